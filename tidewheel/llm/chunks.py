"""Text stretches that a tokenizer treats alike wherever they stand, and bounded memos over them.

A single white-space character between two others that are not white space is
always the start of a piece, for every pattern that lets a space lead a word
or drops white space. So a text is cut there, and what a tokenizer makes of a
stretch is worked out once for each different stretch a worker meets.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from typing import Any

#: Entries a memo may hold before it starts anew: its memory bound.
MEMO_SIZE = 250_000

_CUT = re.compile(r"(?<=\S) (?=\S)")


def stretches(text: str) -> list[str]:
    """text cut before each single space that stands between two other signs; the space itself is left out of all but the first."""
    if text and len(" ".join(text.split())) == len(text):  # all white space is single and inside, so each space is a cut
        return text.split(" ")
    return _CUT.split(text)


class Memo(dict):
    """make(key) for each key asked for, kept while there is room."""

    def __init__(self, make: Callable[[Any], Any], size: int = MEMO_SIZE):
        super().__init__()
        self.make, self.size = make, size

    def __missing__(self, key: Any) -> Any:
        if len(self) >= self.size:
            self.clear()
        self[key] = value = self.make(key)
        return value
