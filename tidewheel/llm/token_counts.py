"""Token counts by offset-mapped attribution.

A document is encoded once, whole. Its tokens' byte lengths give each token's
span of characters; these spans are joined by interval to the spans of the
document's fields or sections, and each token is counted there.

A token over a boundary is allocated by one of three rules:
  start     the section that holds the token's first character (default)
  majority  the section that holds most of its characters, the first of equals
  split     each section, by its share of the token's characters inside sections

A token that begins inside a character belongs to that character. A token
outside all sections is not counted. Null and empty texts have no tokens and
no lines, and give no row. Repeated rows give repeated counts. An empty table
gives an empty table. Further columns are ignored. Texts are worked on one at
a time.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .byte_bpe import read_ranks
from .chunks import Memo, stretches

RULES = ("start", "majority", "split")


class Offsets:
    """Byte lengths of the tokens of a text."""

    def __init__(self, path: str, pattern: str):
        with open(path, "rb") as f:
            ranks = read_ranks(f)
        self.encoding = tiktoken.Encoding("offsets", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.wide = {rank: len(token) for token, rank in ranks.items()}
        assert max(self.wide.values()) < 256
        self.later = Memo(lambda stretch: self._lengths(" " + stretch), 400_000)

    def _lengths(self, stretch: str) -> bytes:
        return bytes(map(self.wide.__getitem__, self.encoding.encode_ordinary(stretch)))

    def lengths(self, text: str) -> np.ndarray:
        head, *rest = stretches(text)
        return np.frombuffer(self._lengths(head) + b"".join(map(self.later.__getitem__, rest)), "u1")


def token_spans(data: bytes, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First character and end of each token, in code points."""
    sign = np.cumsum((np.frombuffer(data, "u1") & 0xC0) != 0x80) - 1  # of each byte
    ends = np.cumsum(lengths, dtype="i8")
    return sign[ends - lengths], sign[ends - 1] + 1


def line_spans(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Lines with their line feeds, in code points."""
    raw = np.frombuffer(data, "u1")
    count = np.cumsum((raw & 0xC0) != 0x80)
    breaks = count[np.flatnonzero(raw == 10)]
    ends = breaks if len(breaks) and breaks[-1] == count[-1] else np.append(breaks, count[-1])
    return np.append(0, ends[:-1]), ends


def allocate(tok_a: np.ndarray, tok_b: np.ndarray, sec_a: np.ndarray, sec_b: np.ndarray, rule: str = "start") -> tuple[np.ndarray, np.ndarray]:
    """Tokens of each section and how many of its tokens also touch another one. Sections are sorted and disjoint."""
    n = len(sec_a)
    first = np.searchsorted(sec_b, tok_a, "right")  # the first section that ends after the token begins
    last = np.searchsorted(sec_a, tok_b, "left") - 1
    met = first <= last
    one = met & (first == last)
    counts = np.bincount(first[one], minlength=n).astype("f8")
    crossing = np.zeros(n)
    for a, b, i, j in zip(*(x[met & ~one].tolist() for x in (tok_a, tok_b, first, last)), strict=True):
        shares = np.minimum(sec_b[i : j + 1], b) - np.maximum(sec_a[i : j + 1], a)
        crossing[i : j + 1] += shares > 0
        if rule == "split":
            counts[i : j + 1] += shares / shares.sum()
        else:
            counts[i + (int(np.argmax(shares)) if rule == "majority" else 0)] += 1
    return counts, crossing.astype("i8")


@functools.lru_cache(2)
def offsets(path: str, pattern: str) -> Offsets:
    return Offsets(path, pattern)


def count_tokens(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", sections_col: str | None = None, rule: str = "start") -> DataFrame:
    """id_col, section, start_char, end_char, n_tokens, n_crossing.

    sections_col: array of structs of two integers, the sorted disjoint
    [start, end) of each section in code points; by default the sections are
    the lines of the text. n_tokens is bigint, double under the split rule.
    """
    if rule not in RULES:
        raise ValueError(f"rule must be one of {RULES}")
    kind = docs.select(id_col).schema[0].dataType.simpleString()
    whole = rule != "split"

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = offsets(path, pattern)
        for batch in batches:
            rows, parts = [], []
            for row, value in enumerate(batch.column(1)):
                if not (text := value.as_py()):
                    continue
                data = text.encode()
                if sections_col:
                    given = [tuple(s.values()) for s in batch.column(2)[row].as_py() or []]
                    a, b = np.array(given, "i8").reshape(-1, 2).T
                else:
                    a, b = line_spans(data)
                counts, crossing = allocate(*token_spans(data, own.lengths(text)), a, b, rule)
                rows.append(np.full(len(a), row))
                parts.append((np.arange(len(a)), a, b, counts, crossing))
            section, a, b, counts, crossing = (np.concatenate([p[i] for p in parts]) if parts else np.zeros(0) for i in range(5))
            take = pa.array(np.concatenate(rows) if rows else np.zeros(0, "i8"), pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(take), pa.array(section.astype("i4")), *(pa.array(x.astype("i8")) for x in (a, b)), pa.array(counts.astype("i8" if whole else "f8")), pa.array(crossing.astype("i8"))],
                ["id", "section", "start_char", "end_char", "n_tokens", "n_crossing"],
            )

    columns = [F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")]
    if sections_col:
        columns.append(F.col(sections_col).alias("sections"))
    schema = f"id {kind}, section int, start_char bigint, end_char bigint, n_tokens {'bigint' if whole else 'double'}, n_crossing bigint"
    return docs.select(*columns).mapInArrow(work, schema).withColumnRenamed("id", id_col)
