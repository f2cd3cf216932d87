"""Byte-level BPE by a lazily determinised transducer.

Encoding. BPE gives each prefix of a piece a definite last token: the only
token t that ends there such that t may follow the last token of what stands
before it. Two tokens may stand side by side if BPE leaves them apart when it
encodes their joint bytes. So a transducer reads one byte at a time; a state
is the last token it has emitted and the bytes read since then. Of these bytes
only the boundaries from which some token of the vocabulary still reaches past
the present byte matter; tokens on which all of them agree are emitted at
once. No token is longer than the longest vocabulary entry, which bounds the
bytes a state holds and so the lookahead. States and transitions come into
being when first needed; once the table is full, what it lacks is followed
step by step without being kept.

Decoding is a stream as well: bytes of tokens go through a UTF-8 state machine
whose state is the unfinished character, so text leaves it at any cut of the
ids.

Null text: an empty one, with no ids. An empty table gives an empty table.
Repeated rows give repeated rows; further columns are ignored unless asked
for. Texts are worked on one at a time, so a worker holds one Arrow batch, one
document's ids and memos of a fixed number of entries.
"""

from __future__ import annotations

import base64
import functools
import hashlib
from collections.abc import Iterator
from typing import IO

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .chunks import Memo, stretches

#: States a transducer may keep: its memory bound.
MAX_STATES = 150_000


def read_ranks(source: IO[bytes]) -> dict[bytes, int]:
    """A rank file: a token in base64 and its rank on each line."""
    return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, source) if rank}


Alive = tuple[tuple[bytes, tuple[int, ...]], ...]
State = tuple[int, Alive]


class Transducer:
    def __init__(self, ranks: dict[bytes, int], max_states: int = MAX_STATES):
        self.ranks = ranks
        self.tokens = {rank: token for token, rank in ranks.items()}
        self.starts = {token[:i] for token in ranks for i in range(1, len(token))}
        self.max_states = max_states
        self.right = Memo(lambda rank: self._spine(self.tokens[rank], -1), 1 << 20)
        self.left = Memo(lambda rank: self._spine(self.tokens[rank], 0), 1 << 20)
        self.apart = Memo(self._apart, 400_000)
        self.states: list[State] = []
        self.numbers: dict[State, int] = {}
        self.steps: dict[int, tuple[int, tuple[int, ...]]] = {}
        self._number((-1, ((b"", ()),)))

    def _number(self, state: State) -> int:
        if state not in self.numbers:
            self.numbers[state] = len(self.states)
            self.states.append(state)
        return self.numbers[state]

    def _halves(self, token: bytes) -> list[bytes]:
        """The two parts whose merge makes the token."""
        parts = [token[i : i + 1] for i in range(len(token))]
        while len(parts) > 2:
            at = min(range(len(parts) - 1), key=lambda i: self.ranks.get(parts[i] + parts[i + 1], 1 << 60))
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def _spine(self, token: bytes, side: int) -> list[tuple[bytes, int]]:
        """The parts that stand at one end of the token while it is merged, each with the rank of the merge that takes it in."""
        found, until = [(token, 1 << 60)], 0
        while len(token) > 1:
            until = self.ranks[token]
            token = self._halves(token)[side]
            found.append((token, until))
        return found

    def _apart(self, pair: tuple[int, int]) -> bool:
        """Whether BPE can put the second token right after the first: no merge across ever comes before the merges on its sides."""
        get = self.ranks.get
        for a, a_until in self.right[pair[0]]:
            for b, b_until in self.left[pair[1]]:
                across = get(a + b)
                if across is not None and across < a_until and across <= b_until:
                    return False
        return True

    def _grow(self, before: int, alive: Alive, byte: bytes) -> list[tuple[bytes, tuple[int, ...]]]:
        """The boundaries that matter after one more byte, oldest first; the new one, if the encoding can end here, comes last."""
        ended, kept = None, []
        get, starts = self.ranks.get, self.starts
        for open_bytes, chain in alive:
            grown = open_bytes + byte
            token = get(grown)
            if token is not None and ended is None:
                previous = chain[-1] if chain else before
                if previous < 0 or self.apart[previous, token]:
                    ended = (*chain, token)
            if grown in starts:
                kept.append((grown, chain))
        if ended is not None:
            kept.append((b"", ended))
        return kept

    def _step(self, state: int, byte: int) -> tuple[int, tuple[int, ...]]:
        before, alive = self.states[state]
        kept = self._grow(before, alive, bytes((byte,)))
        sure = 0
        oldest = kept[0][1]
        while len(oldest) > sure and all(len(c) > sure and c[sure] == oldest[sure] for _, c in kept):
            sure += 1
        out = oldest[:sure]
        return self._number((out[-1] if out else before, tuple((o, c[sure:]) for o, c in kept))), out

    def piece(self, data: bytes) -> list[int]:
        """The ids of one piece of the pattern."""
        if (whole := self.ranks.get(data)) is not None:
            return [whole]
        state, out, steps, room = 0, [], self.steps, len(self.states) < self.max_states
        for at, byte in enumerate(data):
            key = state << 8 | byte
            found = steps.get(key)
            if found is None:
                if not room:
                    break
                found = steps[key] = self._step(state, byte)
            state, emitted = found
            if emitted:
                out += emitted
        else:
            at = len(data)
        before, alive = self.states[state]
        for i in range(at, len(data)):  # the table is full: follow the boundaries themselves
            alive = self._grow(before, alive, data[i : i + 1])
        open_bytes, chain = alive[-1]
        assert not open_bytes, "the vocabulary lacks a byte"
        out += chain
        return out


class Utf8Stream:
    """Text from bytes that come in any cuts; its state is the unfinished character."""

    def __init__(self) -> None:
        self.open = b""

    @staticmethod
    def _unfinished(data: bytes) -> int:
        """How many bytes at the end begin a character without finishing it."""
        for back in range(1, min(3, len(data)) + 1):
            byte = data[-back]
            if byte < 0x80:
                return 0
            if byte >= 0xC0:
                return back if back < 2 + (byte >= 0xE0) + (byte >= 0xF0) else 0
        return 0

    def feed(self, data: bytes) -> str:
        data = self.open + data
        keep = self._unfinished(data)
        self.open = data[len(data) - keep :]
        return data[: len(data) - keep].decode("utf-8", "replace")

    def close(self) -> str:
        rest, self.open = self.open, b""
        return rest.decode("utf-8", "replace")


class Codec:
    """A vocabulary and its pattern, ready to encode and decode."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        # regex counts the separators 1C to 1F as white space, the token pattern does not
        self.pattern = regex.compile(pattern.replace(r"[^\s", r"[^\t-\r \x85\xa0  -     　").replace(r"(?!\S)", r"(?![^\t-\r \x85\xa0  -     　])").replace(r"\s", r"[\t-\r \x85\xa0  -     　]"))
        self.transducer = Transducer(ranks)
        top = max(ranks.values()) + 1
        self.bytes_of = [b""] * top
        for token, rank in ranks.items():
            self.bytes_of[rank] = token
        self.decimal = list(map(str, range(top)))
        self.later = Memo(lambda stretch: self._ids(" " + stretch), 900_000)

    def _ids(self, stretch: str) -> bytes:
        piece = self.transducer.piece
        return np.array([i for p in self.pattern.findall(stretch) for i in piece(p.encode())], "<u4").tobytes()

    def encode(self, text: str) -> bytes:
        """The ids of text as little-endian unsigned 32-bit numbers."""
        head, *rest = stretches(text)
        return self._ids(head) + b"".join(map(self.later.__getitem__, rest))

    def told(self, packed: bytes) -> str:
        """Packed ids in decimal, with commas between."""
        return ",".join(map(self.decimal.__getitem__, np.frombuffer(packed, "<u4").tolist()))

    def decode(self, packed: bytes, block: int = 8192) -> Iterator[str]:
        """The text of packed ids, streamed in blocks of ids."""
        ids, stream, bytes_of = np.frombuffer(packed, "<u4"), Utf8Stream(), self.bytes_of
        for at in range(0, len(ids), block):
            yield stream.feed(b"".join(map(bytes_of.__getitem__, ids[at : at + block].tolist())))
        yield stream.close()


@functools.lru_cache(2)
def codec(path: str, pattern: str) -> Codec:
    with open(path, "rb") as f:
        return Codec(read_ranks(f), pattern)


def encode_documents(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", keep_ids: bool = True) -> DataFrame:
    """id_col, n_tokens, ids (array<int>, with keep_ids), decoded text's and ids' digests."""
    kind = docs.select(id_col).schema[0].dataType.simpleString()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path, pattern)
        for batch in batches:
            counts, ids, told_sha, text_sha = [], [], [], []
            for value in batch.column(1):
                packed = own.encode(value.as_py() or "")
                seen = hashlib.sha256()
                for text in own.decode(packed):
                    seen.update(text.encode())
                counts.append(len(packed) // 4)
                told_sha.append(hashlib.sha256(own.told(packed).encode()).hexdigest())
                text_sha.append(seen.hexdigest())
                if keep_ids:
                    ids.append(np.frombuffer(packed, "<i4"))
            out = [batch.column(0), pa.array(counts, pa.int64()), pa.array(told_sha, pa.string()), pa.array(text_sha, pa.string())]
            names = ["id", "n_tokens", "ids_sha256", "decoded_sha256"]
            if keep_ids:
                out, names = [*out, pa.array(ids, pa.list_(pa.int32()))], [*names, "ids"]
            yield pa.RecordBatch.from_arrays(out, names)

    schema = f"id {kind}, n_tokens bigint, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * keep_ids
    # named apart from the input's columns, then named as asked
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(work, schema).withColumnRenamed("id", id_col)
