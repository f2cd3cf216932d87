"""Context-triggered piecewise hashing: fingerprints of texts, compared by edit distance.

A hash rolls over the last WINDOW bytes. Where it is divisible by the block
size a chunk ends, so an edit moves no boundary but those beside it. Block
sizes are 3 * 2**k; the boundaries of one are among those of the size below. A
text's own is the smallest that its length divides into 3/4 MOST blocks or
fewer, or the next above that gives MOST - 1 boundaries or fewer. Each chunk
becomes one sign of a signature; a fingerprint has the signatures at the own
size and at twice that, as "size:signs:signs".

Two fingerprints are compared where their block sizes meet, at equal sizes or
one twice the other. The likeness of two signatures is 1 - d / (a + b), d the
insertions and deletions that make one of the other, a and b their lengths; it
is 0 unless they share a run of RUN signs, as chance gives every pair of
signatures some signs in common.

The whole text is read, a block at a time, and no more than MOST boundaries are
held, however long it is. Signatures of fewer than RUN chunks spend RUN signs
on each, so that short and monotonous texts are told apart too.

Edge cases. Null text: as empty. Empty text: the fingerprint "3::", like only
to itself. Equal texts have equal fingerprints, and likeness 1. Rows that
repeat id and text stand side by side, each the next of the one before. A null
id is an id, the last in descending order. One row alone is its own next. An
empty table gives an empty table. Further columns are left out.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType

from .common import settle

#: Bytes that the rolling hash sees (a power of two), chunks of a signature at most, equal signs in a row that likeness asks for.
WINDOW, MOST, RUN = 16, 64, 4
#: Bytes that are hashed at a time.
BLOCK = 1 << 18
#: The smallest block size, and how often it can be doubled within 32 bits.
LEAST, DOUBLINGS = 3, 30
#: Pairs of signatures compared at a time.
PAIRS = 512

SIGNS = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"

_STEP = 0x9E3779B97F4A7C15  # odd, so it has an inverse modulo 2**64
_MASK = (1 << 64) - 1
_BACK = pow(_STEP, -1, 1 << 64)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, "u8")
    out[0] = 1
    return np.multiply.accumulate(out)


_UP, _DOWN = _powers(_STEP, BLOCK + 1), _powers(_BACK, BLOCK + 1)


def _rolled(padded: np.ndarray) -> np.ndarray:
    """The hash of each WINDOW bytes in a row, all bits mixed."""
    h, reach, factor = padded.astype("u4") + np.uint32(1), 1, 0x01000193
    while reach < WINDOW:  # from two halves, so that WINDOW is a power of two
        h = h[:-reach] * np.uint32(factor) + h[reach:]
        reach, factor = 2 * reach, factor * factor & 0xFFFFFFFF
    for shift, factor in ((16, 0x85EBCA6B), (13, 0xC2B2AE35)):
        h ^= h >> np.uint32(shift)
        h *= np.uint32(factor)
    return h ^ (h >> np.uint32(16))


def _level(h: np.ndarray) -> np.ndarray:
    """How often LEAST can be doubled and still divide a hash that it divides."""
    q = (h // np.uint32(LEAST)).astype("i8")
    return np.where(q, np.log2(np.maximum(q & -q, 1)), DOUBLINGS).astype("i8")


class _Boundaries:
    """Chunk ends at the text's block size: of each its level, its place, the sum up to it and the factor that moves that sum to 0."""

    def __init__(self, raw: np.ndarray):
        self.n, self.k, self.total = len(raw), max(0, (4 * len(raw) - 1) // (3 * LEAST * MOST)).bit_length(), 0
        self.level, self.place, self.sums, self.down = (np.zeros(0, t) for t in ("i8", "i8", "u8", "u8"))
        up, down = 1, 1
        for start in range(0, len(raw), BLOCK):
            part = raw[start : start + BLOCK]
            lead = raw[max(0, start - WINDOW + 1) : start]
            h = _rolled(np.concatenate([np.zeros(WINDOW - 1 - len(lead), "u1"), lead, part]))
            at, level = self._found(h)
            sums = np.cumsum((part.astype("u8") + np.uint64(1)) * _UP[: len(part)])
            here = (level, start + at + 1, np.uint64(self.total) + sums[at] * np.uint64(up), _DOWN[at + 1] * np.uint64(down))
            both = [np.concatenate(x) for x in zip((self.level, self.place, self.sums, self.down), here, strict=True)]
            self.level, self.place, self.sums, self.down = (x[both[0] >= self.k] for x in both)
            self.total = (self.total + int(sums[-1]) * up) & _MASK
            up, down = (up * int(_UP[len(part)])) & _MASK, (down * int(_DOWN[len(part)])) & _MASK

    def _found(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where windows end whose level stays few enough, and their levels; more text can only raise that level."""
        at = np.flatnonzero(h % np.uint32(LEAST << min(self.k, DOUBLINGS)) == 0)
        level = _level(h[at])
        reach = np.cumsum(np.bincount(np.concatenate([self.level, level]), minlength=DOUBLINGS + 1)[::-1])[::-1]
        self.k = max(self.k, int(np.count_nonzero(reach >= MOST)))
        keep = level >= self.k
        return at[keep], level[keep]

    def signature(self, k: int) -> str:
        if not self.n:
            return ""
        on = (self.level >= k) & (self.place < self.n)
        before = np.concatenate([np.zeros(1, "u8"), self.sums[on]])
        h = np.append(before[1:], np.uint64(self.total)) - before
        h[1:] *= self.down[on]
        h ^= h >> np.uint64(32)
        h *= np.uint64(0xD6E8FEB86659FD93)
        h ^= h >> np.uint64(29)
        shifts = range(58, 58 - 6 * (1 if len(h) >= RUN else RUN), -6)
        return "".join([SIGNS[x >> shift & 63] for x in h.tolist() for shift in shifts])


def fingerprint(text: str | None) -> str:
    """size:signs:signs of a whole text."""
    found = _Boundaries(np.frombuffer((text or "").encode(), "u1"))
    return f"{LEAST << found.k}:{found.signature(found.k)}:{found.signature(found.k + 1)}"


def _codes(signs: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Signs as numbers in rows of MOST, and how many there are."""
    look = np.zeros(128, "u1")
    look[np.frombuffer(SIGNS.encode(), "u1")] = np.arange(len(SIGNS))
    size = np.array([len(s) for s in signs], "i8")
    return look[np.frombuffer("".join(s.ljust(MOST, "A") for s in signs).encode(), "u1")].reshape(-1, MOST), size


def _common(a: np.ndarray, a_size: np.ndarray, b: np.ndarray, b_size: np.ndarray) -> np.ndarray:
    """Length of the longest common subsequence of each pair, one bit a sign."""
    row, at = np.arange(len(a)), np.arange(MOST)
    where = np.zeros((len(a), len(SIGNS)), "u8")
    for i in range(int(a_size.max(initial=0))):
        where[row, a[:, i]] |= np.where(i < a_size, np.uint64(1) << np.uint64(i), np.uint64(0))
    free = np.full(len(a), _MASK, "u8")
    for j in range(int(b_size.max(initial=0))):
        met = free & np.where(j < b_size, where[row, b[:, j]], np.uint64(0))
        free = (free + met) | (free - met)
    return ((~free[:, None] >> at.astype("u8")) & np.uint64(1)).sum(1).astype("i8")


def _share_run(a: np.ndarray, a_size: np.ndarray, b: np.ndarray, b_size: np.ndarray) -> np.ndarray:
    """Whether RUN signs in a row stand in both."""
    runs = []
    for signs, size, none in ((a, a_size, -1), (b, b_size, -2)):
        gram = np.zeros((len(signs), MOST - RUN + 1), "i8")
        for j in range(RUN):
            gram = gram * 64 + signs[:, j : j + gram.shape[1]]
        runs.append(np.where(np.arange(gram.shape[1]) <= (size - RUN)[:, None], gram, none))
    return (runs[0][:, :, None] == runs[1][:, None, :]).any((1, 2))


def _alike(left: list[str], right: list[str]) -> np.ndarray:
    """Likeness of signatures, pair by pair."""
    out = np.zeros(len(left))
    for lo in range(0, len(left), PAIRS):
        a, a_size = _codes(left[lo : lo + PAIRS])
        b, b_size = _codes(right[lo : lo + PAIRS])
        score = 2 * _common(a, a_size, b, b_size) / np.maximum(a_size + b_size, 1)
        out[lo : lo + PAIRS] = np.where(_share_run(a, a_size, b, b_size), score, 0)
    return out


def likeness(left: list[str], right: list[str]) -> np.ndarray:
    """How alike the texts of two lists of fingerprints are, from 0 to 1, pair by pair."""
    best = np.array([float(a == b) for a, b in zip(left, right, strict=True)])
    row, one, two = [], [], []
    for i, (x, y) in enumerate(zip(left, right, strict=True)):
        if x == y:
            continue
        (s, *a), (t, *b) = x.split(":"), y.split(":")
        s, t = int(s), int(t)
        met = [(a[0], b[0]), (a[1], b[1])] if s == t else [(a[1], b[0])] if 2 * s == t else [(a[0], b[1])] if s == 2 * t else []
        for p, q in met:
            row.append(i)
            one.append(p)
            two.append(q)
    np.maximum.at(best, np.array(row, "i8"), _alike(one, two))
    return best


@F.pandas_udf(StringType())
def _fingerprints(texts: pd.Series) -> pd.Series:
    return texts.map(fingerprint, na_action=None)


@F.pandas_udf(DoubleType())
def _likenesses(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series(likeness(a.tolist(), b.tolist()))


def with_fingerprint(docs: DataFrame, name: str = "fingerprint", text_col: str = "text") -> DataFrame:
    """docs and the fingerprint of each text."""
    return docs.withColumn(name, _fingerprints(F.coalesce(F.col(text_col), F.lit(""))))


def alike(a: Column, b: Column) -> Column:
    """Likeness of two columns of fingerprints."""
    return _likenesses(a, b)


def spliced(text: str, after: str) -> str:
    """text with its second half (its shorter half, if odd) replaced by the beginning of another."""
    half = len(text) // 2
    return text[: len(text) - half] + after[:half]


_DONE = "id {id}, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
_HEAD, _TAIL = 1, 2


def _told(ids: list, texts: list[str], prints: list[str], after: list[str], after_prints: list[str]) -> list[list]:
    """The columns of _DONE for texts and their next ones."""
    edited = [spliced(t, a) for t, a in zip(texts, after, strict=True)]
    marks = [fingerprint(e) for e in edited]
    digests = [hashlib.sha256(e.encode()).hexdigest() for e in edited]
    return [ids, [len(t) for t in texts], digests, prints, marks, likeness(prints, marks).tolist(), likeness(prints, after_prints).tolist()]


def _along(batches: Iterator[pa.RecordBatch], id_type: pa.DataType) -> Iterator[pa.RecordBatch]:
    """Each row of a sorted partition beside the next; the first and the last also as edges, with their texts."""
    here = TaskContext.get().partitionId()
    last: tuple | None = None

    def batch_of(columns: list[list], kind: int = 0, texts: list | None = None) -> pa.RecordBatch:
        n = len(columns[0])
        kinds = [id_type, pa.int64(), *[pa.string()] * 3, *[pa.float64()] * 2]
        more = [pa.array([kind] * n, pa.int32()), pa.array([here] * n, pa.int32()), pa.array(texts or [None] * n, pa.string())]
        return pa.RecordBatch.from_arrays([*(pa.array(c, k) for c, k in zip(columns, kinds, strict=True)), *more], ["id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next", "kind", "part", "text"])

    def edge(row: tuple, kind: int) -> pa.RecordBatch:
        return batch_of([[row[0]], [None], [None], [row[2]], [None], [None], [None]], kind, [row[1]])

    for batch in batches:
        for lo in range(0, batch.num_rows, PAIRS):
            ids, texts = (c.to_pylist() for c in batch.slice(lo, PAIRS).columns)
            rows = list(zip(ids, texts, map(fingerprint, texts), strict=True))
            if last is None:
                yield edge(rows[0], _HEAD)
            else:
                rows.insert(0, last)
            last = rows[-1]
            i, t, p = map(list, zip(*rows, strict=True))
            if len(rows) > 1:
                yield batch_of(_told(i[:-1], t[:-1], p[:-1], t[1:], p[1:]))
    if last is not None:
        yield edge(last, _TAIL)


def splice_and_compare(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each document's fingerprint beside those of its edited text and of the next document, in descending order of ids, the first after the last.

    Texts are sorted over the cluster by one shuffle, so that the next document
    is the next row of the task; only the last row of a partition has to be
    brought the first of a later one, and that is two rows a partition. Equal
    ids are ordered by a hash of the text, equal rows by where they stand, so
    that no id and no text makes one partition large.
    """
    kind = docs.select(id_col).schema[0].dataType
    id_type = docs.select(F.col(id_col).alias("id")).limit(0).toArrow().schema.field(0).type
    schema = f"{_DONE.format(id=kind.simpleString())}, kind int, part int, text string"
    named = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    order = [F.col("id").desc_nulls_last(), F.xxhash64("text"), F.col("place")]
    dealt = named.withColumn("place", F.monotonically_increasing_id()).repartitionByRange(*order).sortWithinPartitions(*order)
    found = settle(dealt.select("id", "text").mapInArrow(lambda b: _along(b, id_type), schema))
    done = [c for c in found.columns if c not in ("kind", "part", "text")]

    def across(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = _told(*(c.to_pylist() for c in batch.columns))
            kinds = [id_type, pa.int64(), *[pa.string()] * 3, *[pa.float64()] * 2]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], done)

    parts = Window.orderBy("part")  # one small row a partition
    after = found.where(F.col("kind") == _HEAD).select("part").withColumn("next", F.coalesce(F.lead("part").over(parts), F.min("part").over(Window.partitionBy())))
    tails = found.where(F.col("kind") == _TAIL).select("part", "id", "text", "fingerprint")
    heads = found.where(F.col("kind") == _HEAD).select(F.col("part").alias("next"), F.col("text").alias("next_text"), F.col("fingerprint").alias("next_fingerprint"))
    joined = tails.join(after, "part").join(heads, "next").select("id", "text", "fingerprint", "next_text", "next_fingerprint")
    edges = joined.mapInArrow(across, _DONE.format(id=kind.simpleString()))
    return found.where("kind = 0").select(*done).unionByName(edges).withColumnRenamed("id", id_col)
