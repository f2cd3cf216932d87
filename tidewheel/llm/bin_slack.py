"""Packing by minimum bin slack.

Documents become token sequences, each closed by one end id; only those over
the capacity are cut. What is left to decide depends on lengths alone: how
often each length from 1 to the capacity occurs, a table of at most capacity
rows however large the corpus. On it the packing is planned: each bin takes
the longest length left and then, by a bitset dynamic programme over subset
sums of the lengths still available, the combination that leaves the least
slack. That combination is removed, as many times at once as stock allows.

Pieces then get their places in parallel. A piece's rank among those of its
length comes from counts by (length, salt) and a numbering inside each of
these small groups, so a length that a third of the corpus shares is dealt
over all salts; rank and length name a slot of the plan.

Null text: an empty document, that is one end id. Repeated rows are packed
like others. A null id stays null. An empty table gives an empty table.
Further columns are ignored.
"""

from __future__ import annotations

import functools
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zlib
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import settle
from .words import hand_back

CAPACITY = 2048
END_ID = 0
SALTS = 64
#: Words a worker keeps the ids of, twice: those met lately, and those met before. Its memory bound.
MEMO_SIZE = 80_000
#: Words that are looked up at a time, and encoded in one string.
AT_ONCE, IN_ONE = 300_000, 100

#: Bytes of texts that are encoded together.
AT_A_TIME = 1 << 22

_BREAK = np.arange(256, dtype="u1")
_BREAK[[9, 10, 13]] = 32
_LOWER = _BREAK.copy()
_LOWER[65:91] += 32
_LETTER, _STOP, _MARK = np.zeros(256, bool), np.zeros(256, bool), np.zeros(256, bool)
_LETTER[97:123] = True
_STOP[list(b",.")] = True
_MARK[[*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)]] = True


def _bare(words: pa.LargeBinaryArray) -> list[bytes]:
    """The values of an array without the spaces at their ends."""
    offsets, data = np.frombuffer(words.buffers()[1], "i8")[: len(words) + 1], words.buffers()[2].to_pybytes()
    ends, raw = offsets[1:].copy(), np.frombuffer(data, "u1")
    while (spaces := raw[ends - 1] == 32).any():
        ends -= spaces
    return [data[a:b] for a, b in zip(offsets[:-1].tolist(), ends.tolist(), strict=True)]


class WordTokenizer:
    """Ids of a tokenizer that drops white space and case: words between spaces are encoded one by one, each different one once."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer, normalizers

        self.tokenizer = Tokenizer.from_file(path)
        # for letters between single spaces: the tokenizer's pattern for white space, slow, would find nothing to change there
        self.whole, self.spaceless = self.tokenizer.normalizer, normalizers.Sequence([normalizers.NFC(), normalizers.Lowercase()])
        vocabulary = self.tokenizer.get_vocab()
        self.ends_word = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends_word[[i for token, i in vocabulary.items() if token.endswith("</w>")]] = True
        self.memo: dict[bytes, bytes] = {}
        self.older: dict[bytes, bytes] = {}

    def _learn(self, new: list[bytes]) -> None:
        plain, rest = [], []
        for w in new:  # letters are one piece, whose last id alone ends a word
            (plain if w.isalpha() or (not w.isascii() and w.decode().isalpha()) else rest).append(w)
        self.tokenizer.normalizer = self.spaceless
        joined = [plain[i : i + IN_ONE] for i in range(0, len(plain), IN_ONE)]
        for some, got in zip(joined, self.tokenizer.encode_batch_fast([b" ".join(x).decode() for x in joined], add_special_tokens=False), strict=True):
            packed = np.array(got.ids, "<u4")
            ends = np.flatnonzero(self.ends_word[packed]) + 1
            if len(ends) != len(some):
                rest += some
                continue
            data, at = packed.tobytes(), 0
            for word, end in zip(some, (ends * 4).tolist(), strict=True):
                self.memo[word] = data[at:end]
                at = end
        self.tokenizer.normalizer = self.whole
        for word, got in zip(rest, self.tokenizer.encode_batch_fast([w.decode() for w in rest], add_special_tokens=False), strict=True):
            self.memo[word] = np.array(got.ids, "<u4").tobytes()

    def _ids(self, words: list[bytes]) -> list[bytes]:
        if len(self.memo) > MEMO_SIZE:
            self.memo, self.older = {}, self.memo
        found = list(map(self.memo.get, words))
        if None in found:
            lack = {w for w, p in zip(words, found, strict=True) if p is None}
            known = {w: p for w in lack if (p := self.older.get(w)) is not None}
            self.memo |= known
            self._learn(list(lack - known.keys()))
            found = [p if p is not None else self.memo[w] for w, p in zip(words, found, strict=True)]
        return found

    def encode_all(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of an Arrow column of texts one after the other, nulls as empty ones, and where each text's begin."""
        column = texts.cast(pa.large_binary()).fill_null(b"")
        offsets = np.frombuffer(column.buffers()[1], "i8")[column.offset : column.offset + len(column) + 1]
        data = column.buffers()[2]
        raw = np.frombuffer(data, "u1")[offsets[0] : offsets[-1]] if data is not None else np.zeros(0, "u1")
        special = ((raw[:-1] == 60) & (raw[1:] == 124)).any()  # special tokens, <|...|>, are matched before case is dropped
        raw, offsets = (_BREAK if special else _LOWER)[raw], offsets - offsets[0]
        filled = raw != 32
        first = filled.copy()
        first[1:] &= ~filled[:-1]
        inner = offsets[:-1][offsets[:-1] < len(raw)]
        first[inner] |= filled[inner]  # a text begins a word
        first[1:] |= _LETTER[raw[:-1]] & (_STOP if special else _MARK)[raw[1:]]  # and so, by the tokenizer's pattern, does a mark after a letter
        starts = np.flatnonzero(first)
        del filled, first
        ids, counts = [np.zeros(0, "<u4")], [np.zeros(0, "i8")]
        for at in range(0, len(starts), AT_ONCE):
            part = starts[at : at + AT_ONCE]
            end = starts[at + AT_ONCE] if at + AT_ONCE < len(starts) else len(raw)
            # a word with the spaces behind it
            spans = np.append(part, end)
            words = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(part), [None, pa.py_buffer(spans - spans[0]), pa.py_buffer(raw[spans[0] : end])]).dictionary_encode()
            known = self._ids(_bare(words.dictionary))
            flat, size = np.frombuffer(b"".join(known), "<u4"), np.fromiter(map(len, known), "i8", len(known)) // 4
            which = np.asarray(words.indices)
            n = size[which]
            begin = (np.cumsum(size) - size)[which]
            ends = np.cumsum(n)
            ids.append(flat[np.repeat(begin - (ends - n), n) + np.arange(ends[-1])])
            counts.append(n)
        upto = np.concatenate([[0], np.cumsum(np.concatenate(counts))])
        return np.concatenate(ids), upto[np.searchsorted(starts, offsets)]

    def encode(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit numbers."""
        return self.encode_all(pa.array([text]))[0].tobytes()


def _slices(column: pa.Array) -> Iterator[tuple[int, int]]:
    """Rows of AT_A_TIME bytes of text together, one at least: what is worked out for each byte is held for these only."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False))
    lo = 0
    while lo < len(ends):
        hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + AT_A_TIME, "right")))
        yield lo, hi
        lo = hi


@functools.lru_cache(2)
def tokenizer(path: str) -> WordTokenizer:
    return WordTokenizer(path)


def cut_documents(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """id, piece, start, length, ids_crc32 of each piece of each document."""
    kind = docs.select(id_col).schema[0].dataType.simpleString()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hand_back()
        own, end = tokenizer(path), np.array([end_id], "<u4").tobytes()
        for batch in (whole.slice(lo, hi - lo) for whole in batches for lo, hi in _slices(whole.column(1))):
            rows, piece, start, length, crc = [], [], [], [], []
            ids, begin = own.encode_all(batch.column(1))
            for row in range(batch.num_rows):
                packed = ids[begin[row] : begin[row + 1]].tobytes() + end
                for k, at in enumerate(range(0, len(packed), 4 * capacity)):
                    part = packed[at : at + 4 * capacity]
                    rows.append(row)
                    piece.append(k)
                    start.append(at // 4)
                    length.append(len(part) // 4)
                    crc.append(zlib.crc32(part))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(rows, pa.int64())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())],
                ["id", "piece", "start", "length", "ids_crc32"],
            )
            hand_back()

    return docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(work, f"id {kind}, piece int, start bigint, length bigint, ids_crc32 bigint")


def fullest(stock: list[tuple[int, int]], room: int) -> dict[int, int]:
    """The combination of lengths, each at most as often as in stock, with the largest sum up to room. stock: (length, count), longest first."""
    mask, reach, trail = (2 << room) - 1, 1, []
    for length, count in stock:
        if length > room:
            continue
        most, take = min(count, room // length), 1
        while most > 0:
            take = min(take, most)
            grown = reach | (reach << take * length & mask)
            if grown != reach:
                trail.append((length, take, reach))
                reach = grown
            most -= take
            take *= 2
        if reach >> room & 1:
            break
    target, found = reach.bit_length() - 1, {}
    for length, take, before in reversed(trail):
        if not before >> target & 1:
            found[length] = found.get(length, 0) + take
            target -= take * length
    return found


def plan_bins(counts: dict[int, int], capacity: int = CAPACITY) -> tuple[np.ndarray, int]:
    """Slots (length, first rank, first sequence, offset), each for a run of ranks and sequences, and the number of sequences."""
    left, used = {k: n for k, n in counts.items() if n > 0}, dict.fromkeys(counts, 0)
    slots, sequences = [], 0
    while left:
        stock = sorted(left.items(), reverse=True)
        longest = stock[0][0]
        rest = [(longest, stock[0][1] - 1), *stock[1:]] if stock[0][1] > 1 else stock[1:]
        chosen = fullest(rest, capacity - longest)
        chosen[longest] = chosen.get(longest, 0) + 1
        times, offset = min(left[k] // n for k, n in chosen.items()), 0
        for length, n in sorted(chosen.items(), reverse=True):
            for _ in range(n):
                slots.append((length, used[length], sequences, offset))
                used[length] += times
                offset += length
            left[length] -= n * times
            if not left[length]:
                del left[length]
        sequences += times
    return np.array(sorted(slots), "i8").reshape(-1, 4), sequences


def pack_pieces(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """pieces with sequence_id and offset. pieces: id, piece, start, length, ids_crc32; read twice, so it should be settled."""
    salts = max(SALTS, int(pieces.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    salted = pieces.withColumn("salt", F.pmod(F.xxhash64("id", "piece", "ids_crc32"), F.lit(salts)))
    groups = settle(salted.groupBy("length", "salt").agg(F.count(F.lit(1)).alias("n")))
    counts = {r["length"]: r["n"] for r in groups.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most capacity rows
    slots, _ = plan_bins(counts, capacity)
    upto = Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    groups = groups.select("length", "salt", F.coalesce(F.sum("n").over(upto), F.lit(0)).alias("below"))
    inside = Window.partitionBy("length", "salt").orderBy("id", "piece", "ids_crc32")
    # groups holds at most capacity x salts rows
    ranked = salted.join(F.broadcast(groups), ["length", "salt"]).withColumn("rank", F.col("below") + F.row_number().over(inside) - 1)

    names = [*pieces.columns, "sequence_id", "offset"]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys = slots[:, 0] << 44 | slots[:, 1]
        for batch in batches:
            length, rank = (np.asarray(batch.column(i)).astype("i8") for i in (3, 5))
            at = np.searchsorted(keys, length << 44 | rank, "right") - 1
            sequence = slots[at, 2] + rank - slots[at, 1]
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(sequence), pa.array(slots[at, 3])], names)

    kind = pieces.schema[0].dataType.simpleString()
    schema = f"id {kind}, piece int, start bigint, length bigint, ids_crc32 bigint, sequence_id bigint, offset bigint"
    return ranked.select("id", "piece", "start", "length", "ids_crc32", "rank").mapInArrow(place, schema)


def pack_documents(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """id_col, piece, start, length, ids_crc32, sequence_id, offset: every document packed."""
    pieces = settle(cut_documents(docs, path, id_col, text_col, capacity, end_id))
    return pack_pieces(pieces, capacity).withColumnRenamed("id", id_col)
