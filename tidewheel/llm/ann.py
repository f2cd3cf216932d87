"""Approximate nearest neighbours in low-dimensional stable projections.

Vectors are scaled to length one, so that the nearest by cosine are the
nearest by distance, and projected by a Gaussian (2-stable) matrix to M
numbers. The square of a projected distance over that of the true one follows
a chi-square law with M degrees of freedom. So if d is the distance of the
k-th best vector verified so far, a vector nearer than d lies within
d * sqrt(quantile(CONFIDENCE)) in the projection with probability CONFIDENCE:
once the next projected neighbour is farther than that, the search stops.

The projected space is cut into cells by a kd-tree fitted on a bounded sample
(at least SAMPLE rows, those of smallest hashed id, or four a cell); every row
is indexed. Cells hold about CELL rows; beyond MANY_CELLS their number grows
with the root of the rows, as the driver holds a box for each. A cell that
holds more is dealt over blocks. Each block builds one kd-tree of its own and
hands out its leaves in the order of their projected distance; what lies in
them is verified on the original vectors until the test holds. A query first
searches the cell it lies in, which yields its d, and then, in a second round,
only the cells whose box the test does not rule out. Vectors move once a
round; only where more than QUERY_BLOCK queries ask one block is it copied,
once for each so many of them.

How much is pruned hangs on the data: where the nearest are hardly nearer than
the rest, as with random directions, the test rules out little, and most
vectors are verified (README).

Equal vectors are one vector with the K + 1 smallest ids, which is all that a
list of K can show of them: a vector that very many rows share is no hot spot.
They are told by a 128-bit hash, so that no vector moves to be compared.

Edge cases. Vectors that are null, zero, or hold null or non-finite numbers
take no part, as query or candidate. Vectors of different lengths are tables
of their own. Rows that repeat id and vector count once. Fewer candidates than
K give a shorter list. Ties go to the smaller id. A null id takes no part. An
empty table gives an empty table. Further columns are ignored, whatever they
are called. Long vectors make blocks of more bytes, not more rows.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import MAX_KEYS, drop_rows, row_count, settle

K = 5
M = 8
CONFIDENCE = 0.97
SAMPLE = 20_000
CELL, MANY_CELLS = 4096, 4096
LEAF = 256
QUERY_BLOCK = 16_384
SALTS = 64
SEED = 7


def chi_square_quantile(p: float, m: int = M) -> float:
    """The p-quantile of the chi-square law with an even number m of degrees of freedom."""
    below = lambda x: 1 - math.exp(-x / 2) * sum((x / 2) ** i / math.factorial(i) for i in range(m // 2))
    low, high = 0.0, 1e4
    for _ in range(200):
        middle = (low + high) / 2
        low, high = (middle, high) if below(middle) < p else (low, middle)
    return high


def unit(x: np.ndarray) -> np.ndarray:
    """Rows scaled to length one; their largest number comes first to one, so that none overflows."""
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


class Tree:
    """A kd-tree over points: median cuts of the widest side until a leaf is small."""

    def __init__(self, points: np.ndarray, leaf: int = LEAF):
        self.low, self.high, self.children, self.members, self.cuts = [], [], [], [], []
        self._add(points, np.arange(len(points)), leaf)

    def _add(self, points: np.ndarray, rows: np.ndarray, leaf: int) -> int:
        me, own = len(self.low), points[rows]
        self.low.append(own.min(0))
        self.high.append(own.max(0))
        self.children.append(None)
        self.cuts.append(None)
        self.members.append(rows)
        side = int(np.argmax(self.high[me] - self.low[me]))
        if len(rows) > leaf and self.high[me][side] > self.low[me][side]:
            cut = float(np.median(own[:, side]))
            left = own[:, side] < cut
            if not left.any():
                left = own[:, side] <= cut
            self.cuts[me] = (side, float(own[left, side].max()))
            self.members[me] = None
            self.children[me] = (self._add(points, rows[left], leaf), self._add(points, rows[~left], leaf))
        return me

    def _away(self, q: np.ndarray, node: int) -> float:
        gap = np.maximum(np.maximum(self.low[node] - q, q - self.high[node]), 0)
        return float(gap @ gap)

    def leaves(self, q: np.ndarray) -> Iterator[tuple[float, np.ndarray]]:
        """Squared distance of the box and rows of each leaf, nearest first."""
        heap = [(self._away(q, 0), 0)]
        while heap:
            away, node = heapq.heappop(heap)
            if self.children[node] is None:
                yield away, self.members[node]
            else:
                for child in self.children[node]:
                    heapq.heappush(heap, (self._away(q, child), child))

    def cell_of(self, points: np.ndarray) -> np.ndarray:
        """The leaf each point falls in, by the cuts."""
        at = np.zeros(len(points), "i4")
        for node, cut in enumerate(self.cuts):  # children have larger numbers than their parent
            if cut:
                here = np.flatnonzero(at == node)
                left = points[here, cut[0]] <= cut[1]
                at[here] = np.where(left, *self.children[node])
        return at


def _search(tree: Tree, projected: np.ndarray, vectors: np.ndarray, q_projected: np.ndarray, q: np.ndarray, k: int, bound: float, factor: float) -> tuple[np.ndarray, np.ndarray]:
    """Rows and squared distances of the verified vectors that may be among the k nearest; bound: a squared distance already reached."""
    rows, squares, best = [], [], np.zeros(0)
    for away, members in tree.leaves(q_projected):
        if away > factor * bound:
            break
        gap = projected[members] - q_projected
        near = members[(gap * gap).sum(1) <= factor * bound]
        if len(near):
            square = np.maximum(2 - 2 * (vectors[near] @ q), 0)
            rows.append(near)
            squares.append(square)
            best = np.sort(np.concatenate([best, square]))[:k]
            if len(best) == k:
                bound = min(bound, best[-1])
    if not rows:
        return np.zeros(0, int), np.zeros(0)
    rows, squares = np.concatenate(rows), np.concatenate(squares)
    keep = squares <= (best[-1] if len(best) == k else np.inf) + 1e-12
    return rows[keep], squares[keep]


RESULT = "query_id bigint, rank int, vec_id bigint, score double"


def nearest(vectors: DataFrame, queries: F.Column, id_col: str = "vec_id", vector_col: str = "embedding", k: int = K, confidence: float = CONFIDENCE, seed: int = SEED) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest others of each row for which queries is true."""
    plain = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v"), F.coalesce(queries, F.lit(False)).alias("asks"))
    fine = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))) & F.exists("v", lambda x: x != 0)
    plain = plain.where(F.col("id").isNotNull() & F.col("v").isNotNull()).where(fine)
    plain = settle(plain.select("*", F.size("v").alias("d"), F.xxhash64("v").alias("h"), F.xxhash64(F.lit(1), "v").alias("h2")))
    out = vectors.sparkSession.createDataFrame([], RESULT)
    for row in plain.groupBy("d").agg(F.count(F.lit(1)).alias("n")).orderBy("d").collect():  # a search for each length of vectors, of which models make few
        out = out.unionByName(_search_width(plain.where(F.col("d") == row["d"]), row["d"], k, confidence, seed))
    return out


def _different(plain: DataFrame, k: int) -> DataFrame:
    """ids (the k + 1 smallest, sorted) and v of each different vector. plain: id, v, h, h2."""
    key = ["h", "h2"]
    shared = settle(plain.groupBy(*key).agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(*key))
    alone = drop_rows(plain, shared, [F.col("h"), F.col("h2")]).select(F.array("id").alias("ids"), "v")
    few = F.broadcast(shared) if row_count(shared) <= MAX_KEYS else shared
    # first by salt, then over the salts
    least = lambda *by: Window.partitionBy(*by).orderBy("id")
    mates = plain.join(few, key, "left_semi").select("id", *key).distinct().withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(SALTS)))
    mates = mates.withColumn("r", F.row_number().over(least(*key, "salt"))).where(F.col("r") <= k + 1)
    mates = mates.withColumn("r", F.row_number().over(least(*key))).where(F.col("r") <= k + 1)
    groups = mates.groupBy(*key).agg(F.sort_array(F.collect_list("id")).alias("ids")).withColumn("id", F.element_at("ids", 1))  # k + 1 ids at most
    return alone.unionByName(plain.join(groups, ["id", *key]).dropDuplicates(key).select("ids", "v"))


def _search_width(plain: DataFrame, width: int, k: int, confidence: float, seed: int) -> DataFrame:
    base = settle(_different(plain, k).select("ids", "v"))
    n = row_count(base)
    matrix = np.random.default_rng(seed).standard_normal((width, M))
    wanted = max(1, min(n // CELL, int((MANY_CELLS * n / CELL) ** 0.5)))
    sample = base.orderBy(F.xxhash64(F.col("ids")[0], F.lit(seed))).limit(max(SAMPLE, 4 * wanted)).select("v").toArrow()
    points = unit(np.asarray(sample["v"].combine_chunks().values).reshape(-1, width)) @ matrix
    top = Tree(points, max(1, len(points) // wanted))
    cells = len(top.low)

    def stack(column: pd.Series) -> np.ndarray:
        return unit(np.stack(column.to_list()).astype("f8")) if len(column) else np.zeros((0, width))

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            flat = batch.column(1).flatten()
            at = top.cell_of(unit(np.asarray(flat).reshape(-1, width)) @ matrix) if batch.num_rows else np.zeros(0, "i4")
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(at.astype("i4"))], ["ids", "v", "cell"])

    placed = settle(base.select("ids", "v").mapInArrow(assign, "ids array<bigint>, v array<double>, cell int"))

    def boxes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cell = np.asarray(batch.column(1))
            p = unit(np.asarray(batch.column(0).flatten()).reshape(-1, width)) @ matrix if len(cell) else np.zeros((0, M))
            kinds = np.unique(cell)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.repeat(kinds, M)),
                    pa.array(np.tile(np.arange(M, dtype="i4"), len(kinds))),
                    pa.array(np.concatenate([p[cell == c].min(0) for c in kinds]) if len(kinds) else np.zeros(0)),
                    pa.array(np.concatenate([p[cell == c].max(0) for c in kinds]) if len(kinds) else np.zeros(0)),
                    pa.array(np.repeat([int((cell == c).sum()) for c in kinds], M).astype("i8")),
                ],
                ["cell", "side", "low", "high", "n"],
            )

    found = placed.select("v", "cell").mapInArrow(boxes, "cell int, side int, low double, high double, n bigint")
    low, high, held = np.full((cells, M), np.inf), np.full((cells, M), -np.inf), np.zeros(cells, "i8")
    for r in found.groupBy("cell", "side").agg(F.min("low").alias("low"), F.max("high").alias("high"), F.sum("n").alias("n")).collect():  # cells x M rows
        low[r["cell"], r["side"]], high[r["cell"], r["side"]], held[r["cell"]] = r["low"], r["high"], r["n"]
    blocks = -(-held // (2 * CELL))
    full = np.flatnonzero(held > 0)
    factor = chi_square_quantile(confidence)

    asked = settle(plain.where("asks").dropDuplicates(["id", "h", "h2"]).select("id", "v"))

    def send(home_only: bool):
        def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                bound = np.asarray(batch.column(2))
                p = unit(np.asarray(batch.column(1).flatten()).reshape(-1, width)) @ matrix if batch.num_rows else np.zeros((0, M))
                rows, to, block = [], [], []
                for i in range(batch.num_rows):
                    gap = np.maximum(np.maximum(low[full] - p[i], p[i] - high[full]), 0)
                    away = (gap * gap).sum(1)
                    home = int(np.argmin(away))
                    picked = full[[home]] if home_only else np.delete(full, home)[np.delete(away, home) <= factor * bound[i]]
                    for c in picked:
                        rows += [i] * int(blocks[c])
                        to += [c] * int(blocks[c])
                        block += range(int(blocks[c]))
                take = pa.array(rows, pa.int64())
                yield pa.RecordBatch.from_arrays([batch.column(0).take(take), batch.column(1).take(take), batch.column(2).take(take), pa.array(to, pa.int32()), pa.array(block, pa.int32())], ["id", "v", "bound", "cell", "block"])

        return work

    spread = placed.withColumn("block", F.pmod(F.xxhash64("v"), F.element_at(F.lit([max(1, int(b)) for b in blocks]), F.col("cell") + 1)).cast("int"))

    def within(mine: pd.DataFrame, asking: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(mine) and len(asking):
            vectors, q = stack(mine["v"]), stack(asking["v"])
            raw, raw_q = np.stack(mine["v"].to_list()).astype("f8"), np.stack(asking["v"].to_list()).astype("f8")
            projected, q_projected = vectors @ matrix, q @ matrix
            tree, ids = Tree(projected), mine["ids"].to_list()
            for i, (who, bound) in enumerate(zip(asking["id"], asking["bound"], strict=True)):
                # one more than k, as the query's own vector may be among them
                rows, squares = _search(tree, projected, vectors, q_projected[i], q[i], k + 1, bound, factor)
                for row in rows[np.argsort(squares, kind="stable")]:
                    a, b = raw[row], raw_q[i]
                    a, b = a / np.abs(a).max(), b / np.abs(b).max()
                    value = float((a * b).sum() / (np.sqrt((a * a).sum()) * np.sqrt((b * b).sum())))
                    out += [(who, other, value) for other in ids[row] if other != who]
        return pd.DataFrame(out, columns=["query_id", "vec_id", "score"]).astype({"query_id": "i8", "vec_id": "i8", "score": "f8"})

    def ask(targets: DataFrame) -> DataFrame:
        targets = settle(targets)
        asks = targets.groupBy("cell", "block").agg(F.count(F.lit(1)).alias("n"))
        asks = settle(asks.select("cell", "block", F.ceil(F.col("n") / QUERY_BLOCK).cast("int").alias("salts")))  # one row a block
        keys = ["cell", "block", "salt"]
        split = targets.join(F.broadcast(asks.where("salts > 1")), ["cell", "block"], "left")
        split = split.withColumn("salt", F.pmod(F.xxhash64("id"), F.coalesce("salts", F.lit(1))).cast("int")).drop("salts")
        # blocks that nothing asks for do not move
        met = spread.join(F.broadcast(asks), ["cell", "block"]).withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1))).drop("salts")
        got = met.groupBy(*keys).cogroup(split.groupBy(*keys)).applyInPandas(within, "query_id bigint, vec_id bigint, score double")
        best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
        return got.distinct().withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)

    sent = "id bigint, v array<double>, bound double, cell int, block int"
    first = settle(ask(asked.withColumn("bound", F.lit(float("inf"))).mapInArrow(send(True), sent)))
    # the k-th score so far bounds the true distance
    reached = first.where(F.col("rank") == k).select(F.col("query_id").alias("id"), F.greatest(2 - 2 * F.col("score"), F.lit(0.0)).alias("bound"))
    again = asked.join(reached, "id", "left").select("id", "v", F.coalesce("bound", F.lit(float("inf"))).alias("bound"))
    second = ask(again.mapInArrow(send(False), sent))
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    merged = first.drop("rank").unionByName(second.drop("rank")).distinct().withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    return merged.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
