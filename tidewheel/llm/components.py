"""Connected components by contraction, as joins."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import join_unique, row_count, settle, split_heavy

#: So many edges (8 MB) one task finishes by itself; more are contracted by joins first.
LOCAL_EDGES = 500_000


def _solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """u, m: the smallest node of each node's component, for at most LOCAL_EDGES edges."""
    parts = [np.stack([np.asarray(b.column(i)) for i in (0, 1)]) for b in batches]
    if not parts:
        return
    nodes, at = np.unique(np.concatenate(parts, 1), return_inverse=True)
    a, b = at.reshape(2, -1)
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, label[a], low)
        np.minimum.at(new, label[b], low)
        new = new[new]
        if (new == label).all():
            break
        label = new
    yield pa.RecordBatch.from_arrays([pa.array(nodes), pa.array(nodes[label])], ["u", "m"])


def components(edges: DataFrame) -> DataFrame:
    """node, root for each node of edges (a, b: bigint, not null). A root is some node of its component.

    Each round maps every node to the best of itself and its neighbours and
    contracts the edges: best is the smallest number at first, which undoes
    stars at once, then the smallest hash under a new seed, so that any graph
    shrinks by a factor and rounds grow with the logarithm of its size. Once
    no more than LOCAL_EDGES edges are left, one task finishes them.
    """
    spark = edges.sparkSession
    now = settle(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    levels = []
    while row_count(now) > LOCAL_EDGES:
        rank = F.xxhash64("v", F.lit(len(levels))) if levels else F.col("v")
        # each edge both ways, and its ends as neighbours of themselves
        both = now.select(F.explode(F.array(*[F.struct(F.col(u).alias("u"), F.col(v).alias("v")) for u in "ab" for v in "ab"])).alias("e")).select("e.*")
        step = settle(both.groupBy("u").agg(F.min(F.struct(rank.alias("r"), "v"))["v"].alias("m"), F.count(F.lit(1)).alias("n")))
        levels.append(step)
        ends = _moved(now, step, "a", row_count(now))
        now = settle(_moved(ends, step, "b", row_count(now)).where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    if row_count(now):
        levels.append(settle(now.select("a", "b").coalesce(1).mapInArrow(_solve, "u bigint, m bigint")))
    if not levels:
        return spark.createDataFrame([], "node bigint, root bigint")
    found = levels[-1].selectExpr("u node", "m root")
    for step in reversed(levels[:-1]):
        up = join_unique(step.selectExpr("u node", "m"), found.selectExpr("node m", "root"), "m", "left")
        found = settle(up.select("node", F.coalesce("root", "m").alias("root")))
    return found


def _moved(edges: DataFrame, step: DataFrame, end: str, n: int) -> DataFrame:
    """edges with one end moved to where step maps it; n in step is no less than the edges at a node."""
    heavy, rest = split_heavy(edges, step.select(F.col("u").alias(end), "m", "n"), end, n, "n")
    return heavy.unionByName(rest).drop(end, "n").withColumnRenamed("m", end)
