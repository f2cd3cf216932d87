"""Versions of a table: order-free hashes by bucket, and a tree of them, so that what changed is found without reading both tables.

A row falls in a bucket by the hash of its keys. A bucket's leaf has its count
and two sums over its rows' hashes (exclusive or, and a sum of halves), which
no order, partitioning or file layout changes; equal rows twice over do not
cancel out, as the sum and the count tell them. FAN neighbours make a node
above. Two versions are compared from the root down: only children of nodes
that differ are looked at.

Edge cases. Null values and null keys are hashed as such. An empty table has a
tree of empty leaves. Tables of other columns differ everywhere, as the names
and types of columns are part of every hash.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .lineage import settled

FAN = 8
TREE = "level int, node bigint, n bigint, hash bigint"


def version_tree(df: DataFrame, keys: list[str], levels: int = 3) -> DataFrame:
    """level (0 is the root), node, n, hash: a tree of FAN**levels buckets, to be stored beside the table."""
    names = sorted(df.columns)
    layout = ",".join(f"{c} {df.schema[c].dataType.simpleString()}" for c in names)
    quoted = ["`" + c.replace("`", "``") + "`" for c in names]
    row = F.xxhash64(F.lit(layout), *(x for c in quoted for x in (F.col(c).isNull(), F.col(c))))
    buckets = FAN**levels
    place = F.pmod(F.xxhash64(*("`" + k.replace("`", "``") + "`" for k in keys)), F.lit(buckets))
    held = df.select(place.alias("node"), row.alias("h")).groupBy("node").agg(F.count(F.lit(1)).alias("n"), F.bit_xor("h").alias("x"), F.sum(F.shiftrightunsigned("h", 40)).alias("s"))
    every = df.sparkSession.range(buckets).select(F.col("id").alias("node")).join(held, "node", "left")
    leaves = every.select(F.lit(levels).alias("level"), "node", F.coalesce("n", F.lit(0)).alias("n"), F.xxhash64(F.lit(layout), "n", "x", "s").alias("hash"))
    tree = below = leaves = settled(leaves.coalesce(1))
    for level in range(levels - 1, -1, -1):
        above = below.groupBy(F.expr(f"node div {FAN}").alias("node")).agg(F.sum("n").alias("n"), F.xxhash64(F.array_sort(F.collect_list(F.struct("node", "hash")))).alias("hash"))
        below = above.select(F.lit(level).alias("level"), "node", "n", "hash")
        tree = tree.unionByName(below)
    return settled(tree.coalesce(1))  # a few hundred small rows


def changed_buckets(old: DataFrame, new: DataFrame) -> DataFrame:
    """node, n_old, n_new: the buckets in which two stored trees differ, found from their roots down."""
    levels = new.agg(F.max("level")).first()[0]
    here = None
    for level in range((levels or 0) + 1):
        a, b = (t.where(F.col("level") == level).select("node", "n", "hash") for t in (old, new))
        if here is not None:
            above = here.select(F.col("node").alias("parent"))
            a, b = (t.join(above, F.expr(f"node div {FAN}") == F.col("parent"), "left_semi") for t in (a, b))
        met = a.withColumnsRenamed({"n": "n_old", "hash": "h_old"}).join(b.withColumnsRenamed({"n": "n_new", "hash": "h_new"}), "node", "full")
        here = met.where("not (h_old <=> h_new)").select("node", "n_old", "n_new")
        if here.isEmpty():
            break
    return here


def bucket_of(keys: list[str], levels: int = 3):
    """The bucket of a row of these key columns."""
    return F.pmod(F.xxhash64(*keys), F.lit(FAN**levels))
