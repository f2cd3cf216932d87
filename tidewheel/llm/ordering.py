"""Places of rows in an order, without bringing a group's rows together."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import MAX_KEYS, row_count, settle

#: monotonically_increasing_id() leaves so many bits to the rows of a partition.
_PART = 33


def numbered(df: DataFrame, group: str, order: list[str | Column]) -> DataFrame:
    """df, which should be settled, with idx, a row's place in its group from 0 (bigint), and n, the group's rows (bigint).

    Rows are sorted over the cluster by group, order and, if these are equal,
    by where they stand; a partition then counts its own rows, and adds what
    lies before it. Only counts by group and partition are brought together.
    The group column may hold no nulls.
    """
    keys = [F.col(group), *order, F.col("_place")]
    ranged = df.withColumn("_place", F.monotonically_increasing_id()).repartitionByRange(*keys).sortWithinPartitions(*keys)
    ranged = settle(ranged.drop("_place").withColumn("_at", F.monotonically_increasing_id()))
    part = F.shiftright("_at", _PART)
    counts = ranged.groupBy(F.col(group).alias("_g"), part.alias("_p")).agg(F.min("_at").alias("_first"), F.count(F.lit(1)).alias("_rows"))
    rows = Window.partitionBy("_g")
    before = F.coalesce(F.sum("_rows").over(rows.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    parts = settle(counts.select("_g", "_p", "_first", before.alias("_before"), F.sum("_rows").over(rows).alias("n")))
    met = ranged.join(F.broadcast(parts) if row_count(parts) <= MAX_KEYS else parts, (F.col(group) == F.col("_g")) & (part == F.col("_p")))
    return met.select(*df.columns, (F.col("_at") - F.col("_first") + F.col("_before")).alias("idx"), "n")
