"""Joins and reshaping of series."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


#: The unit of time that as_of() cuts the rows of a key by.
BUCKET = "day"


def wide(long: DataFrame, name_col: str, value_col: str, names: list[str], keys: list[str] = ("ds",), prefix: str = "") -> DataFrame:
    """One column for each of names (given, so that no job is run to find them); of several values the smallest."""
    out = long.where(F.col(value_col).isNotNull()).groupBy(*keys).pivot(name_col, list(names)).agg(F.min(value_col))
    return out.withColumnsRenamed({n: f"{prefix}{n}" for n in names}) if prefix else out


def long(table: DataFrame, keys: list[str], values: list[str], name_col: str = "feature_name", value_col: str = "feature_value") -> DataFrame:
    """One row for each value that is there."""
    return table.select(*keys, *[F.col(v).cast("double").alias(v) for v in values]).unpivot(list(keys), list(values), name_col, value_col).where(F.col(value_col).isNotNull())


def outer_all(frames: list[DataFrame], on: list[str]) -> DataFrame:
    return reduce(lambda a, b: a.join(b, on, "full"), frames)


def in_intervals(rows: DataFrame, time: str, spikes: DataFrame, spike_time: str, before: int, after: int, out: str) -> DataFrame:
    """out: whether a row's date is from before days ahead of a spike to after days behind it.

    Each spike becomes the days it covers, so the join is on equal days and
    works for any number of spikes.
    """
    days = spikes.select(F.explode(F.sequence(F.date_sub(spike_time, before), F.date_add(spike_time, after))).alias(time)).distinct().withColumn(out, F.lit(True))
    return rows.join(days, time, "left").withColumn(out, F.coalesce(out, F.lit(False)))


def as_of(left: DataFrame, right: DataFrame, time: str, keys: list[str], value_cols: list[str]) -> DataFrame:
    """left with the last values of right at or before its time: union and carry forward, no range join.

    A key's rows are carried inside buckets of time (BUCKET), and
    from bucket to bucket by the last values of each; so a hot key is as many
    tasks as it has buckets.
    """
    bucket = F.date_trunc(BUCKET, F.col(time).cast("timestamp"))
    one = left.withColumn("_from", F.lit(1)).withColumns({f"_r_{c}": F.lit(None).cast(right.schema[c].dataType) for c in value_cols})
    two = right.select(*keys, time, *[F.col(c).alias(f"_r_{c}") for c in value_cols], F.lit(0).alias("_from"))
    both = one.unionByName(two, allowMissingColumns=True).withColumn("_b", bucket)
    inside = Window.partitionBy(*keys, "_b").orderBy(time, "_from").rowsBetween(Window.unboundedPreceding, 0)
    # one row for each key and bucket: the last values in it, then those of all before it
    filled = lambda c: F.when(F.col(f"_r_{c}").isNotNull(), F.col(time))
    ends = both.groupBy(*keys, "_b").agg(*[F.max_by(f"_r_{c}", filled(c)).alias(f"_e_{c}") for c in value_cols])
    before = Window.partitionBy(*keys).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    ends = ends.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], F.col("_b").alias("_kb"), *[F.last(f"_e_{c}", ignorenulls=True).over(before).alias(f"_e_{c}") for c in value_cols])
    carried = both.withColumns({c: F.last(f"_r_{c}", ignorenulls=True).over(inside) for c in value_cols}).where("_from = 1")
    same = reduce(Column.__and__, [F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(keys)], F.col("_b").eqNullSafe(F.col("_kb")))
    met = carried.join(ends, same, "left")
    return met.select(*left.columns, *[F.coalesce(c, f"_e_{c}").alias(c) for c in value_cols])


def known_at(left: DataFrame, facts: DataFrame, keys: list[str], time: str, valid: str = "valid", known: str = "known", value: str = "value") -> DataFrame:
    """left with what was known of each key at time: valid, known and value of the newest period told of by then, as last told.

    facts has two times: the period that a value is of, and when it was told; a
    period may be told of again. The greatest (valid, known) of the facts up to
    a moment is a running maximum, taken inside days and from day to day by the
    days' own maxima, so that a key is as many tasks as it has days. Nulls: a
    fact without a period or a time of telling is left out, a value may be
    null; a null key is a key; left rows without a fact by then get nulls.
    """
    told = facts.where(F.col(valid).isNotNull() & F.col(known).isNotNull()).select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], F.to_date(known).alias("_day"), F.col(known).cast("timestamp").alias("_at"), F.struct(F.col(valid).alias("v"), F.col(known).alias("k"), F.col(value).alias("x")).alias("_fact"))
    names = [f"_k{i}" for i in range(len(keys))]
    asked = left.select(*[F.col(k).alias(n) for k, n in zip(keys, names, strict=True)], F.to_date(time).alias("_day"), F.col(time).cast("timestamp").alias("_at"), F.struct(*left.columns).alias("_row"))
    both = told.unionByName(asked, allowMissingColumns=True)
    inside = Window.partitionBy(*names, "_day").orderBy("_at").rangeBetween(Window.unboundedPreceding, 0)
    rows = both.withColumn("_own", F.max("_fact").over(inside)).where("_row is not null")
    days = both.groupBy(*names, "_day").agg(F.max("_fact").alias("_best"))
    before = Window.partitionBy(*names).orderBy("_day").rowsBetween(Window.unboundedPreceding, -1)
    days = days.withColumn("_old", F.max("_best").over(before)).select(*[F.col(n).alias(f"d{n}") for n in names], F.col("_day").alias("d_day"), "_old")
    same = reduce(Column.__and__, [F.col(n).eqNullSafe(F.col(f"d{n}")) for n in [*names, "_day"]])
    met = rows.join(days, same, "left").withColumn("_fact", F.greatest("_own", "_old"))
    return met.select("_row.*", F.col("_fact.v").alias(valid), F.col("_fact.k").alias(known), F.col("_fact.x").alias(value))


def month_dummies(ds: Column) -> dict[str, Column]:
    return {f"month_{k}": (F.month(ds) == k).cast("int") for k in range(1, 13)}


def quarter_dummies(ds: Column) -> dict[str, Column]:
    return {f"quarter_{k}": (F.quarter(ds) == k).cast("int") for k in range(1, 5)}


def align(table: DataFrame, columns: list[str]) -> DataFrame:
    """Just these columns in this order; missing ones 0."""
    return table.select([F.col(c) if c in table.columns else F.lit(0.0).alias(c) for c in columns])


def columns_like(table: DataFrame, part: str) -> list[str]:
    return [c for c in table.columns if part.lower() in c.lower()]


def dense_rows(table: DataFrame, most: float = 0.7) -> DataFrame:
    """Rows of which at most this share of columns is null."""
    nulls = sum((F.col(c).isNull().cast("int") for c in table.columns), F.lit(0))
    return table.where(nulls / len(table.columns) <= most)


def first_by(table: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """One row a key, the first in order."""
    return table.withColumn("_r", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_r = 1").drop("_r")


def horizon(panel: DataFrame, steps: int, keys: list[str] = ("unique_id",), time: str = "ds") -> DataFrame:
    """The steps months after each series' last: keys, step, ds."""
    last = panel.groupBy(*keys).agg(F.max(time).alias("_last"))
    return last.select(*keys, "_last", F.explode(F.sequence(F.lit(1), F.lit(steps))).alias("step")).select(*keys, "step", F.last_day(F.add_months("_last", F.col("step"))).alias(time))
