"""Reports and rules on the quality of series."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import safe_div
from .windows import over_time


def describe(panel: DataFrame, keys: list[str] = ("unique_id",), y: str = "y") -> DataFrame:
    return panel.groupBy(*keys).agg(F.avg(y).alias("mean"), F.stddev_samp(y).alias("std"), F.min(y).alias("min"), F.max(y).alias("max"), F.count(y).alias("n"))


def global_report(df: DataFrame, id_col: str, time: str) -> DataFrame:
    """One row: rows, distinct rows over, ids, date range, months, nulls of each column."""
    keyed = df.groupBy(*df.columns).agg(F.count(F.lit(1)).alias("_n"))  # equal rows meet here, after partial sums
    weigh = lambda e: F.sum(F.when(e, F.col("_n")).otherwise(0))
    nulls = [weigh(F.col(c).isNull()).alias(f"nulls_{c}") for c in df.columns]
    return keyed.agg(
        F.sum("_n").alias("n_rows"),
        F.sum(F.col("_n") - 1).alias("n_duplicates"),
        F.countDistinct(id_col).alias("n_ids"),
        F.min(time).alias("first_day"),
        F.max(time).alias("last_day"),
        F.round(F.datediff(F.max(time), F.min(time)) / 30, 6).alias("n_months"),
        *nulls,
    )


def series_report(df: DataFrame, id_col: str, time: str, y: str) -> DataFrame:
    return df.groupBy(id_col).agg(
        F.count(F.lit(1)).alias("n"),
        F.min(y).alias("min"),
        F.max(y).alias("max"),
        F.avg(y).alias("mean"),
        F.max_by(y, time).alias("latest"),
        F.max(time).alias("latest_day"),
        F.avg(F.col(y).isNull().cast("double")).alias("null_ratio"),
    )


def checks(panel: DataFrame, least: int = 24) -> DataFrame:
    """One row a series: whether it can be modelled, and why not."""
    return panel.groupBy("unique_id").agg(
        (F.count(F.lit(1)) >= least).alias("long_enough"),
        (F.count("y") == F.count(F.lit(1))).alias("complete"),
        (F.coalesce(F.min("y"), F.lit(0.0)) > 0).alias("positive"),
    ).withColumn("ok", F.col("long_enough") & F.col("complete"))


def outliers(panel: DataFrame, k: float = 3.0) -> DataFrame:
    """Rows outside the quartiles by k times their distance."""
    fences = panel.groupBy("unique_id").agg(F.percentile("y", 0.25).alias("q1"), F.percentile("y", 0.75).alias("q3"))
    reach = k * (F.col("q3") - F.col("q1"))
    out = panel.join(fences, "unique_id").withColumn("is_outlier", (F.col("y") < F.col("q1") - reach) | (F.col("y") > F.col("q3") + reach))
    return out


def gaps(panel: DataFrame, most: int = 1) -> DataFrame:
    """Rows that come more than most months after the one before."""
    w = over_time()
    rows = panel.withColumn("previous", F.lag("ds").over(w))
    months = (F.year("ds") - F.year("previous")) * 12 + F.month("ds") - F.month("previous")
    return rows.withColumn("months", months).where(F.col("months") > most)


def duplicate_days(rows: DataFrame, keys: list[str]) -> DataFrame:
    return rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def null_rule(panel: DataFrame, most: float = 0.05) -> DataFrame:
    return panel.groupBy("unique_id").agg(F.avg(F.col("y").isNull().cast("double")).alias("null_ratio")).withColumn("ok", F.col("null_ratio") <= most)


def version_hash(df: DataFrame) -> DataFrame:
    """Rows and an order-free hash of a table."""
    return df.select(F.xxhash64(*df.columns).alias("h")).agg(F.count(F.lit(1)).alias("n_rows"), F.bit_xor("h").alias("hash"), F.sum((F.col("h") % 1_000_003).cast("long")).alias("sum"))


def common_columns(frames: list[DataFrame]) -> list[str]:
    shared = set(frames[0].columns).intersection(*[f.columns for f in frames[1:]])
    return [c for c in frames[0].columns if c in shared]


def correlations(table: DataFrame, columns: list[str]) -> DataFrame:
    """a, b, corr of each pair of columns, in one aggregate."""
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i + 1 :]]
    row = table.agg(*[F.corr(a, b).alias(f"c{i}") for i, (a, b) in enumerate(pairs)])
    return row.select(F.explode(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"c{i}").alias("corr")) for i, (a, b) in enumerate(pairs)])).alias("x")).select("x.*")


def autocorrelation(panel: DataFrame, lags: list[int]) -> DataFrame:
    w = over_time()
    rows = panel.withColumns({f"l{k}": F.lag("y", k).over(w) for k in lags})
    row = rows.groupBy("unique_id").agg(*[F.corr("y", f"l{k}").alias(f"acf_{k}") for k in lags])
    return row


def decompose(panel: DataFrame, season: int = 12) -> DataFrame:
    """Trend (centred mean), seasonal part (mean deviation of the month) and rest."""
    w = over_time()
    half = season // 2
    frame = w.rowsBetween(-half, half)
    trend = F.when(F.count("y").over(frame) == season + 1, (F.sum("y").over(frame) - (F.lag("y", half).over(w) + F.lead("y", half).over(w)) / 2) / season)
    rows = panel.withColumn("trend", trend).withColumn("off", F.col("y") - F.col("trend"))
    rows = rows.withColumn("seasonal", F.avg("off").over(Window.partitionBy("unique_id", F.month("ds"))))
    return rows.withColumn("rest", F.col("off") - F.col("seasonal")).drop("off")


def min_max(table: DataFrame, col: str, keys: list[str]) -> DataFrame:
    whole = Window.partitionBy(*keys)
    return table.withColumn(f"{col}_scaled", safe_div(F.col(col) - F.min(col).over(whole), F.max(col).over(whole) - F.min(col).over(whole)))


def target_encoding(panel: DataFrame) -> DataFrame:
    """The mean of all earlier values of the same month: no row sees itself or the future."""
    w = Window.partitionBy("unique_id", F.month("ds")).orderBy("ds").rowsBetween(Window.unboundedPreceding, -1)
    return panel.withColumn("month_mean_before", F.avg("y").over(w))


def panel_report(panel: DataFrame, y: str = "y") -> DataFrame:
    """One row a series, and one, 'all', of totals: rows, range, nulls, their ratio, and the rows and ratio of an average series."""
    of = lambda: [F.count(F.lit(1)).alias("n_rows"), F.min("ds").alias("first_day"), F.max("ds").alias("last_day"), F.count_if(F.col(y).isNull()).alias("n_nulls")]
    each = panel.groupBy("unique_id").agg(*of()).withColumn("null_ratio", F.col("n_nulls") / F.col("n_rows"))
    # from the rows by series, so that the panel is read once
    whole = each.agg(F.sum("n_rows").alias("n_rows"), F.min("first_day").alias("first_day"), F.max("last_day").alias("last_day"), F.sum("n_nulls").alias("n_nulls"), F.avg("n_rows").alias("mean_rows"), F.avg("null_ratio").alias("null_ratio"), F.count(F.lit(1)).alias("n_series"))
    return each.withColumns({"mean_rows": F.lit(None).cast("double"), "n_series": F.lit(1).cast("long")}).unionByName(whole.withColumn("unique_id", F.lit("all")))


def missing_rule(rows: DataFrame, expected: DataFrame, key: str, y: str) -> DataFrame:
    """key, n_nulls, expected, ok: nulls of each key against as many as are expected (none where nothing is said). expected: key, expected."""
    found = rows.groupBy(key).agg(F.count_if(F.col(y).isNull()).alias("n_nulls"))
    return found.join(expected, key, "left").withColumn("expected", F.coalesce("expected", F.lit(0)).cast("long")).withColumn("ok", F.col("n_nulls") <= F.col("expected"))


def uncorrelated(table: DataFrame, columns: list[str], most: float = 0.95) -> list[str]:
    """The columns that are left if of two that correlate more than that the later goes. One row of statistics comes to the driver."""
    high = {(r["a"], r["b"]) for r in correlations(table, columns).where(F.abs("corr") > most).collect()}
    kept: list[str] = []
    for c in columns:
        if not any((k, c) in high for k in kept):
            kept.append(c)
    return kept


def recession(rates: DataFrame, time: str = "ds", value: str = "value", rise: float = 0.5) -> DataFrame:
    """rates (one row a month) with flag: the three-month mean of unemployment stands rise points or more over its least of the year before."""
    w = Window.orderBy(time)  # one row a month: a few hundred rows, whatever the corpus
    mean = rates.withColumn("_m", F.avg(value).over(w.rowsBetween(-2, 0)))
    return mean.withColumn("flag", F.coalesce(F.col("_m") - F.min("_m").over(w.rowsBetween(-12, -1)) >= rise, F.lit(False)).cast("int")).drop("_m")


def yield_curve(long: F.Column, short: F.Column) -> dict[str, F.Column]:
    """Slope of the curve and whether it is inverted."""
    return {"slope": long - short, "inverted": (long < short).cast("int")}
