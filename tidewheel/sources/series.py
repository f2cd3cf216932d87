"""Series from tables: long observations, monthly panels and daily bars."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalars import clean, month_end

#: Types of a long observation table.
OBSERVATIONS = "ds date, series_id string, value double"
PANEL = "unique_id string, ds date, y double"
BARS = "symbol string, ds date, open double, high double, low double, close double, volume bigint"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def without_last_month(monthly: DataFrame, time: str = "ds") -> DataFrame:
    """All months before the last of the table, which may be incomplete."""
    return monthly.where(F.col(time) < monthly.agg(F.max(time)).scalar())


def sales_panel(spark: SparkSession, sf_dir: str, by: str = "p_type") -> DataFrame:
    """unique_id, ds, y: revenue by month of an attribute of parts. One aggregate over the scan; partial sums meet by key."""
    lines = table(spark, sf_dir, "lineitem").select("l_partkey", "l_shipdate", (F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("v"))
    parts = table(spark, sf_dir, "part").select("p_partkey", F.col(by).alias("unique_id"))
    joined = lines.join(parts, lines.l_partkey == parts.p_partkey)
    panel = joined.groupBy("unique_id", month_end(F.col("l_shipdate")).alias("ds")).agg(F.round(F.sum("v"), 4).alias("y"))
    return without_last_month(panel)


def total_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem")
    panel = lines.groupBy(month_end(F.col("l_shipdate")).alias("ds")).agg(F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 4).alias("y"))
    return without_last_month(panel.select(F.lit("total").alias("unique_id"), "ds", "y"))


def macro_long(spark: SparkSession, sf_dir: str, by: str = "o_orderpriority") -> DataFrame:
    """ds, series_id, value: mean order value by month of an attribute of orders, or of their customers."""
    orders = table(spark, sf_dir, "orders")
    if by.startswith("c_"):
        orders = orders.join(table(spark, sf_dir, "customer").select("c_custkey", by), F.col("o_custkey") == F.col("c_custkey"))
    out = orders.groupBy(month_end(F.col("o_orderdate")).alias("ds"), F.col(by).alias("series_id")).agg(F.round(F.avg("o_totalprice"), 4).alias("value"))
    return without_last_month(out)


def daily_bars(rows: DataFrame, symbol: str, time: str, value: str, tie: str) -> DataFrame:
    """Open, high, low, close and count by day; equal times go by tie, so the result does not hang on the order of rows."""
    order = F.struct(time, tie)
    return rows.groupBy(F.col(symbol).alias("symbol"), F.to_date(time).alias("ds")).agg(
        F.min_by(value, order).alias("open"), F.max(value).alias("high"), F.min(value).alias("low"), F.max_by(value, order).alias("close"), F.count(F.lit(1)).alias("volume")
    )


def order_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    return daily_bars(table(spark, sf_dir, "orders"), "o_orderpriority", "o_orderdate", "o_totalprice", "o_orderkey")


def event_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    return daily_bars(table(spark, sf_dir, "events"), "event_type", "ts", "value", "event_id")


def complete_months(panel: DataFrame, keys: list[str], time: str = "ds") -> DataFrame:
    """A row for every month from a series' first to its last; new rows have nulls."""
    span = panel.groupBy(*keys).agg(F.min(time).alias("a"), F.max(time).alias("b"))
    months = span.select(*keys, F.explode(F.sequence(F.trunc("a", "month"), F.trunc("b", "month"), F.expr("interval 1 month"))).alias("m"))
    return months.select(*keys, F.last_day("m").alias(time)).join(panel, [*keys, time], "left")


def read_csv(spark: SparkSession, paths: list[str], schema: str, date_cols: list[str] = ()) -> DataFrame:
    """CSV with a header; texts of dates are parsed, numbers that are none become null."""
    df = spark.read.schema(schema).csv(first_there(spark, paths), header=True)
    return df.withColumns({c: F.to_date(c) for c in date_cols})


def first_there(spark: SparkSession, paths: list[str]) -> str:
    """The first path that exists, asked of the file system that Spark uses."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    for path in paths:
        where = jvm.org.apache.hadoop.fs.Path(path)
        if where.getFileSystem(conf).exists(where):
            return path
    raise FileNotFoundError(f"none of {paths} exists")


def normal(df: DataFrame) -> DataFrame:
    """All doubles with NaN as null."""
    return df.withColumns({f.name: clean(F.col(f.name)) for f in df.schema if f.dataType.typeName() in ("double", "float")})


def combine(frames: list[DataFrame]) -> DataFrame:
    """All rows, columns by name; missing ones null."""
    out = frames[0]
    for df in frames[1:]:
        out = out.unionByName(df, allowMissingColumns=True)
    return out


def between(df: DataFrame, start: str | None = None, end: str | None = None, kinds: list[str] | None = None, time: str = "ds", kind_col: str = "data_type") -> DataFrame:
    """The optional filters of a stored table: both ends inclusive."""
    conds: list[Column] = []
    if start:
        conds.append(F.col(time) >= F.to_date(F.lit(start)))
    if end:
        conds.append(F.col(time) <= F.to_date(F.lit(end)))
    if kinds:
        conds.append(F.col(kind_col).isin(kinds))
    for c in conds:
        df = df.where(c)
    return df


def file_ages(spark: SparkSession, path: str, days: float = 1.0) -> DataFrame:
    """path, changed, is_old of each file under a path: whether it was last written more than so many days ago."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", F.col("modificationTime").alias("changed"))
    return files.withColumn("is_old", F.col("changed") < F.current_timestamp() - F.make_dt_interval(secs=F.lit(days * 86400.0)))
