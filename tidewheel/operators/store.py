"""The feature store: Parquet tables with keyed upserts, marks and metadata."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalars import feature_kind
from ..sources.series import between
from .reshape import long

TABLES = {
    "metadata": "key string, value string, updated_at timestamp",
    "categories": "category_id string, category_name string, description string, series_id string, is_active boolean, updated_at timestamp",
    "time_series": "category_id string, ds date, value double, data_type string, source string",
    "features": "category_id string, ds date, feature_name string, feature_value double, feature_type string",
    "cache_status": "table_name string, last_updated timestamp, row_count bigint, is_valid boolean",
    "forecasts": "run_id string, category_id string, kind string, run_timestamp timestamp, horizon int, result string",
}


def upserted(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """old with the rows of new in place of those of equal keys."""
    return old.join(new.select(*keys).distinct(), keys, "left_anti").unionByName(new)


def ignored(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """old, and the rows of new whose keys it lacks."""
    return old.unionByName(new.join(old.select(*keys).distinct(), keys, "left_anti"))


def latest(rows: DataFrame, keys: list[str], by: str) -> DataFrame:
    """The newest row of each key, whole; equal times go by the largest row."""
    rest = [c for c in rows.columns if c not in keys]
    newest = rows.groupBy(*keys).agg(F.max(F.struct(by, *[c for c in rest if c != by])).alias("r"))
    return newest.select(*keys, *[F.col(f"r.{c}").alias(c) for c in rest]).select(*rows.columns)


def newer(rows: DataFrame, marks: DataFrame, keys: list[str], time: str = "ds", mark: str = "mark") -> DataFrame:
    """Rows after their key's mark; all rows of keys without one."""
    return rows.join(marks, keys, "left").where(F.col(mark).isNull() | (F.col(time) > F.col(mark))).drop(mark)


def high_water(rows: DataFrame, keys: list[str], time: str = "ds") -> DataFrame:
    return rows.groupBy(*keys).agg(F.max(time).alias("mark"))


def forecast_kind(dates: F.Column, horizon: F.Column) -> F.Column:
    return F.when(dates.isNotNull(), "backtest").when(horizon.isNotNull(), "forecast").otherwise("prediction")


def newest(rows: DataFrame, n: int, by: str, *ties: str) -> DataFrame:
    return rows.orderBy(F.desc(by), *ties).limit(n)


def stats(tables: dict[str, tuple[DataFrame, str | None]]) -> DataFrame:
    """Rows and date range of each table; None where it has no date."""
    out = None
    for name, (df, time) in tables.items():
        a, b = (F.min(time), F.max(time)) if time else (F.lit(None).cast("date"), F.lit(None).cast("date"))
        row = df.agg(F.count(F.lit(1)).alias("n_rows"), a.cast("date").alias("first_day"), b.cast("date").alias("last_day")).select(F.lit(name).alias("table_name"), "*")
        out = row if out is None else out.unionByName(row)
    return out


def active(categories: DataFrame) -> DataFrame:
    return categories.where("is_active").orderBy("category_id")


def by_category(series: DataFrame, category: str | None = None, kinds: list[str] | None = None, start: str | None = None, end: str | None = None) -> DataFrame:
    """category_id, ds, a column for each data type: the stored series of one category or all, in order."""
    rows = series if category is None else series.where(F.col("category_id") == category)
    rows = between(rows, start, end, kinds)
    pivot = rows.groupBy("category_id", "ds").pivot("data_type", kinds) if kinds else rows.groupBy("category_id", "ds").pivot("data_type")
    return pivot.agg(F.first("value")).orderBy("category_id", "ds")


def combined(series: DataFrame, features: DataFrame, names: list[str], category: str | None = None, kind: str = "sales") -> DataFrame:
    """category_id, ds, y, a column for each of names: the observations with their stored features, for one category or all at once."""
    base = series.where(F.col("data_type") == kind).select("category_id", "ds", F.col("value").alias("y"))
    if category is not None:
        base, features = base.where(F.col("category_id") == category), features.where(F.col("category_id") == category)
    wide = features.groupBy("category_id", "ds").pivot("feature_name", names).agg(F.first("feature_value"))
    return base.join(wide, ["category_id", "ds"], "left")


def targets(series: DataFrame, wanted: DataFrame) -> DataFrame:
    """unique_id, ds, y, is_proxy of each wanted target: its own series, or where it has none that of its proxy. wanted: target, category_id, proxy_id."""
    there = series.select("category_id").distinct()
    own = wanted.join(there, "category_id", "left_semi").select("target", "category_id", F.lit(False).alias("is_proxy"))
    other = wanted.join(there, "category_id", "left_anti").select("target", F.col("proxy_id").alias("category_id"), F.lit(True).alias("is_proxy"))
    return own.unionByName(other).join(series, "category_id").select(F.col("target").alias("unique_id"), "ds", F.col("value").alias("y"), "is_proxy")


def forecast_results(run_id: str, predictions: DataFrame, at: F.Column | None = None) -> DataFrame:
    """Rows of the forecasts table: one a category, its predictions in order, with dates, bands and metrics where they are there, as JSON.

    predictions: category_id, step, yhat, and of ds, lower, upper, y those that there are. A category with y is a backtest.
    """
    have = [c for c in ("ds", "lower", "upper", "y") if c in predictions.columns]
    row = F.struct("step", *[F.col(c).cast("string").alias(c) if c == "ds" else c for c in have], "yhat")
    one = predictions.groupBy("category_id").agg(F.array_sort(F.collect_list(row)).alias("rows"), F.max("step").alias("horizon"), *([F.avg(F.abs(F.col("y") - F.col("yhat"))).alias("mae"), F.max("ds").alias("_known")] if {"y", "ds"} <= set(have) else []))
    known = F.col("_known") if "_known" in one.columns else F.lit(None)
    told = F.struct("rows", *([F.struct("mae").alias("metrics")] if "mae" in one.columns else []))
    return one.select(F.lit(run_id).alias("run_id"), "category_id", forecast_kind(known, F.col("horizon")).alias("kind"), (at if at is not None else F.current_timestamp()).alias("run_timestamp"), "horizon", F.to_json(told).alias("result"))


RESULT = "rows array<struct<step: int, ds: string, lower: double, upper: double, y: double, yhat: double>>, metrics struct<mae: double>"


def forecast_scan(forecasts: DataFrame, category: str | None = None, kind: str | None = None, n: int = 10) -> DataFrame:
    """The newest n forecasts of a category or all, of a kind or any, their JSON read."""
    rows = forecasts
    if category is not None:
        rows = rows.where(F.col("category_id") == category)
    if kind is not None:
        rows = rows.where(F.col("kind") == kind)
    return newest(rows, n, "run_timestamp", "category_id").withColumn("result", F.from_json("result", RESULT))


def fan_out(forecasts: DataFrame, last: DataFrame) -> DataFrame:
    """category_id, kind, step, ds, yhat, lower, upper, mae: forecasts as one long table, months generated where they are not told. last: category_id, last_day."""
    rows = forecasts.withColumn("r", F.from_json("result", RESULT)).select("category_id", "kind", F.col("r.metrics.mae").alias("mae"), F.explode("r.rows").alias("x"))
    rows = rows.join(last, "category_id", "left")
    ds = F.coalesce(F.to_date("x.ds"), F.last_day(F.add_months("last_day", F.col("x.step"))))
    return rows.select("category_id", "kind", F.col("x.step").alias("step"), ds.alias("ds"), *[F.col(f"x.{c}").alias(c) for c in ("yhat", "lower", "upper")], "mae")


#: The features that a migration takes over.
MIGRATED = ["lag_1", "lag_3", "lag_12", "ma_3", "ma_12", "yoy_change", "mom_change"]


def migrated(panel: DataFrame, names: list[str] = MIGRATED) -> tuple[DataFrame, DataFrame]:
    """The series and features rows of panel files: the id is unique_id without a closing US, values that are null go."""
    rows = panel.withColumn("category_id", F.regexp_replace("unique_id", "US$", ""))
    there = [c for c in names if c in panel.columns]
    series = rows.where("y is not null").select("category_id", F.to_date("ds").alias("ds"), F.col("y").cast("double").alias("value"), F.lit("sales").alias("data_type"), F.lit("migration").alias("source"))
    if not there:
        return series, rows.sparkSession.createDataFrame([], TABLES["features"])
    features = long(rows.withColumn("ds", F.to_date("ds")), ["category_id", "ds"], there).withColumn("feature_type", feature_kind(F.col("feature_name")))
    return series, features


class Store:
    """Tables in one folder. A write makes new files beside the old and then moves the mark; readers see one or the other whole.

    A version is a list of parts, each a folder of its own: an upsert into a
    table that is split by a column writes the parts that its rows touch and
    takes the others over. The mark names the version it was made from, and
    takes its number: of two writers that start from one version the second
    finds the number taken and fails, and may start again.
    """

    MARK = "version int, parts map<string, string>, split string"

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _fs(self, path: str):
        where = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return where.getFileSystem(self.spark._jsc.hadoopConfiguration()), where

    def _mark(self, name: str) -> dict | None:
        fs, where = self._fs(f"{self.root}/_marks/{name}")
        if not fs.exists(where):
            return None
        numbers = [int(f.getPath().getName()) for f in fs.listStatus(where)]
        if not numbers:
            return None
        row = self.spark.read.schema(self.MARK).json(f"{self.root}/_marks/{name}/{max(numbers)}").collect()[0]
        return row.asDict(True)

    def version(self, name: str) -> int | None:
        mark = self._mark(name)
        return mark["version"] if mark else None

    def _commit(self, name: str, before: dict | None, parts: dict[str, str], split: str | None) -> None:
        number = (before["version"] if before else 0) + 1
        made = f"{self.root}/_new/{uuid.uuid4().hex}"
        self.spark.createDataFrame([(number, parts, split)], self.MARK).coalesce(1).write.json(made)
        fs, source = self._fs(made)
        _, folder = self._fs(f"{self.root}/_marks/{name}")
        _, target = self._fs(f"{self.root}/_marks/{name}/{number}")
        fs.mkdirs(folder)
        # a rename onto what is there already fails or lands inside it; either way the number was taken
        if fs.exists(target) or not fs.rename(source, target) or fs.exists(self._fs(f"{self.root}/_marks/{name}/{number}/{made.rpartition('/')[2]}")[1]):
            raise RuntimeError(f"{name} was written by another while this write ran")

    def _put(self, name: str, df: DataFrame) -> str:
        path = f"{name}/{uuid.uuid4().hex}"
        df.write.parquet(f"{self.root}/{path}")
        return path

    def read(self, name: str, only: list[str] | None = None) -> DataFrame:
        """The table, or of a split one only these parts."""
        mark = self._mark(name)
        paths = [f"{self.root}/{p}" for k, p in (mark["parts"] if mark else {}).items() if only is None or k in only]
        return self.spark.read.schema(TABLES[name]).parquet(*paths) if paths else self.spark.createDataFrame([], TABLES[name])

    def write(self, name: str, df: DataFrame, split_by: str | None = None) -> None:
        """df in place of the table, one part for each value of split_by, which should have few."""
        before = self._mark(name)
        if split_by is None:
            parts = {"": self._put(name, df)}
        else:
            df = df.cache()
            try:
                parts = {str(v): self._put(name, df.where(F.col(split_by).cast("string").eqNullSafe(F.lit(v)))) for v in self._values(df, split_by)}
            finally:
                df.unpersist()
        self._commit(name, before, parts, split_by)

    @staticmethod
    def _values(df: DataFrame, split_by: str) -> list[str | None]:
        return [r[0] for r in df.select(F.col(split_by).cast("string")).distinct().collect()]

    def upsert(self, name: str, new: DataFrame, keys: list[str]) -> None:
        """Rows of new without a null in keys or value replace those of equal keys. Of a split table only the parts they fall in are written."""
        must = [*keys, *[c for c in ("value", "feature_value") if c in new.columns]]
        new = new.dropna(subset=must).dropDuplicates(keys)
        before = self._mark(name)
        split = before["split"] if before else None
        if split is None or split not in keys:
            self._commit(name, before, {"": self._put(name, upserted(self.read(name), new, keys))}, None)
            return
        parts = dict(before["parts"])
        for value in self._values(new, split):
            own = new.where(F.col(split).cast("string") == F.lit(value))
            parts[str(value)] = self._put(name, upserted(self.read(name, [str(value)]), own, keys))
        self._commit(name, before, parts, split)

    def vacuum(self, name: str) -> int:
        """Drops the files of all versions but the present one; to be run when nothing reads or writes the table. How many parts went."""
        mark = self._mark(name)
        fs, where = self._fs(f"{self.root}/{name}")
        gone = [f.getPath() for f in fs.listStatus(where) if f"{name}/{f.getPath().getName()}" not in (mark["parts"] or {}).values()] if fs.exists(where) and mark else []
        for path in gone:
            fs.delete(path, True)
        return len(gone)

    def duplicates(self, name: str, keys: list[str]) -> DataFrame:
        """Keys that occur more than once: none, as long as the table was written by upsert."""
        return self.read(name).groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where("n > 1")

    def fresh(self, name: str, days: float = 1.0) -> bool:
        """Whether the table was written within so many days and not marked invalid."""
        rows = self.read("cache_status").where((F.col("table_name") == name) & F.col("is_valid") & (F.col("last_updated") >= F.current_timestamp() - F.expr(f"interval {int(days * 86400)} seconds")))
        return bool(rows.limit(1).collect())

    def mark_fresh(self, name: str) -> None:
        row = self.read(name).agg(F.count(F.lit(1)).alias("row_count")).select(F.lit(name).alias("table_name"), F.current_timestamp().alias("last_updated"), "row_count", F.lit(True).alias("is_valid"))
        self.write("cache_status", upserted(self.read("cache_status"), row, ["table_name"]))

    def backup(self, name: str, to: str) -> None:
        self.read(name).write.parquet(f"{to.rstrip('/')}/{name}")

