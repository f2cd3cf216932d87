"""Bars and sessions from event streams. Batch frames pass through the same functions, without watermarks."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.store import Store

EVENTS = "event_id bigint, ts timestamp, user_id bigint, event_type string, value double, props string"


def read_events(spark: SparkSession, folder: str, files_at_once: int = 100) -> DataFrame:
    return spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", files_at_once).parquet(folder)


def _late(events: DataFrame, lateness: str) -> DataFrame:
    return events.withWatermark("ts", lateness) if events.isStreaming else events


def daily_bars(events: DataFrame, lateness: str = "1 hour") -> DataFrame:
    order = F.struct("ts", "event_id")
    out = _late(events, lateness).groupBy(F.window("ts", "1 day").alias("w"), F.col("event_type").alias("symbol")).agg(
        F.min_by("value", order).alias("open"), F.max("value").alias("high"), F.min("value").alias("low"), F.max_by("value", order).alias("close"), F.count(F.lit(1)).alias("volume")
    )
    return out.select("symbol", F.to_date("w.start").alias("ds"), "open", "high", "low", "close", "volume")


def sliding_mean(events: DataFrame, length: str = "7 days", step: str = "1 day", lateness: str = "1 hour") -> DataFrame:
    out = _late(events, lateness).groupBy(F.window("ts", length, step).alias("w"), "event_type").agg(F.avg("value").alias("mean"), F.count(F.lit(1)).alias("n"))
    return out.select("event_type", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "mean", "n")


def sessions(events: DataFrame, gap: str = "30 minutes", lateness: str = "1 hour") -> DataFrame:
    out = _late(events, lateness).groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))
    return out.select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n", "total")


def upsert_into(store: Store, name: str, keys: list[str]) -> Callable[[DataFrame, int], None]:
    """A foreachBatch step that puts each batch into a table of the store; a batch that comes twice changes nothing."""

    def step(batch: DataFrame, number: int) -> None:
        store.upsert(name, batch, keys)

    return step


def run_once(df: DataFrame, step: Callable[[DataFrame, int], None], checkpoint: str, mode: str = "update") -> StreamingQuery:
    """All that has come since the last run."""
    return df.writeStream.outputMode(mode).foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
