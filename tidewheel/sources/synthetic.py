"""Made-up monthly series: a base with a yearly slope, seasonal factors and seeded noise."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Base, yearly slope and factor of November and December.
PROFILES = {"electronics": (8000.0, 200.0, 1.8), "total": (450000.0, 10000.0, 1.4), "nonstore": (65000.0, 8000.0, 1.6), "misc": (25000.0, 1000.0, 1.2), "other": (15000.0, 500.0, 1.3)}


def monthly(spark: SparkSession, start: int, end: int, noise: float = 0.075, seed: int = 1) -> DataFrame:
    """unique_id, ds, y for all profiles and every month from January of start to December of end."""
    rows = [(k, *v) for k, v in PROFILES.items()]
    months = F.sequence(F.to_date(F.lit(f"{start}-01-01")), F.to_date(F.lit(f"{end}-12-01")), F.expr("interval 1 month"))
    df = spark.createDataFrame(rows, "unique_id string, base double, slope double, peak double").withColumn("m", F.explode(months))
    month = F.month("m")
    factor = F.when(month >= 11, F.col("peak")).when((F.col("unique_id") == "electronics") & month.isin(8, 9), 1.3).when((F.col("unique_id") == "electronics") & month.isin(6, 7), 0.9).otherwise(1.0)
    y = (F.col("base") + F.col("slope") * (F.year("m") - start)) * factor * (1 + noise * (2 * F.rand(seed) - 1))
    return df.select("unique_id", F.last_day("m").alias("ds"), y.alias("y"), F.lit(True).alias("is_synthetic"))
