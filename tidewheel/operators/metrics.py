"""Accuracy measures, as aggregates over actual and predicted values."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import safe_div


def mape(y: Column, p: Column) -> Column:
    return F.avg(F.abs(safe_div(y - p, y))) * 100


def smape(y: Column, p: Column) -> Column:
    return F.avg(safe_div(F.abs(y - p), (F.abs(y) + F.abs(p)) / 2)) * 100


def mae(y: Column, p: Column) -> Column:
    return F.avg(F.abs(y - p))


def rmse(y: Column, p: Column) -> Column:
    return F.sqrt(F.avg((y - p) * (y - p)))


def r2(y: Column, p: Column) -> Column:
    return 1 - safe_div(F.sum((y - p) * (y - p)), F.var_pop(y) * F.count(y))


def moments(x: Column, name: str) -> list[Column]:
    return [F.avg(x).alias(f"{name}_mean"), F.stddev_pop(x).alias(f"{name}_std"), F.min(x).alias(f"{name}_min"), F.max(x).alias(f"{name}_max")]


def mase(error: Column, scale: Column) -> Column:
    """Mean absolute error over the scale; with scale 0: 0 if there is no error, else infinite, told as null."""
    return F.when(scale > 0, error / scale).when(error == 0, 0.0)


def naive_scale(train: DataFrame, keys: list[str], y: str = "y", time: str = "ds", season: int = 12) -> DataFrame:
    """keys, scale: mean absolute change over a season, over one row if the history is shorter."""
    w = Window.partitionBy(*keys).orderBy(time)
    steps = train.withColumn("_s", F.abs(F.col(y) - F.lag(y, season).over(w))).withColumn("_1", F.abs(F.col(y) - F.lag(y, 1).over(w)))
    return steps.groupBy(*keys).agg(F.when(F.count(F.lit(1)) >= season, F.avg("_s")).otherwise(F.avg("_1")).alias("scale"))


def all_metrics(pairs: DataFrame, keys: list[str], y: str = "y", p: str = "yhat") -> DataFrame:
    y_, p_ = F.col(y), F.col(p)
    return pairs.groupBy(*keys).agg(mape(y_, p_).alias("mape"), smape(y_, p_).alias("smape"), mae(y_, p_).alias("mae"), rmse(y_, p_).alias("rmse"), r2(y_, p_).alias("r2"), F.count(F.lit(1)).alias("n"))


def directional_accuracy(pairs: DataFrame, keys: list[str], order: str, within: list[str], y: str = "y", p: str = "yhat") -> DataFrame:
    """Share of steps whose direction was right, in percent; steps stay inside a fold."""
    w = Window.partitionBy(*keys, *within).orderBy(order)
    same = F.signum(F.col(y) - F.lag(y).over(w)) == F.signum(F.col(p) - F.lag(p).over(w))
    return pairs.withColumn("_same", same.cast("double")).groupBy(*keys).agg((F.avg("_same") * 100).alias("directional_accuracy"))


def leaderboard(scores: DataFrame, category: str, by: str = "mase") -> DataFrame:
    """Rank of each model in its category, nulls last, equal scores by name."""
    order = F.col(by).asc_nulls_last()
    return scores.withColumn("place", F.row_number().over(Window.partitionBy(category).orderBy(order, "model")))


def model_statistics(scores: DataFrame, metric_cols: list[str]) -> DataFrame:
    """Mean, population deviation, least and largest of each metric by model, and the share of runs that gave one."""
    aggs = [x for c in metric_cols for x in moments(F.col(c), c)]
    return scores.groupBy("model").agg(*aggs, (F.count(metric_cols[0]) / F.count(F.lit(1)) * 100).alias("success_rate"), F.count(F.lit(1)).alias("n_runs"))
