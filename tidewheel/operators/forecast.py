"""Splits and closed-form forecasters. All of them work on every series at once: unique_id, ds, y in, rows out."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import safe_div
from .reshape import horizon

ID = "unique_id"


def numbered(panel: DataFrame) -> DataFrame:
    """rn: place in the series from 1; n: its length."""
    w = Window.partitionBy(ID)
    return panel.withColumn("rn", F.row_number().over(w.orderBy("ds"))).withColumn("n", F.count(F.lit(1)).over(w))


def folds(panel: DataFrame, k: int = 5, h: int = 12, gap: int = 0, least: int = 24) -> DataFrame:
    """Rows of each expanding fold: fold, step (null in the training part), is_test. Series shorter than h + least have none."""
    rows = numbered(panel).withColumn("fold", F.explode(F.sequence(F.lit(0), F.lit(k - 1))))
    rows = rows.withColumn("train_end", F.col("n") - (F.lit(k) - F.col("fold")) * h - gap)
    rows = rows.where((F.col("n") >= h + least) & (F.col("train_end") > h) & (F.col("rn") <= F.col("train_end") + h))
    step = F.when(F.col("rn") > F.col("train_end"), F.col("rn") - F.col("train_end"))
    return rows.withColumn("step", step).withColumn("is_test", step.isNotNull())


def walk_forward_folds(panel: DataFrame, season: int = 12, most: int = 5, gap: int = 12, least: int = 24) -> DataFrame:
    """Yearly folds, as many as the series has years, at most most; a training part needs least rows."""
    rows = numbered(panel).withColumn("k", F.least(F.lit(most), F.floor(F.col("n") / season).cast("int")))
    rows = rows.where("k > 0").withColumn("fold", F.explode(F.sequence(F.lit(0), F.col("k") - 1)))
    rows = rows.withColumn("train_end", F.col("n") - (F.col("k") - F.col("fold")) * season - gap).where((F.col("train_end") >= least) & (F.col("rn") <= F.col("train_end") + season))
    step = F.when(F.col("rn") > F.col("train_end"), F.col("rn") - F.col("train_end"))
    return rows.withColumn("step", step).withColumn("is_test", step.isNotNull())


def ratio_holdout(panel: DataFrame, least: int = 36) -> DataFrame:
    """is_test for the last fifth of a series, 12 rows at least and 24 at most."""
    rows = numbered(panel).where(F.col("n") >= least)
    held = F.least(F.lit(24), F.greatest(F.lit(12), F.floor(F.col("n") / 5)))
    return rows.withColumn("is_test", F.col("rn") > F.col("n") - held)


def seasonal_naive_backtest(panel: DataFrame, k: int = 5, h: int = 12, season: int = 12, gap: int = 0) -> DataFrame:
    """unique_id, fold, step, ds, y, yhat, scale: each test row with the value a season (or more) before, from the training part."""
    rows = folds(panel, k, h, gap)
    train = rows.where(~F.col("is_test"))
    w = Window.partitionBy(ID, "fold").orderBy("rn")
    scale = train.withColumn("c", F.abs(F.col("y") - F.lag("y", season).over(w))).groupBy(ID, "fold").agg(F.avg("c").alias("scale"))
    tail = train.where(F.col("rn") > F.col("train_end") - season).select(ID, "fold", (F.col("rn") - F.col("train_end") + season - 1).alias("slot"), F.col("y").alias("yhat"))
    test = rows.where("is_test").withColumn("slot", F.pmod(F.col("step") - 1, F.lit(season)))
    return test.join(tail, [ID, "fold", "slot"]).join(scale, [ID, "fold"]).select(ID, "fold", "step", "ds", "y", "yhat", "scale")


def seasonal_naive(panel: DataFrame, h: int = 12, season: int = 12) -> DataFrame:
    tail = numbered(panel).where(F.col("rn") > F.col("n") - season).select(ID, (F.col("rn") - F.col("n") + season - 1).alias("slot"), F.col("y").alias("yhat"))
    ahead = horizon(panel, h).withColumn("slot", F.pmod(F.col("step") - 1, F.lit(season)))
    return ahead.join(tail, [ID, "slot"]).select(ID, "step", "ds", "yhat")


def flat(panel: DataFrame, h: int = 12) -> DataFrame:
    """The last value; the exponential smoothing that starts from it stays there."""
    last = panel.groupBy(ID).agg(F.max_by("y", "ds").alias("yhat"))
    return horizon(panel, h).join(last, ID).select(ID, "step", "ds", "yhat")


def trend_seasonal(panel: DataFrame, h: int = 12, window: int = 24, weight: float = 0.3) -> DataFrame:
    """Last value, plus the slope of the last window rows, plus a share of their deviation from their mean, repeated."""
    tail = numbered(panel).where(F.col("rn") > F.col("n") - window)
    fit = tail.groupBy(ID).agg(F.regr_slope("y", F.col("rn").cast("double")).alias("slope"), F.avg("y").alias("mean"), F.max_by("y", "rn").alias("last"), F.count(F.lit(1)).alias("m"))
    slots = tail.select(ID, (F.col("rn") - F.greatest(F.col("n") - window, F.lit(0)) - 1).alias("slot"), F.col("y").alias("v"))
    ahead = horizon(panel, h).join(fit, ID).withColumn("slot", F.pmod(F.col("step") - 1, F.col("m")))
    yhat = F.col("last") + F.col("slope") * F.col("step") + weight * (F.col("v") - F.col("mean"))
    return ahead.join(slots, [ID, "slot"]).select(ID, "step", "ds", yhat.alias("yhat"))


def growth_stats(panel: DataFrame, season: int = 12) -> DataFrame:
    """last, growth (mean of the last year's yearly rates) and volatility (their population deviation) of series of two years or more."""
    rows = numbered(panel).withColumn("rate", safe_div(F.col("y"), F.lag("y", season).over(Window.partitionBy(ID).orderBy("ds"))) - 1)
    rows = rows.where((F.col("n") >= 2 * season) & (F.col("rn") > F.col("n") - season))
    return rows.groupBy(ID).agg(F.max_by("y", "rn").alias("last"), F.avg("rate").alias("growth"), F.stddev_pop("rate").alias("volatility"))


def growth_projection(panel: DataFrame, h: int = 12) -> DataFrame:
    return horizon(panel, h).join(growth_stats(panel), ID).select(ID, "step", "ds", (F.col("last") * F.pow(1 + F.col("growth"), F.col("step"))).alias("yhat"))


def ensemble(parts: dict[str, DataFrame], weights: dict[str, float] | None = None) -> DataFrame:
    """Mean (or weighted mean) of methods by step, and bands from their spread: 68, 80 and 95 percent of a normal law.

    The bands tell how far the methods disagree (method_spread), not how far off they are.
    """
    rows = None
    for name, df in parts.items():
        own = df.select(ID, "step", "ds", "yhat", F.lit(name).alias("model"), F.lit(float((weights or {}).get(name, 1.0))).alias("weight"))
        rows = own if rows is None else rows.unionByName(own)
    out = rows.groupBy(ID, "step", "ds").agg((F.sum(F.col("yhat") * F.col("weight")) / F.sum("weight")).alias("yhat"), F.stddev_pop("yhat").alias("method_spread"), F.count(F.lit(1)).alias("n_methods"))
    for name, z in {"68": 1.0, "80": 1.28, "95": 1.96}.items():
        out = out.withColumn(f"lower_{name}", F.col("yhat") - z * F.col("method_spread")).withColumn(f"upper_{name}", F.col("yhat") + z * F.col("method_spread"))
    return out


def long_term(panel: DataFrame, h: int = 60) -> DataFrame:
    return ensemble({"flat": flat(panel, h), "trend_seasonal": trend_seasonal(panel, h), "growth": growth_projection(panel, h)})


def scenarios(forecast: DataFrame, stats: DataFrame, default: float = 0.05) -> DataFrame:
    """optimistic and pessimistic paths beside the baseline: half the volatility compounded from the second step on."""
    v = 0.5 * F.coalesce(F.col("volatility"), F.lit(default))
    rows = forecast.join(stats.select(ID, "volatility"), ID, "left")
    return rows.select(
        ID, "step", "ds", (F.col("yhat") * F.pow(1 + v, F.col("step") - 1)).alias("optimistic"), F.col("yhat").alias("baseline"), (F.col("yhat") * F.pow(1 - v, F.col("step") - 1)).alias("pessimistic")
    )


def seasonal_path(panel: DataFrame, base: DataFrame, h: int = 12, rise: float = 0.1) -> DataFrame:
    """A model's base value (unique_id, base) along last year's shape, rising by a tenth to the horizon, never under 0."""
    tail = numbered(panel).where(F.col("rn") > F.col("n") - 12)
    shape = tail.withColumn("f", safe_div(F.col("y"), F.avg("y").over(Window.partitionBy(ID)))).select(ID, (F.col("rn") - F.col("n") + 11).alias("slot"), "f")
    ahead = horizon(panel, h).withColumn("slot", F.pmod(F.col("step") - 1, F.lit(12)))
    yhat = F.greatest(F.lit(0.0), F.col("base") * F.col("f") * (1 + rise * F.col("step") / h))
    return ahead.join(shape, [ID, "slot"]).join(base, ID).select(ID, "step", "ds", yhat.alias("yhat"))
