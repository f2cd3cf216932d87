"""Fitted forecasters: per-series statistical ones in grouped tasks, tree models over all series by pyspark.ml.

A model that cannot be fitted tells so in its status column and gives null
values; there are no placeholder numbers. The statistical ones are a stated
subset of their namesakes: ets searches a grid of smoothing weights of the
additive Holt-Winters form by squared one-step error; ar is a regression of
the yearly difference on its own lags 1, 2 and 12.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterable
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import GBTRegressor, RandomForestRegressor
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .features import model_profile
from .forecast import folds, horizon
from .windows import over_time

SEASON = 12
#: Rows of a training table that a task reads at least.
ROWS_A_TASK = 20_000


class Forecaster(Protocol):
    """history (oldest first) and a number of steps in, that many values out; ValueError if it cannot."""

    def __call__(self, y: np.ndarray, h: int) -> np.ndarray: ...


def _holt_winters(y: np.ndarray, a: float, b: float, g: float, damp: float) -> tuple[float, float, float, list[float]]:
    first = y[:SEASON].mean()
    level, slope = first, (y[SEASON : 2 * SEASON].mean() - first) / SEASON
    season, loss = list(y[:SEASON] - first), 0.0
    for t in range(SEASON, len(y)):
        s = season[t % SEASON]
        loss += (y[t] - (level + damp * slope + s)) ** 2
        new = a * (y[t] - s) + (1 - a) * (level + damp * slope)
        slope = b * (new - level) + (1 - b) * damp * slope
        season[t % SEASON] = g * (y[t] - new) + (1 - g) * s
        level = new
    return loss, level, slope, season


def ets(y: np.ndarray, h: int) -> np.ndarray:
    if len(y) < 2 * SEASON:
        raise ValueError("needs two seasons")
    grid = ((a, b, g, d) for a in (0.1, 0.3, 0.5, 0.8) for b in (0.01, 0.1) for g in (0.05, 0.3) for d in (0.9, 1.0))
    best = min(grid, key=lambda p: _holt_winters(y, *p)[0])
    _, level, slope, season = _holt_winters(y, *best)
    damp = np.cumsum(best[3] ** np.arange(1, h + 1))
    return level + slope * damp + np.array([season[(len(y) + k) % SEASON] for k in range(h)])


def ar(y: np.ndarray, h: int) -> np.ndarray:
    if len(y) < 3 * SEASON + 4:
        raise ValueError("needs three seasons")
    d, lags = y[SEASON:] - y[:-SEASON], (1, 2, SEASON)
    rows = np.array([[1.0, *(d[t - k] for k in lags)] for t in range(SEASON, len(d))])
    weights = np.linalg.lstsq(rows, d[SEASON:], rcond=None)[0]
    d, out = list(d), list(y)
    for _ in range(h):
        d.append(float(weights @ [1.0, *(d[-k] for k in lags)]))
        out.append(out[-SEASON] + d[-1])
    return np.array(out[-h:])


MODELS: dict[str, Forecaster] = {"ets": ets, "ar": ar}
_OUT = "unique_id string, fold int, model string, step int, yhat double, status string, seconds double"


def _fit_groups(models: dict[str, Forecaster], h: int) -> Callable[[pd.DataFrame], pd.DataFrame]:
    def work(part: pd.DataFrame) -> pd.DataFrame:
        y = part.sort_values("ds")["y"].to_numpy("f8")
        out = []
        for name, model in models.items():
            began = time.perf_counter()
            try:
                values, status = model(y[~np.isnan(y)], h), "ok"
            except ValueError as why:
                values, status = [None] * h, str(why)
            took = time.perf_counter() - began
            out += [(part["unique_id"].iloc[0], int(part["fold"].iloc[0]), name, k + 1, v, status, took) for k, v in enumerate(values)]
        return pd.DataFrame(out, columns=["unique_id", "fold", "model", "step", "yhat", "status", "seconds"]).astype({"yhat": "f8"})

    return work


def forecast_models(panel: DataFrame, h: int = 12, models: dict[str, Forecaster] | None = None) -> DataFrame:
    """unique_id, model, step, ds, yhat, status of each series and model."""
    got = panel.withColumn("fold", F.lit(0)).select("unique_id", "fold", "ds", "y").groupBy("unique_id", "fold").applyInPandas(_fit_groups(models or MODELS, h), _OUT)
    return got.join(horizon(panel, h), ["unique_id", "step"]).select("unique_id", "model", "step", "ds", "yhat", "status")


def backtest_models(panel: DataFrame, k: int = 5, h: int = 12, models: dict[str, Forecaster] | None = None) -> DataFrame:
    """unique_id, model, fold, step, ds, y, yhat, status: every fold of every series is a task of its own."""
    rows = folds(panel, k, h)
    got = rows.where(~F.col("is_test")).select("unique_id", "fold", "ds", "y").groupBy("unique_id", "fold").applyInPandas(_fit_groups(models or MODELS, h), _OUT)
    return rows.where("is_test").select("unique_id", "fold", "step", "ds", "y").join(got, ["unique_id", "fold", "step"]).drop("seconds")


def model_times(panel: DataFrame, k: int = 5, h: int = 12, models: dict[str, Forecaster] | None = None) -> DataFrame:
    """model, n_fits, seconds: how often each model was fitted in a backtest, and the time of all its fits."""
    rows = folds(panel, k, h)
    got = rows.where(~F.col("is_test")).select("unique_id", "fold", "ds", "y").groupBy("unique_id", "fold").applyInPandas(_fit_groups(models or MODELS, h), _OUT)
    return got.where("step = 1").groupBy("model").agg(F.count(F.lit(1)).alias("n_fits"), F.sum("seconds").alias("seconds"))


def feature_matrix(panel: DataFrame) -> tuple[DataFrame, list[str]]:
    """The model profile with nulls as 0, and the names of its numeric features."""
    wide = model_profile(panel)
    names = [f.name for f in wide.schema if f.name not in ("unique_id", "ds", "y") and f.dataType.typeName() in ("integer", "long", "double")]
    return wide.select("unique_id", "ds", F.col("y").alias("label"), *[F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c) for c in names]), names


def forest(seed: int = 42, **settings) -> RandomForestRegressor:
    return RandomForestRegressor(featuresCol="features", **({"numTrees": 100, "maxDepth": 10, "minInstancesPerNode": 2, "featureSubsetStrategy": "sqrt", "seed": seed} | settings))


def boosting(seed: int = 42, **settings) -> GBTRegressor:
    return GBTRegressor(featuresCol="features", **({"maxIter": 200, "stepSize": 0.05, "maxDepth": 6, "subsamplingRate": 0.8, "seed": seed} | settings))


def fit_trees(panel: DataFrame, regressor: RandomForestRegressor | GBTRegressor, held: int = 12) -> tuple[PipelineModel, DataFrame, list[str]]:
    """The model fitted on all series before their last held months, and unique_id, ds, y, yhat of those months."""
    wide, names = feature_matrix(panel)
    cut = wide.groupBy("unique_id").agg(F.add_months(F.max("ds"), -held).alias("cut"))
    kept = wide.join(cut, "unique_id").cache()
    # every round of a tree ensemble is a job or more: no more tasks than the rows are worth
    wide = kept.coalesce(kept.count() // ROWS_A_TASK + 1)
    try:
        model = Pipeline(stages=[VectorAssembler(inputCols=names, outputCol="features"), regressor]).fit(wide.where("ds <= cut"))
    finally:
        kept.unpersist()
    return model, model.transform(wide.where("ds > cut")).select("unique_id", "ds", F.col("label").alias("y"), F.col("prediction").alias("yhat")), names


def _split_data(wide: DataFrame, names: list[str], regressor: RandomForestRegressor | GBTRegressor, rows: DataFrame) -> DataFrame:
    kept = rows.cache()
    try:
        model = Pipeline(stages=[VectorAssembler(inputCols=names, outputCol="features"), regressor]).fit(kept.coalesce(kept.count() // ROWS_A_TASK + 1))
    finally:
        kept.unpersist()
    return model.transform(wide)


def tree_forecast(panel: DataFrame, regressor: RandomForestRegressor | GBTRegressor, h: int = 12) -> DataFrame:
    """unique_id, step, ds, yhat of the h months after each series: one direct model for all steps, the step a feature.

    A row of history is an example for each step whose month it has; nothing is fed back, so errors do not pile up.
    """
    wide, names = feature_matrix(panel)
    w = over_time()
    # what comes, and the newest value known of the same month of a year before
    pairs = [F.struct(F.lead("label", s).over(w).alias("target"), F.lag("label", -s % SEASON).over(w).alias("anchor")) for s in range(1, h + 1)]
    rows = wide.withColumn("ahead", F.array(*pairs)).withColumn("is_last", F.lead("ds").over(w).isNull())
    rows = rows.select("unique_id", "ds", "is_last", *names, F.posexplode("ahead").alias("s", "x")).withColumn("step", F.col("s") + 1)
    rows = rows.withColumns({"target": F.col("x.target"), "anchor": F.coalesce("x.anchor", F.lit(0.0)), "target_month": F.month(F.add_months("ds", F.col("step")))}).drop("x")
    known = rows.where("target is not null").withColumn("label", F.col("target"))
    got = _split_data(rows.where("is_last"), [*names, "step", "anchor", "target_month"], regressor, known)
    return got.select("unique_id", "step", F.last_day(F.add_months("ds", F.col("step"))).alias("ds"), F.col("prediction").alias("yhat"))


def in_sample(panel: DataFrame, regressor: RandomForestRegressor | GBTRegressor, pad: int = 24) -> DataFrame:
    """unique_id, ds, y, yhat, padded: the fit of each month from the months before it; the first pad months of a series repeat y."""
    wide, names = feature_matrix(panel)
    got = _split_data(wide.withColumn("rn", F.row_number().over(over_time())), names, regressor, wide.where("label is not null"))
    return got.select("unique_id", "ds", F.col("label").alias("y"), F.when(F.col("rn") <= pad, F.col("label")).otherwise(F.col("prediction")).alias("yhat"), (F.col("rn") <= pad).alias("padded"))


def importances(model: PipelineModel, names: list[str], n: int = 15) -> list[tuple[str, float]]:
    values = model.stages[-1].featureImportances.toArray()
    return sorted(zip(names, map(float, values), strict=True), key=lambda x: (-x[1], x[0]))[:n]


def grid_search(tries: Iterable[dict], score: Callable[[dict], float], patience: int = 3, larger: bool = False) -> tuple[dict | None, float | None]:
    """The best of settings tried in order, until patience of them in a row bring nothing."""
    best, value, idle = None, None, 0
    for settings in tries:
        now = score(settings)
        if value is None or (now > value if larger else now < value):
            best, value, idle = settings, now, 0
        elif (idle := idle + 1) >= patience:
            break
    return best, value


def stationarity(panel: DataFrame) -> DataFrame:
    """unique_id, statistic: the Dickey-Fuller t of each series with a constant (below -2.89: stationary at 5 percent); null below five values."""
    w = over_time()
    rows = panel.where("y is not null").withColumn("x", F.lag("y").over(w)).withColumn("d", F.col("y") - F.col("x"))
    sums = rows.groupBy("unique_id").agg(F.regr_sxx("d", "x").alias("xx"), F.regr_syy("d", "x").alias("yy"), F.regr_sxy("d", "x").alias("xy"), F.count("x").alias("n"))
    spread = (F.col("yy") - F.col("xy") * F.col("xy") / F.col("xx")) / (F.col("n") - 2) / F.col("xx")
    return sums.select("unique_id", F.when((F.col("n") > 3) & (spread > 0), F.col("xy") / F.col("xx") / F.sqrt(spread)).alias("statistic"))
