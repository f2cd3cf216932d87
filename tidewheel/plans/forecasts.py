"""Queries on splits, forecasts and accuracy."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import forecast as G
from ..operators import metrics as M
from ..operators import models as L
from ..operators import trees as T
from ..sources import series as src
from .base import SALES, query, r

_N = "n AS (SELECT *, row_number() OVER (PARTITION BY unique_id ORDER BY ds) AS rn, count(*) OVER (PARTITION BY unique_id) AS n FROM p)"
_F = "f AS (SELECT n.*, fold::INT AS fold, n - (5 - fold) * 12 AS train_end FROM n, range(5) q(fold) WHERE n >= 36 AND n - (5 - fold) * 12 > 12 AND rn <= n - (5 - fold) * 12 + 12)"
_BT = """sc AS (SELECT unique_id, fold, avg(c) AS scale FROM (SELECT unique_id, fold, abs(y - lag(y, 12) OVER (PARTITION BY unique_id, fold ORDER BY rn)) AS c FROM f WHERE rn <= train_end) GROUP BY 1, 2),
bt AS (SELECT a.unique_id, a.fold, (a.rn - a.train_end)::INT AS step, a.ds, a.y, b.y AS yhat, scale FROM f a JOIN f b ON a.unique_id = b.unique_id AND a.fold = b.fold AND a.rn > a.train_end AND b.rn = a.rn - 12
  JOIN sc ON a.unique_id = sc.unique_id AND a.fold = sc.fold)"""


def _panel(spark, d):
    return src.sales_panel(spark, d)


@query("backtest_folds", f"WITH {SALES}, {_N}, {_F} SELECT unique_id, fold, count(*) FILTER (rn <= train_end) AS n_train, count(*) FILTER (rn > train_end) AS n_test, max(ds) FILTER (rn <= train_end) AS last_train, min(ds) FILTER (rn > train_end) AS first_test FROM f GROUP BY 1, 2")
def backtest_folds(spark, d):
    return G.folds(_panel(spark, d)).groupBy("unique_id", "fold").agg(
        F.count_if(~F.col("is_test")).alias("n_train"), F.count_if("is_test").alias("n_test"), F.max(F.when(~F.col("is_test"), F.col("ds"))).alias("last_train"), F.min(F.when(F.col("is_test"), F.col("ds"))).alias("first_test")
    )


@query("walk_forward_folds", f"WITH {SALES}, {_N}, g AS (SELECT n.*, fold::INT AS fold, n - (least(5, n // 12) - fold) * 12 - 12 AS train_end FROM n, range(5) q(fold) WHERE fold < least(5, n // 12)) SELECT unique_id, fold, max(train_end)::INT AS train_end, count(*) AS n_rows FROM g WHERE train_end >= 24 AND rn <= train_end + 12 GROUP BY 1, 2")
def walk_forward_folds(spark, d):
    return G.walk_forward_folds(_panel(spark, d)).groupBy("unique_id", "fold").agg(F.max("train_end").cast("int").alias("train_end"), F.count(F.lit(1)).alias("n_rows"))


@query("ratio_holdout", f"WITH {SALES}, {_N} SELECT unique_id, count(*) FILTER (rn > n - least(24, greatest(12, n // 5))) AS n_test, count(*) AS n_rows FROM n WHERE n >= 36 GROUP BY 1")
def ratio_holdout(spark, d):
    return G.ratio_holdout(_panel(spark, d)).groupBy("unique_id").agg(F.count_if("is_test").alias("n_test"), F.count(F.lit(1)).alias("n_rows"))


@query("seasonal_naive_backtest", f"WITH {SALES}, {_N}, {_F}, {_BT} SELECT unique_id, fold, step, ds, {r('y', 'y')}, {r('yhat', 'yhat')}, {r('scale', 'scale')} FROM bt")
def seasonal_naive_backtest(spark, d):
    return G.seasonal_naive_backtest(_panel(spark, d)).withColumn("step", F.col("step").cast("int"))


_METRICS = f"{r('avg(abs((y - yhat) / nullif(y, 0))) * 100', 'mape')}, {r('avg(abs(y - yhat) / nullif((abs(y) + abs(yhat)) / 2, 0)) * 100', 'smape')}, {r('avg(abs(y - yhat))', 'mae', 4)}, {r('sqrt(avg((y - yhat) * (y - yhat)))', 'rmse', 4)}"


@query("metrics_by_series", f"WITH {SALES}, {_N}, {_F}, {_BT} SELECT unique_id, {_METRICS}, {r('1 - sum((y - yhat) * (y - yhat)) / nullif(var_pop(y) * count(y), 0)', 'r2')}, count(*) AS n FROM bt GROUP BY 1")
def metrics_by_series(spark, d):
    out = M.all_metrics(G.seasonal_naive_backtest(_panel(spark, d)), ["unique_id"])
    return out.withColumns({c: F.round(c, 4) for c in ("mae", "rmse")})


@query("mase_by_fold", f"WITH {SALES}, {_N}, {_F}, {_BT} SELECT unique_id, fold, {r('avg(abs(y - yhat)) / nullif(max(scale), 0)', 'mase')} FROM bt GROUP BY 1, 2")
def mase_by_fold(spark, d):
    bt = G.seasonal_naive_backtest(_panel(spark, d))
    return bt.groupBy("unique_id", "fold").agg(M.mase(M.mae(F.col("y"), F.col("yhat")), F.max("scale")).alias("mase"))


@query("naive_scale", f"WITH {SALES}, s1 AS (SELECT *, abs(y - lag(y, 12) OVER w) AS a FROM p WINDOW w AS (PARTITION BY unique_id ORDER BY ds)) SELECT unique_id, {r('avg(a)', 'scale', 4)} FROM s1 GROUP BY 1")
def naive_scale(spark, d):
    return M.naive_scale(_panel(spark, d), ["unique_id"]).withColumn("scale", F.round("scale", 4))


@query("moments_by_series", f"WITH {SALES} SELECT unique_id, {r('avg(y)', 'y_mean', 4)}, {r('stddev_pop(y)', 'y_std', 4)}, {r('min(y)', 'y_min', 4)}, {r('max(y)', 'y_max', 4)} FROM p GROUP BY 1")
def moments_by_series(spark, d):
    out = _panel(spark, d).groupBy("unique_id").agg(*M.moments(F.col("y"), "y"))
    return out.withColumns({c: F.round(c, 4) for c in out.columns if c != "unique_id"})


@query(
    "directional_accuracy",
    f"WITH {SALES}, {_N}, {_F}, {_BT}, s1 AS (SELECT unique_id, (sign(y - lag(y) OVER w) = sign(yhat - lag(yhat) OVER w))::INT AS ok FROM bt WINDOW w AS (PARTITION BY unique_id, fold ORDER BY step)) SELECT unique_id, {r('avg(ok) * 100', 'directional_accuracy')} FROM s1 GROUP BY 1",
)
def directional_accuracy(spark, d):
    return M.directional_accuracy(G.seasonal_naive_backtest(_panel(spark, d)), ["unique_id"], "step", ["fold"])


_TWO = f"WITH {SALES}, {_N}, {_F}, {_BT}, l AS (SELECT unique_id, fold, max(y) FILTER (rn = train_end) AS v FROM f GROUP BY 1, 2), a AS (SELECT unique_id, 'seasonal_naive' AS model, y, yhat, scale FROM bt UNION ALL SELECT unique_id, 'flat', y, v, scale FROM bt JOIN l USING (unique_id, fold)), sc2 AS (SELECT unique_id, model, avg(abs(y - yhat) / nullif(scale, 0)) AS mase FROM a GROUP BY 1, 2)"


def _scores(spark, d):
    panel = _panel(spark, d)
    bt = G.seasonal_naive_backtest(panel)
    last = G.folds(panel).where(F.col("rn") == F.col("train_end")).select("unique_id", "fold", F.col("y").alias("v"))
    flat = bt.join(last, ["unique_id", "fold"]).select("unique_id", F.lit("flat").alias("model"), "y", F.col("v").alias("yhat"), "scale")
    both = bt.select("unique_id", F.lit("seasonal_naive").alias("model"), "y", "yhat", "scale").unionByName(flat)
    return both.groupBy("unique_id", "model").agg(F.avg(F.abs(F.col("y") - F.col("yhat")) / F.nullif("scale", F.lit(0.0))).alias("mase"))


@query("leaderboard", f"{_TWO} SELECT unique_id, model, {r('mase', 'mase')}, row_number() OVER (PARTITION BY unique_id ORDER BY mase, model)::INT AS place FROM sc2")
def leaderboard(spark, d):
    return M.leaderboard(_scores(spark, d), "unique_id")


@query("best_model", f"{_TWO} SELECT unique_id, model FROM sc2 QUALIFY row_number() OVER (PARTITION BY unique_id ORDER BY mase, model) = 1")
def best_model(spark, d):
    return M.leaderboard(_scores(spark, d), "unique_id").where("place = 1").select("unique_id", "model")


@query("model_statistics", f"{_TWO} SELECT model, {r('avg(mase)', 'mase_mean')}, {r('stddev_pop(mase)', 'mase_std')}, {r('min(mase)', 'mase_min')}, {r('max(mase)', 'mase_max')}, {r('count(mase) / count(*) * 100', 'success_rate')}, count(*) AS n_runs FROM sc2 GROUP BY 1")
def model_statistics(spark, d):
    return M.model_statistics(_scores(spark, d), ["mase"])


@query("overall_statistics", f"{_TWO} SELECT {r('avg(mase)', 'mean')}, {r('median(mase)', 'median')}, {r('stddev_pop(mase)', 'std')} FROM sc2")
def overall_statistics(spark, d):
    return _scores(spark, d).agg(F.avg("mase").alias("mean"), F.median("mase").alias("median"), F.stddev_pop("mase").alias("std"))


def _ahead(h: int) -> str:
    return f"h AS (SELECT unique_id, st::INT AS step, last_day(max(ds) + to_months(st::INT)) AS ds FROM p, range(1, {h + 1}) q(st) GROUP BY unique_id, st)"


@query("horizon_dates", f"WITH {SALES}, {_ahead(12)} SELECT unique_id, step, ds FROM h")
def horizon_dates(spark, d):
    from ..operators.reshape import horizon

    return horizon(_panel(spark, d), 12)


@query("seasonal_naive_forecast", f"WITH {SALES}, {_N}, {_ahead(24)} SELECT h.unique_id, step, h.ds, {r('n.y', 'yhat', 4)} FROM h JOIN n ON h.unique_id = n.unique_id AND n.rn = n.n - 12 + (step - 1) % 12 + 1")
def seasonal_naive_forecast(spark, d):
    return G.seasonal_naive(_panel(spark, d), 24)


_FLAT = "fl AS (SELECT h.unique_id, step, h.ds, y AS yhat FROM h JOIN n ON h.unique_id = n.unique_id AND rn = n)"
_TREND = """tl AS (SELECT *, rn - greatest(n - 24, 0) - 1 AS slot FROM n WHERE rn > n - 24), ft AS (SELECT unique_id, regr_slope(y, rn) AS slope, avg(y) AS mean, arg_max(y, rn) AS last, count(*) AS m FROM tl GROUP BY 1),
tr AS (SELECT h.unique_id, step, h.ds, last + slope * step + 0.3 * (y - mean) AS yhat FROM h JOIN ft USING (unique_id) JOIN tl ON tl.unique_id = h.unique_id AND slot = (step - 1) % m)"""
_GROWTH = """gr AS (SELECT unique_id, arg_max(y, rn) AS last, avg(rate) AS growth, stddev_pop(rate) AS volatility FROM (SELECT *, y / nullif(lag(y, 12) OVER (PARTITION BY unique_id ORDER BY ds), 0) - 1 AS rate FROM n) WHERE n >= 24 AND rn > n - 12 GROUP BY 1),
gp AS (SELECT unique_id, step, ds, last * pow(1 + growth, step) AS yhat FROM h JOIN gr USING (unique_id))"""


@query("flat_smoothing", f"WITH {SALES}, {_N}, {_ahead(12)}, {_FLAT} SELECT unique_id, step, ds, {r('yhat', 'yhat', 4)} FROM fl")
def flat_smoothing(spark, d):
    return G.flat(_panel(spark, d))


@query("trend_seasonality", f"WITH {SALES}, {_N}, {_ahead(60)}, {_TREND} SELECT unique_id, step, ds, {r('yhat', 'yhat', 4)} FROM tr")
def trend_seasonality(spark, d):
    return G.trend_seasonal(_panel(spark, d), 60).withColumn("yhat", F.round("yhat", 4))


@query("growth_projection", f"WITH {SALES}, {_N}, {_ahead(60)}, {_GROWTH} SELECT unique_id, step, ds, {r('yhat', 'yhat', 3)} FROM gp")
def growth_projection(spark, d):
    return G.growth_projection(_panel(spark, d), 60).withColumn("yhat", F.round("yhat", 3))


_ENS = f"WITH {SALES}, {_N}, {_ahead(60)}, {_FLAT}, {_TREND}, {_GROWTH}, al AS (SELECT * FROM fl UNION ALL SELECT * FROM tr UNION ALL SELECT * FROM gp), en AS (SELECT unique_id, step, ds, avg(yhat) AS yhat, stddev_pop(yhat) AS sp, count(*) AS n_methods FROM al GROUP BY 1, 2, 3)"


@query("ensemble_bands", f"{_ENS} SELECT unique_id, step, ds, {r('yhat', 'yhat', 3)}, {r('sp', 'method_spread', 3)}, n_methods, " + ", ".join(f"{r(f'yhat - {z} * sp', f'lower_{n}', 3)}, {r(f'yhat + {z} * sp', f'upper_{n}', 3)}" for n, z in ((68, 1.0), (80, 1.28), (95, 1.96))) + " FROM en")
def ensemble_bands(spark, d):
    out = G.long_term(_panel(spark, d), 60)
    return out.withColumns({f.name: F.round(f.name, 3) for f in out.schema if f.dataType.typeName() == "double"})


@query("weighted_ensemble", f"WITH {SALES}, {_N}, {_ahead(12)}, {_FLAT}, {_GROWTH} SELECT unique_id, step, ds, {r('0.25 * fl.yhat + 0.75 * gp.yhat', 'yhat', 3)} FROM fl JOIN gp USING (unique_id, step, ds)")
def weighted_ensemble(spark, d):
    p = _panel(spark, d)
    out = G.ensemble({"flat": G.flat(p), "growth": G.growth_projection(p)}, {"flat": 0.25, "growth": 0.75})
    return out.select("unique_id", "step", "ds", F.round("yhat", 3).alias("yhat"))


@query("scenarios", f"{_ENS} SELECT unique_id, step, ds, {r('yhat * pow(1 + 0.5 * volatility, step - 1)', 'optimistic', 3)}, {r('yhat', 'baseline', 3)}, {r('yhat * pow(1 - 0.5 * volatility, step - 1)', 'pessimistic', 3)} FROM en JOIN gr USING (unique_id)")
def scenarios(spark, d):
    p = _panel(spark, d)
    out = G.scenarios(G.long_term(p, 60), G.growth_stats(p))
    return out.withColumns({c: F.round(c, 3) for c in ("optimistic", "baseline", "pessimistic")})


@query("seasonal_path", f"WITH {SALES}, {_N}, {_ahead(12)}, sh AS (SELECT unique_id, rn - n + 11 AS slot, y / nullif(avg(y) OVER (PARTITION BY unique_id), 0) AS f FROM n WHERE rn > n - 12), ba AS (SELECT unique_id, avg(y) AS base FROM p GROUP BY 1) SELECT h.unique_id, step, ds, {r('greatest(0, base * f * (1 + 0.1 * step / 12))', 'yhat', 3)} FROM h JOIN sh ON h.unique_id = sh.unique_id AND slot = (step - 1) % 12 JOIN ba ON h.unique_id = ba.unique_id")
def seasonal_path(spark, d):
    p = _panel(spark, d)
    return G.seasonal_path(p, p.groupBy("unique_id").agg(F.avg("y").alias("base"))).withColumn("yhat", F.round("yhat", 3))


# fitted models: rows only; tests/test_trees.py and tests/test_searched.py hold trees and searched models against plain code
@query("ets_forecast")
def ets_forecast(spark, d):
    return L.forecast_models(_panel(spark, d), 12, {"ets": L.ets})


@query("ar_forecast")
def ar_forecast(spark, d):
    return L.forecast_models(_panel(spark, d), 12, {"ar": L.ar})


@query("model_backtest")
def model_backtest(spark, d):
    return L.backtest_models(_panel(spark, d))


@query("rf_forecast")
def rf_forecast(spark, d):
    return L.fit_trees(_panel(spark, d), L.forest())[1]


@query("gbt_forecast")
def gbt_forecast(spark, d):
    return T.holdout(_panel(spark, d))


@query("feature_importance")
def feature_importance(spark, d):
    model, _, names = L.fit_trees(_panel(spark, d), L.forest())
    return spark.createDataFrame(L.importances(model, names), "feature string, importance double")


@query("stationarity")
def stationarity(spark, d):
    return L.stationarity(_panel(spark, d))
