"""Queries shaped like dataset readers and sinks: stored series and features, targets, forecast results, panel reports, trees ahead."""

from __future__ import annotations

import datetime

from pyspark.sql import functions as F

from ..functions.scalars import CATEGORY_SEASONS, category_seasons, holidays
from ..operators import features as X
from ..operators import models as L
from ..operators import quality as Q
from ..operators import reshape as H
from ..operators import store as K
from ..sources import providers
from ..sources import series as src
from .base import SALES, query, r


def _series(spark, d):
    p = src.sales_panel(spark, d)
    sales = p.select(F.col("unique_id").alias("category_id"), "ds", F.col("y").alias("value"), F.lit("sales").alias("data_type"), F.lit("t").alias("source"))
    return sales.unionByName(sales.withColumns({"value": F.round(F.col("value") / 2, 4), "data_type": F.lit("costs")}))


def _features(spark, d):
    wide = X.store_profile(src.sales_panel(spark, d)).withColumnRenamed("unique_id", "category_id")
    return H.long(wide, ["category_id", "ds"], ["lag_1", "ma_3"])


_ST = f"WITH {SALES}, st AS (SELECT unique_id AS category_id, ds, y AS value, 'sales' AS data_type FROM p UNION ALL SELECT unique_id, ds, round(y / 2, 4), 'costs' FROM p)"
_FE = "fe AS (SELECT unique_id, ds, lag(y) OVER w AS lag_1, avg(y) OVER (PARTITION BY unique_id ORDER BY ds ROWS 2 PRECEDING) AS ma_3, y FROM p WINDOW w AS (PARTITION BY unique_id ORDER BY ds))"


@query("category_series", f"{_ST} SELECT category_id, ds, {r('max(value) FILTER (data_type = $$sales$$)', 'sales', 4)}, {r('max(value) FILTER (data_type = $$costs$$)', 'costs', 4)} FROM st WHERE ds BETWEEN DATE '1998-01-01' AND DATE '2000-12-31' GROUP BY 1, 2".replace("$$", "'"))
def category_series(spark, d):
    return K.by_category(_series(spark, d), None, ["sales", "costs"], "1998-01-01", "2000-12-31")


@query("active_categories", "SELECT p_type AS category_id, count(*) AS n FROM part GROUP BY 1 HAVING count(*) % 2 = 0")
def active_categories(spark, d):
    rows = src.table(spark, d, "part").groupBy(F.col("p_type").alias("category_id")).agg(F.count(F.lit(1)).alias("n"))
    return K.active(rows.withColumn("is_active", F.col("n") % 2 == 0)).drop("is_active")


@query("combined_dataset", f"WITH {SALES}, {_FE} SELECT unique_id AS category_id, ds, {r('y', 'y')}, {r('lag_1', 'lag_1')}, {r('ma_3', 'ma_3')} FROM fe")
def combined_dataset(spark, d):
    return K.combined(_series(spark, d), _features(spark, d), ["lag_1", "ma_3"])


@query("target_loader", f"{_ST}, l AS (SELECT min(category_id) AS a, max(category_id) AS z FROM st) SELECT 'first' AS unique_id, ds, {r('value', 'y', 4)}, false AS is_proxy FROM st, l WHERE category_id = a AND data_type = 'sales' UNION ALL SELECT 'stand_in', ds, {r('value', 'y', 4)}, true FROM st, l WHERE category_id = z AND data_type = 'sales'")
def target_loader(spark, d):
    sales = _series(spark, d).where("data_type = 'sales'")
    ends = sales.agg(F.min("category_id").alias("a"), F.max("category_id").alias("z"))
    wanted = ends.select(F.explode(F.array(F.struct(F.lit("first").alias("target"), F.col("a").alias("category_id"), F.col("z").alias("proxy_id")), F.struct(F.lit("stand_in").alias("target"), F.lit("not there").alias("category_id"), F.col("z").alias("proxy_id")))).alias("x")).select("x.*")
    return K.targets(sales, wanted)


def _sink(spark, d):
    p = src.sales_panel(spark, d)
    test = p.where("year(ds) = 2000").select(F.col("unique_id").alias("category_id"), F.month("ds").alias("step"), "ds", F.round(F.col("y") * 1.5, 4).alias("yhat"), "y")
    at = F.lit(datetime.datetime(2001, 1, 1))
    ahead = test.select(F.concat(F.lit("next "), "category_id").alias("category_id"), "step", "yhat")
    return K.forecast_results("a", test, at).unionByName(K.forecast_results("b", ahead, at + F.make_dt_interval(days=F.lit(1))))


_SK = f"WITH {SALES}, te AS (SELECT unique_id AS c, month(ds)::INT AS step, ds, round(y * 1.5, 4) AS yhat, y FROM p WHERE year(ds) = 2000), mm AS (SELECT c, avg(abs(y - yhat)) AS mae FROM te GROUP BY 1)"


@query("forecast_results", f"{_SK} SELECT te.c AS category_id, 'backtest' AS kind, step, ds, {r('yhat', 'yhat', 4)}, {r('mae', 'mae', 4)} FROM te JOIN mm USING (c) UNION ALL SELECT 'next ' || c, 'forecast', step, last_day(DATE '2000-12-31' + INTERVAL 1 MONTH * step)::DATE, {r('yhat', 'yhat', 4)}, NULL FROM te")
def forecast_results(spark, d):
    rows = _sink(spark, d)
    last = rows.select("category_id", F.lit("2000-12-31").cast("date").alias("last_day"))
    out = K.fan_out(rows, last).select("category_id", "kind", "step", "ds", F.round("yhat", 4).alias("yhat"), F.round("mae", 4).alias("mae"))
    return out


@query("forecast_scan", f"{_SK} SELECT 'next ' || c AS category_id, 'forecast' AS kind, count(*)::INT AS horizon, {r('max(yhat)', 'largest', 4)} FROM te GROUP BY 1 ORDER BY 1 LIMIT 3")
def forecast_scan(spark, d):
    rows = K.forecast_scan(_sink(spark, d), kind="forecast", n=3)
    return rows.select("category_id", "kind", "horizon", F.round(F.array_max(F.transform("result.rows", lambda x: x["yhat"])), 4).alias("largest"))


@query("migrated_series", f"WITH {SALES} SELECT unique_id AS category_id, ds::DATE AS ds, {r('y', 'value', 4)}, 'sales' AS data_type, 'migration' AS source FROM p")
def migrated_series(spark, d):
    return K.migrated(src.sales_panel(spark, d).withColumn("unique_id", F.concat("unique_id", F.lit("US"))))[0]


@query("migrated_features", f"WITH {SALES}, {_FE} SELECT unique_id AS category_id, ds::DATE AS ds, 'lag_1' AS feature_name, {r('lag_1', 'feature_value')}, 'lag' AS feature_type FROM fe WHERE lag_1 IS NOT NULL UNION ALL SELECT unique_id, ds::DATE, 'ma_3', {r('ma_3', 'feature_value')}, 'moving_avg' FROM fe")
def migrated_features(spark, d):
    wide = X.store_profile(src.sales_panel(spark, d)).select("unique_id", "ds", "y", "lag_1", "ma_3")
    return K.migrated(wide.withColumn("unique_id", F.concat("unique_id", F.lit("US"))))[1]


@query(
    "panel_report",
    f"""WITH {SALES}, q AS (SELECT unique_id, ds, CASE WHEN month(ds) <> 7 THEN y END AS y FROM p), e AS (SELECT unique_id, count(*) AS n_rows, min(ds) AS first_day, max(ds) AS last_day, count(*) FILTER (y IS NULL) AS n_nulls, (count(*) FILTER (y IS NULL)) / count(*) AS null_ratio, NULL::DOUBLE AS mean_rows, 1::BIGINT AS n_series FROM q GROUP BY 1)
    SELECT unique_id, n_rows, first_day, last_day, n_nulls, {r('null_ratio', 'null_ratio')}, mean_rows, n_series FROM e UNION ALL SELECT 'all', sum(n_rows)::BIGINT, min(first_day), max(last_day), sum(n_nulls)::BIGINT, {r('avg(null_ratio)', 'null_ratio')}, {r('avg(n_rows)', 'mean_rows')}, count(*) FROM e""",
)
def panel_report(spark, d):
    return Q.panel_report(src.sales_panel(spark, d).withColumn("y", F.when(F.month("ds") != 7, F.col("y"))))


@query("missing_rule", f"WITH {SALES}, q AS (SELECT unique_id, CASE WHEN month(ds) <> 7 THEN y END AS y FROM p), f AS (SELECT unique_id, count(*) FILTER (y IS NULL) AS n_nulls FROM q GROUP BY 1) SELECT unique_id, n_nulls, CASE WHEN unique_id = (SELECT min(unique_id) FROM p) THEN 50 ELSE 0 END::BIGINT AS expected, n_nulls <= CASE WHEN unique_id = (SELECT min(unique_id) FROM p) THEN 50 ELSE 0 END AS ok FROM f")
def missing_rule(spark, d):
    p = src.sales_panel(spark, d).withColumn("y", F.when(F.month("ds") != 7, F.col("y")))
    return Q.missing_rule(p, p.agg(F.min("unique_id").alias("unique_id")).withColumn("expected", F.lit(50)), "unique_id", "y")


@query("wide_features", f"WITH {SALES}, i AS (SELECT min(unique_id) AS a FROM p), x AS (SELECT unique_id, ds, y, lag(y, 12) OVER w AS l12, avg(y) OVER (PARTITION BY unique_id ORDER BY ds ROWS 5 PRECEDING) AS m6, y / nullif(lag(y) OVER w, 0) - 1 AS p1 FROM p WINDOW w AS (PARTITION BY unique_id ORDER BY ds)), z AS (SELECT x.*, CASE WHEN count(p1) OVER v >= 2 THEN stddev_samp(p1) OVER v END AS v3 FROM x WINDOW v AS (PARTITION BY unique_id ORDER BY ds ROWS 2 PRECEDING)) SELECT ds, {r('y', 'value', 4)}, {r('l12', 'lag_12', 4)}, {r('m6', 'ma_6', 4)}, {r('p1', 'pct_1')}, {r('v3', 'vol_3')} FROM z, i WHERE unique_id = a")
def wide_features(spark, d):
    p = src.sales_panel(spark, d)
    first = p.agg(F.min("unique_id")).first()[0]
    wide = X.wide_features(p, [first], "unique_id", "ds", "y")
    pick = lambda c: F.col(f"`{first}_{c}`").alias(c)
    out = wide.select("ds", *map(pick, ("value", "lag_12", "ma_6", "pct_1", "vol_3")))
    return out.withColumns({c: F.round(c, 4) for c in ("value", "lag_12", "ma_6")})


_SEASONS = ", ".join(f"((lower(c) LIKE '%{w}%') AND month(ds) IN ({', '.join(map(str, months))}))::INT AS {flag}" for w, family in (("tech", "electronics"), ("fashion", "clothing"), ("garden", "home"), ("automobile", "auto"), ("restaurant", "food")) for flag, months in CATEGORY_SEASONS[family].items())


@query("category_seasons", f"WITH {SALES} SELECT c, ds, {_SEASONS} FROM (SELECT DISTINCT ds FROM p), (VALUES ('Tech Shops'), ('FASHION'), ('Garden Centres'), ('Automobile Dealers'), ('Restaurants'), ('Other')) v(c)")
def category_flags(spark, d):
    days = src.sales_panel(spark, d).select("ds").distinct()
    names = F.explode(F.array(*map(F.lit, ["Tech Shops", "FASHION", "Garden Centres", "Automobile Dealers", "Restaurants", "Other"])))
    rows = days.select("ds", names.alias("c"))
    return rows.select("c", "ds", *[v.alias(k) for k, v in category_seasons(F.col("c"), F.col("ds")).items()])


@query(
    "holiday_counts",
    """WITH e AS (SELECT DISTINCT o_orderdate::DATE AS ds FROM orders) SELECT ds, (month(ds) = 1 AND day(ds) = 1)::INT AS is_new_year, (month(ds) = 7 AND day(ds) = 4)::INT AS is_independence_day, (month(ds) = 12 AND day(ds) = 25)::INT AS is_christmas,
    (month(ds) = 5 AND isodow(ds) = 1 AND month(ds + 7) = 6)::INT AS is_memorial_day, (month(ds) = 9 AND isodow(ds) = 1 AND day(ds) <= 7)::INT AS is_labor_day, (month(ds) = 11 AND isodow(ds) = 4 AND day(ds) BETWEEN 22 AND 28)::INT AS is_thanksgiving, (month(ds) = 11 AND isodow(ds) = 5 AND day(ds - 1) BETWEEN 22 AND 28)::INT AS is_black_friday,
    (ds IN (DATE '1995-04-16', DATE '1996-04-07', DATE '1997-03-30', DATE '1998-04-12', DATE '1999-04-04', DATE '2000-04-23', DATE '2001-04-15', DATE '2002-03-31'))::INT AS is_easter FROM e""",
)
def holiday_counts(spark, d):
    days = src.table(spark, d, "orders").select(F.to_date("o_orderdate").alias("ds")).distinct()
    return days.withColumns(holidays(F.col("ds")))


@query("recession_flag", "WITH m AS (SELECT last_day(o_orderdate) AS ds, round(avg(o_totalprice) / 1000, 4) AS value FROM orders GROUP BY 1), a AS (SELECT *, avg(value) OVER (ORDER BY ds ROWS 2 PRECEDING) AS m3 FROM m) SELECT ds, " + r("value", "value", 4) + ", coalesce(m3 - min(m3) OVER (ORDER BY ds ROWS BETWEEN 12 PRECEDING AND 1 PRECEDING) >= 0.5, false)::INT AS flag FROM a")
def recession_flag(spark, d):
    m = src.table(spark, d, "orders").groupBy(F.last_day("o_orderdate").alias("ds")).agg(F.round(F.avg("o_totalprice") / 1000, 4).alias("value"))
    return Q.recession(m).withColumn("value", F.round("value", 4))


@query("macro_payload", "WITH m AS (SELECT last_day(o_orderdate) AS ds, o_orderpriority AS series_id, round(avg(o_totalprice), 2) AS value FROM orders GROUP BY 1, 2) SELECT ds, series_id, " + r("value", "value", 2) + " FROM m WHERE month(ds) <> 2")
def macro_payload(spark, d):
    m = src.table(spark, d, "orders").groupBy(F.last_day("o_orderdate").alias("ds"), F.col("o_orderpriority").alias("s")).agg(F.round(F.avg("o_totalprice"), 2).alias("v"))
    text = F.when(F.month("ds") == 2, ".").otherwise(F.col("v").cast("decimal(18,2)").cast("string"))
    obs = F.struct(F.date_format("ds", "yyyy-MM-01").alias("date"), text.alias("value"))
    payloads = m.groupBy("s").agg(F.to_json(F.struct(F.collect_list(obs).alias("observations"))).alias("payload"))
    key = F.concat(F.lit(providers.MACRO_URL + "?series_id="), "s", F.lit("&file_type=json"))
    return providers.macro_rows(payloads.select(key.alias("key"), "payload"))


@query("tree_forecast_months", f"WITH {SALES} SELECT unique_id, step::INT AS step, last_day(max(ds) + INTERVAL 1 MONTH * step)::DATE AS ds FROM p, range(1, 13) s(step) GROUP BY unique_id, step")
def tree_forecast_months(spark, d):
    """Series and months of the direct tree forecast; its values are held against last year's months in the tests."""
    return L.tree_forecast(src.sales_panel(spark, d), L.forest()).select("unique_id", "step", "ds")


@query("tree_forecast")
def tree_forecast(spark, d):
    return L.tree_forecast(src.sales_panel(spark, d), L.forest())


@query("in_sample_padding", f"WITH {SALES}, n AS (SELECT *, row_number() OVER (PARTITION BY unique_id ORDER BY ds) AS rn FROM p) SELECT unique_id, ds, rn <= 24 AS padded, {r('CASE WHEN rn <= 24 THEN y END', 'yhat', 4)} FROM n")
def in_sample_padding(spark, d):
    fit = L.in_sample(src.sales_panel(spark, d), L.forest())
    return fit.select("unique_id", "ds", "padded", F.round(F.when(F.col("padded"), F.col("yhat")), 4).alias("yhat"))


@query("model_times", "SELECT * FROM (VALUES ('ets', 30::BIGINT, true), ('ar', 30::BIGINT, true)) v(model, n_fits, timed)")
def model_times(spark, d):
    return L.model_times(src.sales_panel(spark, d)).select("model", "n_fits", (F.col("seconds") >= 0).alias("timed"))


@query(
    "stationarity_regression",
    f"""WITH {SALES}, l AS (SELECT unique_id, y - lag(y) OVER w AS dy, lag(y) OVER w AS x FROM p WINDOW w AS (PARTITION BY unique_id ORDER BY ds)),
    g AS (SELECT unique_id, regr_slope(dy, x) AS b, regr_sxx(dy, x) AS sxx, regr_syy(dy, x) AS syy, regr_sxy(dy, x) AS sxy, count(*) AS n FROM l WHERE x IS NOT NULL GROUP BY 1)
    SELECT unique_id, {r('b / sqrt((syy - sxy * sxy / sxx) / (n - 2) / sxx)', 'statistic', 4)} FROM g""",
)
def stationarity_regression(spark, d):
    """The Dickey-Fuller t of stationarity() to four digits."""
    return L.stationarity(src.sales_panel(spark, d)).withColumn("statistic", F.round("statistic", 4))
