"""Queries shaped like the feature store: upserts, marks, newest rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import quality as Q
from ..operators import store as K
from ..sources import series as src
from ..sources import synthetic
from .base import SALES, query, r


def _old_new(spark, d):
    p = src.sales_panel(spark, d)
    new = p.where(F.year("ds") >= 2000).withColumn("y", F.round(F.col("y") * 2, 4))
    return p.where(F.year("ds") <= 2000), new


_OLD = "o AS (SELECT * FROM p WHERE year(ds) <= 2000), nw AS (SELECT unique_id, ds, y * 2 AS y FROM p WHERE year(ds) >= 2000)"


@query("upsert_timeseries", f"WITH {SALES}, {_OLD} SELECT unique_id, ds, {r('y', 'y', 4)} FROM o ANTI JOIN nw USING (unique_id, ds) UNION ALL SELECT unique_id, ds, {r('y', 'y', 4)} FROM nw")
def upsert_timeseries(spark, d):
    return K.upserted(*_old_new(spark, d), ["unique_id", "ds"])


@query("insert_ignore", f"WITH {SALES}, {_OLD} SELECT unique_id, ds, {r('y', 'y', 4)} FROM o UNION ALL SELECT unique_id, ds, {r('y', 'y', 4)} FROM nw ANTI JOIN o USING (unique_id, ds)")
def insert_ignore(spark, d):
    return K.ignored(*_old_new(spark, d), ["unique_id", "ds"])


@query("latest_by_key", f"SELECT user_id, arg_max(event_type, (ts, event_id)) AS event_type, max(ts) AS ts FROM events GROUP BY 1")
def latest_by_key(spark, d):
    e = src.table(spark, d, "events").select("user_id", "event_id", "event_type", "ts").withColumn("at", F.struct("ts", "event_id"))
    return K.latest(e.drop("ts", "event_id"), ["user_id"], "at").select("user_id", "event_type", "at.ts")


@query("high_water_mark", f"WITH {SALES}, m1 AS (SELECT unique_id, max(ds) AS mark FROM p WHERE year(ds) <= 2000 GROUP BY 1) SELECT unique_id, count(*) AS n_new, min(ds) AS first_new FROM p JOIN m1 USING (unique_id) WHERE ds > mark GROUP BY 1")
def high_water_mark(spark, d):
    p = src.sales_panel(spark, d)
    fresh = K.newer(p, K.high_water(p.where(F.year("ds") <= 2000), ["unique_id"]), ["unique_id"])
    return fresh.groupBy("unique_id").agg(F.count(F.lit(1)).alias("n_new"), F.min("ds").alias("first_new"))


@query("topn_recent", f"SELECT o_orderkey, o_orderdate, {r('o_totalprice', 'o_totalprice', 2)} FROM orders ORDER BY o_orderdate DESC, o_orderkey LIMIT 25")
def topn_recent(spark, d):
    return K.newest(src.table(spark, d, "orders").select("o_orderkey", "o_orderdate", "o_totalprice"), 25, "o_orderdate", "o_orderkey").withColumn("o_totalprice", F.round("o_totalprice", 2))


@query("date_range_filter", f"WITH {SALES} SELECT unique_id, ds, {r('y', 'y', 4)} FROM p WHERE ds BETWEEN DATE '1998-01-31' AND DATE '1999-06-30'")
def date_range_filter(spark, d):
    return src.between(src.sales_panel(spark, d), "1998-01-31", "1999-06-30")


@query("store_stats", "SELECT 'orders' AS table_name, count(*) AS n_rows, min(o_orderdate)::DATE AS first_day, max(o_orderdate)::DATE AS last_day FROM orders UNION ALL SELECT 'events', count(*), min(ts)::DATE, max(ts)::DATE FROM events UNION ALL SELECT 'part', count(*), NULL, NULL FROM part")
def store_stats(spark, d):
    t = lambda n: src.table(spark, d, n)
    return K.stats({"orders": (t("orders"), "o_orderdate"), "events": (t("events"), "ts"), "part": (t("part"), None)})


@query("forecast_kind", "SELECT event_id, CASE WHEN event_id % 3 = 0 THEN 'backtest' WHEN event_id % 2 = 0 THEN 'forecast' ELSE 'prediction' END AS kind FROM events")
def forecast_kind(spark, d):
    e = src.table(spark, d, "events")
    kind = K.forecast_kind(F.when(F.col("event_id") % 3 == 0, F.col("ts")), F.when(F.col("event_id") % 2 == 0, F.lit(12)))
    return e.select("event_id", kind.alias("kind"))


@query("null_ratio_rule", f"WITH {SALES}, q AS (SELECT unique_id, CASE WHEN month(ds) <> 7 THEN y END AS y FROM p) SELECT unique_id, {r('avg((y IS NULL)::INT)', 'null_ratio')}, avg((y IS NULL)::INT) <= 0.05 AS ok FROM q GROUP BY 1")
def null_ratio_rule(spark, d):
    return Q.null_rule(src.sales_panel(spark, d).withColumn("y", F.when(F.month("ds") != 7, F.col("y"))))


@query("version_hash")
def version_hash(spark, d):
    return Q.version_hash(src.sales_panel(spark, d))


@query("synthetic_series", "WITH b AS (SELECT * FROM (VALUES ('electronics', 8000.0, 200.0, 1.8), ('total', 450000.0, 10000.0, 1.4), ('nonstore', 65000.0, 8000.0, 1.6), ('misc', 25000.0, 1000.0, 1.2), ('other', 15000.0, 500.0, 1.3)) v(unique_id, base, slope, peak)), m AS (SELECT unnest(generate_series(DATE '2015-01-01', DATE '2017-12-01', INTERVAL 1 MONTH))::DATE AS m) SELECT unique_id, last_day(m) AS ds, " + r("((base + slope * (year(m) - 2015)) * CASE WHEN month(m) >= 11 THEN peak WHEN unique_id = 'electronics' AND month(m) IN (8, 9) THEN 1.3 WHEN unique_id = 'electronics' AND month(m) IN (6, 7) THEN 0.9 ELSE 1 END)::DOUBLE", "y", 4) + ", true AS is_synthetic FROM b, m")
def synthetic_series(spark, d):
    return synthetic.monthly(spark, 2015, 2017, noise=0.0).withColumn("y", F.round("y", 4))
