"""Queries that join and reshape."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import features as X
from ..operators import reshape as H
from ..operators import windows as V
from ..sources import catalog as C
from ..sources import payload as P
from ..sources import series as src
from .base import MACRO, SALES, SEGMENTS, TOTAL, W, query, r

_PRIORITIES = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]
_SEG = ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"]
_MX = "x AS (SELECT ds, " + ", ".join(f"max(value) FILTER (series_id = '{p}') AS \"{p}\"" for p in _PRIORITIES) + " FROM m GROUP BY ds)"


def _macro_wide(spark, d):
    return H.wide(src.macro_long(spark, d), "series_id", "value", _PRIORITIES)


@query("macro_wide_pivot", f"WITH {MACRO}, {_MX} SELECT ds, " + ", ".join(r(f'"{p}"', f'"{p}"') for p in _PRIORITIES) + " FROM x")
def macro_wide_pivot(spark, d):
    return _macro_wide(spark, d)


@query("left_join_exog", f"WITH {SALES}, {MACRO}, {_MX} SELECT unique_id, ds, {r('y', 'y')}, " + r('"1-URGENT"', "urgent") + ", " + r('"5-LOW"', "low") + " FROM p LEFT JOIN x USING (ds)")
def left_join_exog(spark, d):
    wide = _macro_wide(spark, d).select("ds", F.col("`1-URGENT`").alias("urgent"), F.col("`5-LOW`").alias("low"))
    return src.sales_panel(spark, d).join(wide, "ds", "left").select("unique_id", "ds", "y", "urgent", "low")


@query(
    "full_outer_series",
    f"WITH {SEGMENTS}, a AS (SELECT ds, value AS a FROM g WHERE series_id = 'AUTOMOBILE' AND month(ds) <> 3), b AS (SELECT ds, value AS b FROM g WHERE series_id = 'BUILDING' AND month(ds) <> 5), c AS (SELECT ds, value AS c FROM g WHERE series_id = 'FURNITURE' AND month(ds) <> 7) "
    f"SELECT ds, {r('a', 'a')}, {r('b', 'b')}, {r('c', 'c')} FROM a FULL JOIN b USING (ds) FULL JOIN c USING (ds)",
)
def full_outer_series(spark, d):
    g = src.macro_long(spark, d, "c_mktsegment")
    part = lambda s, m, n: g.where((F.col("series_id") == s) & (F.month("ds") != m)).select("ds", F.col("value").alias(n))
    return H.outer_all([part("AUTOMOBILE", 3, "a"), part("BUILDING", 5, "b"), part("FURNITURE", 7, "c")], ["ds"])


_SPIKES = "k AS (SELECT ds FROM (SELECT ds, value / nullif(lag(value) OVER (PARTITION BY series_id ORDER BY ds), 0) - 1 AS c FROM m WHERE series_id = '1-URGENT') WHERE c > 0.05)"


@query("interval_flag", f"WITH {SALES}, {MACRO}, {_SPIKES} SELECT unique_id, ds, EXISTS (SELECT 1 FROM k WHERE p.ds BETWEEN k.ds - 90 AND k.ds + 180) AS in_window FROM p")
def interval_flag(spark, d):
    m = src.macro_long(spark, d).where("series_id = '1-URGENT'")
    spikes = m.withColumn("c", V.pct_change(F.col("value"), 1, V.over_time("series_id"))).where("c > 0.05").select(F.col("ds").alias("spike"))
    return H.in_intervals(src.sales_panel(spark, d), "ds", spikes, "spike", 90, 180, "in_window").drop("y")


@query(
    "asof_align",
    "WITH e AS (SELECT event_id, user_id % 20 AS k, ts FROM events), q AS (SELECT user_id % 20 AS k, date_trunc('hour', ts) AS ts, max(value) AS v FROM events WHERE event_id % 10 = 0 GROUP BY 1, 2) "
    f"SELECT event_id, e.k, e.ts, {r('q.v', 'v')} FROM e ASOF LEFT JOIN q ON e.k = q.k AND e.ts >= q.ts",
)
def asof_align(spark, d):
    events = src.table(spark, d, "events")
    left = events.select("event_id", (F.col("user_id") % 20).alias("k"), "ts")
    right = events.where("event_id % 10 = 0").groupBy((F.col("user_id") % 20).alias("k"), F.date_trunc("hour", "ts").alias("ts")).agg(F.max("value").alias("v"))
    return H.as_of(left, right.withColumn("ts", F.col("ts").cast(left.schema["ts"].dataType)), "ts", ["k"], ["v"])


@query("asof_align_all")
def asof_align_all(spark, d):
    """Every event with the last hourly maximum of its own user; no SQL, compared with plain code in the tests."""
    events = src.table(spark, d, "events")
    left = events.select("event_id", F.col("user_id").alias("k"), "ts")
    right = events.groupBy(F.col("user_id").alias("k"), F.date_trunc("hour", "ts").alias("ts")).agg(F.max("value").alias("v"))
    return H.as_of(left, right.withColumn("ts", F.col("ts").cast(left.schema["ts"].dataType)), "ts", ["k"], ["v"])


@query("seasonal_self_join", f"WITH {SALES} SELECT a.unique_id, a.ds, {r('a.y', 'y')}, {r('b.y', 'y_year_before')} FROM p a JOIN p b ON a.unique_id = b.unique_id AND b.ds = last_day(a.ds - INTERVAL 12 MONTH)")
def seasonal_self_join(spark, d):
    p = src.sales_panel(spark, d)
    before = p.select("unique_id", F.last_day(F.add_months("ds", 12)).alias("ds"), F.col("y").alias("y_year_before"))
    return p.join(before, ["unique_id", "ds"])


@query("unpivot_features", f"WITH {SALES}, l AS (SELECT unique_id, ds, lag(y, 1) OVER w AS lag_1, avg(y) OVER (PARTITION BY unique_id ORDER BY ds ROWS 2 PRECEDING) AS ma_3 FROM p {W}), u AS (UNPIVOT l ON lag_1, ma_3 INTO NAME feature_name VALUE feature_value) SELECT unique_id, ds, feature_name, {r('feature_value', 'feature_value')}, CASE WHEN feature_name LIKE 'lag_%' THEN 'lag' ELSE 'moving_avg' END AS feature_type FROM u")
def unpivot_features(spark, d):
    wide = X.store_profile(src.sales_panel(spark, d)).select("unique_id", "ds", "lag_1", "ma_3")
    return H.long(wide, ["unique_id", "ds"], ["lag_1", "ma_3"]).withColumn("feature_type", S.feature_kind(F.col("feature_name")))


@query("feature_type_case", "SELECT * FROM (VALUES ('lag_12', 'lag'), ('ma_3', 'moving_avg'), ('yoy_change', 'pct_change'), ('mom_change', 'pct_change'), ('seasonal_component', 'seasonal'), ('trend', 'trend'), ('cpi', 'other')) v(name, kind)")
def feature_type_case(spark, d):
    names = spark.createDataFrame([(n,) for n in ("lag_12", "ma_3", "yoy_change", "mom_change", "seasonal_component", "trend", "cpi")], "name string")
    return names.withColumn("kind", S.feature_kind(F.col("name")))


@query("row_null_filter", "WITH a AS (SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN o_totalprice END AS a, CASE WHEN o_orderkey % 3 = 0 THEN o_totalprice END AS b, CASE WHEN o_orderkey % 5 = 0 THEN o_totalprice END AS c FROM orders) SELECT o_orderkey FROM a WHERE ((a IS NULL)::INT + (b IS NULL)::INT + (c IS NULL)::INT) / 4 <= 0.5")
def row_null_filter(spark, d):
    o, pick = src.table(spark, d, "orders"), lambda k: F.when(F.col("o_orderkey") % k == 0, F.col("o_totalprice"))
    return H.dense_rows(o.select("o_orderkey", pick(2).alias("a"), pick(3).alias("b"), pick(5).alias("c")), 0.5).select("o_orderkey")


@query("dedup_first", f"SELECT user_id, event_id, {r('value', 'value')} FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) = 1")
def dedup_first(spark, d):
    return H.first_by(src.table(spark, d, "events"), ["user_id"], F.col("ts"), F.col("event_id")).select("user_id", "event_id", "value")


_MW = [w / sum(P.MONTH_WEIGHTS) for w in P.MONTH_WEIGHTS]
_WEIGHTS = "w AS (SELECT * FROM (VALUES " + ", ".join(f"({i + 1}, {w!r})" for i, w in enumerate(_MW)) + ") v(k, f))"


@query("annual_to_monthly", f"WITH {SALES}, a AS (SELECT unique_id, year(ds)::INT AS year, round(sum(y), 4) AS value FROM p GROUP BY 1, 2), {_WEIGHTS} SELECT unique_id, year, last_day(make_date(year, k, 1)) AS ds, {r('value * f', 'value', 4)} FROM a, w")
def annual_to_monthly(spark, d):
    a = src.sales_panel(spark, d).groupBy("unique_id", F.year("ds").alias("year")).agg(F.round(F.sum("y"), 4).alias("value"))
    return P.spread_over_months(a).withColumn("value", F.round("value", 4))


@query(
    "json_payload_parse",
    f"""WITH {TOTAL}, c AS (SELECT year(ds)::INT AS year, month(ds) AS mo, CASE WHEN month(ds) = 2 THEN NULL WHEN month(ds) = 3 THEN NULL ELSE round(y, 2) END AS value FROM t)
    SELECT last_day(make_date(year, mo::INT, 1)) AS ds, '44X72' AS category_code, {r('value', 'value', 2)} FROM c WHERE value IS NOT NULL""",
)
def json_payload_parse(spark, d):
    t = src.total_panel(spark, d).withColumn("month", F.month("ds"))
    cell = F.when(F.col("month") == 2, "M").when(F.col("month") == 3, "0").otherwise(F.round("y", 2).cast("decimal(20,2)").cast("string"))
    row = F.array(F.lit("SM"), F.format_string("M%02d", "month"), F.lit("yes"), F.lit("44X72"), cell)
    head = F.array(*[F.lit(c) for c in ("data_type_code", "time_slot_id", "seasonally_adj", "category_code", "cell_value")])
    payloads = t.groupBy(F.year("ds").alias("year")).agg(F.to_json(F.concat(F.array(head), F.collect_list(row))).alias("payload"))
    return P.monthly_observations(P.parse(payloads, keep=["year"]))


@query("annual_record_max", "SELECT year(o_orderdate)::INT AS year, o_orderpriority AS category_code, " + r("max(o_totalprice)", "value", 2) + " FROM orders GROUP BY 1, 2")
def annual_record_max(spark, d):
    o = src.table(spark, d, "orders").select(F.year("o_orderdate").alias("year"), F.lit("0").alias("slot"), F.col("o_orderpriority").alias("code"), F.col("o_totalprice").cast("string").alias("cell"))
    return P.annual_records(o.select("year", F.create_map(F.lit("time_slot_id"), "slot", F.lit("category_code"), "code", F.lit("cell_value"), "cell").alias("cells"))).withColumn("value", F.round("value", 2))


@query("column_names", "SELECT DISTINCT p_type AS label, regexp_replace(replace(replace(lower(p_type), '&', 'and'), ' ', '_'), '[^a-z0-9_]', '', 'g') AS name FROM part")
def column_names(spark, d):
    return src.table(spark, d, "part").select(F.col("p_type").alias("label")).distinct().withColumn("name", S.column_name(F.col("label")))


@query("event_props", "SELECT event_type, sum((props->>'k')::BIGINT)::BIGINT AS total, count(props->>'k') AS n FROM events GROUP BY 1")
def event_props(spark, d):
    e = src.table(spark, d, "events").withColumn("p", F.from_json("props", "k bigint"))
    return e.groupBy("event_type").agg(F.sum("p.k").alias("total"), F.count("p.k").alias("n"))


@query("series_catalog", "SELECT * FROM (VALUES ('RSGASS', 'Gasoline Stations'), ('RSNSR', 'Nonstore Retailers')) v(series_id, name)")
def series_catalog(spark, d):
    c = C.catalog(spark)
    return c.where(C.like_name(F.col("name"), "NONSTORE_retailers") | F.lower("name").contains("gasoline")).select("series_id", "name")


@query("union_by_name", f"WITH {MACRO}, {SEGMENTS} SELECT ds, series_id, {r('value', 'value')}, 'priority' AS source FROM m UNION ALL SELECT ds, series_id, {r('value', 'value')}, NULL FROM g")
def union_by_name(spark, d):
    return src.combine([src.macro_long(spark, d).withColumn("source", F.lit("priority")), src.macro_long(spark, d, "c_mktsegment")])


@query(
    "economic_derived",
    f"""WITH {SALES}, {MACRO}, {_MX}, j AS (SELECT unique_id, ds, y, "1-URGENT" AS pr, "2-HIGH" / 1e6 AS ra, "3-MEDIUM" / 1e5 AS mo, "5-LOW" / 1e5 AS un FROM p JOIN x USING (ds))
    SELECT unique_id, ds, {r('y / nullif(pr / 100, 0)', 'real_sales')}, {r('ra - coalesce(pr / nullif(lag(pr) OVER w, 0) - 1, 0)', 'rate_pressure')}, {r('mo / nullif(1 + un, 0)', 'consumer_health')},
    {r('ra * (month(ds) = 12)::INT', 'rate_x_december')}, {r('un * (month(ds) IN (6, 7, 8))::INT', 'unemployment_x_summer')} FROM j {W}""",
)
def economic_derived(spark, d):
    x = _macro_wide(spark, d).select("ds", F.col("`1-URGENT`").alias("pr"), (F.col("`2-HIGH`") / 1e6).alias("ra"), (F.col("`3-MEDIUM`") / 1e5).alias("mo"), (F.col("`5-LOW`") / 1e5).alias("un"))
    j = src.sales_panel(spark, d).join(x, "ds")
    out = X.economic(j, F.col("y"), F.col("pr"), F.col("ra"), F.col("mo"), F.col("un"))
    return out.select("unique_id", "ds", "real_sales", "rate_pressure", "consumer_health", "rate_x_december", "unemployment_x_summer")


@query(
    "exogenous_profile",
    f"""WITH {SALES}, {MACRO}, {_MX}, j AS (SELECT unique_id, ds, "1-URGENT" AS pr FROM p JOIN x USING (ds)) SELECT unique_id, ds, {r('pr / nullif(lag(pr) OVER w, 0) - 1', 'pr_pct_change')}, {r('lag(pr, 6) OVER w', 'pr_lag_6')},
    {r('avg(pr) OVER (PARTITION BY unique_id ORDER BY ds ROWS 11 PRECEDING)', 'pr_ma_12')}, {r('stddev_samp(pr) OVER (PARTITION BY unique_id ORDER BY ds ROWS 2 PRECEDING)', 'pr_std_3')} FROM j {W}""",
)
def exogenous_profile(spark, d):
    x = _macro_wide(spark, d).select("ds", F.col("`1-URGENT`").alias("pr"))
    return X.exogenous_profile(src.sales_panel(spark, d).join(x, "ds"), ["pr"]).select("unique_id", "ds", "pr_pct_change", "pr_lag_6", "pr_ma_12", "pr_std_3")


@query("full_join_aligned", f"WITH {TOTAL} SELECT {r('y', 'y')}, {r('0.0::DOUBLE', 'missing')}, month(ds)::INT AS month FROM t")
def full_join_aligned(spark, d):
    return H.align(src.total_panel(spark, d).withColumn("month", F.month("ds")), ["y", "missing", "month"])
