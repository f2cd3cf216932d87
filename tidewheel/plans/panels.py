"""Queries over monthly panels: windows, calendar, quality."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import features as X
from ..operators import quality as Q
from ..operators import reshape as H
from ..operators import windows as V
from ..sources import series as src
from .base import MACRO, SALES, SEGMENTS, TOTAL, W, frame, query, r



def _panel(spark: SparkSession, d: str) -> DataFrame:
    return src.sales_panel(spark, d)


@query(
    "panel_monthly",
    f"""WITH {SALES} SELECT unique_id, ds, {r('y', 'y', 4)}, {r('lag(y, 1) OVER w', 'lag_1')}, {r('lag(y, 12) OVER w', 'lag_12')}, {r('avg(y) ' + frame(3), 'ma_3')},
    {r('avg(y) ' + frame(12), 'ma_12')}, {r('y / nullif(lag(y, 12) OVER w, 0) - 1', 'yoy')} FROM p {W}""",
)
def panel_monthly(spark, d):
    out = _panel(spark, d).withColumns({"lag_1": V.lag(F.col("y"), 1, V.over_time()), "lag_12": V.lag(F.col("y"), 12, V.over_time()), "ma_3": V.rolling(F.avg, F.col("y"), 3, V.over_time(), 1), "ma_12": V.rolling(F.avg, F.col("y"), 12, V.over_time(), 1), "yoy": V.pct_change(F.col("y"), 12, V.over_time())})
    return out


query("panel_total", f"WITH {TOTAL} SELECT unique_id, ds, {r('y', 'y', 4)} FROM t")(src.total_panel)
query("macro_long", f"WITH {MACRO} SELECT ds, series_id, {r('value', 'value', 4)} FROM m")(src.macro_long)


@query("lag_features", f"WITH {SALES} SELECT unique_id, ds, {', '.join(r(f'lag(y, {n}) OVER w', f'lag_{n}') for n in (1, 2, 3, 4, 6, 8, 12, 24))} FROM p {W}")
def lag_features(spark, d):
    return X.lags(_panel(spark, d), [1, 2, 3, 4, 6, 8, 12, 24]).drop("y")


@query(
    "diff_pct_change",
    f"WITH {SALES} SELECT unique_id, ds, {', '.join(r(f'y - lag(y, {n}) OVER w', f'diff_{n}') for n in (1, 12))}, {', '.join(r(f'y / nullif(lag(y, {n}) OVER w, 0) - 1', f'pct_{n}') for n in (1, 3, 6, 12))} FROM p {W}",
)
def diff_pct_change(spark, d):
    return _panel(spark, d).select("unique_id", "ds", *[V.diff(F.col("y"), n, V.over_time()).alias(f"diff_{n}") for n in (1, 12)], *[V.pct_change(F.col("y"), n, V.over_time()).alias(f"pct_{n}") for n in (1, 3, 6, 12)])


@query("log_changes", f"WITH {SALES} SELECT unique_id, ds, {', '.join(r(f'ln(y) - lag(ln(y), {n}) OVER w', f'log_{n}') for n in (1, 12))} FROM p {W}")
def log_changes(spark, d):
    return _panel(spark, d).select("unique_id", "ds", *[V.log_change(F.col("y"), n, V.over_time()).alias(f"log_{n}") for n in (1, 12)])


@query("rolling_mean_mp1", f"WITH {SALES} SELECT unique_id, ds, {', '.join(r('avg(y) ' + frame(n), f'ma_{n}') for n in (3, 6, 12))} FROM p")
def rolling_mean_mp1(spark, d):
    return _panel(spark, d).select("unique_id", "ds", *[V.rolling(F.avg, F.col("y"), n, V.over_time(), 1).alias(f"ma_{n}") for n in (3, 6, 12)])


def _full(n: int, agg: str) -> str:
    return f"CASE WHEN count(y) {frame(n)} >= {n} THEN {agg}(y) {frame(n)} END"


@query("rolling_mean_full", f"WITH {SALES} SELECT unique_id, ds, {', '.join(r(_full(n, 'avg'), f'ma_{n}') for n in (3, 4, 6, 8, 12))} FROM p")
def rolling_mean_full(spark, d):
    return _panel(spark, d).select("unique_id", "ds", *[V.rolling(F.avg, F.col("y"), n, V.over_time()).alias(f"ma_{n}") for n in (3, 4, 6, 8, 12)])


@query(
    "rolling_mean_half",
    f"WITH {SALES} SELECT unique_id, ds, " + ", ".join(r(f"CASE WHEN count(y) {frame(n)} >= {n // 2} THEN avg(y) {frame(n)} END", f"ma_{n}") for n in (12, 24)) + " FROM p",
)
def rolling_mean_half(spark, d):
    return _panel(spark, d).select("unique_id", "ds", *[V.rolling(F.avg, F.col("y"), n, V.over_time(), n // 2).alias(f"ma_{n}") for n in (12, 24)])


@query(
    "rolling_std_volatility",
    f"""WITH {SALES}, c AS (SELECT *, y / nullif(lag(y) OVER w, 0) - 1 AS pc FROM p {W})
    SELECT unique_id, ds, {', '.join(r('stddev_samp(y) ' + frame(n), f'std_{n}') for n in (3, 6, 12))}, {', '.join(r('stddev_samp(pc) ' + frame(n), f'vol_{n}') for n in (3, 12))} FROM c""",
)
def rolling_std_volatility(spark, d):
    out = _panel(spark, d).withColumn("pc", V.pct_change(F.col("y"), 1, V.over_time()))
    return out.select("unique_id", "ds", *[V.rolling(F.stddev_samp, F.col("y"), n, V.over_time(), 1).alias(f"std_{n}") for n in (3, 6, 12)], *[V.rolling(F.stddev_samp, F.col("pc"), n, V.over_time(), 1).alias(f"vol_{n}") for n in (3, 12)])


@query("rolling_min_max", f"WITH {SALES} SELECT unique_id, ds, {', '.join(r(f'{a}(y) ' + frame(n), f'{a}_{n}') for n in (3, 6, 12) for a in ('min', 'max'))} FROM p")
def rolling_min_max(spark, d):
    return _panel(spark, d).select("unique_id", "ds", *[V.rolling(f, F.col("y"), n, V.over_time(), 1).alias(f"{a}_{n}") for n in (3, 6, 12) for a, f in (("min", F.min), ("max", F.max))])


@query(
    "rolling_zscore",
    f"WITH {SALES} SELECT unique_id, ds, " + ", ".join(r(f"CASE WHEN count(y) {frame(n)} >= {n // 2} THEN (y - avg(y) {frame(n)}) / nullif(stddev_samp(y) {frame(n)}, 0) END", f"z_{n}") for n in (12, 24)) + " FROM p",
)
def rolling_zscore(spark, d):
    return _panel(spark, d).select("unique_id", "ds", *[V.zscore(F.col("y"), n, V.over_time()).alias(f"z_{n}") for n in (12, 24)])


def _rank(n: int) -> str:
    f = f"list(y) {frame(n)}"
    return f"CASE WHEN len(l{n}) >= {n // 2} THEN (len(list_filter(l{n}, lambda v: v < y)) + (len(list_filter(l{n}, lambda v: v = y)) + 1) / 2.0) / len(l{n}) END", f"{f} AS l{n}"


@query(
    "rolling_pct_rank",
    f"WITH {SALES}, l AS (SELECT *, {', '.join(_rank(n)[1] for n in (12, 24, 60))} FROM p) SELECT unique_id, ds, {', '.join(r(_rank(n)[0], f'rank_{n}') for n in (12, 24, 60))} FROM l",
)
def rolling_pct_rank(spark, d):
    return _panel(spark, d).select("unique_id", "ds", *[V.rolling_rank(F.col("y"), n, V.over_time()).alias(f"rank_{n}") for n in (12, 24, 60)])


@query(
    "global_pct_rank",
    f"WITH {MACRO} SELECT series_id, ds, " + r("(rank() OVER (PARTITION BY series_id ORDER BY value) + (count(*) OVER (PARTITION BY series_id, value) - 1) / 2.0) / count(*) OVER (PARTITION BY series_id)", "pct_rank") + " FROM m",
)
def global_pct_rank(spark, d):
    return src.macro_long(spark, d).select("series_id", "ds", V.total_rank(F.col("value"), ["series_id"]).alias("pct_rank"))


@query(
    "retail_profile",
    f"""WITH {SALES}, c AS (SELECT *, y / nullif(lag(y) OVER w, 0) - 1 AS pc, avg(y) {frame(3)} AS m3, avg(y) {frame(12)} AS m12 FROM p {W})
    SELECT unique_id, ds, {r('pc', 'pct_change')}, {r('m3', 'rolling_mean_3m')}, {r('(m3 - m12) / nullif(m12, 0)', 'trend_3m_vs_12m')}, {r('pc - lag(pc) OVER w', 'acceleration_1m')},
    CASE WHEN pc <= -0.1 THEN 'Strong Decline' WHEN pc <= -0.05 THEN 'Decline' WHEN pc <= 0.05 THEN 'Stable' WHEN pc <= 0.1 THEN 'Growth' WHEN pc > 0.1 THEN 'Strong Growth' END AS growth_rate FROM c {W}""",
)
def retail_profile(spark, d):
    return X.retail_profile(_panel(spark, d)).select("unique_id", "ds", "pct_change", "rolling_mean_3m", "trend_3m_vs_12m", "acceleration_1m", "growth_rate")


@query(
    "macro_profile",
    f"""WITH {MACRO}, c AS (SELECT *, value / nullif(lag(value) OVER w, 0) - 1 AS ch, value / nullif(lag(value, 12) OVER w, 0) - 1 AS yoy FROM m WINDOW w AS (PARTITION BY series_id ORDER BY ds))
    SELECT series_id, ds, {r('ch', 'value_change')}, {r('yoy', 'value_yoy_change')}, {r('ln(value) - lag(ln(value), 12) OVER w', 'log_yoy_change')},
    {r(f"CASE WHEN count(yoy) {frame(12, 'PARTITION BY series_id ORDER BY ds')} >= 6 THEN avg(yoy) {frame(12, 'PARTITION BY series_id ORDER BY ds')} END", 'ma_yoy_1y')},
    {r('stddev_samp(ch) ' + frame(12, 'PARTITION BY series_id ORDER BY ds'), 'volatility_12m')} FROM c WINDOW w AS (PARTITION BY series_id ORDER BY ds)""",
)
def macro_profile(spark, d):
    return X.macro_profile(src.macro_long(spark, d)).select("series_id", "ds", "value_change", "value_yoy_change", "log_yoy_change", "ma_yoy_1y", "volatility_12m")


@query(
    "pipeline_profile",
    f"""WITH {SALES}, q AS (SELECT *, lag(y) OVER w AS z FROM p {W}) SELECT unique_id, ds, {r('lag(y, 8) OVER w', 'lag_8')},
    {r(f"CASE WHEN count(y) {frame(3, shift=1)} >= 3 THEN avg(y) {frame(3, shift=1)} END", 'rolling_mean_3')}, {r('z - lag(z, 12) OVER w', 'diff_12')},
    {r(f'cos({2 * math.pi!r} * month(ds) / 12)', 'month_cos')}, weekofyear(ds)::INT AS week_of_year FROM q {W}""",
)
def pipeline_profile(spark, d):
    return X.pipeline_profile(_panel(spark, d), shift=1).select("unique_id", "ds", "lag_8", "rolling_mean_3", "diff_12", "month_cos", "week_of_year")


@query(
    "model_profile",
    f"""WITH {SALES}, a AS (SELECT *, lag(y) OVER w AS pv, avg(y) {frame(3, shift=1)} AS m3, avg(y) {frame(12, shift=1)} AS m12, avg(y) {frame(24, shift=1)} AS m24, count(*) OVER (PARTITION BY unique_id) AS n,
    row_number() OVER w - 1 AS trend FROM p {W}) SELECT unique_id, ds, trend::INT AS trend, {r('CASE WHEN n >= 24 THEN m3 END', 'ma_3')}, {r('coalesce(pv / nullif(lag(pv, 12) OVER w, 0) - 1, 0)', 'yoy_growth')},
    {r('CASE WHEN n >= 24 THEN m12 END / nullif(m24, 0)', 'seasonal_component')}, {r('(m12 - m3) / nullif(m12, 0)', 'trend_strength')}, (month(ds) IN (11, 12))::INT AS is_holiday_season FROM a {W}""",
)
def model_profile(spark, d):
    return X.model_profile(_panel(spark, d)).select("unique_id", "ds", "trend", "ma_3", "yoy_growth", "seasonal_component", "trend_strength", "is_holiday_season")


@query(
    "store_profile",
    f"""WITH {SALES} SELECT unique_id, ds, {r('lag(y, 6) OVER w', 'lag_6')}, {r('avg(y) ' + frame(6), 'ma_6')}, {r('y / nullif(lag(y, 12) OVER w, 0) - 1', 'yoy_change')},
    {r('avg(y) OVER (PARTITION BY unique_id, month(ds))', 'seasonal_component')}, {r('avg(y) ' + frame(12), 'trend')} FROM p {W}""",
)
def store_profile(spark, d):
    return X.store_profile(_panel(spark, d)).select("unique_id", "ds", "lag_6", "ma_6", "yoy_change", "seasonal_component", "trend")


@query(
    "calendar_flags",
    f"""WITH {TOTAL} SELECT ds, year(ds)::INT AS year, month(ds)::INT AS month, quarter(ds)::INT AS quarter, day(ds)::INT AS day_of_month, dayofyear(ds)::INT AS day_of_year, weekofyear(ds)::INT AS week_of_year,
    (isodow(ds) - 1)::INT AS day_of_week, day(last_day(ds))::INT AS days_in_month, (isodow(ds) >= 6)::INT AS is_weekend, (month(ds) IN (11, 12))::INT AS is_holiday_season, (month(ds) IN (7, 8))::INT AS is_back_to_school,
    (month(ds) IN (6, 7, 8))::INT AS is_summer, (month(ds) IN (3, 6, 9, 12))::INT AS is_quarter_end, (month(ds) = 12)::INT AS is_year_end, (day(ds) BETWEEN 14 AND 16 OR day(ds) >= 28)::INT AS is_payday FROM t""",
)
def calendar_flags(spark, d):
    cal = S.calendar(F.col("ds"))
    names = "year month quarter day_of_month day_of_year week_of_year day_of_week days_in_month is_weekend is_holiday_season is_back_to_school is_summer is_quarter_end is_year_end is_payday".split()
    return src.total_panel(spark, d).select("ds", *[cal[n].cast("int").alias(n) for n in names])


_T = repr(2 * math.pi)


@query(
    "fourier_terms",
    f"WITH {TOTAL} SELECT ds, {r(f'sin({_T} * month(ds) / 12)', 'month_sin')}, {r(f'cos({_T} * month(ds) / 12)', 'month_cos')}, {r(f'sin({_T} * quarter(ds) / 4)', 'quarter_sin')}, "
    + ", ".join(r(f"{f}({_T} * {k} * dayofyear(ds) / 365.25)", f"year_{f}_{k}") for k in (1, 2, 3) for f in ("sin", "cos"))
    + f", {r('dayofyear(ds) / 365.25', 'year_progress')} FROM t",
)
def fourier_terms(spark, d):
    got = S.fourier(F.col("ds"))
    names = ["month_sin", "month_cos", "quarter_sin", *[f"year_{f}_{k}" for k in (1, 2, 3) for f in ("sin", "cos")], "year_progress"]
    return src.total_panel(spark, d).select("ds", *[got[n].alias(n) for n in names])


@query("month_one_hot", f"WITH {TOTAL} SELECT ds, {', '.join(f'(month(ds) = {k})::INT AS month_{k}' for k in range(1, 13))}, {', '.join(f'(quarter(ds) = {k})::INT AS quarter_{k}' for k in range(1, 5))} FROM t")
def month_one_hot(spark, d):
    return src.total_panel(spark, d).withColumns(H.month_dummies(F.col("ds")) | H.quarter_dummies(F.col("ds"))).drop("unique_id", "y")


@query(
    "ffill_gaps",
    """WITH g AS (SELECT o_custkey % 7 AS k, last_day(o_orderdate) AS ds, round(sum(o_totalprice), 4) AS y FROM orders WHERE o_orderpriority = '1-URGENT' AND o_custkey < 20 GROUP BY 1, 2),
    n AS (SELECT k, last_day(unnest(generate_series(date_trunc('month', min(ds)), date_trunc('month', max(ds)), INTERVAL 1 MONTH))::DATE) AS ds FROM g GROUP BY k)
    SELECT k::BIGINT AS k, ds, """
    + r("last_value(y IGNORE NULLS) OVER (PARTITION BY k ORDER BY ds ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)", "forward")
    + ", "
    + r("first_value(y IGNORE NULLS) OVER (PARTITION BY k ORDER BY ds ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)", "backward")
    + ", "
    + r("coalesce(y, median(y) OVER (PARTITION BY k))", "imputed")
    + " FROM n LEFT JOIN g USING (k, ds)",
)
def ffill_gaps(spark, d):
    rows = src.table(spark, d, "orders").where("o_orderpriority = '1-URGENT' AND o_custkey < 20")
    g = rows.groupBy((F.col("o_custkey") % 7).alias("k"), S.month_end(F.col("o_orderdate")).alias("ds")).agg(F.round(F.sum("o_totalprice"), 4).alias("y"))
    return _filled(g)


def _filled(g):
    w = V.over_time("k")
    full = src.complete_months(g, ["k"])
    return full.select("k", "ds", V.forward_fill(F.col("y"), w).alias("forward"), V.backward_fill(F.col("y"), w, V.newest_first("k")).alias("backward"), F.coalesce("y", F.median("y").over(Window.partitionBy("k"))).alias("imputed"))


# the _all queries: every order by customer, a key that is sparse by itself; no SQL, compared with plain code in the tests
def _by_customer(spark, d, key="unique_id"):
    rows = src.table(spark, d, "orders")
    return rows.groupBy(F.col("o_custkey").alias(key), S.month_end(F.col("o_orderdate")).alias("ds")).agg(F.round(F.sum("o_totalprice"), 4).alias("y"))


@query("ffill_gaps_all")
def ffill_gaps_all(spark, d):
    return _filled(_by_customer(spark, d, "k"))


@query("month_profile", f"WITH {SALES} SELECT unique_id, month(ds)::INT AS month, {r('avg(y)', 'mean')} FROM p GROUP BY 1, 2")
def month_profile(spark, d):
    return _panel(spark, d).groupBy("unique_id", F.month("ds").alias("month")).agg(F.avg("y").alias("mean"))


@query("yearly_avg", f"WITH {SALES} SELECT unique_id, year(ds)::INT AS year, {r('avg(y)', 'mean')} FROM p GROUP BY 1, 2")
def yearly_avg(spark, d):
    return _panel(spark, d).groupBy("unique_id", F.year("ds").alias("year")).agg(F.avg("y").alias("mean"))


@query("hierarchy_rollup", f"WITH {SALES} SELECT unique_id, year(ds)::INT AS year, {r('sum(y)', 'total', 4)} FROM p GROUP BY ROLLUP (unique_id, year(ds)::INT)")
def hierarchy_rollup(spark, d):
    return _panel(spark, d).withColumn("year", F.year("ds")).rollup("unique_id", "year").agg(F.round(F.sum("y"), 4).alias("total"))


@query("describe_target", f"WITH {SALES} SELECT unique_id, {r('avg(y)', 'mean')}, {r('stddev_samp(y)', 'std')}, {r('min(y)', 'min')}, {r('max(y)', 'max')}, count(y) AS n FROM p GROUP BY 1")
def describe_target(spark, d):
    return Q.describe(_panel(spark, d))


@query(
    "quality_global",
    """SELECT count(*) AS n_rows, (count(*) - (SELECT count(*) FROM (SELECT DISTINCT c_custkey, c_nationkey, c_acctbal, c_mktsegment FROM customer)))::BIGINT AS n_duplicates, count(DISTINCT c_mktsegment) AS n_ids,
    min(c_custkey) AS first_day, max(c_custkey) AS last_day, sum((c_acctbal IS NULL)::BIGINT)::BIGINT AS nulls_c_acctbal FROM customer""",
)
def quality_global(spark, d):
    rows = src.table(spark, d, "customer").select("c_custkey", "c_nationkey", "c_acctbal", "c_mktsegment")
    got = Q.global_report(rows.withColumn("day", F.date_add(F.lit("1970-01-01").cast("date"), F.col("c_custkey").cast("int"))), "c_mktsegment", "day")
    back = lambda c: F.datediff(c, F.lit("1970-01-01").cast("date")).cast("long").alias(c)
    return got.select("n_rows", "n_duplicates", "n_ids", back("first_day"), back("last_day"), "nulls_c_acctbal")


@query(
    "quality_by_series",
    f"WITH {MACRO} SELECT series_id, count(*) AS n, {r('min(value)', 'min')}, {r('max(value)', 'max')}, {r('avg(value)', 'mean')}, {r('arg_max(value, ds)', 'latest')}, max(ds) AS latest_day, {r('avg((value IS NULL)::INT)', 'null_ratio')} FROM m GROUP BY 1",
)
def quality_by_series(spark, d):
    return Q.series_report(src.macro_long(spark, d), "series_id", "ds", "value")


@query("panel_checks", f"WITH {SALES} SELECT unique_id, count(*) >= 24 AS long_enough, count(y) = count(*) AS complete, coalesce(min(y), 0) > 0 AS positive, count(*) >= 24 AND count(y) = count(*) AS ok FROM p GROUP BY 1")
def panel_checks(spark, d):
    return Q.checks(_panel(spark, d))


@query(
    "iqr_outliers",
    f"WITH {SALES}, f AS (SELECT unique_id, quantile_cont(y, 0.25) AS q1, quantile_cont(y, 0.75) AS q3 FROM p GROUP BY 1) SELECT unique_id, ds, {r('y', 'y')}, {r('q1', 'q1')}, {r('q3', 'q3')}, (y < q1 - 1 * (q3 - q1) OR y > q3 + 1 * (q3 - q1)) AS is_outlier FROM p JOIN f USING (unique_id)",
)
def iqr_outliers(spark, d):
    return Q.outliers(_panel(spark, d), 1.0).select("unique_id", "ds", "y", "q1", "q3", "is_outlier")


_SPARSE = "v AS (SELECT (o_custkey % 50)::BIGINT AS unique_id, last_day(o_orderdate) AS ds, round(sum(o_totalprice), 4) AS y FROM orders WHERE o_custkey < 300 GROUP BY 1, 2)"


def _sparse(spark, d):
    rows = src.table(spark, d, "orders").where("o_custkey < 300")
    return rows.groupBy((F.col("o_custkey") % 50).alias("unique_id"), S.month_end(F.col("o_orderdate")).alias("ds")).agg(F.round(F.sum("o_totalprice"), 4).alias("y"))


@query(
    "gap_detect",
    f"""WITH {_SPARSE}, x AS (SELECT *, lag(ds) OVER w AS previous FROM v {W}), z AS (SELECT *, ((year(ds) - year(previous)) * 12 + month(ds) - month(previous))::INT AS months FROM x)
    SELECT unique_id, ds, {r('y', 'y')}, previous, months FROM z WHERE months > 2""",
)
def gap_detect(spark, d):
    return Q.gaps(_sparse(spark, d), 2)


@query("gap_detect_all")
def gap_detect_all(spark, d):
    return Q.gaps(_by_customer(spark, d), 2)


@query(
    "linear_interpolation",
    f"""WITH {_SPARSE}, n AS (SELECT unique_id, last_day(unnest(generate_series(date_trunc('month', min(ds)), date_trunc('month', max(ds)), INTERVAL 1 MONTH))::DATE) AS ds FROM v GROUP BY 1),
    f AS (SELECT unique_id, ds, y, CASE WHEN y IS NOT NULL THEN ds END AS held FROM n LEFT JOIN v USING (unique_id, ds)),
    h AS (SELECT *, last_value(y IGNORE NULLS) OVER a AS ya, first_value(y IGNORE NULLS) OVER b AS yb, last_value(held IGNORE NULLS) OVER a AS ta, first_value(held IGNORE NULLS) OVER b AS tb FROM f
      WINDOW a AS (PARTITION BY unique_id ORDER BY ds ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), b AS (PARTITION BY unique_id ORDER BY ds ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))
    SELECT unique_id, ds, {r('coalesce(y, ya + (yb - ya) * (ds - ta)::DOUBLE / nullif((tb - ta)::DOUBLE, 0))', 'y', 4)} FROM h""",
)
def linear_interpolation(spark, d):
    return _interpolated(_sparse(spark, d))


@query("linear_interpolation_all")
def linear_interpolation_all(spark, d):
    return _interpolated(_by_customer(spark, d))


def _interpolated(panel):
    return src.complete_months(panel, ["unique_id"]).select("unique_id", "ds", F.round(V.interpolate(F.col("y"), V.over_time(), F.col("ds"), V.newest_first()), 4).alias("y"))


@query("duplicate_days", "SELECT user_id, ts::DATE AS day, count(*) AS n FROM events GROUP BY 1, 2 HAVING count(*) > 1")
def duplicate_days(spark, d):
    return Q.duplicate_days(src.table(spark, d, "events").select("user_id", F.to_date("ts").alias("day")), ["user_id", "day"])


_SEG = ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"]


@query(
    "correlation_pairs",
    f"WITH {SEGMENTS} SELECT a.series_id AS a, b.series_id AS b, {r('corr(a.value, b.value)', 'corr')} FROM g a JOIN g b ON a.ds = b.ds AND a.series_id < b.series_id GROUP BY 1, 2",
)
def correlation_pairs(spark, d):
    long = src.macro_long(spark, d, "c_mktsegment")
    names = sorted(_SEG)
    return Q.correlations(H.wide(long, "series_id", "value", names), names).where("corr IS NOT NULL")


@query("autocorrelation", f"WITH {SALES}, l AS (SELECT *, lag(y, 1) OVER w AS a, lag(y, 12) OVER w AS b FROM p {W}) SELECT unique_id, {r('corr(y, a)', 'acf_1')}, {r('corr(y, b)', 'acf_12')} FROM l GROUP BY 1")
def autocorrelation(spark, d):
    return Q.autocorrelation(_panel(spark, d), [1, 12])


@query(
    "decomposition",
    f"""WITH {SALES}, a AS (SELECT *, CASE WHEN count(y) OVER f = 13 THEN (sum(y) OVER f - (lag(y, 6) OVER w + lead(y, 6) OVER w) / 2) / 12 END AS trend FROM p
    WINDOW w AS (PARTITION BY unique_id ORDER BY ds), f AS (PARTITION BY unique_id ORDER BY ds ROWS BETWEEN 6 PRECEDING AND 6 FOLLOWING)),
    b AS (SELECT *, avg(y - trend) OVER (PARTITION BY unique_id, month(ds)) AS seasonal FROM a) SELECT unique_id, ds, {r('trend', 'trend', 4)}, {r('seasonal', 'seasonal', 4)}, {r('y - trend - seasonal', 'rest', 4)} FROM b""",
)
def decomposition(spark, d):
    out = Q.decompose(_panel(spark, d))
    return out.select("unique_id", "ds", *[F.round(c, 4).alias(c) for c in ("trend", "seasonal", "rest")])


@query("min_max_scaled", f"WITH {SALES} SELECT unique_id, ds, {r('(y - min(y) OVER u) / nullif(max(y) OVER u - min(y) OVER u, 0)', 'y_scaled')} FROM p WINDOW u AS (PARTITION BY unique_id)")
def min_max_scaled(spark, d):
    return Q.min_max(_panel(spark, d), "y", ["unique_id"]).drop("y")


@query("target_encoding", f"WITH {SALES} SELECT unique_id, ds, {r('avg(y) OVER (PARTITION BY unique_id, month(ds) ORDER BY ds ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)', 'month_mean_before')} FROM p")
def target_encoding(spark, d):
    return Q.target_encoding(_panel(spark, d)).drop("y")


@query(
    "category_share",
    f"WITH {SALES} SELECT unique_id, ds, {r('y / nullif(sum(y) OVER (PARTITION BY ds), 0)', 'share')}, {r('y / nullif(avg(y) OVER (PARTITION BY ds), 0)', 'vs_market')}, {r('y / nullif(avg(y) ' + frame(12) + ', 0)', 'seasonal_strength')} FROM p",
)
def category_share(spark, d):
    month = Window.partitionBy("ds")
    return _panel(spark, d).select(
        "unique_id", "ds", S.safe_div(F.col("y"), F.sum("y").over(month)).alias("share"), S.safe_div(F.col("y"), F.avg("y").over(month)).alias("vs_market"), S.safe_div(F.col("y"), V.rolling(F.avg, F.col("y"), 12, V.over_time(), 1)).alias("seasonal_strength")
    )


@query("gaussian_smooth", f"WITH {SALES} SELECT unique_id, ds, " + r("(" + " + ".join(f"coalesce({math.exp(-k * k / 4.5)!r} * " + (f"lead(y, {k}) OVER w" if k > 0 else f"lag(y, {-k}) OVER w") + ", 0)" for k in range(-6, 7)) + ") / (" + " + ".join(f"CASE WHEN {(f'lead(y, {k}) OVER w' if k > 0 else f'lag(y, {-k}) OVER w')} IS NULL THEN 0 ELSE {math.exp(-k * k / 4.5)!r} END" for k in range(-6, 7)) + ")", "smooth", 4) + f" FROM p {W}")
def gaussian_smooth(spark, d):
    return _panel(spark, d).select("unique_id", "ds", F.round(V.smooth(F.col("y"), V.over_time()), 4).alias("smooth"))


@query("poly_features", f"WITH {SALES} SELECT unique_id, ds, {r('y * y / 1e6', 'squared', 3)}, {r('sqrt(y)', 'root')}, {r('ln(y)', 'log')}, {r('y / nullif(lag(y) OVER w, 0)', 'ratio')} FROM p {W}")
def poly_features(spark, d):
    return _panel(spark, d).select("unique_id", "ds", F.round(F.col("y") * F.col("y") / 1e6, 3).alias("squared"), F.sqrt("y").alias("root"), F.ln("y").alias("log"), S.safe_div(F.col("y"), V.lag(F.col("y"), 1, V.over_time())).alias("ratio"))
