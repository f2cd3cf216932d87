"""What was known when, unit roots, components, feature scores, and trees that stop early."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import features as X
from ..operators import models as L
from ..operators import reshape as H
from ..operators import select as C
from ..operators import trees as T
from ..operators import unitroot as U
from ..operators import versions as Z
from ..sources import series as src
from .base import MACRO, SALES, query, r


@query(
    "macro_known_at",
    f"""WITH {MACRO}, f AS (SELECT series_id, ds AS valid, (ds + INTERVAL 20 DAY)::DATE AS known, round(value / 100) * 100 AS value FROM m UNION ALL SELECT series_id, ds, (ds + INTERVAL 50 DAY)::DATE, value FROM m)
    SELECT m.series_id, m.ds, f.valid, f.known, {r("f.value", "value", 4)} FROM m LEFT JOIN f ON f.series_id = m.series_id AND f.known <= m.ds QUALIFY row_number() OVER (PARTITION BY m.series_id, m.ds ORDER BY f.valid DESC NULLS LAST, f.known DESC) = 1""",
)
def macro_known_at(spark, d):
    """Each month end's macro values as they were known then: told 20 days after their month, in hundreds, and finally after 50."""
    m = src.macro_long(spark, d).select("series_id", "ds", "value")
    told = F.explode(F.array(F.struct(F.lit(20).alias("days"), (F.round(F.col("value") / 100) * 100).alias("value")), F.struct(F.lit(50).alias("days"), "value"))).alias("x")
    facts = m.select("series_id", F.col("ds").alias("valid"), told).select("series_id", "valid", F.date_add("valid", F.col("x.days")).alias("known"), "x.value")
    return H.known_at(m.select("series_id", "ds"), facts, ["series_id"], "ds").withColumn("value", F.round("value", 4))


@query(
    "dickey_fuller_one_lag",
    f"""WITH {SALES}, a AS (SELECT unique_id, ds, lag(y) OVER w AS x, y - lag(y) OVER w AS d FROM p WINDOW w AS (PARTITION BY unique_id ORDER BY ds)), b AS (SELECT *, lag(d) OVER (PARTITION BY unique_id ORDER BY ds) AS z FROM a),
    su AS (SELECT unique_id, count(*) AS n, regr_sxx(d, x) AS xx, regr_syy(d, x) AS dd, regr_sxy(d, x) AS xd, regr_sxx(d, z) AS zz, regr_sxy(d, z) AS zd, regr_sxy(x, z) AS xz FROM b WHERE z IS NOT NULL GROUP BY 1),
    q AS (SELECT *, dd - xd * xd / xx AS rest0, xx * zz - xz * xz AS det, (xd * zz - zd * xz) / (xx * zz - xz * xz) AS b1, (zd * xx - xd * xz) / (xx * zz - xz * xz) AS c1 FROM su), t AS (SELECT *, dd - b1 * xd - c1 * zd AS rest1 FROM q)
    SELECT unique_id, n, CASE WHEN n * ln(rest1 / n) + 6 < n * ln(rest0 / n) + 4 THEN 1 ELSE 0 END AS lags,
    {r("CASE WHEN n * ln(rest1 / n) + 6 < n * ln(rest0 / n) + 4 THEN b1 / sqrt(rest1 / (n - 3) * zz / det) ELSE xd / xx / sqrt(rest0 / (n - 2) / xx) END", "statistic", 4)} FROM t""",
)
def dickey_fuller_one_lag(spark, d):
    return U.dickey_fuller(src.sales_panel(spark, d), 1).select("unique_id", "n", "lags", F.round("statistic", 4).alias("statistic"))


@query("dickey_fuller")
def dickey_fuller(spark, d):
    """With up to twelve lags and p-values; the tests hold it against least squares and a table."""
    return U.dickey_fuller(src.sales_panel(spark, d))


_LINES = "l AS (SELECT l_quantity AS quantity, l_extendedprice / 1000 AS price, l_discount AS discount, l_tax AS tax, l_extendedprice * (1 - l_discount) / 1000 AS revenue FROM lineitem)"
_FEATURES = ["quantity", "price", "discount", "tax"]


def _lines(spark, d):
    price = F.col("l_extendedprice")
    return src.table(spark, d, "lineitem").select(F.col("l_quantity").alias("quantity"), (price / 1000).alias("price"), F.col("l_discount").alias("discount"), F.col("l_tax").alias("tax"), (price * (1 - F.col("l_discount")) / 1000).alias("revenue"))


_PAIRS = [(a, b) for i, a in enumerate(_FEATURES) for b in _FEATURES[i:]]


@query("feature_covariances", f"WITH {_LINES} " + " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, count(*) AS n, {r(f'covar_samp({a}, {b})', 'covariance')} FROM l" for a, b in _PAIRS))
def feature_covariances(spark, d):
    return C.covariances(_lines(spark, d), _FEATURES).withColumn("covariance", F.round("covariance", 6))


@query("feature_f_scores", f"WITH {_LINES} " + " UNION ALL ".join(f"SELECT '{c}' AS feature, count(*) AS n, {r(f'corr({c}, revenue)', 'r')}, {r(f'pow(corr({c}, revenue), 2) * (count(*) - 2) / (1 - pow(corr({c}, revenue), 2))', 'f', 3)} FROM l" for c in _FEATURES))
def feature_f_scores(spark, d):
    return C.f_scores(_lines(spark, d), _FEATURES, "revenue").withColumns({"r": F.round("r", 6), "f": F.round("f", 3)})


@query(
    "feature_information",
    f"WITH {_LINES}, x AS ("
    + " UNION ALL ".join(f"SELECT '{c}' AS feature, {c} AS v, revenue AS t FROM l" for c in _FEATURES)
    + f"), e AS (SELECT feature, min(v) AS va, max(v) AS vb, min(t) AS ta, max(t) AS tb FROM x GROUP BY 1), g AS (SELECT feature, least(7, floor((v - va) / (vb - va) * 8)) AS a, least(7, floor((t - ta) / (tb - ta) * 8)) AS b, count(*) AS c FROM x JOIN e USING (feature) GROUP BY ALL), h AS (SELECT *, sum(c) OVER (PARTITION BY feature, a) AS ca, sum(c) OVER (PARTITION BY feature, b) AS cb, sum(c) OVER (PARTITION BY feature) AS n FROM g) SELECT feature, max(n)::BIGINT AS n, {r('greatest(0.0, sum(c / n * ln(c * n / (ca * cb))))', 'information')} FROM h GROUP BY 1",
)
def feature_information(spark, d):
    return C.mutual_information(_lines(spark, d), _FEATURES, "revenue").withColumn("information", F.round("information", 6))


@query("principal_components")
def principal_components(spark, d):
    """Directions of the two largest components and their shares; the tests hold them against NumPy."""
    ways, shares, _ = C.components(_lines(spark, d), _FEATURES)
    rows = [(f"pc_{i + 1}", float(s), *map(float, w)) for i, (w, s) in enumerate(zip(ways, shares, strict=True))]
    return spark.createDataFrame(rows, "component string, share double, " + ", ".join(f"{c} double" for c in _FEATURES))


_WIDE = ("value", "lag_12", "ma_6", "pct_1", "vol_3")


@query("wide_features_every", f"WITH {SALES}, x AS (SELECT unique_id, ds, y, lag(y, 12) OVER w AS l12, avg(y) OVER (PARTITION BY unique_id ORDER BY ds ROWS 5 PRECEDING) AS m6, y / nullif(lag(y) OVER w, 0) - 1 AS p1 FROM p WINDOW w AS (PARTITION BY unique_id ORDER BY ds)), z AS (SELECT x.*, CASE WHEN count(p1) OVER v >= 2 THEN stddev_samp(p1) OVER v END AS v3 FROM x WINDOW v AS (PARTITION BY unique_id ORDER BY ds ROWS 2 PRECEDING)) SELECT ds, unique_id, {r('y', 'value', 4)}, {r('l12', 'lag_12', 4)}, {r('m6', 'ma_6', 4)}, {r('p1', 'pct_1')}, {r('v3', 'vol_3')} FROM z")
def wide_features_every(spark, d):
    """The wide columns of all series, told by series again."""
    p = src.sales_panel(spark, d)
    ids = sorted(row[0] for row in p.select("unique_id").distinct().collect())  # the columns of a wide table: few by nature
    wide = X.wide_features(p, ids, "unique_id", "ds", "y")
    told = F.explode(F.array(*(F.struct(F.lit(i).alias("unique_id"), *(F.col(f"`{i}_{c}`").alias(c) for c in _WIDE)) for i in ids))).alias("x")
    out = wide.select("ds", told).select("ds", "x.*").where("value is not null")
    return out.withColumns({c: F.round(c, 4) for c in ("value", "lag_12", "ma_6")} | {c: F.round(c, 6) for c in ("pct_1", "vol_3")})


@query("recursive_forecast")
def recursive_forecast(spark, d):
    """Twelve months, each from those before it; the tests hold it against features built anew at each step."""
    p = src.sales_panel(spark, d)
    return T.recursive(T.boosted(*L.feature_matrix(p))[0], p)


@query("forest_out_of_bag")
def forest_out_of_bag(spark, d):
    """Every month by the trees that did not see it."""
    return T.forest(*L.feature_matrix(src.sales_panel(spark, d)))[1].withColumnRenamed("label", "y")


@query("version_tree")
def version_tree(spark, d):
    """Hashes of all orders by bucket and the tree over them; the tests change single values and find their buckets."""
    return Z.version_tree(src.table(spark, d, "orders"), ["o_orderkey"])
