"""Models whose orders and forms are searched, and the statistics that this rests on."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import arima as A
from ..operators import exponential as E
from .base import SALES, query, r
from .forecasts import _panel


def _kpss(k: int) -> str:
    """Level stationarity of z<k>, from its definition: lags up to 3 * sqrt(n) / 13 with Bartlett weights."""
    lags = range(1, A.LAGS + 1)
    weight = lambda j: f"CASE WHEN {j} <= l THEN (1 - {j} / (l + 1.0)) * coalesce(g{j}, 0) ELSE 0 END"
    return f"""e{k} AS (SELECT unique_id, i, z{k} - avg(z{k}) OVER (PARTITION BY unique_id) AS e, count(*) OVER (PARTITION BY unique_id) AS m FROM z WHERE z{k} IS NOT NULL),
u{k} AS (SELECT unique_id, m, e, sum(e) OVER w AS s, {", ".join(f"lag(e, {j}) OVER w AS e_{j}" for j in lags)} FROM e{k} WINDOW w AS (PARTITION BY unique_id ORDER BY i)),
v{k} AS (SELECT unique_id, m, sum(s * s) AS ss, sum(e * e) AS g0, {", ".join(f"sum(e * e_{j}) AS g{j}" for j in lags)}, least({A.LAGS}, floor(3 * sqrt(m) / 13)) AS l FROM u{k} GROUP BY 1, 2),
q{k} AS (SELECT unique_id, ss / nullif(m * (g0 + 2 * ({" + ".join(map(weight, lags))})), 0) AS kpss{k} FROM v{k})"""


_DIFFERENCES = f"""WITH {SALES}, n AS (SELECT unique_id, row_number() OVER (PARTITION BY unique_id ORDER BY ds) - 1 AS i, count(*) OVER (PARTITION BY unique_id) AS n, y FROM p),
a AS (SELECT *, y - (avg(y) OVER (PARTITION BY unique_id ORDER BY i ROWS BETWEEN 6 PRECEDING AND 5 FOLLOWING) + avg(y) OVER (PARTITION BY unique_id ORDER BY i ROWS BETWEEN 5 PRECEDING AND 6 FOLLOWING)) / 2 AS away FROM n),
b AS (SELECT *, away - avg(away) OVER (PARTITION BY unique_id, i % 12) AS rest FROM a WHERE i >= 6 AND i < n - 6),
s1 AS (SELECT unique_id, greatest(0.0, 1 - var_samp(rest) / nullif(var_samp(away), 0)) AS strength FROM b GROUP BY 1),
o AS (SELECT DISTINCT n.unique_id, n, strength, CASE WHEN strength > 0.64 AND n >= 36 THEN 1 ELSE 0 END AS sd FROM n LEFT JOIN s1 USING (unique_id)),
y0 AS (SELECT n.unique_id, i, CASE WHEN sd = 1 THEN y - lag(y, 12) OVER (PARTITION BY n.unique_id ORDER BY i) ELSE y END AS z0 FROM n JOIN o USING (unique_id)),
z AS (SELECT *, z0 - lag(z0) OVER (PARTITION BY unique_id ORDER BY i) AS z1 FROM y0), {_kpss(0)}, {_kpss(1)}
SELECT unique_id, n, {r("strength", "strength")}, sd, {r("kpss0", "kpss0")}, {r("kpss1", "kpss1")}, CASE WHEN kpss0 >= 0.463 IS NOT TRUE THEN 0 WHEN kpss1 >= 0.463 IS NOT TRUE THEN 1 ELSE 2 END AS d
FROM o LEFT JOIN q0 USING (unique_id) LEFT JOIN q1 USING (unique_id)"""


@query("arima_differences", _DIFFERENCES)
def arima_differences(spark, d):
    told = A.differences(_panel(spark, d))[0]
    return told.withColumns({c: F.round(c, 6) for c in ("strength", "kpss0", "kpss1")})


# searched models: the tests hold likelihoods, orders, forms and forecasts against plain code
@query("auto_arima_forecast")
def auto_arima_forecast(spark, d):
    return A.auto_arima(_panel(spark, d))


@query("auto_ets_forecast")
def auto_ets_forecast(spark, d):
    return E.auto_ets(_panel(spark, d))
