"""Queries over daily bars: technical features and monthly aggregates."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import technical as T
from ..operators import windows as V
from ..sources import series as src
from ..streaming import bars as stream
from .base import BARS, EVENT_BARS, frame, query, r

_P = "PARTITION BY symbol ORDER BY ds"
_W = f"WINDOW w AS ({_P})"


@query("bars_daily", f"WITH {EVENT_BARS} SELECT symbol, ds, {r('open', 'open')}, {r('high', 'high')}, {r('low', 'low')}, {r('close', 'close')}, volume FROM b")
def bars_daily(spark, d):
    return src.event_bars(spark, d)


@query(
    "bar_returns",
    f"""WITH {BARS}, c AS (SELECT *, close / nullif(lag(close) OVER w, 0) - 1 AS dr, ln(close) - lag(ln(close)) OVER w AS lr FROM b {_W})
    SELECT symbol, ds, {r('dr', 'daily_return')}, {r('lr', 'log_return')}, {', '.join(r(f'stddev_samp(dr) {frame(n, _P)}', f'rolling_vol_{n}d') for n in (5, 10, 20))}, {', '.join(r(f'avg(close) {frame(n, _P)}', f'rolling_mean_{n}d') for n in (5, 10, 20, 50))} FROM c""",
)
def bar_returns(spark, d):
    return T.returns(src.order_bars(spark, d)).drop("open", "high", "low", "close", "volume")


@query(
    "spreads",
    f"WITH {BARS} SELECT symbol, ds, {r('(high - low) / nullif(close, 0)', 'high_low_spread')}, {r('(close - open) / nullif(open, 0)', 'open_close_spread')}, {r('volume / nullif(lag(volume) OVER w, 0) - 1', 'volume_change')} FROM b {_W}",
)
def spreads(spark, d):
    return T.spreads(src.order_bars(spark, d)).drop("open", "high", "low", "close", "volume")


@query(
    "rsi14",
    f"""WITH {BARS}, c AS (SELECT *, coalesce(close - lag(close) OVER w, 0) AS mv FROM b {_W}), g AS (SELECT symbol, ds, avg(greatest(mv, 0)) {frame(14, _P)} AS ga, avg(greatest(-mv, 0)) {frame(14, _P)} AS lo FROM c)
    SELECT symbol, ds, {r('CASE WHEN lo > 0 THEN 100 - 100 / (1 + ga / lo) WHEN ga > 0 THEN 100.0 END', 'rsi_14')} FROM g""",
)
def rsi14(spark, d):
    return T.rsi(src.order_bars(spark, d)).select("symbol", "ds", "rsi_14")


def _ema_sql(col: str, span: int, name: str) -> str:
    # short series: the plain closed form
    a = 2.0 / (span + 1)
    return f"pow({1 - a!r}, k) * sum(CASE WHEN k = 0 THEN {col} ELSE {a!r} * {col} END * pow({1 - a!r}, -k)) OVER (PARTITION BY symbol ORDER BY k) AS {name}"


@query(
    "ema_macd",
    f"""WITH {EVENT_BARS}, k AS (SELECT *, row_number() OVER ({_P}) - 1 AS k FROM b), e AS (SELECT *, {_ema_sql('close', 12, 'fa')}, {_ema_sql('close', 26, 'sl')} FROM k), m AS (SELECT *, fa - sl AS macd FROM e),
    s AS (SELECT *, {_ema_sql('macd', 9, 'sg')} FROM m) SELECT symbol, ds, {r('macd', 'macd')}, {r('sg', 'macd_signal')}, {r('macd - sg', 'macd_histogram')} FROM s""",
)
def ema_macd(spark, d):
    return T.macd(src.event_bars(spark, d)).select("symbol", "ds", "macd", "macd_signal", "macd_histogram")


@query(
    "bollinger",
    f"""WITH {BARS}, c AS (SELECT *, CASE WHEN count(close) {frame(20, _P)} >= 20 THEN avg(close) {frame(20, _P)} END AS m, CASE WHEN count(close) {frame(20, _P)} >= 20 THEN stddev_samp(close) {frame(20, _P)} END AS sd FROM b)
    SELECT symbol, ds, {r('m', 'bb_middle')}, {r('m + 2 * sd', 'bb_upper')}, {r('m - 2 * sd', 'bb_lower')}, {r('4 * sd / nullif(m, 0)', 'bb_width')}, {r('(close - (m - 2 * sd)) / nullif(4 * sd, 0)', 'bb_position')} FROM c""",
)
def bollinger(spark, d):
    return T.bollinger(src.order_bars(spark, d)).select("symbol", "ds", "bb_middle", "bb_upper", "bb_lower", "bb_width", "bb_position")


@query(
    "position_52w",
    f"""WITH {BARS}, c AS (SELECT *, max(high) {frame(252, _P)} AS h, min(low) {frame(252, _P)} AS l FROM b) SELECT symbol, ds, {r('h', 'high_52w')}, {r('l', 'low_52w')}, {r('(close - l) / nullif(h - l, 0)', 'position_52w')} FROM c""",
)
def position_52w(spark, d):
    return T.year_range(src.order_bars(spark, d)).select("symbol", "ds", "high_52w", "low_52w", "position_52w")


@query("momentum", f"WITH {BARS} SELECT symbol, ds, {', '.join(r(f'close / nullif(lag(close, {n}) OVER w, 0) - 1', f'momentum_{n}d') for n in (1, 3, 5, 10, 20))} FROM b {_W}")
def momentum(spark, d):
    return T.momentum(src.order_bars(spark, d)).drop("open", "high", "low", "close", "volume")


@query(
    "bars_monthly_resample",
    f"""WITH {BARS}, c AS (SELECT *, close / nullif(lag(close) OVER w, 0) - 1 AS x FROM b {_W}),
    m AS (SELECT symbol, last_day(ds) AS month, arg_max(close, ds) AS close, stddev_samp(x) AS volatility, avg(volume) AS avg_volume, avg(x) AS avg_return, count(*) AS n_days FROM c GROUP BY 1, 2)
    SELECT symbol, month, {r('close', 'close')}, {r('volatility', 'volatility')}, {r('avg_volume', 'avg_volume')}, {r('avg_return', 'avg_return')}, n_days, {r('close / nullif(lag(close) OVER v, 0) - 1', 'monthly_return')},
    {r('close / nullif(lag(close, 3) OVER v, 0) - 1', 'price_momentum')} FROM m WINDOW v AS (PARTITION BY symbol ORDER BY month)""",
)
def bars_monthly_resample(spark, d):
    return T.monthly(src.order_bars(spark, d))


@query(
    "market_trend",
    f"""WITH {BARS}, c AS (SELECT symbol, ds, avg(close) {frame(50, _P)} AS s, avg(close) {frame(200, _P)} AS l, lag(close) OVER ({_P}) AS pc FROM b) SELECT symbol, ds, {r('s', 'ma_50')}, {r('l', 'ma_200')}, (s > l)::INT AS trend_up, {r('pc', 'previous_close')} FROM c""",
)
def market_trend(spark, d):
    return T.market_trend(src.order_bars(spark, d)).drop("open", "high", "low", "close", "volume")


@query("session_windows", "WITH o AS (SELECT *, CASE WHEN ts >= lag(ts) OVER w + INTERVAL 30 MINUTE OR lag(ts) OVER w IS NULL THEN 1 ELSE 0 END AS nw FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), s AS (SELECT *, sum(nw) OVER (PARTITION BY user_id ORDER BY ts) AS k FROM o) SELECT user_id, min(ts) AS start, max(ts) + INTERVAL 30 MINUTE AS \"end\", count(*) AS n, " + r("sum(value)", "total") + " FROM s GROUP BY user_id, k")
def session_windows(spark, d):
    return stream.sessions(src.table(spark, d, "events"))


@query("sliding_week", "WITH d AS (SELECT event_type, (ts::DATE - i::INT)::TIMESTAMP AS start, value FROM events, range(7) r(i)) SELECT event_type, start, start + INTERVAL 7 DAY AS \"end\", " + r("avg(value)", "mean") + ", count(*) AS n FROM d GROUP BY 1, 2")
def sliding_week(spark, d):
    return stream.sliding_mean(src.table(spark, d, "events"))


@query("distinct_sketches", "SELECT event_type, count(DISTINCT user_id) AS users FROM events GROUP BY 1")
def distinct_sketches(spark, d):
    return src.table(spark, d, "events").groupBy("event_type").agg(F.countDistinct("user_id").alias("users"))


@query("daily_return_lags", f"WITH {BARS}, c AS (SELECT *, close / nullif(lag(close) OVER w, 0) - 1 AS x FROM b {_W}) SELECT symbol, ds, {r('lag(x, 1) OVER w', 'lag_1')}, {r('lag(x, 3) OVER w', 'lag_3')} FROM c {_W}")
def daily_return_lags(spark, d):
    w = V.over_time("symbol")
    out = src.order_bars(spark, d).withColumn("x", V.pct_change(F.col("close"), 1, w))
    return out.select("symbol", "ds", V.lag(F.col("x"), 1, w).alias("lag_1"), V.lag(F.col("x"), 3, w).alias("lag_3"))
