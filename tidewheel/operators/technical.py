"""Features of daily price bars: symbol, ds, open, high, low, close, volume."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import month_end, safe_div
from .windows import diff, lag, log_change, over_time, pct_change, rolling, with_ema


def returns(bars: DataFrame) -> DataFrame:
    w, c = over_time("symbol"), F.col("close")
    out = bars.withColumn("daily_return", pct_change(c, 1, w)).withColumn("log_return", log_change(c, 1, w))
    for n in (5, 10, 20):
        out = out.withColumn(f"rolling_vol_{n}d", rolling(F.stddev_samp, F.col("daily_return"), n, w, 1))
    for n in (5, 10, 20, 50):
        out = out.withColumn(f"rolling_mean_{n}d", rolling(F.avg, c, n, w, 1))
    return out


def spreads(bars: DataFrame) -> DataFrame:
    w = over_time("symbol")
    return (
        bars.withColumn("high_low_spread", safe_div(F.col("high") - F.col("low"), F.col("close")))
        .withColumn("open_close_spread", safe_div(F.col("close") - F.col("open"), F.col("open")))
        .withColumn("volume_change", pct_change(F.col("volume").cast("double"), 1, w))
    )


def rsi(bars: DataFrame, n: int = 14) -> DataFrame:
    """100 where there are only gains, null where nothing moved yet; the first row counts as no move."""
    w = over_time("symbol")
    move = F.coalesce(diff(F.col("close"), 1, w), F.lit(0.0))
    out = bars.withColumn("_move", move)
    gain = rolling(F.avg, F.greatest("_move", F.lit(0.0)), n, w, 1)
    loss = rolling(F.avg, F.greatest(-F.col("_move"), F.lit(0.0)), n, w, 1)
    out = out.withColumn("_gain", gain).withColumn("_loss", loss)
    value = F.when(F.col("_loss") > 0, 100 - 100 / (1 + safe_div(F.col("_gain"), F.col("_loss")))).when(F.col("_gain") > 0, 100.0)
    return out.withColumn(f"rsi_{n}", value).drop("_move", "_gain", "_loss")


def macd(bars: DataFrame, fast: int = 12, slow: int = 26, signal: int = 9) -> DataFrame:
    out = with_ema(with_ema(bars, "close", fast, "_fast", ["symbol"], "ds"), "close", slow, "_slow", ["symbol"], "ds")
    out = out.withColumn("macd", F.col("_fast") - F.col("_slow")).drop("_fast", "_slow")
    out = with_ema(out, "macd", signal, "macd_signal", ["symbol"], "ds")
    return out.withColumn("macd_histogram", F.col("macd") - F.col("macd_signal"))


def bollinger(bars: DataFrame, n: int = 20, k: float = 2.0) -> DataFrame:
    w, c = over_time("symbol"), F.col("close")
    out = bars.withColumn("bb_middle", rolling(F.avg, c, n, w)).withColumn("_sd", rolling(F.stddev_samp, c, n, w))
    out = out.withColumn("bb_upper", F.col("bb_middle") + k * F.col("_sd")).withColumn("bb_lower", F.col("bb_middle") - k * F.col("_sd"))
    wide = F.col("bb_upper") - F.col("bb_lower")
    return out.withColumn("bb_width", safe_div(wide, F.col("bb_middle"))).withColumn("bb_position", safe_div(c - F.col("bb_lower"), wide)).drop("_sd")


def year_range(bars: DataFrame, n: int = 252) -> DataFrame:
    w = over_time("symbol")
    out = bars.withColumn("high_52w", rolling(F.max, F.col("high"), n, w, 1)).withColumn("low_52w", rolling(F.min, F.col("low"), n, w, 1))
    return out.withColumn("position_52w", safe_div(F.col("close") - F.col("low_52w"), F.col("high_52w") - F.col("low_52w")))


def momentum(bars: DataFrame) -> DataFrame:
    w = over_time("symbol")
    for n in (1, 3, 5, 10, 20):
        bars = bars.withColumn(f"momentum_{n}d", pct_change(F.col("close"), n, w))
    return bars


def all_features(bars: DataFrame) -> DataFrame:
    """The whole daily profile."""
    for step in (returns, spreads, rsi, macd, bollinger, year_range, momentum):
        bars = step(bars)
    return bars


def monthly(bars: DataFrame) -> DataFrame:
    """Bars by month: last close, volatility of daily returns inside the month, means; then return and momentum of months."""
    w = over_time("symbol")
    daily = bars.withColumn("r", pct_change(F.col("close"), 1, w))
    out = daily.groupBy("symbol", month_end(F.col("ds")).alias("month")).agg(
        F.max_by("close", "ds").alias("close"), F.stddev_samp("r").alias("volatility"), F.avg("volume").alias("avg_volume"), F.avg("r").alias("avg_return"), F.count(F.lit(1)).alias("n_days")
    )
    months = over_time("symbol", "month")
    return out.withColumn("monthly_return", pct_change(F.col("close"), 1, months)).withColumn("price_momentum", pct_change(F.col("close"), 3, months))


def market_trend(bars: DataFrame, short: int = 50, long: int = 200) -> DataFrame:
    """1 where the short mean stands over the long one."""
    w = over_time("symbol")
    out = bars.withColumn(f"ma_{short}", rolling(F.avg, F.col("close"), short, w, 1)).withColumn(f"ma_{long}", rolling(F.avg, F.col("close"), long, w, 1))
    return out.withColumn("trend_up", (F.col(f"ma_{short}") > F.col(f"ma_{long}")).cast("int")).withColumn("previous_close", lag(F.col("close"), 1, w))
