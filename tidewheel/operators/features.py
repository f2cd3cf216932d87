"""Feature profiles: named lists of columns, built in stages over one window specification."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from ..functions.scalars import calendar, category_kind, category_seasons, fourier, growth_band, safe_div
from .reshape import month_dummies
from .windows import diff, enough, forward_fill, lag, log_change, over_time, pct_change, rolling, rolling_rank, total_rank, zscore

def lags(panel: DataFrame, steps: list[int], y: str = "y", w: WindowSpec | None = None) -> DataFrame:
    w = w or over_time()
    return panel.withColumns({f"lag_{n}": lag(F.col(y), n, w) for n in steps})


def retail_profile(panel: DataFrame, y: str = "y", w: WindowSpec | None = None) -> DataFrame:
    """Changes, means, volatility, ranks and scores, momentum and growth bands of observations."""
    w = w or over_time()
    x = F.col(y)
    out = panel.withColumns({"pct_change": pct_change(x, 1, w), "pct_change_yoy": pct_change(x, 12, w)})
    out = out.withColumns({f"rolling_mean_{n}m": rolling(F.avg, x, n, w, 1) for n in (3, 6, 12)})
    out = out.withColumns({f"rolling_std_{n}m": rolling(F.stddev_samp, F.col("pct_change"), n, w, 1) for n in (3, 12)})
    out = out.withColumns({f"zscore_{k}y": zscore(x, 12 * k, w) for k in (1, 2)} | {f"pct_rank_{k}y": rolling_rank(x, 12 * k, w) for k in (1, 2)})
    out = out.withColumns({f"momentum_{n}m": pct_change(x, n, w) for n in (1, 3, 6)})
    out = out.withColumn("acceleration_1m", diff(F.col("momentum_1m"), 1, w))
    out = out.withColumn("trend_3m_vs_12m", safe_div(F.col("rolling_mean_3m") - F.col("rolling_mean_12m"), F.col("rolling_mean_12m")))
    return out.withColumn("growth_rate", growth_band(F.col("pct_change")))


def macro_profile(long: DataFrame, id_col: str = "series_id", time: str = "ds", value: str = "value", leading: tuple[str, ...] = ("UMCSENT",)) -> DataFrame:
    """The same for macro series, with logarithms, and the global rank as signal of leading series."""
    w, x = over_time(id_col, time), F.col(value)
    out = long.withColumns({"value_change": pct_change(x, 1, w), "value_diff": diff(x, 1, w), "log_value": F.when(x > 0, F.ln(x)), "log_change": log_change(x, 1, w)})
    out = out.withColumns({"value_yoy_change": pct_change(x, 12, w), "log_yoy_change": log_change(x, 12, w)})
    out = out.withColumns({f"ma_{n}m": rolling(F.avg, x, n, w, 1) for n in (3, 6, 12)} | {f"ma_{n}m_std": rolling(F.stddev_samp, x, n, w, 1) for n in (3, 6, 12)})
    out = out.withColumns({f"ma_yoy_{k}y": rolling(F.avg, F.col("value_yoy_change"), 12 * k, w, 6 * k) for k in (1, 2)})
    out = out.withColumns({f"volatility_{n}m": rolling(F.stddev_samp, F.col("value_change"), n, w, 1) for n in (3, 12)})
    out = out.withColumns({f"zscore_{k}y": zscore(x, 12 * k, w) for k in (1, 2)} | {f"pct_rank_{k}y": rolling_rank(x, 12 * k, w) for k in (1, 2, 5)})
    return out.withColumn("leading_signal", F.when(F.col(id_col).isin(*leading), total_rank(x, [id_col])).otherwise(0.0))


def pipeline_profile(panel: DataFrame, full: bool = False, y: str = "y", shift: int = 0) -> DataFrame:
    """Lags, full-window statistics, differences and calendar. shift 1 keeps the present value out of all of them."""
    x = F.col(y)
    out = lags(panel, [1, 2, 3, 4, 8, 12] + [24] * full, y)
    stats = {"mean": F.avg, "std": F.stddev_samp} | ({"min": F.min, "max": F.max} if full else {})
    out = out.withColumns({f"rolling_{name}_{n}": rolling(f, x, n, over_time(), n, shift) for n in ((4, 8, 12) if full else (3, 6, 12)) for name, f in stats.items()})
    if shift:
        out = out.withColumn("_p", lag(x, shift, over_time()))
        x = F.col("_p")
    out = out.withColumns({f"diff_{n}": diff(x, n, over_time()) for n in (1, 12)} | {f"pct_change_{n}": pct_change(x, n, over_time()) for n in (1, 12)})
    cal, cyc = calendar(F.col("ds")), fourier(F.col("ds"))
    names = ["day_of_week", "week_of_year", "is_weekend", "month", "quarter", "year"]
    return out.drop("_p").withColumns({n: cal[n] for n in names} | {n: cyc[n] for n in ("month_sin", "month_cos", "quarter_sin", "quarter_cos")})


def model_profile(panel: DataFrame, y: str = "y", shift: int = 1) -> DataFrame:
    """Trend, season, holiday, category and history features for tree models. By default no frame reaches the present value."""
    x = F.col(y)
    keys = ["unique_id"]
    out = panel.withColumn("trend", F.row_number().over(over_time()) - 1).withColumn("trend_squared", F.col("trend") * F.col("trend"))
    out = out.withColumns(calendar(F.col("ds")) | fourier(F.col("ds")) | month_dummies(F.col("ds")))
    turn = 2 * math.pi
    out = out.withColumns({"cycle_proxy": F.sin(turn * F.col("year") / 10), "confidence_proxy": 0.3 * F.sin(turn * F.col("day_of_year") / 365.25) + 1})
    kind = category_kind(F.col("unique_id"))
    out = out.withColumns({f"is_{k}": (kind == k).cast("int") for k in ("electronics", "clothing", "home", "auto", "food")} | category_seasons(F.col("unique_id"), F.col("ds")))
    out = out.withColumns({f"lag_{n}": enough(lag(x, n, over_time()), n, keys) for n in (1, 2, 3, 6, 12)} | {"yoy_lag_1": lag(x, 12, over_time()), "yoy_lag_2": lag(x, 24, over_time())})
    past = lag(x, shift, over_time()) if shift else x
    out = out.withColumn("_p", past)
    p = F.col("_p")
    roll = {f"ma_{n}{tail}": enough(rolling(f, x, n, over_time(), 1, shift), 24, keys) for n in (3, 6, 12) for tail, f in {"": F.avg, "_std": F.stddev_samp, "_min": F.min, "_max": F.max}.items()}
    out = out.withColumns(roll | {"_m24": rolling(F.avg, x, 24, over_time(), 1, shift)})
    out = out.withColumns({"yoy_growth": F.coalesce(pct_change(p, 12, over_time()), F.lit(0.0))} | {f"momentum_{n}": pct_change(p, n, over_time()) for n in (1, 3, 12)} | {f"volatility_{n}": F.col(f"ma_{n}_std") for n in (3, 12)})
    out = out.withColumns({"seasonal_component": safe_div(F.col("ma_12"), F.col("_m24")), "trend_strength": safe_div(F.col("ma_12") - F.col("ma_3"), F.col("ma_12"))})
    return out.drop("_p", "_m24")


def store_profile(panel: DataFrame, y: str = "y") -> DataFrame:
    """The stored features: lags, means, changes, month means of the whole history (they see the future) and trend."""
    x = F.col(y)
    out = lags(panel, [1, 3, 6, 12], y)
    out = out.withColumns({f"ma_{n}": rolling(F.avg, x, n, over_time(), 1) for n in (3, 6, 12)})
    out = out.withColumns({"yoy_change": pct_change(x, 12, over_time()), "mom_change": pct_change(x, 1, over_time())})
    return out.withColumns({"seasonal_component": F.avg(x).over(Window.partitionBy("unique_id", F.month("ds"))), "trend": rolling(F.avg, x, 12, over_time(), 1)})


def wide_features(long: DataFrame, ids: list[str], id_col: str = "series_id", time: str = "ds", value: str = "value") -> DataFrame:
    """One row a month, ID_FEATURE columns: lags 1, 3, 6, 12, means 3, 6, 12, changes 1, 12 and volatility 3, 12 of each of ids. Windows by series, one pivot."""
    w, x = over_time(id_col, time), F.col(value)
    out = long.where(F.col(id_col).isin(ids)).withColumn("pct_1", pct_change(x, 1, w))
    named = {f"lag_{n}": lag(x, n, w) for n in (1, 3, 6, 12)} | {f"ma_{n}": rolling(F.avg, x, n, w, 1) for n in (3, 6, 12)} | {"pct_12": pct_change(x, 12, w)} | {f"vol_{n}": rolling(F.stddev_samp, F.col("pct_1"), n, w, 2) for n in (3, 12)}
    out = out.withColumns(named)
    names = ["pct_1", *named]
    return out.groupBy(time).pivot(id_col, ids).agg(F.first(value).alias("value"), *[F.first(n).alias(n) for n in names])


def exogenous_profile(panel: DataFrame, columns: list[str], steps: list[int] = (1, 3, 6, 12)) -> DataFrame:
    """Changes, lags, means and deviations of each exogenous column."""
    for c in columns:
        x = F.col(c)
        panel = panel.withColumns({f"{c}_pct_change": pct_change(x, 1, over_time()), f"{c}_pct_change_yoy": pct_change(x, 12, over_time())} | {f"{c}_lag_{n}": lag(x, n, over_time()) for n in steps})
        panel = panel.withColumns({f"{c}_ma_{n}": rolling(F.avg, x, n, over_time(), 1) for n in (3, 6, 12)} | {f"{c}_std_{n}": rolling(F.stddev_samp, x, n, over_time(), 1) for n in (3, 6, 12)})
    return panel


def impute(panel: DataFrame, col: str, keys: list[str] = ("unique_id",), back: bool = False, time: str = "ds") -> Column:
    """Carried forward, then (if asked; it sees the future) backward, then the median of the series."""
    from .windows import backward_fill, newest_first

    w = over_time(list(keys), time)
    x = F.col(col)
    parts = [forward_fill(x, w)] + ([backward_fill(x, w, newest_first(list(keys), time))] if back else [])
    return F.coalesce(*parts, F.median(x).over(Window.partitionBy(*keys)))


def economic(wide: DataFrame, sales: Column, prices: Column, rates: Column, mood: Column, unemployment: Column) -> DataFrame:
    """Real sales, rate pressure, consumer health, its weighted index, and interactions."""
    w = Window.orderBy("ds") if "unique_id" not in wide.columns else over_time()
    inflation = F.coalesce(pct_change(prices, 1, w), F.lit(0.0))
    return wide.withColumns(
        {
            "real_sales": safe_div(sales, prices / 100),
            "rate_pressure": rates - inflation,
            "consumer_health": safe_div(mood, 1 + unemployment),
            "health_index": 0.3 * sales + 0.3 * mood + 0.4 * unemployment,
            "rate_x_december": rates * (F.month("ds") == 12).cast("int"),
            "unemployment_x_summer": unemployment * F.month("ds").isin(6, 7, 8).cast("int"),
        }
    )
