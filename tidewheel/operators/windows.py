"""Time-series window expressions: one window specification, stacked in stages.

All expressions take w, a window partitioned by series and ordered by time, so
that a whole stage of them compiles to one Window node without a new shuffle.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from ..functions.scalars import safe_div


def newest_first(keys: str | list[str] = "unique_id", time: str = "ds") -> WindowSpec:
    return Window.partitionBy(*([keys] if isinstance(keys, str) else keys)).orderBy(F.desc(time))


def over_time(keys: str | list[str] = "unique_id", time: str = "ds") -> WindowSpec:
    return Window.partitionBy(*([keys] if isinstance(keys, str) else keys)).orderBy(time)


def lag(x: Column, n: int, w: WindowSpec) -> Column:
    return F.lag(x, n).over(w)


def diff(x: Column, n: int, w: WindowSpec) -> Column:
    return x - lag(x, n, w)


def pct_change(x: Column, n: int, w: WindowSpec) -> Column:
    """Relative change over n rows; gaps are not filled first."""
    return safe_div(x, lag(x, n, w)) - 1


def log_change(x: Column, n: int, w: WindowSpec) -> Column:
    ln = F.when(x > 0, F.ln(x))
    return ln - lag(ln, n, w)


def rolling(agg: Callable[[Column], Column], x: Column, n: int, w: WindowSpec, min_periods: int | None = None, shift: int = 0) -> Column:
    """agg of the last n rows, null under min_periods (n by default) values; shift 1 leaves the present row out."""
    frame = w.rowsBetween(-(n - 1) - shift, -shift)
    least = n if min_periods is None else min_periods
    value = agg(x).over(frame)
    return value if least <= 1 else F.when(F.count(x).over(frame) >= least, value)


def zscore(x: Column, n: int, w: WindowSpec, min_periods: int | None = None) -> Column:
    least = n // 2 if min_periods is None else min_periods
    return safe_div(x - rolling(F.avg, x, n, w, least), rolling(F.stddev_samp, x, n, w, least))


def rolling_rank(x: Column, n: int, w: WindowSpec, min_periods: int | None = None) -> Column:
    """Share of the last n values up to the present one, equal ones at their mean rank."""
    least = n // 2 if min_periods is None else min_periods
    frame = F.collect_list(x).over(w.rowsBetween(-(n - 1), 0))
    under = F.size(F.filter(frame, lambda v: v < x))
    equal = F.size(F.filter(frame, lambda v: v == x))
    return F.when(x.isNotNull() & (F.size(frame) >= least), (under + (equal + 1) / 2) / F.size(frame))


def total_rank(x: Column, keys: list[str]) -> Column:
    """Share of all values of the series up to this one, equal ones at their mean rank."""
    whole, same = Window.partitionBy(*keys), Window.partitionBy(*keys, x)
    place = F.rank().over(whole.orderBy(x.asc_nulls_last()))
    return F.when(x.isNotNull(), (place + (F.count(x).over(same) - 1) / 2) / F.count(x).over(whole))


def forward_fill(x: Column, w: WindowSpec) -> Column:
    return F.last(x, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))


def backward_fill(x: Column, w: WindowSpec, newest_first: WindowSpec | None = None) -> Column:
    """Values of the future: not for model inputs.

    newest_first: the same window in descending order, along which the value is
    carried forward in one pass; without it each row looks through the rest of
    its series.
    """
    if newest_first is not None:
        return forward_fill(x, newest_first)
    return F.first(x, ignorenulls=True).over(w.rowsBetween(0, Window.unboundedFollowing))


def interpolate(x: Column, w: WindowSpec, time: Column, newest_first: WindowSpec | None = None) -> Column:
    """Straight line by days between the values before and after a gap. newest_first: as with backward_fill."""
    held = F.when(x.isNotNull(), time)
    a, b = forward_fill(x, w), backward_fill(x, w, newest_first)
    t, u = forward_fill(held, w), backward_fill(held, w, newest_first)
    return F.coalesce(x, a + (b - a) * safe_div(F.datediff(time, t).cast("double"), F.datediff(u, t).cast("double")))


def smooth(x: Column, w: WindowSpec, sigma: float = 1.5, reach: int = 6) -> Column:
    """Gaussian weights around a row, over the rows that are there."""
    from math import exp

    top, below = F.lit(0.0), F.lit(0.0)
    for k in range(-reach, reach + 1):
        value, weight = (x if k == 0 else F.lag(x, -k).over(w)), exp(-k * k / (2 * sigma * sigma))
        top, below = top + F.coalesce(value * weight, F.lit(0.0)), below + F.when(value.isNotNull(), weight).otherwise(0.0)
    return safe_div(top, below)


def with_ema(df: DataFrame, col: str, span: int, out: str, keys: list[str], time: str) -> DataFrame:
    """out: the exponential mean of col with weight 2 / (span + 1), begun at the first value.

    Sums of weighted values run inside blocks of rows so long that what came
    before the block before has no weight left in a double; so no series is
    too long, and no row is touched twice.
    """
    a = 2.0 / (span + 1)
    size = int(40 / a) + 1
    w = over_time(keys, time)
    own = df.withColumn("_t", F.row_number().over(w) - 1)
    own = own.withColumn("_b", F.floor(F.col("_t") / size)).withColumn("_u", F.col("_t") % size)
    weight = F.when(F.col("_t") == 0, 1.0).otherwise(a)
    block = Window.partitionBy(*keys, "_b").orderBy(time)
    own = own.withColumn("_local", F.pow(F.lit(1 - a), "_u") * F.sum(weight * F.col(col) * F.pow(F.lit(1 - a), -F.col("_u"))).over(block))
    own = own.withColumn("_before", F.lag("_local").over(w)).withColumn("_carry", F.first("_before").over(block))
    value = F.col("_local") + F.coalesce(F.pow(F.lit(1 - a), F.col("_u") + 1) * F.col("_carry"), F.lit(0.0))
    return own.withColumn(out, value).drop("_t", "_b", "_u", "_local", "_before", "_carry")


def enough(x: Column, n: int, keys: list[str]) -> Column:
    """x where its series has n rows or more."""
    return F.when(F.count(F.lit(1)).over(Window.partitionBy(*keys)) >= n, x)
