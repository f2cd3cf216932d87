"""Seasonal ARIMA with its orders found for every series at once.

Differences come from the data by DataFrame functions: a seasonal one if the
seasonal strength (one less the remainder's share of the variance of season
and remainder) is above STRENGTH, then plain ones until the KPSS statistic is
below its 5 percent point, two at most. Orders come from a stepwise search in
rounds: a round is a table of (series, order) not yet tried, dealt over tasks
and fitted there; the least AICc of a series is its best, whose neighbours are
the next round; a series without new neighbours is done. Fits of one order are
batched: each step of the filter is worked out for all of them, and for all
points that the optimiser asks for, together.

The likelihood is exact: the prediction errors and their variances of a Kalman
filter over the ARMA state, started from its stationary distribution. As that
start makes the change of the state's covariance a matrix of rank one, the
filter carries vectors only. AR and MA polynomials are built from partial
autocorrelations, so every point asked for is stationary and invertible; fits
with one beyond EDGE are not chosen.

Edge cases. Null values are left out, so a series is its values in order. A
series of fewer than LEAST values, or of one value throughout, has a status
and null forecasts. Of orders with equal AICc the one of fewer parameters, then
the smaller by (p, q, P, Q), is chosen. An empty panel gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .reshape import horizon
from .lineage import settled
from .search import quasi_newton
from .windows import over_time

SEASON = 12
#: The bounds of the seasonal strength and of the KPSS statistic (5 percent, level), and the lags that its variance looks back on at most.
STRENGTH, KPSS, LAGS = 0.64, 0.463, 12
#: Largest orders, least values, and the partial autocorrelation beyond which a fit is at the edge.
MOST, MOST_SEASONAL, LEAST, EDGE = 5, 2, 2 * SEASON + 6, 0.99
#: Fits a task gets, and rounds of the search.
FITS_A_TASK, ROUNDS = 24, 40

ORDER = ["p", "q", "sp", "sq", "c"]
_NORMAL95 = 1.959963984540054


# --- differences, by DataFrame functions -------------------------------------------------------------------------------


def seasonal_strength(rows: DataFrame) -> DataFrame:
    """unique_id, strength of rows (unique_id, i, y): classical decomposition, the trend a centred mean over a year."""
    w = Window.partitionBy("unique_id").orderBy("i")
    half = lambda a, b: F.avg("y").over(w.rowsBetween(a, b))
    inside = (F.col("i") >= SEASON // 2) & (F.col("i") < F.col("n") - SEASON // 2)
    kept = rows.withColumn("away", F.when(inside, F.col("y") - (half(-6, 5) + half(-5, 6)) / 2)).where(inside)
    season = F.avg("away").over(Window.partitionBy("unique_id", F.col("i") % SEASON))
    parts = kept.withColumn("rest", F.col("away") - season)
    share = F.try_divide(F.var_samp("rest"), F.var_samp("away"))
    return parts.groupBy("unique_id").agg(F.greatest(F.lit(0.0), 1 - share).alias("strength"))


def kpss(rows: DataFrame) -> DataFrame:
    """unique_id, kpss of rows (unique_id, i, z): level stationarity, Bartlett weights over 3 * sqrt(n) / 13 lags."""
    part = Window.partitionBy("unique_id")
    w = part.orderBy("i")
    e = rows.withColumn("e", F.col("z") - F.avg("z").over(part)).withColumn("m", F.count("z").over(part))
    upto = e.withColumn("s", F.sum("e").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    lagged = upto.select("unique_id", "m", "e", "s", *(F.lag("e", j).over(w).alias(f"e{j}") for j in range(1, LAGS + 1)))
    sums = lagged.groupBy("unique_id", "m").agg(F.sum(F.col("s") * F.col("s")).alias("ss"), F.sum(F.col("e") * F.col("e")).alias("g0"), *(F.sum(F.col("e") * F.col(f"e{j}")).alias(f"g{j}") for j in range(1, LAGS + 1)))
    lags = F.least(F.lit(LAGS), F.floor(3 * F.sqrt("m") / 13))
    weights = [F.when(F.lit(j) <= lags, (1 - j / (lags + 1)) * F.coalesce(F.col(f"g{j}"), F.lit(0.0))).otherwise(0.0) for j in range(1, LAGS + 1)]
    variance = F.col("g0") + 2 * sum(weights, F.lit(0.0))
    return sums.select("unique_id", F.try_divide(F.col("ss"), F.col("m") * variance).alias("kpss"))


def differences(panel: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Orders (unique_id, n, strength, sd, kpss0, kpss1, d), and values (unique_id, i, y, z): z is y differenced so often, null at the beginning."""
    w = over_time()
    rows = panel.where("y is not null").select("unique_id", "ds", F.col("y").cast("double").alias("y"))
    rows = rows.select("unique_id", (F.row_number().over(w) - 1).alias("i"), F.count("y").over(Window.partitionBy("unique_id")).alias("n"), "y")
    strong = rows.select("unique_id", "n").distinct().join(seasonal_strength(rows), "unique_id", "left")
    strong = strong.withColumn("sd", F.when((F.col("strength") > STRENGTH) & (F.col("n") >= 3 * SEASON), 1).otherwise(0))
    at = Window.partitionBy("unique_id").orderBy("i")
    z0 = F.when(F.col("sd") == 1, F.col("y") - F.lag("y", SEASON).over(at)).otherwise(F.col("y"))
    held = rows.join(strong.select("unique_id", "sd"), "unique_id").withColumn("z0", z0)
    held = held.withColumn("z1", F.col("z0") - F.lag("z0").over(at)).withColumn("z2", F.col("z1") - F.lag("z1").over(at))
    told = strong
    for k in (0, 1):
        told = told.join(kpss(held.where(f"z{k} is not null").select("unique_id", "i", F.col(f"z{k}").alias("z"))).withColumnRenamed("kpss", f"kpss{k}"), "unique_id", "left")
    unsure = lambda c: F.coalesce(F.col(c) >= KPSS, F.lit(False))
    told = told.withColumn("d", F.when(~unsure("kpss0"), 0).when(~unsure("kpss1"), 1).otherwise(2))
    z = F.when(F.col("d") == 0, F.col("z0")).when(F.col("d") == 1, F.col("z1")).otherwise(F.col("z2"))
    return told, held.join(told.select("unique_id", "d"), "unique_id").select("unique_id", "i", "y", z.alias("z"))


# --- the likelihood, many fits at a time -----------------------------------------------------------------------------


def from_partial(partial: np.ndarray) -> np.ndarray:
    """Coefficients a of 1 - a1 B - ... from partial autocorrelations, row by row."""
    out = np.zeros_like(partial)
    for k in range(partial.shape[1]):
        r = partial[:, k : k + 1]
        out[:, :k] = out[:, :k] - r * out[:, :k][:, ::-1]
        out[:, k : k + 1] = r
    return out


def _product(plain: np.ndarray, seasonal: np.ndarray) -> np.ndarray:
    """Coefficients of (1 - plain)(1 - seasonal in B^SEASON), without the 1, with its sign turned."""
    n, p, s = len(plain), plain.shape[1], seasonal.shape[1]
    out = np.zeros((n, p + SEASON * s + 1))
    out[:, 0] = -1
    out[:, 1 : p + 1] = plain
    for k in range(s):
        at = SEASON * (k + 1)
        out[:, at] += seasonal[:, k]
        out[:, at + 1 : at + p + 1] -= seasonal[:, k : k + 1] * plain
    return out[:, 1:]


def polynomials(x: np.ndarray, order: tuple[int, ...]) -> tuple[np.ndarray, np.ndarray]:
    """AR and MA coefficients of points x (arctanh of partial autocorrelations, then the constant), as wide as the state."""
    p, q, sp, sq, _ = order
    cuts = np.cumsum([p, q, sp, sq])
    a, m, sa, sm = (from_partial(np.tanh(part)) for part in np.split(x[:, : cuts[-1]], cuts[:-1], axis=1))
    phi, theta = _product(a, sa), -_product(m, sm)
    r = max(phi.shape[1], theta.shape[1] + 1)
    pad = lambda c, width: np.concatenate([c, np.zeros((len(c), width - c.shape[1]))], 1)
    return pad(phi, r), pad(theta, r - 1)


def autocovariance(phi: np.ndarray, theta: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Autocovariances 0..r of an ARMA process of unit shocks, and its weights on the shocks 0..r-1."""
    n, r = phi.shape
    ma = np.concatenate([np.ones((n, 1)), theta], 1)
    psi = np.zeros((n, r))
    for j in range(r):
        psi[:, j] = ma[:, j] + (phi[:, :j] * psi[:, :j][:, ::-1]).sum(1)
    right = np.zeros((n, r + 1))
    for k in range(r):
        right[:, k] = (ma[:, k:] * psi[:, : r - k]).sum(1)
    # row k says: autocovariance k less phi_i times autocovariance |k - i|, which is m for i = k - m and for i = k + m
    k, m = np.indices((r + 1, r + 1))
    known = np.concatenate([np.zeros((n, 1)), phi, np.zeros((n, 1))], 1)
    below, above = np.where(k > m, k - m, 0), np.where((m > 0) & (k + m <= r), k + m, 0)
    left = np.eye(r + 1) - known[:, below] - known[:, above]
    return np.linalg.solve(left, right[:, :, None])[:, :, 0], psi


def filtered(phi: np.ndarray, theta: np.ndarray, z: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sum of squared errors over their variances, sum of the variances' logarithms, and the state ahead; z: rows of values, NaN behind the last."""
    n, r = phi.shape
    gamma, psi = autocovariance(phi, theta)
    ma = np.concatenate([np.ones((n, 1)), theta], 1)
    start = np.stack([(phi[:, j:] * gamma[:, 1 : r - j + 1]).sum(1) + (ma[:, j:] * psi[:, : r - j]).sum(1) for j in range(r)], 1)
    ahead = lambda u: phi * u[:, :1] + np.concatenate([u[:, 1:], np.zeros((n, 1))], 1)
    f, gain = start[:, 0].copy(), ahead(start)
    change, scale = gain.copy(), -1 / f
    state, squares, logs = np.zeros((n, r)), np.zeros(n), np.zeros(n)
    steady = False
    for t in range(z.shape[1]):
        on = ~np.isnan(z[:, t])
        error = np.where(on, z[:, t] - state[:, 0], 0.0)
        squares += error * error / f
        logs += np.where(on, np.log(f), 0.0)
        moved = ahead(state) + gain * (error / f)[:, None]
        state = np.where(on[:, None], moved, state)
        if not steady:
            u, first = ahead(change), change[:, 0].copy()
            part = scale * first
            gain = gain + u * part[:, None]
            new = f + part * first
            change = u - gain * (first / new)[:, None]
            scale, f = scale * new / f, new
            steady = bool((np.abs(scale[:, None] * change * change) < 1e-14 * f[:, None]).all())
    return squares, logs, state


def log_likelihood(phi: np.ndarray, theta: np.ndarray, z: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Log likelihood at the best shock variance, and that variance."""
    m = (~np.isnan(z)).sum(1)
    squares, logs, _ = filtered(phi, theta, z)
    variance = squares / m
    return -0.5 * (m * (np.log(2 * np.pi * variance) + 1) + logs), variance


def fit(z: np.ndarray, order: tuple[int, ...]) -> tuple[np.ndarray, np.ndarray]:
    """Points of greatest likelihood of one order for rows of z, and these likelihoods; the better of two starts."""
    p, q, sp, sq, c = order
    centre = np.nanmean(z, 1) if c else np.zeros(len(z))
    scale = np.nanstd(z, 1)

    def loss(x: np.ndarray, which: np.ndarray) -> np.ndarray:
        own = z[which] - (centre[which] + scale[which] * x[:, -1] if c else 0 * centre[which])[:, None]
        return -log_likelihood(*polynomials(x, order), own)[0]

    starts = [np.repeat([[a, b, a, b, 0.0]], len(z), 0).repeat([p, q, sp, sq, c], axis=1) for a, b in ((0.1, 0.1), (0.5, -0.4))]
    got = [quasi_newton(loss, x, tol=1e-6) for x in (starts if p + q + sp + sq > 1 else starts[:1])]
    x = np.where((got[0][1] <= got[-1][1])[:, None], got[0][0], got[-1][0])
    return x, -np.minimum(got[0][1], got[-1][1])


def aicc(log_lik: np.ndarray, order: tuple[int, ...], m: np.ndarray) -> np.ndarray:
    k = sum(order) + 1
    return np.where(m > k + 1, -2 * log_lik + 2 * k + 2 * k * (k + 1) / np.maximum(m - k - 1, 1), np.inf)


def _laid(values: pd.Series) -> np.ndarray:
    z = np.full((len(values), max(map(len, values))), np.nan)
    for i, v in enumerate(values):
        z[i, : len(v)] = v
    return z


def _fits(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Every (series, order) of a batch, those of one order together."""
    for batch in batches:
        for order, part in batch.groupby(ORDER, sort=False):
            z = _laid(part["z"])
            x, likelihood = fit(z, tuple(map(int, order)))
            score = aicc(likelihood, order, (~np.isnan(z)).sum(1))
            edge = (np.abs(np.tanh(x[:, : sum(order[:4])])) > EDGE).any(1)
            score = np.where(edge | ~np.isfinite(score) | (likelihood < -1e299), np.inf, score)
            yield part[["unique_id", *ORDER]].assign(aicc=score, log_lik=likelihood, x=list(x))


_KEY = ", ".join(f"{c} int" for c in ORDER)
_FITTED = f"unique_id string, {_KEY}, aicc double, log_lik double, x array<double>"


# --- the search, in rounds -------------------------------------------------------------------------------------------


def _orders(*rows: tuple[int, ...]) -> Column:
    return F.array(*(F.struct(*(F.lit(v).alias(c) for v, c in zip(row, ORDER, strict=True))) for row in rows))


def _first(series: DataFrame) -> DataFrame:
    """The orders that a search starts from, with a constant if one difference or none was taken."""
    c = (F.col("d") + F.col("sd") <= 1).cast("int")
    known = series.select("unique_id", "d", "sd", F.explode(_orders((2, 2, 1, 1, 0), (0, 0, 0, 0, 0), (1, 0, 1, 0, 0), (0, 1, 0, 1, 0))).alias("o"))
    return known.select("unique_id", *(F.col(f"o.{k}").alias(k) for k in ORDER[:4]), c.alias("c"))


def _neighbours(best: DataFrame) -> DataFrame:
    """One or both plain orders, or one or both seasonal ones, up or down by one, or the constant the other way."""
    steps = [(a, b, 0, 0, 0) for a, b in ((1, 0), (-1, 0), (0, 1), (0, -1), (1, 1), (-1, -1), (1, -1), (-1, 1))]
    steps += [(0, 0, *s[:2], 0) for s in steps] + [(0, 0, 0, 0, 1)]
    moved = best.select("unique_id", "d", "sd", *ORDER, F.explode(_orders(*steps)).alias("o"))
    new = [(F.col(k) + F.col(f"o.{k}")).alias(k) for k in ORDER[:4]] + [F.when(F.col("o.c") == 1, 1 - F.col("c")).otherwise(F.col("c")).alias("c")]
    inside = F.lit(True)
    for k, most in zip(ORDER, (MOST, MOST, MOST_SEASONAL, MOST_SEASONAL), strict=False):
        inside &= F.col(k).between(0, most)
    return moved.select("unique_id", "d", "sd", *new).where(inside & ((F.col("c") == 0) | (F.col("d") + F.col("sd") <= 1))).select("unique_id", *ORDER)


def search(series: DataFrame) -> DataFrame:
    """The best fit of each row of series (unique_id, d, sd, z): unique_id, d, sd, z, the order, aicc, log_lik, x."""
    tried, new = None, _first(series)
    for _ in range(ROUNDS):
        new = settled(new)
        n = new.count()
        if not n and tried is not None:
            break
        dealt = new.join(series.select("unique_id", "z"), "unique_id").repartition(n // FITS_A_TASK + 1, *ORDER, F.xxhash64("unique_id") % 64)
        got = dealt.mapInPandas(_fits, _FITTED)
        tried = settled(got if tried is None else tried.unionByName(got))
        size = sum((F.col(c) for c in ORDER), F.lit(0))
        best = tried.groupBy("unique_id").agg(F.min(F.struct("aicc", size.alias("size"), *ORDER, "log_lik", "x")).alias("b")).select("unique_id", "b.*").drop("size")
        best = series.join(best, "unique_id")
        new = _neighbours(best).join(tried.select("unique_id", *ORDER), ["unique_id", *ORDER], "left_anti")
    return best


def _ahead(best: pd.DataFrame, h: int) -> list[tuple]:
    """Forecasts and the standard errors of one series, undifferenced."""
    order = tuple(int(best[c]) for c in ORDER)
    x, z, y = np.asarray(best["x"], "f8")[None], np.asarray(best["z"], "f8")[None], list(best["y"])
    centre = float(np.mean(z) + np.std(z) * x[0, -1]) if order[4] else 0.0
    phi, theta = polynomials(x, order)
    squares, _, state = filtered(phi, theta, z - centre)
    ma = np.concatenate([[1.0], theta[0]])
    taken = np.array([1.0])
    for lag in [1] * int(best["d"]) + [SEASON] * int(best["sd"]):
        taken = np.convolve(taken, np.concatenate([[1.0], np.zeros(lag - 1), [-1.0]]))
    whole = -np.convolve(np.concatenate([[1.0], -phi[0]]), taken)[1:]
    psi, out, spread = [], [], 0.0
    for k in range(h):
        y.append(centre + state[0, 0] - sum(taken[i] * y[-i] for i in range(1, len(taken))))
        psi.append((ma[k] if k < len(ma) else 0.0) + sum(whole[i] * psi[k - 1 - i] for i in range(min(k, len(whole)))))
        spread += psi[-1] ** 2
        state = phi * state[:, :1] + np.concatenate([state[:, 1:], np.zeros((1, 1))], 1)
        out.append((k + 1, float(y[-1]), float(np.sqrt(spread * squares[0] / z.shape[1]))))
    return out


def name(order: Column | None = None) -> Column:
    return F.format_string(f"(%d,%d,%d)(%d,%d,%d)[{SEASON}]%s", "p", "d", "q", "sp", "sd", "sq", F.when(F.col("c") == 1, " with constant").otherwise(""))


def auto_arima(panel: DataFrame, h: int = 12) -> DataFrame:
    """unique_id, step, ds, yhat, lower, upper (95 percent), model, aicc, log_lik, status."""
    told, values = differences(panel)
    listed = F.transform(F.array_sort(F.collect_list(F.struct("i", "y", "z"))), lambda v: F.struct(v["y"].alias("y"), v["z"].alias("z")))
    lists = values.groupBy("unique_id").agg(listed.alias("v")).select("unique_id", F.col("v.y").alias("y"), F.filter("v.z", lambda z: z.isNotNull()).alias("z"))
    lists = settled(told.join(lists, "unique_id").withColumn("flat", F.array_min("z") == F.array_max("z")))
    fit_for = (F.size("z") >= LEAST - SEASON) & (F.col("n") >= LEAST) & ~F.col("flat")
    best = search(lists.where(fit_for).select("unique_id", "d", "sd", "y", "z"))

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(r["unique_id"], *step) for _, r in batch.iterrows() for step in _ahead(r, h)]
            yield pd.DataFrame(rows, columns=["unique_id", "step", "yhat", "se"])

    found = settled(best.where(F.col("aicc") < float("inf")).withColumn("model", name()))
    ahead = found.mapInPandas(work, "unique_id string, step int, yhat double, se double").join(found.select("unique_id", "model", "aicc", "log_lik"), "unique_id")
    steps = horizon(panel.where("y is not null"), h).join(ahead, ["unique_id", "step"], "left").join(lists.select("unique_id", F.col("n") < LEAST, "flat").toDF("unique_id", "short", "flat"), "unique_id", "left")
    status = F.when(F.col("yhat").isNotNull(), "ok").when(F.col("short"), f"needs {LEAST} values").when(F.col("flat"), "needs values that differ").otherwise("no order could be fitted")
    reach = _NORMAL95 * F.col("se")
    return steps.select("unique_id", "step", "ds", "yhat", (F.col("yhat") - reach).alias("lower"), (F.col("yhat") + reach).alias("upper"), "model", "aicc", "log_lik", status.alias("status"))
