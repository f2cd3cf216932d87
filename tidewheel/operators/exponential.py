"""Exponential smoothing with its form found for every series at once.

A form is an error (A, M), a trend (N, A, Ad) and a season (N, A, M); forms of
an additive error and a multiplicative season are left out, as their variance
is not bounded. Each (series, form) is a row, dealt over tasks; a task fits the
rows of one form together, as the recursion is worked out for all of them and
for all points of their simplexes at each step. The form of least AICc is a
series' own.

Smoothing weights and the first level and slope are searched by a downhill
simplex over the Gaussian likelihood; the first season is that of a
decomposition of the first years. All of these count as parameters. A season
that grows while the level does not is none of the forms; models.ets followed
one such made-up series better (MASE 2.9 over a year, against 6.6 here).

Edge cases. Null values are left out. A series of fewer than two seasons and
six values, or of one value throughout, has a status and null forecasts;
multiplicative forms need values above 0. Of equal AICc the first in the order
of FORMS is taken. An empty panel gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .lineage import settled
from .reshape import horizon
from .search import simplex

SEASON = 12
LEAST = 2 * SEASON + 6
#: Fits a task gets.
FITS_A_TASK = 60
FORMS = [(e, t, s) for e in "AM" for t in ("N", "A", "Ad") for s in "NAM" if (e, s) != ("A", "M")]
_FITTED = "unique_id string, form string, k int, aicc double, log_lik double, x array<double>, level double, slope double, season array<double>"


def _first_season(y: np.ndarray, kind: str) -> np.ndarray:
    """Season of a decomposition of the first three years (or two), zero or one on the mean."""
    y = y[: 3 * SEASON] if len(y) >= 3 * SEASON else y
    ends = np.concatenate([[0.5], np.ones(SEASON - 1), [0.5]]) / SEASON
    trend = np.convolve(y, ends, "valid")
    inner = y[SEASON // 2 : SEASON // 2 + len(trend)]
    away = inner / trend if kind == "M" else inner - trend
    month = (np.arange(len(away)) + SEASON // 2) % SEASON
    season = np.array([away[month == m].mean() if (month == m).any() else float(kind == "M") for m in range(SEASON)])
    return season / season.mean() if kind == "M" else season - season.mean()


def beginnings(y: np.ndarray, form: tuple[str, str, str]) -> tuple[float, float, np.ndarray]:
    """First level, slope and season: a line through the first year, without its season."""
    season = _first_season(y, form[2]) if form[2] != "N" else np.zeros(SEASON)
    plain = y[:SEASON] / season if form[2] == "M" else y[:SEASON] - season
    slope, level = np.polyfit(np.arange(1, len(plain) + 1), plain, 1)
    return (float(level) if form[1] != "N" else float(plain.mean())), (float(slope) if form[1] != "N" else 0.0), season


def weights(x: np.ndarray, form: tuple[str, str, str]) -> tuple[np.ndarray, ...]:
    """alpha, beta, gamma, phi of points x (logits), then the first level's and slope's moves."""
    sig = lambda v: 0.5 + 0.5 * np.tanh(v / 2)
    columns, zero = iter(x.T), np.zeros(len(x))
    alpha = 0.0001 + 0.9998 * sig(next(columns))
    beta = alpha * sig(next(columns)) if form[1] != "N" else zero
    gamma = (1 - alpha) * sig(next(columns)) if form[2] != "N" else zero
    phi = 0.8 + 0.18 * sig(next(columns)) if form[1] == "Ad" else zero + 1
    return alpha, beta, gamma, phi, next(columns), next(columns) if form[1] != "N" else zero


def dimensions(form: tuple[str, str, str]) -> int:
    return 2 + 2 * (form[1] != "N") + (form[2] != "N") + (form[1] == "Ad")


def smoothed(y: np.ndarray, x: np.ndarray, form: tuple[str, str, str], level: np.ndarray, slope: np.ndarray, season: np.ndarray, scale: np.ndarray):
    """Log likelihood, last level and slope, and seasons of the recursion over rows of y (NaN behind the last)."""
    error, trend, kind = form
    alpha, beta, gamma, phi, up, tilt = weights(x, form)
    l, b, s = level + scale * up, slope + scale / SEASON * tilt, season.copy()
    squares, logs, n = np.zeros(len(y)), np.zeros(len(y)), (~np.isnan(y)).sum(1)
    for t in range(y.shape[1]):
        on = ~np.isnan(y[:, t])
        at = t % SEASON
        base = l + phi * b
        mean = base * s[:, at] if kind == "M" else base + s[:, at]
        e = np.where(on, y[:, t] - mean, 0.0)
        if error == "M":
            e = e / mean
            logs += np.where(on, np.log(np.abs(mean)), 0.0)
        squares += e * e
        # what a unit of error adds to level and slope, and to the season
        size = (base if kind != "A" else mean) if error == "M" else 1.0
        l = np.where(on, base + alpha * size * e, l)
        b = np.where(on, phi * b + beta * size * e, b)
        if kind == "A":
            s[:, at] += gamma * size * e
        elif kind == "M":
            s[:, at] *= 1 + gamma * e
    return -0.5 * n * (np.log(2 * np.pi * squares / n) + 1) - logs, l, b, s


def parameters(form: tuple[str, str, str]) -> int:
    """Weights, first states and the variance."""
    return 3 + 2 * (form[1] != "N") + (form[1] == "Ad") + (form[2] != "N") * (1 + SEASON - 1)


def fit(y: np.ndarray, form: tuple[str, str, str]) -> tuple[np.ndarray, np.ndarray, list]:
    """Points of greatest likelihood of one form for rows of y, these likelihoods, and what the recursions begin with."""
    starts = [beginnings(r[~np.isnan(r)], form) for r in y]
    level, slope = (np.array([s[i] for s in starts]) for i in (0, 1))
    season, scale = np.array([s[2] for s in starts]), np.nanstd(y, 1)

    def loss(x: np.ndarray, which: np.ndarray) -> np.ndarray:
        return -smoothed(y[which], x, form, level[which], slope[which], season[which], scale[which])[0]

    first = [-1.0] + [-2.0] * (form[1] != "N") + [-2.0] * (form[2] != "N") + [1.0] * (form[1] == "Ad") + [0.0] * (1 + (form[1] != "N"))
    x, value = simplex(loss, np.tile(first, (len(y), 1)))
    return x, -value, starts


def _laid(values: pd.Series) -> np.ndarray:
    y = np.full((len(values), max(map(len, values))), np.nan)
    for i, v in enumerate(values):
        y[i, : len(v)] = v
    return y


def _fits(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        for number, part in batch.groupby("number"):
            form = FORMS[number]
            y, k = _laid(part["y"]), parameters(form)
            x, likelihood, starts = fit(y, form)
            n = (~np.isnan(y)).sum(1)
            score = np.where(n > k + 1, -2 * likelihood + 2 * k + 2 * k * (k + 1) / np.maximum(n - k - 1, 1), np.inf)
            score = np.where(np.isfinite(score) & (likelihood > -1e299), score, np.inf)
            level, slope, season = zip(*starts, strict=True)
            yield pd.DataFrame({"unique_id": part["unique_id"], "form": ",".join(form), "k": k, "aicc": score, "log_lik": likelihood, "x": list(x), "level": level, "slope": slope, "season": season})


def _ahead(row: pd.Series, h: int) -> np.ndarray:
    form = tuple(row["form"].split(","))
    y, x = np.asarray(row["y"], "f8")[None], np.asarray(row["x"], "f8")[None]
    _, level, slope, season = smoothed(y, x, form, np.array([row["level"]]), np.array([row["slope"]]), np.asarray(row["season"], "f8")[None].copy(), np.std(y, axis=1))
    reach = np.cumsum(weights(x, form)[3][0] ** np.arange(1, h + 1)) if form[1] != "N" else np.zeros(h)
    base, own = level[0] + slope[0] * reach, season[0, (y.shape[1] + np.arange(h)) % SEASON]
    return base * own if form[2] == "M" else base + own


def forms(panel: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Every form's fit (unique_id, form, k, aicc, log_lik and its parameters), and the series (unique_id, n, y, flat, low)."""
    listed = F.transform(F.array_sort(F.collect_list(F.struct("ds", F.col("y").cast("double").alias("y")))), lambda v: v["y"])
    series = panel.where("y is not null").groupBy("unique_id").agg(listed.alias("y"), F.count(F.lit(1)).alias("n"), F.min("y").alias("low"), (F.min("y") == F.max("y")).alias("flat"))
    series = settled(series)
    kinds = F.explode(F.array(*(F.struct(F.lit(i).alias("number"), F.lit("M" in (f[0], f[2])).alias("above")) for i, f in enumerate(FORMS)))).alias("f")
    rows = series.where((F.col("n") >= LEAST) & ~F.col("flat")).select("unique_id", "y", "low", kinds).where("low > 0 or not f.above").select("unique_id", "y", "f.number")
    tasks = max(1, series.count() * len(FORMS) // FITS_A_TASK)
    return rows.repartition(max(tasks, len(FORMS)), "number", F.xxhash64("unique_id") % 64).mapInPandas(_fits, _FITTED), series


def auto_ets(panel: DataFrame, h: int = 12) -> DataFrame:
    """unique_id, step, ds, yhat, model (error, trend, season), aicc, log_lik, status."""
    fits, series = forms(panel)
    place = F.array_position(F.array(*(F.lit(",".join(f)) for f in FORMS)), F.col("form"))
    best = fits.where(F.col("aicc") < float("inf")).groupBy("unique_id").agg(F.min(F.struct("aicc", place.alias("place"), "form", "log_lik", "x", "level", "slope", "season")).alias("b"))
    best = settled(best.select("unique_id", "b.*").join(series.select("unique_id", "y"), "unique_id"))

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(r["unique_id"], k + 1, float(v)) for _, r in batch.iterrows() for k, v in enumerate(_ahead(r, h))]
            yield pd.DataFrame(rows, columns=["unique_id", "step", "yhat"])

    told = best.select("unique_id", F.concat(F.lit("ETS("), "form", F.lit(")")).alias("model"), "aicc", "log_lik")
    ahead = best.mapInPandas(work, "unique_id string, step int, yhat double").join(told, "unique_id")
    steps = horizon(panel.where("y is not null"), h).join(ahead, ["unique_id", "step"], "left").join(series.select("unique_id", "n", "flat"), "unique_id", "left")
    status = F.when(F.col("yhat").isNotNull(), "ok").when(F.col("n") < LEAST, f"needs {LEAST} values").when(F.col("flat"), "needs values that differ").otherwise("no form could be fitted")
    return steps.select("unique_id", "step", "ds", "yhat", "model", "aicc", "log_lik", status.alias("status"))
