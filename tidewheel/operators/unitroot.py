"""Augmented Dickey-Fuller test of every series: sums by Spark, small systems by row."""

from __future__ import annotations

from collections.abc import Iterator
from math import erf

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .windows import over_time

# The response surface of the test's p-value with a constant (its ends, where its two parts meet, and their polynomials).
_LOW, _HIGH, _MEET = -18.83, 2.74, -1.61
_SMALL, _LARGE = (2.1659, 1.4412, 0.038269), (1.7339, 0.93202, -0.12745, -0.010368)


def p_value(t: float) -> float:
    if t >= _HIGH:
        return 1.0
    if t <= _LOW:
        return 0.0
    z = sum(c * t**k for k, c in enumerate(_SMALL if t <= _MEET else _LARGE))
    return 0.5 * (1 + erf(z / 2**0.5))


def regression(sums: np.ndarray, lags: int, n: int) -> tuple[float, float]:
    """The t of the level and the AIC, from sums of products of 1, the level, the lagged differences and (last) the difference."""
    used = [0, 1, *range(2, 2 + lags)]
    a, b, yy = sums[np.ix_(used, used)], sums[used, -1], sums[-1, -1]
    scale = np.sqrt(np.diag(a))
    if not (scale > 0).all() or n <= len(used) + 1:
        return np.nan, np.inf
    inverse = np.linalg.pinv(a / np.outer(scale, scale), rcond=1e-13, hermitian=True) / np.outer(scale, scale)
    weights = inverse @ b
    rest = float(yy - weights @ b)
    if rest <= 1e-12 * max(yy, 1e-300):
        return np.nan, np.inf
    return float(weights[1] / np.sqrt(rest / (n - len(used)) * inverse[1, 1])), n * np.log(rest / n) + 2 * len(used)


def dickey_fuller(panel: DataFrame, most: int = 12) -> DataFrame:
    """unique_id, n, lags, statistic, p_value, stationary (at 5 percent).

    The difference is regressed on a constant, the level before and up to most
    lagged differences; how many is chosen by AIC, all of them on the same
    rows. Only sums of products leave the series, one row each, so no task
    holds a series. Values are taken about the series' mean, which changes
    nothing but rounding. Null values are left out. Series of too few rows for
    any choice, or without variation, have null results.
    """
    w = over_time()
    rows = panel.where("y is not null").select("unique_id", "ds", (F.col("y") - F.avg("y").over(Window.partitionBy("unique_id"))).alias("y"))
    rows = rows.withColumn("x1", F.lag("y").over(w)).withColumn("d", F.col("y") - F.col("x1"))
    names = ["x0", "x1", *(f"x{k + 1}" for k in range(1, most + 1)), "d"]
    rows = rows.withColumns({"x0": F.lit(1.0)} | {f"x{k + 1}": F.lag("d", k).over(w) for k in range(1, most + 1)})
    whole = rows.where(F.col(f"x{most + 1}").isNotNull() if most else F.col("d").isNotNull())
    pairs = [(i, j) for i in range(len(names)) for j in range(i, len(names))]
    sums = whole.groupBy("unique_id").agg(F.count(F.lit(1)).alias("n"), F.array(*(F.sum(F.col(names[i]) * F.col(names[j])) for i, j in pairs)).alias("sums"))

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for key, n, values in zip(batch["unique_id"], batch["n"], batch["sums"], strict=True):
                table = np.zeros((len(names), len(names)))
                for (i, j), v in zip(pairs, values, strict=True):
                    table[i, j] = table[j, i] = v
                tried = [regression(table, k, int(n)) for k in range(most + 1)]
                k = int(np.argmin([a for _, a in tried]))
                t = tried[k][0]
                out.append((key, n, None, None, None) if np.isnan(t) else (key, n, k, t, p_value(t)))
            yield pd.DataFrame(out, columns=["unique_id", "n", "lags", "statistic", "p_value"]).astype({"lags": "Int32", "statistic": "Float64", "p_value": "Float64"})

    found = sums.mapInPandas(work, "unique_id string, n bigint, lags int, statistic double, p_value double")
    every = panel.select("unique_id").distinct().join(found, "unique_id", "left")
    return every.select("unique_id", F.coalesce("n", F.lit(0)).alias("n"), "lags", "statistic", "p_value", (F.col("p_value") < 0.05).alias("stationary"))
