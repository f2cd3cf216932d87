"""Principal components and feature scores, from sums over all rows."""

from __future__ import annotations

from itertools import combinations_with_replacement

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def covariances(table: DataFrame, names: list[str]) -> DataFrame:
    """a, b, n, covariance (sample) of each pair of columns, a column with itself included: one pass, over rows without nulls in names."""
    rows = table.dropna(subset=names)
    pairs = list(combinations_with_replacement(names, 2))
    held = rows.agg(F.count(F.lit(1)).alias("n"), *(F.covar_samp(a, b).alias(f"c{i}") for i, (a, b) in enumerate(pairs)))
    told = [F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"c{i}").alias("covariance")) for i, (a, b) in enumerate(pairs)]
    return held.select("n", F.explode(F.array(*told)).alias("x")).select("x.a", "x.b", "n", "x.covariance")


def components(table: DataFrame, names: list[str], k: int = 2, scaled: bool = True) -> tuple[np.ndarray, np.ndarray, dict[str, tuple[float, float]]]:
    """Directions (rows, each with its largest part positive), their shares of the variance, and mean and scale of each column.

    Only the covariances, a number for each pair of columns, come to the driver. A column without variation has scale 1.
    """
    rows = table.dropna(subset=names)
    found = {(r.a, r.b): r.covariance for r in covariances(rows, names).collect()}
    if any(v is None for v in found.values()):
        raise ValueError("needs two rows without nulls")
    cov = np.array([[found.get((a, b), found.get((b, a))) for b in names] for a in names])
    means = rows.agg(*(F.avg(c).alias(f"m{i}") for i, c in enumerate(names))).first()
    scale = np.sqrt(np.where(np.diag(cov) > 0, np.diag(cov), 1.0)) if scaled else np.ones(len(names))
    values, vectors = np.linalg.eigh(cov / np.outer(scale, scale))
    order = np.argsort(-values, kind="stable")[:k]
    ways = vectors[:, order].T
    ways *= np.sign(ways[np.arange(len(ways)), np.abs(ways).argmax(1)])[:, None]
    return ways, values[order] / values.sum(), {c: (float(m), float(s)) for c, m, s in zip(names, means, scale, strict=True)}


def project(table: DataFrame, names: list[str], ways: np.ndarray, scales: dict[str, tuple[float, float]]) -> DataFrame:
    """table with pc_1, pc_2 and so on; null where a column is null."""
    centred = [(F.col(c) - scales[c][0]) / scales[c][1] for c in names]
    return table.withColumns({f"pc_{i + 1}": sum((x * float(w) for x, w in zip(centred, way, strict=True)), F.lit(0.0)) for i, way in enumerate(ways)})


def f_scores(table: DataFrame, names: list[str], target: str) -> DataFrame:
    """feature, n, r, f: the F statistic of a straight line from each feature to the target, over rows where both are there; null without variation or at a perfect fit."""
    both = lambda c: F.when(F.col(c).isNotNull() & F.col(target).isNotNull(), F.col(c))
    pair = lambda c: (F.when(both(c).isNotNull(), F.col(target)), both(c))
    line = lambda c: F.try_divide(F.covar_pop(*pair(c)), F.sqrt(F.var_pop(pair(c)[0]) * F.var_pop(pair(c)[1])))
    held = table.agg(*(x for i, c in enumerate(names) for x in (line(c).alias(f"r{i}"), F.count(both(c)).alias(f"n{i}"))))
    rows = held.select(F.explode(F.array(*(F.struct(F.lit(c).alias("feature"), F.col(f"n{i}").alias("n"), F.col(f"r{i}").alias("r")) for i, c in enumerate(names)))).alias("x")).select("x.*")
    r2 = F.col("r") * F.col("r")
    return rows.select("feature", "n", "r", F.when(F.col("n") > 2, F.try_divide(r2 * (F.col("n") - 2), 1 - r2)).alias("f"))


def mutual_information(table: DataFrame, names: list[str], target: str, bins: int = 8) -> DataFrame:
    """feature, n, information (nats) between each feature and the target, both cut into so many bins of equal width between their ends.

    Counts by (feature, bin, bin) are all that is shuffled, bins * bins for each
    feature. Rows where either is null are left out; a column without variation has one bin.
    """
    long = table.select(F.col(target).cast("double").alias("t"), F.explode(F.array(*(F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("v")) for c in names))).alias("x"))
    long = long.select("x.feature", "x.v", "t").where("v is not null and t is not null")
    ends = long.groupBy("feature").agg(*(f(c).alias(f"{n}_{c}") for c in ("v", "t") for n, f in (("low", F.min), ("high", F.max))))
    cell = lambda c: F.when(F.col(f"high_{c}") == F.col(f"low_{c}"), 0).otherwise(F.least(F.lit(bins - 1), F.floor((F.col(c) - F.col(f"low_{c}")) / (F.col(f"high_{c}") - F.col(f"low_{c}")) * bins)))
    counts = long.join(F.broadcast(ends), "feature").groupBy("feature", cell("v").alias("a"), cell("t").alias("b")).agg(F.count(F.lit(1)).alias("c"))
    over = lambda *k: F.sum("c").over(Window.partitionBy("feature", *k))
    told = counts.withColumns({"ca": over("a"), "cb": over("b"), "all": over()})
    part = F.col("c") / F.col("all") * F.ln(F.col("c") * F.col("all") / (F.col("ca") * F.col("cb")))
    return told.groupBy("feature").agg(F.max("all").alias("n"), F.greatest(F.lit(0.0), F.sum(part)).alias("information"))
