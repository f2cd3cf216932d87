"""Boosting that stops early, forests with out-of-bag scores, and recursive forecasts: trees as arrays.

A table of up to LOCAL_ROWS rows is worth no job for each level of each tree.
Its features are cut into BINS bins by quantiles that Spark finds, and trees
grow on histograms inside tasks: a boosted model in one, a forest in as many as
there are parts. Larger tables are for pyspark.ml (models.fit_trees).

Which rows a tree sees comes from a hash of the row's key and the tree's
number: a Poisson count for a forest, a yes or no for boosting. So bags depend
on no partitioning, a lost task draws the same ones again, and the rows out of
each tree's bag are known, which gives every row a prediction by the trees that
did not see it.

Boosting watches the last months of each series before the cut (a time-ordered
validation set) and stops when PATIENCE rounds have not lowered their error; it
keeps the rounds up to the lowest.

A fitted model is a list of arrays whose size its settings bound, not the data.
A recursive forecast feeds each value back: what the calendar says of the
months ahead is worked out by Spark for all of them at once, and a grouped task
carries the last two years of a series from step to step.

Edge cases. Null features are 0, rows with a null label are not fitted. Rows of
equal keys share their bags. A series of few rows is forecast from what it has.
An empty panel raises ValueError when a model is fitted, as there is none.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .lineage import settled
from .reshape import horizon
from .windows import newest_first

LOCAL_ROWS, BINS, PARTS = 50_000, 64, 8
PATIENCE, SEASON, STATE = 15, 12, 26
_TREE = "kind string, number int, feature array<int>, cut array<double>, below array<int>, above array<int>, value array<double>, key bigint, total double, times int"


@dataclass
class Tree:
    """Node i asks whether feature[i] is at most cut[i]; below[i] is where to go then, above[i] else; a leaf has feature -1."""

    feature: np.ndarray
    cut: np.ndarray
    below: np.ndarray
    above: np.ndarray
    value: np.ndarray

    def predict(self, x: np.ndarray) -> np.ndarray:
        at, rows = np.zeros(len(x), "i8"), np.arange(len(x))
        while (inner := self.feature[at] >= 0).any():
            f = np.maximum(self.feature[at], 0)
            at = np.where(inner, np.where(x[rows, f] <= self.cut[at], self.below[at], self.above[at]), at)
        return self.value[at]


@dataclass
class Ensemble:
    """base and the trees' values, each times rate, or their mean."""

    names: list[str]
    trees: list[Tree]
    base: float = 0.0
    rate: float | None = None

    def predict(self, x: np.ndarray) -> np.ndarray:
        total = sum((t.predict(x) for t in self.trees), np.zeros(len(x)))
        return total / max(len(self.trees), 1) if self.rate is None else self.base + self.rate * total


def draws(keys: np.ndarray, tree: int, seed: int) -> np.ndarray:
    """A number in [0, 1) for each key and tree."""
    with np.errstate(over="ignore"):
        h = keys.astype("i8").view("u8") ^ np.uint64(((tree + 1) * 0x9E3779B97F4A7C15 + seed * 0xD1B54A32D192ED03) & 0xFFFFFFFFFFFFFFFF)
        for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
            h = (h ^ h >> np.uint64(shift)) * np.uint64(factor)
        h ^= h >> np.uint64(31)
    return (h >> np.uint64(11)).astype("f8") / (1 << 53)


#: How likely a Poisson count of mean one is 0, up to 1, up to 2 and so on.
_POISSON = np.cumsum([np.exp(-1) / np.prod(np.arange(1, k + 1)) for k in range(12)])


def bag(keys: np.ndarray, tree: int, seed: int) -> np.ndarray:
    return np.searchsorted(_POISSON, draws(keys, tree, seed), "right").astype("f8")


def grow(bins: np.ndarray, edges: list[np.ndarray], y: np.ndarray, weight: np.ndarray, depth: int, least: int, some: int | None = None, rng: np.random.Generator | None = None) -> Tree:
    """A regression tree, level by level: at each node the cut that lowers the squared error most, at least least rows on both sides; some: features that a node may ask for."""
    n, width = bins.shape
    held = np.flatnonzero(weight > 0)
    bins, y, weight = bins[held], y[held], weight[held]
    feature, cut, below, above = [-1], [0.0], [0], [0]
    value = [float((weight * y).sum() / max(weight.sum(), 1e-12))]
    node, first = np.zeros(len(held), "i8"), 0
    for _ in range(depth):
        count = len(feature) - first
        rows = node >= first
        if count <= 0 or not rows.any():
            break
        cell = (((node[rows] - first)[:, None] * width + np.arange(width)) * BINS + bins[rows]).ravel()
        size = count * width * BINS
        sums = [np.bincount(cell, np.repeat(v[rows], width), size).reshape(count, width, BINS).cumsum(2) for v in (weight, weight * y)]
        seen = np.bincount(cell, minlength=size).reshape(count, width, BINS).cumsum(2)
        (w, s), (all_w, all_s) = (x[:, :, :-1] for x in sums), (x[:, :, -1:] for x in sums)
        fits = (seen[:, :, :-1] >= least) & (seen[:, :, -1:] - seen[:, :, :-1] >= least)
        if some is not None and some < width:
            fits &= (rng.random((count, width)).argsort(1).argsort(1) < some)[:, :, None]
        with np.errstate(all="ignore"):
            gain = np.where(fits, s * s / w + (all_s - s) ** 2 / (all_w - w) - all_s * all_s / all_w, -np.inf)
        flat = gain.reshape(count, -1)
        best = flat.argmax(1)
        splits = flat[np.arange(count), best] > 1e-12
        f, b = best // (BINS - 1), best % (BINS - 1)
        start = len(feature)
        for k in np.flatnonzero(splits):
            i = first + k
            feature[i], cut[i], below[i], above[i] = int(f[k]), float(edges[f[k]][b[k]]), len(feature), len(feature) + 1
            low_w, low_s = w[k, f[k], b[k]], s[k, f[k], b[k]]
            value += [float(low_s / low_w), float((all_s[k, 0, 0] - low_s) / (all_w[k, 0, 0] - low_w))]
            feature += [-1, -1]
            cut += [0.0, 0.0]
            below += [0, 0]
            above += [0, 0]
        here = np.flatnonzero(rows)
        k = node[here] - first
        here, k = here[splits[k]], k[splits[k]]
        node[here] = np.where(bins[here, f[k]] <= b[k], np.array(below)[first + k], np.array(above)[first + k])
        first = start
    return Tree(np.array(feature), np.array(cut), np.array(below), np.array(above), np.array(value))


def binned(x: np.ndarray, edges: list[np.ndarray]) -> np.ndarray:
    """Bin b holds the values above edge b - 1 and up to edge b."""
    return np.stack([np.searchsorted(e, x[:, j], "left") for j, e in enumerate(edges)], 1) if len(edges) else np.zeros((len(x), 0), "i8")


def boost(x: np.ndarray, y: np.ndarray, keys: np.ndarray, valid: np.ndarray, edges: list[np.ndarray], rounds: int, rate: float, depth: int, least: int, share: float, seed: int, patience: int) -> tuple[list[Tree], float, list[float]]:
    """Trees on what is left of y, its mean, and the error of the validation rows after each round."""
    bins = binned(x, edges)
    base = float(y[~valid].mean())
    now, trees, errors = np.full(len(y), base), [], []
    for k in range(rounds):
        weight = ((draws(keys, k, seed) < share) & ~valid).astype("f8")
        trees.append(grow(bins, edges, y - now, weight, depth, least))
        now = now + rate * trees[-1].predict(x)
        if valid.any():
            errors.append(float(((y - now)[valid] ** 2).mean()))
            if k - int(np.argmin(errors)) >= patience:
                break
    return (trees[: int(np.argmin(errors)) + 1] if errors else trees), base, errors


def _edges(rows: DataFrame, names: list[str]) -> list[np.ndarray]:
    """BINS - 1 cuts of each feature at quantiles; as many numbers whatever the data."""
    at = [k / BINS for k in range(1, BINS)]
    got = rows.agg(*(F.percentile_approx(c, at, 10_000).alias(f"e{i}") for i, c in enumerate(names))).first()
    return [np.concatenate([(u := np.unique(e)), np.full(BINS - 1 - len(u), np.inf)]) for e in got]


def _told(kind: str, number: int, tree: Tree) -> dict:
    return {"kind": kind, "number": number, "feature": tree.feature.tolist(), "cut": tree.cut.tolist(), "below": tree.below.tolist(), "above": tree.above.tolist(), "value": tree.value.tolist()}


def _frame(rows: list[dict]) -> pd.DataFrame:
    names = [c.split(" ")[0] for c in _TREE.split(", ")]
    frame = pd.DataFrame({c: pd.Series([r.get(c) for r in rows], dtype=object) for c in names})
    return frame.astype({"number": "Int32", "key": "Int64", "times": "Int32", "total": "f8"})


def _read(rows: list) -> list[Tree]:
    return [Tree(*(np.array(r[c]) for c in ("feature", "cut", "below", "above", "value"))) for r in sorted(rows, key=lambda r: r["number"])]


def _training(wide: DataFrame, names: list[str]) -> tuple[DataFrame, list[np.ndarray]]:
    rows = settled(wide.where("label is not null").withColumn("key", F.xxhash64("unique_id", "ds")))
    n = rows.count()
    if not n:
        raise ValueError("needs rows with a label")
    if n > LOCAL_ROWS:
        raise ValueError(f"is for up to {LOCAL_ROWS} rows; models.fit_trees takes more")
    return rows, _edges(rows, names)


def boosted(wide: DataFrame, names: list[str], valid: int = 12, rounds: int = 200, rate: float = 0.05, depth: int = 6, least: int = 2, share: float = 0.8, seed: int = 42, patience: int = PATIENCE) -> tuple[Ensemble, list[float]]:
    """The model of wide (unique_id, ds, label, names), and the validation error after each round; the last valid months of each series decide when to stop."""
    rows, edges = _training(wide, names)
    last = rows.groupBy("unique_id").agg(F.add_months(F.max("ds"), -valid).alias("cut"))
    marked = rows.join(F.broadcast(last), "unique_id").withColumn("valid", (F.col("ds") > F.col("cut")) & F.lit(valid > 0))

    def work(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("key")
        trees, base, errors = boost(part[names].to_numpy("f8"), part["label"].to_numpy("f8"), part["key"].to_numpy(), part["valid"].to_numpy(bool), edges, rounds, rate, depth, least, share, seed, patience)
        return _frame([_told("tree", k, t) for k, t in enumerate(trees)] + [{"kind": "error", "number": k, "total": e} for k, e in enumerate(errors)] + [{"kind": "base", "number": 0, "total": base}])

    got = marked.select("key", "label", "valid", *names, F.lit(0).alias("part")).groupBy("part").applyInPandas(work, _TREE).collect()
    errors = [r["total"] for r in sorted((r for r in got if r["kind"] == "error"), key=lambda r: r["number"])]
    base = next(r["total"] for r in got if r["kind"] == "base")
    return Ensemble(names, _read([r for r in got if r["kind"] == "tree"]), base, rate), errors


def forest(wide: DataFrame, names: list[str], trees: int = 100, depth: int = 10, least: int = 2, seed: int = 42) -> tuple[Ensemble, DataFrame]:
    """The model of wide, and unique_id, ds, label, yhat, n_trees: each row's mean over the trees whose bag it is not in (null if it is in all)."""
    rows, edges = _training(wide, names)
    some = max(1, int(np.sqrt(len(names))))

    def work(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("key")
        x, y, keys = part[names].to_numpy("f8"), part["label"].to_numpy("f8"), part["key"].to_numpy()
        bins, out = binned(x, edges), []
        total, times = np.zeros(len(y)), np.zeros(len(y), "i8")
        for k in range(int(key[0]), trees, PARTS):
            weight = bag(keys, k, seed)
            tree = grow(bins, edges, y, weight, depth, least, some, np.random.default_rng([seed, k]))
            away = weight == 0
            total[away] += tree.predict(x[away])
            times += away
            out.append(_told("tree", k, tree))
        rest = [{"kind": "away", "key": k, "total": t, "times": n} for k, t, n in zip(keys.tolist(), total.tolist(), times.tolist(), strict=True)]
        return _frame(out + rest)

    parts = rows.select("key", "label", *names, F.explode(F.sequence(F.lit(0), F.lit(PARTS - 1))).alias("part"))
    got = settled(parts.groupBy("part").applyInPandas(work, _TREE))
    model = Ensemble(names, _read(got.where("kind = 'tree'").collect()))
    sums = got.where("kind = 'away'").groupBy("key").agg(F.sum("total").alias("total"), F.sum("times").alias("n_trees"))
    kept = rows.select("unique_id", "ds", "label", "key").join(sums, "key")
    return model, kept.select("unique_id", "ds", "label", F.try_divide("total", "n_trees").alias("yhat"), "n_trees")


def out_of_bag(scored: DataFrame) -> DataFrame:
    """n, mse, r2 of a forest's out-of-bag predictions."""
    rows = scored.where("yhat is not null")
    error = F.avg((F.col("label") - F.col("yhat")) ** 2)
    return rows.agg(F.count(F.lit(1)).alias("n"), error.alias("mse"), (1 - error / F.var_pop("label")).alias("r2"))


def predict(model: Ensemble, wide: DataFrame) -> DataFrame:
    """unique_id, ds, y, yhat."""

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield batch[["unique_id", "ds", "label"]].assign(yhat=model.predict(batch[model.names].to_numpy("f8"))).rename(columns={"label": "y"})

    return wide.select("unique_id", "ds", "label", *model.names).mapInPandas(work, "unique_id string, ds date, y double, yhat double")


def history(y: np.ndarray, n: int) -> dict[str, float]:
    """The features of models.feature_matrix that look back, for the month after y, of a series of n rows with that month; y holds its last STATE values, or all."""
    ago = lambda k: y[-k] if len(y) >= k else np.nan
    share = lambda a, b: a / b if b != 0 else np.nan
    out = {f"lag_{k}": ago(k) if n >= k else np.nan for k in (1, 2, 3, 6, 12)} | {"yoy_lag_1": ago(12), "yoy_lag_2": ago(24)}
    means = {}
    for k in (3, 6, 12):
        part = y[-k:]
        means[k] = part.mean() if len(part) else np.nan
        spread = part.std(ddof=1) if len(part) > 1 else np.nan
        out |= {f"ma_{k}{tail}": v if n >= 24 else np.nan for tail, v in (("", means[k]), ("_std", spread), ("_min", part.min(initial=np.inf)), ("_max", part.max(initial=-np.inf)))}
    out |= {"yoy_growth": share(ago(1), ago(13)) - 1} | {f"momentum_{k}": share(ago(1), ago(1 + k)) - 1 for k in (1, 3, 12)} | {f"volatility_{k}": out[f"ma_{k}_std"] for k in (3, 12)}
    out |= {"seasonal_component": share(out["ma_12"], y[-24:].mean() if len(y) else np.nan), "trend_strength": share(out["ma_12"] - out["ma_3"], out["ma_12"])}
    return {k: float(v) if np.isfinite(v) else 0.0 for k, v in out.items()}


def recursive(model: Ensemble, panel: DataFrame, h: int = 12) -> DataFrame:
    """unique_id, step, ds, yhat: each month ahead from the months before it, forecast ones included."""
    from .models import feature_matrix

    ahead = horizon(panel, h)
    wide, names = feature_matrix(panel.select("unique_id", "ds", F.col("y").cast("double").alias("y")).unionByName(ahead.select("unique_id", "ds", F.lit(None).cast("double").alias("y"))))
    backward = sorted(history(np.ones(1), 1).keys() & set(names))
    known = [c for c in model.names if c not in backward]
    place = {c: i for i, c in enumerate(model.names)}
    size = wide.groupBy("unique_id").agg(F.count(F.lit(1)).alias("size"))
    recent = wide.join(ahead.select("unique_id", "ds", "step"), ["unique_id", "ds"], "left").join(size, "unique_id")
    recent = recent.withColumn("back", F.row_number().over(newest_first())).where(F.col("back") <= h + STATE)

    def work(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("ds")
        todo = part[part["step"].notna()]
        y = part[part["step"].isna()]["label"].to_numpy("f8")
        n, out = int(part["size"].iloc[0]) - h, []
        fixed = todo[known].to_numpy("f8")
        for k in range(len(todo)):
            x = np.zeros((1, len(model.names)))
            x[0, [place[c] for c in known]] = fixed[k]
            for c, v in history(y[-STATE:], n + k + 1).items():
                if c in place:
                    x[0, place[c]] = v
            out.append(float(model.predict(x)[0]))
            y = np.append(y, out[-1])
        return pd.DataFrame({"unique_id": todo["unique_id"], "step": todo["step"].astype("int32"), "ds": todo["ds"], "yhat": out})

    columns = ["unique_id", "ds", "step", "label", "size", *known]
    return recent.select(*columns).groupBy("unique_id").applyInPandas(work, "unique_id string, step int, ds date, yhat double")



def holdout(panel: DataFrame, held: int = 12, **settings) -> DataFrame:
    """unique_id, ds, y, yhat of each series' last held months, by a boosted model of what lies before, stopped early by the months before these.

    A panel of more than LOCAL_ROWS rows is boosted by pyspark.ml, with the same cut as validation indicator.
    """
    from . import models

    wide, names = models.feature_matrix(panel)
    cut = wide.groupBy("unique_id").agg(F.add_months(F.max("ds"), -held).alias("_cut"))
    marked = settled(wide.join(cut, "unique_id"))
    known, ahead = marked.where("ds <= _cut").drop("_cut"), marked.where("ds > _cut").drop("_cut")
    if known.count() <= LOCAL_ROWS:
        return predict(boosted(known, names, **settings)[0], ahead)
    from pyspark.ml import Pipeline
    from pyspark.ml.feature import VectorAssembler

    late = marked.where("ds <= _cut and label is not null").withColumn("late", F.col("ds") > F.add_months("_cut", -12))
    regressor = models.boosting(validationIndicatorCol="late", validationTol=0.001)
    model = Pipeline(stages=[VectorAssembler(inputCols=names, outputCol="features"), regressor]).fit(late)
    return model.transform(ahead).select("unique_id", "ds", F.col("label").alias("y"), F.col("prediction").alias("yhat"))
