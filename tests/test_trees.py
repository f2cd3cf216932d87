"""Trees as arrays: cuts, bags, early stopping and recursion against plain code."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidewheel.operators import models as L
from tidewheel.operators import trees as T


def months(n):
    return [(pd.Timestamp(2000, 1, 31) + pd.offsets.MonthEnd(i)).date() for i in range(n)]


@pytest.fixture(scope="module")
def panel(spark):
    rng, rows = np.random.default_rng(1), []
    for k, n in (("a", 70), ("b", 60), ("c", 30)):
        y = 100 + np.arange(n) * 0.5 + 20 * np.sin(np.arange(n) * np.pi / 6) + rng.normal(0, 3, n)
        rows += [(k, d, float(v)) for d, v in zip(months(n), y, strict=True)]
    return spark.createDataFrame(rows, "unique_id string, ds date, y double").repartition(3)


def plain_tree(x, y, w, edges, depth, least):
    """The same greedy tree by trying every cut, as nested tuples."""
    total = (w * y).sum() / w.sum()
    best = (1e-12, None)
    if depth:
        whole = (w * y).sum() ** 2 / w.sum()
        for f in range(x.shape[1]):
            for e in edges[f][np.isfinite(edges[f])]:
                low = x[:, f] <= e
                if least <= low.sum() <= len(y) - least:
                    gain = (w * y)[low].sum() ** 2 / w[low].sum() + (w * y)[~low].sum() ** 2 / w[~low].sum() - whole
                    if gain > best[0] * (1 + 1e-9) + 1e-9:
                        best = (gain, (f, e, low))
    if best[1] is None:
        return total
    f, e, low = best[1]
    return f, e, *(plain_tree(x[m], y[m], w[m], edges, depth - 1, least) for m in (low, ~low))


def plain_predict(tree, row):
    while isinstance(tree, tuple):
        tree = tree[2] if row[tree[0]] <= tree[1] else tree[3]
    return tree


def test_trees_by_trying_every_cut():
    rng = np.random.default_rng(2)
    x, y = rng.normal(size=(120, 4)).round(1), rng.normal(size=120)
    x[:, 3] = (x[:, 3] > 0) * 1.0
    edges = [np.concatenate([(u := np.unique(x[:, j])[:-1]), np.full(T.BINS - 1 - len(u), np.inf)]) for j in range(4)]
    for depth, least in ((1, 1), (3, 2), (6, 5)):
        w = T.bag(np.arange(120), depth, 1)
        tree = T.grow(T.binned(x, edges), edges, y, w, depth, least)
        on = w > 0
        want = plain_tree(x[on], y[on], w[on], edges, depth, least)
        assert tree.predict(x) == pytest.approx([plain_predict(want, r) for r in x])


def test_bags_are_poisson():
    counts = np.bincount(T.bag(np.arange(200_000) * 7919, 3, 42).astype(int))
    assert counts[:4] / 200_000 == pytest.approx([0.3679, 0.3679, 0.1839, 0.0613], abs=0.004)
    one, other = (T.draws(np.arange(10_000), k, 42) for k in (0, 1))
    assert abs(np.corrcoef(one, other)[0, 1]) < 0.03


def test_boosting_stops_where_the_last_months_are_best(spark, panel):
    wide, names = L.feature_matrix(panel)
    model, errors = T.boosted(wide, names, valid=12, patience=5)
    assert len(errors) < 200 and len(model.trees) == int(np.argmin(errors)) + 1 and len(errors) - len(model.trees) == 5
    rows = wide.toPandas().sort_values(["unique_id", "ds"])
    cut = rows.groupby("unique_id")["ds"].transform("max").map(lambda d: (pd.Timestamp(d) - pd.DateOffset(months=12)).date())
    late = (rows["ds"] > cut).to_numpy()
    assert late.sum() == 36
    x, y = rows[names].to_numpy("f8"), rows["label"].to_numpy()
    assert ((y - model.predict(x))[late] ** 2).mean() == pytest.approx(min(errors)) and model.base == pytest.approx(y[~late].mean())
    told = {(r.unique_id, r.ds): r.yhat for r in T.predict(model, wide).collect()}
    assert [told[k] for k in zip(rows["unique_id"], rows["ds"], strict=True)] == pytest.approx(model.predict(x))
    assert len(T.boosted(wide, names, valid=0, rounds=7)[0].trees) == 7


def test_out_of_bag_error_by_plain_computation(spark, panel):
    wide, names = L.feature_matrix(panel)
    model, scored = T.forest(wide, names, trees=20)
    assert len(model.trees) == 20
    rows = scored.join(wide.select("unique_id", "ds", *names), ["unique_id", "ds"]).withColumn("key", F.xxhash64("unique_id", "ds")).toPandas()
    x, keys = rows[names].to_numpy("f8"), rows["key"].to_numpy()
    away = np.stack([T.bag(keys, k, 42) == 0 for k in range(20)])
    values = np.stack([t.predict(x) for t in model.trees])
    assert (rows["n_trees"] == away.sum(0)).all() and 5 < away.sum(0).mean() < 10
    want = (values * away).sum(0) / np.where(away.sum(0), away.sum(0), np.nan)
    assert rows["yhat"].to_numpy("f8") == pytest.approx(want, nan_ok=True)
    got, known = T.out_of_bag(scored).first(), ~np.isnan(want)
    y = rows["label"].to_numpy()
    assert got.n == known.sum() and got.mse == pytest.approx(((y - want)[known] ** 2).mean()) and got.r2 > 0.5
    again = T.forest(wide.repartition(7), names, trees=20)[1]
    assert again.exceptAll(scored).count() == 0  # bags hang on keys, not on partitions


def test_recursion_equals_rebuilt_features(spark, panel):
    """Three steps, each by building all features anew over the series and the values forecast so far."""
    wide, names = L.feature_matrix(panel)
    model, _ = T.boosted(wide, names, rounds=30)
    got = {(r.unique_id, r.step): (r.ds, r.yhat) for r in T.recursive(model, panel, 3).collect()}
    assert len(got) == 9
    now = panel
    for step in (1, 2, 3):
        ahead = panel.groupBy("unique_id").agg(F.last_day(F.add_months(F.max("ds"), step)).alias("ds"))
        rebuilt = L.feature_matrix(now.unionByName(ahead.withColumn("y", F.lit(None).cast("double"))))[0]
        new = T.predict(model, rebuilt.join(ahead, ["unique_id", "ds"])).collect()
        for r in new:
            assert got[r.unique_id, step] == (r.ds, pytest.approx(r.yhat))
        now = now.unionByName(spark.createDataFrame([(r.unique_id, r.ds, r.yhat) for r in new], panel.schema))


def test_short_series_and_empty_panels(spark):
    short = spark.createDataFrame([("x", d, float(i)) for i, d in enumerate(months(3))], "unique_id string, ds date, y double")
    wide, names = L.feature_matrix(short)
    model, _ = T.boosted(wide, names, valid=0, rounds=3)
    rows = T.recursive(model, short, 4).collect()
    assert len(rows) == 4 and all(np.isfinite(r.yhat) for r in rows)
    for fit in (T.boosted, T.forest):
        with pytest.raises(ValueError, match="needs rows"):
            fit(wide.limit(0), names)
