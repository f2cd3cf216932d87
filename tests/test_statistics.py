"""Point-in-time joins, unit roots, components and scores against plain code."""

import datetime as dt
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as Ty

from tidewheel.operators import reshape as H
from tidewheel.operators import select as C
from tidewheel.operators import unitroot as U
from tidewheel.operators import windows as V


def test_no_value_is_used_before_it_was_known(spark):
    rng, day = random.Random(1), lambda k: dt.date(2020, 1, 1) + dt.timedelta(k)
    facts = [(rng.choice(["a", "b", None]), day(rng.randint(0, 60)), day(rng.randint(0, 120)), rng.choice([None, 1.0 * k])) for k in range(150)]
    facts = list({f[:3]: f for f in facts}.values()) + [("a", None, day(3), 5.0), ("a", day(3), None, 5.0)]
    left = [(rng.choice(["a", "b", None, "none"]), day(rng.randint(-5, 130)), k) for k in range(200)]
    f = spark.createDataFrame(facts, "id string, valid date, known date, value double")
    got = {r.n: (r.valid, r.known, r.value) for r in H.known_at(spark.createDataFrame(left, "id string, t date, n int"), f, ["id"], "t").collect()}
    assert len(got) == 200
    for key, t, n in left:
        seen = [x[1:] for x in facts if x[0] == key and x[1] and x[2] and x[2] <= t]
        assert got[n] == (max(seen, key=lambda x: x[:2]) if seen else (None, None, None))
        assert got[n][1] is None or got[n][1] <= t
    assert H.known_at(spark.createDataFrame(left, "id string, t date, n int"), f.limit(0), ["id"], "t").where("valid is not null").count() == 0


def plain_test(y, most):
    y = y - y.mean()  # else a small series on a high level loses its digits here
    d, best = np.diff(y), (np.inf, None, None)
    rows = range(most, len(d))
    for k in range(most + 1):
        x = np.array([[1, y[t], *(d[t - j] for j in range(1, k + 1))] for t in rows])
        target = d[most:]
        w, *_ = np.linalg.lstsq(x, target, rcond=None)
        rest = ((target - x @ w) ** 2).sum()
        n = len(target)
        aic = n * np.log(rest / n) + 2 * x.shape[1]
        if aic < best[0]:
            best = (aic, k, w[1] / np.sqrt(rest / (n - x.shape[1]) * np.linalg.inv(x.T @ x)[1, 1]))
    return best[1:]


def test_dickey_fuller_by_least_squares(spark):
    rng, rows, want = np.random.default_rng(3), [], {}
    for i in range(8):
        e = rng.normal(size=150)
        y = np.zeros(150)
        for t in range(2, 150):
            y[t] = (0.5, 0.9, 1.0, 1.4)[i % 4] * y[t - 1] - (0.4 if i % 4 == 3 else 0) * y[t - 2] + e[t]
        y = y * 10.0 ** (i - 3) + 1000
        rows += [(f"s{i}", dt.date(2000, 1, 1) + dt.timedelta(t), float(v)) for t, v in enumerate(y)]
        want[f"s{i}"] = plain_test(y, 12)
    rows += [("short", dt.date(2000, 1, t), float(t)) for t in range(1, 9)] + [("flat", dt.date(2000, 1, 1) + dt.timedelta(t), 5.0) for t in range(40)] + [("null", dt.date(2000, 1, 1), None)]
    got = {r.unique_id: r for r in U.dickey_fuller(spark.createDataFrame(rows, "unique_id string, ds date, y double").repartition(5)).collect()}
    for k, (lags, t) in want.items():
        assert got[k].lags == lags and got[k].statistic == pytest.approx(t, rel=1e-6) and got[k].p_value == U.p_value(got[k].statistic)
    assert all(got[k].statistic is None and got[k].stationary is None for k in ("short", "flat", "null")) and got["null"].n == 0
    assert got["s0"].stationary and not got["s2"].stationary


def test_p_values_by_the_table_of_critical_values():
    """Large-sample points of the test with a constant, at 1, 5 and 10 percent."""
    assert [U.p_value(t) for t in (-3.43035, -2.86154, -2.56677)] == pytest.approx([0.01, 0.05, 0.10], abs=6e-4)
    values = [U.p_value(t) for t in np.linspace(-20, 4, 400)]
    assert values == sorted(values) and values[0] == 0 and values[-1] == 1


@pytest.fixture(scope="module")
def table(spark):
    rng = np.random.default_rng(5)
    a, b = rng.normal(size=400), rng.normal(size=400)
    pdf = pd.DataFrame({"a": 100 + a, "b": a * 3 + b, "c": b - 1e4, "flat": 2.0, "t": a * a + rng.normal(size=400) * 0.1})
    pdf.loc[::50, "c"] = np.nan
    rows = [tuple(None if np.isnan(v) else float(v) for v in r) for r in pdf.itertuples(index=False)]
    return spark.createDataFrame(rows, "a double, b double, c double, flat double, t double").repartition(6), pdf


def test_components_equal_numpy(table):
    df, pdf = table
    names = ["a", "b", "c"]
    x = pdf[names].dropna().to_numpy()
    for scaled in (True, False):
        ways, shares, scales = C.components(df, names, 3, scaled)
        z = (x - x.mean(0)) / (x.std(0, ddof=1) if scaled else 1)
        _, s, v = np.linalg.svd(z, full_matrices=False)
        assert shares == pytest.approx(s**2 / (s**2).sum())
        assert np.abs((ways * v).sum(1)) == pytest.approx(np.ones(3))
    got = C.project(df, names, *C.components(df, names, 2)[::2]).orderBy("a").select("pc_1", "pc_2").toPandas().to_numpy("f8")
    assert np.isnan(got[:, 0]).sum() == 8 and np.nanvar(got[:, 0], ddof=1) == pytest.approx(shares_of(x)[0] * 3)
    with pytest.raises(ValueError):
        C.components(df.limit(0), names)


def shares_of(x):
    s = np.linalg.svd((x - x.mean(0)) / x.std(0, ddof=1), compute_uv=False)
    return s**2 / (s**2).sum()


def test_scores_by_plain_computation(table):
    df, pdf = table
    got = {r.feature: r for r in C.f_scores(df, ["a", "b", "c", "flat"], "t").collect()}
    info = {r.feature: r for r in C.mutual_information(df, ["a", "b", "c", "flat"], "t", 6).collect()}
    for c in ("a", "b", "c"):
        x = pdf[[c, "t"]].dropna()
        r = np.corrcoef(x[c], x["t"])[0, 1]
        assert got[c].n == info[c].n == len(x) and got[c].r == pytest.approx(r) and got[c].f == pytest.approx(r * r * (len(x) - 2) / (1 - r * r))
        counts, _, _ = np.histogram2d(x[c], x["t"], 6)
        p = counts / counts.sum()
        want = (p[p > 0] * np.log((p / (p.sum(1, keepdims=True) * p.sum(0)))[p > 0])).sum()
        assert info[c].information == pytest.approx(want)
    assert got["flat"].f is None and info["flat"].information == 0
    assert info["a"].information > 5 * info["c"].information and abs(got["a"].r) < 0.3  # a curve has information, but no line


def test_fills_of_long_series_take_one_pass(spark):
    """Values as by the frame that looks ahead, and a plan without such a frame."""
    rows = [("x" if t % 3 else "y", dt.date(2000, 1, 1) + dt.timedelta(t), None if t % 7 else float(t)) for t in range(400)]
    df = spark.createDataFrame(rows, "unique_id string, ds date, y double")
    w, x = V.over_time(), F.col("y")
    both = df.select(V.backward_fill(x, w).alias("a"), V.backward_fill(x, w, V.newest_first()).alias("b"), V.interpolate(x, w, F.col("ds")).alias("c"), V.interpolate(x, w, F.col("ds"), V.newest_first()).alias("d"))
    assert both.where("not (a <=> b) or not (c <=> d)").count() == 0 and both.where("b is not null").count() > 300
    plan = df.select(V.interpolate(x, w, F.col("ds"), V.newest_first()))._jdf.queryExecution().optimizedPlan().toString().lower()
    assert "unboundedfollowing" not in plan.replace("$", "")
    long = spark.range(200_000).select(F.lit("z").alias("unique_id"), F.col("id").alias("ds"), F.when(F.col("id") % 1000 == 999, F.col("id").cast("double")).alias("y"))
    assert long.select(V.backward_fill(x, w, V.newest_first()).alias("b")).agg(F.count("b")).first()[0] == 200_000
    assert isinstance(df.schema["y"].dataType, Ty.DoubleType)


def test_one_changed_value_names_its_bucket(spark):
    from tidewheel.operators import versions as Z

    rows = [(i, f"k{i % 90}", None if i % 7 == 0 else i * 1.5) for i in range(2000)]
    df = spark.createDataFrame(rows, "id long, k string, v double")
    tree = Z.version_tree(df, ["id"])
    assert tree.count() == 512 + 64 + 8 + 1 and tree.where("level = 0").first().n == 2000
    assert Z.changed_buckets(tree, Z.version_tree(df.orderBy(F.desc("v")).repartition(7).select("v", "k", "id"), ["id"])).count() == 0
    other = Z.version_tree(df.withColumn("v", F.when(F.col("id") == 777, 1.0).otherwise(F.col("v"))), ["id"])
    want = df.where("id = 777").select(Z.bucket_of(["id"]).alias("b")).first().b
    assert [r.node for r in Z.changed_buckets(tree, other).collect()] == [want]
    for more in (df.union(df.where("id = 5")).union(df.where("id = 5")), df.where("id <> 7"), df.withColumn("v", F.when(F.col("id") != 7, F.col("v")).otherwise(0.0))):
        assert Z.changed_buckets(tree, Z.version_tree(more, ["id"])).count() == 1  # twice more, gone, null to 0
    assert Z.changed_buckets(tree, Z.version_tree(df.limit(0), ["id"])).count() > 400
