"""Window expressions and measures against pandas and by hand."""

import datetime as dt

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidewheel.functions import scalars as S
from tidewheel.operators import features as X
from tidewheel.operators import forecast as G
from tidewheel.operators import metrics as M
from tidewheel.operators import models as L
from tidewheel.operators import quality as Q
from tidewheel.operators import reshape as H
from tidewheel.operators import technical as T
from tidewheel.operators import windows as V
from tidewheel.sources import payload as P


def series(n=60, seed=0, holes=()):
    rng = np.random.default_rng(seed)
    ds = pd.date_range("2015-01-31", periods=n, freq="ME")
    y = 100 + np.arange(n) + 10 * np.sin(np.arange(n) * np.pi / 6) + rng.normal(0, 3, n)
    return pd.DataFrame({"unique_id": "a", "ds": ds.date, "y": [None if i in holes else float(v) for i, v in enumerate(y)]})


def frame(spark, pdf, schema="unique_id string, ds date, y double"):
    rows = [tuple(None if v is None or v != v else v for v in r) for r in pdf.itertuples(index=False)]
    return spark.createDataFrame(rows, schema)


def column(df, name, by="ds"):
    return pd.Series([r[name] for r in df.orderBy(by).collect()], dtype="float64")


def close(a, b):
    np.testing.assert_allclose(a.to_numpy(float), b.to_numpy(float), rtol=1e-9, atol=1e-9, equal_nan=True)


@pytest.mark.parametrize("n,least", [(3, 1), (6, 6), (12, 6)])
def test_rolling(spark, n, least):
    pdf = series(holes=(4, 5, 20))
    df, w, x = frame(spark, pdf), V.over_time(), F.col("y")
    y = pdf["y"].astype(float)
    for name, f in {"mean": F.avg, "std": F.stddev_samp, "min": F.min, "max": F.max}.items():
        got = column(df.withColumn("z", V.rolling(f, x, n, w, least)), "z")
        close(got, getattr(y.rolling(n, min_periods=least), name)())


def test_rank_zscore_changes(spark):
    pdf = series()
    pdf["y"] = pdf["y"].round(-1)  # ties
    df, w, x, y = frame(spark, pdf), V.over_time(), F.col("y"), pdf["y"]
    close(column(df.withColumn("z", V.rolling_rank(x, 12, w)), "z"), y.rolling(12, min_periods=6).rank(pct=True))
    close(column(df.withColumn("z", V.total_rank(x, ["unique_id"])), "z"), y.rank(pct=True))
    r = y.rolling(12, min_periods=6)
    close(column(df.withColumn("z", V.zscore(x, 12, w)), "z"), (y - r.mean()) / r.std())
    close(column(df.withColumn("z", V.pct_change(x, 3, w)), "z"), y.pct_change(3, fill_method=None))


def test_fill(spark):
    pdf = series(holes=(0, 7, 8, 59))
    df, w, y = frame(spark, pdf), V.over_time(), pdf["y"].astype(float)
    close(column(df.withColumn("z", V.forward_fill(F.col("y"), w)), "z"), y.ffill())
    close(column(df.withColumn("z", V.backward_fill(F.col("y"), w)), "z"), y.bfill())
    full = column(df.withColumn("z", X.impute(df, "y")), "z")
    close(full, y.ffill().fillna(y.median()))


@pytest.mark.parametrize("n", [5, 3000])
def test_ema_has_no_longest_series(spark, n):
    x = np.random.default_rng(1).normal(100, 5, n)
    df = spark.createDataFrame([("s", i, float(v)) for i, v in enumerate(x)], "symbol string, t int, close double")
    got = column(V.with_ema(df, "close", 12, "z", ["symbol"], "t"), "z", "t")
    close(got, pd.Series(x).ewm(span=12, adjust=False).mean())


def test_rsi_of_a_rise_is_100_and_of_nothing_null(spark):
    bars = [("s", dt.date(2020, 1, 1) + dt.timedelta(i), 1.0, 1.0, 1.0, float(max(i, 1)), 1) for i in range(20)]
    got = column(T.rsi(spark.createDataFrame(bars, "symbol string, ds date, open double, high double, low double, close double, volume bigint")), "rsi_14")
    assert np.isnan(got[0]) and np.isnan(got[1]) and (got[2:] == 100).all()


def test_measures_by_hand(spark):
    rows = spark.createDataFrame([(0.0, 5.0), (100.0, 90.0)], "y double, p double")
    assert rows.agg(M.mape(F.col("y"), F.col("p")).alias("m")).first().m == pytest.approx(10.0)
    rows = spark.createDataFrame([(0.0, 0.0), (100.0, 100.0)], "y double, p double")
    assert rows.agg(M.smape(F.col("y"), F.col("p")).alias("m")).first().m == 0.0
    one = spark.range(1)
    assert one.select(M.mase(F.lit(0.0), F.lit(0.0)).alias("m")).first().m == 0.0
    assert one.select(M.mase(F.lit(1.0), F.lit(0.0)).alias("m")).first().m is None


def test_growth_bands_close_on_the_right(spark):
    rows = spark.createDataFrame([(-0.1,), (-0.05,), (0.05,), (0.1,), (0.2,)], "x double")
    assert [r.g for r in rows.select(S.growth_band(F.col("x")).alias("g")).collect()] == ["Strong Decline", "Decline", "Stable", "Growth", "Strong Growth"]


def test_month_weights(spark):
    assert sum(P.MONTH_WEIGHTS) == pytest.approx(1.010)
    months = P.spread_over_months(spark.createDataFrame([(2020, 1200.0)], "year int, value double"))
    assert months.count() == 12 and months.agg(F.sum("value")).first()[0] == pytest.approx(1200.0)
    assert months.agg(F.max("ds")).first()[0] == dt.date(2020, 12, 31)


def test_payload_cells(spark):
    text = '[["data_type_code","time_slot_id","seasonally_adj","category_code","cell_value"],["SM","M02","yes","x","7.5"],["SM","M03","yes","x","M"],["SM","M04","yes","x","0"],["SM","M05","yes","x",""],["SM","0","yes","x","9"],["SM","M13","yes","x","9"],["SM","M06","no","x","9"]]'
    rows = P.monthly_observations(P.parse(spark.createDataFrame([(2020, text)], "year int, payload string"), keep=["year"])).collect()
    assert [(r.ds, r.value) for r in rows] == [(dt.date(2020, 2, 29), 7.5)]


@pytest.mark.parametrize("n,cuts", [(132, [72, 84, 96, 108, 120]), (35, [])])
def test_fold_cuts(spark, n, cuts):
    got = G.folds(frame(spark, series(n))).select("fold", "train_end").distinct().orderBy("fold").collect()
    assert [r.train_end for r in got] == cuts


def test_walk_forward_and_holdout(spark):
    df = frame(spark, series(132))
    assert [r.train_end for r in G.walk_forward_folds(df).select("fold", "train_end").distinct().orderBy("fold").collect()] == [60, 72, 84, 96, 108]
    assert G.ratio_holdout(df).where("is_test").count() == 24


def test_train_lies_before_test(spark):
    rows = G.folds(frame(spark, series(132))).groupBy("fold").agg(F.max(F.when(~F.col("is_test"), F.col("ds"))).alias("a"), F.min(F.when(F.col("is_test"), F.col("ds"))).alias("b"))
    assert all(r.a < r.b for r in rows.collect())


def test_model_features_see_no_present_or_future(spark):
    pdf = series(60)
    other = pdf.copy()
    other.loc[40:, "y"] = 1e6
    a, b = (X.model_profile(frame(spark, p)).where(F.col("ds") <= pdf["ds"][40]).drop("y").orderBy("ds").collect() for p in (pdf, other))
    assert a == b


def test_scenarios_are_in_order(spark):
    df = frame(spark, series(72))
    rows = G.scenarios(G.long_term(df, 24), G.growth_stats(df)).where("step > 1").collect()
    assert rows and all(r.pessimistic <= r.baseline <= r.optimistic for r in rows if r.baseline > 0)


def test_short_series(spark):
    df = frame(spark, series(5))
    assert G.seasonal_naive_backtest(df).count() == 0 and G.growth_projection(df, 3).count() == 0
    assert [r.yhat for r in G.flat(df, 2).orderBy("step").collect()] == [pytest.approx(series(5)["y"].iloc[-1])] * 2
    bad = L.forecast_models(df, 2).collect()
    assert all(r.yhat is None and r.status.startswith("needs") for r in bad)


def test_models_follow_a_season():
    y = series(120)["y"].to_numpy(float)
    for model in (L.ets, L.ar):
        assert np.abs(model(y[:108], 12) - y[108:]).mean() < np.abs(y[96:108] - y[108:]).mean() + 3
    assert L.grid_search([{"x": v} for v in (3, 2, 4, 5, 6, 1)], lambda s: s["x"]) == ({"x": 2}, 2)


def test_pivot_round_trip(spark):
    rows = [("a", 1, 1.0), ("b", 1, 2.0), ("a", 2, 3.0)]
    long = spark.createDataFrame(rows, "n string, ds int, v double")
    back = H.long(H.wide(long, "n", "v", ["a", "b"]), ["ds"], ["a", "b"], "n", "v")
    assert sorted((r.n, r.ds, r.v) for r in back.collect()) == sorted(rows)


def test_as_of_takes_equal_times(spark):
    left = spark.createDataFrame([(1, 1), (1, 5), (2, 5)], "k int, t int")
    right = spark.createDataFrame([(1, 5, 7.0), (1, 3, 6.0)], "k int, t int, v double")
    got = {(r.k, r.t): r.v for r in H.as_of(left, right, "t", ["k"], ["v"]).collect()}
    assert got == {(1, 1): None, (1, 5): 7.0, (2, 5): None}


def test_quality(spark):
    df = spark.createDataFrame([("a", dt.date(2020, 1, 31), 1.0)] * 2 + [("b", dt.date(2020, 3, 1), None)], "unique_id string, ds date, y double")
    row = Q.global_report(df, "unique_id", "ds").first()
    assert (row.n_rows, row.n_duplicates, row.n_ids, row.nulls_y) == (3, 1, 2, 1)
    assert Q.version_hash(df).first().hash == Q.version_hash(df.orderBy(F.desc("ds"))).first().hash
    assert S.clean(F.lit(1.0)) is not None
    assert spark.range(1).select(S.clean(F.lit(float("nan"))).alias("x")).first().x is None


def test_sparse_panels_and_alignment_cover_all_rows(spark, tmp_path):
    from tidewheel.plans.catalog import QUERIES

    rng = np.random.default_rng(5)
    days = [dt.date(2020, 1, 1) + dt.timedelta(int(x)) for x in rng.integers(0, 500, 60)]
    orders = pd.DataFrame({"o_custkey": rng.choice([3, 250, 301, 70_001], 60), "o_orderdate": days, "o_orderpriority": rng.choice(["1-URGENT", "5-LOW"], 60), "o_totalprice": rng.integers(1, 9000, 60) * 1.0})
    spark.createDataFrame(list(orders.itertuples(index=False, name=None)), "o_custkey long, o_orderdate date, o_orderpriority string, o_totalprice double").write.parquet(str(tmp_path / "orders.parquet"))
    month = pd.to_datetime(orders["o_orderdate"]).dt.to_period("M")
    fill, line, gap = {}, {}, {}
    for k, part in orders["o_totalprice"].groupby([orders["o_custkey"], month]).sum().groupby(level=0):
        y = part.droplevel(0)
        full = y.reindex(pd.period_range(y.index.min(), y.index.max(), freq="M"))
        ends = full.index.to_timestamp(how="end").date
        fill |= {(k, d): v for d, *v in zip(ends, full.ffill(), full.bfill(), full.fillna(y.median()), strict=True)}
        even = pd.Series(full.to_numpy(), index=pd.to_datetime(ends)).interpolate("time")
        line |= {(k, d): v for d, v in zip(ends, even, strict=True)}
        gap |= {(k, b.to_timestamp(how="end").date()): (b - a).n for a, b in zip(y.index[:-1], y.index[1:], strict=True) if (b - a).n > 2}
    run = lambda name: QUERIES[name](spark, str(tmp_path)).collect()
    got = {(r.k, r.ds): [r.forward, r.backward, r.imputed] for r in run("ffill_gaps_all")}
    assert set(got) == set(fill) and all(got[k] == pytest.approx(fill[k]) for k in fill)
    got = {(r.unique_id, r.ds): r.y for r in run("linear_interpolation_all")}
    assert set(got) == set(line) and all(got[k] == pytest.approx(line[k], abs=1e-3) for k in line)
    assert gap and {(r.unique_id, r.ds): r.months for r in run("gap_detect_all")} == gap
    events = [(i, int(rng.integers(0, 45)), dt.datetime(2020, 1, 1) + dt.timedelta(minutes=int(rng.integers(0, 3000))), float(i * 7 % 101)) for i in range(200)]
    spark.createDataFrame(events, "event_id long, user_id long, ts timestamp, value double").write.parquet(str(tmp_path / "events.parquet"))
    hour = lambda t: t.replace(minute=0)
    want = {i: max(v for _, x, s, v in events if x == u and hour(s) == hour(t)) for i, u, t, _ in events}
    assert {r.event_id: r.v for r in run("asof_align_all")} == want
