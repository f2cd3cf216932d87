"""The store, streams, configuration and command line."""

import datetime as dt
import json
import math

import pytest
from pyspark.sql import functions as F

from tidewheel.config import Config, merged, read_env
from tidewheel.operators import models as L
from tidewheel.operators import quality as Q
from tidewheel.operators import reshape as H
from tidewheel.operators import store as K
from tidewheel.report import finite, markdown, training_report
from tidewheel.sources import catalog, rest
from tidewheel.sources import providers as P
from tidewheel.sources import series as src
from tidewheel.streaming import bars as B

SF = "/root/testdata/sf0.01"
DAY = dt.date(2020, 1, 31)


def rows(spark, *values):
    return spark.createDataFrame([("c", DAY, v, "retail", k) for k, v in values], "category_id string, ds date, value double, data_type string, source string")


def test_upsert_twice_is_once(spark, tmp_path):
    s, keys = K.Store(spark, str(tmp_path)), ["category_id", "ds", "source"]
    assert s.read("time_series").count() == 0
    s.upsert("time_series", rows(spark, ("x", 1.0), ("y", 2.0)), keys)
    for _ in range(2):
        s.upsert("time_series", rows(spark, ("x", 5.0), ("z", None)), keys)
    assert {r.source: r.value for r in s.read("time_series").collect()} == {"x": 5.0, "y": 2.0}
    assert s.duplicates("time_series", keys).count() == 0
    assert not s.fresh("time_series")
    s.mark_fresh("time_series")
    assert s.fresh("time_series")
    s.backup("time_series", str(tmp_path / "copy"))
    assert spark.read.parquet(str(tmp_path / "copy" / "time_series")).count() == 2


def test_ignore_keeps_the_old(spark):
    got = K.ignored(rows(spark, ("x", 1.0)), rows(spark, ("x", 9.0), ("y", 2.0)), ["source"])
    assert {r.source: r.value for r in got.collect()} == {"x": 1.0, "y": 2.0}


def test_stream_is_like_batch(spark, tmp_path):
    events = spark.read.parquet(f"{SF}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    events.select("event_id", "ts", "user_id", "event_type", "value", "props").repartition(4).write.parquet(str(tmp_path / "in"))
    got = []
    q = B.run_once(B.daily_bars(B.read_events(spark, str(tmp_path / "in"), 10)), lambda df, n: got.extend(df.collect()), str(tmp_path / "mark"))
    q.awaitTermination(120)
    last = {(r.symbol, r.ds): r.volume for r in got}
    batch = {(r.symbol, r.ds): r.volume for r in B.daily_bars(events).collect()}
    assert last == batch


def test_config(tmp_path, monkeypatch):
    monkeypatch.setenv("WHERE", "there")
    c = Config({"paths": {"input": "${WHERE}/x", "output": "${NOWHERE:-out}"}})
    assert (c.get("paths.input"), c.get("paths.output"), c.get("forecast.horizon"), c.get("no.such", 3)) == ("there/x", "out", 12, 3)
    with pytest.raises(KeyError):
        Config({"envirnoment": {}})
    assert merged({"a": {"b": 1, "c": 2}}, {"a": {"b": 3}}) == {"a": {"b": 3, "c": 2}}
    (tmp_path / ".env").write_text("# note\nKEY='v=1'\n\n")
    assert read_env(tmp_path / ".env") == {"KEY": "v=1"}
    c.set("forecast.horizon", 6)
    c.save(tmp_path / "c.yaml")
    assert Config.load(tmp_path / "c.yaml").get("forecast.horizon") == 6


def test_sources(spark, tmp_path):
    (tmp_path / "a.csv").write_text("ds,v\n2020-01-31,1.5\n2020-02-29,M\n")
    df = src.read_csv(spark, [str(tmp_path / "no.csv"), str(tmp_path / "a.csv")], "ds string, v double", ["ds"])
    assert [(r.ds, r.v) for r in df.orderBy("ds").collect()] == [(DAY, 1.5), (dt.date(2020, 2, 29), None)]
    with pytest.raises(FileNotFoundError):
        src.first_there(spark, [str(tmp_path / "no")])
    spark.dataSource.register(rest.PayloadSource)
    got = spark.read.format("payloads").option("keys", "2020,2021").option("fetcher", "json.dumps").load()
    assert sorted((r.key, r.payload) for r in got.collect()) == [("2020", '"2020"'), ("2021", '"2021"')]


def test_report(spark):
    df = finite(spark.createDataFrame([("a", float("inf")), ("b", 2.0)], "k string, v double"))
    assert markdown(df.orderBy("k"), "T").splitlines()[-2:] == ["| a | - |", "| b | 2.0000 |"]
    assert json.loads(df.toJSON().collect()[0]) == {"k": "a"}


def test_command_line(spark, tmp_path, monkeypatch):
    import tidewheel.__main__ as cli

    monkeypatch.setattr(cli, "session", lambda *_: spark)
    src.sales_panel(spark, SF).write.parquet(str(tmp_path / "panel"))
    cli.main(["full", "--panel", str(tmp_path / "panel"), "--out", str(tmp_path / "out"), "--horizon", "6", "--long-term-horizon", "12"])
    assert spark.read.parquet(str(tmp_path / "out" / "scenarios")).count() == 6 * 12
    assert spark.read.parquet(str(tmp_path / "out" / "leaderboard")).where("place = 1").count() == 6


def test_a_split_table_writes_what_it_touches(spark, tmp_path):
    s, keys = K.Store(spark, str(tmp_path)), ["category_id", "ds", "source"]
    two = rows(spark, ("x", 1.0), ("y", 2.0)).unionByName(rows(spark, ("x", 3.0)).withColumn("category_id", F.lit("d")))
    s.write("time_series", two, split_by="category_id")
    before = s._mark("time_series")["parts"]
    s.upsert("time_series", rows(spark, ("y", 9.0), ("z", 4.0)), keys)
    after = s._mark("time_series")["parts"]
    assert before["d"] == after["d"] and before["c"] != after["c"]
    assert {(r.category_id, r.source): r.value for r in s.read("time_series").collect()} == {("c", "x"): 1.0, ("c", "y"): 9.0, ("c", "z"): 4.0, ("d", "x"): 3.0}
    assert s.vacuum("time_series") == 1 and s.read("time_series").count() == 4
    mark = s._mark("time_series")
    s.upsert("time_series", rows(spark, ("q", 1.0)), keys)
    with pytest.raises(RuntimeError):  # a second writer that started from the same version
        s._commit("time_series", mark, {}, None)
    assert s.read("time_series").count() == 5


def test_providers_ask_and_read(spark):
    assert P.retail_requests(2020, 2021)[1].endswith("time=2021") and "category_code" in P.retail_requests(2020, 2020)[0]
    macro = P.macro_requests(["UNRATE"], "2020-01-01", "2020-12-31", "k")[0]
    assert "series_id=UNRATE" in macro and P.market_requests(["^GSPC"])[0].startswith(P.MARKET_URL + "%5EGSPC?")
    cells = [["data_type_code", "time_slot_id", "seasonally_adj", "category_code", "cell_value"], ["SM", "M02", "yes", "44X72", "5"], ["SM", "M03", "yes", "44X72", "M"]]
    got = P.retail_rows(spark.createDataFrame([(P.retail_requests(2020, 2020)[0], json.dumps(cells))], "key string, payload string")).collect()
    assert [tuple(r) for r in got] == [(dt.date(2020, 2, 29), "44X72", 5.0)]
    found = {"observations": [{"date": "2020-01-01", "value": "3.5"}, {"date": "2020-02-01", "value": "."}]}
    got = P.macro_rows(spark.createDataFrame([(macro, json.dumps(found))], "key string, payload string")).collect()
    assert [tuple(r) for r in got] == [(dt.date(2020, 1, 31), "UNRATE", 3.5)]
    quote = {"open": [1.0, 2.0], "high": [1.0, 2.0], "low": [1.0, 2.0], "close": [1.5, None], "volume": [3, 4]}
    chart = {"chart": {"result": [{"meta": {"symbol": "A"}, "timestamp": [86400, 172800], "indicators": {"quote": [quote]}}]}}
    got = P.market_rows(spark.createDataFrame([("u", json.dumps(chart))], "key string, payload string")).collect()
    assert [tuple(r) for r in got] == [("A", dt.date(1970, 1, 2), 1.0, 1.0, 1.0, 1.5, 3)]


def test_file_ages(spark, tmp_path):
    (tmp_path / "a.csv").write_text("x")
    assert [r.is_old for r in src.file_ages(spark, str(tmp_path), 1.0).collect()] == [False]
    assert [r.is_old for r in src.file_ages(spark, str(tmp_path), -1.0).collect()] == [True]


def test_presets_columns_and_reports(spark):
    assert {r.series_id for r in catalog.preset(spark, "rates").collect()} == {"FEDFUNDS"}
    a, b = spark.createDataFrame([(1, 2.0, 3.0)], "id int, lag_1 double, z double"), spark.createDataFrame([(1, 2.0)], "id int, LAG double")
    assert H.columns_like(a, "LAG") == ["lag_1"] and Q.common_columns([a, b]) == ["id"]
    board = spark.createDataFrame([("s", "m", 1.0, 1)], "unique_id string, model string, mae double, place int")
    assert "# Training" in training_report(board, board, board)
    x = spark.range(30).select(F.col("id").cast("double").alias("p"), (F.col("id") * 2.0).alias("q"), F.rand(1).alias("r"))
    assert Q.uncorrelated(x, ["p", "q", "r"]) == ["p", "r"]


def test_series_upserts_from_a_stream(spark, tmp_path):
    rows(spark, ("x", 1.0), ("y", 2.0)).write.parquet(str(tmp_path / "in"))
    s = K.Store(spark, str(tmp_path / "store"))
    stream = spark.readStream.schema(K.TABLES["time_series"]).parquet(str(tmp_path / "in"))
    q = B.run_once(stream, B.upsert_into(s, "time_series", ["category_id", "ds", "source"]), str(tmp_path / "mark"))
    q.awaitTermination(120)
    assert s.read("time_series").count() == 2


def test_trees_ahead_beat_the_mean(spark):
    n = 84
    days = [(dt.date(2000 + (k + 1) // 12, (k + 1) % 12 + 1, 1) - dt.timedelta(1)) for k in range(n)]
    panel = spark.createDataFrame([(u, day, 100.0 + 30 * math.sin(day.month / 12 * 2 * math.pi) + u_n) for u_n, u in enumerate("ab") for day in days], "unique_id string, ds date, y double")
    got = L.tree_forecast(panel.where("ds <= '2005-12-31'"), L.forest(numTrees=20)).collect()
    truth = {(r.unique_id, r.ds): r.y for r in panel.collect()}
    assert len(got) == 24 and sum(abs(r.yhat - truth[r.unique_id, r.ds]) for r in got) / 24 < 10
    fit = L.in_sample(panel, L.forest(numTrees=20)).collect()
    assert sum(r.padded for r in fit) == 48 and all(r.yhat == r.y for r in fit if r.padded) and len(fit) == 2 * n
