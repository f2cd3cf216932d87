"""How a query is put down beside its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

# SQL of the shared inputs; each is a list of common table expressions
SALES = """s AS (SELECT p_type AS unique_id, last_day(l_shipdate) AS ds, round(sum(l_extendedprice * (1 - l_discount)), 4) AS y
  FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2), p AS (SELECT * FROM s WHERE ds < (SELECT max(ds) FROM s))"""
TOTAL = """t0 AS (SELECT last_day(l_shipdate) AS ds, round(sum(l_extendedprice * (1 - l_discount)), 4) AS y FROM lineitem GROUP BY 1),
t AS (SELECT 'total' AS unique_id, ds, y FROM t0 WHERE ds < (SELECT max(ds) FROM t0))"""
MACRO = """m0 AS (SELECT last_day(o_orderdate) AS ds, o_orderpriority AS series_id, round(avg(o_totalprice), 4) AS value FROM orders GROUP BY 1, 2),
m AS (SELECT * FROM m0 WHERE ds < (SELECT max(ds) FROM m0))"""
SEGMENTS = """g0 AS (SELECT last_day(o_orderdate) AS ds, c_mktsegment AS series_id, round(avg(o_totalprice), 4) AS value FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2),
g AS (SELECT * FROM g0 WHERE ds < (SELECT max(ds) FROM g0))"""
BARS = """b AS (SELECT o_orderpriority AS symbol, o_orderdate::DATE AS ds, arg_min(o_totalprice, (o_orderdate, o_orderkey)) AS open, max(o_totalprice) AS high,
  min(o_totalprice) AS low, arg_max(o_totalprice, (o_orderdate, o_orderkey)) AS close, count(*) AS volume FROM orders GROUP BY 1, 2)"""
EVENT_BARS = """b AS (SELECT event_type AS symbol, ts::DATE AS ds, arg_min(value, (ts, event_id)) AS open, max(value) AS high,
  min(value) AS low, arg_max(value, (ts, event_id)) AS close, count(*) AS volume FROM events GROUP BY 1, 2)"""
W = "WINDOW w AS (PARTITION BY unique_id ORDER BY ds)"


def r(sql: str, name: str, digits: int = 6) -> str:
    """A double of the oracle, rounded as rounded() does; -0 becomes 0."""
    return f"round({sql}, {digits}) + 0.0 AS {name}"


def frame(n: int, part: str = "PARTITION BY unique_id ORDER BY ds", shift: int = 0) -> str:
    return f"OVER ({part} ROWS BETWEEN {n - 1 + shift} PRECEDING AND {f'{shift} PRECEDING' if shift else 'CURRENT ROW'})"


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    return df.withColumns({f.name: F.round(f.name, digits) + F.lit(0.0) for f in df.schema if f.dataType.typeName() in ("double", "float")})


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def put(f: Query) -> Query:
        QUERIES[name] = lambda spark, sf_dir: rounded(f(spark, sf_dir))
        if sql:
            ORACLES[name] = sql
        return f

    return put
