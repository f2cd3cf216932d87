"""Requests to public statistics and market services, and the rows in their answers.

A request is a row (key, url), so a table of requests is dealt out like any
other; PayloadSource fetches each in a partition of its own. Parsers take the
fetched payloads (key, payload) and give one schema a kind of service.
"""

from __future__ import annotations

import urllib.parse
import urllib.request
from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import payload as P

# Addresses and parameters of the public services.
RETAIL_URL = "https://api.census.gov/data/timeseries/eits/mrts"
RETAIL_FIELDS = "data_type_code,time_slot_id,seasonally_adj,category_code,cell_value,error_data"
MACRO_URL = "https://api.stlouisfed.org/fred/series/observations"
MARKET_URL = "https://query1.finance.yahoo.com/v8/finance/chart/"


def http_get(url: str) -> str:
    """The fetcher of PayloadSource for real services."""
    with urllib.request.urlopen(url, timeout=60) as answer:
        return answer.read().decode()


def retail_requests(first_year: int, last_year: int, api_key: str = "") -> list[str]:
    """One address a year."""
    fixed = {"get": RETAIL_FIELDS} | ({"key": api_key} if api_key else {})
    return [f"{RETAIL_URL}?{urllib.parse.urlencode(fixed | {'time': str(year)})}" for year in range(first_year, last_year + 1)]


def macro_requests(series: Iterable[str], start: str, end: str, api_key: str) -> list[str]:
    """One address a series."""
    fixed = {"api_key": api_key, "file_type": "json", "observation_start": start, "observation_end": end}
    return [f"{MACRO_URL}?{urllib.parse.urlencode({'series_id': s} | fixed)}" for s in series]


def market_requests(symbols: Iterable[str], span: str = "10y", interval: str = "1d") -> list[str]:
    """One address a symbol."""
    return [f"{MARKET_URL}{urllib.parse.quote(s)}?{urllib.parse.urlencode({'range': span, 'interval': interval})}" for s in symbols]


def retail_rows(payloads: DataFrame) -> DataFrame:
    """ds, category_code, value of the adjusted monthly sales; the year comes from the request."""
    year = F.regexp_extract("key", r"[?&]time=(\d{4})", 1)
    return P.monthly_observations(P.parse(payloads.withColumn("year", year), keep=["year"]))


def macro_rows(payloads: DataFrame) -> DataFrame:
    """ds, series_id, value; '.' is a missing value and goes."""
    found = payloads.select(F.regexp_extract("key", r"[?&]series_id=([^&]+)", 1).alias("series_id"), F.from_json("payload", "observations array<struct<date: string, value: string>>").alias("p"))
    rows = found.select("series_id", F.explode("p.observations").alias("o"))
    return rows.select(F.last_day(F.try_to_date("o.date")).alias("ds"), "series_id", F.col("o.value").try_cast("double").alias("value")).where("ds is not null and value is not null")


def market_rows(payloads: DataFrame) -> DataFrame:
    """symbol, ds, open, high, low, close, volume of the days that have a closing price."""
    quote = "struct<open: array<double>, high: array<double>, low: array<double>, close: array<double>, volume: array<bigint>>"
    shape = f"chart struct<result: array<struct<meta: struct<symbol: string>, timestamp: array<bigint>, indicators: struct<quote: array<{quote}>>>>>"
    one = payloads.select(F.explode(F.from_json("payload", shape)["chart"]["result"]).alias("r"))
    names = ("open", "high", "low", "close", "volume")
    one = one.select(F.col("r.meta.symbol").alias("symbol"), F.col("r.timestamp").alias("at"), *[F.col("r.indicators.quote")[0][c].alias(c) for c in names])
    rows = one.select("symbol", F.explode(F.arrays_zip("at", *names)).alias("x"))
    return rows.select("symbol", F.to_date(F.timestamp_seconds("x.at")).alias("ds"), *[F.col(f"x.{c}").alias(c) for c in names]).where("close is not null")
