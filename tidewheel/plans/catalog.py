"""All queries of the analytics engine, by name, and their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import bars, datasets, forecasts, joins, panels, scores, searched, stores
from .base import ORACLES as ORACLES
from .base import QUERIES as QUERIES

Query = Callable[[SparkSession, str], DataFrame]
MODULES = (panels, bars, joins, forecasts, stores, datasets, searched, scores)
