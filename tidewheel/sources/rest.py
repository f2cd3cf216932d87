"""A data source of yearly or per-series payloads, one partition each.

What is fetched is a function the user brings (an HTTP call, a file, a mock);
it must be importable on the executors. A failing fetch is tried again, then
fails the task, which Spark itself tries again elsewhere.
"""

from __future__ import annotations

import importlib
import json
import time
from collections.abc import Iterator

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition


class Slice(InputPartition):
    def __init__(self, key: str):
        self.key = key


class PayloadReader(DataSourceReader):
    def __init__(self, options: dict):
        keys = options.get("keys", "")
        self.keys = json.loads(keys) if keys.startswith("[") else [k for k in keys.split(",") if k]
        self.fetcher, self.tries, self.wait = options["fetcher"], int(options.get("tries", "3")), float(options.get("wait", "0.1"))

    def partitions(self) -> list[Slice]:
        return [Slice(k) for k in self.keys]

    def read(self, partition: Slice) -> Iterator[tuple]:
        module, _, name = self.fetcher.rpartition(".")
        fetch = getattr(importlib.import_module(module), name)
        for left in reversed(range(self.tries)):
            try:
                yield partition.key, fetch(partition.key)
                return
            except OSError:
                if not left:
                    raise
                time.sleep(self.wait)


class PayloadSource(DataSource):
    """spark.dataSource.register(PayloadSource); spark.read.format("payloads").option("keys", "2023,2024").option("fetcher", "my.module.fetch").load(); keys that hold commas, such as addresses, as a JSON list"""

    @classmethod
    def name(cls) -> str:
        return "payloads"

    def schema(self) -> str:
        return "key string, payload string"

    def reader(self, schema) -> PayloadReader:
        return PayloadReader(self.options)
