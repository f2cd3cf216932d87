"""Helpers shared by the training-data operators.

Nothing here knows about a particular table: columns are passed by name.
"""

from __future__ import annotations

import tempfile
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A key is heavy when it holds at least one row in HEAVY_SHARE of the table,
#: so at most HEAVY_SHARE keys can be heavy, whatever the size of the table.
HEAVY_SHARE = 1000

#: Keys that are broadcast at most, of some tens of bytes each; more are shuffled.
MAX_KEYS = 200_000

#: Rows of a settled table that a task reads at least.
ROWS_A_TASK = 20_000

#: White space between words, fixed by the contracts: space and \t \n \v \f \r.
WORD = r"[^\x20\x09-\x0D]+"


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Leave spark.checkpoint.dir alone; name a local folder only where it is unset (tests)."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        named = sc.getConf().get("spark.checkpoint.dir")
        if not named and not sc.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="tidewheel-"))


def settle(df: DataFrame) -> DataFrame:
    """Cut the lineage in the shared checkpoint folder; a lost executor costs no recomputation before it.

    A table of few rows is read back by few tasks, so that what is done with it
    next does not write a shuffle file for each of many empty partitions.
    """
    ensure_checkpoint_dir(df.sparkSession)
    kept = df.checkpoint(eager=True)
    n = kept.count()
    out = kept.coalesce(n // ROWS_A_TASK + 1)
    out.settled_rows = n
    return out


def row_count(df: DataFrame) -> int:
    """Rows of a table, known already if it was settled."""
    n = getattr(df, "settled_rows", None)
    return df.count() if n is None else n


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def split_heavy(left: DataFrame, right: DataFrame, key: str, n_left: int, count_col: str) -> tuple[DataFrame, DataFrame]:
    """The inner join of left and right on key, as (heavy part, remaining part).

    right has one row a key and, in count_col, how many rows of left carry it.
    Keys of at least n_left / HEAVY_SHARE rows are joined where left's rows
    lie: at most HEAVY_SHARE of them exist, so that broadcast is bounded. All
    other keys are joined by a shuffle, in which none is large.
    """
    bar = max(2, n_left // HEAVY_SHARE)
    heavy = F.broadcast(right.where(F.col(count_col) > bar))
    rest = right.where(F.col(count_col) <= bar)
    cold = left.join(F.broadcast(right.where(F.col(count_col) > bar).select(key)), key, "left_anti")
    return left.join(heavy, key), cold.join(rest, key)


def word_count(text: Column) -> Column:
    """Words of a text, by the contracts' definition of a word; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def join_unique(left: DataFrame, right: DataFrame, key: str, how: str = "inner") -> DataFrame:
    """left joined (inner or left) to right, which has one row a key, however many rows of left share a key.

    Keys that HEAVY_SHARE rows in left or more share out of all are counted
    first; there are at most HEAVY_SHARE of them, and their rows of right are
    broadcast. left is read twice, so it should be settled.
    """
    counts = left.groupBy(key).agg(F.count(F.lit(1)).alias("_n"))
    bar = max(2, row_count(left) // HEAVY_SHARE)
    hot = F.broadcast(settle(counts.where((F.col("_n") > bar) & F.col(key).isNotNull()).select(key)))
    heavy = left.join(hot, key, "left_semi").join(F.broadcast(right.join(hot, key, "left_semi")), key, how)
    rest = left.join(hot, key, "left_anti").join(right, key, how)
    return heavy.unionByName(rest)


def _meet(docs: DataFrame, keys: DataFrame, found: list[Column], how: str) -> DataFrame:
    names = free_names(docs, len(keys.columns))
    keys = settle(keys.toDF(*names))
    few = row_count(keys) <= MAX_KEYS
    on = reduce(Column.__and__, [value.eqNullSafe(F.col(name)) for value, name in zip(found, names, strict=True)])
    return docs.join(F.broadcast(keys) if few else keys, on, how)


def drop_rows(docs: DataFrame, keys: DataFrame, found: list[Column]) -> DataFrame:
    """The rows of docs whose values of found, nulls included, are not a row of keys; columns of docs may have any names.

    Up to MAX_KEYS keys come to where the rows lie; beyond that the rows are
    shuffled once. Either way gives the same rows.
    """
    return _meet(docs, keys, found, "left_anti")


def take_rows(docs: DataFrame, keys: DataFrame, found: list[Column]) -> DataFrame:
    """The rows of docs that drop_rows() drops."""
    return _meet(docs, keys, found, "left_semi")


def one_of_each(docs: DataFrame, found: list[Column]) -> DataFrame:
    """One row of docs for each of the different values of found."""
    names = free_names(docs, len(found))
    return docs.withColumns(dict(zip(names, found, strict=True))).dropDuplicates(names).drop(*names)


def quoted(names: list[str]) -> list[str]:
    """Column names as expressions, whatever signs they hold."""
    return ["`" + name.replace("`", "``") + "`" for name in names]


def free_names(df: DataFrame, n: int) -> list[str]:
    """So many column names that df does not have, however they are spelt."""
    taken, out, i = {c.lower() for c in df.columns}, [], 0
    while len(out) < n:
        if f"tw_{i}" not in taken:
            out.append(f"tw_{i}")
        i += 1
    return out
