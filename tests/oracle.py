"""Spark rows against DuckDB rows: same columns, same multiset of rows, doubles to a relative 1e-9."""

from __future__ import annotations

import math
from pathlib import Path

import duckdb


def run_sql(sql: str, sf_dir: str) -> tuple[list[str], list[tuple]]:
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for p in sorted(Path(sf_dir).glob("*.parquet")):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM read_parquet('{p}{'/*' if p.is_dir() else ''}')")
    got = con.execute(sql)
    return [c[0] for c in got.description], got.fetchall()


def _key(row: tuple) -> tuple:
    return tuple((v is None, "" if v is None else f"{v:.6g}" if isinstance(v, float) else str(v)) for v in row)


def _same(a: object, b: object) -> bool:
    if isinstance(a, float) and isinstance(b, float):
        return a == b or math.isclose(a, b, rel_tol=1e-9, abs_tol=1e-9)
    return a == b and isinstance(a, float) == isinstance(b, float)


def difference(df, sql: str, sf_dir: str) -> str:
    """What differs, empty if nothing does."""
    names, rows = run_sql(sql, sf_dir)
    if sorted(df.columns) != sorted(names):
        return f"columns {sorted(df.columns)} and {sorted(names)}"
    order = sorted(names)
    mine = sorted((tuple(r[c] for c in order) for r in df.collect()), key=_key)
    theirs = sorted((tuple(r[names.index(c)] for c in order) for r in rows), key=_key)
    if len(mine) != len(theirs):
        return f"{len(mine)} and {len(theirs)} rows"
    bad = [(a, b) for a, b in zip(mine, theirs) if not all(map(_same, a, b))]
    return f"{len(bad)} of {len(mine)} rows, as {order}: {bad[:2]}" if bad else ""
