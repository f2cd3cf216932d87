"""Markdown reports from small result tables (one row a series or model)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _cell(value: object) -> str:
    if value is None:
        return "-"
    return f"{value:,.4f}" if isinstance(value, float) else str(value)


def markdown(df: DataFrame, title: str, rows: int = 200) -> str:
    """A table of the first rows of df in its order."""
    lines = [f"## {title}", "", "| " + " | ".join(df.columns) + " |", "|" + "---|" * len(df.columns)]
    lines += ["| " + " | ".join(map(_cell, r)) + " |" for r in df.limit(rows).collect()]
    return "\n".join(lines) + "\n"


def finite(df: DataFrame) -> DataFrame:
    """NaN and infinities as null, for sinks of JSON."""
    fix = lambda c: F.when(~F.isnan(c) & (F.abs(c) != float("inf")), F.col(c))
    return df.withColumns({f.name: fix(f.name) for f in df.schema if f.dataType.typeName() in ("double", "float")})


def training_report(board: DataFrame, models: DataFrame, overall: DataFrame) -> str:
    return "# Training\n\n" + markdown(overall, "Overall") + "\n" + markdown(models.orderBy("model"), "Models") + "\n" + markdown(board.where("place = 1").orderBy("unique_id"), "Best model by series")
