"""Statistics-office payloads: arrays of string arrays, the first of which names the columns."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import period_month, positive_number

# How a year's sales spread over its months; they sum to 1.010 and are normalised on use.
MONTH_WEIGHTS = [0.075, 0.068, 0.078, 0.072, 0.075, 0.080, 0.082, 0.085, 0.083, 0.088, 0.105, 0.119]


def parse(payloads: DataFrame, json_col: str = "payload", keep: list[str] = ()) -> DataFrame:
    """Rows of payloads as maps from column name to text, with the columns to keep."""
    cells = payloads.withColumn("_rows", F.from_json(json_col, "array<array<string>>"))
    head = F.element_at("_rows", 1)
    rows = cells.select(*keep, head.alias("_head"), F.explode(F.slice("_rows", 2, F.greatest(F.size("_rows") - 1, F.lit(0)))).alias("_row"))
    return rows.where(F.size("_head") == F.size("_row")).select(*keep, F.map_from_arrays("_head", "_row").alias("cells"))


def monthly_observations(parsed: DataFrame, year_col: str = "year", data_type: str = "SM", adjusted: str | None = "yes") -> DataFrame:
    """ds, category_code, value of monthly slots; suppressed, zero and non-numeric cells go."""
    get = lambda c: F.col("cells")[c]
    rows = parsed.where(get("data_type_code") == data_type)
    if adjusted:
        rows = rows.where(get("seasonally_adj") == adjusted)
    out = rows.select(
        F.last_day(F.make_date(F.col(year_col).cast("int"), period_month(get("time_slot_id")), F.lit(1))).alias("ds"), get("category_code").alias("category_code"), positive_number(get("cell_value")).alias("value")
    )
    return out.where("ds is not null and value is not null")


def annual_records(parsed: DataFrame, year_col: str = "year") -> DataFrame:
    """year, category_code, value: the largest annual cell of each category and year."""
    get = lambda c: F.col("cells")[c]
    rows = parsed.where(get("time_slot_id") == "0").select(F.col(year_col).cast("int").alias("year"), get("category_code").alias("category_code"), positive_number(get("cell_value")).alias("value"))
    return rows.groupBy("year", "category_code").agg(F.max("value").alias("value")).where("value is not null")


def spread_over_months(annual: DataFrame, year_col: str = "year", value_col: str = "value") -> DataFrame:
    """Each annual value as twelve monthly ones that sum to it."""
    total = sum(MONTH_WEIGHTS)
    weights = F.lit([w / total for w in MONTH_WEIGHTS])
    rows = annual.select(*[c for c in annual.columns if c != value_col], F.col(value_col).alias("_v"), F.posexplode(weights).alias("_m", "_w"))
    return rows.withColumn("ds", F.last_day(F.make_date(F.col(year_col), F.col("_m") + 1, F.lit(1)))).withColumn(value_col, F.col("_v") * F.col("_w")).drop("_v", "_m", "_w")
