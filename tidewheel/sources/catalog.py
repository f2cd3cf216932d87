"""The series catalogue: one dimension table for all modules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Ids, codes and names of public statistics.
SERIES = [
    # series_id, code, name, kind, preset
    ("RSAFS", "44X72", "Total Retail Sales", "retail", "total"),
    ("RSMVPD", "441", "Motor Vehicle and Parts Dealers", "retail", "durable"),
    ("RSFHFS", "442", "Furniture and Home Furnishings", "retail", "durable"),
    ("RSEAS", "443", "Electronics and Appliances", "retail", "durable"),
    ("RSBMGESD", "444", "Building Materials and Garden", "retail", "durable"),
    ("RSDBS", "445", "Food and Beverage", "retail", "nondurable"),
    ("RSHPCS", "446", "Health and Personal Care", "retail", "nondurable"),
    ("RSGASS", "447", "Gasoline Stations", "retail", "nondurable"),
    ("RSCCAS", "448", "Clothing and Accessories", "retail", "nondurable"),
    ("RSSGHBMS", "451", "Sporting Goods, Hobby, Books", "retail", "nondurable"),
    ("RSGMS", "452", "General Merchandise", "retail", "nondurable"),
    ("RSMSR", "453", "Miscellaneous Store Retailers", "retail", "nondurable"),
    ("RSNSR", "454", "Nonstore Retailers", "retail", "nondurable"),
    ("CPIAUCSL", None, "cpi", "macro", "inflation"),
    ("FEDFUNDS", None, "interest_rates", "macro", "rates"),
    ("UNRATE", None, "unemployment", "macro", "employment"),
    ("UMCSENT", None, "consumer_sentiment", "macro", "confidence"),
    ("M2SL", None, "money_supply", "macro", "money"),
    ("INDPRO", None, "industrial_production", "macro", "output"),
    ("PCE", None, "consumer_spending", "macro", "output"),
    ("^GSPC", None, "S&P 500", "market", "indices"),
    ("^IXIC", None, "Nasdaq", "market", "indices"),
    ("^VIX", None, "Volatility Index", "market", "indices"),
    ("CL=F", None, "Oil", "market", "commodities"),
    ("GC=F", None, "Gold", "market", "commodities"),
]


def catalog(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(SERIES, "series_id string, code string, name string, kind string, preset string")


def like_name(col: Column, name: str) -> Column:
    """Names are compared without case, blanks and underscores alike."""
    bare = lambda c: F.regexp_replace(F.lower(c), "[ _]+", " ")
    return bare(col) == bare(F.lit(name))


def preset(spark: SparkSession, name: str) -> DataFrame:
    return catalog(spark).where(F.col("preset") == name)
