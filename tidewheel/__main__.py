"""python -m tidewheel MODE: backtest, forecast, long-term or quality over a panel of unique_id, ds, y in Parquet; or fetch, which reads a service into one."""

from __future__ import annotations

import argparse
import json
import os

from pyspark.sql import functions as F

from .config import Config
from .operators import features, forecast, metrics, models, quality
from .report import finite
from .session import session
from .sources import providers
from .sources.rest import PayloadSource

#: What each service is asked for, and how its answers are read.
SERVICES = {
    "retail": (lambda years: providers.retail_requests(int(min(years)), int(max(years)), os.environ.get("CENSUS_API_KEY", "")), providers.retail_rows),
    "macro": (lambda names: providers.macro_requests(names, "1990-01-01", "2100-01-01", os.environ.get("FRED_API_KEY", "")), providers.macro_rows),
    "market": (lambda names: providers.market_requests(names), providers.market_rows),
}


def main(argv: list[str] | None = None) -> None:
    p = argparse.ArgumentParser(prog="tidewheel", description=__doc__)
    p.add_argument("mode", choices=["fetch", "backtest", "train", "predict", "long-term", "quality", "full"])
    p.add_argument("--panel", help="folder of Parquet files with unique_id, ds, y")
    p.add_argument("--out", required=True, help="folder for results")
    p.add_argument("--config")
    p.add_argument("--targets", nargs="*", help="series to take; all by default")
    p.add_argument("--horizon", type=int)
    p.add_argument("--long-term-horizon", type=int)
    p.add_argument("--no-scenarios", action="store_true")
    p.add_argument("--no-features", action="store_true", help="leave the feature profile out of full")
    p.add_argument("--all", action="store_true", help="take denied series too")
    p.add_argument("--service", choices=sorted(SERVICES), help="of fetch: what to ask")
    p.add_argument("--names", nargs="*", default=[], help="of fetch: years, series or symbols")
    p.add_argument("--fetcher", default="tidewheel.sources.providers.http_get")
    a = p.parse_args(argv)
    config = Config.load(a.config) if a.config else Config()
    spark = session("tidewheel " + a.mode)
    if a.mode == "fetch":
        requests, parse = SERVICES[a.service]
        spark.dataSource.register(PayloadSource)
        got = spark.read.format("payloads").option("keys", json.dumps(requests(a.names))).option("fetcher", a.fetcher).load()
        parse(got).write.mode("overwrite").parquet(f"{a.out}/{a.service}")
        return
    panel = spark.read.parquet(a.panel).select("unique_id", "ds", "y")
    if not a.all:
        panel = panel.where(~F.col("unique_id").isin(config.get("forecast.deny")))
    if a.targets:
        panel = panel.where(F.lower("unique_id").isin([t.lower() for t in a.targets]))
    h, long = a.horizon or config.get("forecast.horizon"), a.long_term_horizon or config.get("forecast.long_term_horizon")
    put = lambda df, name: finite(df).write.mode("overwrite").parquet(f"{a.out}/{name}")
    every = a.mode == "full"
    if every and not a.no_features:
        put(features.model_profile(panel), "features")
    if a.mode == "quality" or every:
        put(quality.panel_report(panel), "panel")
        put(quality.checks(panel, config.get("quality.min_rows")), "checks")
        put(quality.series_report(panel, "unique_id", "ds", "y"), "quality")
    if a.mode in ("backtest", "train") or every:
        naive = forecast.seasonal_naive_backtest(panel, config.get("forecast.folds"), h).select("unique_id", F.lit("seasonal_naive").alias("model"), "fold", "step", "ds", "y", "yhat")
        fitted = models.backtest_models(panel, config.get("forecast.folds"), h)
        pairs = naive.unionByName(fitted.select(naive.columns))
        put(pairs, "backtest")
        put(metrics.leaderboard(metrics.all_metrics(pairs, ["unique_id", "model"]), "unique_id", "mae"), "leaderboard")
    if a.mode == "predict" or every:
        put(models.forecast_models(panel, h), "forecast")
    if a.mode == "long-term" or every:
        ahead = forecast.long_term(panel, long)
        put(ahead, "long_term")
        if not a.no_scenarios:
            put(forecast.scenarios(ahead, forecast.growth_stats(panel)), "scenarios")


if __name__ == "__main__":
    main()
