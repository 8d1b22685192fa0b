"""Command line: ``python -m tideline precache`` and ``python -m tideline train``."""

from __future__ import annotations

import argparse
import logging

from pyspark.sql import SparkSession

from tideline.operators import experiment
from tideline.sources import config, market


def main(args: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="tideline")
    commands = parser.add_subparsers(dest="command", required=True)
    pre = commands.add_parser("precache", help="cache the news of a ticker set")
    pre.add_argument("--config", required=True, help="YAML with root, news_source and tickers (sets by name)")
    pre.add_argument("--cache", required=True)
    pre.add_argument("--ticker-set", default="dev")
    train = commands.add_parser("train", help="run an experiment, or a sweep with --multirun")
    train.add_argument("--config", required=True)
    train.add_argument("--cache", required=True)
    train.add_argument("--multirun", action="store_true")
    train.add_argument("--jobs", type=int, default=1, help="configurations of a sweep at a time")
    train.add_argument("overrides", nargs="*", help="key=value; with --multirun several values, separated by commas")
    chosen = parser.parse_args(args)
    logging.basicConfig(level=logging.INFO, format="%(asctime)s %(levelname)s %(name)s %(message)s")
    builder = SparkSession.builder.appName("tideline")
    spark = (builder.config("spark.scheduler.mode", "FAIR") if getattr(chosen, "jobs", 1) > 1 else builder).getOrCreate()
    if chosen.command == "precache":
        data = config.load(chosen.config)
        found = market.precache(spark, market.news_path(data["root"], data["news_source"]), chosen.cache, data["news_source"], data["tickers"], chosen.ticker_set)
        for row in found.orderBy("ticker").collect():  # a row a configured ticker
            print(row["ticker"], row["n"], sep="\t")
        return
    run = lambda cfg: experiment.run_training(cfg, experiment.datasets(spark, cfg, chosen.cache))
    if chosen.multirun:
        for done in experiment.sweep(spark, chosen.config, tuple(chosen.overrides), run, chosen.jobs):
            print(" ".join(done.overrides), done.result if done.error is None else f"failed: {done.error}")
    else:
        print(run(config.load(chosen.config, tuple(chosen.overrides))))


if __name__ == "__main__":
    main()
