"""Run tracking as append-only Parquet tables, and the explanation file."""

from __future__ import annotations

import time
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .config import flatten

PARAMS = "run string, key string, value string, ts double"
METRICS = "run string, key string, value double, step int, ts double"


class Run:
    """Collects a run's parameters and metrics; leaving the block appends them, one file a table. A disabled run does nothing."""

    def __init__(self, spark: SparkSession, root: str, run: str, enabled: bool = True) -> None:
        self.spark, self.root, self.run, self.enabled = spark, root, run, enabled
        self.params: list[tuple] = []
        self.metrics: list[tuple] = []

    def __enter__(self) -> Run:
        return self

    def __exit__(self, *_: object) -> None:
        for name, rows, schema in (("params", self.params, PARAMS), ("metrics", self.metrics, METRICS)):
            if self.enabled and rows:
                self.spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{self.root}/{name}")
        self.params, self.metrics = [], []

    def log_config(self, tree: dict[str, Any]) -> None:
        self.params += [(self.run, k, None if v is None else str(v), time.time()) for k, v in flatten(tree).items()]

    def log_metrics(self, values: dict[str, float | None], step: int = 0) -> None:
        self.metrics += [(self.run, k, None if v is None else float(v), step, time.time()) for k, v in values.items()]


def read_params(spark: SparkSession, root: str) -> DataFrame:
    return spark.read.schema(PARAMS).parquet(f"{root}/params")


def read_metrics(spark: SparkSession, root: str) -> DataFrame:
    return spark.read.schema(METRICS).parquet(f"{root}/metrics")


def write_examples(examples: DataFrame, path: str) -> None:
    """Explanation rows as JSON lines; meta stays nested, and is an empty object where there is none."""
    rows = examples.select("proto_id", "window_no", "seg_no", "distance", F.when(F.col("meta").isNotNull(), F.col("meta")).alias("meta"))
    rows.coalesce(1).write.mode("overwrite").option("ignoreNullFields", "true").json(path)
