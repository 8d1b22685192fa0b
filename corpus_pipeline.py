"""The corpus pipeline: toxic documents go, one of each near-duplicate group stays, benchmark leaks go, personal data is
replaced, the rest is packed. Each stage's result is written as Parquet and read again by the next.

In every stage null and empty texts count as empty, long texts are taken whole, an empty table gives an empty one, and
further columns keep their names and values, whatever they are called, up to the last stage, which has columns of its own."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tideline.llm import decontam, minhash, packing, pii, toxicity
from tideline.llm.common import stage


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The rows whose text the classifier, fitted on the labelled training rows, scores below its threshold.

    Rows that repeat stay or go together; without labels of both kinds all rows have one score.
    """
    model = toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.keep_clean(docs, model)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The smallest doc_id of each group of near-duplicates from a similarity of 0.8 on, its repeated rows once.

    Texts without words have no group, and rows without doc_id all stay.
    """
    return minhash.keep_one(docs, percent=80)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The rows whose text holds no benchmark item or passage; rows that repeat stay or go together."""
    return decontam.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), passages=decontam.Passages())


def replace_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows, with the spans of personal data in ``text`` replaced by their kinds; n_chars follows."""
    return pii.redact(docs, pii.train(docs))


def pack_windows(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of every document in windows of 2048 ids; a text without ids is its end id alone."""
    return packing.pack(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_leaks),
    ("personal_data", replace_personal_data),
    ("packing", pack_windows),
]
#: No SQL: most stages can't be expressed in it.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, function in STAGES:
        docs = stage(function(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
