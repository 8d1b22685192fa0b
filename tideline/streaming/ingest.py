"""News files that keep arriving, into the partitioned cache."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tideline.sources.market import NEWS_COLUMNS

RAW = ", ".join(f"{c} string" for c in NEWS_COLUMNS)


def ingest_stream(spark: SparkSession, landing: str, target: str, checkpoint: str) -> StreamingQuery:
    """Append each new CSV under ``landing`` once to ``target``, partitioned by ticker, and end when none is left.

    Files must have the columns of ``NEWS_COLUMNS`` in that order; a header that says otherwise ends the query with an error and
    appends nothing of that file. The file sink's log and ``checkpoint`` make reruns and
    lost executors append nothing twice. ``news_id`` is a hash of file and row text, as streams have no row numbers.
    """
    raw = spark.readStream.schema(RAW).csv(landing, header=True, multiLine=True, quote='"', escape='"', enforceSchema=False)
    rows = raw.select(
        F.xxhash64("_metadata.file_name", *NEWS_COLUMNS).alias("news_id"), F.try_to_timestamp("Date").alias("date"), F.col("Stock_symbol").alias("ticker"), F.col("Article_title").alias("title"),
        F.col("Url").alias("url"), F.col("Publisher").alias("publisher"), F.col("Author").alias("author"), F.col("Article").alias("article"),
    )
    return rows.writeStream.format("parquet").partitionBy("ticker").option("path", target).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
