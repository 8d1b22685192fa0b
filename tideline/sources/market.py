"""News and price files: CSV readers, the partitioned Parquet cache, queries by symbol, the price archive."""

from __future__ import annotations

import hashlib
import threading
import uuid
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tideline.sources import archive
from tideline.sources.delimited import read_records
from tideline.sources.files import exists, hadoop_path, remove, rename

NEWS_COLUMNS = ("Date", "Article_title", "Stock_symbol", "Url", "Publisher", "Author", "Article")
NEWS = "news_id long, date timestamp, ticker string, title string, url string, publisher string, author string, article string"
PRICE_VALUES = ("open", "high", "low", "close", "adj close", "volume")


#: One table is written at a time by the threads of a driver.
INGESTING = threading.Lock()


class SourceMissing(FileNotFoundError):
    """A source path that doesn't exist, or a directory without files."""


def news_path(root: str, name: str = "nasdaq_exteral_data") -> str:
    return f"{root}/Stock_news/{name}.csv"


def prices_path(spark: SparkSession, root: str) -> str:
    """The directory of price files; an archive that was extracted into a directory of its own name is looked through."""
    outer = f"{root}/Stock_price/full_history"
    return f"{outer}/full_history" if exists(spark, f"{outer}/full_history") else outer


def fingerprint(spark: SparkSession, path: str) -> str:
    """Changes when the file at ``path`` is replaced: a digest of its size and modification time."""
    system, at = hadoop_path(spark, path)
    if not system.exists(at):
        raise SourceMissing(path)
    status = system.getFileStatus(at)
    return hashlib.sha256(f"{status.getLen()}:{status.getModificationTime()}".encode()).hexdigest()[:16]


def extract_prices(root: str, spark: SparkSession | None = None) -> bool:
    """Unzip ``Stock_price/full_history.zip`` by tasks, beside itself (see ``archive``); True if there was something to do.

    Nothing happens without the archive or where its directory exists already.
    """
    spark = spark or SparkSession.getActiveSession()
    source, target = f"{root}/Stock_price/full_history.zip", f"{root}/Stock_price/full_history"
    if not exists(spark, source) or exists(spark, target):
        return False
    archive.extract(spark, source, target)
    return True


def read_csv(spark: SparkSession, path: str, columns: tuple[str, ...], rejects: bool = False) -> DataFrame:
    """The named columns as strings by each file's own header, null where a file lacks one, with ``_file`` and ``_at``.

    Quotes are doubled, and fields may hold line ends; files are read in splits all the same (see ``delimited``). Lines that
    open a quote for good are left out; with ``rejects`` there is nothing else, and they stand in ``_reject``.
    """
    try:
        rows = read_records(spark, path, columns)
        return rows.filter(F.col("_reject").isNotNull()) if rejects else rows.filter(F.col("_reject").isNull()).drop("_reject")
    except FileNotFoundError as e:
        raise SourceMissing(path) from e
    except AnalysisException as e:
        if "PATH_NOT_FOUND" in str(e):
            raise SourceMissing(path) from e
        raise


def read_news(spark: SparkSession, path: str, limit: int | None = None) -> DataFrame:
    """The NEWS columns of a news CSV. Symbols such as NA stay strings, empty fields are null, dates that can't be read too.

    ``news_id`` grows along files and rows, whatever the splits. ``limit`` takes the first rows.
    """
    raw = read_csv(spark, path, NEWS_COLUMNS).withColumnRenamed("_at", "news_id")
    date = F.coalesce(F.try_to_timestamp("Date"), F.try_to_timestamp(F.regexp_replace("Date", " UTC$", "")))
    rows = raw.select("news_id", date.alias("date"), F.col("Stock_symbol").alias("ticker"), F.col("Article_title").alias("title"), F.col("Url").alias("url"), F.col("Publisher").alias("publisher"), F.col("Author").alias("author"), F.col("Article").alias("article"))
    return rows if limit is None else rows.orderBy("news_id").limit(checked(limit))


def checked(limit: int) -> int:
    if limit < 0:
        raise ValueError("a limit must be 0 or more")
    return limit


def ingest_news(spark: SparkSession, csv: str, cache: str, source: str) -> DataFrame:
    """The cached table of a news CSV, written first if the file has changed since.

    The cache is partitioned by ticker under the source's name and fingerprint. Rows are rebalanced by ticker, so a ticker with
    a large share of the rows is split over tasks and files. A later call reads Parquet only. The table is written under a
    name of its own and renamed, so that runs side by side don't write into each other's files.
    """
    mark = fingerprint(spark, csv)
    at, own = f"{cache}/{source}/{mark}", f"{cache}/{source}/.{mark}-{uuid.uuid4().hex}"
    with INGESTING:
        if not exists(spark, f"{at}/_SUCCESS"):
            read_news(spark, csv).hint("rebalance", "ticker").write.partitionBy("ticker").parquet(own)
            if exists(spark, f"{at}/_SUCCESS"):  # another driver was faster
                remove(spark, own)
            else:
                remove(spark, at)
                rename(spark, own, at)
    return read_cache(spark, at)


def ingest_sources(spark: SparkSession, csvs: dict[str, str], cache: str) -> DataFrame:
    """The cached tables of several news CSVs, by name of the source, one under the other, with the name as ``source``."""
    columns = [c.split()[0] for c in NEWS.split(", ")]
    parts = [ingest_news(spark, csv, cache, name).select(*columns, F.lit(name).alias("source")) for name, csv in sorted(csvs.items())]
    return reduce(DataFrame.unionByName, parts) if parts else spark.createDataFrame([], NEWS + ", source string")


def read_cache(spark: SparkSession, path: str) -> DataFrame:
    """The cached news; tickers keep their type as strings, whatever they look like."""
    return spark.read.schema(NEWS).parquet(path)


def news_for_symbol(news: DataFrame, symbol: str, max_rows: int | None = None, ticker: str = "ticker", order: str = "news_id") -> DataFrame:
    """A symbol's news, case counting; with ``max_rows`` the first ones in file order. Unknown symbols give no rows, with the schema."""
    hits = news.filter(F.col(ticker) == symbol)
    return hits if max_rows is None else hits.orderBy(order).limit(checked(max_rows))


def in_set(news: DataFrame, symbols: list[str], ticker: str = "ticker") -> DataFrame:
    """Rows whose symbol is in a configured list; the list is part of the plan, so partitions are pruned by it."""
    return news.filter(F.col(ticker).isin(list(symbols)))


def count_by_symbol(news: DataFrame, ticker: str = "ticker") -> DataFrame:
    return news.groupBy(ticker).agg(F.count("*").alias("n"))


def precache(spark: SparkSession, csv: str, cache: str, source: str, tickers: dict[str, list[str]], name: str = "dev") -> DataFrame:
    """ticker, n of a named set's symbols (0 for those without news): one pass over the source instead of one a symbol."""
    if name not in tickers:
        raise ValueError(f"unknown ticker set {name!r}; there is {', '.join(sorted(tickers))}")
    found = count_by_symbol(in_set(ingest_news(spark, csv, cache, source), tickers[name]))
    wanted = spark.createDataFrame([(t,) for t in tickers[name]], "ticker string")
    return wanted.join(found, "ticker", "left").select("ticker", F.coalesce("n", F.lit(0)).alias("n"))


def read_prices(spark: SparkSession, path: str) -> DataFrame:
    """ticker, date, open, high, low, close, adj_close, volume of a file or a directory of ``<ticker>.csv`` files.

    Values that aren't numbers and dates that can't be read are null (rejects() counts them).
    """
    rows = read_csv(spark, path, ("date", *PRICE_VALUES))
    values = [F.expr(f"try_cast(`{c}` AS DOUBLE)").alias(c.replace(" ", "_")) for c in PRICE_VALUES]
    return rows.select(F.regexp_replace("_file", r"\.csv$", "").alias("ticker"), F.to_date(F.coalesce(F.try_to_timestamp("date"), F.try_to_timestamp("date", F.lit("M/d/yyyy")))).alias("date"), *values)


def read_price(spark: SparkSession, directory: str, ticker: str) -> DataFrame:
    """One ticker's prices, from its file alone."""
    return read_prices(spark, f"{directory}/{ticker}.csv")


def rejected_lines(spark: SparkSession, path: str) -> DataFrame:
    """file, at and line of each line of a CSV that opens a quote which is never closed; ``at`` is in the order of the file."""
    return read_csv(spark, path, (), rejects=True).select(F.col("_file").alias("file"), F.col("_at").alias("at"), F.col("_reject").alias("line"))


def rejects(prices: DataFrame) -> DataFrame:
    """ticker, n_rows and bad_dates of each ticker."""
    return prices.groupBy("ticker").agg(F.count("*").alias("n_rows"), F.count_if(F.col("date").isNull()).alias("bad_dates"))


def row_iterator(table: DataFrame):
    """Rows one after the other, a partition at a time, as a lazy remote scan gives them."""
    return table.toLocalIterator(prefetchPartitions=True)
