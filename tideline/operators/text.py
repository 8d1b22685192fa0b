"""Text vectors, and their means over the windows' days."""

from __future__ import annotations

import re
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

WORD = re.compile(r"[^\W_]+")


def hashed_words(text: Column, dim: int = 64) -> Column:
    """A unit vector of signed word-hash counts: an offline stand-in for a frozen sentence encoder, not its equal.

    Null and wordless texts give the zero vector.
    """

    @F.pandas_udf("array<double>")
    def embed(texts: pd.Series) -> pd.Series:
        out = []
        for t in texts:
            h = np.array([zlib.crc32(w.encode()) for w in WORD.findall((t or "").lower())], np.int64)
            v = np.bincount(h % dim, np.where(h >> 16 & 1, 1.0, -1.0), dim) if len(h) else np.zeros(dim)
            out.append(v / (np.linalg.norm(v) or 1.0))
        return pd.Series(out)

    return embed(text)


def window_text(bars: DataFrame, news: DataFrame, dim: int, lookback: int) -> DataFrame:
    """ticker, end_date, n_news and text: the mean vector of a ticker's news from a look-back's first day to its last.

    ``news``: ticker, date, vec. News of the end day count, later ones never do; windows without news have the zero
    vector, bars with fewer rows behind them than ``lookback`` have no row. News rows without a ticker, date or vector
    don't count.

    News are summed by ticker and day before the shuffle, laid among the bars, and summed up once along each
    ticker's days, in one exchange and one sort of both; a window's sum is the difference of two running sums, so no news row is copied into the windows that
    hold it, and a group is bounded by the calendar.
    """
    vec = [f"v{k}" for k in range(dim)]
    known = news.filter("ticker IS NOT NULL AND date IS NOT NULL AND vec IS NOT NULL")
    daily = known.groupBy("ticker", F.col("date").cast("date").alias("date")).agg(F.count("*").alias("n"), *[F.sum(F.coalesce(F.get("vec", F.lit(k)).cast("double"), F.lit(0.0))).alias(vec[k]) for k in range(dim)])
    days = bars.select("ticker", "date", F.lit(1).alias("bar"), F.lit(0).cast("long").alias("n"), *[F.lit(0.0).alias(v) for v in vec])
    both = daily.select("ticker", "date", F.lit(0).alias("bar"), "n", *vec).unionByName(days)
    by = Window.partitionBy("ticker").orderBy("date", F.desc("bar"))  # a day's bar stands before its news, one row
    before = by.rowsBetween(Window.unboundedPreceding, -1)
    own = F.lead("date").over(by) == F.col("date")
    sums = ("n", *vec)
    summed = both.select("ticker", "date", "bar", own.alias("own"), *[F.coalesce(F.sum(c).over(before), F.lit(0)).alias(f"{c}_ex") for c in sums], *[F.lead(c).over(by).alias(f"{c}_own") for c in sums])
    rows = Window.partitionBy("ticker").orderBy("date")
    upto = {c: F.col(f"{c}_ex") + F.when(F.col("own"), F.col(f"{c}_own")).otherwise(F.lit(0)) for c in sums}
    at_start = summed.filter("bar = 1").select("ticker", F.col("date").alias("end_date"), *[(upto[c] - F.lag(f"{c}_ex", lookback - 1).over(rows)).alias(c) for c in sums])
    full = at_start.filter("n IS NOT NULL")
    n = F.greatest(F.col("n"), F.lit(1))
    return full.select("ticker", "end_date", F.col("n").cast("long").alias("n_news"), F.array(*[F.when(F.col("n") > 0, F.col(v) / n).otherwise(F.lit(0.0)) for v in vec]).alias("text"))


def window_texts(bars: DataFrame, news: DataFrame, dim: int, lookback: int) -> DataFrame:
    """ticker, end_date, text_dates and texts: one mean vector for each day with news, from a look-back's first day to its last.

    ``news``: ticker, date, vec. Days stand in order, and a window without news has empty arrays; otherwise as window_text().
    News are averaged by ticker and day before the shuffle; a day that isn't a bar's goes with the next bar, and windows
    gather their bars' days, so a set is bounded by the calendar, however many news a day has.
    """
    known = news.filter("ticker IS NOT NULL AND date IS NOT NULL AND vec IS NOT NULL")
    sums = [F.sum(F.coalesce(F.get("vec", F.lit(k)).cast("double"), F.lit(0.0))).alias(f"v{k}") for k in range(dim)]
    daily = known.groupBy("ticker", F.col("date").cast("date").alias("date")).agg(F.count("*").alias("n"), *sums)
    daily = daily.select("ticker", "date", F.array(*[F.col(f"v{k}") / F.col("n") for k in range(dim)]).alias("vec"))
    days = bars.select("ticker", "date", F.lit(True).alias("bar"), F.lit(None).cast("array<double>").alias("vec"))
    both = daily.select("ticker", "date", F.lit(False).alias("bar"), "vec").unionByName(days)
    ahead = Window.partitionBy("ticker").orderBy(F.desc("date"), F.desc("bar"))  # a day's bar stands before its news
    placed = both.withColumn("bar_date", F.last(F.when(F.col("bar"), F.col("date")), ignorenulls=True).over(ahead.rowsBetween(Window.unboundedPreceding, 0))).filter("bar_date IS NOT NULL")
    gathered = placed.groupBy("ticker", "bar_date").agg(F.array_sort(F.collect_list(F.when(~F.col("bar"), F.struct("date", "vec")))).alias("own"))
    back = Window.partitionBy("ticker").orderBy("bar_date").rowsBetween(-(lookback - 1), 0)
    rows = gathered.select("ticker", F.col("bar_date").alias("end_date"), F.min("bar_date").over(back).alias("start_date"), F.count(F.lit(1)).over(back).alias("rows"), F.flatten(F.collect_list("own").over(back)).alias("all"))
    inside = rows.filter(F.col("rows") == lookback).withColumn("all", F.filter("all", lambda d: d["date"] >= F.col("start_date")))
    return inside.select("ticker", "end_date", F.col("all.date").alias("text_dates"), F.col("all.vec").alias("texts"))
