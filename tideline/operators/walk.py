"""Every complete window of every series, handed to numpy functions in blocks, without an array a window.

Bars and news are laid together by ticker and day: one exchange and one sort of rows of single values. A task walks through
its tickers; a ticker's days are held at a time, some thousands of rows by the calendar, and the windows of a block are
views of them. What windows have in common is so read, sent and computed once a day and not once a window.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tideline.operators.series import HORIZON, LOOKBACK, SPLITS

BLOCK = 512


@dataclass
class Block:
    """Windows of one ticker and split that follow each other; window k's look-back are the bars k to k + lookback - 1.

    Dates are days since 1970. Null features are 0, null targets NaN. ``news_*`` are the ticker's days with news, with the
    vectors' mean of each day.
    """

    ticker: pa.Scalar
    split: str
    end_idx: np.ndarray
    values: np.ndarray
    target: np.ndarray
    dates: np.ndarray
    news_date: np.ndarray
    news_n: np.ndarray
    news_sum: np.ndarray
    lookback: int
    horizon: int
    draw: np.ndarray | None = None  # a number a window, where one was asked for

    def __len__(self) -> int:
        return len(self.end_idx)

    @property
    def x(self) -> np.ndarray:
        """[B, T, C], a view."""
        return np.lib.stride_tricks.sliding_window_view(self.values[: len(self) + self.lookback - 1], self.lookback, 0).transpose(0, 2, 1)

    @property
    def y(self) -> np.ndarray:
        """[B, H], a view."""
        return np.lib.stride_tricks.sliding_window_view(self.target[self.lookback :], self.horizon)

    @property
    def end_date(self) -> np.ndarray:
        return self.dates[self.lookback - 1 : self.lookback - 1 + len(self)]

    def _news(self) -> tuple[np.ndarray, np.ndarray]:
        return np.searchsorted(self.news_date, self.dates[: len(self)], "left"), np.searchsorted(self.news_date, self.end_date, "right")

    def text(self) -> np.ndarray:
        """[B, E]: the mean vector of the news from each look-back's first day to its last, 0 without news."""
        lo, hi = self._news()
        before = lambda v: np.concatenate([np.zeros_like(v[:1], shape=(1, *v.shape[1:])), np.cumsum(v, 0)])
        n, total = before(self.news_n), before(self.news_sum)
        return (total[hi] - total[lo]) / np.maximum(n[hi] - n[lo], 1)[:, None]

    def texts(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The windows' days with news one after the other, how many each window has, and those days' mean vectors."""
        lo, hi = self._news()
        counts = hi - lo
        at = np.repeat(lo - np.cumsum(counts) + counts, counts) + np.arange(counts.sum())
        return self.news_date[at], counts, self.news_sum[at] / self.news_n[at, None]

    def part(self, lo: int, hi: int) -> Block:
        """The windows lo to hi - 1."""
        bars = slice(lo, hi + self.lookback + self.horizon - 1)
        days = slice(*np.searchsorted(self.news_date, [self.dates[bars][0], self.dates[hi + self.lookback - 2] + 1]))
        return Block(self.ticker, self.split, self.end_idx[lo:hi], self.values[bars], self.target[bars], self.dates[bars], self.news_date[days], self.news_n[days], self.news_sum[days], self.lookback, self.horizon, None if self.draw is None else self.draw[lo:hi])


def laid(bars: DataFrame, news: DataFrame, features: tuple[str, ...], target: str, dim: int, draw: Column | None = None, since: str | None = None, lookback: int = LOOKBACK) -> DataFrame:
    """ticker, date, bar, features, target, n and the news' sums of each bar and each day with news; a ticker's rows stand together, by day.

    With ``draw``, over ticker and end_idx, also draw and end_idx. With ``since``, too, tickers without bars and bars that are in no look-back
    of a window that ends after that date are left out once all are counted.
    """
    numbers, sums = [f"f{k}" for k in range(len(features))], [f"v{k}" for k in range(dim)]
    known = news.filter("ticker IS NOT NULL AND date IS NOT NULL AND vec IS NOT NULL")
    daily = known.groupBy("ticker", F.col("date").cast("date").alias("date")).agg(F.count("*").alias("n"), *[F.sum(F.coalesce(F.get("vec", F.lit(k)).cast("double"), F.lit(0.0))).alias(v) for k, v in enumerate(sums)])
    none = F.lit(None).cast("double")
    days = bars.filter("ticker IS NOT NULL AND date IS NOT NULL").select("ticker", "date", F.lit(True).alias("bar"), *[F.col(f).cast("double").alias(k) for f, k in zip(features, numbers, strict=True)], F.col(target).cast("double").alias("target"), F.lit(0).cast("long").alias("n"), *[none.alias(v) for v in sums])
    both = days.unionByName(daily.select("ticker", "date", F.lit(False).alias("bar"), *[none.alias(k) for k in (*numbers, "target")], "n", *sums))
    # the number is given, since small rows stand for much work: partitions aren't to be merged by their bytes
    made = both.repartition(int(bars.sparkSession.conf.get("spark.sql.shuffle.partitions")), "ticker").sortWithinPartitions("ticker", "date", "bar")
    if draw is None:
        return made
    of_ticker = Window.partitionBy("ticker").orderBy("date", "bar")  # in the order of the sort above
    place = F.sum(F.col("bar").cast("int")).over(of_ticker.rowsBetween(Window.unboundedPreceding, 0)) - 1
    made = made.withColumn("end_idx", place.cast("int"))
    if since is not None:
        whole = of_ticker.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
        before = F.sum((F.col("bar") & (F.col("date") <= F.lit(since).cast("date"))).cast("int")).over(whole)
        made = made.withColumn("_before", before).withColumn("_bars", F.sum(F.col("bar").cast("int")).over(whole))
        made = made.filter((F.col("_bars") > 0) & (~F.col("bar") | (F.col("end_idx") > F.col("_before") - lookback))).drop("_before", "_bars")
    return made.withColumn("draw", F.when(F.col("bar"), draw))


def tickers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Each ticker's rows."""
    held: list[pa.RecordBatch] = []
    for b in batches:
        at = 0
        for end in pc.run_end_encode(b.column(0)).run_ends.to_pylist():
            if held and not held[0].column(0)[0].equals(b.column(0)[at]):
                yield pa.Table.from_batches(held)
                held = []
            held.append(b.slice(at, end - at))
            at = end
    if held:
        yield pa.Table.from_batches(held)


def stacked(blocks: list[Block]) -> tuple[np.ndarray, np.ndarray]:
    """The values of all look-backs, one block's after the other's, and each window's first row among them."""
    values = [b.values[: len(b) + b.lookback - 1] for b in blocks]
    before = np.cumsum([0, *map(len, values[:-1])])
    return np.concatenate(values), np.concatenate([at + np.arange(len(b)) for at, b in zip(before, blocks, strict=True)])


def lists(blocks: Iterator[Block], days: int) -> Iterator[list[Block]]:
    held: list[Block] = []
    for b in blocks:
        held.append(b)
        if sum(len(one) + one.lookback - 1 for one in held) >= days:
            yield held
            held = []
    if held:
        yield held


def numbers(columns: list[pa.ChunkedArray], null: float) -> np.ndarray:
    return np.stack([pc.fill_null(c, null).to_numpy() for c in columns], 1)


def map_windows(
    bars: DataFrame, news: DataFrame, dim: int, run: Callable[[Block | list[Block]], pa.RecordBatch | None], schema: str, bounds: tuple[str, str], features: tuple[str, ...] = ("close", "volume"), target: str = "close",
    lookback: int = LOOKBACK, horizon: int = HORIZON, splits: tuple[str, ...] = SPLITS, block: int = BLOCK, draw: Column | None = None, together: int = 0,
) -> DataFrame:
    """What ``run`` makes of each block of windows, as rows of ``schema``.

    The windows are those of ``series.with_split(series.windows(...), *bounds)``, of the named splits, with the texts of
    ``text.window_text`` and ``text.window_texts``; with ``together`` blocks are handed over in lists, of any tickers, whose look-backs have so many days
    or which are a partition's last; ``draw`` is an expression over ticker and end_idx, a long for each. ``bars`` have one row a ticker and date, ``news`` ticker, date and vec.
    """
    epoch = dt.date(1970, 1, 1)
    edges = [(dt.date.fromisoformat(d) - epoch).days for d in bounds]
    wanted = [k for k, s in enumerate(SPLITS) if s in splits]
    width = len(features)

    def blocks(t: pa.Table) -> Iterator[Block]:
        bar = t["bar"].to_numpy()
        n = int(bar.sum())
        if n < lookback + horizon:
            return
        days = t.filter(t["bar"])
        other = t.filter(pc.invert(t["bar"]))
        dates = days["date"].cast(pa.int32()).to_numpy()
        split = np.searchsorted(edges, dates[lookback - 1 : n - horizon])
        keep = (split == np.searchsorted(edges, dates[lookback - 1 + horizon :])) & np.isin(split, wanted)
        if not keep.any():
            return
        left_out = days["end_idx"][0].as_py() if "end_idx" in days.column_names else 0
        whole = Block(
            t["ticker"][0], "", np.arange(lookback - 1, n - horizon, dtype=np.int32) + np.int32(left_out), numbers(days.columns[3 : 3 + width], 0.0), pc.fill_null(days["target"], np.nan).to_numpy(), dates,
            other["date"].cast(pa.int32()).to_numpy(), other["n"].to_numpy(), numbers(other.columns[5 + width : 5 + width + dim], 0.0), lookback, horizon,
            days["draw"].to_numpy()[lookback - 1 : n - horizon] if "draw" in days.column_names else None,
        )
        label = np.where(keep, split, -1)
        turns = [0, *(np.flatnonzero(np.diff(label)) + 1).tolist(), len(label)]
        for lo, hi in zip(turns, turns[1:], strict=False):
            for at in range(lo, hi if keep[lo] else lo, block):
                made = whole.part(at, min(at + block, hi))
                made.split = SPLITS[split[lo]]
                yield made

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        every = (b for t in tickers(batches) for b in blocks(t))
        for b in lists(every, together) if together else every:
            made = run(b)
            if made is not None:
                yield made

    since = bounds[wanted[0] - 1] if wanted and wanted[0] else None
    return laid(bars, news, features, target, dim, draw, since, lookback).mapInArrow(walk, schema)
