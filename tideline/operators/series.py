"""Daily bars, look-back and horizon windows, patches, temporal splits, caps and epoch orders.

Window operators partition by ticker. Bars are one row a ticker and day, so however many ticks a ticker has, its group
is bounded by the calendar (some thousands of rows); the ticks are pre-aggregated map-side before the shuffle.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

LOOKBACK, HORIZON = 60, 7
PATCH, STRIDE = 12, 6
SPLITS = ("train", "val", "test")


def daily_bars(ticks: DataFrame, ticker: str, at: str, price: str, volume: str, order: tuple[str, ...] = ()) -> DataFrame:
    """ticker, date, open, high, low, close, volume of each ticker and day.

    Ticks of one instant are put in the order of the ``order`` columns, then the price itself, so open and close don't
    depend on how rows are dealt out. Rows without ticker or instant are left out; null prices don't count.
    """
    key = F.struct(F.col(at), *order, F.col(price))
    value = F.when(F.col(price).isNotNull(), key)
    rows = ticks.filter(F.col(ticker).isNotNull() & F.col(at).isNotNull())
    return rows.groupBy(F.col(ticker).alias("ticker"), F.col(at).cast("date").alias("date")).agg(
        F.min_by(price, value).alias("open"), F.max(price).alias("high"), F.min(price).alias("low"), F.max_by(price, value).alias("close"), F.sum(volume).alias("volume"),
    )


def windows(
    bars: DataFrame, features: tuple[str, ...] = ("open", "high", "low", "close", "volume"), target: str = "close", lookback: int = LOOKBACK, horizon: int | tuple[int, ...] = HORIZON, step: int = 1,
    summaries: dict[str, Column] | None = None, picked: dict[str, tuple[str, int]] | None = None,
) -> DataFrame:
    """One row for each complete window: ticker, end_idx, start_date, end_date, y_last_date, x, y, and last, the end day's features.

    ``x`` is the last ``lookback`` rows as structs of the features, ``y`` the target of the ``horizon`` rows after them;
    ``summaries`` are further aggregates over the look-back, ``picked`` single values of it by column and place (from 0); where no
    more is wanted, these save the arrays. What isn't used of these is not computed. Several horizons give
    a window a row for each that it has targets for, with the column ``horizon``, from frames of the widest. Rows, not
    calendar days, are counted. Nulls keep their place (a struct around them keeps collect_list from dropping them).
    Series shorter than lookback + horizon give none. Bars must be one row a ticker and date. One exchange and one sort serve all
    the frames.
    """
    by = Window.partitionBy("ticker").orderBy("date")
    horizons = (horizon,) if isinstance(horizon, int) else tuple(sorted(horizon))
    back, ahead = by.rowsBetween(-(lookback - 1), 0), by.rowsBetween(1, horizons[-1])
    named = {name: c.over(back) for name, c in (summaries or {}).items()} | {name: F.lag(c, lookback - 1 - place).over(by) for name, (c, place) in (picked or {}).items()}
    ahead_of = F.count(F.lit(1)).over(ahead) if len(horizons) > 1 else F.when(F.lead(F.lit(1), horizons[0]).over(by).isNotNull(), horizons[0]).otherwise(0)
    dated = [] if isinstance(horizon, int) else ["date"]  # a shorter horizon's last date stands among the targets
    rows = bars.select(
        "ticker", (F.row_number().over(by) - 1).alias("end_idx"), F.lag("date", lookback - 1).over(by).alias("start_date"), F.col("date").alias("end_date"), ahead_of.alias("_ahead"),
        F.struct(*features).alias("last"), F.lead("date", horizons[-1]).over(by).alias("y_last_date"),
        F.collect_list(F.struct(*features)).over(back).alias("x"), F.collect_list(F.struct(F.col(target).cast("double").alias("y"), *dated)).over(ahead).alias("_ys"), *[c.alias(name) for name, c in named.items()],
    ).filter((F.col("end_idx") >= lookback - 1) & (F.col("_ahead") >= horizons[0]))
    if step != 1:
        rows = rows.filter((F.col("end_idx") - (lookback - 1)) % step == 0)
    kept = ["ticker", "end_idx", "start_date", "end_date", "y_last_date", "last", "x", "y", *named]
    if isinstance(horizon, int):
        return rows.withColumn("y", F.col("_ys.y")).select(*kept)
    fits = F.filter(F.array(*[F.lit(h) for h in horizons]), lambda h: h <= F.col("_ahead"))
    each = rows.withColumn("horizon", F.explode(fits)).withColumn("_ys", F.slice("_ys", 1, F.col("horizon")))
    return each.withColumn("y", F.col("_ys.y")).withColumn("y_last_date", F.element_at("_ys", -1)["date"]).select(*kept, "horizon")


def feature_matrix(x: Column, features: tuple[str, ...]) -> Column:
    """The structs of ``x`` as arrays of doubles in the order of the features."""
    return F.transform(x, lambda r: F.array(*[r[f].cast("double") for f in features]))


def patches(rows: DataFrame, length: int = PATCH, stride: int = STRIDE) -> DataFrame:
    """A row for each strided patch of ``x``: the window's columns, seg_no and patch."""
    starts = F.sequence(F.lit(0), F.floor((F.size("x") - length) / stride).cast("int"))
    cut = F.transform(starts, lambda s: F.slice("x", s * stride + 1, length))
    enough = rows.filter(F.size("x") >= length)
    return enough.select("*", F.posexplode(cut).alias("seg_no", "patch")).drop("x", "y")


def patch_ends(bars: DataFrame, feature: str = "close", length: int = PATCH, stride: int = STRIDE, lookback: int = LOOKBACK, horizon: int = HORIZON) -> DataFrame:
    """ticker, end_idx, seg_no, first, last: a feature at both ends of each strided patch of each window, read by offset and not from arrays."""
    starts = range(0, lookback - length + 1, stride)
    places = sorted({p for s in starts for p in (s, s + length - 1)})
    rows = windows(bars, (feature,), feature, lookback, horizon, picked={f"_at{p}": (feature, p) for p in places})
    each = [F.struct(F.lit(k).alias("seg_no"), F.col(f"_at{s}").alias("first"), F.col(f"_at{s + length - 1}").alias("last")) for k, s in enumerate(starts)]
    return rows.select("ticker", "end_idx", F.inline(F.array(*each)))


def split_of(day: Column, train_until: str, val_until: str) -> Column:
    """Which split a day belongs to; both bounds are inclusive."""
    bounds = [F.lit(dt.date.fromisoformat(d)) for d in (train_until, val_until)]
    return F.when(day <= bounds[0], "train").when(day <= bounds[1], "val").when(day.isNotNull(), "test")


def with_split(rows: DataFrame, train_until: str, val_until: str, purge: bool = True) -> DataFrame:
    """The windows with the split of their end date; ``purge`` drops those whose targets reach into a later split."""
    out = rows.withColumn("split", split_of(F.col("end_date"), train_until, val_until))
    return out.filter(F.col("split") == split_of(F.col("y_last_date"), train_until, val_until)) if purge else out


def capped(rows: DataFrame, caps: dict[str, int | None], rank: str | None = None) -> DataFrame:
    """The first windows of each split by ticker and end_idx; None keeps all. ``rank`` names a column for a window's place, from 0.

    The limit is pushed below the exchange (a window group limit), so a task gets no more than the largest cap of each
    split from each other; the capped splits are ranked in one pass.
    """
    limited = {s: caps[s] for s in SPLITS if caps.get(s) is not None}
    if not limited:
        return rows if rank is None else capped(rows, dict.fromkeys(SPLITS, (1 << 31) - 1), rank)
    place = F.row_number().over(Window.partitionBy("split").orderBy("ticker", "end_idx"))
    own = F.create_map(*[F.lit(x) for pair in limited.items() for x in pair])[F.col("split")]
    ranked = rows.filter(F.col("split").isin(list(limited))).withColumn("_rank", place).filter(F.col("_rank") <= max(limited.values())).filter(F.col("_rank") <= own)
    ranked = ranked.drop("_rank") if rank is None else ranked.withColumn(rank, F.col("_rank") - 1).drop("_rank")
    if len(limited) == len(SPLITS):
        return ranked
    rest = rows.filter(~F.col("split").isin(list(limited)))
    return ranked.unionByName(rest if rank is None else capped(rest, {}, rank))


def epoch_order(rows: DataFrame, seed: int, epoch: int, keys: tuple[str, ...] = ("ticker", "end_idx")) -> DataFrame:
    """``rows`` sorted into the epoch's order, which depends on the keys and seeds alone, with the sort key as ``epoch_key``."""
    text = F.concat_ws("|", F.lit(str(seed + epoch)), *[F.col(k).cast("string") for k in keys])
    return rows.withColumn("epoch_key", F.md5(text)).orderBy("epoch_key", *keys)


def with_ordinal(rows: DataFrame, name: str = "ordinal") -> DataFrame:
    """``rows`` with their place, from 0, by ticker and end_idx.

    Places within a ticker come from a window by ticker, a ticker's first place from a running sum over one row a
    ticker; no task sees all rows.
    """
    sizes = rows.groupBy("ticker").agg(F.count("*").alias("_n"))
    before = F.sum("_n").over(Window.orderBy("ticker").rowsBetween(Window.unboundedPreceding, -1))
    offsets = sizes.select("ticker", F.coalesce(before, F.lit(0)).alias("_before"))
    own = F.row_number().over(Window.partitionBy("ticker").orderBy("end_idx")) - 1
    return rows.withColumn("_own", own).join(offsets, "ticker").withColumn(name, F.col("_before") + F.col("_own")).drop("_own", "_before")
