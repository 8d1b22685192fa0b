"""Hard-negative mining: for an anchor and each of its nearest rows of the same label, the nearest rows of other labels whose
score lies within a window below.

Rows of one label and vector are a class; only its smallest ids can ever be among the first k, so a class keeps those, and
copies cost no search. Classes are dealt to cells by a vantage-point tree that is fitted on a bounded sample; a task holds one
cell's classes, grows a tree over all of them, and lets the queries of that cell stream through. Queries are the anchors'
classes, each sent to the cells that its bounds don't rule out: the sample gives every query a score that k rows are known
to reach. Searches are exact. Cells grow with the square root of the rows up to a bound, so that queries are copied to
few of them; their size is bounded by dealing the classes of a large one over several.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import vantage
from .common import join_hot, stage

BATCH = 512
RESULT = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"


def matrix(column: pa.Array, dim: int, rest: int = 0) -> np.ndarray:
    """Lists as rows of ``dim`` integers; a shorter one ends in ``rest``."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    sizes = np.diff(column.offsets.to_numpy(zero_copy_only=False))
    flat = column.flatten().to_numpy(zero_copy_only=False)
    if (sizes == dim).all():
        return flat.reshape(len(sizes), dim)
    out = np.full((len(sizes), dim), rest, np.int64)
    out[np.repeat(np.arange(len(sizes)), sizes), np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = flat
    return out


def lists(values: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.arange(len(values) + 1) * values.shape[1], pa.int32()), pa.array(values.reshape(-1), pa.int64()))


@dataclass(frozen=True)
class Sizes:
    """Classes of a cell at most (a cell that is half as large again is dealt over several), rows of a leaf, and classes that
    the cells' tree is fitted on and that every query meets first."""

    cell_rows: int = 1 << 17
    leaf_rows: int = 1024
    sample: int = 8192


@dataclass(frozen=True)
class Cells:
    """What every task needs: sizes, the cells' tree, the first cell's number and the number of cells of each of its leaves, and the sample."""

    dim: int
    most: float
    tree: vantage.Tree
    begin: np.ndarray
    parts: np.ndarray
    sample: np.ndarray
    sample_label: np.ndarray
    leaf_rows: int


def classes_of(rows: DataFrame, keep: int) -> DataFrame:
    """label, vec and ids: the ``keep`` smallest vec_ids of each label and vector. Tasks keep no more a class before the shuffle."""
    within = Window.partitionBy("label", "vec").orderBy("vec_id")
    return rows.withColumn("nth", F.row_number().over(within)).filter(F.col("nth") <= keep).groupBy("label", "vec").agg(F.array_sort(F.collect_list("vec_id")).alias("ids"))


def fitted(classes: DataFrame, sizes: Sizes) -> tuple[Cells, int] | None:
    """The cells of a table of classes and their number; None without classes."""
    square = F.aggregate("vec", F.lit(0.0), lambda a, v: a + v.cast("double") * v)
    largest = F.array_max(F.transform("vec", lambda v: F.abs(v.cast("double"))))
    n, dim, most, big = classes.agg(F.count("*"), F.max(F.size("vec")), F.max(square), F.max(largest)).first()
    if not n:
        return None
    bound = max(dim, 1) * (big or 0) ** 2
    if bound >= 2**53:
        raise ValueError(f"scores of up to {bound:g} can't be told apart; scale the components down")
    cell_rows = min(sizes.cell_rows, int((2 * sizes.leaf_rows * n) ** 0.5))
    some = classes.select("label", "vec").orderBy(F.xxhash64("label", "vec"), "label", "vec").limit(sizes.sample).toArrow()
    sample = matrix(some["vec"], dim).astype(np.float64)
    tree = vantage.grow(vantage.augmented(sample, most), parts=min(len(sample), -(-n // max(cell_rows, 1))))
    label = np.array(some["label"].to_pylist(), np.int64)
    first = Cells(dim, most, tree, np.arange(len(tree.leaves)), np.ones(len(tree.leaves), np.int64), sample, label, sizes.leaf_rows)
    held = np.zeros(len(tree.leaves), np.int64)
    for r in in_cells(classes, first).groupBy("cell").count().collect():
        held[r[0]] = r[1]
    parts = np.maximum(1, -(-held // max(cell_rows * 3 // 2, 1)))
    return Cells(dim, most, tree, np.cumsum(parts) - parts, parts, sample, label, sizes.leaf_rows), int(parts.sum())


def in_cells(classes: DataFrame, cells: Cells) -> DataFrame:
    """``classes`` (label, vec, ids) with their cell."""
    shared = classes.sparkSession.sparkContext.broadcast(cells)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = shared.value
        for b in batches:
            leaf = c.tree.route(vantage.augmented(matrix(b.column(1), c.dim), c.most))
            part = b.column(3).to_numpy() % c.parts[leaf]
            yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array((c.begin[leaf] + part).astype(np.int32))], names=["label", "vec", "ids", "cell"])

    return classes.select("label", "vec", "ids", F.pmod(F.xxhash64("label", "vec"), F.lit(1 << 30)).alias("at")).mapInArrow(run, "label long, vec array<long>, ids array<long>, cell int")


def sent(queries: DataFrame, cells: Cells, same: bool, k: int) -> DataFrame:
    """``queries`` (anchor, label, vec, low, high) once for each cell that may hold rows of use, with ``start``, the score that
    k rows of the sample reach, by window."""
    shared = queries.sparkSession.sparkContext.broadcast(cells)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = shared.value
        for whole in batches:
            for lo in range(0, whole.num_rows, BATCH):
                b = whole.slice(lo, BATCH)
                asked = asked_in(b, c, same, k)
                least = np.full(asked.low.shape, vantage.LOWEST)
                query, window, row, score = vantage.candidates(asked, c.sample, c.sample_label, least)
                group = query * asked.low.shape[1] + window
                kept = vantage.best(group, score, row, k)
                count = np.bincount(group[kept], minlength=least.size)
                last = kept[np.append(group[kept][1:] != group[kept][:-1], True)] if len(kept) else kept
                last = last[count[group[last]] == k]
                least.reshape(-1)[group[last]] = score[last]
                high, low = c.tree.bounds(asked.q.astype(np.float64), c.most)
                hit = np.zeros(high.shape, bool)
                for w in range(least.shape[1]):
                    hit |= (high >= np.maximum(least, asked.low)[:, w, None]) & (low <= asked.high[:, w, None]) & (asked.low <= asked.high)[:, w, None]
                query, leaf = np.nonzero(hit)
                parts = c.parts[leaf]
                query, cell = np.repeat(query, parts), np.repeat(c.begin[leaf] - (np.cumsum(parts) - parts), parts) + np.arange(parts.sum())
                columns = [x.take(pa.array(query)) for x in (*b.columns, lists(least))]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(cell.astype(np.int32))], names=["anchor", "label", "vec", "low", "high", "start", "cell"])

    picked = queries.select("anchor", "label", "vec", "low", "high")
    return picked.mapInArrow(run, "anchor long, label long, vec array<long>, low array<long>, high array<long>, start array<long>, cell int")


def asked_in(b: pa.RecordBatch | pa.Table, c: Cells, same: bool, k: int, start: np.ndarray | None = None) -> vantage.Asked:
    windows = max(1, int(np.diff(b["low"].offsets.to_numpy(zero_copy_only=False)).max(initial=1)))
    low = matrix(b["low"], windows, -vantage.LOWEST - 1)  # a window that isn't there holds no score
    return vantage.Asked(matrix(b["vec"], c.dim).astype(np.float64), b["label"].to_numpy(), low, matrix(b["high"], windows, vantage.LOWEST), np.full(low.shape, vantage.LOWEST) if start is None else start, same, k)


def searched(placed: DataFrame, queries: DataFrame, cells: Cells, n_cells: int, same: bool, k: int) -> DataFrame:
    """anchor, window, nth, score and vec_id: the first k rows by falling score, then by vec_id, of every query and window.

    ``placed``: in_cells(). Each cell's classes come to its task before its queries, which pass in batches.
    """
    shared = queries.sparkSession.sparkContext.broadcast(cells)
    none = F.lit(None)
    data = placed.select("cell", F.lit(0).alias("kind"), none.cast("long").alias("anchor"), "label", "vec", "ids", *[none.cast("array<long>").alias(x) for x in ("low", "high", "start")])
    asked = sent(queries, cells, same, k).select("cell", F.lit(1).alias("kind"), "anchor", "label", "vec", none.cast("array<long>").alias("ids"), "low", "high", "start")
    both = data.unionByName(asked).repartition(2 * n_cells, "cell").sortWithinPartitions("cell", "kind")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c, cell, rows, index, waiting = shared.value, None, [], None, []

        def answers() -> pa.RecordBatch:
            nonlocal index
            if index is None:
                held = pa.Table.from_batches(rows).combine_chunks()
                x, ids = matrix(held["vec"], c.dim), held["ids"].combine_chunks()
                bounds, flat = ids.offsets.to_numpy(), ids.flatten().to_numpy()
                bounds = bounds - bounds[0]
                index = (vantage.grow(vantage.augmented(x, c.most), most_rows=c.leaf_rows), x, held["label"].to_numpy(), flat[bounds[:-1]], bounds, flat)
            tree, x, label, first, bounds, flat = index
            t = pa.Table.from_batches(waiting).combine_chunks()
            t = pa.RecordBatch.from_arrays([t[n].combine_chunks() for n in t.column_names], names=t.column_names)
            asked = asked_in(t, c, same, k)
            asked.start = matrix(t["start"], asked.low.shape[1])
            query, window, row, score = vantage.search(tree, x, label, first, c.most, asked)
            size = bounds[row + 1] - bounds[row]
            many = lambda v: np.repeat(v, size)
            ids = flat[many(bounds[row] - (np.cumsum(size) - size)) + np.arange(size.sum())]
            query, window, score = many(query), many(window), many(score)
            kept = vantage.best(query * asked.low.shape[1] + window, score, ids, k)
            anchor = t["anchor"].to_numpy()[query[kept]]
            waiting.clear()
            return pa.RecordBatch.from_arrays([pa.array(anchor), pa.array(window[kept].astype(np.int32)), pa.array(score[kept]), pa.array(ids[kept])], names=["anchor", "window", "score", "vec_id"])

        for whole in batches:
            number, kind = whole.column(0).to_numpy(), whole.column(1).to_numpy()
            cuts = np.flatnonzero((np.diff(number) != 0) | (np.diff(kind) != 0)) + 1
            for lo, hi in zip([0, *cuts.tolist()], [*cuts.tolist(), whole.num_rows], strict=True):
                if hi == lo:
                    continue
                if number[lo] != cell:
                    if rows and waiting:
                        yield answers()
                    cell, index = number[lo], None
                    rows.clear()
                    waiting.clear()
                if kind[lo] == 0:
                    rows.append(whole.slice(lo, hi - lo))
                    continue
                for a in range(lo, hi, BATCH):
                    waiting.append(whole.slice(a, min(BATCH, hi - a)))
                    if rows and sum(b.num_rows for b in waiting) >= BATCH:
                        yield answers()
        if rows and waiting:
            yield answers()

    local = both.mapInArrow(run, "anchor long, window int, score long, vec_id long")
    order = Window.partitionBy("anchor", "window").orderBy(F.desc("score"), "vec_id")
    return local.withColumn("nth", F.row_number().over(order)).filter(F.col("nth") <= k)


def hard_negatives(rows: DataFrame, anchor: Column, positives: int = 5, negatives: int = 5, low: int = 80, high: int = 100, sizes: Sizes = Sizes()) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    ``rows``: vec_id long, label and vec, arrays of whole numbers; ``anchor`` says by these three which rows are anchors. Scores are inner
    products; a shorter vector ends in zeros. An anchor's positives are its first ``positives`` other rows of its label,
    a positive's negatives the first rows of other labels with low * its score <= 100 * theirs <= high * its score.
    Rows with a null vec_id, label, vector or component take no part, rows that repeat count once, rows of one vec_id that
    differ are rows of their own but never each other's positive; ties go to the smaller vec_id. Other columns are left
    out. A table without rows, anchors or other labels gives none. ValueError if scores can reach 2**53.
    """
    spark = rows.sparkSession
    whole = F.col("vec").isNotNull() & ~F.exists("vec", lambda v: v.isNull())
    picked = rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), F.col("vec").cast("array<long>").alias("vec"))
    different = stage(picked.filter(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & whole).distinct(), "negatives-rows")
    classes = stage(classes_of(different, max(positives + 1, negatives)), "negatives-classes")
    fit = fitted(classes, sizes)
    if fit is None:
        return spark.createDataFrame([], RESULT)
    cells, n_cells = fit
    placed = in_cells(classes, cells)
    anchors = different.filter(anchor).select(F.col("vec_id").alias("anchor_id"), F.struct("label", "vec").alias("key"))
    numbered = anchors.groupBy("key").agg(F.count("*").alias("n")).select("key", "key.label", "key.vec", "n", F.monotonically_increasing_id().alias("anchor"))
    queries = stage(numbered, "negatives-queries")  # written, so that numbers stay
    everything = queries.withColumn("low", F.array(F.lit(vantage.LOWEST + 1))).withColumn("high", F.array(F.lit(-vantage.LOWEST - 1)))
    near = searched(placed, everything, cells, n_cells, True, positives + 1)
    near = near.groupBy("anchor").agg(F.array_sort(F.collect_list(F.struct("nth", "score", "vec_id"))).alias("near"))
    up, down = (f"transform(near, x -> (x.score * {share}L {sign} pmod({'-' * (sign == '+')}x.score * {share}L, 100L)) div 100L)" for share, sign in ((low, "+"), (high, "-")))
    windows = stage(queries.join(near, "anchor").withColumn("low", F.expr(up)).withColumn("high", F.expr(down)), "negatives-windows")
    far = searched(placed, windows, cells, n_cells, False, negatives)
    far = far.groupBy("anchor").agg(F.collect_list(F.struct("window", F.col("nth").alias("rank"), "vec_id", "score")).alias("far"))
    results = stage(windows.select("anchor", "key", "n", "near").join(far, "anchor").drop("anchor"), "negatives-results")
    out = join_hot(anchors, results, "key").select("anchor_id", "near", F.explode("far").alias("one"))
    positive = F.element_at("near", F.col("one.window") + 1)
    own = F.exists("near", lambda x: x["vec_id"] == F.col("anchor_id"))
    out = out.filter((positive["vec_id"] != F.col("anchor_id")) & (own | (F.col("one.window") < positives)))
    return out.select("anchor_id", positive["vec_id"].alias("positive_id"), "one.rank", F.col("one.vec_id").alias("negative_id"), positive["score"].alias("positive_score"), F.col("one.score").alias("negative_score"))
