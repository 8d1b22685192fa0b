"""Toxicity: a linear classifier over character n-grams scaled by naive Bayes log-count ratios.

Labelled documents give, for each hashed n-gram, in how many toxic and how many other documents it stands. Features
are presences scaled by the log ratio of the smoothed shares; a logistic regression over the scaled features is fitted on
the driver from a bounded sample's feature lists, and the weights (one float a bucket, a fixed size) are broadcast.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import column_at, random_table, stage

BITS = 20
ORDERS = (3, 4, 5, 6)
SHIFT = np.uint64(64 - BITS)
BASE = np.uint64(0x9E3779B97F4A7C15)
TABLE = random_table(1 << 16, 3)
SLICE_CHARS = 1 << 18


@dataclass
class Model:
    weights: np.ndarray
    ratios: np.ndarray
    bias: float


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(f" {text.lower()} ".encode("utf-32-le", "surrogatepass"), np.uint32)


def buckets(points: np.ndarray) -> Iterator[np.ndarray]:
    """Hash buckets of the n-grams of each order, in text order; n-grams are of letters, digits and single marks."""
    values = TABLE[points & np.uint32(0xFFFF)]
    rolled = values
    for n in range(2, max(ORDERS) + 1):
        if len(values) < n:
            return
        rolled = rolled[:-1] * BASE + values[n - 1 :]
        if n in ORDERS:
            yield ((rolled ^ (rolled >> np.uint64(29))) * BASE >> SHIFT).astype(np.int32)


def present(text: str, flags: np.ndarray) -> np.ndarray:
    """The different buckets of a whole text. ``flags`` is scratch, all False before and after."""
    points = code_points(text)
    for lo in range(0, max(1, len(points)), SLICE_CHARS):
        for index in buckets(points[lo : lo + SLICE_CHARS + max(ORDERS) - 1]):
            flags[index] = True
    found = np.flatnonzero(flags)
    flags[found] = False
    return found


def scale(squares):
    """A text's features are divided by the fourth root of their total square, so that long texts don't drown short ones."""
    return np.sqrt(np.sqrt(np.maximum(squares, 1.0)))


def training_part(doc_id: Column) -> Column:
    """Rows whose labels may be learnt from; the others are held out."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 3 != 1


def fit(docs: DataFrame, labels: DataFrame, sample_rows: int = 10_000, features: int = 1 << 13, least_docs: int = 4, ridge: float = 0.02, steps: int = 60) -> Model:
    """Fit from at most ``sample_rows`` labelled training rows, those first by a hash of their doc_id.

    Only ``text`` is a feature. Rows without doc_id or label teach nothing, null texts count as empty. With no toxic or
    no other row the score is the constant share of toxic rows, smoothed (0.5 with no rows at all).
    """
    rows = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).dropna().filter(training_part(F.col("doc_id")))
    rows = rows.groupBy("doc_id").agg(F.max("toxic").alias("toxic")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_rows)
    # the sample has sample_rows rows of two numbers at most, whatever the table's size
    sample = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(rows), "doc_id")
    sample = stage(sample.select("text", "toxic"), "toxicity-sample")
    totals = {int(r["toxic"] > 0): r["n"] for r in sample.groupBy((F.col("toxic") > 0).cast("int").alias("toxic")).agg(F.count("*").alias("n")).collect()}
    n_pos, n_neg = totals.get(1, 0), totals.get(0, 0)
    if not n_pos or not n_neg:
        return Model(np.zeros(1 << BITS), np.zeros(1 << BITS), float(np.log((n_pos + 1) / (n_neg + 1))))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        flags, seen = np.zeros(1 << BITS, bool), np.zeros((2, 1 << BITS), np.int32)
        for batch in batches:
            for text, toxic in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                seen[int(toxic > 0), present(text, flags)] += 1
        index = np.flatnonzero(seen.any(0))
        for lo in range(0, len(index), 65536):
            part = index[lo : lo + 65536]
            yield pa.RecordBatch.from_arrays([pa.array(part.astype(np.int32)), pa.array(seen[0, part]), pa.array(seen[1, part])], names=["bucket", "neg", "pos"])

    counts = sample.mapInArrow(count, "bucket int, neg int, pos int").groupBy("bucket").agg(F.sum("neg").alias("neg"), F.sum("pos").alias("pos"))
    ratio = F.log((F.col("pos") + 1) / F.lit(n_pos + 2.0)) - F.log((F.col("neg") + 1) / F.lit(n_neg + 2.0))
    # evidence: the log ratio over its standard error, so that rare n-grams need a larger ratio
    counts = counts.filter(F.col("pos") + F.col("neg") >= least_docs).withColumn("ratio", ratio)
    counts = counts.withColumn("z", F.abs("ratio") / F.sqrt(1 / (F.col("pos") + 1) + 1 / (F.col("neg") + 1)))
    # as many rows, as many n-grams that stand out by chance: the bound grows with the sample as the largest of n normal values does
    chosen = counts.filter(F.col("z") >= float(np.sqrt(2 * np.log(n_pos + n_neg)))).orderBy(F.desc("z"), "bucket").limit(features).select("bucket", "ratio").collect()
    ratios = np.zeros(1 << BITS, np.float32)
    ratios[[r["bucket"] for r in chosen]] = [r["ratio"] for r in chosen]
    shared = docs.sparkSession.sparkContext.broadcast(ratios)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        flags = np.zeros(1 << BITS, bool)
        for batch in batches:
            found = [(f := present(t, flags))[shared.value[f] != 0].astype(np.int32) for t in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.list_(pa.int32())), batch.column(1)], names=["found", "toxic"])

    rows = sample.mapInArrow(keep, "found array<int>, toxic int").toArrow()
    found = rows["found"].combine_chunks()
    index = found.flatten().to_numpy()
    owner = np.repeat(np.arange(len(found)), np.diff(found.offsets.to_numpy()))
    y = (rows["toxic"].to_numpy() > 0).astype(np.float64)
    value = ratios[index].astype(np.float64)
    value /= scale(np.bincount(owner, value**2, len(y)))[owner]
    weight, bias = np.ones(1 << BITS), np.log(n_pos / n_neg)
    first, second = np.zeros(1 << BITS), np.zeros(1 << BITS)
    for step in range(1, steps + 1):  # Adam over the whole sample
        p = 1 / (1 + np.exp(-np.clip(bias + np.bincount(owner, value * weight[index], len(y)), -40, 40)))
        slope = (p - y) / len(y)
        grad = np.bincount(index, value * slope[owner], 1 << BITS) + ridge * (weight - 1) / len(y)
        bias -= 4 * slope.sum()
        first, second = 0.9 * first + 0.1 * grad, 0.99 * second + 0.01 * grad**2
        weight -= 0.1 * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.99**step)) + 1e-9)
    return Model((ratios * weight).astype(np.float64), ratios.astype(np.float64), float(bias))


def score_texts(texts: list[str | None], model: Model) -> np.ndarray:
    """Scores of whole texts; null and empty ones have the score that no evidence gives."""
    live, out = model.ratios != 0, np.full(len(texts), model.bias)
    for k, text in enumerate(texts):
        points, found = code_points(text or ""), []
        for lo in range(0, len(points), SLICE_CHARS):
            for index in buckets(points[lo : lo + SLICE_CHARS + max(ORDERS) - 1]):
                found.append(np.unique(index[live[index]]))
        index = np.unique(np.concatenate(found)) if found else np.empty(0, np.int32)
        if len(index):
            out[k] += model.weights[index].sum() / scale(np.square(model.ratios[index]).sum())
    return 1 / (1 + np.exp(-np.clip(out, -40, 40)))


def score(docs: DataFrame, model: Model, threshold: float = 0.7) -> DataFrame:
    """``docs`` with score (0 to 1) and predicted (1 from ``threshold`` on) of each whole text.

    Null and empty texts have the score that no evidence gives. Columns of ``docs`` named score or predicted are
    replaced; rows that repeat are scored each, an empty table gives none.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    others = [c for c in docs.columns if c.lower() not in ("score", "predicted")]
    rows = docs.select(*others)
    at = column_at(rows, "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            s = score_texts(batch.column(at).to_pylist(), shared.value)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(s), pa.array((s >= threshold).astype(np.int32))], names=[*others, "score", "predicted"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema) + ", score double, predicted int"
    return rows.mapInArrow(run, schema)


def keep_clean(docs: DataFrame, model: Model, threshold: float = 0.7) -> DataFrame:
    """The rows of ``docs`` whose whole text scores below ``threshold``, with all their columns, whatever they are called.

    Null and empty texts have the score that no evidence gives; rows that repeat stay or go together.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = column_at(docs, "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(score_texts(batch.column(at).to_pylist(), shared.value) < threshold))

    return docs.mapInArrow(run, docs.schema)
