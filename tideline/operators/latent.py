"""Text vectors that are learnt from the texts: hashed TF-IDF, and a truncated SVD by subspace iteration on its Gram product.

Words go to ``buckets`` numbers by a hash, so sizes are fixed: the driver holds one weight a bucket and a basis of buckets x
dim. A turn multiplies the sparse rows with the basis, and back, where the rows stand; every task gives one matrix of the
basis's size, and these are added along a tree of tasks (training.summed). The driver then makes the basis orthogonal.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import StorageLevel, TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tideline.operators.training import SUMS, rows_of, summed

WORD = r"[\p{L}\p{N}]+"
#: Rows whose products are made at once.
ROWS = 256


@dataclass(frozen=True)
class Latent:
    """idf by bucket, the right singular vectors as columns (largest entry positive), and the singular values."""

    idf: np.ndarray
    basis: np.ndarray
    values: np.ndarray


def words(text: Column, buckets: int) -> Column:
    """The bucket of each word of a text, in lower case; null has none."""
    found = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(WORD), 0)
    return F.transform(found, lambda w: F.pmod(F.xxhash64(w), F.lit(buckets)).cast("int"))


def weighted(column: pa.Array, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, bucket, value) of the rows' TF-IDF, (1 + ln count) * idf, each row of length 1; entries by row, then bucket."""
    sizes = np.diff(column.offsets.to_numpy())
    row = np.repeat(np.arange(len(sizes)), sizes)
    key, count = np.unique(row * len(idf) + column.flatten().to_numpy(), return_counts=True)
    row, bucket = np.divmod(key, len(idf))
    value = (1 + np.log(count)) * idf[bucket]
    length = np.sqrt(np.bincount(row, value**2, len(sizes)))
    return row, bucket, value / length[row]


def times(entries: tuple[np.ndarray, np.ndarray, np.ndarray], rows: int, basis: np.ndarray) -> np.ndarray:
    """A @ basis for a sparse A of ``rows`` rows."""
    row, bucket, value = entries
    out = np.zeros((rows, basis.shape[1]))
    if len(row):
        first = np.flatnonzero(np.append(True, row[1:] != row[:-1]))
        out[row[first]] = np.add.reduceat(value[:, None] * basis[bucket], first)
    return out


def add_back(entries: tuple[np.ndarray, np.ndarray, np.ndarray], y: np.ndarray, into: np.ndarray) -> None:
    """Add A.T @ y to ``into``."""
    row, bucket, value = entries
    if len(row):
        order = np.argsort(bucket, kind="stable")
        b = bucket[order]
        first = np.flatnonzero(np.append(True, b[1:] != b[:-1]))
        into[b[first]] += np.add.reduceat(value[order, None] * y[row[order]], first)


def products(rows: DataFrame, idf: np.ndarray, basis: np.ndarray, gram: bool, fan_in: int) -> np.ndarray:
    """A.T @ A @ basis over all rows, or with ``gram`` (A @ basis).T @ (A @ basis)."""
    shared = rows.sparkSession.sparkContext.broadcast((idf, basis))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        idf, basis = shared.value
        out, n = np.zeros((basis.shape[1],) * 2 if gram else basis.shape), 0
        for whole in batches:
            for lo in range(0, whole.num_rows, ROWS):
                column = whole.slice(lo, ROWS).column(0)
                entries = weighted(column, idf)
                y = times(entries, len(column), basis)
                n += len(column)
                if gram:
                    out += y.T @ y
                else:
                    add_back(entries, y, out)
        yield rows_of([("g", "", out.ravel(), 0.0, n, n, TaskContext.get().partitionId())])

    made = summed(rows.mapInArrow(run, SUMS), rows.rdd.getNumPartitions(), fan_in).collect()  # one matrix
    shared.unpersist()
    shape = (basis.shape[1],) * 2 if gram else basis.shape
    return np.array(made[0]["value"]).reshape(shape) if made else np.zeros(shape)


def fit(docs: DataFrame, text: str = "text", dim: int = 64, buckets: int = 1 << 15, turns: int = 6, more: int = 16, seed: int = 42, fan_in: int = 16) -> Latent:
    """The first ``dim`` singular vectors of the texts' TF-IDF, found with ``more`` further ones in ``turns`` turns.

    Texts without words count as documents and have no entries. Fewer than ``dim`` words or texts leave vectors of value 0.
    """
    rows = docs.select(words(F.col(text), buckets).alias("words")).persist(StorageLevel.DISK_ONLY)
    try:
        n = rows.count()
        found = rows.select(F.explode(F.array_distinct("words")).alias("b")).groupBy("b").agg(F.count("*").alias("n")).collect()  # a row a bucket
        df = np.zeros(buckets)
        df[[r["b"] for r in found]] = [r["n"] for r in found]
        idf = np.log((1 + n) / (1 + df)) + 1
        q = np.linalg.qr(np.random.default_rng(seed).normal(size=(buckets, dim + more)))[0]
        for _ in range(turns):
            q = np.linalg.qr(products(rows, idf, q, False, fan_in))[0]
        values, turn = np.linalg.eigh(products(rows, idf, q, True, fan_in))
    finally:
        rows.unpersist()
    order = np.argsort(-values, kind="stable")[:dim]
    basis = q @ turn[:, order]
    basis *= np.sign(basis[np.abs(basis).argmax(0), np.arange(dim)] + 0.0)
    return Latent(idf, basis, np.sqrt(np.maximum(values[order], 0)))


def encode(text: Column, latent: Latent, spark) -> Column:
    """A text's coordinates in the basis, of length 1; texts without known words give the zero vector."""
    shared = spark.sparkContext.broadcast(latent)

    @F.pandas_udf("array<double>")
    def project(found: pd.Series) -> pd.Series:
        l = shared.value  # noqa: E741
        column = pa.array([np.asarray(x, np.int32) for x in found], pa.list_(pa.int32()))
        parts = []
        for lo in range(0, len(column), ROWS):
            some = column.slice(lo, ROWS)
            y = times(weighted(some, l.idf), len(some), l.basis)
            length = np.linalg.norm(y, axis=1, keepdims=True)
            parts += list(y / np.where(length > 0, length, 1))
        return pd.Series(parts)

    return project(words(text, len(latent.idf)))
