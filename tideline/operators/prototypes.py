"""Prototype algebra: distances, losses, soft assignments, mixtures, nearest segments and their explanations.

Prototypes are a model's parameters, some tens of vectors. They are counted before they are collected (``MOST`` at most) and
shipped to the tasks; segments, of any number, are never shuffled: each Arrow batch is held against all prototypes in
numpy, and what follows are map-side aggregates.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tideline.functions.vectors import squared_distance

MOST = 4096
BLOCK_VALUES = 1 << 16


def matrix(prototypes: DataFrame) -> tuple[list[int], np.ndarray]:
    """The ids and vectors of a table proto_id, vec, in the order of the ids."""
    rows = prototypes.select("proto_id", F.col("vec").cast("array<double>").alias("vec")).orderBy("proto_id").limit(MOST + 1).collect()
    if not 0 < len(rows) <= MOST:
        raise ValueError(f"there must be 1 to {MOST} prototypes")
    return [r["proto_id"] for r in rows], np.array([r["vec"] for r in rows], np.float64)


def pairwise(z: np.ndarray, p: np.ndarray) -> np.ndarray:
    """Squared distances [N, K], by differences: no cancellation. One prototype at a time, so that differences stay in the processor's cache."""
    out = np.empty((len(z), len(p)))
    step = max(1, BLOCK_VALUES // max(1, p.shape[1]))
    for lo in range(0, len(z), step):
        some = z[lo : lo + step]
        for k, one in enumerate(p):
            apart = some - one
            np.einsum("ij,ij->i", apart, apart, out=out[lo : lo + step, k])
    return out


def soft_weights(d2: np.ndarray) -> np.ndarray:
    raised = np.exp(d2.min(1, keepdims=True) - d2)
    return raised / raised.sum(1, keepdims=True)


def stack(column: pa.Array, dim: int) -> np.ndarray:
    flat = column.flatten().cast(pa.float64())
    if len(flat) != len(column) * dim or flat.null_count:
        raise ValueError(f"segments must have {dim} coordinates, none of them null")
    return flat.to_numpy(zero_copy_only=False).reshape(-1, dim)


def nested(values: np.ndarray) -> pa.Array:
    return pa.FixedSizeListArray.from_arrays(pa.array(values.ravel()), values.shape[1]).cast(pa.list_(pa.float64()))


def assign(segments: DataFrame, prototypes: DataFrame | tuple[list[int], np.ndarray], vec: str = "vec") -> DataFrame:
    """``segments`` without ``vec``, with d2, weights (softmax of -d2) and mix (the weights' mean of prototypes), arrays.

    d2 and weights are in the order of proto_id. Rows without a vector are left out; repeated rows stay.
    """
    _, p = matrix(prototypes) if isinstance(prototypes, DataFrame) else prototypes
    rows = segments.filter(F.col(vec).isNotNull())
    keep = [c for c in rows.columns if c.lower() not in (vec.lower(), "d2", "weights", "mix")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            d2 = pairwise(stack(batch.column(len(keep)), p.shape[1]), p)
            w = soft_weights(d2) if len(d2) else d2
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], nested(d2), nested(w), nested(w @ p)], names=[*keep, "d2", "weights", "mix"])

    rows = rows.select(*keep, vec)
    schema = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in rows.schema if f.name in keep)
    return rows.mapInArrow(run, schema + "d2 array<double>, weights array<double>, mix array<double>")


def long_form(assigned: DataFrame, ids: list[int], column: str, name: str, position: str = "proto_id") -> DataFrame:
    """A row for each element of an array column; positions become prototype ids."""
    rows = assigned.select(*[c for c in assigned.columns if c not in ("d2", "weights", "mix")], F.posexplode(column).alias("_k", name))
    return rows.withColumn(position, F.element_at(F.array(*[F.lit(i) for i in ids]), F.col("_k") + 1)).drop("_k")


def pairs(prototypes: DataFrame) -> DataFrame:
    """proto_a, proto_b, d2 of each pair a < b."""
    ids, p = matrix(prototypes)
    one = prototypes.sparkSession.createDataFrame([(i, v.tolist()) for i, v in zip(ids, p, strict=True)], "proto_id int, vec array<double>").coalesce(1)
    a, b = one.select(F.col("proto_id").alias("proto_a"), F.col("vec").alias("va")), one.select(F.col("proto_id").alias("proto_b"), F.col("vec").alias("vb"))
    return a.join(F.broadcast(b), F.col("proto_a") < F.col("proto_b")).select("proto_a", "proto_b", squared_distance(F.col("va"), F.col("vb")).alias("d2"))


def diversity_loss(p: np.ndarray, d_min: float) -> float:
    """Mean over pairs of max(0, d_min - squared distance); 0 for one prototype."""
    i, j = np.triu_indices(len(p), 1)
    return float(np.maximum(0, d_min - ((p[i] - p[j]) ** 2).sum(1)).mean()) if len(i) else 0.0


def losses(segments: DataFrame, prototypes: DataFrame, d_min: float, vec: str = "vec") -> DataFrame:
    """One row: n, l_c, l_e, l_d and their sum total, in one pass without a shuffle of segments.

    l_c is the mean over segments of the least distance, l_e the mean over prototypes of the least distance; both are
    null without segments.
    """
    ids, p = matrix(prototypes)
    assigned = assign(segments.select(vec), (ids, p), vec)
    least = assigned.agg(F.count("*").alias("n"), F.avg(F.array_min("d2")).alias("l_c"), *[F.min(F.get("d2", F.lit(k))).alias(f"m{k}") for k in range(len(ids))])
    l_e = sum((F.col(f"m{k}") for k in range(1, len(ids))), F.col("m0")) / len(ids)
    out = least.select("n", "l_c", l_e.alias("l_e"), F.lit(diversity_loss(p, d_min)).alias("l_d"))
    return out.withColumn("total", F.col("l_c") + F.col("l_e") + F.col("l_d"))


def weighted_total(l_pred, l_c, l_e, l_d, lambda_c: float = 0.1, lambda_e: float = 0.1, lambda_d: float = 0.01):
    """The training loss from its parts; takes columns or numbers."""
    return l_pred + lambda_c * l_c + lambda_e * l_e + lambda_d * l_d


def project(bank: DataFrame, prototypes: DataFrame, keys: tuple[str, ...], vec: str = "vec") -> DataFrame:
    """proto_id, the ``keys`` of its nearest segment and the distance; ties go to the least keys.

    Each task keeps one candidate a prototype.
    """
    ids, p = matrix(prototypes)
    assigned = assign(bank.select(*keys, vec), (ids, p), vec)
    nearest = assigned.agg(*[F.min(F.struct(F.get("d2", F.lit(k)).alias("distance"), *keys)).alias(f"b{k}") for k in range(len(ids))])
    rows = F.array(*[F.struct(F.lit(i).alias("proto_id"), F.col(f"b{k}").alias("best")) for k, i in enumerate(ids)])
    return nearest.select(F.explode(rows).alias("r")).select("r.proto_id", *[F.col(f"r.best.{k}") for k in keys], "r.best.distance").filter("distance IS NOT NULL")


def bank_windows(segments: int = 9, batch: int = 64, limit: int = 5000) -> int:
    """How many windows a bank takes: whole batches until there are more than ``limit`` segments."""
    return batch * (limit // (batch * segments) + 1)


def examples(bank: DataFrame, prototypes: DataFrame, meta: DataFrame, n_examples: int = 3, vec: str = "vec") -> DataFrame:
    """The first prototypes' nearest segments with their windows' meta.

    ``bank``: window_no, seg_no, vec; ``meta``: window_no and what describes a window. The row has proto_id, window_no,
    seg_no, distance, meta (a struct) and flat_index, the segment's place in the bank.
    """
    found = project(bank, prototypes, ("window_no", "seg_no"), vec)
    ids = sorted(r["proto_id"] for r in prototypes.select("proto_id").limit(MOST).collect())[:n_examples]
    size = bank.agg((F.max("seg_no") + 1).alias("_s"))
    described = meta.select("window_no", F.struct(*[c for c in meta.columns if c != "window_no"]).alias("meta"))
    out = found.filter(F.col("proto_id").isin(ids)).join(F.broadcast(size)).withColumn("flat_index", F.col("window_no") * F.col("_s") + F.col("seg_no")).drop("_s")
    # one row an example: n_examples at most
    return described.join(F.broadcast(out), "window_no", "right")


def legacy_meta(found: DataFrame, n_windows: int) -> DataFrame:
    """``found`` with the window that a lookup by the flat segment index names (null beyond the windows)."""
    return found.withColumn("legacy_meta_window", F.when(F.col("flat_index") < n_windows, F.col("flat_index")))
