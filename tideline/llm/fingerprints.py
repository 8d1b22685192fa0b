"""Document fingerprints by content-defined chunking.

A gear hash runs over a text's UTF-8 bytes; a chunk ends where its masked value is zero, with a stricter mask before
the normal size and a looser one after it (normalised chunking). Boundaries depend on the 32 bytes before them alone,
so an edit moves the chunks around it and no others. A text's fingerprint is the set of its chunks' digests with their
lengths; digests are 128 bits of BLAKE2b, so that different chunks don't share one. Likeness is the share of the shorter
set's length whose chunks the other holds.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import random_table

GEAR = (random_table(256, 9) >> np.uint64(32)).astype(np.uint32)
MIN_SIZE, NORMAL_SIZE, MAX_SIZE = 32, 128, 512
STRICT_BITS, LOOSE_BITS = 9, 5


def gear_hash(data: np.ndarray) -> np.ndarray:
    """The gear hash after each byte: h = 2 h + gear[byte], in 32 bits, by doubling the span summed over."""
    h = GEAR[data]
    for step in (1, 2, 4, 8, 16):
        if step < len(h):
            h[step:] += h[:-step] << np.uint32(step)  # the right side is computed whole before it is added
    return h


def cut_points(data: np.ndarray) -> np.ndarray:
    """Ends of the chunks, the last at the text's end."""
    n = len(data)
    if n == 0:
        return np.empty(0, np.int64)
    h = gear_hash(data)
    loose = np.flatnonzero(h >> np.uint32(32 - LOOSE_BITS) == 0) + 1
    strict = loose[h[loose - 1] >> np.uint32(32 - STRICT_BITS) == 0]
    loose_list, strict_list = loose.tolist(), strict.tolist()
    ends, start, i, j = [], 0, 0, 0
    while n - start > MIN_SIZE:
        while i < len(strict_list) and strict_list[i] < start + MIN_SIZE:
            i += 1
        end = strict_list[i] if i < len(strict_list) and strict_list[i] < start + NORMAL_SIZE else 0
        if not end:
            while j < len(loose_list) and loose_list[j] < start + NORMAL_SIZE:
                j += 1
            end = loose_list[j] if j < len(loose_list) else n
        end = min(end, start + MAX_SIZE, n)
        ends.append(end)
        start = end
    if start < n:
        ends.append(n)
    return np.array(ends, np.int64)


Chunks = dict[bytes, int]


def chunk_set(raw: bytes) -> Chunks:
    """The different chunks' digests, with their lengths."""
    ends = cut_points(np.frombuffer(raw, np.uint8)).tolist()
    return {hashlib.blake2b(raw[s:e], digest_size=16).digest(): e - s for s, e in zip([0, *ends[:-1]], ends, strict=True)} if ends else {}


def likeness(a: Chunks, b: Chunks) -> float:
    """Length of the common chunks over the length of the smaller set; 1 for two empty texts, 0 for one."""
    size_a, size_b = sum(a.values()), sum(b.values())
    if not size_a or not size_b:
        return float(size_a == size_b)
    return sum(a[d] for d in a.keys() & b.keys()) / min(size_a, size_b)


def serialise(chunks: Chunks) -> str:
    return ",".join(f"{d.hex()}:{n}" for d, n in sorted(chunks.items()))


SCHEMA = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def fingerprint_pairs(docs: DataFrame, range_bytes: int = 128 << 20) -> DataFrame:
    """Each document's fingerprint, that of its edited text, and their likeness and its likeness to the next document.

    The edited text's last floor(n_chars / 2) code points are replaced by the first as many of the next document by
    doc_id (all, if it has fewer); the last document's next is the first. Null text is empty. Rows without doc_id come
    first, in the order of a hash of their texts; rows that share one, a key as a rule, follow each other in the order of
    their texts and are one range. A table of one row is its own next; an empty table gives none. Only doc_id and text
    are read, so further columns can have any name.

    Documents are dealt into ranges of about ``range_bytes``: the ids alone are sorted by Spark's range partitioner, whose
    parts' first ids are the bounds. Rows without id are cut by their hash. Each range also gets the first document of
    the range after it, so every document meets its next in one sorted pass that holds two texts at a time. Texts are
    shuffled once.
    """
    spark = docs.sparkSession
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    size = F.octet_length("text").cast("long")
    rows, total, without = base.agg(F.count("*"), F.sum(size), F.sum(F.when(F.col("doc_id").isNull(), size))).first()
    if rows == 0:
        return spark.createDataFrame([], SCHEMA)
    parts = max(-(-total // range_bytes), int(spark.conf.get("spark.sql.shuffle.partitions")))
    # the place of rows without id among themselves; without such rows the texts need not be read for it
    place = F.lit(None).cast("long") if without is None else F.when(F.col("doc_id").isNull(), F.xxhash64("text"))
    own = max(1, parts * (without or 0) // max(total, 1))
    ids = base.filter("doc_id IS NOT NULL").select("doc_id").repartitionByRange(parts, "doc_id")
    # an id a range: the number of ranges is that of the tasks, not of the documents
    cuts = sorted({float(r["least"]) for r in ids.groupBy(F.spark_partition_id()).agg(F.min("doc_id").alias("least")).collect()})[1:] or [0.0]
    ranges = Bucketizer(splits=[-math.inf, *cuts, math.inf], inputCol="at", outputCol="range", handleInvalid="keep")
    placed = base.withColumn("place", place).withColumn("at", F.coalesce("doc_id", F.lit(0)).cast("double"))
    part = F.when(F.col("doc_id").isNull(), F.floor((F.shiftright("place", 1) / 2.0**63 + 0.5) * own)).otherwise(F.col("range") + own).cast("int")
    placed = ranges.transform(placed).withColumn("bucket", part).drop("at", "range")
    least = placed.groupBy("bucket").agg(F.min(F.struct(F.col("doc_id").isNotNull(), "doc_id", "place")).alias("first")).select("bucket", "first.*").collect()
    firsts = sorted((tuple(r[k] for k in ("bucket", "doc_id", "place")) for r in least), key=lambda x: x[0])
    before = spark.createDataFrame([(d, p, firsts[k - 1][0]) for k, (_, d, p) in enumerate(firsts)], "doc_id long, place long, before int")
    heads = placed.join(F.broadcast(before), placed["doc_id"].eqNullSafe(before["doc_id"]) & placed["place"].eqNullSafe(before["place"]))
    heads = heads.select(placed["doc_id"], placed["place"], "text", F.col("before").alias("bucket"), F.lit(1).alias("extra"))
    rows = placed.select("doc_id", "place", "text", "bucket", F.lit(0).alias("extra")).unionByName(heads)
    rows = rows.repartition(len(firsts), "bucket").sortWithinPartitions("bucket", "extra", F.col("doc_id").asc_nulls_first(), "place", "text").drop("place")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        out: list[tuple] = []
        size = 0
        for batch in batches:
            for doc, text, bucket, extra in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                raw = text.encode("utf-8", "surrogatepass")
                chunks = chunk_set(raw)
                if held is not None and held[3] == bucket and not held[4]:
                    row = compare(held, text, raw, chunks)
                    out.append(row)
                    size += len(row[3]) + len(row[4])
                    if size > 4 << 20:
                        yield table(out)
                        out, size = [], 0
                held = (doc, text, chunks, bucket, extra)
        if out:
            yield table(out)

    def compare(held, next_text: str, next_raw: bytes, next_chunks) -> tuple:
        doc, text, chunks = held[:3]
        half = len(text) // 2
        edited = text[: len(text) - half] + next_text[:half]
        raw = edited.encode("utf-8", "surrogatepass")
        edited_chunks = chunk_set(raw)
        return (doc, len(text), hashlib.sha256(raw).hexdigest(), serialise(chunks), serialise(edited_chunks), likeness(chunks, edited_chunks), likeness(chunks, next_chunks))

    def table(out: list[tuple]) -> pa.RecordBatch:
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
        names = [x.split()[0] for x in SCHEMA.split(", ")]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], names=names)

    return rows.mapInArrow(run, SCHEMA)
