from __future__ import annotations

import hashlib
import random

import numpy as np
from pyspark.sql import functions as F

from tideline.llm import fingerprints
from tideline.llm.queries import op9_fingerprints


def slow_chunks(raw):
    """{digest: length}, byte by byte: no code of the library but its fixed numbers."""
    low, usual, high = fingerprints.MIN_SIZE, fingerprints.NORMAL_SIZE, fingerprints.MAX_SIZE
    h, start, out, states = 0, 0, {}, []
    for b in raw:
        h = (2 * h + int(fingerprints.GEAR[b])) % 2**32
        states.append(h)
    for end in range(1, len(raw) + 1):
        size, state = end - start, states[end - 1]
        bits = fingerprints.STRICT_BITS if size < usual else fingerprints.LOOSE_BITS
        if (size >= low and state >> (32 - bits) == 0) or size == high or end == len(raw):
            out[hashlib.blake2b(raw[start:end], digest_size=16).hexdigest()] = size
            start = end
    return out


def slow_likeness(a, b):
    if not a or not b:
        return float(not a and not b)
    return sum(n for d, n in a.items() if d in b) / min(sum(a.values()), sum(b.values()))


def brute(rows):
    rows = sorted(rows)
    out = {}
    for k, (d, t) in enumerate(rows):
        t, n = t or "", rows[(k + 1) % len(rows)][1] or ""
        half = len(t) // 2
        edited = t[: len(t) - half] + n[:half]
        a, b, c = (slow_chunks(x.encode()) for x in (t, edited, n))
        text = lambda x: ",".join(f"{d}:{n}" for d, n in sorted(x.items()))
        out[d] = (len(t), hashlib.sha256(edited.encode()).hexdigest(), text(a), text(b), slow_likeness(a, b), slow_likeness(a, c))
    return out


def got(df):
    return {r["doc_id"]: tuple(r)[1:] for r in df.collect()}


def test_whole_table(spark, sf_dir):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    out = got(op9_fingerprints(spark, sf_dir))
    assert out == brute(rows)
    assert all(0 <= x[4] <= 1 and 0 <= x[5] <= 1 for x in out.values())
    by_text = {}
    for d, t in rows:
        by_text.setdefault(t, set()).add(out[d][2])
    assert all(len(x) == 1 for x in by_text.values())


def test_edge_cases(spark):
    rows = [(1, None), (2, ""), (3, "a"), (5, "é🙂" * 9), (8, "long text " * 30_000), (9, "long text " * 30_000), (2**60, "b" * 5000), (-4, "c" * 77)]
    docs = spark.createDataFrame([(d, t, "x") for d, t in rows], "doc_id long, text string, bucket string")
    assert got(fingerprints.fingerprint_pairs(docs)) == brute(rows)
    assert got(fingerprints.fingerprint_pairs(docs.filter("doc_id = 3"))) == brute([(3, "a")])
    assert fingerprints.fingerprint_pairs(docs.limit(0)).count() == 0
    twice = spark.createDataFrame([(1, "a" * 300), (1, "a" * 300), (None, "b"), (2, "c")], "doc_id long, text string")
    assert fingerprints.fingerprint_pairs(twice).count() == 4


def test_chunks_resist_shifts():
    r = random.Random(2)
    text = "".join(r.choices("abcdefghijklmnop ", k=20_000)).encode()
    for other in (b"x" + text, text[:9000] + b"some new words" + text[9000:], text[137:]):
        assert fingerprints.likeness(fingerprints.chunk_set(text), fingerprints.chunk_set(other)) > 0.95
    assert fingerprints.likeness(fingerprints.chunk_set(text), fingerprints.chunk_set(text[::-1])) < 0.05
    part = fingerprints.chunk_set(text[4000:9000])
    assert fingerprints.likeness(part, fingerprints.chunk_set(text)) > 0.9  # containment


def test_gear_hash_and_sizes():
    data = np.random.default_rng(1).integers(0, 256, 3000).astype(np.uint8)
    h, want = 0, []
    for b in data.tolist():
        h = (2 * h + int(fingerprints.GEAR[b])) % 2**32
        want.append(h)
    assert fingerprints.gear_hash(data).tolist() == want
    sizes = np.diff(np.append(0, fingerprints.cut_points(data)))
    assert sizes.sum() == 3000 and sizes.max() <= fingerprints.MAX_SIZE and sizes[:-1].min() >= fingerprints.MIN_SIZE


def test_many_ranges_and_rows_without_id(spark):
    r = random.Random(8)
    rows = [(d * 3, "".join(r.choices("abcdef ", k=r.randrange(0, 400)))) for d in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    out = fingerprints.fingerprint_pairs(docs, range_bytes=1000)
    assert got(out) == brute(rows)
    sizes = [r["n"] for r in out.groupBy(F.spark_partition_id()).agg(F.count("*").alias("n")).collect()]
    assert len(sizes) > 10 and max(sizes) < 60  # ranges are dealt over tasks, several small ones to some
    lost = [(None, f"text without id {i} " * 9) for i in range(300)]
    out = fingerprints.fingerprint_pairs(spark.createDataFrame(lost + rows, "doc_id long, text string"), range_bytes=1000).collect()
    assert len(out) == 500 and {x["doc_id"]: tuple(x)[1:] for x in out if x["doc_id"] not in (None, 597)} == {d: x for d, x in brute(rows).items() if d != 597}
