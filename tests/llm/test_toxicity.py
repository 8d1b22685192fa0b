from __future__ import annotations

import math
import zlib

import numpy as np
from pyspark.sql import functions as F

from tideline.llm import toxicity
from tideline.llm.queries import op8_toxicity

SF = "/root/testdata/sf0.01"


def auc(score, label):
    order = np.argsort(score, kind="stable")
    rank = np.empty(len(order))
    rank[order] = np.arange(1, len(order) + 1)
    n = label.sum()
    return (rank[label == 1].sum() - n * (n + 1) / 2) / (n * (len(label) - n))


def test_held_out_accuracy(spark):
    got = op8_toxicity(spark, SF).toPandas()
    assert (got.held_out == [zlib.crc32(str(d).encode()) % 3 == 1 for d in got.doc_id]).all()
    assert ((got.score >= 0.7).astype(int) == got.predicted).all() and got.score.between(0, 1).all()
    labels = spark.read.parquet(f"{SF}/labels.parquet").select("doc_id", "toxic").dropna().toPandas()
    test = got.merge(labels, on="doc_id").query("held_out")
    assert auc(test.score.to_numpy(), test.toxic.to_numpy()) > 0.9
    assert (test.predicted == test.toxic).mean() > 0.9
    assert test.query("toxic == 0").predicted.mean() < 0.05


def test_held_out_labels_are_never_learnt(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    flipped = labels.withColumn("toxic", F.when(toxicity.training_part(F.col("doc_id")), F.col("toxic")).otherwise(1 - F.col("toxic")))
    a, b = toxicity.fit(docs, labels), toxicity.fit(docs.withColumn("lang", F.lit("x")), flipped)
    assert np.allclose(a.weights, b.weights) and np.isclose(a.bias, b.bias)


def test_edge_cases(spark):
    rows = [(1, None), (2, ""), (3, "x"), (4, "bad words " * 40_000), (None, "no id"), (5, "twice"), (5, "twice")]
    docs = spark.createDataFrame([(d, t, "clash") for d, t in rows], "doc_id long, text string, score string")
    labels = spark.createDataFrame([(4, 1), (5, 0), (3, None), (None, 1)], "doc_id long, toxic int")
    model = toxicity.fit(docs, labels)
    out = toxicity.score(docs, model)
    got = out.collect()
    assert len(got) == len(rows) and out.columns == ["doc_id", "text", "score", "predicted"]
    assert len({r["score"] for r in got if r["text"] in (None, "")}) == 1
    none = toxicity.fit(docs, labels.limit(0))
    assert {r["score"] for r in toxicity.score(docs, none).collect()} == {0.5}
    assert toxicity.score(docs.limit(0), none).count() == 0
    assert toxicity.fit(docs.limit(0), labels).bias == 0.0


def slow_score(text, model):
    """The score by loops over n-grams and Python numbers, from the model's weights alone."""
    mask, base = (1 << 64) - 1, int(toxicity.BASE)
    values = [int(toxicity.TABLE[ord(c) & 0xFFFF]) for c in f" {(text or '').lower()} "]
    found = set()
    for n in toxicity.ORDERS:
        for i in range(len(values) - n + 1):
            h = 0
            for v in values[i : i + n]:
                h = (h * base + v) & mask
            found.add(((h ^ (h >> 29)) * base & mask) >> (64 - toxicity.BITS))
    known = [b for b in found if model.ratios[b]]
    total = float(model.bias)
    if known:
        total += sum(float(model.weights[b]) for b in known) / max(1.0, sum(float(model.ratios[b]) ** 2 for b in known)) ** 0.25
    return 1 / (1 + math.exp(-max(-40, min(40, total))))


def test_scores_against_plain_loops(spark):
    """Whole texts, longer than a slice too, and the query's rows of the table's shortest texts."""
    sf = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    model = toxicity.fit(docs, labels)
    texts = [None, "", "a", "É longer 🙂 text", *[r["text"] for r in docs.orderBy("n_chars").limit(60).collect()], "some words " * 30_000]
    assert np.allclose(toxicity.score_texts(texts, model), [slow_score(t, model) for t in texts], atol=1e-12)
    got = {r["doc_id"]: r["score"] for r in op8_toxicity(spark, sf).collect()}
    for r in docs.orderBy("n_chars").limit(60).collect():
        assert abs(got[r["doc_id"]] - slow_score(r["text"], model)) < 1e-9


def test_keep_clean_keeps_columns(spark):
    model = toxicity.Model(np.zeros(1 << toxicity.BITS), np.zeros(1 << toxicity.BITS), 2.0)
    docs = spark.createDataFrame([(1, "a", 0.1, 1), (None, None, None, None)], "doc_id long, Text string, score double, predicted int")
    assert toxicity.keep_clean(docs, model, 0.5).count() == 0
    kept = toxicity.keep_clean(docs, model, 0.95)
    assert kept.schema == docs.schema and sorted(map(str, kept.collect())) == sorted(map(str, docs.collect()))
