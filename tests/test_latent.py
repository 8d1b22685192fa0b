"""Learnt text vectors against numpy's SVD."""

from __future__ import annotations

import numpy as np
import pytest

from tideline.operators import latent


def dense(rows, buckets):
    """TF-IDF as a full matrix, by loops."""
    a = np.zeros((len(rows), buckets))
    for k, words in enumerate(rows):
        for b in words:
            a[k, b] += 1
    idf = np.log((1 + len(rows)) / (1 + (a > 0).sum(0))) + 1
    a = np.where(a > 0, 1 + np.log(np.maximum(a, 1)), 0) * idf
    length = np.linalg.norm(a, axis=1, keepdims=True)
    return a / np.where(length > 0, length, 1)


@pytest.fixture(scope="module")
def docs(spark):
    r = np.random.default_rng(1)
    topics = [[f"w{t}x{k}" for k in range(12)] for t in range(4)]
    texts = [" ".join(r.choice(topics[k % 4], r.integers(3, 30))) + " Common, words" * (k % 2) for k in range(150)] + [None, "", "...", "Größe größe 1"]
    return spark.createDataFrame(list(enumerate(texts)), "id int, text string")


@pytest.mark.parametrize(("parts", "fan_in"), [(1, 2), (7, 2), (5, 16)])
def test_against_numpy(spark, docs, parts, fan_in):
    made = latent.fit(docs.repartition(parts), dim=4, buckets=512, turns=12, more=12, fan_in=fan_in)
    rows = [r["w"] for r in docs.orderBy("id").select(latent.words(docs["text"], 512).alias("w")).collect()]
    a = dense(rows, 512)
    _, values, vt = np.linalg.svd(a, full_matrices=False)
    assert np.allclose(made.values, values[:4], rtol=1e-4)
    assert np.allclose(np.abs((made.basis * vt[:4].T).sum(0)), 1, atol=1e-3)  # up to sign
    got = np.array([r["v"] for r in docs.orderBy("id").select("id", latent.encode(docs["text"], made, spark).alias("v")).orderBy("id").collect()])
    want = a @ made.basis
    length = np.linalg.norm(want, axis=1, keepdims=True)
    assert np.allclose(got, want / np.where(length > 0, length, 1), atol=1e-9)
    assert (got[150:153] == 0).all()


def test_it_learns(spark, docs):
    """Texts of one topic come closer than texts of two, which share no words with them."""
    made = latent.fit(docs, dim=4, buckets=512)
    v = np.array([r["v"] for r in docs.filter("id < 150").select("id", latent.encode(docs["text"], made, spark).alias("v")).orderBy("id").collect()])
    topic = np.arange(150) % 4
    same = topic[:, None] == topic
    alike = v @ v.T
    assert alike[same].mean() > 0.9 and alike[~same].mean() < 0.3


def test_few_texts(spark):
    for texts in ([], [("one",)], [(None,)]):
        made = latent.fit(spark.createDataFrame(texts, "text string"), dim=3, buckets=16, turns=2, more=2)
        assert made.basis.shape == (16, 3) and np.isfinite(made.basis).all() and (made.values[1:] < 1e-6).all()
