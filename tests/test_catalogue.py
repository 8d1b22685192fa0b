"""Every registered query of the library against its DuckDB SQL."""

from __future__ import annotations

import json

import numpy as np
import pytest
from conftest import plain_forward, rows
from test_latent import dense

from tideline.operators import attention, latent, model
from tideline.plans import catalogue


@pytest.mark.parametrize("name", sorted(catalogue.ORACLE_SQL))
def test_oracle(spark, duck, sf_dir, name):
    got = catalogue.QUERIES[name](spark, sf_dir)
    want = duck.execute(catalogue.ORACLE_SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    got = got.toPandas()
    for c in want.columns:
        if "date" in c:
            got[c], want[c] = got[c].astype(str).str[:10], want[c].astype(str).str[:10]
    assert len(want) > 0
    assert rows(got) == rows(want)


@pytest.mark.parametrize("name", sorted(set(catalogue.QUERIES) - set(catalogue.ORACLE_SQL)))
def test_without_oracle(spark, sf_dir, name):
    assert catalogue.QUERIES[name](spark, sf_dir).count() > 0


def test_epoch_order_of_every_window(spark, sf_dir):
    got = [tuple(r) for r in catalogue.QUERIES["epoch_order_all"](spark, sf_dir).select("epoch_key", "ticker", "end_idx").collect()]
    train = catalogue.split_windows(spark, sf_dir).filter("split = 'train'").count()
    assert len(got) == train > 50 and got == sorted(got)


def test_forward_and_examples_against_plain_loops(spark, sf_dir):
    """Some windows' predictions, and the examples over the whole bank, by loops over single numbers."""
    shape, w = catalogue.SHAPE, model.initial_weights(catalogue.SHAPE)
    source = catalogue.model_rows(spark, sf_dir).select("ticker", "end_idx", "end_date", "split", "x", "text").orderBy("ticker", "end_idx").collect()
    made = {(r["ticker"], r["end_idx"]): r for r in catalogue.QUERIES["model_forward"](spark, sf_dir).collect()}
    assert len(made) == len(source)
    for r in source[:: len(source) // 4]:
        _, pred = plain_forward(w, shape, np.array(r["x"]), np.array(r["text"]))
        got = made[r["ticker"], r["end_idx"]]
        assert abs(pred[0] - got["pred_first"]) < 2e-6 and abs(pred[-1] - got["pred_last"]) < 2e-6
    bank = [r for r in source if r["split"] == "train"][: 9 * 64]
    segments = np.concatenate([model.forward(w, shape, np.array([r["x"]]), np.array([r["text"]])).seg_post[0] for r in bank])
    for r in catalogue.QUERIES["projection_json"](spark, sf_dir).collect():
        example = json.loads(r["example"])
        d2 = ((segments - w["prototypes"][r["proto_id"]]) ** 2).sum(1)
        best = int(d2.argmin())
        assert (example["window_no"], example["seg_no"]) == divmod(best, 9) and abs(example["distance"] - d2[best]) < 1e-8
        assert (example["meta"]["ticker"], example["meta"]["end_idx"]) == (bank[best // 9]["ticker"], bank[best // 9]["end_idx"])


@pytest.fixture(scope="module")
def scaled(spark, sf_dir):
    """The windows of the model queries as arrays, by split."""
    found = catalogue.model_rows(spark, sf_dir, sets=True).orderBy("ticker", "end_idx").collect()
    return found, np.array([r["x"] for r in found]), np.array([r["y"] for r in found]) / 10_000


def scored(name, found, x):
    """Each window's prediction, and the pass, in one call without Spark."""
    shape = catalogue.shapes()[name]
    sets = [np.array(r["texts"]).reshape(-1, 2) for r in found]
    text = attention.Ragged(np.concatenate(sets), np.array([len(s) for s in sets])) if shape.ragged_text else np.array([r["text"] for r in found])
    return model.forward(model.initial_weights(shape), shape, x, text)


def test_evaluation_and_ablation_against_arrays(spark, sf_dir, scaled):
    found, x, y = scaled
    split = np.array([r["split"] for r in found])
    errors = {n: scored(n, found, x).pred - y for n in ("a", "b", "c0", "c1")}
    for r in catalogue.QUERIES["model_evaluate"](spark, sf_dir).collect():
        own = errors["a"][split == r["split"]]
        assert r["n"] == own.size and abs((own**2).mean() - r["mse"]) < 1e-8 and abs(np.abs(own).mean() - r["mae"]) < 1e-8
    row = catalogue.QUERIES["model_ablation"](spark, sf_dir).first()
    mse = {n: (e[split == "test"] ** 2).mean() for n, e in errors.items()}
    assert all(abs(row[f"{n}_mse"] - mse[n]) < 1e-8 for n in mse)
    assert all(abs(row[f"delta_{a}_{b}_mse"] - (mse[b] - mse[a])) < 2e-8 for a, b in (("a", "b"), ("b", "c0"), ("c0", "c1")))


def test_attention_against_arrays(spark, sf_dir, scaled):
    found, x, _ = scaled
    weights = np.split(scored("c1", found, x).kept["attention"], np.cumsum([len(r["texts"]) for r in found])[:-1])
    got = {(r["ticker"], r["end_idx"]): r for r in catalogue.QUERIES["model_text_attention"](spark, sf_dir).collect()}
    assert len(got) == len(found)
    for r, w in zip(found, weights, strict=True):
        one = got[r["ticker"], r["end_idx"]]
        assert one["n_days"] == len(w) and abs(one["total"] - w.sum()) < 2e-6
        assert one["day"] is None if not len(w) else one["day"] in [d for d, v in zip(r["text_dates"], w, strict=True) if v > w.max() - 1e-9]


def test_faithfulness_query_against_a_loop(spark, sf_dir, scaled):
    found, x, y = scaled
    draws = {(r["ticker"], r["end_idx"]): r["d"] for r in catalogue.model_rows(spark, sf_dir).selectExpr("ticker", "end_idx", "pmod(xxhash64(ticker, end_idx, 42), 1048576) AS d").collect()}
    keep = [k for k, r in enumerate(found) if r["split"] == "test"]
    test = [found[k] for k in keep]
    for row in catalogue.QUERIES["model_faithfulness"](spark, sf_dir).collect():
        own = scored(row["model"], test, x[keep])
        near = own.d2.min(1).reshape(len(test), -1).argmin(1)
        masked = x[keep].copy()
        other = x[keep].copy()
        for k, r in enumerate(test):
            drawn = (near[k] + 1 + draws[r["ticker"], r["end_idx"]] % 8) % 9
            for changed, seg in ((masked, near[k]), (other, drawn)):
                changed[k, 6 * seg : 6 * seg + 12] = x[keep][k].mean(0)
        assert row["n"] == len(test) and abs(row["mse"] - ((own.pred - y[keep]) ** 2).mean()) < 1e-8
        for name, changed in (("nearest", masked), ("random", other)):
            pred = scored(row["model"], test, changed).pred
            assert abs(row[f"mse_{name}"] - ((pred - y[keep]) ** 2).mean()) < 1e-8 and abs(row[f"shift_{name}"] - np.abs(pred - own.pred).mean()) < 1e-8


def test_latent_vectors_against_numpy(spark, sf_dir):
    """The vectors span what numpy's SVD of the full matrix spans: as much of the texts' words lies in them."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    found = [r["w"] for r in docs.orderBy("doc_id").select(latent.words(docs["text"], 1 << 12).alias("w")).collect()]
    a = dense(found, 1 << 12)
    made = latent.fit(docs, dim=8, buckets=1 << 12, turns=4, more=8)
    best = np.linalg.svd(a, compute_uv=False)[:8]
    assert (np.linalg.norm(a @ made.basis, axis=0) <= best + 1e-9).all() and np.linalg.norm(a @ made.basis) > 0.98 * np.linalg.norm(best)
    got = np.array([r["vec"] for r in catalogue.QUERIES["news_latent_vectors"](spark, sf_dir).orderBy("doc_id").collect()])
    want = a @ made.basis
    assert np.allclose(got, want / np.maximum(np.linalg.norm(want, axis=1, keepdims=True), 1e-300), atol=1e-4)
