from __future__ import annotations

import datetime as dt

import numpy as np
import pytest

from tideline.operators import model

SHAPE = model.Shape(n_features=2, horizon=3, d_model=6, n_prototypes=4, d_min=0.5, patch_len=4, patch_stride=2, channels=(5, 4), kernel=3, text_dim=3, text_hidden=5, head_hidden=7)


def batch(n=5, t=12, seed=1):
    r = np.random.default_rng(seed)
    return r.normal(size=(n, t, 2)), r.normal(size=(n, 3)), r.normal(size=(n, 3))


def test_forward_against_plain_loops():
    w, (x, text, _) = model.initial_weights(SHAPE, 3), batch()
    out = model.forward(w, SHAPE, x, text)
    h = x[0]
    for i, c_out in enumerate(SHAPE.channels):
        kernel = w[f"conv{i}.w"].reshape(h.shape[1], 3, c_out)
        z = np.array([[w[f"conv{i}.b"][o] + sum(h[t + k - 1, c] * kernel[c, k, o] for c in range(h.shape[1]) for k in range(3) if 0 <= t + k - 1 < len(h)) for o in range(c_out)] for t in range(len(h))])
        h = np.maximum(z, 0) / np.sqrt(1 + model.EPSILON)
    kernel = w["patch.w"].reshape(h.shape[1], 4, 6)
    seg = np.array([w["patch.b"] + sum(h[s * 2 + k, c] * kernel[c, k] for c in range(h.shape[1]) for k in range(4)) for s in range(5)])
    assert np.allclose(seg, out.seg_pre[0])
    d2 = ((seg[:, None] - w["prototypes"]) ** 2).sum(-1)
    soft = np.exp(-d2) / np.exp(-d2).sum(1, keepdims=True)
    post = seg + soft @ w["prototypes"] @ w["inject.w"] + w["inject.b"]
    assert np.allclose(post, out.seg_post[0])
    t = np.maximum(text[0] @ w["text0.w"] + w["text0.b"], 0) @ w["text1.w"] + w["text1.b"]
    pred = np.maximum(np.concatenate([post.mean(0), t]) @ w["head0.w"] + w["head0.b"], 0) @ w["head1.w"] + w["head1.b"]
    assert np.allclose(pred, out.pred[0])


def test_protocol_sizes():
    shape = model.build_model("a")
    out = model.forward(model.initial_weights(shape), shape, np.zeros((2, 60, 5)), np.zeros((2, 64)))
    assert out.seg_pre.shape == (2, 9, 64) and out.pred.shape == (2, 7)
    with pytest.raises(ValueError):
        model.build_model("d")


def test_gradients_against_differences():
    w, (x, text, y) = model.initial_weights(SHAPE, 3), batch()
    w["prototypes"] = np.random.default_rng(2).normal(size=w["prototypes"].shape) * 0.15
    lambdas = (0.3, 0.2, 0.1)
    _, g, _ = model.loss_and_gradients(w, SHAPE, x, text, y, lambdas)
    assert set(g) == {k for k in w if model.trained(k)}
    r = np.random.default_rng(4)
    for name in g:
        for _ in range(4):
            at = tuple(r.integers(0, s) for s in w[name].shape)
            old, step = w[name][at], 1e-6
            values = []
            for v in (old + step, old - step):
                w[name][at] = v
                values.append(model.loss_and_gradients(w, SHAPE, x, text, y, lambdas)[0]["loss"])
            w[name][at] = old
            assert abs((values[0] - values[1]) / (2 * step) - g[name][at]) < 1e-5, name


def windows(spark, n=160):
    x, text, _ = batch(n, seed=7)
    y = np.stack([x[:, -1, 0], x[:, :, 0].mean(1), text[:, 0]], 1)
    rows = [("a", i, dt.date(2020, 1, 1), x[i].tolist(), text[i].tolist(), y[i].tolist()) for i in range(n)]
    return spark.createDataFrame(rows, "ticker string, end_idx int, end_date date, x array<array<double>>, text array<double>, y array<double>")


def test_scoring_does_not_depend_on_partitions(spark):
    rows, w = windows(spark, 40), model.initial_weights(SHAPE, 3)
    got = [sorted((r["end_idx"], tuple(np.round(r["pred"], 9))) for r in model.score(rows.repartition(n), w, SHAPE).collect()) for n in (1, 7)]
    assert got[0] == got[1]
    seg = model.segments(model.score(rows, w, SHAPE))
    assert seg.count() == 40 * 5
    assert model.evaluate(rows.limit(0), w, SHAPE) == {"n": 0, "mse": None, "mae": None}


def test_training_improves_and_weights_survive(spark, tmp_path):
    rows = windows(spark)
    start = model.evaluate(rows, model.initial_weights(SHAPE, 42), SHAPE)["mse"]
    fit = model.train(rows, rows, SHAPE, str(tmp_path / "t"), epochs=5, batch_size=16, rate=0.02, batches_per_step=2, workers=2)
    assert model.evaluate(rows, fit.weights, SHAPE)["mse"] < 0.8 * start
    assert fit.best_epoch and len(fit.history) == 5 and fit.history[-1]["train_loss"] < fit.history[0]["train_loss"]
    model.save_weights(spark, fit.weights, str(tmp_path / "w"), SHAPE)
    back = model.load_weights(spark, str(tmp_path / "w"))
    assert set(back) == set(fit.weights) and all((back[k] == fit.weights[k]).all() for k in back)


def test_training_stops_early(spark, tmp_path):
    rows = windows(spark, 32)
    fit = model.train(rows, rows.limit(0), SHAPE, str(tmp_path / "t"), epochs=9, patience=2, batch_size=16, batches_per_step=2, workers=1)
    assert len(fit.history) == 2 and fit.best_epoch is None
    with pytest.raises(ValueError):
        model.train(rows.limit(0), rows, SHAPE, str(tmp_path / "u"))


def test_training_does_not_depend_on_partitions(spark, tmp_path):
    rows, made = windows(spark, 100), []
    for n in (1, 9):
        made.append(model.train(rows.repartition(n), rows, SHAPE, str(tmp_path / f"p{n}"), epochs=2, batch_size=16, workers=3).weights)
    assert all(np.allclose(made[0][k], made[1][k], atol=1e-9) for k in made[0])


def test_one_worker_is_the_sequential_loop(spark, tmp_path):
    """A worker's epoch is mini-batches one after the other, in the order of the keys' hashes."""
    rows = windows(spark, 50)
    fit = model.train(rows, rows, SHAPE, str(tmp_path / "one"), epochs=1, batch_size=16, workers=1, seed=5, rate=0.01)
    order = rows.selectExpr("*", "xxhash64(ticker, end_idx, 'order 1 5') AS at").orderBy("at").collect()
    w, optimiser = model.initial_weights(SHAPE, 5), model.AdamW(0.01, 1e-4, 1.0)
    for lo in range(0, 50, 16):
        x, text, y = (np.array([r[c] for r in order[lo : lo + 16]]) for c in ("x", "text", "y"))
        _, g, out = model.loss_and_gradients(w, SHAPE, x, text, y)
        optimiser.step(w, g)
        m = x.shape[0] * x.shape[1]
        for i in range(len(SHAPE.channels)):
            w[f"norm{i}.mean"] += 0.1 * (out.kept[i][5] - w[f"norm{i}.mean"])
            w[f"norm{i}.var"] += 0.1 * (out.kept[i][6] * m / (m - 1) - w[f"norm{i}.var"])
    assert all(np.allclose(fit.weights[k], w[k]) for k in w)
