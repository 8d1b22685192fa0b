"""Models b, c0 and c1: gradients, plain loops, training and what they output."""

from __future__ import annotations

import numpy as np
import pytest

from tideline.operators import attention, experiment, model, training

SIZES = {"n_features": 2, "horizon": 3, "d_model": 8, "n_heads": 2, "n_prototypes": 4, "patch_len": 4, "patch_stride": 2, "lookback": 12, "text_dim": 3, "text_hidden": 5, "head_hidden": 7, "wide": 6}
COUNTS = np.array([2, 0, 4, 1, 0])


def case(name, dropout=0.0):
    shape = model.build_model(name, **SIZES, dropout=dropout)
    w = model.initial_weights(shape, 3)
    r = np.random.default_rng(1)
    w["prototypes"] = np.random.default_rng(2).normal(size=w["prototypes"].shape) * 0.3
    text = attention.Ragged(r.normal(size=(7, 3)), COUNTS) if shape.ragged_text else r.normal(size=(5, 3))
    return shape, w, r.normal(size=(5, 12, 2)), text, r.normal(size=(5, 3))


@pytest.mark.parametrize("dropout", [0.0, 0.3])
@pytest.mark.parametrize("name", ["b", "c0", "c1"])
def test_gradients_against_differences(name, dropout):
    shape, w, x, text, y = case(name, dropout)
    loss = lambda: model.loss_and_gradients(w, shape, x, text, y, (0.3, 0.2, 0.1), np.random.default_rng(9))
    _, g, _ = loss()
    assert set(g) == set(w)
    r = np.random.default_rng(4)
    for key in g:
        for _ in range(3):
            at = tuple(r.integers(0, n) for n in w[key].shape)
            old, step, values = w[key][at], 1e-6, []
            for v in (old + step, old - step):
                w[key][at] = v
                values.append(loss()[0]["loss"])
            w[key][at] = old
            assert abs((values[0] - values[1]) / (2 * step) - g[key][at]) < 1e-5, key


def plainly(w, shape, x, texts):
    """(prediction, text weights) of one window, token by token and head by head."""
    dense = lambda name, v: v @ w[f"{name}.w"] + w[f"{name}.b"]
    norm = lambda name, v: (v - v.mean()) / np.sqrt(v.var() + model.EPSILON) * w[f"{name}.gain"] + w[f"{name}.shift"]
    heads, size = shape.n_heads, shape.d_model // shape.n_heads
    weights = []

    def attend(name, one, others):
        q, out, seen = dense(f"{name}.query", one), np.zeros(shape.d_model), []
        for h in range(heads):
            span = slice(h * size, (h + 1) * size)
            score = np.array([q[span] @ dense(f"{name}.key", o)[span] for o in others]) / size**0.5
            p = np.exp(score) / np.exp(score).sum()
            seen.append(p)
            out[span] = sum(a * dense(f"{name}.value", o)[span] for a, o in zip(p, others, strict=True))
        weights.append(np.mean(seen, 0))
        return dense(f"{name}.out", out)

    kernel = w["patch.w"].reshape(shape.n_features, shape.patch_len, shape.d_model)
    segments = []
    for k in range(shape.n_segments):
        at = k * shape.patch_stride
        seg = w["patch.b"] + sum(x[at + i, c] * kernel[c, i] for c in range(shape.n_features) for i in range(shape.patch_len)) + w["position"][k]
        soft = np.exp(-((w["prototypes"] - seg) ** 2).sum(1))
        segments.append(seg + dense("inject", soft @ w["prototypes"] / soft.sum()))
    two = lambda a, b, v: dense(b, np.maximum(dense(a, v), 0))
    if shape.fusion == "gate":
        t = two("text0", "text1", texts)
        segments = [p + t / (1 + np.exp(-dense("gate", np.concatenate([p, t])))) for p in segments]
    tokens = [*segments, w["global"]]
    for k in range(shape.e_layers):
        tokens = [norm(f"layer{k}.self", t + attend(f"layer{k}.self", t, tokens)) for t in tokens]
        if shape.fusion == "cross":
            tokens[-1] = norm(f"layer{k}.cross", tokens[-1] + attend(f"layer{k}.cross", tokens[-1], [w["no_text"], *[dense("texts", t) for t in texts]]))
        tokens = [norm(f"layer{k}.dense", t + two(f"layer{k}.wide", f"layer{k}.narrow", t)) for t in tokens]
    pooled = np.mean(tokens, 0)
    if shape.fusion == "late":
        pooled = np.concatenate([pooled, two("text0", "text1", texts)])
    return two("head0", "head1", pooled), weights[-1]


def windows(spark, shape, n=60, seed=7):
    """Windows whose target hangs on the texts too."""
    r = np.random.default_rng(seed)
    x = r.normal(size=(n, shape.lookback, 2))
    sets = [r.normal(size=(k % 4, 3)) for k in range(n)]
    y = np.stack([x[:, -1, 0], x[:, :, 0].mean(1), [s[:, 0].sum() for s in sets]], 1)
    rows = [("a", k, "train", x[k].tolist(), (sets[k].mean(0) if len(sets[k]) else np.zeros(3)).tolist(), sets[k].tolist() if k else None, y[k].tolist()) for k in range(n)]
    return spark.createDataFrame(rows, "ticker string, end_idx int, split string, x array<array<double>>, text array<double>, texts array<array<double>>, y array<double>")


@pytest.mark.parametrize("name", ["b", "c0", "c1"])
def test_scores_against_plain_loops(spark, name):
    shape, w, *_ = case(name, 0.5)  # nothing is dropped when windows are scored
    source = windows(spark, shape, 24)
    outputs = ("pred", "seg_post", "attention") if name == "c1" else ("pred", "seg_post")
    made = model.score(source.repartition(3), w, shape, outputs=outputs, carry=("y",), chunk=5)
    assert made.columns == ["ticker", "end_idx", "y", *outputs]
    got = {r["end_idx"]: r for r in made.collect()}
    for r in source.collect():
        texts = np.array(r["texts"] or []).reshape(-1, 3)
        pred, weights = plainly(w, shape, np.array(r["x"]), texts if name == "c1" else np.array(r["text"]))
        one = got[r["end_idx"]]
        assert np.allclose(one["pred"], pred) and one["y"] == r["y"] and len(one["seg_post"]) == shape.n_segments
        if name == "c1":
            assert np.allclose(one["attention"], weights[1:]) and len(one["attention"]) == len(texts)
    with pytest.raises(ValueError):
        model.score(source, *(case("b")[k] for k in (1, 0)), outputs=("attention",))


@pytest.mark.parametrize("name", ["b", "c0", "c1"])
def test_training_lowers_the_error(spark, tmp_path, name):
    shape = model.build_model(name, **SIZES, dropout=0.05)
    rows = windows(spark, shape, 120)
    start = model.evaluate(rows, model.initial_weights(shape, 42), shape)["mse"]
    fit = training.train(rows, rows, shape, str(tmp_path / name), epochs=9, batch_size=16, rate=0.01, workers=2)
    assert model.evaluate(rows, fit.weights, shape)["mse"] < 0.8 * start
    again = training.train(rows.repartition(5), rows, shape, str(tmp_path / f"{name}-again"), epochs=2, batch_size=16, rate=0.01, workers=2)
    assert again.history == [pytest.approx(h) for h in fit.history[:2]]
    assert experiment.faithfulness(rows, fit.weights, shape).first()["n"] == 120


def test_evaluation_is_one_scan_without_a_join(spark, tmp_path):
    shape, w, *_ = case("b")
    windows(spark, shape).write.parquet(str(tmp_path / "rows"))
    seen = []
    plain, model.forecast_metrics = model.forecast_metrics, lambda made: (seen.append(made), plain(made))[1]
    try:
        model.evaluate(spark.read.parquet(str(tmp_path / "rows")), w, shape)
    finally:
        model.forecast_metrics = plain
    plan = seen[0]._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and plan.count("FileScan") == 1 and "texts" not in plan


def test_odd_shapes():
    for wrong in ({"n_heads": 3}, {"lookback": 2}, {"fusion": "other"}):
        with pytest.raises(ValueError):
            attention.PatchShape(**{"d_model": 8, "n_heads": 2, **wrong})


@pytest.mark.parametrize("name", ["a", "c1"])
def test_resumed_run_equals_an_unbroken_one(spark, tmp_path, name):
    sizes = {k: v for k, v in SIZES.items() if name != "a" or k not in ("n_heads", "lookback", "wide")}
    shape = model.build_model(name, **sizes, **({"channels": (4,)} if name == "a" else {"dropout": 0.2}))
    rows = windows(spark, shape if name != "a" else attention.PatchShape(**SIZES), 80)
    options = {"epochs": 4, "batch_size": 8, "rate": 0.01, "workers": 3, "batches_per_step": 2, "fan_in": 2}
    whole = training.train(rows, rows, shape, str(tmp_path / "whole"), **options)

    class Killed(Exception):
        pass

    def kill(entry):
        if entry["epoch"] == 2:
            raise Killed

    with pytest.raises(Killed):
        training.train(rows, rows, shape, str(tmp_path / "cut"), **options, report=kill)
    (tmp_path / "cut/state/epoch-000003").mkdir()  # begun, but not committed
    seen = []
    fit = training.train(rows.limit(0), rows.limit(0), shape, str(tmp_path / "cut"), **options, resume=True, report=seen.append)
    assert [e["epoch"] for e in seen] == [3, 4] and fit.history == [pytest.approx(h) for h in whole.history] and fit.best_epoch == whole.best_epoch
    assert all((fit.weights[k] == whole.weights[k]).all() for k in whole.weights)
    assert training.committed(spark, str(tmp_path / "cut/state")) == ["epoch-000003", "epoch-000004"]
    with pytest.raises(ValueError):
        training.train(rows, rows, shape, str(tmp_path / "cut"), **options | {"rate": 0.5}, resume=True)


@pytest.mark.parametrize(("workers", "fan_in"), [(1, 2), (5, 2), (7, 16), (40, 3)])
def test_sums_along_the_tree(spark, workers, fan_in):
    rows = [("w", n, [float(k), 1.0 * j], 0.5, k, k, k) for k in range(workers) for j, n in enumerate("ab")]
    made = training.summed(spark.createDataFrame(rows, training.SUMS), workers, fan_in).collect()
    total, most = sum(range(workers)), workers - 1
    assert sorted(tuple(r) for r in made) == [("w", n, [float(total), float(j * workers)], 0.5 * workers, total, most, 0) for j, n in enumerate("ab")]


def test_every_worker_has_a_partition(spark):
    for n in (1, 3, 8, 40):
        place = training.slots(spark, n)
        dealt = spark.createDataFrame([(x,) for x in place], "slot int").repartition(n, "slot").selectExpr("slot", "spark_partition_id() AS at").collect()
        assert len({r["at"] for r in dealt}) == n
