"""Windows as a walk through days, against windows as arrays."""

from __future__ import annotations

import datetime as dt

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tideline.operators import attention, experiment, model, series, text, walk
from tideline.plans import catalogue


@pytest.mark.parametrize(
    ("sizes", "lookback", "n"),
    [
        ({}, 60, 70), ({"d_model": 6, "patch_len": 4, "patch_stride": 2, "channels": (5, 4)}, 12, 5), ({"d_model": 6, "patch_len": 11, "patch_stride": 2, "channels": (5, 4), "kernel": 5}, 13, 5),
        ({"d_model": 6, "patch_len": 2, "patch_stride": 1, "channels": (5, 4, 3)}, 9, 1),
    ],
)
def test_sliding_pass_is_the_pass_of_each_window(sizes, lookback, n):
    shape, r = model.Shape(n_features=2, text_dim=2, **sizes), np.random.default_rng(1)
    w = {k: r.uniform(0.5, 1.5, v.shape) if k.startswith("norm") else v for k, v in model.initial_weights(shape, 3).items()}
    values, news = r.normal(size=(n + lookback - 1, 2)), r.normal(size=(n, 2))
    x = np.array([values[k : k + lookback] for k in range(n)])
    assert model.slides(shape, lookback)
    (pred, least), want = model.sliding_forward(w, shape, values, lookback, news), model.forward(w, shape, x, news)
    assert np.allclose(pred, want.pred, atol=1e-13) and np.allclose(least.ravel(), want.d2.min(1), atol=1e-12)


def masked_windows(x, segments, shape):
    out = x.copy()
    for k, s in enumerate(segments):
        out[k, s * shape.patch_stride : s * shape.patch_stride + shape.patch_len] = x[k].mean(0)
    return out


@pytest.mark.parametrize(
    ("sizes", "lookback"),
    [({}, 60), ({"d_model": 6, "patch_len": 4, "patch_stride": 2, "channels": (5, 4)}, 12), ({"d_model": 6, "patch_len": 11, "patch_stride": 2, "channels": (5, 4), "kernel": 5}, 13), ({"d_model": 6, "patch_len": 2, "patch_stride": 1, "channels": (5, 4, 3)}, 9)],
)
def test_masks_on_the_sliding_pass_are_passes_of_masked_windows(sizes, lookback):
    """Of three series in one pass, one of them with a single window; each window with every segment masked, and each with one of its own."""
    shape, r = model.Shape(n_features=2, text_dim=2, **sizes), np.random.default_rng(2)
    w = {k: r.uniform(0.5, 1.5, v.shape) if k.startswith("norm") else v for k, v in model.initial_weights(shape, 3).items()}
    counts = (7, 1, 12)
    series_of = [r.normal(size=(n + lookback - 1, 2)) for n in counts]
    x = np.array([v[k : k + lookback] for v, n in zip(series_of, counts, strict=True) for k in range(n)])
    first = np.concatenate([at + np.arange(n) for at, n in zip(np.cumsum([0, *map(len, series_of[:-1])]), counts, strict=True)])
    news, per = r.normal(size=(20, 2)), (lookback - shape.patch_len) // shape.patch_stride + 1
    made = model.Sliding(w, shape, np.concatenate(series_of), lookback, news, first)
    want = model.forward(w, shape, x, news)
    assert np.allclose(made.pred, want.pred, atol=1e-13) and np.allclose(made.least.ravel(), want.d2.min(1), atol=1e-12)
    segments = np.stack([*(np.full(20, s) for s in range(per)), r.integers(0, per, 20)])
    for got, own in zip(made.masked(segments, chunk=3), segments, strict=True):
        assert np.allclose(got, model.forward(w, shape, masked_windows(x, own, shape), news).pred, atol=1e-13)


def test_masked_passes_compute_what_the_mask_reaches(monkeypatch):
    """Of 60 places a layer the mask of 12 reaches 14, 16 and 18, of which 5, 9 and 13 differ; then 5 of 9 segments."""
    shape, r, spans = catalogue.SHAPE, np.random.default_rng(2), []
    made = model.Sliding(model.initial_weights(shape), shape, r.normal(size=(70, 2)), 60, r.normal(size=(11, 2)))
    plain = model.Taps.changed
    monkeypatch.setattr(model.Taps, "changed", lambda self, *given: (spans.append(self.width), plain(self, *given)))
    monkeypatch.setattr(model, "forward", None)
    made.masked(np.full((2, 11), 4))
    assert (spans.count(3), spans.count(12)) == (5 + 9 + 13, 5)


@pytest.mark.parametrize("name", ["b", "c0", "c1"])
@pytest.mark.parametrize("sizes", [{}, {"e_layers": 3, "patch_len": 7, "patch_stride": 3}, {"e_layers": 1, "patch_len": 4, "patch_stride": 6, "n_heads": 2}, {"e_layers": 0}])
def test_scorer_makes_forwards_predictions(name, sizes):
    shape, r = model.build_model(name, n_features=2, text_dim=2, **sizes), np.random.default_rng(3)
    w = {k: r.uniform(0.5, 1.5, v.shape) if k.endswith((".gain", ".shift")) else v for k, v in model.initial_weights(shape).items()}
    x, counts = r.normal(size=(9, 60, 2)) * 5, np.array([2, 0, 4, 1, 3, 0, 0, 1, 1])
    text = attention.Ragged(r.normal(size=(counts.sum(), 2)), counts) if name == "c1" else r.normal(size=(9, 2))
    scorer, segments = attention.scorer(w, shape), r.integers(0, shape.n_segments, (2, 9))
    segments[:, 0] = 0, shape.n_segments - 1
    want = model.forward(w, shape, x, text)
    for n in (9, 4):  # the second time with fewer windows than its arrays hold
        made, least = scorer.windows(x[:n], 3)
        scorer.mask(x[:n], made[1:], segments[:, :n])
        pred, *other = scorer.predicted(made, text[:n])
        assert np.allclose(pred, want.pred[:n], atol=1e-13) and np.allclose(least.ravel(), want.d2.min(1)[: least.size], rtol=1e-12)
        for got, own in zip(other, segments[:, :n], strict=True):
            assert np.allclose(got, model.forward(w, shape, masked_windows(x[:n], own, shape), text[:n]).pred, atol=1e-13)


def test_scores_of_any_size_stay_finite():
    near = np.array([[[0.0, 1.0, 2.0]], [[1.0, 1.0, 1.0]]])
    for score in (near, near + [[[5000.0]], [[-5000.0]]], near * 4000):
        want = np.exp(score - score.max(-1, keepdims=True))
        got = attention.raised(score.copy())
        assert np.allclose(got / got.sum(-1, keepdims=True), want / want.sum(-1, keepdims=True), rtol=1e-12)


@pytest.fixture(scope="module")
def days(spark):
    """Tickers of several lengths with gaps, news on and between their days, before and after them, and of no ticker's."""
    r, start = np.random.default_rng(5), dt.date(2020, 1, 1)
    bars, news = [], []
    for ticker, n in (("a", 40), ("b", 11), ("c", 9), ("d", 25)):
        at = 0
        for _ in range(n):
            at += int(r.integers(1, 5))
            bars.append((ticker, start + dt.timedelta(at), float(r.normal()) if r.random() > 0.1 else None, float(r.normal()), float(r.normal())))
    for ticker, n in (("a", 90), ("b", 5), ("e", 4)):
        news += [(ticker, start + dt.timedelta(int(r.integers(-10, 140))), r.normal(size=2).tolist()) for _ in range(n)]
    return spark.createDataFrame(bars, "ticker string, date date, p double, q double, target double").repartition(3), spark.createDataFrame([*news, ("a", start, None), (None, start, [1.0, 2.0])], "ticker string, date date, vec array<double>")


@pytest.mark.parametrize("block", [1, 4, 512])
def test_windows_are_those_of_arrays(days, block):
    bars, news = days
    bounds, lookback, horizon = ("2020-02-10", "2020-03-05"), 7, 3

    def run(b):
        dates, counts, vectors = b.texts()
        cut = np.cumsum(counts)[:-1]
        flat = [[float(v) for v in part.ravel()] for part in (*b.x, *b.text(), *b.y)]
        n = len(b)
        return pa.RecordBatch.from_arrays(
            [pa.repeat(b.ticker, n), pa.array(b.end_idx), pa.array([b.split] * n), pa.array(flat[:n]), pa.array(flat[n : 2 * n]), pa.array(flat[2 * n :]), pa.array([d.tolist() for d in np.split(dates, cut)], pa.list_(pa.int32())),
             pa.array([v.ravel().tolist() for v in np.split(vectors, cut)], pa.list_(pa.float64()))], names="ticker end_idx split x text y days texts".split(),
        )

    schema = "ticker string, end_idx int, split string, x array<double>, text array<double>, y array<double>, days array<int>, texts array<double>"
    got = {(r["ticker"], r["end_idx"]): r for r in walk.map_windows(bars, news, 2, run, schema, bounds, ("p", "q"), "target", lookback, horizon, block=block).collect()}
    made = series.with_split(series.windows(bars, ("p", "q"), "target", lookback, horizon), *bounds)
    made = made.join(text.window_text(bars, news, 2, lookback), ["ticker", "end_date"]).join(text.window_texts(bars, news, 2, lookback), ["ticker", "end_date"])
    want = {(r["ticker"], r["end_idx"]): r for r in made.collect()}
    assert set(got) == set(want) and len(want) > 20 and {r["split"] for r in want.values()} == set(series.SPLITS)
    for key, r in want.items():
        g = got[key]
        assert g["split"] == r["split"] and g["y"] == r["y"]
        assert g["x"] == [v or 0.0 for one in r["x"] for v in (one["p"], one["q"])]
        assert np.allclose(g["text"], r["text"], atol=1e-12) and np.allclose(g["texts"], np.array(r["texts"]).ravel(), atol=1e-12)
        assert [dt.date(1970, 1, 1) + dt.timedelta(d) for d in g["days"]] == r["text_dates"]
    only = walk.map_windows(bars, news, 2, run, schema, bounds, ("p", "q"), "target", lookback, horizon, splits=("test",)).collect()
    assert sorted((r["ticker"], r["end_idx"]) for r in only) == sorted(k for k, r in want.items() if r["split"] == "test")


@pytest.mark.parametrize("together", [1, 25, 1000])
def test_blocks_of_several_tickers_are_handed_over_together(days, together):
    bars, news = days
    bounds = ("2020-02-10", "2020-03-05")

    def keys(blocks):
        values, first = walk.stacked(blocks)
        at = np.concatenate([b.x for b in blocks])
        assert np.array_equal(np.lib.stride_tricks.sliding_window_view(values, 7, 0)[first].transpose(0, 2, 1), at)
        return pa.RecordBatch.from_arrays([pa.array([str(b.ticker) for b in blocks for _ in range(len(b))]), pa.array(np.concatenate([b.end_idx for b in blocks])), pa.repeat(pa.scalar(len(at), pa.int32()), len(at))], names=["ticker", "end_idx", "n"])

    got = walk.map_windows(bars.coalesce(1), news, 2, keys, "ticker string, end_idx int, n int", bounds, ("p", "q"), "target", 7, 3, block=4, together=together).collect()
    one = walk.map_windows(bars, news, 2, lambda b: keys([b]), "ticker string, end_idx int, n int", bounds, ("p", "q"), "target", 7, 3).collect()
    assert sorted(r[:2] for r in got) == sorted(r[:2] for r in one)
    assert max(r["n"] for r in got) <= together + 3 and (together == 1 or max(r["n"] for r in got) > 4)


@pytest.mark.parametrize("splits", [("test",), ("val", "test"), ("train", "test"), ("val",)])
def test_bars_that_no_window_takes_are_left_out_once_counted(spark, days, splits):
    """Numbers, draws and windows are those of all bars, though Python is sent only what it walks through."""
    bars, news = days
    bounds, schema = ("2020-02-10", "2020-03-05"), "ticker string, end_idx int, draw long, x array<double>, y array<double>, text array<double>"

    def run(b):
        flat = [[float(v) for v in part.ravel()] for part in (*b.x, *b.y, *b.text())]
        n = len(b)
        draw = pa.nulls(n, pa.int64()) if b.draw is None else pa.array(b.draw)
        return pa.RecordBatch.from_arrays([pa.repeat(b.ticker, n), pa.array(b.end_idx), draw, *[pa.array(flat[k * n : (k + 1) * n]) for k in range(3)]], names="ticker end_idx draw x y text".split())

    draw = F.xxhash64("ticker", "end_idx")
    args = (bars, news, 2, run, schema, bounds, ("p", "q"), "target", 7, 3)
    got = {r[:2]: r for r in walk.map_windows(*args, splits=splits, draw=draw).collect()}
    want = {r[:2]: r for r in walk.map_windows(*args, splits=splits).withColumn("draw", draw).collect()}
    assert len(got) > 5 and set(got) == set(want)
    for key, r in got.items():
        assert r["draw"] == want[key]["draw"]
        assert all(np.allclose(r[c], want[key][c], atol=1e-12, equal_nan=True) for c in ("x", "y", "text"))
    sent = walk.laid(bars, news, ("p", "q"), "target", 2, draw, bounds[1], 7).filter("bar").groupBy("ticker").agg(F.count("*").alias("n")).collect()
    own = bars.groupBy("ticker").agg(F.count("*").alias("n"), F.sum((F.col("date") <= bounds[1]).cast("int")).alias("before")).collect()
    assert {r["ticker"]: r["n"] for r in sent if r["n"]} == {r["ticker"]: r["n"] - max(0, r["before"] - 6) for r in own if r["n"] > max(0, r["before"] - 6)}


@pytest.mark.parametrize("name", ["model_evaluate", "model_forward", "model_ablation", "model_text_attention", "model_faithfulness"])
def test_models_are_sent_days_and_not_windows(spark, sf_dir, name):
    """A day's values are sent once, not in each of the sixty windows that hold it."""
    plan = catalogue.QUERIES[name](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and "collect_list" not in plan


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_bank_is_chosen_by_keys_alone(spark, sf_dir):
    """Only the bank's tickers get windows as arrays; they are few, so the scan itself is filtered by them."""
    assert "l_suppkey" in plan_of(catalogue.QUERIES["projection_json"](spark, sf_dir)).split("PushedFilters: ", 1)[1].split("]", 1)[0]
    rows = catalogue.split_windows(spark, sf_dir).filter("split = 'train'")
    want = sorted((r["ticker"], r["end_idx"]) for r in rows.select("ticker", "end_idx").collect())[:576]
    assert [(r["ticker"], r["end_idx"], r["window_no"]) for r in experiment.bank_keys(rows).orderBy("window_no").collect()] == [(*k, n) for n, k in enumerate(want)]


def test_text_means_take_one_sort_of_bars_and_news(days):
    bars, news = days
    plan = plan_of(text.window_text(bars, news, 2, 7))
    assert "Join" not in plan and plan.count("Sort [") == 1


def test_text_means_against_loops(days):
    bars, news = days
    by, texts = {}, [(r["ticker"], r["date"], r["vec"]) for r in news.collect() if r["vec"] and r["ticker"]]
    for r in bars.orderBy("date").collect():
        by.setdefault(r["ticker"], []).append(r["date"])
    got = {(r["ticker"], r["end_date"]): r for r in text.window_text(bars, news, 2, 7).collect()}
    assert set(got) == {(t, d) for t, own in by.items() for d in own[6:]}
    for (t, d), r in got.items():
        start = by[t][by[t].index(d) - 6]
        inside = [v for ticker, day, v in texts if ticker == t and start <= day <= d]
        assert r["n_news"] == len(inside) and np.allclose(r["text"], np.mean(inside, 0) if inside else [0, 0], atol=1e-12)


def test_patch_ends_are_those_of_patches(spark, sf_dir, days):
    bars, _ = days
    got = series.patch_ends(bars, "p", 4, 2, 8, 3)
    cut = series.patches(series.windows(bars, ("p",), "target", 8, 3), 4, 2)
    want = [(r["ticker"], r["end_idx"], r["seg_no"], r["patch"][0]["p"], r["patch"][-1]["p"]) for r in cut.collect()]
    key = lambda r: r[:3]
    assert sorted((tuple(r) for r in got.select("ticker", "end_idx", "seg_no", "first", "last").collect()), key=key) == sorted(want, key=key) and any(r[3] is None for r in want)
    assert "collect_list" not in plan_of(catalogue.QUERIES["window_patches"](spark, sf_dir))


def test_look_backs_first_values_and_sums_without_arrays(spark, sf_dir, days):
    bars, _ = days
    made = series.windows(bars, ("p", "q"), "target", 7, 3, summaries={"sum": F.sum("q")}, picked={"first": ("p", 0), "third": ("p", 2)}).collect()
    assert made and any(r["first"] is None for r in made)
    for r in made:
        assert (r["first"], r["third"]) == (r["x"][0]["p"], r["x"][2]["p"]) and abs(r["sum"] - sum(v["q"] for v in r["x"])) < 1e-12
    assert "collect_list" not in plan_of(catalogue.QUERIES["lookback_windows"](spark, sf_dir))


def test_attention_ends_early_with_the_same_weights():
    shape, r = model.build_model("c1", n_features=2, text_dim=2), np.random.default_rng(3)
    w, x, counts = model.initial_weights(shape), r.normal(size=(5, 60, 2)), np.array([2, 1, 4, 1, 3])
    sets = attention.Ragged(r.normal(size=(counts.sum(), 2)), counts)
    short = attention.forward(w, shape, x, sets, until_attention=True)
    assert np.allclose(short.kept["attention"], attention.forward(w, shape, x, sets).kept["attention"], atol=1e-14) and short.pred.size == 0
