"""Operators on hand-made cases, by property, and by the plans that Spark picks."""

from __future__ import annotations

import datetime as dt
import math

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tideline.functions import vectors
from tideline.operators import metrics, prototypes, series, text


def bars(spark, sizes):
    day = dt.date(2021, 12, 1)
    rows = [(t, day + dt.timedelta(i), float(i), None if i == 1 else float(i)) for t, n in sizes.items() for i in range(n)]
    return spark.createDataFrame(rows, "ticker string, date date, close double, open double").repartition(4)


def test_windows(spark):
    w = series.windows(bars(spark, {"a": 6, "b": 4, "c": 5}), ("close", "open"), lookback=3, horizon=2)
    got = sorted((r["ticker"], r["end_idx"], [x["close"] for x in r["x"]], [x["open"] for x in r["x"]], r["y"]) for r in w.collect())
    assert got == [("a", 2, [0, 1, 2], [0, None, 2], [3, 4]), ("a", 3, [1, 2, 3], [None, 2, 3], [4, 5]), ("c", 2, [0, 1, 2], [0, None, 2], [3, 4])]
    assert series.windows(bars(spark, {"a": 9}), ("close",), lookback=3, horizon=2, step=2).count() == 3
    plan = w.select("*")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning(ticker") == 1


@pytest.mark.parametrize(("n", "count"), [(65, 0), (66, 0), (67, 1), (70, 4)])
def test_window_counts_and_patches(spark, n, count):
    w = series.windows(bars(spark, {"a": n}), ("close",))
    assert w.count() == count
    cut = series.patches(w)
    assert cut.count() == 9 * count
    if count:
        assert {len(r["patch"]) for r in cut.collect()} == {12}


def test_split_and_purge(spark):
    rows = spark.createDataFrame([(1, "2021-12-31", "2022-01-05"), (2, "2022-01-01", "2022-01-05"), (3, "2022-12-31", "2023-01-03"), (4, "2023-01-01", "2023-01-05")], "id int, a string, b string")
    rows = rows.select("id", F.to_date("a").alias("end_date"), F.to_date("b").alias("y_last_date"))
    both = series.with_split(rows, "2021-12-31", "2022-12-31", purge=False)
    assert [r["split"] for r in both.orderBy("id").collect()] == ["train", "val", "val", "test"]
    assert [r["id"] for r in series.with_split(rows, "2021-12-31", "2022-12-31").orderBy("id").collect()] == [2, 4]


def test_caps_and_order(spark):
    rows = spark.createDataFrame([(s, t, i) for s in ("train", "val", "test") for t in ("a", "b") for i in range(5)], "split string, ticker string, end_idx int")
    got = series.capped(rows, {"train": 6, "val": None, "test": 0})
    assert {r["split"]: r["count"] for r in got.groupBy("split").count().collect()} == {"train": 6, "val": 10}
    assert "WindowGroupLimit" in got._jdf.queryExecution().executedPlan().toString()
    assert series.capped(rows, {}).count() == 30
    one = rows.filter("split = 'train'").select("ticker", "end_idx")
    orders = [[tuple(r)[:2] for r in series.epoch_order(one.repartition(n), 1, e).collect()] for n, e in ((1, 1), (5, 1), (3, 2))]
    assert orders[0] == orders[1] != orders[2]
    assert sorted(r["ordinal"] for r in series.with_ordinal(one).collect()) == list(range(10))


def test_daily_bars_do_not_depend_on_order(spark):
    t = dt.datetime(2020, 1, 1, 10)
    rows = [("a", t, 1, 5.0, 1.0), ("a", t, 2, 6.0, 1.0), ("a", t + dt.timedelta(hours=1), 1, 3.0, 2.0), ("a", t + dt.timedelta(hours=2), 1, None, 4.0), (None, t, 1, 9.0, 1.0), ("a", None, 1, 9.0, 1.0)]
    for order in (rows, rows[::-1]):
        df = spark.createDataFrame(order, "s string, at timestamp, k int, p double, v double")
        assert [tuple(r)[2:] for r in series.daily_bars(df, "s", "at", "p", "v", ("k",)).collect()] == [(5.0, 6.0, 3.0, 3.0, 8.0)]


def test_text_alignment(spark):
    day = dt.date(2022, 1, 10)
    b = spark.createDataFrame([("a", day + dt.timedelta(2 * i)) for i in range(5)] + [("b", day)], "ticker string, date date")
    news = [("a", day - dt.timedelta(1), [9.0, 9.0]), ("a", day, [1.0, 0.0]), ("a", day + dt.timedelta(4), [0.0, 3.0]), ("a", day + dt.timedelta(5), [5.0, 5.0]), ("c", day, [1.0, 1.0]), (None, day, [1.0, 1.0]), ("a", day, None)]
    out = text.window_text(b, spark.createDataFrame(news, "ticker string, date date, vec array<double>"), 2, 3)
    got = {r["end_date"]: (r["n_news"], r["text"]) for r in out.collect()}
    assert got == {day + dt.timedelta(4): (2, [0.5, 1.5]), day + dt.timedelta(6): (2, [2.5, 4.0]), day + dt.timedelta(8): (2, [2.5, 4.0])}
    empty = text.window_text(b, spark.createDataFrame([], "ticker string, date date, vec array<double>"), 2, 3)
    assert {tuple(r["text"]) for r in empty.collect()} == {(0.0, 0.0)}


def test_hashed_words(spark):
    df = spark.createDataFrame([("Rates rise",), ("rates RISE!",), ("",), (None,)], "t string").select(text.hashed_words(F.col("t"), 16).alias("v"))
    a, b, c, d = (np.array(r["v"]) for r in df.collect())
    assert (a == b).all() and abs(np.linalg.norm(a) - 1) < 1e-9 and not c.any() and not d.any()


def frame(spark, rows, name="proto_id"):
    return spark.createDataFrame(list(enumerate(rows)), f"{name} int, vec array<double>")


def test_prototype_case(spark):
    z, p = [[0.0, 0.0], [1.0, 0.0], [0.0, 2.0]], [[0.0, 0.0], [1.0, 1.0]]
    out = {r["id"]: r for r in prototypes.assign(frame(spark, z, "id"), frame(spark, p)).collect()}
    assert [out[i]["d2"] for i in range(3)] == [[0, 2], [1, 1], [4, 2]]
    assert np.allclose([out[i]["weights"][0] for i in range(3)], [0.880797, 0.5, 0.119203], atol=1e-6)
    assert np.allclose([out[i]["mix"] for i in range(3)], [[0.119203] * 2, [0.5] * 2, [0.880797] * 2], atol=1e-6)
    assert tuple(prototypes.losses(frame(spark, z), frame(spark, p), 0.5).first()) == (3, 1.0, 0.5, 0.0, 1.5)
    assert prototypes.losses(frame(spark, z), frame(spark, p), 3.0).first()["l_d"] == 1.0
    assert prototypes.losses(frame(spark, z), frame(spark, p[:1]), 3.0).first()["l_d"] == 0.0
    near = prototypes.project(frame(spark, z, "id"), frame(spark, p), ("id",)).orderBy("proto_id").collect()
    assert [tuple(r) for r in near] == [(0, 0, 0.0), (1, 1, 1.0)]
    assert [tuple(r) for r in prototypes.pairs(frame(spark, p)).collect()] == [(0, 1, 2.0)]
    none = prototypes.losses(frame(spark, z).limit(0), frame(spark, p), 0.5).first()
    assert none["n"] == 0 and none["l_c"] is None
    with pytest.raises(ValueError):
        prototypes.matrix(frame(spark, p).limit(0))
    assert prototypes.weighted_total(1.0, 1.0, 2.0, 3.0) == pytest.approx(1.33)


def test_examples_find_the_right_window(spark):
    bank = spark.createDataFrame([(w, s, [float(9 * w + s)]) for w in range(2) for s in range(9)], "window_no int, seg_no int, vec array<double>")
    protos = spark.createDataFrame([(0, [10.0]), (1, [1.0])], "proto_id int, vec array<double>")
    meta = spark.createDataFrame([(0, "A"), (1, "B")], "window_no int, ticker string")
    found = prototypes.legacy_meta(prototypes.examples(bank, protos, meta), 2).orderBy("proto_id").collect()
    assert [(r["window_no"], r["seg_no"], r["meta"]["ticker"], r["legacy_meta_window"]) for r in found] == [(1, 1, "B", None), (0, 1, "A", 1)]
    assert prototypes.bank_windows() == 576
    assert prototypes.examples(bank, protos, meta, n_examples=1).count() == 1


def test_metrics_case(spark):
    df = spark.createDataFrame([([1.0, 2.0], [1.0, 1.0]), ([3.0, 4.0], [5.0, 4.0])], "pred array<double>, y array<double>")
    assert tuple(metrics.forecast_metrics(df).first()) == (4, 1.25, 0.75)
    assert tuple(metrics.forecast_metrics(df.limit(0)).first()) == (0, None, None)
    assert tuple(metrics.epoch_loss(spark.createDataFrame([], "batch_id int, loss double")).first()) == (0, 0.0)


def loop_stop(values, patience):
    best, best_value, bad = None, math.inf, 0
    for e, v in enumerate(values, 1):
        if v < best_value:
            best, best_value, bad = e, v, 0
        else:
            bad += 1
            if bad >= max(patience, 1):
                return best, e
    return best, len(values)


@pytest.mark.parametrize(("values", "patience", "want"), [([5, 4, 4, math.nan, 3, 6, 7, 8], 3, (5, 8)), ([5, 4, 4, math.nan, 3, 6, 7, 8], 2, (2, 4))])
def test_early_stop_case(spark, values, patience, want):
    r = metrics.early_stop(spark.createDataFrame([(i, float(v)) for i, v in enumerate(values, 1)], "epoch int, val double"), patience).first()
    assert (r["best_epoch"], r["stop_epoch"]) == want == loop_stop(values, patience)


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.sampled_from([1.0, 2.0, 3.0, math.nan, math.inf]), min_size=1, max_size=12), st.integers(0, 4))
def test_early_stop_against_a_loop(spark, values, patience):
    r = metrics.early_stop(spark.createDataFrame(list(enumerate(values, 1)), "epoch int, val double"), patience).first()
    assert (r["best_epoch"], r["stop_epoch"]) == loop_stop(values, patience)


def test_vector_functions(spark):
    df = spark.createDataFrame([([1.0, 2.0], [3.0, 0.0], -1.0, ["a", "b"]), (None, [1.0], None, [])], "a array<double>, b array<double>, x double, s array<string>")
    out = df.select(vectors.squared_distance(F.col("a"), F.col("b")), vectors.add(F.col("a"), F.col("b")), vectors.relu(F.col("x")), vectors.softmax(F.col("b")), vectors.comma_list(F.col("s"))).collect()
    assert tuple(out[0])[:3] == (8.0, [4.0, 2.0], 0.0) and sum(out[0][3]) == pytest.approx(1) and out[0][4] == "a,b"
    assert tuple(out[1]) == (None, None, None, [1.0], "")


def test_constant_metrics_are_forecast_metrics(spark):
    rows = spark.createDataFrame([("a", 1.0, [1.0, 3.0]), ("a", 2.0, [2.0]), ("b", 0.5, [1.5, 0.5])], "k string, p double, y array<double>")
    want = metrics.forecast_metrics(rows.withColumn("pred", F.array_repeat("p", F.size("y"))), by=("k",)).orderBy("k").collect()
    assert metrics.constant_metrics(rows, F.col("p"), by=("k",)).orderBy("k").collect() == want
    assert tuple(metrics.constant_metrics(rows.limit(0), F.col("p")).first()) == (0, None, None)
