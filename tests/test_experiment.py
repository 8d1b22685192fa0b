from __future__ import annotations

import datetime as dt
import json
import logging
import threading

import numpy as np
import yaml

from tideline import __main__ as command
from tideline.operators import experiment, model, text
from tideline.sources import config, tracking

CONFIG = {
    "data": {"news_source": "src", "features": ["open", "close", "volume"], "target": "close", "lookback": 60, "horizon": 7, "train_until": "2020-06-30", "val_until": "2020-08-15", "tickers": {"dev": ["AAPL", "MSFT"]}},
    "model": {"name": "a", "d_model": 6, "n_prototypes": 4, "d_min": 0.5, "cnn": {"channels": [4], "kernel_size": 3}, "text_dim": 5, "text_hidden": 4, "head_hidden": 6, "loss": {"lambda_c": 0.1, "lambda_e": 0.1, "lambda_d": 0.01}},
    "train": {"seed": 42, "batch_size": 16, "epochs": 2, "lr": 0.001, "weight_decay": 0.0001, "patience": 5, "eval_every": 1, "grad_clip": 1.0, "ticker_set": "dev", "max_train_windows": 100, "max_val_windows": None, "mlflow": {"enabled": True}},
    "experiment": {"name": "${model.name}_H${data.horizon}"}, "paths": {"output_dir": "", "checkpoint_dir": "${paths.output_dir}/checkpoints"},
}


def written(tmp_path):
    root = tmp_path / "data"
    prices = root / "Stock_price/full_history"
    prices.mkdir(parents=True)
    (root / "Stock_news").mkdir()
    r = np.random.default_rng(1)
    for k, name in enumerate(("AAPL", "MSFT", "OTHER")):
        days = [dt.date(2020, 1, 1) + dt.timedelta(i) for i in range(300)]
        close = 1 + 0.01 * r.normal(size=300).cumsum()
        head, row = ("date,open,high,low,close,adj close,volume", "{0},{1},{1},{1},{2},{2},{3}") if k else ("volume,close,date,open", "{3},{2},{0},{1}")
        (prices / f"{name}.csv").write_text(head + "\n" + "".join(row.format(d, c, c + 0.001, 1.0) + "\n" for d, c in zip(days, close, strict=True)))
    (root / "Stock_news/src.csv").write_text("Date,Article_title,Stock_symbol\n" + "".join(f'2020-0{m}-15,"good, news {m}",{s}\n' for m in range(1, 9) for s in ("AAPL", "OTHER")))
    cfg = CONFIG | {"data": CONFIG["data"] | {"root": str(root)}, "paths": CONFIG["paths"] | {"output_dir": str(tmp_path / "out")}}
    path = tmp_path / "config.yaml"
    path.write_text(yaml.safe_dump(cfg))
    return path


def test_training_from_a_configuration(spark, tmp_path, caplog, capsys):
    path = written(tmp_path)
    with caplog.at_level(logging.INFO, logger="tideline.experiment"):
        command.main(["train", "--config", str(path), "--cache", str(tmp_path / "cache")])
    out = tmp_path / "out"
    assert "Windows: train 100" in caplog.text and "Epoch 2" in caplog.text and "Test: " in caplog.text
    assert "'mse'" in capsys.readouterr().out
    logged = {(r["key"], r["step"]) for r in tracking.read_metrics(spark, str(out / "runs")).collect()}
    assert {("train_loss", 1), ("val_mse", 2), ("test_mae", 2)} <= logged
    assert tracking.read_params(spark, str(out / "runs")).filter("key = 'experiment.name' OR run = 'a_H7'").count() > 5
    weights = model.load_weights(spark, str(out / "checkpoints"))
    assert weights["prototypes"].shape == (4, 6)
    examples = [json.loads(x) for p in (out / "explain/projection_examples_a.json").glob("part-*") for x in p.read_text().splitlines()]
    assert [e["proto_id"] for e in sorted(examples, key=lambda e: e["proto_id"])] == [0, 1, 2] and all(e["meta"]["ticker"] in ("AAPL", "MSFT") for e in examples)
    assert yaml.safe_load((out / "config_resolved.yaml").read_text())["paths"]["checkpoint_dir"] == f"{out}/checkpoints"
    command.main(["precache", "--config", str(data_config(tmp_path, path)), "--cache", str(tmp_path / "cache")])
    assert capsys.readouterr().out.splitlines()[-2:] == ["AAPL\t8", "MSFT\t0"]


def data_config(tmp_path, path):
    data = tmp_path / "data.yaml"
    data.write_text(yaml.safe_dump(yaml.safe_load(path.read_text())["data"]))
    return data


def test_sweep(tmp_path):
    path = written(tmp_path)
    seen = experiment.multirun(str(path), ("data.horizon=7,14", "model.cnn.channels=[4, 4]", "train.seed=1,2"), lambda cfg: (cfg["experiment"]["name"], cfg["train"]["seed"], cfg["model"]["cnn"]["channels"]))
    assert [r for _, r in seen] == [(f"a_H{h}", s, [4, 4]) for h in (7, 14) for s in (1, 2)]
    assert seen[1][0] == ("data.horizon=7", "model.cnn.channels=[4, 4]", "train.seed=2")


def test_faithfulness_against_a_loop(spark):
    r = np.random.default_rng(4)
    shape = model.Shape(n_features=2, horizon=3, d_model=6, n_prototypes=4, patch_len=4, patch_stride=2, channels=(5,), text_dim=3, text_hidden=5, head_hidden=7)
    w = model.initial_weights(shape, 3)
    x, text, y = r.normal(size=(30, 12, 2)), r.normal(size=(30, 3)), r.normal(size=(30, 3))
    rows = spark.createDataFrame([("a", i, x[i].tolist(), text[i].tolist(), y[i].tolist()) for i in range(30)], "ticker string, end_idx int, x array<array<double>>, text array<double>, y array<double>")
    draws = {row["end_idx"]: row["d"] for row in rows.selectExpr("end_idx", "pmod(xxhash64(ticker, end_idx, 42), 1048576) AS d").collect()}
    want = np.zeros(5)
    for i in range(30):
        own = model.forward(w, shape, x[i : i + 1], text[i : i + 1])
        near = int(own.d2.min(1).argmin())
        preds = []
        for k in (near, (near + 1 + draws[i] % 4) % 5):
            changed = x[i].copy()
            changed[2 * k : 2 * k + 4] = x[i].mean(0)
            preds.append(model.forward(w, shape, changed[None], text[i : i + 1]).pred[0])
        want += [((own.pred[0] - y[i]) ** 2).mean(), *(((p - y[i]) ** 2).mean() for p in preds), *(np.abs(p - own.pred[0]).mean() for p in preds)]
    got = experiment.faithfulness(rows, w, shape).first()
    assert got["n"] == 30 and np.allclose([got[c] for c in ("mse", "mse_nearest", "mse_random", "shift_nearest", "shift_random")], want / 30)
    assert experiment.faithfulness(rows.limit(0), w, shape).first()["n"] == 0


def test_concurrent_sweep(spark, tmp_path):
    """Two configurations overlap, a third fails by itself; each has its own folder and pool."""
    path, together, pools = written(tmp_path), threading.Barrier(2, timeout=60), {}

    def run(cfg):
        seed = cfg["train"]["seed"]
        if seed == 3:
            raise ValueError("seed 3")
        together.wait()
        pools[seed] = spark.sparkContext.getLocalProperty("spark.scheduler.pool")
        n = spark.range(100, numPartitions=4).selectExpr(f"sum(id * {seed})").first()[0]
        spark.range(1).write.parquet(f"{cfg['paths']['output_dir']}/x")
        return n, cfg["paths"]["checkpoint_dir"]

    got = experiment.sweep(spark, str(path), ("train.seed=1,2,3",), run, jobs=3)
    base = tmp_path / "out"
    assert [o.overrides for o in got] == [("train.seed=1",), ("train.seed=2",), ("train.seed=3",)]
    assert [o.result for o in got[:2]] == [(4950 * s, f"{base}/train.seed={s}/checkpoints") for s in (1, 2)]
    assert isinstance(got[2].error, ValueError) and got[2].result is None and got[0].error is None
    assert pools == {1: "train.seed=1", 2: "train.seed=2"} and (base / "train.seed=1/x/_SUCCESS").exists()


def test_sweep_of_models_and_a_resumed_run(spark, tmp_path, caplog):
    """Every model trains from the configuration, two at a time; a run that is asked to resume goes on from its state."""
    path = written(tmp_path)
    cfg = yaml.safe_load(path.read_text())
    cfg["model"] |= {"n_heads": 2, "e_layers": 1, "dropout": 0.1}
    cfg["train"] |= {"max_train_windows": 40, "max_test_windows": 40}
    path.write_text(yaml.safe_dump(cfg))
    run = lambda cfg: experiment.run_training(cfg, experiment.datasets(spark, cfg, str(tmp_path / "cache")), workers=2)
    got = experiment.sweep(spark, str(path), ("model.name=b,c0,c1",), run, jobs=2)
    assert [o.error for o in got] == [None] * 3 and all(np.isfinite(o.result["mse"]) for o in got)
    assert all(len(list((tmp_path / f"out/model.name={n}/explain").iterdir())) == 1 for n in ("b", "c0", "c1"))
    out = f"paths.output_dir={got[2].output_dir}"
    longer = config.load(str(path), ("model.name=c1", out, "train.resume=true", "train.epochs=3"))
    with caplog.at_level(logging.INFO, logger="tideline.experiment"):
        experiment.run_training(longer, experiment.datasets(spark, longer, str(tmp_path / "cache")), workers=2)
    assert [r.getMessage()[:7] for r in caplog.records if r.getMessage().startswith("Epoch")] == ["Epoch 3"]


def test_texts_of_a_window_against_a_loop(spark):
    r = np.random.default_rng(5)
    day = lambda k: dt.date(2020, 1, 1) + dt.timedelta(int(k))
    bars = [("a", day(k)) for k in sorted(r.choice(60, 30, replace=False))] + [("b", day(3))]
    news = [(t, day(r.integers(-3, 64)), [float(x) for x in r.integers(0, 5, 2)]) for t in ("a", "b", "c") for _ in range(50)] + [(None, day(1), [1.0, 1.0]), ("a", None, [1.0, 1.0]), ("a", day(1), None)]
    got = text.window_texts(spark.createDataFrame(bars, "ticker string, date date"), spark.createDataFrame(news, "ticker string, date date, vec array<double>"), 2, 4).collect()
    dates = [d for t, d in bars if t == "a"]
    assert len(got) == len(dates) - 3
    for row in got:
        k = dates.index(row["end_date"])
        want = {}
        for t, d, v in news:
            if t == "a" and v and d and dates[k - 3] <= d <= dates[k]:
                want.setdefault(d, []).append(v)
        assert row["text_dates"] == sorted(want)
        assert np.allclose(np.array(row["texts"]).reshape(-1, 2), np.array([np.mean(want[d], 0) for d in sorted(want)]).reshape(-1, 2))
