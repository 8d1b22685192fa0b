"""An experiment from its configuration: windows, training, tracking, test errors and explanations; sweeps over configurations."""

from __future__ import annotations

import dataclasses
import itertools
import logging
import random
import re
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tideline.operators import attention, latent, model, prototypes, series, text, training
from tideline.sources import config, files, market, tracking

log = logging.getLogger("tideline.experiment")
#: What a configuration's model section calls the sizes of Shape.
SIZES = ("d_model", "n_prototypes", "d_min", "patch_len", "patch_stride", "text_dim", "text_hidden", "head_hidden", "n_heads", "e_layers", "dropout")


def set_seed(seed: int) -> None:
    """Seed the driver's generators; weights, orders and deals take the seed as an argument."""
    random.seed(seed)
    np.random.seed(seed % (1 << 32))


def shape_of(cfg: dict[str, Any], rows: DataFrame) -> model.Shape:
    """The configured model's shape; what the windows decide (features, horizon, text size) is read off one of them."""
    section = cfg["model"]
    fields = {f.name for f in dataclasses.fields(model.build_model(section["name"]))}
    sizes = {k: section[k] for k in SIZES if section.get(k) is not None and k in fields}
    for name, own in (("text_mlp", "text_hidden"), ("head", "head_hidden")):
        if (section.get(name) or {}).get("hidden"):
            sizes[own] = section[name]["hidden"]
    cnn = {} if "lookback" in fields else section.get("cnn") or {}  # patches are embedded, not convolved
    if cnn.get("channels"):
        sizes["channels"] = tuple(cnn["channels"])
    if cnn.get("kernel_size"):
        sizes["kernel"] = cnn["kernel_size"]
    read = [F.size(F.col("x")[0]).alias("n_features"), F.size("y").alias("horizon")]
    read += [F.size("text").alias("text_dim")] if "text" in rows.columns else []
    read += [F.size("x").alias("lookback")] if "lookback" in fields else []
    one = rows.select(*read).first()
    return model.build_model(section["name"], **sizes | (one.asDict() if one else {}))


def datasets(spark: SparkSession, cfg: dict[str, Any], cache: str) -> DataFrame:
    """Windows of the configured ticker set with split, x, text (or texts, for a model that attends to them) and y, from price files and the news cache.

    ``cfg.data``: root, news_source, tickers (sets by name), features, target, lookback, horizon, train_until, val_until, and
    text_encoder: hashed (words' hashes), or latent (learnt from the news up to train_until, see ``latent``).
    """
    data, wanted = cfg["data"], cfg["data"]["tickers"][cfg["train"].get("ticker_set", "dev")]
    features = tuple(f.replace(" ", "_") for f in data["features"])
    bars = market.in_set(market.read_prices(spark, market.prices_path(spark, data["root"])), wanted).filter("date IS NOT NULL").dropDuplicates(["ticker", "date"])
    lookback, dim = data.get("lookback", series.LOOKBACK), cfg["model"].get("text_dim", 64)
    made = series.with_split(series.windows(bars, features, data.get("target", "close"), lookback, data["horizon"]), data["train_until"], data["val_until"])
    news = market.in_set(market.ingest_news(spark, market.news_path(data["root"], data["news_source"]), cache, data["news_source"]), wanted)
    vec = text.hashed_words(F.col("title"), dim)
    if data.get("text_encoder", "hashed") == "latent":
        vec = latent.encode(F.col("title"), latent.fit(news.filter(F.col("date") <= F.lit(data["train_until"])), "title", dim), spark)
    vectors = news.select("ticker", F.col("date").cast("date").alias("date"), vec.alias("vec"))
    if model.build_model(cfg["model"]["name"]).ragged_text:
        found, kind = text.window_texts(bars, vectors, dim, lookback), "texts"
    else:
        found, kind = text.window_text(bars, vectors, dim, lookback), "text"
    return made.withColumn("x", series.feature_matrix(F.col("x"), features)).join(found.select("ticker", "end_date", kind), ["ticker", "end_date"]).select("ticker", "end_idx", "end_date", "split", "x", kind, "y")


def save_projection_examples(rows: DataFrame, w: dict[str, np.ndarray], shape: model.Shape, out_dir: str, n_examples: int = 3, name: str = "a") -> str:
    """Write the first prototypes' nearest segments among the bank's first windows as JSON; the folder is returned.

    ``rows``: ticker, end_idx, end_date, x and text (or texts). Segments are those after the injection. ``name`` is the model's.
    """
    found = projection_examples(rows, w, shape, n_examples)
    path = f"{out_dir}/projection_examples_{name}.json"
    tracking.write_examples(found, path)
    return path


def bank_keys(rows: DataFrame) -> DataFrame:
    """ticker, end_idx and window_no of the bank's windows."""
    keys = rows.select("ticker", "end_idx", F.lit("train").alias("split"))
    return series.capped(keys, {"train": prototypes.bank_windows(), "val": 0, "test": 0}, rank="window_no").drop("split")


def projection_examples(rows: DataFrame, w: dict[str, np.ndarray], shape: model.Shape, n_examples: int = 3) -> DataFrame:
    """proto_id, window_no, seg_no, distance and meta of the first prototypes' nearest segments.

    The bank's windows are chosen and numbered by their keys alone, and scored once; each segment carries its window's meta.
    """
    spark = rows.sparkSession
    first = rows.join(F.broadcast(bank_keys(rows)), ["ticker", "end_idx"])  # 576 keys
    keys = ("window_no", "ticker", "end_date", "end_idx")
    bank = model.segments(model.score(first.withColumn("window_no", F.col("window_no").cast("int")), w, shape, keys, outputs=("seg_post",)), keys)
    protos = spark.createDataFrame(list(enumerate(w["prototypes"].tolist()[:n_examples])), "proto_id int, vec array<double>")
    nearest = prototypes.project(bank, protos, ("window_no", "seg_no", "ticker", "end_date", "end_idx"))
    return nearest.select("proto_id", "window_no", "seg_no", "distance", F.struct("ticker", "end_date", "end_idx").alias("meta"))


def masked_errors(least: np.ndarray, y: np.ndarray, draw: np.ndarray, passes: Callable[[np.ndarray], np.ndarray]) -> list[np.ndarray]:
    """A window's errors as it is, with its nearest segment masked and with the drawn one masked, and how far both maskings move its predictions.

    ``least`` are the segments' least distances to a prototype; ``passes`` takes two segments a window, [2, B], and returns
    the predictions [3, B, H] of the windows as they are and with each masked.
    """
    nearest, per = least.argmin(1), least.shape[1]
    pred, *other = passes(np.stack([nearest, (nearest + 1 + draw % max(1, per - 1)) % per]))
    return [((p - y) ** 2).mean(1) for p in (pred, *other)] + [np.abs(p - pred).mean(1) for p in other]


def masked_errors_of(w: dict[str, np.ndarray], shape: model.Shape, scorer: attention.Scorer | None, x: np.ndarray, text_vec: np.ndarray | attention.Ragged, y: np.ndarray, draw: np.ndarray) -> list[np.ndarray]:
    """masked_errors() of windows x [B, T, C]. ``scorer`` is that of the weights, for models that have one."""
    if scorer is not None:
        made, least = scorer.windows(x, 3)

        def rescored(segments: np.ndarray) -> np.ndarray:
            scorer.mask(x, made[1:], segments)
            return scorer.predicted(made, text_vec)

        return masked_errors(least, y, draw, rescored)
    out = model.forward(w, shape, x, text_vec)

    def passes(segments: np.ndarray) -> np.ndarray:
        at = np.arange(x.shape[1]) - segments[..., None] * shape.patch_stride
        masked = np.where(((at >= 0) & (at < shape.patch_len))[..., None], x.mean(1, keepdims=True), x)
        return np.stack([out.pred, *(model.forward(w, shape, one, text_vec).pred for one in masked)])

    return masked_errors(out.d2.min(1).reshape(out.seg_pre.shape[:2]), y, draw, passes)


def faithfulness(rows: DataFrame, w: dict[str, np.ndarray], shape: model.Shape, seed: int = 42) -> DataFrame:
    """One row: whether predictions hang on the segments that explain them; n, mse, and for two ways of masking one segment
    mse_nearest, mse_random and the mean absolute change of the predictions, shift_nearest and shift_random.

    Masked is, by the window's own feature means, the segment nearest to any prototype, or another one drawn by a hash of
    the keys; both are scored in one pass. ``rows``: ticker, end_idx, x, text (or texts), y. Explanations that are faithful change more than the draw does.
    """
    shared = rows.sparkSession.sparkContext.broadcast((w, attention.scorer(w, shape)))
    names = ("error", "error_nearest", "error_random", "shift_nearest", "shift_random")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, scorer = shared.value
        for whole in batches:
            for lo in range(0, whole.num_rows, 64):
                b = whole.slice(lo, 64)
                x, text_vec, y = model.cube(b.column(0), -1, shape.n_features), model.text_of(b.column(1), shape), model.cube(b.column(2), shape.horizon)
                values = masked_errors_of(weights, shape, scorer, x, text_vec, y, b.column(3).to_numpy())
                yield pa.RecordBatch.from_arrays([pa.array(v) for v in values], names=list(names))

    draw = F.pmod(F.xxhash64("ticker", "end_idx", F.lit(seed)), F.lit(1 << 20))
    picked = rows.select(F.col("x").cast("array<array<double>>").alias("x"), model.text_column(shape), F.col("y").cast("array<double>").alias("y"), draw.alias("draw"))
    made = picked.mapInArrow(run, ", ".join(f"{n} double" for n in names))
    return made.agg(F.count("*").alias("n"), *[F.avg(c).alias(c.replace("error", "mse")) for c in names])


def run_training(cfg: dict[str, Any], rows: DataFrame, workers: int = 8) -> dict[str, float | None]:
    """Train, keep the best weights, and return the test errors; all that a run leaves is under ``cfg.paths.output_dir``.

    ``rows``: ticker, end_idx, end_date, split, x, text (or texts), y, as datasets() makes them; they are written once, and
    everything reads that table. Written are also the state of each epoch, the weights, the tracking tables (if enabled), three
    explanations and the resolved configuration; the log names sizes, epochs and errors. With ``cfg.train.resume`` a run
    that was cut off goes on from its table and its last state.
    """
    spark, t, out = rows.sparkSession, cfg["train"], cfg["paths"]["output_dir"]
    set_seed(t["seed"])
    kept, at = series.capped(rows, {s: t.get(f"max_{s}_windows") for s in series.SPLITS}), f"{out}/training/rows"
    resume = bool(t.get("resume"))
    if not (resume and files.exists(spark, f"{at}/_SUCCESS")):
        kept.write.mode("overwrite").partitionBy("split").parquet(at)
    kept = spark.read.schema(kept.schema).parquet(at)
    sizes = {r["split"]: r["n"] for r in kept.groupBy("split").agg(F.count("*").alias("n")).collect()}
    log.info("Windows: %s", ", ".join(f"{s} {sizes.get(s, 0)}" for s in series.SPLITS))
    part = {s: kept.filter(F.col("split") == s) for s in series.SPLITS}
    shape, loss = shape_of(cfg, part["train"]), cfg["model"]["loss"]
    enabled = bool((t.get("mlflow") or {}).get("enabled"))
    with tracking.Run(spark, f"{out}/runs", cfg["experiment"]["name"], enabled) as run:
        run.log_config(cfg)

        def epoch_done(entry: dict) -> None:
            log.info("Epoch %d: %s", entry["epoch"], ", ".join(f"{k}={v:.4f}" for k, v in entry.items() if isinstance(v, float)))
            run.log_metrics({k: v for k, v in entry.items() if k in ("train_loss", "val_mse", "val_mae")}, entry["epoch"])

        fit = training.train(
            part["train"], part["val"], shape, f"{out}/training", resume=resume, epochs=t["epochs"], batch_size=t["batch_size"], rate=t["lr"], decay=t["weight_decay"], clip=t.get("grad_clip") or None,
            patience=t["patience"], eval_every=t["eval_every"], seed=t["seed"], workers=workers, lambdas=(loss["lambda_c"], loss["lambda_e"], loss["lambda_d"]), report=epoch_done,
        )
        if len(fit.history) < t["epochs"]:
            log.info("Stopped early after epoch %d", len(fit.history))
        model.save_weights(spark, fit.weights, cfg["paths"].get("checkpoint_dir") or f"{out}/checkpoints", shape)
        test = model.evaluate(part["test"], fit.weights, shape)
        log.info("Test: %s", ", ".join(f"{k}={v}" for k, v in test.items()))
        run.log_metrics({"test_mse": test["mse"], "test_mae": test["mae"]}, len(fit.history))
    log.info("Saved projection examples to %s", save_projection_examples(part["train"], fit.weights, shape, f"{out}/explain", name=cfg["model"]["name"]))
    config.save(cfg, f"{out}/config_resolved.yaml")
    return {"mse": test["mse"], "mae": test["mae"]}


def choices(overrides: tuple[str, ...]) -> list[tuple[str, ...]]:
    """The configurations of a sweep: an override with several values, separated by commas, is tried with each; the last changes first."""
    values = [[f"{key}={v}" for v in (given.split(",") if not given.startswith("[") else [given])] for key, given in (o.split("=", 1) for o in overrides)]
    return list(itertools.product(*values))


def multirun(path: str, overrides: tuple[str, ...], run: Callable[[dict[str, Any]], Any]) -> list[tuple[tuple[str, ...], Any]]:
    """``run`` on each configuration of a sweep, one after the other; results come with their overrides, in the order of choices()."""
    return [(picked, run(config.load(path, picked))) for picked in choices(overrides)]


@dataclasses.dataclass(frozen=True)
class Outcome:
    """What became of a sweep's configuration: its result, or the error that ended it."""

    overrides: tuple[str, ...]
    output_dir: str
    result: Any = None
    error: Exception | None = None


def sweep(spark: SparkSession, path: str, overrides: tuple[str, ...], run: Callable[[dict[str, Any]], Any], jobs: int = 2) -> list[Outcome]:
    """``run`` on each configuration of a sweep, ``jobs`` at a time, in the order of choices().

    Each configuration runs in a thread of its own, with a scheduler pool of its own (they share executors evenly where the session
    has spark.scheduler.mode FAIR) and a folder of its own below the configured output_dir, named by its overrides. One that
    fails leaves the others alone, and its error is its outcome.
    """
    base = config.load(path)["paths"]["output_dir"]

    def one(picked: tuple[str, ...]) -> Outcome:
        name = re.sub(r"[^A-Za-z0-9_.=,-]+", "_", ",".join(picked)) or "plain"
        out = f"{base}/{name}"
        context = spark.sparkContext
        context.setLocalProperty("spark.scheduler.pool", name)
        try:
            return Outcome(picked, out, run(config.load(path, (*picked, f"paths.output_dir={out}"))))
        except Exception as error:
            log.exception("%s failed", name)
            return Outcome(picked, out, error=error)
        finally:
            context.setLocalProperty("spark.scheduler.pool", None)

    with ThreadPoolExecutor(max(1, jobs)) as pool:
        # a wrapper each: it holds the thread's own copy of the session's properties
        return [f.result() for f in [pool.submit(inheritable_thread_target(spark)(one), picked) for picked in choices(overrides)]]
