"""Data-parallel training in rounds, with sums of weights along a tree of tasks and a state to resume from.

Windows are dealt to workers by a hash of their keys; in a round, one Spark job, every worker is a task of its own and
trains on its own windows, mini-batch by mini-batch, from the common weights. What the workers end with is added up by
tasks of ``fan_in`` workers each, level by level, so the driver gets one set of weights however many workers there are.
After each epoch the driver's state is written under the epoch's number; a state counts once its files are committed.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from dataclasses import asdict, dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tideline.operators import model
from tideline.sources.files import children, exists, remove

SUMS = "kind string, name string, value array<double>, loss double, batches long, most long, part int"
STATE = "kind string, name string, size array<int>, value array<double>, note string"


@dataclass
class Fit:
    weights: dict[str, np.ndarray]
    history: list[dict]
    best_epoch: int | None


@dataclass
class State:
    """What the driver holds between epochs: model-sized, and the history."""

    weights: dict[str, np.ndarray]
    optimiser: model.AdamW
    kept: dict[str, np.ndarray]
    history: list[dict]
    best: int | None = None
    best_mse: float = float("inf")
    bad: int = 0
    stopped: bool = False

    @property
    def epoch(self) -> int:
        return self.history[-1]["epoch"] if self.history else 0


def copied(d: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    return {k: v.copy() for k, v in d.items()}


def slots(spark: SparkSession, n: int) -> list[int]:
    """For each of n workers a number that hash partitioning into n partitions sends to a partition of its own."""
    numbers = spark.range(40 * n + 200).select(F.col("id").cast("int").alias("id"))
    found = numbers.groupBy(F.pmod(F.hash("id"), F.lit(n)).alias("at")).agg(F.min("id").alias("id")).collect()
    return [r["id"] for r in sorted(found)]


def rows_of(sums: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.string(), pa.string(), pa.list_(pa.float64()), pa.float64(), pa.int64(), pa.int64(), pa.int32())
    columns = list(zip(*sums, strict=True)) or [()] * len(kinds)
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=[x.split()[0] for x in SUMS.split(", ")])


def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The sums of the rows of each kind and name, which stand together; one of them is held at a time."""
    held: list | None = None
    for b in batches:
        values = b.column(2)
        for k, (kind, name, loss, n, most, part) in enumerate(zip(*(b.column(c).to_pylist() for c in (0, 1, 3, 4, 5, 6)), strict=True)):
            value = values[k].values.to_numpy()
            if held and held[:2] == [kind, name]:
                held = [kind, name, held[2] + value, held[3] + loss, held[4] + n, max(held[5], most), min(held[6], part)]
                continue
            if held:
                yield rows_of([tuple(held)])
            held = [kind, name, value, loss, n, most, part]
    if held:
        yield rows_of([tuple(held)])


def summed(made: DataFrame, workers: int, fan_in: int) -> DataFrame:
    """One row a kind and name: values, losses and mini-batches of all workers added in the order of their numbers."""
    level = 1
    while workers > 1:
        workers, level = -(-workers // fan_in), level * fan_in
        made = made.repartition(workers, F.floor(F.col("part") / level)).sortWithinPartitions("kind", "name", "part").mapInArrow(added, SUMS)
    return made


def save_state(spark: SparkSession, path: str, state: State, settings: str) -> None:
    """Write the state of an epoch, then drop all but the last two. Files that weren't committed are written over."""
    parts = (("w", state.weights), ("m", state.optimiser.first), ("v", state.optimiser.second), ("k", state.kept))
    rows = [(kind, name, list(v.shape), v.ravel().tolist(), None) for kind, d in parts for name, v in d.items()]
    rest = {"history": state.history, "best": state.best, "best_mse": state.best_mse, "bad": state.bad, "stopped": state.stopped, "steps": state.optimiser.steps, "settings": settings}
    spark.createDataFrame([*rows, ("note", "", None, None, json.dumps(rest))], STATE).coalesce(1).write.mode("overwrite").parquet(f"{path}/epoch-{state.epoch:06d}")
    for old in committed(spark, path)[:-2]:
        remove(spark, f"{path}/{old}")


def committed(spark: SparkSession, path: str) -> list[str]:
    """The names of the committed states, the oldest first."""
    return sorted(n for n in children(spark, path) if n.startswith("epoch-") and exists(spark, f"{path}/{n}/_SUCCESS"))


def load_state(spark: SparkSession, path: str, optimiser: model.AdamW, settings: str) -> State | None:
    """The last committed state, or None; ValueError if it was made with other settings."""
    names = committed(spark, path)
    if not names:
        return None
    rows = spark.read.schema(STATE).parquet(f"{path}/{names[-1]}").collect()  # model-sized
    rest = json.loads(next(r["note"] for r in rows if r["kind"] == "note"))
    if rest["settings"] != settings:
        raise ValueError(f"{path} belongs to a run with other settings")
    of = lambda kind: {r["name"]: np.array(r["value"]).reshape(r["size"]) for r in rows if r["kind"] == kind}
    optimiser.first, optimiser.second, optimiser.steps = of("m"), of("v"), rest["steps"]
    return State(of("w"), optimiser, of("k"), rest["history"], rest["best"], rest["best_mse"], rest["bad"], rest["stopped"])


def train(
    training: DataFrame, validation: DataFrame, shape: model.Shape, path: str, *, epochs: int = 20, batch_size: int = 32, rate: float = 1e-3, decay: float = 1e-4, clip: float | None = 1.0,
    patience: int = 5, eval_every: int = 1, seed: int = 42, batches_per_step: int | None = None, workers: int = 8, lambdas: tuple[float, float, float] = (0.1, 0.1, 0.01),
    report: Callable[[dict], None] | None = None, resume: bool = False, fan_in: int = 16,
) -> Fit:
    """Weights of the epoch with the least validation mse (the last ones if none was a number).

    A round is a job: each of ``workers`` takes ``batches_per_step`` mini-batches or, with None, all its windows of the
    epoch, and weights, moments and running statistics are averaged, a worker counting as its mini-batches. Which windows
    a worker and a round have, in which order, and what is dropped out, follows from hashes of keys, seed and epoch, so the
    result doesn't depend on partitions; it does depend on ``workers``. ``path`` is a folder that all executors share;
    training and validation windows are written there once. ``report`` is called with each epoch's entry of the history.
    With ``resume`` the run goes on after the last epoch whose state is committed under ``path``, on the windows written
    then, and ends with the weights of an unbroken run; without such a state it begins.
    """
    spark = training.sparkSession
    settings = json.dumps([batch_size, rate, decay, clip, patience, eval_every, seed, batches_per_step, workers, lambdas, {k: str(v) for k, v in asdict(shape).items()}])
    hashed = lambda what: F.xxhash64("ticker", "end_idx", F.lit(f"{what} {seed}"))
    text = model.text_column(shape)
    place = slots(spark, workers)
    number = F.pmod(hashed("worker"), F.lit(workers)).cast("int")
    dealt = training.select("ticker", "end_idx", F.col("x").cast("array<array<double>>").alias("x"), text, F.col("y").cast("array<double>").alias("y"), number.alias("worker"))
    checked = validation.select(F.col("x").cast("array<array<double>>").alias("x"), text.alias("texts" if shape.ragged_text else "text"), F.col("y").cast("array<double>").alias("y"))

    state = load_state(spark, f"{path}/state", model.AdamW(rate, decay, clip), settings) if resume else None
    if state is None:
        remove(spark, f"{path}/state")
        dealt.write.mode("overwrite").parquet(f"{path}/windows")
        checked.write.mode("overwrite").parquet(f"{path}/validation")
        w = model.initial_weights(shape, seed)
        state = State(w, model.AdamW(rate, decay, clip), copied(w), [])
    rows = spark.read.schema(dealt.schema).parquet(f"{path}/windows").withColumn("slot", F.element_at(F.array(*[F.lit(x) for x in place]), F.col("worker") + 1))
    checked = spark.read.schema(checked.schema).parquet(f"{path}/validation")
    n = rows.count()
    if n == 0:
        raise ValueError("there are no training windows")
    rounds = max(1, round(n / (batch_size * batches_per_step * workers))) if batches_per_step else 1

    def work(shared, epoch: int, turn: int):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            worker, held = None, []
            state: tuple = ()

            def step(some: list[pa.RecordBatch]) -> None:
                t = pa.Table.from_batches(some).combine_chunks()
                x = model.cube(t["x"].chunk(0), -1, shape.n_features)
                draw = np.random.default_rng([seed, epoch, turn, worker, len(state[2])])
                parts, g, out = model.loss_and_gradients(state[0], shape, x, model.text_of(t["text"].chunk(0), shape), model.cube(t["y"].chunk(0), shape.horizon), lambdas, draw)
                state[1].step(state[0], g)
                m = x.shape[0] * x.shape[1]
                for i in range(len(shape.channels)):
                    state[0][f"norm{i}.mean"] += 0.1 * (out.kept[i][5] - state[0][f"norm{i}.mean"])
                    state[0][f"norm{i}.var"] += 0.1 * (out.kept[i][6] * m / max(1, m - 1) - state[0][f"norm{i}.var"])
                state[2].append(parts["loss"])

            def done() -> pa.RecordBatch:
                if held:
                    step(held)
                    held.clear()
                count = len(state[2])
                made = [(kind, name, v.ravel() * count) for kind, d in (("w", state[0]), ("m", state[1].first), ("v", state[1].second)) for name, v in d.items()]
                return rows_of([(*x, float(sum(state[2])), count, count, worker) for x in made])

            for whole in batches:
                number = whole.column(3).to_numpy()
                at = 0
                while at < len(number):
                    if number[at] != worker:
                        if worker is not None:
                            yield done()
                        worker = int(number[at])
                        w, optimiser = shared.value
                        state = (copied(w), model.AdamW(optimiser.rate, optimiser.decay, optimiser.clip), [])
                        state[1].steps, state[1].first, state[1].second = optimiser.steps, copied(optimiser.first), copied(optimiser.second)
                    same = int(np.searchsorted(number, worker, "right"))
                    room = batch_size - sum(b.num_rows for b in held)
                    take = min(room, same - at)
                    held.append(whole.slice(at, take))
                    at += take
                    if take == room:
                        step(held)
                        held.clear()
            if worker is not None:
                yield done()

        return run

    for epoch in range(state.epoch + 1, epochs + 1):
        if state.stopped:
            break
        loss = batches = 0.0
        ordered = rows.withColumn("at", hashed(f"order {epoch}")).withColumn("round", F.pmod(hashed(f"round {epoch}"), F.lit(rounds)))
        for turn in range(rounds):
            part = ordered.filter(F.col("round") == turn).repartition(workers, "slot").sortWithinPartitions("worker", "at", "ticker", "end_idx").select("x", "text", "y", "worker")
            shared = spark.sparkContext.broadcast((state.weights, state.optimiser))
            made = summed(part.mapInArrow(work(shared, epoch, turn), SUMS), workers, fan_in).collect()  # three rows a weight
            shared.unpersist()
            if not made:
                continue
            mean = {(r["kind"], r["name"]): np.array(r["value"]).reshape(state.weights[r["name"]].shape) / r["batches"] for r in made}
            one = next(r for r in made if (r["kind"], r["name"]) == ("w", "prototypes"))
            loss, batches = loss + one["loss"], batches + one["batches"]
            state.optimiser.steps += one["most"]
            names = [k for k in state.weights if model.trained(k)]
            state.optimiser.first, state.optimiser.second = {k: mean["m", k] for k in names}, {k: mean["v", k] for k in names}
            state.weights = {k: mean["w", k] for k in state.weights}
        state.history.append({"epoch": epoch, "train_loss": loss / max(batches, 1)})
        if epoch % eval_every == 0:
            state.history[-1] |= {f"val_{k}": v for k, v in model.evaluate(checked, state.weights, shape).items()}
            mse = state.history[-1]["val_mse"]
            if mse is not None and mse < state.best_mse:
                state.best, state.best_mse, state.bad = epoch, mse, 0
                state.kept = copied(state.weights)
            else:
                state.bad += 1
                state.stopped = state.bad >= max(patience, 1)
        save_state(spark, f"{path}/state", state, settings)
        if report:
            report(state.history[-1])
    return Fit(state.kept if state.best else state.weights, state.history, state.best)
