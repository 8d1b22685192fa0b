"""Models scored on all windows of whole series, in one pass over the days of bars and news (see ``walk``)."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tideline.operators import attention, experiment, model, walk
from tideline.operators.prototypes import nested

CHUNK = 24  # what a layer makes of so many windows stays in the processor's cache
MASKED = 32  # so many windows' three passes go through a layer together
Models = dict[str, tuple[model.Shape, dict[str, np.ndarray]]]


def text_of(block: walk.Block, shape: model.Shape) -> np.ndarray | attention.Ragged:
    if not shape.ragged_text:
        return block.text()
    _, counts, vectors = block.texts()
    return attention.Ragged(vectors, counts)


def in_chunks(block: walk.Block, run: Callable[[walk.Block], np.ndarray]) -> np.ndarray:
    return np.concatenate([run(block.part(lo, min(lo + CHUNK, len(block)))) for lo in range(0, len(block), CHUNK)])


def predicted(block: walk.Block, shape: model.Shape, w: dict[str, np.ndarray]) -> np.ndarray:
    """The predictions [B, H] of a block's windows."""
    if model.slides(shape, block.lookback):
        return model.sliding_forward(w, shape, block.values[: len(block) + block.lookback - 1], block.lookback, block.text())[0]
    return in_chunks(block, lambda b: model.forward(w, shape, b.x, text_of(b, shape)).pred)


def repeated(value: object, n: int, kind: pa.DataType | None = None) -> pa.Array:
    return pa.repeat(value if kind is None else pa.scalar(value, kind), n)


def score(bars: DataFrame, news: DataFrame, shape: model.Shape, w: dict[str, np.ndarray], bounds: tuple[str, str], **windows) -> DataFrame:
    """ticker, end_idx, pred and n_segments of each window; ``windows`` are arguments of walk.map_windows()."""
    shared = bars.sparkSession.sparkContext.broadcast(w)

    def run(b: walk.Block) -> pa.RecordBatch:
        segments = (b.lookback - shape.patch_len) // shape.patch_stride + 1
        columns = [repeated(b.ticker, len(b)), pa.array(b.end_idx), nested(predicted(b, shape, shared.value)), repeated(segments, len(b), pa.int32())]
        return pa.RecordBatch.from_arrays(columns, names=["ticker", "end_idx", "pred", "n_segments"])

    kind = bars.schema["ticker"].dataType.simpleString()
    return walk.map_windows(bars, news, shape.text_dim, run, f"ticker {kind}, end_idx int, pred array<double>, n_segments int", bounds, horizon=shape.horizon, **windows)


def evaluate(bars: DataFrame, news: DataFrame, models: Models, bounds: tuple[str, str], **windows) -> DataFrame:
    """model, split, n, mse and mae of all models, in one pass over the windows. Targets that are null don't count."""
    shared = bars.sparkSession.sparkContext.broadcast(models)
    sizes = next(iter(models.values()))[0]

    def run(b: walk.Block) -> pa.RecordBatch:
        made, known = [], ~np.isnan(b.y)
        for name, (shape, w) in shared.value.items():
            error = (predicted(b, shape, w) - b.y)[known]
            made.append((name, b.split, int(known.sum()), float((error**2).sum()), float(np.abs(error).sum())))
        kinds = (pa.string(), pa.string(), pa.int64(), pa.float64(), pa.float64())
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*made, strict=True), kinds, strict=True)], names=["model", "split", "n", "squares", "absolutes"])

    sums = walk.map_windows(bars, news, sizes.text_dim, run, "model string, split string, n long, squares double, absolutes double", bounds, horizon=sizes.horizon, **windows)
    n = F.sum("n")
    return sums.groupBy("model", "split").agg(n.alias("n"), (F.sum("squares") / n).alias("mse"), (F.sum("absolutes") / n).alias("mae"))


def attention_weights(bars: DataFrame, news: DataFrame, shape: model.Shape, w: dict[str, np.ndarray], bounds: tuple[str, str], **windows) -> DataFrame:
    """ticker, end_idx, text_dates and attention: each window's days with news and their weights in the model's last layer.

    For models that attend to texts only. Windows without news have empty arrays, and nothing is computed for them.
    """
    if not shape.ragged_text:
        raise ValueError("this model doesn't attend to texts")
    shared = bars.sparkSession.sparkContext.broadcast(w)

    def run(b: walk.Block) -> pa.RecordBatch:
        dates, counts, vectors = b.texts()
        some, x, first = np.flatnonzero(counts), b.x, np.append(0, np.cumsum(counts))
        weights = [np.empty(0)]
        for lo in range(0, len(some), CHUNK):
            at = some[lo : lo + CHUNK]
            sets = attention.Ragged(vectors[first[at[0]] : first[at[-1] + 1]], counts[at])  # windows between have none
            weights.append(attention.forward(shared.value, shape, x[at], sets, until_attention=True).kept["attention"])
        offsets = pa.array(first, pa.int32())
        lists = [pa.ListArray.from_arrays(offsets, v) for v in (pa.array(dates, pa.int32()).cast(pa.date32()), pa.array(np.concatenate(weights)))]
        return pa.RecordBatch.from_arrays([repeated(b.ticker, len(b)), pa.array(b.end_idx), *lists], names=["ticker", "end_idx", "text_dates", "attention"])

    kind = bars.schema["ticker"].dataType.simpleString()
    return walk.map_windows(bars, news, shape.text_dim, run, f"ticker {kind}, end_idx int, text_dates array<date>, attention array<double>", bounds, horizon=shape.horizon, **windows)


def faithfulness(bars: DataFrame, news: DataFrame, models: Models, bounds: tuple[str, str], seed: int = 42, **windows) -> DataFrame:
    """A row a model: what experiment.faithfulness() returns, of all models in one pass over the windows. Null targets count as 0."""
    shared = bars.sparkSession.sparkContext.broadcast({name: (shape, w, attention.scorer(w, shape)) for name, (shape, w) in models.items()})
    sizes = next(iter(models.values()))[0]
    names = ("error", "error_nearest", "error_random", "shift_nearest", "shift_random")

    def run(blocks: list[walk.Block]) -> pa.RecordBatch:
        values, first = walk.stacked(blocks)
        y, draw = np.nan_to_num(np.concatenate([b.y for b in blocks])), np.concatenate([b.draw for b in blocks])
        columns: list[list[np.ndarray]] = []
        for shape, w, scorer in shared.value.values():
            texts = [text_of(b, shape) for b in blocks]
            if shape.ragged_text:
                text = attention.Ragged(np.concatenate([t.flat for t in texts]), np.concatenate([t.counts for t in texts]))
            else:
                text = np.concatenate(texts)
            if model.slides(shape, blocks[0].lookback):
                whole = model.Sliding(w, shape, values, blocks[0].lookback, text, first)
                made = [experiment.masked_errors(whole.least, y, draw, lambda segments, whole=whole: np.concatenate([whole.pred[None], whole.masked(segments)]))]
            else:
                x = np.lib.stride_tricks.sliding_window_view(values, blocks[0].lookback, 0)
                made = []
                for lo in range(0, len(y), MASKED):
                    at = slice(lo, lo + MASKED)
                    made.append(experiment.masked_errors_of(w, shape, scorer, x[first[at]].transpose(0, 2, 1), text[at], y[at], draw[at]))
            columns.append([np.concatenate(v) for v in zip(*made, strict=True)])
        models = pa.concat_arrays([repeated(name, len(y), pa.string()) for name in shared.value])
        return pa.RecordBatch.from_arrays([models, *[pa.array(np.concatenate(c)) for c in zip(*columns, strict=True)]], names=["model", *names])

    draw = F.pmod(F.xxhash64("ticker", "end_idx", F.lit(seed)), F.lit(1 << 20))
    made = walk.map_windows(bars, news, sizes.text_dim, run, "model string, " + ", ".join(f"{n} double" for n in names), bounds, horizon=sizes.horizon, draw=draw, together=4 * walk.BLOCK, **windows)
    return made.groupBy("model").agg(F.count("*").alias("n"), *[F.avg(c).alias(c.replace("error", "mse")) for c in names])
