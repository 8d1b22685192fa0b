"""Forecast model a: a convolutional segment encoder, prototypes, residual injection and late text fusion, in numpy. Models
b, c0 and c1 (attention.py) are scored and trained by the same functions.

Scoring is a projection over Arrow batches with the weights broadcast. Training (training.py) is data-parallel; one worker
is the plain sequential loop.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import asdict, dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tideline.operators.metrics import forecast_metrics
from tideline.operators.prototypes import diversity_loss, nested, pairwise, soft_weights, weighted_total

EPSILON = 1e-5


@dataclass(frozen=True)
class Shape:
    """The protocol's sizes."""

    n_features: int = 5
    horizon: int = 7
    d_model: int = 64
    n_prototypes: int = 10
    d_min: float = 0.5
    patch_len: int = 12
    patch_stride: int = 6
    channels: tuple[int, ...] = (32, 64, 64)
    kernel: int = 3
    text_dim: int = 64
    text_hidden: int = 64
    head_hidden: int = 128


    @property
    def ragged_text(self) -> bool:
        """Whether a window has several text vectors (column ``texts``) instead of one (column ``text``)."""
        return False


def build_model(name: str = "a", **sizes) -> Shape:
    """The model's shape by name: a, b, c0 or c1."""
    models = {"a": Shape, **attention.shapes()}
    if name not in models:
        raise ValueError(f"model {name!r} isn't defined; there is {', '.join(models)}")
    return models[name](**sizes)


def initial_weights(shape: Shape, seed: int = 42) -> dict[str, np.ndarray]:
    """Weights uniform within 1 / sqrt(fan in), prototypes normal with deviation 0.02, batch norms at identity."""
    if isinstance(shape, attention.PatchShape):
        return attention.initial_weights(shape, seed)
    r = np.random.default_rng(seed)
    w: dict[str, np.ndarray] = {}

    def layer(name: str, fan_in: int, fan_out: int) -> None:
        bound = fan_in**-0.5
        w[f"{name}.w"], w[f"{name}.b"] = r.uniform(-bound, bound, (fan_in, fan_out)), r.uniform(-bound, bound, fan_out)

    c = shape.n_features
    for i, out in enumerate(shape.channels):
        layer(f"conv{i}", c * shape.kernel, out)
        w |= {f"norm{i}.gain": np.ones(out), f"norm{i}.shift": np.zeros(out), f"norm{i}.mean": np.zeros(out), f"norm{i}.var": np.ones(out)}
        c = out
    layer("patch", c * shape.patch_len, shape.d_model)
    w["prototypes"] = r.normal(size=(shape.n_prototypes, shape.d_model)) * 0.02
    layer("inject", shape.d_model, shape.d_model)
    layer("text0", shape.text_dim, shape.text_hidden)
    layer("text1", shape.text_hidden, shape.d_model)
    layer("head0", 2 * shape.d_model, shape.head_hidden)
    layer("head1", shape.head_hidden, shape.horizon)
    return w


def trained(name: str) -> bool:
    return not name.endswith((".mean", ".var"))


def spans(x: np.ndarray, width: int, stride: int) -> np.ndarray:
    """[B, S, C * width]: the strided spans of [B, T, C], channel by channel."""
    view = np.lib.stride_tricks.sliding_window_view(x, width, axis=1)[:, ::stride]
    return view.reshape(*view.shape[:2], -1)


def spans_back(d: np.ndarray, shape: tuple[int, ...], width: int, stride: int) -> np.ndarray:
    """The gradient of spans()."""
    out = np.zeros(shape)
    d = d.reshape(*d.shape[:2], shape[2], width)
    for k in range(width):
        out[:, k : k + stride * (d.shape[1] - 1) + 1 : stride] += d[..., k]
    return out


@dataclass
class Pass:
    """What one forward pass made; ``kept`` is for the backward pass."""

    pred: np.ndarray
    seg_pre: np.ndarray
    seg_post: np.ndarray
    d2: np.ndarray
    kept: dict = field(default_factory=dict)


def forward(w: dict[str, np.ndarray], shape: Shape, x: np.ndarray, text: np.ndarray, training: bool = False) -> Pass:
    """Scores of windows x [B, T, C] and text [B, E]. Batch norms take running statistics, or the batch's in training."""
    if isinstance(shape, attention.PatchShape):
        return attention.forward(w, shape, x, text, training)
    k: dict = {}
    h, half = x, shape.kernel // 2
    for i in range(len(shape.channels)):
        cols = spans(np.pad(h, ((0, 0), (half, half), (0, 0))), shape.kernel, 1)
        z = flat(cols, w[f"conv{i}.w"])
        z += w[f"conv{i}.b"]
        a = np.maximum(z, 0)
        mean, var = (a.mean((0, 1)), a.var((0, 1))) if training else (w[f"norm{i}.mean"], w[f"norm{i}.var"])
        scale = 1 / np.sqrt(var + EPSILON)
        hat = (a - mean) * scale
        k[i] = (h.shape, cols, z, hat, scale, mean, var)
        h = hat * w[f"norm{i}.gain"] + w[f"norm{i}.shift"]
    cols = spans(h, shape.patch_len, shape.patch_stride)
    seg = flat(cols, w["patch.w"]) + w["patch.b"]
    d2 = pairwise(seg.reshape(-1, shape.d_model), w["prototypes"])
    soft = soft_weights(d2)
    mix = (soft @ w["prototypes"]).reshape(seg.shape)
    post = seg + flat(mix, w["inject.w"]) + w["inject.b"]
    t0 = text @ w["text0.w"] + w["text0.b"]
    fused = np.concatenate([post.mean(1), np.maximum(t0, 0) @ w["text1.w"] + w["text1.b"]], 1)
    h0 = fused @ w["head0.w"] + w["head0.b"]
    pred = np.maximum(h0, 0) @ w["head1.w"] + w["head1.b"]
    k |= {"h": h.shape, "cols": cols, "soft": soft, "mix": mix, "text": text, "t0": t0, "fused": fused, "h0": h0}
    return Pass(pred, seg, post, d2, k)


def flat(x: np.ndarray, w: np.ndarray) -> np.ndarray:
    """x @ w as one product of matrices, whatever x's leading axes."""
    return (x.reshape(-1, x.shape[-1]) @ w).reshape(*x.shape[:-1], w.shape[1])


def slides(shape: Shape, lookback: int) -> bool:
    """Whether sliding_forward() takes windows of this length: the padding's reach from both ends must leave days between."""
    return not isinstance(shape, attention.PatchShape) and shape.kernel % 2 == 1 and lookback > 2 * (shape.kernel // 2) * len(shape.channels)


class Taps:
    """A convolution's products with the rows of series and with what windows have of their own.

    ``common`` are rows as if series had no ends, ``first`` each window's first among them; ``own`` are by place in the
    window the values [B, C] that padding has reached; ``kernel`` is [C, width, D].
    """

    def __init__(self, common: np.ndarray, own: dict[int, np.ndarray], kernel: np.ndarray, first: np.ndarray, lookback: int) -> None:
        self.own, self.kernel, self.first, self.lookback, self.width = own, kernel, first, lookback, kernel.shape[1]
        self.made = [common @ kernel[:, k] for k in range(self.width)]
        self.kept: dict[tuple, np.ndarray] = {}

    def product(self, place: int, k: int, at: np.ndarray | slice) -> np.ndarray:
        """[N, D]: the row at a place of the windows ``at`` with a tap."""
        if place not in self.own:
            return self.made[k][self.first[at] + place]
        if (place, k) not in self.kept:
            self.kept[place, k] = self.own[place] @ self.kernel[:, k]
        return self.kept[place, k][at]

    def joined(self, lo: int, hi: int) -> np.ndarray:
        """Of each row that a span may begin at, the sum of the products of the taps lo to hi - 1."""
        if ("joined", lo, hi) not in self.kept:
            n = len(self.made[0]) - self.width + 1
            out = self.made[lo][lo : lo + n].copy()
            for k in range(lo + 1, hi):
                out += self.made[k][k : k + n]
            self.kept["joined", lo, hi] = out
        return self.kept["joined", lo, hi]

    def at(self, start: int, lo: int, hi: int, at: np.ndarray | slice = slice(None)) -> np.ndarray | None:
        """[N, D]: the sum over the taps lo to hi - 1 of a span that begins at a place; beyond the window are zeros, and of nothing else comes None."""
        places = [p for p in range(start + lo, start + hi) if 0 <= p < self.lookback]
        if len(places) > 1 and start >= 0 and start + self.width <= self.lookback and not any(p in self.own for p in places):
            return self.joined(lo, hi)[self.first[at] + start]
        out = None
        for p in places:
            out = self.product(p, p - start, at) if out is None else out + self.product(p, p - start, at)
        return out

    def stacked(self, lo: int, runs: tuple[int, ...]) -> np.ndarray:
        """[len(runs) * C, D]: taps from lo on, those of a run added up as they meet one value."""
        if ("stacked", lo, runs) not in self.kept:
            edges = np.cumsum((lo, *runs))
            self.kept["stacked", lo, runs] = np.concatenate([self.kernel[:, a:b].sum(1) for a, b in zip(edges, edges[1:], strict=False)])
        return self.kept["stacked", lo, runs]

    def changed(self, begin: int, values: np.ndarray, which: dict[int, int], at: np.ndarray, out: np.ndarray) -> None:
        """Into ``out`` [N, D]: the span that begins at a place, of the windows ``at`` with other ``values`` [N, ., C] at the places of ``which``, by their numbers."""
        lo, runs, number = self.met(begin, which)
        np.matmul(values[:, number : number + len(runs)].reshape(len(at), -1), self.stacked(lo, runs), out=out)
        for a, b in ((0, lo), (lo + sum(runs), self.width)):
            old = self.at(begin, a, b, at)
            if old is not None:
                out += old

    def met(self, begin: int, which: dict[int, int]) -> tuple[int, tuple[int, ...], int]:
        """The first tap that meets a changed place, how many taps each changed value meets, and the first such value."""
        met = [(k, which[begin + k]) for k in range(self.width) if begin + k in which]
        numbers = [v for _, v in met]
        return met[0][0], tuple(numbers.count(v) for v in dict.fromkeys(numbers)), numbers[0]


class Sliding:
    """Model a's pass over the windows of ``lookback`` rows that begin at the rows ``first`` [B] (0 to B - 1, if not given) of values [N, C].

    As forward() on each of them. Neighbouring windows share all rows but one, so what doesn't meet a window's padding, the
    convolutions of its inner rows and the patches of these, is computed once a row; only the ends, as far as the padding
    reaches, are computed for each window. ``values`` can be several series, one after the other. ``pred`` [B, H] are the
    predictions, ``least`` [B, S] the segments' least squared distances to a prototype.
    """

    def __init__(self, w: dict[str, np.ndarray], shape: Shape, values: np.ndarray, lookback: int, text: np.ndarray, first: np.ndarray | None = None) -> None:
        half, width = shape.kernel // 2, shape.patch_len
        self.w, self.shape, self.values, self.lookback = w, shape, values, lookback
        self.first = np.arange(len(text)) if first is None else first
        common = values  # the outer rows, as far as padding reaches, are of no use
        own: dict[int, np.ndarray] = {}
        self.layers: list[Taps] = []
        self.norms = []
        for i in range(len(shape.channels)):
            scale = w[f"norm{i}.gain"] / np.sqrt(w[f"norm{i}.var"] + EPSILON)
            self.norms.append((w[f"conv{i}.b"], scale, w[f"norm{i}.shift"] - w[f"norm{i}.mean"] * scale))
            taps = Taps(common, own, w[f"conv{i}.w"].reshape(common.shape[1], shape.kernel, -1), self.first, lookback)
            reach = half * (i + 1)
            ends = {p: self.activated(taps.at(p - half, 0, shape.kernel), i) for p in (*range(reach), *range(lookback - reach, lookback))}
            inner = self.activated(taps.joined(0, shape.kernel), i)
            self.layers.append(taps)
            common, own = np.zeros((len(values), inner.shape[1])), ends
            common[half : len(values) - half] = inner

        self.patch = taps = Taps(common, own, w["patch.w"].reshape(-1, width, shape.d_model), self.first, lookback)
        protos, self.starts = w["prototypes"], range(0, lookback - width + 1, shape.patch_stride)
        every = taps.joined(0, width) + w["patch.b"]
        every_d2 = pairwise(every, protos)
        every_soft, every_least, least = soft_weights(every_d2), every_d2.min(1), []
        self.seg, self.soft = [], []  # [B, D] and [B, K] of each segment
        for s in self.starts:
            if any(p in own for p in range(s, s + width)):
                seg = taps.at(s, 0, width) + w["patch.b"]
                d2 = pairwise(seg, protos)
                self.seg.append(seg)
                self.soft.append(soft_weights(d2))
                least.append(d2.min(1))
            else:
                self.seg.append(every[self.first + s])
                self.soft.append(every_soft[self.first + s])
                least.append(every_least[self.first + s])
        self.least = np.stack(least, 1)
        t = np.maximum(text @ w["text0.w"] + w["text0.b"], 0) @ w["text1.w"] + w["text1.b"]
        self.of_text = t @ w["head0.w"][shape.d_model :] + w["head0.b"]
        self.mixed = w["prototypes"] @ w["inject.w"]
        self.pred = self.head(sum(self.seg[1:], self.seg[0]), sum(self.soft[1:], self.soft[0]), self.of_text)

    def activated(self, z: np.ndarray, i: int) -> np.ndarray:
        bias, scale, shift = self.norms[i]
        z = z + bias
        np.maximum(z, 0, out=z)
        z *= scale
        z += shift
        return z

    def head(self, seg_sum: np.ndarray, soft_sum: np.ndarray, of_text: np.ndarray) -> np.ndarray:
        w = self.w
        pooled = (seg_sum + soft_sum @ self.mixed) / len(self.starts) + w["inject.b"]
        return np.maximum(pooled @ w["head0.w"][: self.shape.d_model] + of_text, 0) @ w["head1.w"] + w["head1.b"]

    def masked(self, segments: np.ndarray, chunk: int = 128) -> np.ndarray:
        """[V, B, H]: the windows' predictions with a segment at the window's means; V segments [V, B] each, by number.

        Windows with the same place masked go together. Of a layer only the places that the mask reaches are computed; in
        the middle of the mask all are alike, and are computed once. What the other places add are products of the whole pass.
        """
        out = np.empty((segments.size, self.pred.shape[1]))
        means = np.lib.stride_tricks.sliding_window_view(self.values, self.lookback, 0)[self.first].mean(-1)
        for s in np.unique(segments).tolist():
            group = np.flatnonzero(segments == s)
            for some in np.array_split(group, -(-len(group) // chunk)):
                out[some] = self._masked(some % len(self.pred), s, means)
        return out.reshape(*segments.shape, -1)

    def _masked(self, at: np.ndarray, segment: int, means: np.ndarray) -> np.ndarray:
        half, width, start = self.shape.kernel // 2, self.shape.patch_len, self.starts[segment]
        values, which = means[at][:, None], dict.fromkeys(range(start, start + width), 0)  # changed values [N, ., C], and which of them each place has
        for i, taps in enumerate(self.layers):
            numbers: dict[tuple, int] = {}
            changed, begins = {}, []
            for p in range(max(0, min(which) - half), min(self.lookback, max(which) + half + 1)):
                met = taps.met(p - half, which)
                changed[p] = numbers.setdefault(met if met[1] == (taps.width,) else (p,), len(numbers))  # alike, where all taps meet one value
                if changed[p] == len(begins):
                    begins.append(p - half)
            made = np.empty((len(at), len(begins), taps.kernel.shape[2]))
            for k, begin in enumerate(begins):
                taps.changed(begin, values, which, at, made[:, k])
            bias, scale, shift = self.norms[i]
            made += bias
            np.maximum(made, 0, out=made)
            made *= scale
            made += shift
            values, which = made, changed
        met = [j for j, s in enumerate(self.starts) if s <= max(which) and s + width > min(which)]
        seg = np.empty((len(at), len(met), self.shape.d_model))
        for k, j in enumerate(met):
            self.patch.changed(self.starts[j], values, which, at, seg[:, k])
        seg += self.w["patch.b"]
        seg_sum, soft_sum = seg.sum(1), soft_of(seg.reshape(-1, self.shape.d_model), self.w["prototypes"]).reshape(len(at), len(met), -1).sum(1)
        for j in sorted(set(range(len(self.starts))) - set(met)):
            seg_sum += self.seg[j][at]
            soft_sum += self.soft[j][at]
        return self.head(seg_sum, soft_sum, self.of_text[at])


def soft_of(z: np.ndarray, p: np.ndarray) -> np.ndarray:
    """soft_weights(pairwise(z, p)): z's own square is common to a row and falls out."""
    near = z @ (2 * p.T) - (p**2).sum(1)
    raised = np.exp(near - near.max(1, keepdims=True))
    return raised / raised.sum(1, keepdims=True)


def sliding_forward(w: dict[str, np.ndarray], shape: Shape, values: np.ndarray, lookback: int, text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The predictions [B, H] of Sliding, and its segments' least squared distances to a prototype [B, S]."""
    made = Sliding(w, shape, values, lookback, text)
    return made.pred, made.least


def through_prototypes(z: np.ndarray, d2: np.ndarray, soft: np.ndarray, p: np.ndarray, d_mix: np.ndarray, lambdas: tuple[float, float, float], d_min: float) -> tuple[np.ndarray, np.ndarray]:
    """Gradients of segments z and prototypes p, by that of the mixtures and by the prototype losses themselves."""
    n, protos = d2.shape
    i, j = np.triu_indices(protos, 1)
    d_soft = d_mix @ p.T
    d_p = soft.T @ d_mix
    d_d2 = -soft * (d_soft - (soft * d_soft).sum(1, keepdims=True))
    d_d2[np.arange(n), d2.argmin(1)] += lambdas[0] / n
    d_d2[d2.argmin(0), np.arange(protos)] += lambdas[1] / protos
    d_z = 2 * (z * d_d2.sum(1, keepdims=True) - d_d2 @ p)
    d_p += 2 * (p * d_d2.sum(0)[:, None] - d_d2.T @ z)
    near = ((p[i] - p[j]) ** 2).sum(1) < d_min
    if len(i):
        pull = -2 * lambdas[2] / len(i) * (p[i] - p[j])[near]
        np.add.at(d_p, i[near], pull)
        np.add.at(d_p, j[near], -pull)
    return d_z, d_p


def loss_and_gradients(w: dict[str, np.ndarray], shape: Shape, x: np.ndarray, text: np.ndarray, y: np.ndarray, lambdas: tuple[float, float, float] = (0.1, 0.1, 0.01), rng: np.random.Generator | None = None) -> tuple[dict[str, float], dict[str, np.ndarray], Pass]:
    """Losses of a mini-batch in training mode, gradients of every trained weight, and the pass. ``rng`` draws for models with dropout."""
    if isinstance(shape, attention.PatchShape):
        return attention.loss_and_gradients(w, shape, x, text, y, lambdas, rng)
    out = forward(w, shape, x, text, training=True)
    k, p, g = out.kept, w["prototypes"], {}
    parts = {"l_pred": float(((out.pred - y) ** 2).mean()), "l_c": float(out.d2.min(1).mean()), "l_e": float(out.d2.min(0).mean()), "l_d": diversity_loss(p, shape.d_min)}
    parts["loss"] = weighted_total(*parts.values(), *lambdas)

    def dense(name: str, inputs: np.ndarray, d: np.ndarray) -> np.ndarray:
        flat, slope = inputs.reshape(-1, inputs.shape[-1]), d.reshape(-1, d.shape[-1])
        g[f"{name}.w"], g[f"{name}.b"] = flat.T @ slope, slope.sum(0)
        return d @ w[f"{name}.w"].T

    d = dense("head1", np.maximum(k["h0"], 0), 2 * (out.pred - y) / y.size) * (k["h0"] > 0)
    d = dense("head0", k["fused"], d)
    d_text = dense("text1", np.maximum(k["t0"], 0), d[:, shape.d_model :]) * (k["t0"] > 0)
    dense("text0", k["text"], d_text)
    d_post = np.broadcast_to(d[:, None, : shape.d_model] / out.seg_post.shape[1], out.seg_post.shape)
    d_mix = dense("inject", k["mix"], d_post).reshape(-1, shape.d_model)
    d_z, g["prototypes"] = through_prototypes(out.seg_pre.reshape(-1, shape.d_model), out.d2, k["soft"], p, d_mix, lambdas, shape.d_min)
    d = dense("patch", k["cols"], d_z.reshape(out.seg_pre.shape) + d_post)
    d = spans_back(d, k["h"], shape.patch_len, shape.patch_stride)
    half = shape.kernel // 2
    for layer in reversed(range(len(shape.channels))):
        before, cols, pre, hat, scale, _, _ = k[layer]
        g[f"norm{layer}.gain"], g[f"norm{layer}.shift"] = (d * hat).sum((0, 1)), d.sum((0, 1))
        d = d * w[f"norm{layer}.gain"]
        d = scale * (d - d.mean((0, 1)) - hat * (d * hat).mean((0, 1))) * (pre > 0)
        d = dense(f"conv{layer}", cols, d)
        padded = (before[0], before[1] + 2 * half, before[2])
        d = spans_back(d, padded, shape.kernel, 1)[:, half : half + before[1]]
    return parts, g, out


class AdamW:
    def __init__(self, rate: float = 1e-3, decay: float = 1e-4, clip: float | None = 1.0) -> None:
        self.rate, self.decay, self.clip, self.steps = rate, decay, clip, 0
        self.first: dict[str, np.ndarray] = {}
        self.second: dict[str, np.ndarray] = {}

    def step(self, w: dict[str, np.ndarray], g: dict[str, np.ndarray]) -> None:
        """Clip by the global norm, then update the weights in place."""
        self.steps += 1
        norm = np.sqrt(sum(float((v**2).sum()) for v in g.values()))
        shrink = min(1.0, self.clip / (norm + 1e-6)) if self.clip else 1.0
        for name, slope in g.items():
            slope = slope * shrink
            m = self.first[name] = 0.9 * self.first.get(name, 0) + 0.1 * slope
            v = self.second[name] = 0.999 * self.second.get(name, 0) + 0.001 * slope**2
            w[name] *= 1 - self.rate * self.decay
            w[name] -= self.rate * (m / (1 - 0.9**self.steps)) / (np.sqrt(v / (1 - 0.999**self.steps)) + 1e-8)


def cube(column: pa.Array, *size: int) -> np.ndarray:
    flat = column
    while pa.types.is_list(flat.type) or pa.types.is_large_list(flat.type):
        flat = flat.flatten()
    return flat.fill_null(0.0).to_numpy(zero_copy_only=False).reshape(len(column), *size)


def text_column(shape: Shape) -> Column:
    """The text that the model takes, as the rows have it: one vector a window, or any number of them."""
    return F.col("texts").cast("array<array<double>>").alias("text") if shape.ragged_text else F.col("text").cast("array<double>").alias("text")


def text_of(column: pa.Array, shape: Shape) -> np.ndarray | attention.Ragged:
    """A batch's text. A null set of vectors is empty, null coordinates are 0."""
    if not shape.ragged_text:
        return cube(column, shape.text_dim)
    counts = pc.fill_null(pc.list_value_length(column), 0).to_numpy().astype(np.int64)
    return attention.Ragged(cube(column.flatten(), shape.text_dim), counts)


OUTPUTS = {"pred": "array<double>", "seg_pre": "array<array<double>>", "seg_post": "array<array<double>>", "attention": "array<double>", "n_segments": "int"}


def score(
    rows: DataFrame, w: dict[str, np.ndarray], shape: Shape, keys: tuple[str, ...] = ("ticker", "end_idx"), chunk: int = 64, outputs: tuple[str, ...] = ("pred", "seg_pre", "seg_post"), carry: tuple[str, ...] = (),
) -> DataFrame:
    """The keys, the columns of ``carry``, and what is asked for in ``outputs`` of each window.

    pred is array<double>, n_segments int; seg_pre and seg_post, the segments before and after the injection, are array<array<double>>;
    attention is array<double>, the weights of the window's text vectors in their order (models that attend to them only; what
    is left to 1 went to the token for no text). What isn't asked for isn't made into a column. ``rows``: keys, x
    array<array<double>> (T x features), and text array<double> or, for models that attend to texts, texts
    array<array<double>>. Null coordinates count as 0. All windows of a table have one length.
    """
    if "attention" in outputs and not shape.ragged_text:
        raise ValueError("this model doesn't attend to texts")
    shared = rows.sparkSession.sparkContext.broadcast(w)
    kept = (*keys, *carry)
    at = len(kept)

    def column(name: str, out: Pass, text: np.ndarray | attention.Ragged) -> pa.Array:
        if name == "pred":
            return nested(out.pred)
        if name == "n_segments":
            return pa.array(np.full(len(out.pred), out.seg_post.shape[1], np.int32))
        if name == "attention":
            return pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(text.counts)), pa.int32()), pa.array(out.kept["attention"], pa.float64()))
        seg = getattr(out, name)
        flat = nested(seg.reshape(-1, shape.d_model))
        return pa.ListArray.from_arrays(pa.array(np.arange(0, len(flat) + 1, seg.shape[1]), pa.int32()), flat)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for lo in range(0, whole.num_rows, chunk):
                batch = whole.slice(lo, chunk)
                text = text_of(batch.column(at + 1), shape)
                out = forward(shared.value, shape, cube(batch.column(at), -1, shape.n_features), text)
                yield pa.RecordBatch.from_arrays([*batch.columns[:at], *[column(name, out, text) for name in outputs]], names=[*kept, *outputs])

    picked = rows.select(*kept, F.col("x").cast("array<array<double>>").alias("x"), text_column(shape))
    schema = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in picked.select(*kept).schema)
    return picked.mapInArrow(run, schema + ", ".join(f"{name} {OUTPUTS[name]}" for name in outputs))


def segments(scored: DataFrame, keys: tuple[str, ...] = ("ticker", "end_idx"), column: str = "seg_post") -> DataFrame:
    """A row for each segment: keys, seg_no, vec."""
    return scored.select(*keys, F.posexplode(column).alias("seg_no", "vec"))


def evaluate(rows: DataFrame, w: dict[str, np.ndarray], shape: Shape) -> dict[str, float | None]:
    """mse and mae over all elements of all windows, and their number; None without windows. One pass: targets go along with the windows."""
    made = score(rows.withColumn("y", F.col("y").cast("array<double>")), w, shape, (), outputs=("pred",), carry=("y",))
    return forecast_metrics(made).first().asDict()


def save_weights(spark, w: dict[str, np.ndarray], path: str, shape: Shape) -> None:
    """Weights as Parquet: layer, size, values; the shape stands beside them as JSON text."""
    rows = [(name, list(v.shape), v.ravel().tolist()) for name, v in w.items()]
    spark.createDataFrame(rows, "layer string, size array<int>, values array<double>").coalesce(1).write.mode("overwrite").parquet(f"{path}/weights")
    sizes = [(k, str(v)) for k, v in asdict(shape).items()]
    spark.createDataFrame(sizes, "name string, value string").coalesce(1).write.mode("overwrite").json(f"{path}/shape")


def load_weights(spark, path: str) -> dict[str, np.ndarray]:
    rows = spark.read.schema("layer string, size array<int>, values array<double>").parquet(f"{path}/weights").collect()
    return {r["layer"]: np.array(r["values"]).reshape(r["size"]) for r in rows}


from tideline.operators import attention  # noqa: E402  # it builds on what stands above


def __getattr__(name: str):
    """train and Fit, which stand in training.py."""
    if name in ("train", "Fit"):
        from tideline.operators import training

        return getattr(training, name)
    raise AttributeError(name)
