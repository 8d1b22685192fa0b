"""Forecast models b, c0 and c1: self-attention over patches and one global token, with prototypes before the attention.

Only sizes and the order of parts are given by what we work from, so the bodies are defined here:

* A window's strided patches are embedded (linear, plus learnt positions); these segments meet the prototypes, and the
  prototypes' mixture is injected into them. A learnt global token joins the segments; the prototypes never see it.
* Each encoder layer: multi-head self-attention over all tokens, dropout, residual, layer norm; then two dense layers with
  ReLU and dropout, residual, layer norm. The tokens' mean goes to the head.
* ``late`` (b): the text vector passes its own dense layers and joins the mean before the head.
* ``gate`` (c0): before the layers, each segment takes the embedded text through a sigmoid gate of segment and text.
* ``cross`` (c1): within each layer, after self-attention, the global token alone attends to the window's text vectors, any
  number of them, and to a learnt one that stands for no text; then residual and layer norm. A window keeps its own set of
  vectors: sets aren't padded, softmax runs over each set by itself. The last layer's weights, averaged over heads, are an output.

Each part returns its result and the function that takes a gradient back through it.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np

from tideline.operators import model
from tideline.operators.prototypes import diversity_loss, pairwise, soft_weights, weighted_total

Back = Callable[[np.ndarray], np.ndarray]
FUSIONS = ("late", "gate", "cross")


@dataclass(frozen=True)
class PatchShape(model.Shape):
    """The protocol's sizes. ``lookback`` decides how many positions there are."""

    channels: tuple[int, ...] = ()
    lookback: int = 60
    n_heads: int = 4
    e_layers: int = 2
    dropout: float = 0.1
    fusion: str = "late"
    wide: int = 128

    def __post_init__(self) -> None:
        if self.fusion not in FUSIONS:
            raise ValueError(f"fusion {self.fusion!r} isn't one of {', '.join(FUSIONS)}")
        if self.d_model % self.n_heads:
            raise ValueError(f"{self.n_heads} heads don't divide {self.d_model} values")
        if self.lookback < self.patch_len:
            raise ValueError("a look-back must hold a patch")

    @property
    def n_segments(self) -> int:
        return (self.lookback - self.patch_len) // self.patch_stride + 1

    @property
    def ragged_text(self) -> bool:
        return self.fusion == "cross"


@dataclass
class Ragged:
    """The text vectors of some windows, one after the other, and how many each has."""

    flat: np.ndarray
    counts: np.ndarray

    def __getitem__(self, windows: slice) -> Ragged:
        """Some windows that follow each other."""
        first = np.append(0, np.cumsum(self.counts))
        lo, hi, _ = windows.indices(len(self.counts))
        return Ragged(self.flat[first[lo] : first[hi]], self.counts[lo:hi])


def initial_weights(shape: PatchShape, seed: int = 42) -> dict[str, np.ndarray]:
    """Dense weights uniform within 1 / sqrt(fan in), prototypes, positions and learnt tokens normal with deviation 0.02, norms at identity."""
    r = np.random.default_rng(seed)
    w: dict[str, np.ndarray] = {}
    d = shape.d_model

    def layer(name: str, fan_in: int, fan_out: int) -> None:
        bound = fan_in**-0.5
        w[f"{name}.w"], w[f"{name}.b"] = r.uniform(-bound, bound, (fan_in, fan_out)), r.uniform(-bound, bound, fan_out)

    layer("patch", shape.n_features * shape.patch_len, d)
    w |= {"position": r.normal(size=(shape.n_segments, d)) * 0.02, "prototypes": r.normal(size=(shape.n_prototypes, d)) * 0.02, "global": r.normal(size=d) * 0.02}
    layer("inject", d, d)
    if shape.fusion != "cross":
        layer("text0", shape.text_dim, shape.text_hidden)
        layer("text1", shape.text_hidden, d)
    if shape.fusion == "gate":
        layer("gate", 2 * d, d)
    if shape.fusion == "cross":
        layer("texts", shape.text_dim, d)
        w["no_text"] = r.normal(size=d) * 0.02
    for k in range(shape.e_layers):
        for part in ("self", *(["cross"] if shape.fusion == "cross" else [])):
            for name in ("query", "key", "value", "out"):
                layer(f"layer{k}.{part}.{name}", d, d)
        layer(f"layer{k}.wide", d, shape.wide)
        layer(f"layer{k}.narrow", shape.wide, d)
        for name in ("self", "dense", *(["cross"] if shape.fusion == "cross" else [])):
            w |= {f"layer{k}.{name}.gain": np.ones(d), f"layer{k}.{name}.shift": np.zeros(d)}
    layer("head0", 2 * d if shape.fusion == "late" else d, shape.head_hidden)
    layer("head1", shape.head_hidden, shape.horizon)
    return w


class Parts:
    """The parts of a forward pass; their ways back add to ``g``. Without ``rng`` nothing is dropped."""

    def __init__(self, w: dict[str, np.ndarray], rate: float, rng: np.random.Generator | None) -> None:
        self.w, self.rate, self.rng, self.g = w, rate, rng, {}

    def add(self, name: str, d: np.ndarray) -> None:
        self.g[name] = self.g[name] + d if name in self.g else d

    def dense(self, name: str, x: np.ndarray) -> tuple[np.ndarray, Back]:
        w = self.w[f"{name}.w"]

        def back(d: np.ndarray) -> np.ndarray:
            self.add(f"{name}.w", x.reshape(-1, x.shape[-1]).T @ d.reshape(-1, d.shape[-1]))
            self.add(f"{name}.b", d.reshape(-1, d.shape[-1]).sum(0))
            return model.flat(d, w.T)

        y = model.flat(x, w)
        y += self.w[f"{name}.b"]
        return y, back

    def two(self, first: str, second: str, x: np.ndarray) -> tuple[np.ndarray, Back]:
        """Dense, ReLU, dropout, dense."""
        h, back0 = self.dense(first, x)
        a, dropped = self.drop(np.maximum(h, 0))
        y, back1 = self.dense(second, a)
        return y, lambda d: back0(dropped(back1(d)) * (h > 0))

    def drop(self, x: np.ndarray) -> tuple[np.ndarray, Back]:
        if self.rng is None or not self.rate:
            return x, lambda d: d
        keep = (self.rng.random(x.shape) >= self.rate) / (1 - self.rate)
        return x * keep, lambda d: d * keep

    def norm(self, name: str, x: np.ndarray) -> tuple[np.ndarray, Back]:
        hat = x - x.mean(-1, keepdims=True)
        scale = 1 / np.sqrt(np.einsum("...i,...i->...", hat, hat)[..., None] / x.shape[-1] + model.EPSILON)
        hat *= scale
        gain = self.w[f"{name}.gain"]

        def back(d: np.ndarray) -> np.ndarray:
            self.add(f"{name}.gain", (d * hat).reshape(-1, x.shape[-1]).sum(0))
            self.add(f"{name}.shift", d.reshape(-1, x.shape[-1]).sum(0))
            d = d * gain
            return scale * (d - d.mean(-1, keepdims=True) - hat * (d * hat).mean(-1, keepdims=True))

        return hat * gain + self.w[f"{name}.shift"], back

    def self_attention(self, name: str, h: np.ndarray, heads: int, asking: slice = slice(None)) -> tuple[np.ndarray, Back]:
        """Each token, or those of ``asking`` (without a way back), attends to all."""
        b, _, d = h.shape
        split = lambda t: t.reshape(b, -1, heads, d // heads).transpose(0, 2, 1, 3)
        merge = lambda t: t.transpose(0, 2, 1, 3).reshape(b, -1, d)
        (q, back_q), (k, back_k), (v, back_v) = (self.dense(f"{name}.{p}", t) for p, t in (("query", h[:, asking]), ("key", h), ("value", h)))
        q, k, v = split(q), split(k), split(v)
        root = (d // heads) ** 0.5
        score = q @ k.transpose(0, 1, 3, 2) / root
        weight = np.exp(score - score.max(-1, keepdims=True))
        weight /= weight.sum(-1, keepdims=True)
        used, dropped = self.drop(weight)
        y, back_out = self.dense(f"{name}.out", merge(used @ v))

        def back(slope: np.ndarray) -> np.ndarray:
            mixed = split(back_out(slope))
            d_weight = dropped(mixed @ v.transpose(0, 1, 3, 2))
            d_score = weight * (d_weight - (weight * d_weight).sum(-1, keepdims=True)) / root
            return back_q(merge(d_score @ k)) + back_k(merge(d_score.transpose(0, 1, 3, 2) @ q)) + back_v(merge(used.transpose(0, 1, 3, 2) @ mixed))

        return y, back

    def set_attention(self, name: str, g: np.ndarray, tokens: np.ndarray, counts: np.ndarray, heads: int) -> tuple[np.ndarray, np.ndarray, Callable[[np.ndarray], tuple[np.ndarray, np.ndarray]]]:
        """g [B, d] attends to its own run of tokens [N, d]; counts are 1 at least. (result, weights [N, heads], way back to g and tokens)."""
        d = g.shape[1]
        owner, first = np.repeat(np.arange(len(counts)), counts), np.cumsum(counts) - counts
        split = lambda t: t.reshape(len(t), heads, d // heads)
        (q, back_q), (k, back_k), (v, back_v) = self.dense(f"{name}.query", g), self.dense(f"{name}.key", tokens), self.dense(f"{name}.value", tokens)
        q, k, v = split(q), split(k), split(v)
        root = (d // heads) ** 0.5
        score = (q[owner] * k).sum(-1) / root
        weight = np.exp(score - np.maximum.reduceat(score, first)[owner])
        weight /= np.add.reduceat(weight, first)[owner]
        used, dropped = self.drop(weight)
        y, back_out = self.dense(f"{name}.out", np.add.reduceat(used[..., None] * v, first).reshape(len(g), d))

        def back(slope: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            mixed = split(back_out(slope))[owner]
            d_weight = dropped((mixed * v).sum(-1))
            d_score = weight * (d_weight - np.add.reduceat(weight * d_weight, first)[owner]) / root
            d_q = np.add.reduceat(d_score[..., None] * k, first).reshape(len(g), d)
            d_k = (d_score[..., None] * q[owner]).reshape(len(tokens), d)
            return back_q(d_q), back_k(d_k) + back_v((used[..., None] * mixed).reshape(len(tokens), d))

        return y, weight, back


def forward(w: dict[str, np.ndarray], shape: PatchShape, x: np.ndarray, text: np.ndarray | Ragged, training: bool = False, rng: np.random.Generator | None = None, until_attention: bool = False) -> model.Pass:
    """Scores of windows x [B, T, C]. ``text`` is [B, E], or Ragged for ``cross``, whose pass has ``attention`` among what it kept.

    With ``until_attention`` a pass of ``cross`` ends with these weights, the last layer's of the global token, and has no predictions.
    """
    f = Parts(w, shape.dropout, rng if training else None)
    b, s, d = len(x), shape.n_segments, shape.d_model
    cols = model.spans(x, shape.patch_len, shape.patch_stride)
    embedded, back_patch = f.dense("patch", cols)
    seg = embedded + w["position"]
    d2 = pairwise(seg.reshape(-1, d), w["prototypes"])
    soft = soft_weights(d2) if len(d2) else d2
    mix = (soft @ w["prototypes"]).reshape(seg.shape)
    injected, back_inject = f.dense("inject", mix)
    post = seg + injected
    h = post
    if shape.fusion != "cross":
        t, back_text = f.two("text0", "text1", text)
    if shape.fusion == "gate":
        both = np.concatenate([post, np.broadcast_to(t[:, None], post.shape)], -1)
        z, back_gate = f.dense("gate", both)
        gate = 1 / (1 + np.exp(-z))
        h = post + gate * t[:, None]
    if shape.fusion == "cross":
        place = np.cumsum(text.counts + 1) - text.counts - 1  # where each window's learnt token stands
        own = np.ones(len(text.flat) + b, bool)
        own[place] = False
        embedded_text, back_texts = f.dense("texts", text.flat)
        tokens = np.empty((len(own), d))
        tokens[own], tokens[place] = embedded_text, w["no_text"]
    h = np.concatenate([h, np.broadcast_to(w["global"], (b, 1, d))], 1)
    ways: list[tuple] = []
    attention = None
    for k in range(shape.e_layers):
        if until_attention and k == shape.e_layers - 1:
            y, _ = f.self_attention(f"layer{k}.self", h, shape.n_heads, slice(s, None))
            g, _ = f.norm(f"layer{k}.self", h[:, s:] + y)
            _, attention, _ = f.set_attention(f"layer{k}.cross", g[:, 0], tokens, text.counts + 1, shape.n_heads)
            return model.Pass(np.empty((b, 0)), seg, post, d2, {"attention": attention.mean(1)[own]})
        y, back_self = f.self_attention(f"layer{k}.self", h, shape.n_heads)
        y, dropped = f.drop(y)
        h, back_norm = f.norm(f"layer{k}.self", h + y)
        cross = None
        if shape.fusion == "cross":
            y, attention, back_set = f.set_attention(f"layer{k}.cross", h[:, s], tokens, text.counts + 1, shape.n_heads)
            y, dropped_cross = f.drop(y)
            g, back_norm_cross = f.norm(f"layer{k}.cross", h[:, s] + y)
            h = np.concatenate([h[:, :s], g[:, None]], 1)
            cross = (back_set, dropped_cross, back_norm_cross)
        y, back_dense = f.two(f"layer{k}.wide", f"layer{k}.narrow", h)
        y, dropped_dense = f.drop(y)
        h, back_norm_dense = f.norm(f"layer{k}.dense", h + y)
        ways.append((back_self, dropped, back_norm, cross, back_dense, dropped_dense, back_norm_dense))
    pooled = h.mean(1)
    fused = np.concatenate([pooled, t], 1) if shape.fusion == "late" else pooled
    pred, back_head = f.two("head0", "head1", fused)

    def back(d_pred: np.ndarray, through: Callable[[np.ndarray], np.ndarray]) -> dict[str, np.ndarray]:
        """Gradients of all weights; ``through`` takes the mixture's gradient through the prototypes to the segments."""
        slope = back_head(d_pred)
        d_h = np.repeat(slope[:, None, :d] / (s + 1), s + 1, 1)
        d_tokens = 0.0
        for back_self, dropped, back_norm, cross, back_dense, dropped_dense, back_norm_dense in reversed(ways):
            d_h = back_norm_dense(d_h)
            d_h = d_h + back_dense(dropped_dense(d_h))
            if cross:
                d_g = cross[2](d_h[:, s])
                d_query, d_more = cross[0](cross[1](d_g))
                d_tokens = d_tokens + d_more
                d_h = np.concatenate([d_h[:, :s], (d_g + d_query)[:, None]], 1)
            d_h = back_norm(d_h)
            d_h = d_h + back_self(dropped(d_h))
        f.add("global", d_h[:, s].sum(0))
        d_post = d_h[:, :s]
        if shape.fusion == "late":
            back_text(slope[:, d:])
        elif shape.fusion == "gate":
            d_both = back_gate(d_post * t[:, None] * gate * (1 - gate))
            back_text((d_post * gate).sum(1) + d_both[..., d:].sum(1))
            d_post = d_post + d_both[..., :d]
        elif shape.e_layers:
            f.add("no_text", d_tokens[place].sum(0))
            back_texts(d_tokens[own])
        d_seg = d_post + through(back_inject(d_post).reshape(-1, d)).reshape(seg.shape)
        f.add("position", d_seg.sum(0))
        back_patch(d_seg)
        return f.g

    kept = {"back": back, "soft": soft}
    if attention is not None:
        kept["attention"] = attention.mean(1)[own]
    return model.Pass(pred, seg, post, d2, kept)


class Scorer:
    """What forward() makes without training, with weights put together beforehand.

    A segment is linear in its patch and in its prototypes' soft weights, and so are its query, key and value in the first
    layer (but for ``gate``): all come from one product, a row a token. Windows that differ in some patches take the other
    tokens from each other.
    """

    def __init__(self, w: dict[str, np.ndarray], shape: PatchShape) -> None:
        self.w, self.shape = w, shape
        self.rooms: dict[str, np.ndarray] = {}
        d, p = shape.d_model, w["prototypes"]
        self.even, self.head_of = np.full(d, 1 / d), np.repeat(np.eye(shape.n_heads), d // shape.n_heads, 1)
        self.folded = shape.fusion != "gate" and shape.e_layers > 0
        self.own = [self.projection(f"layer{k}.self", ("query", "key", "value")) for k in range(shape.e_layers)]
        more, bias = (np.concatenate([np.eye(d), self.own[0][0]], 1), np.concatenate([np.zeros(d), self.own[0][1]])) if self.folded else (np.eye(d), np.zeros(d))
        self.place = w["patch.b"] + w["position"]
        self.token, self.token_place = np.concatenate([w["patch.w"], p @ w["inject.w"]]) @ more, (self.place + w["inject.b"]) @ more + bias
        self.last = w["global"] @ more + bias
        self.near_patch, self.near_place = 2 * w["patch.w"] @ p.T, 2 * self.place @ p.T - (p**2).sum(1)
        if shape.fusion == "cross":
            self.cross = [(self.projection(f"layer{k}.cross", ("query",)), self.projection(f"layer{k}.cross", ("key", "value"))) for k in range(shape.e_layers)]

    def room(self, name: str, *size: int) -> np.ndarray:
        """An array for a step's result, until that step's next call: fresh ones of this size would go back to the system each time."""
        need = math.prod(size)
        if name not in self.rooms or len(self.rooms[name]) < need:
            self.rooms[name] = np.empty(need)
        return self.rooms[name][:need].reshape(size)

    def projection(self, name: str, parts: tuple[str, ...]) -> tuple[np.ndarray, np.ndarray]:
        """Weights and biases side by side; the query's are divided by the root of a head's size."""
        root = (self.shape.d_model // self.shape.n_heads) ** 0.5
        w, b = ([self.w[f"{name}.{part}.{kind}"] / (root if part == "query" else 1) for part in parts] for kind in "wb")
        return np.concatenate(w, 1), np.concatenate(b)

    def tokens(self, patches: np.ndarray, place: np.ndarray | slice = slice(None)) -> tuple[np.ndarray, np.ndarray]:
        """Of patches [N, S, C * P] at the given places: [N, S, .], what layers begin with, and each one's nearest prototype."""
        n, s, size = patches.shape
        known = self.room("known", n * s, size + self.near_patch.shape[1])
        known[:, :size] = patches.reshape(n * s, size)
        near = (known[:, :size] @ self.near_patch).reshape(n, s, -1)
        near += self.near_place[place]
        nearest = near.argmax(-1)
        near -= np.take_along_axis(near, nearest[..., None], -1)  # a segment's own square would be the same for all prototypes
        np.exp(near, out=near)
        near = near.reshape(n * s, -1)
        np.divide(near, (near @ np.ones(near.shape[1]))[:, None], out=known[:, size:])
        made = np.matmul(known, self.token, out=self.room("made", n * s, self.token.shape[1])).reshape(n, s, -1)
        made += self.token_place[place]
        return made, nearest

    def windows(self, x: np.ndarray, copies: int = 1) -> tuple[np.ndarray, np.ndarray]:
        """The tokens of windows x [B, T, C], so many times: [V, B, S + 1, .], and the segments' least squared distances to a prototype [B, S]."""
        patches = model.spans(x, self.shape.patch_len, self.shape.patch_stride)
        made = self.room("tokens", copies, len(x), self.shape.n_segments + 1, self.token.shape[1])
        made[:, :, :-1], nearest = self.tokens(patches)
        made[:, :, -1] = self.last
        apart = model.flat(patches, self.w["patch.w"])
        apart += self.place
        apart -= self.w["prototypes"][nearest]  # by differences: no cancellation
        return made, np.einsum("bsi,bsi->bs", apart, apart)

    def mask(self, x: np.ndarray, made: np.ndarray, segments: np.ndarray) -> None:
        """Put the tokens of windows x with a segment at the window's means into ``made`` [V, B, S + 1, .], which has the windows' own; V segments [V, B] each."""
        shape = self.shape
        reach = (shape.patch_len - 1) // shape.patch_stride
        place = np.clip(segments[..., None] + np.arange(-reach, reach + 1), 0, shape.n_segments - 1)  # patches that the mask meets; near the ends some twice
        rows = place[..., None] * shape.patch_stride + np.arange(shape.patch_len)
        from_start = rows - segments[..., None, None] * shape.patch_stride
        window = np.arange(len(x))[:, None]
        patches = np.where(((from_start >= 0) & (from_start < shape.patch_len))[..., None], x.mean(1)[:, None, None], x[window[..., None], rows])
        patches = patches.swapaxes(3, 4).reshape(-1, place.shape[2], self.near_patch.shape[0])
        made[np.arange(len(segments))[:, None, None], window, place] = self.tokens(patches, place.reshape(-1, place.shape[2]))[0].reshape(*place.shape, -1)

    def normed(self, u: np.ndarray) -> np.ndarray:
        """Rows of mean 0 and variance 1, in place."""
        u -= (u @ self.even)[:, None]
        u *= (1 / np.sqrt(np.einsum("ij,ij->i", u, u) / u.shape[1] + model.EPSILON))[:, None]
        return u

    def norm(self, name: str, u: np.ndarray) -> np.ndarray:
        self.normed(u)
        u *= self.w[f"{name}.gain"]
        u += self.w[f"{name}.shift"]
        return u

    def dense(self, name: str, x: np.ndarray, room: str | None = None) -> np.ndarray:
        w = self.w[f"{name}.w"]
        y = np.matmul(x, w, out=None if room is None else self.room(room, len(x), w.shape[1]))
        y += self.w[f"{name}.b"]
        return y

    def two(self, first: str, second: str, x: np.ndarray, rooms: tuple[str | None, str | None] = (None, None)) -> np.ndarray:
        h = self.dense(first, x, rooms[0])
        return self.dense(second, np.maximum(h, 0, out=h), rooms[1])

    def attended(self, name: str, made: np.ndarray) -> np.ndarray:
        """[B * T, d] from the queries, keys and values [B, T, 3 * d] of all tokens."""
        b, t, _ = made.shape
        d, heads = self.shape.d_model, self.shape.n_heads
        q, k, v = (made[..., lo : lo + d].reshape(b, t, heads, -1).transpose(0, 2, 1, 3) for lo in (0, d, 2 * d))
        weight = raised(np.matmul(q, k.transpose(0, 1, 3, 2), out=self.room("score", b, heads, t, t)))
        y = self.room("mixed", b * t, d)
        np.matmul(weight, v, out=y.reshape(b, t, heads, -1).transpose(0, 2, 1, 3))
        total = (weight.reshape(-1, t) @ np.ones(t)).reshape(b, heads, t)
        y *= np.matmul((1 / total).transpose(0, 2, 1).reshape(-1, heads), self.head_of, out=self.room("out", b * t, d))
        return self.dense(f"{name}.out", y, "out")

    def attended_set(self, k: int, g: np.ndarray, tokens: np.ndarray, owner: np.ndarray, first: np.ndarray) -> np.ndarray:
        """[V * B, d]: each of g [V * B, d] attends to its window's tokens, which the V copies of B windows share."""
        (query, query_b), (given, given_b) = self.cross[k]
        b, d = len(first), self.shape.d_model
        q, kv = (g @ query + query_b).reshape(-1, b, d), tokens @ given + given_b
        score = model.flat(q[:, owner] * kv[:, :d], self.head_of.T)
        weight = np.exp(score - np.maximum.reduceat(score, first, 1)[:, owner])
        mixed = np.add.reduceat(model.flat(weight, self.head_of) * kv[:, d:], first, 1).reshape(-1, d)
        mixed *= (1 / np.add.reduceat(weight, first, 1)).reshape(-1, self.shape.n_heads) @ self.head_of
        return self.dense(f"layer{k}.cross.out", mixed)

    def predicted(self, made: np.ndarray, text: np.ndarray | Ragged) -> np.ndarray:
        """[V, B, H]: predictions from the tokens [V, B, S + 1, .] of V copies of B windows, which have their texts in common."""
        w, shape, d = self.w, self.shape, self.shape.d_model
        copies, b, s = made.shape[0], made.shape[1], shape.n_segments
        n = copies * b
        if not n:
            return np.empty((copies, b, shape.horizon))
        made = made.reshape(n, s + 1, -1)
        h = self.room("h", n, s + 1, d)
        h[:] = made[..., :d]
        if shape.fusion != "cross":
            t = np.concatenate([self.two("text0", "text1", text)] * copies)
        if shape.fusion == "gate":
            z = model.flat(h[:, :s], w["gate.w"][:d]) + (t @ w["gate.w"][d:] + w["gate.b"])[:, None]
            h[:, :s] += t[:, None] / (1 + np.exp(-z))
        if shape.fusion == "cross":
            first = np.cumsum(text.counts + 1) - text.counts - 1  # where each window's learnt token stands
            given = np.ones(len(text.flat) + b, bool)
            given[first] = False
            tokens = np.empty((len(given), d))
            tokens[given], tokens[first] = self.dense("texts", text.flat), w["no_text"]
            owner = np.repeat(np.arange(b), text.counts + 1)
        h = h.reshape(-1, d)
        for k in range(shape.e_layers):
            if k or not self.folded:
                own = np.matmul(h, self.own[k][0], out=self.room("own", len(h), 3 * d))
                own += self.own[k][1]
                own = own.reshape(n, s + 1, -1)
            else:
                own = made[..., d:]
            h += self.attended(f"layer{k}.self", own)
            self.norm(f"layer{k}.self", h)
            if shape.fusion == "cross":
                g = h.reshape(n, s + 1, d)[:, s]
                g += self.attended_set(k, g, tokens, owner, first)
                g[:] = self.norm(f"layer{k}.cross", g.copy())
            h += self.two(f"layer{k}.wide", f"layer{k}.narrow", h, ("wide", "out"))
            if k < shape.e_layers - 1:
                self.norm(f"layer{k}.dense", h)
        if shape.e_layers:  # the last norm's gain and shift are the same for all tokens, so for their mean
            last = f"layer{shape.e_layers - 1}.dense"
            pooled = self.normed(h).reshape(n, s + 1, d).mean(1) * w[f"{last}.gain"] + w[f"{last}.shift"]
        else:
            pooled = h.reshape(n, s + 1, d).mean(1)
        return self.two("head0", "head1", np.concatenate([pooled, t], 1) if shape.fusion == "late" else pooled).reshape(copies, b, -1)


def scorer(w: dict[str, np.ndarray], shape: model.Shape) -> Scorer | None:
    """The model's Scorer, if it is one of these models."""
    return Scorer(w, shape) if isinstance(shape, PatchShape) else None


def raised(score: np.ndarray) -> np.ndarray:
    """exp(score), in place, but for a factor common to each row that keeps it within doubles."""
    top = score.max()
    score -= top if top - score.min() < 600 else score.max(-1, keepdims=True)
    return np.exp(score, out=score)


def loss_and_gradients(w: dict[str, np.ndarray], shape: PatchShape, x: np.ndarray, text: np.ndarray | Ragged, y: np.ndarray, lambdas: tuple[float, float, float] = (0.1, 0.1, 0.01), rng: np.random.Generator | None = None) -> tuple[dict[str, float], dict[str, np.ndarray], model.Pass]:
    """Losses of a mini-batch in training mode, gradients of every weight, and the pass. ``rng`` draws what is dropped."""
    out = forward(w, shape, x, text, True, rng)
    parts = {"l_pred": float(((out.pred - y) ** 2).mean()), "l_c": float(out.d2.min(1).mean()), "l_e": float(out.d2.min(0).mean()), "l_d": diversity_loss(w["prototypes"], shape.d_min)}
    parts["loss"] = weighted_total(*parts.values(), *lambdas)
    grown: dict[str, np.ndarray] = {}

    def through(d_mix: np.ndarray) -> np.ndarray:
        d_z, grown["prototypes"] = model.through_prototypes(out.seg_pre.reshape(-1, shape.d_model), out.d2, out.kept["soft"], w["prototypes"], d_mix, lambdas, shape.d_min)
        return d_z

    g = out.kept["back"](2 * (out.pred - y) / y.size, through)
    return parts, g | grown, out


def shapes() -> dict[str, Callable[..., PatchShape]]:
    """The models by name."""
    return {name: lambda fusion=fusion, **sizes: PatchShape(fusion=fusion, **sizes) for name, fusion in (("b", "late"), ("c0", "gate"), ("c1", "cross"))}
