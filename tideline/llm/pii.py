"""Personal data: exact base patterns, and a character BiLSTM-CRF in numpy that adds the spans they miss.

Base spans (email, ip, card, phone) come from the patterns alone. The network reads windows of the text that overlap by
half; a character's tag scores are averaged over the windows that hold it, nearer to a window's middle counting more, and
the best tag sequence of the whole text under the CRF decides. Windows without a digit and without ``@`` are not read: no
kind of span can stand there, so their characters are outside. As the sequence is outside in every gap between the stretches that
are read, the best one of the text is the best one of each stretch from outside to outside, which is what is computed. Training windows are cut from a bounded sample of documents and labelled with base spans.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import column_at

KINDS = ("email", "ip", "card", "phone")
TAGS = 1 + 2 * len(KINDS)  # outside, then begin and inside of each kind
WINDOW, STRIDE = 64, 32
VOCABULARY = 130  # padding, ASCII, other letters, other marks

LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+){3}")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
TRIGGER = "[0-9@]"


def luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(reversed(digits)):
        v = ord(d) - 48
        if k % 2:
            v = v * 2 - 9 * (v > 4)
        total += v
    return total % 10 == 0


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost matches: from each ``@`` back over the local part, so a long run of letters is walked once."""
    last, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > last and text[start - 1] in LOCAL:
            start -= 1
        found = DOMAIN.match(text, at) if start < at else None
        if found:
            yield start, found.end()
        # what stands left of this @ can't be part of a later match: @ is in no local part
        last = found.end() if found else at + 1
        at = text.find("@", max(at + 1, last))


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """Spans of the base patterns by kind as listed, then start; leftmost and non-overlapping within each kind."""
    out = [("email", s, e) for s, e in emails(text)]
    for m in IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or "0") <= 255 for p in m[0].split(".")):
            out.append(("ip", *m.span()))
    for m in CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 16 <= len(digits) <= 19 and luhn(digits):
            out.append(("card", *m.span()))
    for m in PHONE.finditer(text):
        if 8 <= sum("0" <= c <= "9" for c in m[0]) <= 15:
            out.append(("phone", *m.span()))
    return out


def encode(text: str) -> np.ndarray:
    """Symbol numbers: 1 + code for ASCII, 129 for the rest, 0 pads; digits are one symbol, letters keep case only."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    return np.where(points < 128, points + 1, 129).astype(np.int64)


def stretches(text: str) -> list[tuple[int, list[int]]]:
    """Runs of overlapping windows that hold a trigger: (start, window starts)."""
    hits = np.fromiter((m.start() for m in re.finditer(TRIGGER, text)), np.int64)
    if not len(hits):
        return []
    # windows start at multiples of the stride; a hit is read by the two windows over it and one on either side
    cells = np.unique(np.concatenate([hits // STRIDE + d for d in (-2, -1, 0, 1)]))
    cells = cells[(cells >= 0) & (cells * STRIDE < len(text))]
    runs = np.split(cells, np.flatnonzero(np.diff(cells) > 1) + 1)
    return [(int(r[0]) * STRIDE, (r * STRIDE).tolist()) for r in runs]


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + 0.5


@dataclass
class Tagger:
    """Both directions' weights stand side by side on the first axis."""

    hidden: int = 16
    seed: int = 7
    p: dict[str, np.ndarray] = field(default_factory=dict)

    def __post_init__(self) -> None:
        if not self.p:
            r, h = np.random.default_rng(self.seed), self.hidden
            bias = np.zeros((2, 1, 4 * h), np.float32)
            bias[:, :, h : 2 * h] = 1
            self.p = {
                "symbol": (r.normal(size=(2, VOCABULARY, 4 * h)) * 0.3).astype(np.float32), "state": (r.normal(size=(2, h, 4 * h)) / np.sqrt(h)).astype(np.float32), "bias": bias,
                "out": (r.normal(size=(2 * h, TAGS)) * 0.3).astype(np.float32), "out_bias": np.zeros(TAGS, np.float32), "move": np.zeros((TAGS, TAGS), np.float32), "first": np.zeros(TAGS, np.float32),
            }

    def forward(self, x: np.ndarray) -> tuple[np.ndarray, list]:
        """Tag scores [T, B, TAGS] of symbol windows [B, T], and what backward() needs."""
        p, h = self.p, self.hidden
        both = np.stack([x.T, x.T[::-1]])
        state = np.zeros((2, x.shape[0], h), p["state"].dtype)
        cell, seen, outs = state, [], []
        for t in range(x.shape[1]):
            z = p["symbol"][[[0], [1]], both[:, t]] + state @ p["state"] + p["bias"]
            gates = sigmoid(z[..., : 3 * h])
            i, f, o = gates[..., :h], gates[..., h : 2 * h], gates[..., 2 * h :]
            g = np.tanh(z[..., 3 * h :])
            new = f * cell + i * g
            squashed = np.tanh(new)
            seen.append((state, cell, i, f, o, g, squashed))
            state, cell = o * squashed, new
            outs.append(state)
        outs = np.stack(outs, 1)
        joined = np.concatenate([outs[0], outs[1, ::-1]], -1)
        return joined @ p["out"] + p["out_bias"], [both, seen, joined]

    def loss(self, x: np.ndarray, y: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Mean negative log likelihood of the tag rows y [B, T] under the CRF, and its gradients."""
        scores, (both, seen, joined) = self.forward(x)
        p, h = self.p, self.hidden
        steps, n, _ = scores.shape
        y = y.T
        rows = np.arange(n)
        alpha = np.empty_like(scores)
        alpha[0] = scores[0] + p["first"]
        for t in range(1, steps):
            alpha[t] = scores[t] + logsum(alpha[t - 1][:, :, None] + p["move"], 1)
        total = logsum(alpha[-1], 1)
        gold = p["first"][y[0]] + scores[np.arange(steps)[:, None], rows, y].sum(0) + p["move"][y[:-1], y[1:]].sum(0)
        beta = np.zeros((n, TAGS), scores.dtype)
        slope = np.empty_like(scores)
        move = np.zeros_like(p["move"])
        for t in range(steps - 1, -1, -1):
            slope[t] = np.exp(alpha[t] + beta - total[:, None])
            if t:
                tail = scores[t] + beta
                move += np.exp(alpha[t - 1][:, :, None] + p["move"] + tail[:, None, :] - total[:, None, None]).sum(0)
                beta = logsum(p["move"][None] + tail[:, None, :], 2)
        slope[np.arange(steps)[:, None], rows, y] -= 1
        np.add.at(move, (y[:-1], y[1:]), -1)
        slope /= n
        grad = {"move": move / n, "first": slope[0].sum(0), "out_bias": slope.sum((0, 1)), "out": joined.reshape(-1, 2 * h).T @ slope.reshape(-1, TAGS)}
        back = slope @ p["out"].T
        d_out = np.stack([back[..., :h], back[::-1, :, h:]])
        d_state = np.zeros((2, n, h), scores.dtype)
        d_cell = d_state
        grad |= {k: np.zeros_like(p[k]) for k in ("symbol", "state", "bias")}
        for t in range(steps - 1, -1, -1):
            state, cell, i, f, o, g, squashed = seen[t]
            d = d_state + d_out[:, t]
            d_cell = d_cell + d * o * (1 - squashed**2)
            z = np.concatenate([d_cell * g * i * (1 - i), d_cell * cell * f * (1 - f), d * squashed * o * (1 - o), d_cell * i * (1 - g**2)], -1)
            np.add.at(grad["symbol"], ([[0], [1]], both[:, t]), z)
            grad["state"] += state.transpose(0, 2, 1) @ z
            grad["bias"] += z.sum(1, keepdims=True)
            d_state, d_cell = z @ p["state"].transpose(0, 2, 1), d_cell * f
        return float((total - gold).mean()), grad

    def fit(self, x: np.ndarray, y: np.ndarray, steps: int, batch: int = 32, rate: float = 0.02) -> Tagger:
        """Adam over shuffled batches, with gradients clipped by their norm."""
        r, first, second = np.random.default_rng(self.seed), {}, {}
        for step in range(1, steps + 1):
            pick = r.integers(0, len(x), min(batch, len(x)))
            _, grad = self.loss(x[pick], y[pick])
            norm = np.sqrt(sum(float((g.astype(np.float64) ** 2).sum()) for g in grad.values()))
            for k, g in grad.items():
                g = g * min(1.0, 5 / (norm + 1e-9))
                first[k] = 0.9 * first.get(k, 0) + 0.1 * g
                second[k] = 0.99 * second.get(k, 0) + 0.01 * g * g
                self.p[k] = self.p[k] - (rate * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.99**step)) + 1e-8)).astype(self.p[k].dtype)
        return self

    def viterbi(self, scores: np.ndarray, gap_before: bool = False, gap_behind: bool = False) -> np.ndarray:
        """The best tag row for scores [T, TAGS]; next to a gap the neighbouring character is outside."""
        best, back = scores[0] + (self.p["move"][0] if gap_before else self.p["first"]), np.empty((len(scores), TAGS), np.int64)
        for t in range(1, len(scores)):
            paths = best[:, None] + self.p["move"]
            back[t] = paths.argmax(0)
            best = paths[back[t], np.arange(TAGS)] + scores[t]
        tags = np.empty(len(scores), np.int64)
        tags[-1] = (best + self.p["move"][:, 0] if gap_behind else best).argmax()
        for t in range(len(scores) - 1, 0, -1):
            tags[t - 1] = back[t, tags[t]]
        return tags


def logsum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis, keepdims=True)
    return (np.log(np.exp(x - top).sum(axis, keepdims=True)) + top).squeeze(axis)


def tag_row(length: int, spans: list[tuple[str, int, int]]) -> np.ndarray:
    tags = np.zeros(length, np.int64)
    for kind, s, e in spans:
        k = 1 + 2 * KINDS.index(kind)
        if not tags[s:e].any():
            tags[s], tags[s + 1 : e] = k, k + 1
    return tags


def tag_spans(tags: np.ndarray) -> list[tuple[str, int, int]]:
    out, start = [], -1
    for t, tag in enumerate([*tags.tolist(), 0]):
        if start >= 0 and tag != tags[start] + 1:
            out.append((KINDS[(tags[start] - 1) // 2], start, t))
            start = -1
        if tag % 2:
            start = t
    return out


WEIGHT = np.minimum(np.arange(1, WINDOW + 1), np.arange(WINDOW, 0, -1)).astype(np.float32)[:, None]


def plausible(kind: str, piece: str) -> bool:
    """What a span of the kind must hold at least; the network's other spans are dropped."""
    digits = sum(c.isdigit() for c in piece)
    return {"email": "@" in piece and len(piece) >= 6, "ip": digits >= 4 and piece.count(".") == 3, "card": digits >= 13, "phone": digits >= 8}[kind]


def added_spans(tagger: Tagger, texts: list[str], base: list[list[tuple[str, int, int]]]) -> list[list[tuple[str, int, int]]]:
    """The network's spans for each text, without those that touch a base span."""
    work = [(k, start, starts) for k, text in enumerate(texts) for start, starts in stretches(text)]
    symbols = {k: np.append(encode(texts[k]), np.zeros(WINDOW, np.int64)) for k in {w[0] for w in work}}
    windows = [(k, s) for k, _, starts in work for s in starts]
    out: list[list[tuple[str, int, int]]] = [[] for _ in texts]
    scores = np.empty((len(windows), WINDOW, TAGS), np.float32)
    for lo in range(0, len(windows), 256):
        x = np.stack([symbols[k][s : s + WINDOW] for k, s in windows[lo : lo + 256]])
        scores[lo : lo + 256] = tagger.forward(x)[0].transpose(1, 0, 2)
    at = 0
    for k, start, starts in work:
        size = starts[-1] - start + WINDOW
        total, weight = np.zeros((size, TAGS), np.float32), np.zeros((size, 1), np.float32)
        for s in starts:
            total[s - start : s - start + WINDOW] += scores[at] * WEIGHT
            weight[s - start : s - start + WINDOW] += WEIGHT
            at += 1
        size = min(size, len(texts[k]) - start)
        for kind, s, e in tag_spans(tagger.viterbi((total / weight)[:size], start > 0, start + size < len(texts[k]))):
            s, e = s + start, e + start
            if plausible(kind, texts[k][s:e]) and not any(s < be and bs < e for _, bs, be in base[k]):
                out[k].append((kind, s, e))
    return out


def training_windows(text: str, most: int = 6) -> list[tuple[np.ndarray, np.ndarray]]:
    symbols, tags = encode(text), tag_row(len(text), base_spans(text))
    starts = [s for _, starts in stretches(text) for s in starts]
    pad = lambda a: np.pad(a, (0, WINDOW - len(a)))
    return [(pad(symbols[s : s + WINDOW]), pad(tags[s : s + WINDOW])) for s in starts[:: max(1, -(-len(starts) // most))]]


def train(docs: DataFrame, sample_docs: int = 600, steps: int = 160, hidden: int = 16) -> Tagger | None:
    """A tagger from at most ``sample_docs`` different texts with a trigger, first by a hash of text; None if there are none.

    Base spans label at most six windows of each.
    """
    # copies count once, so that a text that fills a third of the table is one pick
    picked = docs.select(F.col("text")).filter(F.col("text").rlike(TRIGGER)).select(F.xxhash64("text").alias("h")).distinct().orderBy("h").limit(sample_docs)
    # the picks are sample_docs numbers at most
    texts = docs.select("text").withColumn("h", F.xxhash64("text")).join(F.broadcast(picked), "h").dropDuplicates(["h"])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pairs = [(h, x, y) for h, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) for x, y in training_windows(text)]
            yield pa.RecordBatch.from_arrays([pa.array([h for h, _, _ in pairs], pa.int64()), pa.array([x for _, x, _ in pairs], pa.list_(pa.int64())), pa.array([y for _, _, y in pairs], pa.list_(pa.int64()))], names=["h", "x", "y"])

    rows = texts.select("h", "text").mapInArrow(cut, "h long, x array<long>, y array<long>").distinct().orderBy("h", "x").limit(6 * sample_docs).collect()
    if not rows:
        return None
    return Tagger(hidden).fit(np.array([r["x"] for r in rows]), np.array([r["y"] for r in rows]), steps)


def join_spans(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{s}:{e}" for k, s, e in sorted(spans, key=lambda x: (KINDS.index(x[0]), x[1])))


def scan_texts(tagger: Tagger | None, texts: list[str]) -> list[tuple[list, list]]:
    """(base spans, added spans) of each text."""
    base = [base_spans(t) for t in texts]
    return list(zip(base, added_spans(tagger, texts, base) if tagger else [[] for _ in texts], strict=True))


def scan(docs: DataFrame, tagger: Tagger | None) -> DataFrame:
    """Spans of every whole text: doc_id, n_email, n_ip, n_card, n_phone (base spans), n_added, base_spans, spans.

    Null and empty texts have no spans. Rows that repeat are scanned each; a null doc_id stays null, an empty table gives
    none. Only doc_id and text are read, so further columns can have any name. One scan: texts without a trigger don't
    leave the JVM.
    """
    shared = docs.sparkSession.sparkContext.broadcast(tagger)
    names = ["doc_id", *(f"n_{k}" for k in KINDS), "n_added", "base_spans", "spans"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [([], [])] * batch.num_rows
            at = np.flatnonzero(batch.column(1).is_valid().to_numpy(zero_copy_only=False))
            for k, spans in zip(at.tolist(), scan_texts(shared.value, batch.column(1).take(pa.array(at)).to_pylist()), strict=True):
                found[k] = spans
            counts = [pa.array([sum(k == kind for k, _, _ in b) for b, _ in found], pa.int64()) for kind in KINDS]
            yield pa.RecordBatch.from_arrays([batch.column(0), *counts, pa.array([len(a) for _, a in found], pa.int64()), pa.array([join_spans(b) for b, _ in found], pa.string()), pa.array([join_spans(b + a) for b, a in found], pa.string())], names=names)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.when(F.col("text").rlike(TRIGGER), F.col("text")).alias("text"))
    return rows.mapInArrow(run, "doc_id long, " + ", ".join(f"n_{k} long" for k in KINDS) + ", n_added long, base_spans string, spans string")


def redact(docs: DataFrame, tagger: Tagger | None) -> DataFrame:
    """``docs`` with every span of ``text`` replaced by its kind in angle brackets; n_chars, if there, follows.

    Where spans overlap, the union is replaced once and takes the first one's kind. Null and empty texts stay as they are,
    rows that repeat are each redacted, an empty table gives none; other columns keep names and values.
    """
    shared = docs.sparkSession.sparkContext.broadcast(tagger)
    names, at = docs.columns, column_at(docs, "text")
    sizes = [k for k, c in enumerate(names) if c.lower() == "n_chars"]

    def clean(text: str, spans: list[tuple[str, int, int]]) -> str:
        out, done = [], 0
        for kind, s, e in sorted(spans, key=lambda x: (x[1], x[2])):
            if s >= done:
                out += [text[done:s], f"<{kind}>"]
            done = max(done, e)
        return "".join([*out, text[done:]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(at)
            has = pc.fill_null(pc.match_substring_regex(column, TRIGGER), False)
            texts = column.filter(has).to_pylist()
            cleaned = pa.array([clean(t, b + a) for t, (b, a) in zip(texts, scan_texts(shared.value, texts), strict=True)], column.type)
            columns = list(batch.columns)
            columns[at] = pc.replace_with_mask(column, has, cleaned)
            for k in sizes:
                columns[k] = pc.if_else(has, pc.utf8_length(columns[at]).cast(columns[k].type), columns[k])
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return docs.mapInArrow(run, docs.schema)
