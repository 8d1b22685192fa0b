"""Fill-in-middle transformation over ropes.

A text is a rope: a binary tree whose leaves hold about LEAF code points, cut between units, and cache how many units
(runs of A-Z and a-z, or single other code points) and code points they have; inner nodes cache the sums. Two splits at
unit ranks give prefix, middle and suffix as trees that share the text's leaves, and joining them with the sentinels in
another order is a few new inner nodes; the output is written once, leaf by leaf. The way back builds the output's rope,
splits it at the sentinels' code-point ranks and joins the pieces again.

A row is handled by itself where it stands: no shuffle, and a task holds one Arrow batch.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

UNIT = re.compile(r"[A-Za-z]+|[^A-Za-z]")
LETTERS = re.compile(r"[A-Za-z]*")
LEAF = 1024
#: Code points whose units are counted at once.
BLOCK = 1 << 20
#: The sentinels of prefix, suffix and middle.
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
SENTINELS = (PREFIX, SUFFIX, MIDDLE)


class Leaf:
    __slots__ = ("chars", "text", "units")

    def __init__(self, text: str, units: int | None = None) -> None:
        self.text, self.chars = text, len(text)
        self.units = len(UNIT.findall(text)) if units is None else units


class Join:
    __slots__ = ("chars", "left", "right", "units")

    def __init__(self, left: Rope, right: Rope) -> None:
        self.left, self.right = left, right
        self.chars, self.units = left.chars + right.chars, left.units + right.units


type Rope = Leaf | Join
EMPTY = Leaf("", 0)


def join(*ropes: Rope) -> Rope:
    out = EMPTY
    for r in ropes:
        out = r if not out.chars else Join(out, r) if r.chars else out
    return out


def leaves(text: str, leaf: int) -> Iterator[Leaf]:
    """Leaves of about ``leaf`` code points; none cuts a run of letters, so one is as long as its last run makes it."""
    at = 0
    while at < len(text):
        end = at + BLOCK
        if end < len(text) and LETTERS.fullmatch(text, end - 1, end):
            end = LETTERS.match(text, end).end()
        block, at = text[at:end], end
        letter = (np.frombuffer(block.encode("utf-32-le"), np.uint32) | 32) - np.uint32(97) < 26
        begins = ~letter
        begins[0] = True
        begins[1:] |= ~letter[:-1]
        unit = np.flatnonzero(begins)
        rank = np.unique(np.searchsorted(unit, np.arange(0, len(block), leaf)))
        rank = np.append(rank[rank < len(unit)], len(unit))
        place = np.append(unit, len(block))[rank].tolist()
        for i, j, n in zip(place, place[1:], np.diff(rank).tolist(), strict=False):
            yield Leaf(block[i:j], n)


def rope(text: str, leaf: int = LEAF) -> Rope:
    """A balanced rope."""
    level: list[Rope] = list(leaves(text, leaf))
    while len(level) > 1:
        paired: list[Rope] = [Join(a, b) for a, b in zip(level[::2], level[1::2], strict=False)]
        level = [*paired, level[-1]] if len(level) % 2 else paired
    return level[0] if level else EMPTY


def _cut(r: Rope, rank: int, by_units: bool) -> tuple[Rope, Rope]:
    way: list[tuple[Join, bool]] = []
    while isinstance(r, Join):
        size = r.left.units if by_units else r.left.chars
        right = rank >= size
        way.append((r, right))
        rank, r = (rank - size, r.right) if right else (rank, r.left)
    if not by_units:
        at = rank
    elif rank >= r.units:
        at = r.chars
    else:
        at = next(islice(UNIT.finditer(r.text), rank, None)).start()
    if at <= 0 or at >= r.chars:
        low, high = (EMPTY, r) if at <= 0 else (r, EMPTY)
    else:
        low = Leaf(r.text[:at], rank if by_units else None)
        high = Leaf(r.text[at:], r.units - rank if by_units else None)
    for node, right in reversed(way):
        low, high = (join(node.left, low), high) if right else (low, join(high, node.right))
    return low, high


def split_units(r: Rope, rank: int) -> tuple[Rope, Rope]:
    """The first ``rank`` units, and the rest."""
    return _cut(r, rank, True)


def split_chars(r: Rope, rank: int) -> tuple[Rope, Rope]:
    """The first ``rank`` code points, and the rest."""
    return _cut(r, rank, False)


def written(r: Rope) -> str:
    parts, todo = [], [r]
    while todo:
        r = todo.pop()
        if isinstance(r, Join):
            todo += (r.right, r.left)
        else:
            parts.append(r.text)
    return "".join(parts)


def arrange(text: str, h: tuple[int, int, int, int], plain_from: int = 90, spm_below: int = 20) -> tuple[int, str, int | None, int | None, str]:
    """(units, form, code points of the prefix, of the middle, output) of a text and its four draws."""
    whole = rope(text)
    n = whole.units
    if not text or any(s in text for s in SENTINELS) or h[2] % 100 >= plain_from:
        return n, "plain", None, None, text
    low, high = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    rest, suffix = split_units(whole, high)
    prefix, middle = split_units(rest, low)
    marks = {s: Leaf(s, len(s)) for s in SENTINELS}
    if h[3] % 100 < spm_below:
        form, out = "spm", join(marks[SUFFIX], suffix, marks[PREFIX], prefix, marks[MIDDLE], middle)
    else:
        form, out = "psm", join(marks[PREFIX], prefix, marks[SUFFIX], suffix, marks[MIDDLE], middle)
    return n, form, prefix.chars, middle.chars, written(out)


def rearrange(output: str, form: str) -> str | None:
    """The text that ``arrange`` had; None if the form's sentinels aren't there in their order."""
    if form == "plain":
        return output
    first, second = (PREFIX, SUFFIX) if form == "psm" else (SUFFIX, PREFIX)
    at = output.find(second)
    last = output.find(MIDDLE, at)
    if not output.startswith(first) or at < 0 or last < 0:
        return None
    rest, middle = split_chars(rope(output), last)
    head, tail = split_chars(rest, at)
    cut = lambda r, mark: split_chars(r, len(mark))[1]
    one, two, middle = cut(head, first), cut(tail, second), cut(middle, MIDDLE)
    prefix, suffix = (one, two) if form == "psm" else (two, one)
    return written(join(prefix, middle, suffix))


def transform(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", seed: int = 1) -> DataFrame:
    """The id column with n, form (plain, psm or spm), prefix_chars, middle_chars and output of every row.

    Draws are the first four groups of eight digits of the SHA-256 of ``seed:id``. A null text is empty, and so plain; a
    null id draws by the seed alone. Rows that repeat give equal rows; other columns are left out, whatever their names.
    """
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(doc_id).cast("string"), F.lit(""))).cast("binary"), 256)
    draws = [F.conv(F.substring(digest, 1 + 8 * k, 8), 16, 10).cast("long").alias(f"h{k}") for k in range(4)]
    picked = docs.select(F.col(doc_id), F.coalesce(F.col(text), F.lit("")).alias("text"), *draws)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            h = zip(*(b.column(k).to_pylist() for k in range(2, 6)), strict=True)
            made = [arrange(str(t), draw) for t, draw in zip(b.column(1), h, strict=True)]
            n, form, prefix, middle, out = zip(*made, strict=True) if made else ((),) * 5
            kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string())
            yield pa.RecordBatch.from_arrays([b.column(0), *map(pa.array, (n, form, prefix, middle, out), kinds)], names=names)

    names = [doc_id, "n", "form", "prefix_chars", "middle_chars", "output"]
    return picked.mapInArrow(run, f"`{doc_id}` {docs.schema[doc_id].dataType.simpleString()}, n long, form string, prefix_chars long, middle_chars long, output string")


def restore(arranged: DataFrame, output: str = "output", form: str = "form") -> DataFrame:
    """``arranged`` with ``restored``, the text before the transformation, from output and form alone.

    Null where either is null or the form's sentinels are missing.
    """
    at = [arranged.columns.index(c) for c in (output, form)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            pairs = zip(b.column(at[0]), b.column(at[1]).to_pylist(), strict=True)
            back = [rearrange(str(o), f) if o.is_valid and f is not None else None for o, f in pairs]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(back, pa.string())], names=[*b.schema.names, "restored"])

    schema = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in arranged.schema)
    return arranged.mapInArrow(run, schema + "restored string")
