"""Benchmark decontamination: q-gram lemma filtering in overlapping diagonal bands, then banded alignment.

An item of m characters that stands in a text with at most e edits shares at least m - q + 1 - q e of its q-grams with
it, on diagonals (text position - item position) no more than e apart. Q-gram hits are counted in bands of 2 (e + 1)
diagonals that overlap by half, so one band holds all of them; bands that reach the bound are aligned, on their own
diagonals and e more on either side. Items too short for the bound have a shorter q, those of fewer than q characters are one
q-gram each.

Documents that hold a part of an item, an item laid out otherwise or with words replaced are found by the same search
for overlapping passages of the items (Passages), over texts whose runs of white space are collapsed.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import column_at, mix, random_table, stage

TABLE = random_table(1 << 16, 5)
BASE = np.uint64(0x9E3779B97F4A7C15)
MAP_BITS = 22
STOP = np.array([0xFFFFFFFF], np.uint32)
SLICE_CHARS = 1 << 19
#: Postings that are counted at once.
PIECE = 1 << 22
SCHEMA = "doc_id long, item_id long, start long, end long, edits long"
WHITE = np.array([9, 10, 11, 12, 13], np.uint32)
#: Further white space of Unicode, for passages only.
WIDE_WHITE = np.array([0x1C, 0x1D, 0x1E, 0x1F, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000], np.uint32)


@dataclass(frozen=True)
class Passages:
    """Passages of ``chars`` characters, one each ``step``, that may be off by ``edit_rate`` of their characters.

    Whole passages stand in every quotation of chars + step - 1 characters. An item of ``least`` to ``chars`` characters
    is one passage, shorter ones are looked for as a whole only. The q-gram bound is that of fewer edits than may be
    aligned: with these values up to 5 edits anywhere in a passage are found, and 10 if they stand in three words.
    """

    chars: int = 80
    step: int = 20
    least: int = 48
    q: int = 12
    edit_rate: float = 0.13
    #: q-grams that a passage has to share at least
    shared: int = 9


def normal_points(text: str) -> np.ndarray:
    """Lower-case code points, white space as spaces, one for each code point of the text."""
    low = text.lower()
    if len(low) != len(text):
        low = "".join(c if len(x := c.lower()) != 1 else x for c in text)
    points = np.frombuffer(low.encode("utf-32-le", "surrogatepass"), np.uint32)
    return np.where((points >= 9) & (points <= 13), np.uint32(32), points)


def collapsed(points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The points with one space for each run of white space and none at the ends, and where each stood."""
    space = (points == 32) | ((points > 27) & np.isin(points, WIDE_WHITE))
    keep = np.flatnonzero(~space | np.append(~space[1:], False))
    if len(keep) and space[keep[0]]:
        keep = keep[1:]
    return np.where(space[keep], np.uint32(32), points[keep]), keep


def grams(points: np.ndarray, q: int) -> np.ndarray:
    """A 64-bit hash of the q-gram at each position, built from halves."""
    values, n = TABLE[points & np.uint32(0xFFFF)] ^ (points >> np.uint32(16)).astype(np.uint64), len(points)
    if n < q:
        return np.empty(0, np.uint64)
    spans, power, done, out, left = values, 1, 0, None, q
    while left:
        if left & 1:
            part = spans[done : done + n - q + 1]
            out = part if out is None else out * np.uint64(pow(int(BASE), power, 1 << 64)) + part
            done += power
        left >>= 1
        if left:
            spans = spans[: len(spans) - power] * np.uint64(pow(int(BASE), power, 1 << 64)) + spans[power:]
            power *= 2
    return mix(out)


@dataclass
class Index:
    """Q-grams of a block of items: sorted hashes, their postings, a bit map of hashes to turn most away."""

    q: int
    ids: list[list[int]]
    points: list[np.ndarray]
    budget: np.ndarray
    least: np.ndarray
    keys: np.ndarray
    begin: np.ndarray
    item: np.ndarray
    at: np.ndarray
    bits: np.ndarray


def build_index(items: list[tuple[int, str]], q: int, edit_rate: float) -> list[Index]:
    """Indexes of the items, one for each q that they need: the largest up to ``q`` that leaves the lemma a bound of one."""
    points = [(i, normal_points(t)) for i, t in items]
    own = [min(q, len(p) // (int(edit_rate * len(p)) + 1)) for _, p in points]
    return [index_points([i for (i, _), k in zip(points, own, strict=True) if k == n], [p for (_, p), k in zip(points, own, strict=True) if k == n], n, edit_rate) for n in sorted({k for k in own if k})]


def passage_index(items: list[tuple[int, str]], passages: Passages) -> Index:
    """The index of the items' passages, numbered by their item in the block."""
    owner, points = [], []
    for k, (_, text) in enumerate(items):
        whole = collapsed(normal_points(text))[0]
        last = len(whole) - passages.chars
        if len(whole) >= passages.least:
            starts = sorted({*range(0, last, passages.step), max(last, 0)})
            owner += [k] * len(starts)
            points += [whole[a : a + passages.chars] for a in starts]
    return index_points(owner, points, passages.q, passages.edit_rate, passages.shared)


def index_points(owners: list[int], texts: list[np.ndarray], q: int, edit_rate: float, shared: int = 0) -> Index:
    """The index of the texts, equal ones once with all their owners."""
    known: dict[bytes, tuple[np.ndarray, list[int]]] = {}
    for owner, text in zip(owners, texts, strict=True):
        known.setdefault(text.tobytes(), (text, []))[1].append(owner)
    points, ids = [t for t, _ in known.values()], [sorted(set(o)) for _, o in known.values()]
    size = np.array([len(p) for p in points], np.int64)
    budget = (edit_rate * size).astype(np.int64)
    # with ``shared`` the bound is that of fewer edits than may be aligned
    sure = np.maximum(0, np.minimum(budget, (size - q - max(shared - 1, 0)) // q)) if shared else budget
    hashes = [grams(p, q) for p in points]
    key = np.concatenate(hashes) if hashes else np.empty(0, np.uint64)
    item = np.repeat(np.arange(len(ids)), [len(h) for h in hashes])
    at = np.concatenate([np.arange(len(h)) for h in hashes]) if hashes else np.empty(0, np.int64)
    order = np.argsort(key, kind="stable")
    keys, begin = np.unique(key[order], return_index=True)
    bits = np.zeros(1 << MAP_BITS, bool)
    bits[keys >> np.uint64(64 - MAP_BITS)] = True
    return Index(q, ids, points, budget, size - q + 1 - q * sure, keys, np.append(begin, len(key)), item[order], at[order], bits)


def bits_of(flags: np.ndarray) -> int:
    return int.from_bytes(np.packbits(flags, bitorder="little").tobytes(), "little")


def flags_of(bits: int, n: int) -> np.ndarray:
    return np.unpackbits(np.frombuffer(bits.to_bytes(-(-n // 8), "little"), np.uint8), bitorder="little")[:n]


def align(item: np.ndarray, region: np.ndarray, budget: int, low: int, high: int) -> tuple[int, int] | None:
    """Least edits of the whole item against any part of the region, and where that part ends first; None over budget.

    Cells on the diagonals (region position - item position) from ``low`` to ``high`` are filled, a row of the item at a
    time, as differences of neighbouring diagonals in the bits of two integers; the diagonal beyond ``high`` matches
    nothing. Cells outside the region stand for characters that match nothing, so that they cost what leaving out the
    item's character costs.
    """
    n, width = len(region), high - low + 1
    mask, rows = (1 << width) - 1, max(512, width)
    before, behind = max(0, -low), max(0, len(item) + high + 1 - n)
    padded = np.concatenate([np.full(before, 0xFFFFFFFF, np.uint32), region, np.full(behind, 0xFFFFFFFF, np.uint32)])
    up, down, edits = 0, 0, 0  # where the next diagonal costs one more, one less; edits on the first diagonal
    for begin in range(0, len(item), rows):
        part = item[begin : begin + rows]
        text = padded[begin + low + before : begin + low + before + len(part) + width]
        where = {c: bits_of(text == c) for c in np.unique(part).tolist()}
        for k, c in enumerate(part.tolist()):
            equal = (where[c] >> k) & mask
            free = ((((equal & up) + up) ^ up) | equal | down) & mask
            more = down | (mask ^ (free | up))
            less = free & up
            edits += ~free & 1
            free >>= 1
            up, down = less | (mask ^ (free | more)), more & free
    if edits - down.bit_count() > budget:
        return None
    cost = edits + np.concatenate([[0], np.cumsum(flags_of(up, width).astype(np.int64) - flags_of(down, width))[:-1]])
    best = int(np.argmin(cost))
    return (int(cost[best]), min(max(len(item) + low + best, 0), n)) if cost[best] <= budget else None


def occurrence(item: np.ndarray, region: np.ndarray, budget: int, low: int, high: int) -> tuple[int, int, int] | None:
    """(edits, start, end) of the item's best place in the region, on diagonals from ``low`` to ``high``."""
    text, pattern = region.tobytes(), item.tobytes()
    exact = text.find(pattern)
    while exact >= 0 and exact % 4:
        exact = text.find(pattern, exact + 1)
    if exact >= 0:
        return 0, exact // 4, exact // 4 + len(item)
    found = align(item, region, budget, low, high) if budget else None
    if not found:
        return None
    edits, end = found
    # backwards from where it ends, the best path stays within ``edits`` diagonals
    back = align(item[::-1], region[:end][::-1], edits, -edits, edits)
    return (edits, end - back[1], end) if back else None


def shortened(points: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray | None]:
    """The points with ``most`` of each longer run of one character, half from either end, and where each stood.

    What ``most`` / 2 characters can hold stands in the shortened text exactly where it stands in the whole one.
    """
    if len(points) <= most:
        return points, None
    first = np.flatnonzero(np.append(True, points[1:] != points[:-1]))
    size = np.diff(np.append(first, len(points)))
    if size.max() <= most:
        return points, None
    keep = np.ones(len(points), bool)
    for a, n in zip(first[size > most].tolist(), size[size > most].tolist(), strict=True):
        keep[a + most // 2 : a + n - (most - most // 2)] = False
    keep = np.flatnonzero(keep)
    return points[keep], keep


def full_bands(hit: np.ndarray, place: np.ndarray, index: Index) -> tuple[np.ndarray, np.ndarray, int]:
    """(item, band) of the bands that reach their item's bound, in order, and what was added to the diagonals.

    Postings of the hits are counted in pieces, so that memory depends on the bands and not on how often q-grams repeat.
    """
    shift = max((len(p) for p in index.points), default=0) + 1
    # half bands, numbered over all items: a band is two neighbouring ones, and each item has one half more than hits can reach
    halves = (int(hit[-1]) + shift) // (int(index.budget.min()) + 1) + 2
    size = halves * len(index.points)
    dense = np.zeros(size, np.int64) if size <= 4 * PIECE and size <= 8 * len(hit) else None
    ends = np.cumsum(index.begin[place + 1] - index.begin[place])
    keys, counts, lo = [], [], 0
    while lo < len(hit):
        hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + PIECE, "right")))
        h, p = hit[lo:hi], place[lo:hi]
        many = index.begin[p + 1] - index.begin[p]
        posting = np.repeat(index.begin[p] - np.cumsum(many) + many, many) + np.arange(many.sum())
        item = index.item[posting]
        half = item * halves + 1 + (np.repeat(h, many) - index.at[posting] + shift) // (index.budget[item] + 1)
        if dense is not None:
            dense += np.bincount(half, minlength=size)
        else:
            k, c = np.unique(half, return_counts=True)
            keys.append(k)
            counts.append(c)
        lo = hi
    if dense is not None:
        key = np.flatnonzero(dense)
        count = dense[key]
    else:
        key, at = np.unique(np.concatenate(keys), return_inverse=True)
        count = np.bincount(at, np.concatenate(counts)).astype(np.int64)
    # a band is known by its first half
    both = np.append(key[1:] == key[:-1] + 1, False)
    lone = np.append(True, ~both[:-1])  # no band before this one begins with a half that has hits
    band = np.concatenate([key, key[lone] - 1])
    count = np.concatenate([count + np.where(both, np.append(count[1:], 0), 0), count[lone]])
    enough = count >= index.least[band // halves]
    band = np.sort(band[enough])
    return band // halves, band % halves - 1, shift


Part = tuple[int, int, np.ndarray]  # row, where the points begin in its text, points
Best = dict[tuple[int, int], tuple[int, int, int]]  # (row, item): (edits, start, end)


def search(parts: list[Part], index: Index, best: Best) -> None:
    """Put each item's best place in each part that holds it within its budget into ``best``."""
    q = index.q
    ends = np.cumsum([len(t) + 1 for *_, t in parts])
    starts = ends - [len(t) + 1 for *_, t in parts]
    joined = np.concatenate([x for *_, t in parts for x in (t, STOP)])
    h = grams(joined, q)
    hit = np.flatnonzero(index.bits[h >> np.uint64(64 - MAP_BITS)])
    place = np.searchsorted(index.keys, h[hit])
    place[place == len(index.keys)] = 0
    same = index.keys[place] == h[hit] if len(index.keys) else np.zeros(len(hit), bool)
    hit, place = hit[same], place[same]
    if not len(hit):
        return
    item, band, shift = full_bands(hit, place, index)
    # neighbouring bands of an item share most of their text and are aligned as one
    new = np.flatnonzero(np.append(True, (np.diff(item) != 0) | (np.diff(band) > 2))) if len(item) else np.empty(0, np.int64)
    final = np.append(new[1:], len(item))[: len(new)] - 1
    for i, b, c in zip(item[new].tolist(), band[new].tolist(), band[final].tolist(), strict=True):
        e, m = int(index.budget[i]), len(index.points[i])
        low, high = b * (e + 1) - shift - e, (c + 2) * (e + 1) - 1 - shift + e
        first = max(0, int(np.searchsorted(ends, max(low, 0), "right")))
        for k in range(first, min(len(parts), int(np.searchsorted(starts, high + m + 1, "left")))):
            row, begin, points = parts[k]
            left, right = max(low, int(starts[k])), min(high + m + 1, int(ends[k]) - 1)
            if right - left < m - e or best.get((row, i), (1,))[0] == 0:  # parts and bands come in order: no later place is better
                continue
            found = occurrence(index.points[i], points[left - starts[k] : right - starts[k]], e, low - left, high - left)
            if found:
                at = begin + left - int(starts[k])
                new_place = (found[0], at + found[1], at + found[2])
                best[row, i] = min(best.get((row, i), new_place), new_place)


def parts_of(texts: list[np.ndarray], reach: int) -> Iterator[list[Part]]:
    """The texts in groups of about SLICE_CHARS; a longer text is several parts that overlap by ``reach``."""
    held, size, most = [], 0, max(SLICE_CHARS, 2 * reach)
    for row, points in enumerate(texts):
        for begin in range(0, max(1, len(points) - reach), most - reach):
            part = points[begin : begin + most]
            if held and size + len(part) > SLICE_CHARS:
                yield held
                held, size = [], 0
            held.append((row, begin, part))
            size += len(part)
    if held:
        yield held


def search_all(texts: list[np.ndarray], index: Index) -> Best:
    """(row, item): (edits, start, end) of each item's best place, the first of several, in each text that holds it."""
    best: Best = {}
    if not len(index.keys):
        return best
    reach = max(len(p) for p in index.points) + int(index.budget.max()) + 1
    short = [shortened(t, 2 * (reach + index.q)) for t in texts]
    for parts in parts_of([t for t, _ in short], reach):
        search(parts, index, best)
    for (row, i), (edits, start, end) in best.items():
        keep = short[row][1]
        if keep is not None:
            best[row, i] = (edits, int(keep[start]), int(keep[end - 1]) + 1)
    return best


@dataclass
class Block:
    """A block's indexes of whole items and, with passages, that of theirs; ``items`` has the items' ids for the latter."""

    items: list[int]
    whole: list[Index]
    parts: Index | None


def build_block(items: list[tuple[int, str]], q: int, edit_rate: float, passages: Passages | None) -> Block:
    # items are known by their number in the block, as ids may repeat
    return Block([i for i, _ in items], build_index(list(enumerate(t for _, t in items)), q, edit_rate), passage_index(items, passages) if passages else None)


def blocks(benchmark: DataFrame, q: int, edit_rate: float, block_chars: int, passages: Passages | None, least_chars: int) -> Iterator[tuple[Block, bool]]:
    """The benchmark's blocks, each with whether it is the only one; the driver holds two blocks' items at a time."""
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.coalesce("text", F.lit("")).alias("text")).filter(F.length("text") >= max(1, least_chars))
    block, size, ready, made = [], 0, None, 0
    for row in items.orderBy("item_id", "text").toLocalIterator():
        if block and size + len(row["text"]) > block_chars:
            if ready:
                made += 1
                yield build_block(ready, q, edit_rate, passages), False
            ready, block, size = block, [], 0
        block.append((row["item_id"], row["text"]))
        size += len(row["text"])
    for items_of in (ready, block):
        if items_of:
            yield build_block(items_of, q, edit_rate, passages), not made and not ready


def contaminated(docs: DataFrame, benchmark: DataFrame, q: int = 10, edit_rate: float = 0.06, block_chars: int = 4_000_000, passages: Passages | None = None, least_chars: int = 1) -> DataFrame:
    """Pairs (doc_id, item_id) with the item's best place in the text: start, end (code points, end exclusive), edits.

    Case and kind of white space don't count. An item may be off by ``edit_rate`` of its characters, rounded down. Items
    of fewer than ``least_chars`` characters, null and empty ones match nothing; null and empty texts hold nothing. Items
    that repeat are items each; rows that repeat give a pair each, and a null doc_id or item_id stays null. Either table
    empty gives none. Only doc_id, item_id and text are read, so further columns can have any name.

    With ``passages`` a text that doesn't hold the item, but a passage of it, counts, too: its best passage's place and
    edits. There the number of white-space characters doesn't count either.

    The benchmark is read in blocks of at most ``block_chars`` characters (a longer item is a block by itself), so the
    broadcast index has a fixed bound; each block is one pass over the documents, without a shuffle. With several blocks
    each pass is written before the next begins, and its broadcast is given up.
    """
    spark = docs.sparkSession
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    found = []
    for block, only in blocks(benchmark, q, edit_rate, block_chars, passages, least_chars):
        shared = spark.sparkContext.broadcast(block)
        pairs = texts.mapInArrow(searcher(shared), SCHEMA)
        if not only:
            pairs = stage(pairs, "contaminated")
            shared.unpersist()
        found.append(pairs)
    return reduce(DataFrame.unionAll, found) if found else spark.createDataFrame([], SCHEMA)


def hits(block: Block, texts: list[str]) -> Iterator[tuple[int, int, int, int, int]]:
    """(text, item, start, end, edits): whole items, and passages for the pairs that have none. Items by number in the block."""
    held, size, first = [], 0, 0
    for k, text in enumerate(texts):
        held.append(normal_points(text or ""))
        size += len(held[-1])
        if size > SLICE_CHARS or k == len(texts) - 1:
            found = {(row, n): place for index in block.whole for (row, i), place in search_all(held, index).items() for n in index.ids[i]}
            if block.parts:
                for pair, place in passage_hits(held, block.parts).items():
                    found.setdefault(pair, place)
            for (row, i), (edits, start, end) in found.items():
                yield first + row, i, start, end, edits
            held, size, first = [], 0, k + 1


def passage_hits(texts: list[np.ndarray], parts: Index) -> Best:
    """(row, item): the item's passage with the fewest edits, the first of several."""
    tidy = [collapsed(t) for t in texts]
    best: Best = {}
    for (row, part), (edits, start, end) in search_all([t for t, _ in tidy], parts).items():
        at = tidy[row][1]
        new = (edits, int(at[start]), int(at[end - 1]) + 1)
        for n in parts.ids[part]:
            best[row, n] = min(best.get((row, n), new), new)
    return best


def searcher(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, block = batch.column(0).to_pylist(), shared.value
            rows = [(ids[r], block.items[i], s, e, d) for r, i, s, e, d in hits(block, batch.column(1).to_pylist())]
            columns = zip(*rows, strict=True) if rows else [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=[x.split()[0] for x in SCHEMA.split(", ")])

    return run


def clean(docs: DataFrame, benchmark: DataFrame, q: int = 10, edit_rate: float = 0.06, block_chars: int = 4_000_000, passages: Passages | None = None, least_chars: int = 10) -> DataFrame:
    """The rows of ``docs`` whose text holds no benchmark item or passage, as contaminated() says; a pass for each block, no shuffle.

    Items of fewer than ``least_chars`` characters are no evidence: a word that is an item doesn't drop every text that
    uses it. Null and empty texts stay, repeated rows are held each, further columns can have any name, and an empty
    benchmark drops nothing.
    """
    at = column_at(docs, "text")

    def dropper(shared):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                keep = np.ones(batch.num_rows, bool)
                keep[[row for row, *_ in hits(shared.value, batch.column(at).to_pylist())]] = False
                yield batch.filter(pa.array(keep))

        return run

    for block, only in blocks(benchmark, q, edit_rate, block_chars, passages, least_chars):
        shared = docs.sparkSession.sparkContext.broadcast(block)
        docs = docs.mapInArrow(dropper(shared), docs.schema)
        if not only:
            docs = stage(docs, "clean")
            shared.unpersist()
    return docs
