"""Repeated byte strings across documents: every byte covered by a LENGTH-byte string that also starts earlier.

In each LENGTH-byte window the GRAM-byte string of least hash is its anchor. Windows that follow each other and share
an anchor are a run. Equal windows have equal anchors at equal places, so runs meet by their anchor's hash, and stand
in columns by their anchor's place: windows that are equal begin in the same column. Hashes are routes only.

1. Each task cuts its texts into runs. Runs whose anchor's hash occurs once are done: nothing in them repeats.
2. The others' bytes are fetched, for one of SHARES of the keys after the other, and meet in blocks of at most BLOCK runs.
   A block is a collection whose positional Burrows-Wheeler transform and common prefixes are built column by column
   (``columnwise``), one symbol a run each round; windows with LENGTH symbols in common are equal, and all but the earliest
   of them repeat.
3. Where an anchor has more runs than a block, or so many that they were dealt over tasks, what a block leaves meets again
   in a pass of its own, by a finer route: the anchor of a longer gram, then the whole window. Passes read and write
   sequential files in the shared folder, each with only what the one before it left, until no group is cut.
4. A document's repeats are merged to maximal spans and cut out.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .columnwise import in_columns, later_windows
from .common import POWERS, free_shuffles, mix, prefix_hash, slices, stage, text_bytes

LENGTH = 100
#: The anchors' length in each pass; windows by themselves are the last.
GRAMS = (24, 76, LENGTH)
SEGMENT = 4 << 20
BLOCK_RUNS = 400_000
BLOCK = 4096
#: Keys are dealt over so many shares, taken one after the other: runs overlap, so the bytes of all may be over three times the text's.
SHARES = 3
PLACE = np.uint64(0xFFFFFF)


def runs(data: np.ndarray, offsets: np.ndarray, gram: int = GRAMS[0]) -> tuple[np.ndarray, ...]:
    """Runs of the rows' windows: row, first start within ``data``, number of starts, the anchor's place behind it, anchor hash."""
    n, windows = len(data), LENGTH - gram + 1
    row = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    start = np.flatnonzero(row[: max(0, n - LENGTH + 1)] == row[LENGTH - 1 :])
    if not len(start):
        return tuple(np.empty(0, np.int64) for _ in range(5))
    if windows == 1:
        raw = data.tobytes()
        key = np.frombuffer(b"".join(hashlib.blake2b(raw[s : s + LENGTH], digest_size=8).digest() for s in start.tolist()), np.int64)
        return row[start], start, np.ones_like(start), np.zeros_like(start), key
    prefix = prefix_hash(data)
    _, down = POWERS.upto(n)
    hashes = mix((prefix[gram:] - prefix[:-gram]) * down[: n - gram + 1])
    # the least hash, the leftmost of equal ones: the place stands in the low bits
    least = (hashes & ~PLACE) | np.arange(len(hashes), dtype=np.uint64)
    width = 1
    while 2 * width <= windows:
        least = np.minimum(least[:-width], least[width:])
        width *= 2
    if width < windows:
        least = np.minimum(least[: len(least) - (windows - width)], least[windows - width :])
    anchor, row = (least[start] & PLACE).astype(np.int64), row[start]
    new = np.ones(len(start), bool)
    new[1:] = (anchor[1:] != anchor[:-1]) | (row[1:] != row[:-1])
    first = np.flatnonzero(new)
    count = np.diff(np.append(first, len(start)))
    return row[first], start[first], count, anchor[first] - start[first], hashes[anchor[first]].view(np.int64)


def pieces_of(key: np.ndarray, doc: np.ndarray, spread: int) -> tuple[np.ndarray, np.ndarray]:
    """A piece for each run, 0 unless its key is hot in this block of runs, and the hot keys.

    A key with so many of the block's runs that it would fill several of ``spread`` parts of the whole is dealt over as many
    pieces, by document.
    """
    keys, at, count = np.unique(key, return_inverse=True, return_counts=True)
    many = np.minimum(count * spread // max(1, len(key)), count // 16)
    own = many[at]
    deal = (mix(doc.astype(np.uint64)) >> np.uint64(1)).astype(np.int64)
    return np.where(own > 1, 1 + deal % np.maximum(own, 1), 0), keys[many > 1]


def batch(schema: str, *columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c) for c in columns], names=[x.split()[0] for x in schema.split(", ")])


RUNS = "key long, piece int, split boolean, doc long, place long"


def packed(start: np.ndarray, behind: np.ndarray, count: np.ndarray) -> np.ndarray:
    return start << 16 | behind << 8 | count


def with_marks(schema: str, hot: np.ndarray, key: np.ndarray, piece: np.ndarray, doc: np.ndarray, *rest: pa.Array) -> pa.RecordBatch:
    """Rows of runs, and for each hot key a row without document that tells its piece 0 that there are others."""
    m = len(hot)
    columns = [np.append(key, hot), np.append(piece, np.zeros(m, np.int64)).astype(np.int32), np.append(piece > 0, np.ones(m, bool)), pa.concat_arrays([pa.array(doc), pa.nulls(m, pa.int64())])]
    return batch(schema, *columns, *(pa.concat_arrays([c, pa.nulls(m, c.type)]) for c in rest))


def cut_runs(spread: int, segment: int = SEGMENT, block_runs: int = BLOCK_RUNS):
    """From texts to rows of RUNS."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []
        size = 0

        def block() -> pa.RecordBatch:
            doc, key, place = (np.concatenate(c) for c in zip(*held, strict=True))
            piece, hot = pieces_of(key, doc, spread)
            return with_marks(RUNS, hot, key, piece, doc, pa.array(place))

        for b in batches:
            ids = b.column(0).to_numpy()
            data, offsets = text_bytes(b.column(1))
            for i, j in slices(offsets):
                for lo in range(int(offsets[i]), int(offsets[j]), segment) if j - i == 1 else [int(offsets[i])]:
                    hi = min(int(offsets[j]), lo + segment + LENGTH - 1) if j - i == 1 else int(offsets[j])
                    cuts = np.array([0, hi - lo]) if j - i == 1 else offsets[i : j + 1] - lo
                    row, start, count, behind, key = runs(data[lo:hi], cuts)
                    if len(row):
                        held.append((ids[row + i], key, packed(start + lo - offsets[row + i], behind, count)))
                        size += len(row)
                    if size >= block_runs:
                        yield block()
                        held, size = [], 0
        if held:
            yield block()

    return run


def meet_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows of RUNS sorted by key, piece, place: those whose key has others. Marks (null, and so first) are taken up."""
    group, seen, marked = None, 0, False  # the last group so far
    alone = None  # its row, while it has only one
    for b in batches:
        key, piece = b.column(0).to_numpy(), b.column(1).to_numpy()
        mark = b.column(3).is_null().to_numpy(zero_copy_only=False)
        split = b.column(2).to_numpy(zero_copy_only=False)
        if not len(key):
            continue
        new = np.ones(len(key), bool)
        new[1:] = (key[1:] != key[:-1]) | (piece[1:] != piece[:-1])
        of = np.cumsum(new) - 1
        size, told = np.bincount(of, ~mark).astype(np.int64), np.bincount(of, mark) > 0
        if group == (key[0], piece[0]):
            size[0] += seen
            told[0] |= marked
            if alone is not None and size[0] > 1:
                yield alone
                alone = None
        else:
            alone = None
        group, seen, marked = (key[-1], piece[-1]), int(size[-1]), bool(told[-1])
        stay = ~mark & ((size[of] > 1) | told[of] | split)
        out = b.take(pa.array(np.flatnonzero(stay)))
        yield pa.RecordBatch.from_arrays([out.column(0), out.column(1), pa.array((split | told[of])[stay]), out.column(3), out.column(4)], names=out.schema.names)
        last = len(key) - 1
        if seen == 1 and not mark[last] and not stay[last]:
            alone = b.slice(last, 1)


STRINGS = "key long, piece int, split boolean, doc long, start long, lead int, bytes binary"


def fetch_bytes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From texts with their runs to rows of STRINGS."""
    for b in batches:
        raw, offsets = (x.tobytes() if k == 0 else x for k, x in enumerate(text_bytes(b.column(1))))
        lists = b.column(2)
        of = np.repeat(np.arange(b.num_rows), lists.value_lengths().to_numpy())
        flat = lists.flatten()
        place = flat.field(3).to_numpy()
        start, behind, size = place >> 16, place >> 8 & 255, (place & 255) + LENGTH - 1
        at = offsets[of] + start
        for lo in range(0, len(of), 100_000):
            part = slice(lo, lo + 100_000)
            strings = pa.array([raw[s : s + n] for s, n in zip(at[part].tolist(), size[part].tolist(), strict=True)], pa.binary())
            lead = (LENGTH - GRAMS[0] - behind[part]).astype(np.int32)
            yield batch(STRINGS, *(flat.field(k).slice(lo, 100_000) for k in range(3)), b.column(0).take(pa.array(of[part])), start[part], lead, strings)


LEFT = "doc long, start long, count long, bytes binary"


def recut(gram: int, spread: int):
    """From rows of LEFT with bytes to rows of STRINGS by another route."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo in range(0, b.num_rows, 20_000):
                part = b.slice(lo, 20_000)
                data, offsets = binary_bytes(part.column(3))
                row, at, count, behind, key = runs(data, offsets, gram)
                doc = part.column(0).to_numpy()[row]
                raw = data.tobytes()
                strings = pa.array([raw[s : s + n] for s, n in zip(at.tolist(), (count + LENGTH - 1).tolist(), strict=True)], pa.binary())
                piece, hot = pieces_of(key, doc, spread)
                start = part.column(1).to_numpy()[row] + at - offsets[row]
                yield with_marks(STRINGS, hot, key, piece, doc, pa.array(start), pa.array((LENGTH - gram - behind).astype(np.int32)), strings)

    return run


def binary_bytes(column: pa.ChunkedArray | pa.Array) -> tuple[np.ndarray, np.ndarray]:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    strings = column.to_pylist()
    return np.frombuffer(b"".join(strings), np.uint8), np.concatenate([[0], np.cumsum([len(x) for x in strings], dtype=np.int64)])


def spans_of(hit: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(string, first column, columns) of the maximal runs of True in [windows, strings]."""
    string, column = np.nonzero(hit.T)
    first = np.flatnonzero(np.append(True, (string[1:] != string[:-1]) | (column[1:] != column[:-1] + 1))) if len(string) else string
    return string[first], column[first], np.diff(np.append(first, len(string)))


def compare(gram: int, most: int = BLOCK):
    """From rows of STRINGS sorted by key, piece, document, start to rows of LEFT.

    Without bytes they are repeats; with bytes they are what a block of a cut group leaves.
    """
    windows = LENGTH - gram + 1

    def block(t: pa.Table) -> Iterator[pa.RecordBatch]:
        # the order of the text, as pieces of one key may meet here
        t = t.take(pa.array(np.lexsort((t["start"].to_numpy(), t["doc"].to_numpy())))).combine_chunks()
        split, doc, start, lead = (t[c].to_numpy() for c in ("split", "doc", "start", "lead"))
        data, offsets = binary_bytes(t["bytes"])
        later = later_windows(in_columns(data, offsets, lead, windows - 1 + LENGTH), LENGTH, windows)
        column = np.arange(windows)[:, None]
        there = (column >= lead) & (column + LENGTH <= lead + np.diff(offsets))
        string, x, count = spans_of(later & there)
        yield batch(LEFT, doc[string], start[string] + x - lead[string], count, pa.nulls(len(string), pa.binary()))
        string, x, count = spans_of(~later & there & split)
        if len(string):
            raw, at = data.tobytes(), offsets[string] + x - lead[string]
            strings = pa.array([raw[s : s + n] for s, n in zip(at.tolist(), (count + LENGTH - 1).tolist(), strict=True)], pa.binary())
            yield batch(LEFT, doc[string], start[string] + x - lead[string], count, strings)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        rows = 0
        cut = None  # the group whose first rows have gone already, or that a mark says to be in pieces

        def take(final: bool) -> Iterator[pa.RecordBatch]:
            """Blocks of whole groups; a group of more rows than a block is cut."""
            nonlocal held, rows, cut
            t = pa.Table.from_batches(held).combine_chunks()
            key, piece = t["key"].to_numpy(), t["piece"].to_numpy()
            mark = t["doc"].is_null().to_numpy()
            begin = np.flatnonzero(np.append(True, (key[1:] != key[:-1]) | (piece[1:] != piece[:-1])))
            told = np.logical_or.reduceat(mark, begin)
            if cut == (key[0], piece[0]):
                told[0] = True
            size = np.diff(np.append(begin, len(key)))
            told[:-1] |= size[:-1] > most
            told[-1] |= size[-1] > most or (not final and size[-1] == len(key))
            of = np.repeat(np.arange(len(begin)), size)
            split = t["split"].to_numpy() | told[of]
            # the last group may go on in the next batch: it waits, unless it fills a block
            end = len(key) if final or told[-1] else int(begin[-1])
            cut = (key[-1], piece[-1]) if end == len(key) and told[-1] else None
            alone = (size[of] == 1) & ~split
            go = np.flatnonzero(~mark & ~alone & (np.arange(len(key)) < end))
            ready = t.set_column(2, "split", pa.array(split)).take(pa.array(go))
            of, lo = of[go], 0
            while lo < len(go):
                hi = min(lo + most, len(go))
                if hi < len(go) and of[hi] == of[hi - 1]:
                    back = int(np.searchsorted(of, of[hi]))
                    hi = back if back > lo else hi
                yield from block(ready.slice(lo, hi - lo))
                lo = hi
            held = t.slice(end).to_batches()
            rows = len(key) - end

        for b in batches:
            held.append(b)
            rows += b.num_rows
            if rows > 4 * most:
                yield from take(False)
        if rows:
            yield from take(True)

    return run


REPORT = "doc long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"


def report(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        rows = []
        for doc, text, places in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), strict=True):
            raw = text.encode("utf-8", "surrogatepass")
            spans = removed_spans(places.values.to_numpy()) if places.is_valid else []
            kept, done = [], 0
            for s, e in spans:
                kept.append(raw[done:s])
                done = e
            kept.append(raw[done:])
            rows.append((doc, len(raw), sum(e - s for s, e in spans), len(spans), hashlib.sha256(b"".join(kept)).hexdigest()))
        columns = list(zip(*rows, strict=True)) or [()] * 5
        yield batch(REPORT, *(pa.array(c, pa.int64()) for c in columns[:4]), pa.array(columns[4], pa.string()))


def removed_spans(places: np.ndarray) -> list[tuple[int, int]]:
    """Maximal byte spans covered by the windows."""
    places = np.sort(places)
    start, end = places >> 16, (places >> 16) + (places & 0xFFFF) - 1 + LENGTH
    reach = np.maximum.accumulate(end)
    new = np.append(True, start[1:] > reach[:-1])
    first = np.flatnonzero(new)
    return list(zip(start[first].tolist(), reach[np.append(first[1:], len(start)) - 1].tolist(), strict=True))


def end_shuffles(spark: SparkSession) -> None:
    """Give up the shuffles of what was staged: the scheduler holds on to its last job, and so to its shuffles, until it has another."""
    spark.range(1).count()
    free_shuffles(spark)


def windows_of_share(base: DataFrame, met: DataFrame, spread: int, block: int) -> Iterator[DataFrame]:
    """(doc, start, count) of each pass over ``met``, all runs of some of the keys: equal windows have equal keys."""
    # a document's list is in proportion to its text
    by_doc = met.groupBy("doc").agg(F.collect_list(F.struct("key", "piece", "split", "place")).alias("runs"))
    strings = base.join(by_doc, "doc").select("doc", "text", "runs").mapInArrow(fetch_bytes, STRINGS)
    for level in range(1 << 10):
        gram = GRAMS[min(level, len(GRAMS) - 1)]
        sorted_strings = strings.repartition("key", "piece").sortWithinPartitions("key", "piece", "doc", "start")
        left = stage(sorted_strings.mapInArrow(compare(gram, block), LEFT), f"windows-{level}")
        end_shuffles(base.sparkSession)
        yield left.filter("bytes IS NULL").select("doc", "start", "count")
        open_runs = left.filter("bytes IS NOT NULL")
        if open_runs.isEmpty():
            break
        strings = open_runs.mapInArrow(recut(GRAMS[min(level + 1, len(GRAMS) - 1)], spread), STRINGS)


def repeated_windows(base: DataFrame, block: int = BLOCK, segment: int = SEGMENT, block_runs: int = BLOCK_RUNS, shares: int = SHARES) -> DataFrame:
    """(doc, start, count): windows of ``base`` (doc, text) that repeat an earlier one. Every row comes from the transform."""
    spread = 4 * int(base.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    cut = base.mapInArrow(cut_runs(spread, segment, block_runs), RUNS).repartition("key", "piece").sortWithinPartitions("key", "piece", "place")
    # written, so that the shuffle before it can be given up while the next ones grow
    met = stage(cut.mapInArrow(meet_runs, RUNS), "runs")
    end_shuffles(base.sparkSession)
    found = [x for k in range(shares) for x in windows_of_share(base, met.filter(F.pmod("key", F.lit(shares)) == k), spread, block)]
    return reduce(lambda a, b: a.unionByName(b), found)


def remove_repeats(docs: DataFrame, block: int = BLOCK, segment: int = SEGMENT, block_runs: int = BLOCK_RUNS) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of each row of ``docs``.

    Texts count as UTF-8 bytes, null as none; texts under LENGTH bytes lose nothing. The order is that of doc_id. If rows
    share a doc_id or have none they are put in the order of doc_id (null first), then text; each is then a document of
    its own, so that a repeated row repeats the first. An empty table gives none. Only doc_id and text are read, so
    further columns can have any name. ``block`` is how many runs a collection has at most, ``segment`` and ``block_runs`` bound
    what a task cuts at once; none of them changes the result.
    """
    base = docs.select(F.col("doc_id").cast("long").alias("doc"), F.coalesce("text", F.lit("")).alias("text"))
    names = None
    if not base.groupBy("doc").agg(F.count("*").alias("n")).filter("n > 1 OR doc IS NULL").isEmpty():
        ordered = stage(base.orderBy(F.col("doc").asc_nulls_first(), "text").withColumn("at", F.monotonically_increasing_id()), "ordered")
        names, base = ordered.select(F.col("at").alias("doc"), F.col("doc").alias("doc_id")), ordered.select(F.col("at").alias("doc"), "text")
    base = base.filter("doc IS NOT NULL")
    places = repeated_windows(base, block, segment, block_runs).groupBy("doc").agg(F.collect_list(F.expr("start * 65536 + count")).alias("places"))
    out = base.join(places, "doc", "left").select("doc", "text", "places").mapInArrow(report, REPORT)
    if names is not None:
        return out.join(names, "doc").select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
    return out.withColumnRenamed("doc", "doc_id")
