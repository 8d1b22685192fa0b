"""Quoted CSV of any size, read in splits.

A quoted line end can stand anywhere, so a split can't know by itself where its first record begins. A first scan says of each
split how it ends, inside or outside a quoted field, for either way that it may begin; followed along a file, that gives
every split's beginning. A second scan cuts records by the parity of quotes alone, what a split holds of a record that began
before it is joined to it, and Spark's own CSV parser makes fields of the records.

A record has MOST_CHARS characters at most. One that is longer, or that is still open where its file ends, is a quote that
was never closed: its first line is rejected, and reading goes on with the line after it.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MOST_CHARS = 1 << 24
OPTIONS = {"quote": '"', "escape": '"', "multiLine": "true", "maxCharsPerColumn": "-1"}


def ends_inside(line: str, inside: bool) -> bool:
    """Whether a line ends within a quoted field, by how it began. A quote opens a field only as its first character."""
    if '"' not in line:
        return inside
    at = 0
    while True:
        if not inside:
            if line[at : at + 1] != '"':
                at = line.find(",", at)
                if at < 0:
                    return False
                at += 1
                continue
            at += 1
        at = line.find('"', at)
        if at < 0:
            return True
        at += 1
        if line[at : at + 1] == '"':
            inside, at = True, at + 1
            continue
        inside, at = False, line.find(",", at)
        if at < 0:
            return False
        at += 1


class Cutter:
    """Lines of one split into records. ``first`` says that no record has ended yet and the split began inside one.

    add() and reject_open() return what is done: (kind, number of its first line, text), where kind is "whole", "tail" (the end
    of a record that began before the split) or "reject".
    """

    def __init__(self, inside: bool, most: int) -> None:
        self.inside, self.most, self.first, self.number = inside, most, inside, 0
        self.open: list[str] = []
        self.size = 0

    def add(self, line: str) -> list[tuple[str, int, str]]:
        self.open.append(line)
        self.size += len(line) + 1
        self.number += 1
        self.inside = ends_inside(line, self.inside)
        if not self.inside:
            done = ("tail" if self.first else "whole", self.number - len(self.open), "\n".join(self.open))
            self.open, self.size, self.first = [], 0, False
            return [done]
        return self.reject_open() if self.size > self.most else []

    def reject_open(self) -> list[tuple[str, int, str]]:
        """The open record's first line is rejected, and those after it are read from outside. An open tail has no first line here."""
        lines = self.open
        self.number -= len(lines)
        self.open, self.size, self.inside = [], 0, False
        out = []
        if self.first:
            self.first = False
        else:
            out.append(("reject", self.number, lines[0]))
            self.number += 1
            lines = lines[1:]
        for line in lines:
            out += self.add(line)
        return out


@dataclass
class Split:
    """Of a split by the first scan: where it begins, its characters, and by how it begins (outside, inside) whether it ends inside
    and how many characters its open record then has; ``closes`` is where the first record ends, if it begins inside."""

    begin: int
    ends: tuple[bool, bool]
    open: tuple[int, int]
    closes: int | None


@dataclass
class Layout:
    """What the second scan has to know of the first: one entry a split and a file, as many as the scan has tasks and files."""

    #: Where the record began that a split begins within.
    opener: dict[tuple[str, int], int] = field(default_factory=dict)
    #: Splits whose last record is never closed.
    unclosed: set[tuple[str, int]] = field(default_factory=set)
    base: dict[str, int] = field(default_factory=dict)
    names: dict[str, int] = field(default_factory=dict)
    headers: list[tuple[str, ...]] = field(default_factory=list)


def runs_of_splits(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, int, int, list[str]]]:
    """(file, where the split begins, the file's size, lines) in order; a split may come in several runs."""
    for batch in batches:
        files, begins, sizes, lines = (c.to_pylist() for c in batch.columns)
        lo = 0
        while lo < len(lines):
            hi = lo + 1
            while hi < len(lines) and begins[hi] == begins[lo] and files[hi] == files[lo]:
                hi += 1
            yield files[lo], begins[lo], sizes[lo], lines[lo:hi]
            lo = hi


SPLITS = "file string, begin long, size long, ends_outside boolean, ends_inside boolean, open_outside long, open_inside long, closes long, header string"
KINDS = (pa.string(), pa.int64(), pa.int64(), pa.bool_(), pa.bool_(), pa.int64(), pa.int64(), pa.int64(), pa.string())


def ways_through(most: int):
    """Rows of SPLITS; the header is a file's first record, where its first split holds all of it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done: dict[tuple[str, int], list] = {}
        for file, begin, size, lines in runs_of_splits(batches):
            row = done.setdefault((file, begin), [size, Cutter(False, most), Cutter(True, most), None, None, 0])
            for line in lines:
                found = row[1].add(line)
                if begin == 0 and row[4] is None and found:
                    row[4] = found[0][2]
                row[2].add(line)
                row[5] += len(line) + 1
                if row[3] is None and not row[2].first:
                    row[3] = row[5]
        rows = [(file, begin, size, a.inside, b.inside, a.size, b.size, closes, header) for (file, begin), (size, a, b, closes, header, _) in done.items()]
        columns = list(zip(*rows, strict=True)) or [()] * len(KINDS)
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, KINDS, strict=True)], names=[x.split()[0] for x in SPLITS.split(", ")])

    return run


def followed(splits: list[Split], most: int) -> tuple[dict[int, int], set[int]]:
    """(opener by split, unclosed splits) of one file, whose splits stand in order; splits are named by where they begin."""
    opener: dict[int, int] = {}
    unclosed: set[int] = set()
    k, since, size = 0, None, 0  # the place of the split that the open record began in, and its characters so far
    while True:
        runaway = k == len(splits) and since is not None
        if not runaway and k < len(splits) and since is not None:
            size += splits[k].closes if splits[k].closes is not None else splits[k].open[1]
            runaway = size > most
        if runaway:  # its first line is rejected, and the splits after it begin outside
            unclosed.add(splits[since].begin)
            for s in splits[since + 1 : k + 1]:
                opener.pop(s.begin, None)
            k, since, size = since + 1, None, 0
        if k == len(splits):
            return opener, unclosed
        s = splits[k]
        if since is None:
            if s.ends[0] and s.begin not in unclosed:
                since, size = k, s.open[0]
        else:
            opener[s.begin] = splits[since].begin
            if s.closes is not None:
                since, size = (k, s.open[1]) if s.ends[1] and s.begin not in unclosed else (None, 0)
        k += 1


def layout(rows: list, most: int) -> Layout:
    out, base, by_file = Layout(), 0, {}
    for r in sorted(rows, key=lambda r: (r["file"], r["begin"])):
        if r["file"] not in by_file:
            out.base[r["file"]], base = base, base + r["size"] + 1
        by_file.setdefault(r["file"], []).append(Split(r["begin"], (r["ends_outside"], r["ends_inside"]), (r["open_outside"], r["open_inside"]), r["closes"]))
    for file, splits in by_file.items():
        opener, unclosed = followed(splits, most)
        out.opener |= {(file, k): v for k, v in opener.items()}
        out.unclosed |= {(file, k) for k in unclosed}
    return out


def header_names(record: str) -> tuple[str, ...]:
    """The columns that a header names, without case."""
    out, at = [], 0
    record = record.removeprefix("﻿").removesuffix("\r")
    while True:
        if record[at : at + 1] == '"':
            end = at + 1
            while (end := record.find('"', end)) >= 0 and record[end + 1 : end + 2] == '"':
                end += 2
            end = len(record) if end < 0 else end
            out.append(record[at + 1 : end].replace('""', '"'))
            at = end
        else:
            out.append(record[at : (record.find(",", at) + 1 or len(record) + 1) - 1])
        comma = record.find(",", at)
        if comma < 0:
            return tuple(x.strip().lower() for x in out)
        at = comma + 1


PIECES = "file string, opener long, begin long, at long, kind string, head int, text string"


def read_records(spark: SparkSession, path: str, columns: tuple[str, ...], most: int = MOST_CHARS) -> DataFrame:
    """The named columns as strings by each file's own header, ``_file`` (its name), ``_at``, which grows along files and rows,
    and ``_reject``: the line that a quote opened for good, null for records.

    A column that a file lacks, and an empty field, is null; names are compared without case. Files are taken in the order
    of their paths. Two parallel scans, and a third for the few pieces of records that lie over splits.
    """
    lines = spark.read.text(path, lineSep="\n").select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("begin"), F.col("_metadata.file_size").alias("size"), F.coalesce("value", F.lit("")).alias("line"))
    rows = lines.mapInArrow(ways_through(most), SPLITS).collect()
    known = layout(rows, most)
    known.headers = sorted({header_names(r["header"]) for r in rows if r["header"] is not None})
    known.names = {r["file"]: known.headers.index(header_names(r["header"])) for r in rows if r["header"] is not None}
    if not known.base:
        raise FileNotFoundError(path)
    shared = spark.sparkContext.broadcast(known)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Whole records, rejects, and the pieces of records that lie over splits: open, any number of middle ones, tail."""
        split, cutter, out = None, None, []
        kinds = (pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int32(), pa.string())

        def table() -> pa.RecordBatch:
            made = pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(list(zip(*out, strict=True)) or [()] * len(kinds), kinds, strict=True)], names=[x.split()[0] for x in PIECES.split(", ")])
            out.clear()
            return made

        def put(found: list[tuple[str, int, str]]) -> None:
            file, begin = split
            for kind, number, text in found:
                if begin == 0 and number == 0 and kind == "whole":
                    continue  # the header
                opener = shared.value.opener.get(split, begin) if kind in ("tail", "middle") else begin
                text = text if kind in ("open", "middle") else text.removesuffix("\r")
                if text or kind != "whole":
                    out.append((file, opener, begin, shared.value.base[file] + begin + number + (begin > 0), kind, shared.value.names.get(file, 0), text))

        def close() -> None:
            while cutter.open:
                if split not in shared.value.unclosed:
                    if cutter.first:  # a record goes through the whole split
                        put([("middle", 0, "\n".join(cutter.open))])
                    else:
                        put([("open", cutter.number - len(cutter.open), "\n".join(cutter.open))])
                    return
                put(cutter.reject_open())

        for file, begin, _, some in runs_of_splits(batches):
            if (file, begin) != split:
                if split is not None:
                    close()
                split = (file, begin)
                cutter = Cutter(split in shared.value.opener, most)
            for line in some:
                put(cutter.add(line))
                if len(out) > 5000:
                    yield table()
        if split is not None:
            close()
        yield table()

    made = lines.mapInArrow(cut, PIECES)
    # a record's pieces, one a split, have ``most`` characters together
    over = made.filter(F.col("kind").isin("open", "middle", "tail")).groupBy("file", "opener").agg(F.array_sort(F.collect_list(F.struct("begin", F.col("kind") == "open", "at", "text", "head"))).alias("p"))
    over = over.select("file", F.get("p.at", F.lit(0)).alias("at"), F.lit("whole").alias("kind"), F.get("p.head", F.lit(0)).alias("head"), F.array_join("p.text", "\n").alias("text"))
    every = made.filter(F.col("kind").isin("whole", "reject")).select(*over.columns).unionByName(over)
    width = max((len(h) for h in known.headers), default=1)
    fields = F.from_csv("text", ", ".join(f"c{k} string" for k in range(width)), OPTIONS)
    place = [[h.index(c.lower()) if c.lower() in h else -1 for h in known.headers] or [-1] for c in columns]

    def value(places: list[int]):
        own = [F.nullif(F.col(f"f.c{k}"), F.lit("")) if k >= 0 else F.lit(None).cast("string") for k in places]
        return own[0] if len(set(places)) == 1 else F.coalesce(*[F.when(F.col("head") == h, v) for h, v in enumerate(own)])

    good = F.col("kind") != "reject"
    parsed = every.withColumn("f", F.when(good, fields))
    return parsed.select(*[value(p).alias(c) for c, p in zip(columns, place, strict=True)], F.element_at(F.split("file", "/"), -1).alias("_file"), F.col("at").alias("_at"), F.when(~good, F.col("text")).alias("_reject"))
