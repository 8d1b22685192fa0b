"""Zip archives on any file system that Spark reads, extracted by tasks.

Spark's text source reads the archive in splits as runs of bytes between line ends; their lengths, added up along the splits, say
where each run stands. The driver reads the central directory alone, a line or so a member. Runs go to the task of their
member, in order; a task inflates its members one after the other as a stream and checks each one's length and CRC. Nothing
touches a local disk but Spark's shuffle, and a lost task is run again. Files get their names at the end, by renames; the
target directory appears whole or not at all.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import accumulate

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tideline.sources.files import exists, hadoop_path, remove, rename

#: Fixed values of the format: signatures and sizes of its records.
END, END64, PLACE64, ENTRY, LOCAL = b"PK\x05\x06", b"PK\x06\x06", b"PK\x06\x07", b"PK\x01\x02", b"PK\x03\x04"
STORED, DEFLATED = 0, 8
MOST_TAIL = 22 + 0xFFFF + 20 + 56
RUNS = "at long, data binary"


class BadArchive(ValueError):
    """An archive that isn't one, is damaged, or uses what isn't handled here (encryption, other compressions, parts)."""


@dataclass(frozen=True)
class Member:
    name: str
    at: int
    packed: int
    size: int
    crc: int
    method: int


def runs(spark: SparkSession, path: str) -> tuple[DataFrame, int]:
    """(at, data) of the file's runs of bytes, in no order, and the file's size. A run holds what stands up to and with a line end."""
    lines = spark.read.text(path, lineSep="\n").select(F.col("_metadata.file_block_start").alias("begin"), F.col("value").cast("binary").alias("data"))
    found = lines.groupBy("begin").agg(F.sum(F.octet_length("data").cast("long") + 1).alias("n")).orderBy("begin").collect()  # a row a split
    if not found:
        raise BadArchive(f"{path} is empty")
    system, at = hadoop_path(spark, path)
    size = system.getFileStatus(at).getLen()
    starts = dict(zip((r["begin"] for r in found), accumulate((r["n"] for r in found), initial=0), strict=False))
    shared = spark.sparkContext.broadcast(starts)

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split, at = None, 0
        for b in batches:
            begins = b.column(0).to_numpy()
            sizes = pc.binary_length(b.column(1)).to_numpy().astype(np.int64)
            places, cuts = np.empty(len(begins), np.int64), (np.flatnonzero(np.diff(begins)) + 1).tolist()
            for lo, hi in zip([0, *cuts], [*cuts, len(begins)], strict=True):
                if hi > lo:
                    if begins[lo] != split:
                        split, at = begins[lo], shared.value[int(begins[lo])]
                    ends = at + np.cumsum(sizes[lo:hi] + 1)
                    places[lo:hi] = np.append(at, ends[:-1])
                    at = int(ends[-1])
            yield pa.RecordBatch.from_arrays([pa.array(places), b.column(1)], names=["at", "data"])

    with_ends = F.when(F.col("at") + F.octet_length("data") < size, F.concat("data", F.lit(b"\n"))).otherwise(F.col("data"))
    return lines.mapInArrow(placed, RUNS).withColumn("data", with_ends), size


def between(placed: DataFrame, begin: int, end: int) -> bytes:
    """The bytes of a range, on the driver."""
    rows = placed.filter((F.col("at") < end) & (F.col("at") + F.octet_length("data") > begin)).orderBy("at").collect()
    whole = b"".join(bytes(r["data"]) for r in rows)
    return whole[begin - rows[0]["at"] : end - rows[0]["at"]] if rows else b""


def members(placed: DataFrame, size: int) -> list[Member]:
    """The files that the central directory names, by where they stand."""
    tail_at = max(0, size - MOST_TAIL)
    tail = between(placed, tail_at, size)
    k = tail.rfind(END)
    if k < 0:
        raise BadArchive("there is no end record")
    disk, _, _, count, length, at = struct.unpack_from("<HHHHII", tail, k + 4)
    if at == 0xFFFFFFFF or count == 0xFFFF or length == 0xFFFFFFFF:
        place = tail.rfind(PLACE64, 0, k)
        end64 = struct.unpack_from("<Q", tail, place + 8)[0] - tail_at if place >= 0 else -1
        if end64 < 0 or tail[end64 : end64 + 4] != END64:
            raise BadArchive("the 64-bit end record is missing")
        count, length, at = struct.unpack_from("<QQQ", tail, end64 + 32)
    if disk:
        raise BadArchive("archives in parts aren't read")
    directory, found, p = between(placed, at, at + length), [], 0
    for _ in range(count):
        if directory[p : p + 4] != ENTRY:
            raise BadArchive("the central directory is damaged")
        flags, method, _, _, crc, packed, unpacked, n, extra, comment = struct.unpack_from("<HHHHIIIHHH", directory, p + 8)
        start = struct.unpack_from("<I", directory, p + 42)[0]
        name = directory[p + 46 : p + 46 + n].decode("utf-8" if flags & 0x800 else "cp437")
        packed, unpacked, start = wide(directory[p + 46 + n : p + 46 + n + extra], packed, unpacked, start)
        p += 46 + n + extra + comment
        if name.endswith("/"):
            continue
        if flags & 1 or method not in (STORED, DEFLATED):
            raise BadArchive(f"{name} is encrypted or of compression {method}")
        if name.startswith("/") or "\\" in name or ".." in name.split("/"):
            raise BadArchive(f"{name} leads out of the archive")
        found.append(Member(name, start, packed, unpacked, crc, method))
    return sorted(found, key=lambda m: m.at)


def wide(extra: bytes, packed: int, unpacked: int, start: int) -> tuple[int, int, int]:
    """Sizes and place, from the 64-bit field of ``extra`` where they don't fit."""
    p = 0
    while p + 4 <= len(extra):
        kind, n = struct.unpack_from("<HH", extra, p)
        if kind == 1:
            at = p + 4
            values = []
            for v in (unpacked, packed, start):
                if v == 0xFFFFFFFF:
                    v = struct.unpack_from("<Q", extra, at)[0]
                    at += 8
                values.append(v)
            return values[1], values[0], values[2]
        p += 4 + n
    return packed, unpacked, start


class Inflater:
    """One member as a stream: bytes from its local header on go in, its lines come out."""

    def __init__(self, member: Member) -> None:
        self.m, self.head, self.left = member, b"", None
        self.z = zlib.decompressobj(-15) if member.method == DEFLATED else None
        self.rest, self.size, self.crc = b"", 0, 0

    def add(self, data: bytes) -> list[bytes]:
        if self.left is None:
            self.head += data
            if len(self.head) < 30:
                return []
            if self.head[:4] != LOCAL:
                raise BadArchive(f"{self.m.name} has no local header")
            begin = 30 + sum(struct.unpack_from("<HH", self.head, 26))
            if len(self.head) < begin:
                return []
            data, self.head, self.left = self.head[begin:], b"", self.m.packed
        data = data[: self.left]
        self.left -= len(data)
        plain = self.z.decompress(data) if self.z else data
        self.size, self.crc = self.size + len(plain), zlib.crc32(plain, self.crc)
        *lines, self.rest = (self.rest + plain).split(b"\n")
        return lines

    def end(self) -> list[bytes]:
        plain = self.z.flush() if self.z else b""
        self.size, self.crc = self.size + len(plain), zlib.crc32(plain, self.crc)
        if self.left or self.left is None or self.size != self.m.size or self.crc != self.m.crc:
            raise BadArchive(f"{self.m.name} is damaged")
        lines = (self.rest + plain).split(b"\n")
        return lines if lines[-1] else lines[:-1]


def lines_of(placed: DataFrame, found: list[Member], tasks: int) -> DataFrame:
    """(member, number, line) of all members, which are named by their places in ``found``; a member's lines stand in order in one task."""
    spark = placed.sparkSession
    bounds = np.array([m.at for m in found], np.int64)
    # tasks get members that stand together, of about as many bytes
    packed = np.cumsum([m.packed + 1 for m in found])
    group = np.minimum((packed * tasks // packed[-1]).astype(int), tasks - 1)
    shared = spark.sparkContext.broadcast((found, bounds, group))

    def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        members, bounds, group = shared.value
        for b in batches:
            rows = []
            for at, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                k = max(int(np.searchsorted(bounds, at, "right")) - 1, 0)
                while k < len(bounds) and bounds[k] < at + len(data):  # a run may hold several members' bytes
                    end = int(bounds[k + 1]) if k + 1 < len(bounds) else at + len(data)
                    low, high = max(at, int(bounds[k])), min(at + len(data), end)
                    if low < high:
                        rows.append((int(group[k]), k, low, data[low - at : high - at]))
                    k += 1
            kinds = (pa.int32(), pa.int32(), pa.int64(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(list(zip(*rows, strict=True)) or [()] * 4, kinds, strict=True)], names=["group", "member", "at", "data"])

    def inflated(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        members = shared.value[0]
        member, stream, number = None, None, 0

        def out(lines: list[bytes]) -> Iterator[pa.RecordBatch]:
            nonlocal number
            if lines:
                columns = [pa.array([member] * len(lines), pa.int32()), pa.array(range(number, number + len(lines)), pa.int64()), pa.array(lines, pa.binary())]
                number += len(lines)
                yield pa.RecordBatch.from_arrays(columns, names=["member", "number", "line"])

        for b in batches:
            for k, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if k != member:
                    if stream:
                        yield from out(stream.end())
                    member, stream = k, Inflater(members[k])
                # a member's last run may go on into the directory; the stream takes its own bytes only
                yield from out(stream.add(data))
        if stream:
            yield from out(stream.end())

    runs_by_member = placed.mapInArrow(dealt, "group int, member int, at long, data binary")
    together = runs_by_member.repartition(tasks, "group").sortWithinPartitions("member", "at").select("member", "data")
    # an order that Spark knows of, so that writing by member doesn't sort the lines anew
    return together.mapInArrow(inflated, "member int, number long, line binary").sortWithinPartitions("member", "number")


def extract(spark: SparkSession, archive: str, target: str, tasks: int | None = None) -> list[str]:
    """Extract the files of an archive of text files into the directory ``target``; their names are returned.

    Every line ends in a line end afterwards, the last one too. Nothing happens where ``target`` exists; what an
    extraction that was cut off has left is removed first. BadArchive if the archive can't be read or a file is damaged.
    """
    if exists(spark, target):
        return []
    lines, files = f"{target}.lines", f"{target}.files"
    for left in (lines, files):
        remove(spark, left)
    placed, size = runs(spark, archive)
    found = members(placed, size)
    system, at = hadoop_path(spark, files)
    system.mkdirs(at)
    if found:
        rows = lines_of(placed, found, tasks or min(len(found), 4 * spark.sparkContext.defaultParallelism))
        rows.select("member", F.col("line").cast("string").alias("value")).write.partitionBy("member").option("lineSep", "\n").text(lines)
    for k, m in enumerate(found):
        name = f"{files}/{m.name}"
        system.mkdirs(hadoop_path(spark, name.rpartition("/")[0])[1])
        if m.size:
            parts = [s.getPath() for s in system.listStatus(hadoop_path(spark, f"{lines}/member={k}")[1]) if s.getPath().getName().startswith("part-")]
            system.rename(parts[0], hadoop_path(spark, name)[1])
        else:
            system.create(hadoop_path(spark, name)[1], True).close()
    rename(spark, files, target)
    remove(spark, lines)
    return [m.name for m in found]
