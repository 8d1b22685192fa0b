"""Shared pieces of the text operators: the shared staging folder, joins on skewed keys, Arrow text buffers, hashing in numpy.

The rolling hashes here are routes and filters only: structured strings can share one, so no operator takes equal hashes
for equal strings without looking at the strings.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A key is hot when it holds more than one in HOT_KEYS of a table's rows: fewer than HOT_KEYS keys do, at every size.
HOT_KEYS = 2000
GOLDEN = np.uint64(0x9E3779B97F4A7C15)
SLICE_BYTES = 1 << 20


def checkpoint_root(spark: SparkSession) -> str:
    """The folder all executors share, as the session names it in ``spark.checkpoint.dir``.

    Only a local session may lack the setting; it then gets a folder of its own.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that every executor can reach")
        root = tempfile.mkdtemp(prefix="tideline-")
        spark.conf.set("spark.checkpoint.dir", root)
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(root)
    return root


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back: lineage ends here, lost executors lose nothing."""
    spark = df.sparkSession
    path = f"{checkpoint_root(spark)}/tideline/{name}-{uuid.uuid4().hex}"
    schema = df.schema
    df.write.parquet(path)
    free_shuffles(spark)
    return spark.read.schema(schema).parquet(path)


def free_shuffles(spark: SparkSession) -> None:
    """Let the driver's JVM collect its garbage: shuffle files go when nothing refers to their shuffle any more, and a driver
    with memory to spare may not look for hours. Called where lineage ends."""
    spark.sparkContext._jvm.System.gc()


def hot_bound(rows: int) -> int:
    """A key with more rows than this is hot: fewer than HOT_KEYS keys are, and none that a task wouldn't notice."""
    return max(1000, rows // HOT_KEYS)


def join_hot(left: DataFrame, right: DataFrame, key: str, count: str = "n", sizes: tuple[int, int] | None = None) -> DataFrame:
    """``left`` joined with ``right``, which has one narrow row a key and in ``count`` the key's number of rows in ``left``.

    Hot keys join by broadcast, where their rows stand: they are fewer than HOT_KEYS. The others are shuffled. ``sizes`` is
    (all rows, rows of the largest key), where known. ``left`` may be read twice, so it should be a written table.
    """
    if sizes is None:
        sizes = tuple(right.agg(F.sum(count), F.max(count)).first())
    bound = hot_bound(sizes[0] or 0)
    if (sizes[1] or 0) <= bound:
        return left.join(right, key)
    hot, cold = F.broadcast(right.filter(F.col(count) > bound)), right.filter(F.col(count) <= bound)
    return left.join(hot, key).unionByName(left.join(hot.select(key), key, "left_anti").join(cold, key))


def hot_keys(df: DataFrame, key: str) -> dict:
    """Into how many pieces to deal each hot key's rows. Fewer than HOT_KEYS entries."""
    counts = df.groupBy(key).agg(F.count("*").alias("n"))
    rows, most = counts.agg(F.sum("n"), F.max("n")).first()
    bound = hot_bound(rows or 0)
    return {r[0]: -(-r[1] // bound) for r in counts.filter(F.col("n") > bound).collect()} if (most or 0) > bound else {}


def deal(df: DataFrame, key: str, pieces: dict, by: str | None) -> DataFrame:
    """``df`` with ``piece``: rows of a hot key are dealt over its pieces by a hash of ``by``, or, without ``by``, copied to each."""
    if not pieces:
        return df.withColumn("piece", F.lit(0))
    known = df.sparkSession.createDataFrame(list(pieces.items()), f"`{key}` {df.schema[key].dataType.simpleString()}, pieces int")
    df = df.join(F.broadcast(known), key, "left")
    many = F.coalesce("pieces", F.lit(1))
    piece = F.pmod(F.xxhash64(by), many).cast("int") if by else F.explode(F.sequence(F.lit(0), many - 1))
    return df.withColumn("piece", piece).drop("pieces")


def column_at(df: DataFrame, name: str) -> int:
    """Where the column stands; case doesn't count, as in Spark."""
    return [c.lower() for c in df.columns].index(name)


def text_bytes(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and row offsets of a string column, without copying rows; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.fill_null("") if column.null_count else column
    column = column.cast(pa.large_string())
    if len(column) == 0:
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    whole = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
    return whole[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(offsets: np.ndarray, most: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Runs of rows of about ``most`` bytes, so that numpy's temporaries stay small; a longer row is a run by itself."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + most, "right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (xor-shift and multiply), so that every output bit depends on every input bit."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def random_table(n: int, seed: int) -> np.ndarray:
    """n fixed pseudo-random 64-bit values."""
    with np.errstate(over="ignore"):
        return mix((np.arange(1, n + 1, dtype=np.uint64) + np.uint64(seed * 7919)) * GOLDEN)


BYTE_TABLE = random_table(256, 1)
BASE = np.uint64(0x2545F4914F6CDD1D)
INVERSE = np.uint64(pow(int(BASE), -1, 1 << 64))


class Powers:
    """Powers of BASE and of its inverse modulo 2**64, grown on demand."""

    def __init__(self) -> None:
        self.up = self.down = np.ones(1, np.uint64)

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n + 1:
            size = max(n + 1, 2 * len(self.up))
            with np.errstate(over="ignore"):
                self.up = np.cumprod(np.concatenate([[np.uint64(1)], np.full(size, BASE, np.uint64)]), dtype=np.uint64)
                self.down = np.cumprod(np.concatenate([[np.uint64(1)], np.full(size, INVERSE, np.uint64)]), dtype=np.uint64)
        return self.up, self.down


POWERS = Powers()


def prefix_hash(data: np.ndarray) -> np.ndarray:
    """Prefix sums of the bytes' table values times powers of BASE; ``span_hash`` turns two of them into a hash."""
    up, _ = POWERS.upto(len(data))
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(BYTE_TABLE[data] * up[: len(data)], out=out[1:])
    return out


def span_hash(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of the byte spans [start, end), equal for equal spans wherever they stand; different spans may share one."""
    _, down = POWERS.upto(len(prefix))
    return mix((prefix[end] - prefix[start]) * down[start] + (end - start).astype(np.uint64) * GOLDEN)
