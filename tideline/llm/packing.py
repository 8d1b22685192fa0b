"""Sum-of-squares online packing of tokenised documents into fixed windows.

A document's full windows stand alone; its remainder goes, online, to the fill level at which the sum of the squared
counts of partly filled windows grows least (ties: the fullest level). Counts live in a level array, one entry a fill.
When a partition's documents end, its open windows are emptied into each other by cutting remainders, so that a
partition leaves one partly filled window at most. Tokenising, placing and cutting happen in the task that reads the
documents: no shuffle, and memory is the open windows of that task.
"""

from __future__ import annotations

import base64
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
END_ID = 1
#: tiktoken's pattern goes back over a run of white space character by character and panics on one of a million.
LONG_WHITE = 50_000


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def encoder(vocabulary: str):
    """A function from texts to lists of ids for a ``.json`` vocabulary of tokenizers.

    A byte-level BPE whose ranks lie beside it as ``.tiktoken`` gives the same ids through those about four times as
    fast; a text that holds the string of a special token or a run of LONG_WHITE white-space characters keeps to tokenizers.
    """
    import os

    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    from tokenizers import Tokenizer

    slow = Tokenizer.from_file(vocabulary)
    ranks_file = vocabulary.removesuffix(".json") + ".tiktoken"
    if not os.path.exists(ranks_file):
        return lambda texts: [e.ids for e in slow.encode_batch_fast(texts, add_special_tokens=False)]
    import public_tokenizers
    import tiktoken

    with open(ranks_file, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    fast = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    special = [t.content for t in slow.get_added_tokens_decoder().values()]

    run = re.compile(r"\s{%d}" % LONG_WHITE)

    def slowly(text: str) -> bool:
        return any(s in text for s in special) or (len(text) >= LONG_WHITE and run.search(text) is not None)

    def encode(texts: list[str]) -> list[list[int]]:
        return [
            slow.encode(t, add_special_tokens=False).ids if slowly(t) else fast.encode_ordinary(t)
            for t in texts
        ]

    return encode


class LevelPacker:
    """Open windows by fill level. A piece is (doc_id, start, ids, doc_tokens); a window is a list of pieces."""

    def __init__(self, window: int) -> None:
        self.window = window
        self.count = np.zeros(window + 1, np.int64)
        self.open: dict[int, list[list[tuple]]] = {}

    def level_for(self, size: int) -> int:
        """The level to add ``size`` to: least growth of the sum of squares, then the fullest."""
        n, w = self.count, self.window
        cost = 2 * (n[size:] - n[: w - size + 1]) + 2
        cost[0] = 2 * n[size] + 1
        cost[-1] = -2 * n[w - size] + 1
        cost[1:][n[1 : w - size + 1] == 0] = np.iinfo(np.int64).max
        return len(cost) - 1 - int(np.argmin(cost[::-1]))

    def place(self, piece: tuple) -> list[tuple] | None:
        """Add a piece of fewer ids than a window; returns the window if that fills it."""
        size = len(piece[2])
        level = self.level_for(size)
        window = self.open[level].pop() if level else []
        self.count[level] -= level > 0
        window.append(piece)
        if level + size == self.window:
            return window
        self.count[level + size] += 1
        self.open.setdefault(level + size, []).append(window)
        return None

    def flush(self) -> Iterator[list[tuple]]:
        """Empty the least filled windows into the fullest, cutting where a gap ends."""
        rest = [(level, w) for level in sorted(self.open) for w in self.open[level]]
        low, high = 0, len(rest) - 1
        while low < high:
            level, window = rest[high]
            while level < self.window and low < high:
                donor = rest[low][1]
                doc, start, ids, total = donor.pop()
                room = self.window - level
                window.append((doc, start, ids[:room], total))
                level += min(room, len(ids))
                if len(ids) > room:
                    donor.append((doc, start + room, ids[room:], total))
                if not donor:
                    low += 1
            rest[high] = (level, window)
            if level == self.window:
                yield window
                high -= 1
        if low == high:
            yield rest[low][1]


def _rows(windows: list[list[tuple]], first: int) -> pa.RecordBatch:
    out: list[list[int]] = [[] for _ in range(7)]
    for k, window in enumerate(windows):
        offset = 0
        for doc, start, ids, total in window:
            for column, value in zip(out, (doc, start, len(ids), zlib.crc32(ids.tobytes()), total, first + k, offset), strict=True):
                column.append(value)
            offset += len(ids)
    names = [x.split()[0] for x in SCHEMA.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in out], names=names)


def pack(docs: DataFrame, window: int = 2048, vocabulary: str | None = None) -> DataFrame:
    """Pieces of every document in windows of ``window`` ids.

    A document is its text's ids, then the end id 1; null and empty texts are the end id alone. Every row is packed:
    rows that repeat or share a doc_id are packed each by itself, a null doc_id stays null. A text longer than a
    window fills whole windows first. ``sequence_id`` is unique over the table (the partition's number in its high
    bits); a partition's last window may be short, and is the only one that needs padding. An empty table gives none.
    """
    vocabulary = vocabulary or default_vocabulary()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, packer = encoder(vocabulary), LevelPacker(window)
        base = TaskContext.get().partitionId() << 40
        made = 0
        for batch in batches:
            full: list[list[tuple]] = []
            ids_of, texts = batch.column(0).to_pylist(), batch.column(1)
            for lo in range(0, len(ids_of), 64):
                for doc, ids in zip(ids_of[lo : lo + 64], encode(texts.slice(lo, 64).to_pylist()), strict=True):
                    ids.append(END_ID)
                    ids = np.array(ids, "<u4")
                    whole = len(ids) // window * window
                    full += [[(doc, s, ids[s : s + window], len(ids))] for s in range(0, whole, window)]
                    if whole < len(ids) and (done := packer.place((doc, whole, ids[whole:].copy(), len(ids)))):
                        full.append(done)
            yield _rows(full, base + made)
            made += len(full)
        rest = list(packer.flush())
        if rest:
            yield _rows(rest, base + made)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).mapInArrow(run, SCHEMA)
