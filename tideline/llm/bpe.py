"""Byte-level BPE encoding and decoding through a lexicon of frequent words.

Words are counted over all documents; the most frequent ones (at most ``most_words``, which bounds the file and what the
driver compiles) are merged once and compiled with their ids into a minimal acyclic transducer (lexicon.py). Its file
stands in the shared folder; Spark hands a copy to each executor, where tasks map it into memory. Encoding cuts texts into
words by character classes, in numpy, and looks all of a slice's words up at once; words that aren't there are merged by
the vocabulary's own rules, so the lexicon decides the time and never the ids. Rows are encoded where they stand.
"""

from __future__ import annotations

import heapq
import json
import re
import uuid
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import lexicon
from .common import checkpoint_root, stage

MOST_WORDS = 1 << 17
#: Words of a task that are counted before they are handed on.
COUNTED = 1 << 17
#: Code points that are cut into words at once, and rows that are turned into Python's strings at once.
SLICE, ROWS = 1 << 18, 256
LETTER, NUMBER, SPACE, OTHER, BREAK = range(5)
LONG_WORD = 256
NEVER = 1 << 62


def byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in byte-level vocabularies: printable Latin-1 for itself, the others from U+0100 on, in order."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


@dataclass(frozen=True)
class Vocabulary:
    """Tokens' bytes by id, merges as {left << 32 | right: rank}, and as sorted pairs with their ranks, the id that each rank
    makes, ids of single bytes, and special tokens."""

    tokens: tuple[bytes | None, ...]
    ranks: dict[int, int]
    pairs: np.ndarray
    pair_ranks: np.ndarray
    made: np.ndarray
    single: np.ndarray
    special: dict[str, int]


@lru_cache(2)
def vocabulary(path: str) -> Vocabulary:
    """A byte-level BPE vocabulary of the tokenizers library; ValueError if it has parts that aren't handled here."""
    with open(path, encoding="utf-8") as f:
        whole = json.load(f)
    model, before = whole["model"], whole.get("pre_tokenizer") or {}
    odd = [k for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges") if model.get(k)]
    odd += [k for t in whole["added_tokens"] for k in ("single_word", "lstrip", "rstrip") if t.get(k)]
    if model["type"] != "BPE" or whole.get("normalizer") or before.get("type") != "ByteLevel" or before.get("add_prefix_space") or not before.get("use_regex", True) or whole["decoder"]["type"] != "ByteLevel" or odd:
        raise ValueError(f"{path} isn't a plain byte-level BPE vocabulary: {', '.join(odd) or 'other parts'}")
    letters, ids = byte_letters(), model["vocab"]
    special = {t["content"]: t["id"] for t in whole["added_tokens"]}
    tokens: list[bytes | None] = [None] * (1 + max([*ids.values(), *special.values()]))
    for t, k in ids.items():
        tokens[k] = bytes(letters[c] for c in t)
    for t, k in special.items():
        tokens[k] = t.encode()
    pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
    ranks: dict[int, int] = {}
    for rank, (a, b) in enumerate(pairs):
        ranks[ids[a] << 32 | ids[b]] = rank
    single = np.array([ids[c] for c, _ in sorted(letters.items(), key=lambda x: x[1])])
    known = np.array(sorted(ranks.items()), np.int64).reshape(-1, 2)
    return Vocabulary(tuple(tokens), ranks, known[:, 0].copy(), known[:, 1].copy(), np.array([ids[a + b] for a, b in pairs]), single, special)


def rank_of(v: Vocabulary, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """The ranks of pairs of ids, NEVER for those that don't merge."""
    if not len(v.pairs):
        return np.full(len(left), NEVER)
    pair = left << 32 | right
    at = np.minimum(np.searchsorted(v.pairs, pair), len(v.pairs) - 1)
    return np.where(v.pairs[at] == pair, v.pair_ranks[at], NEVER)


def merged_all(v: Vocabulary, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(ids of the words data[start:end] one after the other, how many each has).

    In a round every word merges one pair, that of the lowest rank, the leftmost of them; words without such a pair are
    done. Words over LONG_WORD bytes are merged by themselves.
    """
    size = end - start
    out: list[tuple[np.ndarray, np.ndarray]] = []  # (words in order, their ids)
    for k in np.flatnonzero(size > LONG_WORD):
        made = np.array(merged_long(v, v.single[data[start[k] : end[k]]].tolist()), np.int64)
        out.append((np.full(len(made), k), made))
    short = np.flatnonzero(size <= LONG_WORD)
    size = size[short]
    ends = np.cumsum(size)
    word = np.repeat(short, size)
    ids = v.single[data[np.repeat(start[short] - (ends - size), size) + np.arange(len(word))]]
    ranks = np.full(len(ids), NEVER)
    inner = np.flatnonzero(word[1:] == word[:-1])
    ranks[inner] = rank_of(v, ids[inner], ids[inner + 1])
    while len(ids):
        first = np.flatnonzero(np.append(True, word[1:] != word[:-1]))
        length = np.diff(np.append(first, len(ids)))
        least = np.repeat(np.minimum.reduceat(ranks, first), length)
        done = least == NEVER
        if done.any():
            out.append((word[done], ids[done]))
            going = ~done
            word, ids, ranks, least = word[going], ids[going], ranks[going], least[going]
            if not len(ids):
                break
        at = np.flatnonzero(ranks == least)
        at = at[np.append(True, word[at][1:] != word[at][:-1])]
        ids[at] = v.made[ranks[at]]
        keep = np.ones(len(ids), bool)
        keep[at + 1] = False
        at -= np.arange(len(at))
        word, ids, ranks = word[keep], ids[keep], ranks[keep]
        ranks[at] = NEVER
        for changed in (at[at > 0] - 1, at[at < len(ids) - 1]):
            changed = changed[word[changed] == word[changed + 1]]
            ranks[changed] = rank_of(v, ids[changed], ids[changed + 1])
    if not out:
        return np.empty(0, np.int64), np.zeros(len(start), np.int64)
    word, ids = (np.concatenate(x) for x in zip(*out, strict=True))
    return ids[np.argsort(word, kind="stable")], np.bincount(word, minlength=len(start))


def merged_long(v: Vocabulary, ids: list[int]) -> list[int]:
    """The same for one word, by a heap of pairs over a linked list: n log n for a word of n bytes."""
    n = len(ids)
    after, before = [*range(1, n), -1], [-1, *range(n - 1)]
    rank = v.ranks.get
    heap = [(r, i) for i in range(n - 1) if (r := rank(ids[i] << 32 | ids[i + 1])) is not None]
    heapq.heapify(heap)
    made = v.made.tolist()
    while heap:
        r, i = heapq.heappop(heap)
        j = after[i]
        if ids[i] < 0 or j < 0 or rank(ids[i] << 32 | ids[j]) != r:
            continue
        ids[i], ids[j] = made[r], -1
        after[i] = k = after[j]
        if k >= 0:
            before[k] = i
            if (r := rank(ids[i] << 32 | ids[k])) is not None:
                heapq.heappush(heap, (r, i))
        if (k := before[i]) >= 0 and (r := rank(ids[k] << 32 | ids[i])) is not None:
            heapq.heappush(heap, (r, k))
    return [x for x in ids if x >= 0]


@lru_cache(1)
def classes() -> np.ndarray:
    """LETTER, NUMBER, SPACE or OTHER of every code point, as the tokenizers library's own expressions see them."""
    from tokenizers import Regex
    from tokenizers.pre_tokenizers import Split

    out = np.full(0x110000, OTHER, np.uint8)
    points = np.concatenate([np.arange(0xD800), np.arange(0xE000, 0x110000)]).astype(np.uint32)
    for kind, pattern in ((LETTER, r"\p{L}+"), (NUMBER, r"\p{N}+"), (SPACE, r"\s+")):
        rest = Split(Regex(pattern), "removed")
        for lo in range(0, len(points), 1 << 16):
            some = points[lo : lo + (1 << 16)]
            hit = np.ones(len(some), bool)
            for _, (a, b) in rest.pre_tokenize_str(some.tobytes().decode("utf-32-le")):
                hit[a:b] = False
            out[some[hit]] = kind
    return out


def cut(parts: list[str], kinds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(bytes of all parts, starts, ends, number of words a part): words by the byte-level pattern.

    ``kinds`` is classes(). A word is a short contraction ('s 't 're 've 'm 'll 'd), or letters, digits or other signs with at most one space
    before them, or white space up to the last one before something else. Every part is cut by itself.
    """
    lengths = np.array([len(p) for p in parts], np.int64)
    joined = "".join(parts)
    stops = np.cumsum(lengths + 1) - 1
    point = np.zeros(int(lengths.sum()) + len(parts), np.uint32)
    inside = np.ones(len(point), bool)
    inside[stops] = False
    point[inside] = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
    kind = kinds.take(point)
    kind[stops] = BREAK
    first = np.ones(len(point), bool)
    first[1:] = kind[1:] != kind[:-1]
    first[stops] = True
    start = first.copy()
    words = np.flatnonzero(first & (kind != SPACE) & (kind != BREAK))
    words = words[words > 0]
    white = words[kind[words - 1] == SPACE]
    start[white - 1] = True
    attached = white[point[white - 1] == 32]
    start[attached] = False
    quotes = np.flatnonzero(start & (point == 39) & (kind == OTHER))
    if len(quotes):
        one, two = point[quotes + 1], point[np.minimum(quotes + 2, len(point) - 1)]
        short = np.isin(one, [ord(c) for c in "stmd"])
        long = (two == ord("e")) & ((one == ord("r")) | (one == ord("v"))) | (one == ord("l")) & (two == ord("l"))
        at = quotes[short | long]
        start[at + 1] = False
        start[at + np.where(short[short | long], 2, 3)] = True
    wide = 1 + (point > 0x7F).astype(np.int64) + (point > 0x7FF) + (point > 0xFFFF)
    wide[stops] = 0
    place = np.concatenate([[0], np.cumsum(wide)])
    begin = np.flatnonzero(start)
    end = np.append(begin[1:], len(point))
    real = kind[begin] != BREAK
    counts = np.bincount(np.searchsorted(stops, begin[real]), minlength=len(parts))
    return np.frombuffer(joined.encode(), np.uint8), place[begin[real]], place[end[real]], counts


SAFE = re.compile(r"(?<=\S)(?=\s)")


def pieces(text: str, special: re.Pattern | None, most: int = SLICE) -> Iterator[tuple[str, bool]]:
    """Parts of a text that are cut into words apart, and whether it is a special token.

    Beyond ``most`` code points a part ends where white space follows something else, which begins a word whatever stands around it.
    """
    for k, part in enumerate(special.split(text) if special else [text]):
        if k % 2 or len(part) <= most:
            if part:
                yield part, k % 2 == 1
            continue
        at = 0
        while at < len(part):
            found = SAFE.search(part, min(at + most, len(part)))
            stop = found.start() if found else len(part)
            yield part[at:stop], False
            at = stop


def specials(v: Vocabulary) -> re.Pattern | None:
    return re.compile(f"({'|'.join(map(re.escape, sorted(v.special, key=len, reverse=True)))})") if v.special else None


def sliced(texts: Iterator[str], special: re.Pattern | None) -> Iterator[list[tuple[int, str, bool]]]:
    """(number of the text, part, whether special) in lists of about SLICE code points."""
    held: list[tuple[int, str, bool]] = []
    size = 0
    for k, text in enumerate(texts):
        for part, is_special in pieces(text, special):
            held.append((k, part, is_special))
            size += len(part)
            if size >= SLICE:
                yield held
                held, size = [], 0
    if held:
        yield held


def rows_at_once(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for lo in range(0, b.num_rows, ROWS):
            yield b.slice(lo, ROWS)


def word_counts(docs: DataFrame, vocabulary_path: str, text: str = "text") -> DataFrame:
    """word binary and n: how often each word occurs in all texts. Tasks hand on sums, a row a word."""

    shared = docs.sparkSession.sparkContext.broadcast(classes())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        special, counts = specials(vocabulary(vocabulary_path)), Counter()
        for b in rows_at_once(batches):
            for some in sliced((str(t) for t in b.column(0)), special):
                parts = [p for _, p, is_special in some if not is_special]
                if parts:
                    data, start, end, _ = cut(parts, shared.value)
                    raw = data.tobytes()
                    counts.update([raw[a:b] for a, b in zip(start.tolist(), end.tolist(), strict=True)])
                if len(counts) >= COUNTED:
                    yield pa.RecordBatch.from_arrays([pa.array(counts.keys(), pa.binary()), pa.array(counts.values(), pa.int64())], names=["word", "n"])
                    counts = Counter()
        yield pa.RecordBatch.from_arrays([pa.array(list(counts), pa.binary()), pa.array(list(counts.values()), pa.int64())], names=["word", "n"])

    partial = docs.select(F.coalesce(F.col(text), F.lit("")).alias("text")).mapInArrow(run, "word binary, n long")
    return partial.groupBy("word").agg(F.sum("n").alias("n"))


def compiled(v: Vocabulary, words: list[bytes]) -> dict[str, np.ndarray]:
    """The transducer's arrays, with ids and bounds: number k below the vocabulary's size is that id by itself, each further one a list of ids."""
    size = len(v.tokens)
    ends = np.cumsum([len(w) for w in words], dtype=np.int64)
    ids, count = merged_all(v, np.frombuffer(b"".join(words), np.uint8), np.append(0, ends[:-1])[: len(words)], ends)
    several = count > 1
    first = np.cumsum(count) - count
    number = np.where(several, size - 1 + np.cumsum(several), ids[first])
    bounds = np.concatenate([np.arange(size + 1), size + np.cumsum(count[several])])
    ids = np.concatenate([np.arange(size), ids[np.repeat(several, count)]])
    arrays = lexicon.compiled(zip(words, number.tolist(), strict=True))
    return arrays | {"ids": ids.astype(np.int32), "bounds": bounds.astype(np.int64), "classes": classes()}


@dataclass(frozen=True)
class Lexicon:
    """The name of a compiled lexicon's file among the files that Spark hands to its executors, and the vocabulary's path."""

    file: str
    vocabulary: str
    words: int


def build(docs: DataFrame, vocabulary_path: str, text: str = "text", most_words: int = MOST_WORDS) -> Lexicon:
    """The most frequent words of all texts, compiled and handed to the executors.

    Words come by classes of frequency (a sixteenth of an octave each), as many whole classes from the top as hold
    ``most_words`` words at most; so the driver never gets more. A table without words gives a lexicon without words.
    """
    spark = docs.sparkSession
    counts = stage(word_counts(docs, vocabulary_path, text), "lexicon-words")
    by_class = counts.withColumn("class", F.floor(F.log2("n") * 16))
    least, room = None, most_words
    for r in sorted(by_class.groupBy("class").count().collect(), reverse=True):  # a thousand classes at most
        if r["count"] > room:
            break
        least, room = r["class"], room - r["count"]
    words = [] if least is None else [bytes(r[0]) for r in by_class.filter(F.col("class") >= least).select("word").collect()]
    blob = lexicon.to_bytes(compiled(vocabulary(vocabulary_path), words))
    name = f"lexicon-{uuid.uuid4().hex}.bin"
    path = f"{checkpoint_root(spark)}/tideline/{name}"
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    files = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    out = files.create(at, True)
    try:
        out.write(bytearray(blob))
    finally:
        out.close()
    spark.sparkContext.addFile(files.makeQualified(at).toString())
    return Lexicon(name, vocabulary_path, len(words))


@lru_cache(2)
def _opened(path: str) -> dict[str, np.ndarray]:
    return lexicon.mapped(path)


class Encoder:
    """Texts to ids in a task; words that the lexicon lacks are merged, those of a slice at once."""

    def __init__(self, arrays: dict[str, np.ndarray], v: Vocabulary) -> None:
        self.arrays, self.v, self.special = arrays, v, specials(v)

    def parts(self, parts: list[str]) -> list[np.ndarray]:
        data, start, end, counts = cut(parts, self.arrays["classes"])
        number = lexicon.find(self.arrays, data, start, end)
        ids, bounds = self.arrays["ids"], self.arrays["bounds"]
        unseen = np.flatnonzero(number < 0)
        first, size = bounds[number], bounds[number + 1] - bounds[number]
        if len(unseen):
            raw, places = data.tobytes(), {}
            words = [raw[a:b] for a, b in zip(start[unseen].tolist(), end[unseen].tolist(), strict=True)]
            which = np.array([places.setdefault(w, len(places)) for w in words])
            each = np.flatnonzero(np.diff(np.maximum.accumulate(which), prepend=-1))
            more, count = merged_all(self.v, data, start[unseen[each]], end[unseen[each]])
            begin = len(ids) + np.cumsum(count) - count
            first[unseen], size[unseen] = begin[which], count[which]
            ids = np.concatenate([ids, more.astype(np.int32)])
        ends = np.cumsum(size)
        flat = ids[np.repeat(first - (ends - size), size) + np.arange(ends[-1] if len(ends) else 0)].astype("<u4")
        stops = np.concatenate([[0], ends])[np.concatenate([[0], np.cumsum(counts)])]
        return [flat[a:b] for a, b in zip(stops[:-1], stops[1:], strict=True)]

    def encode(self, texts: list[str]) -> list[bytes]:
        """Each text's ids as little-endian unsigned 32-bit integers."""
        out: list[list[bytes]] = [[] for _ in texts]
        for some in sliced(iter(texts), self.special):
            plain = iter(self.parts([p for _, p, is_special in some if not is_special]))
            for k, part, is_special in some:
                out[k].append(self.v.special[part].to_bytes(4, "little") if is_special else next(plain).tobytes())
        return [b"".join(x) for x in out]


def encode(docs: DataFrame, lexicon_: Lexicon, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The id column and ``ids`` binary: each text's ids as little-endian unsigned 32-bit integers, special tokens among them.

    A null text is empty and has no ids. Rows that repeat give equal rows; other columns are left out, whatever their names.
    """
    file, path = lexicon_.file, lexicon_.vocabulary

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = Encoder(_opened(SparkFiles.get(file)), vocabulary(path))
        for b in rows_at_once(batches):
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(coder.encode([str(t) for t in b.column(1)]), pa.binary())], names=[doc_id, "ids"])

    picked = docs.select(F.col(doc_id), F.coalesce(F.col(text), F.lit("")).alias("text"))
    return picked.mapInArrow(run, f"`{doc_id}` {docs.schema[doc_id].dataType.simpleString()}, ids binary")


def decode(encoded: DataFrame, vocabulary_path: str, ids: str = "ids") -> DataFrame:
    """``encoded`` with ``decoded``: the text of the ids, special tokens kept. Unknown ids are left out, bytes that aren't
    UTF-8 become U+FFFD, null ids give null."""
    at = encoded.columns.index(ids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary(vocabulary_path)
        token = [t or b"" for t in v.tokens]
        for b in rows_at_once(batches):
            texts = []
            for x in b.column(at).to_pylist():
                if x is None:
                    texts.append(None)
                    continue
                numbers = np.frombuffer(x, "<u4")
                if len(numbers) and int(numbers.max()) >= len(token):
                    numbers = numbers[numbers < len(token)]
                texts.append(b"".join([token[k] for k in numbers.tolist()]).decode("utf-8", "replace"))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(texts, pa.string())], names=[*b.schema.names, "decoded"])

    schema = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in encoded.schema)
    return encoded.mapInArrow(run, schema + "decoded string")
