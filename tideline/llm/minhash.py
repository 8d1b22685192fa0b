"""Near-duplicate documents: fast similarity sketches, banding, exact verification on full shingle sets.

A sketch has one coordinate a bin. In round i < T every shingle hashes to a bin and bids (i, hash); in round T + i all
shingles bid for bin i. A bin keeps its least bid, and rounds end once every bin has one, at the latest after 2 T. Bands
of coordinates are the candidate buckets. Equal shingle sets are one class from the start. In each bucket all classes
are first held against its first one; then only classes that still lie in different components are paired, in blocks of
bounded size. Every link is confirmed on the full shingle sets of both texts.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import GOLDEN, POWERS, checkpoint_root, deal, free_shuffles, hot_bound, hot_keys, join_hot, mix, slices, stage, text_bytes

BANDS, ROWS = 32, 6
COORDINATES = BANDS * ROWS
BLOCK, BLOCK_SHINGLES = 512, 400_000
DENSE = 4
LONG_WORD = 256
LOW_BYTES = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)
WHITE = np.zeros(256, bool)
WHITE[[9, 10, 11, 12, 13, 32]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
SALTS = (np.arange(1, 2 * COORDINATES + 1, dtype=np.uint64) * GOLDEN).reshape(-1, 1)
LOW = np.uint64(0xFFFFFFFF)


@dataclass
class Words:
    """A-Z lower-cased words between ASCII white space: the rows' bytes, each word's span, where each row's words begin."""

    data: np.ndarray
    start: np.ndarray
    end: np.ndarray
    cuts: np.ndarray
    inside: np.ndarray


def words_of(data: np.ndarray, offsets: np.ndarray) -> Words:
    data = LOWER[data]
    inside = ~WHITE[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets[:-1]] = True
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1] | edge[1 : len(data)]
    last[:-1] &= ~inside[1:] | edge[1 : len(data)]
    start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    return Words(data, start, end, np.searchsorted(start, offsets), inside)


def word_hashes(found: Words) -> np.ndarray:
    """64-bit hashes of the words, eight bytes at a time through ``mix``; very long ones by a digest."""
    size = found.end - found.start
    padded = np.concatenate([found.data, np.zeros(8, np.uint8)])
    eight = np.ndarray(len(found.data) + 1, "<u8", padded, strides=(1,))
    h = size.astype(np.uint64) * GOLDEN
    live, at = np.flatnonzero(size <= LONG_WORD), 0
    while len(live):
        lane = eight[found.start[live] + at] & LOW_BYTES[np.minimum(size[live] - at, 8)]
        h[live] = mix(h[live] ^ lane) + GOLDEN
        at += 8
        live = live[size[live] > at]
    for k in np.flatnonzero(size > LONG_WORD).tolist():
        h[k] = int.from_bytes(hashlib.blake2b(found.data[found.start[k] : found.end[k]].tobytes(), digest_size=8).digest(), "little")
    return h


def plain_texts(found: Words, offsets: np.ndarray) -> Iterator[bytes]:
    """Each row's words with one space between them."""
    kept = found.inside.copy()
    kept[found.end[found.end < len(found.data)]] = True
    before = np.concatenate([[0], np.cumsum(kept)])[offsets].tolist()
    plain = np.where(found.inside, found.data, np.uint8(32))[kept].tobytes()
    for i, j in zip(before[:-1], before[1:], strict=True):
        yield plain[i:j].strip(b" ")


def hashed_sets(found: Words, words: int = 5) -> list[np.ndarray]:
    """Sorted 64-bit hashes of each row's different shingles.

    With fewer words the whole sequence is one shingle; without words there is none.
    """
    word = word_hashes(found)
    up, _ = POWERS.upto(words + 1)
    n = len(word) - words + 1
    rolled = mix(sum((word[k : k + n] * up[words - k] for k in range(words)), np.zeros(n, np.uint64))) if n > 0 else None
    out = []
    for a, b in zip(found.cuts[:-1].tolist(), found.cuts[1:].tolist(), strict=True):
        if b - a >= words:
            out.append(np.unique(rolled[a : b - words + 1]))
        elif b > a:
            out.append(np.frombuffer(hashlib.blake2b(word[a:b].tobytes(), digest_size=8).digest(), np.uint64))
        else:
            out.append(np.empty(0, np.uint64))
    return out


def exact_sets(data: np.ndarray, offsets: np.ndarray, words: int = 5) -> list[np.ndarray]:
    """Sorted numbers of each row's different shingles; within a call two numbers agree exactly where all words do."""
    found = words_of(data, offsets)
    bounds = np.concatenate([[0], np.cumsum(found.end - found.start)])
    packed = pa.Array.from_buffers(pa.large_binary(), len(found.start), [None, pa.py_buffer(bounds), pa.py_buffer(found.data[found.inside])])
    coded = packed.dictionary_encode()
    code, size = coded.indices.to_numpy().astype(np.int64), max(1, len(coded.dictionary))
    number, bound = code, size
    for k in range(1, words):
        if bound * size >= 1 << 62:  # the products would overflow: number the prefixes anew
            number = np.unique(number, return_inverse=True)[1].astype(np.int64)
            bound = int(number.max(initial=0)) + 1
        number, bound = number[:-1] * size + code[k:], bound * size
    short: dict[tuple, int] = {}
    out = []
    for a, b in zip(found.cuts[:-1].tolist(), found.cuts[1:].tolist(), strict=True):
        if b - a >= words:
            out.append(np.unique(number[a : b - words + 1]))
        elif b > a:
            out.append(np.array([short.setdefault(tuple(code[a:b].tolist()), -1 - len(short))]))
        else:
            out.append(np.empty(0, np.int64))
    return out


def sketch(shingles: np.ndarray) -> np.ndarray:
    """The COORDINATES least bids of a set that isn't empty."""
    t = np.uint64(COORDINATES)
    least = np.full(COORDINATES, np.iinfo(np.uint64).max)
    step = max(1, 4096 // len(shingles)) if len(shingles) < 400 else 1
    for lo in range(0, 2 * COORDINATES, step):
        rounds = np.arange(lo, min(lo + step, 2 * COORDINATES))
        z = mix(shingles[None, :] + SALTS[rounds])
        bins = np.where(rounds[:, None] < COORDINATES, ((z >> np.uint64(32)) * t >> np.uint64(32)).astype(np.int64), rounds[:, None] - COORDINATES)
        np.minimum.at(least, bins.ravel(), ((z & LOW) | (rounds[:, None].astype(np.uint64) << np.uint64(32))).ravel())
        if least.max() < 1 << 63:
            break
    return least


def sketches(docs: DataFrame, words: int = 5) -> DataFrame:
    """doc_id, n_shingles, digest (of the whole word sequence), bands array<long>, sketch (16 bits a coordinate)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        up, _ = POWERS.upto(ROWS + 1)
        for batch in batches:
            data, offsets = text_bytes(batch.column(1))
            sizes, digests, bands, kept = [], [], [], []
            for i, j in slices(offsets):
                cuts = offsets[i : j + 1] - offsets[i]
                found = words_of(data[offsets[i] : offsets[j]], cuts)
                for s, plain in zip(hashed_sets(found, words), plain_texts(found, cuts), strict=True):
                    sizes.append(len(s))
                    if not len(s):
                        digests.append(None)
                        bands.append(None)
                        kept.append(None)
                        continue
                    c = sketch(s)
                    digests.append(hashlib.blake2b(plain, digest_size=32).digest())
                    key = mix((c.reshape(BANDS, ROWS) * up[1 : ROWS + 1]).sum(1, dtype=np.uint64) + np.arange(BANDS, dtype=np.uint64) * GOLDEN)
                    bands.append(key.view(np.int64))
                    kept.append(mix(c).astype(np.uint16).tobytes())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(sizes, pa.int64()), pa.array(digests, pa.binary()), pa.array(bands, pa.list_(pa.int64())), pa.array(kept, pa.binary())],
                names=["doc_id", "n_shingles", "digest", "bands", "sketch"],
            )

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, n_shingles long, digest binary, bands array<long>, sketch binary")


def verify(pairs: DataFrame, texts: DataFrame, percent: int, words: int = 5) -> DataFrame:
    """The pairs (a, b) whose full shingle sets have 100 * intersection >= percent * union, held against each other word by word.

    A node that stands in many pairs as ``a`` has its pairs dealt over pieces, each with a copy of its text. ``pairs`` is
    read more than once, so it should be a written table.
    """
    hubs = hot_keys(pairs, "a")
    right = texts.select(F.col("node").alias("b"), F.col("text").alias("text_b"))
    left = deal(texts.select(F.col("node").alias("a"), F.col("text").alias("text_a")), "a", hubs, None)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = np.zeros(batch.num_rows, bool)
            (da, oa), (db, ob) = text_bytes(batch.column(2)), text_bytes(batch.column(3))
            for i, j in slices(oa + ob):
                data = np.concatenate([da[oa[i] : oa[j]], db[ob[i] : ob[j]]])
                sets = exact_sets(data, np.concatenate([oa[i : j + 1] - oa[i], oa[j] - oa[i] + ob[i + 1 : j + 1] - ob[i]]), words)
                for k, (x, y) in enumerate(zip(sets[: j - i], sets[j - i :], strict=True)):
                    common = len(np.intersect1d(x, y, True))
                    keep[i + k] = 100 * common >= percent * (len(x) + len(y) - common) and common > 0
            yield batch.select(["a", "b"]).filter(pa.array(keep))

    joined = deal(pairs.select("a", "b"), "a", hubs, "b").join(right, "b").join(left, ["a", "piece"]).select("a", "b", "text_a", "text_b")
    return joined.mapInArrow(run, "a long, b long")


def components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(node, component): the smallest node that each node reaches over the edges (a, b).

    Each round a node takes the least label among its own, its neighbours' and its label's label; labels are written to
    the checkpoint folder every round, and rounds end when none changes. Nodes of very many edges and labels of very
    many nodes are hot keys of a round's joins.
    """
    checkpoint_root(nodes.sparkSession)
    both = edges.select(F.col("a").alias("node"), F.col("b").alias("other")).unionByName(edges.select(F.col("b").alias("node"), F.col("a").alias("other"))).distinct().checkpoint()
    hubs = hot_keys(both, "other")
    both = deal(both, "other", hubs, "node")
    labels = nodes.select("node", F.col("node").alias("component")).checkpoint()
    sizes = (0, 0)
    while True:
        told = deal(labels.select(F.col("node").alias("other"), "component"), "other", hubs, None)
        heard = both.join(told, ["other", "piece"]).groupBy("node").agg(F.min("component").alias("heard"))
        hop = labels.select(F.col("node").alias("component"), F.col("component").alias("hop"))
        if sizes[1]:  # counts are needed only to tell hot labels apart
            hop = hop.join(labels.groupBy("component").agg(F.count("*").alias("n")), "component")
        hopped = join_hot(labels, hop, "component", sizes=sizes).select("node", F.col("component").alias("old"), "hop")
        labels = hopped.join(heard, "node", "left").select("node", "old", F.least("old", "hop", F.coalesce("heard", "old")).alias("component")).checkpoint()
        rows, most, changed = labels.groupBy("component").agg(F.count("*").alias("n"), F.count_if(F.col("old") != F.col("component")).alias("changed")).agg(F.sum("n"), F.max("n"), F.sum("changed")).first()
        labels = labels.select("node", "component")
        free_shuffles(labels.sparkSession)
        if not changed:
            return labels
        sizes = (rows, most) if most > hot_bound(rows) else (0, 0)


def spanning_links(linked: np.ndarray) -> tuple[list[int], list[int]]:
    """Edges of a spanning forest of a symmetric boolean matrix: as few links as keep what is connected connected."""
    a, b = [], []
    todo = np.ones(len(linked), bool)
    for root in range(len(linked)):
        front, todo[root] = [root] if todo[root] else [], False
        while front:
            at = front.pop()
            found = np.flatnonzero(linked[at] & todo)
            todo[found] = False
            front += found.tolist()
            a += [at] * len(found)
            b += found.tolist()
    return a, b


def common_counts(sets: list[np.ndarray], columns: int = 4096) -> np.ndarray:
    """Sizes of the intersections of all pairs of sets, as products of membership matrices of ``columns`` elements each."""
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    _, element, many = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = np.cumsum(many > 1) - 1
    keep = many[element] > 1
    owner, element = owner[keep], shared[element[keep]]
    order = np.argsort(element, kind="stable")
    owner, element = owner[order], element[order]
    out = np.zeros((len(sets), len(sets)), np.float32)
    for lo in range(0, int(element[-1]) + 1 if len(element) else 0, columns):
        i, j = np.searchsorted(element, [lo, lo + columns])
        member = np.zeros((len(sets), columns), np.float32)
        member[owner[i:j], element[i:j] - lo] = 1
        out += member @ member.T
    return out


def block_links(buckets: DataFrame, kept: DataFrame, texts: DataFrame, percent: int, words: int = 5) -> DataFrame:
    """Links (a, b) that connect what the buckets' rows of different components connect.

    ``buckets``: key, node, n, component; ``kept``: node, n, sketch, joined to the rows of buckets that aren't connected yet alone.
    A bucket's rows are dealt into chunks of about BLOCK; each pair of chunks
    is a group of bounded size. Sketches rule a pair out when they agree in fewer coordinates than similar sets do but
    once in tens of millions of times (five and a half standard deviations). A group names the pairs left if they are
    few, and they are verified one by one. A group with more than DENSE pairs a row is verified as a whole, in one task that
    holds its texts, and gives a spanning forest of its links instead of all of them.
    """
    share = percent / 100
    least = int(COORDINATES * share - 5.5 * (COORDINATES * share * (1 - share)) ** 0.5)
    # bands that hold the same rows are one bucket; long sets make smaller chunks
    size = buckets.groupBy("key").agg(F.count("*").alias("m"), F.sum("n").alias("all"), F.min("component").alias("lo"), F.max("component").alias("hi"), F.sum(F.xxhash64("node").cast("decimal(38,0)")).alias("sig"), F.min("node").alias("head"))
    chunks = F.ceil(F.greatest(F.col("m") / BLOCK, F.col("all") / BLOCK_SHINGLES)).cast("int")
    size = size.filter("lo <> hi").groupBy("m", "all", "sig", "head").agg(F.min("key").alias("key")).select("key", "m", F.least(chunks, F.col("m").cast("int")).alias("chunks"))
    rows = join_hot(buckets, size, "key", "m").join(kept, ["node", "n"]).withColumn("chunk", F.pmod(F.xxhash64("node", F.lit(3)), F.col("chunks")).cast("int"))
    rows = rows.withColumn("with", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    rows = rows.select("node", "n", "component", "sketch", "key", F.least("chunk", "with").alias("i"), F.greatest("chunk", "with").alias("j"), "chunk")

    def likely(group: pa.Table) -> np.ndarray:
        """Pairs of the group, a row for each of its rows, that sizes, components and sketches leave."""
        n, comp, chunk = (group[c].to_numpy() for c in ("n", "component", "chunk"))
        sk = np.stack([np.frombuffer(x, np.uint16) for x in group["sketch"].to_pylist()])
        one = group["i"][0].as_py() == group["j"][0].as_py()
        out = np.zeros((len(n), len(n)), bool)
        for k in range(len(n)):
            fit = (comp != comp[k]) & (np.minimum(n, n[k]) * 100 >= percent * np.maximum(n, n[k]))
            if not one:
                fit &= chunk != chunk[k]
            near = np.flatnonzero(fit)
            out[k, near[(sk[near] == sk[k]).sum(1) >= least]] = True
        return out

    def name_pairs(group: pa.Table) -> pa.Table:
        node, pairs = group["node"].to_numpy(), likely(group)
        at = group.select(["key", "i", "j"]).slice(0, 1)
        if pairs.sum() > 2 * DENSE * len(node):
            return at.append_column("a", pa.nulls(1, pa.int64())).append_column("b", pa.nulls(1, pa.int64()))
        x, y = np.nonzero(pairs & (node[:, None] < node))
        return at.take(pa.array(np.zeros(len(x), np.int64))).append_column("a", pa.array(node[x], pa.int64())).append_column("b", pa.array(node[y], pa.int64()))

    def verify_group(group: pa.Table) -> pa.Table:
        node, pairs = group["node"].to_numpy(), likely(group)
        sets = exact_sets(*text_bytes(group["text"]), words)
        sizes = np.array([len(s) for s in sets])
        common = common_counts(sets)
        pairs &= 100 * common >= percent * (sizes[:, None] + sizes - common)
        x, y = spanning_links(pairs)
        return pa.table({"a": pa.array(node[x], pa.int64()), "b": pa.array(node[y], pa.int64())})

    named = stage(rows.groupBy("key", "i", "j").applyInArrow(name_pairs, "key long, i int, j int, a long, b long"), "pairs")
    single = verify(stage(named.filter("a IS NOT NULL").select("a", "b").distinct(), "pairs"), texts, percent, words)
    dense = rows.join(named.filter("a IS NULL").select("key", "i", "j"), ["key", "i", "j"]).join(texts, "node")
    whole = dense.select(*rows.columns, "text").groupBy("key", "i", "j").applyInArrow(verify_group, "a long, b long")
    return single.unionByName(whole)


def near_duplicates(docs: DataFrame, percent: int = 85, words: int = 5) -> DataFrame:
    """doc_id, n_shingles, component_id (smallest doc_id reached over links), kept (doc_id = component_id) of each row.

    Null and empty texts have no shingles and no links. Rows that share a doc_id are one node: a link of any of their
    texts is a link of that node. A row without doc_id links with nothing, has a null component and is kept. Ties need no
    rule. An empty table gives none. Only doc_id and text are read, so further columns can have any name.
    """
    made = stage(sketches(docs, words), "sketches")
    linked = made.filter("doc_id IS NOT NULL AND digest IS NOT NULL")
    # texts of one word sequence are one class, named by its smallest doc_id; one text of each goes on
    classes = stage(linked.groupBy("digest").agg(F.min("doc_id").alias("node"), F.count("*").alias("n")), "classes")
    reps = linked.join(classes.select("digest", F.col("node").alias("doc_id")), ["digest", "doc_id"]).dropDuplicates(["digest", "doc_id"])
    reps = stage(reps.select("digest", F.col("doc_id").alias("node"), F.col("n_shingles").alias("n"), "bands", "sketch"), "representatives")
    # a doc_id with texts of several classes links them
    several = linked.groupBy("doc_id").agg(F.count("*").alias("rows")).filter("rows > 1").select("doc_id")
    several = linked.select("doc_id", "digest").join(several, "doc_id").distinct().join(classes.select("digest", "node"), "digest")
    equal = several.select(F.col("doc_id").alias("a"), F.col("node").alias("b")).filter("a <> b").distinct()
    banded = reps.select("node", "n", F.explode("bands").alias("key"))
    full = stage(banded.groupBy("key").agg(F.min("node").alias("head"), F.max("node").alias("tail"), F.count("*").alias("m")).filter("head <> tail").drop("tail"), "buckets")
    buckets = stage(join_hot(banded, full, "key", "m").drop("m"), "buckets")
    nodes = stage(buckets.select("node").distinct(), "candidates")
    # a bound on the two sizes holds for every link, whichever of the two is the larger
    met = stage(buckets.select(F.col("head").alias("a"), F.col("node").alias("b"), F.col("n").alias("n_b")).filter("a <> b").distinct(), "met")
    heads = met.groupBy("a").agg(F.count("*").alias("n")).join(reps.groupBy(F.col("node").alias("a")).agg(F.min("n").alias("lo"), F.max("n").alias("hi")), "a")
    pairs = stage(join_hot(met, heads, "a").filter(f"100 * hi >= {percent} * n_b AND 100 * n_b >= {percent} * lo").select("a", "b").distinct(), "pairs")
    texts = docs.select(F.col("doc_id").cast("long").alias("node"), F.col("text").cast("string").alias("text")).filter("text IS NOT NULL").join(nodes, "node", "left_semi")
    texts = stage(texts.withColumn("h", F.sha2("text", 256)).dropDuplicates(["node", "h"]).drop("h"), "candidate-texts")
    first = stage(verify(pairs, texts, percent, words), "links")
    labels = components(nodes, first)
    dealt = stage(buckets.select("key", "node", "n").join(labels, "node"), "dealt")
    more = stage(block_links(dealt, reps.select("node", "n", "sketch"), texts, percent, words), "links")
    links = stage(first.unionByName(more).unionByName(equal).distinct(), "links")
    ends = links.select(F.col("a").alias("node")).unionByName(links.select(F.col("b").alias("node"))).distinct()
    reached = components(ends, links)
    named = stage(classes.join(reached, "node", "left").select("digest", "n", F.coalesce("component", "node").alias("component_id")), "named")
    out = join_hot(linked.select("digest", "doc_id", "n_shingles"), named, "digest").select("doc_id", "n_shingles", "component_id")
    rest = made.filter("doc_id IS NULL OR digest IS NULL").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    return out.unionByName(rest).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def keep_one(docs: DataFrame, percent: int = 85, words: int = 5) -> DataFrame:
    """The rows of ``docs`` that near_duplicates() keeps: the smallest doc_id of each group, its repeated rows once.

    Rows without doc_id all stay.
    """
    kept = near_duplicates(docs, percent, words).filter("kept AND doc_id IS NOT NULL").select("doc_id").distinct()
    return docs.filter("doc_id IS NOT NULL").join(kept, "doc_id", "left_semi").select(docs.columns).dropDuplicates().unionByName(docs.filter("doc_id IS NULL"))
