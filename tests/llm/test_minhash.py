from __future__ import annotations

import random
import re

import pytest

from tideline.llm import minhash
from tideline.llm.queries import op3_near_duplicates


def shingles(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", low)
    if not words:
        return frozenset()
    return frozenset(tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))) if len(words) >= 5 else frozenset([tuple(words)])


def brute(texts, percent=85):
    """(doc, n_shingles, component, kept) of every row, by comparing all pairs."""
    sets, parent = [shingles(t) for _, t in texts], {d: d for d, _ in texts}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            if 100 * min(len(a), len(sets[j])) < percent * max(len(a), len(sets[j])):
                continue
            common = len(a & sets[j])
            if common and 100 * common >= percent * (len(a) + len(sets[j]) - common):
                x, y = root(texts[i][0]), root(texts[j][0])
                parent[max(x, y)] = min(x, y)
    return sorted((d, len(s), root(d), root(d) == d) for (d, _), s in zip(texts, sets, strict=True))


def got(df):
    return sorted(tuple(r) for r in df.select("doc_id", "n_shingles", "component_id", "kept").collect())


def test_whole_table_against_all_pairs(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").toPandas()
    assert got(op3_near_duplicates(spark, sf_dir)) == brute(list(docs.itertuples(index=False, name=None)))


def test_chains_and_thresholds(spark):
    r = random.Random(4)
    words = [f"w{i}" for i in range(400)]
    texts = []
    for base in range(12):
        text = r.choices(words, k=r.choice([5, 9, 40, 120, 300]))
        for _ in range(12):  # chains: each copy is edited a little more
            texts.append((len(texts) + 1, " ".join(text)))
            if r.random() < 0.7:
                text = text[:]
                text[r.randrange(len(text))] = r.choice(words)
    r.shuffle(texts)
    df = spark.createDataFrame(texts, "doc_id long, text string")
    assert got(minhash.near_duplicates(df)) == brute(texts)


def test_one_very_large_group(spark):
    """More near copies than a block holds, so that blocks are paired too."""
    r = random.Random(5)
    base = [f"w{i}" for i in range(60)]
    texts = []
    for i in range(1300):
        words = base[:]
        words[r.randrange(60)] = f"x{i}"
        texts.append((i, " ".join(words)))
    df = spark.createDataFrame(texts, "doc_id long, text string")
    assert got(minhash.near_duplicates(df)) == brute(texts)


EDGES = [
    (1, None), (2, ""), (3, " \t\n"), (4, "one two"), (5, "ONE  two"), (6, "one two three"), (7, "a\x1cb c d e f"), (8, "a\x1cb c d e f "), (9, "É x y z w"), (10, "é x y z w"),
    (11, "long " * 20_000), (12, "long " * 10_000), (13, "one two"),
]


def test_edge_cases(spark):
    df = spark.createDataFrame([(d, t, 7, "x") for d, t in EDGES], "doc_id long, text string, component_id int, node string")
    assert got(minhash.near_duplicates(df)) == brute(EDGES)
    assert minhash.near_duplicates(df.limit(0)).count() == 0


def test_repeated_rows_and_missing_ids(spark):
    df = spark.createDataFrame([(1, "a b c d e"), (1, "a b c d e"), (2, "a b c d e"), (None, "a b c d e"), (3, "z")], "doc_id long, text string")
    out = sorted(map(tuple, minhash.near_duplicates(df).select("doc_id", "component_id", "kept").collect()), key=str)
    assert out == sorted([(1, 1, True), (1, 1, True), (2, 1, False), (None, None, True), (3, 3, True)], key=str)
    assert sorted((r["doc_id"] or 0) for r in minhash.keep_one(df).collect()) == [0, 1, 3]


@pytest.mark.parametrize("size", [1, 2, 50, 5000])
def test_every_coordinate_fills(size):
    import numpy as np

    s = np.random.default_rng(size).integers(0, 1 << 63, size, dtype=np.uint64)
    assert minhash.sketch(np.unique(s)).max() < 1 << 63


def test_sketch_estimates_similarity():
    import numpy as np

    r = np.random.default_rng(3)
    a = r.integers(0, 1 << 63, 1000, dtype=np.uint64)
    for share in (0.5, 0.85):
        k = int(1000 * 2 * share / (1 + share))
        b = np.concatenate([a[:k], r.integers(0, 1 << 63, 1000 - k, dtype=np.uint64)])
        same = (minhash.sketch(np.unique(a)) == minhash.sketch(np.unique(b))).mean()
        assert abs(same - share) < 0.15


def parity_word(n, letters="ab"):
    """Letters chosen by the parity of a number's set bits: such words and their swaps share polynomial hashes modulo 2**64."""
    return "".join(letters[bin(i).count("1") & 1] for i in range(n))


def test_structured_words_are_told_apart(spark):
    texts = []
    for size in (512, 1024, 2048, 4096):
        a, b = parity_word(size), parity_word(size, "ba")
        texts += [(len(texts) + k, t) for k, t in enumerate((a, b, f"x {a} y z w", f"x {b} y z w", " ".join([a, b] * 4), " ".join([b, a] * 4), f"{a} {b} {a} {a} {b} {b}", f"{b} {a} {b} {b} {a} {a}"))]
    df = spark.createDataFrame(texts, "doc_id long, text string")
    assert got(minhash.near_duplicates(df)) == brute(texts)


def test_exact_sets_do_not_overflow():
    """Numbers of shingles of very many different words are made anew on the way."""
    import numpy as np

    r = random.Random(6)
    texts = [" ".join(f"w{r.randrange(60_000)}" for _ in range(60_000)) for _ in range(2)]
    texts.append(texts[0][: len(texts[0]) // 2])
    raw = [t.encode() for t in texts]
    sets = minhash.exact_sets(np.frombuffer(b"".join(raw), np.uint8), np.concatenate([[0], np.cumsum([len(x) for x in raw])]))
    want = [shingles(t) for t in texts]
    assert [len(s) for s in sets] == [len(w) for w in want]
    assert len(np.intersect1d(sets[0], sets[2])) == len(want[0] & want[2])


def test_one_doc_id_with_two_texts_links_their_groups(spark):
    rows = [(1, "a b c d e f"), (5, "a b c d e f"), (5, "u v w x y z"), (7, "u v w x y z"), (9, "u v w x y z")]
    out = {(r["doc_id"], r["component_id"]) for r in minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert out == {(1, 1), (5, 1), (7, 1), (9, 1)}
