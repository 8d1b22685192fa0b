from __future__ import annotations

import hashlib
import random

import numpy as np
import pytest
from tokenizers import Tokenizer

from tideline.llm import bpe, lexicon, packing, queries

PATH = packing.default_vocabulary()
BITS = ["'", "s", "ll", "re", " ", "  ", "\n", "\t", "a", "Z", "é", "ü", "1", "²", "٣", "!", "...", " ", " ", "日本", "😀", "\x85", "\x1c", "​", "<|endoftext|>", "'T", "'d", "'ve", "_", "́", "﻿"]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def coder(words):
    v = bpe.vocabulary(PATH)
    return bpe.Encoder(bpe.compiled(v, words), v)


def ids_of(encoder, texts):
    return [np.frombuffer(x, "<u4").tolist() for x in encoder.encode(texts)]


def drawn(seed, n, most=30):
    r = random.Random(seed)
    return ["".join(r.choice(BITS) for _ in range(r.randint(0, most))) for _ in range(n)]


@pytest.mark.parametrize("words", [[], [b" the"], [b"a", b" a", b"re", "日本".encode(), b"...", b" alls", b"Zalls", b"ll"]])
def test_ids_are_the_librarys(library, words):
    texts = drawn(len(words), 800)
    assert ids_of(coder(words), texts) == [library.encode(t, add_special_tokens=False).ids for t in texts]


def test_every_code_point_is_cut_as_the_library_does(library):
    points = [chr(k) for k in range(0x110000) if not 0xD800 <= k < 0xE000]
    texts = [x.join(points[lo : lo + 4000]) for lo in range(0, len(points), 4000) for x in (" ", "x", "")]
    encoder = coder([])
    assert ids_of(encoder, texts) == [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]


def test_long_texts(library):
    r = random.Random(1)
    texts = ["a" * 300 + " " + "ab" * 5000, " " * 1_500_000 + "x", "x y" * 500_000, "\n" * 1000, "".join(r.choice("abcdefgh") for _ in range(20_000)), ("x" * 99 + "<|endoftext|>") * 20_000]
    assert ids_of(coder([b"x", b" x"]), texts) == [library.encode(t, add_special_tokens=False).ids for t in texts]


def test_slices_do_not_matter(monkeypatch):
    texts = drawn(5, 200, 200)
    whole = coder([b" a"]).encode(texts)
    monkeypatch.setattr(bpe, "pieces", lambda text, special, most=7, f=bpe.pieces: f(text, special, most))
    monkeypatch.setattr(bpe, "SLICE", 50)
    assert coder([b" a"]).encode(texts) == whole


def test_transducer_is_minimal_and_exact():
    r = random.Random(2)
    words = {bytes(r.choice(b"ab\xffc") for _ in range(r.randint(1, 7))): r.randrange(50) for _ in range(700)}
    builder = lexicon.Builder()
    for w in sorted(words):
        builder.add(w, words[w])
    states = builder.states()
    # a state for each different set of (rest of the word, number beyond the least that the prefix leaves)
    kinds = set()
    for p in {w[:k] for w in words for k in range(len(w) + 1)}:
        rest = {w[len(p) :]: n for w, n in words.items() if w.startswith(p)}
        kinds.add(frozenset((s, n - (min(rest.values()) if p else 0)) for s, n in rest.items()))
    assert len(states) == len(kinds)
    arrays = lexicon.double_array(states)
    asked = [*words, *(w + b"a" for w in words), *(w[:-1] for w in words if w[1:]), b"zz", b"\x00"]
    data, ends = np.frombuffer(b"".join(asked), np.uint8), np.cumsum([len(w) for w in asked])
    got = lexicon.find(arrays, data, np.append(0, ends[:-1]), ends)
    assert got.tolist() == [words.get(w, -1) for w in asked]
    with pytest.raises(ValueError):
        builder.add(b"a", 1)


def test_file_round_trip(tmp_path):
    arrays = lexicon.compiled([(b"ab", 3), (b"b", 0)])
    (tmp_path / "x").write_bytes(lexicon.to_bytes(arrays))
    back = lexicon.mapped(str(tmp_path / "x"))
    assert set(back) == set(arrays) and all((back[k] == arrays[k]).all() and back[k].dtype == arrays[k].dtype for k in arrays)
    (tmp_path / "y").write_bytes(b"something else")
    with pytest.raises(ValueError):
        lexicon.mapped(str(tmp_path / "y"))


def test_word_counts_cover_all_texts(spark):
    docs = spark.createDataFrame([("it's a b a",), (None,), ("",), (" a<|endoftext|>a",), (" a",)], "text string").repartition(3)
    assert {bytes(r["word"]): r["n"] for r in bpe.word_counts(docs, PATH).collect()} == {b"it": 1, b"'s": 1, b" a": 4, b" b": 1, b"a": 1}


def test_rows(spark, library):
    texts = [None, "", "a", "a", "'s" * 3, "<|endoftext|>", *drawn(9, 60)]
    docs = spark.createDataFrame([(None if k == 3 else k, t, "x") for k, t in enumerate(texts)], "doc_id long, text string, ids string").repartition(4)
    made = bpe.build(docs, PATH, most_words=20)
    assert 0 < made.words <= 20
    got = bpe.decode(bpe.encode(docs, made), PATH).collect()
    want = [(None if k == 3 else k, library.encode(t or "", add_special_tokens=False).ids, t or "") for k, t in enumerate(texts)]
    key = lambda x: -1 if x[0] is None else x[0]
    assert sorted(((r["doc_id"], np.frombuffer(r["ids"], "<u4").tolist(), r["decoded"]) for r in got), key=key) == sorted(want, key=key)


def test_empty_table_and_odd_ids(spark, library):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert bpe.decode(bpe.encode(empty, bpe.build(empty, PATH)), PATH).collect() == []
    lists = [[64, 60_000, 50256], [222], [447], []]
    odd = spark.createDataFrame([(bytearray(np.array(x, "<u4").tobytes()),) for x in lists] + [(None,)], "ids binary")
    assert [r["decoded"] for r in bpe.decode(odd, PATH).collect()] == [library.decode(x, skip_special_tokens=False) for x in lists] + [None]


def test_query(spark, library, sf_dir):
    got = {r["doc_id"]: r for r in queries.op11_bpe_lexicon(spark, sf_dir).collect()}
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").collect()
    assert len(got) == len(docs)
    for d in docs:
        ids = library.encode(d["text"] or "", add_special_tokens=False).ids
        text = library.decode(ids, skip_special_tokens=False)
        assert tuple(got[d["doc_id"]])[1:] == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(text.encode()).hexdigest())
