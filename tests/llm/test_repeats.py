from __future__ import annotations

import hashlib
import random
import time
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest

from tideline.llm import columnwise, repeats
from tideline.llm.queries import op7_repeated_strings

LENGTH = repeats.LENGTH


def brute(texts):
    """(doc, n_bytes, n_removed, n_spans, sha256), by a set of every 100-byte string seen so far."""
    seen, out = set(), []
    for doc, text in sorted(texts, key=lambda x: x[0]):
        raw = (text or "").encode()
        gone = bytearray(len(raw))
        for s in range(len(raw) - LENGTH + 1):
            piece = raw[s : s + LENGTH]
            if piece in seen:
                gone[s : s + LENGTH] = b"\1" * LENGTH
            seen.add(piece)
        spans = sum(1 for i, g in enumerate(gone) if g and (i == 0 or not gone[i - 1]))
        kept = bytes(b for b, g in zip(raw, gone, strict=True) if not g)
        out.append((doc, len(raw), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return out


def got(df):
    return sorted(tuple(r) for r in df.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256").collect())


def test_whole_table_against_brute_force(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").toPandas()
    assert got(op7_repeated_strings(spark, sf_dir)) == brute(list(docs.itertuples(index=False, name=None)))


def test_periodic_and_shared_passages(spark):
    r = random.Random(8)
    passage = "".join(r.choices("abcdefgh ", k=400))
    texts = [(1, "a" * 1000), (2, "ab" * 300), (3, "a" * 99), (4, "a" * 100), (5, "é" * 120), (6, None), (7, ""), (8, "abc" * 33), (9, "abc" * 34)]
    for i in range(60):
        lo = r.randrange(0, 250)
        piece = passage[lo : lo + r.randrange(90, 150)]
        texts.append((20 + i, "".join(r.choices("xyz", k=r.randrange(0, 80))) + piece + "".join(r.choices("uvw", k=r.randrange(0, 80)))))
    texts.append((200, passage + passage))
    df = spark.createDataFrame([(d, t, "clash") for d, t in texts], "doc_id long, text string, place string").repartition(5)
    assert got(repeats.remove_repeats(df)) == brute(texts)


@pytest.mark.parametrize("block", [12, 40, 5000])
def test_very_frequent_passage(spark, block):
    """Groups of more runs than a collection holds are cut, and meet again in later passes."""
    r = random.Random(9)
    core, phrase = "".join(r.choices("abcdefgh", k=140)), "a phrase of thirty-six common letters"
    noise = lambda letters: "".join(r.choices(letters, k=120))
    texts = [(i, noise("mnop") + (core if i % 3 else phrase) + noise("qrst") + (core[:90] if i % 2 else core[20:125]) + noise("uv")) for i in range(150)]
    texts += [(200 + i, texts[i % 7][1]) for i in range(60)]
    df = spark.createDataFrame(texts, "doc_id long, text string").repartition(7)
    assert got(repeats.remove_repeats(df, block=block)) == brute(texts)


def test_long_text_in_segments(spark):
    r = random.Random(10)
    part = "".join(r.choices("abcdefgh", k=3000))
    texts = [(1, part), (2, part[500:2900] + "zz" + part), (3, "".join(r.choices("abcdefgh", k=5000)))]
    df = spark.createDataFrame(texts, "doc_id long, text string")
    assert got(repeats.remove_repeats(df, segment=1000, block_runs=50)) == brute(texts)


def test_structured_strings_are_told_apart(spark):
    """Letters chosen by the parity of a number's set bits: such strings and their swaps share polynomial hashes."""
    parity = lambda n, x: "".join(x[bin(i).count("1") & 1] for i in range(n))
    texts = [(k, parity(2048, x) + parity(300, x[::-1])) for k, x in enumerate(("ab", "ba", "cd", "dc"))]
    df = spark.createDataFrame(texts, "doc_id long, text string")
    assert got(repeats.remove_repeats(df, block=8)) == brute(texts)


def test_bytes_are_on_disk_a_share_at_a_time(spark, monkeypatch):
    """Runs overlap: where all have company, shuffle files with the bytes of all at once and the texts took 3.5 times the text."""
    r = random.Random(11)
    halves = ["".join(r.choices("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789", k=5000)) for _ in range(100)]
    texts = [(i, halves[i // 2] + f" ending {i}") for i in range(200)]
    df = spark.createDataFrame(texts, "doc_id long, text string").repartition(4)
    dirs = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString()
    files = lambda: {p: p.stat().st_size for d in dirs for p in Path(d).glob("*/shuffle_*") if p.exists()}
    before, peaks, stage = set(files()), [], repeats.stage

    def watched(df, name):
        for _ in range(50):  # files go a little after they are given up
            if sum(n for p, n in files().items() if p not in before) < 100_000:
                break
            time.sleep(0.1)
        out = stage(df, name)
        peaks.append(sum(n for p, n in files().items() if p not in before))
        return out

    monkeypatch.setattr(repeats, "stage", watched)
    out = got(repeats.remove_repeats(df))
    assert out == brute(texts)
    assert max(peaks) < 2.8 * sum(len(t) for _, t in texts)


def test_missing_and_shared_ids(spark):
    text = "".join(random.Random(3).choices("abcdef", k=200))
    df = spark.createDataFrame([(5, text), (5, text), (None, text), (7, "short")], "doc_id long, text string")
    out = sorted(map(tuple, repeats.remove_repeats(df).select("doc_id", "n_removed").collect()), key=str)
    assert out == sorted([(None, 0), (5, 200), (5, 200), (7, 0)], key=str)
    assert repeats.remove_repeats(df.limit(0)).count() == 0


@pytest.mark.parametrize("seed", range(6))
def test_columns_against_sorting(seed):
    """Order and common prefixes of every round, and equal windows, against sorted strings."""
    r = np.random.default_rng(seed)
    width, n, length = 24, int(r.integers(1, 40)), 3
    lead = r.integers(0, 12, n)
    strings = [bytes(r.integers(97, 97 + r.integers(1, 4), r.integers(1, width - k + 1)).astype(np.uint8)) for k in lead]
    offsets = np.concatenate([[0], np.cumsum([len(s) for s in strings])])
    symbols = columnwise.in_columns(np.frombuffer(b"".join(strings), np.uint8), offsets, lead, width)
    rows = [[0] * k + [c + 1 for c in s] + [0] * (width - k - len(s)) for s, k in zip(strings, lead, strict=True)]
    assert symbols.T.tolist() == rows
    for x, order, common in columnwise.rounds(symbols, 200):
        behind = [rows[i][x:] for i in order]
        assert behind == sorted(behind)
        shared = [next((k for k, (a, b) in enumerate(zip(p, q, strict=True)) if a != b), len(p)) for p, q in zip(behind, behind[1:], strict=False)]
        assert common.tolist() == [0, *shared]
    later = columnwise.later_windows(symbols, length, 12)
    for x in range(12):
        seen: set[tuple] = set()
        for i in range(n):
            piece = tuple(rows[i][x : x + length])
            assert later[x, i] == (piece in seen)
            seen.add(piece)


def test_every_run_with_company_is_kept():
    """meet_runs over batches of any size keeps what a plain grouping keeps, with marks taken up."""
    r = random.Random(12)
    rows = sorted(((r.randrange(40), r.randrange(2) * r.randrange(2), r.choice([None, *range(9)])) for _ in range(120)), key=lambda x: (x[0], x[1], -1 if x[2] is None else x[2]))
    table = [(k, p, p > 0 or d is None, d, d) for k, p, d in rows]
    groups = {}
    for k, p, _, d, _ in table:
        groups.setdefault((k, p), []).append(d)
    want = sorted((k, p, d) for (k, p), ds in groups.items() for d in ds if d is not None and (len([x for x in ds if x is not None]) > 1 or None in ds or p > 0))
    for size in (1, 2, 7, 200):
        batches = [repeats.batch(repeats.RUNS, *(pa.array(c, t) for c, t in zip(zip(*table[lo : lo + size], strict=True), (pa.int64(), pa.int32(), pa.bool_(), pa.int64(), pa.int64()), strict=True))) for lo in range(0, len(table), size)]
        out = [tuple(x.values()) for b in repeats.meet_runs(iter(batches)) for x in b.to_pylist()]
        assert sorted((k, p, d) for k, p, _, d, _ in out) == want
        assert all(s == (p > 0 or None in groups[k, p]) for k, p, s, _, _ in out)
