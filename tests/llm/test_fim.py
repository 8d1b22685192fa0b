from __future__ import annotations

import hashlib
import random

import pytest
from conftest import rows

from tideline.llm import fim, queries

BITS = ["a", "bc", " ", "é", "\n", "<", ">", "<P", "😀", "Z", ".", "k" * 9]


def drawn(r, most=60):
    return "".join(r.choice(BITS) for _ in range(r.randint(0, most)))


@pytest.mark.parametrize(("leaf", "block"), [(5, 37), (1, 4), (1024, 1 << 20)])
def test_ropes_against_lists(monkeypatch, leaf, block):
    monkeypatch.setattr(fim, "BLOCK", block)
    r = random.Random(leaf)
    for _ in range(400):
        text = drawn(r)
        units, whole = fim.UNIT.findall(text), fim.rope(text, leaf)
        assert (fim.written(whole), whole.units, whole.chars) == (text, len(units), len(text))
        k, c = r.randint(0, len(units)), r.randint(0, len(text))
        low, high = fim.split_units(whole, k)
        assert (fim.written(low), fim.written(high), low.units, high.units) == ("".join(units[:k]), "".join(units[k:]), k, len(units) - k)
        low, high = fim.split_chars(whole, c)
        assert (fim.written(low), low.chars, high.chars) == (text[:c], c, len(text) - c)
        assert low.units == len(fim.UNIT.findall(text[:c])) and high.units == len(fim.UNIT.findall(text[c:]))


def plainly(doc_id, text):
    """The contract by lists and strings."""
    h = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(h[8 * k : 8 * k + 8], 16) for k in range(4)]
    u = fim.UNIT.findall(text)
    low, high = sorted((h[0] % (len(u) + 1), h[1] % (len(u) + 1)))
    p, m, s = "".join(u[:low]), "".join(u[low:high]), "".join(u[high:])
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return len(u), "plain", None, None, text
    return (len(u), "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}") if h[3] % 100 < 20 else (len(u), "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}")


def test_rows_against_lists(spark):
    r = random.Random(3)
    texts = [None, "", "<P>", "a<M>b", "x" * 5000, "ab " * 40_000, *(drawn(r, 4000).replace("<P>", "") for _ in range(120))]
    given = [(None if k == 7 else k // 2, t, "de", "other") for k, t in enumerate(texts)]
    docs = spark.createDataFrame(given, "doc_id long, text string, form string, output string")  # names that clash with the results'
    got = fim.restore(fim.transform(docs)).collect()
    want = sorted(((d, *plainly(d, t or "")) for d, t, _, _ in given), key=str)
    assert sorted((tuple(x)[:6] for x in got), key=str) == want
    assert sorted(x["restored"] for x in got) == sorted(t or "" for t in texts)
    assert {x["form"] for x in got} == {"plain", "psm", "spm"}


def test_empty_table_and_broken_outputs(spark):
    assert fim.restore(fim.transform(spark.createDataFrame([], "doc_id long, text string"))).columns == ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output", "restored"]
    broken = spark.createDataFrame([("<P>a<S>b", "psm"), (None, "psm"), ("a", None), ("<S>b<P>a<M>", "psm"), ("", "plain")], "output string, form string")
    assert [x["restored"] for x in fim.restore(broken).collect()] == [None, None, None, None, ""]


def test_query_against_sql(spark, duck, sf_dir):
    got = queries.op12_fill_in_middle(spark, sf_dir)
    assert rows(got) == rows(duck.execute(queries.ORACLE_SQL["op12_fill_in_middle"]).df())
