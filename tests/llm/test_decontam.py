from __future__ import annotations

import random

from tideline.llm import decontam
from tideline.llm.queries import op10_decontamination


def distance_inside(item, text):
    """Least edits of the item against any part of the text."""
    row = [0] * (len(text) + 1)
    for i, c in enumerate(item, 1):
        new = [i]
        for j, d in enumerate(text, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (c != d)))
        row = new
    return min(row)


def edited(r, text, n):
    chars = list(text)
    for _ in range(n):
        at = r.randrange(len(chars))
        kind = r.randrange(3)
        if kind == 0:
            chars[at] = r.choice("xyz")
        elif kind == 1:
            chars.insert(at, r.choice("xyz"))
        else:
            del chars[at]
    return "".join(chars)


def test_against_full_edit_distance(spark):
    r = random.Random(11)
    items = [(i, "".join(r.choices("abcdefgh ", k=r.randrange(40, 90)))) for i in range(12)]
    docs = []
    for d in range(150):
        noise = ["".join(r.choices("abcdefgh ", k=r.randrange(0, 60))) for _ in range(2)]
        middle = edited(r, r.choice(items)[1], r.randrange(0, 9)).upper() if d % 3 else ""
        docs.append((d, noise[0] + middle + noise[1]))
    rate, q = 0.06, 10
    budgets = {i: max(0, min(int(rate * len(t)), (len(t) - q) // q)) for i, t in items}
    want = {(d, i): e for d, text in docs for i, t in items if (e := distance_inside(t, text.lower())) <= budgets[i]}
    out = decontam.contaminated(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"), q, rate).collect()
    assert {(r["doc_id"], r["item_id"]): r["edits"] for r in out} == want and len(out) == len(want) > 20
    texts, named = dict(docs), dict(items)
    for row in out:
        part = texts[row["doc_id"]][row["start"] : row["end"]].lower()
        assert distance_inside(named[row["item_id"]], part) == row["edits"]


def test_blocks_give_the_same(spark):
    docs, items = spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), spark.read.parquet("/root/testdata/sf0.01/benchmark.parquet")
    whole, cut = (sorted(map(tuple, decontam.contaminated(docs, items, block_chars=n).collect())) for n in (4_000_000, 500))
    assert whole == cut and whole
    gone = {r[0] for r in whole}
    kept = {r["doc_id"] for r in decontam.clean(docs, items).select("doc_id").collect()}
    assert kept == {r["doc_id"] for r in docs.select("doc_id").collect()} - gone


def test_every_exact_passage_is_found(spark):
    """All documents that hold a whole item are named, by plain search."""
    docs, items = spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), spark.read.parquet("/root/testdata/sf0.01/benchmark.parquet")
    tidy = lambda t: " ".join((t or "").split()).lower()
    named = [(r["item_id"], tidy(r["text"])) for r in items.collect()]
    want = {(r["doc_id"], i) for r in docs.collect() for text in [tidy(r["text"])] for i, t in named if len(t) >= 10 and t in text}
    got = {(r["doc_id"], r["item_id"]) for r in op10_decontamination(spark, "/root/testdata/sf0.01").collect()}
    assert want <= got and want


def test_edge_cases(spark):
    item = "which of these rivers is the longest in the world"
    docs = spark.createDataFrame([(1, None, "x"), (2, "", "x"), (3, item, "x"), (3, item, "x"), (None, item.upper(), "x"), (4, "pad " * 50_000 + item, "x"), (5, "İ" * 30 + item, "x")], "doc_id long, text string, item_id string")
    items = spark.createDataFrame([(1, item), (1, item), (2, None), (3, "short"), (None, "")], "item_id long, text string")
    out = decontam.contaminated(docs, items).collect()
    assert sorted((r["doc_id"] or 0) for r in out) == [0, 0, 3, 3, 3, 3, 4, 4, 5, 5]
    assert {(r["start"], r["end"]) for r in out if r["doc_id"] == 4} == {(200_000, 200_000 + len(item))}
    assert decontam.contaminated(docs, items.limit(0)).count() == 0
    assert decontam.contaminated(docs.limit(0), items).count() == 0
    assert decontam.clean(docs, items).count() == 2


def test_parts_layout_and_replaced_words(spark):
    """Planted: part of an item, an item with other spacing, a short item with a word replaced; and texts with less."""
    r = random.Random(5)
    word = lambda: "".join(r.choices("abcdefghijklmnopqrstuvwxyz", k=r.randrange(3, 10)))
    prose = lambda n: " ".join(word() for _ in range(n))
    long, short = prose(60)[:394].strip(), "the quick painter carried seven yellow lanterns across the frozen harbour at night"
    items = [(1, long), (2, short)]
    pad = prose(50)
    part = long[100 : 100 + len(long) * 6 // 10]
    docs = {
        1: (f"{pad} {part} {pad}", {1}), 2: (f"{pad} {long.replace(' ', '  ')} {pad}", {1}), 3: (pad + long.replace(" ", "\n    ") + pad, {1}), 4: (f"{pad} {short.replace('yellow', 'purple')} {pad}", {2}),
        5: (f"{pad} {long[200:295]}", {1}), 6: (f"{pad} {long[200:240]} {pad}", set()), 7: (pad, set()), 8: (f"{pad} {long.upper()} {short}", {1, 2}), 9: ("\u00a0".join(long.split()) + pad, {1}), 10: (" " * 500, set()),
    }
    table = spark.createDataFrame([(d, t) for d, (t, _) in docs.items()], "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    out = decontam.contaminated(table, bench, passages=decontam.Passages()).collect()
    assert sorted((x["doc_id"], x["item_id"]) for x in out) == sorted((d, i) for d, (_, want) in docs.items() for i in want)
    named = dict(items)
    for x in out:
        place = " ".join(docs[x["doc_id"]][0][x["start"] : x["end"]].lower().split())
        assert len(place) >= 50 and distance_inside(place, named[x["item_id"]]) <= x["edits"] + 1
    kept = {x["doc_id"] for x in decontam.clean(table, bench, passages=decontam.Passages()).collect()}
    assert kept == {d for d, (_, want) in docs.items() if not want}


def test_short_items_are_found(spark):
    """Items too short for the bound with q = 10 keep their edits, those of fewer characters than q are found as they are."""
    r = random.Random(21)
    items = [(i, "".join(r.choices("abcdefgh", k=k))) for i, k in enumerate((3, 7, 9, 10, 12, 17, 18, 19, 20, 33, 34, 40))]
    docs = []
    for d in range(120):
        noise = ["".join(r.choices("abcdefgh", k=r.randrange(0, 50))) for _ in range(2)]
        docs.append((d, noise[0] + edited(r, r.choice(items)[1], r.randrange(0, 3)) + noise[1]))
    want = {(d, i): e for d, text in docs for i, t in items if (e := distance_inside(t, text)) <= int(0.06 * len(t))}
    table, bench = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    out = decontam.contaminated(table, bench).collect()
    assert {(x["doc_id"], x["item_id"]): x["edits"] for x in out} == want and len(out) == len(want)
    assert {i for _, i in want} == {i for i, _ in items}


def test_alignment_in_a_band_against_full_rows():
    r = random.Random(22)
    for _ in range(300):
        text, e = "".join(r.choices("abc", k=r.randrange(20, 90))), r.randrange(0, 7)
        at = r.randrange(0, len(text) - 15)
        item = edited(r, text[at : at + r.randrange(12, 40)], r.randrange(0, e + 2))
        item_points, points = decontam.normal_points(item), decontam.normal_points(text)
        whole = distance_inside(item, text)
        full = decontam.align(item_points, points, e, -len(item), len(text))
        assert (full is None) == (whole > e) and (full is None or full[0] == whole)
        band = decontam.align(item_points, points, e, at - e, at + e)
        assert band is None or band[0] >= whole
        if whole <= e:
            edits, start, end = decontam.occurrence(item_points, points, e, -len(item), len(text))
            assert edits == whole == distance_inside(item, text[start:end])


def test_texts_and_items_that_repeat_themselves():
    """A megabyte of blanks, of one letter and of two in turn, against items that hold the same."""
    import time

    items = [(1, "x" + " " * 200 + "y"), (2, "=" * 150 + " end of the table"), (3, "ab" * 90 + "c"), (4, "question " * 20)]
    block = decontam.build_block(items, 10, 0.06, decontam.Passages())
    texts = [" " * 1_000_000, "=" * 700_000 + " end of the table" + "=" * 400_000, "ab" * 500_000, " " * 400_000 + "x" + " " * 200 + "y" + " " * 400_000, "question " * 20_000]
    began = time.time()
    found = {(t, i): (s, e, d) for t, i, s, e, d in decontam.hits(block, texts)}
    assert time.time() - began < 120
    assert found[1, 1][:2] == (700_000 - 150, 700_000 + 17) and found[3, 0] == (400_000, 400_202, 0)
    assert found[2, 2][2] == 1 and found[4, 3] == (0, 180, 0)
    assert (0, 0) in found  # the blanks alone are no more than two edits away
    assert (0, 3) not in found and (2, 1) not in found


def test_items_longer_than_a_million():
    """Diagonals of very long items don't run into those of others; texts are cut into parts that overlap."""
    r = random.Random(23)
    long = "".join(r.choices("abcdefghijklmnopqrstuvwxyz ", k=1_300_000))
    short = "".join(r.choices("abcdefghijklmnopqrstuvwxyz ", k=200))
    block = decontam.build_block([(1, long), (2, short)], 10, 0.0001, None)
    found = {(t, i): (s, e, d) for t, i, s, e, d in decontam.hits(block, ["zz" * 300_000 + long + short, short])}
    assert found == {(0, 0): (600_000, 1_900_000, 0), (0, 1): (1_900_000, 1_900_200, 0), (1, 1): (0, 200, 0)}


def test_column_names_in_other_case(spark):
    docs = spark.createDataFrame([(1, "which of these rivers is the longest in the world", 3), (2, "other", 4)], "doc_id long, Text string, item_id long")
    items = spark.createDataFrame([(1, "which of these rivers is the longest in the world")], "item_id long, text string")
    assert [tuple(x) for x in decontam.clean(docs, items).collect()] == [(2, "other", 4)]


def test_boilerplate_against_full_edit_distance():
    """Items that almost fit everywhere in a text of one repeated sentence, some of them twice: the least edits, the first place, in seconds."""
    import time

    r = random.Random(24)
    sentence = "all rights reserved by the owner of this document and others. "
    items = []
    for k in range(30):
        chars = list((sentence * 20)[k % 60 : k % 60 + 540])
        for _ in range(25):
            chars[r.randrange(540)] = r.choice("xyzq")
        items.append((k, "".join(chars)))
    items += [(30, items[0][1]), (31, items[5][1])]
    block = decontam.build_block(items, 10, 0.06, None)
    began = time.time()
    found = {(t, i): (s, e, d) for t, i, s, e, d in decontam.hits(block, [sentence * 3000, sentence * 12])}
    assert time.time() - began < 60
    for k, item in items:
        edits = distance_inside(item, sentence * 12)
        for row in (0, 1):  # the first place lies within the first periods of the sentence, so both texts have the same
            assert (((row, k) in found) == (edits <= 32)) and (edits > 32 or found[row, k][2] == edits)
        assert found.get((0, k)) == found.get((1, k))
    assert found[0, 30] == found[0, 0] and found[0, 31] == found[0, 5]


def test_hits_counted_in_pieces_are_the_same(monkeypatch):
    """Half bands counted by sorting and in small pieces name the same bands as those counted in one array."""
    r = random.Random(25)
    items = [(k, "".join(r.choices("abcdef ", k=r.randrange(1, 200)))) for k in range(10)]
    texts = ["".join(edited(r, r.choice(items)[1], r.randrange(0, 5)) + "".join(r.choices("abcdef ", k=30)) for _ in range(6)) for _ in range(6)]
    block = decontam.build_block(items, 10, 0.06, decontam.Passages())
    want = sorted(decontam.hits(block, texts))
    for piece in (0, 40, 2000):
        monkeypatch.setattr(decontam, "PIECE", piece)
        assert sorted(decontam.hits(block, texts)) == want
    assert want
