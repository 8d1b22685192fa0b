"""Each stage of the pipeline against what its operator says of the same input."""

from __future__ import annotations

import corpus_pipeline
from test_minhash import brute
from test_pii import base

from tideline.llm import decontam, packing

SF = "/root/testdata/sf0.01"  # smaller tables have too few toxic labels to learn from


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    benchmark = spark.read.parquet(f"{SF}/benchmark.parquet")
    columns = docs.columns
    for (name, function), want in zip(corpus_pipeline.STAGES, ["toxicity", "near_duplicates", "decontamination", "personal_data", "packing"], strict=True):
        assert name == want
        before = docs.collect()
        out = function(spark, docs, SF).cache()
        after = out.collect()
        if name == "packing":
            assert {r["doc_id"] for r in after} == {r["doc_id"] for r in before}
            assert out.columns == [c.split()[0] for c in packing.SCHEMA.split(", ")]
            continue
        assert out.columns == columns and out.dtypes == docs.dtypes
        kept = {r["doc_id"] for r in after}
        if name == "toxicity":
            assert 0.8 * len(before) < len(after) <= len(before)
            toxic = {r["doc_id"] for r in spark.read.parquet(f"{SF}/labels.parquet").filter("toxic = 1").collect()} & {r["doc_id"] for r in before}
            assert len(toxic & kept) <= 0.4 * len(toxic)  # of a thousand documents; test_toxicity holds the score to more
        elif name == "near_duplicates":
            assert kept == {d for d, _, _, k in brute([(r["doc_id"], r["text"]) for r in before], 80) if k}
        elif name == "decontamination":
            assert kept == {r["doc_id"] for r in before} - {r["doc_id"] for r in decontam.contaminated(docs, benchmark).collect()}
        else:
            assert len(after) == len(before)
            texts = {r["doc_id"]: r["text"] for r in before}
            for r in after:
                assert not base(r["text"])
                assert r["n_chars"] == len(r["text"] or "")
                if not any(c in "0123456789@" for c in texts[r["doc_id"]] or ""):
                    assert r["text"] == texts[r["doc_id"]]
        docs = out


def test_run(spark):
    out = corpus_pipeline.run(spark, SF)
    assert out.count() > 0 and out.columns[0] == "doc_id"


def edge_rows(spark):
    """Nulls in every column, empty and very long texts, ties, repeated rows, and columns that the stages use inside."""
    long = "a sentence about rivers and hills. " * 20_000
    rows = [(None, None, None, None, None), (1, None, "en", "s", 0), (2, "", "en", None, 0), (3, " \t\n", None, "s", 3), (4, "two words", "en", "s", 9), (4, "two words", "en", "s", 9), (None, "two words", "en", "s", 9), (5, long, "en", "s", len(long)), (6, long, "en", "s", len(long)), (7, "mail me at a.b@example.com please", "en", "s", 33)]
    wide = [(*r, 0.5, 1, True, 7, "x", 8, "y") for r in rows]
    return spark.createDataFrame(wide, "doc_id long, text string, lang string, source string, n_chars long, score double, predicted int, kept boolean, component_id long, spans string, item_id long, digest string")


def test_stages_on_edge_rows(spark):
    docs = edge_rows(spark)
    count = lambda df: sorted((-1 if r["doc_id"] is None else r["doc_id"]) for r in df.collect())
    everything = count(docs)
    for name, function in corpus_pipeline.STAGES[:-1]:
        out = function(spark, docs, SF)
        assert out.columns == docs.columns and out.dtypes == docs.dtypes, name
        # repeated rows of one document are kept once, and one of the two long copies stays
        assert count(out) == ([-1, -1, 1, 2, 3, 4, 5, 7] if name == "near_duplicates" else everything), name
        by_text = {r["doc_id"]: r for r in out.collect()}
        assert by_text[7]["text"] == ("mail me at <email> please" if name == "personal_data" else "mail me at a.b@example.com please")
        assert tuple(by_text[7])[5:] == (0.5, 1, True, 7, "x", 8, "y") and by_text[1]["text"] is None
        assert function(spark, docs.limit(0), SF).count() == 0, name
    name, function = corpus_pipeline.STAGES[-1]
    pieces = function(spark, docs, SF).collect()
    assert sum(r["start"] == 0 for r in pieces) == len(everything)
    assert {r["doc_tokens"] for r in pieces if r["doc_id"] in (1, 2)} == {1}
    assert function(spark, docs.limit(0), SF).count() == 0
