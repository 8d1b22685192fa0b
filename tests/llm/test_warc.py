from __future__ import annotations

import base64
import hashlib

import pytest
from conftest import rows

from tideline.llm import warc
from tideline.llm.queries import ORACLE_SQL, op6_warc_archive

PAGES = [(3, "u3", "same"), (1, "u1", "same"), (2, None, "é🙂"), (4, "bad\r\nurl", None), (5, "u5", ""), (6, "u6", "x" * 300_000), (7, "u7", "x" * 300_000), (8, "u8", "a\r\n\r\nWARC/1.1\r\n")]


def frame(spark, pages):
    return spark.createDataFrame([(*p, "clash") for p in pages], "page_id long, url string, html string, digest string")


def expected(pages, least=0):
    first = {}
    for i, _, html in sorted(pages):
        first.setdefault(html or "", i)
    out = []
    for i, _, html in pages:
        raw = (html or "").encode()
        own = first[html or ""] == i or len(raw) < least
        out.append((i, len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode(), "response" if own else "revisit", None if own else first[html or ""]))
    return sorted(out)


@pytest.mark.parametrize("least", [0, 5])
def test_cases(spark, least):
    assert sorted(map(tuple, warc.archive_round_trip(frame(spark, PAGES), least).collect())) == expected(PAGES, least)
    assert warc.archive_round_trip(frame(spark, PAGES).limit(0)).count() == 0


def test_whole_table(spark, duck, sf_dir):
    assert rows(op6_warc_archive(spark, sf_dir)) == rows(duck.execute(ORACLE_SQL["op6_warc_archive"]).df())


def test_records_are_rebuilt(spark, tmp_path):
    path = str(tmp_path / "archive")
    warc.write_archive(frame(spark, PAGES), path)
    stored = spark.read.parquet(f"{path}/payloads")
    assert stored.count() == len({p[2] or "" for p in PAGES})
    html = {p[0]: (p[2] or "").encode() for p in PAGES}
    for r in warc.reconstruct(spark, path).collect():
        assert bytes(r["payload"]) == html[r["page_id"]]
        head, _, rest = bytes(r["record"]).partition(b"\r\n\r\n")
        size = int(dict(x.split(b": ", 1) for x in head.split(b"\r\n")[1:])[b"Content-Length"])
        assert head.startswith(b"WARC/1.1\r\n") and len(rest) == size + 4 and rest.endswith(b"\r\n\r\n")
    warc.export_warc(spark, path, str(tmp_path / "files"))
    text = b"".join(p.read_bytes() for p in sorted((tmp_path / "files").glob("part-*")))
    found = at = 0
    while at < len(text):
        head, _, rest = text[at:].partition(b"\r\n\r\n")
        at += len(head) + 8 + int(dict(x.split(b": ", 1) for x in head.split(b"\r\n")[1:])[b"Content-Length"])
        found += 1
    assert found == len(PAGES) and at == len(text)


def test_damage_is_noticed(spark, tmp_path):
    path = str(tmp_path / "archive")
    warc.write_archive(frame(spark, PAGES), path)
    bad = spark.read.parquet(f"{path}/payloads").selectExpr("digest", "concat(payload, cast('!' AS binary)) AS payload").collect()
    spark.createDataFrame(bad, "digest string, payload binary").write.mode("overwrite").parquet(f"{path}/payloads")
    with pytest.raises(Exception, match="differs from its digest"):
        warc.verified_payloads(spark, path).collect()


def test_repeated_and_missing_ids(spark):
    pages = frame(spark, [(1, "u", "a"), (1, "u", "a"), (None, "u", "a"), (2, "u", "a")])
    out = sorted(map(str, [(r["page_id"], r["record_type"], r["refers_to"]) for r in warc.archive_round_trip(pages).collect()]))
    assert out == sorted(map(str, [(1, "response", None), (1, "response", None), (None, "response", None), (2, "revisit", 1)]))
