"""Zip archives that tasks extract, against the standard library's reader."""

from __future__ import annotations

import random
import zipfile

import pytest

from tideline.sources import archive, market


def written(path, seed=1, many=25):
    """Files of both compressions, an empty one, one in a directory, one without a last line end, one with bytes that aren't UTF-8."""
    r = random.Random(seed)
    files = {f"dir/T{k}.csv": "".join(f"{r.random()},{r.choice('abc') * r.randrange(40)}\n" for _ in range(r.randrange(200))).encode() for k in range(many)}
    files |= {"empty.csv": b"", "dir/deep/é.csv": b"x,\xff\xfe\r\n\n\n,y", "one.csv": b"\n", "long.csv": r.randbytes(70_000).hex().encode() + b"\n"}
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("dir/", "")
        for k, (name, data) in enumerate(files.items()):
            z.writestr(name, data, zipfile.ZIP_DEFLATED if k % 3 else zipfile.ZIP_STORED)
        z.comment = b"PK\x03\x04 a comment"
    return files


@pytest.mark.parametrize("bytes_a_split", [999, 1 << 27])
def test_extraction(spark, tmp_path, bytes_a_split):
    files = written(tmp_path / "a.zip")
    spark.conf.set("spark.sql.files.maxPartitionBytes", bytes_a_split)
    spark.conf.set("spark.sql.files.openCostInBytes", 1)
    try:
        names = archive.extract(spark, str(tmp_path / "a.zip"), str(tmp_path / "out"), tasks=5)
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert sorted(names) == sorted(files)
    there = {str(p.relative_to(tmp_path / "out")): p.read_bytes() for p in (tmp_path / "out").rglob("*") if p.is_file() and not p.name.endswith(".crc")}
    assert there == {n: d if d.endswith(b"\n") or not d else d + b"\n" for n, d in files.items()}
    assert not (tmp_path / "out.lines").exists() and archive.extract(spark, str(tmp_path / "a.zip"), str(tmp_path / "out")) == []


def test_cut_off_extraction_begins_again(spark, tmp_path):
    files = written(tmp_path / "a.zip", many=3)
    for left in ("out.lines/member=0", "out.files/dir"):
        (tmp_path / left).mkdir(parents=True)
        (tmp_path / left / "part-0.txt").write_text("half a file")
    archive.extract(spark, str(tmp_path / "a.zip"), str(tmp_path / "out"))
    assert len([p for p in (tmp_path / "out").rglob("*.csv")]) == len(files) and not (tmp_path / "out.files").exists()


def test_damage_is_found(spark, tmp_path):
    written(tmp_path / "a.zip", many=3)
    whole = bytearray((tmp_path / "a.zip").read_bytes())
    whole[whole.index(b"dir/T1.csv") + 60] ^= 0xFF
    (tmp_path / "b.zip").write_bytes(whole)
    (tmp_path / "c.zip").write_bytes(b"no archive\nat all")
    (tmp_path / "d.zip").write_bytes(b"")
    with pytest.raises(Exception, match="damaged|decompress"):
        archive.extract(spark, str(tmp_path / "b.zip"), str(tmp_path / "out"))
    assert not (tmp_path / "out").exists()
    for name in ("c", "d"):
        with pytest.raises(archive.BadArchive):
            archive.extract(spark, str(tmp_path / f"{name}.zip"), str(tmp_path / "out"))
    with zipfile.ZipFile(tmp_path / "e.zip", "w") as z:
        z.writestr("../out.csv", "x")
    with pytest.raises(archive.BadArchive):
        archive.extract(spark, str(tmp_path / "e.zip"), str(tmp_path / "out"))


def test_prices_from_an_archive(spark, tmp_path):
    (tmp_path / "Stock_price").mkdir()
    with zipfile.ZipFile(tmp_path / "Stock_price/full_history.zip", "w", zipfile.ZIP_DEFLATED) as z:
        for t in ("AAPL", "NA"):
            z.writestr(f"full_history/{t}.csv", "date,close\n2020-01-02,1.5\n2020-01-03,2")
    assert market.extract_prices(str(tmp_path), spark)
    rows = market.read_prices(spark, market.prices_path(spark, str(tmp_path))).collect()
    assert sorted((r["ticker"], r["close"]) for r in rows) == [("AAPL", 1.5), ("AAPL", 2.0), ("NA", 1.5), ("NA", 2.0)]
