from __future__ import annotations

import random
import zipfile

import pytest
from pyspark.errors import StreamingQueryException
from pyspark.sql import functions as F

from tideline.sources import config, delimited, market, tracking
from tideline.streaming.ingest import ingest_stream

NEWS = '''Date,Article_title,Stock_symbol,Article
2023-12-16 22:00:00 UTC,"Quoted ""word"", comma",AAPL,"line one
line two"
2023-12-15,plain,NA,x
bad date,,,"empty symbol"
2023-01-01,t,1E5,"ends in backslash \\"
2023-01-02,t,TRUE,y
2023-01-03,t,aapl,z
2023-01-04,t,AAPL,w
'''


@pytest.fixture
def csv(tmp_path):
    path = tmp_path / "news.csv"
    path.write_text(NEWS)
    return str(path)


def test_csv_dialect(spark, csv):
    rows = market.read_news(spark, csv).orderBy("news_id").collect()
    assert [r["ticker"] for r in rows] == ["AAPL", "NA", None, "1E5", "TRUE", "aapl", "AAPL"]
    assert rows[0]["title"] == 'Quoted "word", comma' and rows[0]["article"] == "line one\nline two"
    assert rows[3]["article"] == "ends in backslash \\"
    assert [r["date"] is None for r in rows] == [False, False, True, False, False, False, False]
    assert rows[0]["url"] is None
    assert [r["ticker"] for r in market.read_news(spark, csv, 2).collect()] == ["AAPL", "NA"]


def test_cache_symbols_and_limits(spark, csv, tmp_path):
    cache = str(tmp_path / "cache")
    news = market.ingest_news(spark, csv, cache, "src")
    assert {r["ticker"] for r in news.select("ticker").distinct().collect()} == {"AAPL", "NA", None, "1E5", "TRUE", "aapl"}
    hits = market.news_for_symbol(news, "AAPL")
    assert hits.count() == 2 and "PartitionFilters: [isnotnull(ticker" in hits._jdf.queryExecution().toString()
    assert market.news_for_symbol(news, "AAPL", 1).first()["title"].startswith("Quoted")
    assert market.news_for_symbol(news, "AAPL", 0).count() == 0
    assert market.news_for_symbol(news, "XYZ").columns == news.columns
    with pytest.raises(ValueError):
        market.news_for_symbol(news, "AAPL", -1)
    before = market.fingerprint(spark, csv)
    market.ingest_news(spark, csv, cache, "src")  # read back, not written again
    with open(csv, "a") as f:
        f.write("2023-01-05,t,AAPL,v\n")
    assert market.fingerprint(spark, csv) != before
    assert market.news_for_symbol(market.ingest_news(spark, csv, cache, "src"), "AAPL").count() == 3


def test_several_sources(spark, csv, tmp_path):
    other = tmp_path / "other.csv"
    other.write_text("Stock_symbol,Date\nAAPL,2023-02-01\n")
    news = market.ingest_sources(spark, {"b": str(other), "a": csv}, str(tmp_path / "cache"))
    assert {(r["source"], r["n"]) for r in market.news_for_symbol(news, "AAPL").groupBy("source").agg(F.count("*").alias("n")).collect()} == {("a", 2), ("b", 1)}
    assert market.ingest_sources(spark, {}, str(tmp_path / "cache")).columns == news.columns


def test_precache(spark, csv, tmp_path):
    sets = {"dev": ["AAPL", "NA", "MISSING"]}
    got = {r["ticker"]: r["n"] for r in market.precache(spark, csv, str(tmp_path / "c"), "src", sets).collect()}
    assert got == {"AAPL": 2, "NA": 1, "MISSING": 0}
    with pytest.raises(ValueError):
        market.precache(spark, csv, str(tmp_path / "c"), "src", sets, "paper")


def test_prices(spark, tmp_path):
    d = tmp_path / "prices"
    d.mkdir()
    (d / "AAPL.csv").write_text("date,open,high,low,close,adj close,volume\n2020-01-02,1,2,0.5,1.5,1.4,100\nnot a date,1,x,1,1,1,1\n")
    (d / "NA.csv").write_text("date,volume,open,high,low,close,adj close\n1/3/2020,7,1,1,1,1,1\n")
    one = market.read_price(spark, str(d), "AAPL")
    assert [r["close"] for r in one.collect()] == [1.5, 1.0]
    assert market.rejects(one).first()["bad_dates"] == 1
    assert {r["ticker"] for r in one.collect()} == {"AAPL"}
    other = market.read_price(spark, str(d), "NA").first()
    assert (other["ticker"], str(other["date"]), other["volume"]) == ("NA", "2020-01-03", 7.0)
    with pytest.raises(market.SourceMissing):
        market.read_price(spark, str(d), "MSFT")


def test_prices_of_files_with_other_headers(spark, tmp_path):
    d = tmp_path / "mixed"
    d.mkdir()
    (d / "AAPL.csv").write_text("date,open,high,low,close,adj close,volume\n2020-01-02,1,2,0.5,1.5,1.4,100\n")
    (d / "MSFT.csv").write_text("\ufeffVolume,Date,Close,Open\r\n7,2020-01-03,9,8\r\n\r\n5,2020-01-04,3,2")
    got = {(r["ticker"], str(r["date"])): (r["open"], r["close"], r["volume"], r["high"]) for r in market.read_prices(spark, str(d)).collect()}
    assert got == {("AAPL", "2020-01-02"): (1, 1.5, 100, 2), ("MSFT", "2020-01-03"): (8, 9, 7, None), ("MSFT", "2020-01-04"): (2, 3, 5, None)}


@pytest.mark.parametrize("bytes_a_split", [40, 301, 100_000])
def test_quoted_records_across_splits(spark, tmp_path, bytes_a_split):
    """Every way of cutting the file gives the rows that one reader in order gives."""
    r = random.Random(3)
    rows = []
    for k in range(60):
        text = "".join(r.choices(['a', 'b', ' ', ',', '"', "\n", "\r\n", 'word', '""', '",', '\n"'], k=r.randrange(0, 30)))
        rows.append([f"2023-01-{k % 28 + 1:02d}", text, r.choice(["AAPL", "NA", ""]), r.choice(['in "the" middle', "plain", 'five" wide'])])
    plain = lambda x: '"' in x[1:] and x[0] != '"' and "," not in x and "\n" not in x  # noqa: E731  # quotes that open nothing
    quoted = lambda x: x if plain(x) else '"' + x.replace('"', '""') + '"'
    path = tmp_path / "news.csv"
    path.write_bytes(("Date,Article_title,Stock_symbol,Article\n" + "".join(",".join([d, '"' + t.replace('"', '""') + '"', s, quoted(a)]) + "\n" for d, t, s, a in rows)).encode())
    spark.conf.set("spark.sql.files.maxPartitionBytes", bytes_a_split)
    spark.conf.set("spark.sql.files.openCostInBytes", 1)
    try:
        got = [(r["title"], r["ticker"], r["article"]) for r in market.read_news(spark, str(path)).orderBy("news_id").collect()]
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert got == [(t or None, s or None, a) for _, t, s, a in rows]


def test_archive_and_paths(spark, tmp_path):
    root = tmp_path / "root"
    (root / "Stock_price").mkdir(parents=True)
    with zipfile.ZipFile(root / "Stock_price/full_history.zip", "w") as z:
        z.writestr("full_history/AAPL.csv", "date,close\n2020-01-02,1\n")
    assert market.extract_prices(str(root)) and not market.extract_prices(str(root))
    assert market.prices_path(spark, str(root)).endswith("full_history/full_history")
    assert market.news_path("r", "x") == "r/Stock_news/x.csv"
    assert not market.extract_prices(str(tmp_path / "none"))


def test_row_iterator(spark):
    assert next(market.row_iterator(spark.range(10)))["id"] == 0


def test_stream_ingest_takes_each_file_once(spark, tmp_path):
    landing, target, check = (str(tmp_path / x) for x in ("in", "out", "check"))
    (tmp_path / "in").mkdir()
    head = "Date,Article_title,Stock_symbol,Url,Publisher,Author,Article\n"
    (tmp_path / "in/a.csv").write_text(head + '2023-01-01,t,AAPL,u,p,a,"x\ny"\n')
    ingest_stream(spark, landing, target, check).awaitTermination(120)
    (tmp_path / "in/b.csv").write_text(head + "2023-01-02,t,1E5,u,p,a,z\n")
    ingest_stream(spark, landing, target, check).awaitTermination(120)
    rows = market.read_cache(spark, target).orderBy("date").collect()
    assert [(r["ticker"], r["article"]) for r in rows] == [("AAPL", "x\ny"), ("1E5", "z")]


def test_config(tmp_path, spark):
    (tmp_path / "model").mkdir()
    (tmp_path / "model/a.yaml").write_text("name: a\nsize: 3\n")
    (tmp_path / "model/b.yaml").write_text("name: b\nsize: 4\n")
    (tmp_path / "config.yaml").write_text("defaults:\n  - model: a\n  - _self_\nhorizon: 7\nname: ${model.name}_H${horizon}\nsame: ${model.size}\nnow: ${now:%Y}\nkept: ${other:x}\n")
    c = config.load(str(tmp_path / "config.yaml"))
    assert c["name"] == "a_H7" and c["same"] == 3 and len(c["now"]) == 4 and c["kept"] == "${other:x}"
    c = config.load(str(tmp_path / "config.yaml"), ("model=b", "horizon=14", "model.extra=[1, 2]"))
    assert c["name"] == "b_H14" and c["model"]["extra"] == [1, 2]
    config.save(c, str(tmp_path / "out/used.yaml"))
    assert config.load(str(tmp_path / "out/used.yaml"))["horizon"] == 14
    assert config.flatten({"a": {"b": 1, "c": [32, 64]}, "d": None, "e": {}, "f": []}) == {"a.b": 1, "a.c": "32,64", "d": None, "f": ""}
    with pytest.raises(ValueError):
        config.resolve({"a": "${b}", "b": "${a}"}, {"a": "${b}", "b": "${a}"}, ())


def test_tracking(spark, tmp_path):
    root = str(tmp_path / "runs")
    for step in (1, 2):
        with tracking.Run(spark, root, "r1") as run:
            run.log_config({"lr": 0.1, "x": {"y": None}})
            run.log_metrics({"mse": step * 1.0, "mae": None}, step)
    with tracking.Run(spark, root, "off", enabled=False) as run:
        run.log_metrics({"mse": 1.0})
    assert tracking.read_metrics(spark, root).filter("key = 'mse'").count() == 2
    assert {(r["key"], r["value"]) for r in tracking.read_params(spark, root).collect()} == {("lr", "0.1"), ("x.y", None)}


@pytest.mark.parametrize("bytes_a_split", [60, 1000, 1_000_000])
def test_a_quote_that_is_never_closed(spark, tmp_path, bytes_a_split):
    """Its line is rejected and counted; the lines after it are read."""
    path = tmp_path / "news.csv"
    whole = tmp_path / "other.csv"
    whole.write_text("Stock_symbol,Date,Article_title\nX,2023-01-02,\"two\nlines\"\n")
    path.write_text("Date,Stock_symbol,Article_title\n" + "\n".join(f"2023-01-01,S{k},t{k}" if k != 3 else '2023-01-01,S3,"never closed' for k in range(400)) + "\n")
    spark.conf.set("spark.sql.files.maxPartitionBytes", bytes_a_split)
    spark.conf.set("spark.sql.files.openCostInBytes", 1)
    try:
        got = [r["ticker"] for r in market.read_news(spark, str(tmp_path)).orderBy("news_id").collect()]
        bad = [tuple(r) for r in market.rejected_lines(spark, str(tmp_path)).select("file", "line").collect()]
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert got == [f"S{k}" for k in range(400) if k != 3] + ["X"]
    assert bad == [("news.csv", '2023-01-01,S3,"never closed')]


@pytest.mark.parametrize("bytes_a_split", [50, 5000])
def test_records_have_a_bound(spark, tmp_path, bytes_a_split):
    """A record of more characters than the bound loses its first line, wherever splits lie; one below it doesn't."""
    path = tmp_path / "news.csv"
    long = "\n".join(f"part {k} of a long field" for k in range(12))
    path.write_text(f'a,b\n1,"{long}"\n2,x\n3,"short\nfield"\n')
    spark.conf.set("spark.sql.files.maxPartitionBytes", bytes_a_split)
    spark.conf.set("spark.sql.files.openCostInBytes", 1)
    try:
        read = lambda most: delimited.read_records(spark, str(path), ("a", "b"), most).orderBy("_at").collect()
        enough, less = read(1000), read(120)
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert [(r["a"], r["b"]) for r in enough] == [("1", long), ("2", "x"), ("3", "short\nfield")]
    assert [r["_reject"] for r in less if r["_reject"]] == ['1,"part 0 of a long field']
    assert [(r["a"], r["b"]) for r in less if r["a"] in ("2", "3")] == [("2", "x"), ("3", "short\nfield")]


def test_stream_refuses_other_headers(spark, tmp_path):
    landing = tmp_path / "landing"
    landing.mkdir()
    (landing / "a.csv").write_text("Date,Stock_symbol,Article_title,Url,Publisher,Author,Article\n2023-01-01,AAPL,a title,,,,\n")
    query = ingest_stream(spark, str(landing), str(tmp_path / "target"), str(tmp_path / "cp"))
    with pytest.raises(StreamingQueryException):
        query.awaitTermination()
    assert not list((tmp_path / "target").rglob("part-*.parquet"))
