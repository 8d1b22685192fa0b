"""Content-addressed WARC archive: payload bytes once by SHA-256, exact record headers apart, records rebuilt by joins."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import checkpoint_root, deal, hot_keys, join_hot, stage

#: Digits of base 32 as conv() writes them, and the alphabet of RFC 4648.
CONV_DIGITS = "0123456789ABCDEFGHIJKLMNOPQRSTUV"
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
WARC_DATE = "2024-01-01T00:00:00Z"
END = "\r\n\r\n"


def base32_sha1(payload: Column) -> Column:
    """Upper-case base32 of SHA-1: eight groups of five hex digits are four base-32 digits each."""
    digest = F.sha1(payload)
    groups = [F.lpad(F.conv(F.substring(digest, 1 + 5 * k, 5), 16, 32), 4, "0") for k in range(8)]
    return F.translate(F.concat(*groups), CONV_DIGITS, BASE32)


def one_line(url: Column) -> Column:
    """Line ends as URIs write them, since a field is one line."""
    return F.replace(F.replace(url, F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))


def header(record_type: Column) -> Column:
    """The record's header block: named fields, CRLF line ends, an empty line. A revisit has no payload of its own."""
    revisit = record_type == "revisit"
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value, F.lit("\r\n"))
    return F.concat(
        F.lit("WARC/1.1\r\n"),
        line("WARC-Type", record_type),
        line("WARC-Record-ID", F.concat(F.lit("<urn:page:"), F.coalesce(F.col("page_id").cast("string"), F.lit("-")), F.lit(">"))),
        F.when(F.col("url").isNotNull(), line("WARC-Target-URI", one_line(F.col("url")))).otherwise(F.lit("")),
        line("WARC-Date", F.lit(WARC_DATE)),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("sha1_b32"))),
        F.when(revisit, line("WARC-Refers-To", F.concat(F.lit("<urn:page:"), F.col("first_id").cast("string"), F.lit(">")))).otherwise(F.lit("")),
        F.when(revisit, line("WARC-Profile", F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"))).otherwise(F.lit("")),
        line("Content-Type", F.lit("text/html; charset=utf-8")),
        line("Content-Length", F.when(revisit, F.lit(0)).otherwise(F.col("payload_bytes")).cast("string")),
        F.lit("\r\n"),
    )


def write_archive(pages: DataFrame, path: str, min_revisit_bytes: int = 0) -> None:
    """Write ``payloads`` (digest, payload), a row for each different payload, and ``headers`` (page_id, digest, header).

    A null html is an empty payload; a null url leaves its field out. Of records with equal payloads of at least
    ``min_revisit_bytes`` the smallest page_id is the response, the others revisit it; smaller ones are responses all.
    Rows that repeat with one page_id are one page: all are responses where that page is the first. A page without
    page_id can't be referred to, and is a response. An empty table writes empty tables.
    """
    page = pages.select(
        F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"),
        F.encode(F.coalesce("html", F.lit("")), "UTF-8").alias("payload"),
    ).withColumn("digest", F.sha2("payload", 256))
    page.groupBy("digest").agg(F.first("payload").alias("payload")).write.mode("overwrite").parquet(f"{path}/payloads")
    keyed = stage(page.select("page_id", "url", "digest", F.length("payload").cast("long").alias("payload_bytes"), base32_sha1(F.col("payload")).alias("sha1_b32")), "pages")
    first = keyed.groupBy("digest").agg(F.min("page_id").alias("first_id"), F.count("*").alias("n"))
    own = (F.col("page_id") == F.col("first_id")) | F.col("page_id").isNull() | (F.col("payload_bytes") < min_revisit_bytes)
    typed = join_hot(keyed, first, "digest").withColumn("record_type", F.when(own, "response").otherwise("revisit"))
    typed.select("page_id", "digest", header(F.col("record_type")).alias("header")).write.mode("overwrite").parquet(f"{path}/headers")


def verified_payloads(spark, path: str) -> DataFrame:
    """The stored payloads, each checked against the digest that it is stored under."""
    stored = spark.read.schema("digest string, payload binary").parquet(f"{path}/payloads")
    return stored.withColumn("digest", F.when(F.sha2("payload", 256) == F.col("digest"), F.col("digest")).otherwise(F.raise_error(F.concat(F.lit("payload differs from its digest "), "digest"))))


def read_headers(spark, path: str) -> DataFrame:
    """The records' headers, parsed: page_id, record_type, refers_to, stated_digest, stated_bytes, digest, header."""
    raw = spark.read.schema("page_id long, digest string, header string").parquet(f"{path}/headers")
    field = lambda name, kind: F.regexp_extract("header", rf"\r\n{name}: {kind}\r\n", 1)
    return raw.select(
        F.expr(r"try_cast(nullif(regexp_extract(header, '\r\nWARC-Record-ID: <urn:page:([0-9-]+)>\r\n', 1), '') AS BIGINT)").alias("page_id"),
        field("WARC-Type", "([a-z]+)").alias("record_type"),
        F.expr(r"try_cast(nullif(regexp_extract(header, '\r\nWARC-Refers-To: <urn:page:([0-9-]+)>\r\n', 1), '') AS BIGINT)").alias("refers_to"),
        field("WARC-Payload-Digest", "sha1:([A-Z2-7]+)").alias("stated_digest"), field("Content-Length", "([0-9]+)").cast("long").alias("stated_bytes"), "digest", "header",
    )


def reconstruct(spark, path: str) -> DataFrame:
    """Every original record: header fields, full payload (a revisit's too) and record bytes as a WARC file holds them.

    The records of a very frequent payload are dealt over pieces, each with a copy of it.
    """
    headers = read_headers(spark, path)
    hot = hot_keys(headers, "digest")
    full = deal(headers, "digest", hot, "header").join(deal(verified_payloads(spark, path), "digest", hot, None), ["digest", "piece"]).drop("piece")
    own = F.when(F.col("record_type") == "revisit", F.lit(b"")).otherwise(F.col("payload"))
    return full.withColumn("record", F.concat(F.encode("header", "UTF-8"), own, F.lit(END.encode())))


def export_warc(spark, path: str, target: str) -> None:
    """Write the records as WARC files: each line of Spark's text writer is a record, the line end is the record's end."""
    records = reconstruct(spark, path).select(F.decode(F.expr("substring(record, 1, length(record) - 4)"), "UTF-8").alias("value"))
    records.write.mode("overwrite").option("lineSep", END).text(target)


def archive_round_trip(pages: DataFrame, min_revisit_bytes: int = 0) -> DataFrame:
    """Archive the pages in the shared folder, rebuild every record from what is stored, and say what it is.

    Payload length and digest are those of the rebuilt payload: a response's is cut out of its record's bytes, a revisit's
    comes from the store. A record that doesn't hold what its header states is an error. Nulls, repeated rows and empty
    tables: see write_archive(). Only page_id, url and html are read, so further columns can have any name.
    """
    spark = pages.sparkSession
    path = f"{checkpoint_root(spark)}/tideline/archive-{uuid.uuid4().hex}"
    write_archive(pages, path, min_revisit_bytes)
    body = F.expr("substring(record, length(encode(header, 'UTF-8')) + 1, length(record) - length(encode(header, 'UTF-8')) - 4)")
    back = reconstruct(spark, path).withColumn("body", body)
    back = back.withColumn("whole", F.when(F.col("record_type") == "revisit", F.col("payload")).otherwise(F.col("body"))).withColumn("payload_digest", base32_sha1(F.col("whole")))
    sound = (F.length("body") == F.col("stated_bytes")) & (F.col("payload_digest") == F.col("stated_digest"))
    digest = F.when(sound, F.col("payload_digest")).otherwise(F.raise_error(F.concat(F.lit("record differs from its header "), "header")))
    return back.select("page_id", F.length("whole").cast("long").alias("payload_bytes"), digest.alias("payload_digest"), "record_type", "refers_to")
