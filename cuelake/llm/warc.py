"""Content-addressed WARC archives: payloads stored once by digest, record headers kept exactly, records joined back.

An archive is a folder with two sets of gzip files. ``headers`` holds the exact WARC and HTTP header bytes of every
record, ``payloads`` every distinct payload once as a ``resource`` record under its SHA-256. Each record begins with
the archive's own token line, which no payload holds by chance (128 random bits), so Spark's text reader cuts
the files at records, whatever the payloads contain. A record is its headers followed by the payload of its digest.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cuelake.llm.common import join_by_unique

CRLF = "\r\n"
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
NO_ID = "none"


def base32_sha1(payload: Column) -> Column:
    """The SHA-1 of a string's UTF-8 bytes in upper-case base32, from native functions."""
    def group(i: Column) -> Column:
        bits = F.conv(F.substring(F.sha1(payload), i * 5 + 1, F.lit(5)), 16, 10).cast("int")
        letter = lambda right: F.substring(F.lit(BASE32), F.shiftright(bits, right).bitwiseAND(F.lit(31)) + 1, F.lit(1))
        return F.concat(letter(15), letter(10), letter(5), letter(0))

    return F.array_join(F.transform(F.sequence(F.lit(0), F.lit(7)), group), "")


def _urn(name: Column) -> Column:
    """A record id made from a name's digest."""
    h = F.sha2(name.cast("string"), 256)
    return F.concat(F.lit("<urn:uuid:"), F.substring(h, 1, 8), F.lit("-"), F.substring(h, 9, 4), F.lit("-"), F.substring(h, 13, 4), F.lit("-"), F.substring(h, 17, 4), F.lit("-"), F.substring(h, 21, 12), F.lit(">"))


def _lines(*fields: tuple[str, Column]) -> Column:
    """Header lines of the fields that aren't null, each ended by CRLF."""
    return F.concat(*[F.coalesce(F.concat(F.lit(f"{k}: "), v.cast("string"), F.lit(CRLF)), F.lit("")) for k, v in fields])


def write_archive(pages: DataFrame, path: str, date: str = "2024-01-01T00:00:00Z", least_bytes: int = 0) -> None:
    """Write a WARC record for each row of (page_id, url, html).

    Of rows with equal payloads of least_bytes or more, that with the largest page_id is the response and the others
    revisit it; shorter payloads are all responses. Null html is an empty payload, a null url has no target line.
    A null page_id revisits where its payload has a response and else is one. Rows repeated with one page_id and
    payload are repeated records of one type.
    """
    token = uuid.uuid4().hex
    html = F.coalesce(F.col("html"), F.lit(""))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.regexp_replace("url", "[\r\n]", "").alias("url"), html.alias("payload"))
    small = rows.select("page_id", "url", F.octet_length("payload").alias("bytes"), base32_sha1(F.col("payload")).alias("sha1"), F.sha2("payload", 256).alias("digest"))
    chosen = small.groupBy("digest").agg(F.max("page_id").alias("first_id"))
    small = join_by_unique(small, chosen, "digest", F.col("page_id"))
    revisits = (F.col("bytes") >= least_bytes) & F.col("first_id").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first_id"))
    http = F.concat(F.lit(f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{CRLF}Content-Length: "), F.col("bytes").cast("string"), F.lit(CRLF * 2))
    head = F.concat(
        F.lit(f"WARC/1.1{CRLF}WARC-Archive: {token}{CRLF}"),
        _lines(
            ("WARC-Type", F.when(revisits, F.lit("revisit")).otherwise(F.lit("response"))),
            ("WARC-Record-ID", _urn(F.concat(F.lit("page "), F.coalesce(F.col("page_id").cast("string"), F.lit(NO_ID)), F.lit(" "), "digest"))),
            ("WARC-Page-ID", F.coalesce(F.col("page_id").cast("string"), F.lit(NO_ID))),
            ("WARC-Target-URI", F.col("url")),
            ("WARC-Date", F.lit(date)),
            ("WARC-Payload-Digest", F.concat(F.lit("sha1:"), "sha1")),
            ("WARC-Payload-Address", F.concat(F.lit("sha256:"), "digest")),
            ("WARC-Refers-To", F.when(revisits, _urn(F.concat(F.lit("page "), F.col("first_id").cast("string"), F.lit(" "), F.col("digest"))))),
            ("WARC-Refers-To-Page-ID", F.when(revisits, F.col("first_id"))),
            ("WARC-Profile", F.when(revisits, F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"))),
            ("Content-Type", F.lit("application/http; msgtype=response")),
            ("Content-Length", F.octet_length(http) + F.when(revisits, F.lit(0)).otherwise(F.col("bytes"))),
        ),
        F.lit(CRLF),
    )
    out = {"lineSep": CRLF * 2, "compression": "gzip"}
    small.select(F.concat(head, http).alias("value")).write.options(**out).text(f"{path}/headers")
    stored = rows.select(F.sha2("payload", 256).alias("digest"), "payload").groupBy("digest").agg(F.first("payload").alias("payload"))
    kept = F.concat(
        F.lit(f"WARC/1.1{CRLF}WARC-Archive: {token}{CRLF}"),
        _lines(("WARC-Type", F.lit("resource")), ("WARC-Record-ID", _urn(F.col("digest"))), ("WARC-Date", F.lit(date)), ("WARC-Payload-Address", F.concat(F.lit("sha256:"), "digest")), ("Content-Type", F.lit("text/html; charset=utf-8")), ("Content-Length", F.octet_length("payload"))),
        F.lit(CRLF),
        F.col("payload"),
    )
    stored.select(kept.alias("value")).write.options(**out).text(f"{path}/payloads")
    pages.sparkSession.range(1).select(F.lit(token).alias("value")).coalesce(1).write.text(f"{path}/token")


def _blocks(spark: SparkSession, path: str, part: str, token: str) -> DataFrame:
    """(head, body) of the records of one set of files; body still has the CRLFs that end a record."""
    raw = spark.read.option("lineSep", f"WARC/1.1{CRLF}WARC-Archive: {token}{CRLF}").text(f"{path}/{part}").where("value <> ''")
    at = F.instr("value", CRLF * 2)
    return raw.select(F.substring("value", F.lit(1), at + 1).alias("head"), F.substring("value", at + 4, F.length("value")).alias("body"))


def _field(name: str) -> Column:
    """A header's value, null if it isn't there."""
    return F.nullif(F.regexp_extract("head", f"(?:^|\n){name}: ([^\r\n]*)\r", 1), F.lit(""))


def read_archive(spark: SparkSession, path: str) -> DataFrame:
    """The records of an archive: page_id, record_type, refers_to, sha1, digest, payload, and record, the full exact text.

    Payloads are held against their address and SHA-1 as they are read; a mismatch stops the query.
    """
    token = spark.read.text(f"{path}/token").first()[0]
    heads = _blocks(spark, path, "headers", token)
    heads = heads.select(
        F.nullif(_field("WARC-Page-ID"), F.lit(NO_ID)).cast("long").alias("page_id"),
        _field("WARC-Type").alias("record_type"),
        _field("WARC-Refers-To-Page-ID").cast("long").alias("refers_to"),
        F.substring_index(_field("WARC-Payload-Digest"), ":", -1).alias("sha1"),
        F.substring_index(_field("WARC-Payload-Address"), ":", -1).alias("digest"),
        "head",
        "body",
    )
    kept = _blocks(spark, path, "payloads", token)
    payload = F.expr("substring(body, 1, length(body) - 4)")
    kept = kept.select(F.substring_index(_field("WARC-Payload-Address"), ":", -1).alias("digest"), payload.alias("payload"))
    kept = kept.select("payload", F.when(F.sha2("payload", 256) == F.col("digest"), F.col("digest")).otherwise(F.raise_error(F.lit("stored payload doesn't have its digest"))).alias("digest"))
    both = join_by_unique(heads, kept, "digest", F.col("page_id"))
    http = F.expr("substring(body, 1, length(body) - 4)")
    whole = F.concat(F.lit(f"WARC/1.1{CRLF}WARC-Archive: {token}{CRLF}"), "head", F.lit(CRLF), http, F.when(F.col("record_type") == "response", F.col("payload")).otherwise(F.lit("")), F.lit(CRLF * 2))
    checked = F.when(base32_sha1(F.col("payload")) == F.col("sha1"), F.col("sha1")).otherwise(F.raise_error(F.lit("record's payload doesn't have its SHA-1")))
    return both.select("page_id", "record_type", "refers_to", checked.alias("sha1"), "digest", "payload", whole.alias("record"))
