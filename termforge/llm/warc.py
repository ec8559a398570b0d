"""WARC archives by content: payload bytes once under a verified SHA-256, exact
record headers apart, original records rebuilt by a join.

write_archive() gives two Parquet tables in one folder: payloads(sha256, payload),
one row for each distinct payload, and headers(page_id, sha256, header), one row for
each record with all that a WARC 1.1 file would hold before the payload: the record's
header block and the head of its HTTP response. Of records with equal payloads of at least
min_bytes, the one with the largest id is the response and the others are revisits that
refer to its record id and end with their HTTP head; smaller payloads are all responses.

read_records() verifies every payload against its key, every header's digest and length
against the payload, and finds what a revisit refers to by its WARC-Refers-To; any
mismatch fails. reconstruct() joins headers and payloads into whole records again.

Null html is an empty payload; a null url leaves the target empty; a null id sorts
below every other (a payload that only has null ids is all responses). Repeated rows
each give a record with an id of its own; those that share the largest page_id are all
responses. A payload is one value however long it is. An empty table gives an empty
archive, and columns besides page_id, url and html are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import scratch, stored, utf8

WARC_DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def base32_sha1(payload: Column) -> Column:
    """Upper-case base32 of SHA-1, 160 bits being 32 letters without padding."""
    # By tens of hexadecimal digits, which are eight letters each; the payload is hashed once.
    tens = F.regexp_extract_all(F.sha1(payload), F.lit("(.{10})"), 1)
    eight = lambda x: F.lpad(F.conv(x, 16, 32), 8, "0")
    return F.translate(F.array_join(F.transform(tens, eight), ""), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def record_id(*of: Column) -> Column:
    """A UUID of what tells the record apart."""
    h = F.md5(F.concat_ws("\x1f", *[F.coalesce(c.cast("string"), F.lit("")) for c in of]).cast("binary"))
    return F.concat(F.lit("<urn:uuid:"), *[x for i, (a, n) in enumerate(((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))) for x in ([F.lit("-")] if i else []) + [F.substring(h, a, n)]], F.lit(">"))


def write_archive(pages: DataFrame, path: str, min_bytes: int = 0) -> None:
    payload = utf8("html")
    raw = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), payload.alias("payload")).withColumn("sha256", F.sha2("payload", 256))
    (
        raw.groupBy("sha256").agg(F.max("payload").alias("payload"))  # equal under one digest; checked again on reading
        .write.option("compression", "zstd").parquet(f"{path}/payloads")
    )
    # Tables of their own: rows keep their numbers, texts are hashed once more only, and the
    # join meets plain shuffles, of which Spark splits a hot payload's.
    slim = raw.select("page_id", "url", "sha256", F.length("payload").cast("long").alias("size"), base32_sha1(F.col("payload")).alias("sha1"), F.monotonically_increasing_id().alias("row"))
    slim = stored(slim.withColumn("id", record_id(F.col("page_id"), F.col("url"), F.col("row"))).drop("row"), "warc-slim")
    keepers = stored(slim.where(F.col("size") >= min_bytes).groupBy("sha256").agg(F.max(F.struct("page_id", "url", "id")).alias("keeper")), "warc-keepers")
    joined = slim.join(keepers, "sha256", "left")
    revisit = F.col("keeper.page_id").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("keeper.page_id"))
    line = lambda name, value: F.concat(F.lit(name + ": "), value, F.lit("\r\n"))
    target = F.regexp_replace(F.coalesce("url", F.lit("")), r"[\r\n]", " ")
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"), line("Content-Length", F.col("size").cast("string")), F.lit("\r\n"))
    refers = F.concat(line("WARC-Profile", F.lit(PROFILE)), line("WARC-Refers-To", F.col("keeper.id")))
    header = F.concat(
        F.lit("WARC/1.1\r\n"),
        line("WARC-Type", F.when(revisit, F.lit("revisit")).otherwise(F.lit("response"))),
        line("WARC-Target-URI", target),
        line("WARC-Date", F.lit(WARC_DATE)),
        line("WARC-Record-ID", F.col("id")),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("sha1"))),
        F.when(revisit, refers).otherwise(F.lit("")),
        line("Content-Type", F.lit("application/http; msgtype=response")),
        line("Content-Length", (F.octet_length(http) + F.when(revisit, F.lit(0)).otherwise(F.col("size"))).cast("string")),
        F.lit("\r\n"),
        http,
    )
    joined.select("page_id", "sha256", header.cast("binary").alias("header")).write.option("compression", "zstd").parquet(f"{path}/headers")


def _payloads(spark: SparkSession, path: str) -> DataFrame:
    stored = spark.read.parquet(f"{path}/payloads")
    sound = F.sha2("payload", 256) == F.col("sha256")
    return stored.withColumn("payload", F.when(sound, F.col("payload")).otherwise(F.raise_error(F.concat(F.lit("payload does not match its digest "), F.col("sha256")))))


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """page_id and what its header and its stored payload say; payloads stay where they
    are, only their sizes and digests, computed from the bytes read back, are joined."""
    head = F.col("header").cast("string")
    field = lambda name: F.regexp_extract(head, rf"\r\n{name}: ([^\r\n]*)\r\n", 1)
    http = F.octet_length(head) - F.octet_length(F.substring_index(head, "\r\n\r\n", 1)) - 4
    refers = field("WARC-Refers-To")
    headers = spark.read.parquet(f"{path}/headers")
    told = headers.select(
        "page_id", "sha256", field("WARC-Type").alias("record_type"), F.when(refers != "", refers).otherwise(F.concat(F.lit("none "), "sha256")).alias("to"), field("WARC-Payload-Digest").alias("told"), field("Content-Length").cast("long").alias("length"), http.alias("http")
    )
    facts = _payloads(spark, path).select("sha256", F.length("payload").cast("long").alias("payload_bytes"), base32_sha1(F.col("payload")).alias("payload_digest"))
    body = F.when(F.col("record_type") == "revisit", F.lit(0)).otherwise(F.col("payload_bytes"))
    sound = (F.col("told") == F.concat(F.lit("sha1:"), F.col("payload_digest"))) & (F.col("length") == F.col("http") + body)
    checked = F.when(sound, F.col("payload_digest")).otherwise(F.raise_error(F.concat(F.lit("header and payload differ: "), F.col("sha256"))))
    joined = told.join(facts, "sha256", "left").select("page_id", "payload_bytes", checked.alias("payload_digest"), "record_type", "to")
    # Only responses are referred to; a revisit whose response is lost fails.
    responses = headers.where(field("WARC-Type") == "response").select(field("WARC-Record-ID").alias("to"), F.col("page_id").alias("refers_to"))
    found = F.when((F.col("record_type") == "response") | F.col("refers_to").isNotNull(), F.col("refers_to")).otherwise(F.raise_error(F.concat(F.lit("no response "), F.col("to"))))
    return joined.join(responses, "to", "left").select("page_id", "payload_bytes", "payload_digest", "record_type", found.alias("refers_to"))


def reconstruct(spark: SparkSession, path: str) -> DataFrame:
    """page_id and its record's exact bytes: header, HTTP head, payload (responses), two line ends."""
    headers = spark.read.parquet(f"{path}/headers")
    body = F.when(F.col("header").cast("string").contains("\r\nWARC-Type: revisit\r\n"), F.lit(b"").cast("binary")).otherwise(F.col("payload"))
    return headers.join(_payloads(spark, path), "sha256", "left").select("page_id", F.concat("header", body, F.lit(b"\r\n\r\n").cast("binary")).alias("record"))


def round_trip(pages: DataFrame) -> DataFrame:
    path = scratch(pages.sparkSession, "warc")
    write_archive(pages, path)
    return read_records(pages.sparkSession, path)


SQL = r"""
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
     d AS (SELECT h, max(page_id) AS keeper, strlen(h) AS n, sha1(h) AS x FROM p GROUP BY h)
SELECT p.page_id, CAST(n AS BIGINT) AS payload_bytes,
       array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
         CAST(1 + ((CAST('0x' || substr(x, CAST(1 + 5 * (i // 4) AS BIGINT), 5) AS INTEGER) >> CAST(15 - 5 * (i % 4) AS INTEGER)) & 31) AS BIGINT), 1)), '') AS payload_digest,
       CASE WHEN page_id = keeper THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id = keeper THEN NULL ELSE keeper END AS refers_to
FROM p JOIN d USING (h)
"""
