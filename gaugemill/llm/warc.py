"""A content-addressed archive of web records: payload bytes once, exact headers apart, records rebuilt by joins.

write_archive() stores two tables. payloads(digest, payload) has one row for each distinct payload, under its SHA-256.
headers(page_id, record_type, digest, header) has the exact bytes of every record that stand before the payload: WARC
header, blank line and HTTP header. read_archive() joins them by digest, computes every payload's SHA-256 again, and fails
if it differs; record_bytes() frames each record as a WARC file holds it, and parsed_records() takes such records apart again. Of the records with equal payloads of at least MIN_REVISIT bytes, that with the largest page_id is
a response and the others are revisits of it; all smaller ones are responses.

Before anything is stored, payloads under one SHA-256 must agree in length and SHA-1. Only ids and digests are grouped;
each distinct payload crosses the network at most once to be stored and once for the rebuilt records.

Defined cases: null html is an empty payload. A null page_id counts as the smallest; if several rows tie at
the largest page_id, all of these are responses. A null url has no WARC-Target-URI; line ends in a url are percent-encoded.
Repeated rows give repeated records. An empty table gives an empty archive.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gaugemill.llm.common import few_rows, map_pandas, materialize, shared_path, table

MIN_REVISIT = 1000
DATE = "1970-01-01T00:00:00Z"
#: Up to so many (id, digest) pairs, about 100 bytes each, are broadcast; more are joined by a shuffle.
SMALL = 100_000
CRLF = "\r\n"


def _header(kind: str) -> Column:
    """kind: response or revisit; the columns page_id, url, n, sha1, keeper are at hand."""
    record = lambda c: F.concat(F.lit("<urn:page:"), F.coalesce(c.cast("string"), F.lit("null")), F.lit(">"))
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value, F.lit(CRLF))
    http = F.concat(F.lit(f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{CRLF}Content-Length: "), F.col("n").cast("string"), F.lit(CRLF * 2))
    length = F.octet_length(http) + (F.col("n") if kind == "response" else F.lit(0))
    url = F.replace(F.replace("url", F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))
    parts = [
        F.lit(f"WARC/1.1{CRLF}WARC-Type: {kind}{CRLF}"),
        line("WARC-Record-ID", record(F.col("page_id"))),
        line("WARC-Date", F.lit(DATE)),
        F.coalesce(line("WARC-Target-URI", url), F.lit("")),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("sha1"))),
    ]
    if kind == "revisit":
        parts += [line("WARC-Profile", F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")), line("WARC-Refers-To", record(F.col("keeper")))]
    parts += [line("Content-Type", F.lit("application/http;msgtype=response")), line("Content-Length", length.cast("string")), F.lit(CRLF), http]
    return F.concat(*parts)


def write_archive(pages: DataFrame, path: str, min_revisit: int = MIN_REVISIT, small: int = SMALL) -> None:
    """pages(page_id, url, html) into path/headers and path/payloads."""
    payload = F.encode(F.coalesce("html", F.lit("")), "UTF-8")
    full = pages.select("page_id", "url", payload.alias("payload")).withColumn("digest", F.sha2("payload", 256))
    ids = materialize(full.select("page_id", "url", "digest", F.sha1("payload").alias("sha1"), F.octet_length("payload").cast("long").alias("n")), "warc-ids")
    same = (F.min("sha1") == F.max("sha1")) & (F.min("n") == F.max("n"))
    groups = ids.groupBy(F.col("digest").alias("_digest")).agg(F.max("page_id").alias("keeper"), F.count("*").alias("rows"), F.when(same, True).otherwise(F.raise_error(F.lit("two payloads share a SHA-256"))).alias("verified"))
    groups = materialize(groups, "warc-groups").where("rows > 1 and verified").select("_digest", "keeper", F.lit(True).alias("shared"))
    marked = ids.join(groups, F.col("digest") == F.col("_digest"), "left").drop("_digest")
    stored = F.col("shared").isNull() | F.col("page_id").eqNullSafe(F.col("keeper"))
    revisit = ~stored & (F.col("n") >= min_revisit)
    headers = marked.select("page_id", F.when(revisit, "revisit").otherwise("response").alias("record_type"), "digest", F.when(revisit, _header("revisit")).otherwise(_header("response")).alias("header"), stored.alias("stored"), F.coalesce("shared", F.lit(False)).alias("shared"))
    headers.write.parquet(f"{path}/headers")
    headers = pages.sparkSession.read.schema(headers.schema).parquet(f"{path}/headers")
    skip = headers.where("not stored").select(F.col("page_id").alias("_id"), F.col("digest").alias("_digest"))
    skip = F.broadcast(skip) if few_rows(skip, small) else skip
    kept = full.join(skip, (F.col("digest") == F.col("_digest")) & F.col("page_id").eqNullSafe(F.col("_id")), "left_anti").select("digest", "payload")
    if headers.where("stored and shared").groupBy("digest").count().where("count > 1").limit(1).count():
        kept = kept.dropDuplicates(["digest"])
    kept.write.parquet(f"{path}/payloads")


def read_archive(spark: SparkSession, path: str) -> DataFrame:
    """Every record of the archive: page_id, record_type, header, payload (that of a revisit from what it refers to)."""
    headers = spark.read.parquet(f"{path}/headers").select("page_id", "record_type", "digest", "header")
    payloads = spark.read.parquet(f"{path}/payloads")
    whole = F.when(F.sha2("payload", 256) == F.col("digest"), F.col("payload")).otherwise(F.raise_error(F.lit("a stored payload does not have its digest")).cast("binary"))
    return headers.join(payloads, "digest").select("page_id", "record_type", "header", whole.alias("payload"))


def record_bytes(records: DataFrame) -> DataFrame:
    """All columns of records, and record: what a WARC file holds for each, with the two line ends that close it."""
    body = F.when(F.col("record_type") == "response", F.col("payload")).otherwise(F.lit(b""))
    return records.withColumn("record", F.concat(F.encode("header", "UTF-8"), body, F.lit((CRLF * 2).encode())))


def parsed_records(framed: DataFrame) -> DataFrame:
    """framed with header and body (bytes after the HTTP header) as its column record says; an error if a record isn't as long as its Content-Length.

    Headers are ASCII or UTF-8 without empty lines, so the first two empty lines end them, whatever the payload holds.
    """
    text, stop = F.decode("record", "UTF-8"), CRLF * 2
    heads = F.concat(F.substring_index(text, stop, 2), F.lit(stop))
    framed = framed.drop("header").withColumn("header", heads)
    warc = F.octet_length(F.concat(F.substring_index("header", stop, 1), F.lit(stop)))
    length = F.regexp_extract("header", r"(?i)\r\ncontent-length: *(\d+)\r\n", 1).cast("int")
    fits = (F.octet_length("record") == warc + length + 4) & (F.substring("record", -4, 4) == F.lit(stop.encode()))
    skip = F.octet_length("header")
    body = F.substr("record", skip + 1, F.octet_length("record") - skip - 4)
    return framed.withColumn("body", F.when(fits, body).otherwise(F.raise_error(F.lit("a record does not end where its Content-Length says")).cast("binary")))


def export_warc(records: DataFrame, path: str, records_per_file: int = 10_000) -> None:
    """Standard WARC files: the text writer's line end closes each record."""
    text = record_bytes(records).select(F.decode(F.substr("record", F.lit(1), F.octet_length("record") - 4), "UTF-8").alias("value"))
    text.write.option("lineSep", CRLF * 2).option("maxRecordsPerFile", records_per_file).text(path)


def parse_warc(content: bytes) -> Iterator[tuple[str, bytes]]:
    """(headers up to the payload, payload) of each record of a WARC file."""
    at = 0
    while at < len(content):
        end = content.index(b"\r\n\r\n", at) + 4
        head = content[at:end].decode()
        length = next(int(x.split(":")[1]) for x in head.split(CRLF) if x.lower().startswith("content-length:"))
        block = content[end : end + length]
        if content[end + length : end + length + 4] != b"\r\n\r\n":
            raise ValueError(f"the record at byte {at} does not end where its Content-Length says")
        http = block.index(b"\r\n\r\n") + 4
        yield head + block[:http].decode(), block[http:]
        at = end + length + 4


def import_warc(spark: SparkSession, path: str) -> DataFrame:
    """page_id, record_type, header, payload as they stand in WARC files; a file has to fit in a task's memory."""

    def parsed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for content in batch["content"]:
                rows = list(parse_warc(content))
                yield pd.DataFrame({"header": [h for h, _ in rows], "payload": [p for _, p in rows]})

    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("content")
    found = map_pandas(found, parsed, "header string, payload binary")
    return found.select(field(r"WARC-Record-ID: <urn:page:(-?\d+)>").cast("long").alias("page_id"), field(r"WARC-Type: (\w+)").alias("record_type"), "header", "payload")


def field(pattern: str) -> Column:
    """The first group of pattern in a line of the header, or null."""
    return F.nullif(F.regexp_extract("header", rf"\r\n{pattern}\r\n", 1), F.lit(""))


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared_path(spark, "warc")
    write_archive(table(spark, sf_dir, "pages"), path)
    kind = field(r"WARC-Type: (\w+)")
    full = F.when(kind == "response", F.col("body")).otherwise(F.col("payload"))
    return parsed_records(record_bytes(read_archive(spark, path))).select(
        field(r"WARC-Record-ID: <urn:page:(-?\d+)>").cast("long").alias("page_id"),
        F.octet_length(full).cast("long").alias("payload_bytes"),
        F.sha1(full).alias("payload_digest"),
        kind.alias("record_type"),
        field(r"WARC-Refers-To: <urn:page:(-?\d+)>").cast("long").alias("refers_to"),
    )


OP2_SQL = """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b FROM pages),
d AS (SELECT page_id, octet_length(b) AS n, sha1(b) AS h FROM p),
k AS (SELECT *, max(page_id) OVER (PARTITION BY h, n) AS keeper FROM d)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, h AS payload_digest,
  CASE WHEN n >= 1000 AND page_id <> keeper THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN n >= 1000 AND page_id <> keeper THEN keeper END AS refers_to FROM k
"""
