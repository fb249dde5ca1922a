"""WARC archives: writing captures, and transaction assembly from the records read back.

Every capture is written as three records: the request, the response (or a revisit, where an equal
payload has been captured under a smaller id) and a metadata record. Request and metadata name the
capture by WARC-Concurrent-To; assembly joins the three through it and emits one nested row for
each capture.

Archives are written by Spark's text sink, whose separator is the blank line that ends a record, so
each part file is a valid gzipped WARC file (one gzip member each, as Spark's sink can't begin new
ones); they are read by Spark's binary file source. Both work on any store that Spark can reach.
"""

from __future__ import annotations

import gzip
import io
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from reelspark.llm.common import materialise, nonnull_text, read_table, shared_folder

CRLF = "\r\n"
#: Bytes of payload in one archive file on average, so that one file fits a task's memory, and records in it at most.
FILE_BYTES, RECORDS_PER_FILE = 32 << 20, 30_000
#: Bytes of payload in one Arrow batch at most (and at least one record).
BATCH_BYTES = 8 << 20

#: Stands for a null page_id where rows are joined.
_NO_PAGE = -(1 << 63)

RECORD_SCHEMA = T.StructType(
    [
        T.StructField("record_id", T.StringType()),
        T.StructField("record_type", T.StringType()),
        T.StructField("concurrent_to", T.StringType()),
        T.StructField("serial", T.LongType()),
        T.StructField("target_uri", T.StringType()),
        T.StructField("refers_to", T.StringType()),
        T.StructField("digest", T.StringType()),
        T.StructField("http_header", T.StringType()),
        T.StructField("payload", T.BinaryType()),
    ]
)


def base32_sha1(payload: Column) -> Column:
    """Bare upper-case base32 of the SHA-1, 32 letters: five bytes at a time make eight base-32 digits."""
    digits = [F.lpad(F.conv(F.substring(F.sha1(payload), 1 + 10 * i, 10), 16, 32), 8, "0") for i in range(4)]
    return F.translate(F.concat(*digits), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def _urn(*parts: Column) -> Column:
    """A record id in the form of a UUID, fixed by ``parts``."""
    h = F.md5(F.concat_ws("|", *[F.coalesce(p.cast("string"), F.lit("null")) for p in parts]))
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *[F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]), F.lit(">"))


def _record(headers: list[tuple[str, Column | None]], block: Column) -> Column:
    """One record without its closing blank line. A header whose value is null is left out."""
    lines = [F.lit("WARC/1.0" + CRLF)]
    for name, value in [*headers, ("Content-Length", F.octet_length(block).cast("string"))]:
        lines.append(F.coalesce(F.concat(F.lit(f"{name}: "), value, F.lit(CRLF)), F.lit("")))
    return F.concat(*lines, F.lit(CRLF), block)


def write_captures(pages: DataFrame, path: str, smallest: int = 0, date: str = "2024-01-01T00:00:00Z") -> None:
    """Write the rows of ``pages`` (page_id, url, html) as WARC files below ``path``.

    Of captures with equal payloads of at least ``smallest`` bytes, the one with the smallest
    page_id is a response and the others revisit it; of rows that share that page_id too, each is a
    response. Null html is an empty payload, a null url an empty target; a null page_id sorts after
    all others. Line breaks within a url become spaces, as a header can't hold them. An empty table
    gives no records; other columns are ignored.

    Which pages revisit which is worked out by ids and digests alone. Payloads move once, dealt by
    page and digest to files of about FILE_BYTES; a page of more makes a larger file.
    """
    payload = nonnull_text("html")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.regexp_replace(nonnull_text("url"), r"[\r\n]", " ").alias("uri"), payload.alias("payload"))
    rows = rows.withColumns({"digest": base32_sha1(F.col("payload")), "octets": F.octet_length("payload"), "page_key": F.coalesce("page_id", F.lit(_NO_PAGE))})
    short = materialise(rows.select("page_id", "page_key", "digest", "octets"))
    firsts = materialise(short.filter(F.col("octets") >= smallest).groupBy("digest").agg(F.min("page_id").alias("first_id"), F.count(F.lit(1)).alias("n")).filter("n > 1 AND first_id IS NOT NULL").select("digest", "first_id"))
    revisits = short.join(firsts, "digest").filter("NOT page_id <=> first_id").select("page_key", "digest", "first_id").distinct()
    total = short.agg(F.coalesce(F.sum(F.col("octets").cast("long")), F.lit(0)).alias("b")).first()["b"]
    rows = rows.repartition(max(1, -(-total // FILE_BYTES)), "page_key", "digest").join(materialise(revisits), ["page_key", "digest"], "left")
    rows = rows.withColumn("serial", F.monotonically_increasing_id()).withColumn("revisit", F.col("first_id").isNotNull())
    # a response's id follows from its page and payload, so that a revisit can name it
    rows = rows.withColumn("id", F.when(F.col("revisit"), _urn(F.lit("revisit"), F.col("page_id"), F.col("digest"), F.col("serial"))).otherwise(_urn(F.lit("response"), F.col("page_id"), F.col("digest"))))
    serial, stamp = F.col("serial").cast("string"), F.lit(date)
    http = F.concat(F.lit(f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{CRLF}Content-Length: "), F.col("octets").cast("string"), F.lit(CRLF + CRLF))
    host = F.regexp_extract("uri", r"^[^:]*://([^/?#]*)", 1)
    target = F.regexp_extract("uri", r"^[^:]*://[^/?#]*([^#]*)", 1)
    capture = _record(
        [
            ("WARC-Type", F.when(F.col("revisit"), "revisit").otherwise("response")),
            ("WARC-Record-ID", F.col("id")),
            ("WARC-Date", stamp),
            ("WARC-Target-URI", F.col("uri")),
            ("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("digest"))),
            ("WARC-Refers-To", F.when(F.col("revisit"), _urn(F.lit("response"), F.col("first_id"), F.col("digest")))),
            ("WARC-Profile", F.when(F.col("revisit"), "http://netpreserve.org/warc/1.0/revisit/identical-payload-digest")),
            ("X-Capture-Serial", serial),
            ("Content-Type", F.lit("application/http;msgtype=response")),
        ],
        F.concat(http, F.when(F.col("revisit"), "").otherwise(F.col("payload"))),
    )
    of_it = [("WARC-Date", stamp), ("WARC-Target-URI", F.col("uri")), ("WARC-Concurrent-To", F.col("id")), ("X-Capture-Serial", serial)]
    request = _record(
        [("WARC-Type", F.lit("request")), ("WARC-Record-ID", _urn(F.lit("request"), F.col("id"), F.col("serial"))), *of_it, ("Content-Type", F.lit("application/http;msgtype=request"))],
        F.concat(F.lit("GET "), F.when(target.startswith("/"), target).otherwise(F.concat(F.lit("/"), target)), F.lit(f" HTTP/1.1{CRLF}Host: "), host, F.lit(CRLF + CRLF)),
    )
    fields = F.concat(
        F.coalesce(F.concat(F.lit("page-id: "), F.col("page_id").cast("string"), F.lit(CRLF)), F.lit("")),
        F.coalesce(F.concat(F.lit("refers-to-page-id: "), F.when(F.col("revisit"), F.col("first_id").cast("string")), F.lit(CRLF)), F.lit("")),
        F.lit("payload-octets: "), F.col("octets").cast("string"), F.lit(CRLF),
    )
    metadata = _record([("WARC-Type", F.lit("metadata")), ("WARC-Record-ID", _urn(F.lit("metadata"), F.col("id"), F.col("serial"))), *of_it, ("Content-Type", F.lit("application/warc-fields"))], fields)
    records = rows.select(F.explode(F.array(request, capture, metadata)).alias("value"))
    records.write.option("lineSep", CRLF + CRLF).option("compression", "gzip").option("maxRecordsPerFile", RECORDS_PER_FILE).text(path)


def _parse(stream: io.BufferedIOBase) -> Iterator[tuple]:
    """The records of one open archive. Payloads are taken by Content-Length, so they may hold anything."""
    while True:
        line = stream.readline()
        if not line:
            return
        if not line.startswith(b"WARC/"):
            continue  # blank lines between records
        head: dict[str, str] = {}
        while (line := stream.readline().rstrip(b"\r\n")):
            name, _, value = line.decode("utf-8", "replace").partition(":")
            head[name.strip().lower()] = value.strip()
        block = stream.read(int(head.get("content-length", "0")))
        http, payload = None, block
        if head.get("content-type", "").startswith("application/http"):
            top, _, payload = block.partition(b"\r\n\r\n")
            http = top.decode("utf-8", "replace")
        serial = head.get("x-capture-serial")
        yield (
            head.get("warc-record-id"), head.get("warc-type"), head.get("warc-concurrent-to"), int(serial) if serial else None, head.get("warc-target-uri"),
            head.get("warc-refers-to"), (head.get("warc-payload-digest") or "").removeprefix("sha1:") or None, http, payload,
        )


def _read_files(files: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    names = RECORD_SCHEMA.fieldNames()
    for batch in files:
        for content in batch["content"]:
            raw = io.BytesIO(content)
            stream = gzip.GzipFile(fileobj=raw) if content[:2] == b"\x1f\x8b" else raw
            held: list[tuple] = []
            size = 0
            for record in _parse(io.BufferedReader(stream)):
                held.append(record)
                size += len(record[-1])
                if size >= BATCH_BYTES or len(held) >= 5000:
                    yield _frame(held, names)
                    held, size = [], 0
            if held:
                yield _frame(held, names)


def _frame(held: list[tuple], names: list[str]) -> pd.DataFrame:
    out = pd.DataFrame(held, columns=names)
    out["serial"] = out["serial"].astype("Int64")
    return out


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """All records of the WARC files (plain or gzipped) below ``path``, as RECORD_SCHEMA. A task holds a batch of whole files, which Spark bounds by bytes."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("content")
    return files.mapInPandas(_read_files, RECORD_SCHEMA)


def assemble(records: DataFrame) -> DataFrame:
    """One nested row for each capture: request, response (or revisit) and metadata, joined by WARC-Concurrent-To.

    ``records`` needs record_id, record_type, concurrent_to and serial; whatever further columns it
    has go into the nested parts. A capture without a request or metadata keeps a null there;
    requests and metadata that name no capture are left out. Serials tell captures apart that share
    a record id (repeated rows); archives without serials join by the id alone.
    """
    rest = [c for c in records.columns if c not in ("concurrent_to", "serial")]
    serial = F.coalesce("serial", F.lit(-1)).alias("capture_serial")
    captures = records.filter(F.col("record_type").isin("response", "revisit")).select(F.col("record_id").alias("capture_id"), serial, F.struct(*rest).alias("response"))
    part = lambda kind: records.filter(F.col("record_type") == kind).select(F.col("concurrent_to").alias("capture_id"), serial, F.struct(*rest).alias(kind))
    return captures.join(part("request"), ["capture_id", "capture_serial"], "left").join(part("metadata"), ["capture_id", "capture_serial"], "left")


def warc_field(block: Column, name: str) -> Column:
    """A value of an application/warc-fields block; null where the field is missing."""
    found = F.regexp_extract(block.cast("string"), rf"(?m)^{name}: ([^\r\n]*)", 1)
    return F.when(found != "", found)


# ---- queries ----


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page written as WARC records and read back: payload size, digest, kind and what a revisit refers to."""
    path = shared_folder(spark)
    write_captures(read_table(spark, sf_dir, "pages"), path)
    records = read_records(spark, path)
    # digests are taken of the payloads as read, before the join, which then moves short rows only
    is_response = F.col("record_type") == "response"
    slim = records.withColumns(
        {
            "read_octets": F.when(is_response, F.octet_length("payload").cast("long")),
            "read_digest": F.when(is_response, base32_sha1(F.col("payload"))),
            "fields": F.when(F.col("record_type") == "metadata", F.col("payload").cast("string")),
        }
    ).drop("payload", "http_header", "target_uri")
    captures = assemble(materialise(slim))
    fields = F.col("metadata.fields")
    return captures.select(
        warc_field(fields, "page-id").cast("long").alias("page_id"),
        F.coalesce("response.read_octets", warc_field(fields, "payload-octets").cast("long")).alias("payload_bytes"),
        F.coalesce("response.read_digest", "response.digest").alias("payload_digest"),
        F.col("response.record_type").alias("record_type"),
        warc_field(fields, "refers-to-page-id").cast("long").alias("refers_to"),
    )


QUERIES = {"op8_warc": op8_warc}
ORACLES = {
    "op8_warc": """
WITH p AS (
  SELECT page_id, coalesce(html, '') AS payload, sha1(coalesce(html, '')) AS h FROM pages
), d AS (
  SELECT page_id, CAST(strlen(payload) AS BIGINT) AS payload_bytes, h,
         array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + CAST(
           ((CAST('0x' || substr(h, 1 + (i // 4) * 5, 5) AS BIGINT) >> CAST(15 - 5 * (i % 4) AS BIGINT)) & 31) AS INTEGER), 1)), '') AS payload_digest,
         min(page_id) OVER (PARTITION BY payload) AS first_id
  FROM p
)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN page_id = first_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id = first_id THEN NULL ELSE first_id END AS refers_to
FROM d
"""
}
