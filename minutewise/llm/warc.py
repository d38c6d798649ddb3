"""WARC archives: written from page rows, read back, and assembled into one nested row per capture.

A capture is a transaction of three records: the request, the response (or a revisit, where an equal payload is kept
elsewhere) and metadata. Response and metadata name the request in WARC-Concurrent-To, and reading joins them
through it. Files are written by Spark's text writer, with the blank lines that end a record as its separator, as one
gzip stream each; lost tasks are written again and half-written files never show.

Edge cases: a null html is an empty payload. A null url is written and read as an empty target. A null page_id
is kept, and such a row is the response only of payloads that no page with an id has. Rows that share a page_id are
captures of their own. Payloads may hold anything, also lines that look like a record's: reading goes by Content-Length.
Records that end early or lack a length make reading fail. An empty table gives no rows.
"""

from __future__ import annotations

import gzip
import io
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from minutewise.llm.common import read
from minutewise.session import shared_folder


@dataclass(frozen=True)
class WarcParams:
    """Payloads of fewer bytes are never revisits; bytes of payloads in a file, unless one alone has more."""

    least_payload: int = 0
    file_bytes: int = 256 << 20
    date: str = "2024-01-01T00:00:00Z"


END = "\r\n\r\n"
CLASSES = (1 << 16, 1 << 20, 1 << 24, 1 << 28)  # largest payloads of the size classes; one more is above them
RECORD = "type string, id string, concurrent_to string, refers_to string, target string, digest string, block binary"

# The alphabet of RFC 4648 base32.
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"


def base32_sha1(payload: Column) -> Column:
    """SHA-1 of a string or binary column in base32: 160 bits are 32 digits, four from every five of hex."""
    hexed = F.sha1(payload)
    digits = []
    for k in range(8):
        bits = F.conv(F.substring(hexed, 5 * k + 1, 5), 16, 10).cast("int")
        digits += [F.substr(F.lit(BASE32), F.shiftright(bits, s).bitwiseAND(31) + 1, F.lit(1)) for s in (15, 10, 5, 0)]
    return F.concat(*digits)


def captures(pages: DataFrame, params: WarcParams = WarcParams()) -> DataFrame:
    """page_id, url, payload, its bytes and digest, and `original`: whether the page keeps the payload; else first_id does."""
    told = pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("payload")).select(
        "*", F.octet_length("payload").cast("long").alias("payload_bytes"), base32_sha1(F.col("payload")).alias("digest")
    )
    # Counted before the shuffle, so a payload that a third of the pages share is one row per task.
    firsts = told.where(F.col("payload_bytes") >= params.least_payload).groupBy("digest", "payload_bytes").agg(F.min("page_id").alias("first_id"))
    both = told.join(firsts.withColumn("shared", F.lit(True)), ["digest", "payload_bytes"], "left")
    return both.withColumn("original", F.col("shared").isNull() | F.col("page_id").eqNullSafe(F.col("first_id"))).drop("shared")


def _record(fields: list[tuple[str, Column]], block: Column) -> Column:
    lines = [F.lit("WARC/1.1")]
    for name, value in fields:
        lines.append(F.concat(F.lit(f"{name}: "), value))
    lines.append(F.concat(F.lit("Content-Length: "), F.octet_length(block).cast("string")))
    # Fields that are null, and so their lines, are left out.
    return F.concat(F.concat_ws("\r\n", *lines), F.lit(END), block)


def _urn(page: Column) -> Column:
    return F.concat(F.lit("<urn:page:"), F.coalesce(page.cast("string"), F.lit("")), F.lit(">"))


def records(found: DataFrame, params: WarcParams = WarcParams()) -> DataFrame:
    """The text of the three records of each capture, in order."""
    # The request's id is made anew for every row, so that rows which share a page_id stay apart.
    c = found.withColumn("request_id", F.concat(F.lit("<urn:uuid:"), F.expr("uuid()"), F.lit(">")))
    target = F.coalesce("url", F.lit(""))
    line_safe = F.translate(target, "\r\n", "")
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("payload_bytes").cast("string"), F.lit(END))
    date = ("WARC-Date", F.lit(params.date))
    uri = ("WARC-Target-URI", line_safe)
    request = _record(
        [("WARC-Type", F.lit("request")), ("WARC-Record-ID", F.col("request_id")), date, uri, ("Content-Type", F.lit("application/http; msgtype=request"))],
        F.concat(F.lit("GET "), line_safe, F.lit(" HTTP/1.1" + END)),
    )
    response = _record(
        [
            ("WARC-Type", F.when(F.col("original"), "response").otherwise("revisit")),
            ("WARC-Record-ID", _urn(F.col("page_id"))), date, uri,
            ("WARC-Concurrent-To", F.col("request_id")),
            ("WARC-Refers-To", F.when(~F.col("original"), _urn(F.col("first_id")))),
            ("WARC-Profile", F.when(~F.col("original"), F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"))),
            ("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("digest"))),
            ("Content-Type", F.lit("application/http; msgtype=response")),
        ],
        F.when(F.col("original"), F.concat(http, F.col("payload"))).otherwise(http),
    )
    metadata = _record(
        [("WARC-Type", F.lit("metadata")), ("WARC-Record-ID", F.concat(F.lit("<urn:uuid:"), F.expr("uuid()"), F.lit(">"))), date, uri, ("WARC-Concurrent-To", F.col("request_id")), ("Content-Type", F.lit("application/warc-fields"))],
        F.concat(F.lit("payloadBytes: "), F.col("payload_bytes").cast("string")),
    )
    return c.select(F.explode(F.array(request, response, metadata)).alias("value"))


def write_archives(pages: DataFrame, path: str, params: WarcParams = WarcParams()) -> None:
    """Write pages (page_id, url, html) as gzipped WARC files.

    Spark's writer bounds a file by its records, so captures are written by the size class of their payloads, each with
    as many records to a file as are sure to fit. Equal payloads are of one class, so no revisit is lost.
    """
    size = lambda bytes_: sum((bytes_ > most).cast("int") for most in CLASSES)
    own = size(F.coalesce(F.octet_length("html"), F.lit(0)))
    there = pages.select(own.alias("k")).distinct().collect()
    for k in sorted(r["k"] for r in there) or [0]:
        rows = records(captures(pages.where(own == k), params), params)
        fit = max(1, params.file_bytes // CLASSES[k]) if k < len(CLASSES) else 1
        rows.write.mode("append").option("lineSep", END).option("compression", "gzip").option("maxRecordsPerFile", 3 * fit).text(path)


def parse(stream: io.BufferedIOBase) -> Iterator[dict]:
    """The records of one archive, in order."""
    while version := stream.readline():
        if not version.strip():
            continue
        if not version.startswith(b"WARC/"):
            raise ValueError(f"no WARC record where one should begin: {version[:40]!r}")
        fields = {}
        while (line := stream.readline()) not in (b"\r\n", b"\n", b""):
            name, _, value = line.decode("utf-8").partition(":")
            fields[name.strip().lower()] = value.strip()
        length = int(fields["content-length"])
        block = stream.read(length)
        if len(block) != length:
            raise ValueError("an archive ends within a record")
        yield {
            "type": fields.get("warc-type"), "id": fields.get("warc-record-id"), "concurrent_to": fields.get("warc-concurrent-to"),
            "refers_to": fields.get("warc-refers-to"), "target": fields.get("warc-target-uri"),
            "digest": fields.get("warc-payload-digest"), "block": block,
        }


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """RECORD of every record of the archives under path."""
    schema = pa.schema([(n, pa.binary() if k == "binary" else pa.string()) for n, k in (x.split() for x in RECORD.split(", "))])

    def parsed(batches):
        for batch in batches:
            for content in batch.column("content"):
                rows, held = [], 0
                for record in parse(gzip.GzipFile(fileobj=io.BytesIO(content.as_buffer()))):
                    rows.append(record)
                    held += len(record["block"]) + 400
                    if held > 8 << 20:
                        yield pa.RecordBatch.from_pylist(rows, schema=schema)
                        rows, held = [], 0
                yield pa.RecordBatch.from_pylist(rows, schema=schema)

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(parsed, RECORD)


def assemble(records: DataFrame) -> DataFrame:
    """One row per capture: structs request, response (or revisit) and metadata, joined through concurrent-to ids.

    A capture is named by its request. Responses without a request, or without metadata, have nulls there; requests
    nothing answers are left out.
    """
    parts = F.split(F.col("block").cast("string"), END, 2)
    request = records.where("type = 'request'").select(F.col("id").alias("transaction"), F.struct("id", "target", parts[0].alias("head")).alias("request"))
    metadata = records.where("type = 'metadata'").select(F.col("concurrent_to").alias("transaction"), F.struct("id", F.col("block").cast("string").alias("fields")).alias("metadata"))
    # Each payload is measured and hashed where it is read, so that it need not travel for that.
    split = records.where("type IN ('response', 'revisit')").select(
        "*", F.substring_index(F.col("block").cast("string"), END, 1).alias("head")
    ).withColumn("payload", F.expr(f"substring(block, octet_length(head) + {len(END) + 1})"))
    response = split.select(
        F.col("concurrent_to").alias("transaction"),
        F.struct(
            "id", "type", "target", "digest", "refers_to", "head", "payload",
            F.octet_length("payload").cast("long").alias("payload_bytes"), base32_sha1(F.col("payload")).alias("payload_sha1"),
        ).alias("response"),
    )
    return response.join(request, "transaction", "left").join(metadata, "transaction", "left")


def page_of(urn: Column) -> Column:
    """The page_id in a record id."""
    digits = F.regexp_extract(urn, "^<urn:page:(-?[0-9]+)>$", 1)
    return F.when(digits != "", digits.cast("long"))


def op6_warc(spark, sf_dir: str) -> DataFrame:
    """Every page written to archives, and what the archives say of it."""
    path = shared_folder(spark)
    write_archives(read(spark, sf_dir, "pages").select("page_id", "url", "html"), path)
    found = assemble(read_records(spark, path))
    original = F.col("response.type") == "response"
    stated = F.regexp_extract("metadata.fields", "payloadBytes: ([0-9]+)", 1).cast("long")
    return found.select(
        page_of(F.col("response.id")).alias("page_id"),
        F.when(original, F.col("response.payload_bytes")).otherwise(stated).alias("payload_bytes"),
        # A payload that is there is hashed anew; a revisit has its digest in the header.
        F.when(original, F.col("response.payload_sha1")).otherwise(F.substring_index("response.digest", ":", -1)).alias("payload_digest"),
        F.col("response.type").alias("record_type"),
        page_of(F.col("response.refers_to")).alias("refers_to"),
    )


_DIGITS = " || ".join(
    f"substr('{BASE32}', ((CAST('0x' || substr(h, {5 * k + 1}, 5) AS INTEGER) >> {s}) & 31) + 1, 1)" for k in range(8) for s in (15, 10, 5, 0)
)
OP6_SQL = f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS payload, sha1(coalesce(html, '')) AS h FROM pages),
d AS (SELECT page_id, CAST(strlen(payload) AS BIGINT) AS payload_bytes, {_DIGITS} AS payload_digest,
  min(page_id) OVER (PARTITION BY h, strlen(payload)) AS first_id FROM p)
SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN page_id IS NOT DISTINCT FROM first_id THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id IS NOT DISTINCT FROM first_id THEN NULL ELSE first_id END AS refers_to
FROM d
"""
