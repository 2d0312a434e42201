"""Web archives: pages written as WARC records, read back and assembled into one row per capture."""

from __future__ import annotations

import gzip
import hashlib
import io
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from arealcast.session import materialize, shared_dir

#: Fixed values of the format.
VERSION, END, BLANK = "WARC/1.1", "\r\n", "\r\n\r\n"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
HTTP_HEAD = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
#: Equal payloads of at least so many bytes are stored once.
LEAST_BYTES = 100
DATE = "2024-01-01T00:00:00Z"


def _uri(kind: str, *parts: Column) -> Column:
    """A record id made of what the record is, so that a task that runs again writes the same record."""
    text = F.concat_ws("\x1f", F.lit(kind), *[F.coalesce(F.concat(F.lit("="), p.cast("string")), F.lit("-")) for p in parts])
    h = F.md5(text)
    return F.concat(
        F.lit("<urn:uuid:"),
        *[x for a, n in ((1, 8), (9, 4), (13, 4), (17, 4)) for x in (F.substring(h, a, n), F.lit("-"))],
        F.substring(h, 21, 12),
        F.lit(">"),
    )


def _record(kind: Column, record_id: Column, content_type: str, block: Column, headers: dict[str, Column]) -> Column:
    """One record as text, without the two line ends that close it. Headers without a value are left out."""
    lines = [F.lit(VERSION), F.concat(F.lit("WARC-Type: "), kind), F.concat(F.lit("WARC-Record-ID: "), record_id)]
    lines += [F.lit(f"WARC-Date: {DATE}"), F.lit(f"Content-Type: {content_type}")]
    lines += [F.concat(F.lit(f"{name}: "), value) for name, value in headers.items()]
    lines += [F.concat(F.lit("Content-Length: "), F.octet_length(block).cast("string"))]
    return F.concat(F.concat_ws(END, *lines), F.lit(BLANK), block)


def _one_line(text: Column) -> Column:
    return F.regexp_replace(text, r"[\x00-\x1F\x7F]", "%20")


def captures(pages: DataFrame) -> DataFrame:
    """(page_id, url, html, payload_bytes, payload_digest, first): ``first`` is the smallest page_id with the same large payload.

    Only digests of large payloads that occur twice are joined back, so pages move only if even those are many.
    """
    html = F.coalesce(F.col("html"), F.lit(""))
    sized = pages.select(
        F.col("page_id"), F.col("url"), html.alias("html"), F.octet_length(html).cast("long").alias("payload_bytes"), F.sha2(html, 256).alias("payload_digest")
    )
    large = sized.where(F.col("payload_bytes") >= LEAST_BYTES).groupBy("payload_digest")
    again = large.agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1")
    return sized.join(materialize(again.drop("n"), "digests"), "payload_digest", "left")


def records(pages: DataFrame) -> DataFrame:
    """``value``: request, response or revisit, and metadata record of every capture, linked by WARC-Concurrent-To.

    A page whose payload another page of a smaller id has, is a revisit that refers to that page's response. Pages that
    share the smallest id are all responses; so are all if no page of the group has an id.
    """
    c = captures(pages)
    revisit = F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first"))
    page, digest = F.col("page_id").cast("string"), F.concat(F.lit("sha256:"), F.col("payload_digest"))
    own = _uri("capture", F.col("page_id"), F.col("url"), F.col("payload_digest"))
    target = _one_line(F.coalesce(F.col("url"), F.lit("urn:none")))
    shared = {"WARC-Target-URI": target, "X-Page-Id": page}
    body = _record(
        F.when(revisit, "revisit").otherwise("response"),
        own,
        "application/http; msgtype=response",
        F.concat(F.lit(HTTP_HEAD), F.when(revisit, "").otherwise(F.col("html"))),
        shared
        | {
            "WARC-Payload-Digest": digest,
            "WARC-Profile": F.when(revisit, REVISIT_PROFILE),
            "X-Refers-To-Page": F.when(revisit, F.col("first").cast("string")),
        },
    )
    path = F.coalesce(F.regexp_extract(target, r"^[a-z]+://[^/]*(/.*)$", 1), F.lit("/"))
    ask = F.concat(F.lit("GET "), path, F.lit(" HTTP/1.1\r\n\r\n"))
    linked = shared | {"WARC-Concurrent-To": own}
    request = _record(F.lit("request"), _uri("request", own), "application/http; msgtype=request", ask, linked)
    fields = F.concat(F.lit("payload-bytes: "), F.col("payload_bytes").cast("string"), F.lit(END))
    metadata = _record(F.lit("metadata"), _uri("metadata", own), "application/warc-fields", fields, linked)
    return c.select(F.explode(F.array(request, body, metadata)).alias("value"))


def write_archives(pages: DataFrame, path: str, rows_a_file: int = 30_000) -> None:
    """Gzipped archives below ``path``. Each task writes its own pages' records; no page is shuffled for it."""
    text = records(pages).write.option("lineSep", BLANK).option("compression", "gzip")
    text.option("maxRecordsPerFile", rows_a_file).text(path)


def parse_records(stream: io.BufferedIOBase) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers (names lower-cased) and block of every record, by Content-Length alone: blocks may hold anything."""
    while line := stream.readline():
        if not line.strip():
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError(f"no record starts with {line[:40]!r}")
        headers: dict[str, str] = {}
        while (line := stream.readline()).strip():
            name, _, value = line.decode().partition(":")
            headers[name.lower()] = value.strip()
        yield headers, stream.read(int(headers["content-length"]))


RECORD = (
    "record_id string, type string, concurrent_to string, page_id string, target string, digest string,"
    " refers_to string, http_status int, payload binary, payload_bytes bigint, payload_ok boolean"
)


def _read(keep_payload: bool):
    names = [part.split()[0] for part in RECORD.split(",")]

    def row(h: dict[str, str], block: bytes) -> tuple:
        kind = h["warc-type"]
        head, _, payload = block.partition(b"\r\n\r\n")
        size, ok, status, body = None, None, None, None
        if kind in ("response", "revisit"):
            status = int(head.split()[1])
        if kind == "response":
            size, ok = len(payload), "sha256:" + hashlib.sha256(payload).hexdigest() == h.get("warc-payload-digest")
            body = payload if keep_payload else None
        elif kind == "metadata":
            fields = dict(x.partition(":")[::2] for x in block.decode().splitlines() if x)
            size = int(fields["payload-bytes"])
        return (
            h["warc-record-id"], kind, h.get("warc-concurrent-to"), h.get("x-page-id"), h.get("warc-target-uri"),
            h.get("warc-payload-digest"), h.get("x-refers-to-page"), status, body, size, ok,
        )

    types = [pa.string()] * 7 + [pa.int32(), pa.binary(), pa.int64(), pa.bool_()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names)

        rows: list[tuple] = []
        size = 0
        for batch in batches:
            for content in batch.column(0):
                with gzip.open(io.BytesIO(content.as_py())) as stream:
                    for h, block in parse_records(stream):
                        rows.append(row(h, block))
                        size += len(block) if keep_payload else 200
                        if size > 1 << 23:
                            yield out(rows)
                            rows, size = [], 0
        if rows:
            yield out(rows)

    return run


def read_records(spark: SparkSession, path: str, keep_payload: bool = False) -> DataFrame:
    """One row per record of the archives below ``path``. Each file is read whole by one task; writing bounds its size."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(path).select("content")
    return files.mapInArrow(_read(keep_payload), RECORD)


def assemble(found: DataFrame) -> DataFrame:
    """One nested row per capture: request, response and metadata joined through their concurrent-to identifiers.

    Requests and metadata name the response (or revisit) they belong to. A capture without one of them has null there; a
    request or metadata record whose response is missing still gives a row, with response null. Responses of the same id,
    which come of rows that repeat, each give a row.
    """
    named = found.withColumn("capture", F.coalesce("concurrent_to", "record_id"))
    record = F.struct(*[c for c in found.columns if c != "concurrent_to"])
    is_body = F.col("type").isin("response", "revisit")

    def one(test: Column) -> Column:
        return F.first(F.when(test, record), ignorenulls=True)

    grouped = named.groupBy("capture").agg(
        one(F.col("type") == "request").alias("request"),
        one(is_body).alias("response"),
        one(F.col("type") == "metadata").alias("metadata"),
        F.count_if(is_body).alias("copies"),
    )
    each = F.explode(F.sequence(F.lit(1), F.greatest(F.lit(1), F.col("copies").cast("int"))))
    return grouped.withColumn("copy", each).drop("copy", "copies")


def archive_and_read_back(pages: DataFrame) -> DataFrame:
    """One row per page: page_id, payload_bytes, payload_digest, record_type, refers_to, and payload_ok.

    Pages with null html have an empty payload, pages with null url the target ``urn:none``; null ids stay null. A
    payload whose digest is not the one in its header fails the read.
    """
    spark = pages.sparkSession
    path = shared_dir(spark, "warc")
    write_archives(pages, path)
    capture = assemble(read_records(spark, path))
    r, id_type = F.col("response"), dict(pages.dtypes)["page_id"]
    wrong = F.coalesce(~r["payload_ok"], F.lit(False))
    digest = F.when(wrong, F.raise_error(F.lit("payload and digest differ"))).otherwise(F.substring_index(r["digest"], ":", -1))
    return capture.select(
        r["page_id"].cast(id_type).alias("page_id"),
        F.coalesce(F.col("metadata.payload_bytes"), r["payload_bytes"]).alias("payload_bytes"),
        digest.alias("payload_digest"),
        r["type"].alias("record_type"),
        r["refers_to"].cast(id_type).alias("refers_to"),
    )
