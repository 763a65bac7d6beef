"""WARC archives: writing captures, reading records, assembling transactions.

A capture is written as a request, a response (or revisit) and a metadata
record that name the response in WARC-Concurrent-To. Spark's text writer ends
each record with the blank lines that the format asks for, so a task that is
run again leaves no half record. Archives are read whole file by whole file
(plain or gzip, one or many members); their size is set by the writer. Records
are joined through their concurrent-to identifiers to one nested row a capture.
"""

from __future__ import annotations

import hashlib
import io
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cairnlake.llm.common import own_dir, saved, table

#: Shorter payloads are always stored.
LEAST_REVISITED = 100
#: Archives are read file by file, so each stays under a limit of bytes: pages go by
#: size, up to SMALL, four times that, and so on, and an archive holds as many as the
#: limit has room for, but no more than CAPTURES_A_FILE.
CAPTURES_A_FILE, SMALL, MOST_BYTES = 1_000, 64 << 10, 64 << 20
CRLF = "\r\n"
DATE = "2024-01-31T00:00:00Z"


def _header(*fields: tuple[str, Column | str]) -> Column:
    """A WARC header; fields whose value is null are left out."""
    lines = [F.when(v.isNotNull(), F.concat(F.lit(f"{name}: "), v, F.lit(CRLF))) if isinstance(v, Column) else F.lit(f"{name}: {v}{CRLF}") for name, v in fields]
    return F.concat(F.lit(f"WARC/1.1{CRLF}"), *[F.coalesce(x, F.lit("")) for x in lines])


def _record(block: Column, *fields: tuple[str, Column | str]) -> Column:
    return F.concat(_header(*fields, ("Content-Length", F.octet_length(block).cast("string"))), F.lit(CRLF), block)


def write_captures(pages: DataFrame, path: str, date: str = DATE) -> None:
    """Write (page_id, url, html) as archives under ``path``.

    Of pages with equal payloads of 100 bytes or more, those with the smallest
    page_id are stored as responses (one, unless a row is repeated) and the
    others as revisits without a body. A null html is an empty payload; a null
    url leaves the URI out, line ends in it are percent-encoded. A null page_id
    ranks last and is not written. An empty table gives no archives; other columns
    are not read. Archives stay under about 64 megabytes (a payload over that has one
    of its own), so that any is read back in little memory; a page is one row of one task.
    """
    payload = F.coalesce("html", F.lit(""))
    rows = pages.select("page_id", "url", payload.alias("payload")).withColumns({"size": F.octet_length("payload").cast("long"), "digest": F.sha2(F.col("payload").cast("binary"), 256)})
    largest = rows.agg(F.max("size")).first()[0] or 0
    groups = rows.filter(F.col("size") >= LEAST_REVISITED).groupBy("digest").agg(F.min("page_id").alias("kept_id"), F.count("*").alias("n"))
    groups = saved(groups.filter("n > 1").select(F.col("digest").alias("_digest"), "kept_id"), "warc-equal")
    rows = rows.join(groups, F.col("digest") == F.col("_digest"), "left")
    revisit = F.col("kept_id").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("kept_id"))
    rows = rows.withColumn("revisit", F.coalesce(revisit, F.lit(False)))
    for name in ("response_id", "request_id", "metadata_id"):
        rows = rows.withColumn(name, F.concat(F.lit("<urn:uuid:"), F.expr("uuid()"), F.lit(">")))
    uri = F.replace(F.replace(F.col("url"), F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))
    rest = F.regexp_extract(uri, r"://[^/?#]*([^#]*)", 1)
    target = ("WARC-Target-URI", uri)
    asked = F.concat(F.lit("GET "), F.when(F.coalesce(rest, F.lit("")) == "", F.lit("/")).otherwise(rest), F.lit(f" HTTP/1.1{CRLF}Host: "), F.coalesce(F.regexp_extract(uri, "://([^/?#]*)", 1), F.lit("")), F.lit(CRLF + CRLF))
    request = _record(asked, ("WARC-Type", "request"), ("WARC-Record-ID", F.col("request_id")), ("WARC-Concurrent-To", F.col("response_id")), ("WARC-Date", date), target, ("Content-Type", "application/http; msgtype=request"))
    answer = F.concat(F.lit(f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{CRLF}Content-Length: "), F.col("size").cast("string"), F.lit(CRLF + CRLF))
    common = (("WARC-Record-ID", F.col("response_id")), ("WARC-Date", date), target, ("WARC-Payload-Digest", F.concat(F.lit("sha256:"), F.col("digest"))), ("Content-Type", "application/http; msgtype=response"))
    response = _record(F.concat(answer, F.col("payload")), ("WARC-Type", "response"), *common)
    again = _record(answer, ("WARC-Type", "revisit"), ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), *common)
    noted = F.concat(F.lit("page-id: "), F.coalesce(F.col("page_id").cast("string"), F.lit("")), F.lit(CRLF))
    metadata = _record(noted, ("WARC-Type", "metadata"), ("WARC-Record-ID", F.col("metadata_id")), ("WARC-Concurrent-To", F.col("response_id")), ("WARC-Date", date), target, ("Content-Type", "application/warc-fields"))
    records = F.explode(F.array(request, F.when(F.col("revisit"), again).otherwise(response), metadata)).alias("value")
    # One write for each class of sizes that occurs; most tables have the first only.
    low, high = -1, SMALL
    while low < largest:
        part, captures = rows.filter((F.col("size") > low) & (F.col("size") <= high)), min(CAPTURES_A_FILE, max(1, MOST_BYTES // high))
        low, high = high, 4 * high
        writer = part.select(records).write.mode("append").option("lineSep", CRLF + CRLF)
        writer.option("compression", "gzip").option("maxRecordsPerFile", 3 * captures).text(path)


def _fields(block: bytes) -> list[tuple[str, str]]:
    out = []
    for line in block.decode("utf-8", "replace").split(CRLF):
        name, sep, value = line.partition(":")
        if sep:
            out.append((name.strip().lower(), value.strip()))
    return out


class _Unzipped(io.RawIOBase):
    """Bytes of a gzip file of one or many members, or of a plain file."""

    def __init__(self, data: bytes) -> None:
        self.data, self.at, self.gz = memoryview(data), 0, data[:2] == b"\x1f\x8b"
        self.open = None

    def readable(self) -> bool:
        return True

    def readinto(self, buffer) -> int:
        if not self.gz:
            got = bytes(self.data[self.at : self.at + len(buffer)])
            self.at += len(got)
        else:
            got = b""
            while not got and (self.open and self.open.unconsumed_tail or self.at < len(self.data)):
                if self.open is None:
                    self.open = zlib.decompressobj(31)
                pending = self.open.unconsumed_tail
                if not pending:
                    pending = bytes(self.data[self.at : self.at + (1 << 16)])
                    self.at += len(pending)
                got = self.open.decompress(pending, len(buffer))
                if self.open.eof:
                    self.at -= len(self.open.unused_data)
                    self.open = None
        buffer[: len(got)] = got
        return len(got)


def parse(data: bytes) -> Iterator[tuple[dict[str, list[str]], bytes]]:
    """(header fields by lower-case name, block) of each record. A cut last record is an error."""
    stream = io.BufferedReader(_Unzipped(data), 1 << 16)
    while line := stream.readline():
        if line.strip() == b"":
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError(f"no WARC record: {line[:60]!r}")
        fields: dict[str, list[str]] = {}
        head = b""
        while (line := stream.readline()).strip():
            head += line
        for name, value in _fields(head):
            fields.setdefault(name, []).append(value)
        size = int(fields["content-length"][0])
        block = stream.read(size)
        if len(block) < size:
            raise ValueError("cut off WARC record")
        yield fields, block


SCHEMA = "record_id string, record_type string, concurrent_to array<string>, target_uri string, date string, payload_bytes long, payload_digest string, page_id long, http_head string, payload binary"


class _Records:
    def __init__(self, with_payload: bool) -> None:
        self.with_payload = with_payload

    def row(self, fields: dict[str, list[str]], block: bytes) -> tuple:
        one = lambda name: fields.get(name, [None])[0]
        kind = one("warc-type")
        head, payload, size, digest, page = None, None, None, None, None
        if "application/http" in (one("content-type") or ""):
            head, _, payload = block.partition(b"\r\n\r\n")
            if kind == "response":
                size, digest = len(payload), hashlib.sha256(payload).hexdigest()
            elif kind == "revisit":
                payload = None
                size = next((int(v) for k, v in _fields(head) if k == "content-length"), None)
                digest = (one("warc-payload-digest") or "").removeprefix("sha256:")
            head = head.decode("utf-8", "replace")
        elif kind == "metadata":
            page = next((int(v) for k, v in _fields(block) if k == "page-id" and v), None)
        return one("warc-record-id"), kind, fields.get("warc-concurrent-to", []), one("warc-target-uri"), one("warc-date"), size, digest, page, head, payload if self.with_payload else None

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("record_id", pa.string()), ("record_type", pa.string()), ("concurrent_to", pa.list_(pa.string())), ("target_uri", pa.string()), ("date", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("page_id", pa.int64()), ("http_head", pa.string()), ("payload", pa.binary())])
        for batch in batches:
            for data in batch.column(0):
                rows, held = [], 0
                for fields, block in parse(data.as_py()):
                    rows.append(self.row(fields, block))
                    held += len(block)
                    if held > 4 << 20 or len(rows) >= 4096:
                        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)
                        rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)


def read_records(spark: SparkSession, path: str, with_payload: bool = True) -> DataFrame:
    """A row per record of the archives under ``path``; payload sizes and digests
    are those of the stored bytes, for revisits those that the record names."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).filter(F.col("length") > 0)
    return files.select("content").mapInArrow(_Records(with_payload), SCHEMA)


def transactions(records: DataFrame) -> DataFrame:
    """One nested row per capture: (response, request, metadata, refers_to).

    The response or revisit is the anchor; a request or metadata record belongs
    to it if either names the other as concurrent. A capture without a request
    or metadata record has null there. For a revisit, refers_to is the smallest
    page_id of a response with its payload digest.
    """
    whole = lambda kind: F.struct(*[c for c in records.columns if c != "record_type"] if kind != "response" else [F.col(c) for c in records.columns]).alias(kind)
    anchors = records.filter(F.col("record_type").isin("response", "revisit")).select(F.col("record_id").alias("anchor"), F.col("concurrent_to").alias("names"), whole("response"))
    named = anchors.select("anchor", F.explode("names").alias("other"))
    out = anchors.drop("names")
    for kind in ("request", "metadata"):
        some = records.filter(F.col("record_type") == kind)
        forward = some.select(F.explode("concurrent_to").alias("anchor"), whole(kind))
        backward = some.select(F.col("record_id").alias("other"), whole(kind)).join(named, "other").select("anchor", kind)
        each = forward.unionByName(backward).groupBy("anchor").agg(F.min_by(kind, F.col(f"{kind}.record_id")).alias(kind))
        out = out.join(each, "anchor", "left")
    stored = out.filter(F.col("response.record_type") == "response").groupBy(F.col("response.payload_digest").alias("_digest")).agg(F.min("metadata.page_id").alias("_page"))
    # Many revisits may share a digest: Spark splits their part of this join.
    revisited = (F.col("response.record_type") == "revisit") & (F.col("response.payload_digest") == F.col("_digest"))
    return out.join(stored, revisited, "left").withColumnRenamed("_page", "refers_to").drop("anchor", "_digest")


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{own_dir(spark)}/warc-{uuid.uuid4().hex}"
    write_captures(table(spark, sf_dir, "pages"), path)
    found = transactions(saved(read_records(spark, path, with_payload=False).drop("payload"), "warc-records"))
    return found.select(
        F.col("metadata.page_id").alias("page_id"), F.col("response.payload_bytes").alias("payload_bytes"), F.col("response.payload_digest").alias("payload_digest"),
        F.col("response.record_type").alias("record_type"), "refers_to",
    )


def op3_sql() -> str:
    return f"""
WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS n, sha256(coalesce(html, '')) AS d FROM pages),
q AS (SELECT *, CASE WHEN n >= {LEAST_REVISITED} THEN min(page_id) OVER (PARTITION BY d) ELSE page_id END AS first FROM p)
SELECT page_id, n::BIGINT AS payload_bytes, d AS payload_digest, CASE WHEN first = page_id THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN first <> page_id THEN first END AS refers_to FROM q
"""
