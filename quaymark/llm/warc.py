"""WARC archives: one transaction (request, response or revisit, metadata) per page, written and read by Spark.

Records go out through Spark's text writer with ``CRLF CRLF``, the end of a WARC record, as its separator, gzipped file by
file; they come back through the binary-file reader, inflated piecewise and cut by their Content-Length, so payloads may
hold anything. Transactions are assembled by joins on WARC-Concurrent-To.

Defined results: null html is an empty payload; among equal payloads of at least ``min_bytes`` bytes the rows with the
smallest page_id are responses and all others revisit it; a null page_id is never revisited, but revisits; repeated rows
are captures of their own; null urls have no target header; an empty table has no captures; other columns are not written.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, shared_dir, ship, table

_END = "\r\n\r\n"
#: Records of one archive file at most; a file is read by one task.
FILE_RECORDS = 3000
_RECORD = "type string, id string, concurrent string, url string, digest string, payload_bytes long, page_id long, refers_to long, payload binary"


def _base32(hexed):
    """Of 40 hex digits: conv gives base-32 digits, ten hex digits at a time."""
    four = [F.lpad(F.conv(F.substring(hexed, 1 + 10 * i, 10), 16, 32), 8, "0") for i in range(4)]
    return F.translate(F.concat(*four), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def _header(name: str, value):
    return F.when(value.isNotNull(), F.concat(F.lit(f"{name}: "), value.cast("string"), F.lit("\r\n"))).otherwise("")


def _record(kind, rid, concurrent, more, block):
    return F.concat(
        F.lit("WARC/1.1\r\nWARC-Type: "), kind, F.lit("\r\nWARC-Record-ID: "), rid, F.lit("\r\nWARC-Date: 2024-01-01T00:00:00Z\r\n"), _header("WARC-Concurrent-To", concurrent),
        *more, F.lit("Content-Length: "), F.octet_length(block).cast("string"), F.lit(_END), block,
    )


def write(pages: DataFrame, path: str, min_bytes: int = 0) -> None:
    """Archives every row of pages (page_id, url, html) under path."""
    payload = F.coalesce(F.col("html"), F.lit(""))
    rows = pages.select(F.col("page_id").cast("long"), F.regexp_replace(F.regexp_replace("url", "\r", "%0D"), "\n", "%0A").alias("url"), payload.alias("body"), _base32(F.sha1(payload)).alias("digest"), F.octet_length(payload).alias("size"))
    small = rows.select("page_id", "url", "digest", "size")
    first = small.groupBy("digest", "size").agg(F.count("*").alias("c"), F.min("page_id").alias("first"), F.min_by("url", "page_id").alias("first_url")).where((F.col("c") > 1) & (F.col("size") >= min_bytes))
    again = small.join(first, ["digest", "size"]).where(~F.col("page_id").eqNullSafe(F.col("first"))).select(F.col("page_id").alias("p"), F.col("digest").alias("d"), "first", "first_url").distinct()
    full = rows.join(again, F.col("page_id").eqNullSafe(F.col("p")) & (F.col("digest") == F.col("d")), "left").withColumn("u", F.expr("uuid()"))
    rid, req, meta = (F.concat(F.lit("<urn:uuid:"), x, F.lit(">")) for x in (F.col("u"), F.concat(F.lit("11111111"), F.substring("u", 9, 28)), F.concat(F.lit("22222222"), F.substring("u", 9, 28))))
    none, target = F.lit(None).cast("string"), _header("WARC-Target-URI", F.col("url"))
    head = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("size").cast("string"), F.lit(_END))
    digest = _header("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("digest")))
    revisit = F.col("first").isNotNull()
    main = _record(
        F.when(revisit, "revisit").otherwise("response"), rid, none,
        [
            target, digest, F.lit("Content-Type: application/http;msgtype=response\r\n"),
            F.when(revisit, F.concat(F.lit("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest\r\n"), _header("WARC-Refers-To-Target-URI", F.col("first_url")))).otherwise(""),
        ],
        F.when(revisit, head).otherwise(F.concat(head, F.col("body"))),
    )
    asked = F.concat(F.lit("GET "), F.coalesce("url", F.lit("/")), F.lit(" HTTP/1.1" + _END))
    request = _record(F.lit("request"), req, rid, [target, F.lit("Content-Type: application/http;msgtype=request\r\n")], asked)
    fields = F.concat(_header("page-id", F.col("page_id")), _header("payload-bytes", F.col("size")), _header("refers-to", F.col("first")))
    metadata = _record(F.lit("metadata"), meta, rid, [target, F.lit("Content-Type: application/warc-fields\r\n")], fields)
    full.select(F.explode(F.array(request, main, metadata)).alias("value")).write.option("lineSep", _END).option("compression", "gzip").option("maxRecordsPerFile", FILE_RECORDS).text(path)


def _inflate(content: memoryview) -> Iterator[bytes]:
    step, gz = 1 << 20, bytes(content[:2]) == b"\x1f\x8b"
    if not gz:
        yield from (bytes(content[i : i + step]) for i in range(0, len(content), step))
        return
    more = zlib.decompressobj(31)
    for i in range(0, len(content), step):
        piece = bytes(content[i : i + step])
        while piece:
            yield more.decompress(piece)
            piece = more.unused_data
            if more.eof:
                more = zlib.decompressobj(31)
            elif not piece:
                break


def parse(pieces: Iterator[bytes]) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers by lower-case name, block) of each record in a stream."""
    buf = bytearray()

    def fill(n: int) -> bool:
        while len(buf) < n:
            got = next(pieces, None)
            if got is None:
                return False
            buf.extend(got)
        return True

    while True:
        seen = 0
        while (end := buf.find(b"\r\n\r\n", max(0, seen - 3))) < 0:
            seen = len(buf)
            if not fill(seen + 1):
                if buf.strip():
                    raise ValueError("a record has no end of headers")
                return
        if not end:  # between records
            del buf[:4]
            continue
        lines = bytes(buf[:end]).decode("utf-8").lstrip("\r\n").split("\r\n")
        if not lines[0].startswith("WARC/"):
            raise ValueError(f"not a WARC record: {lines[0][:60]!r}")
        headers = {k.lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
        size = int(headers["content-length"])
        if not fill(end + 4 + size):
            raise ValueError("a record's block is cut short")
        yield headers, bytes(buf[end + 4 : end + 4 + size])
        del buf[: end + 4 + size]


def read(spark: SparkSession, path: str, payloads: bool = False) -> DataFrame:
    """A row per record under path: type, id, concurrent, url, digest and payload_bytes (recomputed where the record has
    the payload), the metadata fields page_id and refers_to, and the payload itself if asked for."""
    ship(spark)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = pa.schema([("type", pa.string()), ("id", pa.string()), ("concurrent", pa.string()), ("url", pa.string()), ("digest", pa.string()), ("payload_bytes", pa.int64()), ("page_id", pa.int64()), ("refers_to", pa.int64()), ("payload", pa.binary())])
        for batch in batches:
            for content in batch.column(0):
                rows, held = [], 0
                for h, block in parse(_inflate(memoryview(content.as_buffer()))):
                    kind, payload, fields = h.get("warc-type"), None, {}
                    digest = h.get("warc-payload-digest", "").removeprefix("sha1:") or None
                    if kind == "response":
                        payload = block.partition(b"\r\n\r\n")[2]
                        own = base64.b32encode(hashlib.sha1(payload).digest()).decode()
                        if digest not in (None, own):
                            raise ValueError(f"{h.get('warc-record-id')}: its payload has digest {own}, not {digest}")
                        digest = own
                    elif kind == "metadata":
                        fields = dict(x.split(": ", 1) for x in block.decode("utf-8").split("\r\n") if ": " in x)
                    size = len(payload) if payload is not None else int(fields["payload-bytes"]) if "payload-bytes" in fields else None
                    number = lambda k, f=fields: int(f[k]) if k in f else None
                    rows.append({"type": kind, "id": h.get("warc-record-id"), "concurrent": h.get("warc-concurrent-to"), "url": h.get("warc-target-uri"), "digest": digest, "payload_bytes": size, "page_id": number("page-id"), "refers_to": number("refers-to"), "payload": payload if payloads else None})
                    held += len(payload or b"") if payloads else 200
                    if held > 4 << 20:
                        yield pa.RecordBatch.from_pylist(rows, kinds)
                        rows, held = [], 0
                yield pa.RecordBatch.from_pylist(rows, kinds)

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(run, _RECORD)


def assemble(records: DataFrame) -> DataFrame:
    """One nested row per capture: the response or revisit with the request and metadata records concurrent to it.

    A capture without either has null there; request and metadata records that name no capture are left out.
    """
    main = records.where("type in ('response', 'revisit')").select("id", F.struct("type", "url", "digest", "payload_bytes", "payload").alias("capture"))
    request = records.where("type = 'request'").select(F.col("concurrent").alias("id"), F.struct("id", "url").alias("request"))
    meta = records.where("type = 'metadata'").select(F.col("concurrent").alias("id"), F.struct("id", "page_id", "payload_bytes", "refers_to").alias("metadata"))
    return main.join(request, "id", "left").join(meta, "id", "left")


def remove(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def query(spark, sf_dir):
    path = f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}"
    write(table(spark, sf_dir, "pages"), path)
    captures = assemble(cut(read(spark, path)))
    remove(spark, path)
    return captures.select(
        "metadata.page_id", F.coalesce("capture.payload_bytes", "metadata.payload_bytes").alias("payload_bytes"), F.col("capture.digest").alias("payload_digest"), F.col("capture.type").alias("record_type"), "metadata.refers_to",
    )


ORACLE = """
WITH p AS (SELECT page_id, coalesce(html, '') AS body FROM pages),
h AS (SELECT page_id, strlen(body) AS n, sha1(body) AS hex, min(page_id) OVER (PARTITION BY body) AS first FROM p),
v AS (SELECT *, list_transform(range(0, 4), lambda i: CAST('0x' || hex[i * 10 + 1:i * 10 + 10] AS BIGINT)) AS part FROM h)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes,
       list_aggregate(list_transform(range(0, 32), lambda j: 'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567'[((part[j // 8 + 1] >> (35 - 5 * (j % 8))) & 31) + 1]), 'string_agg', '') AS payload_digest,
       CASE WHEN page_id IS NOT DISTINCT FROM first OR first IS NULL THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id IS NOT DISTINCT FROM first THEN NULL ELSE first END AS refers_to
FROM v
"""
