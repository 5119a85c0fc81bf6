import base64
import gzip
import hashlib

import pytest

from quaymark.llm import warc
from quaymark.llm.common import cut

ROWS = [
    (4, "http://a/1", "same"), (2, "http://a/2", "same"), (9, "http://a/3", "same"), (2, "http://a/2", "same"), (None, None, "same"), (None, "http://n", "alone"),
    (5, "http://b\r\nX: y", None), (6, None, ""), (7, "http://c", "<p>é\r\n\r\nWARC/1.1\r\nContent-Length: 3\r\n\r\nabc"), (8, "http://d", "x" * 3_000_000), (3, "http://e", "\r\n\r\n"),
]


def brute(rows, min_bytes=0):
    body = [(r[2] or "").encode() for r in rows]
    out = []
    for (page, _, _), b in zip(rows, body, strict=True):
        ids = [r[0] for r, o in zip(rows, body, strict=True) if o == b and r[0] is not None]
        first = min(ids) if ids and body.count(b) > 1 and len(b) >= min_bytes else None
        again = first is not None and page != first
        out.append((page, len(b), base64.b32encode(hashlib.sha1(b).digest()).decode(), "revisit" if again else "response", first if again else None))
    return sorted(out, key=str)


@pytest.mark.parametrize("min_bytes", [0, 4])
def test_round_trip(spark, tmp_path, min_bytes):
    pages = spark.createDataFrame([(*r, 1) for r in ROWS], "page_id long, url string, html string, digest int")
    path = f"file://{tmp_path}/w"
    warc.write(pages, path, min_bytes)
    got = warc.assemble(cut(warc.read(spark, path, payloads=True))).collect()
    flat = [(r.metadata.page_id, r.metadata.payload_bytes, r.capture.digest, r.capture.type, r.metadata.refers_to) for r in got]
    assert sorted(flat, key=str) == brute(ROWS, min_bytes)
    assert all(r.request is not None and r.request.url == r.capture.url for r in got)
    kept = sorted(bytes(r.capture.payload) for r in got if r.capture.type == "response")
    assert all(len(r.capture.payload) == r.metadata.payload_bytes for r in got if r.capture.type == "response") and b"x" * 3_000_000 in kept


def test_empty(spark, tmp_path):
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    warc.write(pages, f"file://{tmp_path}/w")
    assert warc.assemble(warc.read(spark, f"file://{tmp_path}/w")).collect() == []


def test_parse_members_and_faults():
    one = b"WARC/1.1\r\nWARC-Type: resource\r\nContent-Length: 5\r\n\r\nhello\r\n\r\n"
    packed = gzip.compress(one) + gzip.compress(one)
    assert [b for _, b in warc.parse(warc._inflate(memoryview(packed)))] == [b"hello"] * 2
    for bad in (one[:-6], b"nonsense\r\n\r\n", one[:20]):
        with pytest.raises(ValueError):
            list(warc.parse(iter([bad])))
