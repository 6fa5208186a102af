import gzip
import hashlib
import io

import pytest

from quillframe.llm import warc

SCHEMA = "page_id long, url string, html string, digest string"


def member(body=b"hello", kind="response"):
    block = warc.http_head(len(body)) + body
    return warc.record(kind, "urn:page:1", block, hashlib.sha256(body).hexdigest(), "http://x/")


@pytest.mark.parametrize("chunk", [1, 7, 1000])
def test_sequential_reader_frames_records(chunk):
    raw = member(b"a" * 5000) + member(b"") + member(b"\r\n\r\nWARC/1.1\r\n\r\n")
    got = list(warc.records(io.BytesIO(raw), chunk))
    assert [b.partition(b"\r\n\r\n")[2] for _, b in got] == [b"a" * 5000, b"", b"\r\n\r\nWARC/1.1\r\n\r\n"]
    assert gzip.decompress(raw).count(b"WARC-Type: response") == 3


def test_corrupt_archives_are_refused():
    good = member(b"payload of a page")
    bad = gzip.compress(gzip.decompress(good).replace(b"payload of", b"payload_of"))
    longer = gzip.compress(gzip.decompress(good) + b"more")
    for raw in (bad, longer, good[:-10], good + b"not gzip", gzip.compress(b"HTTP/1.1\r\n\r\n")):
        with pytest.raises(warc.CorruptArchive):
            list(warc.records(io.BytesIO(raw)))
    assert list(warc.records(io.BytesIO(b""))) == []


def test_round_trip_and_revisits(spark):
    big, small = "ü" * 60, "x" * 99
    rows = [(7, "u", big), (3, "u\r\nv", big), (9, None, big), (None, "u", big), (1, "u", small), (2, "u", small), (4, "u", None), (5, "u", ""), (3, "u", big), (None, "u", "y" * 100), (None, "u", "y" * 100)]
    df = spark.createDataFrame([(*r, "d") for r in rows], SCHEMA)
    manifest = warc.write_archives(df, archive_bytes=500)
    assert manifest.agg({"records": "sum"}).head()[0] == len(rows)
    got = [r.asDict() for r in warc.read_archives(manifest).collect()]
    assert sorted(bytes(r["payload"]) for r in got if r["record_type"] == "response") == sorted(t.encode() for t in [big, big, small, small, "", "", "y" * 100, "y" * 100])
    again = [r for r in got if r["record_type"] == "revisit"]
    assert {r["refers_to"] for r in again} == {"urn:page:3"} and len(again) == 3
    assert all(r["payload_bytes"] == 120 and r["payload_digest"] == hashlib.sha256(big.encode()).hexdigest() for r in again)


def test_empty_table(spark):
    assert warc.read_archives(warc.write_archives(spark.createDataFrame([], SCHEMA))).count() == 0
