"""WARC archives: a writer, and a sequential reader with bounded memory.

Every record is a gzip member of its own. The reader inflates step by step,
frames blocks by Content-Length and verifies block and payload digests. Tasks
write archives under names of their own attempt; only those in the manifest,
which Spark commits with its Parquet files, are read, so tasks that run twice
leave no record twice.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillframe.shared import materialize, new_path, ship

ARCHIVE_BYTES = 32 << 20
CHUNK = 1 << 18
LEAST_REVISIT = 100


def record(kind: str, record_id: str, block: bytes, payload_digest: str, uri: str | None = None, refers_to: str | None = None) -> bytes:
    """One record as a gzip member."""
    head = [
        "WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <{record_id}>", "WARC-Date: 2024-01-01T00:00:00Z", f"WARC-Payload-Digest: sha256:{payload_digest}",
        f"WARC-Block-Digest: sha256:{hashlib.sha256(block).hexdigest()}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}",
    ]
    if uri:
        head.append("WARC-Target-URI: " + uri.replace("\r", "%0D").replace("\n", "%0A"))
    if refers_to:
        head += [f"WARC-Refers-To: <{refers_to}>", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    z = zlib.compressobj(6, zlib.DEFLATED, 31)
    return z.compress("\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n") + z.flush()


def http_head(payload_bytes: int) -> bytes:
    return f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {payload_bytes}\r\n\r\n".encode()


class CorruptArchive(ValueError):
    """A record that is cut off, misframed, or fails its digest."""


def records(stream, chunk: int = CHUNK) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers, block) of every record of a stream of gzip members; holds one record at a time."""
    held, done = b"", False
    number = 0
    while True:
        if not held:
            held = stream.read(chunk)
            if not held:
                return
        number += 1
        z, plain = zlib.decompressobj(31), bytearray()
        headers, need = None, None
        while not z.eof:
            if not held:
                held = stream.read(chunk)
                if not held:
                    raise CorruptArchive(f"record {number} is cut off")
            try:
                plain += z.decompress(held, chunk)
            except zlib.error as e:
                raise CorruptArchive(f"record {number}: {e}") from e
            held = z.unconsumed_tail or z.unused_data if not z.eof else z.unused_data
            if headers is None and (at := plain.find(b"\r\n\r\n")) >= 0:
                lines = bytes(plain[:at]).decode("utf-8", "replace").split("\r\n")
                if not lines[0].startswith("WARC/"):
                    raise CorruptArchive(f"record {number} has no WARC version")
                headers = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
                need = at + 4 + int(headers.get("content-length", -1))
            if need is not None and len(plain) > need + 4:
                raise CorruptArchive(f"record {number} is longer than its Content-Length")
        if headers is None or len(plain) != need + 4 or plain[need:] != b"\r\n\r\n":
            raise CorruptArchive(f"record {number} does not match its Content-Length")
        block = bytes(plain[need - int(headers["content-length"]) : need])
        want = headers.get("warc-block-digest", "")
        if want.startswith("sha256:") and hashlib.sha256(block).hexdigest() != want[7:]:
            raise CorruptArchive(f"record {number} fails its block digest")
        yield headers, block


def _write(batches: Iterator[pa.RecordBatch], folder: str, limit: int) -> Iterator[pa.RecordBatch]:
    from pyarrow import fs
    from pyspark import TaskContext

    task = TaskContext.get()
    store, base = fs.FileSystem.from_uri(folder)
    store.create_dir(base, recursive=True)
    out, path, n, size, part = None, "", 0, 0, 0
    done = []
    for batch in batches:
        small = [batch.column(c).to_pylist() for c in ("page_id", "url", "digest", "first", "payload_bytes")]
        for html, page, url, digest, first, length in zip(batch.column("html"), *small):  # one page at a time
            if out is None:
                name = f"part-{task.partitionId():06d}-{part:04d}-{task.taskAttemptId()}-{uuid.uuid4().hex[:8]}.warc.gz"
                path, n, size, part = f"{base}/{name}", 0, 0, part + 1
                out = store.open_output_stream(path, compression=None)
            me = f"urn:page:{page}" if page is not None else f"urn:uuid:{uuid.uuid4()}"
            again = first is not None and first != page
            block = http_head(length) + (b"" if again else html.as_buffer().to_pybytes())
            member = record("revisit" if again else "response", me, block, digest, url, f"urn:page:{first}" if again else None)
            out.write(member)
            n, size = n + 1, size + len(member)
            if size >= limit:
                out.close()
                done.append((f"{folder}/{path.rsplit('/', 1)[1]}", n, size))
                out = None
    if out is not None:
        out.close()
        done.append((f"{folder}/{path.rsplit('/', 1)[1]}", n, size))
    if done:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*done), (pa.string(), pa.int64(), pa.int64()))], ["path", "records", "bytes"])


def write_archives(pages: DataFrame, *, page_id: str = "page_id", url: str = "url", html: str = "html", folder: str | None = None, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Write a record for every row; (path, records, bytes) of the archives.

    A null html is an empty payload. Of rows with equal payloads of at least 100
    bytes, those with the smallest page_id are responses and the others revisit
    it; a group without any id, and smaller payloads, are responses. Repeated
    rows with the smallest id are all responses. Other columns are ignored. No
    rows give no archive. The folder must be one that all executors see.
    """
    spark = pages.sparkSession
    ship(spark)
    folder = folder or new_path(spark, "warc")
    if "://" not in folder:
        folder = ("file://" if folder.startswith("/") else "") + folder.removeprefix("file:")
    body = F.coalesce(F.col(html), F.lit(""))
    rows = pages.select(F.col(page_id).cast("long").alias("page_id"), F.col(url).alias("url"), body.alias("html"))
    rows = rows.withColumns({"digest": F.sha2(F.col("html").cast("binary"), 256), "payload_bytes": F.octet_length("html").cast("long")})
    groups = rows.where(F.col("payload_bytes") >= LEAST_REVISIT).groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("c")).where("c > 1").drop("c")
    typed = rows.join(groups, "digest", "left").select("page_id", "url", "html", "digest", "first", "payload_bytes")
    return materialize(typed.mapInArrow(lambda it: _write(it, folder, archive_bytes), "path string, records long, bytes long"), "manifest")


RECORD = "archive string, record_id string, record_type string, target_uri string, refers_to string, payload_bytes long, payload_digest string, digest_ok boolean, payload binary"


def _read(batches: Iterator[pa.RecordBatch], payloads: bool) -> Iterator[pa.RecordBatch]:
    from pyarrow import fs

    names = [x.split()[0] for x in RECORD.split(", ")]
    kinds = [pa.string()] * 5 + [pa.int64(), pa.string(), pa.bool_(), pa.binary()]
    for batch in batches:
        for path in batch.column("path").to_pylist():
            store, base = fs.FileSystem.from_uri(path)
            rows, size = [], 0
            with store.open_input_stream(base, compression=None) as stream:
                for h, block in records(stream):
                    head, _, payload = block.partition(b"\r\n\r\n")
                    kind = h.get("warc-type")
                    stated = h.get("warc-payload-digest", "").removeprefix("sha256:")
                    if kind == "revisit":  # the block has only the head of the answer that it repeats
                        n = next((int(x.split(b":")[1]) for x in head.split(b"\r\n") if x.lower().startswith(b"content-length:")), None)
                        digest, ok = stated, None
                    else:
                        n, digest = len(payload), hashlib.sha256(payload).hexdigest()
                        ok = digest == stated
                        if not ok:
                            raise CorruptArchive(f"{path}: {h.get('warc-record-id')} fails its payload digest")
                    strip = lambda x: x.strip("<>") if x else None
                    rows.append((path, strip(h.get("warc-record-id")), kind, h.get("warc-target-uri"), strip(h.get("warc-refers-to")), n, digest, ok, payload if payloads else None))
                    size += len(payload) * payloads + 200
                    if size > 8 << 20:
                        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)
                        rows, size = [], 0
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)


def read_archives(manifest: DataFrame, *, path: str = "path", payloads: bool = True) -> DataFrame:
    """A row for every record of the archives whose paths are listed; a corrupt archive fails the read."""
    spark = manifest.sparkSession
    ship(spark)
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    paths = manifest.select(F.col(path).alias("path")).where("path IS NOT NULL").repartition(n, "path")
    return paths.mapInArrow(lambda it: _read(it, payloads), RECORD)


def query(spark, sf_dir: str) -> DataFrame:
    """All pages written as WARC and read back."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html")
    found = read_archives(write_archives(pages), payloads=False)
    number = lambda c: F.regexp_extract(c, r"^urn:page:(-?\d+)$", 1).try_cast("long")
    return found.select(number("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", number("refers_to").alias("refers_to"))


ORACLE_SQL = """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b FROM pages),
d AS (SELECT page_id, octet_length(b)::BIGINT AS payload_bytes, sha256(b) AS payload_digest FROM p),
g AS (SELECT payload_digest, min(page_id) AS first FROM d WHERE payload_bytes >= 100 GROUP BY 1 HAVING count(*) > 1)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN first IS NOT NULL AND first IS DISTINCT FROM page_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN first IS DISTINCT FROM page_id THEN first END AS refers_to
FROM d LEFT JOIN g USING (payload_digest)
"""
