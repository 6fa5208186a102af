"""Byte views of Arrow string columns, and streams of groups from sorted Arrow batches."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc


def utf8_bytes(arr) -> tuple[np.ndarray, np.ndarray]:
    """(bytes of all rows on end, row offsets); a null row has no bytes."""
    if isinstance(arr, pa.ChunkedArray):
        arr = arr.combine_chunks()
    if isinstance(arr, pa.ChunkedArray):  # no chunk at all
        arr = pa.array([], pa.string())
    n = len(arr)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    if arr.null_count:
        arr = pc.fill_null(arr, b"" if pa.types.is_binary(arr.type) or pa.types.is_large_binary(arr.type) else "")
    wide = pa.types.is_large_string(arr.type) or pa.types.is_large_binary(arr.type)
    _, offsets, data = arr.buffers()
    offs = np.frombuffer(offsets, np.int64 if wide else np.int32)[arr.offset : arr.offset + n + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[offs[0] : offs[-1]], offs - offs[0]


def trim() -> None:
    """Give freed memory back to the system: a worker process stays for later tasks."""
    pa.default_memory_pool().release_unused()
    try:
        import ctypes

        ctypes.CDLL(None).malloc_trim(0)
    except AttributeError:  # another C library
        pass


def arrow_path(path: str):
    """(Arrow file system, path in it) of a path in Spark's spelling."""
    from pyarrow import fs

    if "://" not in path:
        path = "file://" + path.removeprefix("file:")
    return fs.FileSystem.from_uri(path)


def row_slices(offs: np.ndarray, limit: int) -> Iterator[tuple[int, int]]:
    """Row ranges of at most ``limit`` bytes; a longer row is a range of its own."""
    n, i = len(offs) - 1, 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(offs, offs[i] + limit, "right")) - 1)
        yield i, j
        i = j


def grouped(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[pa.Table]:
    """Tables of the rows that share ``key``; the batches are sorted by it."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if batch.num_rows == 0:
            continue
        k = batch.column(key).to_numpy(zero_copy_only=False)
        cuts = np.flatnonzero(k[1:] != k[:-1]) + 1
        starts = np.concatenate([[0], cuts])
        ends = np.concatenate([cuts, [len(k)]])
        for a, b in zip(starts.tolist(), ends.tolist()):
            if held and k[a] != last:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(a, b - a))
            last = k[a]
    if held:
        yield pa.Table.from_batches(held)


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every bit."""
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0x7FB5D329728EA185)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x81DADEF4BC2DD44D)
    x ^= x >> np.uint64(33)
    return x


def pieces(offs: np.ndarray, limit: int) -> Iterator[tuple[int, int, np.ndarray, int]]:
    """(first byte, end byte, row of each byte, first row) of runs of at most ``limit`` bytes, rows cut where they must be."""
    for a in range(0, int(offs[-1]), limit):
        z = min(int(offs[-1]), a + limit)
        i = int(np.searchsorted(offs, a, "right")) - 1
        j = int(np.searchsorted(offs, z, "left"))
        inside = np.diff(np.clip(offs[i : j + 1], a, z))
        yield a, z, np.repeat(np.arange(i, j), inside), i


def in_one_task(sample, fn) -> dict[str, np.ndarray]:
    """Arrays by name that ``fn`` makes of the rows of ``sample``, as an Arrow table, in one executor task.

    The sample must be bounded. Only the arrays come to the driver.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = list(batches)
        if not held:
            return
        made = fn(pa.Table.from_batches(held))
        del held
        trim()
        for name, x in made.items():
            x = np.ascontiguousarray(x)
            yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([x.dtype.str]), pa.array([list(x.shape)], pa.list_(pa.int64())), pa.array([x.tobytes()], pa.binary())], ["name", "kind", "shape", "data"])

    rows = sample.repartition(1).mapInArrow(run, "name string, kind string, shape array<long>, data binary").toArrow().to_pylist()
    return {r["name"]: np.frombuffer(r["data"], r["kind"]).reshape(r["shape"]) for r in rows}
