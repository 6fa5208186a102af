"""Packing token sequences: first-fit decreasing over a tournament tree of bin capacities.

Documents are dealt at random over partitions; each partition is cut into
groups of a bounded number of tokens, and every group is packed by itself. A
group never leaves its task, so that a lost executor costs one partition.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillframe.shared import ship

SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
GROUP_TOKENS = 2_000_000
CACHE_WORDS = 400_000


class WordTokenizer:
    """Ids of a word-end BPE file, with the ids of words kept for the next texts.

    White space always ends a token, so a text is the concatenation of its
    words. Texts with characters whose lower case, composition or white space
    could depend on their neighbours go through the library's whole chain.
    """

    def __init__(self, path: str):
        import regex
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        self.model = self.whole.model
        self.pieces = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+").findall
        # Plain: printable ASCII, common white space, and Latin letters that are composed and have a simple lower case.
        self.odd = regex.compile(r"[^\x20-\x7E\t\n\r¡-¬®-įĲ-ňŊ-ž]").search
        self.kept: dict[str, bytes] = {}
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
        self.shape = {b: chr(b) for b in shown} | {b: chr(256 + k) for k, b in enumerate(b for b in range(256) if b not in shown)}

    def _ids(self, word: str) -> bytes:
        """Little-endian 32-bit ids of a lower-case word without white space."""
        out = []
        for piece in [word] if word.isalpha() else self.pieces(word):
            if not piece.isascii():
                piece = piece.encode().decode("latin-1").translate(self.shape)
            out += [t.id for t in self.model.tokenize(piece)]
        return np.array(out, "<u4").tobytes()

    def encode(self, text: str) -> bytes:
        if "<|" in text or self.odd(text):
            return np.array(self.whole.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        kept, out = self.kept, []
        for w in text.lower().split():
            ids = kept.get(w)
            if ids is None:
                if len(kept) >= CACHE_WORDS:
                    kept.clear()
                ids = kept[w] = self._word(w)
            out.append(ids)
        return b"".join(out)

    def _word(self, w: str) -> bytes:
        """A word with one mark at its end shares the entry of the bare word."""
        if len(w) > 1 and not w[-1].isalnum() and w[:-1].isalpha() and w[-1] != "'":
            bare, mark = w[:-1], w[-1]
            a, b = self.kept.get(bare), self.kept.get(mark)
            return (self._ids(bare) if a is None else a) + (self._ids(mark) if b is None else b)
        return self._ids(w)


_TOKENIZERS: dict[str, WordTokenizer] = {}


def tokenizer(path: str) -> WordTokenizer:
    """One for each worker process, with its kept words."""
    if path not in _TOKENIZERS:
        _TOKENIZERS[path] = WordTokenizer(path)
    return _TOKENIZERS[path]


def vocabulary(name: str = "word_bpe_49k.json", folder: str | None = None) -> str:
    """Path of a vocabulary file: in ``folder``, or where the installed package has it."""
    if folder:
        return f"{folder.rstrip('/')}/{name}"
    import public_tokenizers

    return str(public_tokenizers.path(name))


class CapacityTree:
    """Tournament tree over the room left in bins: finds the first bin with enough of it."""

    def __init__(self, bins: int, capacity: int):
        self.leaves = 1 << max(0, (bins - 1).bit_length())
        self.room = [capacity] * (2 * self.leaves)

    def place(self, size: int) -> int:
        room, i = self.room, 1
        while i < self.leaves:
            i *= 2
            if room[i] < size:
                i += 1
        room[i] -= size
        at = i - self.leaves
        while i > 1:
            i //= 2
            a, b = room[2 * i], room[2 * i + 1]
            m = a if a > b else b
            if room[i] == m:
                break
            room[i] = m
        return at


def first_fit_decreasing(sizes: list[int], capacity: int) -> list[list[int]]:
    """Indices of each bin's items; items are taken by falling size, ties by index."""
    order = sorted(range(len(sizes)), key=lambda k: (-sizes[k], k))
    tree = CapacityTree(max(1, len(sizes)), capacity)
    bins: list[list[int]] = []
    for k in order:
        at = tree.place(sizes[k])
        if at == len(bins):
            bins.append([])
        bins[at].append(k)
    return bins


def pack_group(lengths: list[int], capacity: int) -> list[list[tuple[int, int, int]]]:
    """Sequences of (document, start, length) over one group.

    Full runs of ``capacity`` are sequences of their own; what is left of each
    document is packed first-fit decreasing. Room that is left over is then
    filled from the emptiest bins, whose pieces may be cut for that, and the
    last, partly filled one is divided into sequences whose lengths are powers
    of two. No token is padding.
    """
    full, rest = [], []
    for d, n in enumerate(lengths):
        at = 0
        while n - at >= capacity:
            full.append([(d, at, capacity)])
            at += capacity
        if at < n:
            rest.append((d, at, n - at))
    bins = [[rest[k] for k in b] for b in first_fit_decreasing([r[2] for r in rest], capacity)]
    fill = [sum(p[2] for p in b) for b in bins]
    order = sorted(range(len(bins)), key=lambda k: (-fill[k], k))
    bins = [bins[k] for k in order]
    room = [capacity - fill[k] for k in order]
    i, j = 0, len(bins) - 1
    while i < j:
        if room[i] == 0:
            i += 1
            continue
        d, s, n = bins[j].pop()
        take = min(n, room[i])
        bins[i].append((d, s, take))
        room[i] -= take
        if take < n:
            bins[j].append((d, s + take, n - take))
        room[j] += take
        if not bins[j]:
            j -= 1
    out = full + bins[: j + 1]
    if out and (last := sum(p[2] for p in out[-1])) < capacity:
        tail = out.pop()
        for bit in range(last.bit_length() - 1, -1, -1):
            want, piece = last & (1 << bit), []
            while want:
                d, s, n = tail.pop(0)
                take = min(n, want)
                piece.append((d, s, take))
                want -= take
                if take < n:
                    tail.insert(0, (d, s + take, n - take))
            if piece:
                out.append(piece)
    return out


def _packed(batches: Iterator[pa.RecordBatch], path: str, capacity: int, eos: int, group_tokens: int) -> Iterator[pa.RecordBatch]:
    from pyspark import TaskContext

    tok, end = tokenizer(path), np.array([eos], "<u4").tobytes()
    base = TaskContext.get().partitionId() << 40
    done = 0
    docs: list = []
    held = 0

    def flush() -> Iterator[pa.RecordBatch]:
        nonlocal done, held
        rows = []
        for seq in pack_group([len(ids) // 4 for _, ids in docs], capacity):
            at = 0
            for d, s, n in seq:
                name, ids = docs[d]
                rows.append((name, s, n, zlib.crc32(ids[4 * s : 4 * (s + n)]), len(ids) // 4, base + done, at))
                at += n
            done += 1
        docs.clear()
        held = 0
        cols = list(zip(*rows))
        for a in range(0, len(rows), 20_000):
            yield pa.RecordBatch.from_arrays([pa.array(c[a : a + 20_000], pa.int64()) for c in cols], [x.split()[0] for x in SCHEMA.split(", ")])

    for batch in batches:
        for name, text in zip(batch.column("doc_id").to_pylist(), batch.column("text")):
            ids = tok.encode(text.as_py() or "") + end
            docs.append((name, ids))
            held += len(ids) // 4
            if held >= group_tokens:
                yield from flush()
    if docs:
        yield from flush()


def pack(
    docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", tokenizer_path: str | None = None, capacity: int = 2048, eos: int = 1, group_tokens: int = GROUP_TOKENS
) -> DataFrame:
    """Pieces (doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset) of packed sequences.

    ``capacity`` must be a power of two. A null text is an empty one: its only
    token is ``eos``. Repeated rows are packed as often as they occur; a null
    doc_id is kept. Other columns are ignored. No rows give no pieces. Rows are
    dealt by a hash of their place in the input, so no id or group of copies
    gathers in one task, and sorted by it, so a task that is run again packs the
    same groups.
    """
    ship(docs.sparkSession)
    path = tokenizer_path or vocabulary()
    dealt = (
        docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
        .withColumn("_place", F.monotonically_increasing_id())
        .withColumn("_deal", F.xxhash64(F.lit(2048), F.col("_place")))
    )
    return (
        dealt.repartition("_deal")
        .sortWithinPartitions("_deal", "_place")
        .select("doc_id", "text")
        .mapInArrow(lambda it: _packed(it, path, capacity, eos, group_tokens), SCHEMA)
    )


def query(spark, sf_dir: str) -> DataFrame:
    """All documents packed into sequences of at most 2048 tokens."""
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
