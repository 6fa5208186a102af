"""Language identification by prediction by partial matching over bytes.

Every language has a tree of byte contexts of up to ``order`` bytes with frozen
counts. The code length of a byte is that of escape method C: the longest known
context codes the byte or escapes to the next shorter one, whose symbols already
seen are excluded, down to a uniform choice among the remaining byte values. All
trees are merged into one table of contexts, so that a text is scored by lookups
alone, in arrays, with the same result as a walk through the trees.

The table is made on the executors, a task for each range of the last two
context bytes, and lies in the shared folder in parts of bounded size, from where
the scoring tasks read it. Neither it nor the counts pass through the driver.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillframe.llm.buffers import arrow_path, row_slices, trim, utf8_bytes
from quillframe.shared import materialize, new_path, release, ship

START = 256
SLICE_BYTES = 1 << 19
PART_BYTES = 128 << 20  # of the table, that a scoring worker holds at once
HELD_TEXT = 16 << 20  # scored together where the table has several parts
CHUNK_GRAMS = 20_000


def _padded(data: np.ndarray, offs: np.ndarray, order: int) -> np.ndarray:
    """Symbols of all rows, each row after ``order`` START symbols; a START ends the whole."""
    n = len(offs) - 1
    lengths = np.diff(offs)
    out = np.full(len(data) + order * n, START, np.int64)
    out[np.arange(len(data)) + order * (np.repeat(np.arange(n), lengths) + 1)] = data
    return out


def count_grams(batches: Iterator[pa.RecordBatch], order: int, label: str, text: str) -> Iterator[pa.RecordBatch]:
    """(label, gram, n): how often each run of ``order`` + 1 symbols is in the texts of each label."""
    held: dict[str, list] = {}
    for batch in batches:
        labels = batch.column(label).dictionary_encode()
        codes = labels.indices.to_numpy(zero_copy_only=False)
        for k, name in enumerate(labels.dictionary.to_pylist()):
            data, offs = utf8_bytes(batch.column(text).take(pa.array(np.flatnonzero(codes == k))))
            for i, j in row_slices(offs, SLICE_BYTES):
                x = _padded(data[offs[i] : offs[j]], offs[i : j + 1] - offs[i], order)
                if len(x) <= order:
                    continue
                key = x[order:].copy()
                for d in range(1, order + 1):
                    key += x[order - d : len(x) - d] << (9 * d)
                keys, n = np.unique(key[x[order:] != START], return_counts=True)
                held.setdefault(name, []).append((keys, n))
                if sum(len(p[0]) for p in held[name]) > 1_500_000:
                    held[name] = [_merge(held[name])]
                    if len(held[name][0][0]) > 750_000:  # the sums need not be whole
                        yield from _counted(name, held.pop(name))
    for name, parts in held.items():
        yield from _counted(name, parts)


def _counted(name: str, parts: list) -> Iterator[pa.RecordBatch]:
    keys, n = _merge(parts)
    for i in range(0, len(keys), 50_000):
        k = keys[i : i + 50_000]
        yield pa.RecordBatch.from_arrays([pa.array([name] * len(k), pa.string()), pa.array(k, pa.int64()), pa.array(n[i : i + 50_000], pa.int64())], ["label", "gram", "n"])


def _merge(parts: list) -> tuple[np.ndarray, np.ndarray]:
    keys, back = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
    n = np.zeros(len(keys), np.int64)
    np.add.at(n, back, np.concatenate([p[1] for p in parts]))
    return keys, n


@dataclass
class PpmModel:
    labels: list[str]
    order: int
    symbol: np.ndarray  # byte or START -> dense symbol
    low: np.ndarray  # (1 + symbol, symbol, label) nats in the empty context, and in those of one symbol
    pairs: np.ndarray  # whether a context of two symbols, packed, is known
    parts: int = 1
    path: str | None = None  # of the table in the shared folder
    table: pa.Table | None = field(default=None, repr=False)  # instead, for a model made in memory

    @property
    def width(self) -> int:
        return int(self.symbol.max()) + 1

    def part(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """(row of every packed context of ``order`` symbols, nats by row * width + symbol and label); row 0 costs nothing."""
        w, n = self.width, len(self.labels)
        if self.table is not None:
            batches, total = self.table.to_batches(), self.table.num_rows
        else:
            import pyarrow.dataset as ds
            from pyarrow import fs

            store, at = arrow_path(f"{self.path}/part={k}")
            batches, total = [], 0
            if store.get_file_info(at).type != fs.FileType.NotFound:  # no pair need fall into a part
                rows = ds.dataset(at, filesystem=store, format="parquet")
                total = rows.count_rows()
                batches = rows.to_batches(columns=["ctx", "level", "cost"], batch_size=1024, batch_readahead=1, fragment_readahead=1)
        # Filled a batch at a time, so that the table is held once.
        cost = np.zeros((2 + w + total, w, n), np.float32)
        cost[1 : 2 + w] = self.low
        ctx, level, at = np.empty(total, np.int64), np.empty(total, np.int32), 0
        for b in batches:
            z = at + b.num_rows
            ctx[at:z], level[at:z] = b.column("ctx").to_numpy(), b.column("level").to_numpy()
            cost[2 + w + at : 2 + w + z] = np.frombuffer(utf8_bytes(b.column("cost"))[0], np.float32).reshape(-1, w, n)
            at = z
        cost = cost.reshape(-1, n)
        every = np.arange(w**self.order, dtype=np.int64 if w**self.order > 2**31 else np.int32)
        # Contexts whose last two symbols no tree knows are those of one symbol, and belong to the first part.
        state = np.where(self.pairs[every % w**2], 0, 2 + every % w).astype(np.int32) if k == 0 else np.zeros(len(every), np.int32)
        first = 2 + w
        for d in range(2, self.order + 1):
            of = np.zeros(w**d, np.int32)
            mine = np.flatnonzero(level == d)
            of[ctx[mine]] = first + mine
            longer = of[every % w**d]
            state = np.where(longer > 0, longer, state)
        return state, cost

    def code_lengths(self, data: np.ndarray, offs: np.ndarray) -> np.ndarray:
        """Nats of each row under each label."""
        out = np.zeros((len(offs) - 1, len(self.labels)))
        for k in range(self.parts):
            self._add(out, data, offs, *_loaded(self, k))
        return out

    def _add(self, out: np.ndarray, data: np.ndarray, offs: np.ndarray, state: np.ndarray, cost: np.ndarray) -> None:
        for i, j in row_slices(offs, SLICE_BYTES):
            if offs[j] - offs[i] > 8 * SLICE_BYTES:  # one very long row, in pieces with their contexts
                row = data[offs[i] : offs[j]]
                for a in range(0, len(row), SLICE_BYTES):
                    piece = row[max(0, a - self.order) : a + SLICE_BYTES].astype(np.int64)
                    if a == 0:
                        piece = np.concatenate([np.full(self.order, START), piece])
                    out[i] += self._lengths(piece, np.array([0]), state, cost)[0]
                continue
            part, po = data[offs[i] : offs[j]], offs[i : j + 1] - offs[i]
            full = np.flatnonzero(np.diff(po))
            if len(full):
                x = _padded(part, po, self.order)
                first = po[:-1] + self.order * np.arange(j - i)
                out[i + full] += self._lengths(x, first[full], state, cost)

    def _lengths(self, x: np.ndarray, first: np.ndarray, state: np.ndarray, cost: np.ndarray) -> np.ndarray:
        """Sums over the symbols after each ``first``; START symbols cost nothing."""
        s, width = self.symbol[x].astype(np.int64), self.width
        key = np.zeros(len(s) - self.order, np.int64)
        for d in range(self.order):
            key *= width
            key += s[d : len(s) - self.order + d]
        each = cost[state[key].astype(np.int64) * width + s[self.order :]]
        each[x[self.order :] == START] = 0
        return np.add.reduceat(each, first, axis=0, dtype=np.float64)


_HELD: dict = {}


def _loaded(model: PpmModel, k: int) -> tuple[np.ndarray, np.ndarray]:
    """A part of the table; a worker process keeps the last one."""
    if model.path is None:
        return model.part(k)
    if (model.path, k) not in _HELD:
        _HELD.clear()
        _HELD[model.path, k] = model.part(k)
        trim()
    return _HELD[model.path, k]


def _low_costs(counts: np.ndarray) -> np.ndarray:
    """Nats in the empty context and in those of one symbol, from (label, context symbol, symbol) counts."""
    labels, width, _ = counts.shape
    out = np.empty((1 + width, width, labels))
    for li in range(labels):
        n = np.concatenate([counts[li].sum(0, keepdims=True), counts[li]])
        lower = np.stack([np.zeros(1 + width, np.int64), np.arange(1 + width)])
        length = np.append(0, np.ones(width, np.int64))
        out[:, :, li] = _costs(n, lower, length)
    return out


def _costs(n: np.ndarray, lower: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Nats of every symbol in every context: ``lower[k]`` is the row of a context's suffix of k symbols, ``length`` its own."""
    total, width = n.shape[0], n.shape[1]
    rows = len(length)
    p, free, esc = np.zeros((rows, width)), np.ones((rows, width), bool), np.ones((rows, 1))
    for k in range(len(lower) - 1, -1, -1):
        c = np.where(free, n[np.minimum(lower[k], total - 1)], 0.0) * (length >= k)[:, None]
        tot = c.sum(1, keepdims=True)
        kinds = (c > 0).sum(1, keepdims=True)
        whole = np.where(tot > 0, tot + kinds, 1.0)
        p += esc * c / whole
        esc = np.where(tot > 0, esc * kinds / whole, esc)
        free &= c == 0
    left = 256 - (width - 2 - free[:, : width - 2].sum(1, keepdims=True))
    p = np.where(free, esc / np.maximum(left, 1), p)
    return -np.log(np.maximum(p, 1e-300))


def context_rows(label: np.ndarray, gram: np.ndarray, n: np.ndarray, counts: np.ndarray, symbol: np.ndarray, order: int) -> pa.RecordBatch:
    """(ctx, level, pair, cost) of all contexts of two symbols and more in the given grams.

    The grams must be all of those with the same last two context symbols.
    """
    labels, width = counts.shape[0], counts.shape[1]
    parts = np.stack([(gram >> (9 * d)) & 511 for d in range(order, -1, -1)], axis=1)  # oldest first
    s = symbol[parts].astype(np.int64)
    packed = [np.zeros(len(s), np.int64)]
    for k in range(1, order + 1):
        packed.append(packed[-1] + s[:, order - k] * width ** (k - 1))
    known = [np.zeros(1, np.int64), np.arange(width)] + [np.unique(p) for p in packed[2:]]
    base = np.concatenate([[0], np.cumsum([len(k) for k in known])])
    first = int(base[2])
    length = np.concatenate([np.full(len(k), d) for d, k in enumerate(known)])[first:]
    lower = np.zeros((order + 1, len(length)), np.int64)  # [k] context -> its suffix of k symbols
    for d in range(2, order + 1):
        for k in range(d + 1):
            lower[k, base[d] - first : base[d + 1] - first] = base[k] + np.searchsorted(known[k], known[d] % width**k)
    out = np.empty((len(length), width, labels), np.float32)
    for li in range(labels):
        mine = label == li
        c = np.zeros((int(base[-1]), width))  # float32 would lose single counts beside 2**24
        c[0], c[1 : 1 + width] = counts[li].sum(0), counts[li]
        for k in range(2, order + 1):
            np.add.at(c, (base[k] + np.searchsorted(known[k], packed[k][mine]), s[mine, -1]), n[mine])
        for a in range(0, len(length), 4096):
            out[a : a + 4096, :, li] = _costs(c, lower[:, a : a + 4096], length[a : a + 4096])
    ctx = np.concatenate(known[2:])
    cost = pa.array([r.tobytes() for r in out], pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(ctx), pa.array(length.astype(np.int32)), pa.array(ctx % width**2), cost], ["ctx", "level", "pair", "cost"])


TABLE = "ctx long, level int, pair long, cost binary"


def _table_rows(batches: Iterator[pa.RecordBatch], counts: np.ndarray, symbol: np.ndarray, labels: list[str], order: int) -> Iterator[pa.RecordBatch]:
    """Context rows of grams that come sorted by their last two context symbols, some groups at a time."""
    held: list[pa.RecordBatch] = []

    def flush() -> Iterator[pa.RecordBatch]:
        t = pa.Table.from_batches(held)
        names = {x: i for i, x in enumerate(labels)}
        label = np.array([names[x] for x in t["label"].to_pylist()], np.int64)
        out = context_rows(label, t["gram"].to_numpy(), t["n"].to_numpy().astype(np.float64), counts, symbol, order)
        for a in range(0, out.num_rows, 2000):
            yield out.slice(a, 2000)

    size = 0
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        g = batch.column("tail").to_numpy()
        cuts = np.flatnonzero(np.concatenate([[last is None or g[0] != last], g[1:] != g[:-1]]))
        last = g[-1]
        begin = 0
        for c in cuts.tolist():
            if size + c - begin >= CHUNK_GRAMS:
                held.append(batch.slice(begin, c - begin))
                yield from flush()
                held, size, begin = [], 0, c
        held.append(batch.slice(begin))
        size += batch.num_rows - begin
    if size:
        yield from flush()


def fit(docs: DataFrame, *, text: str = "text", label: str = "lang", order: int = 3, part_bytes: int = PART_BYTES) -> PpmModel:
    """Count contexts over all rows with text and label, and freeze their code lengths.

    Every run of ``order`` + 1 bytes of every label is kept. What comes to the
    driver is the labels, and counts of single bytes after single bytes for each
    label (65,792 at most). No usable row gives a model without labels. ``order``
    is 2 or 3, as contexts are numbered densely.
    """
    spark = docs.sparkSession
    ship(spark)
    known = docs.where(F.col(text).isNotNull() & F.col(label).isNotNull()).select(F.col(label).alias("label"), F.col(text).alias("text"))
    grams = (
        known.mapInArrow(lambda it: count_grams(it, order, "label", "text"), "label string, gram long, n long")
        .groupBy("label", "gram")
        .agg(F.sum("n").alias("n"))
    )
    grams = materialize(grams, "grams")
    ends = grams.groupBy("label", F.expr("gram & 262143").alias("end")).agg(F.sum("n").alias("n")).toArrow().to_pandas()
    labels, symbol, counts = _alphabet(ends)
    if not labels:
        return PpmModel([], order, symbol, np.zeros((1, 1, 0)), np.zeros(1, bool))
    width = counts.shape[1]
    contexts = grams.select(F.expr("gram >> 9").alias("c")).distinct().count()
    parts = max(1, -(-contexts * width * len(labels) * 4 // part_bytes))
    tail = F.expr("(gram >> 9) & 262143")
    dealt = grams.withColumn("tail", tail).repartition("tail").sortWithinPartitions("tail")
    path = new_path(spark, "contexts")
    rows = dealt.select("label", "gram", "n", "tail").mapInArrow(lambda it: _table_rows(it, counts, symbol, labels, order), TABLE)
    # All contexts with the same last two symbols are in one part, since the shorter stand in for unknown longer ones.
    rows.withColumn("part", F.pmod(F.xxhash64("pair"), F.lit(parts)).cast("int")).write.partitionBy("part").parquet(path)
    seen = spark.read.schema("pair long").parquet(path).distinct().toArrow()["pair"].to_numpy()  # 66,049 at most
    release(grams)
    pairs = np.zeros(width**2, bool)
    pairs[seen] = True
    return PpmModel(labels, order, symbol, _low_costs(counts), pairs, parts, path)


def _alphabet(ends: pd.DataFrame) -> tuple[list[str], np.ndarray, np.ndarray]:
    """(labels, byte -> dense symbol, (label, context symbol, symbol) counts) from counts of the last two symbols of grams."""
    labels = sorted(ends["label"].unique())
    before, s = ends["end"].to_numpy(np.int64) >> 9, ends["end"].to_numpy(np.int64) & 511
    used = np.unique(s)
    symbol = np.zeros(257, np.int16)
    symbol[:] = len(used)  # every byte that no tree knows
    symbol[used] = np.arange(len(used))
    symbol[START] = len(used) + 1
    counts = np.zeros((len(labels), len(used) + 2, len(used) + 2))
    np.add.at(counts, (np.searchsorted(labels, ends["label"].to_numpy(str)) if labels else np.zeros(0, int), symbol[before], symbol[s]), ends["n"].to_numpy(np.float64))
    return labels, symbol, counts


def freeze(grams: pd.DataFrame, order: int) -> PpmModel:
    """The same model from counted grams, in memory."""
    ends = grams.assign(end=grams["gram"] & 262143).groupby(["label", "end"], as_index=False)["n"].sum()
    labels, symbol, counts = _alphabet(ends)
    if not labels:
        return PpmModel([], order, symbol, np.zeros((1, 1, 0)), np.zeros(1, bool))
    label = np.searchsorted(labels, grams["label"].to_numpy(str))
    rows = context_rows(label, grams["gram"].to_numpy(), grams["n"].to_numpy(np.float64), counts, symbol, order)
    pairs = np.zeros(counts.shape[1] ** 2, bool)
    pairs[rows.column("pair").to_numpy()] = True
    return PpmModel(labels, order, symbol, _low_costs(counts), pairs, table=pa.Table.from_batches([rows]))


def predict(docs: DataFrame, model: PpmModel, text: str = "text") -> Column:
    """A column STRUCT<lang_pred, score, bits_per_byte>.

    ``und`` with score 0 for null texts, texts without a letter, and a model
    without labels; ties go to the label that sorts first. The score is the
    posterior probability of the label under equal priors. A worker holds one
    part of the table; where there are several, it scores some batches together
    with each of them in turn.
    """
    ship(docs.sparkSession)
    held = docs.sparkSession.sparkContext.broadcast(model)

    def judged(m: PpmModel, batches: list[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        names = np.array([*m.labels, "und"], dtype=object)
        raw = [utf8_bytes(t) for t, _ in batches]
        costs = [np.zeros((len(t), len(m.labels))) for t, _ in batches]
        for k in range(m.parts if m.labels else 0):
            table = _loaded(m, k)
            for out, (data, offs) in zip(costs, raw):
                m._add(out, data, offs, *table)
        for cost, (_, offs), (t, letters) in zip(costs, raw, batches):
            n = len(t)
            best, score, bits = np.full(n, len(m.labels)), np.zeros(n), np.zeros(n)
            if m.labels and n:
                low = cost.min(1, keepdims=True)
                ok = letters.fill_null(False).to_numpy(zero_copy_only=False).astype(bool)
                best = np.where(ok, cost.argmin(1), len(m.labels))
                score = np.where(ok, 1.0 / np.exp(np.maximum(low - cost, -700.0)).sum(1), 0.0)
                bits = low[:, 0] / np.log(2) / np.maximum(1, np.diff(offs))
            yield pa.StructArray.from_arrays([pa.array(names[best], pa.string()), pa.array(score), pa.array(bits)], ["lang_pred", "score", "bits_per_byte"])

    @F.arrow_udf("struct<lang_pred:string,score:double,bits_per_byte:double>")
    def of(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        m = held.value
        waiting, size = [], 0
        for t, letters in batches:
            waiting.append((t, letters))
            size += t.nbytes
            if m.parts == 1 or size >= HELD_TEXT:
                yield from judged(m, waiting)
                waiting, size = [], 0
        yield from judged(m, waiting)

    return of(F.col(text), F.col(text).rlike(r"\p{L}"))


def held_out(doc_id: str = "doc_id") -> Column:
    """True where crc32 of the id as text is divisible by 5; false for a null id."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def query(spark, sf_dir: str) -> DataFrame:
    """Language of every document, learnt from labelled documents that are not held out."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    model = fit(docs.where(F.col("doc_id").isNotNull() & ~held_out()))
    out = docs.select("doc_id", held_out().alias("held_out"), predict(docs, model).alias("p"))
    return out.select("doc_id", "held_out", "p.lang_pred", "p.score")
