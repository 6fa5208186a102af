"""Approximate nearest neighbours by cosine: multiprobe p-stable hashing.

Vectors of length one are projected on Gaussian directions, shifted and cut
into steps: ``hashes`` of those make a bucket of one of ``tables`` tables. A
query visits its own bucket and, of each table, the ``probes`` buckets next to
it that are likeliest to hold neighbours: its distances to the step borders are
ranked, and sets of single-step changes are taken by their expected score.
What the tables find is merged and ranked by exact cosines of the original
vectors.

How many hashes and probes and what step are needed depends on the table: they
are fitted on a bounded sample of queries whose true neighbours a full pass
finds, as the setting that visits the least and still finds 97 per cent of them.

Some buckets make a task. A vector goes once to a task of each table, a query
once to every task in which it visits a bucket, with the list of those. Equal
vectors are one class, of which only the smallest ids can be among the nearest;
crowded tasks are dealt over several.
"""

from __future__ import annotations

import heapq
import itertools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillframe.llm.buffers import arrow_path, grouped, mix64
from quillframe.shared import materialize, materialize_counted, new_path, release, ship

SEED = 17
CROWDED = 8192
#: What a fit can choose from.
GRID = {"tables": (4, 8), "hashes": (1, 2, 3, 4, 6, 8, 10, 12, 16), "step": (0.6, 1.0, 1.4, 1.8, 2.4, 3.2)}
MOST_PROBES = 120
SAMPLE_QUERIES, SAMPLE_VECTORS = 128, 2000
WANTED = 0.97


@dataclass(frozen=True)
class Setting:
    tables: int = 6
    hashes: int = 6
    step: float = 1.8
    probes: int = 60
    recall: float = float("nan")  # on the sample that it was fitted on
    visited: float = float("nan")  # share of all vectors that a query meets in a table, by the same sample


def perturbations(hashes: int, probes: int) -> list[tuple[int, ...]]:
    """Sets of ranks 1..2*hashes by rising expected score; rank j and 2*hashes+1-j are the two sides of one hash."""
    m = hashes
    score = [j * (j + 1) / (4 * (m + 1) * (m + 2)) if j <= m else 1 - (2 * m + 1 - j) / (m + 1) + (2 * m + 1 - j) * (2 * m + 2 - j) / (4 * (m + 1) * (m + 2)) for j in range(1, 2 * m + 1)]
    heap, out = [(score[0], (1,))], []
    while heap and len(out) < probes:
        s, ranks = heapq.heappop(heap)
        if all(2 * m + 1 - r not in ranks for r in ranks):
            out.append(ranks)
        top = ranks[-1]
        if top < 2 * m:
            heapq.heappush(heap, (s - score[top - 1] + score[top], (*ranks[:-1], top + 1)))
            heapq.heappush(heap, (s + score[top], (*ranks, top + 1)))
    return out


class Hasher:
    """Projections and bucket keys; the same seed and dimension give the same ones in every process."""

    def __init__(self, dim: int, setting: Setting, seed: int = SEED):
        tables, hashes, step = setting.tables, setting.hashes, setting.step
        rng = np.random.default_rng(seed)
        self.tables, self.hashes, self.step = tables, hashes, step
        self.along = rng.normal(size=(dim, tables * hashes))
        self.shift = rng.uniform(0, step, tables * hashes)
        self.factor = rng.integers(1, 2**62, tables * hashes, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        self.salt = rng.integers(1, 2**62, tables, dtype=np.uint64)

    def _steps(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        f = (x / np.linalg.norm(x, axis=1, keepdims=True)) @ self.along
        f = (f + self.shift) / self.step
        low = np.floor(f)
        return low.astype(np.int64).view(np.uint64), f - low

    def keys(self, x: np.ndarray) -> np.ndarray:
        """(row, table) bucket keys."""
        low, _ = self._steps(x)
        raw = (low * self.factor).reshape(len(x), self.tables, self.hashes).sum(2, dtype=np.uint64)
        return mix64(raw + self.salt).view(np.int64)

    def probed(self, x: np.ndarray, probes: int) -> np.ndarray:
        """(row, table * (1 + probes)) keys of a query's own and its perturbed buckets."""
        low, rest = self._steps(x)
        raw = (low * self.factor).reshape(len(x), self.tables, self.hashes).sum(2, dtype=np.uint64)
        sets = perturbations(self.hashes, probes)
        out = np.empty((len(x), self.tables, 1 + len(sets)), np.uint64)
        out[:, :, 0] = raw
        for t in range(self.tables):
            part = slice(t * self.hashes, (t + 1) * self.hashes)
            d = np.concatenate([rest[:, part], 1 - rest[:, part]], axis=1)
            order = np.argsort(d, axis=1, kind="stable")
            move = np.concatenate([np.uint64(0) - self.factor[part], self.factor[part]])[order]
            for p, ranks in enumerate(sets):
                out[:, t, 1 + p] = raw[:, t] + move[:, [r - 1 for r in ranks]].sum(1, dtype=np.uint64)
        return mix64(out + self.salt[None, :, None]).view(np.int64).reshape(len(x), -1)


def _matrix(arr, dim: int) -> np.ndarray:
    if isinstance(arr, pa.ChunkedArray):
        arr = arr.combine_chunks()
    return np.asarray(arr.flatten(), np.float64).reshape(-1, dim)


def _by_length(arr: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(length, rows, vectors) of the vectors of each length."""
    n = arr.value_lengths().to_numpy(zero_copy_only=False)
    for d in np.unique(n).tolist():
        at = np.flatnonzero(n == d)
        yield d, at, _matrix(arr.take(pa.array(at)), d)


def top(q: np.ndarray, c: np.ndarray, ids: np.ndarray, k: int, mask=None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query row, candidate row, cosine) of the ``k`` largest cosines of each query, ties to smaller ids; ``mask(a, z)`` tells which candidates rows a to z may have.

    Single precision finds what can be among them, with a margin well over its
    error; their cosines are then computed in double precision from the vectors as
    they are.
    """
    qn, cn = np.linalg.norm(q, axis=1), np.linalg.norm(c, axis=1)
    q1, c1 = (q / qn[:, None]).astype(np.float32), (c / cn[:, None]).astype(np.float32).T.copy()
    found = []
    for a in range(0, len(q), 256):
        s = q1[a : a + 256] @ c1
        if mask is not None:
            s = np.where(mask(a, a + len(s)), s, np.float32(-9))
        floor = np.full(len(s), -2.0, np.float32)
        if s.shape[1] > k:
            some = s[:, :: max(1, min(8, s.shape[1] // (2 * k)))]  # the k-th largest of a part is at most that of all
            floor = np.maximum(floor, np.partition(some, some.shape[1] - k, axis=1)[:, some.shape[1] - k] - np.float32(1e-4))
        row, col = np.nonzero(s >= floor[:, None])
        exact = np.einsum("ij,ij->i", q[a + row], c[col]) / qn[a + row] / cn[col]
        order = np.lexsort((ids[col], -exact, row))
        row, col, exact = row[order], col[order], exact[order]
        keep = np.arange(len(row)) - np.searchsorted(row, row) < k
        found.append((a + row[keep], col[keep], exact[keep]))
    return tuple(np.concatenate(x) for x in zip(*found)) if found else (np.zeros(0, int), np.zeros(0, int), np.zeros(0))


FOUND = "q1 long, q2 long, c1 long, c2 long, members array<long>, score double"
_NAMES = [x.split()[0] for x in FOUND.split(", ")]


def _firsts(members: pa.Array) -> np.ndarray:
    return members.flatten().to_numpy()[np.concatenate([[0], np.cumsum(members.value_lengths().to_numpy())[:-1]]).astype(int)] if len(members) else np.zeros(0, np.int64)


def _visit(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    """The ``k`` nearest classes that each query finds in the buckets it visits in a task."""
    for t in grouped(batches, "task"):
        probe = t.column("probe").to_numpy()
        queries, classes = np.flatnonzero(probe), np.flatnonzero(~probe)
        if not len(queries) or not len(classes):
            continue
        x, keys = t.column("x").combine_chunks(), t.column("keys").combine_chunks()
        v1, v2 = t.column("v1").to_numpy(), t.column("v2").to_numpy()
        dim = len(x[int(classes[0])])
        q, c = _matrix(x.take(pa.array(queries)), dim), _matrix(x.take(pa.array(classes)), dim)
        members = t.column("members").combine_chunks().take(pa.array(classes))
        ids = _firsts(members)
        bucket, of = np.unique(keys.take(pa.array(classes)).flatten().to_numpy(), return_inverse=True)  # a class has one key
        mine = keys.take(pa.array(queries))
        asked, owner = mine.flatten().to_numpy(), np.repeat(np.arange(len(queries)), mine.value_lengths().to_numpy())
        at = np.minimum(np.searchsorted(bucket, asked), len(bucket) - 1)
        hit = bucket[at] == asked
        owner, at = owner[hit], at[hit]
        order = np.lexsort((at, owner))
        owner, at = owner[order], at[order]
        size = np.bincount(of, minlength=len(bucket))
        met = np.bincount(owner, size[at], len(queries))  # classes in the buckets of each query
        by_bucket = np.argsort(of, kind="stable")
        ends = np.cumsum(size)
        few = 32 * met < len(classes)  # else one product of matrices costs less than a gather for each query
        for i in np.flatnonzero(few & (met > 0)).tolist():
            b = at[np.searchsorted(owner, i) : np.searchsorted(owner, i, "right")]
            some = np.concatenate([by_bucket[ends[j] - size[j] : ends[j]] for j in b.tolist()])
            _, col, score = top(q[i : i + 1], c[some], ids[some], k)
            yield _found(v1, v2, queries[[i] * len(col)], classes[some[col]], members.take(pa.array(some[col])), score)
        many = np.flatnonzero(~few)
        place = np.full(len(queries), -1)
        place[many] = np.arange(len(many))
        visits = np.zeros((len(many), len(bucket)), bool)
        here = place[owner] >= 0
        visits[place[owner[here]], at[here]] = True
        row, col, score = top(q[many], c, ids, k, lambda a, z: visits[a:z][:, of])
        yield _found(v1, v2, queries[many[row]], classes[col], members.take(pa.array(col)), score)


def _found(v1, v2, q, c, members, score) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(v1[q]), pa.array(v2[q]), pa.array(v1[c]), pa.array(v2[c]), members, pa.array(score)], _NAMES)


def usable(vec: Column) -> Column:
    """False for null vectors and those with null, NaN or infinite components or none but zeros."""
    bad = F.exists(vec, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    return vec.isNotNull() & ~bad & F.exists(vec, lambda v: v != 0)


@dataclass
class Index:
    """Vectors, and the classes of equal ones with their smallest ids; both in the shared folder."""

    rows: DataFrame  # vec_id, is_query, d, v1, v2
    classes: DataFrame  # v1, v2, x, members
    asked: DataFrame  # v1, v2, x of classes that hold a query
    k: int


def prepare(vectors: DataFrame, queries: Column, *, vec_id: str = "vec_id", vector: str = "embedding", k: int = 5) -> Index:
    rows = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(vector).alias("x"), F.coalesce(queries, F.lit(False)).alias("is_query"))
    rows = rows.where(F.col("vec_id").isNotNull() & usable(F.col("x")))
    exact = F.col("x").cast("array<double>")
    rows = rows.withColumns({"d": F.size("x"), "v1": F.xxhash64(F.lit(1), exact), "v2": F.xxhash64(F.lit(2), exact)})
    # A class keeps its k + 1 smallest ids, and the k + 1 smallest of each map-side part hold them.
    least = rows.groupBy("v1", "v2").agg(F.any_value("x").alias("x"), F.max("is_query").alias("asked"), F.count("*").alias("c"))
    ids = rows.select("vec_id", "is_query", "d", "v1", "v2").distinct()
    ids = materialize(ids, "ids")
    nth = F.row_number().over(Window.partitionBy("v1", "v2").orderBy("vec_id"))
    members = ids.select("vec_id", "v1", "v2").distinct().withColumn("n", nth).where(F.col("n") <= k + 1).groupBy("v1", "v2").agg(F.sort_array(F.collect_list("vec_id")).alias("members"))
    classes = materialize(least.join(members, ["v1", "v2"]).select("v1", "v2", "x", "members", "asked"), "classes")
    return Index(ids, classes, classes.where("asked").select("v1", "v2", "x"), k)


def fit(index: Index, *, wanted: float = WANTED, sample_queries: int = SAMPLE_QUERIES, sample_vectors: int = SAMPLE_VECTORS) -> Setting:
    """The setting that visits the fewest vectors and finds at least ``wanted`` of the true neighbours of a sample.

    The sample is ``sample_queries`` query vectors, those with the smallest hashes,
    and their nearest classes by a full pass; the share of all vectors in the
    buckets that they visit is estimated on ``sample_vectors`` vectors.
    """
    some = index.asked.orderBy("v1", "v2").limit(sample_queries).toArrow()
    others = index.classes.select("v2", "v1", "x").orderBy("v2", "v1").limit(sample_vectors).select("x").toArrow()
    if not some.num_rows:
        return Setting()
    near = scan(index.classes, some, index.k + 1).groupBy("q1", "q2", "c1", "c2").agg(F.max("score").alias("score"))
    rank = F.row_number().over(Window.partitionBy("q1", "q2").orderBy(F.desc("score"), "c1"))
    near = near.where("NOT (q1 = c1 AND q2 = c2)").withColumn("n", rank).where(F.col("n") <= index.k)
    at = {q: i for i, q in enumerate(zip(some["v1"].to_pylist(), some["v2"].to_pylist()))}
    pairs = near.join(index.classes.select(F.col("v1").alias("c1"), F.col("v2").alias("c2"), "x"), ["c1", "c2"]).select("q1", "q2", "x").toArrow().to_pylist()
    mine: dict[int, list] = {}
    xs = some["x"].to_pylist()
    for r in pairs:
        mine.setdefault(len(r["x"]), []).append((at[r["q1"], r["q2"]], r["x"]))
    if not mine:
        return Setting()
    sets = []
    for d, rows in mine.items():
        rand = [v for v in others["x"].to_pylist() if len(v) == d]
        asked, back = np.unique([i for i, _ in rows], return_inverse=True)
        sets.append((d, np.array([xs[i] for i in asked.tolist()], float), back, np.array([v for _, v in rows], float), np.array(rand, float).reshape(-1, d)))
    total = index.classes.count()
    best, most = None, None
    for tables, hashes, step in itertools.product(GRID["tables"], GRID["hashes"], GRID["step"]):
        first, share = [], []  # the least number of probes that finds a pair; share of vectors met by each number of probes
        for d, q, of, c, rand in sets:
            h = Hasher(d, Setting(tables, hashes, step))
            visited = h.probed(q, MOST_PROBES).reshape(len(q), tables, -1)
            hit = visited[of] == h.keys(c)[:, :, None]
            first.append(np.where(hit.any(2), hit.argmax(2), 1 << 20).min(1))
            keys = h.keys(rand) if len(rand) else np.zeros((0, tables), np.int64)
            met = np.zeros(visited.shape[2])
            for t in range(tables):
                values, n = np.unique(keys[:, t], return_counts=True)
                if len(values):
                    pos = np.minimum(np.searchsorted(values, visited[:, t]), len(values) - 1)
                    met += np.cumsum(np.where(values[pos] == visited[:, t], n[pos], 0), axis=1).mean(0) / len(keys)
            share.append((len(q), met))
        first = np.sort(np.concatenate(first))
        met = sum(n * m for n, m in share) / sum(n for n, _ in share)
        need = first[min(len(first) - 1, int(np.ceil(wanted * len(first))) - 1)]
        probes = int(need) if need <= len(met) - 1 else len(met) - 1
        recall = float((first <= probes).mean())
        # A visit of a bucket costs about as much as four vectors in it.
        cost = met[probes] * total + tables * (probes + 1) * 4
        made = Setting(tables, hashes, step, probes, recall, float(met[probes]))
        if recall >= wanted and (best is None or cost < best[0]):
            best = (cost, made)
        if most is None or recall > most.recall:
            most = made
    return best[1] if best else most


def scan(classes: DataFrame, block: pa.Table, k: int) -> DataFrame:
    """The ``k`` nearest classes of each of a bounded block of queries, found by every batch of all vectors."""
    held = classes.sparkSession.sparkContext.broadcast(block)
    return classes.select("v1", "v2", "members", "x").mapInArrow(lambda it: _scanned(it, held.value, k), FOUND)


def _scanned(batches: Iterator[pa.RecordBatch], block: pa.Table, k: int) -> Iterator[pa.RecordBatch]:
    b1, b2 = block["v1"].to_numpy(), block["v2"].to_numpy()
    queries = {d: (at, q) for d, at, q in _by_length(block["x"].combine_chunks())}
    for batch in batches:
        v1, v2, members = batch.column("v1").to_numpy(), batch.column("v2").to_numpy(), batch.column("members")
        ids = _firsts(members)
        for d, mine, c in _by_length(batch.column("x")):
            if d not in queries:
                continue
            at, q = queries[d]
            row, col, score = top(q, c, ids[mine], k)
            who, what = at[row], mine[col]
            yield pa.RecordBatch.from_arrays([pa.array(b1[who]), pa.array(b2[who]), pa.array(v1[what]), pa.array(v2[what]), members.take(pa.array(what)), pa.array(score)], _NAMES)


def search(
    vectors: DataFrame, queries: Column, *, vec_id: str = "vec_id", vector: str = "embedding", k: int = 5, setting: Setting | None = None, crowded: int = CROWDED, sweep: int = 1024,
) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` nearest found of every row where ``queries`` holds.

    Unusable vectors and null ids take no part; vectors of different lengths are
    searched apart. Equal vectors with different ids are neighbours of score 1 (to
    rounding); rows that repeat an id and vector are one. Ties go to the smaller
    id. The setting is fitted unless given. Queries that find fewer than ``k``
    although there are more are compared with all vectors, ``sweep`` at a time.
    """
    ship(vectors.sparkSession)
    index = prepare(vectors, queries, vec_id=vec_id, vector=vector, k=k)
    found = visits(index, setting or fit(index), crowded=crowded)
    nearest = F.row_number().over(Window.partitionBy("q1", "q2").orderBy(F.desc("score"), F.get("members", F.lit(0))))
    # Each class has a member, so those of k + 1 classes hold the k nearest of every query of a class.
    found = found.groupBy("q1", "q2", "c1", "c2").agg(F.max("score").alias("score"), F.any_value("members").alias("members"))
    found = materialize(found.withColumn("n", nearest).where(F.col("n") <= k + 1).drop("n"), "found")
    asked = index.rows.where("is_query").select("vec_id", "d", "v1", "v2").distinct()
    top_k = _nearest(asked, found, k)
    met = top_k.groupBy(F.col("query_id").alias("vec_id")).agg(F.count("*").alias("c"))
    total = F.broadcast(index.rows.groupBy("d").agg(F.count_distinct("vec_id").alias("total")))  # a row for each length of vectors
    short = asked.join(met, "vec_id", "left").join(total, "d").where(F.coalesce("c", F.lit(0)) < F.least(F.lit(k), F.col("total") - 1))
    short, seen = materialize_counted(short.select("vec_id", "v1", "v2", "d"), "short")
    if not seen["rows"]:
        return top_k
    swept = _swept(index, short, seen["rows"], sweep)
    rest = top_k.join(short.select(F.col("vec_id").alias("query_id")).distinct(), "query_id", "left_anti")
    return rest.unionByName(_nearest(short.select("vec_id", "d", "v1", "v2"), swept, k))


def visits(index: Index, setting: Setting, *, crowded: int = CROWDED) -> DataFrame:
    """What queries find in the buckets that they visit, table by table; rows of FOUND."""
    hashers = "array<long>"

    @F.arrow_udf(hashers)
    def index_keys(x: pa.Array) -> pa.Array:
        return _keys(x, lambda d, v: Hasher(d, setting).keys(v))

    @F.arrow_udf(hashers)
    def probe_keys(x: pa.Array) -> pa.Array:
        return _keys(x, lambda d, v: Hasher(d, setting).probed(v, setting.probes))

    span = F.lit(max(1, -(-index.classes.count() // crowded)))  # tasks of a table, as many as its size asks for
    stored = index.classes.withColumn("keys", index_keys("x")).select("v1", "v2", "x", "members", F.posexplode("keys").alias("t", "key"))
    stored = stored.withColumn("place", F.xxhash64(F.size("x"), "t", F.pmod("key", span)))
    # Own and perturbed buckets of a table lie next to each other in the list.
    each = 1 + len(perturbations(setting.hashes, setting.probes))
    probing = index.asked.withColumn("keys", probe_keys("x")).select("v1", "v2", "x", F.posexplode("keys").alias("i", "key"))
    probing = probing.withColumn("t", F.expr(f"i div {each}").cast("int")).withColumn("place", F.xxhash64(F.size("x"), "t", F.pmod("key", span)))
    probing = probing.groupBy("v1", "v2", "place").agg(F.collect_set("key").alias("keys")).join(index.asked, ["v1", "v2"])
    full = stored.groupBy("place").count().where(F.col("count") > 2 * crowded)
    full = full.select("place", F.ceil(F.col("count") / crowded).cast("int").alias("parts"))
    salt = F.coalesce(F.pmod(F.xxhash64("v1", "v2"), F.col("parts")), F.lit(0)).cast("int")
    stored = stored.join(full, "place", "left").select("v1", "v2", "x", "members", F.array("key").alias("keys"), F.xxhash64("place", salt).alias("task"), F.lit(False).alias("probe"))
    parts = F.explode(F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1))
    probing = probing.join(full, "place", "left").select("v1", "v2", "x", "keys", "place", parts.alias("part"))
    probing = probing.select("v1", "v2", "x", F.lit(None).cast("array<long>").alias("members"), "keys", F.xxhash64("place", "part").alias("task"), F.lit(True).alias("probe"))
    sent = stored.unionByName(probing).repartition("task").sortWithinPartitions("task")
    k = index.k + 1
    return sent.mapInArrow(lambda it: _visit(it, k), FOUND)


def _keys(x: pa.Array, of) -> pa.Array:
    out: list = [None] * len(x)
    groups = list(_by_length(x))
    if len(groups) == 1:
        keys = of(groups[0][0], groups[0][2])
        return pa.ListArray.from_arrays(pa.array(np.arange(len(keys) + 1) * keys.shape[1], pa.int32()), pa.array(keys.ravel()))
    for d, at, v in groups:
        for i, keys in zip(at.tolist(), of(d, v)):
            out[i] = keys
    return pa.array(out, pa.list_(pa.int64()))


def _nearest(asked: DataFrame, found: DataFrame, k: int) -> DataFrame:
    near = asked.select(F.col("vec_id").alias("query_id"), F.col("v1").alias("q1"), F.col("v2").alias("q2")).join(found, ["q1", "q2"])
    near = near.select("query_id", F.explode("members").alias("vec_id"), "score").where("vec_id != query_id").groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return near.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _swept(index: Index, short: DataFrame, count: int, sweep: int) -> DataFrame:
    """The nearest classes of queries that found too few, against all vectors, block by block.

    A block is a folder of the shared storage that every task reads; nothing of it passes through the driver.
    """
    spark, k = short.sparkSession, index.k + 1
    blocks = -(-count // sweep)
    folder, out = new_path(spark, "blocks"), new_path(spark, "swept")
    wanted = short.select("v1", "v2").distinct().join(index.asked, ["v1", "v2"])
    wanted.withColumn("block", F.pmod(F.xxhash64("v1", "v2"), F.lit(blocks)).cast("int")).write.partitionBy("block").parquet(folder)

    def over(b: int):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            import pyarrow.dataset as ds
            from pyarrow import fs

            store, at = arrow_path(f"{folder}/block={b}")
            if store.get_file_info(at).type != fs.FileType.NotFound:
                yield from _scanned(batches, ds.dataset(at, filesystem=store, format="parquet").to_table(columns=["v1", "v2", "x"]), k)

        return run

    rank = F.row_number().over(Window.partitionBy("q1", "q2").orderBy(F.desc("score"), F.get("members", F.lit(0))))
    for b in range(blocks):
        found = index.classes.select("v1", "v2", "members", "x").mapInArrow(over(b), FOUND)
        found.withColumn("n", rank).where(F.col("n") <= k).drop("n").write.mode("append").parquet(out)
    return spark.read.schema(FOUND).parquet(out)


def query(spark, sf_dir: str) -> DataFrame:
    """The 5 nearest of every fiftieth vector among all others."""
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding")
    return search(vectors, F.col("vec_id") % 50 == 0)
