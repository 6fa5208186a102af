"""Near-duplicate documents: MinHash with tensored banding, confirmed on full shingle sets.

A document's signature is ``groups`` small collections of ``width`` minhashes
each. Every pair of collections is the key of one table, so that
groups * width hash functions serve groups * (groups - 1) / 2 tables of
2 * width hashes. Two sets of similarity J miss every table only if at most
one collection agrees: with 16 collections of 4, that is 1.3e-4 at J = 0.85 and
1e-6 at J = 0.9. Exact copies of a set are collapsed before that, and clusters
of colliding sets are confirmed exactly, in blocks of bounded size.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillframe.llm.buffers import grouped, mix64, row_slices, utf8_bytes
from quillframe.llm.graph import connected_components
from quillframe.shared import materialize, release, ship

SLICE_BYTES = 1 << 19
PIECE_BYTES = 1 << 22
BLOCK_DOCS = 512
BLOCK_SHINGLES = 300_000

_rng = np.random.default_rng(20240229)
_BYTE = _rng.integers(1, 2**63, 256, dtype=np.uint64)
_MULT = np.uint64(0x9E3779B97F4A7C15)
_LANE = _rng.integers(1, 2**63, 64, dtype=np.uint64) | np.uint64(1)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


def word_hashes(data: np.ndarray, offs: np.ndarray, piece: int = PIECE_BYTES) -> tuple[np.ndarray, np.ndarray]:
    """(64-bit hash of every word of all rows, word offsets of the rows).

    Bytes are read ``piece`` at a time, so that a very long row, or a very long
    word, takes eight bytes a word and not many for each of its bytes.
    """
    cut = np.zeros(len(data) + 1, bool)
    cut[offs] = True
    starts, lengths, sums = [], [], []
    for a in range(0, len(data), piece):
        z = min(len(data), a + piece)
        start, length, each = _raw_words(data[a:z], cut[a : z + 1])
        start += a
        if a and len(start) and start[0] == a and not cut[a] and starts and starts[-1][-1] + lengths[-1][-1] == a:
            # The first word goes on from the piece before.
            lift = np.uint64(pow(int(_MULT), int(lengths[-1][-1]), 1 << 64))
            sums[-1][-1:] += each[:1] * lift
            lengths[-1][-1] += length[0]
            start, length, each = start[1:], length[1:], each[1:]
        if len(start):
            starts.append(start)
            lengths.append(length)
            sums.append(each)
    if not starts:
        return np.zeros(0, np.uint64), np.zeros(len(offs), np.int64)
    h = mix64(np.concatenate(sums) + np.concatenate(lengths).astype(np.uint64))
    return h, np.searchsorted(np.concatenate(starts), offs)


def _raw_words(data: np.ndarray, cut: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, length, polynomial sum) of each run of word bytes; ``cut`` marks borders of rows, one more than there are bytes."""
    inside = ~_SPACE[data]
    start = inside.copy()
    start[1:] &= ~inside[:-1] | cut[1:-1]
    stop = inside.copy()
    stop[:-1] &= ~inside[1:] | cut[1:-1]
    start, stop = np.flatnonzero(start), np.flatnonzero(stop) + 1
    lengths = stop - start
    if len(start) == 0:
        return start, lengths, np.zeros(0, np.uint64)
    at = np.arange(int(lengths.sum())) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    power = np.cumprod(np.concatenate([[np.uint64(1)], np.full(int(lengths.max()) - 1, _MULT)]), dtype=np.uint64)
    each = _BYTE[_LOWER[data[inside]]] * power[at]
    sums = np.concatenate([[np.uint64(0)], np.cumsum(each, dtype=np.uint64)])
    ends = np.cumsum(lengths)
    return start, lengths, sums[ends] - sums[ends - lengths]


def shingle_sets(data: np.ndarray, offs: np.ndarray, words: int) -> tuple[np.ndarray, np.ndarray]:
    """(sorted distinct shingle hashes of each row on end, row offsets)."""
    h, wo = word_hashes(data, offs)
    n = len(wo) - 1
    sets = []
    if len(h) >= words:
        s = h[: len(h) - words + 1] * _LANE[0]
        for k in range(1, words):
            s = s + h[k : len(h) - words + 1 + k] * _LANE[k]
        s = mix64(s)
    for i in range(n):
        a, b = int(wo[i]), int(wo[i + 1])
        if b - a >= words:
            u = np.sort(s[a : b - words + 1])
            sets.append(u[np.concatenate([[True], u[1:] != u[:-1]])])
        elif b > a:
            short = np.bitwise_xor(mix64((h[a:b] * _LANE[: b - a]).sum(dtype=np.uint64, keepdims=True)), _LANE[words + (b - a)])
            sets.append(mix64(short))
        else:
            sets.append(np.zeros(0, np.uint64))
    sizes = np.array([len(x) for x in sets], np.int64)
    return (np.concatenate(sets) if sets else np.zeros(0, np.uint64)), np.concatenate([[0], np.cumsum(sizes)])


def signatures(texts: pa.Array, words: int, groups: int, width: int) -> pa.Array:
    """STRUCT<n, d1, d2, sub>: set size, 128 bits of the whole set, one hash for each collection."""
    rng = np.random.default_rng(7)
    a = rng.integers(1, 2**63, groups * width, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    b = rng.integers(0, 2**63, groups * width, dtype=np.uint64)
    data, offs = utf8_bytes(texts)
    total = len(offs) - 1
    size, d1, d2 = np.zeros(total, np.int64), np.zeros(total, np.uint64), np.zeros(total, np.uint64)
    sub = np.zeros((total, groups), np.uint64)
    for i, j in row_slices(offs, SLICE_BYTES):
        u, so = shingle_sets(data[offs[i] : offs[j]], offs[i : j + 1] - offs[i], words)
        n = np.diff(so)
        size[i:j] = n
        full = np.flatnonzero(n)
        if not len(full):
            continue
        first = so[:-1][full]
        d1[i + full] = np.add.reduceat(mix64(u ^ _LANE[40]), first)
        d2[i + full] = np.add.reduceat(mix64(u ^ _LANE[41]), first)
        for g in range(groups):
            acc = np.full(len(full), g, np.uint64)
            for w in range(width):
                k = g * width + w
                acc = mix64(acc * _LANE[42] + np.minimum.reduceat(u * a[k] + b[k], first))
            sub[i + full, g] = acc
    lists = pa.ListArray.from_arrays(pa.array(np.arange(total + 1) * groups, pa.int32()), pa.array(sub.ravel().view(np.int64)))
    return pa.StructArray.from_arrays([pa.array(size), pa.array(d1.view(np.int64)), pa.array(d2.view(np.int64)), lists], ["n", "d1", "d2", "sub"])


def overlaps(u: np.ndarray, so: np.ndarray) -> np.ndarray:
    """Sizes of all intersections of the given sets, as a square matrix."""
    n = len(so) - 1
    owner = np.repeat(np.arange(n), np.diff(so))
    order = np.argsort(u, kind="stable")
    s, owner = u[order], owner[order]
    cut = np.concatenate([[0], np.flatnonzero(s[1:] != s[:-1]) + 1, [len(s)]]) if len(s) else np.zeros(1, np.int64)
    df = np.diff(cut)
    c = np.zeros(n * n, np.float64)
    for d in np.unique(df[(df > 1) & (df <= 24)]):
        rows = owner[cut[:-1][df == d][:, None] + np.arange(d)]
        for p in range(d):
            for q in range(p + 1, d):
                c += np.bincount(rows[:, p] * n + rows[:, q], minlength=n * n) if len(rows) > n * n // 8 else 0
        if len(rows) <= n * n // 8:
            p, q = np.triu_indices(d, 1)
            for part in range(0, len(rows), max(1, 2_000_000 // len(p))):
                r = rows[part : part + max(1, 2_000_000 // len(p))]
                np.add.at(c, (r[:, p] * n + r[:, q]).ravel(), 1)
    c = c.reshape(n, n)
    c = c + c.T
    common = np.flatnonzero(df > 24)
    for part in range(0, len(common), 2048):
        cols = common[part : part + 2048]
        m = np.zeros((n, len(cols)), np.float32)
        at = np.concatenate([np.arange(cut[k], cut[k + 1]) for k in cols])
        m[owner[at], np.repeat(np.arange(len(cols)), df[cols])] = 1
        c += m @ m.T
    return c


def confirmed_links(batches: Iterator[pa.RecordBatch], words: int, percent: int) -> Iterator[pa.RecordBatch]:
    """(a, b): for each block of documents, a star over those that exact links connect."""
    for table in grouped(batches, "task"):
        ids = table.column("rep").to_numpy()
        data, offs = utf8_bytes(table.column("text"))
        parts, so = [], [np.zeros(1, np.int64)]
        for i, j in row_slices(offs, SLICE_BYTES):
            u, o = shingle_sets(data[offs[i] : offs[j]], offs[i : j + 1] - offs[i], words)
            parts.append(u)
            so.append(o[1:] + so[-1][-1])
        so = np.concatenate(so)
        size = np.diff(so)
        c = overlaps(np.concatenate(parts), so)
        link = 100 * c >= percent * (size[:, None] + size[None, :] - c)
        link &= (size[:, None] > 0) & (size[None, :] > 0)
        x, y = np.nonzero(np.triu(link, 1))
        low = ids.copy()
        while len(x):
            was = low.copy()
            np.minimum.at(low, x, low[y])
            np.minimum.at(low, y, low[x])
            if (was == low).all():
                break
        keep = low != ids
        if keep.any():
            yield pa.RecordBatch.from_arrays([pa.array(ids[keep]), pa.array(low[keep])], ["a", "b"])


def near_duplicates(
    docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", words: int = 5, percent: int = 85, groups: int = 16, width: int = 4
) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for every row of ``docs``.

    Linked are documents whose sets of ``words``-word shingles have
    100 * intersection >= ``percent`` * union. ``component_id`` is the smallest
    doc_id that links reach. A null or wordless text has no shingle and no link.
    A row with null doc_id takes the component that its text links to, null if
    no id is in it; rows that share a doc_id are one node. ``kept`` is
    doc_id = component_id (true for two nulls). Other columns are ignored.

    Words and shingles are compared as 64-bit hashes, and equal sets as their
    size and 128 bits: two unlike sets of a thousand shingles share any hash by
    chance with a probability of about 1e-13.
    """
    spark = docs.sparkSession
    ship(spark)

    @F.arrow_udf("struct<n:long,d1:long,d2:long,sub:array<long>>")
    def sign(texts: pa.Array) -> pa.Array:
        return signatures(texts, words, groups, width)

    base = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    signed = materialize(base.select("doc_id", sign("text").alias("s")).select("doc_id", "s.n", "s.d1", "s.d2", "s.sub"), "signatures")
    # One representative for all documents with the same set: its smallest id, or a hash of the set if it has none.
    classes = signed.where("n > 0").groupBy("n", "d1", "d2").agg(F.min("doc_id").alias("own"), F.any_value("sub").alias("sub"))
    classes = materialize(classes.withColumn("rep", F.coalesce("own", F.xxhash64("d1", "d2"))), "classes")
    parts = classes.select("rep", F.posexplode("sub").alias("i", "sk"))
    shared = parts.groupBy("i", "sk").agg(F.count("*").alias("c")).where("c > 1").select("i", "sk")
    mine = parts.join(shared, ["i", "sk"], "left_semi").groupBy("rep").agg(F.sort_array(F.collect_set(F.struct("i", "sk"))).alias("s"))
    pairs = "flatten(transform(s, x -> transform(filter(s, y -> y.i > x.i), y -> xxhash64(x.i, y.i, x.sk, y.sk))))"
    keys = materialize(mine.where(F.size("s") > 1).select("rep", F.explode(F.expr(pairs)).alias("key")), "keys")
    stars = keys.groupBy("key").agg(F.min("rep").alias("low"), F.count("*").alias("c")).where("c > 1").select("key", "low")
    near = keys.join(stars, "key").where("rep != low").select(F.col("rep").alias("a"), F.col("low").alias("b"))
    clusters = connected_components(near)
    release(keys)
    found = connected_components(_links(base, classes, clusters, words, percent))
    of = classes.join(found, classes["rep"] == found["node"], "left").select("n", "d1", "d2", "own", "rep", "component")
    lowest = of.where("component IS NOT NULL AND own IS NOT NULL").groupBy("component").agg(F.min("own").alias("low"))
    of = of.join(lowest, "component", "left").select("n", "d1", "d2", F.when(F.col("component").isNull(), F.col("own")).otherwise(F.col("low")).alias("component_id"))
    of = materialize(of, "components")  # a plain side, so that a hot set's rows can be split in the join
    release(classes)
    out = signed.select("doc_id", "n", "d1", "d2").join(of, ["n", "d1", "d2"], "left")
    component = F.when(F.col("n") == 0, F.col("doc_id")).otherwise(F.col("component_id"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"))


def _links(base: DataFrame, classes: DataFrame, clusters: DataFrame, words: int, percent: int) -> DataFrame:
    """Confirmed links among the members of each cluster.

    A cluster is divided by set size (linked sets are at most one step apart) and each division into blocks of bounded size; every two blocks that
    can hold a link meet in one task.
    """
    size = classes.select("rep", "own", "n", "d1", "d2")
    members = clusters.join(size, clusters["node"] == size["rep"]).select("rep", "own", "n", "d1", "d2", F.col("component").alias("cluster"))
    members = materialize(members, "members")
    blocks = lambda docs, shingles: F.ceil(F.greatest(docs / F.lit(BLOCK_DOCS), shingles / F.lit(BLOCK_SHINGLES))).cast("int")
    whole = members.groupBy("cluster").agg(F.count("*").alias("c"), F.sum("n").alias("t")).select("cluster", blocks(F.col("c"), F.col("t")).alias("all"))
    placed = members.join(whole, "cluster").withColumn("step", F.when(F.col("all") <= 1, 0).otherwise(F.floor(F.log("n") / (-1.03 * math.log(percent / 100)))).cast("int"))
    placed = materialize(placed.select("rep", "cluster", "step", "n"), "placed")
    per = placed.groupBy("cluster", "step").agg(F.count("*").alias("c"), F.sum("n").alias("t")).select("cluster", "step", blocks(F.col("c"), F.col("t")).alias("nb"))
    around = per
    for shift, name in ((1, "above"), (-1, "below")):
        next_to = per.select("cluster", (F.col("step") - shift).alias("step"), F.col("nb").alias(name))
        around = around.join(next_to, ["cluster", "step"], "left")
    dealt = placed.join(around, ["cluster", "step"]).withColumn("b", F.pmod(F.xxhash64("rep"), F.col("nb")))
    tasks = """flatten(array(
        transform(sequence(0, nb - 1), x -> xxhash64(cluster, step, least(b, x), step, greatest(b, x))),
        if(above is null, array(), transform(sequence(0, above - 1), x -> xxhash64(cluster, step, b, step + 1, bigint(x)))),
        if(below is null, array(), transform(sequence(0, below - 1), x -> xxhash64(cluster, step - 1, bigint(x), step, b)))))"""
    dealt = dealt.select("rep", F.explode(F.expr(tasks)).alias("task"))
    # Members grow with the input: a merge join at every size. Ids that stand for several texts would send each of them, so a member's is the one with its set.
    texts = base.join(members.where("own IS NOT NULL").select("rep").distinct().hint("merge"), base["doc_id"] == F.col("rep")).select("rep", "text")
    unnamed = members.where("own IS NULL").select("rep", "d1", "d2")
    sent = dealt.join(texts.unionByName(_unnamed_texts(base, unnamed, words)), "rep").repartition("task").sortWithinPartitions("task")
    return sent.select("task", "rep", "text").mapInArrow(lambda it: confirmed_links(it, words, percent), "a long, b long")


def _unnamed_texts(base: DataFrame, unnamed: DataFrame, words: int) -> DataFrame:
    """(rep, text) of sets that only rows without id have: those rows are signed again, one of each set is taken."""

    @F.arrow_udf("struct<n:long,d1:long,d2:long,sub:array<long>>")
    def sign(texts: pa.Array) -> pa.Array:
        return signatures(texts, words, 0, 1)

    rows = base.where("doc_id IS NULL").select("text", sign("text").alias("s")).select("text", "s.d1", "s.d2")
    return rows.join(unnamed, ["d1", "d2"]).groupBy("rep").agg(F.any_value("text").alias("text"))


def query(spark, sf_dir: str) -> DataFrame:
    """Near-duplicate components of all documents."""
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))


ORACLE_SQL = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), sh AS (
  SELECT DISTINCT doc_id, CASE WHEN len(w) >= 5 THEN array_to_string(w[i:i + 4], ' ') ELSE array_to_string(w, ' ') END AS s
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM words WHERE len(w) > 0)
), sizes AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
inter AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM sh a JOIN sh b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY ALL),
links AS (SELECT x, y FROM inter JOIN sizes p ON p.doc_id = x JOIN sizes q ON q.doc_id = y WHERE 100 * c >= 85 * (p.n + q.n - c)),
reach AS (SELECT doc_id AS x, doc_id AS y FROM documents UNION SELECT r.x, l.y FROM reach r JOIN links l ON r.y = l.x),
comp AS (SELECT x, min(y) AS component_id FROM reach GROUP BY x)
SELECT d.doc_id, coalesce(s.n, 0) AS n_shingles, c.component_id, d.doc_id = c.component_id AS kept
FROM documents d JOIN comp c ON c.x = d.doc_id LEFT JOIN sizes s ON s.doc_id = d.doc_id
"""
