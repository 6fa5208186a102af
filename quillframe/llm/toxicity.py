"""Toxicity: subword-bag embeddings averaged into a linear softmax, trained jointly.

A passage is a run of words; its vector is the mean of the embeddings of the
hashed byte n-grams of its words, word ends included, so that a misspelt or
inflected word shares most of its vector with known ones. Embeddings and softmax
are trained together by gradient descent on passages of labelled documents. A
document's label says only that some passage is toxic: after each round the
passages of toxic documents are labelled anew, only those that score as toxic,
and the best one of each document, stay positive. A document's score is that of
its most toxic passage, calibrated on labelled documents that did not train.

With the softmax frozen, the dot product of each embedding with it is one number,
so that whole texts are scored by sums of table lookups.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillframe.llm.buffers import in_one_task, row_slices, utf8_bytes
from quillframe.llm.langid import held_out
from quillframe.shared import ship

SIZES = (3, 4, 5, 6)
BITS = 17
DIM = 4
WINDOW, STRIDE = 12, 6
SLICE_BYTES = 1 << 20
LONG_BYTES, PIECE_WORDS = 8 << 20, 120_000

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BREAK = np.zeros(256, bool)
_BREAK[[*range(0, 48), *range(58, 64), *range(91, 97), *range(123, 128)]] = True
_BREAK[[36, 64]] = False  # $ and @ stand for letters at times

_POWER = np.cumprod(np.full(4096, 0x9E3779B97F4A7C15, np.uint64), dtype=np.uint64)


def ngrams(data: np.ndarray, offs: np.ndarray):
    """Word starts, rows of the words, and (position, bucket) of every n-gram, for rows given as bytes.

    The rows are joined by breaks; an n-gram may hold a break only at its ends.
    """
    n = len(offs) - 1
    x = np.full(len(data) + n + 1, 32, np.uint8)
    row = np.repeat(np.arange(n), np.diff(offs))
    x[np.arange(len(data)) + row + 1] = data
    after_c3 = np.zeros(len(x), bool)
    after_c3[1:] = x[:-1] == 0xC3
    x = _LOWER[x]
    upper = after_c3 & (x >= 0x80) & (x <= 0x9E) & (x != 0x97)
    x[upper] += 0x20  # Latin capitals with marks
    stop = _BREAK[x]
    x[stop] = 32
    starts = np.flatnonzero(stop[:-1] & ~stop[1:])  # the break before each word
    rows = np.searchsorted(offs + np.arange(n + 1), starts, "right") - 1
    where = np.where(stop, np.arange(len(x)), len(x) + 8)
    nxt = np.empty(len(x), np.int64)
    nxt[:-1] = np.minimum.accumulate(where[::-1])[::-1][1:]
    nxt[-1] = len(x) + 8
    nxt -= np.arange(len(x))  # distance to the next break
    w = x.astype(np.uint32)
    h = np.full(len(x), 0x811C9DC5, np.uint32)
    grams = []
    for k in range(SIZES[-1]):
        h = h[: len(x) - k]
        h = (h ^ w[k:]) * np.uint32(0x01000193)
        if k + 1 in SIZES:
            at = np.flatnonzero(nxt[: len(x) - k] >= k)
            at = at[(~stop[at]) | (nxt[at] > 1)]
            v = h[at]
            v = (v ^ (v >> np.uint32(15))) * np.uint32(0x2C1B3C6D)
            grams.append((at, (v ^ (v >> np.uint32(13))) & np.uint32((1 << BITS) - 1)))
    again = _repeated(x, stop, starts, rows)
    if again.any():  # a word that has just been said adds nothing to a passage but its length
        inside = np.zeros(len(x), np.int64)
        inside[starts] = 1
        inside = np.cumsum(inside) - 1
        grams = [(at, np.where(again[np.maximum(inside[at], 0)], 1 << BITS, b)) for at, b in grams]
    return len(x), starts, rows, grams


def _repeated(x: np.ndarray, stop: np.ndarray, starts: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """True for words that are also among the WINDOW - 1 words before them in their row."""
    if not len(starts):
        return np.zeros(0, bool)
    ends = np.flatnonzero(~stop[:-1] & stop[1:]) + 1
    length = ends - starts - 1
    at = np.arange(len(x)) - np.repeat(np.append(0, starts), np.diff(np.concatenate([[0], starts, [len(x)]])))
    each = np.where(stop, 0, (x.astype(np.uint64) + np.uint64(1)) * _POWER[at % 4096])
    sums = np.concatenate([[np.uint64(0)], np.cumsum(each, dtype=np.uint64)])
    h = sums[ends] - sums[starts + 1] + length.astype(np.uint64)
    out = np.zeros(len(starts), bool)
    for k in range(1, WINDOW):
        out[k:] |= (h[k:] == h[:-k]) & (rows[k:] == rows[:-k])
    return out


def passages(rows: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, first word, end word) of runs of WINDOW words every STRIDE words; each row with words has one."""
    count = np.bincount(rows, minlength=n) if len(rows) else np.zeros(n, np.int64)
    first = np.cumsum(count) - count
    k = np.where(count > 0, 1 + np.maximum(0, -(-(count - WINDOW) // STRIDE)), 0)
    row = np.repeat(np.arange(n), k)
    i = np.arange(int(k.sum())) - np.repeat(np.cumsum(k) - k, k)
    a = first[row] + i * STRIDE
    return row, a, np.minimum(a + WINDOW, first[row] + count[row])


@dataclass
class ToxicityModel:
    value: np.ndarray  # bucket -> softmax logit of its embedding; a last one of 0 for repeated words
    bias: float
    middle: float  # logit that is scored 0.5
    scale: float

    def _bags(self, data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, first word, logit) of every passage."""
        size, starts, rows, grams = ngrams(data, offs)
        total, count = np.zeros(size + 1), np.zeros(size + 1)
        for at, b in grams:
            total[at + 1] += self.value[b]
            count[at + 1] += 1
        total, count = np.cumsum(total), np.cumsum(count)
        row, a, z = passages(rows, len(offs) - 1)
        edge = np.append(starts, size)
        return row, a, (total[edge[z]] - total[edge[a]]) / np.maximum(1, count[edge[z]] - count[edge[a]]) + self.bias

    def logits(self, data: np.ndarray, offs: np.ndarray, piece_words: int = PIECE_WORDS) -> np.ndarray:
        """Largest passage logit of each row; that of an empty bag for rows without words.

        A row of over eight megabytes is read ``piece_words`` words at a time, each
        piece with the words around it that its passages need.
        """
        n = len(offs) - 1
        out = np.full(n, self.bias)
        for i, j in row_slices(offs, SLICE_BYTES):
            part = data[offs[i] : offs[j]]
            if len(part) > LONG_BYTES:
                out[i] = self._long(part, piece_words)
                continue
            row, _, bag = self._bags(part, offs[i : j + 1] - offs[i])
            if len(row):
                first = np.flatnonzero(np.concatenate([[True], row[1:] != row[:-1]]))
                out[i + row[first]] = np.maximum.reduceat(bag, first)
        return out

    def _long(self, row: np.ndarray, piece_words: int) -> float:
        inside = ~_BREAK[row]
        inside[1:] &= _BREAK[row[:-1]]
        word = np.flatnonzero(inside)
        del inside
        best = -np.inf
        step = piece_words // STRIDE * STRIDE
        for k in range(0, len(word), step):
            low, high = max(0, k - 2 * STRIDE), min(len(word), k + step + WINDOW)
            part = row[word[low] : word[high] if high < len(word) else len(row)]
            _, a, bag = self._bags(part, np.array([0, len(part)]))
            mine = (a >= k - low) & (a < k - low + step)
            best = max(best, bag[mine].max(initial=-np.inf))
        return best if np.isfinite(best) else self.bias

    def scores(self, data: np.ndarray, offs: np.ndarray) -> np.ndarray:
        return 1.0 / (1.0 + np.exp(-np.clip((self.logits(data, offs) - self.middle) * self.scale, -60, 60)))


def train(
    texts: list[str], labels: np.ndarray, *, rounds: int = 5, epochs: int = 2, least: int = 60_000, rate: float = 30.0, batch: int = 512, seed: int = 5,
    positive: int = 25_000, negative: int = 25_000, hard: int = 10_000,
) -> ToxicityModel:
    """Joint gradient descent on embeddings and softmax over passages of the sample.

    A round draws at most ``positive`` and ``negative`` passages of the two
    classes, ``hard`` of the latter being those of the highest score, and goes
    through them at least ``epochs`` times and for at least ``least`` steps of one
    passage. Without both classes every score is that of the only one.
    """
    labels, every = np.asarray(labels), texts
    rest = np.arange(len(labels)) % 4 == 3  # calibrates only
    if len(set(labels[rest])) == 2 and len(set(labels[~rest])) == 2:
        unseen = utf8_bytes(pa.array([t for t, r in zip(every, rest) if r], pa.large_string())), labels[rest]
        texts, labels = [t for t, r in zip(every, rest) if not r], labels[~rest]
    else:
        unseen = None
    if len(labels) == 0 or labels.min() == labels.max():
        only = bool(len(labels) and labels.min() == 1)
        return ToxicityModel(np.zeros((1 << BITS) + 1), 0.0, -4.0 if only else 4.0, 1.0)
    data, offs = utf8_bytes(pa.array(texts, pa.large_string()))
    # By slices, so that only buckets and passage bounds are held for the whole sample.
    buckets, rows_of, los, his, spans = [], [], [], [], []
    held = 0
    for i, j in row_slices(offs, 1 << 18):
        size, starts, rows, grams = ngrams(data[offs[i] : offs[j]], offs[i : j + 1] - offs[i])
        at = np.concatenate([g[0] for g in grams]) if grams else np.zeros(0, np.int64)
        bucket = np.concatenate([g[1] for g in grams]).astype(np.int32) if grams else np.zeros(0, np.int32)
        order = np.argsort(at, kind="stable")
        at, bucket = at[order], bucket[order]
        row, a, z = passages(rows, j - i)
        edge = np.searchsorted(at, np.append(starts, size))
        some = edge[z] > edge[a] if len(row) else np.zeros(0, bool)
        spans.append((sum(map(len, rows_of)), held, len(bucket)))
        rows_of.append(row[some] + i)
        los.append(edge[a][some] + held)
        his.append(edge[z][some] + held)
        buckets.append(bucket)
        held += len(bucket)
    row, lo, hi, bucket = (np.concatenate(x) for x in (rows_of, los, his, buckets))
    del buckets
    spans = [(k[0], nxt[0], k[1], k[2]) for k, nxt in zip(spans, [*spans[1:], (len(row), 0, 0)])]

    def scored(value: np.ndarray, bias: float) -> np.ndarray:
        out = np.empty(len(row))
        for a, z, h, n in spans:
            sums = np.concatenate([[0.0], np.cumsum(value[bucket[h : h + n]], dtype=np.float64)])
            out[a:z] = (sums[hi[a:z] - h] - sums[lo[a:z] - h]) / (hi[a:z] - lo[a:z]) + bias
        return out

    rng = np.random.default_rng(seed)
    e = np.zeros(((1 << BITS) + 1, DIM), np.float32)
    w = rng.normal(0, 1, (DIM, 2)).astype(np.float32)
    c = np.zeros(2, np.float32)
    toxic = labels[row] == 1
    target, used = toxic.copy(), np.ones(len(row), bool)
    clean = np.flatnonzero(~toxic)
    for r in range(rounds):
        pos = rng.permutation(np.flatnonzero(target & used))[:positive]
        neg = rng.permutation(clean)[:negative]
        if r:  # with the clean passages that score highest
            neg = np.union1d(neg[: negative - hard], clean[np.argsort(-score[clean], kind="stable")[:hard]])
        both = np.concatenate([pos, neg])
        passes = max(epochs, -(-least // max(1, len(both))))
        for epoch in range(passes):
            pick = rng.permutation(both)
            for s in range(0, len(pick), batch):
                p = pick[s : s + batch]
                n = hi[p] - lo[p]
                idx = bucket[np.repeat(lo[p], n) + np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)]
                first = np.cumsum(n) - n
                mean = np.add.reduceat(e[idx], first, axis=0) / n[:, None].astype(np.float32)
                logit = mean @ w + c
                q = np.exp(logit - logit.max(1, keepdims=True))
                q /= q.sum(1, keepdims=True)
                q[np.arange(len(p)), target[p].astype(int)] -= 1
                step = rate * (1 - 0.7 * (r + epoch / passes) / rounds)
                back = (q @ w.T) / n[:, None].astype(np.float32)
                w -= 0.01 * step * (mean.T @ q) / len(p)
                c -= 0.01 * step * q.mean(0)
                near, inv = np.unique(idx, return_inverse=True)
                own = np.repeat(np.arange(len(p)), n)
                for d in range(DIM):
                    e[near, d] -= step * np.bincount(inv, back[own, d], len(near)).astype(np.float32) / 8
                e[-1] = 0
        value = e @ (w[:, 1] - w[:, 0])
        score = scored(value, float(c[1] - c[0]))
        # The best passage of each toxic document, and every other that scores as toxic, are positive from now on.
        best = np.full(len(labels), -np.inf)
        np.maximum.at(best, row, score)
        limit = np.quantile(score[clean], 0.995)
        used = ~toxic | (score >= best[row]) | (score > limit)
        used &= ~toxic | (score > np.quantile(score[clean], 0.98))  # else nothing in the document is like the others' toxic passages
    model = ToxicityModel(value.astype(np.float64), float(c[1] - c[0]), 0.0, 1.0)
    (data, offs), labels = unseen or ((data, offs), labels)
    top = model.logits(data, offs)
    # The cut with the least error, a false alarm counting five times; the middle of the gap around it.
    cut = np.unique(top)
    cut = np.concatenate([[cut[0] - 1], (cut[1:] + cut[:-1]) / 2])
    bad = np.searchsorted(np.sort(top[labels == 1]), cut) / max(1, (labels == 1).sum())
    false = 1 - np.searchsorted(np.sort(top[labels == 0]), cut) / max(1, (labels == 0).sum())
    err = bad + 5 * false
    ties = np.flatnonzero(err <= err.min() + 1e-12)
    model.middle = float(cut[ties[len(ties) // 2]])
    up, down = np.median(top[labels == 1]), np.median(top[labels == 0])
    model.scale = float(6.0 / max(1e-6, up - down))
    return model


def fit(docs: DataFrame, labels: DataFrame, *, doc_id: str = "doc_id", text: str = "text", label: str = "toxic", per_class: int = 2000, max_bytes: int = 16_384) -> ToxicityModel:
    """Train on a bounded sample of labelled rows, in an executor task.

    Of the labelled texts of at most ``max_bytes`` bytes, the sample has those of
    ``per_class`` ids of each class, the ones with the smallest hash. An id that is
    labelled more than once is toxic if any label is; null labels, ids and texts
    do not count.
    """
    ship(docs.sparkSession)
    known = labels.where(F.col(label).isNotNull() & F.col(doc_id).isNotNull()).groupBy(F.col(doc_id).alias("doc_id")).agg(F.max(label).cast("int").alias("y"))
    small = docs.where((F.octet_length(text) <= max_bytes) & F.col(doc_id).isNotNull()).select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    usable = small.select("doc_id").distinct().join(known, "doc_id")
    pick = [usable.where(F.col("y") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class) for y in (0, 1)]
    ids = F.broadcast(pick[0].union(pick[1]))  # 2 * per_class rows at most

    def trained(sample: pa.Table) -> dict[str, np.ndarray]:
        sample = sample.sort_by([("doc_id", "ascending"), ("text", "ascending")])
        m = train(sample["text"].to_pylist(), sample["y"].to_numpy())
        return {"value": m.value, "rest": np.array([m.bias, m.middle, m.scale])}

    made = in_one_task(small.join(ids, "doc_id").select("doc_id", "text", "y"), trained)
    return ToxicityModel(made["value"], *made["rest"].tolist()) if made else train([], np.array([]))


def score(docs: DataFrame, model: ToxicityModel, text: str = "text") -> Column:
    """Score from 0 to 1 of every whole text; a null text is an empty one."""
    ship(docs.sparkSession)
    held = docs.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("double")
    def of(texts: pa.Array) -> pa.Array:
        return pa.array(held.value.scores(*utf8_bytes(texts)))

    return of(F.col(text))


def query(spark, sf_dir: str) -> DataFrame:
    """Toxicity of every document, learnt from labels of documents that are not held out."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "toxic")
    model = fit(docs, labels.where(F.col("doc_id").isNotNull() & ~held_out()))
    out = docs.select("doc_id", held_out().alias("held_out"), score(docs, model).alias("score"))
    return out.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
