"""Document quality: a weak-label model over heuristic labellers, then a hashed linear scorer.

Ten heuristics each call a text good, bad, or abstain. Their accuracies are
not known: expectation-maximisation estimates them, with the share of good
texts, from how often each pattern of votes occurs over all documents. The
posterior of a document's pattern is its label, and a logistic regression over
hashed features learns those labels, so that texts on which heuristics abstain
are scored too.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillframe.llm.buffers import in_one_task, mix64, pieces, row_slices, utf8_bytes
from quillframe.llm.minhash import word_hashes
from quillframe.shared import materialize, release, ship

SLICE_BYTES = 1 << 19
PIECE_BYTES = 1 << 22
BITS = 16
LABELLERS = ("capitals", "symbols", "shouting", "separators", "distinct_words", "word_length", "sentences", "distinct_lines", "tripled_marks", "repeated_words")
LEAST_WORDS = 5

_KIND = np.full(256, 6, np.uint8)  # 0 lower, 1 capital, 2 digit, 3 space, 4 line end, 5 sentence mark, 6 other
_KIND[97:123] = _KIND[128:] = 0
_KIND[65:91] = 1
_KIND[48:58] = 2
_KIND[[9, 11, 12, 13, 32]] = 3
_KIND[10] = 4
_KIND[[33, 46, 63]] = 5
_KIND[[34, 39, 40, 41, 44, 45, 58, 59]] = 7  # marks of ordinary prose


def statistics(data: np.ndarray, offs: np.ndarray, piece: int = PIECE_BYTES) -> dict[str, np.ndarray]:
    """Counts and ratios of each row; bytes are read ``piece`` at a time, with no effect of a row on another."""
    n = len(offs) - 1
    h, wo = word_hashes(data, offs, piece)
    words = np.diff(wo).astype(np.float64)
    distinct = np.array([len(np.unique(h[wo[i] : wo[i + 1]])) for i in range(n)], np.float64)
    said = np.zeros(len(h), bool)
    said[1:] = h[1:] == h[:-1]
    said[wo[:-1][np.diff(wo) > 0]] = False
    count, tallies = np.zeros((n, 8)), np.zeros((3, n))
    line_row, line_hash, line_at = [], [], 0
    for a, z, row, _ in pieces(offs, piece):
        # Three bytes before the piece decide on its first ones.
        low = max(0, a - 3)
        back = a - low
        x = data[low:z]
        r = np.concatenate([np.searchsorted(offs, np.arange(low, a), "right") - 1, row])
        kind = _KIND[x]
        accented = np.zeros(len(x), bool)
        accented[1:] = (x[:-1] == 0xC3) & (x[1:] >= 0x80) & (x[1:] <= 0x9E)
        kind = np.where(accented, 1, kind)
        double, run = np.zeros(len(x), bool), np.zeros(len(x), bool)
        double[1:] = (x[1:] == 33) & (x[:-1] == 33) & (r[1:] == r[:-1])
        run[2:] = (kind[2:] >= 5) & (x[2:] != 46) & (x[2:] == x[1:-1]) & (x[1:-1] == x[:-2]) & (r[2:] == r[:-2])
        triple = run.copy()
        triple[1:] &= ~(run[:-1] & (r[1:] == r[:-1]))  # once for each run
        count += np.bincount(row * 8 + kind[back:], minlength=8 * n).reshape(n, 8)
        for k, mark in enumerate((double[back:], x[back:] == 124, triple[back:])):
            tallies[k] += np.bincount(row[mark], minlength=n)
        # Lines by sums of mixed bytes and places; a line may go on from the piece before.
        y = data[a:z]
        first = np.zeros(len(y), bool)
        first[1:] = (y[:-1] == 10) | (row[1:] != row[:-1])
        fresh = a == 0 or data[a - 1] == 10 or bool(np.any(offs == a))
        first[0] = True
        starts = np.flatnonzero(first)
        place = np.arange(len(y)) - np.repeat(starts, np.diff(np.append(starts, len(y))))
        place[: starts[1] if len(starts) > 1 else len(y)] += 0 if fresh else a - line_at
        if fresh or len(starts) > 1:
            line_at = a + int(starts[-1])
        each = np.add.reduceat(mix64(y.astype(np.uint64) + np.uint64(1) + place.astype(np.uint64) * np.uint64(257)), starts)
        if not fresh:
            line_hash[-1][-1:] += each[:1]
            each, starts = each[1:], starts[1:]
        if len(starts):
            line_row.append(row[starts])
            line_hash.append(each)
    lines, unique_lines = np.ones(n), np.ones(n)
    if line_row:
        owner, value = np.concatenate(line_row), np.concatenate(line_hash)
        lines = np.maximum(1.0, np.bincount(owner, minlength=n))
        order = np.lexsort((value, owner))
        o, v = owner[order], value[order]
        new = np.concatenate([[True], (o[1:] != o[:-1]) | (v[1:] != v[:-1])])
        unique_lines = np.maximum(1.0, np.bincount(o[new], minlength=n))
    letters = count[:, 0] + count[:, 1]
    word_row = np.repeat(np.arange(n), np.diff(wo))
    least = lambda x: np.maximum(x, 1)
    return {
        "words": words, "capitals": count[:, 1] / least(letters), "symbols": count[:, 6] / least(np.diff(offs)), "shouting": tallies[0] / least(words), "separators": tallies[1] / least(words),
        "distinct_words": distinct / least(words), "word_length": letters / least(words), "sentences": count[:, 5] / least(words), "distinct_lines": unique_lines / lines, "lines": lines,
        "tripled_marks": tallies[2] / least(words), "repeated_words": np.bincount(word_row, said, n) / least(words),
    }


def votes(s: dict[str, np.ndarray]) -> np.ndarray:
    """(row, labeller): 1 good, -1 bad, 0 no opinion. Texts of few words get no opinion on ratios of words."""
    some, many = s["words"] >= LEAST_WORDS, s["words"] >= 30
    vote = lambda good, bad, when: np.where(when & bad, -1, np.where(when & good, 1, 0))
    of = {
        "capitals": vote(s["capitals"] < 0.15, s["capitals"] > 0.4, some),
        "symbols": vote(s["symbols"] < 0.01, s["symbols"] > 0.05, s["words"] > 0),
        "shouting": vote(s["shouting"] < 0.01, s["shouting"] > 0.1, some),
        "separators": vote(s["separators"] == 0, s["separators"] > 0.2, some),
        "distinct_words": vote(s["distinct_words"] > 0.35 * np.minimum(1, (300 / np.maximum(s["words"], 1)) ** 0.5), s["distinct_words"] < 0.12 * np.minimum(1, (300 / np.maximum(s["words"], 1)) ** 0.5), many),
        "word_length": vote((s["word_length"] > 2.5) & (s["word_length"] < 9), (s["word_length"] > 14) | (s["word_length"] < 1.5), some),
        "sentences": vote((s["sentences"] > 0.02) & (s["sentences"] < 0.4), (s["sentences"] < 0.002) | (s["sentences"] > 1.2), many),
        "distinct_lines": vote(s["distinct_lines"] > 0.8, s["distinct_lines"] < 0.3, s["lines"] >= 5),
        "tripled_marks": vote(s["tripled_marks"] < 0.02, s["tripled_marks"] > 0.1, some),
        "repeated_words": vote(s["repeated_words"] < 0.1, s["repeated_words"] > 0.3, some),
    }
    return np.stack([of[k] for k in LABELLERS], axis=1).astype(np.int8)


def pattern_of(v: np.ndarray) -> np.ndarray:
    return ((v + 1) * 3 ** np.arange(len(LABELLERS))).sum(1).astype(np.int64)


@dataclass
class LabelModel:
    good: float  # share of good texts
    table: np.ndarray  # (class, labeller, vote + 1) likelihoods; class 1 is good; 1 for an abstention, which tells nothing

    def posterior(self, pattern: np.ndarray) -> np.ndarray:
        """P(good) of vote patterns."""
        v = (np.asarray(pattern)[:, None] // 3 ** np.arange(len(LABELLERS))) % 3
        log = [np.log(self.table[c, np.arange(len(LABELLERS)), v]).sum(1) + np.log(p) for c, p in ((0, 1 - self.good), (1, self.good))]
        return 1 / (1 + np.exp(np.clip(log[0] - log[1], -700, 700)))


def expectation_maximisation(pattern: np.ndarray, count: np.ndarray, rounds: int = 200, tolerance: float = 1e-9) -> LabelModel:
    """Estimate labellers from pattern counts; no counts give a labeller's prior.

    At first a text without a bad vote is good at 0.95, one with a single bad vote
    at 0.3, others at 0.05.
    """
    v = (np.asarray(pattern)[:, None] // 3 ** np.arange(len(LABELLERS))) % 3
    prior = np.array([[[0.4, 1.0, 0.6]] * len(LABELLERS), [[0.02, 1.0, 0.98]] * len(LABELLERS)])
    if len(v) == 0 or count.sum() == 0:
        return LabelModel(0.8, prior)
    p = np.choose(np.minimum((v == 0).sum(1), 2), [0.95, 0.3, 0.05])
    model = LabelModel(0.5, prior)
    for _ in range(rounds):
        weight = np.stack([count * (1 - p), count * p])
        table = prior.copy()
        for c in range(2):
            # Ten imagined texts keep a labeller that never votes, or always agrees, within reason.
            n = {k: (weight[c][:, None] * (v == k)).sum(0) + 10 * prior[c, :, k] for k in (0, 2)}
            table[c, :, 0], table[c, :, 2] = n[0] / (n[0] + n[2]), n[2] / (n[0] + n[2])
        model = LabelModel(float((weight[1].sum() + 8) / (count.sum() + 10)), table)
        new = model.posterior(pattern)
        done = np.abs(new - p).max() < tolerance
        p = new
        if done:
            break
    return model


KINDS = ((4, "shape"), (3, "bytes"))


def features(data: np.ndarray, offs: np.ndarray, s: dict[str, np.ndarray], piece: int = PIECE_BYTES) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(kind, rows, buckets) of hashed features: shape runs and byte trigrams a piece at a time, then binned statistics."""
    n = len(offs) - 1
    for a, z, row, i in pieces(offs, piece):
        end = min(len(data), z + 3)
        x = data[a:end]
        if end > z:
            row = np.concatenate([row, np.searchsorted(offs, np.arange(z, end), "right") - 1])
        shape = np.where(_KIND[x] >= 5, x, _KIND[x]).astype(np.uint32)
        for k, codes in enumerate((shape, x.astype(np.uint32))):
            size = KINDS[k][0]
            m = min(z - a, len(x) - size + 1)  # n-grams that start in this piece
            if m <= 0:
                continue
            h = np.full(m, 0x9E3779B1 + k, np.uint32)
            for d in range(size):
                h = (h ^ codes[d : m + d]) * np.uint32(0x85EBCA6B)
            h ^= h >> np.uint32(15)
            whole = row[:m] == row[size - 1 : size - 1 + m]
            yield k, row[:m][whole], ((h * np.uint32(0xC2B2AE35)) >> np.uint32(32 - BITS))[whole].astype(np.int32)
    for k, name in enumerate(LABELLERS):
        bins = np.minimum(31, np.floor(np.log2(1 + 1023 * np.clip(s[name], 0, 8)) * 2)).astype(np.int32)
        yield len(KINDS) + k, np.arange(n), (1 << BITS) + 32 * k + bins


WIDTH = (1 << BITS) + 32 * len(LABELLERS)


@dataclass
class QualityModel:
    labels: LabelModel
    weight: np.ndarray
    bias: float

    def rate(self, texts) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(pattern, posterior, score) of an Arrow array of texts."""
        data, offs = utf8_bytes(texts)
        n = len(offs) - 1
        pattern, score = np.zeros(n, np.int64), np.zeros(n)
        for i, j in row_slices(offs, SLICE_BYTES):
            part, po = data[offs[i] : offs[j]], offs[i : j + 1] - offs[i]
            s = statistics(part, po)
            pattern[i:j] = pattern_of(votes(s))
            score[i:j] = self.bias + _mean_logit(features(part, po, s), self.weight, j - i)
        return pattern, self.labels.posterior(pattern), 1 / (1 + np.exp(-np.clip(score, -60, 60)))


def _mean_logit(feats, weight: np.ndarray, n: int) -> np.ndarray:
    total, count = np.zeros((len(KINDS) + len(LABELLERS), n)), np.zeros((len(KINDS) + len(LABELLERS), n))
    for kind, row, b in feats:
        total[kind] += np.bincount(row, weight[b], n)
        count[kind] += np.bincount(row, minlength=n)
    return (total / np.maximum(1, count)).sum(0)


def train(texts, target: np.ndarray, *, epochs: int = 60, rate: float = 4.0, l2: float = 1e-5) -> tuple[np.ndarray, float]:
    """(weights, bias) of a logistic regression with soft targets over mean feature values; classes count alike.

    Features are held by slices of a megabyte of text, four bytes a bucket and
    four a value, and each step goes through the slices.
    """
    if len(texts) == 0:
        return np.zeros(WIDTH), 1.0
    data, offs = utf8_bytes(texts)
    slices = []
    for i, j in row_slices(offs, SLICE_BYTES):
        part, po = data[offs[i] : offs[j]], offs[i : j + 1] - offs[i]
        keys, vals = [], []
        for _, row, b in features(part, po, statistics(part, po)):
            pair, c = np.unique(row * WIDTH + b, return_counts=True)
            keys.append(pair)
            vals.append((c / np.bincount(row, minlength=j - i)[pair // WIDTH]).astype(np.float32))
        key = np.concatenate(keys)
        order = np.argsort(key)
        key = key[order]
        slices.append((i, j, (key % WIDTH).astype(np.int32), np.concatenate(vals)[order], np.searchsorted(key, np.arange(j - i + 1) * WIDTH)))
    y = np.asarray(target, np.float64)
    bad = max(1e-9, (1 - y).sum())
    cost = np.where(y < 0.5, len(y) / 2 / bad, len(y) / 2 / max(1e-9, y.sum()))
    if (y >= 0.5).all() or (y < 0.5).all():
        cost = np.ones(len(y))
    w, c = np.zeros(WIDTH), 0.0
    g2 = np.full(WIDTH, 1e-6)
    for epoch in range(epochs):
        g, shift = l2 * w, 0.0
        for i, j, cols, val, at in slices:
            # Every row has its binned statistics, so no run is empty.
            z = np.add.reduceat(val * w[cols], at[:-1]) + c
            err = cost[i:j] * (1 / (1 + np.exp(-np.clip(z, -60, 60))) - y[i:j]) / len(y)
            g += np.bincount(cols, val * np.repeat(err, np.diff(at)), WIDTH)
            shift += err.sum()
        g2 += g * g
        w -= rate / np.sqrt(1 + epoch / 10) * g / np.sqrt(g2) / 8
        c -= shift
    return w, c


def fit(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", per_class: int = 2000, max_bytes: int = 16_384) -> QualityModel:
    """Count vote patterns over all documents, estimate the labellers, and train the scorer in an executor task.

    The scorer's sample is bounded: of the documents of at most ``max_bytes``
    bytes, ``per_class`` with posteriors below one half and as many others, those
    with the smallest hashes of the id. Null ids and texts are not in it; of rows
    that share an id, all are, at the lowest pattern.
    """
    spark = docs.sparkSession
    ship(spark)

    @F.arrow_udf("long")
    def pattern(texts: pa.Array) -> pa.Array:
        data, offs = utf8_bytes(texts)
        out = np.zeros(len(offs) - 1, np.int64)
        for i, j in row_slices(offs, SLICE_BYTES):
            out[i:j] = pattern_of(votes(statistics(data[offs[i] : offs[j]], offs[i : j + 1] - offs[i])))
        return pa.array(out)

    small = F.coalesce(F.octet_length(text) <= max_bytes, F.lit(False))
    voted = materialize(docs.select(F.col(doc_id).alias("doc_id"), small.alias("small"), pattern(text).alias("pattern")), "votes")
    seen = voted.groupBy("pattern").count().toArrow()  # 3 ** 10 rows at most
    patterns = seen["pattern"].to_numpy()
    labels = expectation_maximisation(patterns, seen["count"].to_numpy().astype(float))
    good = patterns[labels.posterior(patterns) >= 0.5].tolist() if len(patterns) else []
    usable = voted.where("small AND doc_id IS NOT NULL")
    is_good = F.col("pattern").isin(good) if good else F.lit(False)
    pick = [usable.where(c).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class) for c in (is_good, ~is_good)]
    ids = F.broadcast(pick[0].union(pick[1]).groupBy("doc_id").agg(F.min("pattern").alias("pattern")))  # 2 * per_class rows at most
    rows = docs.where(small).select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).join(ids, "doc_id")

    def trained(sample: pa.Table) -> dict[str, np.ndarray]:
        sample = sample.sort_by([("doc_id", "ascending"), ("text", "ascending")])
        weight, bias = train(sample["text"], labels.posterior(sample["pattern"].to_numpy()))
        return {"weight": weight, "bias": np.array([bias])}

    made = in_one_task(rows.select("doc_id", "text", "pattern"), trained) or {"weight": np.zeros(WIDTH), "bias": np.ones(1)}
    release(voted)
    return QualityModel(labels, made["weight"], float(made["bias"][0]))


def rate(docs: DataFrame, model: QualityModel, text: str = "text", threshold: float = 0.5) -> Column:
    """A column STRUCT<posterior, score, keep> for every whole text; a null text is an empty one, and texts without words are not kept."""
    ship(docs.sparkSession)
    held = docs.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("struct<posterior:double,score:double>")
    def of(texts: pa.Array) -> pa.Array:
        _, posterior, score = held.value.rate(texts)
        return pa.StructArray.from_arrays([pa.array(posterior), pa.array(score)], ["posterior", "score"])

    r = of(F.col(text))
    words = F.coalesce(F.col(text).rlike(r"[^\x20\x09-\x0D]"), F.lit(False))
    return F.struct(r["posterior"].alias("posterior"), r["score"].alias("score"), (words & (r["score"] >= threshold)).alias("keep"))


def query(spark, sf_dir: str) -> DataFrame:
    """Posterior label, score and decision for every document."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return docs.select("doc_id", rate(docs, fit(docs)).alias("r")).select("doc_id", "r.posterior", "r.score", "r.keep")
