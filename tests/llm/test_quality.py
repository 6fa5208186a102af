import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from quillframe.llm import quality
from quillframe.llm.buffers import utf8_bytes

PROSE = "The river runs by the old mill, and people walk there. They talk of the weather. Some bring bread for the ducks, which gather at once. "


def stats(*texts):
    return quality.statistics(*utf8_bytes(pa.array(texts)))


def test_statistics_by_hand():
    s = stats("Ab cd!! x|y", "", None, "%%% a$$$$ b", "to to to be", "l1\nl1\nl1\nl2\nl3")
    assert s["words"].tolist() == [3, 0, 0, 3, 4, 5]
    assert abs(s["capitals"][0] - 1 / 6) < 1e-9 and s["shouting"][0] == 1 / 3 and s["separators"][0] == 1 / 3
    assert abs(s["tripled_marks"][3] - 2 / 3) < 1e-9 and s["repeated_words"][4] == 0.5 and s["distinct_words"][4] == 0.5
    assert s["distinct_lines"][5] == 3 / 5 and s["lines"].tolist()[:5] == [1] * 5


def test_expectation_maximisation_recovers_planted_accuracies():
    rng = np.random.default_rng(1)
    n, good = 20000, 0.85
    y = rng.random(n) < good
    bad_if_bad, bad_if_good = np.linspace(0.5, 0.95, len(quality.LABELLERS)), np.linspace(0.01, 0.1, len(quality.LABELLERS))
    v = np.where(rng.random((n, len(quality.LABELLERS))) < np.where(y[:, None], bad_if_good, bad_if_bad), -1, 1).astype(np.int8)
    v[rng.random(v.shape) < 0.3] = 0
    pattern, count = np.unique(quality.pattern_of(v), return_counts=True)
    m = quality.expectation_maximisation(pattern, count.astype(float))
    assert abs(m.good - good) < 0.02 and np.abs(m.table[0, :, 0] - bad_if_bad).max() < 0.05 and np.abs(m.table[1, :, 0] - bad_if_good).max() < 0.02
    assert ((m.posterior(quality.pattern_of(v)) >= 0.5) == y).mean() > 0.98


def test_no_documents(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    model = quality.fit(empty)
    docs = spark.createDataFrame([(1, PROSE), (2, None), (3, " "), (None, PROSE)], "doc_id long, text string")
    assert [r["k"] for r in docs.select(quality.rate(docs, model)["keep"].alias("k")).collect()] == [True, False, False, True]
    assert empty.select(quality.rate(empty, quality.fit(docs)).alias("r")).count() == 0


def test_agrees_with_labels_it_has_not_seen(spark):
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet").select("doc_id", "quality")
    p = quality.query(spark, "/root/testdata/sf0.1").join(labels, "doc_id").toPandas()
    assert p[p.quality == 1].keep.mean() > 0.99 and p[p.quality == 0].keep.mean() < 0.1


def test_pieces_change_nothing_and_rows_do_not_touch():
    rng = np.random.default_rng(4)
    texts = ["".join(rng.choice(list("ab C.!|\nÉe1%"), n)) for n in (0, 1, 5, 40, 300)] + ["!!", "!x", None, "same\nsame\nother"]
    data, offs = utf8_bytes(pa.array(texts))
    whole = quality.statistics(data, offs)
    weight = rng.normal(size=quality.WIDTH)
    logit = quality._mean_logit(quality.features(data, offs, whole), weight, len(texts))
    for piece in (1, 3, 7, 50):
        s = quality.statistics(data, offs, piece)
        assert all(np.array_equal(s[k], whole[k]) for k in whole)
        assert np.allclose(quality._mean_logit(quality.features(data, offs, s, piece), weight, len(texts)), logit)
    alone = [quality.statistics(*utf8_bytes(pa.array([t], pa.string()))) for t in texts]
    assert all(whole[k][i] == alone[i][k][0] for k in whole for i in range(len(texts)))


def test_scorer_equals_plain_descent():
    texts, y = ["Good words here.", "BAD!!! |||", "More good words, and some.", "%%%% $$"], np.array([0.9, 0.1, 0.8, 0.2])
    w, c = quality.train(pa.array(texts), y, epochs=5)
    x = np.zeros((4, quality.WIDTH))
    for i, t in enumerate(texts):
        data, offs = utf8_bytes(pa.array([t]))
        for _, _, b in quality.features(data, offs, quality.statistics(data, offs)):
            for k in b:
                x[i, k] += 1 / len(b)
    want, bias, g2 = np.zeros(quality.WIDTH), 0.0, np.full(quality.WIDTH, 1e-6)
    cost = np.where(y < 0.5, 2 / (1 - y).sum(), 2 / y.sum())
    for epoch in range(5):
        err = cost * (1 / (1 + np.exp(-(x @ want + bias))) - y) / 4
        g = x.T @ err + 1e-5 * want
        g2 += g * g
        want -= 4.0 / np.sqrt(1 + epoch / 10) * g / np.sqrt(g2) / 8
        bias -= err.sum()
    assert np.allclose(w, want, atol=1e-5) and abs(c - bias) < 1e-6


def test_clashing_columns_repeated_rows_and_long_texts(spark):
    rows = [(1, PROSE, 5, "x"), (1, PROSE, 5, "x"), (2, PROSE * 20_000, 6, "y"), (3, "", 7, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, pattern int, small string")
    model = quality.fit(docs)
    got = [(r["doc_id"], r["pattern"], r["k"]) for r in docs.select("doc_id", "pattern", quality.rate(docs, model)["keep"].alias("k")).collect()]
    assert sorted(got) == [(1, 5, True), (1, 5, True), (2, 6, True), (3, 7, False)]
