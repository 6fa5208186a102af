import numpy as np
import pyarrow as pa

from quillframe.llm import toxicity
from quillframe.llm.buffers import utf8_bytes


def test_ngrams_are_those_of_a_plain_scan():
    texts = ["Ab cde.", "", None, "xyz xyz"]
    size, starts, rows, grams = toxicity.ngrams(*utf8_bytes(pa.array(texts)))
    x = b" ab cde    xyz xyz "
    assert size == len(x) and rows.tolist() == [0, 0, 3, 3]
    want = {n: [i for i in range(len(x) - n + 1) if b" " not in x[i + 1 : i + n - 1] and not (x[i] == 32 and x[i + 1] == 32)] for n in toxicity.SIZES}
    for (at, b), n in zip(grams, toxicity.SIZES):
        assert at.tolist() == want[n]
        same = {}
        for i, k in zip(at.tolist(), b.tolist()):
            if k != 1 << toxicity.BITS:
                assert same.setdefault(x[i : i + n], k) == k


def test_passages_cover_all_words():
    row, a, z = toxicity.passages(np.array([0] * 3 + [2] * 40), 4)
    assert set(row) == {0, 2} and (z > a).all()
    assert set(np.concatenate([np.arange(i, j) for i, j in zip(a, z)])) == set(range(43))


def sample(n=300):
    rng = np.random.default_rng(0)
    words = ["".join(rng.choice(list("aeiourstlnm"), rng.integers(2, 8))) for _ in range(400)]
    texts = [" ".join(rng.choice(words, 80)) for _ in range(n)]
    y = np.arange(n) % 3 == 0
    bad = ["grobianisch", "grobianlich", "grobianerei"]
    texts = [t + " " + bad[k % 3] + " " + " ".join(rng.choice(words, 20)) if y[k] else t for k, t in enumerate(texts)]
    return texts, y.astype(int), words


def test_unseen_misspellings_score_and_long_texts_stay_clean():
    texts, y, words = sample()
    model = toxicity.train(texts, y)
    rng = np.random.default_rng(9)
    some = ["grobianheit", "an Grobiann", " ".join(rng.choice(words, 120)), "", "grobian " * 50]
    s = model.scores(*utf8_bytes(pa.array(some)))
    assert s[0] >= 0.5 and s[1] >= 0.5 and s[2] < 0.5 and s[3] < 0.5 and ((s >= 0) & (s <= 1)).all()


def test_one_class_and_no_rows():
    data = utf8_bytes(pa.array(["x", None]))
    assert (toxicity.train([], np.array([])).scores(*data) < 0.5).all()
    assert (toxicity.train(["a"], np.array([0])).scores(*data) < 0.5).all()
    assert (toxicity.train(["a"], np.array([1])).scores(*data) > 0.5).all()


def test_query_on_held_out_rows(spark):
    from pyspark.sql import functions as F

    df = toxicity.query(spark, "/root/testdata/sf0.1")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet").select("doc_id", "toxic")
    p = df.join(labels, "doc_id").where("held_out").toPandas()
    assert p[p.toxic == 1].predicted.mean() > 0.8 and p[p.toxic == 0].predicted.mean() < 0.03


def test_edge_rows(spark):
    docs = spark.createDataFrame([(1, "a b", 1.0), (2, None, 1.0), (None, "grobian", 1.0), (1, "a b", 1.0)], "doc_id long, text string, score double")
    labels = spark.createDataFrame([(1, 0), (1, 1), (None, 1), (2, None)], "doc_id long, toxic int")
    model = toxicity.fit(docs, labels)
    got = docs.select("doc_id", toxicity.score(docs, model).alias("s")).collect()
    assert len(got) == 4 and all(0 <= r["s"] <= 1 for r in got)
    assert docs.limit(0).select(toxicity.score(docs, model)).count() == 0


def test_long_rows_score_as_in_one_piece(monkeypatch):
    rng = np.random.default_rng(3)
    model = toxicity.ToxicityModel(np.append(rng.normal(size=1 << toxicity.BITS), 0.0), 0.1, 0.0, 1.0)
    words = ["".join(rng.choice(list("abcde"), rng.integers(1, 4))) for _ in range(30)]
    texts = [" ".join(rng.choice(words, n)) + "  . " for n in (1, 5, 11, 12, 13, 17, 18, 19, 25, 36, 37, 100, 301)]
    data = utf8_bytes(pa.array(texts))
    whole = model.logits(*data)
    monkeypatch.setattr(toxicity, "LONG_BYTES", 0)
    monkeypatch.setattr(toxicity, "SLICE_BYTES", 1)
    for step in (6, 12, 18, 60):
        assert np.allclose(model.logits(*data, piece_words=step), whole)


def test_equal_texts_score_alike_and_long_ones_do_not_starve_the_sample(spark):
    texts, y, _ = sample(60)
    rows = [(k, t) for k, t in enumerate(texts)] + [(1000 + k, "x " * 20_000) for k in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(k, int(v)) for k, v in enumerate(y)] + [(1000 + k, 0) for k in range(60)], "doc_id long, toxic int")
    model = toxicity.fit(docs, labels, per_class=25)
    seen = toxicity.train([t for k, t in enumerate(texts)], y)
    assert np.isfinite(model.value).all() and model.value.any() and seen.value.any()
    twice = docs.where("doc_id < 5").union(docs.where("doc_id < 5"))
    got = twice.select("doc_id", toxicity.score(docs, model).alias("s")).distinct().count()
    assert got == 5
