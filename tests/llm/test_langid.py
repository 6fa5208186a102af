import math
from collections import Counter, defaultdict

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quillframe.llm import langid
from quillframe.llm.buffers import utf8_bytes

SCHEMA = "doc_id long, text string, lang string, score double"


def plain_lengths(texts, train, order):
    """Escape method C with exclusion, symbol by symbol."""
    out = []
    counts = {}
    for lang, ts in train.items():
        c = defaultdict(Counter)
        for t in ts:
            b = [256] * order + list(t.encode())
            for i in range(order, len(b)):
                for k in range(order + 1):
                    c[tuple(b[i - k : i])][b[i]] += 1
        counts[lang] = c
    for t in texts:
        row = []
        b = [256] * order + list(t.encode())
        for lang in sorted(train):
            nats = 0.0
            for i in range(order, len(b)):
                out_of, p = set(), 1.0
                for k in range(order, -1, -1):
                    seen = {s: n for s, n in counts[lang][tuple(b[i - k : i])].items() if s not in out_of}
                    total = sum(seen.values())
                    if not total:
                        continue
                    if b[i] in seen:
                        p *= seen[b[i]] / (total + len(seen))
                        break
                    p *= len(seen) / (total + len(seen))
                    out_of |= set(seen)
                else:
                    p *= 1 / (256 - len(out_of))
                nats -= math.log(p)
            row.append(nats)
        out.append(row)
    return np.array(out)


def test_code_lengths_equal_a_walk_through_the_trees():
    train = {"x": ["the cat sat", "the dog"], "y": ["le chat été", "la"]}
    rows = []
    for lang, ts in train.items():
        b = pa.RecordBatch.from_pydict({"label": [lang] * len(ts), "text": ts})
        for r in langid.count_grams(iter([b]), 3, "label", "text"):
            rows.append(r.to_pandas())
    model = langid.freeze(pd.concat(rows), 3)
    texts = ["the chat", "", "zzz", "éé the"]
    got = model.code_lengths(*utf8_bytes(pa.array(texts)))
    assert np.allclose(got, plain_lengths(texts, train, 3), rtol=1e-5)


def test_long_rows_are_scored_whole(monkeypatch):
    rows = list(langid.count_grams(iter([pa.RecordBatch.from_pydict({"label": ["x"], "text": ["abc abd " * 5]})]), 3, "label", "text"))
    model = langid.freeze(rows[0].to_pandas(), 3)
    data = utf8_bytes(pa.array(["abc abd xyz " * 60, "ab"]))
    whole = model.code_lengths(*data)
    monkeypatch.setattr(langid, "SLICE_BYTES", 16)
    assert np.allclose(model.code_lengths(*data), whole, rtol=1e-6)


def test_predict_handles_edge_cases(spark):
    rows = [(1, "the cat and the dog and", "en", 0.0), (2, "der hund und die katze und", "de", 0.0), (3, None, "en", 0.0), (4, "", None, 0.0), (5, "123 !!", "de", 0.0), (None, "and the", None, 0.0), (1, "the cat and the dog and", "en", 0.0)]
    docs = spark.createDataFrame(rows, SCHEMA)
    model = langid.fit(docs)
    got = docs.select("doc_id", langid.predict(docs, model).alias("p")).select("doc_id", "p.*").collect()
    pred = [(r["doc_id"], r["lang_pred"]) for r in got]
    assert sorted(pred, key=str) == sorted([(1, "en"), (2, "de"), (3, "und"), (4, "und"), (5, "und"), (None, "en"), (1, "en")], key=str)
    assert all(0 <= r["score"] <= 1 for r in got)


def test_no_rows_and_no_labels(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert langid.fit(empty).labels == []
    docs = spark.createDataFrame([(1, "text", None, 0.0)], SCHEMA)
    p = docs.select(langid.predict(docs, langid.fit(docs)).alias("p")).head()["p"]
    assert (p["lang_pred"], p["score"]) == ("und", 0.0)
    assert empty.select(langid.predict(empty, langid.fit(docs)).alias("p")).count() == 0


def test_rare_language_is_kept_whole_beside_a_hot_one(spark):
    letters = np.array(list("abcdefghijklmnopqrstuvwxyz0123"))
    hot = "".join(letters[np.random.default_rng(1).integers(0, len(letters), 300_000)])
    rare = "ÅÄÖ ÆØ ÞÐ"
    assert len({hot[i : i + 4] for i in range(len(hot) - 3)}) > 200_000  # each twice in the two rows below
    docs = spark.createDataFrame([(1, hot, "hot", 0.0), (2, hot, "hot", 0.0), (3, rare, "rare", 0.0)], SCHEMA)
    model = langid.fit(docs)
    assert model.labels == ["hot", "rare"]
    assert np.allclose(model.code_lengths(*utf8_bytes(pa.array([rare])))[:, 1], plain_lengths([rare], {"rare": [rare]}, 3)[:, 0], rtol=1e-5)
    assert docs.where("doc_id = 3").select(langid.predict(docs, model).alias("p")).head()["p"]["lang_pred"] == "rare"


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = langid.query(spark, "/root/testdata/sf0.01").join(docs.select("doc_id", "lang"), "doc_id").where("held_out")
    assert got.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).head()[0] > 0.98


def test_a_table_in_parts_gives_the_same(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text", "lang")
    one, many = langid.fit(docs), langid.fit(docs, part_bytes=1_000_000)
    assert one.parts == 1 and many.parts > 3
    texts = [r["text"] for r in docs.limit(20).collect()] + ["", None, "\U0001f600 \u4e00\u4e8c zzqqxx"]
    data = utf8_bytes(pa.array(texts))
    assert np.allclose(one.code_lengths(*data), many.code_lengths(*data), rtol=1e-6)
    a = docs.select("doc_id", langid.predict(docs, one).alias("p")).collect()
    b = docs.select("doc_id", langid.predict(docs, many).alias("p")).collect()
    assert sorted((r["doc_id"], r["p"]["lang_pred"]) for r in a) == sorted((r["doc_id"], r["p"]["lang_pred"]) for r in b)
    rows = list(langid.count_grams(iter(docs.where("lang IS NOT NULL AND text IS NOT NULL").select(F.col("lang").alias("label"), "text").toArrow().to_batches()), 3, "label", "text"))
    plain = langid.freeze(pa.Table.from_batches(rows).to_pandas(), 3)
    assert np.allclose(one.code_lengths(*data), plain.code_lengths(*data), rtol=1e-6)


def test_ties_go_to_the_label_that_sorts_first(spark):
    docs = spark.createDataFrame([(1, "abc abc", "b", 0.0), (2, "abc abc", "a", 0.0), (3, "abc", None, 0.0)], SCHEMA)
    got = docs.select(langid.predict(docs, langid.fit(docs)).alias("p")).collect()
    assert {r["p"]["lang_pred"] for r in got} == {"a"} and all(abs(r["p"]["score"] - 0.5) < 1e-9 for r in got)
