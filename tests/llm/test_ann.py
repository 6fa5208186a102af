import numpy as np
from pyspark.sql import functions as F

from quillframe.llm import ann

SCHEMA = "vec_id long, embedding array<float>, score string"


def plain(rows, queries, k):
    good = [(i, np.array(v, float)) for i, v in dict.fromkeys((i, tuple(v)) for i, v in rows)]
    out = {}
    for i, q in good:
        if queries(i):
            c = sorted((-float(q @ v / np.linalg.norm(q) / np.linalg.norm(v)), j) for j, v in good if j != i)
            out[i] = [(j, -s) for s, j in c[:k]]
    return out


def test_perturbations_are_ordered_and_valid():
    sets = ann.perturbations(4, 30)
    assert len(sets) == len(set(sets)) == 30 and sets[0] == (1,)
    assert all(not any(9 - r in s for r in s) for s in sets)


def test_recall_and_exact_scores(spark):
    rng = np.random.default_rng(0)
    rows = [(i, v.astype("f4").tolist()) for i, v in enumerate(rng.normal(size=(1500, 16)) + np.repeat(rng.normal(size=(5, 16)) * 2, 300, 0))]
    df = spark.createDataFrame([(*r, "x") for r in rows], SCHEMA)
    got = {}
    for r in ann.search(df, F.col("vec_id") % 50 == 0, crowded=100).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    want = plain([(i, np.float32(v)) for i, v in rows], lambda i: i % 50 == 0, 5)
    assert set(got) == set(want) and all([r for r, _, _ in v] == [1, 2, 3, 4, 5] for v in got.values())
    vec = {i: np.array(np.float32(v), float) for i, v in rows}
    for q, v in got.items():
        for _, j, s in v:
            assert abs(s - vec[q] @ vec[j] / np.linalg.norm(vec[q]) / np.linalg.norm(vec[j])) < 1e-12
    hits = sum(len({j for _, j, _ in got[q]} & {j for j, _ in want[q]}) for q in want)
    assert hits / (5 * len(want)) >= 0.9


def test_unusable_equal_and_few_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [1.0, 0.0]), (3, [0.0, 1.0]), (4, None), (5, [0.0, 0.0]), (6, [1.0, None]), (7, [nan, 1.0]), (8, [inf, 1.0]), (9, [1.0, 2.0, 3.0]), (None, [1.0, 1.0]), (3, [0.0, 1.0])]
    df = spark.createDataFrame([(*r, None) for r in rows], SCHEMA)
    got = [tuple(r)[:3] for r in ann.search(df, F.col("vec_id").isin(0, 3, 5, 7)).orderBy("query_id", "rank").collect()]
    assert got == [(0, 1, 1), (0, 2, 2), (0, 3, 3), (3, 1, 0), (3, 2, 1), (3, 3, 2)]
    assert ann.search(df.limit(0), F.lit(True)).count() == 0
    assert ann.search(df.where("vec_id = 0"), F.lit(True)).count() == 0


def test_many_equal_vectors_give_the_smallest_ids(spark):
    df = spark.createDataFrame([(i, [1.0, 2.0, 3.0], None) for i in range(200)], SCHEMA)
    got = ann.search(df, F.col("vec_id") % 50 == 0).collect()
    assert {(r["query_id"], r["vec_id"]) for r in got if r["query_id"] == 150} == {(150, j) for j in range(5)}
    assert {r["vec_id"] for r in got if r["query_id"] == 0} == {1, 2, 3, 4, 5}


def test_recall_on_the_registered_table(spark):
    vectors = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").select("vec_id", "embedding")
    rows = [(r["vec_id"], r["embedding"]) for r in vectors.collect()]
    want = plain(rows, lambda i: i % 50 == 0, 5)
    got = {}
    for r in ann.query(spark, "/root/testdata/sf0.1").collect():
        got.setdefault(r["query_id"], set()).add(r["vec_id"])
    assert sum(len(got[q] & {j for j, _ in want[q]}) for q in want) / (5 * len(want)) >= 0.9


def test_queries_that_find_too_few_meet_all_vectors_and_lengths_stay_apart(spark):
    rng = np.random.default_rng(4)
    rows = [(i, rng.normal(size=8 + i % 2).astype("f4").tolist()) for i in range(240)]
    df = spark.createDataFrame([(*r, None) for r in rows], SCHEMA)
    narrow = ann.Setting(tables=1, hashes=12, step=0.1, probes=2)
    got = {}
    for r in ann.search(df, F.col("vec_id") % 5 == 0, setting=narrow, sweep=7).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append(r["vec_id"])
    want = {}
    for odd in (0, 1):
        want |= plain([r for r in rows if r[0] % 2 == odd], lambda i: i % 5 == 0, 5)
    assert got == {q: [j for j, _ in v] for q, v in want.items()}


def test_a_fit_visits_less_where_neighbours_are_closer(spark):
    shares = []
    for noise in (0.1, 1.0):
        rng = np.random.default_rng(5)
        rows = [(i, v.tolist()) for i, v in enumerate(rng.normal(size=(60, 16))[rng.integers(0, 60, 1500)] + noise * rng.normal(size=(1500, 16)))]
        index = ann.prepare(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id") % 10 == 0)
        made = ann.fit(index)
        assert made.recall >= ann.WANTED
        shares.append(made.visited)
    assert shares[0] < shares[1] / 2
