import pytest
from pyspark.sql import functions as F

from quillframe.operators import evaluate as E

DOCS = [(1, "return value one\nreturn value two\nshort\n", "x"), (2, "return value one\nreturn value one\n", "x"), (3, "return value two\n  other line here\n", "y"), (4, None, "y"), (5, "", None), (6, "return value one\nother line here\n", "z")]


def plain_rates(held):
    norm = lambda s: " ".join(s.split())
    lines = [(d, i, norm(x), g) for d, t, g in DOCS if t is not None for i, x in enumerate(t.split("\n")) if 4 <= len(norm(x)) <= 400]
    index = {}
    for d, _, x, _ in lines:
        if d not in held:
            index[x] = index.get(x, 0) + 1
    got = {}
    for d, i, x, g in lines:
        if d in held and len(x) >= 8:
            p = norm(x[: 4 + (i * 7 + len(x)) % (len(x) - 6)])
            rest = sorted(((-c, y[len(p) :]) for y, c in index.items() if y.startswith(p) and len(y) - len(p) >= 2))[:4]
            ok = [r.startswith(x[len(p) :]) for _, r in rest]
            got.setdefault(g, []).append((any(ok[:1]), any(ok)))
    return {g: (len(v), sum(a for a, _ in v) / len(v), sum(b for _, b in v) / len(v)) for g, v in got.items()}


@pytest.mark.parametrize("held", [{1}, {3, 6}, {4, 5}, set()])
def test_held_out_rates_equal_brute_force(spark, held):
    docs = spark.createDataFrame(DOCS, "doc_id long, text string, lang string")
    is_held = F.col("doc_id").isin(*held) if held else F.lit(False)
    got = {r["lang"]: (r["n"], r["hit1"], r["hitk"]) for r in E.held_out_rates(docs, is_held, "lang").collect()}
    near = lambda d: {g: tuple(round(x, 9) for x in v) for g, v in d.items()}
    assert near(got) == near(plain_rates(held))


def test_tuning_only_improves(spark):
    rows = [(q, t, s, v, "good") for q in range(4) for t, s, v in [("good one", "a", 1.0), ("bad", "b", 2.0)]] + [(9, "good", "b", 1.0, "good")]
    c = spark.createDataFrame(rows, "query_id long, text string, source string, score double, truth string")
    assert E.hits_at_one(c, [{}, {"a": 3.0}, {"b": 0.1}]) == [0.2, 1.0, 1.0]
    weights, rate = E.tune(c, {"a": [0.5, 3.0], "b": [0.5, 2.0]})
    assert (weights, rate) == ({"a": 3.0, "b": 1.0}, 1.0)
    assert E.tune(c.limit(0), {"a": [2.0]}) == ({"a": 1.0}, 0.0)


def test_lines_are_ranked_before_they_meet_queries(spark, tmp_path):
    """Documents with one start make as many rows as there are documents and ranks, not documents times lines."""
    from quillframe.plans.more import eval_hit_rates

    rows = [(i, f"start of line {i:03d}", "en", "s", 1) for i in range(300)] + [(300 + i, f"start of line {i:03d}\nzz other", "en", "s", 1) for i in range(3)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    df = eval_hit_rates(spark, str(tmp_path))
    assert [tuple(r) for r in df.collect()] == [("en", 303, round(2 / 303, 9), round(7 / 303, 9))]
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Join Inner") < plan.index("row_number")  # the ranking lies below the join
