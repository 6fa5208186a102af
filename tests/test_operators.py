from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from quillframe.functions.text import END
from quillframe.operators import commits, edits, feedback, lines, ngram, rank, symbols, tables
from quillframe.sources import corpus

SEQS = [("a", "b", "c"), ("x", "b", "c"), ("y", "a", "b"), ("z", "a", "b", "d"), ("a", "b", "e"), ("b", "f")]


def plain_kn(seqs, order):
    raw = Counter(tuple(s[i : i + n]) for s in seqs for n in range(1, order + 2) for i in range(len(s) - n + 1))
    cont = Counter(g[1:] for g in raw if len(g) > 1)
    least = lambda n: 1 if n <= 3 else 2
    st = {g: (cont[g] if len(g) < order else c) for g, c in raw.items() if len(g) <= order and c >= least(len(g)) and (len(g) == order or cont[g])}
    disc = {}
    for n in range(1, order + 1):
        k = Counter(c for g, c in st.items() if len(g) == n)
        if k[1] and k[2] and k[3]:
            y = k[1] / (k[1] + 2 * k[2])
            disc[n] = [min(1, max(0, j - (j + 1) * y * k[j + 1] / k[j])) for j in (1, 2, 3)]
        else:
            disc[n] = [0.5, 0.67, 0.8]
    v = sum(1 for g in st if len(g) == 1)

    def p(ctx, tok):
        out = 1 / v
        for n in range(1, min(order, len(ctx) + 1) + 1):
            c = tuple(ctx[len(ctx) - n + 1 :])
            row = {g[-1]: x for g, x in st.items() if len(g) == n and g[:-1] == c}
            if row:
                d = disc[n]
                gamma = sum(d[min(x, 3) - 1] for x in row.values())
                x = row.get(tok, 0)
                out = (max(x - d[min(max(x, 1), 3) - 1], 0) + gamma * out) / sum(row.values())
        return out

    return st, p


def test_kneser_ney_equals_brute_force_and_sums_to_one(spark):
    toks = spark.createDataFrame([([*s, END],) for s in SEQS], "toks array<string>")
    raw = ngram.raw_counts(toks, 4)
    stored = ngram.stored_counts(raw, 3).cache()
    st, p = plain_kn(SEQS, 3)
    assert {(*r["ctx"], r["tok"]): r["cnt"] for r in stored.collect()} == st
    disc = ngram.discounts(stored)
    vocab = sorted(g[0] for g in st if len(g) == 1)
    ctxs = [(), ("a",), ("a", "b"), ("q", "a"), ("z", "a")]
    q = spark.createDataFrame([(f"{'-'.join(c)}>{t}", list(c), t) for c in ctxs for t in vocab], "query_id string, ctx array<string>, tok string")
    got = {r["query_id"]: r["p"] for r in ngram.score(q, stored, disc, ngram.context_rows(stored, disc), len(vocab), 3).collect()}
    for c in ctxs:
        assert sum(got[f"{'-'.join(c)}>{t}"] for t in vocab) == pytest.approx(1, abs=1e-9)
        for t in vocab:
            assert got[f"{'-'.join(c)}>{t}"] == pytest.approx(p(c, t), rel=1e-9)


def test_cache_and_mixture(spark):
    counts = spark.createDataFrame([(1, [], "a", 3), (1, [], "b", 1), (2, ["a"], "b", 2)], "n int, ctx array<string>, tok string, cnt long")
    q = spark.createDataFrame([(1, ["a"]), (2, ["z"])], "query_id int, ctx array<string>")
    cache = ngram.cache_distribution(counts, q)
    assert {(r["query_id"], r["tok"]): (r["pc"], r["tot"]) for r in cache.collect()} == {(1, "b"): (1.0, 2), (2, "a"): (0.75, 4), (2, "b"): (0.25, 4)}
    static = spark.createDataFrame([(1, "b", 0.5), (1, "c", 0.5)], "query_id int, tok string, p double")
    got = {(r["query_id"], r["tok"]): r["p"] for r in ngram.mix_candidates(static, cache.where("query_id = 1")).collect()}
    b = 2 / 6
    assert got == pytest.approx({(1, "b"): b + (1 - b) * 0.5, (1, "c"): (1 - b) * 0.5})


def test_prefix_completion(spark):
    idx = spark.createDataFrame([("return nil", 5), ("return err", 5), ("return", 9), ("re", 1), ("zz top", 2)], "line string, cnt long")
    q = spark.createDataFrame([(1, "  return "), (2, "re"), (3, "r"), (4, "zz"), (5, "return n")], "query_id int, prefix string")
    got = {(r["query_id"], r["rnk"]): r["rest"] for r in lines.prefix_complete(q, idx, k=2).collect()}
    assert got == {(1, 1): " err", (1, 2): " nil", (2, 1): "turn", (2, 2): "turn err", (4, 1): " top", (5, 1): "il"}


def test_structure_keys(spark):
    toks = spark.createDataFrame([(1, ["if", " ", "(", "x", ")", "{", "\n", "return", "}", END])], "doc_id int, toks array<string>")
    got = [(r["tok"], r["skey"]) for r in tables.structure_keys(toks).orderBy("pos").collect()]
    assert got == [("if", 0), (" ", 2), ("(", 2), ("x", 10), (")", 10), ("{", 2), ("return", 18), ("}", 17)]


def test_duplicates_manifest_and_delta(spark):
    d = spark.createDataFrame([(3, "a"), (1, "a"), (2, "b"), (4, None), (5, None)], "doc_id int, text string")
    assert {r["doc_id"]: r["dup_of"] for r in corpus.mark_duplicates(d, "doc_id", "text").collect()} == {1: None, 2: None, 3: 1, 4: None, 5: None}
    old = spark.createDataFrame([("a", 1, 1), ("b", 1, 1), ("c", 1, None)], "path string, size int, mtime int")
    new = spark.createDataFrame([("a", 1, 1), ("b", 2, 1), ("d", 1, 1), ("c", 1, None)], "path string, size int, mtime int")
    assert {tuple(r) for r in corpus.manifest_changes(old, new).collect()} == {("b", "changed"), ("d", "added")}
    c = lambda *r: spark.createDataFrame(r, "line string, cnt long")
    assert {tuple(r) for r in corpus.apply_delta(c(("x", 3), ("y", 1)), c(("x", 1), ("y", 1)), c(("z", 2)), ["line"]).collect()} == {("x", 2), ("z", 2)}


def test_files_round_trip(spark, tmp_path):
    (tmp_path / "src/node_modules").mkdir(parents=True)
    (tmp_path / "src/a.go").write_text("package a\n")
    (tmp_path / "src/b.min.js").write_text("x")
    (tmp_path / "src/node_modules/c.js").write_text("x")
    (tmp_path / "src/gen.go").write_text("// DO NOT EDIT\n")
    got = [r["path"].rsplit("/", 1)[1] for r in corpus.read_files(spark, f"{tmp_path}/src").collect()]
    assert got == ["a.go"]
    corpus.save_tables({"t": spark.range(3)}, f"{tmp_path}/set")
    assert corpus.load_tables(spark, f"{tmp_path}/set")["t"].count() == 3
    (tmp_path / "j.jsonl").write_text('{"e":"a","s":"dyn","v":1.5}\nnot json\n{"e":"x"}\n')
    assert [r["s"] for r in corpus.read_journal(spark, f"{tmp_path}/j.jsonl").collect()] == ["dyn"]


def test_union_and_order(spark):
    c = lambda *r: spark.createDataFrame([(1, *x) for x in r], "query_id int, text string, source string, score double")
    u = rank.union_candidates(c(("a", "corpus", 9.0), ("b", "corpus", 8.0), ("c", "corpus", 7.0), ("d", "corpus", 6.0)), c(("a", "file", 10.0), ("e", "model", 1.0)))
    assert {(r["text"], r["source"]) for r in u.collect()} == {("a", "file"), ("b", "corpus"), ("c", "corpus"), ("d", "corpus"), ("e", "model")}
    same = rank.union_candidates(c(*[(x, "corpus", 9.0 - k) for k, x in enumerate("abcd")], ("e", "model", 3.0)))
    assert [r["text"] for r in rank.final_order(same).orderBy("rnk").collect()] == ["a", "b", "c", "e"]
    low = rank.union_candidates(c(*[(x, "corpus", 9.0 - k) for k, x in enumerate("abcd")], ("e", "model", 0.1)))
    assert [r["text"] for r in rank.final_order(low).orderBy("rnk").collect()] == ["a", "b", "c", "d"]


def test_matched_accepts_consume_what_was_shown(spark):
    ts = lambda s: f"2024-01-01 00:00:{s:02d}"
    shown = spark.createDataFrame([(1, 10, ts(0)), (1, 11, ts(5)), (2, 12, ts(0))], "u int, shown_id int, ts string").withColumn("ts", F.to_timestamp("ts"))
    learn = spark.createDataFrame([(1, 20, ts(6)), (1, 21, ts(7)), (2, 22, "2024-01-01 00:05:00")], "u int, event_id int, ts string").withColumn("ts", F.to_timestamp("ts"))
    assert [tuple(r) for r in feedback.matched_accepts(shown, learn, ["u"]).collect()] == [(1, 11, 20, 1)]


def test_trainers(spark):
    rows = [("good", 1.0, 0, 1, k) for k in range(200)] + [("bad", 1.0, 0, 0, k) for k in range(200)] + [("few", 1.0, 0, 0, k) for k in range(5)]
    df = spark.createDataFrame(rows, "source string, score double, rank int, accepted int, ts int")
    w = {r["source"]: r["weight"] for r in feedback.source_weights(df).collect()}
    assert w["good"] == 1.0 and w["bad"] < 0.5 and w["few"] == 1.0
    assert feedback.source_weights(df.limit(10)).count() == 0
    j = spark.createDataFrame([([1.0, 0.0], 1, 1), ([0.0, 1.0], 0, 2)] * 30, "f array<double>, accepted int, ts int")
    got = {r["i"]: r["weight"] for r in feedback.online_ranker(j, 2).collect()}
    assert got[0] > 0 > got[1]
    assert feedback.tuned_floor([False] * 256) == pytest.approx(0.024) and feedback.tuned_floor([True] * 256) == pytest.approx(0.02 / 1.2)


def test_edits(spark):
    assert edits.line_rule("a = foo(b)", "a = bar(b)") == ("foo", "bar") and edits.line_rule("x", "x") is None
    v = spark.createDataFrame([(1, 0, "x\nfoo(1)\ny\nfoo(2)"), (1, 1, "x\nbar(1)\ny\nfoo(2)")], "uri int, version int, text string")
    rules = edits.edit_rules(edits.version_pairs(v, "uri", "version", "text"), "uri", "version")
    assert [tuple(r) for r in rules.collect()] == [(1, 1, "foo", "bar")]
    ls = spark.createDataFrame([(1, 1, "bar(1)"), (1, 3, "foo(2)")], "uri int, pos int, line string")
    assert [r["pos"] for r in edits.next_edits(rules, ls, "version").collect()] == [3]


def test_symbols(spark):
    text = "package a\nfunc (r *T) Get(x int) {\n}\nfunc Free() {}\ntype T struct {}\nclass Foo:\n  def m(self):\nreturn func\nconst X = 1\n"
    assert [(k, n, line) for k, n, line, _ in symbols.definitions(text)] == [("method", "Get", 2), ("func", "Free", 4), ("type", "T", 5), ("type", "Foo", 6), ("func", "m", 7), ("var", "X", 9)]
    df = symbols.extract(spark.createDataFrame([("a.go", text), ("b", None)], "p string, text string"), F.col("p"))
    assert [r["name"] for r in symbols.lookup_prefix(df, spark.createDataFrame([(1, "F")], "query_id int, prefix string")).orderBy("rnk").collect()] == ["Foo", "Free"]
    i = spark.createDataFrame([("R", "Read("), ("R", "Close("), ("F", "field")], "iface string, member string")
    m = spark.createDataFrame([("A", "Read("), ("A", "Close("), ("B", "Read(")], "type string, member string")
    assert [tuple(r) for r in symbols.satisfies(i, m).collect()] == [("R", "A")]


def test_commit_drafts(spark):
    rows = [(1, ["docs/a.md"], "+x"), (2, ["internal/engine/a.go", "internal/engine/b.go"], "-x"), (3, ["a_test.go"], ""), (4, ["cmd/x/main.go"], "new file mode 100644\n+++ b/cmd/x/main.go\n+a"), (5, ["a.go", "b/c.go"], "+a\n-b"), (6, [], None)]
    df = spark.createDataFrame(rows, "id int, files array<string>, diff string")
    got = df.select("id", commits.commit_type(F.col("files"), F.col("diff")).alias("t"), commits.commit_scope(F.col("files")).alias("s")).collect()
    assert {r["id"]: (r["t"], r["s"]) for r in got} == {1: ("docs", "docs"), 2: ("refactor", "engine"), 3: ("test", ""), 4: ("feat", "x"), 5: ("fix", ""), 6: ("chore", "")}
    gen = spark.createDataFrame([(2, 0, "drop old path\nmore"), (2, 1, "fix: x"), (2, 2, "drop old path")], "id int, seq int, text string")
    out = [r["message"] for r in commits.drafts(df.where("id = 2"), gen).orderBy("rank").collect()]
    assert out == ["refactor(engine): drop old path", "fix: x", "refactor(engine): update 2 files"]


def test_infix_lines_are_joined_by_the_rarest_run_alone(spark):
    """Only runs, without their lines, are counted; no exchange carries a line for each of its runs."""
    index = spark.createDataFrame([(f"the same start {i} and end",) for i in range(50)] + [("the rare needle here",)], "line string")
    q = spark.createDataFrame([(1, "rare needle"), (2, "same start 7"), (3, "absent text")], "query_id long, needle string")
    df = lines.infix_complete(q, index)
    assert {tuple(r) for r in df.collect()} == {(1, "here", 1), (2, "and end", 1)}
    assert "LeftSemi" not in df._jdf.queryExecution().optimizedPlan().toString()


def test_shares_of_a_context_are_taken_once_for_all_its_queries(spark):
    counts = spark.createDataFrame([("s", 1, [], "a", 3), ("s", 1, [], "b", 1), ("s", 2, ["a"], "b", 9), ("s", 2, ["a"], "c", 1), ("t", 1, [], "a", 1)], "k string, n int, ctx array<string>, tok string, cnt long")
    q = spark.createDataFrame([(i, "s", ["a"]) for i in range(5)] + [(8, "s", ["z"]), (9, "t", ["a"]), (10, "u", ["a"])], "query_id long, k string, ctx array<string>")
    got = {tuple(r) for r in ngram.cache_distribution(counts, q, 2, ("k",), over=0.1).collect()}
    assert got == {(i, "b", 0.9, 10) for i in range(5)} | {(8, "a", 0.75, 4), (8, "b", 0.25, 4), (9, "a", 1.0, 1)}


def test_scope_judges_a_document_once(spark):
    toks = spark.createDataFrame([(1, ["a", " ", "bb", "a", "<eof>"]), (2, ["x", "<eof>"])], "doc_id long, toks array<string>")
    df = tables.scope(toks)
    assert {tuple(r) for r in df.collect()} == {(1, "a", 2, True), (1, "bb", 1, True), (2, "x", 1, True)}
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Generate posexplode") < plan.index("size(filter(")  # found below the generator, not for each token


def test_satisfies_compares_classes_of_equal_members_alone(spark):
    need = [(f"i{k}", m) for k in range(6) for m in ("a(", "b(")] + [("one", "c("), ("x", "a("), ("x", "b("), ("x", "z("), ("field", "a"), (None, "a("), ("i0", None)]
    have = [(f"t{k}", m) for k in range(7) for m in ("a(", "b(", "c(")] + [("i1", "a("), ("i1", "b("), ("t9", "c("), ("t9", "c("), (None, "a("), ("u", None)]
    df = symbols.satisfies(spark.createDataFrame(need, "iface string, member string"), spark.createDataFrame(have, "type string, member string"))
    types = {f"t{k}" for k in range(7)}
    want = {(f"i{k}", t) for k in range(6) for t in types | {"i1"} if t != f"i{k}"} | {("one", t) for t in types | {"t9"}}
    rows = [tuple(r) for r in df.collect()]
    assert set(rows) == want and len(rows) == len(want)
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert plan.startswith("Project") and plan.index("Join") < plan.index("Aggregate") and plan.count("Join") >= 6  # the last joins expand classes, above every grouping
