import corpus_pipeline
from quillframe.llm import mixing


def test_stages_take_effect(spark, tmp_path):
    d = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{d}/documents.parquet")
    columns = docs.columns
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_classifier", "language_id", "minhash_near_dedup", "mixing", "packing"]
    kept = {}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = f"{tmp_path}/{k}"
        stage(spark, docs, d).write.parquet(out)
        docs = spark.read.parquet(out)
        if k < 4:
            assert docs.columns == columns
            kept[name] = {r["doc_id"] for r in docs.select("doc_id").collect()}
    assert kept["mixing"] <= kept["minhash_near_dedup"] < kept["language_id"] <= kept["quality_classifier"]
    pieces = docs.collect()
    assert {r["doc_id"] for r in pieces} == kept["mixing"]


def test_near_duplicates_keep_one_of_each_group(spark):
    t = " ".join(f"w{k}" for k in range(60))
    rows = [(1, t), (2, t), (3, t + " more"), (4, "quite another text of some words"), (5, None), (None, "a text without an id in it"), (None, "a text without an id in it"), (None, t + " more")]
    docs = spark.createDataFrame([(i, x, "en", "src1", 0, i) for i, x in rows], "doc_id long, text string, lang string, source string, n_chars long, component_id long")
    got = corpus_pipeline.drop_near_duplicates(spark, docs, "")
    assert {r["doc_id"] for r in got.collect()} == {1, 4, 5, None} and got.columns == docs.columns


def test_stages_take_empty_tables_and_nulls(spark):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    for rows in ([], [(None, None, None, None, None), (1, "", None, None, 0), (2, "Some plain words are here, and more of them follow.", None, "src1", 5)]):
        docs = spark.createDataFrame(rows, schema)
        for _, stage in corpus_pipeline.STAGES:
            stage(spark, docs, "").collect()


def test_mixing_repeats_documents(spark):
    docs = spark.createDataFrame([(i, "a b c d", "en", "src0", 7) for i in range(10)], "doc_id long, text string, lang string, source string, n_chars long")
    got = corpus_pipeline.mix_sources(spark, docs, "").count()
    assert got == 10 * mixing.SHARE // 100


def test_stages_leave_columns_of_any_name(spark):
    t = "Some plain words are here, and more of them follow. The river runs by the old mill. "
    schema = "doc_id long, text string, lang string, source string, n_chars long, _rated int, _told int, _Ident int, _place int, _times int, _taken_id int, n int, rep int, component_id string"
    rows = [(i, f"{t} number {i} of many", "en", "src1", 1, 1, 2, 3, 4, 5, 6, 7, 8, "x") for i in range(6)]
    docs = spark.createDataFrame(rows + rows[:1], schema)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, "")
        assert out.columns == docs.columns and all(tuple(r)[5:] == (1, 2, 3, 4, 5, 6, 7, 8, "x") for r in out.collect()), name


def test_near_duplicates_equal_brute_force(spark):
    from test_minhash import family, plain

    import random

    rng = random.Random(8)
    texts = [x for _ in range(5) for x in family(rng, 12)] + ["one two", None, ""]
    docs = spark.createDataFrame([(i, x, "en", "s", 0) for i, x in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    got = {r["doc_id"] for r in corpus_pipeline.drop_near_duplicates(spark, docs, "").collect()}
    assert got == {d for d, _, _, kept in plain(list(enumerate(texts)), 80) if kept}
