from pyspark.sql import functions as F

from quillframe.streaming import documents, feedback


def test_index_follows_updates(spark, tmp_path):
    src, out = f"{tmp_path}/in", f"{tmp_path}/out"
    schema = "uri string, version int, text string"
    spark.createDataFrame([("a", 1, "line one\nline two"), ("b", 1, "line one")], schema).coalesce(1).write.parquet(src)
    run = lambda: documents.maintain_index(documents.read_updates(spark, src, schema), out, f"{tmp_path}/ck").awaitTermination()
    run()
    spark.createDataFrame([("a", 3, "line three"), ("b", 0, "late old one")], schema).coalesce(1).write.mode("append").parquet(src)
    run()
    assert {tuple(r) for r in documents.current_index(spark, out).collect()} == {("line three", 1), ("line one", 1)}
    documents.compact_index(spark, out)
    spark.createDataFrame([("b", 2, None), ("c", 1, "line three"), ("a", 3, "no newer")], schema).coalesce(1).write.mode("append").parquet(src)
    run()
    assert {tuple(r) for r in documents.current_index(spark, out).collect()} == {("line three", 2)}


def test_rejects_rules_and_journals_stream(spark, tmp_path):
    rows = [("a", "rej", "2024-01-01 00:00:00", 1), ("a", "req", "2024-01-01 00:04:00", 2), ("a", "req", "2024-01-01 00:06:00", 3), ("b", "req", "2024-01-01 00:01:00", 4), ("z", "req", "2024-01-02 00:00:00", 5)]
    spark.createDataFrame(rows, "k string, kind string, ts string, id int").withColumn("ts", F.to_timestamp("ts")).coalesce(1).write.parquet(f"{tmp_path}/e")
    e = spark.readStream.schema("k string, kind string, ts timestamp, id int").parquet(f"{tmp_path}/e")
    hit = feedback.suppressed_requests(e.where("kind = 'req'").select("k", F.col("id").alias("request_id"), "ts"), e.where("kind = 'rej'").select("k", "ts"), ["k"])
    assert [(r["request_id"], r["factor"]) for r in memory(spark, hit, "hit", "append").collect()] == [(2, 0.4)]
    live = memory(spark, feedback.live_rules(e, ["k"]), "live", "append").where("k = 'a'").head()
    assert live["n"] == 3 and str(live["end"]) == "2024-01-01 00:51:00"
    with open(f"{tmp_path}/j.json", "w") as f:
        f.write('{"e":"a","s":"x"}\nnot json\n{"e":"q"}\n{"e":"r","t":"bad\\u0001"}\n')
    got = memory(spark, feedback.replay(spark, f"{tmp_path}/j.json*"), "replayed", "append")
    assert [r["s"] for r in got.collect()] == ["x"]


def test_table_sets_switch_whole(spark, tmp_path):
    from quillframe.sources import corpus

    folder = f"{tmp_path}/sets"
    assert corpus.save_tables({"t": spark.range(5).toDF("n")}, folder, {"t": ["n"]}) == 1 and corpus.save_tables({"t": spark.range(9).toDF("n")}, folder) == 2
    spark.range(1).write.parquet(f"{folder}/3/t")  # a set that was cut off
    assert corpus.load_tables(spark, folder)["t"].count() == 9 and corpus.load_tables(spark, folder, 1)["t"].count() == 5
    seen = []
    documents.on_new_tables(spark, folder, f"{tmp_path}/ck2", lambda t: seen.append(t["t"].count())).awaitTermination()
    assert seen and seen[-1] == 9
    corpus.save_lines(spark.createDataFrame([("p", "func", "f", 1, "s")], "path string, kind string, name string, line int, sig string"), f"{tmp_path}/sym")
    assert [r["name"] for r in corpus.load_symbols(spark, f"{tmp_path}/sym").collect()] == ["f"]


def memory(spark, df, name, mode):
    q = df.writeStream.outputMode(mode).format("memory").queryName(name).trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.table(name)


def test_feedback_streams(spark, tmp_path):
    rows = [(1, "view", "2024-01-01 00:00:00", 1), (1, "buy", "2024-01-01 00:01:00", 2), (1, "buy", "2024-01-01 00:09:00", 3)]
    spark.createDataFrame(rows, "u int, kind string, ts string, id int").withColumn("ts", F.to_timestamp("ts")).coalesce(1).write.parquet(f"{tmp_path}/e")
    e = spark.readStream.schema("u int, kind string, ts timestamp, id int").parquet(f"{tmp_path}/e")
    pairs = feedback.shown_then_learned(e.where("kind = 'view'").select("u", F.col("id").alias("shown_id"), "ts"), e.where("kind = 'buy'").select("u", F.col("id").alias("event_id"), "ts"), ["u"])
    assert [(r["shown_id"], r["event_id"]) for r in memory(spark, pairs, "pairs", "append").collect()] == [(1, 2)]
    kind = F.when(F.col("kind") == "buy", "a").otherwise("r")
    got = memory(spark, feedback.rates(e.withColumn("kind", kind)), "rates", "complete").head()
    assert (got["acc"], got["rej"]) == (2, 1)


def test_token_budget_resets(spark, tmp_path):
    spark.createDataFrame([("k", 6), ("k", 6), ("k", 3)], "key string, n int").coalesce(1).write.parquet(f"{tmp_path}/t")
    s = spark.readStream.schema("key string, n int").parquet(f"{tmp_path}/t")
    got = memory(spark, documents.token_budget(s, "key", "n", 10), "budget", "update").collect()
    assert [tuple(r) for r in got][-1] == ("k", 9, 1)
