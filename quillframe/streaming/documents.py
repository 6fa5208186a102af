"""Document updates: the newest version of each wins, and the line index follows."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillframe.operators.lines import line_index
from quillframe.shared import ship
from quillframe.sources.corpus import latest_versions


def read_updates(spark: SparkSession, folder: str, schema: str, files_per_batch: int = 16) -> DataFrame:
    """A stream of update rows from Parquet files that appear in ``folder``."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(folder)


BUCKETS = 64


def _numbers(spark: SparkSession, folder: str) -> list[int]:
    """The numbers under which whole tables lie in ``folder``; a table without Spark's mark of success does not count."""
    jvm, conf = spark._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    root = jvm.org.apache.hadoop.fs.Path(folder)
    store = root.getFileSystem(conf)
    if not store.exists(root):
        return []
    names = [s.getPath().getName() for s in store.listStatus(root)]
    return sorted(int(n) for n in names if n.isdigit() and store.exists(jvm.org.apache.hadoop.fs.Path(f"{folder}/{n}/_SUCCESS")))


def maintain_index(updates: DataFrame, folder: str, checkpoint: str, key: str = "uri", version: str = "version", text: str = "text"):
    """Keep a line index of the newest text of each key up to date by deltas; returns the query.

    A batch writes the versions that it brings (``state/<number>``, by buckets of
    keys) and what they change of the counts (``delta/<number>``: line, cnt, less
    than nothing for lines that go); it reads only the buckets of its own keys,
    and a batch that runs again writes the same tables. Older versions that come
    late, and equal ones, lose. A null text deletes its document. Read the index
    with ``current_index``.
    """
    spark = updates.sparkSession
    schema = f"{key} {dict(updates.dtypes)[key]}, {version} {dict(updates.dtypes)[version]}, {text} string, bucket int"

    def fold(batch: DataFrame, number: int) -> None:
        bucket = F.pmod(F.xxhash64(key), F.lit(BUCKETS)).cast("int")
        new = latest_versions(batch.select(key, version, text), key, version).withColumn("bucket", bucket)
        paths = [f"{folder}/state/{n}" for n in _numbers(spark, f"{folder}/state") if n < number]
        old = spark.createDataFrame([], schema)
        if paths:
            mine = [r["bucket"] for r in new.select("bucket").distinct().collect()]  # 64 at most
            for p in paths:
                old = old.unionByName(spark.read.schema(schema).parquet(p).where(F.col("bucket").isin(mine)))
        old = latest_versions(old.drop("bucket"), key, version)
        before = old.select(F.col(key).alias("_k"), F.col(version).alias("_v"))
        fresh = new.join(before, F.col(key) == F.col("_k"), "left").where(F.col("_v").isNull() | (F.col(version) > F.col("_v"))).drop("_k", "_v")
        fresh.write.mode("overwrite").partitionBy("bucket").parquet(f"{folder}/state/{number}")
        fresh = spark.read.schema(schema).parquet(f"{folder}/state/{number}")
        gone = old.join(fresh.select(key), key, "left_semi")
        change = line_index(fresh, text).unionByName(line_index(gone, text).withColumn("cnt", -F.col("cnt")))
        change.groupBy("line").agg(F.sum("cnt").alias("cnt")).where("cnt != 0").write.mode("overwrite").parquet(f"{folder}/delta/{number}")

    return updates.writeStream.foreachBatch(fold).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def current_index(spark: SparkSession, folder: str) -> DataFrame:
    """(line, cnt) after all whole deltas: the newest compacted index, and the sum of what came later."""
    base = _numbers(spark, f"{folder}/base")[-1:]
    later = [n for n in _numbers(spark, f"{folder}/delta") if not base or n > base[0]]
    rows = spark.createDataFrame([], "line string, cnt long")
    for path in [f"{folder}/base/{n}" for n in base] + [f"{folder}/delta/{n}" for n in later]:
        rows = rows.unionByName(spark.read.schema("line string, cnt long").parquet(path))
    return rows.groupBy("line").agg(F.sum("cnt").alias("cnt")).where("cnt > 0")


def compact_index(spark: SparkSession, folder: str) -> None:
    """Write the present index as a table of its own, from which later reads start; deltas stay until someone removes them."""
    done = _numbers(spark, f"{folder}/delta")
    if done:
        current_index(spark, folder).write.mode("overwrite").parquet(f"{folder}/base/{done[-1]}")


def on_new_tables(spark: SparkSession, folder: str, checkpoint: str, install):
    """Call ``install(tables)`` when a newer set of tables lies in ``folder``; returns the query. A set is whole once its mark is there."""
    from quillframe.sources.corpus import load_tables

    marks = spark.readStream.schema("version long, name string").parquet(f"{folder}/_whole")

    def reload(batch: DataFrame, number: int) -> None:
        if not batch.isEmpty():
            install(load_tables(spark, folder))

    return marks.writeStream.foreachBatch(reload).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def session_counts(updates: DataFrame, key: str, ts: str, gap: str = "45 minutes", late: str = "2 minutes") -> DataFrame:
    """(key, start, end, n): sessions of updates, closed when the watermark has passed them."""
    w = F.session_window(ts, gap)
    return updates.withWatermark(ts, late).groupBy(key, w.alias("w")).agg(F.count("*").alias("n")).select(key, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def token_budget(updates: DataFrame, key: str, tokens: str, cap: int) -> DataFrame:
    """(key, used, resets): tokens in each key's cache, which starts anew when it would go beyond ``cap``.

    Custom state by key: (used, resets).
    """
    ship(updates.sparkSession)

    def step(k: tuple, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        used, resets = state.get if state.exists else (0, 0)
        for pdf in frames:
            for n in pdf[tokens]:
                if used + int(n) > cap and used:
                    used, resets = 0, resets + 1
                used += int(n)
        state.update((used, resets))
        yield pd.DataFrame([(k[0], used, resets)], columns=["key", "used", "resets"])

    return updates.groupBy(key).applyInPandasWithState(step, "key string, used long, resets long", "used long, resets long", "update", "NoTimeout")
