"""Reading document collections, marking exact duplicates, and comparing manifests."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillframe.functions import text as X
from quillframe.shared import materialize


def read_files(spark: SparkSession, root: str, glob: str = "*") -> DataFrame:
    """(path, size, mtime, data) of the readable source files below ``root``.

    Names and sizes are tested before contents are.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(root)
    files = files.where(~X.skippable_name(F.col("path")) & ~X.skippable_dir(F.regexp_replace("path", f"^.*?{root.rstrip('/')}/", "")))
    data = files.select("path", F.col("length").alias("size"), F.unix_seconds("modificationTime").alias("mtime"), F.col("content").cast("string").alias("data"))
    return data.where(X.acceptable_text(F.col("data")))


def list_files(spark: SparkSession, root: str) -> DataFrame:
    """(path, size, mtime) without reading contents."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    return files.select("path", F.col("length").alias("size"), F.unix_seconds("modificationTime").alias("mtime")).where(~X.skippable_name(F.col("path")))


def mark_duplicates(docs: DataFrame, key: str, text: str) -> DataFrame:
    """Adds ``dup_of``: the smallest key of an equal text, null for that one and for null texts.

    Texts are compared by their SHA-256, and only digests are grouped, so a text
    that very many rows share is aggregated before it is shuffled.
    """
    dig = docs.withColumn("_digest", F.sha2(F.col(text).cast("binary"), 256))
    first = dig.where(F.col("_digest").isNotNull()).groupBy("_digest").agg(F.min(key).alias("_first"))
    out = dig.join(first, "_digest", "left").drop("_digest")
    return out.withColumn("dup_of", F.when(F.col("_first") != F.col(key), F.col("_first"))).drop("_first")


def distinct_texts(docs: DataFrame, key: str, text: str, *keep: str) -> DataFrame:
    """One row, that with the smallest key, for each distinct text; null texts are left out.

    Keys and digests alone are grouped. Those of the repeated rows are written as
    a table, whose size Spark knows: while it is small it is broadcast, and no
    text is shuffled.
    """
    rows = docs.select(key, text, *keep).where(F.col(text).isNotNull()).withColumn("_digest", F.sha2(F.col(text).cast("binary"), 256))
    dig = rows.select(key, "_digest")
    first = dig.groupBy("_digest").agg(F.min(key).alias("_first"), F.count("*").alias("_c")).where("_c > 1")
    again = materialize(dig.join(first, "_digest").where(F.col(key) != F.col("_first")).select(key, "_digest").distinct(), "repeated")
    return rows.join(again, [key, "_digest"], "left_anti").drop("_digest")


def manifest_changes(old: DataFrame, new: DataFrame) -> DataFrame:
    """(path, change) of manifests (path, size, mtime): added, changed or deleted; equal entries are left out."""
    o = old.select("path", F.struct("size", "mtime").alias("o"))
    n = new.select("path", F.struct("size", "mtime").alias("n"))
    kind = F.when(F.col("o").isNull(), "added").when(F.col("n").isNull(), "deleted").when(F.col("o") != F.col("n"), "changed")
    return o.join(n, "path", "full_outer").select("path", kind.alias("change")).where("change IS NOT NULL")


def apply_delta(base: DataFrame, removed: DataFrame, added: DataFrame, keys: list[str], count: str = "cnt") -> DataFrame:
    """Counts of a changed collection: base minus what deleted and old versions gave, plus what new ones give.

    Counts add up, so no rebuild is needed; keys that fall to 0 are dropped.
    """
    signed = base.select(*keys, count).unionByName(removed.select(*keys, (-F.col(count)).alias(count))).unionByName(added.select(*keys, count))
    return signed.groupBy(*keys).agg(F.sum(count).alias(count)).where(F.col(count) > 0)


def save_tables(tables: dict[str, DataFrame], folder: str, order: dict[str, list[str]] | None = None) -> int:
    """Write a set of tables as Parquet below a new folder of ``folder``, and last a mark that it is whole; the set's version.

    Sets are never overwritten, so one that is cut off leaves the last whole one
    in force. ``order`` names columns by which a table is split by ranges and
    sorted, so that readers skip row groups.
    """
    spark = next(iter(tables.values())).sparkSession
    version = max(_versions(spark, folder), default=0) + 1
    for name, df in tables.items():
        by = (order or {}).get(name)
        (df.repartitionByRange(*by).sortWithinPartitions(*by) if by else df).write.mode("overwrite").parquet(f"{folder}/{version}/{name}")
    marks = spark.createDataFrame([(version, n) for n in sorted(tables)], "version long, name string")
    marks.coalesce(1).write.mode("append").parquet(f"{folder}/_whole")
    return version


def _versions(spark: SparkSession, folder: str) -> list[int]:
    root = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/_whole")
    if not root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(root):
        return []
    return [r["version"] for r in spark.read.schema("version long, name string").parquet(f"{folder}/_whole").select("version").distinct().collect()]  # one for each saved set


def load_tables(spark: SparkSession, folder: str, version: int | None = None) -> dict[str, DataFrame]:
    """The tables of the newest whole set, or of that ``version``."""
    known = _versions(spark, folder)
    if not known or (version is not None and version not in known):
        raise FileNotFoundError(f"no whole set of tables in {folder}")
    version = max(known) if version is None else version
    marks = spark.read.schema("version long, name string").parquet(f"{folder}/_whole")
    names = [r["name"] for r in marks.where(F.col("version") == version).collect()]  # one row for each table
    return {n: spark.read.parquet(f"{folder}/{version}/{n}") for n in names}


def save_lines(df: DataFrame, folder: str) -> None:
    """Append rows, such as definitions or feedback events, as JSON lines."""
    df.write.mode("append").json(folder)


def load_symbols(spark: SparkSession, folder: str) -> DataFrame:
    """(path, kind, name, line, sig) of JSON lines; lines that are none are skipped, missing fields are null."""
    rows = spark.read.schema("path string, kind string, name string, line int, sig string, _bad string").option("columnNameOfCorruptRecord", "_bad").json(folder)
    return rows.where("_bad IS NULL AND name IS NOT NULL").drop("_bad")


JOURNAL = "e string, s string, v double, r int, l int, m boolean, f array<double>, t string, ts timestamp, _bad string"


def valid_events(rows: DataFrame) -> DataFrame:
    """Accepts and rejects of rows read with JOURNAL, whose learnt text, if any, has at most 512 bytes and no control characters."""
    rows = rows.where(F.col("_bad").isNull() & F.col("e").isin("a", "r")).drop("_bad")
    return rows.where(F.col("t").isNull() | ((F.octet_length("t") <= 512) & ~F.col("t").rlike(r"[\x00-\x08\x0B-\x1F]")))


def read_journal(spark: SparkSession, path: str, newest: int | None = None) -> DataFrame:
    """Feedback events of JSON lines; malformed lines are skipped."""
    rows = valid_events(spark.read.schema(JOURNAL).option("columnNameOfCorruptRecord", "_bad").json(path))
    return rows.orderBy(F.desc("ts")).limit(newest) if newest else rows


def latest_versions(docs: DataFrame, key: str, version: str) -> DataFrame:
    """The row with the greatest version of each key."""
    rank = F.row_number().over(Window.partitionBy(key).orderBy(F.desc(version)))
    return docs.withColumn("_r", rank).where("_r = 1").drop("_r")
