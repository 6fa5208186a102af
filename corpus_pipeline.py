"""A corpus pipeline: quality, language, near-duplicates, mixture, packing.

Each stage takes (spark, docs, sf_dir), ``docs`` being what its predecessor kept
with the columns of ``documents``, and returns a DataFrame; all but the last
return those columns. Further columns of ``docs`` are passed on.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillframe.llm import langid, minhash, mixing, packing, quality
from quillframe.shared import materialize

#: No SQL: the first, second and last stages have no counterpart in it.
ORACLE_SQL = None

LEAST_SCORE = 0.5
SIMILARITY = 80
COLLECTIONS = 24


def _new(docs: DataFrame, name: str) -> str:
    """A column name like ``name`` that ``docs`` does not have."""
    taken = {c.lower() for c in docs.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier keeps; those without words go."""
    rated = _new(docs, "_rated")
    return docs.withColumn(rated, quality.rate(docs, quality.fit(docs))).where(F.col(rated)["keep"]).drop(rated)


def keep_known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a language: those that are ``und``, or less than even for the best language, go.

    All rows with text and lang are learnt from. Without any, nothing can be told and all stay.
    """
    model = langid.fit(docs)
    if not model.labels:
        return docs
    told = _new(docs, "_told")
    known = docs.withColumn(told, langid.predict(docs, model))
    return known.where((F.col(told)["lang_pred"] != "und") & (F.col(told)["score"] >= LEAST_SCORE)).drop(told)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that links of similarity 0.8 or more connect: that with the smallest doc_id.

    Rows that share a doc_id are one document and stay together. A row without id
    is a document by its text, of which one row stays; texts without a word are
    like nothing, and stay.
    """
    ident, place = _new(docs, "_ident"), _new(docs, "_place")
    own = F.coalesce("doc_id", F.lit(1 << 62) + F.shiftrightunsigned(F.xxhash64("text"), 2))  # after all ids that count from 0
    found = minhash.near_duplicates(docs.select(own.alias("doc_id"), "text"), percent=SIMILARITY, groups=COLLECTIONS)
    kept = materialize(found.where("kept").select(F.col("doc_id").alias(ident)).distinct(), "kept")
    rows = docs.withColumn(ident, own).join(kept.hint("merge"), ident, "left_semi").drop(ident)
    if docs.where("doc_id IS NULL").isEmpty():
        return rows
    some = F.coalesce(F.col("text").rlike(r"[^\x20\x09-\x0D]"), F.lit(False))
    unnamed = rows.where(F.col("doc_id").isNull() & some)
    unnamed = unnamed.withColumn(place, F.row_number().over(Window.partitionBy(F.xxhash64("text")).orderBy(F.length("text")))).where(F.col(place) == 1).drop(place)
    return rows.where(F.col("doc_id").isNotNull() | ~some).unionByName(unnamed)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents by the target weights: each as often as passes over its leaf take it.

    The pass that ends a leaf's budget takes its last document whole.
    """
    leaves = materialize(mixing.document_leaves(docs), "leaves_of_documents")
    taken = mixing.mix(leaves, ["domain", "lang", "source"], mixing.weights())
    times, ident = _new(docs, "_times"), _new(docs, "_taken_id")
    n = taken.groupBy(F.col("doc_id").alias(ident)).agg(F.max(F.col("epochs_taken") + (F.col("prefix_tokens") > 0).cast("long")).alias(times))
    n = materialize(n, "taken")
    again = docs.join(n.hint("merge"), F.col("doc_id").eqNullSafe(F.col(ident)))
    return again.withColumn(times, F.explode(F.sequence(F.lit(1), F.col(times).cast("int")))).drop(times, ident)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of at most 2048 tokens."""
    return packing.pack(docs)


STAGES = [
    ("quality_classifier", keep_good),
    ("language_id", keep_known_language),
    ("minhash_near_dedup", drop_near_duplicates),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
