"""Aggregated tables over tokens, languages, folders and structure."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillframe.functions import text as X
from quillframe.operators.lines import begun, top
from quillframe.shared import materialize


def token_counts(tokens: DataFrame) -> DataFrame:
    """(tok, cnt) of a table with ``toks``, without end marks."""
    return tokens.select(F.explode("toks").alias("tok")).where(F.col("tok") != X.END).groupBy("tok").agg(F.count("*").alias("cnt"))


def language_unigrams(tokens: DataFrame, lang: str = "lang", least_tokens: int = 2048, cap: int = 64) -> DataFrame:
    """(lang, tok, cnt, rnk): the most frequent tokens of languages with enough of them."""
    c = materialize(tokens.select(lang, F.explode("toks").alias("tok")).where(F.col("tok") != X.END).groupBy(lang, "tok").agg(F.count("*").alias("cnt")), "tokens")  # read twice
    big = c.groupBy(lang).agg(F.sum("cnt").alias("n")).where(F.col("n") >= least_tokens).select(lang)
    return top(c.join(big, lang, "left_semi"), [lang], [F.desc("cnt"), F.col("tok")], cap)


def language_bigrams(tokens: DataFrame, lang: str = "lang", least: int = 2, least_tokens: int = 2048, cap: int = 32) -> DataFrame:
    """(lang, prev, tok, cnt, rnk): the most frequent followers of each token within a language."""
    # One pass: the first token of a document has no predecessor, so the rows of a language add up to its size.
    last = F.get("toks", F.size("toks") - 1) == X.END
    t = tokens.select(lang, F.when(last, F.slice("toks", 1, F.size("toks") - 1)).otherwise(F.col("toks")).alias("tok")).where(F.size("tok") > 0)
    prev = F.concat(F.array(F.lit(None).cast("string")), F.slice("tok", 1, F.size("tok") - 1))
    rows = t.select(lang, F.inline(F.arrays_zip("tok", prev.alias("prev"))))
    # Written, as both the sizes and the ranks read it, and Spark would count twice for them.
    c = materialize(rows.groupBy(lang, "prev", "tok").agg(F.count("*").alias("cnt")), "followers")
    big = c.groupBy(lang).agg(F.sum("cnt").alias("n")).where(F.col("n") >= least_tokens).select(lang)
    return top(c.where(F.col("prev").isNotNull() & (F.col("cnt") >= least)).join(big, lang, "left_semi"), [lang, "prev"], [F.desc("cnt"), F.col("tok")], cap)


def language_blend(bigrams: DataFrame, unigrams: DataFrame, contexts: DataFrame, lang: str = "lang") -> DataFrame:
    """(query_id, tok, p) for contexts (query_id, lang, prev): three quarters bigram and one quarter unigram share, or unigram alone."""
    bt = bigrams.withColumn("share", F.col("cnt") / F.sum("cnt").over(Window.partitionBy(lang, "prev"))).select(lang, "prev", "tok", F.col("share").alias("b"))
    ut = unigrams.withColumn("share", F.col("cnt") / F.sum("cnt").over(Window.partitionBy(lang))).select(lang, "tok", F.col("share").alias("u"))
    b = contexts.join(bt, [lang, "prev"]).select("query_id", "tok", "b")
    u = contexts.join(ut, lang).select("query_id", "tok", "u")
    both = u.join(b, ["query_id", "tok"], "full_outer").withColumn("known", F.max(F.col("b").isNotNull()).over(Window.partitionBy("query_id")))
    p = F.when(F.col("known"), 0.75 * F.coalesce("b", F.lit(0.0)) + 0.25 * F.coalesce("u", F.lit(0.0))).otherwise(F.col("u"))
    return both.select("query_id", "tok", p.alias("p"))


def structure_keys(tokens: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, pos, tok, skey): brace depth, being in brackets, and the last keyword class before each token.

    Line ends are skipped. Running sums and the last keyword are windows over
    the document, read before the token itself counts.
    """
    rows = tokens.select(key, F.posexplode("toks").alias("pos", "tok")).where(~F.col("tok").isin("\n", X.END))
    w = Window.partitionBy(key).orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    step = lambda up, down: F.coalesce(F.sum(F.when(F.col("tok").isin(up), 1).when(F.col("tok").isin(down), -1).otherwise(0)).over(w), F.lit(0))
    depth, par = step(["{"], ["}"]), step(["(", "["], [")", "]"])
    kw = F.coalesce(F.last(X.keyword_class(F.col("tok")), ignorenulls=True).over(w), F.lit(0))
    skey = F.least(depth, F.lit(15)) * 16 + F.when(par > 0, 8).otherwise(0) + kw
    return rows.select(key, "pos", "tok", skey.cast("int").alias("skey"))


def structure_table(tokens: DataFrame, key: str = "doc_id", least: int = 2, cap: int = 24) -> DataFrame:
    """(skey, tok, cnt, rnk): the most frequent tokens under each structural key."""
    c = structure_keys(tokens, key).groupBy("skey", "tok").agg(F.count("*").alias("cnt")).where(F.col("cnt") >= least)
    return top(c, ["skey"], [F.desc("cnt"), F.col("tok")], cap)


def file_starts(docs: DataFrame, lang: str = "lang", text: str = "text", least: int = 3, cap: int = 8) -> DataFrame:
    """(lang, line, cnt, rnk): how files of a language begin: first non-blank lines of at most 96 bytes."""
    first = F.get(X.document_lines(F.col(text), 1), F.lit(0))
    c = docs.select(lang, first.alias("line")).where(F.octet_length("line") <= 96).groupBy(lang, "line").agg(F.count("*").alias("cnt")).where(F.col("cnt") >= least)
    return top(c, [lang], [F.desc("cnt"), F.col("line")], cap)


def folder_names(docs: DataFrame, folder: str = "source", text: str = "text", least: int = 3, cap: int = 96) -> DataFrame:
    """(folder, ident, cnt, rnk): the names that a folder centres on, by runs of name characters."""
    runs = F.regexp_extract_all(text, F.lit(rf"[A-Za-z0-9_${X.HIGH}]+"), F.lit(0))
    c = docs.select(folder, F.explode(runs).alias("ident"))
    c = c.where((F.octet_length("ident") >= 3) & ~F.col("ident").rlike("^[0-9]") & ~X.is_keyword(F.col("ident"))).groupBy(folder, "ident").agg(F.count("*").alias("cnt"))
    return top(c.where(F.col("cnt") >= least), [folder], [F.desc("cnt"), F.col("ident")], cap)


def name_index(counts: DataFrame) -> DataFrame:
    """(path_key, ident, freq) of names among (tok, cnt)."""
    names = counts.where(X.is_name(F.col("tok")))
    return names.select(X.name_key(X.subtokens(F.col("tok"))).alias("path_key"), F.col("tok").alias("ident"), F.col("cnt").alias("freq"))


def name_prefix(index: DataFrame, contexts: DataFrame, k: int = 4) -> DataFrame:
    """(query_id, ident, freq, rnk): the most frequent names whose parts start with those of ``fragment``."""
    q = contexts.select("query_id", X.name_key(X.subtokens(F.col("fragment"))).alias("p")).where(F.length("p") >= 2)
    # Names rank alike for all fragments of the same parts, so they are ranked once and only the first meet queries.
    best = top(begun(index, "path_key", q), ["p"], [F.desc("freq"), F.col("ident")], k)
    return q.join(best, "p").select("query_id", "ident", "freq", "rnk")


def table_sizes(**tables: DataFrame) -> DataFrame:
    """(name, n) of each table."""
    out = None
    for name, df in sorted(tables.items()):
        one = df.agg(F.count("*").alias("n")).select(F.lit(name).alias("name"), "n")
        out = one if out is None else out.union(one)
    return out


def overlay(base: DataFrame, over: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of ``over``, and those of ``base`` whose keys it lacks."""
    return over.unionByName(base.join(over.select(*keys).distinct(), keys, "left_anti"))


def source_multiplier(events: DataFrame, source: str, kind: Column, alpha: float = 4.0) -> DataFrame:
    """(source, acc, rej, mult): a source's smoothed accept rate over the global one, within 0.6 and 1.6. ``kind`` is ``a``, ``r`` or null."""
    c = events.select(F.col(source).alias("source"), kind.alias("k")).groupBy("source").agg(F.count_if(F.col("k") == "a").alias("acc"), F.count_if(F.col("k") == "r").alias("rej"))
    g = c.agg(F.sum("acc").alias("ga"), F.sum("rej").alias("gr"))
    rate = (F.col("acc") + alpha) / (F.col("acc") + F.col("rej") + 2 * alpha)
    every = (F.col("ga") + alpha) / (F.col("ga") + F.col("gr") + 2 * alpha)
    return c.crossJoin(F.broadcast(g)).select("source", "acc", "rej", F.least(F.greatest(rate / every, F.lit(0.6)), F.lit(1.6)).alias("mult"))  # g is one row


def scope(tokens: DataFrame, key: str = "doc_id", most: int = 512, thin: int = 4) -> DataFrame:
    """(key, name, cnt, thin): the first ``most`` different names of each token array with their counts; thin documents have at most ``thin`` tokens that are no blanks."""
    few = F.size(F.filter("toks", lambda t: (F.trim(t) != "") & (t != "\n") & (t != X.END))) <= thin
    # Beside the generator it would be found anew for each of the document's tokens.
    rows = tokens.withColumn("thin", few).select(key, "thin", F.posexplode("toks").alias("pos", "name"))
    names = rows.where(F.col("name").rlike(rf"^[A-Za-z_${X.HIGH}]") & ~X.is_keyword(F.col("name")) & (F.col("name") != X.END))
    c = names.groupBy(key, "name", "thin").agg(F.count("*").alias("cnt"), F.min("pos").alias("at"))
    return top(c, [key], [F.col("at")], most).select(key, "name", "cnt", "thin")
