"""Line index, next-line grams, masked shapes, and the joins that retrieve from them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillframe.functions import text as X
from quillframe.shared import materialize

SHORTEST, LONGEST = 4, 400


def top(df: DataFrame, by: list[str], order: list[Column], k: int, name: str = "rnk") -> DataFrame:
    """The first ``k`` rows of each key, ranked from 1."""
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col(name) <= k)


def kept_lines(docs: DataFrame, key: str = "doc_id", text: str = "text", *keep: str) -> DataFrame:
    """(key, pos, line): normalised lines of 4 to 400 bytes, by place among all lines."""
    lines = F.transform(F.split(text, "\n"), X.normalize)
    rows = docs.select(key, *keep, F.posexplode_outer(lines).alias("pos", "line"))  # of an inner one Spark infers a filter, which makes all lines anew
    return rows.where(F.octet_length("line").between(SHORTEST, LONGEST))


def line_index(docs: DataFrame, text: str = "text") -> DataFrame:
    """(line, cnt) over all kept lines."""
    return docs.select(F.explode_outer(X.document_lines(F.col(text), SHORTEST)).alias("line")).where(F.octet_length("line") <= LONGEST).groupBy("line").agg(F.count("*").alias("cnt"))


def line_grams(docs: DataFrame, arity: int, key: str = "doc_id", text: str = "text", least: int = 2, cap: int = 32) -> DataFrame:
    """(prev2?, prev1, next_line, cnt, rnk): what follows one or two kept lines."""
    w = Window.partitionBy(key).orderBy("pos")
    names = ["prev2", "prev1"][-arity:]
    rows = kept_lines(docs, key, text).select(*[F.lag("line", arity - k).over(w).alias(n) for k, n in enumerate(names)], F.col("line").alias("next_line"))
    pairs = rows.where(F.col(names[0]).isNotNull()).groupBy(*names, "next_line").agg(F.count("*").alias("cnt")).where(F.col("cnt") >= least)
    return top(pairs, names, [F.desc("cnt"), F.col("next_line")], cap)


def next_lines(contexts: DataFrame, bigrams: DataFrame, trigrams: DataFrame, k: int = 4) -> DataFrame:
    """(query_id, next_line, cnt, arity, rnk): rows of the longest known context of (query_id, prev2, prev1)."""
    two = contexts.join(trigrams.drop("rnk"), ["prev2", "prev1"]).select("query_id", "next_line", "cnt", F.lit(2).alias("arity"))
    one = contexts.join(bigrams.drop("rnk"), "prev1").select("query_id", "next_line", "cnt", F.lit(1).alias("arity"))
    both = two.unionByName(one).withColumn("longest", F.max("arity").over(Window.partitionBy("query_id")))
    return top(both.where("arity = longest").drop("longest"), ["query_id"], [F.desc("cnt"), F.col("next_line")], k)


def masked_index(index: DataFrame) -> DataFrame:
    """(shape, line, cnt): the lines of each masked shape."""
    return index.select(X.masked_line(F.col("line")).alias("shape"), "line", "cnt")


def prefix_complete(contexts: DataFrame, index: DataFrame, k: int = 8, least_rest: int = 2) -> DataFrame:
    """(query_id, rest, cnt, rnk): the most frequent continuations of each prefix (query_id, prefix).

    The prefix is normalised and has to have 2 bytes or more. Lines and prefixes
    meet on the first 1, 2, 4, 8.. characters, the most that the prefix has, with
    the whole prefix as a further condition; a line is sent once for each of
    these widths that some prefix has.
    """
    q = contexts.select("query_id", X.normalize(F.col("prefix")).alias("p")).where(F.octet_length("p") >= 2)
    width = F.lit(1)
    for w in (2, 4, 8, 16, 32, 64, 128, 256):
        width = F.when(F.length("p") >= w, w).otherwise(width)
    q = q.withColumn("w", width).withColumn("bucket", F.expr("substring(p, 1, w)"))
    widths = F.broadcast(q.select("w").distinct())  # nine rows at most
    idx = index.select("line", "cnt").join(widths, F.length("line") >= F.col("w")).withColumn("bucket", F.expr("substring(line, 1, w)"))
    hit = q.join(idx, ["w", "bucket"]).where(F.startswith("line", F.col("p")))
    hit = hit.select("query_id", F.expr("substring(line, length(p) + 1)").alias("rest"), "cnt").where(F.octet_length("rest") >= least_rest)
    return top(hit, ["query_id"], [F.desc("cnt"), F.col("rest")], k)


def begun(index: DataFrame, of: str, prefixes: DataFrame) -> DataFrame:
    """The rows of ``index``, once for each of the different prefixes (p) that its column ``of`` begins with, with p: an equi-join at the lengths that prefixes have."""
    asked = prefixes.select("p").distinct()
    lengths = F.broadcast(asked.select(F.length("p").alias("_w")).distinct())  # at most as many rows as the longest prefix has characters
    return index.join(lengths, F.length(of) >= F.col("_w")).withColumn("p", F.expr(f"substring({of}, 1, _w)")).drop("_w").join(asked, "p", "left_semi")


def for_language(index: DataFrame, languages: DataFrame) -> DataFrame:
    """(lang, line, cnt): for each asked language (lang) its lines of (lang, line, cnt) and those of no or another known language.

    Asked languages are few and are sent to the lines: a shuffle by language would bring all lines of one to one task.
    """
    asked = languages.select("lang", F.explode(F.array_distinct(F.array("lang", F.lit(""), F.lit("other")))).alias("of"))
    hit = index.withColumnRenamed("lang", "of").join(F.broadcast(asked), "of")
    return hit.groupBy("lang", "line").agg(F.sum("cnt").alias("cnt"))


def infix_complete(contexts: DataFrame, lines: DataFrame, k: int = 3) -> DataFrame:
    """(query_id, rest, rnk): what follows ``needle`` (query_id, needle) inside the distinct lines (line), not at their start.

    Runs of four characters are the equi-key: of each needle the one that the
    fewest lines have. Runs are counted first, without their lines, and the
    choice is written, so that it is broadcast while it is small and lines are
    not shuffled; ``lines`` is read twice.
    """
    runs = lambda c, first: F.array_distinct(F.expr(f"transform(sequence({first}, greatest(length({c}) - 3, {first})), i -> substring({c}, i, 4))"))
    q = contexts.where((F.octet_length("needle") >= 4) & (F.length("needle") >= 4))
    asked = q.select("query_id", "needle", F.explode(runs("needle", 1)).alias("g"))
    long = lines.where(F.length("line") >= 5)
    count = long.select(F.explode(runs("line", 2)).alias("g")).groupBy("g").agg(F.count("*").alias("c"))
    # A run that no line has leaves its needle without any.
    rarest = asked.join(count, "g", "left").groupBy("query_id", "needle").agg(F.min_by("g", F.struct(F.coalesce("c", F.lit(0)), "g")).alias("g"))
    rarest = materialize(rarest, "rarest")
    hit = rarest.join(long.select("line", F.explode(runs("line", 2)).alias("g")), "g").withColumn("at", F.instr("line", F.col("needle"))).where("at > 1")
    rest = hit.select("query_id", F.trim(F.expr("substring(line, at + length(needle))")).alias("rest")).where("rest != ''").distinct()
    return top(rest, ["query_id"], [F.col("rest")], k)


def same_document_lines(docs: DataFrame, width: int = 3, k: int = 3, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, pos, rest, dist, rnk): for each kept line, the nearest other lines of its document that start with its first ``width`` characters."""
    rows = kept_lines(docs, key, text).withColumn("head", F.substring("line", 1, width)).where(F.octet_length("head") >= 3)
    a = rows.select(key, "head", F.col("pos").alias("at"), F.col("line").alias("own"))
    hit = a.join(rows, [key, "head"]).where("line != own").select(key, "at", F.expr(f"substring(line, {width + 1})").alias("rest"), F.abs(F.col("pos") - F.col("at")).alias("dist"))
    near = hit.where("rest != ''").groupBy(key, "at", "rest").agg(F.min("dist").alias("dist"))
    return top(near, [key, "at"], [F.col("dist"), F.col("rest")], k).withColumnRenamed("at", "pos")


def following_blocks(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, line, block): each distinct line of a document with its next one or two non-blank lines, first occurrence."""
    w = Window.partitionBy(key).orderBy("pos")
    rows = kept_lines(docs, key, text).select(key, "pos", "line", F.lead("line", 1).over(w).alias("n1"), F.lead("line", 2).over(w).alias("n2")).where("n1 IS NOT NULL")
    first = top(rows, [key, "line"], [F.col("pos")], 1)
    return first.select(key, "line", F.concat_ws("\n", "n1", "n2").alias("block"))
