"""Queries on plausibility, facts, decoding and parts of names."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from quillframe.functions import cursor as U
from quillframe.operators import complete as O
from quillframe.operators import decode as D
from quillframe.operators import evaluate as E
from quillframe.operators import facts as A
from quillframe.operators import lines as L
from quillframe.operators import tables as T
from quillframe.plans.more import _foreign_sql
from quillframe.plans.queries import EXPLODED, INDEX, LINES, NORM, ORDER, PARTS, TOP, WORDS, X, _last, answers, lexed, model, query, table, texts
from quillframe.shared import materialize

_SCALARS = ", ".join(f"'{s}'" for s in U.SCALARS)
_AFTER = ", ".join(f"'{s}'" for s in U.OPERAND_AFTER)
_W, _S = U.WORD, U.START
_CLOSED = U.CLOSED.replace("'", "''")


@query(rf"""
WITH {INDEX}, c AS (SELECT substr(line, 1, k) AS prefix, substr(line, k + 1) AS first FROM idx, (SELECT unnest([5, 9, 14]) AS k) WHERE length(line) > k),
b AS (SELECT *, unnest(['go', 'python', 'text']) AS l, regexp_replace(first, '^[ \t\n]+', '') AS body, regexp_extract(prefix, '([^ \t])[ \t]*$', 1) AS last, regexp_extract(prefix, '{_W}*$') AS part FROM c),
x AS (SELECT *, substr(body, 1, 1) AS sign, regexp_extract(body, '^{_W}*') AS word, regexp_matches(body, '^{_S}') AS named, instr(first, '// ') AS i1, instr(first, '# ') AS i2 FROM b),
y AS (SELECT *, part <> '' AND regexp_matches(first, '^{_S}{_W}* {_W}') AND NOT regexp_matches(regexp_replace(prefix, '{_CLOSED}', '', 'g'), '["''`]') AND part || regexp_extract(first, '^{_W}*') NOT IN ({WORDS}) AS two,
  last = '.' AND (NOT named OR word IN ({WORDS}) OR regexp_matches(first, '[;{{}}]')) AS nomember, last = '{{' AND sign = '{{' AS braces,
  regexp_matches(body, '^[A-Z]{_W}*[ \t]+[a-z]') OR (i1 > 1 AND regexp_matches(substr(first, i1 + 2), '^[ \t]*[A-Z]{_W}* [a-z]')) OR (i2 > 1 AND regexp_matches(substr(first, i2 + 1), '^[ \t]*[A-Z]{_W}* [a-z]')) AS prose,
  last IN ({_AFTER}) AND (contains(first, '`') OR sign = '.' OR (named AND (regexp_matches(body, '^{_W}+[ \t]*:=') OR (word IN ({_SCALARS}) AND NOT regexp_matches(body, '^{_W}+[ \t\n]*\('))))) AS operand FROM x)
SELECT prefix, first AS cand, l AS lang, body <> '' AND NOT two AND NOT coalesce({_foreign_sql()}, false) AND CASE WHEN last = '.' AND sign = '(' THEN regexp_matches(body, '^\([ \t]*{_S}') ELSE NOT (nomember OR braces OR prose OR operand) END AS ok FROM y
""")
def plausible_lines(spark, sf_dir):
    """Which ends of lines can follow their starts, for three languages."""
    idx = L.line_index(texts(spark, sf_dir)).withColumn("k", F.explode(F.array(F.lit(5), F.lit(9), F.lit(14)))).where("length(line) > k")
    c = idx.select(F.expr("substring(line, 1, k)").alias("prefix"), F.expr("substring(line, k + 1)").alias("cand"))
    c = c.withColumn("can", U.possible(F.col("cand"), F.col("prefix")))  # below the generator: once for all three languages
    c = c.select("prefix", "cand", "can", F.explode(F.array(*[F.lit(x) for x in ("go", "python", "text")])).alias("lang"))
    return c.select("prefix", "cand", "lang", (F.col("can") & ~X.foreign_line(F.col("cand"), F.col("lang"))).alias("ok"))


@query(rf"""
WITH {EXPLODED}, pa AS (SELECT doc_id, pos, CASE WHEN regexp_matches(tok, '^{_S}') AND strlen(tok) >= 3 THEN {PARTS('tok')} ELSE [tok] END AS ps FROM tk),
s AS (SELECT doc_id, pos, generate_subscripts(ps, 1) AS i, unnest(ps) AS p FROM pa), t AS (SELECT doc_id, pos, i, CASE WHEN i > 1 THEN chr(1) || p ELSE p END AS tok FROM s),
w AS (SELECT tok, lag(tok) OVER d AS p1, lag(tok, 2) OVER d AS p2 FROM t WINDOW d AS (PARTITION BY doc_id ORDER BY pos, i)),
r AS (SELECT 1 AS n, '' AS ctx, tok, count(*) AS cnt FROM w GROUP BY tok UNION ALL SELECT 2, p1, tok, count(*) FROM w WHERE p1 IS NOT NULL GROUP BY ALL UNION ALL SELECT 3, p2 || chr(2) || p1, tok, count(*) FROM w WHERE p2 IS NOT NULL GROUP BY ALL)
SELECT n::INT AS n, ctx, tok, cnt FROM r WHERE n < 3 OR cnt >= 2
""")
def subtoken_ngrams(spark, sf_dir):
    """N-grams of orders 1 to 3 over parts of names."""
    return D.part_counts(lexed(spark, sf_dir)).select("n", F.array_join("ctx", "\x02").alias("ctx"), "tok", "cnt")


@query()
def subtoken_candidates(spark, sf_dir):
    """Names that each name with several parts, less its last character, may become."""
    lx = materialize(lexed(spark, sf_dir), "lexed")
    names = materialize(T.name_index(T.token_counts(lx)), "names")
    q = names.where(F.contains("path_key", F.lit("|")) & (F.length("ident") > 3)).select(F.col("ident").alias("query_id"), F.expr("CAST(array() AS array<string>)").alias("ctx"), F.expr("substring(ident, 1, length(ident) - 1)").alias("fragment"))
    return D.part_candidates(q, materialize(D.part_counts(lx), "parts"), names).withColumn("weight", F.round("weight", 9))


@query()
def greedy_decode(spark, sf_dir):
    """Continuations, of at most 96 tokens and four lines, of what stands before each document's last token."""
    lx, stored, disc, rows = model(spark, sf_dir)
    v = stored.where("n = 1").count()
    return D.greedy(_last(lx).select("query_id", "ctx"), answers(stored, disc, rows), v, ORDER).withColumn("p", F.round("p", 8))


def _code(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select(F.concat(F.lit("d"), "doc_id").alias("doc_id"), "text")
    return d.unionByName(table(spark, sf_dir, "pages").select(F.concat(F.lit("p"), "page_id").alias("doc_id"), F.col("html").alias("text")))


@query()
def code_facts(spark, sf_dir):
    """Facts about types, members and variables in all documents and pages."""
    return A.extract(_code(spark, sf_dir))


@query()
def call_members(spark, sf_dir):
    """What documents and pages use of functions' results."""
    return A.call_members(materialize(A.extract(_code(spark, sf_dir)), "facts"))


def _shop_facts(spark, sf_dir):
    """Facts from orders: suppliers are types, part groups members, customers variables of an order."""
    li, o = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "orders")
    text = lambda c: c.cast("string")
    fact = lambda df, kind, k1, v: df.select(text(F.col("doc")).alias("doc"), F.lit(kind).alias("kind"), k1.alias("k1"), F.lit("").alias("k2"), v.alias("v"))
    li, o = li.withColumn("doc", F.col("l_orderkey")), o.withColumn("doc", F.col("o_orderkey"))
    member = F.concat(F.lit("m"), text(F.col("l_partkey") % 12), F.when(F.col("l_partkey") % 2 == 0, "(").otherwise(""))
    out = fact(li, "member", text(F.col("l_suppkey")), member).unionByName(fact(o, "var", F.lit("x"), text(F.col("o_custkey") % 60)))
    out = out.unionByName(fact(li, "use", F.lit("x"), F.concat(F.lit("u"), text(F.col("l_linenumber")))))
    return out.unionByName(fact(o.where("o_custkey % 7 = 0"), "embeds", text(F.col("o_custkey") % 60), text(F.col("o_custkey") % 11)))


_MEMBER = "'m' || (l_partkey % 12) || CASE WHEN l_partkey % 2 = 0 THEN '(' ELSE '' END"


@query(f"""
WITH s AS (SELECT l_orderkey AS doc, l_suppkey::VARCHAR AS type, {_MEMBER} AS member FROM lineitem UNION SELECT o_orderkey, (o_custkey % 60)::VARCHAR, 'u' || l_linenumber FROM orders JOIN lineitem ON l_orderkey = o_orderkey),
c AS (SELECT type, member, count(*) AS cnt FROM s GROUP BY ALL) SELECT type, member, cnt, rnk::INT AS rnk FROM (SELECT *, {TOP('type', 'cnt DESC, member')} AS rnk FROM c) WHERE rnk <= 48
""")
def type_members(spark, sf_dir):
    """Members of each supplier as a type, by the number of orders that state or use them."""
    return A.type_members(materialize(_shop_facts(spark, sf_dir), "facts"))


@query(f"""
WITH q AS (SELECT DISTINCT o_orderkey AS query_id, (o_custkey % 60)::VARCHAR AS type FROM orders), e AS (SELECT DISTINCT (o_custkey % 60)::VARCHAR AS type, (o_custkey % 11)::VARCHAR AS base FROM orders WHERE o_custkey % 7 = 0),
w AS (SELECT query_id, type, type AS owner FROM q UNION ALL SELECT query_id, type, base FROM q JOIN e USING (type)), m AS (SELECT DISTINCT l_orderkey AS doc, l_suppkey::VARCHAR AS owner, {_MEMBER} AS member FROM lineitem),
h AS (SELECT query_id, type, member, max(CASE WHEN query_id = doc THEN 1 ELSE 0 END) AS own FROM w JOIN m USING (owner) GROUP BY ALL)
SELECT query_id::VARCHAR AS query_id, type, member, rnk::INT AS rnk FROM (SELECT *, {TOP('query_id', "own DESC, ends_with(member, '(') DESC, member")} AS rnk FROM h) WHERE rnk <= 48
""")
def member_resolution(spark, sf_dir):
    """Members of each order's customer variable, over embedded types, those of the order first."""
    q = table(spark, sf_dir, "orders").select(F.col("o_orderkey").cast("string").alias("query_id")).distinct()
    return A.members_for(q.select("query_id", F.col("query_id").alias("doc"), F.array(F.lit("x")).alias("chain")), materialize(_shop_facts(spark, sf_dir), "facts"))


@query()
def synthesized(spark, sf_dir):
    """Expressions for every variable's type in documents and pages."""
    facts = materialize(A.extract(_code(spark, sf_dir)), "facts")
    goals = A.of_kind(facts, "var", k1="var", v="type", k2="shape").groupBy("doc", "type").agg(F.max("shape").alias("shape"))
    return A.synthesize(goals.withColumn("query_id", F.concat_ws("/", "doc", "type")), facts)


@query()
def cursor_parts(spark, sf_dir):
    """What stands at the end of each page: open block, literals, imports."""
    h = F.col("html")
    return table(spark, sf_dir, "pages").select("page_id", F.array_join(U.enclosing_block(h), "\n").alias("block"), F.array_join(U.literals_before(h), "\n").alias("literals"), F.array_join(U.import_paths(h), "\n").alias("imports"), U.trailing_name(h).alias("part"))


@query(f"""
WITH {LINES}, ix AS (SELECT line, count(*) AS cnt FROM kl WHERE doc_id % 5 <> 0 GROUP BY line),
c AS (SELECT *, {NORM("substr(line, 1, (4 + (pos * 7 + length(line)) % (length(line) - 6))::INT)")} AS prefix FROM kl WHERE doc_id % 5 = 0 AND length(line) >= 8),
p AS (SELECT DISTINCT prefix FROM c WHERE strlen(prefix) >= 2), h AS (SELECT prefix, substr(line, length(prefix) + 1) AS rest, cnt FROM p JOIN ix ON starts_with(line, prefix) WHERE strlen(substr(line, length(prefix) + 1)) >= 2),
r AS (SELECT * FROM (SELECT *, {TOP('prefix', 'cnt DESC, rest')} AS rnk FROM h) WHERE rnk <= 4),
q AS (SELECT lang, doc_id, pos, max(CASE WHEN rnk = 1 AND starts_with(rest, substr(line, length(c.prefix) + 1)) THEN 1 ELSE 0 END) AS h1, max(CASE WHEN starts_with(rest, substr(line, length(c.prefix) + 1)) THEN 1 ELSE 0 END) AS hk FROM c LEFT JOIN r USING (prefix) GROUP BY ALL)
SELECT lang, count(*) AS n, round(avg(h1), 9) AS hit1, round(avg(hk), 9) AS hitk FROM q GROUP BY lang
""")
def eval_held_out(spark, sf_dir):
    """How often lines of every fifth document are completed from the others."""
    rates = E.held_out_rates(texts(spark, sf_dir), F.col("doc_id") % 5 == 0, "lang")
    return rates.withColumns({"hit1": F.round("hit1", 9), "hitk": F.round("hitk", 9)})


@query()
def tuned_weights(spark, sf_dir):
    """Weights of two sources, the same document and all others, tuned on every fifth document."""
    d = texts(spark, sf_dir)
    held = F.col("doc_id") % 5 == 0
    cut = E.cuts(d.where(held)).withColumn("query_id", F.concat_ws("/", "doc_id", "pos"))
    every = E.answers(cut, L.line_index(d.where(~held))).where("text IS NOT NULL")
    own = L.kept_lines(d.where(held)).select("doc_id", F.col("pos").alias("p"), "line", F.substring("line", 1, 4).alias("g"))
    near = cut.withColumn("g", F.substring("prefix", 1, 4)).join(own, ["doc_id", "g"]).where("p != pos AND startswith(line, prefix)")
    near = near.select("query_id", F.expr("substring(line, length(prefix) + 1)").alias("text"), F.lit("file").alias("source"), F.lit(1.0).alias("score"), "truth").distinct()
    cands = materialize(every.select("query_id", "text", F.lit("corpus").alias("source"), (1.0 / F.col("rnk")).alias("score"), "truth").unionByName(near), "candidates")
    weights, _ = E.tune(cands, {"file": [0.25, 0.6, 1.5, 4.0], "corpus": [0.25, 0.6, 1.5, 4.0]})
    return spark.createDataFrame(sorted(weights.items()), "source string, weight double")


@query()
def complete_lines(spark, sf_dir):
    """The four best continuations of the first eight characters of each document's last line, over all sources but a model's and edits."""
    d = materialize(texts(spark, sf_dir), "texts")
    index, bigrams, trigrams = materialize(L.line_index(d), "index"), materialize(L.line_grams(d, 1), "bigrams"), materialize(L.line_grams(d, 2), "trigrams")
    w = Window.partitionBy("doc_id").orderBy("pos")
    at = L.kept_lines(d, "doc_id", "text", "lang").withColumns({"prev1": F.lag("line").over(w), "prev2": F.lag("line", 2).over(w), "r": F.row_number().over(Window.partitionBy("doc_id").orderBy(F.desc("pos")))}).where("r = 1")
    name = F.concat(F.lit("d"), F.col("doc_id").cast("string"))
    before = F.array_join(F.slice(F.split("text", "\n"), 1, F.col("pos")), "\n")
    q = at.join(d.select("doc_id", "text"), "doc_id").select(F.col("doc_id").alias("query_id"), name.alias("doc"), "lang", F.substring("line", 1, 8).alias("prefix"), "prev1", "prev2", before.alias("before"), "pos", (F.col("pos") == 0).alias("thin"))
    docs = d.select(name.alias("doc"), "text")
    facts = materialize(A.extract(docs.withColumnRenamed("doc", "doc_id")), "facts")
    names = materialize(T.scope(X.with_tokens(docs), key="doc").withColumn("from_folder", F.lit(False)), "scope")
    return O.complete(q, index, bigrams, facts, True, trigrams=trigrams, docs=docs, starts=T.file_starts(d), scope=names).withColumn("score", F.round("score", 6))
