"""Queries on retrieval with renaming, look-ups, multipliers, mixtures, edits and journals."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from quillframe.functions import cursor as U
from quillframe.functions import text as X
from quillframe.operators import adapt as P
from quillframe.operators import context as K
from quillframe.operators import edits as E
from quillframe.operators import evaluate as V
from quillframe.operators import feedback as B
from quillframe.operators import lines as L
from quillframe.operators import ngram as N
from quillframe.operators import rank as R
from quillframe.operators import symbols as S
from quillframe.operators import tables as T
from quillframe.plans.more import KIND_SQL, kind
from quillframe.plans.queries import ALL_LINES, EXPLODED, GRAM, INDEX, LEXED, LINES, NORM, RAW, TOKENS, TOP, WORDS, lexed, query, table, texts
from quillframe.shared import materialize

_IDENT = f"'^[A-Za-z_${X.HIGH}][A-Za-z_${X.HIGH}0-9-]*$'"
_IS_NAME = lambda t: f"(regexp_matches({t}, {_IDENT}) AND {t} NOT IN ({WORDS}))"
_LOOKS = lambda t: f"regexp_matches({t}, '^[A-Za-z_${X.HIGH}0-9]+$')"
_LEX = lambda x: TOKENS(f"({RAW(x)})")


def _variants_sql(source: str, keep: str) -> str:
    """CTEs that add shape variants of the column typed of ``source``: va (keep.., typed, nw, shape)."""
    return f"""k0 AS (SELECT *, list_transform(typed, lambda t: CASE WHEN {_IS_NAME('t')} THEN chr(2) ELSE t END) AS base, list_filter(range(1, len(typed) + 1), lambda i: typed[i] IN ({WORDS}))[1:4] AS kw FROM {source}),
k1 AS (SELECT *, unnest(range(0, (2 ** len(kw))::BIGINT)) AS bits FROM k0),
va AS (SELECT DISTINCT {keep}, typed, nw, array_to_string(list_transform(base, lambda t, i: CASE WHEN list_position(kw, i) IS NOT NULL AND (bits >> (list_position(kw, i) - 1)) & 1 = 1 THEN chr(2) ELSE t END), '') AS shape FROM k1)"""


def _rebind_sql(source: str, keep: str) -> str:
    """CTEs that align the columns toks and typed of ``source``: rb (keep.., rest, compl, changed)."""
    return f"""r0 AS (SELECT {keep}, typed, toks, list_zip(toks[1:len(typed)], typed) AS z FROM {source} WHERE len(toks) > len(typed)),
r1 AS (SELECT *, list_filter(z, lambda p: {_IS_NAME('p[1]')} AND p[1] <> p[2]) AS ps FROM r0 WHERE len(list_filter(z, lambda p: CASE WHEN {_IS_NAME('p[1]')} THEN {_LOOKS('p[2]')} ELSE p[1] = p[2] END)) = len(z)),
r2 AS (SELECT *, toks[len(typed) + 1:] AS aft, len(list_distinct(list_transform(ps, lambda p: p[1]))) AS changed, list_transform(ps, lambda p: p[1]) AS olds, typed[len(typed)] AS lst, toks[len(typed)] AS own FROM r1),
r3 AS (SELECT *, array_to_string(list_transform(aft, lambda t: coalesce(list_filter(ps, lambda p: p[1] = t)[-1][2], t)), '') AS tail, list_has_any(aft, olds) AS used FROM r2 WHERE changed > 0),
rb AS (SELECT {keep}, changed, CASE WHEN used THEN tail END AS rest, CASE WHEN {_LOOKS('lst')} AND {_IS_NAME('own')} AND strlen(own) > strlen(lst) AND starts_with(own, lst) THEN substr(own, length(lst) + 1) || tail END AS compl FROM r3)"""


_TYPED = lambda source, keep: f"ty AS (SELECT *, len(list_filter(typed, lambda t: t <> ' ')) AS nw FROM (SELECT {keep}, {_LEX('p')} AS typed FROM {source}))"


@query(f"""
WITH {INDEX}, q AS (SELECT DISTINCT substr(line, 1, length(line) // 2) AS query_id FROM idx), n AS (SELECT query_id, {NORM('query_id')} AS p FROM q),
{_TYPED('n', 'query_id')}, tq AS (SELECT * FROM ty WHERE nw >= 5), {_variants_sql('tq', 'query_id')},
lx AS MATERIALIZED (SELECT line, cnt, {_LEX('line')} AS toks FROM idx), lm AS (SELECT *, list_transform(toks, lambda t: CASE WHEN {_IS_NAME('t')} THEN chr(2) ELSE t END) AS masked FROM lx),
sh AS MATERIALIZED (SELECT DISTINCT len(typed) AS m, shape FROM va), cu AS (SELECT line, cnt, toks, m, array_to_string(masked[1:m], '') AS shape FROM lm JOIN (SELECT DISTINCT m FROM sh) ON len(toks) > m),
po AS MATERIALIZED (SELECT * FROM (SELECT cu.*, {TOP('m, shape', 'cnt DESC, line')} AS r FROM cu SEMI JOIN sh USING (m, shape)) WHERE r <= 256),
pr AS (SELECT query_id, typed, nw, toks, cnt FROM va JOIN po ON po.m = len(typed) AND po.shape = va.shape), {_rebind_sql('pr', 'query_id, nw, cnt')},
ou AS (SELECT query_id, cnt, nw / (nw + 4.0::DOUBLE) / (1.0::DOUBLE + 0.15::DOUBLE * changed) AS qual, unnest([rest, compl]) AS text FROM rb),
be AS (SELECT query_id, text, max(cnt) AS cnt, max(qual) AS qual FROM ou WHERE strlen(text) >= 2 AND qual >= 0.22 GROUP BY ALL)
SELECT query_id, text, cnt, round(qual, 9) AS qual, rnk::INT AS rnk FROM (SELECT *, {TOP('query_id', 'cnt DESC, round(qual, 12) DESC, text')} AS rnk FROM be) WHERE rnk <= 4
""")
def masked_adapt(spark, sf_dir):
    """Continuations of like-shaped lines for every line's first half, names renamed."""
    idx = materialize(L.line_index(texts(spark, sf_dir)), "index")
    contexts = idx.select(F.expr("substring(line, 1, length(line) div 2)").alias("query_id")).distinct().withColumn("prefix", F.col("query_id"))
    return P.adapt(contexts, idx).withColumn("qual", F.round("qual", 9))


_LAST = "la AS (SELECT * FROM (SELECT doc_id AS query_id, doc_id, pos, line, row_number() OVER (PARTITION BY doc_id ORDER BY pos DESC) AS r FROM kl) WHERE r = 1)"


def _last_lines(d, part):
    at = L.kept_lines(d).withColumn("r", F.row_number().over(Window.partitionBy("doc_id").orderBy(F.desc("pos")))).where("r = 1")
    return at.select(F.col("doc_id").alias("query_id"), "doc_id", "pos", F.expr(part).alias("prefix"))


@query(f"""
WITH {LINES}, {_LAST}, n AS (SELECT query_id, doc_id, pos AS here, {NORM('substr(line, 1, length(line) // 2)')} AS p FROM la), {_TYPED('n', 'query_id, doc_id, here, p')}, tq AS (SELECT * FROM ty WHERE nw >= 5),
{_variants_sql('tq', 'query_id, doc_id, here, p')}, ln AS (SELECT doc_id, pos, line, {_LEX('line')} AS toks FROM kl WHERE doc_id IN (SELECT doc_id FROM tq)),
lm AS (SELECT *, array_to_string(list_transform(toks, lambda t: CASE WHEN {_IS_NAME('t')} THEN chr(2) ELSE t END), '') AS masked FROM ln),
pr AS (SELECT DISTINCT query_id, typed, toks, abs(pos - here) AS dist FROM va JOIN lm USING (doc_id) WHERE pos <> here AND NOT starts_with(line, p) AND starts_with(masked, shape)), {_rebind_sql('pr', 'query_id, dist')},
be AS (SELECT query_id, rest AS text, min(dist) AS dist FROM rb WHERE strlen(rest) >= 2 GROUP BY ALL)
SELECT query_id, text, dist::INT AS dist, rnk::INT AS rnk FROM (SELECT *, {TOP('query_id', 'dist, text')} AS rnk FROM be) WHERE rnk <= 3
""")
def file_adapt(spark, sf_dir):
    """Like-shaped lines of the same document for the first half of each document's last line."""
    d = texts(spark, sf_dir)
    return P.document_adapt(_last_lines(d, "substring(line, 1, length(line) div 2)"), d)


@query(f"""
WITH {LINES}, {_LAST}, n AS (SELECT query_id, doc_id, pos AS here, {NORM('substr(line, 1, 6)')} AS p FROM la), s AS (SELECT doc_id, pos, line, lead(line) OVER w AS n1, lead(line, 2) OVER w AS n2 FROM kl WINDOW w AS (PARTITION BY doc_id ORDER BY pos)),
h AS (SELECT query_id, concat_ws(chr(10), substr(line, length(p) + 1), n1, n2) AS text, min(abs(pos - here)) AS dist FROM n JOIN s USING (doc_id) WHERE strlen(p) >= 4 AND starts_with(line, p) AND pos <> here AND n1 IS NOT NULL AND length(line) > length(p) GROUP BY ALL)
SELECT query_id, text, dist::INT AS dist, rnk::INT AS rnk FROM (SELECT *, {TOP('query_id', 'dist, text')} AS rnk FROM h) WHERE rnk <= 2
""")
def file_blocks(spark, sf_dir):
    """Lines of the same document that begin as its last one, each with the lines that follow."""
    d = texts(spark, sf_dir)
    return P.document_blocks(_last_lines(d, "substring(line, 1, 6)"), d)


@query(f"WITH {INDEX}, q AS (SELECT item_id, {NORM('substr(text, 1, 24)')} AS p FROM benchmark) SELECT item_id FROM q WHERE strlen(p) >= 2 AND EXISTS (SELECT 1 FROM idx WHERE starts_with(line, p))")
def prefix_attested(spark, sf_dir):
    """Passages whose start begins some line."""
    q = table(spark, sf_dir, "benchmark").select("item_id", F.substring("text", 1, 24).alias("prefix"))
    return K.has_prefix(q, L.line_index(texts(spark, sf_dir))).select("item_id")


@query(f"""
WITH {INDEX}, q AS (SELECT DISTINCT substr(line, 1, 5) AS query_id FROM idx), p AS (SELECT query_id, {NORM('query_id')} AS p FROM q WHERE strlen({NORM('query_id')}) >= 2), dy AS (SELECT line, count(*) AS cnt FROM kl WHERE source = 'src1' GROUP BY line),
h AS (SELECT query_id, substr(line, length(p) + 1) AS rest, cnt, 0 AS i FROM p JOIN dy ON starts_with(line, p) UNION ALL SELECT query_id, substr(line, length(p) + 1), cnt, 1 FROM p JOIN idx ON starts_with(line, p)),
t AS (SELECT * FROM (SELECT *, {TOP('query_id, i', 'cnt DESC, rest')} AS r FROM h WHERE strlen(rest) >= 2) WHERE r <= 20), f AS (SELECT query_id, rest, min(i * 1000 + r) AS o FROM t GROUP BY ALL)
SELECT query_id, rest, rnk::INT AS rnk FROM (SELECT *, {TOP('query_id', 'o, rest')} AS rnk FROM f) WHERE rnk <= 10
""")
def lookup_lines(spark, sf_dir):
    """Ten continuations of each line's first five characters, those of one source first."""
    d = materialize(texts(spark, sf_dir), "texts")
    idx = materialize(L.line_index(d), "index")
    q = idx.select(F.substring("line", 1, 5).alias("query_id")).distinct().withColumn("prefix", F.col("query_id"))
    return K.lookup_lines(q, idx, L.line_index(d.where("source = 'src1'")))


_FOLDER = "regexp_replace(regexp_extract(regexp_extract(regexp_replace(url, '^[\\s\\S]*?://', ''), '^[^?#]*'), '^(.*)/[^/]*$', 1), '/+$', '')"


@query(f"""
WITH f AS (SELECT page_id, {_FOLDER} AS folder FROM pages), b AS (SELECT *, translate(regexp_extract(folder, '([^/]*)/*$', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS base FROM f),
n AS (SELECT *, regexp_replace(regexp_replace(base, '[^a-z0-9_]', '', 'g'), '^[0-9]+', '') AS name FROM b) SELECT page_id, folder, CASE WHEN name IN ('internal', 'cmd', 'vendor') THEN '' ELSE name END AS package FROM n
""")
def path_folders(spark, sf_dir):
    """Folder and package name of each page's URL."""
    return table(spark, sf_dir, "pages").select("page_id", K.folder_of(F.col("url")).alias("folder")).withColumn("package", K.package_name(F.col("folder")))


_TAILS = lambda x: f"list_transform(range(least(len(ps), 3), 0, -1), lambda k: array_to_string(ps[len(ps) - k + 1:], '/'))"


@query(f"""
WITH f AS (SELECT page_id, url, {_FOLDER} AS folder FROM pages), kn AS (SELECT DISTINCT folder, list_filter(string_split(folder, '/'), lambda p: p <> '') AS ps FROM f WHERE folder <> ''),
tl AS (SELECT folder, unnest({_TAILS('ps')}) AS tail FROM kn), bt AS (SELECT * FROM (SELECT *, {TOP('tail', 'folder')} AS r FROM tl) WHERE r <= 8),
im AS (SELECT page_id, folder AS own, list_filter(string_split('x/' || regexp_extract(folder, '([^/]*/[^/]*)$', 1), '/'), lambda p: p <> '') AS ps FROM f),
ti AS (SELECT page_id, unnest({_TAILS('ps')}) AS tail, generate_subscripts({_TAILS('ps')}, 1) AS short FROM im), hi AS (SELECT page_id, folder, short, min(short) OVER (PARTITION BY page_id) AS best FROM ti JOIN bt USING (tail)),
ev AS (SELECT page_id, folder, -1 AS seq FROM f WHERE folder <> '' UNION ALL SELECT page_id, folder, 0 FROM hi WHERE short = best), o AS (SELECT page_id, folder, min(seq) AS seq FROM ev GROUP BY ALL)
SELECT page_id AS query_id, folder, rnk::INT AS rnk FROM (SELECT *, {TOP('page_id', 'seq, folder')} AS rnk FROM o) WHERE rnk <= 12
""")
def import_folders(spark, sf_dir):
    """Folders of pages that end as an import of each page's own last two folders would."""
    f = table(spark, sf_dir, "pages").select(F.col("page_id").alias("query_id"), K.folder_of(F.col("url")).alias("own"))
    imports = f.withColumns({"seq": F.lit(0), "path": F.concat(F.lit("x/"), F.regexp_extract("own", r"([^/]*/[^/]*)$", 1))})
    return K.resolve_folders(imports, f.select(F.col("own").alias("folder")))


# --- Mixtures, votes, probabilities -------------------------------------------------


@query(f"""
WITH {EXPLODED}, c AS (SELECT lang, tok, count(*) AS cnt FROM tk GROUP BY ALL), g AS (SELECT lang FROM c GROUP BY lang HAVING sum(cnt) >= 2048), u AS (SELECT *, cnt / sum(cnt) OVER (PARTITION BY lang)::DOUBLE AS u FROM (SELECT c.*, {TOP('lang', 'cnt DESC, tok')} AS r FROM c JOIN g USING (lang)) WHERE r <= 64),
p AS (SELECT lang, lag(tok) OVER (PARTITION BY doc_id ORDER BY pos) AS prev, tok FROM tk), bc AS (SELECT lang, prev, tok, count(*) AS cnt FROM p JOIN g USING (lang) WHERE prev IS NOT NULL GROUP BY ALL HAVING count(*) >= 2),
b AS (SELECT *, cnt / sum(cnt) OVER (PARTITION BY lang, prev)::DOUBLE AS b FROM (SELECT *, {TOP('lang, prev', 'cnt DESC, tok')} AS r FROM bc) WHERE r <= 32),
q AS (SELECT doc_id AS query_id, lang, toks[len(toks)] AS prev FROM lexed WHERE len(toks) > 0), x AS (SELECT query_id, tok, b FROM q JOIN b USING (lang, prev)), y AS (SELECT query_id, tok, u FROM q JOIN u USING (lang)),
j AS (SELECT query_id, tok, b, u, max(CASE WHEN b IS NOT NULL THEN 1 ELSE 0 END) OVER (PARTITION BY query_id) AS known FROM y FULL JOIN x USING (query_id, tok)),
d AS (SELECT query_id, tok, CASE WHEN known = 1 THEN 0.75 * coalesce(b, 0) + 0.25 * coalesce(u, 0) ELSE u END AS p FROM j)
SELECT query_id, tok, round(p, 9) AS p FROM d WHERE p > 0.01
""")
def language_next(spark, sf_dir):
    """Tokens that the language makes likely, over one per cent, after each document's last token."""
    lx = materialize(lexed(spark, sf_dir), "lexed")
    q = lx.where(F.size("toks") > 1).select(F.col("doc_id").alias("query_id"), "lang", F.expr("toks[size(toks) - 2]").alias("prev"))
    return T.language_blend(T.language_bigrams(lx).drop("rnk"), T.language_unigrams(lx).drop("rnk"), q).where("p > 0.01").withColumn("p", F.round("p", 9))


@query(f"""
WITH {LEXED}, q AS (SELECT doc_id AS query_id, source, toks[len(toks)] AS lst, toks FROM lexed WHERE len(toks) > 0), t AS (SELECT source, doc_id, unnest(toks) AS tok, generate_subscripts(toks, 1) AS pos FROM lexed),
w AS (SELECT source, lag(tok) OVER (PARTITION BY doc_id ORDER BY pos) AS prev, tok FROM t), c2 AS (SELECT source, prev, tok, count(*) AS cnt FROM w WHERE prev IS NOT NULL GROUP BY ALL), c1 AS (SELECT source, tok, count(*) AS cnt FROM t GROUP BY ALL),
h2 AS (SELECT query_id, c2.tok, cnt FROM q JOIN c2 ON q.source IS NOT DISTINCT FROM c2.source AND c2.prev = lst), h1 AS (SELECT query_id, c1.tok, cnt FROM q JOIN c1 ON q.source IS NOT DISTINCT FROM c1.source WHERE query_id NOT IN (SELECT query_id FROM h2)),
h AS (SELECT *, sum(cnt) OVER (PARTITION BY query_id)::BIGINT AS tot FROM (SELECT * FROM h2 UNION ALL SELECT * FROM h1)) SELECT query_id, tok, round(cnt / tot::DOUBLE, 9) AS pc, tot FROM h WHERE cnt / tot::DOUBLE > 0.02
""")
def cache_next(spark, sf_dir):
    """Tokens over two per cent after each document's last token, by the counts of its source."""
    t = materialize(lexed(spark, sf_dir).withColumn("source", F.coalesce("source", F.lit("\x00"))), "lexed")
    q = t.select(F.col("doc_id").alias("query_id"), "source", F.filter("toks", lambda x: x != X.END).alias("t")).where(F.size("t") > 0)
    return N.scoped_cache(t, "source", q.select("query_id", "source", F.expr("slice(t, size(t), 1)").alias("ctx")), order=2, over=0.02).withColumn("pc", F.round("pc", 9))


@query("""
WITH s AS (SELECT o_custkey AS query_id, o_orderpriority AS tok, count(*) AS c FROM orders GROUP BY ALL), st AS (SELECT query_id, tok, c / sum(c) OVER (PARTITION BY query_id)::DOUBLE AS p FROM s),
k AS (SELECT o_custkey AS query_id, o_orderpriority AS tok, count(*) AS c FROM orders WHERE o_orderstatus = 'F' GROUP BY ALL), ca AS (SELECT query_id, tok, c / sum(c) OVER (PARTITION BY query_id)::DOUBLE AS pc, sum(c) OVER (PARTITION BY query_id) AS tot FROM k),
w AS (SELECT query_id, least(0.75, max(tot) / (max(tot) + 4)::DOUBLE) AS b FROM ca GROUP BY query_id), j AS (SELECT query_id, tok, p, pc, coalesce(b, 0) AS b FROM (SELECT * FROM st FULL JOIN ca USING (query_id, tok)) LEFT JOIN w USING (query_id))
SELECT query_id, tok, round(CASE WHEN p IS NULL THEN 0.5 * b * pc WHEN pc IS NULL THEN (1 - b) * p ELSE b * pc + (1 - b) * p END, 9) AS p FROM j
""")
def cache_mixture(spark, sf_dir):
    """Shares of order priorities of each customer, mixed with those of finished orders as a cache."""
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("query_id"), F.col("o_orderpriority").alias("tok"), "o_orderstatus")
    share = lambda df: df.groupBy("query_id", "tok").agg(F.count("*").alias("c")).withColumn("tot", F.sum("c").over(Window.partitionBy("query_id")))
    static = share(o).select("query_id", "tok", (F.col("c") / F.col("tot")).alias("p"))
    cache = share(o.where("o_orderstatus = 'F'")).select("query_id", "tok", (F.col("c") / F.col("tot")).alias("pc"), "tot")
    return N.mix_candidates(static, cache).withColumn("p", F.round("p", 9))


@query("""
WITH s AS (SELECT o_custkey AS query_id, o_orderpriority AS tok, count(*) AS c FROM orders GROUP BY ALL), p AS (SELECT query_id, tok, c / sum(c) OVER (PARTITION BY query_id)::DOUBLE AS p FROM s),
l AS (SELECT o_orderpriority AS tok, count(*) / (SELECT count(*) FROM orders)::DOUBLE AS langp FROM orders WHERE o_orderpriority < '4' GROUP BY 1), t AS (SELECT o_orderpriority AS tok, count(*) FILTER (o_orderstatus = 'F') / count(*)::DOUBLE AS structp FROM orders GROUP BY 1),
v AS (SELECT query_id, tok, p * (1 + 3 * coalesce(langp, 0)) * (1 + 2 * coalesce(structp, 0)) AS p FROM p LEFT JOIN l USING (tok) LEFT JOIN t USING (tok)) SELECT query_id, tok, round(p, 9) AS p, rnk::INT AS rnk FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(p, 12) DESC, tok) AS rnk FROM v)
""")
def voted_tokens(spark, sf_dir):
    """Shares of order priorities of each customer with votes of two other tables."""
    o = table(spark, sf_dir, "orders").withColumnRenamed("o_orderpriority", "tok")
    c = o.groupBy(F.col("o_custkey").alias("query_id"), "tok").agg(F.count("*").alias("c"))
    p = c.select("query_id", "tok", (F.col("c") / F.sum("c").over(Window.partitionBy("query_id"))).alias("p"))
    lang = o.where("tok < '4'").groupBy("tok").agg((F.count("*") / F.lit(o.count())).alias("p")).join(c.select("query_id").distinct())
    struct = o.groupBy("tok").agg((F.count_if(F.col("o_orderstatus") == "F") / F.count("*")).alias("p")).join(c.select("query_id").distinct())
    return N.voted(p, lang.select("query_id", "tok", "p"), struct.select("query_id", "tok", "p")).withColumn("p", F.round("p", 9))


@query(f"""
WITH {EXPLODED}, t AS (SELECT tok, count(*) / (SELECT count(*) FROM tk)::DOUBLE AS p FROM tk GROUP BY tok) SELECT doc_id, round(exp(avg(ln(greatest(p, 1e-9)))), 9) AS p FROM (SELECT doc_id, tok, pos FROM tk WHERE tok <> ' ') JOIN t USING (tok) GROUP BY doc_id
""")
def rest_probability(spark, sf_dir):
    """Geometric mean of the tokens' shares in each document."""
    lx = materialize(lexed(spark, sf_dir), "lexed")
    c = T.token_counts(lx)
    n = c.agg(F.sum("cnt")).head()[0] or 1
    rows = lx.select("doc_id", F.explode("toks").alias("tok")).where((F.col("tok") != " ") & (F.col("tok") != X.END))
    return N.geometric_mean(rows.join(c.withColumn("p", F.col("cnt") / F.lit(float(n))), "tok"), "doc_id").withColumn("p", F.round("p", 9))


@query("""
WITH h AS (SELECT l_linenumber AS n, l_discount + 0.01 AS direct, l_tax + 0.01 AS g FROM lineitem), c AS (SELECT n, count(*) AS c, avg(g / (direct + g)) AS beta, avg(g) AS gm FROM h GROUP BY n),
r AS (SELECT n, CASE WHEN c >= 64 AND gm > 0 THEN least(greatest(beta / gm, 0.25), 4.0) ELSE 1.0 END AS l FROM c) SELECT n, round(l / (SELECT exp(avg(ln(l))) FROM r), 9) AS lam FROM r
""")
def held_out_lambdas(spark, sf_dir):
    """Interpolation weights of line numbers as orders, from discounts and taxes as evidence."""
    li = table(spark, sf_dir, "lineitem").select(F.col("l_linenumber").alias("n"), (F.col("l_discount") + 0.01).alias("direct"), (F.col("l_tax") + 0.01).alias("gamma_lower"))
    return B.deleted_interpolation(li).withColumn("lam", F.round("lam", 9))


# --- Ranking -----------------------------------------------------------------------

_FLAGS = """c AS (SELECT line AS query_id, line AS text, cnt::DOUBLE AS score, cnt % 4 AS hits, length(line) % 5 = 0 AS member, length(line) % 3 = 0 AS imported, length(line) % 2 = 0 AS indent, cnt % 3 = 0 AS rejected, 0.6 + (length(line) % 7) / 7.0::DOUBLE AS mult,
  (cnt % 13)::INT AS learned, length(line) % 11 = 0 AS learned_prefix, length(line) % 4 = 0 AS block FROM idx)"""


@query(f"""
WITH {INDEX}, {_FLAGS}, a AS (SELECT *, score * (1 + 0.12 * least(0.7 * hits, 3)) * CASE WHEN member THEN 1.5 ELSE 1 END * CASE WHEN imported THEN 1.15 ELSE 1 END * CASE WHEN indent THEN 1.06 ELSE 1 END * CASE WHEN rejected THEN 0.4 ELSE 1 END * mult AS s FROM c)
SELECT text, round((s + CASE WHEN learned > 0 THEN least(learned, 10) * 200000.0 WHEN learned_prefix THEN 100000.0 ELSE 0 END) * CASE WHEN block THEN 1.2 ELSE 1 END, 3) AS score FROM a
""")
def multiplied_scores(spark, sf_dir):
    """Scores of lines after every multiplier in turn, with signs made of counts and lengths."""
    n = F.length("line")
    c = L.line_index(texts(spark, sf_dir)).select(
        F.col("line").alias("query_id"), F.col("line").alias("text"), F.col("cnt").cast("double").alias("score"), (0.7 * (F.col("cnt") % 4)).alias("scope"), (n % 5 == 0).alias("member"), (n % 3 == 0).alias("imported"),
        (n % 2 == 0).alias("indent"), (F.col("cnt") % 3 == 0).alias("rejected"), (0.6 + (n % 7) / 7.0).alias("mult"), (F.col("cnt") % 13).cast("int").alias("learned"), (n % 11 == 0).alias("learned_prefix"), (n % 4 == 0).alias("block"),
    )
    return R.multiplied(c).select("text", F.round("score", 3).alias("score"))


@query("""
WITH r AS (SELECT user_id, ts AS r_ts, event_id % 3 AS shape FROM events WHERE event_type = 'error'), q AS (SELECT event_id, user_id, ts, event_id % 3 AS shape, value AS score FROM events WHERE event_type = 'view')
SELECT event_id, round(score * CASE WHEN EXISTS (SELECT 1 FROM r WHERE r.user_id = q.user_id AND r.shape = q.shape AND r_ts <= ts AND ts <= r_ts + INTERVAL 300 MINUTE) THEN 0.4 ELSE 1 END, 9) AS score FROM q
""")
def rejected_again(spark, sf_dir):
    """Views' values, lowered where the user had an error of the same kind within five hours before."""
    e = table(spark, sf_dir, "events").withColumn("shape", F.col("event_id") % 3)
    shown = e.where("event_type = 'view'").select("event_id", "user_id", "ts", "shape", F.col("value").alias("score"))
    return B.suppressed(shown, e.where("event_type = 'error'").select("user_id", "shape", "ts"), ["user_id", "shape"], within="300 minutes").select("event_id", F.round("score", 9).alias("score"))


@query(f"""
WITH {LINES}, s AS (SELECT lang, length(line) AS v, row_number() OVER (PARTITION BY lang ORDER BY length(line)) - 1 AS i, count(*) OVER (PARTITION BY lang) AS n FROM kl)
SELECT lang, n, max(CASE WHEN i = n * 50 // 100 THEN v END) AS p50, max(CASE WHEN i = n * 95 // 100 THEN v END) AS p95 FROM s GROUP BY lang, n
""")
def length_percentiles(spark, sf_dir):
    """Median and 95th percentile of lines' lengths by language, picked by index."""
    rows = L.kept_lines(texts(spark, sf_dir), "doc_id", "text", "lang").select("lang", F.length("line").cast("long").alias("v"))
    return V.percentiles(rows, "lang", "v", (50, 95))


# --- Edits, symbols, journal --------------------------------------------------------


@query("""
WITH r AS (SELECT conv_id AS uri, substr(text, 1, 4) AS o, 'zz' AS n, turn AS age FROM conversations WHERE text <> ''), l AS (SELECT conv_id AS uri, turn AS pos, text AS line FROM conversations),
h AS (SELECT *, row_number() OVER (PARTITION BY uri, pos ORDER BY age DESC, o, n) AS q FROM r JOIN l USING (uri) WHERE contains(line, o) AND NOT contains(line, n) AND o <> '')
SELECT uri, pos, line, o AS old_side, n AS new_side, rnk::INT AS rnk FROM (SELECT *, row_number() OVER (PARTITION BY uri ORDER BY age DESC, pos) AS rnk FROM h WHERE q = 1) WHERE rnk <= 8
""")
def next_edit_sites(spark, sf_dir):
    """Turns of a conversation that hold what another of its turns begins with."""
    c = table(spark, sf_dir, "conversations")
    rules = c.where("text != ''").select(F.col("conv_id").alias("uri"), F.substring("text", 1, 4).alias("old_side"), F.lit("zz").alias("new_side"), F.col("turn").alias("age"))
    return E.next_edits(rules, c.select(F.col("conv_id").alias("uri"), F.col("turn").alias("pos"), F.col("text").alias("line")), "age")


@query("""
WITH w AS (SELECT conv_id AS query_id, turn, text, (turn + 1)::DOUBLE AS score, regexp_extract(text, '[A-Za-z]{3,}') AS word FROM conversations WHERE text IS NOT NULL), r AS (SELECT query_id, word AS o, 'zz' AS n, turn AS age FROM w WHERE word <> '' AND turn < 3),
c AS (SELECT query_id, text, max(score) AS score FROM w GROUP BY ALL), h AS (SELECT query_id, text, score, regexp_replace(text, '(^|[^A-Za-z0-9_$])' || o || '($|[^A-Za-z0-9_$])', '\\1' || n || '\\2', 'g') AS new, row_number() OVER (PARTITION BY query_id, text ORDER BY age DESC, o) AS k
  FROM c JOIN r USING (query_id) WHERE regexp_matches(text, '(^|[^A-Za-z0-9_$])' || o || '($|[^A-Za-z0-9_$])')),
k AS (SELECT * FROM h WHERE k <= 6), s AS (SELECT query_id, text, 'own' AS source, CASE WHEN (query_id, text) IN (SELECT (query_id, text) FROM h) THEN score * 0.8 ELSE score END AS score FROM c), v AS (SELECT query_id, new AS text, 'edit' AS source, score * 0.95 AS score FROM k)
SELECT query_id, text, source, round(max(score), 9) AS score FROM (SELECT * FROM s UNION ALL SELECT * FROM v) GROUP BY ALL
""")
def propagated_edits(spark, sf_dir):
    """Turns as candidates with the first words of their conversation's first turns replaced."""
    w = table(spark, sf_dir, "conversations").where("text IS NOT NULL").select(F.col("conv_id").alias("query_id"), "turn", "text", (F.col("turn") + 1.0).alias("score"), F.regexp_extract("text", "[A-Za-z]{3,}", 0).alias("old_side"))
    rules = w.where("old_side != '' AND turn < 3").select("query_id", "old_side", F.lit("zz").alias("new_side"), F.col("turn").alias("age"))
    c = w.groupBy("query_id", "text").agg(F.max("score").alias("score")).withColumn("source", F.lit("own"))
    out = E.propagate(c, rules, newest=F.col("age"))
    return out.groupBy("query_id", "text", "source").agg(F.round(F.max("score"), 9).alias("score"))


@query("""
WITH q AS (SELECT DISTINCT substr(p_name, 1, 3) AS query_id FROM part), h AS (SELECT query_id, p_name AS name, p_brand AS path, p_partkey AS line FROM q JOIN part ON starts_with(p_name, query_id))
SELECT query_id, name, path, line, rnk::INT AS rnk FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY length(name), name, path, line) AS rnk FROM h) WHERE rnk <= 10
""")
def symbol_prefix(spark, sf_dir):
    """The ten shortest part names that begin with each three characters."""
    p = table(spark, sf_dir, "part")
    q = p.select(F.substring("p_name", 1, 3).alias("query_id")).distinct().withColumn("prefix", F.col("query_id"))
    return S.lookup_prefix(p.select(F.col("p_name").alias("name"), F.col("p_brand").alias("path"), F.col("p_partkey").alias("line")), q)


@query("""
WITH b AS (SELECT event_id, ts, strlen(props) + 1 AS size FROM events), s AS (SELECT *, sum(size) OVER (ORDER BY ts DESC, event_id DESC) AS upto FROM b) SELECT event_id FROM s WHERE upto <= 65536
""")
def journal_compacted(spark, sf_dir):
    """The newest events whose properties take at most 64 KiB."""
    return B.newest_bytes(table(spark, sf_dir, "events").select("event_id", "ts", "props"), "ts", "event_id", F.octet_length("props") + 1, 65536).select("event_id")


@query(f"""
WITH e AS (SELECT row_number() OVER (ORDER BY ts, event_id) - 1 AS i, {KIND_SQL} AS k FROM events WHERE {KIND_SQL} IS NOT NULL), b AS (SELECT i // 256 AS b, count(*) FILTER (k = 'a') / 256.0::DOUBLE AS share FROM e GROUP BY 1 HAVING count(*) = 256)
SELECT round(list_reduce(list_prepend(0.02::DOUBLE, coalesce(list(share ORDER BY b), [])), lambda a, s: CASE WHEN s < 0.1 THEN least(0.08, a * 1.2) WHEN s > 0.5 THEN greatest(0.008, a / 1.2) ELSE a END), 9) AS floor FROM b
""")
def adapted_floor(spark, sf_dir):
    """The model's probability floor after all feedback."""
    e = table(spark, sf_dir, "events").where(kind().isNotNull()).select("ts", "event_id", (kind() == "a").alias("accepted"))
    return B.floor_after(e, "ts", "event_id").withColumn("floor", F.round("floor", 9))


@query(f"""
WITH {LINES}, b AS (SELECT lang, line, count(*) AS cnt FROM kl GROUP BY ALL), w AS (SELECT unnest(['en', 'xx']) AS lang), h AS (SELECT w.lang, line, cnt FROM w JOIN b ON b.lang = w.lang OR b.lang IN ('', 'other')) SELECT lang, line, sum(cnt)::BIGINT AS cnt FROM h GROUP BY ALL
""")
def dynamic_union(spark, sf_dir):
    """Lines of a language with those of no language."""
    d = L.kept_lines(texts(spark, sf_dir), "doc_id", "text", "lang").groupBy("lang", "line").agg(F.count("*").alias("cnt"))
    return L.for_language(d, spark.createDataFrame([("en",), ("xx",)], "lang string"))


@query(f"""
WITH {INDEX}, o AS (SELECT line, count(*) + 1000 AS cnt FROM kl WHERE source = 'src1' GROUP BY line) SELECT line, cnt FROM o UNION ALL SELECT line, cnt FROM idx WHERE line NOT IN (SELECT line FROM o)
""")
def overlaid_index(spark, sf_dir):
    """The line index under an overlay of one source's lines."""
    d = texts(spark, sf_dir)
    over = L.line_index(d.where("source = 'src1'")).withColumn("cnt", F.col("cnt") + 1000)
    return T.overlay(L.line_index(d), over, ["line"])


@query(f"WITH {LEXED} SELECT doc_id, md5(array_to_string(toks, '')) AS digest, len(toks) AS n FROM lexed")
def detokenized(spark, sf_dir):
    """Digest of each document's tokens on end, and their number."""
    return lexed(spark, sf_dir).select("doc_id", F.md5(X.detok(F.col("toks")).cast("binary")).alias("digest"), (F.size("toks") - 1).cast("long").alias("n"))


@query(f"""
WITH {ALL_LINES}, l AS (SELECT DISTINCT line FROM al WHERE line <> '') SELECT line, regexp_extract(line, '{U.WORD}*$') AS part, regexp_extract(line, '([^ \t])[ \t]*$', 1) AS sign,
  regexp_matches(regexp_replace(line, '{U.CLOSED.replace("'", "''")}', '', 'g'), '["''`]') AS open, {_LEX('line')}[1] AS first FROM l
""")
def cursor_ends(spark, sf_dir):
    """What stands at the end of each distinct line: a part of a name, a sign, an open literal; and its first token."""
    lines = texts(spark, sf_dir).select(F.explode_outer(F.transform(F.split("text", "\n"), X.normalize)).alias("line")).where("line != ''").distinct()
    c = F.col("line")
    return lines.select("line", U.trailing_name(c).alias("part"), U.last_sign(c).alias("sign"), U.in_literal(c).alias("open"), X.first_line_token(c).alias("first"))


@query(f"""
WITH {EXPLODED}, n AS (SELECT doc_id, tok AS name, count(*) AS cnt, min(pos) AS fst FROM tk WHERE regexp_matches(tok, '^{U.START}') AND tok NOT IN ({WORDS}) GROUP BY ALL)
SELECT doc_id, name, cnt FROM (SELECT *, {TOP('doc_id', 'fst')} AS r FROM n) WHERE r <= 512
""")
def scope_counts(spark, sf_dir):
    """The first 512 different names of each document with their counts."""
    return T.scope(lexed(spark, sf_dir)).select("doc_id", "name", "cnt")
