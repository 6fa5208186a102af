"""Further queries: ranking, feedback, edits, pages, definitions."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from quillframe.functions import text as X
from quillframe.functions import vocabulary as V
from quillframe.operators import edits as E
from quillframe.operators import feedback as B
from quillframe.operators import lines as L
from quillframe.operators import rank as R
from quillframe.operators import symbols as S
from quillframe.operators import tables as T
from quillframe.plans.queries import INDEX, LINES, MASK, NORM, PARTS, RAW, TOKENS, TOP, query, table, texts



def kind():
    """``a`` for accepted, ``r`` for rejected, else null."""
    return F.when(F.col("event_type") == "purchase", "a").when(F.col("event_type") == "error", "r")


KIND_SQL = "CASE event_type WHEN 'purchase' THEN 'a' WHEN 'error' THEN 'r' END"


@query(f"""
WITH c AS (SELECT CAST(user_id % 10 AS VARCHAR) AS source, count(*) FILTER (k = 'a') AS acc, count(*) FILTER (k = 'r') AS rej FROM (SELECT user_id, {KIND_SQL} AS k FROM events) GROUP BY 1),
g AS (SELECT sum(acc) AS ga, sum(rej) AS gr FROM c)
SELECT source, acc, rej, round(least(greatest(((acc + 4) / (acc + rej + 8)::DOUBLE) / ((ga + 4) / (ga + gr + 8)::DOUBLE), 0.6), 1.6), 9) AS mult FROM c, g
""")
def src_mult(spark, sf_dir):
    """Accept rate of each source over the global one."""
    e = table(spark, sf_dir, "events").withColumn("src", (F.col("user_id") % 10).cast("string"))
    return T.source_multiplier(e, "src", kind()).withColumn("mult", F.round("mult", 9))


@query("""
WITH s AS (SELECT user_id, event_id AS shown_id, ts AS s_ts FROM events WHERE event_type = 'view'), e AS (SELECT user_id, event_id, ts AS e_ts FROM events WHERE event_type IN ('purchase', 'click')),
h AS (SELECT *, row_number() OVER (PARTITION BY event_id ORDER BY s_ts DESC, shown_id DESC) AS r FROM s JOIN e USING (user_id) WHERE s_ts <= e_ts AND e_ts <= s_ts + INTERVAL 120 MINUTE),
o AS (SELECT *, row_number() OVER (PARTITION BY shown_id ORDER BY e_ts, event_id) AS q FROM h WHERE r = 1)
SELECT user_id, shown_id, event_id, ((epoch_us(e_ts) - epoch_us(s_ts)) // 1000000)::BIGINT AS gap FROM o WHERE q = 1
""")
def accept_interval_join(spark, sf_dir):
    """Each click or purchase with the view it follows within two hours."""
    e = table(spark, sf_dir, "events")
    shown = e.where("event_type = 'view'").select("user_id", F.col("event_id").alias("shown_id"), "ts")
    return B.matched_accepts(shown, e.where("event_type IN ('purchase', 'click')").select("user_id", "event_id", "ts"), ["user_id"], "120 minutes")


@query(f"""
WITH k AS (SELECT date_trunc('day', ts) AS start, {KIND_SQL} AS k FROM events)
SELECT start, count(*) FILTER (k = 'a') AS acc, count(*) FILTER (k = 'r') AS rej, round(count(*) FILTER (k = 'a') / nullif(count(*) FILTER (k IN ('a', 'r')), 0)::DOUBLE, 9) AS rate FROM k GROUP BY start
""")
def accept_rate_windows(spark, sf_dir):
    """Accept rate of each day."""
    e = table(spark, sf_dir, "events").withColumn("kind", kind())
    return B.accept_rates(e, "ts", "kind").withColumn("rate", F.round("rate", 9))


@query("SELECT event_id, user_id::VARCHAR AS source, value AS score, (props->>'$.k')::BIGINT AS k FROM events WHERE event_type IN ('purchase', 'error')")
def journal_events(spark, sf_dir):
    """Feedback events with their JSON properties read."""
    e = table(spark, sf_dir, "events").where(kind().isNotNull())
    return e.select("event_id", F.col("user_id").cast("string").alias("source"), F.col("value").alias("score"), F.from_json("props", "k long")["k"].alias("k"))


@query("""
WITH v AS (SELECT conv_id, turn, lag(text) OVER (PARTITION BY conv_id ORDER BY turn) AS old, text AS new FROM conversations),
x AS (SELECT conv_id, turn, string_split(old, chr(10)) AS o, string_split(new, chr(10)) AS n FROM v WHERE old IS NOT NULL AND old <> new),
m AS (SELECT *, least(len(o), len(n)) AS m FROM x),
h AS (SELECT *, coalesce(list_min(list_filter(range(1, m + 1), lambda i: o[i] <> n[i])) - 1, m) AS head FROM m),
t AS (SELECT *, least(coalesce(list_min(list_filter(range(1, m + 1), lambda i: o[len(o) - i + 1] <> n[len(n) - i + 1])) - 1, m), m - head) AS tail FROM h)
SELECT conv_id, turn, (len(o) - head - tail)::INT AS removed, (len(n) - head - tail)::INT AS added FROM t
""")
def edit_pairs(spark, sf_dir):
    """How many lines each turn of a conversation changes against the one before."""
    v = table(spark, sf_dir, "conversations").select("conv_id", "turn", "text")
    return E.changed_lines(E.version_pairs(v, "conv_id", "turn", "text"), "conv_id", "turn")


@query()
def edit_rules(spark, sf_dir):
    """Token rules between turns of conversations."""
    v = table(spark, sf_dir, "conversations").select("conv_id", "turn", "text")
    return E.edit_rules(E.version_pairs(v, "conv_id", "turn", "text"), "conv_id", "turn")


@query("""
WITH c AS (SELECT page_id, substr(html, 1, instr(html, 'var t') + 2) AS p FROM pages)
SELECT page_id, CASE WHEN contains(p, '<?php') AND NOT contains(string_split(p, '<?php')[-1], '?>') THEN 'php'
  WHEN contains(p, '<script') AND NOT contains(string_split(p, '<script')[-1], '</script') THEN CASE WHEN contains(substr(string_split(p, '<script')[-1], 1, 193), 'ts') THEN 'typescript' ELSE 'javascript' END ELSE 'html' END AS lang FROM c
""")
def page_embedded_lang(spark, sf_dir):
    """The language at the place of each page's first script variable."""
    cut = F.expr("substring(html, 1, instr(html, 'var t') + 2)")
    return table(spark, sf_dir, "pages").select("page_id", X.embedded_language(F.lit("html"), cut).alias("lang"))


_EXT = "CASE " + " ".join(f"WHEN base = '{n}' THEN '{v}'" for n, v in V.LANGUAGE_NAMES.items()) + " " + " ".join(f"WHEN ext IN ({', '.join(repr(e) for e in es)}) THEN '{v}'" for v, es in V.LANGUAGE_EXTENSIONS.items()) + " ELSE 'other' END"


@query(f"""
WITH b AS (SELECT page_id, lower(regexp_extract(regexp_extract(regexp_replace(url, '^[\\s\\S]*?://', ''), '^[^?#]*'), '([^/]*)/*$', 1)) AS base FROM pages),
e AS (SELECT *, regexp_extract(base, '\\.([^.]*)$', 1) AS ext FROM b) SELECT page_id, {_EXT} AS lang FROM e
""")
def language_of_path(spark, sf_dir):
    """Language of each page by its URL's extension."""
    return table(spark, sf_dir, "pages").select("page_id", X.language_of(F.col("url")).alias("lang"))


SUG = """WITH b AS (SELECT a.item_id, a.text AS sug, b.text AS after FROM benchmark a JOIN benchmark b ON b.item_id = (a.item_id + 1))"""


@query(rf"""
WITH b AS (SELECT item_id, substr(text, 1, 30) AS sug, substr(text, 11, 20) AS rest, substr(text, 21) AS tail FROM benchmark), n AS (SELECT item_id, sug, {NORM('sug')} AS s, {NORM('rest')} AS rest, {NORM('tail')} AS tail FROM b)
SELECT item_id, strlen(sug) >= 2 AND s <> '' AND (tail = '' OR (NOT starts_with(tail, s) AND (rest = '' OR CASE WHEN strlen(rest) >= 2 THEN CASE WHEN s = rest OR ends_with(s, rest) THEN strlen(s) > strlen(rest) ELSE NOT contains(s, rest) END ELSE NOT ends_with(s, rest) END))) AS ok FROM n
""")
def suggestion_accept(spark, sf_dir):
    """Whether the start of each passage is worth suggesting before a part of it."""
    b = table(spark, sf_dir, "benchmark").select("item_id", F.substring("text", 1, 30).alias("sug"), X.normalize(F.substring("text", 11, 20)).alias("rest"), X.normalize(F.expr("substring(text, 21)")).alias("tail"))
    return b.select("item_id", X.acceptable_suggestion(F.col("sug"), F.col("tail"), F.col("rest")).alias("ok"))


def _foreign_sql() -> str:
    out = []
    for name, words in V.FOREIGN_TOKENS.items():
        whole = "|".join(rf"(?:^|[^A-Za-z0-9_$]){w}(?:[^A-Za-z0-9_$]|$)" for w in words if not w.endswith("."))
        out.append(f"(l = '{name}' AND (regexp_matches(first, '{whole}')" + "".join(f" OR contains(first, '{w}')" for w in words if w.endswith(".")) + "))")
    for name, subs in V.FOREIGN_SUBSTRINGS.items():
        for s in subs:
            extra = " AND NOT regexp_matches(string_split(first, ':=')[1], '[(\\[{]') AND NOT regexp_matches(first, '^[ \\t]*(?:if|while|elif|for|return|assert) ')" if (name, s) == ("python", ":=") else ""
            out.append(f"(l = '{name}' AND contains(first, '{s}'){extra})")
    return " OR ".join(out)


@query(f"WITH {LINES}, d AS (SELECT DISTINCT line AS first FROM kl), x AS (SELECT first, unnest(['python', 'go', 'java', 'rust']) AS l FROM d) SELECT l AS lang, count(*) FILTER ({_foreign_sql()}) AS n_foreign, count(*) AS n FROM x GROUP BY l")
def foreign_lines(spark, sf_dir):
    """How many distinct lines some languages cannot have."""
    lines = L.line_index(texts(spark, sf_dir)).select("line", F.explode(F.array(*[F.lit(x) for x in ("python", "go", "java", "rust")])).alias("lang"))
    return lines.groupBy("lang").agg(F.count_if(X.foreign_line(F.col("line"), F.col("lang"))).alias("n_foreign"), F.count("*").alias("n"))


@query(f"WITH w AS (SELECT DISTINCT unnest(regexp_extract_all(text, '[A-Za-z_][A-Za-z0-9_]*')) AS ident FROM documents) SELECT ident, array_to_string({PARTS('ident')}, '|') AS parts FROM w")
def subtoken_parts(spark, sf_dir):
    """Parts of all ASCII names."""
    names = table(spark, sf_dir, "documents").select(F.explode(F.regexp_extract_all("text", F.lit("[A-Za-z_][A-Za-z0-9_]*"), F.lit(0))).alias("ident")).distinct()
    return names.select("ident", F.array_join(X.subtokens(F.col("ident")), "|").alias("parts"))


@query()
def symbols(spark, sf_dir):
    """Definitions in all documents and pages."""
    d = table(spark, sf_dir, "documents").select(F.concat(F.lit("d"), "doc_id").alias("p"), "text")
    p = table(spark, sf_dir, "pages").select(F.concat(F.lit("p"), "page_id").alias("p"), F.col("html").alias("text"))
    return S.extract(d.unionByName(p), F.col("p"))


@query(f"""
WITH {INDEX}, c AS (SELECT substr(line, 1, 6) AS query_id, substr(line, 7) AS text, cnt, CASE WHEN cnt >= 3 THEN 'file' WHEN cnt = 2 THEN 'dyn' ELSE 'corpus' END AS source FROM idx WHERE strlen(substr(line, 7)) >= 2),
s AS (SELECT query_id, text, source, CASE source WHEN 'file' THEN 1000000.0 WHEN 'dyn' THEN 100000.0 ELSE 0.0 END + cnt AS score, CASE source WHEN 'file' THEN 1 WHEN 'dyn' THEN 5 ELSE 6 END AS seq FROM c),
u AS (SELECT * FROM (SELECT *, {TOP('query_id, text', 'seq, score DESC')} AS q FROM s) WHERE q = 1),
r AS (SELECT *, {TOP('query_id', 'score DESC, seq, text')} AS r FROM u),
g AS (SELECT *, max(CASE WHEN r = 1 THEN source END) OVER p AS s1, min(CASE WHEN r <= 4 THEN source END) OVER p = max(CASE WHEN r <= 4 THEN source END) OVER p AS uniform, max(CASE WHEN r = 4 THEN score END) OVER p AS last FROM r WINDOW p AS (PARTITION BY query_id)),
o AS (SELECT *, min(CASE WHEN r > 4 AND source <> s1 THEN r END) OVER (PARTITION BY query_id) AS other FROM g),
w AS (SELECT *, coalesce(uniform AND other IS NOT NULL AND max(CASE WHEN r = other AND score > 0.15 * last THEN 1 ELSE 0 END) OVER (PARTITION BY query_id) = 1, false) AS swap FROM o),
f AS (SELECT query_id, text, source, score::DOUBLE AS score, (CASE WHEN swap AND r = other THEN 4 WHEN swap AND r = 4 THEN 5 ELSE r END)::INT AS rnk FROM w)
SELECT * FROM f WHERE rnk <= 4
""")
def candidate_union_rank(spark, sf_dir):
    """The four best continuations of line starts, from three sources, with another source in the last place."""
    rest = F.expr("substring(line, 7)")
    c = L.line_index(texts(spark, sf_dir)).select(F.substring("line", 1, 6).alias("query_id"), rest.alias("text"), "cnt").where(F.octet_length("text") >= 2)
    part = lambda source, cond: c.where(cond).select("query_id", "text", F.lit(source).alias("source"), (F.lit(R.BASE.get(source, 0.0)) + F.col("cnt")).alias("score"))
    return R.final_order(R.union_candidates(part("corpus", "cnt = 1"), part("file", "cnt >= 3"), part("dyn", "cnt = 2")))


@query(f"""
WITH {INDEX}, r AS (SELECT substr(line, 1, 2) AS query_id, line, cnt, {RAW('line')} AS r FROM idx), t AS (SELECT query_id, line, cnt, {TOKENS('r')} AS toks FROM r), m AS (SELECT query_id, line, cnt, {MASK('toks')} AS shape FROM t)
SELECT query_id, line AS text, cnt::DOUBLE AS score FROM (SELECT *, {TOP('query_id, shape', 'cnt DESC, line')} AS q FROM m) WHERE q = 1
""")
def dedupe_shapes(spark, sf_dir):
    """Of lines that begin alike, the most frequent of each shape."""
    c = L.line_index(texts(spark, sf_dir)).select(F.substring("line", 1, 2).alias("query_id"), F.col("line").alias("text"), F.col("cnt").cast("double").alias("score"), F.lit(0).alias("seq"))
    return R.one_per_shape(c).select("query_id", "text", "score")


@query("""
WITH i AS (SELECT DISTINCT o_custkey AS iface, l_partkey % 50 AS member FROM orders JOIN lineitem ON l_orderkey = o_orderkey), t AS (SELECT DISTINCT l_suppkey AS type, l_partkey % 50 AS member FROM lineitem),
n AS (SELECT iface, count(*) AS n FROM i GROUP BY iface HAVING count(*) BETWEEN 1 AND 8), h AS (SELECT iface, type, count(*) AS m FROM i JOIN t USING (member) WHERE iface <> type GROUP BY ALL)
SELECT iface, type FROM h JOIN n USING (iface) WHERE m = n
""")
def satisfies(spark, sf_dir):
    """Which suppliers have every kind of part that a customer with few kinds bought."""
    li = table(spark, sf_dir, "lineitem")
    name = F.concat((F.col("l_partkey") % 50).cast("string"), F.lit("("))
    need = table(spark, sf_dir, "orders").join(li, F.col("l_orderkey") == F.col("o_orderkey")).select(F.col("o_custkey").alias("iface"), name.alias("member"))
    return S.satisfies(need, li.select(F.col("l_suppkey").alias("type"), name.alias("member")))


@query()
def source_weights(spark, sf_dir):
    """Trained weights of sources from feedback events."""
    e = table(spark, sf_dir, "events").withColumn("kind", kind()).where("kind IS NOT NULL")
    return B.source_weights(e.select((F.col("user_id") % 10).cast("string").alias("source"), F.col("value").alias("score"), (F.col("event_id") % 4).cast("int").alias("rank"), (F.col("kind") == "a").cast("int").alias("accepted"), "ts"))


@query(f"""
WITH {LINES}, a AS (SELECT doc_id AS query_id, lang, min(line) AS t FROM kl GROUP BY doc_id, lang), s AS (SELECT line, count(*) AS cnt FROM kl GROUP BY line),
g AS (SELECT query_id, lang, t AS truth, line AS text, row_number() OVER (PARTITION BY query_id ORDER BY cnt DESC, line) AS rnk FROM a JOIN s ON substr(t, 1, 5) = substr(line, 1, 5)),
q AS (SELECT lang, query_id, max(CASE WHEN starts_with(text, truth) AND rnk = 1 THEN 1 ELSE 0 END) AS h1, max(CASE WHEN starts_with(text, truth) THEN 1 ELSE 0 END) AS hk FROM g WHERE rnk <= 4 GROUP BY ALL)
SELECT lang, count(*) AS n, round(avg(h1), 9) AS hit1, round(avg(hk), 9) AS hitk FROM q GROUP BY lang
""")
def eval_hit_rates(spark, sf_dir):
    """How often the smallest line of a document is first, or among four, of the lines that begin with its five characters."""
    d = texts(spark, sf_dir)
    truth = L.kept_lines(d, "doc_id", "text", "lang").groupBy("doc_id", "lang").agg(F.min("line").alias("truth"))
    # Lines rank alike for every query with their five characters, so only the first four of those meet queries.
    idx = L.top(L.line_index(d).withColumn("g", F.substring("line", 1, 5)), ["g"], [F.desc("cnt"), F.col("line")], 4)
    ranked = truth.withColumn("g", F.substring("truth", 1, 5)).join(idx, "g").select(F.col("doc_id").alias("query_id"), "lang", "truth", F.col("line").alias("text"), "rnk")
    return R.hit_rates(ranked, "lang").withColumns({"hit1": F.round("hit1", 9), "hitk": F.round("hitk", 9)})


@query(f"WITH {INDEX} SELECT 'documents' AS name, (SELECT count(*) FROM docs) AS n UNION ALL SELECT 'line_index', (SELECT count(*) FROM idx) UNION ALL SELECT 'lines', (SELECT count(*) FROM kl)")
def stats(spark, sf_dir):
    """Sizes of tables."""
    d = texts(spark, sf_dir)
    return T.table_sizes(documents=d, line_index=L.line_index(d), lines=L.kept_lines(d))
