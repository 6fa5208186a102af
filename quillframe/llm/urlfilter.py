"""URL filter: host and path rules, then the ratio of two character language models.

Native: DataFrame functions only. Accepted and rejected URLs each have a
variable-order Markov model (Witten-Bell smoothing from contexts of three
characters down to none). A URL that no rule decides is kept if the
length-normalised difference of its two log-likelihoods reaches a threshold that
is calibrated on labelled URLs the models have not seen.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillframe.shared import materialize

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: (verdict, host, path): rules of the query.
RULES = [
    ("block", "com", "/en/"),
    ("allow", "example.com", "/en/7"),
    ("allow", "net", "/de/"),
    ("block", "example.net", "/de/8"),
    ("block", "org", "/es/"),
]
ORDER = 3


def host_of(url: Column) -> Column:
    """What follows the first ``://`` up to ``/``, ``?``, ``#`` or the end; A-Z lower-cased; else empty."""
    return F.coalesce(F.translate(F.regexp_extract(_after(url), r"^[^/?#]*", 0), UPPER, LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end; else empty."""
    return F.coalesce(F.regexp_extract(_after(url), r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def _after(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, F.substring(url, at + 3, F.length(url)))


def rule_columns(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits host or parent domain and path start; null if none."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for what, h, p in sorted(rules, key=lambda r: (len(r[1]) + len(r[2]), r[1], r[2])):
        fits = ((host == h) | F.endswith(host, F.lit("." + h))) & F.startswith(path, F.lit(p))
        rule, verdict = F.when(fits, F.lit(h + p)).otherwise(rule), F.when(fits, F.lit(what)).otherwise(verdict)
    return rule, verdict


def filter_urls(pages: DataFrame, *, page_id: str = "page_id", url: str = "url", rules=RULES) -> DataFrame:
    """(page_id, host, path, rule, verdict, llr) for every row.

    Rules label URLs for the models: four fifths of them by a hash of the URL
    train, the others calibrate. The threshold lies between the class means of
    the normalised difference, in proportion to the class deviations; it is 0 if
    a class has no calibration URL. Without any URL of a class every undecided
    URL is allowed. A null URL is scored as an empty one; repeated rows, null
    and repeated ids are kept. Other columns are ignored.
    """
    host, path = host_of(F.col("url")), path_of(F.col("url"))
    rule, decided = rule_columns(F.col("host"), F.col("path"), rules)
    rows = (
        pages.select(F.col(page_id).alias("page_id"), F.col(url).alias("url"))
        .withColumn("rid", F.monotonically_increasing_id())
        .withColumns({"host": host, "path": path})
        .withColumns({"rule": rule, "decided": decided})
        .withColumn("part", F.pmod(F.crc32(F.coalesce(F.col("url"), F.lit("")).cast("binary")), F.lit(5)))
    )
    rows = materialize(rows, "urls")
    text = F.concat(F.lit("\u0002" * ORDER), F.coalesce("url", F.lit("")), F.lit("\u0003"))
    grams = (
        rows.withColumn("x", text)
        .select("rid", "decided", "part", F.explode(F.expr(f"transform(sequence(1, length(x) - {ORDER}), i -> substr(x, i, {ORDER + 1}))")).alias("g"))
    )
    train = lambda what: F.count_if((F.col("part") != 0) & (F.col("decided") == what))
    counts = materialize(grams.groupBy("g").agg(train("allow").alias("na"), train("block").alias("nr")), "grams")
    # As a table its size is known: a small model is broadcast, and no character is shuffled; else frequent runs can be split.
    scored = materialize(_log_ratio(counts), "ratios")
    by_row = grams.select("rid", "g").join(scored, "g").groupBy("rid").agg((F.sum("lr") / F.count("*")).alias("llr"))
    out = materialize(rows.select("rid", "page_id", "host", "path", "rule", "decided", "part").join(by_row, "rid"), "scored")
    of = lambda what: (F.col("part") == 0) & (F.col("decided") == what)
    stats = out.agg(*[f(F.when(of(w), F.col("llr"))).alias(n + w) for n, f in (("m", F.avg), ("s", F.stddev_pop)) for w in ("allow", "block")])
    spread = F.col("sallow") + F.col("sblock")
    middle = F.when(spread > 0, (F.col("mallow") * F.col("sblock") + F.col("mblock") * F.col("sallow")) / spread).otherwise((F.col("mallow") + F.col("mblock")) / 2)
    limit = stats.select(F.coalesce(middle, F.lit(0.0)).alias("threshold")).head()[0]  # one number
    verdict = F.coalesce("decided", F.when(F.round("llr", 9) >= F.round(F.lit(limit), 9), "allow").otherwise("block"))
    return out.select("page_id", "host", "path", "rule", verdict.alias("verdict"), F.round("llr", 6).alias("llr"))


def _log_ratio(counts: DataFrame) -> DataFrame:
    """(g, lr): log P(last character | those before) of accepted minus that of rejected URLs."""
    kinds = counts.select(F.substring("g", ORDER + 1, 1).alias("c")).distinct().agg((1.0 / (F.count("*") + 1.0)).alias("uniform"))
    out = counts.select("g").crossJoin(kinds).withColumns({"pa": F.col("uniform"), "pr": F.col("uniform")})
    for k in range(ORDER + 1):
        sfx = F.substring("g", ORDER + 1 - k, k + 1)
        seen = counts.groupBy(sfx.alias("sfx")).agg(F.sum("na").alias("ca"), F.sum("nr").alias("cr"))
        ctx = seen.groupBy(F.expr(f"substr(sfx, 1, {k})").alias("ctx")).agg(
            F.sum("ca").alias("ta"), F.sum("cr").alias("tr"), F.count_if(F.col("ca") > 0).alias("da"), F.count_if(F.col("cr") > 0).alias("dr")
        )
        out = out.withColumns({"sfx": sfx, "ctx": F.expr(f"substr(g, {ORDER + 1 - k}, {k})")}).join(seen, "sfx").join(ctx, "ctx")
        step = lambda c, d, t, p: F.when(t > 0, (c + d * p) / (t + d)).otherwise(p)
        pa = step(F.col("ca"), F.col("da"), F.col("ta"), F.col("pa"))
        pr = step(F.col("cr"), F.col("dr"), F.col("tr"), F.col("pr"))
        out = out.withColumns({"pa": pa, "pr": pr}).select("g", "pa", "pr")
    empty = counts.agg((F.sum("na") > 0).alias("a"), (F.sum("nr") > 0).alias("r"))
    return out.crossJoin(empty).select("g", F.when(F.col("a") & F.col("r"), F.log("pa") - F.log("pr")).otherwise(0.0).alias("lr"))


def query(spark, sf_dir: str) -> DataFrame:
    """Verdict on every page's URL."""
    return filter_urls(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")).drop("llr")


def _oracle() -> str:
    ranks = sorted(RULES, key=lambda r: -(len(r[1]) + len(r[2])))
    fits = [f"((host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}'))" for _, h, p in ranks]
    rule = "CASE " + " ".join(f"WHEN {f} THEN '{h + p}'" for f, (_, h, p) in zip(fits, ranks)) + " END"
    decided = "CASE " + " ".join(f"WHEN {f} THEN '{v}'" for f, (v, _, _) in zip(fits, ranks)) + " END"
    steps, prev = [], "SELECT g, u AS pa, u AS pr FROM counts, (SELECT 1.0::DOUBLE / (count(DISTINCT substr(g, 4, 1)) + 1.0) AS u FROM counts)"
    steps.append(f"p_ AS ({prev})")
    last = "p_"
    for k in range(ORDER + 1):
        steps.append(f"s{k} AS (SELECT substr(g, {4 - k}, {k + 1}) AS sfx, sum(na) AS ca, sum(nr) AS cr FROM counts GROUP BY 1)")
        steps.append(
            f"c{k} AS (SELECT substr(sfx, 1, {k}) AS ctx, sum(ca) AS ta, sum(cr) AS tr, count(*) FILTER (ca > 0) AS da, count(*) FILTER (cr > 0) AS dr FROM s{k} GROUP BY 1)"
        )
        steps.append(
            f"p{k} AS (SELECT p.g, CASE WHEN ta > 0 THEN (ca + da * pa) / (ta + da)::DOUBLE ELSE pa END AS pa, CASE WHEN tr > 0 THEN (cr + dr * pr) / (tr + dr)::DOUBLE ELSE pr END AS pr "
            f"FROM {last} p JOIN s{k} ON sfx = substr(g, {4 - k}, {k + 1}) JOIN c{k} ON ctx = substr(g, {4 - k}, {k}))"
        )
        last = f"p{k}"
    return f"""
WITH RECURSIVE crc_table AS (
  SELECT n, list_reduce(list_prepend(n::UBIGINT, range(8)::UBIGINT[]), lambda a, x: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384::UBIGINT) ELSE a >> 1 END) AS t FROM (SELECT unnest(range(256)) AS n)
), tab AS (SELECT list(t ORDER BY n) AS ts FROM crc_table),
urls AS MATERIALIZED (
  SELECT row_number() OVER () AS rid, page_id, coalesce(url, '') AS url, instr(url, '://') AS pos FROM pages
), parts AS (
  SELECT rid, page_id, url, CASE WHEN pos > 0 THEN translate(regexp_extract(substr(url, pos + 3), '^[^/?#]*'), '{UPPER}', '{LOWER}') ELSE '' END AS host,
    CASE WHEN pos > 0 THEN regexp_extract(substr(url, pos + 3), '^[^/?#]*([^?#]*)', 1) ELSE '' END AS path FROM urls
), bytes AS (
  SELECT rid, list_transform(range(0, octet_length(encode(url)) * 2, 2), lambda i: ('0x' || substr(hex(encode(url)), (i + 1)::BIGINT, 2))::UBIGINT) AS bs FROM urls
), crcs AS (
  SELECT rid, xor(list_reduce(list_prepend(4294967295::UBIGINT, bs), lambda a, x: xor(a >> 8, ts[(xor(a, x) & 255)::BIGINT + 1])), 4294967295::UBIGINT) % 5 AS part FROM bytes, tab
), base AS MATERIALIZED (
  SELECT p.*, {rule} AS rule, {decided} AS decided, part, repeat(chr(2), 3) || url || chr(3) AS x FROM parts p JOIN crcs USING (rid)
), grams AS (
  SELECT rid, decided, part, substr(x, i, 4) AS g FROM (SELECT rid, decided, part, x, unnest(range(1, length(x) - 2)) AS i FROM base)
), counts AS (
  SELECT g, count(*) FILTER (part <> 0 AND decided = 'allow') AS na, count(*) FILTER (part <> 0 AND decided = 'block') AS nr FROM grams GROUP BY g
), {", ".join(steps)},
lr AS (SELECT g, CASE WHEN a AND r THEN ln(pa) - ln(pr) ELSE 0 END AS lr FROM {last}, (SELECT sum(na) > 0 AS a, sum(nr) > 0 AS r FROM counts)),
sc AS (SELECT rid, sum(lr) / count(*) AS llr FROM grams JOIN lr USING (g) GROUP BY rid),
al AS (SELECT b.*, llr FROM base b JOIN sc USING (rid)),
st AS (SELECT avg(llr) FILTER (part = 0 AND decided = 'allow') AS ma, avg(llr) FILTER (part = 0 AND decided = 'block') AS mr,
  stddev_pop(llr) FILTER (part = 0 AND decided = 'allow') AS sa, stddev_pop(llr) FILTER (part = 0 AND decided = 'block') AS sr FROM al),
th AS (SELECT coalesce(CASE WHEN sa + sr > 0 THEN (ma * sr + mr * sa) / (sa + sr) ELSE (ma + mr) / 2 END, 0) AS limit_ FROM st)
SELECT page_id, host, path, rule, coalesce(decided, CASE WHEN round(llr, 9) >= round(limit_, 9) THEN 'allow' ELSE 'block' END) AS verdict FROM al, th
"""


ORACLE_SQL = _oracle()
