"""Mixing sources to target weights by hierarchical budgets.

Native: DataFrame functions only. A token budget runs down a tree (domain,
language, source): each node's budget is shared among its children by weight,
no child gets more than its subtree can give in ``max_epochs`` passes, and what
a child cannot take goes to its siblings first. Since a node's budget never
exceeds its subtree's capacity, an ancestor only redistributes what a whole
subtree lacks. Each leaf is then read in seeded orders, whole epochs first, up
to the exact token of its budget.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillframe.shared import materialize

WORD = r"[^ \t\n\r\f]+"
DOMAIN_WEIGHTS = {"d0": 4, "d1": 3, "d2": 2, "d3": 1}
LANG_WEIGHTS = {"en": 5, "de": 2, "fr": 2, "es": 1}
SHARE, EPOCHS, SEED = 60, 2, 11
BUCKET_ROWS = 4096


def whole(c) -> Column:
    return c.cast("decimal(38,0)")


def water_fill(nodes: DataFrame, parents: Sequence[str], name: str) -> DataFrame:
    """Adds ``budget``: the share of ``parent_budget`` of each child with ``weight`` and ``cap``, in whole tokens.

    Children are taken by cap / weight; those that the level reaches get their
    cap, the others share the rest by weight, rounded down, and what that leaves
    goes, a token each, to those with the largest remainders.
    """
    by = Window.partitionBy(*parents) if parents else Window.partitionBy(F.lit(0))
    rank = by.orderBy(F.expr("CAST(cap AS DECIMAL(38,0)) * 1000000 div weight"), name)
    x = (
        nodes.where("weight > 0")
        .withColumn("cap_before", F.sum("cap").over(rank.rowsBetween(Window.unboundedPreceding, -1)))
        .withColumn("weight_after", F.sum("weight").over(rank.rowsBetween(0, Window.unboundedFollowing)))
        .withColumn("cap_before", F.coalesce("cap_before", F.lit(0)).cast("long"))
        .withColumn("sated", F.expr("CAST(cap AS DECIMAL(38,0)) * weight_after <= CAST(parent_budget - cap_before AS DECIMAL(38,0)) * weight"))
        .withColumn("taken", F.sum(F.when(F.col("sated"), F.col("cap")).otherwise(0)).over(by))
        .withColumn("open_weight", F.sum(F.when(F.col("sated"), 0).otherwise(F.col("weight"))).over(by))
    )
    part = "CAST(parent_budget - taken AS DECIMAL(38,0)) * weight"
    x = x.withColumn("share", F.when(F.col("sated"), F.col("cap")).otherwise(F.expr(f"CAST({part} div open_weight AS BIGINT)")))
    x = x.withColumn("remainder", F.when(F.col("sated"), F.lit(-1)).otherwise(F.expr(f"CAST({part} % open_weight AS BIGINT)")))
    x = x.withColumn("left", F.col("parent_budget") - F.sum("share").over(by))
    # A child that the level does not reach has room for one more.
    more = ~F.col("sated") & (F.row_number().over(by.orderBy(F.desc("remainder"), name)) <= F.col("left"))
    x = x.withColumn("budget", F.col("share") + more.cast("long"))
    return x.drop("cap_before", "weight_after", "sated", "taken", "open_weight", "share", "remainder", "left")


def leaf_budgets(leaves: DataFrame, levels: Sequence[str], weights: Sequence[Column], total: Column | int, max_epochs: int) -> DataFrame:
    """(levels..., tokens, rows, budget) from (levels..., tokens, rows); ``weights`` has a whole-number column for each level."""
    base = leaves.withColumn("cap", (F.col("tokens") * max_epochs).cast("long"))
    root = base.agg(F.coalesce(F.sum("cap"), F.lit(0)).cast("long").alias("root_cap"))
    root = root.select(F.least("root_cap", (total if isinstance(total, Column) else F.lit(total)).cast("long")).alias("parent_budget"))
    above: DataFrame = root
    for k, level in enumerate(levels):
        nodes = base.groupBy(*levels[: k + 1]).agg(F.sum("cap").cast("long").alias("cap")).withColumn("weight", weights[k].cast("long"))
        nodes = nodes.join(above, list(levels[:k])) if k else nodes.crossJoin(above)
        above = water_fill(nodes, levels[:k], level).select(*levels[: k + 1], F.col("budget").alias("parent_budget"))
    return leaves.join(above, list(levels)).withColumnRenamed("parent_budget", "budget")


def mix(
    docs: DataFrame, levels: Sequence[str], weights: Sequence[Column], *, doc_id: str = "doc_id", tokens: str = "n_tokens", share: int = SHARE, max_epochs: int = EPOCHS, seed: int = SEED
) -> DataFrame:
    """Rows of ``docs`` that the budget reaches, with ``epochs_taken`` and ``prefix_tokens``.

    The budget is ``share`` per cent of all tokens. ``epochs_taken`` counts whole
    passes over the row's leaf; ``prefix_tokens`` are the row's first tokens taken
    in the pass after those, in the order of a seeded hash of the id. Rows of
    no tokens are never taken. ``levels`` must not be null. Rows without id are
    placed by their number of tokens; of rows that share id and number any may
    come first, as nothing that is returned tells them apart. The prefix of a leaf
    is found over hash buckets of about 4096 rows, so that a leaf with most of
    the rows is spread over many tasks.
    """
    leaves = docs.groupBy(*levels).agg(F.sum(tokens).cast("long").alias("tokens"), F.count("*").alias("rows"))
    leaves = materialize(leaves, "leaves")
    all_tokens = leaves.agg(F.coalesce(F.sum("tokens"), F.lit(0)).cast("long")).head()[0]  # one number
    budgets = leaf_budgets(leaves, levels, weights, all_tokens * share // 100, max_epochs).where("tokens > 0")
    budgets = materialize(
        budgets.withColumns(
            {"_full": F.expr("budget div tokens"), "_part": F.expr("budget % tokens"), "_step": F.expr(f"1152921504606846976 div ((rows + {BUCKET_ROWS - 1}) div {BUCKET_ROWS}) + 1")}
        ).select(*levels, "_full", "_part", "_step"),
        "budgets",
    )
    key = F.concat_ws(":", F.lit(seed), F.col("_full"), F.coalesce(F.col(doc_id).cast("string"), F.concat(F.lit("null"), F.col(tokens))))
    rows = docs.where(F.col(tokens) > 0).join(budgets, list(levels))
    rows = rows.withColumn("_h", F.conv(F.substring(F.md5(key.cast("binary")), 1, 15), 16, 10).cast("long")).withColumn("_b", F.expr("_h div _step"))
    buckets = rows.groupBy(*levels, "_b").agg(F.sum(tokens).alias("_t"))
    order = Window.partitionBy(*levels).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    buckets = buckets.withColumn("_before", F.coalesce(F.sum("_t").over(order), F.lit(0))).drop("_t")
    inner = Window.partitionBy(*levels, "_b").orderBy("_h", F.col(doc_id), F.col(tokens)).rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.join(buckets, [*levels, "_b"]).withColumn("_before", F.col("_before") + F.coalesce(F.sum(tokens).over(inner), F.lit(0)))
    taken = F.greatest(F.least(F.col(tokens), F.col("_part") - F.col("_before")), F.lit(0))
    rows = rows.withColumns({"epochs_taken": F.col("_full"), "prefix_tokens": taken.cast("long")})
    return rows.where("epochs_taken > 0 OR prefix_tokens > 0").drop("_h", "_b", "_step", "_before", "_full", "_part")


def weight_of(column: str, table: dict[str, int]) -> Column:
    """Whole-number weight by value; 1 for values that the table lacks."""
    out = F.lit(1)
    for name, w in table.items():
        out = F.when(F.col(column) == name, w).otherwise(out)
    return out


def document_leaves(docs: DataFrame) -> DataFrame:
    """(doc_id, domain, lang, source, n_tokens): a source's domain is its number modulo 4, else ``other``."""
    source = F.coalesce("source", F.lit("(none)"))
    number = F.regexp_extract(source, r"^src([0-9]{1,9})$", 1)
    domain = F.when(number != "", F.concat(F.lit("d"), F.pmod(number.cast("int"), F.lit(4)).cast("string"))).otherwise("other")
    tokens = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")
    return docs.select("doc_id", domain.alias("domain"), F.coalesce("lang", F.lit("(none)")).alias("lang"), source.alias("source"), tokens.alias("n_tokens"))


def weights() -> list[Column]:
    return [weight_of("domain", DOMAIN_WEIGHTS), weight_of("lang", LANG_WEIGHTS), F.lit(1)]


def query(spark, sf_dir: str) -> DataFrame:
    """The documents that 60 % of all tokens take, by weights of domain, language and source."""
    docs = materialize(document_leaves(spark.read.parquet(f"{sf_dir}/documents.parquet")), "leaves_of_documents")
    return mix(docs, ["domain", "lang", "source"], weights()).select("doc_id", "domain", "lang", "source", "n_tokens", "epochs_taken", "prefix_tokens")


def oracle(docs_sql: str) -> str:
    """The same in SQL over a table (doc_id, domain, lang, source, n_tokens) given as a query."""
    case = lambda c, t: "CASE " + " ".join(f"WHEN {c} = '{k}' THEN {v}" for k, v in t.items()) + " ELSE 1 END"
    levels, out = ["domain", "lang", "source"], []
    w = [case("domain", DOMAIN_WEIGHTS), case("lang", LANG_WEIGHTS), "1"]
    out.append(f"d AS MATERIALIZED ({docs_sql})")
    out.append("leaves AS (SELECT domain, lang, source, sum(n_tokens)::HUGEINT AS tokens, count(*) AS nrows FROM d GROUP BY ALL)")
    out.append(f"b_ AS (SELECT least(sum(tokens) * {EPOCHS}, sum(tokens) * {SHARE} // 100)::HUGEINT AS pb FROM leaves)")
    for k, level in enumerate(levels):
        cols, parents = ", ".join(levels[: k + 1]), ", ".join(levels[:k])
        part = f"PARTITION BY {parents}" if k else ""
        join = f"JOIN b{k - 1} USING ({parents})" if k else "CROSS JOIN b_"
        out.append(f"n{k} AS (SELECT * FROM (SELECT {cols}, sum(tokens)::HUGEINT * {EPOCHS} AS cap, ({w[k]})::HUGEINT AS weight FROM leaves GROUP BY {cols}) {join})")
        rank = f"OVER ({part} ORDER BY cap * 1000000 // weight, {level}"
        out.append(
            f"r{k} AS (SELECT *, coalesce(sum(cap) {rank} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::HUGEINT AS cb, "
            f"sum(weight) {rank} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)::HUGEINT AS wa FROM n{k})"
        )
        out.append(f"t{k} AS (SELECT *, cap * wa <= (pb - cb) * weight AS sated FROM r{k})")
        of_open = lambda x, y: f"(sum(CASE WHEN sated THEN {x} ELSE {y} END) OVER ({part}))::HUGEINT"
        out.append(f"u{k} AS (SELECT *, (pb - {of_open('cap', '0')}) * weight AS due, greatest({of_open('0', 'weight')}, 1) AS ow FROM t{k})")
        out.append(f"v{k} AS (SELECT *, CASE WHEN sated THEN cap ELSE due // ow END AS share, CASE WHEN sated THEN -1 ELSE due % ow END AS rem FROM u{k})")
        more = f"NOT sated AND row_number() OVER ({part} ORDER BY rem DESC, {level}) <= pb - (sum(share) OVER ({part}))::HUGEINT"
        out.append(f"b{k} AS (SELECT {cols}, share + CASE WHEN {more} THEN 1 ELSE 0 END AS pb FROM v{k})")
    out.append("q AS (SELECT domain, lang, source, pb // tokens AS fullp, pb % tokens AS part FROM leaves JOIN b2 USING (domain, lang, source) WHERE tokens > 0)")
    out.append(
        f"o AS (SELECT d.*, fullp, part, ('0x' || substr(md5(concat_ws(':', '{SEED}', fullp::BIGINT::VARCHAR, coalesce(doc_id::VARCHAR, 'null' || n_tokens))), 1, 15))::BIGINT AS h "
        "FROM d JOIN q USING (domain, lang, source) WHERE n_tokens > 0)"
    )
    out.append("c AS (SELECT *, coalesce(sum(n_tokens) OVER (PARTITION BY domain, lang, source ORDER BY h, doc_id NULLS FIRST, n_tokens ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM o)")
    out.append("m AS (SELECT doc_id, domain, lang, source, n_tokens, fullp::BIGINT AS epochs_taken, greatest(least(n_tokens, part - before), 0)::BIGINT AS prefix_tokens FROM c)")
    return "WITH " + ",\n".join(out) + "\nSELECT * FROM m WHERE epochs_taken > 0 OR prefix_tokens > 0"


ORACLE_SQL = oracle(
    r"""SELECT doc_id, CASE WHEN regexp_matches(coalesce(source, '(none)'), '^src[0-9]{1,9}$') THEN 'd' || (regexp_extract(source, '^src([0-9]{1,9})$', 1)::INT % 4) ELSE 'other' END AS domain,
  coalesce(lang, '(none)') AS lang, coalesce(source, '(none)') AS source, coalesce(len(regexp_extract_all(text, '[^ \t\n\r\f]+')), 0)::BIGINT AS n_tokens FROM documents"""
)
