"""Evaluation on held-out documents, and tuning of source weights by it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillframe.functions import text as X
from quillframe.operators.lines import kept_lines, line_index, prefix_complete


def cuts(docs: DataFrame, *keep: str, key: str = "doc_id", text: str = "text", least_line: int = 8, least_start: int = 4, least_truth: int = 3) -> DataFrame:
    """(key, pos, keep.., prefix, truth): every line of at least ``least_line`` characters, cut once.

    The cut depends on the line's place and length alone, so runs are alike. A
    blank before the cut goes, as in lookups, so the truth may begin with it.
    """
    n = F.length("line")
    at = F.lit(least_start) + (F.col("pos") * 7 + n) % (n - least_start - least_truth + 1)
    lines = kept_lines(docs, key, text, *keep).where(n >= max(least_line, least_start + least_truth)).withColumn("_at", at)
    prefix = X.normalize(F.expr("substring(line, 1, _at)"))
    return lines.select(key, "pos", *keep, prefix.alias("prefix"), F.substring("line", F.length(prefix) + 1, n).alias("truth"))


def answers(cut: DataFrame, index: DataFrame, k: int = 4) -> DataFrame:
    """``cut`` with (text, rnk), null where nothing is suggested; each different prefix is looked up once."""
    asked = cut.select(F.col("prefix").alias("query_id"), "prefix").distinct()
    found = prefix_complete(asked, index, k=k).select(F.col("query_id").alias("prefix"), F.col("rest").alias("text"), "rnk")
    return cut.join(found, "prefix", "left")


def held_out_rates(docs: DataFrame, held_out: Column, by: str, key: str = "doc_id", text: str = "text", k: int = 4) -> DataFrame:
    """(by, n, hit1, hitk): how often the rest of a held-out line is first, or among ``k``, by an index of the other documents alone."""
    cut = cuts(docs.where(held_out), by, key=key, text=text)
    a = answers(cut, line_index(docs.where(~held_out), text), k)
    ok = F.coalesce(F.startswith("text", F.col("truth")), F.lit(False))
    one = a.groupBy(by, key, "pos").agg(F.max((ok & (F.col("rnk") == 1)).cast("int")).alias("h1"), F.max(ok.cast("int")).alias("hk"))
    return one.groupBy(by).agg(F.count("*").alias("n"), F.avg(F.coalesce("h1", F.lit(0))).alias("hit1"), F.avg("hk").alias("hitk"))


def hits_at_one(cands: DataFrame, trials: list[dict[str, float]]) -> list[float]:
    """Share of queries of (query_id, text, source, score, truth) whose best text starts with the truth, for each trial's weights of sources.

    All trials run in one job; only a number for each comes back. Ties go by text.
    """
    def weight(trial: dict[str, float]) -> Column:
        out = F.when(F.lit(False), F.lit(1.0))
        for source, w in sorted(trial.items()):
            out = out.when(F.col("source") == source, F.lit(float(w)))
        return out.otherwise(1.0)

    each = cands.select("query_id", "text", "score", "truth", F.posexplode(F.array(*[weight(t) for t in trials])).alias("trial", "w"))
    best = each.groupBy("trial", "query_id").agg(F.min(F.struct((-F.col("score") * F.col("w")).alias("s"), "text", "truth")).alias("b"))
    rates = best.groupBy("trial").agg(F.avg(F.startswith("b.text", F.col("b.truth")).cast("int")).alias("rate")).collect()
    by = {r["trial"]: r["rate"] or 0.0 for r in rates}
    return [by.get(i, 0.0) for i in range(len(trials))]


def tune(cands: DataFrame, knobs: dict[str, list[float]], rounds: int = 2) -> tuple[dict[str, float], float]:
    """(weights, rate): coordinate descent over the sources' values in ``knobs``, from 1 for each.

    A value is taken only if it is better than what holds, so the result is never
    worse than the defaults. One job for each source and round.
    """
    weights = dict.fromkeys(knobs, 1.0)
    (rate,) = hits_at_one(cands, [weights])
    for _ in range(rounds):
        before = rate
        for source, values in knobs.items():
            trials = [weights | {source: v} for v in values]
            got = hits_at_one(cands, trials)
            if got and max(got) > rate:
                rate = max(got)
                weights = trials[got.index(rate)]
        if rate == before:
            break
    return weights, rate


def percentiles(rows: DataFrame, by: str, value: str, shares: tuple[int, ...] = (50, 95)) -> DataFrame:
    """(by, n, p50, p95): the value at place n * share // 100, from 0, of each group in rising order; nulls do not count.

    Values are counted first, so a group is a running sum over its different values.
    """
    c = rows.where(F.col(value).isNotNull()).groupBy(by, value).agg(F.count("*").alias("c"))
    w = Window.partitionBy(by)
    run = c.withColumns({"n": F.sum("c").over(w), "upto": F.sum("c").over(w.orderBy(value))})
    picks = [F.min(F.when(F.col("upto") > F.expr(f"n * {s} div 100"), F.col(value))).alias(f"p{s}") for s in shares]
    return run.groupBy(by, "n").agg(*picks)
