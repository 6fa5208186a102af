"""Accept and reject events: matching, logistic trainers, calibration."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillframe.shared import ship


def matched_accepts(shown: DataFrame, learned: DataFrame, keys: Sequence[str], within: str = "2 minutes") -> DataFrame:
    """(keys.., shown_id, event_id, gap in whole seconds): for each learn event the latest row shown before it, at most ``within`` ago; a shown row serves one event.

    Both sides are one sequence by time, in which each event looks back to the
    last row shown, so a user with very many rows costs no more than a sort. Of
    the events that a shown row could serve the first takes it.
    """
    s = shown.select(*keys, F.col("ts"), F.lit(0).alias("k"), "shown_id", F.lit(None).cast(learned.schema["event_id"].dataType).alias("event_id"))
    e = learned.select(*keys, F.col("ts"), F.lit(1).alias("k"), F.lit(None).cast(shown.schema["shown_id"].dataType).alias("shown_id"), "event_id")
    back = Window.partitionBy(*keys).orderBy("ts", "k", "shown_id").rowsBetween(Window.unboundedPreceding, 0)
    last = F.last(F.when(F.col("k") == 0, F.struct(F.col("ts").alias("s_ts"), "shown_id")), ignorenulls=True).over(back)
    hit = s.unionByName(e).withColumn("m", last).where("k = 1 AND m IS NOT NULL").select(*keys, "m.shown_id", "event_id", "m.s_ts", F.col("ts").alias("e_ts"))
    hit = hit.where(F.col("e_ts") <= F.col("s_ts") + F.expr(f"INTERVAL {within}"))
    one = hit.withColumn("r", F.row_number().over(Window.partitionBy(*keys, "shown_id").orderBy("e_ts", "event_id"))).where("r = 1")
    return one.select(*keys, "shown_id", "event_id", F.expr("timestampdiff(SECOND, s_ts, e_ts)").alias("gap"))


def suppressed(shown: DataFrame, rejects: DataFrame, keys: Sequence[str], within: str = "5 minutes", factor: float = 0.4) -> DataFrame:
    """``shown`` (keys.., ts, score, ..) with the score times ``factor`` where the same keys were rejected (keys.., ts) at most ``within`` before; null keys match nothing."""
    other = [c for c in shown.columns if c not in (*keys, "ts")]
    s = shown.select(*keys, "ts", *other, F.lit(1).alias("_k"))
    r = rejects.select(*keys, "ts", *[F.lit(None).cast(shown.schema[c].dataType).alias(c) for c in other], F.lit(0).alias("_k"))
    back = Window.partitionBy(*keys).orderBy("ts", "_k").rowsBetween(Window.unboundedPreceding, 0)
    at = F.last(F.when(F.col("_k") == 0, F.col("ts")), ignorenulls=True).over(back)
    given = F.lit(True)
    for k in keys:
        given = given & F.col(k).isNotNull()
    recent = given & F.col("_at").isNotNull() & (F.col("ts") <= F.col("_at") + F.expr(f"INTERVAL {within}"))
    out = s.unionByName(r).withColumn("_at", at).where("_k = 1")
    return out.withColumn("score", F.col("score") * F.when(recent, factor).otherwise(1.0)).select(*shown.columns)


def _with_place(events: DataFrame, ts: str, key: str, amount, falling: bool = False) -> DataFrame:
    """``events`` with ``_before``: the sum of ``amount`` over all that come before by ``ts`` and ``key``, by hours and then within each, so that no task sorts everything."""
    by = F.desc if falling else F.col
    rows = events.withColumns({"_h": F.date_trunc("hour", ts), "_a": amount})
    hours = rows.groupBy("_h").agg(F.sum("_a").alias("_t"))
    w = Window.orderBy(by("_h")).rowsBetween(Window.unboundedPreceding, -1)  # a row for each hour
    hours = hours.select("_h", F.coalesce(F.sum("_t").over(w), F.lit(0)).alias("_upto"))
    inner = Window.partitionBy("_h").orderBy(by(ts), by(key)).rowsBetween(Window.unboundedPreceding, -1)
    return rows.join(hours, "_h").withColumn("_before", F.col("_upto") + F.coalesce(F.sum("_a").over(inner), F.lit(0))).drop("_h", "_upto")


def newest_bytes(journal: DataFrame, ts: str, key: str, size, most: int) -> DataFrame:
    """The newest rows of a journal whose sizes add up to at most ``most``; what a compaction keeps. Rows without ``ts`` are left out."""
    rows = _with_place(journal.where(F.col(ts).isNotNull()), ts, key, size.cast("long"), falling=True)
    return rows.where(F.col("_before") + F.col("_a") <= most).drop("_before", "_a")


def floor_after(events: DataFrame, ts: str, key: str, floor: float = 0.02, block: int = 256) -> DataFrame:
    """(floor): ``tuned_floor`` over all (ts, key, accepted) in that order; blocks are grouped sums, and only the few blocks' shares are folded."""
    rows = _with_place(events, ts, key, F.lit(1).cast("long")).withColumn("b", F.expr(f"_before div {block}"))
    share = rows.groupBy("b").agg(F.count("*").alias("n"), F.avg(F.col("accepted").cast("double")).alias("s")).where(F.col("n") == block)
    shares = share.agg(F.array_sort(F.collect_list(F.struct("b", "s"))).alias("x"))  # one number for each block
    low, high = lambda a: F.least(F.lit(0.08), a * 1.2), lambda a: F.greatest(F.lit(0.008), a / 1.2)
    return shares.select(F.aggregate("x", F.lit(floor), lambda a, v: F.when(v["s"] < 0.1, low(a)).when(v["s"] > 0.5, high(a)).otherwise(a)).alias("floor"))


def calibrator(journal: DataFrame, least: int = 256, newest: int = 100_000, few: int = 32, epochs: int = 500, rate: float = 0.05, l2: float = 1e-4) -> DataFrame:
    """(name, weight) from (source, score, rank, length, multi, accepted, ts): log-odds of acceptance by source, score, rank, length and number of lines.

    Trains on the ``newest`` events, which bounds the only task. Sources with
    fewer than ``few`` events have no weight of their own; those of sources are
    held back four times as hard. With fewer than ``least`` events, or no frequent
    source, there are no rows.
    """
    ship(journal.sparkSession)

    def train(pdf: pd.DataFrame) -> pd.DataFrame:
        counts = pdf["source"].value_counts()
        names = sorted(counts[counts >= few].index)
        if len(pdf) < least or not names:
            return pd.DataFrame({"name": pd.Series([], dtype=str), "weight": pd.Series([], dtype=float)})
        pdf = pdf.sort_values(["ts", "source", "score"])
        hot = (pdf["source"].to_numpy()[:, None] == np.array(names)[None, :]).astype(float)
        other = [np.log1p(np.maximum(pdf["score"], 0)) / 10, pdf["rank"], np.log1p(np.maximum(pdf["length"], 0)) / 5, pdf["multi"].astype(float)]
        x = np.column_stack([np.ones(len(pdf)), hot, *other])
        y, w = pdf["accepted"].to_numpy(float), np.zeros(1 + len(names) + 4)
        hold = np.full(len(w), l2)
        hold[1 : 1 + len(names)] *= 4
        for _ in range(epochs):
            p = 1 / (1 + np.exp(-np.clip(x @ w, -60, 60)))
            w -= rate * (x.T @ (p - y) / len(y) + hold * w)
        return pd.DataFrame({"name": ["(bias)", *names, "(score)", "(rank)", "(length)", "(multi)"], "weight": w})

    recent = journal.orderBy(F.desc("ts")).limit(newest).withColumn("_g", F.lit(1))
    return recent.groupBy("_g").applyInPandas(train, "name string, weight double")


def accept_rates(events: DataFrame, ts: str, kind: str, width: str = "1 day") -> DataFrame:
    """(start, acc, rej, rate) of tumbling windows; with a watermark set on ``events`` it also streams."""
    c = events.groupBy(F.window(ts, width).alias("w")).agg(F.count_if(F.col(kind) == "a").alias("acc"), F.count_if(F.col(kind) == "r").alias("rej"))
    n = F.col("acc") + F.col("rej")
    return c.select(F.col("w.start").alias("start"), "acc", "rej", F.when(n > 0, F.col("acc") / n).alias("rate"))


def logistic(x: np.ndarray, y: np.ndarray, epochs: int, rate: float, l2: float = 0.0) -> np.ndarray:
    """Full-batch gradient descent with fixed steps; the last weight is the intercept."""
    x = np.column_stack([x, np.ones(len(x))])
    w = np.zeros(x.shape[1])
    for _ in range(epochs):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -60, 60)))
        w -= rate * (x.T @ (p - y) / max(1, len(y)) + l2 * w)
    return w


def source_weights(journal: DataFrame, least: int = 256, newest: int = 100_000, few: int = 32) -> DataFrame:
    """(source, weight) from (source, score, rank, accepted, ts): relative odds of each source at equal score and rank.

    Trains on the ``newest`` events, which bounds the only task; with fewer than
    ``least`` there are no rows, and a source with fewer than ``few`` has weight 1.
    """
    ship(journal.sparkSession)

    def train(pdf: pd.DataFrame) -> pd.DataFrame:
        if len(pdf) < least:
            return pd.DataFrame({"source": pd.Series([], dtype=str), "weight": pd.Series([], dtype=float)})
        pdf = pdf.sort_values(["ts", "source", "score"])
        names = sorted(pdf["source"].unique())
        hot = (pdf["source"].to_numpy()[:, None] == np.array(names)[None, :]).astype(float)
        x = np.column_stack([hot, np.log1p(np.maximum(pdf["score"], 0)) / 10, pdf["rank"]])
        w = logistic(x, pdf["accepted"].to_numpy(float), 400, 0.05)[: len(names)]
        out = np.where(hot.sum(0) < few, 1.0, np.exp(w - w.max()))
        return pd.DataFrame({"source": names, "weight": np.clip(out, 0.25, 4.0)})

    recent = journal.orderBy(F.desc("ts")).limit(newest).withColumn("_g", F.lit(1))
    return recent.groupBy("_g").applyInPandas(train, "source string, weight double")


def online_ranker(journal: DataFrame, features: int, rate: float = 0.06, l2: float = 1e-5, epochs: int = 6, newest: int = 100_000) -> DataFrame:
    """(i, weight): stochastic gradient descent over (f array<double>, accepted, ts) in time order, over the newest events."""

    def train(pdf: pd.DataFrame) -> pd.DataFrame:
        w = np.zeros(features)
        pdf = pdf.sort_values("ts")
        for _ in range(epochs):
            for f, y in zip(pdf["f"], pdf["accepted"]):
                x = np.zeros(features)
                x[: min(features, len(f))] = list(f)[:features]
                p = 1 / (1 + np.exp(-np.clip(w @ x, -60, 60)))
                w -= rate * ((p - float(y)) * x + l2 * w)
        return pd.DataFrame({"i": np.arange(features), "weight": w})

    return journal.orderBy(F.desc("ts")).limit(newest).withColumn("_g", F.lit(1)).groupBy("_g").applyInPandas(train, "i int, weight double")


def calibrated_boost(logit, intercept: float, low: float = 0.4, high: float = 2.5):
    """How much likelier than by the intercept alone, within bounds."""
    own, base = 1 / (1 + F.exp(-logit)), 1 / (1 + F.exp(F.lit(-intercept)))
    return F.least(F.greatest(own / base, F.lit(low)), F.lit(high))


def tuned_floor(outcomes: Sequence[bool], floor: float = 0.02, block: int = 256) -> float:
    """The model's probability floor after these accept outcomes: raised by a fifth after blocks below 10 %, lowered after those above 50 %."""
    for a in range(0, len(outcomes) - block + 1, block):
        share = sum(outcomes[a : a + block]) / block
        if share < 0.1:
            floor = min(0.08, floor * 1.2)
        elif share > 0.5:
            floor = max(0.008, floor / 1.2)
    return floor


def deleted_interpolation(hits: DataFrame, least: int = 64) -> DataFrame:
    """(n, lam) from held-out (n, direct, gamma_lower): how far each order's own evidence goes beyond its back-off.

    Orders with fewer than ``least`` positions have 1; the others are clipped to
    0.25 to 4 and divided by their geometric mean.
    """
    c = hits.groupBy("n").agg(F.count("*").alias("c"), F.avg(F.col("gamma_lower") / (F.col("direct") + F.col("gamma_lower"))).alias("beta"), F.avg("gamma_lower").alias("g"))
    raw = c.select("n", F.when((F.col("c") >= least) & (F.col("g") > 0), F.least(F.greatest(F.col("beta") / F.col("g"), F.lit(0.25)), F.lit(4.0))).otherwise(1.0).alias("l"))
    mean = raw.agg(F.exp(F.avg(F.log("l"))).alias("m"))
    return raw.crossJoin(F.broadcast(mean)).select("n", (F.col("l") / F.col("m")).alias("lam"))  # mean is one row
