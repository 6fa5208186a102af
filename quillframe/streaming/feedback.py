"""Feedback events: what was shown and then accepted, and accept rates over time."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillframe.operators.feedback import accept_rates


def shown_then_learned(shown: DataFrame, learned: DataFrame, keys: list[str], within: str = "2 minutes", late: str = "2 minutes") -> DataFrame:
    """Pairs of shown and learn events with equal keys, the second at most ``within`` after the first.

    A stream-stream interval join: both sides' watermarks and the interval bound
    its state. One shown row may pair with several events; keep the first of
    each where the pairs are stored.
    """
    s = shown.withWatermark("ts", late).select(*[F.col(k).alias(f"s_{k}") for k in keys], "shown_id", F.col("ts").alias("s_ts"))
    e = learned.withWatermark("ts", late).select(*keys, "event_id", F.col("ts").alias("e_ts"))
    same = F.expr(" AND ".join(f"s_{k} = {k}" for k in keys) + f" AND e_ts >= s_ts AND e_ts <= s_ts + INTERVAL {within}")
    return s.join(e, same).select(*keys, "shown_id", "event_id", "s_ts", "e_ts")


def rates(events: DataFrame, ts: str = "ts", kind: str = "kind", width: str = "1 day", late: str = "2 minutes") -> DataFrame:
    """Accept rates of tumbling windows; rows later than the watermark are dropped."""
    return accept_rates(events.withWatermark(ts, late), ts, kind, width)


def suppressed_requests(requests: DataFrame, rejects: DataFrame, keys: list[str], within: str = "5 minutes", late: str = "2 minutes", factor: float = 0.4) -> DataFrame:
    """(request_id, factor): requests (keys.., request_id, ts) that have the same keys as a reject (keys.., ts) at most ``within`` before.

    A stream-stream interval join, whose state goes with the watermark: that is
    how long a reject is remembered.
    """
    q = requests.withWatermark("ts", late).select(*[F.col(k).alias(f"q_{k}") for k in keys], "request_id", F.col("ts").alias("q_ts"))
    r = rejects.withWatermark("ts", late).select(*keys, F.col("ts").alias("r_ts"))
    same = F.expr(" AND ".join(f"q_{k} = {k}" for k in keys) + f" AND q_ts >= r_ts AND q_ts <= r_ts + INTERVAL {within}")
    return q.join(r, same).select("request_id", F.lit(factor).alias("factor"), "q_ts")


def live_rules(uses: DataFrame, keys: list[str], ttl: str = "45 minutes", late: str = "2 minutes") -> DataFrame:
    """(keys.., start, end): how long edit rules live: from their first use until ``ttl`` after the last, where each use in between prolongs them."""
    w = F.session_window("ts", ttl)
    return uses.withWatermark("ts", late).groupBy(*keys, w.alias("w")).agg(F.count("*").alias("n")).select(*keys, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def replay(spark, folder: str) -> DataFrame:
    """A stream of the feedback events of JSON lines files in ``folder``; with a checkpoint each is read once, and a new one reads all again."""
    from quillframe.sources.corpus import JOURNAL, valid_events

    return valid_events(spark.readStream.schema(JOURNAL).option("columnNameOfCorruptRecord", "_bad").json(folder))
