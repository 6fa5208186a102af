"""Connected components by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillframe.shared import materialize_counted, release


def connected_components(edges: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 60) -> DataFrame:
    """(node, component) for every node of an edge, ``component`` the smallest node that it reaches.

    Every step is a grouped minimum and a join, so that a node with very many
    edges is pre-aggregated before it is shuffled. A round is one job: its edges
    are written to the shared folder, their count and checksum observed on the
    way, and those of the round before deleted. Loops, nulls and repeated edges
    are allowed; no edges give no rows.
    """
    e = (
        edges.where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b)))
        .select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"))
        .distinct()
    )
    e, before = _written(e)
    for _ in range(max_rounds):
        if before["rows"] == 0:
            break
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("low")).select("u", F.least("u", "low").alias("low"))
        large = both.join(low, "u").where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("low").alias("v")).distinct()
        low2 = large.groupBy("u").agg(F.min("v").alias("low"))
        joined = large.join(low2, "u")
        small = joined.where(F.col("v") != F.col("low")).select(F.col("v").alias("u"), F.col("low").alias("v"))
        was, (e, after) = e, _written(small.union(low2.select("u", F.col("low").alias("v"))).distinct())
        release(was)
        if after == before:
            break
        before = after
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).union(
        e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    )


def _written(e: DataFrame) -> tuple[DataFrame, dict]:
    return materialize_counted(e, "edges", F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("checksum"))
