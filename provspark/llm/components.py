"""Connected components by alternating star contraction, DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from provspark.llm.common import materialize


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """``edges(a, b)`` -> ``(node, component)``, component = smallest node reachable.

    Each round makes every node's larger neighbours point to its smallest one, then its smaller neighbours.
    Rounds grow with the logarithm of the longest path. Nodes without an edge are not returned; edges with a
    null end are ignored. Hubs are pre-aggregated (min) and their join is one that AQE splits.
    Every round is a table in the shared folder, so a lost executor costs one round at most.
    """
    pairs = edges.where("a is not null and b is not null and a <> b")
    links = materialize(pairs.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "cc")
    state = _state(links)
    for _ in range(max_rounds):
        if not state[0]:
            break
        both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        moved = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        links = materialize(moved.unionByName(least.select("u", F.col("m").alias("v"))).distinct(), "cc")
        before, state = state, _state(links)
        if state == before:
            break
    else:
        raise RuntimeError("components have not settled")
    stars = links.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return stars.unionByName(links.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())


def _state(links: DataFrame) -> tuple:
    row = links.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    return row[0], row[1]
