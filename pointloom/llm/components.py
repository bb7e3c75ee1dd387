"""Connected components of an edge table by alternating star contractions.

Each round replaces edges by edges to smaller neighbours (large star, then
small star); the edge count never grows, hubs are reached through partial
aggregation, and the loop ends when the edge set is a forest of stars.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import evenly, materialise, release


def _with_minimum(edges: DataFrame) -> DataFrame:
    """(u, v, m): every directed edge with the smallest id next to or at u."""
    low = edges.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    return edges.join(evenly(low), "u")


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Smallest reachable id for every vertex of an undirected edge table.

    ``edges`` has long columns ``u`` and ``v`` (self loops and repeated edges
    are allowed, nulls are ignored).  Returns ``(id, component)`` for each id
    that has an edge to another id; isolated ids do not appear.
    """
    e = edges.where("u IS NOT NULL AND v IS NOT NULL AND u <> v")
    e = materialise(e.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    mark = None
    for _ in range(max_rounds):
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        # large star: larger neighbours of u move to the minimum around u
        large = _with_minimum(both).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where("u <> v").distinct()
        # small star: u and its smaller neighbours move to the minimum around u
        small = _with_minimum(large)
        nxt = small.select(F.explode(F.array(F.col("u"), F.col("v"))).alias("u"), F.col("m").alias("v"))
        nxt = materialise(nxt.where("u <> v").distinct(), "edges")
        now = nxt.agg(F.count("*"), F.sum(F.xxhash64("u", "v") % F.lit(1 << 40))).first()
        release(e)
        e = nxt
        if tuple(now) == mark:
            break
        mark = tuple(now)
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    return e.groupBy(F.col("u").alias("id")).agg(F.min("v").alias("component")).unionByName(
        e.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct()
    )
