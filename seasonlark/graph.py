"""Connected components of an edge table by alternating large-star and small-star steps.

Both steps are a grouped minimum (combined before the shuffle) and one equi-join, so
no node's neighbours are ever gathered; the edge table at most keeps its size, and
the number of rounds grows with the logarithm of the longest path.  Edges that are stars
already, such as components of an earlier call, take no round at all.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seasonlark.scratch import materialise, remove


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One step over (u, v) rows with u > v; returns such rows again, distinct."""
    if large:
        both = edges.select("u", "v").unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))
        out = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        least = edges.groupBy("u").agg(F.min("v").alias("m"))
        hooked = edges.join(least, "u")
        out = hooked.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionAll(least.select("u", F.col("m").alias("v")))
    return out.where("u > v").distinct()


def _settled(edges: DataFrame) -> bool:
    """Whether (u, v) rows are stars: every u has one edge and is no edge's v."""
    ends = edges.select(F.col("u").alias("x"), F.lit(1).alias("up"), F.lit(0).alias("down")).unionAll(edges.select(F.col("v").alias("x"), F.lit(0).alias("up"), F.lit(1).alias("down")))
    return ends.groupBy("x").agg(F.sum("up").alias("up"), F.max("down").alias("down")).where((F.col("up") > 1) | ((F.col("up") > 0) & (F.col("down") > 0))).isEmpty()


def connected_components(edges: DataFrame, src: str, dst: str, max_rounds: int = 60) -> DataFrame:
    """``(id, component)`` for every id that occurs in an edge; component is the smallest id reachable.

    Edges with a null end or equal ends are ignored; repeated edges and both
    directions count once; an empty table gives an empty result.
    """
    cur = materialise(
        edges.where(F.col(src) != F.col(dst)).select(F.greatest(src, dst).alias("u"), F.least(src, dst).alias("v")).distinct(),
        "edges",
    )

    for _ in range(max_rounds):
        if _settled(cur):
            break
        nxt = materialise(_star(_star(cur, True), False), "edges")
        remove(cur)
        cur = nxt
    else:
        if not _settled(cur):
            raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    roots = cur.select(F.col("v").alias("id")).distinct()
    return cur.select(F.col("u").alias("id"), F.col("v").alias("component")).unionAll(roots.select("id", F.col("id").alias("component")))
