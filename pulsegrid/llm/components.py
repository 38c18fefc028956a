"""Connected components of an edge table by alternating large-star and
small-star steps (Kiveris et al., SoCC 2014).

Each step is one grouped minimum, written to scratch, and one join; a hub's
edges never meet in one task because the join sides are plain exchanges that
adaptive execution may split.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import keep, release

MAX_ROUNDS = 60


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One star step over edges (u, v) with u > v."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))) if large else edges
    low = keep(both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m")), "star", "lz4_raw")
    near = both.filter("v > u") if large else both
    linked = near.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    if not large:
        linked = linked.unionByName(low.select("u", F.col("m").alias("v")))
    out = keep(linked.filter("u <> v").distinct(), "edges", "lz4_raw")
    release(low)
    return out


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, root): every node that has an edge and the smallest node reachable
    from it. ``edges`` has columns a, b of one orderable type; self links,
    repeats and either direction are fine; null ends are dropped."""
    now = keep(
        edges.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(),
        "edges",
        "lz4_raw",
    )
    mark = None
    for _ in range(MAX_ROUNDS):
        wide = _star(now, True)
        release(now)
        now = _star(wide, False)
        release(wide)
        seen = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if mark == tuple(seen):
            break
        mark = tuple(seen)
    else:
        raise RuntimeError("components did not settle")
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(
        now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    )
