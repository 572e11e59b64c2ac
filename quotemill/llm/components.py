"""Connected components by alternating large-star and small-star rounds.

Used by the redirect-equivalence filter, the embedding graph and the n-gram
Jaccard join. Each round joins edges with per-vertex minima, which are pre-aggregated
before the shuffle. The edges of a hot vertex meet its minimum by broadcast (at most
``HOT`` vertices hold more than 1 in ``HOT`` edges), those of the others by a shuffle,
so no task holds the edges of a hot vertex.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import cut, spread_join


def _minima(e: DataFrame) -> DataFrame:
    return e.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"), F.count("*").alias("n"))


def _large(e: DataFrame, total: int) -> DataFrame:
    both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
    met = spread_join(both, _minima(both), ["u"], total)
    return met.filter("v > u and v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small(e: DataFrame, total: int) -> DataFrame:
    low = e.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    m = _minima(low)
    moved = spread_join(low, m, ["u"], total).filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.union(m.select("u", F.col("m").alias("v"))).filter("u <> v").distinct()


def _stars(e: DataFrame) -> bool:
    """Whether every vertex has one edge upwards, or only edges from below."""
    up = e.select(F.col("u").alias("x"), F.lit(1).alias("up"), F.lit(0).alias("down"))
    down = e.select(F.col("v").alias("x"), F.lit(0).alias("up"), F.lit(1).alias("down"))
    seen = up.union(down).groupBy("x").agg(F.sum("up").alias("up"), F.max("down").alias("down"))
    return seen.filter("up > 1 or up + down > 1").isEmpty()


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """``edges(u, v)`` -> ``(u, root)`` for every vertex that is not its own root.

    The root is the smallest vertex of the component. Edges are undirected; self
    loops, repeats and null ends are ignored. No edge gives no row.
    """
    e = edges.select("u", "v").filter("u is not null and v is not null and u <> v")
    e = cut(e.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    total = e.count()
    for _ in range(max_rounds):
        if not total or _stars(e):
            break
        e = cut(_small(_large(e, total), total))
    else:
        raise RuntimeError("components did not converge")
    return e.select("u", F.col("v").alias("root"))
