"""Connected components by alternating large-star and small-star steps.

Kiveris et al., "Connected Components in MapReduce and Beyond", SoCC 2014.  Each
step is an aggregation and a join; the state is a table of pairs in the shared
folder, so lineage stays short and a lost executor costs one step.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loupe.session import HOT_ROWS, Scratch, follow


def _large_star(pairs: DataFrame, n: int) -> DataFrame:
    """Ties every greater neighbour of a vertex to the least of its neighbourhood; n bounds the pairs both ways."""
    both = pairs.unionByName(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return follow(both, least, "u", n).filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(pairs: DataFrame, n: int) -> DataFrame:
    """Ties a vertex and its smaller neighbours to the least of them; u > v on both sides."""
    least = pairs.groupBy("u").agg(F.min("v").alias("m"))
    others = follow(pairs, least, "u", n).filter("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return others.unionByName(least.select("u", F.col("m").alias("v"))).distinct()


def _fingerprint() -> dict[str, Column]:
    """What tells one set of distinct pairs (u, v) from another: its size and two hashes put together by xor, which cannot overflow."""
    return {"n": F.count(F.lit(1)), "x": F.bit_xor(F.xxhash64("u", "v")), "y": F.bit_xor(F.xxhash64("v", "u"))}


def components(pairs: DataFrame, a: str, b: str, vertices: DataFrame | None = None, vertex: str = "seq") -> DataFrame:
    """(``vertex``, ``component``): component is the smallest id connected to the vertex.

    Pairs may repeat, run either way or tie an id to itself; null ends are left
    out.  Ids without a pair come out alone if ``vertices`` names them, else not.
    """
    scratch = Scratch(pairs.sparkSession, "stars")
    u, v = F.col(a).cast("long"), F.col(b).cast("long")
    state = pairs.select(F.greatest(u, v).alias("u"), F.least(u, v).alias("v")).filter(u.isNotNull() & v.isNotNull() & (u != v)).distinct()
    sums = _fingerprint()
    state, seen = scratch.cut(state, "0", **sums)
    step = 0
    while seen["n"]:
        before, step = seen, step + 1
        n = 2 * seen["n"]  # the first step lists every pair both ways, the second no more than the first
        large = _large_star(state, n)
        if n > HOT_ROWS:  # read several times in the second step
            large, _ = scratch.cut(large, f"{step}-large")
        state, seen = scratch.cut(_small_star(large, n), str(step), **sums)
        scratch.drop(f"{step}-large")
        scratch.drop(str(step - 1))
        if before == seen:
            break
    joined = state.select(F.col("u").alias(vertex), F.col("v").alias("component"))
    roots = state.select(F.col("v").alias(vertex)).distinct().withColumn("component", F.col(vertex))
    found = joined.unionByName(roots)
    if vertices is None:
        return found
    return vertices.select(vertex).distinct().join(found, vertex, "left").withColumn("component", F.coalesce("component", vertex))
