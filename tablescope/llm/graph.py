"""Connected components of a distributed edge list."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablescope.session import cut_lineage

MAX_ROUNDS = 60


def components(edges: DataFrame) -> DataFrame:
    """(v, c): for every vertex of ``edges(a, b)`` the smallest vertex it reaches.

    Alternating large-star and small-star steps until nothing moves. A step is one minimum per
    vertex (pre-aggregated in the map tasks) and one join, so a vertex with millions of edges is
    never gathered. Every round is checkpointed. Null ends and loops are ignored.
    """
    e = cut_lineage(edges.where("a is not null and b is not null and a <> b")
                    .select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    before = None
    for _ in range(MAX_ROUNDS):
        both = e.union(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.where("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = large.where("a <> b").distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a")
        e = cut_lineage(small.select("a", F.col("m").alias("b"))
                        .union(small.select(F.col("b").alias("a"), F.col("m").alias("b"))).where("a <> b").distinct())
        state = e.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b"))).first()
        if state == before:
            break
        before = state
    else:
        raise RuntimeError("components did not settle")
    top = e.select(F.col("b").alias("v")).distinct().select("v", F.col("v").alias("c"))
    return e.select(F.col("a").alias("v"), F.col("b").alias("c")).union(top)
