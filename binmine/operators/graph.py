"""Connected components of an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from binmine.session import checkpointed


def connected_components(edges: DataFrame, nodes: DataFrame | None = None, rounds: int = 60) -> DataFrame:
    """id, component: the smallest id reachable. edges: a, b. nodes (id) adds ids without edges.

    Alternating large-star and small-star steps over checkpointed edges; smallest neighbours are pre-aggregated, and only
    a count and a checksum reach the driver.
    """
    state = lambda e: tuple(e.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b"))).first())
    e = checkpointed(edges.select(F.greatest("a", "b").cast("long").alias("a"), F.least("a", "b").cast("long").alias("b")).where("a != b").distinct())
    now = state(e)
    for _ in range(rounds if now[0] else 0):
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).withColumn("m", F.least("a", "m"))
        large = both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        small = large.join(large.groupBy("a").agg(F.min("b").alias("m")), "a").select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("x")).select("x.*").where("a != b")
        e = checkpointed(small.distinct())
        now, old = state(e), now
        if now == old:
            break
    else:
        if now[0]:
            raise RuntimeError(f"components did not settle in {rounds} rounds")
    found = e.select(F.col("a").alias("id"), F.col("b").alias("component")).unionByName(e.select(F.col("b").alias("id"), F.col("b").alias("component")).distinct())
    if nodes is None:
        return found
    return nodes.select("id").distinct().join(found, "id", "left").select("id", F.coalesce("component", F.col("id").cast("long")).alias("component"))
