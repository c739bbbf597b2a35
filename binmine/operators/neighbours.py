"""Exact nearest neighbours by Hamming distance: multi-index hashing with a growing radius."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from binmine.functions.bits import hamming, packed
from binmine.session import checkpointed, discard

#: Bits of a segment. Two rows that differ in fewer than segments * (s + 1) bits agree in one of them but for s bits.
WIDTH = 16


def _segments(bits: int, width: int) -> list[int]:
    return [min(width, bits - at) for at in range(0, bits, width)]


def _values(bits: int, width: int) -> Column:
    """The segments of v as numbers."""
    value = lambda at, n: F.aggregate(F.slice("v", at + 1, n), F.lit(0), lambda a, x: a * 2 + x)
    return F.array(*(value(k * width, n) for k, n in enumerate(_segments(bits, width))))


def hamming_neighbours(obs: DataFrame, queries: DataFrame, k: int, width: int = WIDTH) -> DataFrame:
    """query, id, d, rank: the k rows of obs nearest to each of queries (both id, v; ids once), without itself, lower ids first.

    Rows are indexed by each segment of their bits. A round looks up, for the queries that are not done, all values that
    differ from a segment in just s bits; after it all rows that differ in fewer than segments * (s + 1) bits have been met,
    so a query is done when its k-th neighbour is among these, and only the others go on to s + 1. Of equal rows the k + 1
    lowest ids suffice and are all that is indexed. Queries with fewer than k other rows get those there are.
    """
    spark, first = obs.sparkSession, obs.where("v is not null").select(F.size("v").alias("p")).first()
    result = "query long, id long, d int, rank int"
    if first is None:
        return spark.createDataFrame([], result)
    sizes = _segments(first.p, width)
    one = F.row_number().over(Window.partitionBy("x").orderBy("id"))
    rows = obs.where("v is not null").select(F.col("id").cast("long").alias("id"), packed("v").alias("x"), _values(first.p, width).alias("parts"))
    rows = rows.withColumn("__n", one).where(F.col("__n") <= k + 1).drop("__n")
    index = checkpointed(rows.select("id", "x", F.posexplode("parts").alias("seg", "val")))
    open_ = checkpointed(queries.where("v is not null").select(F.col("id").cast("long").alias("query"), packed("v").alias("y"), _values(first.p, width).alias("parts")))
    best, done = checkpointed(spark.createDataFrame([], "query long, id long, d int")), []
    for s in range(max(sizes) + 1):
        masks = spark.createDataFrame([(seg, sum(1 << b for b in some)) for seg, n in enumerate(sizes) for some in combinations(range(n), s)], "seg int, mask int")
        probes = open_.select("query", "y", F.posexplode("parts").alias("seg", "part")).join(F.broadcast(masks), "seg").select("query", "y", "seg", F.col("part").bitwiseXOR(F.col("mask")).alias("val"))
        met = probes.join(index, ["seg", "val"]).where("id != query").select("query", "id", hamming(F.col("x"), F.col("y")).alias("d"))
        every = met.unionByName(best).groupBy("query", "id").agg(F.min("d").alias("d"))
        rank = F.row_number().over(Window.partitionBy("query").orderBy("d", "id"))
        top = checkpointed(every.withColumn("rank", rank).where(F.col("rank") <= k))
        settled = top.groupBy("query").agg(F.count(F.lit(1)).alias("n"), F.max("d").alias("last")).where((F.col("n") == k) & (F.col("last") < len(sizes) * (s + 1)) if s < max(sizes) else F.lit(True))
        settled = checkpointed(settled.select("query"))
        done.append(checkpointed(top.join(settled, "query", "left_semi").select("query", "id", "d", "rank")))
        left = checkpointed(open_.join(settled, "query", "left_anti"))
        new = checkpointed(top.join(settled, "query", "left_anti").select("query", "id", "d"))
        discard(open_, best, top, settled)
        open_, best = left, new
        if open_.isEmpty():
            break
    discard(index, open_, best)
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    return out
