"""Hamming distance as a column, nearest representatives, portable pseudo-random order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from binmine.session import checkpointed


def popcount(v: str | Column) -> Column:
    return F.aggregate(v, F.lit(0), lambda a, x: a + x)


def packed(v: str | Column) -> Column:
    """32 bits to a word, first bit highest: Hamming distances then are a bit count a word."""
    c = F.col(v) if isinstance(v, str) else v
    words = F.sequence(F.lit(0), F.ceil(F.size(c) / 32).cast("int") - 1)
    return F.transform(words, lambda w: F.aggregate(F.slice(c, w * 32 + 1, F.lit(32)), F.lit(0).cast("long"), lambda a, x: a * 2 + x))


def hamming(a: Column, b: Column) -> Column:
    """Differing bits of two packed rows."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, x: s + x)


def shared(a: Column, b: Column) -> Column:
    """Ones that two packed rows have both."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.bit_count(x.bitwiseAND(y))), F.lit(0), lambda s, x: s + x)


def nearest(obs: DataFrame, reps: DataFrame, *keep: str) -> DataFrame:
    """id, kept columns, cluster, d: the nearest of reps (cluster, v), the lowest cluster on ties; reps is a few rows.

    Rows meet all representatives in one array, so nothing is shuffled and repeated rows stay.
    """
    x = obs.select("id", *keep, packed("v").alias("__x"))
    r = reps.agg(F.collect_list(F.struct("cluster", packed("v").alias("r"))).alias("__rs"))
    best = F.array_min(F.transform("__rs", lambda m: F.struct(hamming(F.col("__x"), m["r"]).alias("d"), m["cluster"].alias("cluster"))))
    return x.crossJoin(F.broadcast(r)).select("id", *keep, best.alias("b")).select("id", *keep, F.col("b.cluster").alias("cluster"), F.col("b.d").alias("d"))


def within(obs: DataFrame, reps: DataFrame, radius: float, *keep: str) -> DataFrame:
    """id, kept columns, cluster: the lowest cluster of reps (cluster, v) nearer than radius (a share of the bits), or null.

    reps is a few rows, met as in nearest().
    """
    x = obs.select("id", *keep, packed("v").alias("__x"), F.size("v").alias("__p"))
    r = reps.orderBy("cluster").agg(F.sort_array(F.collect_list(F.struct("cluster", packed("v").alias("r")))).alias("__rs"))
    near = F.array_min(F.transform(F.filter("__rs", lambda m: hamming(F.col("__x"), m["r"]) < radius * F.col("__p")), lambda m: m["cluster"]))
    return x.crossJoin(F.broadcast(r)).select("id", *keep, near.alias("cluster"))


def seeded(seed: int, key: str = "id") -> Column:
    """A text whose order is a shuffle that other engines reproduce."""
    return F.md5(F.concat(F.lit(f"{seed}-"), F.col(key).cast("string")).cast("binary"))


def sample_rows(df: DataFrame, n: int, seed: int, key: str = "id") -> DataFrame:
    """Exactly n rows (all, if there are fewer)."""
    return df.orderBy(seeded(seed, key), key).limit(n)


def stratified(df: DataFrame, total: int, classes: int, seed: int, by: str = "orig", key: str = "id") -> DataFrame:
    """A quota of each class 1..classes, from rounded (half-even) cumulative bounds of total."""
    quota = "bround({0}.0D * {1} / {2}) - bround({0}.0D * ({1} - 1) / {2})".format(total, by, classes)
    rank = F.row_number().over(Window.partitionBy(by).orderBy(seeded(seed, key), key))
    return df.withColumn("__rn", rank).where(F.col("__rn") <= F.expr(quota)).drop("__rn")


def ranked(df: DataFrame, key: str, name: str = "rank") -> DataFrame:
    """A column of ranks from 1 in order of key, whose ties are ranked in any order.

    Ranks come from counts of key ranges and a row number inside each, so no task orders the whole table.
    """
    # ranges are drawn from a sample: a checkpoint holds them still for the counts and the rows
    parts = checkpointed(df.repartitionByRange(key).withColumn("__p", F.spark_partition_id()))
    counts = parts.groupBy("__p").agg(F.count(F.lit(1)).alias("__n")).withColumn("__before", F.sum("__n").over(Window.orderBy("__p").rowsBetween(Window.unboundedPreceding, 0)) - F.col("__n")).drop("__n")
    rank = F.col("__before") + F.row_number().over(Window.partitionBy("__p").orderBy(key))
    return parts.join(F.broadcast(counts), "__p").withColumn(name, rank).drop("__p", "__before")


def chunked(df: DataFrame, chunks: int, key: str = "id", rank: str | None = None) -> DataFrame:
    """A column chunk from 1: contiguous ranges of key, near-equal, larger first; and, if named, one of ranks from 1."""
    n = df.count()
    small, extra = divmod(n, chunks)
    r = ranked(df, key, "__r").withColumn("__r", F.col("__r") - 1)
    cut = extra * (small + 1)
    of = F.when(F.col("__r") < cut, F.floor(F.col("__r") / (small + 1))).otherwise(extra + F.floor((F.col("__r") - cut) / max(small, 1)))
    r = r.withColumn("chunk", (of + 1).cast("int"))
    return (r.withColumn(rank, F.col("__r") + 1) if rank else r).drop("__r")
