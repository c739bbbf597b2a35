"""Proportional stratified interleaving: every shard gets the corpus's mixture of sources.

Rows of a source are shuffled by a seeded hash and ranked; rank r of n stands at the fraction (r - 1 + u) / n, where
u in [0, 1) is the source's own seeded offset. All rows in order of that fraction are cut into shards whose row
counts differ by at most one. Ranks come from counts of hash buckets plus a row number inside a bucket, so no task
holds a whole source or the whole order, however large either is. DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import table

#: Hash buckets of a source, and fraction buckets of the whole order. A power of two; raise it beyond about 1e11 rows.
BUCKETS = 1024


def _hash60(c: Column, seed: int) -> Column:
    """The first 60 bits of an MD5, as a long that other engines can compute too."""
    return F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}-"), c).cast("binary")), 1, 15), 16, 10).cast("long")


def interleave(df: DataFrame, n_shards: int = 40, source: str = "source", key: str = "doc_id", ties: tuple[str, ...] = (), seed: int = 17, buckets: int = BUCKETS, shard: str = "shard", slot: str = "slot") -> DataFrame:
    """df with the columns shard (0 to n_shards - 1) and slot (gapless from 0 in a shard).

    Rows with a null source are a source of their own, a null key hashes as the text "null". Rows equal in key and
    ties are interchangeable: which of them gets which slot is open. Columns of df named like shard or slot are
    replaced. An empty frame gives an empty result; with fewer rows than shards some shards are empty.
    """
    bits = buckets.bit_length() - 1
    src, h, u, rank, at, f, fb = (f"__il_{x}" for x in ("src", "hash", "u", "rank", "at", "fraction", "fb"))
    skey = F.coalesce(F.concat(F.lit("s"), F.col(f"`{source}`").cast("string")), F.lit("n"))
    rows = (
        df.drop(shard, slot)
        .withColumn(src, skey)
        .withColumn(h, _hash60(F.coalesce(F.col(f"`{key}`").cast("string"), F.lit("null")), seed))
        .withColumn(at, F.shiftright(F.col(h), 60 - bits))
    )
    tie = [F.col(f"`{c}`") for c in (key, *ties)]
    by_src = Window.partitionBy(src)
    starts = (
        rows.groupBy(src, at)
        .agg(F.count(F.lit(1)).alias("__il_n"))
        .select(
            src,
            at,
            (F.sum("__il_n").over(by_src.orderBy(at).rowsBetween(Window.unboundedPreceding, 0)) - F.col("__il_n")).alias("__il_before"),
            F.sum("__il_n").over(by_src).alias("__il_of"),
        )
    )
    ranked = (
        rows.join(starts, [src, at])
        .withColumn(rank, F.col("__il_before") + F.row_number().over(Window.partitionBy(src, at).orderBy(h, *tie)))
        .withColumn(u, _hash60(F.col(src), seed).cast("double") / F.lit(float(1 << 60)))
        .withColumn(f, (F.col(rank) - 1 + F.col(u)) / F.col("__il_of"))
        .withColumn(fb, F.least(F.floor(F.col(f) * buckets), F.lit(buckets - 1)))
        .drop("__il_before", "__il_of", rank, u)
    )
    whole = Window.partitionBy()
    offsets = (  # one row for each of the fraction buckets: bounded
        ranked.groupBy(fb)
        .agg(F.count(F.lit(1)).alias("__il_n"))
        .select(fb, (F.sum("__il_n").over(Window.orderBy(fb).rowsBetween(Window.unboundedPreceding, 0)) - F.col("__il_n")).alias("__il_before"), F.sum("__il_n").over(whole).alias("__il_all"))
    )
    g = "__il_global"
    return (
        ranked.join(F.broadcast(offsets), fb)
        .withColumn(g, F.col("__il_before") + F.row_number().over(Window.partitionBy(fb).orderBy(f, src, h, *tie)) - 1)
        .withColumn(shard, F.expr(f"cast({g} * {n_shards} div __il_all as int)"))
        .withColumn(slot, F.expr(f"{g} - (cast({shard} as bigint) * __il_all + {n_shards - 1}) div {n_shards}"))
        .drop(src, h, at, f, fb, g, "__il_before", "__il_all")
    )


def op10_interleave(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in shards 0 to 39, law "rows"."""
    text = F.coalesce("text", F.lit(""))
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", (F.octet_length(text) + 16).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"))
    out = interleave(docs, 40, ties=("text_crc32", "size"))
    return out.select("doc_id", "source", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
