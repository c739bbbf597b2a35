"""Binary observations from tables.

obs(id, v ARRAY<TINYINT>), optionally with orig (the true class, from 1); obs_long(id, j) lists the ones, j from 1.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def sign_bits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, orig, v from embeddings: a bit is one where the component is positive."""
    bit = lambda x: F.when(x > 0, 1).otherwise(0).cast("tinyint")
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), (F.col("label") + 1).alias("orig"), F.transform("embedding", bit).alias("v"))


def baskets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """obs_long of orders: the brands, numbered in alphabetical order, of an order's parts."""
    part = table(spark, sf_dir, "part").select("p_partkey", "p_brand")
    brands = part.select("p_brand").distinct().withColumn("j", F.dense_rank().over(Window.orderBy("p_brand")))
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey")
    return lines.join(part, lines.l_partkey == part.p_partkey).join(F.broadcast(brands), "p_brand").select(F.col("l_orderkey").alias("id"), "j").distinct()


def shingles(spark: SparkSession, sf_dir: str, size: int = 1024) -> DataFrame:
    """obs_long of documents: words of letters a-z, hashed to 1..size."""
    words = F.explode(F.array_distinct(F.filter(F.split(F.lower("text"), "[^a-z]+"), lambda w: w != "")))
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), words.alias("w")).select("id", (F.conv(F.substring(F.md5(F.col("w").cast("binary")), 1, 6), 16, 10).cast("long") % size + 1).cast("int").alias("j")).distinct()


def word_numbers(spark: SparkSession, sf_dir: str, size: int = 1024) -> DataFrame:
    """id, j: the numbers of shingles(), maybe repeated, a null one for a document without words: no shuffle."""
    words = F.array_distinct(F.filter(F.split(F.lower(F.coalesce("text", F.lit(""))), "[^a-z]+"), lambda w: w != ""))
    number = (F.conv(F.substring(F.md5(F.col("w").cast("binary")), 1, 6), 16, 10).cast("long") % size + 1).cast("int")
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.explode_outer(words).alias("w")).select("id", number.alias("j"))


def from_wide(df: DataFrame, prefix: str = "V", key: str = "id") -> DataFrame:
    """obs from columns prefix1..prefixp, in the order of their numbers."""
    cols = sorted((c for c in df.columns if c.startswith(prefix) and c[len(prefix) :].isdigit()), key=lambda c: int(c[len(prefix) :]))
    return df.select(F.col(key).alias("id"), F.array(*(F.col(c).cast("tinyint") for c in cols)).alias("v"))


def to_wide(obs: DataFrame, p: int, prefix: str = "V") -> DataFrame:
    return obs.select("id", *(F.col("v")[i].alias(f"{prefix}{i + 1}") for i in range(p)))


def to_long(obs: DataFrame, *keep: str) -> DataFrame:
    """id, kept columns and j of each one."""
    return obs.select("id", *keep, F.posexplode("v").alias("j0", "one")).where("one = 1").select("id", *keep, (F.col("j0") + 1).alias("j"))


def from_long(obs_long: DataFrame, p: int) -> DataFrame:
    """obs of the ids that have ones."""
    items = obs_long.groupBy("id").agg(F.collect_set("j").alias("items"))
    return items.select("id", F.expr(f"transform(sequence(1, {p}), j -> cast(if(array_contains(items, cast(j as {dict(obs_long.dtypes)['j']})), 1, 0) as tinyint))").alias("v"))


def to_items(obs: DataFrame, *keep: str) -> DataFrame:
    """id, kept columns and the ascending positions of ones."""
    return obs.select("id", *keep, F.expr("filter(transform(v, (x, i) -> if(x = 1, i + 1, 0)), j -> j > 0)").alias("items"))


def write(df: DataFrame, path: str) -> None:
    """Labels, pairs, buckets or features as Parquet."""
    df.write.mode("overwrite").parquet(path)
