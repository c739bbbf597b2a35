"""External cluster metrics from the long contingency table: one shuffle of pre-aggregated counts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from binmine.functions.bits import ranked


def _pairs(c: str):
    return F.expr(f"{c} * ({c} - 1) / 2")


def contingency(df: DataFrame, orig: str = "orig", result: str = "result") -> DataFrame:
    return df.groupBy(F.col(orig).alias("orig"), F.col(result).alias("result")).agg(F.count(F.lit(1)).alias("n"))


def rec_pre_f1(df: DataFrame, orig: str = "orig", result: str = "result", exact: bool = False) -> DataFrame:
    """recall, precision, f1 of pairs. Missed pairs between two cells of one row each are not counted, unless exact."""
    tab = contingency(df, orig, result)
    lone = F.lit(0.0) if exact else F.expr("ones * (ones - 1) / 2")
    rows = tab.groupBy("orig").agg(F.sum("n").alias("n"), F.sum(_pairs("n")).alias("tp"), F.count_if(F.col("n") == 1).alias("ones")).agg(F.sum("tp").alias("tp"), F.sum(_pairs("n") - F.col("tp") - lone).alias("fn"))
    cols = tab.groupBy("result").agg(F.sum("n").alias("n")).agg(F.sum(_pairs("n")).alias("found"))
    both = rows.join(F.broadcast(cols), F.lit(True))  # one row each
    out = both.select(F.expr("try_divide(tp, tp + fn)").alias("recall"), F.expr("try_divide(tp, found)").alias("precision"))
    return out.withColumn("f1", F.expr("try_divide(2 * recall * precision, recall + precision)"))


def entropy(df: DataFrame, orig: str = "orig", result: str = "result") -> DataFrame:
    """Mean entropy (bits) of the true classes inside a cluster, weighted by cluster size."""
    tab = contingency(df, orig, result).withColumn("size", F.sum("n").over(Window.partitionBy("result")))
    return tab.agg(F.expr("try_divide(sum(-n * log2(n / size)), sum(n))").alias("entropy"))


def rand_index(df: DataFrame, orig: str = "orig", result: str = "result") -> DataFrame:
    """The Rand index; null for fewer than two rows."""
    tab = contingency(df, orig, result)
    m = tab.cube("orig", "result").agg(F.sum("n").alias("n"), F.sum(F.expr("n * n")).alias("nn"), F.grouping_id().alias("g"))
    of = lambda g, c: F.sum(F.when(F.col("g") == g, F.expr(c)))
    parts = m.agg(of(3, "nn").alias("cells"), of(1, "n * n").alias("rows"), of(2, "n * n").alias("cols"), of(3, "n").alias("n"))
    return parts.select(F.expr("1 + try_divide(cells - (rows + cols) / 2, n * (n - 1) / 2)").alias("rand"))


def purity_blocks(df: DataFrame, blocks: int, result: str = "result", key: str = "id") -> DataFrame:
    """Share of rows with their block's most frequent label; blocks are equal runs of key order.

    A fractional block size leaves rows out, and blocks beyond the number of labels do not count.
    """
    n, labels = df.agg(F.count(F.lit(1)), F.count_distinct(result)).first()
    size = n / blocks if blocks else 0.0
    starts = [(i + 1, int(size * i) + 1, int(size * i) + int(size)) for i in range(min(blocks, labels))]
    spans = df.sparkSession.createDataFrame(starts, "block int, first long, last long")
    rows = ranked(df.select(F.col(result).alias("result"), F.col(key).alias("__key")), "__key", "rn")
    best = rows.join(F.broadcast(spans), F.col("rn").between(F.col("first"), F.col("last"))).groupBy("block", "result").count().groupBy("block").agg(F.max("count").alias("most"))
    return best.agg((F.coalesce(F.sum("most"), F.lit(0)) / F.lit(max(n, 1))).alias("purity"))


def purity(df: DataFrame, orig: str = "orig", result: str = "result") -> DataFrame:
    """The usual purity: share of rows with their cluster's most frequent class."""
    return contingency(df, orig, result).groupBy("result").agg(F.max("n").alias("most"), F.sum("n").alias("n")).agg(F.expr("sum(most) / sum(n)").alias("purity"))


def pair_metrics(pairs: DataFrame, truth: DataFrame, n: int, classes: int) -> DataFrame:
    """recall, precision, f1, rand of candidate pairs (id1, id2) against truth (id, orig).

    True negatives are (n / classes) ** classes less false positives; pairs whose first class is not 1..classes are ignored.
    """
    a = truth.select(F.col("id").alias("id1"), F.col("orig").alias("o1"))
    b = truth.select(F.col("id").alias("id2"), F.col("orig").alias("o2"))
    known = pairs.join(a, "id1").join(b, "id2", "left").where(F.col("o1").between(1, classes))
    return pair_scores(known.agg(F.count_if(F.expr("o1 <=> o2")).alias("tp"), F.count_if(F.expr("not (o1 <=> o2)")).alias("fp")), n, classes)


def pair_scores(cells: DataFrame, n: int, classes: int) -> DataFrame:
    """The figures of pair_metrics() from its counts tp and fp."""
    each = n / classes
    full = cells.withColumn("tn", F.lit(each**classes) - F.col("fp")).withColumn("fn", F.lit(each * (each - 1) / 2 * classes) - F.col("tp"))
    out = full.select(F.expr("try_divide(tp, tp + fn)").alias("recall"), F.expr("try_divide(tp, tp + fp)").alias("precision"), F.expr(f"(tp + tn) / {n * (n - 1) / 2!r}D").alias("rand"))
    return out.select("recall", "precision", F.expr("try_divide(2 * precision * recall, precision + recall)").alias("f1"), "rand")
