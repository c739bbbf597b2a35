"""Monothetic trees: MBT splits by the most balanced bit, MONA by information gain. One aggregate a level serves all nodes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from binmine.functions.bits import ranked, seeded
from binmine.functions.kernels import kmeans
from binmine.operators import merge, representatives
from binmine.session import checkpointed


def item_support(obs: DataFrame, *by: str) -> DataFrame:
    """by, j, s (ones), n (rows)."""
    return obs.select(*by, F.posexplode("v").alias("j0", "b")).groupBy(*by, (F.col("j0") + 1).alias("j")).agg(F.sum("b").alias("s"), F.count(F.lit(1)).alias("n"))


def balanced_variables(obs: DataFrame, *by: str) -> DataFrame:
    """by, j, off: the bit whose support is nearest to half the rows, the lowest on ties, and twice its distance."""
    return item_support(obs, *by).groupBy(*by).agg(F.min(F.struct(F.abs(2 * F.col("s") - F.col("n")).alias("off"), "j")).alias("m"), F.max("n").alias("n")).select(*by, F.col("m.j").alias("j"), F.col("m.off").alias("off"), "n")


def mbt_partitions(obs: DataFrame, threshold: int, chunk: str | None = None) -> DataFrame:
    """id, v, (chunk,) part: the bits taken on the way down. Parts over threshold are split, and all are at first, twice.

    A part whose best bit is constant is final; a bit is constant below its split, so there are no more levels than bits. The
    table of chosen bits grows with rows / threshold, so how it is joined is left to the optimiser.
    """
    by = [chunk] if chunk else []
    now = obs.select("id", *by, "v", F.lit("").alias("part"), F.lit(True).alias("open"))
    first = obs.select("v").first()
    bits = len(first.v) if first else 0
    for level in range(bits + 1):
        pick = balanced_variables(now.where("open"), *by, "part").withColumn("split", F.col("off") < F.col("n")).where(F.col("split") & ((F.col("n") > threshold) | F.lit(level < 2)))
        chosen = checkpointed(pick.select(*by, "part", "j"))
        if chosen.isEmpty():
            break
        bit = F.get("v", F.col("j") - 1).cast("string")
        now = now.join(chosen, [*by, "part"], "left").select("id", *by, "v", F.when(F.col("j").isNotNull(), F.concat("part", bit)).otherwise(F.col("part")).alias("part"), F.col("j").isNotNull().alias("open"))
        if level % 4 == 3:
            now = checkpointed(now)
    else:
        raise RuntimeError(f"parts are still split after {bits + 1} levels of {bits} bits")
    return now.drop("open")


def mbt(obs: DataFrame, threshold: int, k: int, seed: int = 1) -> DataFrame:
    """id, cluster: k-means over one seeded row of each part. Parts are as many as rows / threshold and stay a frame."""
    parts = checkpointed(mbt_partitions(obs, threshold))
    first = F.min_by("v", F.struct(seeded(seed), "id"))
    reps = parts.groupBy("part").agg(first.alias("v")).select("part", F.col("v").cast("array<double>").alias("v"))
    reps = checkpointed(ranked(reps, "part", "idx").select("part", (F.col("idx") - 1).cast("long").alias("idx"), "v"))
    of = reps.drop("v").join(representatives.kmeans(reps.select("idx", "v"), k, seed), "idx").select("part", "cluster")
    return parts.join(of, "part").select("id", "cluster")


def mbt_kernel(threshold: int, k: int, seed: int):
    def run(x: np.ndarray, chunk: int = 0) -> tuple[np.ndarray, np.ndarray]:
        parts, done, level = [np.arange(len(x))], [], 0
        while parts:
            nxt = []
            for rows in parts:
                s = x[rows].sum(0)
                j = int(np.abs(2 * s - len(rows)).argmin())
                if s[j] in (0, len(rows)) or (len(rows) <= threshold and level >= 2):
                    done.append(rows)
                else:
                    nxt += [rows[x[rows, j] == 0], rows[x[rows, j] == 1]]
            parts, level = nxt, level + 1
        label = np.zeros(len(x), int)
        for i, rows in enumerate(done):
            label[rows] = i
        if len(done) > k:
            label = kmeans(np.array([x[r[0]] for r in done]), k, seed)[label]
        label = merge.dense(label)
        return label, merge.medoids(x, label, 2000, seed)

    return run


def mbt_par(obs: DataFrame, threshold: int, k: int, chunks: int, seed: int = 1) -> DataFrame:
    return merge.merge(merge.local_clusters(obs, chunks, mbt_kernel(threshold, k, seed)), merge.by_kmeans(k, seed))


def _h(a: str, n: str) -> str:
    """a ln a + (n - a) ln (n - a), with 0 ln 0 = 0."""
    return f"(if({a} > 0, {a} * ln({a}), 0D) + if({n} > {a}, ({n} - {a}) * ln({n} - {a}), 0D))"


def co_occurrences(obs: DataFrame, *by: str) -> DataFrame:
    """by (none or one column of numbers), j, side, i, a, n: of a task's n rows whose bit j is side, a have bit i too.

    A task holds one bits x bits matrix for each node that it meets.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[int, list] = {}
        for b in batches:
            v = b.column(b.num_columns - 1)
            x = v.flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, -1).astype(np.float64)
            keys = b.column(0).to_numpy() if by else np.zeros(b.num_rows, np.int64)
            for k in np.unique(keys).tolist():
                some = x[keys == k]
                c = counts.setdefault(k, [0, 0])
                c[0], c[1] = c[0] + some.T @ some, c[1] + len(some)
        for k, (both, n) in counts.items():
            p, s = len(both), np.diag(both)
            a = np.stack([s[None, :] - both, both]).astype(np.int64)  # side, j, i
            rows = np.repeat(np.stack([n - s, s])[:, :, None], p, axis=2).astype(np.int64)
            side, j, i = (m.ravel() for m in np.indices((2, p, p)))
            cols = [pa.array(np.full(len(j), k))] if by else []
            yield pa.RecordBatch.from_arrays([*cols, pa.array(j + 1), pa.array(side), pa.array(i + 1), pa.array(a.ravel()), pa.array(rows.ravel())], [*by, "j", "side", "i", "a", "n"])

    kept = [F.col(c).cast("long") for c in by]
    out = obs.where(F.size("v") > 0).select(*kept, "v").mapInArrow(run, "".join(f"{c} long, " for c in by) + "j long, side long, i long, a long, n long")
    return out.withColumn("j", F.col("j").cast("int"))


def information_gain(obs: DataFrame, *by: str) -> DataFrame:
    """by, j, gain = I - I(j = 0) - I(j = 1) of every bit; a split's own bit does not count inside its branches.

    I = p n ln n - sum(a ln a + (n - a) ln(n - a)) over bits with a ones. Co-occurrences of all bits come from one job.
    """
    co = co_occurrences(obs, *by).where("i != j").groupBy(*by, "j", "side", "i").agg(F.sum("a").cast("double").alias("a"), F.sum("n").cast("double").alias("n"))
    branch = co.groupBy(*by, "j", "side").agg(F.expr(f"sum(if(n > 0, n * ln(n), 0D) - {_h('a', 'n')})").alias("i")).groupBy(*by, "j").agg(F.sum("i").alias("branches"))
    sup = item_support(obs, *by).select(*by, "j", F.col("s").cast("double").alias("s"), F.col("n").cast("double").alias("n"))
    whole = sup.groupBy(*by).agg(F.expr(f"sum(n * ln(n) - {_h('s', 'n')})").alias("whole"))
    joined = branch.join(F.broadcast(whole), list(by)) if by else branch.join(F.broadcast(whole), F.lit(True))
    return joined.select(*by, "j", (F.col("whole") - F.col("branches")).alias("gain"))


def mona_splits(obs: DataFrame, levels: int) -> tuple[DataFrame, DataFrame]:
    """Rows with their node after `levels` splits (heap numbers; 2i takes bit 0), and the splits node, j."""
    spark = obs.sparkSession
    now = obs.select("id", "v", F.lit(1).cast("long").alias("node"))
    splits, used = [], {1: []}
    for _ in range(levels):
        taken = spark.createDataFrame([(n, j) for n, js in used.items() for j in js], "node long, j int")
        gain = information_gain(now, "node").join(F.broadcast(taken), ["node", "j"], "left_anti")
        best = gain.groupBy("node").agg(F.min(F.struct((-F.round("gain", 9)).alias("g"), "j")).alias("m")).select("node", F.col("m.j").cast("int").alias("j")).collect()  # 2**level rows
        splits += [tuple(r) for r in best]
        used = {2 * r.node + side: [*used[r.node], r.j] for r in best for side in (0, 1)}
        small = spark.createDataFrame([tuple(r) for r in best], "node long, j int")
        now = now.join(F.broadcast(small), "node").select("id", "v", (F.col("node") * 2 + F.get("v", F.col("j") - 1)).alias("node"))
    return now, spark.createDataFrame(splits, "node long, j int")


def mona(obs: DataFrame, n_splits: int) -> DataFrame:
    """id, cluster: the leaves of a tree of n_splits = 2**d - 1 nodes, numbered by first id."""
    levels = (n_splits + 1).bit_length() - 1
    if n_splits != 2**levels - 1:
        raise ValueError("n_splits must be 2**d - 1")
    rows, _ = mona_splits(obs, levels)
    leaf = rows.groupBy("node").agg(F.min("id").alias("first")).withColumn("cluster", F.row_number().over(Window.orderBy("first"))).select("node", "cluster")
    return rows.join(F.broadcast(leaf), "node").select("id", "cluster")
