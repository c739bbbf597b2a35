"""Canopies and sorted neighbourhoods."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from binmine.functions.bits import chunked, hamming, packed, popcount, seeded, within
from binmine.functions.kernels import distances
from binmine.operators import merge
from binmine.operators.graph import connected_components
from binmine.session import checkpointed, discard, scratch


def canopy_pass(remaining: DataFrame, centre: list[int], t1: float) -> DataFrame:
    """id of the remaining rows nearer than t1 to centre, with their distance in bits; counts compare, not ratios."""
    c = packed(F.array(*(F.lit(int(x)) for x in centre)))
    return remaining.select("id", hamming(packed("v"), c).alias("d")).where(F.col("d") < t1 * len(centre))


def canopy_kernel(t1: float, t2: float, seed: int | None = None):
    """Labels and centres of one matrix: first remaining row is the centre, later canopies overwrite, nearer than t2 are taken."""

    def run(x: np.ndarray, chunk: int = 0) -> tuple[np.ndarray, np.ndarray]:
        n, p = x.shape
        left = np.arange(n) if seed is None else np.random.default_rng(seed + chunk).permutation(n)
        label, centres = np.full(n, -1), []
        while len(left):
            d = (x[left] != x[left[0]]).sum(1)
            label[left[d < t1 * p]] = len(centres)
            centres.append(x[left[0]])
            left = left[d >= t2 * p]
        used = merge.dense(label)
        return used, np.array(centres)[[label[np.flatnonzero(used == k)[0]] for k in range(used.max() + 1)]]

    return run


#: Rows of a round of canopies that are looked at together.
PREFIX = 1024


def _first_centres(x: np.ndarray, t2: float) -> np.ndarray:
    """Rows that are no nearer than t2 to an earlier such row."""
    near = np.rint(distances(x) * x.shape[1]) < t2 * x.shape[1]
    left, out = np.ones(len(x), bool), []
    for i in range(len(x)):
        if left[i]:
            out.append(i)
            left &= ~near[i]
    return np.array(out, int)


def canopy(obs: DataFrame, t1: float, t2: float, seed: int = 1, prefix: int = PREFIX) -> DataFrame:
    """id, cluster. Centres are rows, in seeded order, that no earlier centre is nearer than t2 to; 0 < t2 <= t1, else rows
    could stay without a label or for ever.

    That is the lexicographically first maximal independent set of rows nearer than t2, found in rounds: of the first
    `prefix` rows that are left, those without an earlier neighbour that is a centre become centres at once, all rows left
    meet them, and those near one go, labelled by the first (a row's last canopy is the one that takes it, so t1 moves no
    label). Whether a row is a centre depends on earlier rows only, so the labels are those of one row after the other. The
    driver holds `prefix` rows; every row meets every centre once, and no task holds the table. A null row is in no canopy.
    """
    if not 0 < t2 <= t1:
        raise ValueError("canopies need 0 < t2 <= t1")
    spark, out = obs.sparkSession, scratch(obs.sparkSession, "canopies")
    left = checkpointed(obs.where("v is not null").select("id", "v", seeded(seed).alias("h")))
    number, rounds = 0, 0
    while True:
        first = left.orderBy("h", "id").limit(prefix).select("v").collect()
        if not first:
            break
        x = np.array([r.v for r in first], np.int8).reshape(len(first), -1)
        centres = [(number + k + 1, x[i].tolist()) for k, i in enumerate(_first_centres(x, t2))]
        number, rounds = number + len(centres), rounds + 1
        near = within(left, spark.createDataFrame(centres, "cluster int, v array<tinyint>"), t2, "v", "h")
        # rows of the prefix are all taken, so each round ends with fewer rows and those taken are written once
        met = checkpointed(near)
        met.where("cluster is not null").select("id", "cluster").write.parquet(f"{out}/round={rounds}")
        rest = checkpointed(met.where("cluster is null").select("id", "v", "h"))
        discard(left, met)
        left = rest
    discard(left)
    if not rounds:
        return spark.createDataFrame([], "id long, cluster int")
    return spark.read.schema("id long, cluster int, round int").parquet(out).select("id", "cluster")


def canopy_par(obs: DataFrame, t1: float, t2: float, k: int, chunks: int, seed: int = 1) -> DataFrame:
    """Canopies of each chunk, their centres clustered by k-means."""
    if not 0 < t2 <= t1:
        raise ValueError("canopies need 0 < t2 <= t1")
    return merge.merge(merge.local_clusters(obs, chunks, canopy_kernel(t1, t2, seed)), merge.by_kmeans(k, seed))


def neighbour_edges(obs: DataFrame, window: int, threshold: float, chunks: int = 1, order: str | None = None, seed: int = 1, block: int = 10_000) -> DataFrame:
    """a, b, d: each row and its nearest predecessor among the last `window` of its chunk, if nearer than threshold.

    order "popcount" sorts by ones, then id; else by seeded hash. Windows end at chunks of the order, which are part of
    the result. block is not: rows are dealt to tasks in blocks of the order, each with the last `window` rows of the one before.
    """
    key = F.concat(F.lpad(popcount("v").cast("string"), 9, "0"), F.lit("-"), F.lpad(F.col("id").cast("string"), 19, "0")) if order == "popcount" else F.concat(seeded(seed), F.lit("-"), F.lpad(F.col("id").cast("string"), 19, "0"))
    p = F.size("v")
    size = max(block, window)
    rows = chunked(obs.select("id", packed("v").alias("x"), p.alias("p"), key.alias("k")), chunks, key="k", rank="rn").drop("k").withColumn("home", F.expr(f"(rn - 1) div {size}"))
    dealt = rows.withColumn("at", F.explode(F.when(F.expr(f"(rn - 1) % {size} >= {size - window}"), F.array("home", F.col("home") + 1)).otherwise(F.array("home"))))
    frame = Window.partitionBy("at").orderBy("rn").rowsBetween(-window, -1)
    before = F.filter(F.collect_list(F.struct("chunk", "rn", "id", "x")).over(frame), lambda b: b["chunk"] == F.col("chunk"))
    near = F.array_min(F.transform("before", lambda b: F.struct(hamming(F.col("x"), b["x"]).alias("d"), b["rn"].alias("rn"), b["id"].alias("id"))))
    return dealt.withColumn("before", before).where("at = home and size(before) > 0").select("id", "p", near.alias("n")).where(F.col("n.d") < threshold * F.col("p")).select(F.col("id").alias("a"), F.col("n.id").alias("b"), F.col("n.d").alias("d"))


def default_threshold(obs: DataFrame, seed: int = 1) -> float:
    """Mean of the whole distance matrix, zeros included, of 100 rows."""
    from binmine.functions.bits import sample_rows
    from binmine.functions.kernels import distances

    return float(distances(np.array([r.v for r in sample_rows(obs.select("id", "v"), 100, seed).collect()])).mean())


def sorted_neighborhood(obs: DataFrame, window: int = 30, threshold: float | None = None, runs: int = 3, all_random: bool = True, chunks: int = 1, seed: int = 1) -> DataFrame:
    """id, cluster: components of the nearest-predecessor links of all runs (the first sorted by ones, unless all_random)."""
    t = default_threshold(obs, seed) if threshold is None else threshold
    edges = None
    for r in range(runs):
        e = neighbour_edges(obs, window, t, chunks, "popcount" if r == 0 and not all_random else None, seed + r).select("a", "b")
        edges = e if edges is None else edges.unionByName(e)
    return connected_components(edges, obs).withColumnRenamed("component", "cluster")
