"""CLARA and CLARANS: samples and swaps are small, costs are Spark aggregates over all rows."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from binmine.functions.bits import hamming, nearest, packed, sample_rows
from binmine.functions.kernels import distances, pam


def _reps(obs: DataFrame, rows: list) -> DataFrame:
    return obs.sparkSession.createDataFrame([(i + 1, [int(x) for x in v]) for i, v in enumerate(rows)], "cluster int, v array<tinyint>")


def candidate_costs(obs: DataFrame, candidates: DataFrame) -> DataFrame:
    """cand, cost: for each candidate set of medoids (cand, cluster, v; few rows) the sum of differing bits to the nearest.

    All candidates are costed in one job; rows meet only the broadcast medoids.
    """
    x = obs.select("id", packed("v").alias("x"))
    r = candidates.groupBy("cand").agg(F.collect_list(packed("v")).alias("rs"))
    near = F.array_min(F.transform("rs", lambda m: hamming(F.col("x"), m)))
    return x.crossJoin(F.broadcast(r)).groupBy("cand").agg(F.sum(near).cast("long").alias("cost"))


def clara(obs: DataFrame, k: int, samples: int = 5, size: int = 100, seed: int = 1, compat: bool = False) -> DataFrame:
    """id, cluster: medoids of the sample that cost least over all rows (compat: of the last that beat its predecessor)."""
    sets = []
    for i in range(samples):
        x = np.array([r.v for r in sample_rows(obs.select("id", "v"), size, seed + i).collect()])
        sets.append(x[np.sort(pam(distances(x), k))])
    spark = obs.sparkSession
    cand = spark.createDataFrame([(i, j + 1, [int(b) for b in v]) for i, s in enumerate(sets) for j, v in enumerate(s)], "cand int, cluster int, v array<tinyint>")
    cost = {r.cand: r.cost for r in candidate_costs(obs, cand).collect()}
    best = min(cost, key=lambda c: (cost[c], c))
    if compat:
        best, last = 0, cost[0]
        for c in range(1, samples):
            best, last = (c if cost[c] < last else best), cost[c]
    return nearest(obs, _reps(obs, sets[best])).select("id", "cluster")


def clarans(obs: DataFrame, k: int, numlocal: int = 2, maxneighbor: int = 20, parallel: int = 5, seed: int = 1, compat: bool = False) -> tuple[list, DataFrame, int]:
    """Medoids, labels (id, cluster) and cost. Each round costs `parallel` random single swaps in one job.

    The round counter starts anew after an improvement (compat: a restart ends at its first round without one). Rows to
    swap in are drawn from all rows, fresh ones for some rounds at a time, so nothing but candidates reaches the driver.
    """
    spark = obs.sparkSession
    rng = np.random.default_rng(seed)
    draws = 0

    def drawn(n: int) -> list:
        nonlocal draws
        draws += 1
        return [r.v for r in sample_rows(obs.select("id", "v"), n, seed * 1_000_003 + draws).collect()]

    def costs(sets: list) -> list[int]:
        cand = spark.createDataFrame([(i, j + 1, [int(b) for b in v]) for i, s in enumerate(sets) for j, v in enumerate(s)], "cand int, cluster int, v array<tinyint>")
        found = {r.cand: r.cost for r in candidate_costs(obs, cand).collect()}
        return [found[i] for i in range(len(sets))]

    best = None
    for _ in range(numlocal):
        now, pool = drawn(k), []
        cost, j = costs([now])[0], 1
        while j <= maxneighbor:
            tries = []
            for _ in range(parallel):
                t = list(now)
                pool = pool or drawn(10 * parallel)
                t[rng.integers(len(t))] = pool.pop()
                tries.append(t)
            found = costs(tries)
            i = int(np.argmin(found))
            if found[i] < cost:
                now, cost, j = tries[i], found[i], 1
            elif compat:
                break
            else:
                j += parallel
        if best is None or cost < best[1]:
            best = now, cost
    return best[0], nearest(obs, _reps(obs, best[0])).select("id", "cluster"), best[1]


def cluster_medoids(obs: DataFrame, labels: DataFrame) -> DataFrame:
    """cluster, id of the row with the least sum of distances to the rows of its cluster, and that sum; lowest id on ties.

    A row's sum is linear in its cluster's bit counts (s ones of n at a bit: n - s for a one, s for a zero), so no pairs are made.
    """
    x = obs.join(labels, "id").select("id", "cluster", "v")
    ones = x.select("cluster", F.posexplode("v").alias("j", "b")).groupBy("cluster", "j").agg(F.sum("b").alias("s"), F.count(F.lit(1)).alias("n"))
    bits = ones.groupBy("cluster").agg(F.transform(F.array_sort(F.collect_list(F.struct("j", "s"))), lambda c: c["s"]).alias("s"), F.max("n").alias("n"))
    total = F.aggregate(F.zip_with("v", "s", lambda b, s: F.when(b == 1, F.col("n") - s).otherwise(s)), F.lit(0).cast("long"), lambda t, d: t + d)
    sums = x.join(bits, "cluster").select("cluster", "id", total.alias("s"))
    return sums.groupBy("cluster").agg(F.min(F.struct("s", "id")).alias("m")).select("cluster", F.col("m.id").alias("id"), F.col("m.s").alias("total"))
