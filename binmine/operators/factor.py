"""Matrix-factor models: the general binary model, the block model, and PROXIMUS patterns."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from binmine.functions.bits import hamming, nearest, packed, popcount, ranked, seeded, shared
from binmine.functions.kernels import GUARD
from binmine.operators import merge, representatives
from binmine.session import checkpointed, discard, scratch


def _unsettled(rounds: int) -> RuntimeError:
    return RuntimeError(f"the objective still falls after {rounds} rounds")


def patterns(obs: DataFrame, labels: DataFrame, k: int) -> DataFrame:
    """cluster, v: bit j is one where a cluster's mean of it is over 1 / k."""
    cells = obs.join(labels, "id").select("cluster", F.posexplode("v").alias("j", "b")).groupBy("cluster", "j").agg((F.sum("b") * k > F.count(F.lit(1))).cast("tinyint").alias("b"))
    return cells.groupBy("cluster").agg(F.transform(F.array_sort(F.collect_list(F.struct("j", "b"))), lambda x: x["b"]).alias("v"))


def pattern_objective(obs: DataFrame, labels: DataFrame, pats: DataFrame) -> DataFrame:
    """objective: sum of absolute differences of rows and their cluster's pattern."""
    both = obs.join(labels, "id").join(F.broadcast(pats.withColumnRenamed("v", "m")), "cluster")
    return both.agg(F.sum(F.aggregate(F.zip_with("v", "m", lambda a, b: F.abs(a - b).cast("long")), F.lit(0).cast("long"), lambda s, x: s + x)).alias("objective"))


def binary_model(obs: DataFrame, k: int, seed: int = 1, rounds: int = GUARD) -> DataFrame:
    """id, cluster: rows go to the nearest pattern, patterns follow, while the objective falls; the last rows' places count.

    Rows start in a cluster given by a seeded hash of their id. An error if it still falls after so many rounds.
    """
    labels = obs.select("id", (F.conv(F.substring(seeded(seed), 1, 8), 16, 10).cast("long") % k + 1).cast("int").alias("cluster"))
    p = len(obs.select("v").first().v)
    last = None
    for _ in range(rounds):
        found = {r.cluster: r.v for r in patterns(obs, labels, k).collect()}  # k rows
        pats = obs.sparkSession.createDataFrame([(c, found.get(c, [0] * p)) for c in range(1, k + 1)], "cluster int, v array<tinyint>")
        labels = nearest(obs, pats).select("id", "cluster")
        now = pattern_objective(obs, labels, pats).first().objective
        if last is not None and now >= last:
            break
        last = now
    else:
        raise _unsettled(rounds)
    return labels


def binary_kernel(k: int, seed: int):
    def run(x: np.ndarray, chunk: int = 0) -> tuple[np.ndarray, np.ndarray]:
        label = np.random.default_rng(seed + chunk).integers(0, k, len(x))
        last = None
        for _ in range(GUARD):
            b = np.array([(x[label == c].mean(0) > 1 / k) if (label == c).any() else np.zeros(x.shape[1]) for c in range(k)]).astype(int)
            d = (x[:, None, :] != b[None]).sum(2)
            label = d.argmin(1)
            now = d.min(1).sum()
            if last is not None and now >= last:
                break
            last = now
        else:
            raise _unsettled(GUARD)
        label = merge.dense(label)
        return label, merge.medoids(x, label, 1000, seed)

    return run


def binary_model_par(obs: DataFrame, k: int, chunks: int, seed: int = 1) -> DataFrame:
    return merge.merge(merge.local_clusters(obs, chunks, binary_kernel(k, seed)), merge.by_pam(k))


def contiguous(n: int, k: int) -> str:
    """SQL of the block (from 1) of a position from 1, with bounds floor(i n / k)."""
    return "case " + " ".join(f"when pos <= {n * i // k} then {i}" for i in range(1, k)) + f" else {k} end"


def _column_sums(rows: DataFrame) -> DataFrame:
    """rowcluster, j, s (ones), n (rows): a row for each row block and column; all that later steps need of the rows."""
    return rows.select(F.col("cluster").alias("rowcluster"), F.posexplode("v").alias("j0", "b")).groupBy("rowcluster", (F.col("j0") + 1).alias("j")).agg(F.sum("b").alias("s"), F.count(F.lit(1)).alias("n"))


def block_means(obs: DataFrame, labels: DataFrame, columns: DataFrame) -> DataFrame:
    """rowcluster, colcluster, mean, n; columns: j, colcluster (few). Zero means get a guard of 1e-8."""
    return _means(_column_sums(obs.join(labels, "id")), columns)


def _means(sums: DataFrame, columns: DataFrame) -> DataFrame:
    m = sums.join(F.broadcast(columns), "j").groupBy("rowcluster", "colcluster").agg(F.sum("s").alias("s"), F.sum("n").alias("n"))
    return m.select("rowcluster", "colcluster", F.expr("if(s = 0, 1e-8D, s / n)").alias("mean"), "n")


def _with_costs(obs: DataFrame, columns: DataFrame, means: DataFrame) -> DataFrame:
    """obs and __costs, an array of (c, rowcluster): each row block's squared difference, rounded, from the row's sums over column blocks.

    Both small tables come as one row, so rows are neither exploded nor shuffled.
    """
    blocks = columns.groupBy("colcluster").agg(F.collect_list("j").alias("js"))
    per = means.join(blocks, "colcluster").groupBy("rowcluster").agg(F.collect_list(F.struct("mean", "js")).alias("cells"))
    one = per.agg(F.collect_list(F.struct("rowcluster", "cells")).alias("__blocks"))
    ones = lambda c: F.aggregate(c["js"], F.lit(0), lambda a, j: a + F.get("v", j - 1).cast("int"))
    cell = lambda c: ones(c) * (1 - 2 * c["mean"]) + F.size(c["js"]) * c["mean"] * c["mean"]
    cost = lambda r: F.aggregate(F.transform(r["cells"], cell), F.lit(0.0), lambda a, x: a + x)
    return obs.crossJoin(F.broadcast(one)).withColumn("__costs", F.transform("__blocks", lambda r: F.struct(cost(r).alias("c"), r["rowcluster"].alias("rowcluster")))).drop("__blocks")


def _placed(obs: DataFrame, columns: DataFrame, means: DataFrame, variant: str) -> DataFrame:
    """id, v, cluster (the block of least difference, the lowest on ties)."""
    if variant == "reference":
        columns = columns.where(F.col("colcluster") == columns.agg(F.max("colcluster")).first()[0])
    best = F.array_min(F.transform("__costs", lambda x: F.struct(F.round(x["c"], 9).alias("c"), x["rowcluster"].alias("rowcluster"))))
    return _with_costs(obs.select("id", "v"), columns, means).select("id", "v", best["rowcluster"].alias("cluster"))


def block_rows(obs: DataFrame, columns: DataFrame, means: DataFrame, variant: str = "full") -> DataFrame:
    """id, cluster: the row block of least squared difference; from row sums, as the data are 0/1.

    Variant "reference" lets only the last column block count.
    """
    return _placed(obs, columns, means, variant).select("id", "cluster")


def block_columns(obs: DataFrame, labels: DataFrame, means: DataFrame) -> DataFrame:
    """j, colcluster of least squared difference, from each column's sums over row blocks."""
    return _columns(_column_sums(obs.join(labels, "id")), means)


def _columns(sums: DataFrame, means: DataFrame) -> DataFrame:
    cost = sums.join(F.broadcast(means.select("rowcluster", "colcluster", "mean")), "rowcluster").groupBy("j", "colcluster").agg(F.sum(F.expr("s * (1 - 2 * mean) + n * mean * mean")).alias("c"))
    return cost.groupBy("j").agg(F.min(F.struct(F.round("c", 9).alias("c"), "colcluster")).alias("m")).select("j", F.col("m.colcluster").alias("colcluster"))


def block_objective(obs: DataFrame, labels: DataFrame, columns: DataFrame, means: DataFrame) -> DataFrame:
    """objective: the Frobenius norm of the data less its block means."""
    return _objective(_column_sums(obs.join(labels, "id")), columns, means)


def _objective(sums: DataFrame, columns: DataFrame, means: DataFrame) -> DataFrame:
    return sums.join(F.broadcast(columns), "j").join(F.broadcast(means.drop("n")), ["rowcluster", "colcluster"]).agg(F.expr("sqrt(sum(s * (1 - 2 * mean) + n * mean * mean))").alias("objective"))


def first_blocks(obs: DataFrame, k: int, c: int) -> tuple[DataFrame, DataFrame]:
    """Contiguous row blocks in id order and column blocks."""
    n = obs.count()
    p = len(obs.select("v").first().v)
    labels = ranked(obs.select("id"), "id", "pos").select("id", F.expr(contiguous(n, k)).alias("cluster"))
    cols = obs.sparkSession.range(1, p + 1).select(F.col("id").cast("int").alias("j"), F.col("id").alias("pos")).select("j", F.expr(contiguous(p, c)).alias("colcluster"))
    return labels, cols


def _small(df: DataFrame) -> DataFrame:
    """A table of a few rows (blocks, or one for each column) without its lineage, so that plans do not grow by rounds."""
    return df.sparkSession.createDataFrame(df.collect(), df.schema)


def block_model(obs: DataFrame, k: int, c: int, rounds: int = GUARD, variant: str = "full") -> tuple[DataFrame, DataFrame]:
    """Row labels (id, cluster) and column labels (j, colcluster); steps alternate while the objective falls.

    An error if it still falls after so many rounds.
    """
    labels, cols = first_blocks(obs, k, c)
    means, last = _small(block_means(obs, labels, cols)), None
    for _ in range(rounds):
        new = _placed(obs, cols, means, variant)
        sums = _small(_column_sums(new))  # the round's one pass over the rows
        new_cols = _small(_columns(sums, means))
        new_means = _small(_means(sums, new_cols))
        now = _objective(sums, new_cols, new_means).first().objective
        if last is not None and now >= last - 1e-12:
            break
        labels, cols, means, last = new.select("id", "cluster"), new_cols, new_means, now
    else:
        raise _unsettled(rounds)
    return labels, cols


def block_kernel(k: int, c: int, seed: int):
    def run(x: np.ndarray, chunk: int = 0) -> tuple[np.ndarray, np.ndarray]:
        n, p = x.shape
        a = np.searchsorted(np.array([n * i // k for i in range(1, k + 1)]), np.arange(1, n + 1))
        b = np.searchsorted(np.array([p * i // c for i in range(1, c + 1)]), np.arange(1, p + 1))
        last = None
        for _ in range(GUARD):
            m = np.array([[x[np.ix_(a == i, b == j)].mean() if (a == i).any() and (b == j).any() else 0 for j in range(c)] for i in range(k)])
            m = np.where(m == 0, 1e-8, m)
            new = ((x[:, None, :] - m[:, b][None]) ** 2).sum(2).argmin(1)
            nb = ((x.T[:, None, :] - m.T[:, new][None]) ** 2).sum(2).argmin(1)
            now = float(((x - m[np.ix_(new, nb)]) ** 2).sum())
            if last is not None and now >= last:
                break
            a, b, last = new, nb, now
        else:
            raise _unsettled(GUARD)
        label = merge.dense(a)
        return label, merge.medoids(x, label, 1000, seed)

    return run


def block_model_par(obs: DataFrame, k: int, c: int, chunks: int, seed: int = 1) -> DataFrame:
    return merge.merge(merge.local_clusters(obs, chunks, block_kernel(k, c, seed)), merge.by_pam(k))


def _words(x: np.ndarray) -> np.ndarray:
    """0/1 rows as words of 64 bits, padded with zeros."""
    packed = np.packbits(x.astype(bool), axis=1)
    return np.ascontiguousarray(np.pad(packed, ((0, 0), (0, -packed.shape[1] % 8)))).view(np.uint64)


def _bit_sums(words: np.ndarray) -> np.ndarray:
    """Ones of each bit; 255 rows at a time, which a byte can count."""
    out = np.zeros(words.shape[1] * 64, np.int64)
    for at in range(0, len(words), 255 * 256):
        bits = np.unpackbits(words[at : at + 255 * 256].view(np.uint8), axis=1)
        whole = len(bits) // 255 * 255
        out += bits[:whole].reshape(-1, 255, len(out)).sum(1, dtype=np.uint8).sum(0, dtype=np.int64) + bits[whole:].sum(0, dtype=np.int64)
    return out


def _common(words: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Ones that each row shares with y."""
    if words.shape[1] == 1:
        return np.bitwise_count(words[:, 0] & y[0])
    return np.bitwise_count(words & y).sum(1, dtype=np.int64)


def rank_one(words: np.ndarray, ones: np.ndarray, sums: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows, pattern (words) and shared ones of a binary rank-one approximation, alternating from the densest row.

    ones and sums: the ones of each row and of each bit. Sums of a step's rows come from the fewer of the rows it takes or
    leaves. A pattern that gives itself again is where alternating ends, as it takes the same rows again.
    """
    y = words[ones.argmax()]
    for _ in range(GUARD):
        common = _common(words, y)
        size = int(np.bitwise_count(y).sum())
        new = common >= (size + 1) // 2
        n = int(np.count_nonzero(new))
        if not n:
            new[common.argmax()], n = True, 1
        s = sums if n == len(new) else _bit_sums(words[new]) if 2 * n < len(new) else sums - _bit_sums(words[~new])
        z = np.packbits(2 * s >= n).view(np.uint64)
        if (z == y).all():
            return new, y, common
        y = z
    raise _unsettled(GUARD)


def proximus_kernel(radius: float):
    """Recursive rank-one patterns: a set all of whose rows are within radius of its pattern is a leaf, others split.

    Rows are words of bits: a step counts the bits of one word or a few for each row, and a set's sums are its parent's
    less its sibling's.
    """

    def run(x: np.ndarray, chunk: int = 0) -> tuple[np.ndarray, np.ndarray]:
        return on_words(_words(x), x.shape[1])

    def on_words(words: np.ndarray, p: int) -> tuple[np.ndarray, np.ndarray]:
        label, reps = np.zeros(len(words), int), []
        todo = [(np.arange(len(words)), words, np.bitwise_count(words).sum(1, dtype=np.int64), _bit_sums(words))]
        while todo:
            at, words, ones, sums = todo.pop()
            rows, y, common = rank_one(words, ones, sums)
            d = ones + int(np.bitwise_count(y).sum()) - 2 * common.astype(np.int64)
            near = d <= radius
            if near.all() or len(at) == 1:
                label[at] = len(reps)
                reps.append(np.unpackbits(y.view(np.uint8))[:p].astype(int))
                continue
            if rows.all():
                if not near.any():
                    near[d.argmin()] = True
                rows = near
            rest = ~rows
            taken, left = words[rows], words[rest]
            own = _bit_sums(taken) if 2 * len(taken) < len(at) else sums - _bit_sums(left)
            todo += [(at[rows], taken, ones[rows], own), (at[rest], left, ones[rest], sums - own)]
        used = merge.dense(label)
        return used, np.array(reps)[label[np.unique(used, return_index=True)[1]]]

    run.on_words = on_words
    return run


def proximus(obs: DataFrame, radius: float, k: int, chunks: int, seed: int = 1) -> DataFrame:
    """id, cluster: patterns of each chunk, clustered by k-means. proximus_tree() needs no chunks."""
    return merge.merge(merge.local_clusters(obs, chunks, proximus_kernel(radius)), merge.by_kmeans(k, seed))


def _node_sums(rows: DataFrame) -> DataFrame:
    """node, n, s (ones of each bit, an array) of rows (node, v); a task adds up its own rows of a node before any shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[str, list] = {}
        for b in batches:
            x = _bit_rows(b.column(1)).astype(np.int64)
            coded = b.column(0).dictionary_encode()
            at = coded.indices.to_numpy(zero_copy_only=False)
            for k, node in enumerate(coded.dictionary.to_pylist()):
                some = x[at == k]
                own = found.setdefault(node, [0, 0])
                own[0], own[1] = own[0] + len(some), own[1] + some.sum(0)
            if len(found) > 10_000:
                yield _sums_batch(found)
                found.clear()
        if found:
            yield _sums_batch(found)

    parts = rows.mapInArrow(run, "node string, n long, s array<long>")
    bits = parts.select("node", "n", F.posexplode("s").alias("j", "s")).groupBy("node", "j").agg(F.sum("n").alias("n"), F.sum("s").alias("s"))
    return bits.groupBy("node").agg(F.max("n").alias("n"), F.transform(F.array_sort(F.collect_list(F.struct("j", "s"))), lambda c: c["s"]).alias("s"))


def _sums_batch(found: dict[str, list]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(found.keys(), pa.string()), pa.array([n for n, _ in found.values()], pa.int64()), pa.array([s.tolist() for _, s in found.values()], pa.list_(pa.int64()))], ["node", "n", "s"])


def _patterns(rows: DataFrame) -> DataFrame:
    """node, y: the pattern of each node of rows (id, v, x, node), where alternating steps no longer change it.

    A node starts from its densest row, the first on ties. A step takes the rows that share half of the pattern's ones at
    least (the one that shares most, if there is none), and the bits that half of these have. All nodes that still move
    take a step in one job.
    """
    first = F.max_by("v", F.struct(popcount("v").alias("ones"), (-F.col("id")).alias("i")))
    now = checkpointed(rows.groupBy("node").agg(first.alias("y")).withColumn("still", F.lit(False)))
    for _ in range(GUARD):
        moving = now.where("not still")
        both = rows.join(moving.select("node", packed("y").alias("p"), popcount("y").alias("ones")), "node").withColumn("common", shared(F.col("x"), F.col("p")))
        taken = _node_sums(both.where("2 * common >= ones").select("node", "v"))
        best = both.groupBy("node").agg(F.max_by("v", F.struct("common", (-F.col("id")).alias("i"))).alias("best"))
        z = F.coalesce(F.transform("s", lambda a: (2 * a >= F.col("n")).cast("tinyint")), F.col("best"))
        step = moving.join(best, "node").join(taken, "node", "left").select("node", z.alias("y"), (z == F.col("y")).alias("still"))
        new = checkpointed(step.unionByName(now.where("still")))
        discard(now)
        now = new
        if now.where("not still").isEmpty():
            return now
    raise _unsettled(GUARD)


#: Rows of a node that is finished in one task, as words of bits (8 bytes for 64) that come in batches.
SMALL = 65_536


def _finished(radius: float):
    """Rows of one small node: its leaves, named below it, and a leaf's pattern on its first row."""
    kernel = proximus_kernel(radius)

    def run(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, words, p = [], [], 0
        for b in batches:
            if b.num_rows:
                x = _bit_rows(b.column("v"))
                ids.append(b.column("id").to_numpy(zero_copy_only=False))
                words.append(_words(x))
                p = x.shape[1]
        ids, words = np.concatenate(ids), np.concatenate(words)
        order = np.argsort(ids, kind="stable")
        ids, words = ids[order], words[order]
        label, reps = kernel.on_words(words, p)
        firsts = np.zeros(len(ids), bool)
        firsts[np.unique(label, return_index=True)[1]] = True
        for at in range(0, len(ids), 8192):
            some = slice(at, at + 8192)
            y = [reps[k].tolist() if f else None for k, f in zip(label[some].tolist(), firsts[some].tolist(), strict=True)]
            node = [f"{key[0].as_py()}.{k}" for k in label[some].tolist()]
            yield pa.RecordBatch.from_arrays([pa.array(ids[some], pa.int64()), pa.array(node, pa.string()), pa.array(y, pa.list_(pa.int8()))], ["id", "node", "y"])

    return run


def _bit_rows(column: pa.Array) -> np.ndarray:
    """The 0/1 rows of a column of arrays of one length."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def proximus_tree(obs: DataFrame, radius: float, small: int = SMALL) -> tuple[DataFrame, DataFrame]:
    """labels (id, cluster) and patterns (cluster, v) of one recursion over the whole table, a level at a time.

    A node all of whose rows are within radius of its pattern, or of one row, is a leaf; others split into the rows that
    share half of the pattern's ones and the rest, or, where that is all rows, into those within radius (the nearest row, if
    none is) and the rest. All nodes of a level alternate in the same jobs. Nodes of at most `small` rows are finished by the
    same steps in a task each, all in one job, which changes no label; no task holds a larger node. Clusters are numbered by
    their first id. A null row is in no cluster.
    """
    spark, out = obs.sparkSession, scratch(obs.sparkSession, "proximus")
    rows, level = checkpointed(obs.where("v is not null").select("id", "v", packed("v").alias("x"), F.lit("").alias("node"))), 0
    while True:
        size = checkpointed(rows.groupBy("node").agg(F.count(F.lit(1)).alias("rows")))
        few = rows.join(size.where(F.col("rows") <= small), "node").select("id", "v", "node")
        few.groupBy("node").applyInArrow(_finished(radius), "id long, node string, y array<tinyint>").write.parquet(f"{out}/level={level}/kind=small")
        large = checkpointed(rows.join(size.where(F.col("rows") > small).select("node"), "node"))
        discard(rows, size)
        rows = large
        if rows.isEmpty():
            discard(rows)
            break
        y = _patterns(rows)
        met = rows.join(y.select("node", packed("y").alias("p"), popcount("y").alias("ones")), "node").select("id", "v", "x", "node", (2 * shared(F.col("x"), F.col("p")) >= F.col("ones")).alias("in"), hamming(F.col("x"), F.col("p")).alias("d"))
        per = met.groupBy("node").agg(F.count(F.lit(1)).alias("n"), F.max("d").alias("most"), F.min(F.struct("d", "id")).alias("least"), F.count_if("in").alias("taken"))
        per = checkpointed(per.join(y.select("node", "y"), "node").withColumn("leaf", (F.col("most") <= radius) | (F.col("n") == 1)))
        by_pattern = (F.col("taken") > 0) & (F.col("taken") < F.col("n"))
        near = F.when(F.col("least.d") <= radius, F.col("d") <= radius).otherwise(F.col("id") == F.col("least.id"))
        told = met.join(per, "node")
        told.where("leaf").select("id", "node", F.when(F.col("id") == F.col("least.id"), F.col("y")).alias("y")).write.parquet(f"{out}/level={level}/kind=large")
        rest = checkpointed(told.where("not leaf").select("id", "v", "x", F.concat("node", F.when(F.when(by_pattern, F.col("in")).otherwise(near), "1").otherwise("0")).alias("node")))
        discard(rows, y, per)
        rows, level = rest, level + 1
    found = spark.read.schema("id long, node string, y array<tinyint>, level int, kind string").parquet(out)
    number = ranked(found.groupBy("node").agg(F.min("id").alias("first"), F.first("y", ignorenulls=True).alias("v")), "first", "cluster")
    number = checkpointed(number.select("node", F.col("cluster").cast("int").alias("cluster"), "v"))
    return found.join(number, "node").select("id", "cluster"), number.select("cluster", "v")


def proximus_whole(obs: DataFrame, radius: float, k: int, seed: int = 1) -> DataFrame:
    """id, cluster: the patterns of one recursion over the whole table, clustered by k-means as those of chunks are."""
    labels, found = proximus_tree(obs, radius)
    points = found.select((F.col("cluster") - 1).cast("long").alias("idx"), F.col("v").cast("array<double>").alias("v"))
    of = representatives.kmeans(checkpointed(points), k, seed).select((F.col("idx") + 1).cast("int").alias("pattern"), "cluster")
    return labels.withColumnRenamed("cluster", "pattern").join(of, "pattern").select("id", "cluster")
