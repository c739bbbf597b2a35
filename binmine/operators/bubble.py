"""BUBBLE: height-balanced trees of cluster features over Hamming distance, built in each chunk and joined level by level.

A tree keeps at most `budget` leaf features: one more and the threshold is raised and the features themselves, not their
rows, are put into a new tree. Trees of `FAN` chunks at a time are joined the same way, so no task and no driver holds more
than FAN * budget features however many chunks there are, and rows follow their features through small tables of numbers.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from binmine.functions.bits import chunked
from binmine.functions.kernels import distances
from binmine.operators import representatives
from binmine.session import checkpointed, discard

#: Objects near the clustroid that a feature keeps.
NEAR = 10
#: Leaf features that a tree keeps, and trees that are joined at once.
BUDGET, FAN = 1000, 8


class Feature:
    """A leaf cluster: its clustroid with row sum, near objects with row sums, running radius sum and size."""

    def __init__(self, x: np.ndarray) -> None:
        self.n, self.clustroid, self.row_sum, self.radius = 1, x, 0.0, 0.0
        self.near: list[np.ndarray] = []
        self.near_sums: list[float] = []
        self.into: Feature | None = None

    def last(self) -> Feature:
        """The feature that this one has gone into, or itself."""
        f = self
        while f.into is not None:
            f = f.into
        return f

    def merge(self, other: Feature, d: float) -> None:
        """Take in a feature whose clustroid is d away. Row sums over the other side's rows are estimated by its clustroid:
        n times the distance to it and its own row sum. The least becomes clustroid, the next NEAR are kept."""
        objects, sums = [], []
        for a, b in ((self, other), (other, self)):
            for o, s in zip([a.clustroid, *a.near], [a.row_sum, *a.near_sums], strict=True):
                objects.append(o)
                sums.append(s + b.n * float((o != b.clustroid).mean()) + b.row_sum)
        best = np.argsort(np.round(sums, 9), kind="stable")[: NEAR + 1].tolist()
        self.n, self.radius = self.n + other.n, self.radius + other.radius + other.n * d
        self.clustroid, self.row_sum = objects[best[0]], sums[best[0]]
        self.near, self.near_sums = [objects[i] for i in best[1:]], [sums[i] for i in best[1:]]
        other.into = self

    def absorb(self, x: np.ndarray, d: float) -> None:
        """Exact row sum for small features, n r + n d beyond; the least row sum becomes clustroid."""
        if self.n <= NEAR:
            own = d + sum(float((x != o).mean()) for o in self.near)
        else:
            own = self.n * (self.radius / self.n) + self.n * d
        self.near_sums = [s + float((x != o).mean()) for s, o in zip(self.near_sums, self.near, strict=True)]
        self.row_sum += d
        self.radius += d
        self.n += 1
        sums = [*self.near_sums, own]
        best = int(np.argmin(sums))
        if sums[best] < self.row_sum:
            old, old_sum = self.clustroid, self.row_sum
            if best == len(self.near):
                self.clustroid, self.row_sum = x, own
                self._keep(old, old_sum)
            else:
                self.clustroid, self.row_sum = self.near[best], self.near_sums[best]
                self.near[best], self.near_sums[best] = old, old_sum
                self._keep(x, own)
        else:
            self._keep(x, own)

    def _keep(self, x: np.ndarray, s: float) -> None:
        if len(self.near) < NEAR:
            self.near.append(x)
            self.near_sums.append(s)
        else:
            worst = int(np.argmax(self.near_sums))
            if s < self.near_sums[worst]:
                self.near[worst], self.near_sums[worst] = x, s


class Node:
    """entries: features of a leaf, else child nodes; a node's clustroid is its entries' medoid."""

    def __init__(self, leaf: bool, entries: list) -> None:
        self.leaf, self.entries = leaf, entries
        self.refresh()

    def refresh(self) -> None:
        m = np.array([e.clustroid for e in self.entries])
        self.points = m
        self.clustroid = m[distances(m).sum(1).argmin()] if len(m) else None

    def nearest(self, x: np.ndarray) -> tuple[int, float]:
        d = (self.points != x).mean(1)
        i = int(d.argmin())
        return i, float(d[i])

    def split(self, most: int) -> Node:
        """The half of the entries nearest to an end of the first farthest pair moves to a new node; both are refreshed."""
        d = distances(self.points)
        end = int(np.unravel_index(d.argmax(), d.shape)[0])
        close = set(np.argsort(d[end], kind="stable")[: most // 2].tolist())
        other = Node(self.leaf, [e for i, e in enumerate(self.entries) if i in close])
        self.entries = [e for i, e in enumerate(self.entries) if i not in close]
        self.refresh()
        return other


class Tree:
    """threshold: distance at which a leaf cluster takes a row. most: entries of a node, even. budget: most leaf clusters."""

    def __init__(self, threshold: float, most: int, budget: int = BUDGET) -> None:
        if most < 2 or most % 2:
            raise ValueError("a node's capacity must be even")
        self.threshold, self.most, self.budget, self.root, self.levels, self.size = threshold, most, budget, None, 0, 0

    def insert(self, x: np.ndarray) -> Feature:
        """The row's own feature, whose last() is the leaf cluster that has it."""
        f = Feature(x)
        self.add(f)
        return f

    def add(self, f: Feature) -> None:
        """Put a feature in; beyond the budget raise the threshold and put all features into a new tree."""
        self._place(f)
        while self.size > self.budget:
            new = Tree(self._raised(), self.most, self.budget)
            for g in list(self.leaves()):
                new._place(g)
            self.threshold, self.root, self.levels, self.size = new.threshold, new.root, new.levels, new.size

    def _raised(self) -> float:
        """The mean over leaves of their closest entries' distance, but a bit more than the threshold at least."""
        gaps = []
        for node in self._leaf_nodes(self.root):
            if len(node.entries) > 1:
                d = distances(node.points)
                gaps.append(float((d + np.eye(len(d)) * 2).min()))
        return max(self.threshold + 1.0 / max(1, len(self.root.clustroid)), float(np.mean(gaps)) if gaps else 0.0)

    def _leaf_nodes(self, node: Node):
        if node.leaf:
            yield node
        else:
            for e in node.entries:
                yield from self._leaf_nodes(e)

    def _place(self, f: Feature) -> None:
        x = f.clustroid
        if self.root is None:
            self.root, self.levels, self.size = Node(True, [f]), 1, 1
            return
        while True:
            path, node = [self.root], self.root
            while not node.leaf:
                node = node.entries[node.nearest(x)[0]]
                path.append(node)
            i, d = node.nearest(x)
            if d <= self.threshold:
                if f.n == 1:
                    node.entries[i].absorb(x, d)
                    f.into = node.entries[i]
                else:
                    node.entries[i].merge(f, d)
            elif len(node.entries) < self.most:
                node.entries.append(f)
                self.size += 1
            else:
                self._split(path)
                continue
            for n in reversed(path):
                n.refresh()
            return

    def _split(self, path: list[Node]) -> None:
        """Split full nodes from the leaf upwards; a split root adds a level."""
        for node in reversed(path):
            if len(node.entries) < self.most:
                break
            other = node.split(self.most)
            up = path.index(node)
            if up:
                path[up - 1].entries.append(other)
                path[up - 1].refresh()
                if len(path[up - 1].entries) <= self.most:
                    break
            else:
                self.root = Node(False, [node, other])
                self.levels += 1
        for n in reversed(path):
            n.refresh()

    def leaves(self, node: Node | None = None):
        node = node or self.root
        for e in node.entries:
            if node.leaf:
                yield e
            else:
                yield from self.leaves(e)


_FEATURE = "n long, v array<tinyint>, row_sum double, radius double, near array<array<tinyint>>, near_sums array<double>, threshold double"
_FIELDS = [c.split()[0] for c in _FEATURE.split(", ")]


def _rows_of(tree: Tree) -> pd.DataFrame:
    """The tree's leaf features in order, numbered from 1."""
    rows = [(k, f.n, f.clustroid.tolist(), f.row_sum, f.radius, [o.tolist() for o in f.near], list(f.near_sums), tree.threshold) for k, f in enumerate(tree.leaves(), 1)]
    return pd.DataFrame(rows, columns=["local", *_FIELDS]).astype({"local": "Int64", "n": "Int64"})


def _with_rows(rows: pd.DataFrame, tree: Tree, first: list[str], chunk: int) -> pd.DataFrame:
    """rows, then the tree's features, in one frame whose arrays are null where there are none."""
    out = pd.concat([rows.astype("Int64"), _rows_of(tree)]).assign(chunk=chunk).reindex(columns=[*first, "chunk", "local", *_FIELDS])
    for c in ("v", "near", "near_sums"):
        out[c] = [x if isinstance(x, list) else None for x in out[c]]
    return out


def _feature(r) -> Feature:
    f = Feature(np.array(r.v, np.int8))
    f.n, f.row_sum, f.radius = int(r.n), float(r.row_sum), float(r.radius)
    f.near, f.near_sums = [np.array(o, np.int8) for o in r.near], [float(x) for x in r.near_sums]
    return f


def _numbered(tree: Tree, found: list[Feature]) -> list[int]:
    number = {id(f): k for k, f in enumerate(tree.leaves(), 1)}
    return [number[id(f.last())] for f in found]


def _trees(obs: DataFrame, threshold: float, most: int, chunks: int, budget: int) -> DataFrame:
    """Rows (id, chunk, local) and the features of their chunk's tree (id null), in one table."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("id")
        tree = Tree(threshold, most, budget)
        found = [tree.insert(np.array(v, np.int8)) for v in pdf["v"]]
        rows = pd.DataFrame({"id": pdf["id"].to_numpy(), "local": _numbered(tree, found)})
        return _with_rows(rows, tree, ["id"], int(pdf["chunk"].iloc[0]))

    return checkpointed(chunked(obs.where("v is not null").select("id", "v"), chunks).groupBy("chunk").applyInPandas(run, f"id long, chunk int, local int, {_FEATURE}"))


def bubble(obs: DataFrame, threshold: float, most: int, chunks: int, budget: int = BUDGET) -> tuple[DataFrame, DataFrame]:
    """labels (id, chunk, local) and clustroids (chunk, local, n, v); local numbers a chunk's leaves from 1.

    One tree for each chunk of id order; chunks and the budget of leaves are part of the result. A null row is in no tree.
    """
    out = _trees(obs, threshold, most, chunks, budget)
    return out.where("id is not null").select("id", "chunk", "local"), out.where("id is null").select("chunk", "local", F.col("n").cast("int").alias("n"), "v")


def _joined(features: DataFrame, most: int, budget: int, fan: int) -> DataFrame:
    """Features of the trees of `fan` chunks at a time put into one tree: where each old one went, and the new ones (old null)."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["chunk", "local"])
        tree = Tree(float(pdf["threshold"].max()), most, budget)
        found = [_feature(r) for r in pdf.itertuples()]
        for f in found:
            tree.add(f)
        went = pd.DataFrame({"old_chunk": pdf["chunk"].to_numpy(), "old_local": pdf["local"].to_numpy(), "local": _numbered(tree, found)})
        return _with_rows(went, tree, ["old_chunk", "old_local"], int(pdf["group"].iloc[0]))

    grouped = features.withColumn("group", F.expr(f"cast((chunk - 1) div {fan} + 1 as int)"))
    return checkpointed(grouped.groupBy("group").applyInPandas(run, f"old_chunk int, old_local int, chunk int, local int, {_FEATURE}"))


def joined_trees(obs: DataFrame, threshold: float, most: int, chunks: int, budget: int = BUDGET, fan: int = FAN) -> tuple[DataFrame, DataFrame]:
    """id, leaf (from 1) of the one tree that all chunks' trees end in, and its leaves (leaf, n, v); at most budget of them."""
    trees = _trees(obs, threshold, most, chunks, budget)
    features = trees.where("id is null").drop("id")
    went = features.select(F.col("chunk").alias("c0"), F.col("local").alias("l0"), "chunk", "local")
    tables = [trees]
    while chunks > 1:
        step = _joined(features, most, budget, fan)
        tables.append(step)
        moved = step.where("old_chunk is not null").select(F.col("old_chunk").alias("chunk"), F.col("old_local").alias("local"), F.col("chunk").alias("c1"), F.col("local").alias("l1"))
        went = went.join(moved, ["chunk", "local"]).select("c0", "l0", F.col("c1").alias("chunk"), F.col("l1").alias("local"))
        features = step.where("old_chunk is null").drop("old_chunk", "old_local")
        chunks = -(-chunks // fan)
    of = went.select(F.col("c0").alias("chunk"), F.col("l0").alias("local"), F.col("local").alias("leaf"))
    rows = checkpointed(trees.where("id is not null").select("id", "chunk", "local").join(of, ["chunk", "local"]).select("id", "leaf"))
    leaves = checkpointed(features.select(F.col("local").alias("leaf"), "n", "v"))
    discard(*tables)
    return rows, leaves


def bubble_clusters(obs: DataFrame, threshold: float, most: int, chunks: int, k: int, budget: int = BUDGET) -> DataFrame:
    """id, cluster: the clustroids of the joined tree clustered around medoids, or numbered if there are no more than k."""
    rows, leaves = joined_trees(obs, threshold, most, chunks, budget)
    if leaves.count() <= k:
        return rows.withColumnRenamed("leaf", "cluster")
    points = leaves.select((F.col("leaf") - 1).cast("long").alias("idx"), F.col("v").cast("array<double>").alias("v"))
    of = representatives.medoid_clusters(points, k).select((F.col("idx") + 1).alias("leaf"), "cluster")
    return rows.join(of, "leaf").select("id", "cluster")
