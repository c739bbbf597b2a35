"""Embedding near-duplicates by an epsilon grid order join.

Unit vectors with cosine c or more lie within epsilon = sqrt(2 - 2c) of each other, and no orthogonal projection lengthens that
distance. Vectors are projected on leading principal dimensions, put into grid cells of side epsilon, sorted by
cells in lexicographic order and cut into blocks. Intervals of that sequence are joined recursively, first over
blocks (as joins of small tables of bounding boxes), then inside two blocks, and two intervals whose boxes are
further apart than epsilon are skipped. What remains is compared in double precision.

Equal vectors are one class with a multiplicity, so copies cost no pairs; links between classes are counted where they
are found, and only enough of them to span each component leave a task.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from .common import discard, map_texts, table, written
from .components import Forest, connected_components

COSINE = 0.95
#: Principal dimensions of the grid, and the vectors (drawn by hash) that they are fitted on; they only steer the skipping.
DIMENSIONS, FIT_ROWS = 6, 20_000
#: Vectors of the smallest interval, and children of a node in the tree of blocks.
LEAF, FAN = 256, 16
#: Vectors of a block: a share of all, so that blocks are few and each is sent to few others, between bounds, so that a task holds two.
SHARE, SMALLEST, LARGEST = 6, 2048, 16_384


def usable(v: Column) -> Column:
    """Neither null nor empty nor zero, and all components finite numbers."""
    finite = F.forall(v, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False)))
    return F.coalesce(finite & F.exists(v, lambda x: x != 0), F.lit(False))


def _units(x: np.ndarray) -> np.ndarray:
    """Rows of length one, in double precision; scaled first, so that squares neither overflow nor vanish."""
    x = x.astype(np.float64)
    x /= np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def principal_dimensions(classes: DataFrame, k: int = DIMENSIONS, fit_rows: int = FIT_ROWS) -> np.ndarray:
    """Leading eigenvectors (longest vector's length x k or fewer) of at most fit_rows unit vectors drawn by hash."""
    rows = [r.vec for r in classes.select("rep", "vec").orderBy(F.xxhash64("rep"), "rep").limit(fit_rows).select("vec").toLocalIterator()]
    d = max((len(r) for r in rows), default=1)
    x = np.zeros((len(rows), d))
    for i, r in enumerate(rows):
        x[i, : len(r)] = _units(np.array([r], np.float64))[0]
    x -= x.mean(axis=0) if len(rows) else 0.0
    _, vectors = np.linalg.eigh(x.T @ x)
    return vectors[:, ::-1][:, :k].copy()


def _projected(units: np.ndarray, basis: np.ndarray) -> np.ndarray:
    """Vectors may be longer or shorter than the basis: missing components are zero, and further ones left out."""
    n = min(units.shape[1], len(basis))
    return units[:, :n] @ basis[:n]


def _sides(units: np.ndarray, basis: np.ndarray) -> np.ndarray:
    """The projection, and the length of what it leaves out."""
    p = _projected(units, basis)
    return np.column_stack([p, np.sqrt(np.maximum(0.0, 1.0 - (p * p).sum(axis=1)))])


def _near(eps2: float) -> float:
    """A squared distance with room for what lengths near zero lose by rounding."""
    return eps2 * (1 + 1e-6) + 1e-7


def _cells(basis: np.ndarray, eps: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            vecs = b.column(2)
            size = np.diff(vecs.offsets.to_numpy())
            flat = vecs.flatten().to_numpy(zero_copy_only=False)
            at = np.concatenate([[0], np.cumsum(size)])
            cells = np.zeros((b.num_rows, basis.shape[1]), np.int32)
            for d in np.unique(size):
                rows = np.flatnonzero(size == d)
                x = flat[at[rows][:, None] + np.arange(d)]
                cells[rows] = np.floor(_projected(_units(x), basis) / eps)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(size.astype(np.int32)), *(pa.array(c) for c in cells.T)], [*b.schema.names, "dim", *(f"c{i}" for i in range(basis.shape[1]))])

    return run


def _blocks(basis: np.ndarray, kind: str, size: int):
    k = basis.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, seq = TaskContext.get().partitionId(), 0
        held: list[tuple] = []

        def block(dim: int, reps: list, counts: list, vecs: list) -> pa.RecordBatch:
            nonlocal seq
            x = np.array(vecs, kind)
            p = _sides(_units(x), basis)
            row = {"block": part * (1 << 32) + seq, "dim": dim, "lo": p.min(axis=0).tolist(), "hi": p.max(axis=0).tolist(), "reps": np.array(reps, np.int64).tobytes(), "counts": np.array(counts, np.int64).tobytes(), "vecs": x.tobytes()}
            seq += 1
            return pa.RecordBatch.from_pylist([row], pa.schema([("block", pa.int64()), ("dim", pa.int32()), ("lo", pa.list_(pa.float64())), ("hi", pa.list_(pa.float64())), ("reps", pa.binary()), ("counts", pa.binary()), ("vecs", pa.binary())]))

        for b in batches:
            for rep, n, vec, dim in zip(*(b.column(i).to_pylist() for i in range(4)), strict=True):
                if held and (len(held) >= size or held[0][0] != dim):
                    yield block(held[0][0], *map(list, zip(*(h[1:] for h in held), strict=True)))
                    held = []
                held.append((dim, rep, n, vec))
        if held:
            yield block(held[0][0], *map(list, zip(*(h[1:] for h in held), strict=True)))

    assert k
    return run


def near_blocks(boxes: DataFrame, k: int, eps: float, fan: int = FAN) -> DataFrame:
    """Pairs a <= b of block numbers whose boxes are within eps; boxes: b, dim, lo0.., hi0.. with b gapless from 0.

    A tree of intervals is descended level by level: of two nodes that are near, children that are near go on.
    """
    n = boxes.count()
    levels = max(1, math.ceil(math.log(max(n, 2), fan) - 1e-9))
    pairs = boxes.sparkSession.createDataFrame([(0, 0)], "a long, b long")
    for level in range(levels - 1, -1, -1):
        nodes = boxes.groupBy(F.expr(f"b div {fan**level}").alias("node")).agg(
            F.min("dim").alias("d0"), F.max("dim").alias("d1"), *(F.min(f"lo{i}").alias(f"lo{i}") for i in range(k)), *(F.max(f"hi{i}").alias(f"hi{i}") for i in range(k))
        )
        side = lambda s: nodes.select(*(F.col(c).alias(f"{s}{c}") for c in nodes.columns))
        gap = sum(F.pow(F.greatest(F.lit(0.0), F.col(f"yhi{i}") * -1 + F.col(f"xlo{i}"), F.col(f"ylo{i}") - F.col(f"xhi{i}")), 2) for i in range(k))
        children = pairs.select(F.explode(F.expr(f"sequence(a * {fan}, a * {fan} + {fan - 1})")).alias("xnode"), "b").select("xnode", F.explode(F.expr(f"sequence(b * {fan}, b * {fan} + {fan - 1})")).alias("ynode")).where("xnode <= ynode")
        pairs = children.join(side("x"), "xnode").join(side("y"), "ynode").where((gap <= _near(eps * eps)) & F.expr("xd0 <= yd1 and yd0 <= xd1")).select(F.col("xnode").alias("a"), F.col("ynode").alias("b"))
    return pairs


def join_blocks(x: np.ndarray, y: np.ndarray | None, basis: np.ndarray, cosine: float, leaf: int = LEAF) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Rows (i, j) of unit vectors x and y with that cosine or more, interval by interval; y None: pairs i < j of x."""
    eps2 = _near(2 - 2 * cosine)
    own = y is None
    y = x if own else y
    sides = []
    for v in (x, y):
        p = _sides(v, basis)
        n = -(-len(v) // leaf)
        boxes = {(i, i + 1): (p[i * leaf : (i + 1) * leaf].min(axis=0), p[i * leaf : (i + 1) * leaf].max(axis=0)) for i in range(n)}
        sides.append((n, boxes))

    def box(side: int, a: int, b: int):
        boxes = sides[side][1]
        if (a, b) not in boxes:
            m = (a + b) // 2
            (l0, h0), (l1, h1) = box(side, a, m), box(side, m, b)
            boxes[a, b] = np.minimum(l0, l1), np.maximum(h0, h1)
        return boxes[a, b]

    def go(a: int, b: int, c: int, d: int):
        if own and a >= d:
            return
        (xl, xh), (yl, yh) = box(0, a, b), box(1, c, d)
        g = np.maximum(0.0, np.maximum(xl - yh, yl - xh))
        if g @ g > eps2:
            return
        if b - a == 1 and d - c == 1:
            if own and a > c:
                return
            i, j = np.nonzero(x[a * leaf : b * leaf] @ y[c * leaf : d * leaf].T >= cosine)
            i, j = i + a * leaf, j + c * leaf
            if own:
                i, j = i[i < j], j[i < j]
            if len(i):
                yield i, j
        elif b - a >= d - c:
            m = (a + b) // 2
            yield from go(a, m, c, d)
            yield from go(m, b, c, d)
        else:
            m = (c + d) // 2
            yield from go(a, b, c, m)
            yield from go(a, b, m, d)

    if len(x) and len(y):
        yield from go(0, sides[0][0], 0, sides[1][0])


def _compare(basis: np.ndarray, kind: str, cosine: float):
    def load(row: dict, s: str):
        return np.frombuffer(row[f"{s}reps"], np.int64), np.frombuffer(row[f"{s}counts"], np.int64), _units(np.frombuffer(row[f"{s}vecs"], kind).reshape(-1, row["dim"]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row in b.to_pylist():
                xr, xn, x = load(row, "x")
                same = row["a"] == row["b"]
                yr, yn, y = (xr, xn, x) if same else load(row, "y")
                nx, ny = np.zeros(len(x), np.int64), np.zeros(len(y), np.int64)
                off = 0 if same else len(x)
                forest, kept = Forest(len(x) + (0 if same else len(y))), []
                for i, j in join_blocks(x, None if same else y, basis, cosine):
                    nx += np.bincount(i, yn[j], len(x)).astype(np.int64)
                    ny += np.bincount(j, xn[i], len(y)).astype(np.int64)
                    kept += forest.add(i, j + off)
                reps = xr if same else np.concatenate([xr, yr])
                n = nx + ny if same else np.concatenate([nx, ny])
                at = np.flatnonzero(n)
                if len(at):
                    e = np.array(kept, np.int64).reshape(-1, 2)
                    none = pa.nulls(len(at), pa.int64())
                    yield pa.RecordBatch.from_arrays([pa.concat_arrays([pa.array(reps[at]), pa.array(reps[e[:, 0]])]), pa.concat_arrays([none, pa.array(reps[e[:, 1]])]), pa.concat_arrays([pa.array(n[at]), pa.array(np.zeros(len(e), np.int64))])], ["a", "b", "n"])

    return run


def near_vectors(vectors: DataFrame, cosine: float = COSINE, key: str = "vec_id", vector: str = "embedding", block: int | None = None) -> DataFrame:
    """vec_id, n_links, component_id, kept for each row of vectors; rows link at that cosine (0 < cosine <= 1) or more.

    A vector that is null, empty, zero or has null or non-finite components links with nothing, as does a row with a null
    id and vectors of different lengths; such a row is a component of its own (of no id, if its id is null). Equal
    vectors link. Repeated rows count as other rows, different vectors under one id are linked each for itself. Other columns are not read. block: vectors of a block, if not a share of all.
    """
    spark = vectors.sparkSession
    rows = vectors.select(F.col(key).cast("long").alias("vec_id"), F.col(vector).alias("vec"))
    kind = "f4" if isinstance(rows.schema["vec"].dataType.elementType, T.FloatType) else "f8"
    if kind == "f8":
        rows = rows.withColumn("vec", F.col("vec").cast("array<double>"))
    good = rows.where(usable(F.col("vec")) & F.col("vec_id").isNotNull())
    classes, class_path = written(good.groupBy("vec").agg(F.min("vec_id").alias("first"), F.count(F.lit(1)).alias("n")).select(F.monotonically_increasing_id().alias("rep"), "n", "vec", "first"), "vectors")
    ids, classes = classes, classes.select("rep", "n", "vec")  # equal vectors are a class, known by a number: one id may have several vectors
    basis, eps = principal_dimensions(classes), math.sqrt(2 - 2 * cosine) + 1e-9
    block = block or max(SMALLEST, min(LARGEST, classes.count() // SHARE))
    k = basis.shape[1]
    order = ["dim", *(f"c{i}" for i in range(k)), "rep"]
    celled = classes.mapInArrow(_cells(basis, eps), T.StructType([*classes.schema.fields, T.StructField("dim", T.IntegerType()), *(T.StructField(f"c{i}", T.IntegerType()) for i in range(k))]))
    made = celled.repartitionByRange(*order).sortWithinPartitions(*order).select("rep", "n", "vec", "dim").mapInArrow(_blocks(basis, kind, block), "block long, dim int, lo array<double>, hi array<double>, reps binary, counts binary, vecs binary")
    blocks, block_path = written(made, "blocks")
    # a block's number is its place in its partition after the blocks of earlier partitions: a row for each partition is ordered
    parts = blocks.groupBy(F.shiftright("block", 32).alias("part")).agg(F.count(F.lit(1)).alias("n"))
    before = parts.select("part", (F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, 0)) - F.col("n")).alias("before"))
    sides = k + 1
    number = blocks.select("block", "dim", *(F.col("lo")[i].alias(f"lo{i}") for i in range(sides)), *(F.col("hi")[i].alias(f"hi{i}") for i in range(sides)), F.shiftright("block", 32).alias("part")).join(before, "part").withColumn("b", F.col("before") + F.col("block").bitwiseAND((1 << 32) - 1)).drop("part", "before")
    boxes, box_path = written(number, "boxes")
    data = blocks.join(boxes.select("block", F.col("b").alias("id")), "block")
    side = lambda s: data.select(F.col("id").alias({"x": "a", "y": "b"}[s]), "dim", *(F.col(c).alias(s + c) for c in ("reps", "counts", "vecs")))
    near = near_blocks(boxes, sides, eps).join(side("x"), "a").join(side("y"), ["b", "dim"]).select("a", "b", "dim", "xreps", "xcounts", "xvecs", "yreps", "ycounts", "yvecs")
    found, found_path = written(map_texts(near, _compare(basis, kind, cosine), "a long, b long, n long"), "near")  # a batch holds few pairs of blocks
    discard(spark, block_path, box_path)
    links = found.where("b is null").groupBy(F.col("a").alias("rep")).agg(F.sum("n").alias("links"))
    parts = connected_components(found.where("b is not null").select("a", "b")).withColumnRenamed("node", "rep")
    joined = ids.join(links, "rep", "left").join(parts, "rep", "left").withColumn("component", F.coalesce("component", "rep"))
    least = joined.groupBy("component").agg(F.min("first").alias("component_id"))
    known, _ = written(joined.join(least, "component").select("vec", (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), "component_id"), "linked")
    discard(spark, class_path, found_path)
    named = rows.withColumn("vec", F.when(F.col("vec_id").isNotNull(), F.col("vec"))).join(known, "vec", "left")
    return named.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id")).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))


def op2_grid_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicates of all embeddings at cosine 0.95."""
    return near_vectors(table(spark, sf_dir, "embeddings"))
