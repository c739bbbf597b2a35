"""MinHash signatures, exact-signature clusters, LSH bands and candidate pairs, as expressions."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from binmine.functions.bits import ranked
from binmine.functions.kernels import primes


def modulus(p: int) -> int:
    """The second prime from p + 1 on."""
    return primes(p + 1, p + 1000)[1]


def coefficients(n_hash: int, p: int, seed: int = 1) -> list[tuple[int, int]]:
    """(a, b) with a odd in 1..P-2 and b in 0..P-1. More hashes extend fewer: a prefix stays."""
    big = modulus(p)
    rng = np.random.default_rng(seed)
    draws = rng.random((n_hash, 2))
    return [(2 * int(x * ((big - 1) // 2)) + 1, int(y * big)) for x, y in draws]


def _least(c: Column, a: int, b: int, big: int, m: int) -> Column:
    return F.array_min(F.transform(c, lambda j: (j.cast("long") * a + b) % big % m))


def signatures(items: DataFrame, coefs: list[tuple[int, int]], p: int, *keep: str) -> DataFrame:
    """id, kept columns, sig; items: id, items (array)."""
    return items.select("id", *keep, F.array(*(F.coalesce(_least(F.col("items"), a, b, modulus(p), p + 1), F.lit(-1).cast("long")) for a, b in coefs)).alias("sig"))


def signatures_long(obs_long: DataFrame, coefs: list[tuple[int, int]], p: int) -> DataFrame:
    """The same from id, j (null for none), in one row for each id.

    Minima are plain columns, aggregated where an id's items are read, so no row holds all of them and one narrow row
    for each id is shuffled.
    """
    big, m = modulus(p), p + 1
    mins = [F.min((F.col("j").cast("long") * a + b) % big % m).alias(f"h{i}") for i, (a, b) in enumerate(coefs)]
    return obs_long.groupBy("id").agg(*mins).select("id", F.array(*(F.coalesce(F.col(f"h{i}"), F.lit(-1).cast("long")) for i in range(len(coefs)))).alias("sig"))


def minhash_clusters(sigs: DataFrame) -> DataFrame:
    """id, cluster: equal signatures, numbered by their first id."""
    firsts = sigs.groupBy("sig").agg(F.min("id").alias("first"))
    numbered = ranked(firsts, "first", "cluster").select("sig", "cluster")
    return sigs.join(numbered, "sig").select("id", "cluster")


def band_sizes(n_hash: int, bands: int) -> list[int]:
    out, left = [], n_hash
    for k in range(bands, 0, -1):
        out.append(-(-left // k))
        left -= out[-1]
    return out


def buckets(sigs: DataFrame, n_hash: int, bands: int) -> DataFrame:
    """band, h (the band's part of the signature), id."""
    at, parts = 1, []
    for size in band_sizes(n_hash, bands):
        parts.append(F.slice("sig", at, size))
        at += size
    return sigs.select(F.posexplode(F.array(*parts)).alias("band0", "h"), "id").select((F.col("band0") + 1).alias("band"), "h", "id")


#: Ids of a bucket's part: larger buckets are split into parts that meet two by two.
PART = 1024


def _parts(rows: DataFrame, part: int) -> DataFrame:
    """rows (k1, k2: the bucket, id, more) with parts, into how many its bucket is split, and own, the part of its id.

    Buckets over part ids are split by a hash of the id. Buckets of one id meet nothing and are left out.
    """
    full = rows.groupBy("k1", "k2").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("k1", "k2", F.expr(f"cast((n + {part - 1}) div {part} as int)").alias("parts"))
    own = F.pmod(F.xxhash64("id", F.lit(7)), F.col("parts").cast("long")).cast("int")
    return rows.join(full, ["k1", "k2"]).withColumn("own", own)


def _by_cell(dealt: DataFrame) -> DataFrame:
    """Cells (k1, k2, c1, c2) are small but their pairs are many: dealt to all tasks by number of rows rather than bytes."""
    return dealt.repartition(int(dealt.sparkSession.conf.get("spark.sql.shuffle.partitions")), "k1", "k2", "c1", "c2")


def _dealt(rows: DataFrame, part: int) -> DataFrame:
    """rows (k1, k2: the bucket, id, more) with own, c1, c2: a row's part of its bucket, in each cell it belongs to.

    Every two parts are a cell of their own, so no key holds more than two parts however large its bucket. Both sides of a
    cell are dealt at once.
    """
    dealt = _parts(rows, part).withColumn("with", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    return _by_cell(dealt.withColumn("c1", F.least("own", "with")).withColumn("c2", F.greatest("own", "with")))


def _met(rows: DataFrame, part: int, where: str = "true") -> DataFrame:
    """id1 < id2 of rows (k1, k2: the bucket, id, more) that share a bucket, each pair of a bucket once, where a condition holds.

    The condition is symmetric and names the other columns with suffixes 1 and 2. Every two parts are a cell; a row of part
    i stands on the left of (i, i), (i, i + 1)... and on the right of (0, i)... (i, i), so a cell compares its own pairs only.
    """
    keys, more = ["k1", "k2", "c1", "c2"], [c for c in rows.columns if c not in ("k1", "k2")]
    parts = _parts(rows.where("id is not null"), part)
    left = parts.withColumn("c1", F.col("own")).withColumn("c2", F.explode(F.sequence("own", F.col("parts") - 1)))
    right = parts.withColumn("c2", F.col("own")).withColumn("c1", F.explode(F.sequence(F.lit(0), "own")))
    a, b = (_by_cell(side.select(*keys, *(F.col(c).alias(f"{c}{n}") for c in more))) for n, side in ((1, left), (2, right)))
    met = a.join(b.hint("merge"), keys).where(f"(c1 <> c2 or id1 < id2) and ({where})")
    return met.select(F.least("id1", "id2").alias("id1"), F.greatest("id1", "id2").alias("id2"))


def _codes(n_hash: int, bands: int, p: int) -> list[Column]:
    """For each band of sig, hashes of p items, one number that no other values have."""
    sizes, base = band_sizes(n_hash, bands), p + 3
    if base ** max(sizes) >= 1 << 63:
        raise ValueError("a band's values do not fit one number")
    ends = [sum(sizes[: b + 1]) for b in range(bands)]
    return [sum((F.col("sig")[i] + 1) * F.lit(base ** (i - e + n)) for i in range(e - n, e)).cast("int" if base**n < 1 << 31 else "long") for e, n in zip(ends, sizes, strict=True)]


def signature_pairs(sigs: DataFrame, n_hash: int, bands: int, part: int = PART, p: int | None = None) -> DataFrame:
    """id1 < id2 whose signatures (id, sig; an id once) agree in a whole band, each pair once.

    A pair belongs to the first band in which it agrees, so pairs need no distinct. With p, for hashes of p items, a band
    is compared as one number, else as an array.
    """
    sizes = band_sizes(n_hash, bands)
    values = _codes(n_hash, bands, p) if p else [F.slice("sig", sum(sizes[:k]) + 1, n) for k, n in enumerate(sizes)]
    names = [f"b{k}_" for k in range(bands)]
    coded = sigs.select("id", *(c.alias(b) for b, c in zip(names, values, strict=True)))
    # columns of their own, as a condition on array elements grows too long to be compiled
    rows = coded.select(F.posexplode(F.array(*names)).alias("k1", "k2"), "id", *names[:-1])
    return _met(rows, part, " and ".join(f"(k1 <= {k} or {b}1 <> {b}2)" for k, b in enumerate(names[:-1])) or "true")


#: Ids of a bucket's part where pairs are counted and not returned, and rows of one part that meet the other at a time.
COUNTED, TILE = 16_384, 256


def _cells(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[tuple[np.ndarray, list[np.ndarray]]]:
    """Each run of equal keys, the first columns, of sorted rows with the arrays of the other columns."""
    key, held = None, []
    for b in batches:
        if not b.num_rows:
            continue
        k = np.column_stack([c.to_numpy(zero_copy_only=False) for c in b.columns[:keys]])
        more = [c.flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, -1) if pa.types.is_list(c.type) else c.to_numpy(zero_copy_only=False) for c in b.columns[keys:]]
        cuts = [0, *(np.flatnonzero((k[1:] != k[:-1]).any(1)) + 1).tolist(), b.num_rows]
        for at, end in zip(cuts, cuts[1:], strict=False):
            if held and (k[at] != key).any():
                yield key, [np.concatenate(c) for c in zip(*held, strict=True)]
                held = []
            key = k[at]
            held.append([c[at:end] for c in more])
    if held:
        yield key, [np.concatenate(c) for c in zip(*held, strict=True)]


def _first_agreements(band: int, one: bool, a: list[np.ndarray], b: list[np.ndarray], classes: int) -> tuple[int, int]:
    """Pairs of a's and b's rows (id, orig, codes of bands), or of a's alone, that agree in no band before: same and other class."""
    (id1, o1, x), (id2, o2, y) = a, b
    kind = np.uint16 if max(x.max(), y.max()) < 1 << 16 else np.int64
    x, y = np.ascontiguousarray(x.T[: band + 1].astype(kind)), np.ascontiguousarray(y.T[: band + 1].astype(kind))
    known1, known2 = (o1 >= 1) & (o1 <= classes), (o2 >= 1) & (o2 <= classes)
    all_known = known1.all() and known2.all()
    same = found = 0
    for at in range(0, len(id1), TILE):
        i, j = slice(at, at + TILE), slice(at if one else 0, None)
        pair = x[band, i][:, None] == y[band, j]
        for e in range(band):
            pair &= x[e, i][:, None] != y[e, j]
        if one:
            pair &= id1[i][:, None] < id2[j]
        if not all_known:
            pair &= np.where(id1[i][:, None] < id2[j], known1[i][:, None], known2[j])
        found += np.count_nonzero(pair)
        pair &= o1[i][:, None] == o2[j]
        same += np.count_nonzero(pair)
    return int(same), int(found - same)


def pair_counts(sigs: DataFrame, n_hash: int, bands: int, p: int, classes: int, part: int = COUNTED) -> DataFrame:
    """tp, fp: how many of signature_pairs(), whose first class is one of 1..classes, are of the same class and how many not.

    sigs: id (once), orig, sig with hashes of p items. No pair is made a row: the rows of a cell, sorted by id, meet in
    tiles, and a task gives the counts of its cells. A band's values are one number.
    """
    codes = F.array(*_codes(n_hash, bands, p))
    rows = sigs.where("id is not null").select("id", F.coalesce(F.col("orig").cast("long"), F.lit(-1)).alias("orig"), codes.alias("codes")).select("*", F.posexplode("codes").alias("k1", "k2"))
    keys = ["k1", "k2", "c1", "c2"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tp = fp = 0
        for (band, _, c1, c2), (own, *more) in _cells(batches, len(keys)):
            order = np.argsort(more[0])
            own, more = own[order], [c[order] for c in more]
            a, b = ([c[own == side] for c in more] for side in (c1, c2))
            if len(a[0]) and len(b[0]):
                same, other = _first_agreements(int(band), c1 == c2, a, b, classes)
                tp, fp = tp + same, fp + other
        yield pa.RecordBatch.from_arrays([pa.array([tp], pa.int64()), pa.array([fp], pa.int64())], ["tp", "fp"])

    cells = _dealt(rows, part).select(*keys, "own", "id", "orig", "codes").sortWithinPartitions(*keys)
    return cells.mapInArrow(run, "tp long, fp long").agg(F.coalesce(F.sum("tp"), F.lit(0)).alias("tp"), F.coalesce(F.sum("fp"), F.lit(0)).alias("fp"))


def candidate_pairs(found: DataFrame, part: int = PART) -> DataFrame:
    """Distinct id1 < id2 that share a bucket of found (band, h, id). The pairs of a bucket are what this operator is for."""
    rows = found.select(F.col("band").alias("k1"), F.col("h").alias("k2"), "id").distinct()
    return _met(rows, part).distinct()


def eval_sample(found: DataFrame, n_rows: int, classes: int, n_sample: int, seed: int = 1) -> DataFrame:
    """The buckets of a sample that takes n_sample / classes ids from each of `classes` equal runs of id order."""
    run = F.expr(f"least({classes}, greatest(1, cast(ceil(rn * {classes}D / {n_rows}) as int)))")
    ids = ranked(found.where("band = 1").select("id"), "id", "rn").withColumn("run", run)
    pick = F.row_number().over(Window.partitionBy("run").orderBy(F.md5(F.concat(F.lit(f"{seed}-"), F.col("id").cast("string")).cast("binary")), "id"))
    return found.join(ids.withColumn("k", pick).where(F.col("k") <= n_sample // classes).select("id"), "id", "left_semi")
