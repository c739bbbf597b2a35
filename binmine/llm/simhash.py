"""SimHash near-duplicates by bit-sliced comparison.

A text's fingerprint is the bitwise majority over the XXH64 hashes of its word shingles. Equal fingerprints are one
class; classes are compared where they agree in one of radius + 1 bit segments, which any pair within the radius does.
Inside a segment's bucket the bit planes are stored vertically, 64 fingerprints to a word, and a sequence is laid
over itself at each shift: one XOR compares 64 pairs in one bit, carry-save counters add the differences up, and a
block is abandoned as soon as all its pairs exceed the radius. Pairs that are in one component already are passed over,
so a bucket of near copies costs little more than its rows.

Three of 64 bits only find almost equal texts. near_copies() finds texts by the Jaccard similarity of their distinct
shingles: fingerprints of 384 bits are compared where they agree in a band of bits, differences far below those of the
least similarity are links at once, and those around it are held against the shingles themselves.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import discard, map_texts, table, written
from .components import Forest, connected_components

SEED, SHINGLE, RADIUS = 42, 3, 3
#: Fingerprints of a bucket that meet in one comparison; larger buckets are split into parts that meet two by two.
PART = 4096
#: Fingerprints that one bit-sliced pass takes at once, and 64-bit words of a block that is abandoned as a whole.
PASS, BLOCK = 1 << 17, 2048

_BYTE_AT = (np.arange(8) * 256).astype(np.int64)
_BITS_OF = ((np.arange(256)[:, None] >> np.arange(8)) & 1).astype(np.int64)


def shingle_hashes(text: str, size: int = SHINGLE, seed: int = SEED, held: int = 1 << 16) -> Iterator[np.ndarray]:
    """The XXH64 of each shingle, in bounded pieces; the whole sequence is the shingle of fewer words, none gives nothing."""
    import xxhash

    words = text.encode("utf-8", "surrogatepass").lower().split()  # both of them touch ASCII only
    if not words:
        return
    hash_, join = xxhash.xxh64_intdigest, b" ".join
    for at in range(0, max(1, len(words) - size + 1), held):
        some = words[at : at + held + size - 1]
        grams = zip(*(some[i:] for i in range(size)), strict=False) if len(words) >= size else [words]
        yield np.fromiter((hash_(join(g), seed) for g in grams), np.uint64)


def _votes(h: np.ndarray) -> np.ndarray:
    """For each of 64 bits (8 x 8), how many hashes have it."""
    return np.bincount((h.view(np.uint8).reshape(-1, 8) + _BYTE_AT).ravel(), minlength=2048).reshape(8, 256) @ _BITS_OF


def fingerprint(text: str, size: int = SHINGLE, seed: int = SEED) -> int:
    """The 64-bit fingerprint of a text, as an unsigned int; 0 without words. Repeated shingles count each time."""
    votes, n = np.zeros((8, 8), np.int64), 0
    for h in shingle_hashes(text, size, seed):
        votes += _votes(h)
        n += len(h)
    return int.from_bytes(np.packbits((2 * votes > n).ravel(), bitorder="little").tobytes(), "little")


def _mixed(h: np.ndarray, k: int) -> np.ndarray:
    """The k-th of further hashes of a hash (the finaliser of SplitMix64)."""
    z = h + np.uint64((0x9E3779B97F4A7C15 * (k + 1)) & 0xFFFFFFFFFFFFFFFF)
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return z ^ (z >> np.uint64(31))


def distinct_shingles(text: str, size: int, seed: int = SEED) -> np.ndarray:
    """The sorted hashes of a text's distinct shingles."""
    found = [np.unique(h) for h in shingle_hashes(text, size, seed)]
    return np.unique(np.concatenate(found)) if len(found) > 1 else found[0] if found else np.zeros(0, np.uint64)


def wide_fingerprint(shingles: np.ndarray, words: int) -> bytes:
    """A fingerprint of 64 times that many bits of distinct shingles; all zeros without any."""
    votes = np.concatenate([_votes(_mixed(shingles, k)) for k in range(words)]) if len(shingles) else np.zeros((8 * words, 8), np.int64)
    return np.packbits((2 * votes > len(shingles)).ravel(), bitorder="little").tobytes()


def _fingerprinted(docs: DataFrame, key: str = "doc_id", text: str = "text", size: int = SHINGLE, seed: int = SEED) -> DataFrame:
    """doc_id, h (a hash of the text), fp."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = np.fromiter((fingerprint(t.as_py() or "", size, seed) for t in b.column(2)), np.uint64, b.num_rows)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(fps.view(np.int64))], ["doc_id", "h", "fp"])

    return map_texts(docs.select(F.col(key).cast("long").alias("doc_id"), _text_hash(text), F.col(text).cast("string").alias("text")), run, "doc_id long, h long, fp long")


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text", size: int = SHINGLE, seed: int = SEED) -> DataFrame:
    """doc_id, fp (the fingerprint's bits as a signed long), a row for each row of docs. A null text has no words."""
    return _fingerprinted(docs, key, text, size, seed).select("doc_id", "fp")


def _words(bits: np.ndarray, words: int) -> np.ndarray:
    """Packed bits, 64 to a word, in rows of a given number of words."""
    packed = np.packbits(bits, axis=-1, bitorder="little")
    out = np.zeros((*packed.shape[:-1], words * 8), np.uint8)
    out[..., : packed.shape[-1]] = packed
    return out.view(np.uint64)


def _carry_save(a: np.ndarray, b: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Carries and sums of three bits each."""
    u = a ^ b
    return a & b | u & c, u ^ c


def near_pairs(fps: np.ndarray, group: np.ndarray, radius: int = RADIUS, forest: Forest | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Positions (i, j) of all pairs of one group at radius or fewer differing bits; rows of a group stand together.

    fps: one or more 64-bit words for each row. Pairs that are joined in forest, which may grow meanwhile, are left out.

    Groups are laid out by falling size, so the pairs at shift k lie in a prefix of the sequence and the work is that
    of the pairs there are. Counters of r bits start so that exceeding the radius is their overflow.
    """
    n = len(fps)
    if n < 2:
        return
    edge = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
    size = np.diff(np.r_[edge, n])
    by = np.argsort(-size, kind="stable")
    order = np.concatenate([np.arange(edge[g], edge[g] + size[g]) for g in by]) if len(by) < n else np.arange(n)
    sizes = np.repeat(size[by], size[by])
    left = sizes - (np.arange(n) - np.repeat(np.cumsum(size[by]) - size[by], size[by])) - 1  # rows that follow in the group
    width = n // 64 + 3 + int(size.max()) // 64
    some = fps[order].reshape(n, -1)
    planes = np.concatenate([_words(np.unpackbits(np.ascontiguousarray(some[:, w]).view(np.uint8).reshape(n, 8), axis=1, bitorder="little").T, width) for w in range(some.shape[1])])
    digits = max(3, radius.bit_length())
    start = (1 << digits) - 1 - radius
    for k in range(1, int(size.max())):
        m = int(np.searchsorted(-sizes, -k, side="left"))  # rows of groups of more than k rows
        words, off, r = (m + 63) // 64, np.uint64(k & 63), k >> 6
        wanted = left[:m] >= k
        if forest is not None:
            at, to = order[:m], order[np.minimum(np.arange(k, m + k), n - 1)]
            wanted &= forest.root[at] != forest.root[to]
            if not wanted.any():
                continue
        live_all = _words(wanted, words)
        for w in range(0, words, BLOCK):
            v = min(words, w + BLOCK)
            live = live_all[w:v]
            if not live.any():
                continue
            count = [np.full(v - w, ~np.uint64(0) if start >> d & 1 else np.uint64(0)) for d in range(digits)]
            over = ~live

            def differing(bit: int) -> np.ndarray:
                p = planes[bit]
                shifted = p[w + r : v + r] >> off | p[w + r + 1 : v + r + 1] << (np.uint64(64) - off) if off else p[w + r : v + r]
                return p[w:v] ^ shifted

            for bit in range(0, len(planes), 8):  # eight planes leave at most one carry to the digit of eights
                one, two, four = count[:3]
                carries = []
                for d in range(bit, bit + 8, 2):
                    carry, one = _carry_save(one, differing(d), differing(d + 1))
                    carries.append(carry)
                low, two = _carry_save(two, carries[0], carries[1])
                high, two = _carry_save(two, carries[2], carries[3])
                carry, four = _carry_save(four, low, high)
                count[:3] = one, two, four
                for d in range(3, digits):
                    count[d], carry = count[d] ^ carry, count[d] & carry
                over |= carry
                if (over == ~np.uint64(0)).all():
                    break
            else:
                at = np.flatnonzero(np.unpackbits((~over).view(np.uint8), bitorder="little")) + w * 64
                if len(at):
                    yield order[at], order[at + k]


def _links(radius: int):
    def links(fps: np.ndarray, group: np.ndarray, rep: np.ndarray) -> pd.DataFrame:
        forest, out = Forest(len(fps)), []
        for i, j in near_pairs(fps, group, radius, forest):
            out += forest.add(i, j)
        kept = np.array(out, np.int64).reshape(-1, 2)
        return pd.DataFrame({"a": rep[kept[:, 0]], "b": rep[kept[:, 1]]})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []
        rows = 0
        for pdf in batches:
            held.append(pdf)
            rows += len(pdf)
            if rows >= PASS:
                whole = pd.concat(held)
                g = whole["g"].to_numpy()
                cut = int(np.searchsorted(g != g[-1], False)) if (g == g[-1]).all() else int(np.flatnonzero(g != g[-1])[-1]) + 1
                if cut:
                    yield links(whole["fp"].to_numpy()[:cut].view(np.uint64), g[:cut], whole["rep"].to_numpy()[:cut])
                held, rows = [whole[cut:]], len(whole) - cut
        if rows:
            whole = pd.concat(held)
            yield links(whole["fp"].to_numpy().view(np.uint64), whole["g"].to_numpy(), whole["rep"].to_numpy())

    return run


def _dealt(buckets: DataFrame, part: int, *keep: str) -> DataFrame:
    """fp, rep, g and kept columns of buckets (fp, rep, bucket): g numbers groups of at most about 2 * part rows, in one of which any two rows of a bucket meet.

    The few large buckets are a table of known size, so rows are moved for its join only where it is large itself.
    """
    counts = buckets.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).where(f"n > {part}")
    big, _ = written(counts.select("bucket", F.ceil(F.col("n") / part).cast("int").alias("parts")), "buckets")
    return (
        buckets.join(big, "bucket", "left")
        .withColumn("parts", F.coalesce("parts", F.lit(1)))
        .withColumn("own", F.pmod(F.xxhash64("fp"), F.col("parts")).cast("int"))
        .withColumn("other", F.explode(F.expr("sequence(0, parts - 1)")))
        .select("fp", "rep", F.xxhash64("bucket", F.least("own", "other"), F.greatest("own", "other")).alias("g"), *keep)
    )


def near_links(classes: DataFrame, radius: int = RADIUS, part: int = PART) -> DataFrame:
    """Links a, b between representatives of fingerprints (fp, rep) within the radius: enough to span each component.

    A bucket of more than `part` fingerprints is split by hash into parts, and each two parts meet in a task of their
    own, so no task holds a whole bucket and no pair is left out.
    """
    n = radius + 1
    cuts = [64 * i // n for i in range(n + 1)]
    keys = [F.expr(f"(shiftrightunsigned(fp, {lo}) & {(1 << (hi - lo)) - 1}L) * {n} + {i}") for i, (lo, hi) in enumerate(zip(cuts, cuts[1:], strict=False))]
    buckets = classes.select("fp", "rep", F.explode(F.array(*keys)).alias("bucket"))
    return _dealt(buckets, part).repartition("g").sortWithinPartitions("g").mapInPandas(_links(radius), "a long, b long")


def _named(rows: DataFrame, classes: DataFrame, linked: DataFrame) -> DataFrame:
    """For classes (fp, rep, first: the least (doc_id, h) of the class, or null) and components of their numbers (node,
    component): fp, component_id and whether a row is its component's least, for each of rows (doc_id, h, fp)."""
    of = classes.join(linked.withColumnRenamed("node", "rep"), "rep", "left").withColumn("component", F.coalesce("component", "rep"))
    least = of.groupBy("component").agg(F.min("first").alias("least"))
    of_fp, _ = written(of.join(least, "component").select("fp", "least"), "classes")
    named = rows.join(of_fp, "fp")
    own = F.coalesce(F.struct("doc_id", "h") == F.col("least"), F.lit(False))
    return named.select("doc_id", "h", "fp", F.col("least.doc_id").alias("component_id"), own.alias("own"))


def _first() -> Column:
    """The least (doc_id, h) of rows with an id."""
    return F.min(F.when(F.col("doc_id").isNotNull(), F.struct("doc_id", "h"))).alias("first")


def _text_hash(text: str) -> Column:
    """Tells texts of one id apart."""
    return F.xxhash64(F.coalesce(F.col(text).cast("string"), F.lit(""))).alias("h")


def _components(docs: DataFrame, key: str, text: str, radius: int) -> DataFrame:
    fps, _ = written(_fingerprinted(docs, key, text), "fingerprints")
    classes, _ = written(fps.groupBy("fp").agg(_first()).withColumn("rep", F.col("fp")), "classes")
    return _named(fps, classes, connected_components(near_links(classes.where("first is not null").select("fp", "rep"), radius)))


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", radius: int = RADIUS) -> DataFrame:
    """doc_id, fp, component_id for each row of docs.

    component_id is the smallest doc_id that links reach. Classes of equal fingerprints are what is linked, so different
    texts under one id stay apart; their components may then be named alike. Rows without words have fingerprint 0 and link
    like others. A null doc_id never names a component: its row gets the smallest other doc_id of its class and those linked
    with it by equal fingerprints, and null where there is none. Repeated rows stay, an empty table gives an empty result.
    Other columns of docs are not read.
    """
    return _components(docs, key, text, radius).select("fp", "doc_id", "component_id")


def _named_rows(docs: DataFrame, components: DataFrame) -> DataFrame:
    """One row of docs for each component: of the rows with its least id and text hash that of the least hash of all columns."""
    kept, _ = written(components.where("own").select(F.col("doc_id").alias("__id"), F.col("h").alias("__h")).distinct(), "kept")
    keyed = docs.withColumn("__id", F.col("doc_id").cast("long")).withColumn("__h", _text_hash("text"))
    named = keyed.join(kept, ["__id", "__h"], "left_semi").groupBy("__id", "__h").agg(F.min_by(F.struct(*docs.columns), F.xxhash64(*docs.columns)).alias("__row")).select("__row.*")
    return named.unionByName(docs.where("doc_id is null"))


def without_near_duplicates(docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """docs with one row of each component of near_duplicates(), one whose doc_id names it; all columns are kept.

    Of repeated rows one is kept. Rows with a null doc_id cannot be named and are kept all.
    """
    return _named_rows(docs, _components(docs, "doc_id", "text", radius))


#: Texts are near copies at this Jaccard similarity of their distinct shingles of so many words.
JACCARD, WORDS_OF_COPIES = 0.8, 5
#: 64-bit words of a wide fingerprint, bits of a band, and standard deviations below and above the expected difference at
#: that similarity within which shingles are compared.
WIDE, BAND, DOUBT = 6, 13, (2.5, 1.5)


def radii(jaccard: float, bits: int, doubt: tuple[float, float] = DOUBT) -> tuple[int, int]:
    """Differing bits up to which texts are that similar for sure, and from which on they are not, but for chance.

    Sets of Jaccard similarity j have a cosine of 2 j / (1 + j) or more, and a bit differs with the share of the angle in pi.
    """
    p = math.acos(min(1.0, 2 * jaccard / (1 + jaccard))) / math.pi
    spread = math.sqrt(p * (1 - p) * bits)
    return max(0, math.floor(p * bits - doubt[0] * spread)), min(bits, math.ceil(p * bits + doubt[1] * spread))


def _fixed(binary: pa.Array, words: int) -> np.ndarray:
    """Binaries of 64-bit words as rows of a matrix."""
    at, size = binary.offset, words * 8
    return np.frombuffer(binary.buffers()[2], np.uint8)[at * size : (at + len(binary)) * size].view(np.uint64).reshape(-1, words) if len(binary) else np.zeros((0, words), np.uint64)


def _banded(words: int, band: int):
    """fp, rep, component, band, bucket: a row for each whole band of bits of a fingerprint."""
    starts = range(0, 64 * words - band + 1, band)
    weights = 1 << np.arange(band, dtype=np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            bits = np.unpackbits(_fixed(b.column(0), words).view(np.uint8), axis=1, bitorder="little")
            values = np.column_stack([bits[:, at : at + band] @ weights * len(starts) + i for i, at in enumerate(starts)])
            row = pa.array(np.repeat(np.arange(b.num_rows), len(starts)))
            at = pa.array(np.tile(np.arange(len(starts), dtype=np.int32), b.num_rows))
            yield pa.RecordBatch.from_arrays([*(c.take(row) for c in b.columns), at, pa.array(values.ravel())], ["fp", "rep", "component", "band", "bucket"])

    return run


def _wide(size: int, seed: int, words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = [wide_fingerprint(distinct_shingles(t.as_py() or "", size, seed), words) for t in b.column(2)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(fps, pa.binary())], ["doc_id", "h", "fp"])

    return run


#: Pairs in doubt that a task holds before it keeps only those that span.
HELD = 500_000


def _wide_links(sure: int, most: int, words: int, width: int, span: bool):
    """Links a, b of fingerprints (fp, rep, g, component, band) of each bucket g, between different components.

    span: links that are sure, enough to span, and of those in doubt the nearest that span what these leave apart; else all
    that are in doubt, each in the first band of that width in which both agree.
    """

    def links(fps: np.ndarray, group: np.ndarray, rep: np.ndarray, component: np.ndarray, band: np.ndarray) -> pa.RecordBatch:
        forest, kept, doubt = Forest(len(fps)), [], [np.zeros((0, 2), np.int64)]
        _, lowest, of = np.unique(component, return_index=True, return_inverse=True)
        forest.root = lowest[of]

        def spanning(pairs: list[np.ndarray]) -> np.ndarray:
            p = np.concatenate(pairs)
            p = p[np.argsort(np.bitwise_count(fps[p[:, 0]] ^ fps[p[:, 1]]).sum(axis=1), kind="stable")]
            both = Forest(0)
            both.root = forest.root.copy()
            return np.array(both.add(p[:, 0], p[:, 1]), np.int64).reshape(-1, 2)

        for i, j in near_pairs(fps, group, most, forest):
            if span:
                near = np.bitwise_count(fps[i] ^ fps[j]).sum(axis=1) <= sure
                kept += forest.add(i[near], j[near])
                i, j = i[~near], j[~near]
            else:
                differ = np.unpackbits((fps[i] ^ fps[j]).view(np.uint8), axis=1, bitorder="little")
                count = differ.shape[1] // width
                first = differ[:, : count * width].reshape(-1, count, width).any(axis=2).argmin(axis=1)
                i, j = i[first == band[i]], j[first == band[i]]
            doubt.append(np.column_stack([i, j]))
            if span and sum(map(len, doubt)) > HELD:
                doubt = [spanning(doubt)]
        left = spanning(doubt) if span else np.concatenate(doubt)
        every = np.concatenate([np.array(kept, np.int64).reshape(-1, 2), left])
        lo, hi = np.minimum(rep[every[:, 0]], rep[every[:, 1]]), np.maximum(rep[every[:, 0]], rep[every[:, 1]])
        return pa.RecordBatch.from_arrays([pa.array(lo), pa.array(hi), pa.array(np.arange(len(every)) >= len(kept))], ["a", "b", "doubt"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def numbers(held: list[pa.RecordBatch]) -> tuple[np.ndarray, ...]:
            t = pa.concat_batches(held)
            return _fixed(t.column(0), words), *(t.column(c).to_numpy() for c in ("g", "rep", "component", "band"))

        held: list[pa.RecordBatch] = []
        rows = 0
        for b in batches:
            held.append(b)
            rows += b.num_rows
            if rows >= PASS:
                x = numbers(held)
                ends = np.flatnonzero(x[1] != x[1][-1])
                if len(ends):
                    cut = int(ends[-1]) + 1
                    yield links(*(c[:cut] for c in x))
                    held, rows = [pa.concat_batches(held).slice(cut)], rows - cut
        if rows:
            yield links(*numbers(held))

    return run


def _alike(jaccard: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keep = []
            for x, y in zip(b.column(2), b.column(3), strict=True):
                x, y = np.frombuffer(x.as_py(), np.uint64), np.frombuffer(y.as_py(), np.uint64)
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(both >= jaccard * (len(x) + len(y) - both))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(keep, pa.bool_())], ["a", "b", "alike"])

    return run


def near_copies(docs: DataFrame, jaccard: float = JACCARD, size: int = WORDS_OF_COPIES, key: str = "doc_id", text: str = "text", words: int = WIDE, band: int = BAND, seed: int = SEED, part: int = PART) -> DataFrame:
    """doc_id, component_id for each row of docs: components of texts whose distinct shingles are that similar.

    Found are pairs that agree in one band of bits at least and differ in few enough: of those at exactly a similarity of 0.8
    some 0.9, at 0.82 0.95, at 0.85 0.99, at 0.9 more than 0.999; components lose less, as their members are linked in many
    ways. Texts of equal distinct shingles, those without words among them, are equal. What is linked are classes of equal
    fingerprints, so different texts under one id stay apart; null ids, repeated rows, ties and empty tables are as in
    near_duplicates(). No bucket, component or text is limited in size.
    """
    return _copies(docs, jaccard, size, key, text, words, band, seed, part).select("doc_id", "component_id")


def _ends(pairs: DataFrame) -> DataFrame:
    """The distinct ends of pairs a, b; each side is made distinct where it is read, so no pair becomes two rows."""
    return pairs.select(F.col("a").alias("rep")).distinct().unionByName(pairs.select(F.col("b").alias("rep")).distinct()).distinct()


def _copies(docs: DataFrame, jaccard: float = JACCARD, size: int = WORDS_OF_COPIES, key: str = "doc_id", text: str = "text", words: int = WIDE, band: int = BAND, seed: int = SEED, part: int = PART) -> DataFrame:
    rows = docs.select(F.col(key).cast("long").alias("doc_id"), _text_hash(text), F.col(text).cast("string").alias("text"))
    fps, _ = written(map_texts(rows, _wide(size, seed, words), "doc_id long, h long, fp binary"), "fingerprints")
    # a class is known by a number that holds once the table is written
    classes, class_path = written(fps.groupBy("fp").agg(_first()).withColumn("rep", F.monotonically_increasing_id()), "classes")
    sure, most = radii(jaccard, 64 * words)
    spark = docs.sparkSession

    def candidates(some: DataFrame, span: bool) -> tuple[DataFrame, str]:
        buckets = map_texts(some, _banded(words, band), "fp binary, rep long, component long, band int, bucket long")
        return written(_dealt(buckets, part, "component", "band").repartition("g").sortWithinPartitions("g").mapInArrow(_wide_links(sure, most, words, band, span), "a long, b long, doubt boolean"), "near")

    def shingles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([distinct_shingles(t.as_py() or "", size, seed).tobytes() for t in b.column(1)], pa.binary())], ["rep", "s"])

    def checked(pairs: DataFrame) -> tuple[DataFrame, str]:
        """a, b and whether their texts are alike; a class's text is that of its least row."""
        wanted = _ends(pairs).join(classes.select("rep", "first.*"), "rep")
        wanted, wanted_path = written(wanted, "texts")  # of known size: texts move only if it is large
        sets, sets_path = written(map_texts(rows.join(wanted, ["doc_id", "h"]).select("rep", "text"), shingles, "rep long, s binary"), "shingles")
        sets = sets.dropDuplicates(["rep"])
        both = pairs.join(sets.select(F.col("rep").alias("a"), F.col("s").alias("x")), "a").join(sets.select(F.col("rep").alias("b"), F.col("s").alias("y")), "b")
        out = written(map_texts(both.select("a", "b", "x", "y"), _alike(jaccard), "a long, b long, alike boolean"), "checked")
        discard(spark, wanted_path, sets_path)
        return out

    named = classes.where("first is not null").select("fp", "rep")
    # first what is sure, and of what is in doubt the nearest pairs that span: groups of near copies are whole after that
    first, first_path = candidates(named.withColumn("component", F.col("rep")), True)
    doubt, doubt_path = written(first.where("doubt").select("a", "b").distinct(), "doubt")
    known, known_path = checked(doubt)
    links = first.where("not doubt").select("a", "b").unionByName(known.where("alike").select("a", "b"))
    parts, parts_path = written(connected_components(links).withColumnRenamed("node", "rep"), "parts")
    # a pair in doubt that is still apart and was not looked at stands, at both ends, in components that have a pair found unlike
    of_rep = named.join(parts, "rep", "left").select("fp", "rep", F.coalesce("component", "rep").alias("component"))
    unlike = _ends(known.where("not alike")).join(of_rep.select("rep", "component"), "rep").select("component").distinct()
    rest, rest_path = candidates(of_rep.join(unlike, "component", "left_semi").select("fp", "rep", "component"), False)
    again, again_path = written(rest.select("a", "b").distinct().join(known, ["a", "b"], "left_anti"), "doubt")
    more, more_path = checked(again)
    linked = connected_components(links.unionByName(more.where("alike").select("a", "b")))
    out = _named(fps, classes, linked)
    discard(spark, class_path, first_path, doubt_path, known_path, parts_path, rest_path, again_path, more_path)
    return out


def without_near_copies(docs: DataFrame, jaccard: float = JACCARD) -> DataFrame:
    """docs with one row of each component of near_copies(), one whose doc_id names it; all columns are kept.

    Of repeated rows one is kept. Rows with a null doc_id cannot be named and are kept all.
    """
    return _named_rows(docs, _copies(docs, jaccard))


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate components of all documents: three-word shingles, three bits."""
    out = near_duplicates(table(spark, sf_dir, "documents"))
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
