"""Maximal periodic runs of words, after Stoye and Gusfield: branching tandem repeats of a suffix tree, rotated and merged.

A node of depth q of a text's suffix tree holds the places where some q words stand. Place i starts a branching tandem
repeat of period q if i + q is below the same node but below another child: the words at i and at i + q agree for q
words and no more. Only places outside a node's largest child are asked, in both directions, so a text of n words
costs n log n questions. Rotating a branching repeat to the left while the word before it agrees gives the whole run,
whose right end it already has; runs that are found under a multiple of their period too are merged.

The tree is kept as a suffix array (ranks of 1, 2, 4 ... words), common prefixes of neighbours and their intervals, for
many texts at once. Stretches in which no run can lie are left out beforehand by a true bound (see _stretches).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import map_texts, table

LEAST, EXPONENT = 24, 3
#: Words of a shingle in the bound, and words that go into one suffix tree (a longer stretch has a tree of its own).
GRAM, TREE = 8, 1 << 18
SPACE = "[\\x20\\x09-\\x0D]+"


class Codes(dict):
    """Numbers of words in the order of their first use."""

    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self)
        return n


def _stretches(x: np.ndarray, start: np.ndarray) -> list[tuple[int, int]]:
    """Parts (from, to) of the words x, of texts that begin at start, that hold every run.

    A run of period q and L >= max(24, 3 q) words has L - q - 7 places in a row whose eight words come again q words
    later. So it lies in a row of m >= 9 places whose eight words come again in the text, the next time at most
    q <= (m + 7) / 2 words later at one of them at least, and ends at most q + 8 words after the row's last place.
    """
    n, ends = len(x), np.append(start[1:], len(x))
    if n < LEAST:
        return []
    text = np.repeat(np.arange(len(start), dtype=np.uint64), ends - start)
    h = (x.astype(np.uint64) + 1) * np.uint64(0x9E3779B97F4A7C15) ^ (text + 1) * np.uint64(0xC2B2AE3D27D4EB4F)
    factor, width = 0x100000001B3, 1
    while width < GRAM:
        h = h[:-width] * np.uint64(factor) + h[width:]
        factor, width = factor * factor & 0xFFFFFFFFFFFFFFFF, 2 * width
        h ^= h >> np.uint64(29)
    inside = np.arange(len(h)) + GRAM <= np.repeat(ends, ends - start)[: len(h)]
    order = np.argsort(h, kind="stable")
    ranked = h[order]
    same = np.flatnonzero(ranked[1:] == ranked[:-1])
    after = np.zeros(len(h) + 1, np.int64)
    after[order[same]] = order[same + 1] - order[same]
    after[:-1][~inside] = 0
    after[order[same]] *= inside[order[same + 1]] & (text[order[same]] == text[order[same + 1]])
    edge = np.diff((after > 0).astype(np.int8), prepend=0)
    begin, stop = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    if not len(begin):
        return []
    m = stop - begin
    least = np.minimum.reduceat(np.where(after > 0, after, n), np.column_stack([begin, stop]).ravel())[::2]
    keep = (m >= LEAST - 2 * GRAM + 1) & (2 * least <= m + GRAM - 1)
    end_of = ends[text[begin].astype(np.int64)]
    out: list[tuple[int, int]] = []
    for a, b, e in zip(begin[keep].tolist(), (stop + GRAM + (m + GRAM - 1) // 2 + 1)[keep].tolist(), end_of[keep].tolist(), strict=True):
        b = min(b, e)
        if out and a < out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


class SuffixTree:
    """The suffix tree of several words sequences at once, none of which shares a path with another."""

    def __init__(self, parts: list[np.ndarray]) -> None:
        size = np.array([len(p) for p in parts])
        self.first = np.repeat(np.cumsum(size) - size, size)
        self.end = np.repeat(np.cumsum(size), size)
        x = np.concatenate(parts).astype(np.int64)
        self.n = n = len(x)
        own = np.repeat(np.arange(len(parts)), size)
        rank = np.unique(own * (int(x.max()) + 1) + x, return_inverse=True)[1].astype(np.int64)
        self.levels, step, place = [rank.astype(np.int32)], 1, np.arange(n)
        while True:
            ahead = np.zeros(n, np.int64)
            there = place + step < self.end
            ahead[there] = rank[place[there] + step] + 1
            key = rank * (n + 1) + ahead
            self.order = np.argsort(key, kind="stable")
            ranked = key[self.order]
            rank = np.empty(n, np.int64)
            rank[self.order] = np.concatenate([[0], np.cumsum(ranked[1:] != ranked[:-1])])
            if rank[self.order[-1]] == n - 1:
                break
            self.levels.append(rank.astype(np.int32))
            step *= 2
        self.rank = rank

    def common(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """How many words agree from the places i and j on."""
        out = np.zeros(len(i), np.int64)
        for k in range(len(self.levels) - 1, -1, -1):
            a, b = i + out, j + out
            open_ = np.flatnonzero((a < self.end[i]) & (b < self.end[j]))
            level = self.levels[k]
            out[open_[level[a[open_]] == level[b[open_]]]] += 1 << k
        return out

    def children(self) -> tuple[np.ndarray, ...]:
        """For every child of every node but one largest child a node: depth and interval (from, to) of the node, interval of the child."""
        lcp = np.zeros(self.n + 1, np.int64)
        lcp[1:-1] = self.common(self.order[:-1], self.order[1:])
        left, right = np.zeros(self.n + 1, np.int64), np.zeros(self.n + 1, np.int64)
        stack: list[int] = []
        depth = lcp.tolist()
        lefts = [0] * (self.n + 1)
        for k, d in enumerate(depth):
            while stack and depth[stack[-1]] > d:
                right[stack.pop()] = k
            if stack:
                top = stack[-1]
                lefts[k] = lefts[top] if depth[top] == d else top
            stack.append(k)
        left[:] = lefts
        k = np.flatnonzero(lcp > 0)
        k = k[np.lexsort((k, right[k], left[k]))]
        node = np.ones(len(k), bool)
        node[1:] = (left[k[1:]] != left[k[:-1]]) | (right[k[1:]] != right[k[:-1]])
        from_ = np.where(node, left[k], np.roll(k, 1))
        ends = np.append(np.flatnonzero(node)[1:], len(k)) - 1 if len(k) else np.zeros(0, np.int64)
        number = np.cumsum(node) - 1
        whose = np.concatenate([number, number[ends]])
        a, b = np.concatenate([from_, k[ends]]), np.concatenate([k, right[k[ends]]])
        of = np.concatenate([k, k[ends]])
        by = np.lexsort((b - a, whose))
        small = np.ones(len(by), bool)
        small[np.append(np.flatnonzero(np.diff(whose[by])), len(by) - 1) if len(by) else []] = False
        kept = by[small]
        return lcp[of[kept]], left[of[kept]], right[of[kept]], a[kept], b[kept]

    def branching(self) -> tuple[np.ndarray, np.ndarray]:
        """Places and periods of all branching tandem repeats."""
        depth, lo, hi, a, b = self.children()
        found = []
        for cut in np.array_split(np.arange(len(a)), max(1, int((b - a).sum()) // (4 * TREE))):
            n = (b - a)[cut]
            row = np.repeat(cut, n)
            leaf = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n) + a[row]
            i, q = self.order[leaf], depth[row]
            for j, inside in ((i + q, i + q < self.end[i]), (i - q, i - q >= self.first[i])):
                at = np.flatnonzero(inside)
                r, w = self.rank[j[at]], row[at]
                at = at[(r >= lo[w]) & (r < hi[w]) & ((r < a[w]) | (r >= b[w]))]
                found.append(np.column_stack([np.minimum(i[at], j[at]), q[at]]))
        place, period = np.concatenate(found).T
        coded = np.unique(place * (self.n + 1) + period)
        return coded // (self.n + 1), coded % (self.n + 1)


def _agreeing(same: np.ndarray) -> int:
    bad = np.flatnonzero(~same)
    return int(bad[0]) if len(bad) else len(same)


def _rotated(x: np.ndarray, i: int, q: int) -> tuple[int, int]:
    """The whole run (start, end) of period q about the repeat at i: as far to the left and right as words q apart agree."""
    start, end, step = i, i + 2 * q, 64
    while start:
        n = min(step, start)
        more = _agreeing((x[start - n : start] == x[start - n + q : start + q])[::-1])
        start, step = start - more, step * 4
        if more < n:
            break
    step = 64
    while end < len(x):
        n = min(step, len(x) - end)
        more = _agreeing(x[end : end + n] == x[end - q : end - q + n])
        end, step = end + more, step * 4
        if more < n:
            break
    return start, end


def runs_of(texts: list[np.ndarray], least: int = LEAST, exponent: int = EXPONENT) -> list[list[tuple[int, int, int]]]:
    """(start, length, period) of all runs of each sequence of word numbers, by start, then period."""
    size = np.array([len(t) for t in texts], np.int64)
    start = np.cumsum(size) - size
    x = np.concatenate(texts) if len(texts) else np.zeros(0, np.int32)
    parts, out = _stretches(x, start), [{} for _ in texts]
    while parts:
        n, k = 0, 0
        while k < len(parts) and (not k or n + parts[k][1] - parts[k][0] <= TREE):
            n, k = n + parts[k][1] - parts[k][0], k + 1
        some, parts = parts[:k], parts[k:]
        tree = SuffixTree([x[a:b] for a, b in some])
        i, q = tree.branching()
        long = np.maximum(least, exponent * q)
        from_ = i + 2 * q - long
        at = np.flatnonzero(from_ >= tree.first[i])
        at = at[tree.common(from_[at], from_[at] + q[at]) >= (long - q)[at]]
        offset = np.array([a for a, _ in some])
        which = np.searchsorted(np.unique(tree.first), i[at], side="right") - 1
        for p, period, w in zip(i[at].tolist(), q[at].tolist(), which.tolist(), strict=True):
            place = p - int(tree.first[p]) + int(offset[w])
            t = int(np.searchsorted(start, place, side="right")) - 1
            s, e = _rotated(texts[t], place - int(start[t]), period)
            out[t][s, e] = min(period, out[t].get((s, e), period))
    return [sorted(((s, e - s, q) for (s, e), q in o.items()), key=lambda r: (r[0], r[2])) for o in out]


RUNS = "doc_id long, n_words long, runs array<struct<start: long, length: long, period: long>>, collapsed string"
_RUN = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))


def _find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        codes = Codes()
        words = [(t or b"").split() for t in b.column(1).cast(pa.binary()).to_pylist()]
        found = runs_of([np.fromiter(map(codes.__getitem__, w), np.int32, len(w)) for w in words])
        collapsed = []
        for w, runs in zip(words, found, strict=True):
            if runs:
                keep = np.ones(len(w), bool)
                for s, n, q in runs:
                    keep[s + q : s + n] = False
                w = [w[i] for i in np.flatnonzero(keep).tolist()]
            collapsed.append(b" ".join(w))
        runs = pa.array([[{"start": s, "length": n, "period": q} for s, n, q in r] for r in found], _RUN)
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array([len(w) for w in words], pa.int64()), runs, pa.array(collapsed, pa.binary()).cast(pa.string())], ["doc_id", "n_words", "runs", "collapsed"])


def periodic_runs(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, runs and the text without repetitions, of each row of docs (doc_id, text; others are not read).

    Words are separated by ASCII white space. A run is a maximal stretch of max(24, 3 q) words or more with smallest period
    q; runs come by start, then period. collapsed has the words, joined by one space, that no run holds after its first
    q words. A null or empty text has no words and no run. Repeated rows stay, a null id stays null. Texts are worked on
    alone, a batch of some megabytes at a time; memory follows the longest text.
    """
    return map_texts(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")), _find, RUNS)


def planted(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text), where the words of a tenth of the texts, by the hash of the id, repeat from some word on.

    With h the CRC-32 of the decimal id and g = h div 10, where h % 10 = 0 word i >= a becomes word a + (i - a) % p,
    a = g % n, p = 1 + (n - a) div (3 + g % 8). Texts with no word, or with a null id, stay.
    """
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    words = f"filter(split(text, '{SPACE}'), x -> x <> '')".replace("\\", "\\\\")
    a, p = "cast((h div 10) % size(w) as int)", "cast(1 + (size(w) - (h div 10) % size(w)) div (3 + (h div 10) % 8) as int)"
    repeated = f"array_join(transform(w, (x, i) -> if(i < {a}, x, w[{a} + (i - {a}) % {p}])), ' ')"
    text = F.expr(f"if(h % 10 = 0, transform(array({words}), w -> if(size(w) > 0, {repeated}, ''))[0], text)")
    return docs.select("doc_id", "text", h.alias("h")).select("doc_id", text.alias("text"))


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of all documents, a tenth of which are made periodic."""
    found = periodic_runs(planted(table(spark, sf_dir, "documents").select("doc_id", "text")))
    best = F.expr("reduce(runs, cast(null as struct<start: bigint, length: bigint, period: bigint>), (b, r) -> if(b is null or r.length * b.period > b.length * r.period, r, b))")
    lines = F.expr("array_join(transform(runs, r -> concat(r.start, ',', r.length, ',', r.period, '\\n')), '')")
    return found.withColumn("best", best).select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        "best.start",
        "best.length",
        "best.period",
        F.expr("1000 * best.length div best.period").alias("exponent_milli"),
        F.sha2(lines.cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )
