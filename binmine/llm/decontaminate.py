"""Benchmark decontamination by latent semantic retrieval.

Benchmark items are cut into passages and weighted by TF-IDF, with document frequencies counted over the whole
corpus. A randomised SVD, whose products are summed over the passages' partitions, gives the latent space of a block of
passages, with as many dimensions as hold nearly all of their weight; windows of every document are projected into it
and compared with them by cosine. What comes near is checked word by word: the longest common subsequence must cover most
of the passage, or, for a paraphrase, less of it together with the passage's answer.

A window whose surroundings cannot hold a common subsequence that is long enough is not projected at all. At most a fixed
share of a passage's words may be missing, so of its rarest words, a few more than may be missing, those few must
stand close together. An index from such words to passages finds these places; that bound loses nothing.

Documents are tokenized to numbers of benchmark words, a batch at once, and only streamed, whole, never shuffled. The benchmark
is taken in groups of blocks, so what tasks hold does not grow with it: two passes over the documents for each group.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Remembered, gathered, map_texts, numbered, table

WORDS = re.compile(r"\w+").findall
#: Distinct runs without white space in one generation of a worker's memory, and words of documents that are matched at once.
RUNS_KEPT, CHUNK = 100_000, 1 << 17
#: Places of windows are multiples of their stride, which divides this; documents begin at multiples of it too.
ALIGN = 32


@dataclass(frozen=True)
class Settings:
    """passage: words of a passage at most; sizes: windows, in words, which move by a quarter (of a power of two) at a time.

    rank, extra, power: of the SVD; rank doubles until the space holds that share of the passages' energy.
    cosine: candidates. same: share of a passage in a common subsequence that suffices; near and answer: shares
    that suffice together. seldom: the answer of an item that states none is this many of its rarest words. full: passages
    of fewer words must be there in full. rarest: share of a passage's words that must stand together among its rarest for a
    window to be projected. light: passages whose words' weights are, in root mean square, below those of a
    word in one of this many documents are not left to the latent space. block: passages of one latent space; group:
    passages that are matched in one pass.
    """

    passage: int = 128
    sizes: tuple[int, ...] = (16, 24, 32, 48, 64, 96, 128)
    rank: int = 128
    extra: int = 16
    power: int = 2
    energy: float = 0.95
    cosine: float = 0.45
    same: float = 0.8
    near: float = 0.6
    answer: float = 0.8
    seldom: int = 5
    full: int = 8
    rarest: float = 0.15
    light: float = 20.0
    block: int = 256
    group: int = 2048
    seed: int = 7

    def stride(self, size: int) -> int:
        return min(ALIGN, 1 << max(0, (size // 4).bit_length() - 1))

    def need(self, n: int) -> int:
        """Words of a passage of n that a common subsequence must have."""
        return n if n < self.full else math.ceil(self.near * n - 1e-9)


@dataclass
class Passage:
    item_id: int
    words: list[str]
    answer: list[str]


def _passages(item_id: int, text: str | None, answer: str | None, s: Settings) -> list[Passage]:
    words, answered = words_of(text), words_of(answer)
    n = -(-len(words) // s.passage)
    return [Passage(item_id, words[i * len(words) // n : (i + 1) * len(words) // n], answered) for i in range(n)]


def words_of(text: str | None) -> list[str]:
    """The lower-cased words of a text, each character by itself."""
    return WORDS(pc.utf8_lower(pa.scalar(text or "")).as_py())


class Terms:
    """Numbers of terms; any other word is number `none`."""

    #: Punctuation but for the underscore, which is part of words.
    PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[\\]^`{|}~"

    def __init__(self, terms: list[str]) -> None:
        self.terms, self.none = terms, len(terms)
        self.number = {t: i for i, t in enumerate(terms)}
        self.bytes: dict[str, bytes] = {}

    def __getstate__(self) -> dict:
        return {"terms": self.terms}

    def __setstate__(self, state: dict) -> None:
        self.__init__(state["terms"])

    def _encode(self, runs: list[str]) -> list[bytes]:
        get, other, marks, out = self.bytes.get, self.other, self.PUNCTUATION, []
        for r in runs:
            core = r.strip(marks)
            out.append(get(core, other) if core.isalnum() else b"".join([get(w, other) for w in WORDS(r)]))
        return out

    def _values(self, runs: list[str]) -> list[bytes]:
        """Runs of letters and digits are words; what others hold is remembered."""
        if not self.bytes:
            self.bytes, self.other = {t: i.to_bytes(4, "little") for t, i in self.number.items()}, self.none.to_bytes(4, "little")
            self.known = Remembered(self._encode, RUNS_KEPT)
        own, other = self.bytes, self.other
        known = self.known.learn({r for r in runs if r not in own and not r.isalnum()})
        return [own[r] if r in own else known.get(r, other) for r in runs]

    def read(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The numbers of all texts' words one after the other, and how many words each text has."""
        ids, n = numbered(texts, self._values)
        return ids.view("<i4"), n

    def frequencies(self, texts: pa.Array) -> np.ndarray:
        """How many of the texts have each term."""
        df = np.zeros(self.none + 1, np.int64)
        ids, n = self.read(texts)
        for x in np.split(ids, np.cumsum(n)[:-1]) if len(n) else []:
            df[np.unique(x)] += 1
        return df[:-1]


def document_frequencies(docs: DataFrame, terms: list[str]) -> tuple[np.ndarray, int]:
    """In how many rows of docs each term occurs, and the number of rows: counts of each task are summed in Spark.

    A null text is a row without terms.
    """
    of = Terms(terms)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, n = np.zeros(len(terms), np.int64), 0
        for b in gathered(batches):
            n += b.num_rows
            df += of.frequencies(b.column(0))
        at = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(at, -1)), pa.array(np.append(df[at], n))], ["term", "n"])

    out, rows = np.zeros(len(terms), np.int64), 0
    for r in map_texts(docs.select(F.col("text").cast("string").alias("text")), run, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).toLocalIterator():
        if r.term < 0:
            rows = r.n
        else:
            out[r.term] = r.n
    return out, rows


def randomised_svd(passages: DataFrame, terms: int, rank: int, extra: int = 16, power: int = 2, seed: int = 7) -> tuple[np.ndarray, float]:
    """Leading right singular vectors (terms x rank, or fewer) of the rows term (array), weight (array), and the sum of their squared values.

    A product with A'A is summed over partitions in stripes of terms, so a task holds one terms x (rank + extra) matrix.
    """
    width = min(rank + extra, terms)
    stripe = 1024

    def product(q: np.ndarray) -> np.ndarray:
        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            z = np.zeros((terms, q.shape[1]))
            for pdf in batches:
                for t, w in zip(pdf["term"], pdf["weight"], strict=True):
                    t, w = np.asarray(t), np.asarray(w)
                    z[t] += np.outer(w, w @ q[t])  # a passage names each term once
            yield pd.DataFrame({"stripe": range(0, terms, stripe), "part": [z[i : i + stripe].tobytes() for i in range(0, terms, stripe)]})

        def add(pdf: pd.DataFrame) -> pd.DataFrame:
            return pd.DataFrame({"stripe": pdf["stripe"][:1], "part": [sum(np.frombuffer(p) for p in sorted(pdf["part"])).tobytes()]})

        parts = passages.mapInPandas(run, "stripe int, part binary").groupBy("stripe").applyInPandas(add, "stripe int, part binary").collect()
        return np.concatenate([np.frombuffer(p.part) for p in sorted(parts, key=lambda p: p.stripe)]).reshape(terms, -1)

    q = np.linalg.qr(np.random.default_rng(seed).standard_normal((terms, width)))[0]
    for _ in range(power):
        q = np.linalg.qr(product(q))[0]
    z = product(q)
    values, vectors = np.linalg.eigh(q.T @ z)
    keep = np.argsort(-values)[: min(rank, width)]
    keep = keep[values[keep] > 1e-9 * max(values.max(), 1e-30)]
    return q @ vectors[:, keep], float(values[keep].sum())


def common_subsequence(passage: list, words: list) -> int:
    """Length of the longest common subsequence, a machine word's or more of columns at a time."""
    where: dict = {}
    for i, w in enumerate(passage):
        where[w] = where.get(w, 0) | 1 << i
    full = (1 << len(passage)) - 1
    s = full
    for w in words:
        if u := s & where.get(w, 0):
            s = (s + u | s - u) & full
    return len(passage) - s.bit_count()


@dataclass
class _Class:
    """Passages of one block that are looked for in windows of one size; q: their directions in the latent space."""

    size: int
    of: list[int]
    q: np.ndarray | None = None


class Matcher:
    """The passages of one block of the benchmark that texts hold.

    Words next to a light passage outweigh it in any window, so light and short passages, and those without a direction in
    the latent space, are verified wherever enough of their words stand together.
    """

    def __init__(self, passages: list[Passage], terms: Terms, idf: np.ndarray, space: np.ndarray, s: Settings, own: list[int] | None = None) -> None:
        """idf: a weight for each term; own: the terms that space has rows for, if not all. Others share a row of zeros."""
        own = list(range(terms.none)) if own is None else own
        self.s, self.passages, self.terms = s, passages, terms
        number = terms.number
        self.ids = [[number[w] for w in p.words] for p in passages]
        self.answers = [{number.get(w, -1) for w in p.answer} or set(sorted(set(i), key=lambda x: (-idf[x], terms.terms[x]))[: s.seldom]) for p, i in zip(passages, self.ids, strict=True)]
        self.space = np.vstack([space * idf[own, None], np.zeros((1, space.shape[1]))]).astype(np.float32)
        self.row = np.full(terms.none + 1, len(own), np.int32)
        self.row[own] = np.arange(len(own), dtype=np.int32)
        latent: dict[int, list[int]] = {}
        exact: dict[int, list[int]] = {}
        self.least, self.span, posts = np.zeros(len(passages), np.int64), np.zeros(len(passages), np.int64), []
        for k, at in enumerate(self.ids):
            size = next((w for w in s.sizes if w >= len(at)), s.sizes[-1])
            heavy = (idf[at] ** 2).mean() >= math.log(s.light) ** 2 and np.linalg.norm(self.space[self.row[at]].sum(axis=0)) > 1e-6
            (latent if heavy and len(at) >= s.full else exact).setdefault(size, []).append(k)
            # of any words of a passage but for so many as may be missing, some must be there: the rarest are asked for
            need = s.need(len(at))
            least = min(need, max(3, math.ceil(s.rarest * len(at))))
            self.least[k], self.span[k] = least, size + 2 * (size // 4)
            posts += [(w, k) for w in set(sorted(at, key=lambda x: (-idf[x], x))[: len(at) - need + least])]
        posts.sort()
        self.post = np.array([k for _, k in posts], np.int64)
        self.degree = np.bincount([w for w, _ in posts], minlength=terms.none + 1)
        self.first = np.cumsum(self.degree) - self.degree
        self.latent = [_Class(size, of) for size, of in sorted(latent.items())]
        self.exact = [_Class(size, of) for size, of in sorted(exact.items())]
        for c in self.latent:
            q = np.array([self.space[self.row[self.ids[k]]].sum(axis=0) for k in c.of], np.float32)
            c.q = (q / np.linalg.norm(q, axis=1, keepdims=True)).T.copy()

    def _places(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(passage, first, last): where the least number of a passage's rarest words stand as close as its surroundings reach."""
        at = np.flatnonzero(self.degree[ids])
        n = self.degree[ids[at]]
        total = int(n.sum())
        post = self.post[np.repeat(self.first[ids[at]] - (np.cumsum(n) - n), n) + np.arange(total)]
        shift = len(ids) + 2 * int(self.span.max(initial=0))
        key = np.sort(post * shift + np.repeat(at, n))
        k = key // shift
        j = np.arange(total) + self.least[k] - 1
        i = np.flatnonzero(j < total)
        i = i[key[j[i]] - key[i] < self.span[k[i]]]  # a smaller step than any from one passage to the next
        return k[i], key[i] - k[i] * shift, key[j[i]] - k[i] * shift

    def _starts(self, c: _Class, first: np.ndarray, last: np.ndarray, lo: int, hi: int, begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places from lo to hi of windows whose surroundings hold some first to last, and their texts."""
        step, around = self.s.stride(c.size), c.size // 4
        a = np.clip(-(-(last - around - c.size + 1) // step), lo // step, hi // step)
        b = np.clip((first + around) // step + 1, a, -(-hi // step))
        marks = np.bincount(a - lo // step, minlength=-(-hi // step) - lo // step + 1) - np.bincount(b - lo // step, minlength=-(-hi // step) - lo // step + 1)
        starts = (np.flatnonzero(np.cumsum(marks) > 0) + lo // step) * step
        text = np.searchsorted(begin, starts, side="right") - 1
        n = end[text] - begin[text]
        ok = starts - begin[text] < np.minimum(n, np.maximum(1, n - c.size // 2))
        return starts[ok], text[ok]

    def matches(self, ids: np.ndarray, begin: np.ndarray, end: np.ndarray, best: dict[tuple[int, int], tuple]) -> None:
        """Adds the best place of each item that text i, ids[begin[i]:end[i]], holds as best[i, item_id].

        begin is aligned. A place is (first word, word after the last, cosine, share in common, share of the answer); the
        larger share in common, then of the answer, then the earlier and the shorter place is better.
        """
        lap = 2 * self.s.sizes[-1]
        for lo in range(0, len(ids), CHUNK):
            hi, a = min(len(ids), lo + CHUNK), max(0, lo - lap)
            k, first, last = self._places(ids[a : hi + lap])
            if not len(k):
                continue
            for c in self.latent:
                here = np.isin(k, c.of)
                starts, text = self._starts(c, first[here] + a, last[here] + a, lo, hi, begin, end)
                for i in range(0, len(starts), 1024):
                    s, t = starts[i : i + 1024], text[i : i + 1024]
                    v = np.zeros((len(s), self.space.shape[1]), np.float32)
                    for j in range(c.size):
                        v += self.space[self.row[np.where(s + j < end[t], ids[np.minimum(s + j, len(ids) - 1)], self.terms.none)]]
                    cos = v @ c.q / np.maximum(np.linalg.norm(v, axis=1), 1e-6)[:, None]
                    for r, m in zip(*(x.tolist() for x in np.nonzero(cos >= self.s.cosine)), strict=True):
                        self._verify(c.of[m], ids, int(s[r]), c.size, int(t[r]), begin, end, float(cos[r, m]), best)
            for c in self.exact:
                for m in c.of:
                    here = k == m
                    if here.any():
                        for start, text in zip(*(x.tolist() for x in self._starts(c, first[here] + a, last[here] + a, lo, hi, begin, end)), strict=True):
                            self._verify(m, ids, start, c.size, text, begin, end, 0.0, best)

    def _verify(self, k: int, ids: np.ndarray, start: int, size: int, text: int, begin: np.ndarray, end: np.ndarray, cos: float, best: dict[tuple[int, int], tuple]) -> None:
        a, b = max(int(begin[text]), start - size // 4), min(int(end[text]), start + size + size // 4)
        region, own = ids[a:b].tolist(), self.ids[k]
        held = set(region)
        if sum(map(held.__contains__, own)) < self.s.need(len(own)):  # no common subsequence can be longer
            return
        common = common_subsequence(own, region)
        if common < self.s.need(len(own)):
            return
        share = common / len(own)
        answer = sum(w in held for w in self.answers[k]) / len(self.answers[k])
        if len(own) < self.s.full or share >= self.s.same or answer >= self.s.answer:
            key = (text, self.passages[k].item_id)
            found = (a - int(begin[text]), b - int(begin[text]), round(cos, 4), share, answer)
            if key not in best or (share, answer, -found[0], -found[1]) > (best[key][3], best[key][4], -best[key][0], -best[key][1]):
                best[key] = found


def matches(matchers: list[Matcher], texts: pa.Array) -> dict[tuple[int, int], tuple]:
    """(number of the text, item_id) -> its best place; matchers share their terms."""
    read, n = matchers[0].terms.read(texts)
    room = -(-n // ALIGN) * ALIGN
    begin = np.cumsum(room) - room
    ids = np.full(int(room.sum()), matchers[0].terms.none, np.int32)
    ids[np.arange(len(read)) + np.repeat(begin - (np.cumsum(n) - n), n)] = read
    best: dict[tuple[int, int], tuple] = {}
    if len(ids):
        for m in matchers:
            m.matches(ids, begin, begin + n, best)
    return best


def _groups(benchmark: DataFrame, s: Settings) -> Iterator[list[Passage]]:
    """Passages of the benchmark in order of their ids, about s.group at a time; rows of one id stay together.

    The benchmark is read as a stream. Repeated rows count once; null ids and null and empty texts give no passage.
    """
    answer = F.col("answer").cast("string") if "answer" in benchmark.columns else F.lit(None).cast("string")
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text"), answer.alias("answer")).where("text is not null and item_id is not null").distinct()
    held: list[Passage] = []
    for r in items.orderBy("item_id", "text", "answer").toLocalIterator():
        if len(held) >= s.group and held[-1].item_id != r.item_id:
            yield held
            held = []
        held += _passages(r.item_id, r.text, r.answer, s)
    if held:
        yield held


def latent_space(spark: SparkSession, rows: list[tuple[list[int], list[float]]], terms: int, s: Settings) -> np.ndarray:
    """The space (terms x dimensions) that holds s.energy of the unit rows (terms, weights); at most as many dimensions as rows."""
    matrix, rank = spark.createDataFrame(rows, "term array<int>, weight array<double>"), s.rank
    while True:
        space, held = randomised_svd(matrix, terms, min(rank, len(rows)), s.extra, s.power, s.seed)
        if held >= s.energy * len(rows) or rank >= min(len(rows), terms):
            return space
        rank *= 2


def matchers(docs: DataFrame, benchmark: DataFrame, s: Settings = Settings()) -> Iterator[list[Matcher]]:
    """Matchers of each group of the benchmark: item_id, text and, if there is one, answer.

    The corpus is read once for the frequencies of all of the benchmark's words, which the driver holds.
    """
    every = sorted({w for group in _groups(benchmark, s) for p in group for w in (*p.words, *p.answer)})
    if not every:
        return
    df, n = document_frequencies(docs, every)
    weight = dict(zip(every, (np.log((n + 1.0) / (df + 1.0)) + 1e-3).tolist(), strict=True))
    for group in _groups(benchmark, s):
        terms = Terms(sorted({w for p in group for w in (*p.words, *p.answer)}))
        idf = np.array([weight[w] for w in terms.terms])
        out = []
        for at in range(0, len(group), s.block):
            block = group[at : at + s.block]
            own = sorted({terms.number[w] for p in block for w in p.words})
            number = {t: i for i, t in enumerate(own)}
            sparse = []
            for p in block:
                tf: dict[int, float] = {}
                for t in (terms.number[w] for w in p.words):
                    tf[number[t]] = tf.get(number[t], 0.0) + float(idf[t])
                norm = math.sqrt(sum(x * x for x in tf.values()))
                sparse.append((list(tf), [x / norm for x in tf.values()]))
            found = latent_space(docs.sparkSession, sparse, len(own), s)
            out.append(Matcher(block, terms, idf, found, s, own))
        yield out


FOUND = "doc_id long, item_id long, word_start long, word_end long, cosine double, common double, answer double"


def leaks(docs: DataFrame, benchmark: DataFrame, s: Settings = Settings()) -> DataFrame:
    """A row for each row of docs and benchmark item that it holds: ids, place (word numbers), cosine and shares.

    Documents that hold none have no row; null and empty texts hold none. The cosine of passages that are found
    without the latent space, as they are short or their words stand in very many documents, is 0; items of fewer than
    s.full words must be there in full. Repeated rows of docs each get their rows. Other columns are not read.
    """
    out = docs.sparkSession.createDataFrame([], FOUND)
    for group in matchers(docs, benchmark, s):

        def run(batches: Iterator[pa.RecordBatch], group: list[Matcher] = group) -> Iterator[pa.RecordBatch]:
            for b in gathered(batches):
                docs = b.column(0).to_pylist()
                rows = [(docs[i], item, *x) for (i, item), x in matches(group, b.column(1)).items()]
                cols = list(zip(*rows, strict=True)) or [[]] * 7
                kinds = [pa.int64()] * 4 + [pa.float64()] * 3
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], [x.split()[0] for x in FOUND.split(", ")])

        found = map_texts(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")), run, FOUND)
        out = out.unionByName(found)
    return out


def without_leaks(docs: DataFrame, benchmark: DataFrame, s: Settings = Settings()) -> DataFrame:
    """docs without the rows that leaks() would name; all columns are kept and no row is shuffled."""
    at = docs.columns.index("text")
    out = docs
    for group in matchers(docs, benchmark, s):

        def run(batches: Iterator[pa.RecordBatch], group: list[Matcher] = group) -> Iterator[pa.RecordBatch]:
            for b in gathered(batches):
                held = {i for i, _ in matches(group, b.column(at))}
                yield b.filter(pa.array([i not in held for i in range(b.num_rows)], pa.bool_()))

        out = map_texts(out, run, docs.schema)
    return out


def op1_latent_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every benchmark item that any document holds."""
    return leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
