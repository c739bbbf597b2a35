"""Language identification by hierarchical discrimination: the family first, then one against one inside it.

Evidence is what stands around each letter: the letter with its two neighbours, anything but letters being a space,
hashed to a fixed number of buckets. A family's share of buckets (multinomial, smoothed towards the whole corpus) tells
families apart, which differ in many letters. Close relatives share most of them, so for each two languages of a family
a linear support vector machine learns which few decide; the language that wins most of its duels is taken.

Family shares are counts over all training rows. Machines are fitted on a sample of bounded size (SAMPLE texts of each
language), each in a task of its own, by dual coordinate descent.
"""

from __future__ import annotations

import functools
import hashlib
import math
from collections.abc import Iterator, Mapping
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import discard, map_texts, table, written

#: Families of languages; a language that is not listed is a family of its own.
FAMILIES = {
    "germanic": ("af", "da", "de", "en", "fy", "is", "lb", "nb", "nl", "nn", "no", "sv", "yi"),
    "romance": ("ca", "es", "fr", "gl", "it", "oc", "pt", "ro"),
    "slavic": ("be", "bg", "bs", "cs", "hr", "mk", "pl", "ru", "sk", "sl", "sr", "uk"),
    "baltic": ("lt", "lv"),
    "celtic": ("br", "cy", "ga", "gd"),
    "finnic": ("et", "fi"),
    "turkic": ("az", "kk", "ky", "tr", "tt", "ug", "uz"),
    "indic": ("bn", "gu", "hi", "mr", "ne", "pa", "ur"),
    "iranian": ("fa", "ku", "ps", "tg"),
    "semitic": ("am", "ar", "he", "mt"),
    "sinitic": ("wuu", "yue", "zh"),
    "malayic": ("id", "ms"),
}
#: Hash buckets, texts of a language that its machines learn from, and letters that are worked on at once.
BUCKETS, SAMPLE, STEP = 1 << 16, 2000, 1 << 20
#: Weight of the corpus's shares in a family's, in letters a bucket has in the mean, and letters that one letter is seen with.
PRIOR, SEEN = 0.01, 3.0
#: Cost of a text on the wrong side, and rounds of descent.
COST, ROUNDS = 1.0, 20
UNKNOWN = "und"


@functools.cache
def _letters() -> np.ndarray:
    return np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)


def buckets(text: str) -> Iterator[np.ndarray]:
    """The bucket of each letter of the lower-cased text and its neighbours, some letters at a time."""
    whole = f" {text.lower()} "
    for at in range(0, len(whole) - 2, STEP):
        code = np.frombuffer(whole[at : at + STEP + 2].encode("utf-32-le", "surrogatepass"), "<u4")
        letter = _letters()[code]
        c = np.where(letter, code, 32).astype(np.uint64)
        i = np.flatnonzero(letter[1:-1]) + 1
        h = (c[i - 1] * np.uint64(0x9E3779B97F4A7C15)) ^ (c[i] * np.uint64(0xC2B2AE3D27D4EB4F)) ^ (c[i + 1] * np.uint64(0x165667B19E3779F9))
        h ^= h >> np.uint64(31)
        yield ((h * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(48)).astype(np.int64)


def _counts(text: str) -> np.ndarray:
    return sum((np.bincount(b, minlength=BUCKETS) for b in buckets(text)), np.zeros(BUCKETS, np.int64))


@dataclass
class Model:
    """Languages by family; table: a row for each bucket, a column for each family, then one for each duel."""

    families: list[list[str]]
    table: np.ndarray
    prior: np.ndarray
    duels: list[tuple[str, str]]
    bias: np.ndarray
    slope: np.ndarray

    def predict(self, text: str) -> tuple[str, float]:
        """The language and how sure it is: the family's share times the mean chance of its duels."""
        total, n = np.zeros(self.table.shape[1]), 0
        for b in buckets(text):
            total += self.table[b].sum(axis=0, dtype=np.float64)
            n += len(b)
        if not n:
            return UNKNOWN, 0.0
        k = len(self.families)
        log = self.prior + total[:k] / SEEN
        share = np.exp(log - log.max())
        best = int(np.argmax(share))
        sure, own = float(share[best] / share.sum()), self.families[best]
        if len(own) == 1:
            return own[0], sure
        margin = total[k:] / n + self.bias
        won, chance = dict.fromkeys(own, 0), dict.fromkeys(own, 0.0)
        for (a, b), m, s in zip(self.duels, margin.tolist(), self.slope.tolist(), strict=True):
            if a in won:
                p = 1.0 / (1.0 + math.exp(-max(-700.0, min(700.0, s * m))))
                won[a if m >= 0 else b] += 1
                chance[a] += p
                chance[b] += 1.0 - p
        top = max(own, key=lambda x: (won[x], chance[x]))
        return top, sure * chance[top] / (len(own) - 1)


def held_out(key: Column) -> Column:
    """Whether the CRC-32 of the id as text leaves 1 when divided by 3; false for a null id."""
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def _family_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """lang, bucket, n: letters by bucket, and at bucket -1 the texts that have any."""
    found: dict[str, np.ndarray] = {}
    for b in batches:
        for text, lang in zip(*b.columns, strict=True):
            n = _counts(text.as_py())
            if n.any():
                own = found.setdefault(lang.as_py(), np.zeros(BUCKETS + 1, np.int64))
                own[:-1] += n
                own[-1] += 1
    for lang, n in found.items():
        at = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(np.where(at == BUCKETS, -1, at)), pa.array(n[at])], ["lang", "bucket", "n"])


def _examples(duels: list[tuple[str, str]]):
    """A row for each duel that a text's language takes part in: its side, and the share of its letters in each bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for text, lang in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                n = _counts(text)
                at = np.flatnonzero(n)
                if len(at):
                    share = (n[at] / n.sum()).astype(np.float32)
                    key = hashlib.md5(text.encode()).hexdigest()
                    out += [(d, 1 if lang == pair[0] else -1, key, at, share) for d, pair in enumerate(duels) if lang in pair]
            cols = list(zip(*out, strict=True)) or [[]] * 5
            kinds = (pa.int32(), pa.int32(), pa.string(), pa.list_(pa.int32()), pa.list_(pa.float32()))
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], ["duel", "side", "key", "at", "share"])

    return run


def svm(x: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, size: int, cost: float = COST, rounds: int = ROUNDS) -> tuple[np.ndarray, float]:
    """Weights and bias that minimise |w|^2 / 2 + cost * sum of squared hinge losses, by dual coordinate descent.

    x: places (distinct) and values of each example. Sides are weighted alike whatever their number of examples.
    """
    w, bias = np.zeros(size), 0.0
    each = {s: len(y) / (2.0 * max(1, int((y == s).sum()))) for s in (-1, 1)}
    slack = np.array([1.0 / (2.0 * cost * each[int(s)]) for s in y])
    square = np.array([v @ v + 1.0 for _, v in x]) + slack
    alpha, order = np.zeros(len(y)), np.random.default_rng(0)
    for _ in range(rounds):
        most = 0.0
        for i in order.permutation(len(y)).tolist():
            at, v = x[i]
            gradient = y[i] * (float(w[at] @ v) + bias) - 1.0 + slack[i] * alpha[i]
            new = max(0.0, alpha[i] - gradient / square[i])
            step = (new - alpha[i]) * y[i]
            if step:
                w[at] += step * v
                bias += step
                most = max(most, abs(step))
                alpha[i] = new
        if most < 1e-4:
            break
    return w, bias


def _fit_duel(pdf: pd.DataFrame) -> pd.DataFrame:
    """The machine of one duel; places are scaled by their share in all its texts, which the weights then hold."""
    pdf = pdf.sort_values(["key", "side"])
    y = pdf["side"].to_numpy()
    x = [(np.asarray(a, np.int64), np.asarray(v, np.float64)) for a, v in zip(pdf["at"], pdf["share"], strict=True)]
    share = np.zeros(BUCKETS)
    for at, v in x:
        share[at] += v
    scale = 1.0 / np.sqrt(share / len(x) + 1.0 / BUCKETS)
    w, bias = svm([(at, v * scale[at]) for at, v in x], y, BUCKETS)
    w *= scale
    margin = y * np.array([float(w[at] @ v) + bias for at, v in x])
    slope = 1.0
    for _ in range(30):  # the slope of a logistic curve over the margins, with one example on each wrong side
        m = np.append(margin, -1.0)
        p = 1.0 / (1.0 + np.exp(np.clip(slope * m, -30, 30)))
        slope = float(np.clip(slope + (m @ p) / max(1e-9, (m * m) @ (p * (1 - p))), 0.1, 50.0))
    at = np.flatnonzero(w)
    return pd.DataFrame({"duel": [int(pdf["duel"].iloc[0])], "bias": [bias], "slope": [slope], "at": [at.tolist()], "w": [w[at].tolist()]})


def fit(docs: DataFrame, sample: int = SAMPLE, families: Mapping[str, tuple[str, ...]] = FAMILIES) -> Model | None:
    """The model of docs (doc_id, text, lang): rows that are not held out and have an id, a text and a language; None without letters there.

    What reaches the driver is a number for each language, or duel, and bucket. A duel's task holds its sample's letters
    by bucket, about SAMPLE texts of two languages.
    """
    train = docs.where("doc_id is not null and text is not null and lang is not null").where(~held_out(F.col("doc_id"))).select(F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    n: dict[str, np.ndarray] = {}
    for r in map_texts(train, _family_counts, "lang string, bucket long, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toLocalIterator():
        n.setdefault(r.lang, np.zeros(BUCKETS + 1))[r.bucket] = r.n
    if not n:
        return None
    of = {lang: name for name, langs in families.items() for lang in langs}
    groups: dict[str, list[str]] = {}
    for lang in sorted(n):
        groups.setdefault(of.get(lang, f"only {lang}"), []).append(lang)
    own = list(groups.values())
    letters = np.array([sum(n[x][:-1] for x in g) for g in own])
    texts = np.array([sum(n[x][-1] for x in g) for g in own])
    corpus = (letters.sum(axis=0) + 1.0) / (letters.sum() + BUCKETS)
    weight = PRIOR * BUCKETS
    shares = np.log((letters + weight * corpus) / (letters.sum(axis=1, keepdims=True) + weight))
    duels = [(a, b) for g in own for k, a in enumerate(g) for b in g[k + 1 :]]
    columns, bias, slope = np.zeros((BUCKETS, len(duels))), np.zeros(len(duels)), np.ones(len(duels))
    if duels:
        spark = docs.sparkSession
        rates = spark.createDataFrame([(x, min(1.0, sample / float(n[x][-1]))) for g in own if len(g) > 1 for x in g], "lang string, rate double")
        draw = F.pmod(F.xxhash64("lang", "text"), F.lit(1 << 30)) / F.lit(float(1 << 30))
        some = train.join(F.broadcast(rates), "lang").where(draw < F.col("rate")).select("text", "lang").dropDuplicates()  # copies teach once
        some, path = written(some, "language-sample")
        for r in map_texts(some, _examples(duels), "duel int, side int, key string, at array<int>, share array<float>").groupBy("duel").applyInPandas(_fit_duel, "duel int, bias double, slope double, at array<int>, w array<double>").toLocalIterator():
            columns[r.at, r.duel] = r.w
            bias[r.duel], slope[r.duel] = r.bias, r.slope
        discard(spark, path)
    return Model(own, np.column_stack([shares.T, columns]).astype(np.float32), np.log(texts / texts.sum()), duels, bias, slope)


PREDICTED = "doc_id long, lang_pred string, score double"


def predict(docs: DataFrame, model: Model | None) -> DataFrame:
    """doc_id, lang_pred, score (0 to 1) of each row of docs, from nothing but its whole text.

    A null text, or one without a letter, is "und" with score 0; so is every text without a model. Repeated rows and null
    ids stay, other columns are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [model.predict(t or "") if model else (UNKNOWN, 0.0) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([x for x, _ in found], pa.string()), pa.array([s for _, s in found], pa.float64())], ["doc_id", "lang_pred", "score"])

    return map_texts(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")), run, PREDICTED)


def op13_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document."""
    docs = table(spark, sf_dir, "documents")
    return predict(docs, fit(docs)).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")
