"""Toxic passages as maximal-scoring segments of token log-odds.

A token's score is the log-odds that it stands in a toxic rather than a clean text, less a drift that makes ordinary
text score below zero. Counts are smoothed by Dirichlet priors in two levels: a token's prior is its prefix, a
prefix's prior the whole corpus, so an inflected form that was never seen takes after its stem. A linear-time scan
finds all maximal-scoring segments of a text. By extreme-value theory the number of chance segments of score S or more
in n tokens is about E = K n exp(-lambda S): lambda solves E[exp(lambda s)] = 1 over the scores of clean tokens, K comes
from the best segments of clean texts. Tokens of real texts come in clumps, which stretches the tail; what is called a
significant passage is, where clean texts refute the theory, settled by a line through the logarithms of the shares of
them that have a best segment as good or better. What a text holds is gathered as -log E of all its segments together (S is the
log of their summed exponentials), which a logistic curve turns into a probability.

Only training rows teach: counts, lambda, K and the curve. Lambda, K and the curve are fitted on scores that each half of
them gets from the other half's counts, each half with its own lambda.
"""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import map_texts, table, written

#: Labelled rows that the fit takes at most, drawn by hash.
FIT_ROWS = 100_000
#: Hash buckets of tokens and of prefixes, and the letters of a prefix.
TOKENS, PREFIXES, PREFIX = 1 << 18, 1 << 16, 4
#: Prior weights in tokens, and the drift.
TOKEN_PRIOR, PREFIX_PRIOR, DRIFT = 5.0, 20.0, 1.5
#: Evidence is kept between these; bins of the calibration are a quarter wide.
LOW, HIGH, BIN = -20.0, 60.0, 0.25
#: Token scores are counted between minus and plus this, in bins so wide.
SPREAD, NARROW = 20.0, 0.02
THRESHOLD = 0.3
#: Share of clean texts with a passage as good, below which it is significant, and the share from which on the tail is fitted.
SIGNIFICANT, TAIL = 0.01, 0.04

WORDS = re.compile(r"\w+").findall


def _token(word: str) -> int:
    return zlib.crc32(word.encode("utf-8", "surrogatepass")) % TOKENS


def _prefix(word: str) -> int:
    return zlib.crc32(word[:PREFIX].encode("utf-8", "surrogatepass")) % PREFIXES


class Counts:
    """Token and prefix counts of clean (row 0) and toxic (row 1) texts."""

    def __init__(self) -> None:
        self.tokens, self.prefixes = np.zeros((2, TOKENS)), np.zeros((2, PREFIXES))
        self._known: dict[str, tuple[int, int]] = {}

    def add(self, text: str, toxic: int) -> None:
        words = WORDS(text.lower())
        if len(self._known) > 300_000:
            self._known.clear()
        known = self._known
        for w in words:
            if w not in known:
                known[w] = (_token(w), _prefix(w))
        if words:
            at = np.array([known[w] for w in words])
            self.tokens[toxic] += np.bincount(at[:, 0], minlength=TOKENS)
            self.prefixes[toxic] += np.bincount(at[:, 1], minlength=PREFIXES)


@dataclass
class Model:
    """Scores of tokens, and what turns a text's evidence into a probability; log_k is the log of K.

    least is the value of lambda S - log n that a share of SIGNIFICANT clean texts reach.
    """

    tokens: np.ndarray
    prefix_share: np.ndarray
    share: float
    lam: float = 1.0
    log_k: float = 0.0
    slope: float = 1.0
    intercept: float = 0.0
    least: float = 0.0

    @classmethod
    def of(cls, tokens: np.ndarray, prefixes: np.ndarray) -> Model:
        total = tokens.sum(axis=1)
        share = (total[1] + 1.0) / (total.sum() + 2.0)
        prefix_share = (prefixes[1] + PREFIX_PRIOR * share) / (prefixes.sum(axis=0) + PREFIX_PRIOR)
        return cls(tokens.astype(np.float32), prefix_share.astype(np.float32), float(share))

    def score(self, word: str) -> float:
        t, rho = self.tokens[:, _token(word)], float(self.prefix_share[_prefix(word)])
        odds = (float(t[1]) + TOKEN_PRIOR * rho) / (float(t[0]) + TOKEN_PRIOR * (1 - rho))
        return math.log(odds) - math.log(self.share / (1 - self.share)) - DRIFT

    def probability(self, evidence: float) -> float:
        return 1.0 / (1.0 + math.exp(-max(-700.0, min(700.0, self.intercept + self.slope * evidence))))


def solve_lambda(scores: np.ndarray, weights: np.ndarray) -> float:
    """The positive lambda of which the mean of exp(lambda score) is 1; 1.0 where there is none, as no score or the mean is above zero."""
    scores, w = scores[weights > 0], weights[weights > 0] / max(weights.sum(), 1e-300)
    if not len(scores) or scores.max() <= 0 or (w * scores).sum() >= 0:
        return 1.0
    mean = lambda x: float((w * np.exp(x * scores)).sum())
    lo, hi = 0.0, 1.0
    while mean(hi) <= 1.0:
        hi *= 2
    for _ in range(80):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if mean(mid) < 1.0 else (lo, mid)
    return hi


def gumbel_log_k(x: np.ndarray, weights: np.ndarray, low: float) -> float:
    """log K from lambda M - log n of the best segments M of chance texts; texts without a segment stand at low.

    A quantile q of the distribution exp(-K exp(-x)) is at log K - log(-log q); the one halfway up among texts with segments is taken.
    """
    order = np.argsort(x)
    x, share = x[order], np.cumsum(weights[order]) / weights.sum()
    none = float(share[x <= low][-1]) if (x <= low).any() else 0.0
    if none >= 1.0:
        return 0.0
    at = int(np.searchsorted(share, (1.0 + none) / 2))
    q = float(share[at - 1] + share[at]) / 2 if at else float(share[at]) / 2
    return float(x[at]) + math.log(-math.log(q))


def tail_value(x: np.ndarray, weights: np.ndarray, share: float, log_k: float) -> float:
    """The value that a share of chance texts, with best segments x, reach.

    By theory that is where E = exp(log K - x) is the share. Where more than three times as many of the texts at hand reach
    it, the theory's independent tokens do not fit them, and a line through the tail's log shares, in which points count by
    their texts, takes its place, if the tail is long enough for one.
    """
    order = np.argsort(-x)
    x, weights = x[order], weights[order]
    reach = np.cumsum(weights) / weights.sum()  # of the texts at x or more
    tail = np.flatnonzero((reach <= TAIL) & (np.cumsum(weights) >= 5))
    theory = log_k - math.log(share)
    if weights[x >= theory].sum() <= 3 * share * weights.sum() or len(tail) < 3:
        return theory
    slope, at = np.polyfit(x[tail], np.log(reach[tail]), 1, w=np.sqrt(np.cumsum(weights)[tail]))
    return float((math.log(share) - at) / slope) if slope < 0 else theory


def maximal_segments(scores: np.ndarray) -> list[tuple[int, int, float]]:
    """All maximal-scoring segments (start, end, score), in order, in linear time (after Ruzzo and Tompa)."""
    total = np.concatenate([[0.0], np.cumsum(scores)])
    segs: list[tuple[float, float, int, int, int]] = []  # left and right totals, start, end, the last one with a smaller left
    for i in np.flatnonzero(scores > 0).tolist():
        left, right, start = total[i], total[i + 1], i
        while True:
            j = len(segs) - 1
            while j >= 0 and segs[j][0] >= left:
                j = segs[j][4]
            if j < 0 or segs[j][1] >= right:
                segs.append((left, right, start, i + 1, j))
                break
            left, start = segs[j][0], segs[j][2]
            del segs[j:]
    return [(a, b, r - l) for l, r, a, b, _ in segs]


class Scorer:
    """evidence(text) and the text's segments, with token scores remembered."""

    def __init__(self, model: Model) -> None:
        self.model, self.known = model, {}

    def scores(self, text: str) -> np.ndarray:
        words = WORDS(text.lower())
        known = self.known
        try:
            scores = [known[w] for w in words]
        except KeyError:
            if len(known) > 300_000:
                known.clear()
            for w in words:
                if w not in known:
                    known[w] = self.model.score(w)
            scores = [known[w] for w in words]
        return np.array(scores)

    def segments(self, text: str) -> tuple[list[tuple[int, int, float]], int]:
        scores = self.scores(text)
        return maximal_segments(scores), len(scores)

    def raw(self, segments: list[tuple[int, int, float]], n: int) -> tuple[float, float]:
        """lambda S - log n of all segments together, and of the best one."""
        if not segments:
            return LOW, LOW
        x = self.model.lam * np.array([s for _, _, s in segments])
        top = float(x.max())
        return tuple(min(HIGH, max(LOW, v - math.log(n))) for v in (top + math.log(float(np.exp(x - top).sum())), top))

    def evidence(self, segments: list[tuple[int, int, float]], n: int) -> float:
        """-log E of a text's segments."""
        return self.raw(segments, n)[0] - self.model.log_k


def held_out(key: Column) -> Column:
    """Whether the CRC-32 of the id as text leaves 2 when divided by 4; false for a null id."""
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def _training(docs: DataFrame, labels: DataFrame, fit_rows: int) -> DataFrame:
    """text, toxic, fold of the training rows: at most fit_rows labels, whose small table is then safe to broadcast."""
    known = (
        labels.where("doc_id is not null and toxic is not null")
        .where(~held_out(F.col("doc_id")))
        .groupBy("doc_id")
        .agg((F.max("toxic") > 0).cast("int").alias("toxic"))
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(fit_rows)
    )
    fold = F.pmod(F.xxhash64("doc_id"), F.lit(2)).cast("int")
    return docs.select("doc_id", "text").join(F.broadcast(written(known, "labels")[0]), "doc_id").select(F.coalesce("text", F.lit("")).alias("text"), "toxic", fold.alias("fold"))


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    folds = [Counts(), Counts()]
    for b in batches:
        for text, toxic, fold in zip(*b.columns, strict=True):
            folds[fold.as_py()].add(text.as_py(), toxic.as_py())
    for fold, c in enumerate(folds):
        for what, of in ((0, c.tokens), (1, c.prefixes)):
            for toxic in (0, 1):
                at = np.flatnonzero(of[toxic])
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), (fold * 2 + what) * 2 + toxic)), pa.array(at), pa.array(of[toxic][at])], ["part", "bucket", "n"])


def _token_scores(models: list[Model]):
    """fold, bin, n, total: how often clean tokens of a fold score so by the other fold's counts, and the sum of their scores."""
    bins = int(2 * SPREAD / NARROW)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorers, out, total = [Scorer(m) for m in models], np.zeros((2, bins), np.int64), np.zeros((2, bins))
        for b in batches:
            for text, toxic, fold in zip(*b.columns, strict=True):
                if not toxic.as_py():
                    f = fold.as_py()
                    scores = scorers[1 - f].scores(text.as_py())
                    at = np.clip(np.floor((scores + SPREAD) / NARROW).astype(np.int64), 0, bins - 1)
                    out[f] += np.bincount(at, minlength=bins)
                    total[f] += np.bincount(at, scores, minlength=bins)
        fold, at = np.nonzero(out)
        yield pa.RecordBatch.from_arrays([pa.array(fold), pa.array(at), pa.array(out[fold, at]), pa.array(total[fold, at])], ["fold", "bin", "n", "total"])

    return run


def _half(models: list[Model]):
    """kind, bin: the evidence of texts (kind 0: clean, 1: toxic) and that of the best segments of clean ones (2), before K."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorers = [Scorer(m) for m in models]
        for b in batches:
            kind, out = [], []
            for text, toxic, fold in zip(*b.columns, strict=True):
                s = scorers[1 - fold.as_py()]
                whole, best = s.raw(*s.segments(text.as_py()))
                kind.append(toxic.as_py())
                out.append(whole)
                if not kind[-1]:
                    kind.append(2)
                    out.append(best)
            yield pa.RecordBatch.from_arrays([pa.array(kind, pa.int32()), pa.array(np.floor((np.array(out) - LOW) / BIN).astype(np.int64))], ["kind", "bin"])

    return run


def fit(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS) -> Model | None:
    """The model of docs (doc_id, text) whose labels (doc_id, toxic) may be learnt; None without such rows.

    What reaches the driver is a row for each hash bucket and each bin of evidence: bounded, whatever the corpus.
    """
    train = _training(docs, labels, fit_rows)
    parts = [np.zeros(TOKENS if p & 2 == 0 else PREFIXES) for p in range(8)]
    for r in map_texts(train, _count, "part long, bucket long, n double").groupBy("part", "bucket").agg(F.sum("n").alias("n")).toLocalIterator():
        parts[r.part][r.bucket] = r.n
    tokens, prefixes = np.array([[parts[0], parts[1]], [parts[4], parts[5]]]), np.array([[parts[2], parts[3]], [parts[6], parts[7]]])
    if not tokens.sum():
        return None
    model = Model.of(tokens.sum(axis=0), prefixes.sum(axis=0))
    halves = [Model.of(tokens[f], prefixes[f]) for f in (0, 1)]
    spread = map_texts(train, _token_scores(halves), "fold long, bin long, n long, total double").groupBy("fold", "bin").agg(F.sum("n").alias("n"), F.sum("total").alias("total")).collect()
    fold, count, middle = np.array([r.fold for r in spread]), np.array([float(r.n) for r in spread]), np.array([r.total / r.n for r in spread])
    for f in (0, 1):
        halves[f].lam = solve_lambda(middle[fold != f], count[fold != f])
    model.lam = solve_lambda(middle, count)
    bins = map_texts(train, _half(halves), "kind int, bin long").groupBy("kind", "bin").count().collect()
    kind = np.array([r.kind for r in bins])
    x, n = np.array([LOW + BIN * (r.bin + 0.5) for r in bins]), np.array([float(r["count"]) for r in bins])
    if (kind == 2).any():
        model.log_k = gumbel_log_k(x[kind == 2], n[kind == 2], LOW + BIN)
        model.least = tail_value(x[kind == 2], n[kind == 2], SIGNIFICANT, model.log_k)
    x, y, n = x[kind < 2] - model.log_k, (kind[kind < 2] == 1).astype(float), n[kind < 2]
    c = float(np.average(x, weights=n))
    a, b = math.log((n @ y + 0.5) / (n @ (1 - y) + 0.5)), 0.1
    for _ in range(50):  # Newton steps of a logistic fit with a slight ridge on the slope
        p = 1 / (1 + np.exp(-np.clip(a + b * (x - c), -30, 30)))
        g = np.array([n @ (y - p), n @ ((y - p) * (x - c)) - b])
        w = n * p * (1 - p)
        h = np.array([[w.sum() + 1e-6, w @ (x - c)], [w @ (x - c), w @ (x - c) ** 2 + 1.0]])
        step = np.linalg.solve(h, g)
        step *= min(1.0, 2.0 / max(1e-9, float(np.abs(step).max())))
        a, b = a + step[0], b + step[1]
        if np.abs(step).max() < 1e-7:
            break
    model.slope, model.intercept = float(b), float(a - b * c)
    return model


SCORED = "doc_id long, score double, n_passages int, passages array<struct<start: int, end: int, score: double>>"
PASSAGES = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64())]))


def score(docs: DataFrame, model: Model | None) -> DataFrame:
    """doc_id, score (0 to 1), and the significant passages (word numbers from start to end) of each row of docs.

    Whole texts are scored from nothing but their words. A null or empty text has no segment and so the lowest score;
    without a model every score is 0. Repeated rows stay, other columns are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s = Scorer(model) if model else None
        for b in batches:
            scores, passages = [], []
            for t in b.column(1):
                found, n = s.segments(t.as_py() or "") if s else ([], 0)
                scores.append(model.probability(s.evidence(found, n)) if s else 0.0)
                least = (model.least + math.log(n)) / model.lam if found else 0.0
                passages.append([{"start": a, "end": e, "score": x} for a, e, x in found if x >= least])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(scores, pa.float64()), pa.array([len(p) for p in passages], pa.int32()), pa.array(passages, PASSAGES)], ["doc_id", "score", "n_passages", "passages"])

    return map_texts(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")), run, SCORED)


def without_toxic(docs: DataFrame, model: Model | None, threshold: float = THRESHOLD) -> DataFrame:
    """docs without the rows that score the threshold or more; all columns are kept and no row is shuffled.

    A null text scores like an empty one. Without a model every row is kept.
    """
    if model is None:
        return docs
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s = Scorer(model)
        for b in batches:
            yield b.filter(pa.array([model.probability(s.evidence(*s.segments(t.as_py() or ""))) < threshold for t in b.column(at)], pa.bool_()))

    return map_texts(docs, run, docs.schema)


def op9_toxic_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A toxicity score for every document."""
    docs = table(spark, sf_dir, "documents")
    scored = score(docs, fit(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"), "n_passages")
