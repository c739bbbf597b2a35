"""Scores of documents against a plain version, and how often clean texts hold a significant passage."""

import math
import re
import zlib

from pyspark.sql import functions as F

from binmine.llm import toxicity


def plain_segments(scores):
    """The best stretch, then the best ones to its left and right: all maximal-scoring segments."""
    best = None
    for a in range(len(scores)):
        total = 0.0
        for b in range(a, len(scores)):
            total += scores[b]
            if total > 0 and (best is None or total > best[0] + 1e-12):
                best = total, a, b + 1
    if best is None:
        return []
    _, a, b = best
    return [*plain_segments(scores[:a]), best[0], *plain_segments(scores[b:])]


def plain_score(text, m):
    scores = []
    for w in re.findall(r"\w+", text.lower()):
        t, q = zlib.crc32(w.encode()) % toxicity.TOKENS, zlib.crc32(w[:4].encode()) % toxicity.PREFIXES
        rho = float(m.prefix_share[q])
        scores.append(math.log((float(m.tokens[1, t]) + 5 * rho) / (float(m.tokens[0, t]) + 5 * (1 - rho))) - math.log(m.share / (1 - m.share)) - 1.5)
    found = plain_segments(scores)
    x = math.log(sum(math.exp(m.lam * s) for s in found)) - math.log(len(scores)) if found else -20.0
    return 1 / (1 + math.exp(-(m.intercept + m.slope * (min(60.0, max(-20.0, x)) - m.log_k))))


def test_scores_of_whole_documents(spark):
    d = "/root/testdata/sf0.001"
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    model = toxicity.fit(docs, labels)
    short = docs.where(F.length("text") < 1500)
    got = {r.doc_id: r.score for r in toxicity.score(short, model).collect()}
    rows = short.collect()
    assert len(rows) > 50 and all(abs(got[r.doc_id] - plain_score(r.text, model)) < 1e-9 for r in rows)


def test_significance_holds_on_real_texts(spark):
    """On the larger table few clean texts that taught nothing hold a passage that is called significant at 0.01."""
    d = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    found = toxicity.score(docs, toxicity.fit(docs, labels)).join(labels, "doc_id").where(toxicity.held_out(F.col("doc_id")))
    n = {r.toxic: r for r in found.groupBy("toxic").agg(F.count("*").alias("n"), F.avg((F.col("n_passages") > 0).cast("double")).alias("share"), F.avg((F.col("score") >= 0.3).cast("double")).alias("caught")).collect()}
    assert n[0].n > 800 and n[0].share < 0.03
    assert n[1].share > 0.6 and n[1].caught > 0.9 and n[0].caught < 0.03
