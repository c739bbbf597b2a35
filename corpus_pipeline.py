"""Corpus pipeline: toxicity, near-duplicates, benchmark decontamination, secrets, packing.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor kept; docs has the columns of documents, and may
have others, which are kept. The last stage returns packed pieces. No stage fails on a null in any column, on empty or
very long texts, on repeated rows or on an empty table, whose result is empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from binmine.llm import decontaminate, packing, secrets, simhash, toxicity
from binmine.llm.common import discard, table, written


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity is below the threshold.

    A null text scores like an empty one; equal texts score alike, so repeated rows stay or go together. A null id teaches
    nothing and is scored. Without labels to learn from all rows stay.
    """
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    return toxicity.without_toxic(docs, model)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the smallest id, of each component of texts with a Jaccard similarity of five-word shingles of 0.8 or more.

    Texts without words (null, empty, white space) are equal, so one of them stays; of repeated rows of one id one stays.
    Rows with a null id cannot be named by a component and stay all.
    """
    return simhash.without_near_copies(docs)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item; null and empty texts hold none, and equal texts stay or go together.

    Null and empty items are in no document, repeated items count once; without items all rows stay.
    """
    return decontaminate.without_leaks(docs, table(spark, sf_dir, "benchmark"))


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, secrets in their texts replaced by a mark; n_chars follows the text. A null text stays null, as does its n_chars."""
    return secrets.redact(docs).withColumn("n_chars", F.length("text").cast("long"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents, each a sequence of its own whose length is a power of two.

    A null or empty text is one piece of the end id alone; repeated rows are packed each; a null id stays null.
    """
    import public_tokenizers

    return packing.packed(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_leaks),
    ("secrets", redact_secrets),
    ("packing", pack),
]

#: Fitted models, hashes and a tokenizer are beyond SQL; tests hold the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each but the last is written to the shared folder, read by the next and then removed."""
    docs, last = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        docs, path = written(stage(spark, docs, sf_dir), f"stage-{name}")
        if last:
            discard(spark, last)
        last = path
    out = STAGES[-1][1](spark, docs, sf_dir)  # its pieces are written: docs is not read again
    discard(spark, last)
    return out
