"""Packing by power-of-two decomposition.

A document of n tokens is cut into pieces whose lengths are powers of two: as many pieces of the longest length as fit,
then the binary digits of the rest, from long to short. Each piece is a training sequence of its own, so no sequence
crosses documents and none is padded. Pieces are written into a bucket, a folder, for each length, so a batch of a fixed
token count reads rows of one folder. Cutting needs no shuffle.

Tokenizing is done by words: pretokens are found as the tokenizer finds them, and each distinct one is encoded by the
tokenizer's own model once and remembered. That holds for the normalizer and pretokenizer that are named below; a tokenizer
file with others, and texts with characters on which the two ways could differ, go to the tokenizer whole.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Remembered, gathered, map_texts, numbered, scratch, table

MAX_LENGTH, END_ID = 4096, 2
#: Distinct words in one generation of a worker's memory.
WORDS_KEPT = 120_000
#: Bytes of ids in one batch from Python.
BATCH = 8 << 20
PIECES = "doc_id long, start long, length long, ids binary, doc_tokens long"


#: What of a tokenizer file the way by words rests on; fixed values of that format. The pattern is the second's.
NORMALIZER = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]}
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
PRETOKENIZER = {
    "type": "Sequence",
    "pretokenizers": [
        {"type": "Split", "pattern": {"Regex": PATTERN}, "behavior": "Removed", "invert": True},
        {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
    ],
}
#: Not printable ASCII, tab, line end or one of the Latin letters below U+0250 (but for those whose lower case is two
#: characters), which all are one character each in composed form, with the same classes and lower case everywhere.
UNSAFE = r"[^\t\n\r\x20-\x7e\x{a1}-\x{12f}\x{131}-\x{24f}]"
PUNCTUATION = "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"


def _byte_letters() -> dict[int, str]:
    """The letter that byte-level models have for each byte: itself if it is printable Latin-1, else one from U+0100 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = (b for b in range(256) if b not in own)
    return {b: chr(b) for b in own} | {b: chr(256 + i) for i, b in enumerate(others)}


class Words:
    """encode(texts): the ids that the tokenizer in a file gives each text."""

    def __init__(self, path: str) -> None:
        import regex
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec.get("model", {})
        self.tokenizer = Tokenizer.from_file(path)
        self.by_words = spec.get("normalizer") == NORMALIZER and spec.get("pre_tokenizer") == PRETOKENIZER and model.get("type") == "BPE" and not model.get("dropout")
        added = [t["content"] for t in spec.get("added_tokens", [])]
        self.added = added
        self.words = regex.compile(PATTERN).findall
        self.letters = _byte_letters()
        self.id_bytes = [i.to_bytes(4, "little") for i in range(self.tokenizer.get_vocab_size(with_added_tokens=True))] if self.by_words else []
        self.known = Remembered(self._encode_words, WORDS_KEPT)

    @classmethod
    def shared(cls, path: str) -> Words:
        """One for each worker process, whose memory of words lasts from task to task."""
        kept = cls.__dict__.get("_shared") or {}
        if path not in kept:
            kept[path] = cls(path)
            cls._shared = kept
        return kept[path]

    def whole(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4")

    def _encode_words(self, words: list[str]) -> list[bytes]:
        tokens, of, letters = self.tokenizer.model.tokenize, self.id_bytes, self.letters
        return [b"".join([of[t.id] for t in tokens(w if w.isascii() else w.encode().decode("latin-1").translate(letters))]) for w in words]

    def _values(self, runs: list[str]) -> list[bytes]:
        """Ids of runs without white space; letters alone, and letters before punctuation, need no regex to be cut."""
        odd = [r for r in runs if not r.isalpha()]
        cores = [r.rstrip(PUNCTUATION) for r in odd]
        cut = {r: (c, r[len(c) :]) if c.isalpha() else self.words(r) for r, c in zip(odd, cores, strict=True)}
        known = self.known.learn(set(runs).difference(cut).union(*cut.values()))
        return [b"".join([known[w] for w in cut[r]]) if r in cut else known[r] for r in runs]

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts one after the other, and how many each text has; a null text has none."""
        texts = pc.fill_null(texts, "")
        odd = pc.match_substring_regex(texts, UNSAFE) if self.by_words else pa.array(np.ones(len(texts), bool))
        for a in self.added:
            odd = pc.or_(odd, pc.match_substring(texts, a))
        odd = odd.to_numpy(zero_copy_only=False)
        if not odd.any():
            return numbered(texts, self._values)
        ids, n = numbered(texts.filter(pa.array(~odd)), self._values)
        parts, at = np.split(ids, np.cumsum(n)[:-1]) if len(n) else [], 0
        out = []
        for i, o in enumerate(odd.tolist()):
            out.append(self.whole(texts[i].as_py()) if o else parts[at])
            at += not o
        return np.concatenate(out), np.array([len(x) for x in out], np.int64)


def pack(docs: DataFrame, tokenizer: str, longest: int = MAX_LENGTH, end_id: int = END_ID, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Pieces of all rows of docs: doc_id, start, length, ids (little-endian unsigned 32-bit), doc_tokens, sequence_id.

    longest is a power of two. A document's ids are the tokenizer's and end_id; a null or empty text has end_id alone,
    so each row has at least one piece. Each piece is one sequence, and sequence_id names it uniquely; the number
    follows the place of the row in its input split, so a task that runs again gives the same, but the same rows in other
    files are numbered otherwise. Repeated rows are packed each, an empty table has no pieces. Other columns of docs are not read.
    """
    if longest < 1 or longest & (longest - 1):
        raise ValueError("longest must be a power of two")
    sizes = 1 << np.arange(longest.bit_length() - 1, -1, -1, dtype=np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        words = Words.shared(tokenizer)
        for b in gathered(batches):
            ids, n = words.encode(b.column(1))
            data = np.insert(ids, np.cumsum(n), end_id)
            n += 1
            digits = n[:, None] // sizes  # how many pieces of each size: all that fit of the longest, else a binary digit
            digits[:, 1:] &= 1
            length = np.repeat(np.tile(sizes, len(n)), digits.ravel())
            of = np.repeat(np.arange(len(n)), digits.sum(axis=1))
            place = np.cumsum(length) - length
            start = place - (np.cumsum(n) - n)[of]
            doc = b.column(0).take(pa.array(of))
            cut = np.flatnonzero(np.diff(4 * place // BATCH, prepend=-1))
            for i, j in zip(cut.tolist(), [*cut[1:].tolist(), len(length)], strict=True):
                offsets = np.append(4 * (place[i:j] - place[i]), 4 * (place[j - 1] + length[j - 1] - place[i])).astype(np.int32)
                part = data[place[i] : place[i] + int(offsets[-1]) // 4]
                binary = pa.Array.from_buffers(pa.binary(), j - i, [None, pa.py_buffer(offsets), pa.py_buffer(part)])
                yield pa.RecordBatch.from_arrays([doc[i:j], pa.array(start[i:j]), pa.array(length[i:j]), binary, pa.array(n[of[i:j]])], ["doc_id", "start", "length", "ids", "doc_tokens"])

    rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    return map_texts(rows, run, PIECES).withColumn("sequence_id", F.monotonically_increasing_id())


def write_buckets(pieces: DataFrame, path: str) -> DataFrame:
    """Write pack()'s pieces below path, a folder bucket=<length> for each length, and read them back (with bucket).

    Pieces of an empty table give a folder without buckets, which reads as no rows.
    """
    out = pieces.withColumn("bucket", F.col("length"))
    out.write.partitionBy("bucket").parquet(path)
    return pieces.sparkSession.read.schema(out.schema).parquet(path)


def digests(pieces: DataFrame) -> DataFrame:
    """What the contract asks for of each piece; a piece starts its sequence, so its offset is 0."""
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", F.lit(0).cast("long").alias("offset"))


def packed(docs: DataFrame, tokenizer: str) -> DataFrame:
    """digests() of docs, packed and written into buckets in the shared folder."""
    return digests(write_buckets(pack(docs, tokenizer), scratch(docs.sparkSession, "buckets")))


def op5_pack_pow2(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, packed without padding."""
    import public_tokenizers

    return packed(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
