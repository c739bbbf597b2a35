"""What the operators share: reading tables, the shared scratch folder, written tables."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir.

    Only where a session on one machine has none (tests), a temporary folder is set; on a cluster that is an error.
    """
    conf = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.sparkContext.getCheckpointDir()
    if conf:
        return conf.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    own = getattr(shared_dir, "own", None)
    if own is None:
        own = shared_dir.own = tempfile.mkdtemp(prefix="binmine-shared-")
        spark.sparkContext.setCheckpointDir(own)
    return own


def scratch(spark: SparkSession, tag: str) -> str:
    """A fresh path below the shared folder."""
    return f"{shared_dir(spark)}/binmine-{tag}-{uuid.uuid4().hex}"


def written(df: DataFrame, tag: str) -> tuple[DataFrame, str]:
    """The frame as a table written to the shared folder and read again, and its path: lineage ends here."""
    spark = df.sparkSession
    path = scratch(spark, tag)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def discard(spark: SparkSession, *paths: str) -> None:
    """Delete written tables that no later plan reads."""
    for path in paths:
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def ascii_lower(c: Column) -> Column:
    """A-Z lower-cased, every other character kept."""
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


#: Bytes and rows of a batch of texts on its way to Python, so that very long texts do not pile up. A session's own setting stays.
BATCHES = {"spark.sql.execution.arrow.maxBytesPerBatch": str(4 << 20), "spark.sql.execution.arrow.maxRecordsPerBatch": "1000"}


def bounded_batches(df: DataFrame) -> DataFrame:
    """df, in whose session batches to Python are from now on bounded, unless the session has set them itself."""
    conf = df.sparkSession.conf
    for key, value in BATCHES.items():
        if conf.get(key, None) is None:
            conf.set(key, value)
    return df


def _settle() -> None:
    """Give memory that a finished task has freed, or left in cycles, back to the system."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def map_texts(df: DataFrame, run: Callable, schema) -> DataFrame:
    """df.mapInArrow with bounded batches, after each task of which freed memory goes back."""

    def tidy(batches):
        try:
            yield from run(batches)
        finally:
            _settle()

    return bounded_batches(df).mapInArrow(tidy, schema)


class Remembered:
    """What a worker knows of distinct strings, in two generations: values of strings that keep coming up stay.

    make(strings) gives the values (bytes) of new strings, all of a batch at once. When the young generation exceeds
    limit it becomes the old one, from which strings move back as they come up, so memory is bounded by two
    generations and the share of strings that are made anew does not grow with the corpus.
    """

    def __init__(self, make: Callable[[list[str]], Iterable[bytes]], limit: int) -> None:
        self.make, self.limit = make, limit
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def learn(self, strings: set[str]) -> dict[str, bytes]:
        """A mapping that holds all of these strings, until the next call."""
        if len(self.young) > self.limit:
            self.old, self.young = self.young, {}
        young, old = self.young, self.old
        new = strings.difference(young)
        if new:
            back = new.intersection(old)
            young.update(zip(back, map(old.__getitem__, back), strict=True))
            fresh = list(new.difference(back)) if back else list(new)
            young.update(zip(fresh, self.make(fresh), strict=True))
        return young


def gathered(batches: Iterable[pa.RecordBatch], size: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Batches joined until they have about that many bytes: distinct words then repeat more often in each."""
    held, n = [], 0
    for b in batches:
        held.append(b)
        n += b.nbytes
        if n >= size:
            yield pa.concat_batches(held)
            held, n = [], 0
    if held:
        yield pa.concat_batches(held)


def strings(texts: list[str | None]) -> pa.Array:
    return pa.array([t or "" for t in texts], pa.string())


def numbered(texts: pa.Array, values: Callable[[list[str]], list[bytes]]) -> tuple[np.ndarray, np.ndarray]:
    """The numbers (32 bits) of all texts one after the other, and how many each text has; a null text has none.

    Texts are lower-cased (each character by itself) and split at white space; values gives the numbers, as
    little-endian bytes, of a batch's distinct runs. Only these are handled one by one.
    """
    runs = pc.utf8_split_whitespace(pc.utf8_lower(pc.fill_null(texts, "")))
    coded = runs.flatten().dictionary_encode()
    found = values(coded.dictionary.to_numpy(zero_copy_only=False).tolist())
    size = np.fromiter(map(len, found), np.int64, len(found)) >> 2
    flat = np.frombuffer(b"".join(found), "<u4")
    at = coded.indices.to_numpy(zero_copy_only=False)
    n = size[at]
    total = np.zeros(len(n) + 1, np.int64)
    np.cumsum(n, out=total[1:])
    kind = np.int32 if total[-1] < 1 << 31 else np.int64
    place = np.arange(total[-1], dtype=kind)
    place += np.repeat(((np.cumsum(size) - size)[at] - total[:-1]).astype(kind), n)
    return flat[place], np.diff(total[runs.offsets.to_numpy() - runs.offsets[0].as_py()])
