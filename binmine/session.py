"""Session helpers."""

from __future__ import annotations

import tempfile
import uuid
from pathlib import Path

from pyspark.sql import SparkSession

ROOT = str(Path(__file__).resolve().parent.parent)


def ship(spark: SparkSession) -> SparkSession:
    """Let Python workers import this package from where the driver has it, whatever the working directory."""
    env = spark.sparkContext.environment
    paths = [p for p in env.get("PYTHONPATH", "").split(":") if p]
    if ROOT not in paths:
        env["PYTHONPATH"] = ":".join([ROOT, *paths])
    return spark


def scratch(spark: SparkSession, tag: str) -> str:
    """A fresh path below spark.checkpoint.dir.

    Where a session on one machine has no such folder a temporary one is set; on a cluster that is an error, as executors
    do not share local folders.
    """
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.sparkContext.getCheckpointDir() or getattr(scratch, "own", None)
    if base is None:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = scratch.own = tempfile.mkdtemp(prefix="binmine-")
    return f"{base.rstrip('/')}/binmine-{tag}-{uuid.uuid4().hex}"


def checkpointed(df, *by: str):
    """df as a table written below spark.checkpoint.dir and read again: lineage and size estimates end here.

    by names columns to lay the table out by. discard() removes it.
    """
    path = scratch(df.sparkSession, "table")
    df.write.partitionBy(*by).parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.written_at = path
    return out


def discard(*tables) -> None:
    """Remove tables of checkpointed() that no later plan reads."""
    for t in tables:
        jvm, spark = t.sparkSession._jvm, t.sparkSession
        path = jvm.org.apache.hadoop.fs.Path(t.written_at)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
