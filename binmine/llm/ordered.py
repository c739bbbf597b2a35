"""Ranks and running sums in one global order, without one task that sees all rows or all rows of a group.

Rows are dealt by ranges of the whole sort key, so a group of any size lies in many partitions, side by side. Each
partition numbers its own rows; what it passes on (its groups, how far its last group has come) is one row a partition,
from which the driver works out where each partition goes on. That is all the driver sees.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import map_texts, written


def _local(group: int | None, sums: list[int]):
    """Adds row, rank, at and the running sums, all counted from the partition's start."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, rank, at, last, totals = 0, 0, 0, None, [0] * len(sums)
        for b in batches:
            n = b.num_rows
            if not n:
                continue
            new = np.zeros(n, bool)
            new[0] = seen == 0
            if group is not None:
                key = b.column(group).to_numpy(zero_copy_only=False)
                new[1:] = key[1:] != key[:-1]
                new[0] |= key[0] != last
                last = key[-1]
            place = np.arange(n)
            start = np.maximum.accumulate(np.where(new, place, -1))
            inside = start >= 0
            ranks = rank + np.cumsum(new)
            ats = np.where(inside, place - start + 1, at + place + 1)
            out = [pa.array(seen + place), pa.array(ranks), pa.array(ats)]
            for k, c in enumerate(sums):
                x = b.column(c).to_numpy(zero_copy_only=False)
                total = np.cumsum(x)
                went = np.where(inside, total - (total - x)[start], totals[k] + total)
                totals[k] = int(went[-1])
                out.append(pa.array(went))
            seen, rank, at = seen + n, int(ranks[-1]), int(ats[-1])
            yield pa.RecordBatch.from_arrays([*b.columns, *out], names=[*b.schema.names, *(f"_{i}" for i in range(len(out)))])

    return run


def running(df: DataFrame, group: str | None, order: list[str], keep: list[str], sums: tuple[str, ...] = (), tag: str = "running") -> tuple[DataFrame, str]:
    """df's columns keep with rank, at and run_x, and the path of the table that they were written to.

    Rows stand in the order of (group, *order), ascending, nulls first. rank numbers the distinct values of group from 1,
    at the rows of a group from 1, run_x is the sum of x (a long, not negative, not null) in the group up to and with
    the row. Without a group all rows are one. group must not be null. Rows equal in all of these may change places.
    """
    by = [*([group] if group else []), *order]
    cols = list(dict.fromkeys([*([group] if group else []), *keep, *sums]))
    placed = df.repartitionByRange(*by).sortWithinPartitions(*by).select(F.spark_partition_id().alias("_part"), *cols)
    added = ["_row", "rank", "at", *(f"run_{x}" for x in sums)]
    schema = T.StructType([*placed.schema.fields, *(T.StructField(c, T.LongType()) for c in added)])
    local, path = written(map_texts(placed, _local(1 if group else None, [1 + cols.index(x) for x in sums]), schema), tag)
    key = F.col(group) if group else F.lit(0)
    state = F.struct("at", *(f"run_{x}" for x in sums))
    head = F.when(F.col("rank") == 1, F.col("_row"))
    parts = (
        local.groupBy("_part")
        .agg(F.min_by(key, "_row").alias("first"), F.max_by(key, "_row").alias("last"), F.max("rank").alias("groups"), F.max_by(state, "_row").alias("end"), F.max_by(state, head).alias("head_end"))
        .orderBy("_part")
        .collect()
    )
    offsets, groups, open_key, open_state = [], 0, None, [0] * (1 + len(sums))
    for p in parts:
        on = bool(groups) and p["first"] == open_key
        carry = open_state if on else [0] * (1 + len(sums))
        offsets.append((p["_part"], groups - on, *carry))
        open_state = [x + (y if p["groups"] == 1 else 0) for x, y in zip(p["end"], carry, strict=True)]
        groups, open_key = groups + p["groups"] - on, p["last"]
    names = ["_ranks", "_at", *(f"_carry_{x}" for x in sums)]
    table = local.sparkSession.createDataFrame(offsets, "_part int, " + ", ".join(f"{c} long" for c in names))
    carried = lambda c, by: (F.col(c) + F.when(F.col("rank") == 1, F.col(by)).otherwise(0)).alias(c)
    out = local.join(F.broadcast(table), "_part").select(
        *cols, (F.col("rank") + F.col("_ranks")).alias("rank"), carried("at", "_at"), *(carried(f"run_{x}", f"_carry_{x}") for x in sums)
    )
    return out, path
