"""Merging one bounded summary per task in a tree of tasks, in a fixed order."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import partial

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.session import Scratch

FAN_IN = 8  # summaries that a task joins to one


def summary(blob: bytes) -> pa.RecordBatch:
    """A task's one row for merged(): the number of its partition and its summary."""
    from pyspark import TaskContext

    return pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int64()), pa.array([blob], pa.binary())], ["part", "blob"])


SUMMARY = "part long, blob binary"


def _fold(batches: Iterator[pa.RecordBatch], join: Callable[[bytes, bytes], bytes]) -> Iterator[pa.RecordBatch]:
    """One row for each group of rows, which come sorted by (group, part); its group is its new part."""
    group, held = None, b""
    for batch in batches:
        for at, blob in zip(batch.column("group").to_pylist(), batch.column("blob"), strict=True):
            if at == group:
                held = join(held, blob.as_py())
            else:
                if group is not None:
                    yield pa.RecordBatch.from_arrays([pa.array([group], pa.int64()), pa.array([held], pa.binary())], ["part", "blob"])
                group, held = at, blob.as_py()
    if group is not None:
        yield pa.RecordBatch.from_arrays([pa.array([group], pa.int64()), pa.array([held], pa.binary())], ["part", "blob"])


def merged(blobs: DataFrame, join: Callable[[bytes, bytes], bytes], scratch: Scratch, name: str) -> bytes | None:
    """All rows (part, blob) joined to one; None without rows.

    Each level joins FAN_IN neighbours in the order of their parts, so a task
    reads that many summaries however many there are, holds two at a time, and
    sums come out alike in each run over the same partitions.
    """
    rows = scratch.write(blobs, name)
    last = rows.agg(F.max("part")).first()[0]
    while last:
        last //= FAN_IN
        rows = rows.select(F.floor(F.col("part") / FAN_IN).alias("group"), "part", "blob").repartition(last + 1, "group").sortWithinPartitions("group", "part")
        rows = rows.mapInArrow(partial(_fold, join=join), SUMMARY)
    row = rows.first()
    return row and bytes(row.blob)
