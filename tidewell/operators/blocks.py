"""Tracks as blocks of samples, so that a long track is the work of many tasks.

A block is ``(track, seq, n, <one array per channel>)`` and holds the samples ``seq * size`` and on; only a
track's last block is shorter. What needs samples beyond a block's ends gets them by :func:`overlapped`.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F


def finite(c: Column) -> Column:
    """The value; 0 where it is null, NaN or infinite, as one of these would spoil all that follows it."""
    return F.when(c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")), 0.0).otherwise(c)


def blocks(s: DataFrame, size: int, channels: Sequence[str] = ("x",)) -> DataFrame:
    """Blocks of ``s(track, idx, channels...)``; ``idx`` counts from 0 in each track.

    A value that is not finite becomes 0. A gap or a repeated ``idx`` is an error.
    """
    seq = F.floor(F.col("idx") / size).alias("seq")
    rows = s.select("track", "idx", seq, *(finite(F.col(c).cast("double")).alias(c) for c in channels))
    whole = F.array_sort(F.collect_list(F.struct("idx", *channels)))
    held = rows.groupBy("track", "seq").agg(whole.alias("rows"), F.count("*").alias("n"), F.count_distinct("idx").alias("distinct"), F.max("idx").alias("top"))
    full = (F.col("n") == F.col("distinct")) & (F.col("top") - F.col("seq") * size + 1 == F.col("n"))
    held = held.withColumn("rows", F.when(full, F.col("rows")).otherwise(F.raise_error(F.lit("idx has gaps or repeats"))))
    return held.select("track", "seq", F.col("n").cast("int").alias("n"), *(F.col("rows").getField(c).alias(c) for c in channels))


def overlapped(b: DataFrame, before: int, after: int, channels: Sequence[str] = ("x",)) -> DataFrame:
    """Each block with up to ``before`` samples in front of it and up to ``after`` behind it, and ``lead``: how many in front.

    The neighbours' ends are sent to the block, so one shuffle on (track, seq) spreads a track over all tasks.
    Both must be at most the block size.
    """
    cut = lambda take: [take(F.col(c)).alias(c) for c in channels]
    own = b.select("track", "seq", F.lit(1).alias("part"), "n", *cut(lambda c: c))
    parts = [own]
    if before:
        tail = lambda c: F.slice(c, F.greatest(F.size(c) - before + 1, F.lit(1)), before)
        parts.append(b.select("track", (F.col("seq") + 1).alias("seq"), F.lit(0).alias("part"), F.least("n", F.lit(before)).alias("n"), *cut(tail)))
    if after:
        parts.append(b.select("track", (F.col("seq") - 1).alias("seq"), F.lit(2).alias("part"), F.least("n", F.lit(after)).alias("n"), *cut(lambda c: F.slice(c, 1, after))))
    all_ = parts[0]
    for p in parts[1:]:
        all_ = all_.unionByName(p)
    held = all_.groupBy("track", "seq").agg(F.array_sort(F.collect_list(F.struct("part", "n", *channels))).alias("parts"))
    held = held.filter(F.exists("parts", lambda p: p["part"] == 1))  # not the places beyond a track's ends
    joined = [F.flatten(F.col("parts").getField(c)).alias(c) for c in channels]
    count = lambda which: F.aggregate(F.filter("parts", lambda p: p["part"] == which), F.lit(0), lambda a, p: a + p["n"])
    return held.select("track", "seq", count(1).alias("n"), count(0).alias("lead"), *joined)


def matrix(column: pa.Array) -> np.ndarray:
    """Arrays of one length as rows of a matrix."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return np.asarray(column.flatten(), np.float64).reshape(len(column), -1)


def by_length(batch: pa.RecordBatch, column: str = "n") -> list[np.ndarray]:
    """Rows of a batch, those of equal length together."""
    n = np.asarray(batch.column(column))
    return [np.flatnonzero(n == k) for k in np.unique(n)]


def lists(x: np.ndarray) -> pa.Array:
    """The inverse of :func:`matrix`."""
    return pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * x.shape[1], pa.int32()), pa.array(np.ascontiguousarray(x, np.float64).ravel()))
