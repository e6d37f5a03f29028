"""Best-fit packing of documents into sequences, certified by lower bounds.

Pieces are dealt evenly over partitions; each packs its own by best-fit decreasing and compares its
number of bins with a lower bound from dual feasible functions. Where both are equal the packing is
certified and only its loosest bin may still be improved together with others; where there is a gap,
all bins that are not full give up their pieces. What was given up is dealt anew over fewer
partitions and packed again, until one partition is left. The work of a round is a fraction of the
round before, and no partition holds more than ``rows`` pieces until the last, which is as small.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from . import ragged
from .bpe import encoder, runs
from .scratch import Scratch

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
PACKED = PIECES + ", sequence_id long, offset long"
ROUNDS = 12


def best_fit_decreasing(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, list[int]]:
    """The bin and the place in it of each piece, and the room left in each bin.

    Bins are kept by their room; a bit per room finds the least one that suffices.
    """
    bins, places, room = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64), []
    by_room: list[list[int]] = [[] for _ in range(capacity + 1)]
    has = 0
    order = np.argsort(-lengths, kind="stable")
    for i, n in zip(order.tolist(), lengths[order].tolist()):
        fits = has >> n
        if fits:
            left = n + (fits & -fits).bit_length() - 1
            b = by_room[left].pop()
            if not by_room[left]:
                has ^= 1 << left
        else:
            left, b = capacity, len(room)
            room.append(capacity)
        bins[i], places[i] = b, capacity - left
        left -= n
        room[b] = left
        if left:
            by_room[left].append(b)
            has |= 1 << left
    return bins, places, room


def lower_bound(lengths: np.ndarray, capacity: int) -> int:
    """The best bound of three families of dual feasible functions, over the histogram of lengths."""
    if not len(lengths):
        return 0
    count = np.bincount(lengths, minlength=capacity + 1).astype(np.float64)
    x = np.arange(capacity + 1)
    best = int(-(-int((count * x).sum()) // capacity))
    for k in range(1, 21):  # round down to k-ths, keep exact multiples
        whole = (k + 1) * x % capacity == 0
        value = np.where(whole, x / capacity, (k + 1) * x // capacity / k)
        best = max(best, int(np.ceil((count * value).sum() - 1e-9)))
    half = capacity // 2
    above, weight = np.cumsum(count[::-1])[::-1], np.append(0, np.cumsum(count * x))
    eps = np.arange(1, half + 1)  # pieces above 1 - eps need a bin each, those below eps count nothing
    large = above[np.minimum(capacity - eps + 1, capacity)]
    middle = (weight[capacity - eps + 1] - weight[eps]) / capacity
    best = max(best, int(np.ceil((large + middle).max() - 1e-9)))
    for e in np.unique(np.linspace(1, half, 64).astype(int)):  # large pieces by what fits beside them
        slots = capacity // e
        value = np.where(2 * x > capacity, slots - (capacity - x) // e, np.where(2 * x == capacity, slots / 2, x // e)) / slots
        best = max(best, int(np.ceil((count * value).sum() - 1e-9)))
    return best


def pieces_of(docs: DataFrame, vocabulary: str, capacity: int, end_id: int) -> DataFrame:
    """The pieces of each document: its ids and one ``end_id``, cut only where longer than capacity."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = encoder(vocabulary)
        for batch in batches:
            column = pc.fill_null(batch.column("text"), "")
            names = batch.column("doc_id").to_pylist()
            for a, b in runs(pc.binary_length(column).to_pylist()):
                ids, count = code.encode(column.slice(a, b - a).to_pylist())
                stop = np.cumsum(count)
                ids = np.insert(ids, stop, end_id).astype("<u4")
                rows, at = [], 0
                for name, n in zip(names[a:b], (count + 1).tolist()):
                    for p, s in enumerate(range(0, n, capacity)):
                        part = ids[at + s : at + min(n, s + capacity)]
                        rows.append((name, p, s, len(part), zlib.crc32(part)))
                    at += n
                kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(ragged.tidy(run), PIECES)


def pack(docs: DataFrame, vocabulary: str, capacity: int = 2048, end_id: int = 0, rows: int = 50_000) -> DataFrame:
    """One row per piece of ``docs(doc_id, text)``: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    * Null or empty text: one piece, the end id alone. A null doc_id is kept; repeated rows are
      packed each. Longer texts are cut into pieces of ``capacity``, the last one shorter.
    * Ties in length keep any order; sequence numbers are unique, not dense.
    * Extra columns are ignored; an empty table gives an empty result.
    """
    scratch = Scratch(docs.sparkSession, "packing")
    pool = scratch.save(pieces_of(docs, vocabulary, capacity, end_id))
    settled: DataFrame | None = None
    for turn in range(ROUNDS):
        n = pool.count()
        parts = max(1, -(-n // rows))
        last = parts == 1 or turn == ROUNDS - 1

        def run(batches: Iterator[pa.RecordBatch], turn: int = turn, last: bool = last) -> Iterator[pa.RecordBatch]:
            held = list(batches)
            if not held:
                return
            table = pa.Table.from_batches(held).combine_chunks()
            lengths = table.column("length").to_numpy()
            bins, places, room = best_fit_decreasing(lengths, capacity)
            left = np.array(room)
            if last:
                given = np.zeros(len(left), bool)
            elif len(left) > lower_bound(lengths, capacity):
                given = left > 0
            else:
                given = np.arange(len(left)) == left.argmax() if left.any() else np.zeros(len(left), bool)
            name = (turn * (1 << 22) + TaskContext.get().partitionId()) * (1 << 32) + bins
            number = pa.array(name, pa.int64(), mask=given[bins])
            for out in table.append_column("sequence_id", number).append_column("offset", pa.array(places, pa.int64())).to_batches(65536):
                yield out

        done = scratch.save(pool.repartition(parts).mapInArrow(ragged.tidy(run), PACKED))
        kept = done.filter("sequence_id is not null")
        settled = kept if settled is None else settled.unionByName(kept)
        if last:
            break
        pool = done.filter("sequence_id is null").drop("sequence_id", "offset")
    return settled
