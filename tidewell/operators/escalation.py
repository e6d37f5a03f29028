"""A costly transform only where it is asked for: flagged segments with context around them, results spliced back.

Segments are widened and those that then touch become one region, so no sample is worked on twice. Regions meet the
blocks they cover by an equi-join on (track, block); only these blocks' samples are shuffled. What comes back replaces
the flagged samples, not the context, and all other blocks pass through.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F


def regions(flagged: DataFrame, pad: int) -> DataFrame:
    """``(track, low, high, parts)`` of ``flagged(track, start, end)``, ends included: widened by ``pad``, merged where they meet.

    ``parts`` are the region's flagged segments. A segment that ends before it starts is left out.
    """
    order = Window.partitionBy("track").orderBy("low", "high", "start")
    w = flagged.filter("start <= `end`").select("track", "start", "end", F.greatest(F.col("start") - pad, F.lit(0)).alias("low"), (F.col("end") + pad).alias("high"))
    reach = F.max("high").over(order.rowsBetween(Window.unboundedPreceding, -1))
    w = w.withColumn("fresh", F.coalesce((F.col("low") > reach + 1).cast("int"), F.lit(1)))
    w = w.withColumn("region", F.sum("fresh").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    merged = w.groupBy("track", "region").agg(F.min("low").alias("low"), F.max("high").alias("high"), F.array_sort(F.collect_list(F.struct("start", "end"))).alias("parts"))
    return merged.drop("region")


def escalated(b: DataFrame, size: int, flagged: DataFrame, pad: int, work: Callable[[np.ndarray], np.ndarray]) -> DataFrame:
    """Blocks ``b(track, seq, n, x)`` of ``size`` samples with the flagged ones replaced by what ``work`` makes of their region.

    ``work`` gets a region's samples (cut off at the track's ends) and returns as many; a region must fit a task.
    Tracks or places without samples are left out.
    """
    kind = b.schema["track"].dataType.simpleString()
    r = regions(flagged, pad)
    covered = F.explode(F.sequence(F.floor(F.col("low") / size), F.floor(F.col("high") / size)))
    met = r.withColumn("seq", covered).join(b.select("track", "seq", "x"), ["track", "seq"])
    first = F.greatest(F.col("low") - F.col("seq") * size, F.lit(0)).cast("int")
    last = F.least(F.col("high") - F.col("seq") * size, F.size("x") - 1).cast("int")
    pieces = met.filter(first <= last).select("track", "low", "seq", "parts", (F.col("seq") * size + first).alias("at"), F.slice("x", first + 1, last - first + 1).alias("x"))

    def run(t: pa.Table) -> pa.Table:
        t = t.sort_by("at")
        at = t.column("at")[0].as_py()
        x = np.concatenate([np.asarray(v.values, np.float64) for v in t.column("x")])
        y = np.asarray(work(x), np.float64)
        seq, place, out = [], [], []
        for part in t.column("parts")[0].as_py():
            a, end = max(part["start"], at), min(part["end"] + 1, at + len(x))
            while a < end:
                stop = min(end, (a // size + 1) * size)
                seq.append(a // size)
                place.append(a % size)
                out.append(y[a - at : stop - at])
                a = stop
        track = pa.chunked_array([t.column("track").combine_chunks().take(pa.array(np.zeros(len(seq), np.int64)))])
        return pa.table({"track": track, "seq": pa.array(seq, pa.int64()), "place": pa.array(place, pa.int32()), "y": pa.array(out, pa.list_(pa.float64()))})

    done = pieces.groupBy("track", "low").applyInArrow(run, f"track {kind}, seq long, place int, y array<double>")
    new = done.groupBy("track", "seq").agg(F.collect_list(F.struct("place", "y")).alias("new"))

    def splice(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for x, new in zip(batch.column("x"), batch.column("new").to_pylist()):
                x = np.array(x.values, np.float64)
                for piece in new or []:
                    x[piece["place"] : piece["place"] + len(piece["y"])] = piece["y"]
                out.append(x)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("track", "seq", "n")), pa.array(out, pa.list_(pa.float64()))], ["track", "seq", "n", "x"])

    return b.select("track", "seq", "n", "x").join(new, ["track", "seq"], "left").mapInArrow(splice, f"track {kind}, seq long, n int, x array<double>")
