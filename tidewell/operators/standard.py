"""Tracks of any rate and number of channels brought to one form, hashed and judged in one pass over their blocks.

A block is mixed down to two channels, resampled, made finite and limited to -1..1, stored in 32 bits,
hashed, and summed up in windows of a second, all in one function; only the resampler looks beyond a
block, so blocks come with ``TAPS`` samples of their neighbours. Hashes of blocks are composed in order
into one of the track, and windows that lie across blocks are added up.
"""

from __future__ import annotations

import functools
import hashlib
import math
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from . import blocks as B

TAPS = 32
WINDOWS = "array<struct<window:long,power:double,n:long>>"


def downmix(x: np.ndarray) -> np.ndarray:
    """Two rows out of any number: the mean of channels 0, 2, ... and of 1, 3, ...; one channel is both."""
    left = x[0::2].mean(axis=0)
    return np.stack([left, x[1::2].mean(axis=0) if len(x) > 1 else left])


@functools.lru_cache(maxsize=16)
def _phases(source: int, target: int, taps: int) -> np.ndarray:
    """The weights of the 2 * taps samples around each of the places an output can have between two inputs."""
    many, cut = target // math.gcd(source, target), min(1.0, target / source)
    away = np.arange(many)[:, None] / many - np.arange(1 - taps, taps + 1)
    return cut * np.sinc(cut * away) * (0.5 + 0.5 * np.cos(np.pi * np.clip(away / taps, -1, 1)))


def resampled(x: np.ndarray, lead: int, start: int, n: int, source: int, target: int, taps: int = TAPS) -> tuple[int, np.ndarray]:
    """(first place, outputs) that fall on input samples start..start+n-1; ``x`` has ``lead`` samples before these.

    Output j lies at j * source / target. What lies beyond ``x`` counts as 0.
    """
    first, end = -(-start * target // source), -(-(start + n) * target // source)
    j = np.arange(first, end)
    if source == target:
        return first, x[:, lead : lead + n]
    at, phase = j * source // target, (j * source % target) // math.gcd(source, target)
    padded = np.pad(x, [(0, 0), (taps, taps)])
    # input start sits at place lead + taps of the padded rows
    place = (at - start + lead + taps)[:, None] + np.arange(1 - taps, taps + 1)
    return first, (padded[:, place] * _phases(source, target, taps)[phase]).sum(axis=2)


def standardized(s: DataFrame, channels: Sequence[str], target: int = 48_000, size: int = 48_000, taps: int = TAPS, window: int | None = None) -> DataFrame:
    """``(track, seq, first, n, l, r, digest, windows, bad)`` out of ``s(track, idx, rate, channels...)``.

    ``first`` is the place of a block's first output; ``digest`` is the sha256 of its interleaved little-endian
    32-bit samples; ``windows`` has (window, power, n): half the sum of both channels' squares for windows of
    ``window`` outputs (a second); ``bad`` counts input values that were null, NaN or infinite (taken as 0).
    A track has one rate, its first. An empty table gives an empty one. ``size`` (input samples) must be at least ``taps``.
    """
    if size < taps:
        raise ValueError("blocks must be at least as long as the resampler's reach")
    window = window or target
    kind = s.schema["track"].dataType.simpleString()
    odd = lambda c: F.when(F.col(c).isNull() | F.isnan(c) | (F.abs(c) == float("inf")), 1.0).otherwise(0.0)
    rows = s.withColumn("_bad", sum((odd(c) for c in channels), F.lit(0.0)))
    held = B.overlapped(B.blocks(rows, size, [*channels, "rate", "_bad"]), taps, taps, [*channels, "rate", "_bad"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: dict[str, list] = {c: [] for c in ("first", "n", "l", "r", "digest", "windows", "bad")}
            for i, (seq, n, lead) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("seq", "n", "lead")))):
                x = np.stack([np.asarray(batch.column(c)[i].values, np.float64) for c in channels])
                rate = int(batch.column("rate")[i].values[lead].as_py())
                first, y = resampled(downmix(x), lead, seq * size, n, rate, target, taps)
                y = np.clip(np.where(np.isfinite(y), y, 0.0), -1.0, 1.0).astype("<f4")
                power = (y.astype(np.float64) ** 2).sum(axis=0) / 2
                which = np.arange(first, first + len(power)) // window
                low = int(which[0]) if len(which) else 0
                sums, many = np.bincount(which - low, weights=power), np.bincount(which - low)
                values = first, len(power), y[0].astype(np.float64), y[1].astype(np.float64), hashlib.sha256(np.ascontiguousarray(y.T).tobytes()).digest()
                windows = [{"window": low + k, "power": float(p), "n": int(m)} for k, (p, m) in enumerate(zip(sums, many))]
                bad = int(np.asarray(batch.column("_bad")[i].values)[lead : lead + n].sum())
                for name, value in zip(out, (*values, windows, bad)):
                    out[name].append(value)
            kinds = pa.int64(), pa.int64(), pa.list_(pa.float64()), pa.list_(pa.float64()), pa.binary(), pa.list_(pa.struct([("window", pa.int64()), ("power", pa.float64()), ("n", pa.int64())])), pa.int64()
            cols = [pa.array(values, kind) for values, kind in zip(out.values(), kinds)]
            yield pa.RecordBatch.from_arrays([batch.column("track"), batch.column("seq"), *cols], ["track", "seq", *out])

    return held.mapInArrow(run, f"track {kind}, seq long, first long, n long, l array<double>, r array<double>, digest binary, windows {WINDOWS}, bad long")


def samples(b: DataFrame) -> DataFrame:
    """``(track, idx, l, r)`` of standardized blocks."""
    pairs = F.posexplode(F.arrays_zip("l", "r")).alias("at", "pair")
    return b.select("track", "first", pairs).select("track", (F.col("first") + F.col("at")).alias("idx"), "pair.l", "pair.r")


def digests(b: DataFrame) -> DataFrame:
    """``(track, n, digest)``: the sha256 of the blocks' digests in order, and the track's length. It depends on the block size."""
    joined = F.transform(F.array_sort(F.collect_list(F.struct("seq", "digest"))), lambda x: F.hex(x["digest"]))
    return b.groupBy("track").agg(F.sum("n").alias("n"), F.sha2(F.unhex(F.concat_ws("", joined)), 256).alias("digest"))


def dbfs(power: Column) -> Column:
    """Decibels of a mean power; null for none, as it has no level."""
    return F.when(power > 0, 10 * F.log10(power))


def seconds(b: DataFrame, window: int) -> DataFrame:
    """``(track, window, power, n)``: the windows of standardized blocks, each once."""
    each = b.select("track", F.explode("windows").alias("w")).select("track", "w.*")
    return each.groupBy("track", "window").agg(F.sum("power").alias("power"), F.sum("n").alias("n")).withColumn("whole", F.col("n") == window)


def dead_air(w: DataFrame, quiet_db: float = -60.0, least: int = 3) -> DataFrame:
    """``(track, start, length)`` in windows: runs of ``least`` or more whole windows below ``quiet_db``."""
    order = Window.partitionBy("track").orderBy("window")
    quiet = w.filter("whole").filter(F.coalesce(dbfs(F.col("power") / F.col("n")) < quiet_db, F.lit(True)))
    run = quiet.withColumn("run", F.col("window") - F.row_number().over(order)).groupBy("track", "run")
    return run.agg(F.min("window").alias("start"), F.count("*").alias("length")).filter(F.col("length") >= least).drop("run")


def health(w: DataFrame, quiet_db: float = -60.0, least: int = 3, early: int = 30, digital_db: float = -100.0, silent_db: float = -60.0, target_db: float = -14.0, most_gain_db: float = 30.0) -> DataFrame:
    """One row per track of :func:`seconds`: its level, that of the first ``early`` windows, a verdict and the dead air in it.

    ``verdict``: ``dead`` if the early windows are below ``digital_db`` (also where the track is shorter), else
    ``silent`` if the whole is below ``silent_db``, else ``faint`` if reaching ``target_db`` (a level counts one
    decibel less than its power says) takes more than ``most_gain_db``, else ``ok``. Gaps are not a fault; all are counted.
    Levels are null where there is no power at all.
    """
    mean = lambda when: F.sum(F.when(when, F.col("power"))) / F.sum(F.when(when, F.col("n")))
    loud = F.col("whole") & (dbfs(F.col("power") / F.col("n")) >= quiet_db)
    a = w.groupBy("track").agg(
        F.sum("n").alias("n"), dbfs(mean(F.lit(True))).alias("level_db"), dbfs(mean(F.col("window") < early)).alias("early_db"),
        F.min(F.when(loud, dbfs(F.col("power") / F.col("n")))).alias("least_loud_db"),
    )
    below = lambda c, limit: F.coalesce(F.col(c) < limit, F.lit(True))
    verdict = F.when(below("early_db", digital_db), "dead").when(below("level_db", silent_db), "silent").when(target_db - (F.col("level_db") - 1) > most_gain_db, "faint").otherwise("ok")
    gaps = dead_air(w, quiet_db, least).groupBy("track").agg(F.count("*").alias("gaps"), F.sum("length").alias("gap_windows"), F.max("length").alias("longest_gap"))
    told = a.withColumn("verdict", verdict).join(gaps, "track", "left")
    return told.fillna(0, ["gaps", "gap_windows", "longest_gap"])
