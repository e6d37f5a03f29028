"""Voice activity: features of frames, the odds of speech, a latch with two thresholds, and gains that follow it.

Features are one pass over blocks that carry the samples of the slow average in front of them. All that follows
is windows over frames: the latch has no loop, since it is open exactly when the last frame that opened it came
after the last frame that closed it.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from . import blocks as B

FRAME, SLOW, PADDED = 480, 4800, 2048
#: What makes a rise, and the ratio that stands for a signal without a middle.
RISE, SIDE_ONLY, SILENCE_DB = 1.9952623, 100.0, -144.0
#: Fixed values of the odds: slope and centre over the noise floor; (mean, deviation) of speech and of its opposite.
SNR_SLOPE, SNR_CENTRE, LEAST_FLOOR = 0.15, 6.0, -70.0
FLATNESS, DELTA, RATE = ((0.03, 0.04), (0.28, 0.08)), ((1.0, 1.0), (0.2, 0.3)), ((5.5, 3.5), (1.0, 1.5))
SIDE_SCALE, SIDE_NOISE, SIDE_NORM, TEMPERATURE = 0.15, (0.6, 0.4), 1.8997678, 2.0
#: Fixed values of the latch and of the gains.
ENTER, LEAVE, HOLD, ATTACK, RELEASE = 0.70, 0.30, 15, 0.3, 0.02
FLOOR_DB, DEAD_ZONE, ATTACK_S, RELEASE_S = -12.0, 0.30, 0.030, 0.500


def features(s: DataFrame, frame: int = FRAME, slow: int = SLOW, padded: int = PADDED, size: int = 48_000) -> DataFrame:
    """``(track, frame, rms_db, flatness, side_ratio, rises)`` of the whole frames of ``s(track, idx, l, r)``.

    ``flatness`` is that of the power spectrum of the windowed middle, 0.5 for silence; ``side_ratio`` the side's RMS over the
    middle's; ``rises`` counts how often the mean magnitude of the last ``frame`` samples comes to lie 6 dB above
    that of the last ``slow``. ``size`` must be a multiple of ``frame`` and longer than ``slow``.
    """
    if size % frame or size <= slow:
        raise ValueError("the block size must be a multiple of the frame and longer than the slow average")
    kind = s.schema["track"].dataType.simpleString()
    window = 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(frame) / frame)

    def of(l: np.ndarray, r: np.ndarray, lead: int, n: int) -> list[np.ndarray]:  # noqa: E741
        many = n // frame
        mid, side = (l + r) / 2, (l - r) / 2
        rows = lambda x: x[lead : lead + many * frame].reshape(many, frame)
        m, d = np.sqrt((rows(mid) ** 2).mean(axis=1)), np.sqrt((rows(side) ** 2).mean(axis=1))
        p = np.abs(np.fft.rfft(rows(mid) * window, padded)) ** 2 + 1e-20
        flat = np.where(m > 0, np.exp(np.log(p).mean(axis=1)) / p.mean(axis=1), 0.5)
        ratio = np.where(m < 1e-10, np.where(d < 1e-10, 0.0, SIDE_ONLY), d / np.maximum(m, 1e-10))
        total = np.append(np.zeros(slow + 1), np.cumsum(np.abs(mid)))
        at = np.arange(lead - 1, lead + many * frame) + slow + 1  # one sample before the block, to see what rises in its first
        at = np.maximum(at, slow)
        mean = lambda w: (total[at] - total[at - w]) / w
        above = mean(frame) > mean(slow) * RISE
        rises = (above[1:] & ~above[:-1]).reshape(many, frame).sum(axis=1)
        return [np.where(m > 1e-15, 20 * np.log10(np.maximum(m, 1e-15)), SILENCE_DB), flat, ratio, rises]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, (seq, n, lead) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("seq", "n", "lead")))):
                if n < frame:
                    continue
                found = of(*(np.asarray(batch.column(c)[i].values, np.float64) for c in "lr"), lead, n)
                place = np.arange(n // frame) + seq * (size // frame)
                track = batch.column("track").take(pa.array(np.full(len(place), i)))
                yield pa.RecordBatch.from_arrays([track, pa.array(place), *map(pa.array, found[:3]), pa.array(found[3].astype(np.int64))], ["track", "frame", "rms_db", "flatness", "side_ratio", "rises"])

    held = B.overlapped(B.blocks(s, size, ["l", "r"]), slow + 1, 0, ["l", "r"])
    return held.mapInArrow(run, f"track {kind}, frame long, rms_db double, flatness double, side_ratio double, rises long")


def _against(x: Column, speech: tuple[float, float], other: tuple[float, float], most: float) -> Column:
    """Log ratio of two normal densities, limited to +-``most``."""
    a, b = (x - speech[0]) / speech[1], (x - other[0]) / other[1]
    return _limit(0.5 * b * b - 0.5 * a * a + math.log(other[1] / speech[1]), most)


def _limit(x: Column, most: float) -> Column:
    return F.greatest(F.least(x, F.lit(most)), F.lit(-most))


def posterior(f: DataFrame, floor_db: Column, lag: int = 3, rate_frames: int = 100) -> DataFrame:
    """Adds ``posterior``, the chance that a frame is speech, from :func:`features` and the level of the noise.

    A frame's level counts against that of ``lag`` frames before, its rises with those of ``rate_frames`` frames. Frames with a
    figure that is null, NaN or infinite say nothing: a half.
    """
    order = Window.partitionBy("track").orderBy("frame")
    past = order.rowsBetween(1 - rate_frames, 0)
    x = f.withColumn("floor", F.greatest(floor_db, F.lit(LEAST_FLOOR))).withColumn("delta", F.coalesce(F.abs(F.col("rms_db") - F.lag("rms_db", lag).over(order)), F.lit(0.0)))
    x = x.withColumn("rate", F.when(F.count("*").over(past) == rate_frames, F.sum("rises").over(past)))
    snr = F.col("rms_db") - F.col("floor")
    side = F.greatest(F.least(F.col("side_ratio"), F.lit(1.0)), F.lit(0.0))
    away = (side - SIDE_NOISE[0]) / SIDE_NOISE[1]
    terms = [
        _limit(SNR_SLOPE * (snr - SNR_CENTRE), 1.0),
        _against(F.col("flatness"), *FLATNESS, 8.0),
        F.when(F.col("side_ratio") < 1e-6, 0.0).otherwise(_limit(-(side / SIDE_SCALE) + 0.5 * away * away + SIDE_NORM, 0.5)),
        _against(F.col("delta"), *DELTA, 0.5),
        F.when((snr < 6.0) | F.col("rate").isNull(), 0.0).otherwise(_against(F.col("rate"), *RATE, 1.5)),
    ]
    figures = [F.col(c) for c in ("rms_db", "flatness", "side_ratio")] + [floor_db, F.col("delta")]
    bad = [c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")) for c in figures]
    odds = F.when(F.greatest(*bad), 0.0).otherwise(sum(terms, F.lit(0.0)))
    return x.withColumn("posterior", 1 / (1 + F.exp(-odds / TEMPERATURE))).drop("floor", "delta", "rate")


def latched(f: DataFrame, enter: float = ENTER, leave: float = LEAVE, hold: int = HOLD) -> DataFrame:
    """Adds ``is_speech`` to ``f(track, frame, posterior)``: from a frame above ``enter`` until more than ``hold`` in a row are not above ``leave``.

    Frames count from 0 without gaps. A null or NaN posterior is neither above the one nor the other.
    """
    so_far = Window.partitionBy("track").orderBy("frame").rowsBetween(Window.unboundedPreceding, 0)
    p = F.when(~F.isnan("posterior"), F.col("posterior"))
    last = lambda when: F.max(F.when(when, F.col("frame"))).over(so_far)
    x = f.withColumn("high", F.coalesce(last(p > leave), F.lit(-1)))
    x = x.withColumn("opened", last(p > enter)).withColumn("closed", last(F.col("frame") - F.col("high") > hold))
    return x.withColumn("is_speech", F.col("opened").isNotNull() & (F.col("closed").isNull() | (F.col("opened") > F.col("closed")))).drop("high", "opened", "closed")


def segments(f: DataFrame, flag: str = "is_speech") -> DataFrame:
    """``(track, start, length)`` of the runs of frames with the flag."""
    order = Window.partitionBy("track").orderBy("frame")
    run = f.filter(flag).withColumn("run", F.col("frame") - F.row_number().over(order))
    return run.groupBy("track", "run").agg(F.min("frame").alias("start"), F.count("*").alias("length")).drop("run")


def alphas(frame_rate: float) -> tuple[float, float]:
    """How much of a gain's distance to its target is left after a frame, going down and going up."""
    return math.exp(-2.2 / (ATTACK_S * frame_rate)), math.exp(-2.2 / (RELEASE_S * frame_rate))


def duck(p: np.ndarray, gain: float, down: float, up: float) -> tuple[np.ndarray, float]:
    """Gains that fall as the posterior rises over the dead zone, frame by frame; a value that is not finite leaves the gain."""
    floor, out = 10 ** (FLOOR_DB / 20), np.empty(len(p))
    open_ = np.clip((np.clip(p, 0, 1) - DEAD_ZONE) / (1 - DEAD_ZONE), 0, 1)
    for i, (x, fine) in enumerate(zip((1 - open_ * (1 - floor)).tolist(), np.isfinite(p).tolist())):
        if fine:
            gain = min(max(x + (down if x < gain else up) * (gain - x), 0.0), 1.0)
        out[i] = gain
    return out, gain


def ducked(f: DataFrame, frame_rate: float = 100.0) -> DataFrame:
    """``(track, frame, gain)`` for ``f(track, frame, posterior)``: two speeds make it a loop, over a track's frames (a hundred a second)."""
    kind = f.schema["track"].dataType.simpleString()

    def run(t: pa.Table) -> pa.Table:
        t = t.sort_by("frame")
        gains, _ = duck(np.asarray(t.column("posterior").to_numpy(), float), 1.0, *alphas(frame_rate))
        return pa.table({"track": t.column("track"), "frame": t.column("frame"), "gain": pa.array(gains)})

    return f.select("track", "frame", "posterior").groupBy("track").applyInArrow(run, f"track {kind}, frame long, gain double")
