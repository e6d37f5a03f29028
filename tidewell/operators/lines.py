"""The strongest line of a band: low-pass and decimation in a scan over blocks, then one long spectrum per track."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from . import blocks as B, recurrences as R
from .spectral import biquad

#: Where mains hum is looked for, and what the floor around a line is taken from, in Hz.
MAINS, SPAN, SKIP = (40.0, 75.0), 25.0, 4.0
CUTOFF, DECIMATE, LENGTH = 450.0, 48, 4096
LEAST, NOTHING = 1e-30, -300.0


def spectrum(x: np.ndarray, length: int) -> np.ndarray:
    """Power in decibels of at most ``length`` samples under a symmetric window, padded with zeros."""
    x = x[:length]
    w = 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(len(x)) / (len(x) - 1)) if len(x) > 1 else np.ones(len(x))
    p = np.abs(np.fft.rfft(x * w, length)) ** 2 / max(float((w * w).sum()), LEAST)
    p[1:-1] *= 2
    return np.where(p < LEAST, NOTHING, 10 * np.log10(np.maximum(p, LEAST)))


def floor_around(psd: np.ndarray, k: int, bin_hz: float) -> float:
    """The upper median of the bins within ``SPAN`` of bin k, without those within ``SKIP``."""
    span, skip = int(SPAN / bin_hz), int(SKIP / bin_hz)
    near = np.arange(max(k - span, 0), min(k + span, len(psd) - 1) + 1)
    near = np.sort(psd[near[np.abs(near - k) > skip]])
    return float(near[len(near) // 2]) if len(near) else float(psd[k])


def peak(psd: np.ndarray, bin_hz: float, low: float, high: float) -> tuple[float, float] | None:
    """(Hz, prominence in decibels) of the highest bin between ``low`` and ``high``, refined by a parabola; None without one."""
    first, last = max(int(np.floor(low / bin_hz + 0.5)), 1), min(int(np.floor(high / bin_hz + 0.5)), len(psd) - 2)
    if first > last:
        return None
    k = first + int(np.argmax(psd[first : last + 1]))
    a, b, c = psd[k - 1 : k + 2]
    bend = a - 2 * b + c
    shift = 0.5 * (a - c) / bend if abs(bend) > 1e-9 else 0.0
    return (k + shift) * bin_hz, float(b - floor_around(psd, k, bin_hz))


def band_peak(s: DataFrame, rate: float, low: float = MAINS[0], high: float = MAINS[1], cutoff: float = CUTOFF, decimate: int = DECIMATE, length: int = LENGTH, size: int = 48_000) -> DataFrame:
    """``(track, hz, prominence_db)``: the most prominent line between ``low`` and ``high`` of ``s(track, idx, x)``.

    Two Butterworth sections at ``cutoff``, every ``decimate``-th sample, one spectrum of ``length`` such samples: what comes
    after them in a track is not read, so a task holds ``length`` numbers of a track. A track of fewer than
    ``decimate`` samples, or a band without a bin, has null. It is a measurement, not a verdict.
    """
    kind = s.schema["track"].dataType.simpleString()
    used = s.filter(F.col("idx") < decimate * length)
    parts = R.sections(biquad("lowpass", rate, cutoff, float(np.sqrt(0.5)))) * 2
    voices = [("x", parts)]

    def thinned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, (y,) in R.voiced(batch, voices):
                starts = [-seq * size % decimate for seq in rows.column("seq").to_pylist()]
                kept = pa.array([row[a::decimate] for row, a in zip(y, starts)], pa.list_(pa.float64()))
                yield pa.RecordBatch.from_arrays([*(rows.column(c) for c in ("track", "seq", "n")), kept], ["track", "seq", "n", "x"])

    def measured(t: pa.Table) -> pa.Table:
        t = t.sort_by("seq")
        x = np.concatenate([np.asarray(v.values) for v in t.column("x")])
        enough = sum(t.column("n").to_pylist()) >= decimate
        found = peak(spectrum(x, length), rate / decimate / length, low, high) if enough else None
        hz, prominence = found or (None, None)
        return pa.table({"track": t.column("track")[:1], "hz": pa.array([hz], pa.float64()), "prominence_db": pa.array([prominence], pa.float64())})

    thin = R.entered(B.blocks(used, size), voices).mapInArrow(thinned, f"track {kind}, seq long, n int, x array<double>")
    return thin.groupBy("track").applyInArrow(measured, f"track {kind}, hz double, prominence_db double")
