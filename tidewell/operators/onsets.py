"""Onset strength that ignores vibrato: rises of logarithmic bands over the widened bands of the frame before.

Frames are cut from blocks with overlap, so a long track is many tasks, and the only shuffle is that which
brings a block its neighbours' ends.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import blocks as B
from .spectral import hann

#: The mel scale that is linear up to 1000 Hz (200/3 Hz each) and logarithmic above (27 to a factor of 6.4).
LINEAR_HZ, BREAK_HZ, STEP = 200.0 / 3.0, 1000.0, np.log(6.4) / 27.0


def to_mel(hz: np.ndarray) -> np.ndarray:
    return np.where(hz < BREAK_HZ, hz / LINEAR_HZ, BREAK_HZ / LINEAR_HZ + np.log(np.maximum(hz, BREAK_HZ) / BREAK_HZ) / STEP)


def to_hz(mel: np.ndarray) -> np.ndarray:
    top = BREAK_HZ / LINEAR_HZ
    return np.where(mel < top, mel * LINEAR_HZ, BREAK_HZ * np.exp(STEP * (np.maximum(mel, top) - top)))


@functools.lru_cache(maxsize=16)
def mel_bands(bands: int, size: int, rate: float) -> np.ndarray:
    """Triangles of equal area, evenly spaced on that scale from 0 to half the rate: (bands, size / 2 + 1)."""
    edge = to_hz(np.linspace(0.0, float(to_mel(np.array(rate / 2))), bands + 2))
    f = np.fft.rfftfreq(size, 1 / rate)
    rise = (f - edge[:-2, None]) / np.diff(edge)[:-1, None]
    fall = (edge[2:, None] - f) / np.diff(edge)[1:, None]
    return np.maximum(0, np.minimum(rise, fall)) * (2.0 / (edge[2:] - edge[:-2]))[:, None]


def log_bands(frames: np.ndarray, bands: np.ndarray, gamma: float) -> np.ndarray:
    """log(1 + gamma * band) of the magnitudes of windowed frames."""
    return np.log1p(gamma * (np.abs(np.fft.rfft(frames * hann(frames.shape[1]))) @ bands.T))


def strength(now: np.ndarray, before: np.ndarray) -> np.ndarray:
    """Mean rise of each row of ``now`` over the largest of three neighbouring bands of its row of ``before``."""
    wide = np.pad(before, [(0, 0), (1, 1)], mode="edge")
    return np.maximum(now - np.maximum(np.maximum(wide[:, :-2], wide[:, 2:]), before), 0).mean(axis=1)


def superflux(s: DataFrame, rate: float, size: int = 2048, hop: int = 512, bands: int = 24, gamma: float = 10.0, block: int = 48_000) -> DataFrame:
    """``(track, frame, strength)`` for ``s(track, idx, x)``; frame i is ``size`` samples from i * ``hop`` on.

    Before the first frame there is silence. A track shorter than a frame has none; what is left at its end is not
    looked at; values that are not finite count as 0. ``block`` must be at least ``size``.
    """
    if block < size:
        raise ValueError("blocks must be at least as long as a frame")
    kind = s.schema["track"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights = mel_bands(bands, size, rate)
        for batch in batches:
            rows, place, value = [], [], []
            for i, (seq, n, lead, x) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("seq", "n", "lead")), batch.column("x"))):
                x, start = np.asarray(x.values, np.float64), seq * block
                first = -(-start // hop)
                many = min(-(-(start + n) // hop), (start - lead + len(x) - size) // hop + 1) - first
                if many <= 0:
                    continue
                prior = first > 0  # the frame before lies in the block in front
                at = np.arange(first - prior, first + many) * hop - start + lead
                found = log_bands(x[at[:, None] + np.arange(size)], weights, gamma)
                now, before = (found[1:], found[:-1]) if prior else (found, np.vstack([np.zeros((1, bands)), found[:-1]]))
                rows.append(np.full(many, i))
                place.append(np.arange(first, first + many))
                value.append(strength(now, before))
            take = np.concatenate(rows) if rows else np.zeros(0, np.int64)
            numbers = [np.concatenate(v) if v else np.zeros(0, t) for v, t in ((place, np.int64), (value, np.float64))]
            yield pa.RecordBatch.from_arrays([batch.column("track").take(pa.array(take)), *map(pa.array, numbers)], ["track", "frame", "strength"])

    held = B.overlapped(B.blocks(s, block), hop, size)
    return held.mapInArrow(run, f"track {kind}, frame long, strength double")
