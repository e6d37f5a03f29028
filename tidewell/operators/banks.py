"""Filter banks as scans over blocks: crossovers that sum to an all-pass, an eight-band profile, and what follows from it."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F

from . import blocks as B, recurrences as R
from .levels import amplitude_db
from .spectral import biquad

#: The edges of the eight bands, and the quality of the sections with which profiles are measured.
EDGES = (20.0, 80.0, 250.0, 500.0, 1000.0, 2000.0, 4000.0, 8000.0, 20000.0)
QUALITY = float(np.sqrt(2.0))
SILENCE_DB, LEAST = -144.0, 1e-20
#: Where the zones begin.
RUMBLE_DB, HARSH_DB, HARSH_CREST_DB, BOXY_DB, BOXY_RANGE, PHASE = -30.0, -18.0, 8.0, -20.0, 5.0, 0.3
HARSH_HZ = (2000.0, 8000.0)


def _twice(kind: str, rate: float, f0: float, q: float) -> R.Sections:
    return R.sections(biquad(kind, rate, f0, q)) * 2


def crossover(rate: float, f0: float) -> tuple[R.Sections, R.Sections]:
    """(below, above): two Butterworth sections each; their sum has the input's magnitude at all frequencies."""
    q = float(np.sqrt(0.5))
    return _twice("lowpass", rate, f0, q), _twice("highpass", rate, f0, q)


def three_bands(rate: float, low: float, high: float, channel: str = "x") -> dict[str, tuple[str, R.Sections]]:
    """Voices low, mid and high: the part above ``low`` is split again at ``high``."""
    (below, rest), (middle, above) = crossover(rate, low), crossover(rate, high)
    return {"low": (channel, below), "mid": (channel, rest + middle), "high": (channel, rest + above)}


def band_filters(rate: float, edges: Sequence[float] = EDGES, q: float = QUALITY) -> list[R.Sections | None]:
    """For each band two high-pass sections at its lower edge and two low-pass ones at its upper; None beyond half the rate."""
    out: list[R.Sections | None] = []
    for a, b in zip(edges, edges[1:]):
        b = min(b, rate / 2 - rate / 48_000)
        out.append(_twice("highpass", rate, a, q) + _twice("lowpass", rate, b, q) if a < b else None)
    return out


def profile(s: DataFrame, rate: float, channels: Sequence[str] = ("l", "r"), edges: Sequence[float] = EDGES, size: int = 48_000) -> DataFrame:
    """``(track, levels)``: the RMS in decibels of each band over all channels; silence for bands beyond half the rate."""
    filters = band_filters(rate, edges)
    bank = {f"b{i}_{c}": (c, f) for i, f in enumerate(filters) if f for c in channels}
    sums = R.block_powers(B.blocks(s, size, channels), bank).groupBy("track").agg(F.sum("n").alias("n"), *(F.sum(v).alias(v) for v in bank))

    def level(i: int) -> Column:
        rms = F.sqrt(sum((F.col(f"b{i}_{c}") for c in channels), F.lit(0.0)) / (len(channels) * F.col("n")))
        return F.when(rms > LEAST, 20 * F.log10(rms)).otherwise(SILENCE_DB)

    return sums.select("track", F.array(*(level(i) if f else F.lit(SILENCE_DB) for i, f in enumerate(filters))).alias("levels"))


def slope(levels: Column, edges: Sequence[float] = EDGES) -> Column:
    """Least-squares slope of the bands' density over log frequency, without the first and the last band, in (dB / 20) per decade."""
    inner = range(1, len(edges) - 2)
    x = np.array([np.log10(np.sqrt(edges[i] * edges[i + 1])) for i in inner])
    weight = (x - x.mean()) / ((x - x.mean()) ** 2).sum()
    density = lambda i: (F.element_at(levels, i + 1) - 10 * float(np.log10(edges[i + 1] - edges[i]))) / 20
    return sum((float(w) * density(i) for w, i in zip(weight, inner)), F.lit(0.0))


def zones(levels: Column, crest_db: Column, range_db: Column, correlation: Column, peaks: Column | None = None) -> list[Column]:
    """Flags from a profile and its track's figures; a figure that is missing raises none.

    ``peaks`` (an array of frequencies) flags a resonance where one lies within ``HARSH_HZ``.
    """
    band = lambda i: F.element_at(levels, i + 1)
    inside = lambda f: (f >= HARSH_HZ[0]) & (f <= HARSH_HZ[1])
    found = {
        "cymbal_harsh": (band(5) > HARSH_DB) & (crest_db < HARSH_CREST_DB),
        "sub_rumble": band(0) > RUMBLE_DB,
        "boxiness": (band(2) > BOXY_DB) & (range_db < BOXY_RANGE),
        "phase_issue": correlation < PHASE,
        "harsh_resonance": F.exists(peaks, inside) if peaks is not None else F.lit(False),
    }
    return [F.coalesce(flag, F.lit(False)).alias(f"zone_{name}") for name, flag in found.items()]


def band_levels(s: DataFrame, bank: dict[str, tuple[str, R.Sections]], size: int = 48_000) -> DataFrame:
    """``(track, one level per voice)``: RMS in decibels of each voice of a bank."""
    channels = list(dict.fromkeys(c for c, _ in bank.values()))
    sums = R.block_powers(B.blocks(s, size, channels), bank).groupBy("track").agg(F.sum("n").alias("n"), *(F.sum(v).alias(v) for v in bank))
    return sums.select("track", *(amplitude_db(F.sqrt(F.col(v) / F.col("n")), SILENCE_DB, LEAST).alias(v) for v in bank))
