"""Beats from the rises of energy: transients, the commonest distance between them, a grid of beats.

Energies of hops are partial sums below the shuffle on the track; all else is windows over hops. The streaming
form is in ``streaming.beats``; it decides on a frame when the ``reach`` frames after it have come, so the
local window must end there as well (``ahead = reach``). The plain form looks one frame less far ahead.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

SPREADS, LEAST_FLUX = 1.5, 1e-4
#: Distances of transients are counted in bins of 10 ms; those of 60 to 200 beats a minute may be the beat's.
BIN_MS, FIRST_BIN, LAST_BIN = 10, 30, 100


def reach(rate: int, hop: int) -> int:
    """Half the local window of a second and a half, in frames."""
    return max(int(1.5 * rate / hop), 5) // 2


def energy_flux(s: DataFrame, hop: int = 512) -> DataFrame:
    """``(track, frame, flux, samples)``: rises of the RMS from window to window of two hops, for ``s(track, idx, x)``.

    ``samples`` is the track's length so far as its rows tell. Windows that are not full are left out, but a
    track that has none keeps one row without a frame. Null and non-finite samples count as 0.
    """
    x = F.when(F.col("x").isNull() | F.isnan("x") | (F.abs("x") == float("inf")), 0.0).otherwise(F.col("x"))
    hops = s.groupBy("track", F.floor(F.col("idx") / hop).alias("frame")).agg(F.sum(x * x).alias("p"), F.count("*").alias("n"))
    track = Window.partitionBy("track")
    order = track.orderBy("frame")
    both = F.when((F.col("n") == hop) & (F.lead("n").over(order) == hop), F.col("p") + F.lead("p").over(order))
    hops = hops.withColumn("rms", F.sqrt(both / (2 * hop))).withColumn("samples", F.sum("n").over(track))
    rise = F.greatest(F.col("rms") - F.coalesce(F.lag("rms").over(order), F.lit(0.0)), F.lit(0.0))
    hops = hops.withColumn("flux", F.when(F.col("rms").isNotNull(), rise))
    return hops.filter(F.col("flux").isNotNull() | (F.col("frame") == 0)).select("track", F.when(F.col("flux").isNotNull(), F.col("frame")).alias("frame"), "flux", "samples")


def transients(flux: DataFrame, rate: int, hop: int = 512, ahead: int | None = None) -> DataFrame:
    """``(track, frame, ms, flux, samples)``: frames above both neighbours and the local mean plus 1.5 deviations.

    The local window reaches ``reach`` frames back and ``ahead`` on (one less than that if not given).
    """
    half = reach(rate, hop)
    order = Window.partitionBy("track").orderBy("frame")
    near = order.rowsBetween(-half, half - 1 if ahead is None else ahead)
    f = flux.filter(F.col("frame").isNotNull())
    f = f.select("*", F.lag("flux").over(order).alias("a"), F.lead("flux").over(order).alias("b"), (F.avg("flux").over(near) + SPREADS * F.stddev_pop("flux").over(near)).alias("limit"))
    found = f.filter("flux > a and flux > b and flux > limit").filter(F.col("flux") > LEAST_FLUX)
    return found.select("track", "frame", F.floor((F.col("frame") * hop + hop) * 1000 / rate).alias("ms"), "flux", "samples")


def tempo(found: DataFrame) -> DataFrame:
    """``(track, step_ms, first_ms, samples)`` from :func:`transients`: the commonest distance, the shorter on ties."""
    order = Window.partitionBy("track").orderBy("frame")
    gaps = found.withColumn("bin", F.floor((F.col("ms") - F.lag("ms").over(order)) / BIN_MS))
    counted = gaps.groupBy("track", "bin").agg(F.count("*").alias("n"), F.min("ms").alias("first_ms"), F.max("samples").alias("samples"))
    fits = F.col("bin").between(FIRST_BIN, LAST_BIN)
    best = F.min(F.when(fits, F.struct((-F.col("n")).alias("few"), "bin")))
    return counted.groupBy("track").agg(best.alias("best"), F.min("first_ms").alias("first_ms"), F.max("samples").alias("samples")).select("track", (F.col("best.bin") * BIN_MS).alias("step_ms"), "first_ms", "samples")


def grid(beat: DataFrame, rate: int) -> DataFrame:
    """``(track, beat, ms, downbeat)``: beats from the first transient to the track's end; every fourth is a downbeat."""
    end = F.floor(F.col("samples") * 1000 / rate)
    steps = beat.filter(F.col("step_ms").isNotNull() & (F.col("first_ms") < end))
    steps = steps.select("track", F.posexplode(F.sequence("first_ms", end - 1, F.col("step_ms"))).alias("beat", "ms"))
    return steps.select("track", F.col("beat").cast("long").alias("beat"), "ms", (F.col("beat") % 4 == 0).alias("downbeat"))


def bpm(step_ms: Column) -> Column:
    """Beats a minute; 0 without a beat."""
    return F.coalesce(60_000 / step_ms, F.lit(0.0))
