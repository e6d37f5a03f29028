"""Queries over onsets and beats, in batch and as a stream, and their oracles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tidewell.operators import beats as T, blocks as B
from tidewell.streaming import beats as stream_form

from .transform_queries import _finished, _folder
from .views import SIGNAL, rounded, signal

RATE, HOP, BLOCK = 20, 2, 7
HALF = T.reach(RATE, HOP)


def _beats(ahead: int) -> str:
    return f"""hops as (select track, idx // {HOP} frame, sum(x * x) p, count(*) n from signal group by 1, 2),
 two as (select *, sqrt(case when n = {HOP} and lead(n) over w = {HOP} then p + lead(p) over w end / {2 * HOP}) rms, sum(n) over (partition by track) samples from hops window w as (partition by track order by frame)),
 flux as materialized (select track, frame, samples, greatest(rms - coalesce(lag(rms) over (partition by track order by frame), 0), 0) flux from two where rms is not null),
 near as (select *, lag(flux) over w a, lead(flux) over w b, avg(flux) over v + 1.5 * stddev_pop(flux) over v top from flux window w as (partition by track order by frame), v as (partition by track order by frame rows between {HALF} preceding and {ahead} following)),
 hit as (select track, frame, (frame * {HOP} + {HOP}) * 1000 // {RATE} ms, flux, samples from near where flux > a and flux > b and flux > top and flux > 1e-4),
 gap as (select *, (ms - lag(ms) over (partition by track order by frame)) // 10 bin from hit), bins as (select track, bin, count(*) n from gap where bin between 30 and 100 group by 1, 2),
 best as (select track, arg_min(bin, -n * 1000 + bin) * 10 step from bins group by 1), facts as (select track, min(ms) first_ms, max(samples) samples from hit group by 1),
 grid as (select track, step, first_ms + step * i ms, i from (select *, unnest(range((samples::bigint * 1000 // {RATE} - first_ms + step - 1) // step)) i from facts join best using (track)))"""


def transients(spark: SparkSession, d: str) -> DataFrame:
    """Rises of energy that stand out."""
    found = T.transients(T.energy_flux(signal(spark, d), HOP), RATE, HOP)
    return rounded(found.drop("samples"))


def beat_grid(spark: SparkSession, d: str) -> DataFrame:
    """Tempo and beats of every track that has them."""
    beat = T.tempo(T.transients(T.energy_flux(signal(spark, d), HOP), RATE, HOP))
    return rounded(T.grid(beat, RATE).join(beat.select("track", T.bpm(F.col("step_ms")).alias("bpm")), "track"))


def stream_beats(spark: SparkSession, d: str) -> DataFrame:
    """The streaming detector over blocks of seven samples."""
    root = _folder(spark)
    s = signal(spark, d)
    b = B.blocks(s, BLOCK)
    ends = s.groupBy("track").agg(F.floor(F.max("idx") / BLOCK).alias("end"), F.max("ts").cast("timestamp").alias("ts"))
    fed = b.join(ends, "track").select("track", "seq", "ts", "x", (F.col("seq") == F.col("end")).alias("last"))
    fed.repartition("track").sortWithinPartitions("track", "seq").write.parquet(f"{root}/in")
    before = spark.conf.get(stream_form.PROVIDER[0])
    spark.conf.set(*stream_form.PROVIDER)
    try:
        stream = spark.readStream.schema(spark.read.parquet(f"{root}/in").schema).parquet(f"{root}/in")
        found = stream_form.beats(stream, RATE, HOP)
        _finished(found.writeStream.outputMode("append").option("checkpointLocation", f"{root}/at").format("parquet").option("path", f"{root}/out"))
    finally:
        spark.conf.set(stream_form.PROVIDER[0], before)
    return rounded(spark.read.schema(stream_form.RESULT).parquet(f"{root}/out"))


QUERIES = {f.__name__: f for f in (transients, beat_grid, stream_beats)}
ORACLE = {
    "transients": f"with {SIGNAL}, {_beats(HALF - 1)} select track, frame, ms, round(flux, 6) flux from hit",
    "beat_grid": f"with {SIGNAL}, {_beats(HALF - 1)} select track, i beat, ms, i % 4 = 0 downbeat, round(60000.0::double / step, 6) bpm from grid",
    "stream_beats": f"""with {SIGNAL}, {_beats(HALF)}, every as (select track, count(*) n from signal group by 1)
 select track, 'transient' kind, frame place, ms, null::double bpm from hit union all select track, 'tempo', n, coalesce(step, 0), round(coalesce(60000.0::double / step, 0), 6) from every left join best using (track)
 union all select track, case when i % 4 = 0 then 'downbeat' else 'beat' end, i, ms, null from grid""",
}
