"""Queries over voice activity, in batch and as a stream, and their oracles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tidewell.functions import tables as T
from tidewell.operators import blocks as B, escalation as E, voice as V
from tidewell.streaming import voice as stream_form
from tidewell.streaming.beats import PROVIDER

from .transform_queries import _finished, _folder
from .views import SIGNAL, rounded, signal

FRAME, SLOW, PADDED, SIZE, FLOOR_DB, RATE_FRAMES, HOLD, FRAME_RATE = 4, 12, 16, 16, -12.0, 5, 1, 20.0
ENTER, LEAVE = 0.7, 0.55


def _frames(spark: SparkSession, d: str) -> DataFrame:
    f = V.features(signal(spark, d), FRAME, SLOW, PADDED, SIZE)
    return V.posterior(f, F.lit(FLOOR_DB), rate_frames=RATE_FRAMES)


def _spread(spark: SparkSession, d: str) -> DataFrame:
    """The view is noise, so its chances are all small; they are spread out for what decides on them."""
    return _frames(spark, d).withColumn("posterior", F.least(50 * F.col("posterior"), F.lit(1.0)))


def voice_posterior(spark: SparkSession, d: str) -> DataFrame:
    """Features of frames and the chance of speech."""
    return rounded(_frames(spark, d), 5)


def voice_segments(spark: SparkSession, d: str) -> DataFrame:
    """Runs of frames in which the latch is open."""
    return V.segments(V.latched(_spread(spark, d), ENTER, LEAVE, HOLD))


def voice_gain(spark: SparkSession, d: str) -> DataFrame:
    """Gains that make room for speech."""
    return rounded(V.ducked(_spread(spark, d), FRAME_RATE), 5)


def stream_voice(spark: SparkSession, d: str) -> DataFrame:
    """Latch and gain from a stream of frames."""
    root = _folder(spark)
    _spread(spark, d).select("track", "frame", "posterior").write.parquet(f"{root}/in")
    before = spark.conf.get(PROVIDER[0])
    spark.conf.set(*PROVIDER)
    try:
        stream = spark.readStream.schema(spark.read.parquet(f"{root}/in").schema).parquet(f"{root}/in")
        found = stream_form.voice(stream, ENTER, LEAVE, HOLD, FRAME_RATE)
        _finished(found.writeStream.outputMode("append").option("checkpointLocation", f"{root}/at").format("parquet").option("path", f"{root}/out"))
    finally:
        spark.conf.set(PROVIDER[0], before)
    return rounded(spark.read.schema(stream_form.RESULT).parquet(f"{root}/out"), 5)


def escalated_segments(spark: SparkSession, d: str) -> DataFrame:
    """Loud segments with what surrounds them, made free of their region's mean; all else as it was."""
    s = signal(spark, d)
    b = E.escalated(B.blocks(s, 9), 9, T.segmented(s, 1.2, 1), 3, lambda x: x - x.mean())
    return rounded(b.select("track", F.posexplode("x").alias("at", "x"), "seq").select("track", (F.col("seq") * 9 + F.col("at")).alias("idx"), F.col("x")), 9)


def _clip(x: str, most: float) -> str:
    return f"greatest(least({x}, {most}), {-most})"


def _against(x: str, speech: tuple[float, float], other: tuple[float, float], most: float) -> str:
    return _clip(f"(0.5 * pow(({x} - {other[0]}) / {other[1]}, 2) - 0.5 * pow(({x} - {speech[0]}) / {speech[1]}, 2) + ln({other[1]} / {speech[1]}))", most)


DOWN, UP = V.alphas(FRAME_RATE)
POSTERIOR = f"""{SIGNAL}, pair as (select track, idx, idx // {FRAME} frame, idx % {FRAME} k, (l + r) / 2 m, (l - r) / 2 d from signal),
 near as (select *, sum(abs(m)) over (partition by track order by idx rows between {FRAME - 1} preceding and current row) / {FRAME} > sum(abs(m)) over (partition by track order by idx rows between {SLOW - 1} preceding and current row) / {SLOW} * {V.RISE} above from pair),
 edge as (select *, above and not coalesce(lag(above) over (partition by track order by idx), false) rise from near),
 base as materialized (select track, frame, sqrt(avg(m * m)) m, sqrt(avg(d * d)) d, count(*) filter (rise) rises from edge group by 1, 2 having count(*) = {FRAME}),
 dft as (select track, frame, b, sum(m * (0.5 - 0.5 * cos(2 * pi() * k / {FRAME})) * cos(2 * pi() * k * b / {PADDED})) re, sum(m * (0.5 - 0.5 * cos(2 * pi() * k / {FRAME})) * sin(2 * pi() * k * b / {PADDED})) im from pair cross join range({PADDED // 2 + 1}) t(b) group by 1, 2, 3),
 flat as (select track, frame, exp(avg(ln(re * re + im * im + 1e-20))) / avg(re * re + im * im + 1e-20) f from dft group by 1, 2),
 feat as materialized (select track, frame, case when m > 1e-15 then 20 * log10(m) else -144 end rms_db, case when m > 0 then f else 0.5 end flatness, case when m < 1e-10 then case when d < 1e-10 then 0 else 100 end else d / m end side_ratio, rises from base join flat using (track, frame)),
 more as (select *, coalesce(abs(rms_db - lag(rms_db, 3) over w), 0) delta, case when count(*) over v = {RATE_FRAMES} then sum(rises) over v end rate, rms_db - {max(FLOOR_DB, V.LEAST_FLOOR)} snr, greatest(least(side_ratio, 1), 0) side from feat window w as (partition by track order by frame), v as (partition by track order by frame rows between {RATE_FRAMES - 1} preceding and current row)),
 odds as (select *, {_clip(f'({V.SNR_SLOPE} * (snr - {V.SNR_CENTRE}))', 1.0)} + {_against('flatness', *V.FLATNESS, 8.0)} + case when side_ratio < 1e-6 then 0 else {_clip(f'(-(side / {V.SIDE_SCALE}) + 0.5 * pow((side - {V.SIDE_NOISE[0]}) / {V.SIDE_NOISE[1]}, 2) + {V.SIDE_NORM})', 0.5)} end
  + {_against('delta', *V.DELTA, 0.5)} + case when snr < 6 or rate is null then 0 else {_against('rate', *V.RATE, 1.5)} end o from more),
 post as materialized (select track, frame, rms_db, flatness, side_ratio, rises, 1 / (1 + exp(-o / {V.TEMPERATURE})) posterior from odds), spread as materialized (select track, frame, least(50 * posterior, 1) posterior from post)"""
LATCH = f"""latch(track, frame, speech, held) as (select track, frame, posterior > {ENTER}, case when posterior > {ENTER} then {HOLD} else 0 end from spread where frame = 0
 union all select p.track, p.frame, case when l.speech then posterior > {LEAVE} or l.held > 0 else posterior > {ENTER} end, case when l.speech then case when posterior > {LEAVE} then {HOLD} else greatest(l.held - 1, 0) end when posterior > {ENTER} then {HOLD} else 0 end from latch l join spread p on p.track = l.track and p.frame = l.frame + 1)"""
TARGET = f"1 - greatest(least((posterior - {V.DEAD_ZONE}) / {1 - V.DEAD_ZONE!r}, 1), 0) * {1 - 10 ** (V.FLOOR_DB / 20)!r}::double"
GAIN = f"""aim as (select track, frame, {TARGET} x from spread), gain(track, frame, g) as (select track, frame, x + case when x < 1 then {DOWN!r}::double else {UP!r}::double end * (1 - x) from aim where frame = 0
 union all select a.track, a.frame, x + case when x < g then {DOWN!r}::double else {UP!r}::double end * (g - x) from gain join aim a on a.track = gain.track and a.frame = gain.frame + 1)"""
QUERIES = {f.__name__: f for f in (voice_posterior, voice_segments, voice_gain, stream_voice, escalated_segments)}
ORACLE = {
    "voice_posterior": f"with {POSTERIOR} select track, frame, round(rms_db, 5) rms_db, round(flatness, 5) flatness, round(side_ratio, 5) side_ratio, rises, round(posterior, 5) posterior from post",
    "voice_segments": f"""with recursive {POSTERIOR}, {LATCH}, g as (select track, frame, frame - row_number() over (partition by track order by frame) g from latch where speech) select track, min(frame) "start", count(*) length from g group by track, g""",
    "voice_gain": f"with recursive {POSTERIOR}, {GAIN} select track, frame, round(g, 5) gain from gain",
    "stream_voice": f"with recursive {POSTERIOR}, {LATCH}, {GAIN} select track, frame, speech is_speech, round(g, 5) gain from latch join gain using (track, frame)",
    "escalated_segments": f"""with {SIGNAL}, q as (select *, idx - lag(idx) over (partition by track order by idx) > 2 fresh from signal where abs(x) >= 1.2), g as (select *, sum(case when fresh then 1 else 0 end) over (partition by track order by idx) g from q),
 seg as (select track, min(idx) a, max(idx) b from g group by track, g), wide as (select *, greatest(a - 3, 0) low, b + 3 high from seg), cut as (select *, coalesce(low > max(high) over (partition by track order by low rows between unbounded preceding and 1 preceding) + 1, true) fresh from wide),
 reg as (select *, sum(fresh::int) over (partition by track order by low) k from cut), area as (select track, k, min(low) low, max(high) high from reg group by 1, 2), mean as (select a.track, k, avg(x) m from area a join signal s on s.track = a.track and s.idx between low and high group by 1, 2),
 hit as (select s.track, s.idx, m from reg join mean using (track, k) join signal s on s.track = reg.track and s.idx between a and b)
 select track, idx, round(x - coalesce(m, 0), 9) x from signal left join hit using (track, idx)""",
}
