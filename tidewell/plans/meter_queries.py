"""Queries over weighted levels: filters as scans over blocks, gates, and their oracles by recursion in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tidewell.operators import banks as K, levels as L, lines as N, recurrences as R, spectral as P, standard as S
from tidewell.streaming import health as monitor
from tidewell.streaming.beats import PROVIDER

from .level_queries import ORACLE as LEVEL_ORACLE, _db
from .transform_queries import _finished, _folder
from .views import SIGNAL, rounded, signal

HOP, SIZE = 2, 6  # a track has some 66 samples: about eleven blocks


def _six(s: DataFrame) -> DataFrame:
    """Six channels out of the view's four values."""
    return s.select("track", "idx", "l", "r", (F.col("c") - 0.45).alias("c"), F.col("x").alias("lfe"), (F.col("l") * F.col("c")).alias("ls"), (F.col("r") * 0.5).alias("rs"))


SIX = {"l": "l", "r": "r", "c": "c - 0.45", "ls": "l * c", "rs": "r * 0.5"}


def _recursion(parts: R.Sections | list) -> str:
    """``wave(track, ch, idx, v)`` filtered sample by sample: the transposed direct form as a recursive table.

    A coefficient is a number or the name of a column of ``wave``.
    """
    num = lambda c: c if isinstance(c, str) else f"{c!r}::double"
    y, start, step = "v", [], []
    for i, (b, a) in enumerate(parts):
        out = f"({num(b[0])} * ({y}) + {{p{i}}})"
        step.append((f"{num(b[1])} * ({y}) - {num(a[1])} * {out} + {{q{i}}}", f"{num(b[2])} * ({y}) - {num(a[2])} * {out}"))
        y = out
    names = [f"{x}{i}" for i in range(len(parts)) for x in "pq"]
    fill = lambda text, old: text.format(**{n: (f"f.{n}" if old else "0.0::double") for n in names})
    states = lambda old: ", ".join(f"{fill(text, old)} {n}" for n, text in zip(names, [t for pair in step for t in pair]))
    return f"""f(track, ch, idx, y, {', '.join(names)}) as (select track, ch, idx, {fill(y, False)} y, {states(False)} from wave where idx = 0
 union all select w.track, w.ch, w.idx, {fill(y, True)}, {states(True)} from f join wave w on w.track = f.track and w.ch = f.ch and w.idx = f.idx + 1)"""


def _wave(channels: dict[str, str]) -> str:
    return "wave as materialized (" + " union all ".join(f"select track, '{name}' ch, idx, {value} v from signal" for name, value in channels.items()) + ")"


def _loudness(channels: dict[str, str], weights: dict[str, float], hop: int, per: int = 4) -> str:
    weight = " ".join(f"when '{c}' then {weights[c]!r}" for c in channels)
    return f"""with recursive {SIGNAL}, {_wave(channels)}, {_recursion(P.K_WEIGHTING)},
 hops as (select track, idx // {hop} hop, sum(y * y * case ch {weight} end) s, count(*) n from f group by 1, 2 having count(*) = {hop * len(channels)}),
 near as (select track, sum(s) over w / {hop * per} z, count(*) over w k from hops window w as (partition by track order by hop rows between {per - 1} preceding and current row)),
 one as (select track, z, avg(z) over (partition by track) m from near where k = {per} and -0.691 + {_db('z')} >= -70),
 two as (select track, avg(z) p, count(*) kept from one where -0.691 + {_db('z')} >= -0.691 + {_db('m')} - 10 group by 1),
 every as (select track, count(case when k = {per} then 1 end) windows from near group by 1)
 select track, round(case when kept > 0 then -0.691 + {_db('p')} when windows > 0 then -144.0 end, 6) level_db, windows, coalesce(kept, 0) kept from every left join two using (track)"""


def loudness_stereo(spark: SparkSession, d: str) -> DataFrame:
    """Integrated loudness of two channels, weighted and gated."""
    return rounded(R.loudness(signal(spark, d), P.K_WEIGHTING, R.STEREO, HOP, SIZE))


def loudness_surround(spark: SparkSession, d: str) -> DataFrame:
    """Integrated loudness of six channels, of which one is not heard and two weigh more."""
    return rounded(R.loudness(_six(signal(spark, d)), P.K_WEIGHTING, R.SURROUND, HOP, SIZE))


def weighted_level(spark: SparkSession, d: str) -> DataFrame:
    """Mean power of each track behind the weighting filter."""
    hops = R.hop_powers(R.B.blocks(signal(spark, d), SIZE), SIZE, P.K_WEIGHTING, 1, {"x": 1.0})
    return rounded(hops.groupBy("track").agg(F.avg("power").alias("power")))


RATE, TAPS, REACH, QUIET = 8, 4, 20, -6.5  # rate of the result, the resampler's reach, block size, what counts as quiet


def _standard(spark: SparkSession, d: str) -> DataFrame:
    """The view's channels as tracks of three rates."""
    rate = F.element_at(F.array(F.lit(6), F.lit(8), F.lit(12)), (F.col("track") % 3 + 1).cast("int"))
    return S.standardized(signal(spark, d).withColumn("rate", rate), ["l", "r", "c"], RATE, REACH, TAPS)


STANDARD = f"""rated as (select track, idx, (l + c) / 2 a, r b, case track % 3 when 0 then 6 when 1 then 8 else 12 end rate from signal),
 ends as (select track, rate, count(*) n from rated group by 1, 2),
 outs as (select track, rate, unnest(range((n * {RATE} + rate - 1) // rate)) j from ends),
 near as (select track, rate, j, j * rate // {RATE} + k as idx, (j * rate % {RATE}) / {RATE}.0::double - k as away, least(1.0::double, {RATE}.0::double / rate) cut from outs cross join range({1 - TAPS}, {TAPS + 1}) t(k) where rate <> {RATE} or k = 0),
 weight as (select *, case when rate = {RATE} then 1 else cut * case when away = 0 then 1 else sin(pi() * cut * away) / (pi() * cut * away) end * (0.5 + 0.5 * cos(pi() * greatest(least(away / {TAPS}, 1), -1))) end w from near),
 standard as materialized (select track, j, greatest(least(coalesce(sum(a * w), 0), 1), -1)::float::double l, greatest(least(coalesce(sum(b * w), 0), 1), -1)::float::double r from weight left join rated using (track, idx) group by 1, 2)"""
SECONDS = f"""secs as (select track, j // {RATE} as win, sum(l * l + r * r) / 2 p, count(*) n from standard group by 1, 2),
 lev as (select *, n = {RATE} as whole, case when p > 0 then 10 * log10(p / n) end db from secs),
 runs as (select track, win, win - row_number() over (partition by track order by win) g from lev where whole and coalesce(db < {QUIET}, true)),
 gap as (select track, min(win) "start", count(*) length from runs group by track, g having count(*) >= 2)"""


def standardized_samples(spark: SparkSession, d: str) -> DataFrame:
    """Three channels of three rates as two channels of one."""
    out = rounded(S.samples(_standard(spark, d)), 5)
    return out.select("track", "idx", *(F.when(F.col(c) == 0, 0.0).otherwise(F.col(c)).alias(c) for c in "lr"))  # no negative zero


def standardized_digests(spark: SparkSession, d: str) -> DataFrame:
    """Length and composed hash of every standardized track."""
    return S.digests(_standard(spark, d))


RULES = {"quiet_db": QUIET, "least": 2, "early": 3, "digital_db": -7.0, "silent_db": -6.2, "target_db": 14.0, "most_gain_db": 20.5}


def stream_health(spark: SparkSession, d: str) -> DataFrame:
    """The monitor over the same blocks as a stream: gaps and final verdicts."""
    root = _folder(spark)
    ends = signal(spark, d).groupBy("track").agg(F.floor(F.max("idx") / REACH).alias("end"), F.max("ts").cast("timestamp").alias("ts"))
    fed = _standard(spark, d).join(ends, "track").select("track", "seq", "ts", "windows", (F.col("seq") == F.col("end")).alias("last"))
    fed.write.parquet(f"{root}/in")
    before = spark.conf.get(PROVIDER[0])
    spark.conf.set(*PROVIDER)
    try:
        stream = spark.readStream.schema(spark.read.parquet(f"{root}/in").schema).parquet(f"{root}/in")
        found = monitor.health(stream, RATE, **RULES)
        _finished(found.writeStream.outputMode("append").option("checkpointLocation", f"{root}/at").format("parquet").option("path", f"{root}/out"))
    finally:
        spark.conf.set(PROVIDER[0], before)
    return rounded(spark.read.schema(monitor.RESULT).parquet(f"{root}/out").filter("kind <> 'early'"), 5)


def signal_health(spark: SparkSession, d: str) -> DataFrame:
    """Levels, verdict and dead air of every standardized track."""
    return rounded(S.health(S.seconds(_standard(spark, d), RATE), **RULES), 5)


def dead_air(spark: SparkSession, d: str) -> DataFrame:
    """Runs of quiet windows in every standardized track."""
    return S.dead_air(S.seconds(_standard(spark, d), RATE), QUIET, 2)


BAND_RATE, BAND_EDGES = 100.0, (1.0, 3.0, 6.0, 10.0, 15.0, 20.0, 30.0, 45.0, 60.0)
BANKS = {"edges": [(f"b{i}", f) for i, f in enumerate(K.band_filters(BAND_RATE, BAND_EDGES))], "three": [(name, f) for name, (_, f) in K.three_bands(BAND_RATE, 5.0, 20.0).items()]}
NONE = ((1.0, 0.0, 0.0), (1.0, 0.0, 0.0))


def _bank(which: str, channels: list[str]) -> str:
    """The view's channels through every filter of a bank: ``f(track, ch, idx, y)``, ch being band and channel."""
    names = [f"k{i}" for i in range(20)]
    rows = []
    for band, parts in BANKS[which]:
        numbers = [v for b, a in (*parts, *[NONE] * (4 - len(parts))) for v in (*b, *a[1:])]
        rows.append(f"('{band}', {', '.join(f'{v!r}::double' for v in numbers)})")
    sections = [(names[5 * i : 5 * i + 3], [1.0, *names[5 * i + 3 : 5 * i + 5]]) for i in range(4)]
    values = " union all ".join(f"select track, '{c}' c, idx, {c} v from signal" for c in channels)
    return f"coefs(band, {', '.join(names)}) as (values {', '.join(rows)}), wave as materialized (select track, band || '_' || c ch, idx, v, {', '.join(names)} from ({values}) cross join coefs), {_recursion(sections)}"


def band_profile(spark: SparkSession, d: str) -> DataFrame:
    """Eight bands' levels and their slope."""
    p = K.profile(signal(spark, d), BAND_RATE, ("l", "r"), BAND_EDGES, SIZE)
    return rounded(p.select("track", *(F.element_at("levels", i + 1).alias(f"b{i}") for i in range(8)), K.slope(F.col("levels"), BAND_EDGES).alias("slope")))


def three_bands(spark: SparkSession, d: str) -> DataFrame:
    """Levels of the three parts of a crossover."""
    return rounded(K.band_levels(signal(spark, d), K.three_bands(BAND_RATE, 5.0, 20.0), SIZE))


def profile_zones(spark: SparkSession, d: str) -> DataFrame:
    """Zones of every track, from its profile, crest, range and correlation."""
    s = signal(spark, d)
    p = K.profile(s, BAND_RATE, ("l", "r"), BAND_EDGES, SIZE)
    both = s.groupBy("track").agg((F.sum(F.col("l") * F.col("r")) / F.sqrt(F.sum(F.col("l") * F.col("l")) * F.sum(F.col("r") * F.col("r")))).alias("correlation"))
    told = p.join(L.level_stats(s).select("track", "crest_db"), "track").join(L.level_range(s, 2, 4, False, "floor_n"), "track", "left").join(both, "track")
    return told.select("track", *K.zones(F.col("levels"), F.col("crest_db"), F.col("range_db"), F.col("correlation")))


LINE = {"rate": 100.0, "low": 5.0, "high": 20.0, "cutoff": 20.0, "decimate": 2, "length": 32}


def band_peak(spark: SparkSession, d: str) -> DataFrame:
    """The most prominent line of every track between 5 and 20 Hz."""
    return rounded(N.band_peak(signal(spark, d), size=7, **LINE), 5)


def _line(rate: float, low: float, high: float, cutoff: float, decimate: int, length: int) -> str:
    bin_hz = rate / decimate / length
    parts = R.sections(P.biquad("lowpass", rate, cutoff, 0.5**0.5)) * 2
    half, first, last = length // 2, max(int(low / bin_hz + 0.5), 1), min(int(high / bin_hz + 0.5), length // 2 - 1)
    return f"""with recursive {SIGNAL}, {_wave({'x': 'x'})}, {_recursion(parts)}, thin as (select track, idx // {decimate} i, y from f where idx % {decimate} = 0 and idx < {decimate * length}),
 long as (select track, count(*) n from thin group by 1), win as (select track, i, y, case when n > 1 then 0.5 - 0.5 * cos(2 * pi() * i / (n - 1)) else 1 end w from thin join long using (track)),
 dft as (select track, k, sum(y * w * cos(2 * pi() * i * k / {length})) re, sum(y * w * sin(2 * pi() * i * k / {length})) im, greatest(sum(w * w), 1e-30) e from win cross join range({half + 1}) t(k) group by 1, 2),
 pow as (select track, k, case when k = 0 or k = {half} then 1 else 2 end * (re * re + im * im) / e p from dft), psd as materialized (select track, k, case when p < 1e-30 then -300 else 10 * log10(p) end v from pow),
 best as (select track, arg_max(k, v) k from psd where k between {first} and {last} group by 1), top as (select b.track, b.k, b0.v a, b1.v b, b2.v c from best b join psd b0 on b0.track = b.track and b0.k = b.k - 1 join psd b1 on b1.track = b.track and b1.k = b.k join psd b2 on b2.track = b.track and b2.k = b.k + 1),
 near as (select b.track, list_sort(list(p.v)) v from best b join psd p on p.track = b.track and abs(p.k - b.k) <= {int(N.SPAN / bin_hz)} and abs(p.k - b.k) > {int(N.SKIP / bin_hz)} group by 1)
 select track, round((k + case when abs(a - 2 * b + c) > 1e-9 then 0.5 * (a - c) / (a - 2 * b + c) else 0 end) * {bin_hz!r}::double, 5) hz, round(b - v[len(v) // 2 + 1], 5) prominence_db from top join near using (track)"""


LEVELS8 = f"""pow8 as (select track, ch[2]::int band, sum(y * y) p, count(*) n from f group by 1, 2), lev8 as (select track, band, case when sqrt(p / n) > 1e-20 then 20 * log10(sqrt(p / n)) else -144 end db from pow8),
 wide as (select track, {', '.join(f'max(db) filter (band = {i}) b{i}' for i in range(8))} from lev8 group by 1)"""
CENTRES = ", ".join(f"({i}, log10(sqrt({BAND_EDGES[i]!r} * {BAND_EDGES[i + 1]!r})), 10 * log10({BAND_EDGES[i + 1] - BAND_EDGES[i]!r}))" for i in range(1, 7))
QUERIES = {f.__name__: f for f in (loudness_stereo, loudness_surround, weighted_level, standardized_samples, standardized_digests, signal_health, dead_air, band_profile, three_bands, profile_zones, band_peak, stream_health)}
ORACLE = {
    "band_profile": f"""with recursive {SIGNAL}, {_bank('edges', ['l', 'r'])}, {LEVELS8}, centre(band, x, w) as (values {CENTRES}), fit as (select track, regr_slope((db - w) / 20, x) slope from lev8 join centre using (band) group by 1)
 select track, {', '.join(f'round(b{i}, 6) b{i}' for i in range(8))}, round(slope, 6) slope from wide join fit using (track)""",
    "three_bands": f"""with recursive {SIGNAL}, {_bank('three', ['x'])}, e as (select track, ch, 20 * log10(sqrt(avg(y * y))) db from f group by 1, 2)
 select track, {', '.join(f"round(max(db) filter (ch = '{n}_x'), 6) {n}" for n in ('low', 'mid', 'high'))} from e group by 1""",
    "band_peak": _line(**LINE),
    "profile_zones": f"""with recursive {SIGNAL}, {_bank('edges', ['l', 'r'])}, {LEVELS8}, crest as ({LEVEL_ORACLE['level_stats']}), span as ({LEVEL_ORACLE['level_range_short']}), corr as (select track, sum(l * r) / sqrt(sum(l * l) * sum(r * r)) c from signal group by 1)
 select track, coalesce(b5 > -18 and crest_db < 8, false) zone_cymbal_harsh, coalesce(b0 > -30, false) zone_sub_rumble, coalesce(b2 > -20 and range_db < 5, false) zone_boxiness, coalesce(c < 0.3, false) zone_phase_issue, false zone_harsh_resonance
 from wide left join crest using (track) left join span using (track) left join corr using (track)""",
    "loudness_stereo": _loudness({"l": "l", "r": "r"}, R.STEREO, HOP),
    "loudness_surround": _loudness(SIX, R.SURROUND, HOP),
    "weighted_level": f"with recursive {SIGNAL}, {_wave({'x': 'x'})}, {_recursion(P.K_WEIGHTING)} select track, round(avg(y * y), 6) power from f group by 1",
    "standardized_samples": f"with {SIGNAL}, {STANDARD} select track, j idx, case when round(l, 5) = 0 then 0 else round(l, 5) end l, case when round(r, 5) = 0 then 0 else round(r, 5) end r from standard",
    "dead_air": f'with {SIGNAL}, {STANDARD}, {SECONDS} select track, "start", length from gap',
    "signal_health": f"""with {SIGNAL}, {STANDARD}, {SECONDS}, a as (select track, sum(n)::bigint n, case when sum(p) > 0 then 10 * log10(sum(p) / sum(n)) end level_db, case when sum(p) filter (win < 3) > 0 then 10 * log10(sum(p) filter (win < 3) / sum(n) filter (win < 3)) end early_db, min(db) filter (whole and db >= {QUIET}) least_loud_db from lev group by 1),
 g as (select track, count(*) gaps, sum(length)::bigint gap_windows, max(length) longest_gap from gap group by 1)
 select track, n, round(level_db, 5) level_db, round(early_db, 5) early_db, round(least_loud_db, 5) least_loud_db, case when coalesce(early_db < -7, true) then 'dead' when coalesce(level_db < -6.2, true) then 'silent' when 14 - (level_db - 1) > 20.5 then 'faint' else 'ok' end verdict,
 coalesce(gaps, 0) gaps, coalesce(gap_windows, 0) gap_windows, coalesce(longest_gap, 0) longest_gap from a left join g using (track)""",
}

ORACLE["stream_health"] = f"""select track, 'final' kind, verdict, n, level_db, early_db, least_loud_db, gaps, gap_windows, longest_gap, null::bigint "start", null::bigint length from ({ORACLE['signal_health']})
 union all select track, 'gap', null, null, null, null, null, null, null, null, "start", length from ({ORACLE['dead_air']})"""
