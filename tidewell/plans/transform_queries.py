"""Queries over transforms of whole tracks, and the streaming twins run over the same samples."""

from __future__ import annotations

import uuid

import numpy as np
from pyspark.sql import DataFrame, SparkSession, functions as F

from tidewell.operators import convolutive as C, onsets as O, spectral as P
from tidewell.sources.storage import checkpoints
from tidewell.streaming import twins

from .level_queries import _db, _sliding
from .views import SIGNAL, rounded, signal

SIZE, HOP, RATE = 16, 4, 1000.0


def _one(name: str, f, schema: str):
    return lambda spark, d: rounded(P.per_track(signal(spark, d), f, schema))


def _mfcc(x: np.ndarray) -> dict:
    m = P.mfcc(x, SIZE, HOP, RATE, 8, 5)
    return {"coefficient": np.arange(5), "mean": m.mean(axis=0), "std": m.std(axis=0)}


def _onsets(x: np.ndarray) -> dict:
    f = P.flux(x, SIZE, HOP)
    at = [i for i in range(1, len(f) - 1) if f[i] >= 0.5 and f[i] > f[i - 1] and f[i] > f[i + 1]]
    return {"frame": at, "flux": f[at] if at else []}


def _layers(x: np.ndarray) -> dict:
    z = P.stft(x, SIZE, HOP)
    h, p = P.hpss(np.abs(z), 2)
    parts = [P.istft(z * m, SIZE, HOP, len(x)) for m in (h, p, 1 - h - p)]
    return {"harmonic": [float((parts[0] ** 2).mean())], "percussive": [float((parts[1] ** 2).mean())], "whole": [float((P.istft(z, SIZE, HOP, len(x)) ** 2).mean())]}


def _components(x: np.ndarray) -> dict:
    v = np.abs(P.stft(x, SIZE, HOP)).T
    w, h = P.nmf(v, 3)
    return {"component": np.arange(3), "energy": h.sum(axis=1), "centroid": (w * np.arange(len(w))[:, None]).sum(axis=0) / (w.sum(axis=0) + 1e-12)}


def _chain(x: np.ndarray) -> dict:
    y = P.chain(x, [("gain", {"gain": 1.2}), ("biquad", {"kind": "highpass", "rate": RATE, "f0": 20.0, "q": 0.707}), ("compressor", {"threshold_db": -12.0, "ratio": 3.0, "knee_db": 6.0, "attack": 0.5, "release": 0.1}), ("limiter", {"ceiling": 0.8, "ahead": 4, "release": 0.2})])
    return {"peak": [float(np.abs(y).max())], "power": [float((y * y).mean())]}


def _bands(x: np.ndarray) -> dict:
    m = np.abs(P.stft(x, SIZE, HOP)) ** 2
    return {"band": np.arange(m.shape[1]), "energy": m.mean(axis=0)}


QUERIES = {
    "spectral_descriptors": _one("d", lambda x: P.descriptors(x, SIZE, HOP, RATE), "centroid double, flatness double, crest double"),
    "band_energy": _one("b", _bands, "band long, energy double"),
    "flux_onsets": _one("f", _onsets, "frame long, flux double"),
    "mfcc_statistics": _one("m", _mfcc, "coefficient long, mean double, std double"),
    "true_peak": _one("t", lambda x: {"true_peak": [P.true_peak(x)], "peak": [float(np.abs(x).max())]}, "true_peak double, peak double"),
    "resampled": _one("r", lambda x: {"idx": np.arange(int(len(x) * 1.5)), "x": P.resampled(x, 2, 3, 8)}, "idx long, x double"),
    "harmonic_percussive": _one("h", _layers, "harmonic double, percussive double, whole double"),
    "components_nmf": _one("n", _components, "component long, energy double, centroid double"),
    "node_chain": _one("c", _chain, "peak double, power double"),
}


def superflux(spark: SparkSession, d: str) -> DataFrame:
    """Onset strength of every frame over blocks of twenty samples."""
    return rounded(O.superflux(signal(spark, d), RATE, SIZE, HOP, 6, block=20))


QUERIES["superflux"] = superflux


COMPONENTS, REACH, ROUNDS = 3, 3, 2


def convolutive_patterns(spark: SparkSession, d: str) -> DataFrame:
    """Patterns in time that all tracks' spectrograms share."""
    w, _, _ = C.factorised(C.spectrograms(signal(spark, d), SIZE, HOP), SIZE // 2 + 1, COMPONENTS, REACH, ROUNDS, seed=1)
    return rounded(spark.createDataFrame([(t, b, k, float(x)) for (t, b, k), x in np.ndenumerate(w)], "t long, bin long, component long, weight double"))


def pattern_activations(spark: SparkSession, d: str) -> DataFrame:
    """How much of each pattern a track has, the first two being given."""
    given = C.first_guess(SIZE // 2 + 1, 2, REACH, None, 5)
    _, fit, _ = C.factorised(C.spectrograms(signal(spark, d), SIZE, HOP), SIZE // 2 + 1, COMPONENTS, REACH, ROUNDS, given, seed=1)
    part = lambda k: F.aggregate(F.slice("h", F.lit(k) * F.col("n") + 1, F.col("n")), F.lit(0.0), lambda a, x: a + x)
    return rounded(fit.select("track", F.posexplode(F.array(*(part(k) for k in range(COMPONENTS)))).alias("component", "activation"), "cost"), 5)


QUERIES |= {"convolutive_patterns": convolutive_patterns, "pattern_activations": pattern_activations}


def _table(name: str, columns: str, rows: np.ndarray) -> str:
    """A matrix as a table (row, column, value)."""
    values = ", ".join(f"({i}, {j}, {v!r}::double)" for i, row in enumerate(rows.tolist()) for j, v in enumerate(row))
    return f"{name}({columns}) as (values {values})"


def _spectrum(centre: bool) -> str:
    """``mag(track, frame, bin, m)``: the discrete Fourier transform of windowed frames, by its definition."""
    count = f"n // {HOP} + 1" if centre else f"(greatest(n, {SIZE}) - {SIZE}) // {HOP} + 1"
    wave = np.arange(SIZE) * np.arange(SIZE // 2 + 1)[:, None] * 2 * np.pi / SIZE
    both = np.concatenate([np.cos(wave), -np.sin(wave)]) * P.hann(SIZE)
    return f"""{_table('wave', 'part, k, w', both)}, long as (select track, count(*) n from signal group by 1),
 spot as (select track, frame, frame * {HOP} - {SIZE // 2 if centre else 0} + k as idx, k from (select track, unnest(range({count})) frame from long) cross join range({SIZE}) t(k)),
 parts as (select track, frame, part, sum(coalesce(x, 0) * w) v from spot left join signal using (track, idx) join wave using (k) group by 1, 2, 3),
 mag as materialized (select track, frame, part % {SIZE // 2 + 1} as bin, sqrt(sum(v * v)) m from parts group by 1, 2, 3)"""


def _sinc(x: str) -> str:
    return f"case when {x} = 0 then 1.0::double else sin(pi() * {x}) / (pi() * {x}) end"


FLUX = "rise as (select track, frame, sum(greatest(m - before, 0)) r from (select *, lag(m) over (partition by track, bin order by frame) before from mag) group by 1, 2), f as (select track, frame, coalesce(r, 0) / max(r) over (partition by track) v from rise)"
def _patterns(frozen: int, guess: np.ndarray) -> str:
    """``w`` and ``h`` after the rounds, written out: ratio, patterns, activations."""
    eps = f"{C.EPS!r}::double"
    first = ", ".join(f"({t}, {b}, {k}, {float(v)!r}::double)" for (t, b, k), v in np.ndenumerate(guess))
    lam = "select c.track, c.frame, c.bin, c.v, sum(w.w * h.h) + {eps} lam from v c join w{i} w on w.bin = c.bin join h{i} h on h.track = c.track and h.k = w.k and h.frame = c.frame - w.t group by all"
    steps = [
        _spectrum(True), f"v as materialized (select track, frame, bin, m / ({eps} + sum(m) over (partition by track)) v from mag)", f"w0(t, bin, k, w) as (values {first})",
        f"h0 as materialized (select distinct track, frame, k, 1.0::double h from v cross join range({COMPONENTS}) t(k))", "many as (select track, max(frame) + 1 n from v group by 1)",
    ]
    for i in range(ROUNDS):
        steps += [
            f"q{i} as materialized (select *, v / (lam + {eps}) q from ({lam.format(i=i, eps=eps)}))",
            f"top{i} as (select t, k, bin, sum(q * h) top from q{i} q cross join range({REACH}) t(t) join h{i} h on h.track = q.track and h.frame = q.frame - t group by all)",
            f"low{i} as (select t, k, sum(h) low from h{i} join many using (track) cross join range({REACH}) t(t) where frame + t < n group by all)",
            f"w{i + 1} as materialized (select t, bin, k, case when k < {frozen} then w else w * coalesce(top, 0) / (coalesce(low, 0) + {eps}) end w from w{i} left join top{i} using (t, bin, k) left join low{i} using (t, k))",
            f"sum{i} as (select t, k, sum(w) s from w{i + 1} group by all), up{i} as (select q.track, q.frame - w.t frame, w.k, sum(w.w * q.q / (s + {eps})) u from q{i} q join w{i + 1} w on w.bin = q.bin join sum{i} s on s.t = w.t and s.k = w.k where q.frame >= w.t group by all)",
            f"h{i + 1} as materialized (select track, frame, k, h * coalesce(u, 0) / {REACH} h from h{i} left join up{i} using (track, frame, k))",
        ]
    steps.append(f"cost as (select track, avg(v * ln(1 + v / (lam + {eps})) - v + lam) cost from ({lam.format(i=ROUNDS, eps=eps)}) group by 1)")
    return f"with {SIGNAL}, {', '.join(steps)}"


ORACLE: dict[str, str] = {
    "convolutive_patterns": f"{_patterns(0, C.first_guess(SIZE // 2 + 1, COMPONENTS, REACH, None, 1))} select t, bin, k component, round(w, 6) weight from w{ROUNDS}",
    "pattern_activations": f"""{_patterns(2, C.first_guess(SIZE // 2 + 1, COMPONENTS, REACH, C.first_guess(SIZE // 2 + 1, 2, REACH, None, 5), 1))}
 select track, k::int component, round(sum(h), 5) activation, round(max(cost), 5) "cost" from h{ROUNDS} join cost using (track) group by 1, 2""",
    "band_energy": f"with {SIGNAL}, {_spectrum(True)} select track, bin band, round(avg(m * m), 6) energy from mag group by 1, 2",
    "spectral_descriptors": f"""with {SIGNAL}, {_spectrum(True)}, e as (select track, frame, sum(m * bin * {RATE / SIZE!r}::double) / sum(m) c, exp(avg(ln(m * m + 1e-20))) / avg(m * m + 1e-20) f, max(m) / avg(m) t from mag group by 1, 2 having sum(m) > 1e-10),
 every as (select distinct track from signal) select track, round(coalesce(avg(c), 1000), 6) centroid, round(coalesce(avg(f), 0.5), 6) flatness, round(coalesce(avg(t), 10), 6) crest from every left join e using (track) group by 1""",
    "flux_onsets": f"with {SIGNAL}, {_spectrum(True)}, {FLUX} select track, frame, round(v, 6) flux from (select *, lag(v) over w a, lead(v) over w b from f window w as (partition by track order by frame)) where v >= 0.5 and v > a and v > b",
    "mfcc_statistics": f"""with {SIGNAL}, {_spectrum(False)}, {_table('mel', 'band, bin, w', P.mel_filters(8, SIZE, RATE))}, {_table('turn', 'coefficient, band, c', np.cos(np.pi * np.arange(5)[:, None] * (np.arange(8) + 0.5) / 8))},
 e as (select track, frame, band, log10(greatest(sum(m * m * w), 1e-10)) e from mag join mel using (bin) group by 1, 2, 3), q as (select track, frame, coefficient, sum(e * c) q from e join turn using (band) group by 1, 2, 3)
 select track, coefficient, round(avg(q), 6) mean, round(stddev_pop(q), 6) std from q group by 1, 2""",
    "true_peak": f"""with {SIGNAL}, y as (select s.track, 4 * idx + k as j, sum(x * ({_sinc('(k / 4.0::double)')}) * (0.5 - 0.5 * cos(2 * pi() * (k + 49) / 98.0::double))) y from signal s cross join range(-48, 49) t(k) group by 1, 2),
 e as (select track, count(*) n, max(abs(x)) peak from signal group by 1) select track, round(greatest(max(abs(y)), max(peak)), 6) true_peak, round(max(peak), 6) peak from e join y using (track) where j between 0 and 4 * n - 1 group by 1""",
    "resampled": f"""with {SIGNAL}, long as (select track, count(*) n from signal group by 1), spot as (select track, j, j * 2 // 3 + k as idx, (j * 2) / 3.0::double - (j * 2 // 3 + k) d from (select track, unnest(range(n * 3 // 2)) j from long) cross join range(-7, 9) t(k))
 select track, j idx, round(coalesce(sum(x * ({_sinc('d')}) * (0.5 + 0.5 * cos(pi() * greatest(least(d / 8, 1), -1)))), 0), 6) x from spot left join signal using (track, idx) group by 1, 2""",
    "superflux": f"""with {SIGNAL}, {_spectrum(False)}, {_table('mel', 'band, bin, w', O.mel_bands(6, SIZE, RATE))}, fits as (select track from long where n >= {SIZE}),
 e as (select track, frame, band, ln(1 + 10 * sum(m * w)) e from mag join mel using (bin) semi join fits using (track) group by 1, 2, 3), wide as (select *, max(e) over (partition by track, frame order by band rows between 1 preceding and 1 following) top from e)
 select track, frame, round(avg(greatest(e - coalesce(before, 0), 0)), 6) strength from (select *, lag(top) over (partition by track, band order by frame) before from wide) group by 1, 2""",
}


def _finished(query) -> None:
    q = query.trigger(availableNow=True).start()
    try:
        q.awaitTermination()
    finally:
        q.stop()


def _folder(spark: SparkSession) -> str:
    checkpoints(spark)
    return f"{spark.sparkContext.getCheckpointDir().rstrip('/')}/stream-{uuid.uuid4().hex}"


def stream_windows(spark: SparkSession, d: str) -> DataFrame:
    """Tumbling day windows per state from a stream over the events."""
    root = _folder(spark)
    signal(spark, d).select("ts", "state", "x").withColumn("ts", F.col("ts").cast("timestamp")).write.parquet(f"{root}/in")
    stream = spark.readStream.schema(spark.read.parquet(f"{root}/in").schema).parquet(f"{root}/in")
    out = f"{root}/out"
    last = [-1]

    def batch(df: DataFrame, n: int) -> None:
        df.write.mode("overwrite").parquet(f"{out}/{n}")
        last[0] = n

    _finished(twins.windowed(stream, "1 hour", "1 day").writeStream.outputMode("complete").option("checkpointLocation", f"{root}/at").foreachBatch(batch))
    return rounded(spark.read.parquet(f"{out}/{last[0]}").withColumn("start", F.date_format("start", "yyyy-MM-dd")))


def stream_meter(spark: SparkSession, d: str) -> DataFrame:
    """The streaming meter over blocks of five samples; equal to the batch meters."""
    root = _folder(spark)
    s = signal(spark, d)
    b = s.groupBy("track", F.floor(F.col("idx") / 5).alias("seq")).agg(F.transform(F.array_sort(F.collect_list(F.struct("idx", "x"))), lambda v: v["x"]).alias("x"))
    ends = b.groupBy("track").agg(F.max("seq").alias("end"))
    b.join(ends, "track").select("track", "seq", "x", (F.col("seq") == F.col("end")).alias("last")).write.parquet(f"{root}/in")
    stream = spark.readStream.schema(spark.read.parquet(f"{root}/in").schema).parquet(f"{root}/in")
    _finished(twins.metered(stream, 2, 4, 0.3, 3).writeStream.outputMode("append").option("checkpointLocation", f"{root}/at").format("parquet").option("path", f"{root}/out"))
    return rounded(spark.read.schema(twins.RESULT).parquet(f"{root}/out"))


QUERIES |= {"stream_windows": stream_windows, "stream_meter": stream_meter}
ORACLE |= {
    "stream_windows": f"with {SIGNAL} select strftime(ts, '%Y-%m-%d') start, state, count(*) n, round(avg(x), 6) mean, round(max(x), 6) top from signal group by 1, 2",
    "stream_meter": f"""with {SIGNAL}, {_sliding(2, 4)}, z as (select *, -0.691 + {_db('z')} db from sliding), f as (select *, avg(z) over (partition by track) m from z where db >= -70), g as (select track, count(*) windows, -0.691 + {_db('avg(z)')} level_db from f where db >= -0.691 + {_db('m')} - 10 group by 1),
 i as (select *, idx - row_number() over (partition by track order by idx) g from signal where abs(x) >= 0.3), r as (select track, count(*) clip_runs from (select track, g from i group by 1, 2 having count(*) >= 3) group by 1), a as (select track, count(*) n, {_db('avg(x * x)')} rms_db, max(abs(x)) peak from signal group by 1)
 select track, n, round(rms_db, 6) rms_db, round(peak, 6) peak, coalesce(clip_runs, 0) clip_runs, coalesce(windows, 0) windows, round(level_db, 6) level_db from a left join g using (track) left join r using (track)""",
}
