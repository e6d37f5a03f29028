"""Beats and onset strength: against plain loops, at any block size, and the stream against the batch."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidewell.operators import beats as T, onsets as O
from tidewell.operators.spectral import hann
from tidewell.streaming import beats as stream_form

from .test_blocks import frame, noise

RATE, HOP = 1000, 20


def clicks(step, n, seed=0):
    """A click every ``step`` samples in faint noise."""
    x = 0.01 * noise(n, seed=seed)[0]
    for at in range(step, n - 10, step):
        x[at : at + 10] += 0.8
    return x[None]


def by_loop(x, rate, hop, ahead):
    """(flux, transients, step, beats) of one track."""
    whole = len(x) // hop
    p = [(x[i * hop : (i + 1) * hop] ** 2).sum() for i in range(whole)]
    rms = [np.sqrt((a + b) / (2 * hop)) for a, b in zip(p, p[1:])]
    flux = np.array([max(b - a, 0) for a, b in zip([0.0, *rms], rms)])
    half, found = T.reach(rate, hop), []
    for i in range(1, len(flux) - 1):
        near = flux[max(i - half, 0) : i + ahead + 1]
        if flux[i] > flux[i - 1] and flux[i] > flux[i + 1] and flux[i] > near.mean() + 1.5 * near.std() and flux[i] > 1e-4:
            found.append((i, (i * hop + hop) * 1000 // rate))
    gaps = [(b - a) // 10 for (_, a), (_, b) in zip(found, found[1:])]
    fits = [g for g in gaps if 30 <= g <= 100]
    step = 10 * min(set(fits), key=lambda g: (-fits.count(g), g)) if fits else 0
    beats = list(range(found[0][1], len(x) * 1000 // rate, step)) if step else []
    return flux, found, step, beats


TRACKS = {1: clicks(500, 9000), 2: clicks(730, 8010, 1), 3: noise(3000, seed=5), 4: np.zeros((1, 500)), 5: noise(HOP + 3), 6: np.full((1, 200), np.nan)}


@pytest.mark.parametrize("late", [False, True])
def test_beats_equal_loops(spark, late):
    half = T.reach(RATE, HOP)
    flux = T.energy_flux(frame(spark, TRACKS), HOP)
    hit = T.transients(flux, RATE, HOP, half if late else None)
    found = {t: sorted((r.frame, r.ms) for r in rows) for t, rows in pd.Series(hit.collect()).groupby(lambda i, h=hit.collect(): h[i].track)} if hit.count() else {}
    beat = {r.track: r for r in T.tempo(hit).collect()}
    grid = T.grid(T.tempo(hit), RATE).toPandas()
    for t, x in TRACKS.items():
        clean = np.where(np.isfinite(x[0]), x[0], 0)
        want_flux, want, step, beats = by_loop(clean, RATE, HOP, half if late else half - 1)
        got = [r.flux for r in flux.filter(F.col("track") == t).filter("frame is not null").orderBy("frame").collect()]
        assert np.allclose(got, want_flux) and found.get(t, []) == want
        assert (beat[t].step_ms or 0 if t in beat else 0) == step
        mine = grid[grid.track == t].sort_values("beat")
        assert mine["ms"].tolist() == beats and mine["downbeat"].tolist() == [i % 4 == 0 for i in range(len(beats))]
    assert beat[1].step_ms == 500 and len(grid[grid.track == 1]) >= 16


def rows_of(t, x):
    """What the stream has to say about a track."""
    _, found, step, beats = by_loop(np.where(np.isfinite(x), x, 0), RATE, HOP, T.reach(RATE, HOP))
    out = [(t, "transient", i, ms, None) for i, ms in found] + [(t, "tempo", len(x), step, 60_000 / step if step else 0.0)]
    return sorted(out + [(t, "beat" if i % 4 else "downbeat", i, ms, None) for i, ms in enumerate(beats)], key=str)


def test_detector_does_not_depend_on_chunks():
    for t, x in TRACKS.items():
        for seed in range(3):
            cuts = np.sort(np.random.default_rng(seed).integers(0, x.shape[1], 12))
            d, state, out = None, None, []
            for part in np.split(x[0], cuts):
                d = stream_form.Detector(RATE, HOP, state)
                d.feed(part)
                out += d.out
                state = tuple(d.s.values())
                assert len(d.s["flux"]) <= 2 * d.reach + 1
            d.out = []
            d.finish()
            assert sorted(((t, *row) for row in out + d.out), key=str) == rows_of(t, x[0])


def test_stream_of_several_batches(spark, tmp_path):
    """A track with an end, one that falls silent and is ended by the timer, and blocks that come twice."""
    schema = "track long, seq long, ts timestamp, x array<double>, last boolean"
    parts = {t: np.split(TRACKS[t][0], [1500, 3100, 5000]) for t in (1, 2)}
    at = lambda hour: pd.Timestamp(2024, 1, 1, hour)
    batches = [
        [(1, 0, at(0), parts[1][0]), (2, 0, at(0), parts[2][0]), (2, 1, at(0), parts[2][1])],
        [(1, 1, at(1), parts[1][1]), (1, 0, at(1), parts[1][0])],
        [(1, 2, at(3), parts[1][2])],
        [(1, 3, at(5), parts[1][3])],
        [(1, 4, at(6), parts[1][3])],
    ]
    for i, rows in enumerate(batches):
        data = [(t, seq, ts.to_pydatetime(), x.tolist(), t == 1 and seq == 3) for t, seq, ts, x in rows]
        spark.createDataFrame(data, schema).coalesce(1).write.parquet(f"{tmp_path}/in/{i}")
    before = spark.conf.get(stream_form.PROVIDER[0])
    spark.conf.set(*stream_form.PROVIDER)
    try:
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(f"{tmp_path}/in")
        q = stream_form.beats(stream, RATE, HOP, "1 second", 3_600_000).writeStream.outputMode("append").option("checkpointLocation", f"{tmp_path}/at").format("parquet").option("path", f"{tmp_path}/out").trigger(availableNow=True).start()
        assert q.awaitTermination(240)
    finally:
        spark.conf.set(stream_form.PROVIDER[0], before)
    got = sorted(map(tuple, spark.read.schema(stream_form.RESULT).parquet(f"{tmp_path}/out").collect()), key=str)
    silent = np.concatenate(parts[2][:2])
    assert got == sorted(rows_of(1, TRACKS[1][0]) + rows_of(2, silent), key=str)


def test_mel_bands_are_the_known_ones():
    """The first weights of 24 bands of 2048 samples at 48 kHz."""
    first = O.mel_bands(24, 2048, 48_000)[0]
    assert np.allclose(first[1:5], [8.792566e-04, 1.758513e-03, 2.637770e-03, 3.517026e-03], atol=1e-9) and first[0] == 0


@pytest.mark.parametrize("block", [32, 50, 64, 1000])
def test_onset_strength_does_not_depend_on_blocks(spark, block):
    tracks = {1: noise(501), 2: noise(64, seed=2), 3: noise(31, seed=3), 4: noise(32, seed=4)}
    size, hop, bands = 32, 8, 7
    got = O.superflux(frame(spark, tracks), 1000, size, hop, bands, block=block).toPandas()
    weights = O.mel_bands(bands, size, 1000)
    for t, x in tracks.items():
        many = max((x.shape[1] - size) // hop + 1, 0)
        want, ref = [], np.zeros(bands)
        for i in range(many):
            now = np.log(1 + 10 * weights @ np.abs(np.fft.rfft(x[0, i * hop : i * hop + size] * hann(size))))
            want.append(np.maximum(now - ref, 0).mean())
            ref = np.array([max(now[max(b - 1, 0) : b + 2]) for b in range(bands)])
        mine = got[got.track == t].sort_values("frame")
        assert mine["frame"].tolist() == list(range(many)) and np.allclose(mine["strength"], want)


def test_stream_processor_takes_rows_as_they_are():
    from pyspark.sql import Row

    from tests.test_health_stream import Handle
    from tidewell.streaming import beats as stream

    blocks = [Row(seq=i, at=1000 * i, x=[0.0, 0.5, -0.5, 0.25] * 8, last=i == 2) for i in range(3)]

    def run(parts):
        h, p, out = Handle(), stream.BeatProcessor(100, 4, 500), []
        p.init(h)
        for part in parts:
            out += list(p.handleInputRows((7,), iter(part), h))
        assert not h.timers
        return out, h.asked

    whole, asked = run([blocks[::-1]])
    assert not asked and [(x.kind, x.place) for x in whole if x.kind == "tempo"] == [("tempo", 96)]
    assert run([blocks[:1], blocks[:2], blocks[2:], blocks])[0] == whole
