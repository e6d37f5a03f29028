"""Banks, lines and convolutive patterns: reconstruction, known lines, and the updates of one track after the other."""

import numpy as np
import pytest

from tidewell.operators import banks as K, blocks as B, convolutive as C, lines as N, recurrences as R

from .test_blocks import frame, noise


@pytest.mark.parametrize("f0", [100.0, 1000.0, 9000.0])
def test_crossover_sums_to_an_all_pass(f0):
    impulse = np.zeros(1 << 15)
    impulse[0] = 1.0
    low, high = (R.filtered(parts, impulse) for parts in K.crossover(48_000, f0))
    assert np.allclose(np.abs(np.fft.rfft(low + high)), 1.0, atol=1e-3)
    at = round(f0 * len(impulse) / 48_000)
    assert 20 * np.log10(np.abs(np.fft.rfft(low))[at]) == pytest.approx(-6.02, abs=0.2)


def test_bank_of_named_voices(spark):
    x = noise(700)
    bank = K.three_bands(48_000, 200.0, 3000.0)
    out = R.filtered_blocks(B.blocks(frame(spark, {1: x}), 100), bank).orderBy("seq").toPandas()
    for name, (_, parts) in bank.items():
        assert np.allclose(np.concatenate(out[name].tolist()), R.filtered(parts, x[0]), atol=1e-9)


def test_profile_of_tones_and_slope(spark):
    t = np.arange(24_000) / 48_000
    tone = lambda f: np.stack([np.sin(2 * np.pi * f * t)] * 2)
    got = {r.track: list(r.levels) for r in K.profile(frame(spark, {f: tone(f) for f in (140, 1400, 5600)}, "lr"), 48_000, size=5_000).collect()}
    assert [int(np.argmax(got[f])) for f in (140, 1400, 5600)] == [1, 4, 6] and got[1400][4] > -3.5
    low = K.profile(frame(spark, {1: tone(140)}, "lr"), 8_000, size=5_000).first().levels
    assert low[7] == K.SILENCE_DB and low[6] == K.SILENCE_DB
    from pyspark.sql import functions as F

    bands = [-3.0 * i + 10 * float(np.log10(b - a)) for i, (a, b) in enumerate(zip(K.EDGES, K.EDGES[1:]))]
    x = np.log10(np.sqrt(np.array(K.EDGES[1:7]) * np.array(K.EDGES[2:8])))
    want = np.polyfit(x, -3.0 * np.arange(1, 7) / 20, 1)[0]
    row = spark.createDataFrame([(bands,)], "v array<double>").select(K.slope(F.col("v")).alias("s")).first()
    assert row.s == pytest.approx(want)


def test_zones_at_their_bounds(spark):
    from pyspark.sql import functions as F

    rows = [(1, [-30.0, 0.0, -20.0, 0.0, 0.0, -18.0, 0.0, 0.0], 7.0, 4.0, 0.3, [1999.0]), (2, [-29.9, 0.0, -19.0, 0.0, 0.0, -17.0, 0.0, 0.0], 7.9, 4.9, 0.29, [8000.0]), (3, [-29.9, 0.0, -19.0, 0.0, 0.0, -17.0, 0.0, 0.0], None, None, None, None)]
    df = spark.createDataFrame(rows, "id int, v array<double>, crest double, span double, corr double, peaks array<double>")
    got = {r.id: list(r)[1:] for r in df.select("id", *K.zones(F.col("v"), F.col("crest"), F.col("span"), F.col("corr"), F.col("peaks"))).collect()}
    assert got == {1: [False] * 5, 2: [True] * 5, 3: [False, True, False, False, False]}


def test_band_peak_finds_hum(spark):
    t = np.arange(96_000) / 48_000
    tracks = {50: 0.01 * np.sin(2 * np.pi * 50.3 * t) + 0.003 * noise(len(t))[0], 60: 0.01 * np.sin(2 * np.pi * 60 * t) + 0.003 * noise(len(t), seed=1)[0]}
    df = frame(spark, {k: x[None] for k, x in tracks.items()} | {1: noise(30)})
    got = {r.track: r for r in N.band_peak(df, 48_000, size=10_000).collect()}
    assert got[50].hz == pytest.approx(50.3, abs=0.05) and got[60].hz == pytest.approx(60, abs=0.05)
    assert got[50].prominence_db > 20 and got[1].hz is None
    again = {r.track: r for r in N.band_peak(df, 48_000, size=48_000).collect()}
    assert again[50].hz == pytest.approx(got[50].hz) and again[50].prominence_db == pytest.approx(got[50].prominence_db)
    assert N.band_peak(frame(spark, {1: noise(30)}).limit(0), 48_000).collect() == []


def by_loops(vs, w, rounds, frozen):
    """The updates for several tracks, entry by entry."""
    reach, bins, k = w.shape
    hs, eps = [np.ones((k, v.shape[1])) for v in vs], C.EPS
    for _ in range(rounds):
        qs = []
        for v, h in zip(vs, hs):
            lam = np.full(v.shape, eps)
            for f in range(v.shape[1]):
                for t in range(min(reach, f + 1)):
                    lam[:, f] += w[t] @ h[:, f - t]
            qs.append(v / (lam + eps))
        new = w.copy()
        for t in range(reach):
            top = sum(sum(np.outer(q[:, f], h[:, f - t]) for f in range(t, q.shape[1])) for q, h in zip(qs, hs) if q.shape[1] > t)
            below = sum(h[:, : max(h.shape[1] - t, 0)].sum(axis=1) for h in hs)
            new[t, :, frozen:] = (w[t] * top / (below + eps))[:, frozen:]
        for i, (q, h) in enumerate(zip(qs, hs)):
            up = np.zeros_like(h)
            for t in range(reach):
                for f in range(h.shape[1] - t):
                    up[:, f] += new[t].T @ q[:, f + t] / (new[t].sum(axis=0) + eps)
            hs[i] = h * up / reach
        w = new
    return w, hs


@pytest.mark.parametrize("frozen", [0, 2])
def test_patterns_equal_loops(spark, frozen):
    r = np.random.default_rng(4)
    bins, k, reach = 5, 3, 3
    vs = [r.random((bins, n)) / n for n in (9, 2, 14, 1)]
    given = r.random((reach, bins, frozen)) if frozen else None
    table = spark.createDataFrame([(i, v.shape[1], v.ravel().tolist()) for i, v in enumerate(vs)], "track long, n int, v array<double>").repartition(3)
    w, fit, costs = C.factorised(table, bins, k, reach, 4, given, seed=7)
    want, hs = by_loops(vs, C.first_guess(bins, k, reach, given, 7), 4, frozen)
    assert np.allclose(w, want) and len(costs) == 4
    rows = {x.track: x for x in fit.collect()}
    assert all(np.allclose(np.reshape(rows[i].h, (k, -1)), h) for i, h in enumerate(hs))
    if frozen:
        assert (w[:, :, :frozen] == given).all()


def test_patterns_are_found_again(spark):
    """Tracks that are made of two patterns: the fit is close, and no tracks are no fit."""
    r = np.random.default_rng(1)
    true = np.zeros((4, 6, 2))
    true[:, 0, 0], true[[0, 1, 2, 3], [1, 2, 3, 4], 1] = [1, 0.6, 0.3, 0.1], 1.0
    vs = []
    for _ in range(6):
        h = (r.random((2, 40)) < 0.1) * r.random((2, 40))
        v = C.model(true, h)
        vs.append(v / v.sum())
    table = spark.createDataFrame([(i, v.shape[1], v.ravel().tolist()) for i, v in enumerate(vs)], "track long, n int, v array<double>")
    w, fit, costs = C.factorised(table, 6, 2, 4, 40, seed=3)
    assert costs[-1] < 0.2 * costs[0]
    _, frozen, exact = C.factorised(table, 6, 2, 4, 20, true)
    assert frozen.groupBy().avg("cost").first()[0] < 0.1 * exact[0]
    w, fit, costs = C.factorised(table.limit(0), 6, 2, 4, 3)
    assert fit.collect() == [] and costs == [] and w.shape == (4, 6, 2)
