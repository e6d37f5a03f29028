"""Blocks of tracks: filters as scans, loudness, the standard form; against sample-by-sample loops and at any block size."""

import hashlib
import math

import numpy as np
import pandas as pd
import pytest

from tidewell.operators import blocks as B, recurrences as R, spectral as P, standard as S


def frame(spark, tracks, names=("x",)):
    """Rows (track, idx, channels...) of arrays of shape (channels, n), in no order."""
    parts = [pd.DataFrame({"track": t, "idx": np.arange(x.shape[1]), **dict(zip(names, x))}) for t, x in tracks.items()]
    return spark.createDataFrame(pd.concat(parts).sample(frac=1, random_state=1)).repartition(3)


def by_sample(parts, x):
    """The difference equation, one sample after the other."""
    for b, a in parts:
        y = np.zeros(len(x))
        for i in range(len(x)):
            y[i] = sum(b[k] * x[i - k] for k in range(3) if i >= k) - sum(a[k] * y[i - k] for k in (1, 2) if i >= k)
        x = y
    return x


def noise(n, channels=1, seed=0):
    return np.random.default_rng(seed).uniform(-1, 1, (channels, n))


@pytest.mark.parametrize("size, fan", [(7, 2), (64, 3), (100, 256), (1000, 256)])
def test_filter_does_not_depend_on_blocks(spark, monkeypatch, size, fan):
    monkeypatch.setattr(R, "FAN", fan)
    parts = R.sections(P.K_SHELF, P.K_HIGHPASS, P.biquad("peak", 48_000, 3_000, 2.0, 6.0))
    tracks = {1: noise(501), 2: noise(64, seed=2), 3: noise(1, seed=3)}
    out = R.filtered_blocks(B.blocks(frame(spark, tracks), size), parts).toPandas()
    for t, x in tracks.items():
        got = np.concatenate(out[out.track == t].sort_values("seq")["x"].tolist())
        assert np.allclose(got, by_sample(parts, x[0]), atol=1e-9)


def test_loudness_of_known_signals(spark):
    """A tone of 997 Hz has the level the weighting is made for; the gate leaves out silence; the low channel is not heard."""
    t = np.arange(48_000) / 48_000
    tone = np.sin(2 * np.pi * 997 * t)
    zero = np.zeros_like(tone)
    stereo = {1: 0.1 * np.stack([tone, tone]), 2: np.stack([tone, zero]), 3: np.stack([zero, zero]), 4: 0.1 * np.stack([tone, tone])[:, :10_000], 5: np.stack([np.append(0.1 * tone, zero)] * 2)}
    got = {r.track: r for r in R.loudness(frame(spark, stereo, "lr"), P.K_WEIGHTING, size=9_600).collect()}
    assert got[1].level_db == pytest.approx(-20.0, abs=0.1) and got[1].windows == 7
    assert got[2].level_db == pytest.approx(-3.01, abs=0.1)
    assert got[3].level_db == -144.0 and got[3].kept == 0 and got[4].level_db is None
    assert got[5].level_db == pytest.approx(-20.0, abs=1.0) and got[5].windows == 17 and got[5].kept < 12
    six = {1: np.stack([zero, zero, 0.1 * tone, tone, zero, zero]), 2: np.stack([zero] * 4 + [0.1 * tone, zero])}
    got = {r.track: r.level_db for r in R.loudness(frame(spark, six, list(R.SURROUND)), P.K_WEIGHTING, R.SURROUND).collect()}
    assert got[1] == pytest.approx(-23.01, abs=0.1) and got[2] == pytest.approx(-23.01 + 1.5, abs=0.1)


def test_blocks_refuse_gaps_and_mend_values(spark):
    rows = [(1, 0, 1.0), (1, 1, None), (1, 2, float("nan")), (1, 3, float("inf")), (2, 0, 5.0)]
    got = {(r.track, r.seq): list(r.x) for r in B.blocks(spark.createDataFrame(rows, "track long, idx long, x double"), 3).collect()}
    assert got == {(1, 0): [1.0, 0.0, 0.0], (1, 1): [0.0], (2, 0): [5.0]}
    for bad in ([(1, 0, 1.0), (1, 2, 1.0)], [(1, 0, 1.0), (1, 0, 1.0)]):
        with pytest.raises(Exception, match="gaps"):
            B.blocks(spark.createDataFrame(bad, "track long, idx long, x double"), 3).collect()
    empty = spark.createDataFrame([], "track long, idx long, l double, r double")
    assert R.loudness(empty, P.K_WEIGHTING).collect() == []


def test_overlap(spark):
    b = B.blocks(frame(spark, {1: np.arange(10.0)[None], 2: np.arange(2.0)[None]}), 4)
    got = {(r.track, r.seq): (r.lead, r.n, list(r.x)) for r in B.overlapped(b, 2, 3).collect()}
    assert got == {(1, 0): (0, 4, [0, 1, 2, 3, 4, 5, 6]), (1, 1): (2, 4, [2, 3, 4, 5, 6, 7, 8, 9]), (1, 2): (2, 2, [6, 7, 8, 9]), (2, 0): (0, 2, [0, 1])}


def rated(spark, tracks, rates, names="lr"):
    rate = spark.createDataFrame(list(rates.items()), "track long, rate long")
    return frame(spark, tracks, names).join(rate, "track")


def whole(x, source, target, taps):
    """Resampling by its definition over the whole track."""
    n, cut = x.shape[1], min(1.0, target / source)
    out = []
    for j in range(math.ceil(n * target / source)):
        at = j * source / target
        k = np.arange(math.floor(at) - taps + 1, math.floor(at) + taps + 1)
        w = cut * np.sinc(cut * (at - k)) * (0.5 + 0.5 * np.cos(np.pi * np.clip((at - k) / taps, -1, 1)))
        ok = (k >= 0) & (k < n)
        out.append((x[:, k[ok]] * w[ok]).sum(axis=1))
    return np.array(out).T.reshape(2, -1)


@pytest.mark.parametrize("size", [8, 33, 500])
def test_standard_form_does_not_depend_on_blocks(spark, size):
    tracks, rates = {i: 0.8 * noise(n, 3, i) for i, n in enumerate((200, 147, 9, 1))}, {0: 441, 1: 960, 2: 480, 3: 300}
    b = S.standardized(rated(spark, tracks, rates, "abc"), "abc", 480, size, 8)
    got = S.samples(b).toPandas()
    windows = {(r.track, r.window): (r.power, r.n) for r in S.seconds(b, 480).collect()}
    digest = {r.track: (r.n, r.digest) for r in S.digests(b).collect()}
    for t, x in tracks.items():
        two = S.downmix(x)
        want = np.clip(two if rates[t] == 480 else whole(two, rates[t], 480, 8), -1, 1)
        mine = got[got.track == t].sort_values("idx")
        assert mine["idx"].tolist() == list(range(want.shape[1]))
        assert np.allclose(mine[["l", "r"]].to_numpy().T, want, atol=1e-6)
        assert windows[t, 0][1] == min(480, want.shape[1]) and digest[t][0] == want.shape[1]
        assert windows[t, 0][0] == pytest.approx((want**2).sum() / 2, rel=1e-5)


def test_standard_form_digest_and_bad_values(spark):
    x = np.array([[0.5, float("nan"), 2.0, -3.0, 0.25]])
    row = S.standardized(rated(spark, {1: x}, {1: 48_000}, "x"), "x").first()
    stored = np.array([0.5, 0, 1, -1, 0.25], "<f4")
    assert bytes(row.digest) == hashlib.sha256(np.repeat(stored, 2).tobytes()).digest() and row.bad == 1 and list(row.l) == list(row.r) == stored.tolist()
    b = S.standardized(rated(spark, {1: x}, {1: 48_000}, "x"), "x")
    assert S.digests(b).first().digest == hashlib.sha256(bytes(row.digest)).hexdigest()


def test_health_verdicts_and_gaps(spark):
    """One window is one second of 100 samples."""
    level = lambda *db: np.concatenate([np.full(100, 10 ** (d / 20)) if d is not None else np.zeros(100) for d in db])[None]
    tracks = {1: level(-10, None, None, None, -20, -70, -70, -10), 2: level(*[None] * 4), 3: level(-65, -65), 4: level(-50, -50), 5: level(None, -1)[:, :150], 6: level(-10, None, None, None, None)}
    s = rated(spark, tracks, dict.fromkeys(tracks, 100), "x")
    w = S.seconds(S.standardized(s, "x", 100, 64), 100)
    got = {r.track: r for r in S.health(w, early=2).collect()}
    assert {t: r.verdict for t, r in got.items()} == {1: "ok", 2: "dead", 3: "silent", 4: "faint", 5: "ok", 6: "ok"}
    assert (got[1].gaps, got[1].gap_windows, got[1].longest_gap) == (1, 3, 3) and got[1].least_loud_db == pytest.approx(-20, abs=1e-4)
    assert (got[6].gaps, got[6].longest_gap) == (1, 4) and got[5].gaps == 0 and got[2].level_db is None
    assert {(r.track, r.start, r.length) for r in S.dead_air(w).collect()} == {(1, 1, 3), (2, 0, 4), (6, 1, 4)}
