"""Voice activity against plain loops: at any block size, at the latch's bounds, and as a stream of several batches."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidewell.operators import voice as V
from tidewell.streaming import beats as beat_stream, voice as stream_form

from .test_blocks import frame, noise

FRAME, SLOW, PADDED = 8, 32, 32


def by_loop(x):
    """(rms_db, flatness, side ratio, rises) of each whole frame."""
    mid, side = (x[0] + x[1]) / 2, (x[0] - x[1]) / 2
    out, before = [], False
    for i in range(x.shape[1] // FRAME):
        rises = 0
        for k in range(i * FRAME, (i + 1) * FRAME):
            fast, slow = (np.abs(mid[max(k + 1 - w, 0) : k + 1]).sum() / w for w in (FRAME, SLOW))
            rises += bool(fast > slow * V.RISE and not before)
            before = fast > slow * V.RISE
        m, s = (np.sqrt((v[i * FRAME : (i + 1) * FRAME] ** 2).mean()) for v in (mid, side))
        w = 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(FRAME) / FRAME)
        p = np.abs(np.fft.rfft(mid[i * FRAME : (i + 1) * FRAME] * w, PADDED)) ** 2 + 1e-20
        flat = np.exp(np.log(p).mean()) / p.mean() if m > 0 else 0.5
        out.append((20 * np.log10(m) if m > 1e-15 else -144.0, flat, (0.0 if s < 1e-10 else 100.0) if m < 1e-10 else s / m, rises))
    return out


@pytest.mark.parametrize("size", [40, 64, 4000])
def test_features_do_not_depend_on_blocks(spark, size):
    burst = noise(300, 2, 3)
    burst[:, :150] *= 0.01
    tracks = {1: burst, 2: noise(7, 2), 3: np.zeros((2, 50)), 4: np.stack([np.ones(40), -np.ones(40)])}
    got = V.features(frame(spark, tracks, "lr"), FRAME, SLOW, PADDED, size).toPandas()
    for t, x in tracks.items():
        mine = got[got.track == t].sort_values("frame")
        want = by_loop(x)
        assert mine["frame"].tolist() == list(range(len(want)))
        assert np.allclose(mine[["rms_db", "flatness", "side_ratio", "rises"]].to_numpy(), np.array(want).reshape(-1, 4))
    assert sum(r for *_, r in by_loop(burst)) > 0


def loop_latch(p, hold):
    out, on, left = [], False, 0
    for x in p:
        if not on and x > V.ENTER:
            on, left = True, hold
        elif on:
            if x > V.LEAVE:
                left = hold
            elif left:
                left -= 1
            else:
                on = False
        out.append(on)
    return out


CHANCES = {1: [0.7, 0.71, 0.3, 0.3, 0.3, 0.9], 2: [0.9] + [0.1] * 3 + [0.31] + [0.1] * 3, 3: [0.1] * 9 + [0.8], 4: [0.5, 0.6], 5: [float("nan"), 0.9, float("nan"), float("nan"), float("nan"), 0.2]}


@pytest.mark.parametrize("hold", [0, 2])
def test_latch_equals_loop(spark, hold):
    r = np.random.default_rng(2)
    tracks = CHANCES | {10 + i: r.random(80).tolist() for i in range(4)}
    df = spark.createDataFrame([(t, i, float(x)) for t, p in tracks.items() for i, x in enumerate(p)], "track long, frame long, posterior double").repartition(3)
    got = V.latched(df, hold=hold).toPandas()
    for t, p in tracks.items():
        assert got[got.track == t].sort_values("frame")["is_speech"].tolist() == loop_latch(p, hold)
    runs = V.segments(V.latched(df.filter("track = 2"), hold=hold)).orderBy("start").collect()
    assert [(r.start, r.length) for r in runs] == ([(0, 1)] if hold == 0 else [(0, 3)])


def test_posterior_is_a_half_without_figures(spark):
    rows = [(1, 0, -20.0, 0.03, 0.0, 0), (1, 1, float("nan"), 0.03, 0.0, 0), (2, 0, -60.0, 0.28, 0.6, 0), (3, 0, None, 0.03, 0.0, 0)]
    df = spark.createDataFrame(rows, "track long, frame long, rms_db double, flatness double, side_ratio double, rises long")
    got = {(r.track, r.frame): r.posterior for r in V.posterior(df, F.lit(-60.0)).collect()}
    assert got[1, 0] > 0.9 and got[2, 0] < 0.2 and got[1, 1] == got[3, 0] == 0.5


def test_stream_equals_batch(spark, tmp_path):
    """Three batches, one of which brings frames again."""
    r = np.random.default_rng(5)
    tracks = {t: r.random(60) for t in (1, 2)}
    tracks[1][20:40] = 0.1
    cuts = [(0, 25), (20, 41), (41, 60)]
    for i, (a, b) in enumerate(cuts):
        rows = [(t, k, float(p[k])) for t, p in tracks.items() for k in range(a, b)]
        spark.createDataFrame(rows, "track long, frame long, posterior double").coalesce(1).write.parquet(f"{tmp_path}/in/{i}")
    before = spark.conf.get(beat_stream.PROVIDER[0])
    spark.conf.set(*beat_stream.PROVIDER)
    try:
        stream = spark.readStream.schema("track long, frame long, posterior double").option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(f"{tmp_path}/in")
        q = stream_form.voice(stream, hold=3).writeStream.outputMode("append").option("checkpointLocation", f"{tmp_path}/at").format("parquet").option("path", f"{tmp_path}/out").trigger(availableNow=True).start()
        assert q.awaitTermination(240)
    finally:
        spark.conf.set(beat_stream.PROVIDER[0], before)
    got = spark.read.schema(stream_form.RESULT).parquet(f"{tmp_path}/out").toPandas()
    whole = spark.createDataFrame(pd.DataFrame([(t, k, float(x)) for t, p in tracks.items() for k, x in enumerate(p)], columns=["track", "frame", "posterior"]))
    gains = V.ducked(whole).toPandas()
    for t, p in tracks.items():
        mine = got[got.track == t].sort_values("frame")
        assert mine["frame"].tolist() == list(range(60)) and mine["is_speech"].tolist() == loop_latch(p, 3)
        assert np.allclose(mine["gain"], gains[gains.track == t].sort_values("frame")["gain"])
        assert mine["gain"].between(10 ** (V.FLOOR_DB / 20), 1).all()
