"""Regions that touch, segments at a track's ends and across blocks, and what is left alone."""

import numpy as np
import pytest

from tidewell.operators import blocks as B, escalation as E

from .test_blocks import frame, noise


def by_hand(x, segments, pad):
    """Mark regions, work on each as a whole, put back the flagged samples."""
    n = len(x)
    wide, flag = np.zeros(n + 1, bool), np.zeros(n, bool)
    for a, b in segments:
        if a <= b:
            wide[max(a - pad, 0) : b + pad + 1] = True
            flag[a : b + 1] = True
    wide[n] = False
    y, start = x.copy(), None
    for i in range(n + 1):
        if wide[i] and start is None:
            start = i
        elif not wide[i] and start is not None:
            y[start:i] = np.cumsum(x[start:i])
            start = None
    return np.where(flag, y, x)


@pytest.mark.parametrize("size", [4, 10, 100])
def test_escalated_equals_by_hand(spark, size):
    tracks = {1: noise(57)[0], 2: noise(30, seed=2)[0], 3: noise(5, seed=3)[0]}
    flagged = {1: [(0, 1), (9, 9), (13, 20), (40, 70), (30, 25)], 2: [(5, 6), (6, 8), (20, 29)], 9: [(1, 2)]}
    df = spark.createDataFrame([(t, a, b) for t, s in flagged.items() for a, b in s], "track long, start long, end long")
    out = E.escalated(B.blocks(frame(spark, {t: x[None] for t, x in tracks.items()}), size), size, df, 2, np.cumsum).toPandas()
    for t, x in tracks.items():
        got = np.concatenate(out[out.track == t].sort_values("seq")["x"].tolist())
        assert np.allclose(got, by_hand(x, flagged.get(t, []), 2))
    assert set(out.track) == {1, 2, 3}
    same = E.escalated(B.blocks(frame(spark, {1: tracks[1][None]}), size), size, df.limit(0), 2, np.cumsum).toPandas()
    assert np.allclose(np.concatenate(same.sort_values("seq")["x"].tolist()), tracks[1])
