"""The streaming monitor against the batch, in parts of any size; the table function and the aggregate on edges."""

import math

import numpy as np
import pytest
from pyspark.sql import Row, functions as F

from tidewell.functions import tables as T
from tidewell.operators import standard as S
from tidewell.streaming import health as H

WINDOW = 10
RULES = {"quiet_db": -60.0, "least": 3, "early": 4, "digital_db": -100.0, "silent_db": -60.0, "target_db": -14.0, "most_gain_db": 30.0}
LEVELS = {
    1: [-10, None, None, None, -20, -70, -70, -10], 2: [None] * 6, 3: [-65] * 5, 4: [-50] * 3, 5: [None, -1], 6: [-10, None, None, None, None],
    7: [None, None, None, None, -1, -1], 8: [], 9: [-70, -70, -70, -1],
}


def parts(levels, rest, cut):
    """(window, power, n): full windows, each in parts of ``cut`` samples, and ``rest`` samples of a last one."""
    out = []
    for w, n in [*((i, WINDOW) for i in range(len(levels))), *([(len(levels), rest)] if rest else [])]:
        p = 10 ** (levels[w] / 10) if w < len(levels) and levels[w] is not None else 0.0
        out += [(w, p * min(cut, n - a), min(cut, n - a)) for a in range(0, n, cut)]
    return out


@pytest.mark.parametrize("cut", [3, 10])
def test_monitor_equals_batch(spark, cut):
    rows, got, gaps, early = [], {}, set(), {}
    for t, levels in LEVELS.items():
        fed = parts(levels, 4 if t in (5, 8) else 0, cut)
        rows += [(t, *part) for part in fed]
        state = None
        for part in fed:  # as if every part came in a batch of its own
            m = H.Monitor(RULES | {"window": WINDOW}, state)
            m.add(*part)
            gaps |= {(t, x["start"], x["length"]) for x in m.out if x["kind"] == "gap"}
            early |= {t: x["verdict"] for x in m.out if x["kind"] == "early"}
            state = tuple(m.s.values())
        m = H.Monitor(RULES | {"window": WINDOW}, state)
        m.finish()
        gaps |= {(t, x["start"], x["length"]) for x in m.out if x["kind"] == "gap"}
        got[t] = m.out[-1]
    table = spark.createDataFrame(rows, "track long, window long, power double, n long").groupBy("track", "window").agg(F.sum("power").alias("power"), F.sum("n").alias("n")).withColumn("whole", F.col("n") == WINDOW)
    for r in S.health(table, **RULES).collect():
        mine = got[r.track]
        for c in ("verdict", "n", "level_db", "early_db", "least_loud_db", "gaps", "gap_windows", "longest_gap"):
            a, b = mine[c], r[c]
            assert a == b or math.isclose(a, b, rel_tol=1e-9), (r.track, c)
    assert gaps == {(r.track, r.start, r.length) for r in S.dead_air(table, -60.0, 3).collect()}
    # a pause at the start is no fault before the early windows are full; what was dead then stays so
    assert early == {1: "ok", 2: "dead", 3: "ok", 6: "ok", 7: "dead", 9: "ok"} and got[7]["verdict"] == "dead" and got[3]["verdict"] == "silent"


def test_segmenter(spark):
    rows = [(1, i, x) for i, x in enumerate([0.0, 2.0, None, -3.0, 0.0, 0.0, 0.0, 1.0, float("nan"), 1.0])] + [(2, 0, 0.5), (3, 0, 1.0)]
    df = spark.createDataFrame(rows, "track long, idx long, x double").repartition(4)
    got = sorted(map(tuple, T.segmented(df, 1.0, 2).collect()))
    assert got == [(1, 1, 3, 2, 3.0, 13.0), (1, 7, 9, 2, 1.0, 2.0), (3, 0, 0, 1, 1.0, 1.0)]
    assert T.segmented(df.limit(0), 1.0, 2).collect() == []


def test_spread(spark):
    rows = [(1, 1.0), (1, 2.0), (1, 100.0), (1, None), (2, None), (3, float("nan")), (3, 5.0)]
    got = dict(spark.createDataFrame(rows, "k int, x double").groupBy("k").agg(T.spread("x").alias("s")).collect())
    assert got[1] == 1.0 and got[3] == 0.0 and (got[2] is None or np.isnan(got[2]))


def test_segmenter_is_given_loud_rows_only(spark, monkeypatch):
    rows = [(1, i, x) for i, x in enumerate([0.0, -2.0, None, 3.0, 0.5, float("nan"), 1.0])]
    seen = spark.sparkContext.accumulator(0)

    class Counting(T.Segmenter.func):
        def eval(self, row, threshold, gap):
            seen.add(1)
            yield from super().eval(row, threshold, gap)

    monkeypatch.setattr(T, "Segmenter", F.udtf(Counting, returnType=T.SEGMENTS, useArrow=False))
    assert sorted(map(tuple, T.segmented(spark.createDataFrame(rows, "track long, idx long, x double"), 1.0, 1).collect())) == [(1, 1, 3, 2, 3.0, 13.0), (1, 6, 6, 1, 1.0, 1.0)]
    assert seen.value == 3


class Handle:
    """A state and timers in memory, which count what is asked of them."""

    def __init__(self):
        self.value, self.timers, self.asked = None, [], 0

    def getValueState(self, name, schema):  # noqa: N802
        return self

    def get(self):
        return self.value

    def update(self, value):
        self.value = value

    def listTimers(self):  # noqa: N802
        self.asked += 1
        return iter(list(self.timers))

    def deleteTimer(self, t):  # noqa: N802
        self.timers.remove(t)

    def registerTimer(self, t):  # noqa: N802
        self.timers.append(t)

    def getCurrentWatermarkInMs(self):  # noqa: N802
        return -1


def test_processor_takes_rows_as_they_are(spark):
    def block(seq, levels, last=False):
        return Row(seq=seq, at=1000 * seq, windows=[Row(window=2 * seq + i, power=x, n=WINDOW) for i, x in enumerate(levels)], last=last)

    blocks = [block(0, [1.0, 0.0]), block(1, [0.0, 0.0]), block(2, [2.0, 3.0], True)]
    h = Handle()
    p = H.HealthProcessor(RULES | {"window": WINDOW}, 500)
    p.init(h)
    assert list(p.handleInputRows((7,), iter(blocks[:1]), h)) == [] and h.timers == [500] and not h.asked
    told = list(p.handleInputRows((7,), iter([blocks[1], blocks[0]]), h))  # the first comes again
    assert [(x.track, x.kind, x.verdict) for x in told] == [(7, "early", "ok")] and h.timers == [1500]
    told = list(p.handleInputRows((7,), iter(blocks[2:]), h))
    assert [(x.kind, x.start, x.length, x.gaps, x.n) for x in told] == [("gap", 1, 3, None, None), ("final", None, None, 1, 6 * WINDOW)] and h.timers == []
    assert list(p.handleInputRows((7,), iter(blocks), h)) == []

    one, other = Handle(), H.HealthProcessor(RULES | {"window": WINDOW}, 500)  # all at once, in another order: no timer is asked for
    other.init(one)
    again = list(other.handleInputRows((7,), iter(blocks[::-1]), one))
    assert [x for x in again if x.kind != "early"] == told and not one.asked and not one.timers

    silent, third = Handle(), H.HealthProcessor(RULES | {"window": WINDOW}, 500)  # no last block: the timer ends it
    third.init(silent)
    list(third.handleInputRows((7,), iter(blocks[:2]), silent))
    assert [(x.kind, x.start) for x in third.handleExpiredTimer((7,), silent, None)] == [("gap", 1), ("final", None)]
    with pytest.raises(ValueError, match="block 0 is missing"):
        fresh = H.HealthProcessor(RULES | {"window": WINDOW}, 500)
        fresh.init(Handle())
        list(fresh.handleInputRows((7,), iter(blocks[1:]), Handle()))
