"""Streaming twins of the batch meters: the same state per track, fed in order and closed at the end.

A stream carries blocks ``(track, seq, x array)``; ``last`` marks a track's end. State is sums, extremes, the
last few values of a window, and eight bytes for each window's power, which the final gate needs. A finished
track leaves a mark of a few bytes, by which its late blocks are dropped.
"""

from __future__ import annotations

import json
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

RESULT = "track long, n long, rms_db double, peak double, clip_runs long, windows long, level_db double"
STATE = "state string, powers binary, done boolean"


class Meter:
    """Sums, extremes, clip runs and a sliding power window; ``feed`` and ``finish``."""

    def __init__(self, size: int, hops: int, ceiling: float, least: int) -> None:
        self.size, self.hops, self.ceiling, self.least = size, hops, ceiling, least
        self.s: dict = {"n": 0, "p": 0.0, "peak": 0.0, "run": 0, "runs": 0, "block": [0, 0.0], "last": [], "z": []}

    def feed(self, xs: list[float]) -> None:
        s = self.s
        for x in xs:
            s["n"] += 1
            s["p"] += x * x
            s["peak"] = max(s["peak"], abs(x))
            s["run"] = s["run"] + 1 if abs(x) >= self.ceiling else 0
            s["runs"] += s["run"] == self.least
            s["block"][0] += 1
            s["block"][1] += x * x
            if s["block"][0] == self.size:
                s["last"] = [*s["last"], s["block"][1] / self.size][-self.hops :]
                s["block"] = [0, 0.0]
                if len(s["last"]) == self.hops:
                    s["z"].append(sum(s["last"]) / self.hops)

    def finish(self) -> tuple[int, float, float, int, int, float | None]:
        db = lambda p: 10 * math.log10(p) if p >= 1e-30 else -144.0
        s = self.s
        first = [z for z in s["z"] if -0.691 + db(z) >= -70]
        gate = -0.691 + db(sum(first) / len(first)) - 10 if first else 0.0
        kept = [z for z in first if -0.691 + db(z) >= gate]
        return s["n"], db(s["p"] / s["n"]) if s["n"] else -144.0, s["peak"], int(s["runs"]), len(kept), -0.691 + db(sum(kept) / len(kept)) if kept else None


def metered(stream: DataFrame, size: int, hops: int, ceiling: float, least: int) -> DataFrame:
    """One row per track when its last block has come, from ``stream(track, seq, x, last)``."""

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        rows = pd.concat(list(batches)).sort_values("seq")
        if state.exists and state.get[2]:
            return
        m = Meter(size, hops, ceiling, least)
        if state.exists:
            m.s = json.loads(state.get[0]) | {"z": []}
        before = bytes(state.get[1]) if state.exists else b""
        for x in rows["x"]:
            m.feed(list(x))
        powers = before + np.array(m.s.pop("z"), np.float64).tobytes()
        if bool(rows["last"].any()):
            m.s["z"] = np.frombuffer(powers, np.float64).tolist()
            state.update(("", b"", True))
            yield pd.DataFrame([(key[0], *m.finish())], columns=[c.split()[0] for c in RESULT.split(", ")])
        else:
            state.update((json.dumps(m.s), powers, False))

    return stream.groupBy("track").applyInPandasWithState(run, RESULT, STATE, "append", GroupStateTimeout.NoTimeout)


def windowed(stream: DataFrame, late: str, size: str, slide: str | None = None) -> DataFrame:
    """Count, mean and largest value of ``stream(ts, state, x)`` per time window and state, with a watermark."""
    w = F.window("ts", size, slide) if slide else F.window("ts", size)
    a = stream.withWatermark("ts", late).groupBy(w, "state").agg(F.count("*").alias("n"), F.avg("x").alias("mean"), F.max("x").alias("top"))
    return a.select(F.col("window.start").alias("start"), "state", "n", "mean", "top")


def session_runs(stream: DataFrame, late: str, gap: str) -> DataFrame:
    """Sessions of a track divided by silent gaps in time."""
    a = stream.withWatermark("ts", late).groupBy(F.session_window("ts", gap), "track").agg(F.count("*").alias("n"), F.max("x").alias("top"))
    return a.select("track", F.col("session_window.start").alias("start"), "n", "top")
