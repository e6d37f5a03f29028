"""The beat detector on a stream: transients after a fixed delay, tempo and grid when a track ends.

A stream carries blocks ``(track, seq, ts, x array, last)``, a track's in order; ``ts`` is when a block came in. Per
track the state holds the last hops and as many frames as the local window has, sums, and a count for each
possible distance: its size does not grow with the track. A track ends with its last block, or when the
watermark is ``idle`` past its latest one; a timer that every block sets anew sees to that. Timers are in event
time, so a replay gives the same result. The results equal ``operators.beats`` with ``ahead = reach``.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import numpy as np
from pyspark.sql import DataFrame, Row, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from tidewell.operators import beats as B

RESULT = "track long, kind string, place long, ms long, bpm double"
STATE = "seq long, samples long, part double, held int, hop double, hops long, rms double, flux array<double>, front long, next long, first long, latest long, bins array<int>, done boolean"
NAMES = [c.split()[0] for c in RESULT.split(", ")]
#: The provider that state with timers needs; set it in the session before the query starts.
PROVIDER = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


class Detector:
    """One track's detector; ``s`` is all it remembers, in the order of ``STATE``."""

    def __init__(self, rate: int, hop: int, state: tuple | None = None) -> None:
        self.rate, self.hop, self.reach = rate, hop, B.reach(rate, hop)
        fresh = (-1, 0, 0.0, 0, -1.0, 0, 0.0, [], 0, 0, -1, -1, [0] * (B.LAST_BIN - B.FIRST_BIN + 1), False)
        self.s = dict(zip((c.split()[0] for c in STATE.split(", ")), state or fresh))
        self.out: list[tuple] = []

    def feed(self, x: np.ndarray) -> None:
        """Take samples, and decide on every frame of which enough has followed."""
        s = self.s
        x = np.where(np.isfinite(x), x, 0.0)
        s["samples"] += len(x)
        square = np.append(s["part"], x * x)
        cut = np.arange(self.hop - s["held"], len(x) + 1, self.hop)
        whole = [float(v.sum()) for v in np.split(square, cut + 1)]
        s["part"], s["held"] = whole.pop(), (s["held"] + len(x)) % self.hop
        for p in whole:
            s["hops"] += 1
            if s["hop"] >= 0:
                rms = float(np.sqrt((s["hop"] + p) / (2 * self.hop)))
                s["flux"].append(max(rms - s["rms"], 0.0))
                s["rms"] = rms
            s["hop"] = p
            while s["front"] + len(s["flux"]) - 1 - s["next"] >= self.reach:
                self._decide(s["next"], None)

    def _decide(self, c: int, end: int | None) -> None:
        """Whether frame c is a transient; ``end`` is the number of frames where it is known."""
        s = self.s
        flux = np.array(s["flux"])
        i = c - s["front"]
        near = flux[max(i - self.reach, 0) : i + self.reach + 1]
        inner = c > 0 and (end is None or c < end - 1)
        if inner and flux[i] > flux[i - 1] and flux[i] > flux[i + 1] and flux[i] > near.mean() + B.SPREADS * near.std() and flux[i] > B.LEAST_FLUX:
            ms = (c * self.hop + self.hop) * 1000 // self.rate
            self.out.append(("transient", c, ms, None))
            at = (ms - s["latest"]) // B.BIN_MS - B.FIRST_BIN
            if s["first"] < 0:
                s["first"] = ms
            elif 0 <= at < len(s["bins"]):
                s["bins"][at] += 1
            s["latest"] = ms
        s["next"] = c + 1
        keep = max(c + 1 - self.reach, 0)
        if keep > s["front"]:
            s["flux"], s["front"] = s["flux"][keep - s["front"] :], keep

    def finish(self) -> None:
        """Decide on the frames that are left; then the tempo and the grid."""
        s = self.s
        end = s["front"] + len(s["flux"])
        for c in range(s["next"], end):
            self._decide(c, end)
        best = int(np.argmax(s["bins"]))
        step = (best + B.FIRST_BIN) * B.BIN_MS if s["bins"][best] else 0
        total = s["samples"] * 1000 // self.rate
        self.out.append(("tempo", s["samples"], step, 60_000 / step if step else 0.0))
        if step:
            self.out += [("downbeat" if i % 4 == 0 else "beat", i, ms, None) for i, ms in enumerate(range(s["first"], total, step))]
        s["done"] = True


class BeatProcessor(StatefulProcessor):
    """Per track: a :class:`Detector` in a value state, and a timer for the end of tracks that fall silent."""

    def __init__(self, rate: int, hop: int, idle_ms: int) -> None:
        self.rate, self.hop, self.idle_ms = rate, hop, idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.state = handle, handle.getValueState("beats", STATE)

    def _found(self, key: Any, d: Detector) -> Iterator[Row]:
        self.state.update(tuple(d.s.values()))
        return (Row(**dict(zip(NAMES, (key[0], *row)))) for row in d.out)

    def _detector(self, held: tuple | None) -> Detector:
        return Detector(self.rate, self.hop, tuple(list(v) if isinstance(v, (list, tuple, np.ndarray)) else v for v in held) if held else None)

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:  # noqa: N802, N803
        known = self.state.get()
        d = self._detector(known)
        latest = timerValues.getCurrentWatermarkInMs() + 1
        for r in sorted(rows, key=lambda r: r["seq"]):
            latest = max(latest, r["at"])
            if d.s["done"] or r["seq"] <= d.s["seq"]:
                continue  # a block that came again, or after the end
            if r["seq"] != d.s["seq"] + 1:
                raise ValueError(f"track {key[0]}: block {d.s['seq'] + 1} is missing")
            d.s["seq"] = r["seq"]
            d.feed(np.asarray(r["x"], float))
            if r["last"]:
                d.finish()
        for t in list(self.handle.listTimers()) if known else ():
            self.handle.deleteTimer(t)
        if not d.s["done"]:
            self.handle.registerTimer(latest + self.idle_ms)
        yield from self._found(key, d)

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[Row]:  # noqa: N802, N803
        d = self._detector(self.state.get())
        if not d.s["done"]:
            d.finish()
        yield from self._found(key, d)

    def close(self) -> None:
        pass


def beats(stream: DataFrame, rate: int, hop: int = 512, late: str = "1 minute", idle_ms: int = 600_000) -> DataFrame:
    """``(track, kind, place, ms, bpm)`` of ``stream(track, seq, ts, x, last)``, whose watermark is ``late`` behind.

    ``kind`` is transient (place: its frame), tempo (place: samples, ms: the step, 0 for none), downbeat or beat (place:
    its number). Blocks that come again are skipped, those after a track's end too; a missing one is an error.
    """
    timed = stream.withWatermark("ts", late).withColumn("at", F.unix_millis(F.col("ts").cast("timestamp")))
    processor = BeatProcessor(rate, hop, idle_ms)
    return timed.groupBy("track").transformWithState(statefulProcessor=processor, outputStructType=RESULT, outputMode="Append", timeMode="EventTime")
