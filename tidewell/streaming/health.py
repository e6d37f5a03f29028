"""Signal health on a stream: gaps as they end, a first verdict when the early windows are full, a final one at the end.

A stream carries standardized blocks ``(track, seq, ts, windows, last)``, a track's in order; their windows are the
sums that ``operators.standard`` makes. While the early windows fill, nothing is said: a pause at the start is no
fault. Then comes a verdict that the end may revise, and with the last block, or when the watermark is ``idle``
past the latest one, the final row, after which the track is closed. The state is some twenty numbers, the blocks
come as rows: a track has few in a batch, and a pandas frame for each would cost more than what is done with them.
The final row and the gaps equal ``standard.health`` and ``standard.dead_air``.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from typing import Any

from pyspark.sql import DataFrame, Row, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

RESULT = "track long, kind string, verdict string, n long, level_db double, early_db double, least_loud_db double, gaps long, gap_windows long, longest_gap long, start long, length long"
STATE = "seq long, open long, power double, held long, total double, n long, early double, early_n long, loud double, quiet long, gaps long, gap_windows long, longest long, said boolean, done boolean"

NAMES = [c.split()[0] for c in RESULT.split(", ")]


def _db(power: float, n: int) -> float | None:
    return 10 * math.log10(power / n) if power > 0 else None


class Monitor:
    """One track's sums and runs; ``s`` is all it remembers, in the order of ``STATE``."""

    def __init__(self, rules: dict, state: tuple | None = None) -> None:
        self.r = rules
        fresh = (-1, 0, 0.0, 0, 0.0, 0, 0.0, 0, math.inf, -1, 0, 0, 0, False, False)
        self.s = dict(zip((c.split()[0] for c in STATE.split(", ")), state or fresh))
        self.out: list[dict] = []

    def add(self, window: int, power: float, n: int) -> None:
        """A part of a window; windows come in order, one may come in several parts."""
        s = self.s
        if window != s["open"]:
            s["open"], s["power"], s["held"] = window, 0.0, 0
        s["power"] += power
        s["held"] += n
        s["total"] += power
        s["n"] += n
        if window < self.r["early"]:
            s["early"] += power
            s["early_n"] += n
        if s["held"] == self.r["window"]:
            self._close(window)

    def _close(self, window: int) -> None:
        s = self.s
        db = _db(s["power"], s["held"])
        if db is None or db < self.r["quiet_db"]:
            s["quiet"] = window if s["quiet"] < 0 else s["quiet"]
        else:
            s["loud"] = min(s["loud"], db)
            self._gap(window)
        if window + 1 == self.r["early"] and not s["said"]:
            s["said"] = True
            self.out.append({"kind": "early", "verdict": self._verdict(False), "n": s["n"], "early_db": _db(s["early"], s["early_n"])})

    def _gap(self, end: int) -> None:
        """A quiet run that ended before window ``end``."""
        s = self.s
        length = end - s["quiet"] if s["quiet"] >= 0 else 0
        if length >= self.r["least"]:
            s["gaps"], s["gap_windows"], s["longest"] = s["gaps"] + 1, s["gap_windows"] + length, max(s["longest"], length)
            self.out.append({"kind": "gap", "start": s["quiet"], "length": length})
        s["quiet"] = -1

    def _verdict(self, final: bool) -> str:
        early, level = _db(self.s["early"], self.s["early_n"]), _db(self.s["total"], self.s["n"])
        if early is None or early < self.r["digital_db"]:
            return "dead"
        if final and (level is None or level < self.r["silent_db"]):
            return "silent"
        return "faint" if final and self.r["target_db"] - (level - 1) > self.r["most_gain_db"] else "ok"

    def finish(self) -> None:
        s = self.s
        whole = s["held"] == self.r["window"]
        self._gap(s["open"] + whole)
        loud = s["loud"] if math.isfinite(s["loud"]) else None
        levels = {"level_db": _db(s["total"], s["n"]), "early_db": _db(s["early"], s["early_n"]), "least_loud_db": loud}
        self.out.append({"kind": "final", "verdict": self._verdict(True), "n": s["n"], **levels, "gaps": s["gaps"], "gap_windows": s["gap_windows"], "longest_gap": s["longest"]})
        s["done"] = True


class HealthProcessor(StatefulProcessor):
    """Per track: a :class:`Monitor` in a value state, and a timer for the end of tracks that fall silent."""

    def __init__(self, rules: dict, idle_ms: int) -> None:
        self.rules, self.idle_ms = rules, idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.state = handle, handle.getValueState("health", STATE)

    def _told(self, key: Any, m: Monitor) -> Iterator[Row]:
        self.state.update(tuple(m.s.values()))
        return (Row(**dict.fromkeys(NAMES) | {"track": key[0]} | row) for row in m.out)

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:  # noqa: N802, N803
        known = self.state.get()
        m = Monitor(self.rules, tuple(known) if known else None)
        latest = timerValues.getCurrentWatermarkInMs() + 1
        for b in sorted(rows, key=lambda b: b["seq"]):
            latest = max(latest, b["at"])
            if m.s["done"] or b["seq"] <= m.s["seq"]:
                continue  # a block that came again, or after the end
            if b["seq"] != m.s["seq"] + 1:
                raise ValueError(f"track {key[0]}: block {m.s['seq'] + 1} is missing")
            m.s["seq"] = b["seq"]
            for w in b["windows"]:
                m.add(w["window"], w["power"], w["n"])
            if b["last"]:
                m.finish()
        for t in list(self.handle.listTimers()) if known else ():
            self.handle.deleteTimer(t)
        if not m.s["done"]:
            self.handle.registerTimer(latest + self.idle_ms)
        yield from self._told(key, m)

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[Row]:  # noqa: N802, N803
        m = Monitor(self.rules, tuple(self.state.get()))
        if not m.s["done"]:
            m.finish()
        yield from self._told(key, m)

    def close(self) -> None:
        pass


def health(stream: DataFrame, window: int, quiet_db: float = -60.0, least: int = 3, early: int = 30, digital_db: float = -100.0, silent_db: float = -60.0, target_db: float = -14.0, most_gain_db: float = 30.0, late: str = "1 minute", idle_ms: int = 600_000) -> DataFrame:
    """Rows of kind gap, early and final of ``stream(track, seq, ts, windows, last)``; the rules are those of ``standard.health``.

    Blocks that come again are skipped, those after a track's end too; a missing one is an error.
    """
    rules = {"window": window, "quiet_db": quiet_db, "least": least, "early": early, "digital_db": digital_db, "silent_db": silent_db, "target_db": target_db, "most_gain_db": most_gain_db}
    timed = stream.withWatermark("ts", late).withColumn("at", F.unix_millis(F.col("ts").cast("timestamp")))
    processor = HealthProcessor(rules, idle_ms)
    return timed.groupBy("track").transformWithState(statefulProcessor=processor, outputStructType=RESULT, outputMode="Append", timeMode="EventTime")
