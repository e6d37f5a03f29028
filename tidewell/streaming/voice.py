"""The latch and the gain on a stream of frames: a few numbers per track, results at once, equal to the batch."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from tidewell.operators import voice as V

RESULT = "track long, frame long, is_speech boolean, gain double"
STATE = "next long, speech boolean, held int, gain double"


class VoiceProcessor(StatefulProcessor):
    """Per track: the next frame, whether the latch is open, how long it holds, and the gain."""

    def __init__(self, enter: float, leave: float, hold: int, frame_rate: float) -> None:
        self.enter, self.leave, self.hold, self.alphas = enter, leave, hold, V.alphas(frame_rate)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("voice", STATE)

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        upcoming, speech, held, gain = self.state.get() if self.state.exists() else (0, False, 0, 1.0)
        f = pd.concat(list(rows)).sort_values("frame")
        f = f[f["frame"] >= upcoming].drop_duplicates("frame")  # frames that come again have had their answer
        if len(f) and f["frame"].tolist() != list(range(upcoming, upcoming + len(f))):
            raise ValueError(f"track {key[0]}: frame {upcoming} or one after it is missing")
        p, said = f["posterior"].to_numpy(float), []
        for x in p.tolist():
            if not speech and x > self.enter:
                speech, held = True, self.hold
            elif speech:
                if x > self.leave:
                    held = self.hold
                elif held:
                    held -= 1
                else:
                    speech = False
            said.append(speech)
        gains, gain = V.duck(p, gain, *self.alphas)
        self.state.update((upcoming + len(f), speech, held, float(gain)))
        yield pd.DataFrame({"track": np.full(len(f), key[0]), "frame": f["frame"].to_numpy(), "is_speech": np.array(said, bool), "gain": gains})

    def close(self) -> None:
        pass


def voice(stream: DataFrame, enter: float = V.ENTER, leave: float = V.LEAVE, hold: int = V.HOLD, frame_rate: float = 100.0) -> DataFrame:
    """``(track, frame, is_speech, gain)`` of ``stream(track, frame, posterior)``, a track's frames in order from 0."""
    processor = VoiceProcessor(enter, leave, hold, frame_rate)
    return stream.groupBy("track").transformWithStateInPandas(statefulProcessor=processor, outputStructType=RESULT, outputMode="Append", timeMode="None")
