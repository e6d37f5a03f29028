"""Recursive filters as a scan over blocks: no track is one task's work.

A cascade of second-order sections is linear in its state and its input, so what a block does to the state
is a pair: the power of a matrix, and the state that the block leaves when it is entered with zeros (its
forced response). Pairs compose associatively. They are computed for all blocks at once, composed by groups of
``FAN`` blocks and over the groups, and every block is then filtered from the state it is entered with.
Within a block, runs of ``STEP`` samples are matrix products; only the state goes from run to run.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from tidewell.sources.storage import saved

from . import blocks as B, levels

STEP, FAN = 64, 256
Sections = tuple[tuple[tuple[float, ...], tuple[float, ...]], ...]


def sections(*pairs: tuple[Sequence[float], Sequence[float]]) -> Sections:
    """Sections (b, a) with a[0] = 1, as values that can be hashed."""
    return tuple((tuple(map(float, b)), tuple(map(float, a))) for b, a in pairs)


class Cascade:
    """Sections in series as matrices: ``of(cascade)`` keeps one per process."""

    def __init__(self, parts: Sections) -> None:
        k = 2 * len(parts)

        def step(state: np.ndarray, x: float) -> tuple[np.ndarray, float]:
            """One sample by the transposed direct form."""
            new = np.empty(k)
            for i, (b, a) in enumerate(parts):
                y = b[0] * x + state[2 * i]
                new[2 * i], new[2 * i + 1] = b[1] * x - a[1] * y + state[2 * i + 1], b[2] * x - a[2] * y
                x = y
            return new, x

        unit = [step(row, 0.0) for row in np.eye(k)]
        self.a = np.array([new for new, _ in unit]).T
        self.c = np.array([y for _, y in unit])
        self.b, self.d = step(np.zeros(k), 1.0)
        self.size = k
        powers = [np.eye(k)]
        for _ in range(STEP):
            powers.append(self.a @ powers[-1])
        self.powers = powers
        #: what the state adds to each of a run's outputs, what the inputs do, and what they leave in the state
        self.free = np.array([self.c @ p for p in powers[:STEP]])
        impulse = np.append(self.d, self.free[:-1] @ self.b)
        i, j = np.indices((STEP, STEP))
        self.forced = np.where(i >= j, impulse[np.maximum(i - j, 0)], 0.0)
        self.left = np.array([powers[STEP - 1 - t] @ self.b for t in range(STEP)])

    @functools.lru_cache(maxsize=64)  # noqa: B019  few lengths, and a cascade is kept for the life of a worker
    def power(self, n: int) -> np.ndarray:
        return np.linalg.matrix_power(self.a, n)

    def ends(self, x: np.ndarray) -> np.ndarray:
        """The state that each row of samples leaves when it is entered with zeros."""
        state = np.zeros((len(x), self.size))
        for at in range(0, x.shape[1], STEP):
            run = x[:, at : at + STEP]
            state = state @ self.powers[run.shape[1]].T + run @ self.left[STEP - run.shape[1] :]
        return state

    def run(self, x: np.ndarray, state: np.ndarray) -> np.ndarray:
        """Each row filtered, entered with its row of ``state``."""
        out = np.empty_like(x)
        for at in range(0, x.shape[1], STEP):
            run = x[:, at : at + STEP]
            m = run.shape[1]
            out[:, at : at + m] = run @ self.forced[:m, :m].T + state @ self.free[:m].T
            state = state @ self.powers[m].T + run @ self.left[STEP - m :]
        return out


@functools.lru_cache(maxsize=32)
def of(parts: Sections) -> Cascade:
    return Cascade(parts)


def filtered(parts: Sections, x: np.ndarray) -> np.ndarray:
    """One row of samples, from silence."""
    return of(parts).run(np.asarray(x, float)[None], np.zeros((1, 2 * len(parts))))[0]


Voices = Sequence[tuple[str, Sections]]  # a channel and the filter it goes through; a channel may have many


def _split(flat: np.ndarray, voices: Voices) -> list[np.ndarray]:
    """The states of the voices, side by side in the last axis of ``flat``."""
    return np.split(flat, np.cumsum([2 * len(parts) for _, parts in voices])[:-1], axis=-1)


def _compose(voices: Voices, n: list[int], left: np.ndarray, state: np.ndarray) -> np.ndarray:
    """The states before each of the blocks and after the last, from ``state`` on; ``left`` has the forced responses."""
    out = []
    for (_, parts), start, forced in zip(voices, _split(state, voices), _split(left, voices)):
        cascade, held = of(parts), [start]
        for k, f in zip(n, forced):
            held.append(cascade.power(k) @ held[-1] + f)
        out.append(np.array(held))
    return np.concatenate(out, axis=1)


def entries(b: DataFrame, voices: Voices) -> DataFrame:
    """(track, seq, state): the states with which every block is entered, the voices' side by side."""
    kind = b.schema["track"].dataType.simpleString()
    channels = list(dict.fromkeys(c for c, _ in voices))
    zero = np.zeros(sum(2 * len(parts) for _, parts in voices))

    def forced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows in B.by_length(batch):
                some = batch.take(pa.array(rows))
                x = {c: B.matrix(some.column(c)) for c in channels}
                left = np.concatenate([of(parts).ends(x[c]) for c, parts in voices], axis=1)
                yield pa.RecordBatch.from_arrays([some.column("track"), some.column("seq"), some.column("n"), B.lists(left)], ["track", "seq", "n", "left"])

    def states(t: pa.Table, entry: np.ndarray) -> np.ndarray:
        return _compose(voices, t.column("n").to_pylist(), B.matrix(t.column("left")), entry)

    def whole(t: pa.Table) -> pa.Table:
        t = t.sort_by("seq")
        last = states(t, zero)[-1:]
        return pa.table({"track": t.column("track")[:1], "span": t.column("span")[:1], "n": pa.array([sum(t.column("n").to_pylist())], pa.int64()), "left": B.lists(last)})

    def between(t: pa.Table) -> pa.Table:
        t = t.sort_by("span")
        return pa.table({"track": t.column("track"), "span": t.column("span"), "entry": B.lists(states(t, zero)[:-1])})

    def inside(t: pa.Table) -> pa.Table:
        t = t.sort_by("seq")
        before = states(t, B.matrix(t.column("entry"))[0])[:-1]
        return pa.table({"track": t.column("track"), "seq": t.column("seq"), "state": B.lists(before)})

    pairs = b.select("track", "seq", "n", *channels).mapInArrow(forced, f"track {kind}, seq long, n int, left array<double>")
    pairs = saved(pairs.withColumn("n", F.col("n").cast("long")).withColumn("span", F.floor(F.col("seq") / FAN)))
    spans = pairs.groupBy("track", "span").applyInArrow(whole, f"track {kind}, span long, n long, left array<double>")
    entry = spans.groupBy("track").applyInArrow(between, f"track {kind}, span long, entry array<double>")
    return pairs.join(entry, ["track", "span"]).groupBy("track", "span").applyInArrow(inside, f"track {kind}, seq long, state array<double>")


def entered(b: DataFrame, voices: Voices) -> DataFrame:
    """The blocks with the states they are entered with."""
    return b.join(entries(b, voices), ["track", "seq"]).select("track", "seq", "n", *dict.fromkeys(c for c, _ in voices), "state")


def voiced(batch: pa.RecordBatch, voices: Voices) -> Iterator[tuple[pa.RecordBatch, list[np.ndarray]]]:
    """Rows of equal length, and each voice's samples of them."""
    for rows in B.by_length(batch):
        some = batch.take(pa.array(rows))
        x = {c: B.matrix(some.column(c)) for c, _ in voices}
        yield some, [of(parts).run(x[c], state) for (c, parts), state in zip(voices, _split(B.matrix(some.column("state")), voices))]


def filtered_blocks(b: DataFrame, parts: Sections | dict[str, tuple[str, Sections]], channels: Sequence[str] = ("x",)) -> DataFrame:
    """The blocks with every channel filtered, or with the named voices of a bank (name: channel and filter) as columns.

    Tracks start from silence; an empty table gives an empty one.
    """
    bank = parts if isinstance(parts, dict) else {c: (c, parts) for c in channels}
    kind, voices = b.schema["track"].dataType.simpleString(), list(bank.values())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, out in voiced(batch, voices):
                yield pa.RecordBatch.from_arrays([*(rows.column(c) for c in ("track", "seq", "n")), *(B.lists(y) for y in out)], ["track", "seq", "n", *bank])

    return entered(b, voices).mapInArrow(run, f"track {kind}, seq long, n int, {', '.join(f'{c} array<double>' for c in bank)}")


def block_powers(b: DataFrame, bank: dict[str, tuple[str, Sections]]) -> DataFrame:
    """(track, seq, n, one column per voice): the sum of each voice's squares over a block; no samples are kept."""
    kind, voices = b.schema["track"].dataType.simpleString(), list(bank.values())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, out in voiced(batch, voices):
                yield pa.RecordBatch.from_arrays([*(rows.column(c) for c in ("track", "seq", "n")), *(pa.array((y * y).sum(axis=1)) for y in out)], ["track", "seq", "n", *bank])

    return entered(b, voices).mapInArrow(run, f"track {kind}, seq long, n int, {', '.join(f'{c} double' for c in bank)}")


def hop_powers(b: DataFrame, size: int, parts: Sections, hop: int, weights: dict[str, float]) -> DataFrame:
    """(track, hop, power): the weighted sum of the filtered channels' squares over each whole hop of ``hop`` samples.

    ``size`` is that of the blocks, a multiple of ``hop``. Filter and sums are one pass over a block; samples
    do not leave it. A block without a whole hop has one row of nulls.
    """
    if size % hop:
        raise ValueError("the block size must be a multiple of the hop")
    kind, voices = b.schema["track"].dataType.simpleString(), [(c, parts) for c in weights]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, out in voiced(batch, voices):
                power = sum(w * y * y for w, y in zip(weights.values(), out))
                many = power.shape[1] // hop
                sums = power[:, : many * hop].reshape(len(power), many, hop).sum(axis=2)
                yield pa.RecordBatch.from_arrays([rows.column("track"), rows.column("seq"), B.lists(sums)], ["track", "seq", "sums"])

    held = entered(b, voices).mapInArrow(run, f"track {kind}, seq long, sums array<double>")
    each = held.select("track", "seq", F.posexplode_outer("sums").alias("at", "power"))
    return each.select("track", (F.col("seq") * (size // hop) + F.col("at")).alias("hop"), "power")


def gated(hops: DataFrame, hop: int, per: int = 4, floor_db: float = -70.0, below_db: float = -10.0) -> DataFrame:
    """``(track, level_db, windows, kept)`` from :func:`hop_powers`: mean of the windows that pass both gates.

    A window is ``per`` hops in a row. The first gate is at ``floor_db``, the second ``below_db`` under the level of
    what passed the first; both let through what lies on them. A track without a window has no level (null);
    one of which nothing passes has that of silence. All three steps share one shuffle, on the track.
    """
    track = Window.partitionBy("track")
    near = track.orderBy("hop").rowsBetween(1 - per, 0)
    level = lambda p: -0.691 + levels.power_db(p)
    z = F.when(F.count("power").over(near) == per, F.sum("power").over(near) / (per * hop))
    rows = hops.withColumn("z", z).withColumn("first", F.when(level(F.col("z")) >= floor_db, F.col("z")))
    rows = rows.withColumn("mean", F.avg("first").over(track))
    rows = rows.withColumn("second", F.when(level(F.col("first")) >= level(F.col("mean")) + below_db, F.col("first")))
    found = rows.groupBy("track").agg(F.avg("second").alias("p"), F.count("z").alias("windows"), F.count("second").alias("kept"))
    return found.select("track", F.when(F.col("kept") > 0, level(F.col("p"))).when(F.col("windows") > 0, levels.SILENCE_DB).alias("level_db"), "windows", "kept")


#: The weights of the six channels left, right, centre, low, left and right surround.
SURROUND = {"l": 1.0, "r": 1.0, "c": 1.0, "lfe": 0.0, "ls": 1.4125375, "rs": 1.4125375}
STEREO = {"l": 1.0, "r": 1.0}


def loudness(s: DataFrame, parts: Sections, weights: dict[str, float] = STEREO, hop: int = 4800, size: int = 48_000) -> DataFrame:
    """Integrated loudness of ``s(track, idx, channels...)``: weighting filter, powers of hops, both gates.

    Channels of weight 0 are not filtered. A null or non-finite sample counts as 0.
    """
    heard = {c: w for c, w in weights.items() if w}
    return gated(hop_powers(B.blocks(s, size, list(heard)), size, parts, hop, heard), hop)
