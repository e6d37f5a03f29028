"""Convolutive factorisation of spectrograms: components that are short patterns in time, shared by all tracks.

V ~ sum over t of W[t] (H shifted by t). With the divergence's multiplicative updates, what a track adds
to the update of W is a numerator and a denominator that add up over tracks, and the update of H needs only the
track and the new W. So a round is one pass over the tracks: update H by the last W, then add up for the next.
W (components x bins x reach) is small and goes to every task; a track's V and H stay in its row. Frozen
components keep their patterns and only have their activations fitted.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tidewell.sources.storage import saved

from .spectral import frames, hann

EPS = float(np.finfo(np.float64).eps)


def shifted(x: np.ndarray, t: int) -> np.ndarray:
    """Columns moved t places to the right (left if negative), zeros coming in."""
    out = np.zeros_like(x)
    if t == 0:
        return x
    if abs(t) < x.shape[1]:
        if t > 0:
            out[:, t:] = x[:, :-t]
        else:
            out[:, :t] = x[:, -t:]
    return out


def model(w: np.ndarray, h: np.ndarray) -> np.ndarray:
    """The spectrogram that patterns w (reach, bins, components) and activations h make."""
    return sum(p @ shifted(h, t) for t, p in enumerate(w)) + EPS


def ratio(v: np.ndarray, w: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, float]:
    """What the updates need of a track, V / model, and its divergence."""
    lam = model(w, h)
    return v / (lam + EPS), float((v * np.log(1 + v / (lam + EPS)) - v + lam).mean())


def evidence(q: np.ndarray, h: np.ndarray, reach: int) -> tuple[np.ndarray, np.ndarray]:
    """A track's part of the update of W: (reach, bins, components) and (reach, components)."""
    moved = [shifted(h, t) for t in range(reach)]
    return np.array([q @ m.T for m in moved]), np.array([m.sum(axis=1) for m in moved])


def patterns(w: np.ndarray, top: np.ndarray, below: np.ndarray, frozen: int) -> np.ndarray:
    """The next W; the first ``frozen`` components stay as they are."""
    new = w * top / (below + EPS)[:, None, :]
    new[:, :, :frozen] = w[:, :, :frozen]
    return new


def activations(q: np.ndarray, w: np.ndarray, h: np.ndarray) -> np.ndarray:
    """A track's next H, from its ratio under the W before."""
    up = sum((p.T @ shifted(q, -t)) / (p.sum(axis=0) + EPS)[:, None] for t, p in enumerate(w))
    return h * up / len(w)


def first_guess(bins: int, components: int, reach: int, frozen: np.ndarray | None, seed: int) -> np.ndarray:
    """Random patterns; given ones (reach, bins, components of theirs) stand in front."""
    have = 0 if frozen is None else frozen.shape[2]
    w = np.random.default_rng(seed).random((reach, bins, components))
    if frozen is not None:
        w[:, :, :have] = frozen
    return w


def spectrograms(s: DataFrame, size: int, hop: int) -> DataFrame:
    """``(track, n, v)``: the magnitudes (bins x n frames, row by row) of ``s(track, idx, x)``, divided by their sum."""
    kind = s.schema["track"].dataType.simpleString()

    def run(t: pa.Table) -> pa.Table:
        x = np.nan_to_num(np.asarray(t.sort_by("idx").column("x"), np.float64), nan=0.0, posinf=0.0, neginf=0.0)
        v = np.abs(np.fft.rfft(frames(x, size, hop) * hann(size))).T
        return pa.table({"track": t.column("track")[:1], "n": pa.array([v.shape[1]], pa.int32()), "v": pa.array([(v / (EPS + v.sum())).ravel()], pa.list_(pa.float64()))})

    return s.select("track", "idx", "x").groupBy("track").applyInArrow(run, f"track {kind}, n int, v array<double>")


def factorised(v: DataFrame, bins: int, components: int, reach: int, rounds: int = 30, frozen: np.ndarray | None = None, seed: int = 0) -> tuple[np.ndarray, DataFrame, list[float]]:
    """``(W, table (track, n, h, cost), costs)`` of ``v(track, n, v)``; h is components x n, row by row.

    ``costs`` has the mean divergence of the tracks before each round; the table's ``cost`` is the one after the last.
    H starts at one everywhere, so results do not depend on how tracks are dealt out (but for the last digits of
    sums). A track without energy keeps patterns as they are. No tracks: the first guess, and empty tables.
    """
    kind = v.schema["track"].dataType.simpleString()
    fixed = 0 if frozen is None else frozen.shape[2]
    schema = f"track {kind}, n int, v array<double>, h array<double>, cost double, top array<double>, below array<double>, tracks long"

    def turn(old: np.ndarray | None, new: np.ndarray):  # noqa: ANN202
        """One pass: H by ``new`` (from one everywhere where there is no ``old``), and the sums of all tracks of a task in one more row."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            top, below, total, tracks = np.zeros((reach, bins, components)), np.zeros((reach, components)), 0.0, 0
            number, many = pa.float64(), pa.list_(pa.float64())

            def row(track: pa.Array, n: list, *cells: list) -> pa.RecordBatch:
                kinds = many, many, number, many, many, pa.int64()
                return pa.RecordBatch.from_arrays([track, pa.array(n, pa.int32()), *(pa.array(c, k) for c, k in zip(cells, kinds))], ["track", "n", "v", "h", "cost", "top", "below", "tracks"])

            for batch in batches:
                for i in range(batch.num_rows):
                    n = batch.column("n")[i].as_py()
                    x = np.asarray(batch.column("v")[i].values, np.float64).reshape(bins, n)
                    if old is None:
                        h = np.ones((components, n))
                    else:
                        h = np.asarray(batch.column("h")[i].values, np.float64).reshape(components, n)
                        h = activations(ratio(x, old, h)[0], new, h)
                    q, cost = ratio(x, new, h)
                    a, b = evidence(q, h, reach)
                    top, below, total, tracks = top + a, below + b, total + cost, tracks + 1
                    yield row(batch.column("track").slice(i, 1), [n], [x.ravel()], [h.ravel()], [cost], [None], [None], [None])
            if tracks:
                yield row(pa.nulls(1, batch.schema.field("track").type), [None], [None], [None], [total], [top.ravel()], [below.ravel()], [tracks])

        return run

    def added(rows: DataFrame) -> tuple | None:
        """The tasks' sums, added up in a tree."""
        plus = lambda a, b: b if a is None else a if b is None else tuple(x + y for x, y in zip(a, b))
        take = lambda r: (np.asarray(r["top"]), np.asarray(r["below"]), r["cost"], r["tracks"])
        return rows.filter("tracks is not null").select("top", "below", "cost", "tracks").rdd.map(take).treeAggregate(None, plus, plus)

    w, old, costs = first_guess(bins, components, reach, frozen, seed), None, []
    held = saved(v.mapInArrow(turn(None, w), schema))
    found = added(held)
    for _ in range(rounds if found else 0):
        top, below, total, tracks = found
        costs.append(total / tracks)
        old, w = w, patterns(w, top.reshape(w.shape), below.reshape(reach, components), fixed)
        held = saved(held.filter("tracks is null").mapInArrow(turn(old, w), schema), instead=held)
        found = added(held)
    return w, held.filter("tracks is null").select("track", "n", "h", "cost"), costs
