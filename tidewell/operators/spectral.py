"""Transforms and filters of one track at a time: recursive state never crosses a track.

Each takes rows ``(track, idx, x)`` and runs as a grouped Arrow function, so tracks are the unit of
parallelism; a track must fit a task, as its samples are sequential by nature.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from . import recurrences


ARROW = {"long": pa.int64(), "double": pa.float64(), "int": pa.int32()}


def per_track(s: DataFrame, f: Callable[[np.ndarray], dict[str, np.ndarray | list]], schema: str) -> DataFrame:
    """Apply ``f`` to each track's samples in order; it returns equally long columns, named and typed by ``schema``."""
    kinds = [c.split() for c in schema.split(", ")]
    fields = pa.schema([("track", pa.int64()), *((name, ARROW[kind]) for name, kind in kinds)])

    def run(t: pa.Table) -> pa.Table:
        out = f(np.asarray(t.sort_by("idx").column("x"), float))
        many = len(out[kinds[0][0]])
        return pa.table([pa.array(np.full(many, t.column("track")[0].as_py(), np.int64)), *(pa.array(out[name], ARROW[kind]) for name, kind in kinds)], schema=fields)

    return s.select(F.col("track").cast("long").alias("track"), "idx", F.col("x").cast("double").alias("x")).groupBy("track").applyInArrow(run, f"track long, {schema}")


def hann(n: int) -> np.ndarray:
    return 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(n) / n)


def frames(x: np.ndarray, size: int, hop: int, centre: bool = True) -> np.ndarray:
    """Frames of ``size`` every ``hop``, zero-padded half a frame at both ends if centred."""
    if centre:
        x = np.concatenate([np.zeros(size // 2), x, np.zeros(size // 2)])
    if len(x) < size:
        x = np.append(x, np.zeros(size - len(x)))
    n = 1 + (len(x) - size) // hop
    return x[np.arange(n)[:, None] * hop + np.arange(size)]


def stft(x: np.ndarray, size: int, hop: int) -> np.ndarray:
    return np.fft.rfft(frames(x, size, hop) * hann(size))


def istft(z: np.ndarray, size: int, hop: int, length: int) -> np.ndarray:
    """Weighted overlap-add; the inverse of :func:`stft` where windows overlap."""
    w, n = hann(size), len(z)
    out, norm = np.zeros(size + hop * (n - 1)), np.zeros(size + hop * (n - 1))
    for i, f in enumerate(np.fft.irfft(z, size)):
        out[i * hop : i * hop + size] += f * w
        norm[i * hop : i * hop + size] += w * w
    y = out / np.where(norm > 1e-8, norm, 1)
    return y[size // 2 : size // 2 + length]


def descriptors(x: np.ndarray, size: int, hop: int, rate: float) -> dict[str, list]:
    """Centroid, flatness and crest of the spectrum, averaged over frames that are not silent."""
    m = np.abs(stft(x, size, hop))
    m = m[m.sum(axis=1) > 1e-10]
    if not len(m):
        return {"centroid": [1000.0], "flatness": [0.5], "crest": [10.0]}
    f = np.fft.rfftfreq(size, 1 / rate)
    p = m * m + 1e-20
    return {"centroid": [float(((m * f).sum(axis=1) / m.sum(axis=1)).mean())], "flatness": [float((np.exp(np.log(p).mean(axis=1)) / p.mean(axis=1)).mean())], "crest": [float((m.max(axis=1) / m.mean(axis=1)).mean())]}


def flux(x: np.ndarray, size: int, hop: int) -> np.ndarray:
    """Sum of the rises of magnitude from frame to frame, scaled to at most one."""
    m = np.abs(stft(x, size, hop))
    r = np.append(0, np.maximum(np.diff(m, axis=0), 0).sum(axis=1))
    return r / r.max() if r.max() > 0 else r


def mel_filters(bands: int, size: int, rate: float) -> np.ndarray:
    """Triangles evenly spaced in mel."""
    mel, hz = (lambda f: 2595 * np.log10(1 + f / 700)), (lambda m: 700 * (10 ** (m / 2595) - 1))
    edge = hz(np.linspace(mel(0), mel(rate / 2), bands + 2))
    f = np.fft.rfftfreq(size, 1 / rate)
    up, down = (f - edge[:-2, None]) / (edge[1:-1] - edge[:-2])[:, None], (edge[2:, None] - f) / (edge[2:] - edge[1:-1])[:, None]
    return np.maximum(0, np.minimum(up, down))


def mfcc(x: np.ndarray, size: int, hop: int, rate: float, bands: int = 26, keep: int = 13) -> np.ndarray:
    """Cosine transform of the log mel energies."""
    p = np.abs(np.fft.rfft(frames(x, size, hop, centre=False) * hann(size))) ** 2
    e = np.log10(np.maximum(p @ mel_filters(bands, size, rate).T, 1e-10))
    return e @ np.cos(np.pi * np.arange(keep)[:, None] * (np.arange(bands) + 0.5) / bands).T


def biquad(kind: str, rate: float, f0: float, q: float, gain_db: float = 0.0) -> tuple[np.ndarray, np.ndarray]:
    """Second-order sections of the audio cookbook: lowpass, highpass, notch, peak, lowshelf, highshelf."""
    w, a = 2 * np.pi * f0 / rate, 10 ** (gain_db / 40)
    c, al = np.cos(w), np.sin(w) / (2 * q)
    s = 2 * np.sqrt(a) * al
    b, d = {
        "lowpass": ([(1 - c) / 2, 1 - c, (1 - c) / 2], [1 + al, -2 * c, 1 - al]),
        "highpass": ([(1 + c) / 2, -1 - c, (1 + c) / 2], [1 + al, -2 * c, 1 - al]),
        "notch": ([1, -2 * c, 1], [1 + al, -2 * c, 1 - al]),
        "peak": ([1 + al * a, -2 * c, 1 - al * a], [1 + al / a, -2 * c, 1 - al / a]),
        "lowshelf": ([a * (a + 1 - (a - 1) * c + s), 2 * a * (a - 1 - (a + 1) * c), a * (a + 1 - (a - 1) * c - s)], [a + 1 + (a - 1) * c + s, -2 * (a - 1 + (a + 1) * c), a + 1 + (a - 1) * c - s]),
        "highshelf": ([a * (a + 1 + (a - 1) * c + s), -2 * a * (a - 1 + (a + 1) * c), a * (a + 1 + (a - 1) * c - s)], [a + 1 - (a - 1) * c + s, 2 * (a - 1 - (a + 1) * c), a + 1 - (a - 1) * c - s]),
    }[kind]
    return np.array(b) / d[0], np.array(d) / d[0]


def filtered(b: np.ndarray, a: np.ndarray, x: np.ndarray) -> np.ndarray:
    """A second-order section over one track's samples; see ``recurrences`` for tracks of many blocks."""
    return recurrences.filtered(recurrences.sections((b, a)), x)


#: The two sections of the loudness weighting at 48 kHz.
K_SHELF = (np.array([1.53512485958697, -2.69169618940638, 1.19839281085285]), np.array([1.0, -1.69065929318241, 0.73248077421585]))
K_HIGHPASS = (np.array([1.0, -2.0, 1.0]), np.array([1.0, -1.99004745483398, 0.99007225036621]))


K_WEIGHTING = recurrences.sections(K_SHELF, K_HIGHPASS)


def k_weighted(x: np.ndarray) -> np.ndarray:
    return recurrences.filtered(K_WEIGHTING, x)


def true_peak(x: np.ndarray, factor: int = 4, taps: int = 12) -> float:
    """Largest magnitude after oversampling with a windowed sinc."""
    if not len(x):
        return 0.0
    n = np.arange(-taps * factor, taps * factor + 1)
    h = np.sinc(n / factor) * np.hanning(len(n) + 2)[1:-1]
    up = np.zeros(len(x) * factor)
    up[::factor] = x
    return float(max(np.abs(np.convolve(up, h, "same")).max(), np.abs(x).max()))


def resampled(x: np.ndarray, source: int, target: int, taps: int = 32) -> np.ndarray:
    """Windowed-sinc interpolation at the target's instants."""
    n = int(len(x) * target / source)
    at = np.arange(n) * source / target
    k = np.floor(at).astype(int)[:, None] + np.arange(-taps + 1, taps + 1)
    cut = min(1.0, target / source)
    d = at[:, None] - k
    w = cut * np.sinc(cut * d) * (0.5 + 0.5 * np.cos(np.pi * np.clip(d / taps, -1, 1)))
    return (np.where((k >= 0) & (k < len(x)), x[np.clip(k, 0, max(len(x) - 1, 0))], 0) * w).sum(axis=1)


def walsh_hadamard(x: np.ndarray) -> np.ndarray:
    """Orthonormal transform of a power of two of values."""
    y, h = x.astype(float).copy(), 1
    while h < len(y):
        y = y.reshape(-1, 2, h)
        y = np.stack([y[:, 0] + y[:, 1], y[:, 0] - y[:, 1]], axis=1).reshape(-1)
        h *= 2
    return y / np.sqrt(len(y))


def hpss(m: np.ndarray, half: int = 8) -> tuple[np.ndarray, np.ndarray]:
    """Soft masks of what is steady in time and what is broad in frequency, by running medians."""
    pad = lambda axis: np.pad(m, [(half, half) if i == axis else (0, 0) for i in (0, 1)], mode="edge")
    run = lambda axis: np.median(np.lib.stride_tricks.sliding_window_view(pad(axis), 2 * half + 1, axis=axis), axis=-1)
    h, p = run(0) ** 2, run(1) ** 2
    return h / (h + p + 1e-12), p / (h + p + 1e-12)


def nmf(v: np.ndarray, k: int = 5, turns: int = 30, sparsity: float = 0.1, seed: int = 42, w: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Multiplicative updates of V ~ W H; columns of W sum to one; a given W stays as it is."""
    g = np.random.default_rng(seed)
    fixed = w is not None
    w = g.random((v.shape[0], k)) + 1e-3 if w is None else w
    h = g.random((w.shape[1], v.shape[1])) + 1e-3
    for _ in range(turns):
        h *= (w.T @ v) / (w.T @ w @ h + sparsity + 1e-12)
        if not fixed:
            w *= (v @ h.T) / (w @ h @ h.T + 1e-12)
            total = w.sum(axis=0) + 1e-12
            w, h = w / total, h * total[:, None]
    return w, h


def envelope(x: np.ndarray, attack: float, release: float) -> np.ndarray:
    """One-pole follower of the magnitude with two speeds."""
    e, out = 0.0, np.empty(len(x))
    for i, v in enumerate(np.abs(x).tolist()):
        e += (attack if v > e else release) * (v - e)
        out[i] = e
    return out


def compressed(x: np.ndarray, threshold_db: float, ratio: float, knee_db: float, attack: float, release: float) -> np.ndarray:
    """Soft-knee gain computer over the envelope."""
    level = 20 * np.log10(np.maximum(envelope(x, attack, release), 1e-6))
    over = level - threshold_db
    soft = np.where(over <= -knee_db / 2, 0, np.where(over >= knee_db / 2, over, (over + knee_db / 2) ** 2 / (2 * knee_db) if knee_db else over))
    return x * 10 ** (-soft * (1 - 1 / ratio) / 20)


def limited(x: np.ndarray, ceiling: float, ahead: int, release: float) -> np.ndarray:
    """Brick wall with look-ahead: the gain meets every coming peak, then recovers."""
    if not len(x):
        return x
    padded = np.append(np.abs(x), np.zeros(ahead))
    peak = np.lib.stride_tricks.sliding_window_view(padded, ahead + 1).max(axis=1)
    need = np.minimum(1, ceiling / np.maximum(peak, 1e-12))
    g, out = 1.0, np.empty(len(x))
    for i, n in enumerate(need.tolist()):
        g = min(n, g + release * (1 - g))
        out[i] = g
    return x * out


def gate(x: np.ndarray, threshold: float, hold: int, release: float) -> np.ndarray:
    """Open above the threshold and for ``hold`` samples after, then fading."""
    g, left, out = 0.0, 0, np.empty(len(x))
    for i, v in enumerate(np.abs(x).tolist()):
        left = hold if v >= threshold else left - 1
        g = 1.0 if left > 0 or v >= threshold else g * (1 - release)
        out[i] = g
    return x * out


def dehum(x: np.ndarray, rate: float, base: float = 50.0, harmonics: int = 4, q: float = 30.0) -> np.ndarray:
    """Notches at multiples of the mains frequency below half the rate."""
    for k in range(1, harmonics + 1):
        if base * k < rate / 2:
            x = filtered(*biquad("notch", rate, base * k, q), x)
    return x


def chain(x: np.ndarray, nodes: list[tuple[str, dict]]) -> np.ndarray:
    """Run a list of named nodes in order; an unknown name is an error."""
    known: dict[str, Callable[..., np.ndarray]] = {"gain": lambda x, gain: x * gain, "biquad": lambda x, **p: filtered(*biquad(**p), x), "compressor": compressed, "limiter": limited, "gate": gate, "dehum": dehum, "k_weighting": k_weighted}
    for name, parameters in nodes:
        x = known[name](x, **parameters)
    return x
