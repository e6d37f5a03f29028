"""Scalar expressions on samples, levels and text: all are columns that Spark compiles."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def mono(l: Column, r: Column) -> Column:
    return (l + r) * 0.5


def mid_side(l: Column, r: Column) -> tuple[Column, Column]:
    return (l + r) * 0.5, (l - r) * 0.5


def left_right(mid: Column, side: Column) -> tuple[Column, Column]:
    return mid + side, mid - side


def folded(channels: Column) -> tuple[Column, Column]:
    """Mean of the even-numbered channels, and of the odd ones; zero without any."""
    mean = lambda odd: F.coalesce(F.try_divide(F.aggregate(F.filter(channels, lambda x, i: i % 2 == odd), F.lit(0.0), lambda s, x: s + x), F.size(F.filter(channels, lambda x, i: i % 2 == odd))), F.lit(0.0))
    return mean(0), mean(1)


def surround_to_stereo(c: list[Column]) -> tuple[Column, Column]:
    """Left, right, centre, (low effects dropped), rear left, rear right."""
    k = 2**-0.5
    return c[0] + k * c[2] + k * c[4], c[1] + k * c[2] + k * c[5]


def finite(x: Column) -> Column:
    """Zero for what is not a number or infinite."""
    return F.when(F.isnan(x) | (F.abs(x) == float("inf")), 0.0).otherwise(x)


def lerp(a: Column, b: Column, t: Column) -> Column:
    return a + (b - a) * t


def s_curve(t: Column) -> Column:
    return 3 * t * t - 2 * t * t * t


def exponential(t: Column, k: float) -> Column:
    """Runs from 0 to 1 with curvature ``k``."""
    return (F.exp(k * t) - 1) / (F.exp(F.lit(k)) - 1)


def shaped(t: Column, shape: str) -> Column:
    return {"linear": t, "root": F.sqrt(t), "square": t * t}[shape]


def sigmoid(x: Column, temperature: float) -> Column:
    return 1 / (1 + F.exp(-x / temperature))


def logistic_map(seed: Column, r: float, turns: int) -> Column:
    """x -> r x (1 - x), ``turns`` times."""
    return F.aggregate(F.sequence(F.lit(1), F.lit(turns)), seed, lambda x, _: r * x * (1 - x))


def hz_to_mel(f: Column) -> Column:
    return 2595 * F.log10(1 + f / 700)


def mel_to_hz(m: Column) -> Column:
    return 700 * (F.pow(F.lit(10.0), m / 2595) - 1)


def bark(f: Column) -> Column:
    """Critical-band rate by the arctangent formula."""
    return 13 * F.atan(0.00076 * f) + 3.5 * F.atan(F.pow(f / 7500, 2))


def piecewise(x: Column, points: list[tuple[float, float]]) -> Column:
    """Linear between points, constant outside."""
    out = F.lit(points[-1][1])
    for (a, ya), (b, yb) in reversed(list(zip(points, points[1:]))):
        out = F.when(x < b, ya + (yb - ya) * (F.greatest(x, F.lit(a)) - a) / (b - a)).otherwise(out)
    return out


def projected(x: Column, y: Column, ax: float, ay: float, bx: float, by: float) -> tuple[Column, Column]:
    """Leaning of a point (clamped to +-3) between two centres, and confidence with a penalty off the axis.

    Not-a-number and infinite inputs give (0.5, 0).
    """
    cut = lambda v: F.greatest(F.least(v, F.lit(3.0)), F.lit(-3.0))
    dx, dy = bx - ax, by - ay
    n2 = dx * dx + dy * dy
    t = ((cut(x) - ax) * dx + (cut(y) - ay) * dy) / n2
    off = F.abs((cut(x) - ax) * dy - (cut(y) - ay) * dx) / n2**0.5
    lean = F.greatest(F.least(t, F.lit(1.0)), F.lit(0.0))
    bad = F.isnan(x) | F.isnan(y) | (F.abs(x) == float("inf")) | (F.abs(y) == float("inf"))
    return F.when(bad, 0.5).otherwise(lean), F.when(bad, 0.0).otherwise(F.abs(lean - 0.5) * 2 / (1 + off))


def goal(text: Column, words: list[tuple[str, list[str]]], default: str) -> Column:
    """The first goal one of whose words is in the text; ``_`` and blank are the same."""
    t, out = F.lower(F.regexp_replace(text, "_", " ")), F.lit(default)
    for name, keys in reversed(words):
        hit = F.lit(False)
        for k in keys:
            hit = hit | t.contains(k)
        out = F.when(hit, name).otherwise(out)
    return out


def jitter(key: Column, field: str, spread: float) -> Column:
    """A factor in 1 +- spread fixed by a key and a field's name."""
    h = F.conv(F.substring(F.md5(F.concat_ws(":", key.cast("string"), F.lit(field))), 1, 8), 16, 10).cast("double") / float(1 << 32)
    return 1 + spread * (2 * h - 1)


def numbered(position: Column, count: Column, title: Column) -> Column:
    """A file name: the position padded to the width of the count, and the title."""
    return F.concat(F.lpad(position.cast("string"), F.length(count.cast("string")), F.lit("0")), F.lit("_"), title)
