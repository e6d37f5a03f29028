"""Window functions over ordered rows: runs, segments, peaks, smoothing and ranks."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window, WindowSpec, functions as F

def _by_track() -> WindowSpec:
    return Window.partitionBy("track").orderBy("idx")



def deltas(s: DataFrame, back: int = 1, first: float = -144.0) -> DataFrame:
    """Difference to the row before (``first`` stands before the first), and to ``back`` rows before (0 in warm-up)."""
    return s.select("track", "idx", (F.col("x") - F.lag("x", 1, first).over(_by_track())).alias("delta"), F.abs(F.coalesce(F.col("x") - F.lag("x", back).over(_by_track()), F.lit(0.0))).alias("back_delta"))


def rolling_count(s: DataFrame, condition: Column, size: int) -> DataFrame:
    """How many of the last ``size`` rows meet a condition; null in warm-up."""
    w = _by_track().rowsBetween(-(size - 1), 0)
    return s.select("track", "idx", F.when(F.count("*").over(w) == size, F.sum(condition.cast("int")).over(w)).alias("hits"))


def runs(s: DataFrame, condition: Column) -> DataFrame:
    """Maximal runs of consecutive rows that meet a condition: start, end (inclusive), length."""
    t = s.filter(condition).withColumn("island", F.col("idx") - F.row_number().over(_by_track()))
    return t.groupBy("track", "island").agg(F.min("idx").alias("start"), F.max("idx").alias("end"), F.count("*").alias("length"), F.avg("x").alias("mean")).drop("island")


def long_runs(s: DataFrame, condition: Column, least: int) -> DataFrame:
    """Number, total and longest of the runs of at least ``least`` rows, and the first five starts."""
    r = runs(s, condition).filter(F.col("length") >= least)
    return r.groupBy("track").agg(F.count("*").alias("events"), F.sum("length").alias("rows"), F.max("length").alias("longest"), F.array_join(F.slice(F.array_sort(F.collect_list("start")), 1, 5), ",").alias("first_starts"))


def longest_run(s: DataFrame, condition: Column) -> DataFrame:
    """The longest run of each track; the first on ties."""
    r = runs(s, condition)
    return r.groupBy("track").agg(F.min(F.struct((-F.col("length")).alias("neg"), "start")).alias("b")).select("track", F.col("b.start").alias("start"), (-F.col("b.neg")).alias("length"))


def quiet_ends(s: DataFrame, condition: Column) -> DataFrame:
    """Quiet rows before the first loud one and behind the last; an all-quiet track has no tail."""
    a = s.groupBy("track").agg(F.count("*").alias("n"), F.min(F.when(condition, F.col("idx"))).alias("a"), F.max(F.when(condition, F.col("idx"))).alias("b"))
    return a.select("track", F.coalesce("a", "n").alias("head"), F.coalesce(F.col("n") - 1 - F.col("b"), F.lit(0)).alias("tail"))


def local_peaks(s: DataFrame, half: int, sigmas: float, symmetric: bool) -> DataFrame:
    """Strict local maxima above the local mean plus deviations; the frame has or lacks its last row."""
    w = _by_track().rowsBetween(-half, half if symmetric else half - 1)
    t = s.withColumn("lim", F.avg("x").over(w) + sigmas * F.stddev_pop("x").over(w)).withColumn("a", F.lag("x").over(_by_track())).withColumn("b", F.lead("x").over(_by_track()))
    return t.filter((F.col("x") > F.col("lim")) & (F.col("x") > F.col("a")) & (F.col("x") > F.col("b"))).select("track", "idx", "x")


def spaced(peaks: DataFrame, distance: int) -> DataFrame:
    """Peaks at least ``distance`` behind the last one taken: a fold over each track's ordered positions."""
    ordered = peaks.groupBy("track").agg(F.array_sort(F.collect_list(F.col("idx").cast("long"))).alias("v"))
    fold = F.expr(f"aggregate(v, cast(array() as array<bigint>), (acc, i) -> case when size(acc) = 0 or i - try_element_at(acc, -1) >= {distance} then concat(acc, array(i)) else acc end)")
    return ordered.select("track", F.explode(fold).alias("idx"))


def sliding_median(s: DataFrame, half: int) -> DataFrame:
    """Median of 2*half+1 rows, the ends repeated beyond the edges."""
    w = Window.partitionBy("track")
    t = s.withColumn("n", F.count("*").over(w)).withColumn("near", F.collect_list("x").over(_by_track().rowsBetween(-half, half))).withColumn("first", F.first("x").over(_by_track())).withColumn("last", F.last("x").over(_by_track().rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    left = F.greatest(F.lit(half) - F.col("idx"), F.lit(0)).cast("int")
    right = F.greatest(F.col("idx") + half - (F.col("n") - 1), F.lit(0)).cast("int")
    v = F.array_sort(F.concat("near", F.array_repeat("first", left), F.array_repeat("last", right)))
    return t.select("track", "idx", F.element_at(v, half + 1).alias("median"))


def smoothed(s: DataFrame) -> DataFrame:
    """Mean of three neighbours (fewer at the ends)."""
    return s.select("track", "idx", F.avg("x").over(_by_track().rowsBetween(-1, 1)).alias("fir"))


def majority(s: DataFrame, condition: Column, half: int) -> DataFrame:
    """Centred vote of 2*half+1 rows; a tie is a no."""
    w = _by_track().rowsBetween(-half, half)
    return s.select("track", "idx", (2 * F.sum(condition.cast("int")).over(w) > F.count("*").over(w)).alias("vote"))


def confident_smoothing(s: DataFrame) -> DataFrame:
    """a += c (x - a) from a = 0: sequential per track, so a grouped pandas function."""

    def fold(t: pd.DataFrame) -> pd.DataFrame:
        t, a, out = t.sort_values("idx"), 0.0, []
        for x, c in zip(t["x"], t["c"]):
            a += c * (x - a)
            out.append(a)
        return pd.DataFrame({"track": t["track"], "idx": t["idx"], "a": out})

    return s.select("track", "idx", "x", "c").groupBy("track").applyInPandas(fold, "track long, idx long, a double")


def segments(s: DataFrame, condition: Column) -> DataFrame:
    """Stretches between changes of a condition, with their bounds and mean: flag, running sum, group."""
    t = s.withColumn("k", condition.cast("int"))
    t = t.withColumn("new", (F.col("k") != F.lag("k", 1, -1).over(_by_track())).cast("int")).withColumn("segment", F.sum("new").over(_by_track()))
    return t.groupBy("track", "segment").agg(F.min("idx").alias("start"), (F.max("idx") + 1).alias("end"), F.max("k").alias("kind"), F.avg("x").alias("mean"))


def best_window(s: DataFrame, size: int) -> DataFrame:
    """Start of the window of ``size`` rows with the largest sum; the last on ties."""
    w = _by_track().rowsBetween(-(size - 1), 0)
    t = s.withColumn("sum", F.round(F.sum("x").over(w), 9)).withColumn("k", F.count("*").over(w)).filter(F.col("k") == size)
    return t.groupBy("track").agg(F.max(F.struct("sum", "idx")).alias("b")).select("track", (F.col("b.idx") - (size - 1)).alias("start"), F.col("b.sum").alias("total"))


def zscores(d: DataFrame, column: str) -> DataFrame:
    """Population z-score of a column (0 where all are equal), joined from one global aggregate."""
    t = d.agg(F.avg(column).alias("m"), F.stddev_pop(column).alias("sd"))
    return d.crossJoin(F.broadcast(t)).withColumn("z", F.when(F.col("sd") > 0, (F.col(column) - F.col("m")) / F.col("sd")).otherwise(0.0)).drop("m", "sd")


def top(d: DataFrame, by: list[Column], n: int) -> DataFrame:
    """The first ``n`` rows in an order, with their rank; only ``n`` rows per task reach the last step."""
    return d.orderBy(*by).limit(n).withColumn("rank", F.row_number().over(Window.orderBy(*by)))


def retained(d: DataFrame, key: str, by: list[Column], cap: int) -> DataFrame:
    """The newest ``cap`` rows of each key."""
    return d.withColumn("rn", F.row_number().over(Window.partitionBy(key).orderBy(*by))).filter(F.col("rn") <= cap).drop("rn")


def contiguous(d: DataFrame, key: str, position: str) -> DataFrame:
    """Whether each key's positions are 1..n without gap or repeat."""
    return d.groupBy(key).agg(F.count("*").alias("n"), ((F.min(position) == 1) & (F.max(position) == F.count("*")) & (F.countDistinct(position) == F.count("*"))).alias("contiguous"))


def monocultures(s: DataFrame, span: float, least: int) -> DataFrame:
    """Greedy clusters: sorted values within ``span`` of a cluster's first; those of ``least`` or more."""

    def fold(t: pd.DataFrame) -> pd.DataFrame:
        start, members, out = None, 0, []
        for x in sorted(t["x"]):
            if start is None or x - start > span:
                if members >= least:
                    out.append((start, members))
                start, members = x, 0
            members += 1
        if members >= least:
            out.append((start, members))
        return pd.DataFrame({"track": [t["track"].iloc[0]] * len(out), "start": [a for a, _ in out], "members": [b for _, b in out]})

    return s.select("track", "x").groupBy("track").applyInPandas(fold, "track long, start double, members long")
