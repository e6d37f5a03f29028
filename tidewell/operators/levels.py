"""Level meters: aggregates of ordered samples per track, in plain DataFrame expressions.

All take rows ``(track, idx, x)`` or ``(track, idx, l, r)`` and shuffle once, on ``track``; blocks and
windows are partial aggregates below it. Nothing is collected per track but block values.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

SILENCE_DB, EPS_DB = -144.0, 1e-30


def power_db(p: Column, floor: float = SILENCE_DB, eps: float = EPS_DB) -> Column:
    """Decibels of a power; the floor where it is tiny or missing."""
    return F.when(p.isNull() | (p < eps), F.lit(floor)).otherwise(10 * F.log10(p))


def amplitude_db(a: Column, floor: float = -120.0, eps: float = 1e-6) -> Column:
    """Decibels of an amplitude; the floor below ``eps``."""
    return F.when(a.isNull() | (a < eps), F.lit(floor)).otherwise(20 * F.log10(a))


def level_stats(s: DataFrame) -> DataFrame:
    """RMS and crest in decibels, peak, and both again after the mean is taken out."""
    mean, square = F.avg("x"), F.avg(F.col("x") * F.col("x"))
    a = s.groupBy("track").agg(F.count("*").alias("n"), square.alias("p"), F.max(F.abs("x")).alias("peak"), mean.alias("mu"), F.max("x").alias("hi"), F.min("x").alias("lo"))
    rms = F.sqrt("p")
    crest = F.when(rms < 1e-10, 0.0).otherwise(20 * F.log10(F.when(F.col("peak") > 0, F.col("peak")) / F.when(rms > 0, rms)))
    return a.select("track", "n", power_db(F.col("p")).alias("rms_db"), F.coalesce(crest, F.lit(0.0)).alias("crest_db"), "peak", F.greatest(F.col("hi") - F.col("mu"), F.col("mu") - F.col("lo")).alias("dc_free_peak"), F.sqrt(F.greatest(F.col("p") - F.col("mu") * F.col("mu"), F.lit(0.0))).alias("dc_free_rms"))


def blocks(s: DataFrame, size: int, full: bool = True) -> DataFrame:
    """Mean power of consecutive blocks of ``size`` samples; a partial last block is dropped if ``full``."""
    b = s.groupBy("track", F.floor(F.col("idx") / size).alias("block")).agg(F.avg(F.col("x") * F.col("x")).alias("p"), F.count("*").alias("n"))
    return b.filter(F.col("n") == size).drop("n") if full else b.drop("n")


def pick(values: Column, percent: int, rule: str) -> Column:
    """An element of a sorted array: index n*p/100 floored, (n-1)*p rounded, or (n-1)*p floored."""
    n = F.size(values)
    at = {"floor_n": F.floor(n * percent / 100), "round": F.floor((n - 1) * percent / 100.0 + 0.5), "floor": F.floor((n - 1) * percent / 100.0)}[rule]
    return F.element_at(values, F.least(at, n - 1).cast("int") + 1)


def block_spread(s: DataFrame, size: int) -> DataFrame:
    """Decibels between the 95th and the 5th percentile of the blocks that are not silent."""
    b = blocks(s, size).withColumn("db", power_db(F.col("p"))).filter(F.col("db") > SILENCE_DB)
    a = b.groupBy("track").agg(F.array_sort(F.collect_list("db")).alias("v"))
    return a.select("track", pick(F.col("v"), 95, "floor_n").alias("p95"), pick(F.col("v"), 5, "floor_n").alias("p5"), (pick(F.col("v"), 95, "floor_n") - pick(F.col("v"), 5, "floor_n")).alias("spread_db"))


def noise_floor(s: DataFrame, size: int, width: int = 5, least: int = 10, edge: int = 0) -> DataFrame:
    """The quietest mean of ``width`` blocks, and where it starts; null under ``least`` blocks.

    ``edge`` leaves out that many blocks at both ends.
    """
    w = Window.partitionBy("track")
    b = blocks(s, size).withColumn("all", F.count("*").over(w)).withColumn("rn", F.row_number().over(w.orderBy("block")))
    b = b.filter((F.col("rn") > edge) & (F.col("rn") <= F.col("all") - edge))
    run = w.orderBy("block").rowsBetween(0, width - 1)
    m = b.withColumn("m", F.avg("p").over(run)).withColumn("k", F.count("*").over(run))
    fits = (F.col("k") == width) & (F.col("all") >= least)
    a = m.groupBy("track").agg(F.min(F.when(fits, F.struct("m", "block"))).alias("best"))
    return a.select("track", F.when(F.col("best").isNotNull(), power_db(F.col("best.m"))).alias("floor_db"), F.col("best.block").alias("start_block"))


def sliding(s: DataFrame, hop: int, hops: int) -> DataFrame:
    """Mean power of windows of ``hops`` hops, one per hop; incomplete windows are dropped."""
    w = Window.partitionBy("track").orderBy("block").rowsBetween(-(hops - 1), 0)
    b = blocks(s, hop).withColumn("z", F.avg("p").over(w)).withColumn("k", F.count("*").over(w))
    return b.filter(F.col("k") == hops).select("track", "block", "z")


def gated_level(s: DataFrame, hop: int, hops: int = 4, absolute: float = -70.0, relative: float = -10.0, offset: float = -0.691) -> DataFrame:
    """Integrated level: mean of the windows at or above the absolute gate and mean + ``relative``.

    Both passes use running aggregates over one partitioning by track.
    """
    z = sliding(s, hop, hops).withColumn("db", offset + power_db(F.col("z")))
    w = Window.partitionBy("track")
    first = z.filter(F.col("db") >= absolute).withColumn("m", F.avg("z").over(w))
    second = first.filter(F.col("db") >= offset + power_db(F.col("m")) + relative)
    return second.groupBy("track").agg((offset + power_db(F.avg("z"))).alias("level_db"), F.count("*").alias("windows"))


def level_range(s: DataFrame, hop: int, hops: int, strict: bool, rule: str, scale: float = 1.0, absolute: float = -70.0, relative: float = -20.0) -> DataFrame:
    """Spread between the 95th and 10th percentile of gated windows; gates and index rule vary."""
    z = sliding(s, hop, hops).withColumn("z", F.col("z") * scale).withColumn("db", -0.691 + power_db(F.col("z")))
    over = (lambda c, g: c > g) if strict else (lambda c, g: c >= g)
    first = z.filter(over(F.col("db"), F.lit(absolute))).withColumn("m", F.avg("z").over(Window.partitionBy("track")))
    kept = first.filter(over(F.col("db"), -0.691 + power_db(F.col("m")) + relative))
    a = kept.groupBy("track").agg(F.array_sort(F.collect_list("db")).alias("v"))
    return a.select("track", (pick(F.col("v"), 95, rule) - pick(F.col("v"), 10, rule)).alias("range_db"))


def last_level(s: DataFrame, samples: int) -> DataFrame:
    """Level of the last ``samples`` samples; negative infinity for shorter tracks."""
    w = Window.partitionBy("track")
    t = s.withColumn("top", F.max("idx").over(w)).filter(F.col("idx") > F.col("top") - samples)
    a = t.groupBy("track").agg(F.avg(F.col("x") * F.col("x")).alias("p"), F.count("*").alias("n"))
    return a.select("track", F.when(F.col("n") < samples, F.lit(float("-inf"))).otherwise(-0.691 + power_db(F.col("p"))).alias("level_db"))


def stereo(s: DataFrame) -> DataFrame:
    """Correlation without mean, width, and the principal axis of the sample covariance."""
    a = s.groupBy("track").agg(F.sum(F.col("l") * F.col("r")).alias("lr"), F.sum(F.col("l") * F.col("l")).alias("ll"), F.sum(F.col("r") * F.col("r")).alias("rr"), F.var_samp("l").alias("vl"), F.var_samp("r").alias("vr"), F.covar_samp("l", "r").alias("c"), F.count("*").alias("n"))
    d = F.sqrt(F.col("ll") * F.col("rr"))
    corr = F.when(d < 1e-10, 1.0).otherwise(F.col("lr") / F.when(d > 0, d))
    half, root = (F.col("vl") + F.col("vr")) / 2, F.sqrt(F.pow((F.col("vl") - F.col("vr")) / 2, 2) + F.col("c") * F.col("c"))
    few = F.col("n") < 2
    return a.select("track", corr.alias("corr"), (1 - F.abs(corr)).alias("width"), F.when(few, 0.0).otherwise(half + root).alias("eig1"), F.when(few, 0.0).otherwise(half - root).alias("eig2"), F.when(few, 0.0).otherwise(0.5 * F.atan2(2 * F.col("c"), F.col("vl") - F.col("vr"))).alias("angle"))


def distortion_db(s: DataFrame) -> DataFrame:
    """Decibels of signal ``l`` over the error ``l - r``; 100 where there is next to none."""
    e = F.col("l") - F.col("r")
    a = s.groupBy("track").agg(F.sum(F.col("l") * F.col("l")).alias("p"), F.sum(e * e).alias("e"))
    return a.select("track", F.when(F.col("e") < 1e-10, 100.0).otherwise(10 * F.log10(F.when(F.col("p") > 0, F.col("p")) / F.when(F.col("e") > 0, F.col("e")))).alias("sdr_db"))


def crossings(s: DataFrame, size: int, hop: int) -> DataFrame:
    """Mean and population deviation of the rate of sign changes over frames of ``size`` every ``hop``."""
    w = Window.partitionBy("track").orderBy("idx")
    flip = F.when((F.lag("x").over(w) >= 0) != (F.col("x") >= 0), 1).otherwise(0)
    frame = F.explode(F.sequence(F.greatest(F.ceil((F.col("idx") - size + 1) / hop), F.lit(0)), F.floor(F.col("idx") / hop)))
    f = s.withColumn("flip", flip).withColumn("frame", frame)
    inner = F.col("idx") > F.col("frame") * hop
    z = f.groupBy("track", "frame").agg(F.sum(F.when(inner, F.col("flip")).otherwise(0)).alias("k"), F.count("*").alias("n")).filter(F.col("n") == size).withColumn("z", F.col("k") / (size - 1))
    return z.groupBy("track").agg(F.avg("z").alias("zcr_mean"), F.sqrt(F.greatest(F.avg(F.col("z") * F.col("z")) - F.avg("z") * F.avg("z"), F.lit(0.0))).alias("zcr_std"))


def clip_ratio(s: DataFrame, ceiling: float) -> DataFrame:
    """Share of samples at or above the ceiling."""
    return s.groupBy("track").agg(F.avg((F.abs("x") >= ceiling).cast("double")).alias("clip_ratio"), F.max(F.abs("x")).alias("peak"))


def histogram(s: DataFrame, low: float, width: float, bins: int) -> DataFrame:
    """Counts of all ``bins`` bins, empty ones too; values beyond fall into the outer bins."""
    spark = s.sparkSession
    bin_ = F.greatest(F.least(F.floor((F.col("x") - low) / width), F.lit(bins - 1)), F.lit(0)).cast("int")
    some = s.groupBy(bin_.alias("bin")).agg(F.count("*").alias("n"))
    every = spark.range(bins).select(F.col("id").cast("int").alias("bin"))
    return every.join(some, "bin", "left").select("bin", F.coalesce("n", F.lit(0)).alias("n"))


def otsu(hist: DataFrame) -> DataFrame:
    """The first bin that best splits a histogram in two (between-class variance); null if one-sided.

    The histogram has a bounded number of rows, so its cumulative sums run in one small task.
    """
    w = Window.orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
    c = hist.select("bin", F.sum("n").over(w).alias("w0"), F.sum(F.col("n") * F.col("bin")).over(w).alias("s0"))
    t = hist.agg(F.sum("n").alias("w"), F.sum(F.col("n") * F.col("bin")).alias("s"))
    v = c.crossJoin(t).filter((F.col("w0") > 0) & (F.col("w0") < F.col("w")))
    m = F.col("s0") / F.col("w0") - (F.col("s") - F.col("s0")) / (F.col("w") - F.col("w0"))
    v = v.withColumn("between", F.col("w0").cast("double") * (F.col("w") - F.col("w0")) * m * m)
    best = v.agg(F.min(F.struct((-F.col("between")).alias("neg"), "bin")).alias("b"))
    return best.select(F.col("b.bin").alias("split_bin"), (-F.col("b.neg")).alias("between"))


def valley_guard(hist: DataFrame) -> DataFrame:
    """The split with whether it lies strictly below a peak on both sides."""
    s = otsu(hist).crossJoin(hist)
    a = s.groupBy("split_bin").agg(F.max(F.when(F.col("bin") < F.col("split_bin"), F.col("n"))).alias("left_peak"), F.max(F.when(F.col("bin") > F.col("split_bin"), F.col("n"))).alias("right_peak"), F.max(F.when(F.col("bin") == F.col("split_bin"), F.col("n"))).alias("valley"))
    return a.select("split_bin", "left_peak", "right_peak", "valley", ((F.col("valley") < F.col("left_peak")) & (F.col("valley") < F.col("right_peak"))).alias("bimodal"))


def sparse_scan(s: DataFrame, windows: int, size: int) -> DataFrame:
    """Peak and RMS of evenly spaced windows, and the quadratic mean of all of them."""
    w = Window.partitionBy("track")
    t = s.withColumn("n", F.count("*").over(w)).withColumn("step", F.greatest(F.floor(F.col("n") / windows), F.lit(1)))
    t = t.withColumn("k", F.floor(F.col("idx") / F.col("step"))).filter((F.col("k") < windows) & (F.col("idx") - F.col("k") * F.col("step") < size))
    a = t.groupBy("track", "k").agg(F.max(F.abs("x")).alias("peak"), F.avg(F.col("x") * F.col("x")).alias("p"))
    return a.groupBy("track").agg(F.count("*").alias("windows"), F.max("peak").alias("peak"), F.sqrt(F.avg("p")).alias("rms"))


def loudest_window(s: DataFrame, hop: int, hops: int) -> DataFrame:
    """Start and power of the loudest window of ``hops`` hops; the first on ties."""
    z = sliding(s, hop, hops)
    a = z.groupBy("track").agg(F.min(F.struct((-F.col("z")).alias("neg"), "block")).alias("b"))
    return a.select("track", (F.col("b.block") - (hops - 1)).alias("start_block"), (-F.col("b.neg")).alias("power"))


def intervals(s: DataFrame, threshold: float) -> DataFrame:
    """Onsets (rises above the threshold), and the variation of the gaps between them (null under three)."""
    w = Window.partitionBy("track").orderBy("idx")
    on = s.withColumn("up", (F.col("x") > threshold) & (F.coalesce(F.lag("x").over(w), F.lit(float("-inf"))) <= threshold)).filter("up")
    g = on.withColumn("gap", F.col("idx") - F.lag("idx").over(w))
    a = g.groupBy("track").agg(F.count("*").alias("onsets"), F.avg("gap").alias("m"), F.stddev_pop("gap").alias("sd"))
    return a.select("track", "onsets", F.when(F.col("onsets") >= 3, F.col("sd") / F.col("m")).alias("cv"))


def interval_mode(s: DataFrame, threshold: float, width: int) -> DataFrame:
    """The commonest gap between onsets in bins of ``width``; the smallest on ties."""
    w = Window.partitionBy("track").orderBy("idx")
    on = s.withColumn("up", (F.col("x") > threshold) & (F.coalesce(F.lag("x").over(w), F.lit(float("-inf"))) <= threshold)).filter("up")
    b = on.withColumn("gap", F.col("idx") - F.lag("idx").over(w)).filter("gap is not null").groupBy("track", F.floor(F.col("gap") / width).alias("bin")).agg(F.count("*").alias("n"))
    a = b.groupBy("track").agg(F.min(F.struct((-F.col("n")).alias("neg"), "bin")).alias("b"))
    return a.select("track", (F.col("b.bin") * width).alias("gap"), (-F.col("b.neg")).alias("votes"))


def transient_density(s: DataFrame, fast: int, slow: int, factor: float) -> DataFrame:
    """Rises of the fast mean of |x| above ``factor`` times the slow one, per sample after warm-up."""
    w = Window.partitionBy("track").orderBy("idx")
    t = s.withColumn("hot", (F.avg(F.abs("x")).over(w.rowsBetween(-(fast - 1), 0)) > factor * F.avg(F.abs("x")).over(w.rowsBetween(-(slow - 1), 0))).cast("int"))
    t = t.withColumn("edge", (F.col("hot") == 1) & (F.coalesce(F.lag("hot").over(w), F.lit(0)) == 0)).filter(F.col("idx") >= slow)
    return t.groupBy("track").agg(F.sum(F.col("edge").cast("int")).alias("edges"), F.avg(F.col("edge").cast("double")).alias("density"))


def jump_density(s: DataFrame) -> DataFrame:
    """Share of steps larger than the mean step plus its deviation."""
    w = Window.partitionBy("track")
    t = s.withColumn("d", F.abs(F.col("x") - F.lag("x").over(w.orderBy("idx"))))
    t = t.withColumn("lim", F.avg("d").over(w) + F.stddev_pop("d").over(w))
    return t.groupBy("track").agg(F.avg(F.coalesce((F.col("d") > F.col("lim")).cast("double"), F.lit(0.0))).alias("density"))


def lag_correlation(s: DataFrame, low: int, high: int) -> DataFrame:
    """The lag with the highest autocorrelation of x less its mean (first on ties), and its share of lag 0.

    All lags are taken in one pass over the ordered track, after the pass for its mean. ``idx`` has no gaps.
    """
    track = Window.partitionBy("track")
    order = track.orderBy("idx")
    c = s.withColumn("y", F.col("x") - F.avg("x").over(track)).select("track", "idx", "y")
    products = c.select("track", "y", *(F.lag("y", k).over(order).alias(f"y{k}") for k in range(low, high + 1)))
    sums = products.groupBy("track").agg(F.sum(F.col("y") * F.col("y")).alias("r0"), F.array(*(F.struct((-F.round(F.sum(F.col("y") * F.col(f"y{k}")), 9)).alias("neg"), F.lit(k).alias("lag")) for k in range(low, high + 1))).alias("r"))
    b = sums.select("track", "r0", F.array_min(F.filter("r", lambda x: x["neg"].isNotNull())).alias("b")).filter("b is not null")
    return b.select("track", F.col("b.lag").alias("lag"), F.when(F.col("r0") > 0, -F.col("b.neg") / F.col("r0")).alias("confidence"))
