"""Centroids and profiles of vectors, held as arrays or exploded to positions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F


def exploded(v: DataFrame, vector: str = "embedding") -> DataFrame:
    """One row per position of each vector."""
    return v.select("vec_id", "label", F.posexplode(vector).alias("pos", "v")).withColumn("v", F.col("v").cast("double"))


def dimension_stats(v: DataFrame) -> DataFrame:
    """Mean and population deviation of each position over all vectors."""
    return exploded(v).groupBy("pos").agg(F.avg("v").alias("mean"), F.stddev_pop("v").alias("std"))


def label_centroids(v: DataFrame, eps: float = 1e-8) -> DataFrame:
    """Per label and position, mean and population variance of the z-scores."""
    stats = dimension_stats(v)
    z = exploded(v).join(F.broadcast(stats), "pos").withColumn("z", (F.col("v") - F.col("mean")) / (F.col("std") + eps))  # one row per dimension
    return z.groupBy("label", "pos").agg(F.avg("z").alias("centroid"), F.var_pop("z").alias("variance"))


def distance(a: Column, b: Column, skip: int = 0) -> Column:
    """Euclidean distance of two arrays, without the first ``skip`` positions."""
    cut = lambda x: F.slice(x, skip + 1, F.greatest(F.size(x) - skip, F.lit(0))) if skip else x
    return F.sqrt(F.aggregate(F.zip_with(cut(a), cut(b), lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, d: s + d))


def nearest(v: DataFrame, farthest: float, margin: float) -> DataFrame:
    """The nearest raw centroid of each vector; null if too far, or if the second is within ``margin``."""
    means = exploded(v).groupBy("label", "pos").agg(F.avg("v").alias("m"))
    c = means.groupBy("label").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "m"))), lambda s: s["m"]).alias("c"))
    model = c.agg(F.collect_list(F.struct("label", "c")).alias("model"))  # one row, as large as there are labels
    near = F.transform("model", lambda x: F.struct(F.round(distance(F.col("e"), x["c"]), 9).alias("d"), x["label"].alias("to")))
    a = v.select("vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("e")).join(F.broadcast(model))
    a = a.select("vec_id", F.slice(F.array_sort(near), 1, 2).alias("b"))
    best, second = F.element_at("b", 1), F.try_element_at(F.col("b"), F.lit(2))
    sure = (best["d"] <= farthest) & (F.coalesce(second["d"] - best["d"], F.lit(1e9)) >= margin)
    return a.select("vec_id", best["d"].alias("distance"), F.when(sure, best["to"]).alias("label"))


def profile(v: DataFrame) -> DataFrame:
    """Vectors less their own mean, averaged as powers of ten, less the mean again; with the spread."""
    c = exploded(v).withColumn("v", F.col("v") - F.avg("v").over(Window.partitionBy("vec_id")))
    a = c.groupBy("pos").agg((10 * F.log10(F.avg(F.pow(F.lit(10.0), F.col("v") / 10)))).alias("p"), F.stddev_pop("v").alias("dead_zone"))
    m = a.agg(F.avg("p").alias("m"))
    return a.crossJoin(F.broadcast(m)).select("pos", (F.col("p") - F.col("m")).alias("profile"), "dead_zone")


def slopes(v: DataFrame, first: int, last: int) -> DataFrame:
    """Least-squares slope over the positions from ``first`` to ``last``."""
    return exploded(v).filter(F.col("pos").between(first, last)).groupBy("vec_id").agg(F.regr_slope("v", F.col("pos").cast("double")).alias("slope"))


def weighted_mean(d: DataFrame, key: str, value: str, weight: Column) -> DataFrame:
    """Weighted mean per key; null where the weights vanish."""
    a = d.groupBy(key).agg(F.sum(F.col(value) * weight).alias("vw"), F.sum(weight).alias("w"))
    return a.select(key, F.when(F.col("w") >= 1e-10, F.col("vw") / F.when(F.col("w") != 0, F.col("w"))).alias("centroid"))


def step_distances(v: DataFrame, skip: int, window: int) -> DataFrame:
    """Distance of each vector to the one before (by id, within its label), and its rolling mean."""
    w = Window.partitionBy("label").orderBy("vec_id")
    e = v.select("vec_id", "label", F.transform("embedding", lambda x: x.cast("double")).alias("e"))
    d = e.withColumn("d", distance(F.col("e"), F.lag("e").over(w), skip)).filter("d is not null")
    return d.select("vec_id", "label", "d", F.avg("d").over(w.rowsBetween(-(window - 1), 0)).alias("rolling"))


def normalised_head(v: DataFrame, n: int) -> DataFrame:
    """The first ``n`` values of each vector divided by the mean of their magnitudes."""
    head = F.transform(F.slice("embedding", 1, n), lambda x: x.cast("double"))
    m = F.aggregate(head, F.lit(0.0), lambda s, x: s + F.abs(x)) / n
    return v.select("vec_id", F.posexplode(F.transform(head, lambda x: F.when(m > 0, x / m).otherwise(0.0))).alias("pos", "v"))


def dead_zone_difference(v: DataFrame, zone: float, limit: float) -> DataFrame:
    """Per position, each vector's distance from the mean vector beyond a dead zone, clamped."""
    d = exploded(v).join(F.broadcast(dimension_stats(v).select("pos", "mean")), "pos").withColumn("d", F.col("mean") - F.col("v"))
    cut = F.when(F.abs("d") <= zone, 0.0).otherwise(F.col("d") - F.signum("d") * zone)
    return d.select("vec_id", "pos", F.greatest(F.least(cut, F.lit(limit)), F.lit(-limit)).alias("gain"))
