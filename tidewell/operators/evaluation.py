"""Corpus evaluation: thresholds, leave-one-group-out, admission, splits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F


def value_counts(d: DataFrame) -> DataFrame:
    """Positives and negatives of ``d(grp, x, y)`` per group and value: all later steps work on this."""
    return d.groupBy("grp", "x").agg(F.sum("y").alias("pos"), F.sum(1 - F.col("y")).alias("neg"))


def threshold_scores(counts: DataFrame) -> DataFrame:
    """Accuracy of ``x >= t -> 1`` at the midpoints between neighbouring values, per fold.

    Cumulative sums over the sorted values replace the join of rows with candidates.
    """
    w = Window.partitionBy("fold").orderBy("x")
    c = counts.groupBy("fold", "x").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    all_ = Window.partitionBy("fold")
    c = c.withColumn("t", (F.col("x") + F.lead("x").over(w)) / 2).withColumn("right", F.sum("neg").over(w) + F.sum("pos").over(all_) - F.sum("pos").over(w)).withColumn("n", F.sum(F.col("pos") + F.col("neg")).over(all_))
    return c.filter("t is not null").select("fold", "t", (F.col("right") / F.col("n")).alias("accuracy"))


def best_threshold(d: DataFrame) -> DataFrame:
    """The first of the best midpoints over all rows."""
    s = threshold_scores(value_counts(d).withColumn("fold", F.lit("all")))
    return s.agg(F.min(F.struct((-F.round("accuracy", 12)).alias("neg"), "t")).alias("b")).select(F.col("b.t").alias("threshold"), (-F.col("b.neg")).alias("accuracy"))


def leave_one_group_out(d: DataFrame) -> DataFrame:
    """Per group, the best threshold of all others and its accuracy on the group.

    The folds join value counts with the list of groups, not rows with rows.
    """
    counts = value_counts(d)
    folds = counts.select(F.col("grp").alias("fold")).distinct()
    train = counts.crossJoin(F.broadcast(folds)).filter("grp <> fold") if folds.count() <= 10_000 else counts.join(folds, F.col("grp") != F.col("fold"))
    best = threshold_scores(train).groupBy("fold").agg(F.min(F.struct((-F.round("accuracy", 12)).alias("neg"), "t")).alias("b")).select("fold", F.col("b.t").alias("threshold"))
    test = counts.join(best, F.col("grp") == F.col("fold"))
    hit = F.sum(F.when(F.col("x") >= F.col("threshold"), F.col("pos")).otherwise(F.col("neg")))
    return test.groupBy("fold", "threshold").agg((hit / F.sum(F.col("pos") + F.col("neg"))).alias("accuracy"))


def agreement(d: DataFrame, group: str) -> DataFrame:
    """Per group: share of rows where prediction and truth agree, and the four counts."""
    k = lambda p, y: F.sum(((F.col("p") == p) & (F.col("y") == y)).cast("int"))
    return d.groupBy(group).agg(F.avg((F.col("p") == F.col("y")).cast("double")).alias("agree"), k(1, 1).alias("tp"), k(1, 0).alias("fp"), k(0, 1).alias("fn"), k(0, 0).alias("tn"))


def pooled_std(d: DataFrame, value: str) -> DataFrame:
    """Root of the mean of the two classes' sample variances."""
    v = d.groupBy("y").agg(F.var_samp(value).alias("v"))
    return v.agg(F.sqrt(F.avg("v")).alias("pooled"))


def quartiles(d: DataFrame, group: str, value: str) -> DataFrame:
    """Exact quartiles with linear interpolation."""
    return d.groupBy(group).agg(*(F.expr(f"percentile({value}, {p})").alias(n) for p, n in ((0.25, "p25"), (0.5, "p50"), (0.75, "p75"))))


def breakdown(d: DataFrame, reason: Column) -> DataFrame:
    """Rows per reason."""
    return d.groupBy(reason.alias("reason")).agg(F.count("*").alias("n"))


def split_by_entity(d: DataFrame, entity: str, percent: int) -> DataFrame:
    """Training or test by a hash of the entity, so that no entity is in both."""
    h = F.conv(F.substring(F.md5(F.col(entity).cast("string")), 1, 8), 16, 10).cast("long")
    return d.withColumn("part", F.when(h % 100 < percent, "train").otherwise("test"))


def clip_windows(d: DataFrame, key: str, length: str, size: int) -> DataFrame:
    """Start of each whole non-overlapping window of ``size``."""
    return d.filter(F.col(length) >= size).select(key, F.explode(F.sequence(F.lit(0), F.floor(F.col(length) / size).cast("int") - 1)).alias("w")).select(key, (F.col("w") * size).alias("start"))
