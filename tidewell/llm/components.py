"""Connected components by alternating stars, on tables only."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .scratch import Scratch


def components(edges: DataFrame, scratch: Scratch, rounds: int = 40) -> DataFrame:
    """``(node, comp)`` for every node of ``edges(a, b)``; comp is the smallest node reachable.

    Each round points every neighbour of a node at the smallest one (large star), then the smaller
    neighbours at the smallest (small star). The number of edges never grows, so a round costs two
    shuffles of what the input holds; the loop ends when a round changes nothing. Partial minima are
    taken before each shuffle, and no neighbour list is ever gathered.
    """

    def star(e: DataFrame, large: bool) -> DataFrame:
        if large:
            both = e.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(e.select(F.col("b").alias("u"), F.col("a").alias("v")))
        else:
            both = e.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        met = both.join(low, "u")
        if large:
            met = met.filter("v > u")
            made = met.select(F.col("v").alias("a"), F.col("m").alias("b"))
        else:
            made = met.select(F.col("v").alias("a"), F.col("m").alias("b")).unionByName(low.select(F.col("u").alias("a"), F.col("m").alias("b")))
        return made.filter("a <> b").distinct()

    mark = lambda e: e.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("s")).first()
    now = scratch.save(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct())
    seen = mark(now)
    for _ in range(rounds):
        if not seen["n"]:
            break
        new = scratch.save(star(star(now, True), False))
        scratch.drop(now)
        now, (last, seen) = new, (seen, mark(new))
        if last == seen:
            break
    else:
        raise RuntimeError("components did not settle")
    return now.select(F.col("a").alias("node"), F.col("b").alias("comp")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("comp"))).groupBy("node").agg(F.min("comp").alias("comp"))
