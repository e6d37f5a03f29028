"""State models: transition counts that merge by addition, emissions, and inference."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F


def bigrams(states: DataFrame) -> DataFrame:
    """``(src, dst, n)`` of consecutive states per session, of ``states(session, seq, state)``."""
    w = Window.partitionBy("session").orderBy("seq")
    pairs = states.select(F.col("state").alias("src"), F.lead("state").over(w).alias("dst"))
    return pairs.filter("dst is not null").groupBy("src", "dst").agg(F.count("*").alias("n"))


def merge(a: DataFrame, b: DataFrame) -> DataFrame:
    """The sum of two count tables; states of either are kept."""
    keys = [c for c in a.columns if c != "n"]
    return a.unionByName(b).groupBy(*keys).agg(F.sum("n").alias("n"))


def transitions(counts: DataFrame) -> DataFrame:
    """Row-normalised matrix over all states; a state never left is uniform."""
    every = counts.select(F.col("src").alias("s")).union(counts.select("dst")).distinct()
    grid = every.withColumnRenamed("s", "src").crossJoin(every.withColumnRenamed("s", "dst"))  # states squared
    w = Window.partitionBy("src")
    full = grid.join(counts, ["src", "dst"], "left").withColumn("n", F.coalesce("n", F.lit(0))).withColumn("t", F.sum("n").over(w)).withColumn("k", F.count("*").over(w))
    return full.select("src", "dst", F.when(F.col("t") > 0, F.col("n") / F.col("t")).otherwise(1.0 / F.col("k")).alias("p"))


def emissions(rows: DataFrame, edges: list[float]) -> DataFrame:
    """``(state, bin, n)``: values binned by strict upper edges; empty bins of a state are kept."""
    bin_ = F.lit(len(edges))
    for i, e in reversed(list(enumerate(edges))):
        bin_ = F.when(F.col("x") < e, i).otherwise(bin_)
    some = rows.groupBy("state", bin_.cast("int").alias("bin")).agg(F.count("*").alias("n"))
    grid = rows.select("state").distinct().select("state", F.explode(F.sequence(F.lit(0), F.lit(len(edges)))).alias("bin"))
    return grid.join(some, ["state", "bin"], "left").select("state", "bin", F.coalesce("n", F.lit(0)).alias("n"))


def likelihood(emitted: DataFrame) -> DataFrame:
    """P(bin | state) with one added to every count."""
    w = Window.partitionBy("state")
    return emitted.select("state", "bin", ((F.col("n") + 1) / (F.sum("n").over(w) + F.count("*").over(w))).alias("p"))


def infer(observed: DataFrame, likely: DataFrame, moves: DataFrame, unseen: float = 1e-6) -> DataFrame:
    """The likeliest state of each ``observed(id, prev, bin)`` and its share of all; ties take the first name.

    The model is one row, an array with a map of bins and one of states before for each state; every observation is
    scored against it where it is, without a shuffle. It is bounded by states times states and bins.
    """
    maps = likely.groupBy("state").agg(F.map_from_entries(F.collect_list(F.struct("bin", "p"))).alias("bins"))
    before = moves.groupBy(F.col("dst").alias("state")).agg(F.map_from_entries(F.collect_list(F.struct("src", "p"))).alias("before"))
    model = maps.join(before, "state", "left").agg(F.collect_list(F.struct("state", "bins", "before")).alias("model"))
    q = observed.join(F.broadcast(model))

    def score(m: Column) -> Column:
        chance = F.coalesce(F.element_at(m["bins"], F.col("bin")), F.lit(unseen)) * F.coalesce(F.element_at(m["before"], F.col("prev")), 1.0 / F.size("model"))
        return F.struct((-F.round(chance, 12)).alias("neg"), m["state"].alias("state"), chance.alias("score"))

    q = q.withColumn("scores", F.transform("model", score))
    best = F.array_min(F.transform("scores", lambda x: F.struct(x["neg"].alias("neg"), x["state"].alias("state"))))
    total = F.aggregate("scores", F.lit(0.0), lambda a, x: a + x["score"])
    return q.filter(F.size("scores") > 0).select("id", best["state"].alias("state"), (-best["neg"] / total).alias("confidence"))


def bigrams_by(states: DataFrame, key: str) -> DataFrame:
    """Transition counts within each value of a key (presets never mix)."""
    w = Window.partitionBy("session").orderBy("seq")
    pairs = states.select(key, F.col("state").alias("src"), F.lead("state").over(w).alias("dst"))
    return pairs.filter("dst is not null").groupBy(key, "src", "dst").agg(F.count("*").alias("n"))


def next_state(moves: DataFrame) -> DataFrame:
    """The likeliest successor of each state; the first name on ties."""
    a = moves.groupBy("src").agg(F.min(F.struct((-F.round("p", 12)).alias("neg"), "dst")).alias("b"))
    return a.select("src", F.col("b.dst").alias("dst"), (-F.col("b.neg")).alias("p"))


def shares(states: DataFrame, sets: dict[str, list[str]]) -> DataFrame:
    """Per session, the share of rows whose state is in each set."""
    return states.groupBy("session").agg(*(F.avg(F.col("state").isin(v).cast("double")).alias(k) for k, v in sets.items()))


def activity(delta: Column, level: Column) -> Column:
    """Silence, attack, decay or sustain from a level and its change."""
    return F.when(level < 0.0, "silence").when(delta > 0.2, "attack").when(delta < -0.2, "decay").otherwise("sustain")
