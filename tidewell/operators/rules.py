"""Rules, gates, labels and compliance reports as column expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window, functions as F

SEVERITIES = ("Info", "Low", "Medium", "High")


def rank(severity: Column) -> Column:
    """Position of a severity in their order."""
    out = F.lit(-1)
    for i, s in enumerate(SEVERITIES):
        out = F.when(severity == s, i).otherwise(out)
    return out


def reasons(checks: list[tuple[str, Column]]) -> Column:
    """All reasons that apply, in the order given (an unknown measure gives none)."""
    return F.filter(F.array(*(F.when(c, F.lit(name)) for name, c in checks)), lambda x: x.isNotNull())


def first_reason(checks: list[tuple[str, Column]], passed: str = "accepted") -> Column:
    """The first reason that applies."""
    out = F.lit(passed)
    for name, c in reversed(checks):
        out = F.when(c, F.lit(name)).otherwise(out)
    return out


Rule = Callable[[], Column]


def issue(name: str, severity: Column, current: Column, target: Column) -> Column:
    """A rule's row, or null where its severity is null."""
    row = F.struct(F.lit(name).alias("rule"), severity.alias("severity"), current.cast("double").alias("current"), target.cast("double").alias("target"), (current - target).cast("double").alias("delta"))
    return F.when(severity.isNotNull(), row)


def deviation(name: str, current: Column, target: Column, tolerance: float) -> Column:
    """No issue within the tolerance or without a target; else by the distance."""
    d = F.abs(current - target)
    return issue(name, F.when(d > 2, "High").when(d > 1, "Medium").when(d > tolerance, "Low"), current, target)


def above(name: str, current: Column, limit: Column, severity: str) -> Column:
    return issue(name, F.when(current > limit, severity), current, limit)


def below(name: str, current: Column, limit: Column, severity: str) -> Column:
    return issue(name, F.when(current < limit, severity), current, limit)


def evaluate(d: DataFrame, key: list[str], rules: list[Column]) -> DataFrame:
    """One row per issue, in rule order; rows without issues give none."""
    rows = F.filter(F.array(*rules), lambda x: x.isNotNull())
    return d.select(*key, F.posexplode(rows).alias("at", "i")).select(*key, "at", "i.*")


def at_least(issues: DataFrame, severity: str) -> DataFrame:
    return issues.filter(rank(F.col("severity")) >= SEVERITIES.index(severity))


def verdicts(checks: DataFrame, key: str) -> DataFrame:
    """Compliant if nothing failed and nothing expected is missing; advice never counts."""
    v = lambda x: F.array_join(F.array_sort(F.collect_list(F.when(F.col("verdict") == x, F.col("metric")))), ",")
    a = checks.groupBy(key).agg(v("fail").alias("failed"), v("advisory").alias("advisory"), v("missing").alias("missing"))
    return a.withColumn("complies", (F.col("failed") == "") & (F.col("missing") == ""))


def lookup(d: DataFrame, name: str, presets: DataFrame, fallback: str | None) -> DataFrame:
    """Preset by id or alias of ``presets(id, aliases, target)``; else the fallback's, or null."""
    names = presets.select("id", "target", F.explode(F.concat(F.array("id"), "aliases")).alias("alias"))
    out = d.join(names, F.lower(d[name]) == names["alias"], "left").drop("alias")
    if fallback is None:
        return out
    other = presets.filter(F.col("id") == fallback).select(F.col("id").alias("fid"), F.col("target").alias("ft"))
    return out.join(F.broadcast(other), F.lit(True), "left").withColumn("target", F.coalesce("target", "ft")).withColumn("id", F.coalesce("id", "fid")).drop("fid", "ft")  # one row


def recommended(options: DataFrame, key: str) -> DataFrame:
    """The passing option with the least target, a missing target counting as infinite; first name on ties."""
    t = F.struct(F.coalesce("target", F.lit(float("inf"))).alias("t"), "option")
    return options.filter("passes").groupBy(key).agg(F.min(t).alias("b")).select(key, F.col("b.option").alias("option"))


def sanitized_title(c: Column) -> Column:
    """Letters, digits, - and _; spaces become _, runs of _ one, none at the ends."""
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(F.regexp_replace(c, " ", "_"), "[^A-Za-z0-9_-]", ""), "_+", "_"), "^_+|_+$", "")


def routed(d: DataFrame) -> DataFrame:
    """A manual choice wins; else the label where its confidence reaches the floor of its kind; else the default."""
    floor = F.when(F.col("label") == "speech", 0.75).otherwise(0.70)
    return d.withColumn("bus", F.coalesce("manual", F.when(F.col("confidence") >= floor, F.col("label")), F.lit("music")))


def votes(flags: list[Column]) -> tuple[Column, Column]:
    """Label and confidence of a vote of three: unanimous .85, else .55 and too uncertain to name."""
    n = sum((f.cast("int") for f in flags[1:]), flags[0].cast("int"))
    confidence = F.when((n == 0) | (n == len(flags)), 0.85).otherwise(0.55)
    return F.when(confidence < 0.6, "Uncertain").when(n == len(flags), "Speech").otherwise("Music"), confidence


def stages(conditions: list[tuple[str, Column]], last: str) -> Column:
    """The stages whose condition holds, in order, and always the last."""
    return F.array_join(F.concat(reasons(conditions), F.array(F.lit(last))), ">")


def clamped(value: Column, low: float, high: float) -> tuple[Column, Column]:
    """A value within bounds, and whether it had to be clamped."""
    return F.greatest(F.least(value, F.lit(high)), F.lit(low)), (value < low) | (value > high)


def relative_targets(d: DataFrame, key: str, level: str, target: float, low: float, high: float) -> DataFrame:
    """Each row's target, ``target - (loudest - own)``, clamped; and whether its predecessor tires the ear."""
    w = Window.partitionBy(key)
    t = d.withColumn("anchor", F.max(level).over(w)).withColumn("goal", F.greatest(F.least(target - (F.col("anchor") - F.col(level)), F.lit(high)), F.lit(low)))
    tired = F.lag(level).over(w.orderBy("seq")) > F.col(level) + 0.5
    own = F.lead(level).over(w.orderBy("seq")) < F.col(level) - 0.5
    return t.withColumn("after_loud", F.coalesce(tired, F.lit(False))).withColumn("before_quiet", F.coalesce(own, F.lit(False)))


def plan_errors(d: DataFrame, key: str) -> DataFrame:
    """All errors of each plan of ``(key, pos, role, length)``: order, duplicates, roles, total length."""
    a = d.groupBy(key).agg(F.count("*").alias("n"), F.min("pos").alias("lo"), F.max("pos").alias("hi"), F.countDistinct("pos").alias("k"), F.sum(F.when(F.col("role") == "opening", 1).otherwise(0)).alias("openings"), F.sum(F.when(F.col("role") == "chapter", 1).otherwise(0)).alias("chapters"), F.sum("length").alias("length"))
    e = reasons([("gap", (F.col("lo") != 1) | (F.col("hi") != F.col("n"))), ("duplicate", F.col("k") < F.col("n")), ("openings", F.col("openings") > 1), ("no_chapter", F.col("chapters") < 1), ("too_long", F.col("length") > 120)])
    return a.select(key, F.array_join(e, ",").alias("errors"))
