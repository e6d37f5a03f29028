"""Reports: validation of patches, margins, trims, fatigue, labels per kind, delivery rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F


def labelled(kind: Column, x: Column, tables: dict[str, list[tuple[float, str]]], top: dict[str, str]) -> Column:
    """A state per kind of row: the first upper edge above the value names it, else the kind's top state."""
    out = F.lit(None).cast("string")
    for name, edges in tables.items():
        state = F.lit(top[name])
        for edge, label in reversed(edges):
            state = F.when(x < edge, label).otherwise(state)
        out = F.when(kind == name, state).otherwise(out)
    return out


def patch_errors(patch: Column, fields: dict[str, tuple[float, float]]) -> Column:
    """Errors of a JSON object: unknown keys, values that are no numbers or out of range, in key order."""
    keys = F.array_sort(F.coalesce(F.json_object_keys(patch), F.array().cast("array<string>")))
    parsed = F.from_json(patch, "map<string,string>")

    def check(k: Column) -> Column:
        v = F.element_at(parsed, k)
        number = F.try_to_number(v, F.lit("S99999999.9999")).cast("double")
        out = F.concat(F.lit("unknown:"), k)
        for name, (low, high) in fields.items():
            bad = F.when(number.isNull(), F.concat(F.lit("type:"), k)).when((number < low) | (number > high), F.concat(F.lit("range:"), k))
            out = F.when(k == name, bad).otherwise(out)
        return out

    return F.when(F.json_object_keys(patch).isNull(), F.array(F.lit("not an object"))).otherwise(F.filter(F.transform(keys, check), lambda e: e.isNotNull()))


def margins(d: DataFrame, key: str, checks: list[tuple[str, Column, float, str]]) -> DataFrame:
    """One row per measured check: margin to its bound, and pass or fail; unmeasured ones are left out."""
    rows = []
    for name, value, bound, side in checks:
        margin = (bound - value) if side == "max" else (value - bound)
        rows.append(F.when(value.isNotNull(), F.struct(F.lit(name).alias("metric"), value.alias("measured"), F.lit(bound).alias("required"), margin.alias("margin"), F.when(margin >= 0, "pass").otherwise("fail").alias("verdict"))))
    return d.select(key, F.explode(F.filter(F.array(*rows), lambda x: x.isNotNull())).alias("c")).select(key, "c.*")


def trims(level: Column, peak_db: Column, target: float, ceiling: float, most: float = 3.0) -> Column:
    """One correcting gain: towards the target, at most ``most`` either way, never above the headroom."""
    return F.least(F.greatest(F.least(target - level, F.lit(most)), F.lit(-most)), ceiling - peak_db)


def deliveries(entries: DataFrame, tracks: DataFrame) -> DataFrame:
    """Entries with their track's level; a missing track becomes an error row."""
    met = entries.join(tracks, "track", "left")
    return met.withColumn("error", F.when(F.col("level").isNull(), F.format_string("track %s not found", F.col("track").cast("string"))))


def spread_of_role(d: DataFrame, key: str, level: str, role: str, most: float) -> DataFrame:
    """Range of a level over the rows of a role, whether it warns, and whether the role is there at all."""
    mine = F.when(F.col("role") == role, F.col(level))
    a = d.groupBy(key).agg((F.max(mine) - F.min(mine)).alias("spread"), F.count(mine).alias("rows"))
    return a.select(key, "spread", F.coalesce(F.col("spread") > most, F.lit(False)).alias("warns"), (F.col("rows") == 0).alias("missing_role"))


def fatigue(d: DataFrame, key: str, order: str, level: str) -> DataFrame:
    """Change from the row before in its key, and a softer target after a rise of more than two."""
    w = Window.partitionBy(key).orderBy(order)
    d = d.withColumn("delta", F.col(level) - F.lag(level).over(w))
    return d.withColumn("adjust", F.when(F.col("delta") > 2, F.greatest(-F.col("delta") / 4, F.lit(-1.5))).otherwise(0.0))


def platform_ok(level: Column, peak_db: Column, target: float) -> Column:
    """Only the upper side of the level counts."""
    return (level <= target + 1) & (peak_db <= -1)


def valid_or(text: Column, confidence: Column, delta: Column, fallback: str) -> Column:
    """The suggestion if it is well formed, else a fallback."""
    ok = (F.length(F.trim(text)) > 0) & (F.length(text) <= 500) & confidence.between(0, 1) & (F.abs(delta) <= 0.3)
    return F.when(F.coalesce(ok, F.lit(False)), text).otherwise(fallback)


def band_balance(s: DataFrame, edges: list[float]) -> DataFrame:
    """Mid and side power and pan of samples by band of their control value."""
    band = F.lit(len(edges))
    for i, e in reversed(list(enumerate(edges))):
        band = F.when(F.col("c") < e, i).otherwise(band)
    l2, r2 = F.sum(F.col("l") * F.col("l")), F.sum(F.col("r") * F.col("r"))
    m, sd = (F.col("l") + F.col("r")) / 2, (F.col("l") - F.col("r")) / 2
    return s.groupBy("track", band.cast("int").alias("band")).agg(F.avg(m * m).alias("mid"), F.avg(sd * sd).alias("side"), ((r2 - l2) / (l2 + r2 + 1e-9)).alias("pan"))


def side_ratio(s: DataFrame, size: int) -> DataFrame:
    """Per frame, side over mid RMS: 0 in silence, at most 100."""
    m, sd = (F.col("l") + F.col("r")) / 2, (F.col("l") - F.col("r")) / 2
    a = s.groupBy("track", F.floor(F.col("idx") / size).alias("frame")).agg(F.sqrt(F.avg(m * m)).alias("m"), F.sqrt(F.avg(sd * sd)).alias("s"))
    return a.select("track", "frame", F.when((F.col("m") < 1e-9) & (F.col("s") < 1e-9), 0.0).when(F.col("m") < 1e-9, 100.0).otherwise(F.least(F.try_divide("s", "m"), F.lit(100.0))).alias("ratio"))


def segment_scan(s: DataFrame, size: int, hop: int) -> DataFrame:
    """Mean and mean square of windows of ``size`` samples every ``hop``; partial ones are dropped."""
    frame = F.explode(F.sequence(F.greatest(F.ceil((F.col("idx") - size + 1) / hop), F.lit(0)), F.floor(F.col("idx") / hop)))
    f = s.withColumn("window", frame).groupBy("track", "window").agg(F.count("*").alias("n"), F.avg("x").alias("mean"), F.avg(F.col("x") * F.col("x")).alias("power"))
    return f.filter(F.col("n") == size).drop("n")
