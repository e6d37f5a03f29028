"""Queries over scalar functions of the view ``signal`` and other tables."""

from __future__ import annotations

import math

from pyspark.sql import Window, functions as F

from tidewell.functions import scalars as X

from .views import SIGNAL, rounded, signal, table

QUERIES: dict = {}
ORACLE: dict[str, str] = {}
c = F.col


def register(name: str, query, sql: str) -> None:
    QUERIES[name] = lambda spark, d: rounded(query(spark, d))
    ORACLE[name] = sql


def _channels(s, d):
    l, r = X.folded(F.array("l", "r", "x", "c"))
    dl, dr = X.surround_to_stereo([c("l"), c("r"), c("x"), c("c"), c("l"), c("r")])
    m, side = X.mid_side(c("l"), c("r"))
    bl, br = X.left_right(m, side)
    return signal(s, d).select("event_id", X.mono(c("l"), c("r")).alias("mono"), m.alias("mid"), side.alias("side"), bl.alias("l2"), br.alias("r2"), l.alias("fl"), r.alias("fr"), dl.alias("dl"), dr.alias("dr"))


register("channel_folds", _channels, f"with {SIGNAL} select event_id, round((l + r) * 0.5, 6) mono, round((l + r) * 0.5, 6) mid, round((l - r) * 0.5, 6) side, round(l, 6) l2, round(r, 6) r2, round((l + x) / 2, 6) fl, round((r + c) / 2, 6) fr, round(l + pow(2, -0.5) * x + pow(2, -0.5) * l, 6) dl, round(r + pow(2, -0.5) * x + pow(2, -0.5) * r, 6) dr from signal")
register("sanitized_samples", lambda s, d: signal(s, d).select("event_id", X.finite(F.when(c("event_id") % 7 == 0, F.lit(float("nan"))).when(c("event_id") % 11 == 0, F.lit(float("-inf"))).otherwise(c("x"))).alias("x")), f"with {SIGNAL} select event_id, round(case when event_id % 7 = 0 or event_id % 11 = 0 then 0 else x end, 6) x from signal")
register("curves", lambda s, d: signal(s, d).select("event_id", X.lerp(c("l"), c("r"), c("c")).alias("lerp"), X.s_curve(c("c")).alias("s"), X.exponential(c("c"), 3.0).alias("e"), X.shaped(c("c"), "root").alias("root"), X.shaped(c("c"), "square").alias("square"), X.sigmoid(c("x"), 0.3).alias("sig"), X.logistic_map(c("c") * 0.5 + 0.2, 3.2, 6).alias("chaos")),
         f"with {SIGNAL}, f as (select *, c * 0.5 + 0.2 q from signal) select event_id, round(l + (r - l) * c, 6) lerp, round(3 * c * c - 2 * c * c * c, 6) s, round((exp(3 * c) - 1) / (exp(3.0) - 1), 6) e, round(sqrt(c), 6) root, round(c * c, 6) square, round(1 / (1 + exp(-x / 0.3)), 6) sig, round(list_reduce([q, 1, 1, 1, 1, 1, 1], lambda a, b: 3.2 * a * (1 - a)), 6) chaos from f")
register("frequency_scales", lambda s, d: table(s, d, "part").select("p_partkey", X.hz_to_mel(c("p_retailprice")).alias("mel"), X.mel_to_hz(X.hz_to_mel(c("p_retailprice"))).alias("hz"), X.bark(c("p_retailprice")).alias("bark")), "select p_partkey, round(2595 * log10(1 + p_retailprice / 700), 6) mel, round(p_retailprice, 6) hz, round(13 * atan(0.00076 * p_retailprice) + 3.5 * atan(pow(p_retailprice / 7500, 2)), 6) bark from part")
register("risk_projection", lambda s, d: signal(s, d).select("event_id", X.piecewise(c("x"), [(-0.2, 0.0), (0.3, 0.4), (1.0, 1.0)]).alias("risk")), f"with {SIGNAL} select event_id, round(case when x < 0.3 then 0.4 * (greatest(x, -0.2) + 0.2) / 0.5 when x < 1.0 then 0.4 + 0.6 * (x - 0.3) / 0.7 else 1.0 end, 6) risk from signal")


def _lean(s, d):
    lean, sure = X.projected(c("x") * 3, c("r") * 3, -0.5, -0.5, 1.0, 0.5)
    return signal(s, d).select("event_id", lean.alias("lean"), sure.alias("sure"))


LEAN = "p as (select event_id, greatest(least(x * 3, 3), -3) u, greatest(least(r * 3, 3), -3) v from signal), q as (select event_id, greatest(least(((u + 0.5) * 1.5 + (v + 0.5)) / 3.25, 1), 0) lean, abs((u + 0.5) - (v + 0.5) * 1.5) / sqrt(3.25) off from p)"
register("decision_projection", _lean, f"with {SIGNAL}, {LEAN} select event_id, round(lean, 6) lean, round(abs(lean - 0.5) * 2 / (1 + off), 6) sure from q")


def _escalated(s, d):
    lean, sure = X.projected(c("x") * 3, c("r") * 3, -0.5, -0.5, 1.0, 0.5)
    return signal(s, d).select("event_id", lean.alias("lean"), sure.alias("sure")).filter("lean between 0.3 and 0.7 and sure < 0.4")


register("escalation", _escalated, f"with {SIGNAL}, {LEAN} select event_id, round(lean, 6) lean, round(abs(lean - 0.5) * 2 / (1 + off), 6) sure from q where lean between 0.3 and 0.7 and abs(lean - 0.5) * 2 / (1 + off) < 0.4")
GOALS = [("round", ["ring", "gear"]), ("flat", ["plate", "widget"]), ("red", ["red"])]
register("goal_words", lambda s, d: table(s, d, "part").select("p_partkey", X.goal(F.translate("p_name", " ", "_"), GOALS, "other").alias("goal")), "select p_partkey, case " + " ".join("when " + " or ".join(f"contains(lower(p_name), '{k}')" for k in keys) + f" then '{name}'" for name, keys in GOALS) + " else 'other' end goal from part")
register("seeded_jitter", lambda s, d: table(s, d, "supplier").select("s_suppkey", X.jitter(c("s_suppkey"), "gain", 0.3).alias("gain")), "select s_suppkey, round(1 + 0.3 * (2 * (cast('0x' || substr(md5(s_suppkey || ':gain'), 1, 8) as bigint) / 4294967296.0) - 1), 6) gain from supplier")
register("numbered_names", lambda s, d: table(s, d, "lineitem").withColumn("n", F.lit(100)).select("l_orderkey", "l_linenumber", X.numbered(c("l_linenumber"), c("n"), c("l_returnflag")).alias("name")), "select l_orderkey, l_linenumber, lpad(l_linenumber::varchar, 3, '0') || '_' || l_returnflag as name from lineitem")
register("head_sample", lambda s, d: signal(s, d).filter("idx < 30").select("track", "idx", "x"), f"with {SIGNAL} select track, idx, round(x, 6) x from signal where idx < 30")
register("window_read", lambda s, d: signal(s, d).filter("idx >= 20 and idx < 28").select("track", "idx", "x"), f"with {SIGNAL} select track, idx, round(x, 6) x from signal where idx >= 20 and idx < 28")
register("overrides", lambda s, d: signal(s, d).select("event_id", F.coalesce(F.when(c("event_id") % 3 == 0, F.greatest(F.least(c("r"), F.lit(0.5)), F.lit(-0.5))), c("x")).alias("v")), f"with {SIGNAL} select event_id, round(coalesce(case when event_id % 3 = 0 then greatest(least(r, 0.5), -0.5) end, x), 6) v from signal")
register("pre_gain", lambda s, d: signal(s, d).groupBy("track").agg(F.greatest(F.least(-14 - 20 * F.log10(F.sqrt(F.avg(c("x") * c("x")))), F.lit(12.0)), F.lit(-12.0)).alias("gain_db")), f"with {SIGNAL} select track, round(greatest(least(-14 - 20 * log10(sqrt(avg(x * x))), 12), -12), 6) gain_db from signal group by 1")


def _faded(s):
    """From the left channel to the right over the whole track, at equal power and at equal gain."""
    t = c("idx") / F.greatest(F.count("*").over(Window.partitionBy("track")) - 1, F.lit(1))
    s = s.withColumn("t", t)
    power = c("l") * F.cos(c("t") * math.pi / 2) + c("r") * F.sin(c("t") * math.pi / 2)
    zero = lambda v: F.when(v == 0, 0.0).otherwise(v)  # noqa: E731  no negative zero
    return s.select("track", "idx", zero(F.round(power, 6)).alias("power"), zero(c("l") * (1 - c("t")) + c("r") * c("t")).alias("gain"))


QUERIES["crossfade"] = lambda spark, d: rounded(_faded(signal(spark, d)), 11)  # at six digits many gains lie between two
ORACLE["crossfade"] = f"""with {SIGNAL}, t as (select *, idx / greatest(count(*) over (partition by track) - 1, 1)::double t from signal)
 select track, idx, round(l * cos(t * pi() / 2) + r * sin(t * pi() / 2), 6) + 0 as power, round(l * (1 - t) + r * t, 11) + 0 gain from t"""
register("modulation_delay", lambda s, d: signal(s, d).groupBy("track", F.floor(c("idx") / 8).alias("block")).agg(F.max(F.abs("x")).alias("env")).select("track", "block", F.coalesce(F.expr("lag(env) over (partition by track order by block)"), F.lit(0.0)).alias("param")), f"with {SIGNAL}, b as (select track, idx // 8 as block, max(abs(x)) env from signal group by 1, 2) select track, block, round(coalesce(lag(env) over (partition by track order by block), 0), 6) param from b")
register("gain_glide", lambda s, d: signal(s, d).select("track", "idx", (c("x") * (1 + F.least(c("idx") / 20, F.lit(1.0)))).alias("y")), f"with {SIGNAL} select track, idx, round(x * (1 + least(idx / 20.0, 1)), 6) y from signal")
