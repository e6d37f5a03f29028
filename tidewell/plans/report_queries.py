"""Queries over the reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewell.operators import levels as L, reports as R

from .views import SIGNAL, rounded, signal, table

QUERIES: dict = {}
ORACLE: dict[str, str] = {}
c = F.col


def register(name: str, query, sql: str | None) -> None:
    QUERIES[name] = lambda spark, d: rounded(query(spark, d))
    if sql:
        ORACLE[name] = sql


TABLES = {"click": [(0.0, "idle"), (0.4, "tap")], "view": [(-0.2, "short"), (0.2, "mid")], "error": [(0.1, "minor")], "purchase": [(0.5, "small")], "signup": [(-0.3, "quick")]}
TOP = {"click": "burst", "view": "long", "error": "major", "purchase": "large", "signup": "slow"}
CASES = "case " + " ".join(f"when state = '{k}' then case " + " ".join(f"when x < {e} then '{n}'" for e, n in v) + f" else '{TOP[k]}' end" for k, v in TABLES.items()) + " end"
register("kind_states", lambda s, d: signal(s, d).groupBy("track", R.labelled(c("state"), c("x"), TABLES, TOP).alias("label")).agg(F.count("*").alias("n")), f"with {SIGNAL} select track, {CASES} as label, count(*) n from signal group by 1, 2")
register("patch_validation", lambda s, d: table(s, d, "events").select("event_id", F.array_join(R.patch_errors(F.when(c("event_id") % 5 == 0, F.regexp_replace("props", "k", "gain")).otherwise(c("props")), {"k": (10, 90)}), ",").alias("errors")), "select event_id, case when event_id % 5 = 0 then 'unknown:gain' when cast(json_extract(props, '$.k') as int) not between 10 and 90 then 'range:k' else '' end errors from events")
STATS = f"with {SIGNAL}, st as (select track, avg(x * x) p, max(abs(x)) peak, avg(x) mu, 10 * log10(avg(x * x)) rms_db, 20 * log10(max(abs(x))) peak_db from signal group by 1)"


def _stats(s, d):
    return L.level_stats(signal(s, d)).withColumn("peak_db", 20 * F.log10("peak"))


register("margin_checks", lambda s, d: R.margins(_stats(s, d), "track", [("peak", c("peak_db"), 3.0, "max"), ("rms_low", c("rms_db"), -12.0, "min"), ("rms_high", F.when(c("track") % 4 != 0, c("rms_db")), -8.0, "max")]), f"""{STATS}, m as (select track, 'peak' metric, peak_db measured, 3.0::double required, 3 - peak_db margin from st union all select track, 'rms_low', rms_db, -12.0, rms_db + 12 from st union all select track, 'rms_high', rms_db, -8.0, -8 - rms_db from st where track % 4 <> 0)
 select track, metric, round(measured, 6) measured, required, round(margin, 6) margin, case when margin >= 0 then 'pass' else 'fail' end verdict from m""")
register("verify_trim", lambda s, d: _stats(s, d).select("track", R.trims(c("rms_db"), c("peak_db"), -9.0, 6.0).alias("trim_db")), f"{STATS} select track, round(least(greatest(least(-9 - rms_db, 3), -3), 6 - peak_db), 6) trim_db from st")
register("platform_flags", lambda s, d: _stats(s, d).select("track", R.platform_ok(c("rms_db"), c("peak_db") - 6, -11.0).alias("ok")), f"{STATS} select track, rms_db <= -10 and peak_db - 6 <= -1 ok from st")
register("delivery_rows", lambda s, d: R.deliveries(table(s, d, "customer").select(c("c_custkey").alias("track")), _stats(s, d).select("track", c("rms_db").alias("level"))), f"{STATS} select c_custkey track, round(rms_db, 6) as level, case when rms_db is null then 'track ' || c_custkey || ' not found' end error from customer left join st on track = c_custkey")
register("role_spread", lambda s, d: R.spread_of_role(table(s, d, "lineitem").select("l_orderkey", c("l_quantity").alias("level"), F.when(c("l_returnflag") == "A", "chapter").otherwise("other").alias("role")), "l_orderkey", "level", "chapter", 20.0), "select l_orderkey, round(max(l_quantity) filter (l_returnflag = 'A') - min(l_quantity) filter (l_returnflag = 'A'), 6) spread, coalesce(max(l_quantity) filter (l_returnflag = 'A') - min(l_quantity) filter (l_returnflag = 'A') > 20, false) warns, count(*) filter (l_returnflag = 'A') = 0 missing_role from lineitem group by 1")
register("ear_fatigue", lambda s, d: R.fatigue(signal(s, d).select("track", "idx", (c("x") * 4).alias("level")), "track", "idx", "level"), f"with {SIGNAL}, f as (select track, idx, x * 4 as level, x * 4 - lag(x * 4) over (partition by track order by idx) delta from signal) select track, idx, round(level, 6) as level, round(delta, 6) delta, round(case when delta > 2 then greatest(-delta / 4, -1.5) else 0 end, 6) adjust from f")
register("suggestion_fallback", lambda s, d: signal(s, d).select("event_id", R.valid_or(F.when(c("event_id") % 6 == 0, " ").otherwise(c("state")), c("c") * 1.2, c("x") / 2, "keep").alias("text")), f"with {SIGNAL} select event_id, case when event_id % 6 <> 0 and c * 1.2 between 0 and 1 and abs(x / 2) <= 0.3 then state else 'keep' end as text from signal")
register("band_balance", lambda s, d: R.band_balance(signal(s, d), [0.2, 0.4, 0.6, 0.8]), f"with {SIGNAL} select track, case when c < 0.2 then 0 when c < 0.4 then 1 when c < 0.6 then 2 when c < 0.8 then 3 else 4 end band, round(avg(pow((l + r) / 2, 2)), 6) mid, round(avg(pow((l - r) / 2, 2)), 6) side, round((sum(r * r) - sum(l * l)) / (sum(l * l) + sum(r * r) + 1e-9), 6) pan from signal group by 1, 2")
register("side_ratio", lambda s, d: R.side_ratio(signal(s, d), 4), f"with {SIGNAL}, a as (select track, idx // 4 frame, sqrt(avg(pow((l + r) / 2, 2))) m, sqrt(avg(pow((l - r) / 2, 2))) s from signal group by 1, 2) select track, frame, round(case when m < 1e-9 and s < 1e-9 then 0 when m < 1e-9 then 100 else least(s / m, 100) end, 6) ratio from a")
register("segment_scan", lambda s, d: R.segment_scan(signal(s, d), 10, 2), f"with {SIGNAL}, f as (select track, idx, x, unnest(range(greatest(cast(ceil((idx - 9) / 2.0) as bigint), 0), idx // 2 + 1)) w from signal) select track, w as \"window\", round(avg(x), 6) mean, round(avg(x * x), 6) as power from f group by 1, 2 having count(*) = 10")
register("fused_measurement", lambda s, d: L.level_stats(signal(s, d)).join(L.stereo(signal(s, d)).select("track", "corr", "width"), "track").join(L.clip_ratio(signal(s, d), 0.9).select("track", "clip_ratio"), "track"), f"{STATS}, u as (select track, count(*) n, min(x) lo, max(x) hi, sum(l * r) / sqrt(sum(l * l) * sum(r * r)) corr, avg(case when abs(x) >= 0.9 then 1.0 else 0.0 end) clip_ratio from signal group by 1) select track, n, round(rms_db, 6) rms_db, round(20 * log10(peak / sqrt(p)), 6) crest_db, round(peak, 6) peak, round(greatest(hi - mu, mu - lo), 6) dc_free_peak, round(sqrt(greatest(p - mu * mu, 0)), 6) dc_free_rms, round(corr, 6) corr, round(1 - abs(corr), 6) width, round(clip_ratio, 6) clip_ratio from st join u using (track)")
