"""Queries over state models, centroids, joins, rules, graphs and evaluation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from tidewell.operators import centroids as C, evaluation as E, graphs as G, joins as J, markov as M, rules as R
from tidewell.sources.storage import checkpoints

from .views import SIGNAL, rounded, signal, table

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def register(name: str, query, sql: str | None) -> None:
    QUERIES[name] = lambda spark, d: rounded(query(spark, d))
    if sql:
        ORACLE[name] = sql


def states(spark: SparkSession, d: str) -> DataFrame:
    return signal(spark, d).select(F.col("track").alias("session"), F.col("idx").alias("seq"), "state", "x", (F.col("track") % 3).alias("preset"))


STATES = SIGNAL + ", states as (select track as session, idx as seq, state, x, track % 3 as preset from signal)"
PAIRS = STATES + ", pairs as (select * from (select session, preset, seq, state as src, lead(state) over (partition by session order by seq) dst from states) where dst is not null), counts as (select src, dst, count(*) n from pairs group by 1, 2)"
MOVES = PAIRS + ", names as (select distinct src s from counts union select dst from counts), grid as (select a.s src, b.s dst from names a, names b), full_ as (select g.src, g.dst, coalesce(n, 0) n, sum(coalesce(n, 0)) over (partition by g.src) t, count(*) over (partition by g.src) k from grid g left join counts using (src, dst)), moves as (select src, dst, case when t > 0 then n / t else 1.0 / k end p from full_)"
BIN = "case when x < -0.3 then 0 when x < -0.1 then 1 when x < 0.2 then 2 else 3 end"
EMIT = f"got as (select state, {BIN} bin, count(*) n from states group by 1, 2), emitted as (select s.state, b.bin, coalesce(n, 0) n from (select distinct state from states) s cross join range(4) b(bin) left join got using (state, bin)), likely as (select state, bin, (n + 1) / (sum(n) over (partition by state) + count(*) over (partition by state)) p from emitted)"
EDGES = [-0.3, -0.1, 0.2]


def _moves(spark, d):
    return M.transitions(M.bigrams(states(spark, d)))


def _observed(spark, d):
    w = Window.partitionBy("session").orderBy("seq")
    s = states(spark, d).withColumn("prev", F.lag("state").over(w)).filter("prev is not null")
    b = F.when(F.col("x") < -0.3, 0).when(F.col("x") < -0.1, 1).when(F.col("x") < 0.2, 2).otherwise(3)
    return s.select((F.col("session") * 100000 + F.col("seq")).alias("id"), "prev", b.cast("int").alias("bin"))


register("transition_counts", lambda s, d: M.bigrams(states(s, d)), f"with {PAIRS} select * from counts")
register("transition_matrix", _moves, f"with {MOVES} select src, dst, round(p, 6) p from moves")
register("model_merge", lambda s, d: M.merge(M.bigrams(states(s, d).filter("preset = 0")), M.bigrams(states(s, d).filter("preset <> 0"))), f"with {PAIRS} select * from counts")
register("preset_models", lambda s, d: M.bigrams_by(states(s, d), "preset"), f"with {PAIRS} select preset, src, dst, count(*) n from pairs group by 1, 2, 3")
register("preset_sessions", lambda s, d: states(s, d).groupBy("preset").agg(F.countDistinct("session").alias("n")).agg(F.max("n").alias("most")), f"with {STATES} select max(n) most from (select preset, count(distinct session) n from states group by 1)")
register("emission_histogram", lambda s, d: M.emissions(states(s, d), EDGES), f"with {STATES}, {EMIT} select state, cast(bin as int) bin, n from emitted")
register("emission_likelihood", lambda s, d: M.likelihood(M.emissions(states(s, d), EDGES)), f"with {STATES}, {EMIT} select state, cast(bin as int) bin, round(p, 6) p from likely")
register("state_inference", lambda s, d: M.infer(_observed(s, d), M.likelihood(M.emissions(states(s, d), EDGES)), _moves(s, d)), f"""with {MOVES}, {EMIT}, o as (select session * 100000 + seq id, lag(state) over (partition by session order by seq) prev, {BIN} bin from states),
 q as (select o.id, l.state, l.p * m.p score from o join likely l on l.bin = o.bin join moves m on m.src = o.prev and m.dst = l.state where prev is not null), a as (select id, min({{'neg': -round(score, 12), 'state': state}}) b, sum(score) t from q group by 1) select id, b.state state, round(-b.neg / t, 6) confidence from a""")
register("next_state", lambda s, d: M.next_state(_moves(s, d)), f"with {MOVES}, a as (select src, min({{'neg': -round(p, 12), 'dst': dst}}) b from moves group by 1) select src, b.dst dst, round(-b.neg, 6) p from a")
register("state_shares", lambda s, d: M.shares(states(s, d), {"active": ["click", "purchase"], "errors": ["error"]}), f"with {STATES} select session, round(avg(cast(state in ('click', 'purchase') as int)), 6) active, round(avg(cast(state = 'error' as int)), 6) errors from states group by 1")
register("activity_labels", lambda s, d: _activity(s, d), f"with {SIGNAL}, t as (select track, idx, x, x - lag(x, 1, -144.0) over (partition by track order by idx) dx from signal), l as (select case when x < 0 then 'silence' when dx > 0.2 then 'attack' when dx < -0.2 then 'decay' else 'sustain' end label, * from t) select track, label, count(*) n from l group by 1, 2")


def _activity(s, d):
    dx = F.col("x") - F.lag("x", 1, -144.0).over(Window.partitionBy("track").orderBy("idx"))
    return signal(s, d).withColumn("dx", dx).groupBy("track", M.activity(F.col("dx"), F.col("x")).alias("label")).agg(F.count("*").alias("n"))


# Centroids
EX = "ex as (select vec_id, label, unnest(range(len(embedding))) pos, unnest(embedding)::double v from embeddings), st as (select pos, avg(v) mean, stddev_pop(v) std from ex group by 1)"
emb = lambda s, d: table(s, d, "embeddings")
register("dimension_stats", lambda s, d: C.dimension_stats(emb(s, d)), f"with {EX} select cast(pos as int) pos, round(mean, 6) mean, round(std, 6) std from st")
register("label_centroids", lambda s, d: C.label_centroids(emb(s, d)), f"with {EX} select label, cast(pos as int) pos, round(avg((v - mean) / (std + 1e-8)), 6) centroid, round(var_pop((v - mean) / (std + 1e-8)), 6) variance from ex join st using (pos) group by 1, 2")
register("nearest_centroid", lambda s, d: C.nearest(emb(s, d), 4.0, 0.15), f"""with {EX}, c as (select label, pos, avg(v) m from ex group by 1, 2), ds as (select vec_id, c.label tto, round(sqrt(sum((v - m) * (v - m))), 9) dd from ex join c using (pos) group by 1, 2),
 b as (select vec_id, list_sort(list({{'d': dd, 'to': tto}})) b from ds group by 1) select vec_id, round(b[1].d, 6) distance, case when b[1].d <= 4.0 and coalesce(b[2].d - b[1].d, 1e9) >= 0.15 then b[1]['to'] end as label from b""")
register("corpus_profile", lambda s, d: C.profile(emb(s, d)), f"with {EX}, c as (select pos, v - avg(v) over (partition by vec_id) v from ex), a as (select pos, 10 * log10(avg(pow(10, v / 10))) p, stddev_pop(v) z from c group by 1) select cast(pos as int) pos, round(p - avg(p) over (), 6) profile, round(z, 6) dead_zone from a")
register("spectral_slope", lambda s, d: C.slopes(emb(s, d), 1, 6), f"with {EX} select vec_id, round(regr_slope(v, pos), 6) slope from ex where pos between 1 and 6 group by 1")
register("energy_centroid", lambda s, d: C.weighted_mean(signal(s, d), "track", "r", F.pow(F.lit(10.0), F.col("x"))), f"with {SIGNAL} select track, round(case when sum(pow(10, x)) >= 1e-10 then sum(r * pow(10, x)) / sum(pow(10, x)) end, 6) centroid from signal group by 1")
register("liked_centroid", lambda s, d: table(s, d, "events").filter("event_type = 'purchase'").groupBy("user_id").agg(F.avg("value").alias("centroid"), F.floor(F.sum("event_id") / F.count("*")).alias("whole")), "select user_id, round(avg(value), 6) centroid, cast(sum(event_id) // count(*) as bigint) whole from events where event_type = 'purchase' group by 1")
register("step_distances", lambda s, d: C.step_distances(emb(s, d), 1, 466), """with p as (select vec_id, label, embedding[2:] e, lag(embedding[2:]) over (partition by label order by vec_id) q from embeddings), d as (select vec_id, label, list_distance(e::double[], q::double[]) d from p where q is not null) select vec_id, label, round(d, 6) d, round(avg(d) over (partition by label order by vec_id rows 465 preceding), 6) rolling from d""")
register("normalised_head", lambda s, d: C.normalised_head(emb(s, d), 6), f"with {EX}, h as (select vec_id, pos, v, sum(abs(v)) over (partition by vec_id) / 6 m from ex where pos < 6) select vec_id, cast(pos as int) pos, round(case when m > 0 then v / m else 0 end, 6) v from h")
register("dead_zone_gains", lambda s, d: C.dead_zone_difference(emb(s, d), 0.05, 0.3), f"with {EX}, g as (select vec_id, pos, mean - v d from ex join st using (pos)) select vec_id, cast(pos as int) pos, round(greatest(least(case when abs(d) <= 0.05 then 0 else d - sign(d) * 0.05 end, 0.3), -0.3), 6) gain from g")

# Joins
SPANS = "spans as (select p_partkey as span, p_retailprice * 1.0 as lo, p_retailprice + p_size / 10.0::double as hi from part)"


def _spans(s, d):
    return table(s, d, "part").select(F.col("p_partkey").alias("span"), F.col("p_retailprice").alias("lo"), (F.col("p_retailprice") + F.col("p_size") / 10).alias("hi"))


register("point_in_interval", lambda s, d: J.point_in_interval(table(s, d, "customer").select(F.col("c_custkey").alias("id"), (F.abs("c_acctbal") / 10 + 850).alias("t")), _spans(s, d), 5.0), f"with {SPANS}, p as (select c_custkey id, abs(c_acctbal) / 10 + 850 t from customer), m as (select id, min({{'lo': lo, 'span': span}}) b from p join spans on lo <= t and t < hi group by 1) select p.id, round(t, 6) t, b.span span from p left join m using (id)")
register("interval_overlaps", lambda s, d: J.overlaps(_spans(s, d), 5.0), f"with {SPANS} select a.span a, b.span b from spans a join spans b on a.lo <= b.hi and b.lo <= a.hi and a.span < b.span")
register("lookup_chain", lambda s, d: J.first_found(table(s, d, "customer").select("c_custkey"), "c_custkey", [table(s, d, "orders").filter(f"o_orderstatus = '{x}'").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.max("o_orderkey").alias("o")) for x in "POF"], "o"), "with " + ", ".join(f"s{i} as (select o_custkey c_custkey, max(o_orderkey) o from orders where o_orderstatus = '{x}' group by 1)" for i, x in enumerate("POF")) + " select c_custkey, coalesce(s0.o, s1.o, s2.o) o, case when s0.o is not null then 0 when s1.o is not null then 1 when s2.o is not null then 2 end as source from customer left join s0 using (c_custkey) left join s1 using (c_custkey) left join s2 using (c_custkey)")
register("expected_missing", lambda s, d: J.missing(table(s, d, "customer").select(F.col("c_custkey").alias("k")), table(s, d, "orders").select(F.col("o_custkey").alias("k")), ["k"]), "select c_custkey k from customer where c_custkey not in (select o_custkey from orders)")
register("semi_allow_list", lambda s, d: J.present_only(table(s, d, "lineitem").select("l_partkey", "l_orderkey", "l_linenumber"), table(s, d, "part").filter("p_size < 5").select(F.col("p_partkey").alias("l_partkey")), "l_partkey"), "select l_partkey, l_orderkey, l_linenumber from lineitem where l_partkey in (select p_partkey from part where p_size < 5)")
register("window_intersection", lambda s, d: signal(s, d).filter("x > 0").select("track", F.floor(F.col("idx") / 4).alias("w")).intersect(signal(s, d).filter("r > 0").select("track", F.floor(F.col("idx") / 4).alias("w"))), f"with {SIGNAL} select track, idx // 4 w from signal where x > 0 intersect select track, idx // 4 from signal where r > 0")
register("as_of_value", lambda s, d: J.as_of(table(s, d, "events").filter("event_type = 'purchase'").select("user_id", "ts", F.col("event_id").alias("id")), table(s, d, "events").filter("event_type = 'view'").select("user_id", "ts", "value"), "user_id", "ts", "value"), "select p.event_id id, round(v.value, 6) as value from (select * from events where event_type = 'purchase') p asof left join (select * from events where event_type = 'view') v on p.user_id = v.user_id and p.ts >= v.ts")
register("prefix_allow_list", lambda s, d: J.allowed(table(s, d, "part").select("p_partkey", "p_name"), "p_name", ["red", "blue"]), "select p_partkey, p_name, starts_with(p_name, 'red') or starts_with(p_name, 'blue') allowed from part")
PRINTS = "prints as (select track id, idx pos, cast(floor((x + 1) * 20) * 1000 + floor((lead(x) over (partition by track order by idx) + 1) * 20) as bigint) hash from signal qualify hash is not null)"


def _prints(s, d):
    """A print is two neighbouring values, in steps of a twentieth."""
    next_ = F.lead("x").over(Window.partitionBy("track").orderBy("idx"))
    step = lambda x: F.floor((x + 1) * 20)
    return signal(s, d).select(F.col("track").alias("id"), F.col("idx").alias("pos"), (step(F.col("x")) * 1000 + step(next_)).alias("hash")).filter("hash is not null")


register("fingerprint_matches", lambda s, d: J.offset_matches(_prints(s, d), _prints(s, d), 5, 0.3), f"with {SIGNAL}, {PRINTS}, n as (select id, count(*) n from prints group by 1), m as (select a.id, b.id other, a.pos - b.pos off, count(distinct a.pos) k from prints a join prints b on a.hash = b.hash and abs(a.pos - b.pos) <= 5 group by 1, 2, 3) select m.id, other, round(max(k) / any_value(n), 6) score from m join n using (id) group by 1, 2 having max(k) / any_value(n) >= 0.3")
def _greedy_duplicates(s: SparkSession, d: str) -> DataFrame:
    """Vectors in order, each rejected where it correlates by over 0.9 with an accepted one."""
    checkpoints(s)
    v = table(s, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"))
    return J.greedy_distinct(v, 0.9)


register("greedy_duplicates", _greedy_duplicates, None)

# Rules
REPORT = "rep as (select track, avg(x) level, max(abs(x)) peak, max(x) - min(x) span, sum(l * r) / sqrt(sum(l * l) * sum(r * r)) corr from signal group by 1)"


def _report(s, d):
    return signal(s, d).groupBy("track").agg(F.avg("x").alias("level"), F.max(F.abs("x")).alias("peak"), (F.max("x") - F.min("x")).alias("span"), (F.sum(F.col("l") * F.col("r")) / F.sqrt(F.sum(F.col("l") * F.col("l")) * F.sum(F.col("r") * F.col("r")))).alias("corr"))


def _rules() -> list:
    c, n = F.col, F.lit
    low_corr = F.when(c("corr") < -0.1, "High").when(c("corr") < 0.05, "Medium")
    return [R.deviation("level", c("level") * 20, n(0.0), 0.5), R.above("peak", c("peak"), n(1.0), "High"), R.below("range_low", c("span"), n(1.0), "Low"), R.above("range_high", c("span"), n(1.5), "Info"), R.issue("correlation_low", low_corr, c("corr"), n(0.05)), R.above("offset", F.abs(c("level")), n(0.05), "Low")]


RULES_SQL = f"""{REPORT}, iss as (select track, 0 k, 'level' as rule, case when abs(level * 20) > 2 then 'High' when abs(level * 20) > 1 then 'Medium' when abs(level * 20) > 0.5 then 'Low' end severity, level * 20 cur, 0.0 tgt from rep
 union all select track, 1, 'peak', case when peak > 1 then 'High' end, peak, 1.0 from rep union all select track, 2, 'range_low', case when span < 1 then 'Low' end, span, 1.0 from rep union all select track, 3, 'range_high', case when span > 1.5 then 'Info' end, span, 1.5 from rep
 union all select track, 4, 'correlation_low', case when corr < -0.1 then 'High' when corr < 0.05 then 'Medium' end, corr, 0.05 from rep union all select track, 5, 'offset', case when abs(level) > 0.05 then 'Low' end, abs(level), 0.05 from rep),
 found as (select track, cast(row_number() over (partition by track order by k) - 1 as int) as "at", rule, severity, round(cur, 6) as "current", round(tgt::double, 6) target, round(cur - tgt, 6) delta from iss where severity is not null)"""
register("rule_issues", lambda s, d: R.evaluate(_report(s, d), ["track"], _rules()), f"with {SIGNAL}, {RULES_SQL} select * from found")
register("severe_issues", lambda s, d: R.at_least(R.evaluate(_report(s, d), ["track"], _rules()), "Medium"), f"with {SIGNAL}, {RULES_SQL} select * from found where severity in ('Medium', 'High')")
register("zone_flags", lambda s, d: _report(s, d).select("track", (F.col("peak") > 1).alias("hot"), (F.col("span") > 1.5).alias("wide"), (F.col("corr") < 0).alias("phase"), (F.col("level") > 0).alias("loud")), f"with {SIGNAL}, {REPORT} select track, peak > 1 hot, span > 1.5 wide, corr < 0 phase, level > 0 loud from rep")
GATE = [("short", "n_chars < 200"), ("long", "n_chars > 6000"), ("source", "source in ('src1', 'src2')"), ("language", "lang = 'de'"), ("quality", "quality = 0")]


def _corpus(s, d):
    return table(s, d, "documents").join(table(s, d, "labels"), "doc_id", "left").drop("text")


CORPUS = "corpus as (select doc_id, lang, source, n_chars, quality, toxic from documents left join labels using (doc_id))"
register("gate_reasons", lambda s, d: _corpus(s, d).select("doc_id", F.array_join(R.reasons([(n, F.expr(c)) for n, c in GATE]), ",").alias("reasons")), f"with {CORPUS} select doc_id, array_to_string(list_filter([" + ", ".join(f"case when {c} then '{n}' end" for n, c in GATE) + "], lambda x: x is not null), ',') reasons from corpus")
register("admission_first_reason", lambda s, d: _corpus(s, d).select("doc_id", R.first_reason([(n, F.expr(c)) for n, c in GATE]).alias("reason")), f"with {CORPUS} select doc_id, case " + " ".join(f"when {c} then '{n}'" for n, c in GATE) + " else 'accepted' end reason from corpus")
register("rejection_breakdown", lambda s, d: E.breakdown(_corpus(s, d), R.first_reason([(n, F.expr(c)) for n, c in GATE])), f"with {CORPUS} select case " + " ".join(f"when {c} then '{n}'" for n, c in GATE) + " else 'accepted' end reason, count(*) n from corpus group by 1")
CHECKS = "checks as (select o_custkey, o_orderpriority metric, case o_orderstatus when 'F' then 'fail' when 'P' then 'advisory' else 'pass' end verdict from orders)"
register("delivery_verdicts", lambda s, d: R.verdicts(table(s, d, "orders").select("o_custkey", F.col("o_orderpriority").alias("metric"), F.expr("case o_orderstatus when 'F' then 'fail' when 'P' then 'advisory' else 'pass' end").alias("verdict")), "o_custkey"), f"with {CHECKS}, a as (select o_custkey, " + ", ".join(f"coalesce(array_to_string(list_sort(list(metric) filter (verdict = '{v}')), ','), '') {n}" for v, n in (("fail", "failed"), ("advisory", "advisory"), ("missing", "missing"))) + " from checks group by 1) select *, failed = '' and missing = '' complies from a")


def _presets(spark):
    return spark.createDataFrame([("building", ["construction"], -14.0), ("furniture", ["home", "household"], -16.0), ("automobile", ["car"], None), ("generic", [], -18.0)], "id string, aliases array<string>, target double")


PRE = "pre(alias, id, target) as (values ('building', 'building', -14.0::double), ('construction', 'building', -14.0), ('furniture', 'furniture', -16.0), ('home', 'furniture', -16.0), ('household', 'furniture', -16.0), ('automobile', 'automobile', null), ('car', 'automobile', null), ('generic', 'generic', -18.0))"
seg = lambda s, d: table(s, d, "customer").select("c_custkey", "c_mktsegment")
register("preset_lookup", lambda s, d: R.lookup(seg(s, d), "c_mktsegment", _presets(s), None), f"with {PRE} select c_custkey, c_mktsegment, id, target from customer left join pre on alias = lower(c_mktsegment)")
register("preset_fallback", lambda s, d: R.lookup(seg(s, d), "c_mktsegment", _presets(s), "generic"), f"with {PRE} select c_custkey, c_mktsegment, coalesce(id, 'generic') id, coalesce(target, -18.0) target from customer left join pre on alias = lower(c_mktsegment)")
register("recommended_option", lambda s, d: R.recommended(table(s, d, "orders").select("o_custkey", F.col("o_orderpriority").alias("option"), F.when(F.col("o_orderstatus") != "P", F.col("o_totalprice")).alias("target"), (F.col("o_totalprice") > 100000).alias("passes")), "o_custkey"), "with o as (select o_custkey, min({'t': coalesce(case when o_orderstatus <> 'P' then o_totalprice end, 'infinity'::double), 'o': o_orderpriority}) b from orders where o_totalprice > 100000 group by 1) select o_custkey, b.o as option from o")
register("sanitized_titles", lambda s, d: table(s, d, "benchmark").select("item_id", R.sanitized_title(F.col("text")).alias("title")), "select item_id, regexp_replace(regexp_replace(regexp_replace(replace(text, ' ', '_'), '[^A-Za-z0-9_-]', '', 'g'), '_+', '_', 'g'), '^_+|_+$', '', 'g') title from benchmark")
register("bus_routing", lambda s, d: R.routed(signal(s, d).select("event_id", F.when(F.col("state") == "click", "speech").otherwise("drums").alias("label"), F.col("c").alias("confidence"), F.when(F.col("event_id") % 11 == 0, "manual").alias("manual"))), f"with {SIGNAL} select event_id, case when state = 'click' then 'speech' else 'drums' end as label, c confidence, case when event_id % 11 = 0 then 'manual' end manual, case when event_id % 11 = 0 then 'manual' when c >= case when state = 'click' then 0.75 else 0.7 end then case when state = 'click' then 'speech' else 'drums' end else 'music' end bus from signal")


def _votes(s, d):
    name, conf = R.votes([F.col("x") > 0, F.col("r") > 0, F.col("c") > 0.5])
    return signal(s, d).select("event_id", name.alias("label"), conf.alias("confidence"))


VOTE = "(cast(x > 0 as int) + cast(r > 0 as int) + cast(c > 0.5 as int))"
register("three_votes", _votes, f"with {SIGNAL} select event_id, case when {VOTE} in (0, 3) then case when {VOTE} = 3 then 'Speech' else 'Music' end else 'Uncertain' end as label, case when {VOTE} in (0, 3) then 0.85 else 0.55 end::double confidence from signal")
register("stage_routing", lambda s, d: _report(s, d).select("track", R.stages([("gain", F.col("level") < 0), ("limit", F.col("peak") > 1), ("widen", F.col("corr") > 0.1)], "loudness").alias("stages")), f"with {SIGNAL}, {REPORT} select track, array_to_string(list_filter([case when level < 0 then 'gain' end, case when peak > 1 then 'limit' end, case when corr > 0.1 then 'widen' end, 'loudness'], lambda x: x is not null), '>') stages from rep")


def _clamped(s, d):
    v, hit = R.clamped(F.col("x") * 3, -0.5, 1.0)
    return signal(s, d).select("track", v.alias("v"), hit.alias("hit")).groupBy("track").agg(F.sum(F.col("hit").cast("int")).alias("clamps"), F.avg("v").alias("mean"))


register("clamp_events", _clamped, f"with {SIGNAL} select track, sum(cast(x * 3 < -0.5 or x * 3 > 1 as int)) clamps, round(avg(greatest(least(x * 3, 1.0), -0.5)), 6) mean from signal group by 1")


def _album(s, d):
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    return table(s, d, "orders").select(F.col("o_custkey").alias("album"), F.row_number().over(w).alias("seq"), F.log10("o_totalprice").alias("level"))


ALBUM = "album as (select o_custkey album, cast(row_number() over (partition by o_custkey order by o_orderdate, o_orderkey) as int) seq, log10(o_totalprice) as level from orders)"
register("album_targets", lambda s, d: R.relative_targets(_album(s, d), "album", "level", -14.0, -23.0, 0.0).drop("anchor"), f"with {ALBUM} select album, seq, round(level, 6) as level, round(greatest(least(-14 - (max(level) over (partition by album) - level), 0), -23), 6) goal, coalesce(lag(level) over w > level + 0.5, false) after_loud, coalesce(lead(level) over w < level - 0.5, false) before_quiet from album window w as (partition by album order by seq)")
PLAN = "plan as (select l_orderkey, l_linenumber pos, case l_returnflag when 'A' then 'opening' else 'chapter' end as role, l_quantity as length from lineitem)"
register("plan_validation", lambda s, d: R.plan_errors(table(s, d, "lineitem").select("l_orderkey", F.col("l_linenumber").alias("pos"), F.expr("case l_returnflag when 'A' then 'opening' else 'chapter' end").alias("role"), F.col("l_quantity").alias("length")), "l_orderkey"), f"with {PLAN} select l_orderkey, array_to_string(list_filter([case when min(pos) <> 1 or max(pos) <> count(*) then 'gap' end, case when count(distinct pos) < count(*) then 'duplicate' end, case when sum(cast(role = 'opening' as int)) > 1 then 'openings' end, case when sum(cast(role = 'chapter' as int)) < 1 then 'no_chapter' end, case when sum(length) > 120 then 'too_long' end], lambda x: x is not null), ',') errors from plan group by 1")
register("album_hash", lambda s, d: table(s, d, "orders").groupBy("o_custkey").agg(F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("o_orderkey", F.sha2(F.col("o_orderkey").cast("string"), 256).alias("h")))), lambda x: x["h"]), ""), 256).alias("hash")), "select o_custkey, sha256(string_agg(sha256(o_orderkey::varchar), '' order by o_orderkey)) hash from orders group by 1")
register("stage_timeline", lambda s, d: signal(s, d).select("track", "idx", F.round((F.unix_micros(F.col("ts").cast("timestamp")) - F.lag(F.unix_micros(F.col("ts").cast("timestamp"))).over(Window.partitionBy("track").orderBy("idx"))) / 1000, 3).alias("ms")), f"with {SIGNAL} select track, idx, round((epoch_us(ts) - lag(epoch_us(ts)) over (partition by track order by idx)) / 1000, 3) ms from signal")
register("experience_tiers", lambda s, d: table(s, d, "orders").groupBy("o_custkey").agg(F.count("*").alias("n")).withColumn("tier", F.when(F.col("n") < 5, "new").when(F.col("n") < 20, "regular").otherwise("expert")), "select o_custkey, count(*) n, case when count(*) < 5 then 'new' when count(*) < 20 then 'regular' else 'expert' end tier from orders group by 1")
register("finding_scores", lambda s, d: signal(s, d).groupBy("track").agg(F.sum(F.expr("case state when 'purchase' then 2 when 'view' then -1 when 'error' then -1 else 0 end")).alias("score")), f"with {SIGNAL} select track, sum(case state when 'purchase' then 2 when 'view' then -1 when 'error' then -1 else 0 end) score from signal group by 1")
register("integrity_sweep", lambda s, d: table(s, d, "part").withColumn("expected", F.when(F.col("p_partkey") % 5 == 0, "").otherwise(F.md5(F.concat("p_name", F.when(F.col("p_partkey") % 17 == 0, "x").otherwise(""))))).filter("expected <> '' and expected <> md5(p_name)").select("p_partkey"), "select p_partkey from part where p_partkey % 5 <> 0 and p_partkey % 17 = 0")
register("multi_criteria_health", lambda s, d: signal(s, d).groupBy("track").agg(F.bool_and(F.abs("x") < 1).alias("level_ok"), F.bool_and(F.col("c") >= 0).alias("control_ok")).withColumn("healthy", F.expr("level_ok and control_ok")), f"with {SIGNAL} select track, bool_and(abs(x) < 1) level_ok, bool_and(c >= 0) control_ok, bool_and(abs(x) < 1) and bool_and(c >= 0) healthy from signal group by 1")

# Graphs: orders of one customer form a chain, linked items a DAG
commits = lambda s, d: table(s, d, "orders").select(F.col("o_orderkey").alias("node"), F.lag("o_orderkey").over(Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")).alias("parent"), "o_custkey")
COMMITS = "commits as (select o_orderkey node, lag(o_orderkey) over (partition by o_custkey order by o_orderdate, o_orderkey) parent, o_custkey from orders)"
register("commit_history", lambda s, d: G.history(commits(s, d), commits(s, d).groupBy("o_custkey").agg(F.max("node").alias("node"))), f"with recursive {COMMITS}, walk as (select node head, node, 0 distance from (select max(node) node from commits group by o_custkey) union all select w.head, c.parent, w.distance + 1 from walk w join commits c on c.node = w.node where c.parent is not null) select * from walk")
edges = lambda s, d: table(s, d, "supplier").select(F.col("s_suppkey").alias("src"), (F.col("s_suppkey") * 2 + F.col("s_nationkey") % 3).alias("dst"))
EDGES_SQL = "edges as (select s_suppkey src, s_suppkey * 2 + s_nationkey % 3 dst from supplier)"
nodes = lambda s, d: table(s, d, "supplier").select(F.col("s_suppkey").alias("node"), F.col("s_acctbal").alias("value"))
register("dangling_edges", lambda s, d: G.dangling(nodes(s, d), edges(s, d)), f"with {EDGES_SQL} select src, dst, 'dst' as \"end\" from edges where dst not in (select s_suppkey from supplier)")
register("fan_in_sum", lambda s, d: G.fan_in(nodes(s, d), edges(s, d)), f"with {EDGES_SQL} select dst, round(sum(s_acctbal), 6) as value from edges join supplier on s_suppkey = src group by 1")


def _with_checkpoint(query):
    def run(s, d):

        checkpoints(s)
        return query(s, d)

    return run


register("topological_depth", _with_checkpoint(lambda s, d: G.peel(nodes(s, d), edges(s, d).filter("src <> dst").join(nodes(s, d).select(F.col("node").alias("dst")), "dst", "left_semi"))), f"""with recursive {EDGES_SQL}, e as (select src, dst from edges where src <> dst and dst in (select s_suppkey from supplier)), w as (select s_suppkey node, 0 depth from supplier where s_suppkey not in (select dst from e) union select e.dst, w.depth + 1 from w join e on e.src = w.node where w.depth < 60) select s_suppkey node, cast(max(depth) as int) depth from supplier left join w on w.node = s_suppkey group by 1""")
register("connected_components", _with_checkpoint(lambda s, d: G.connected(edges(s, d))), f"with recursive {EDGES_SQL}, both_ as (select src a, dst b from edges union select dst, src from edges), w as (select a node, a comp from both_ union select w.node, b.b from w join both_ b on b.a = w.comp) select node, min(comp) comp from w group by 1")
GRAPHS = ([("Input", "gain"), ("gain", "eq"), ("eq", "Output")], [("Input", "limit"), ("limit", "Output")])
register("merged_topology", lambda s, d: G.merged([s.createDataFrame(g, "src string, dst string") for g in GRAPHS]), "select * from (values ('f0_Input', 'f0_gain'), ('f0_gain', 'f0_eq'), ('f0_eq', 'f1_limit'), ('f1_limit', 'f1_Output')) t(src, dst)")

# Evaluation
pairs = lambda s, d: _corpus(s, d).filter("quality is not null").select(F.col("source").alias("grp"), F.log10(F.col("n_chars") + 1).alias("x"), F.col("quality").cast("long").alias("y"))
EV = f"{CORPUS}, ev as (select source grp, log10(n_chars + 1) x, quality y from corpus where quality is not null), vals as (select distinct x from ev), mids as (select (x + lead(x) over (order by x)) / 2 t from vals)"
register("best_threshold", lambda s, d: E.best_threshold(pairs(s, d)), f"with {EV}, sc as (select t, avg(cast((x >= t) = (y = 1) as int)) a from ev, mids where t is not null group by 1) select round(b.t, 6) threshold, round(-b.neg, 6) accuracy from (select min({{'neg': -round(a, 12), 't': t}}) b from sc)")
register("leave_one_source_out", lambda s, d: E.leave_one_group_out(pairs(s, d)), f"""with {EV}, folds as (select distinct grp fold from ev), tr as (select fold, x, y from ev, folds where grp <> fold), m as (select fold, (x + lead(x) over (partition by fold order by x)) / 2 t from (select distinct fold, x from tr)),
 sc as (select fold, t, avg(cast((x >= t) = (y = 1) as int)) a from tr join m using (fold) where t is not null group by 1, 2), b as (select fold, min({{'neg': -round(a, 12), 't': t}}).t threshold from sc group by 1) select fold, round(threshold, 6) threshold, round(avg(cast((x >= threshold) = (y = 1) as int)), 6) accuracy from ev join b on grp = fold group by 1, b.threshold""")
register("agreement_by_source", lambda s, d: E.agreement(pairs(s, d).withColumn("p", (F.col("x") > 2.8).cast("int")), "grp"), f"with {EV}, p as (select *, cast(x > 2.8 as int) p from ev) select grp, round(avg(cast(p = y as int)), 6) agree, sum(cast(p = 1 and y = 1 as int)) tp, sum(cast(p = 1 and y = 0 as int)) fp, sum(cast(p = 0 and y = 1 as int)) fn, sum(cast(p = 0 and y = 0 as int)) tn from p group by 1")
register("pooled_deviation", lambda s, d: E.pooled_std(pairs(s, d), "x"), f"with {EV} select round(sqrt(avg(v)), 6) pooled from (select y, var_samp(x) v from ev group by 1)")
register("quartiles", lambda s, d: E.quartiles(_corpus(s, d).withColumn("n", F.col("n_chars").cast("double")), "source", "n"), f"with {CORPUS} select source, quantile_cont(n_chars::double, 0.25) p25, quantile_cont(n_chars::double, 0.5) p50, quantile_cont(n_chars::double, 0.75) p75 from corpus group by 1")
register("entity_split", lambda s, d: E.split_by_entity(_corpus(s, d).select("doc_id", "source"), "source", 85), "select doc_id, source, case when cast('0x' || substr(md5(source), 1, 8) as bigint) % 100 < 85 then 'train' else 'test' end part from documents")
register("clip_windows", lambda s, d: E.clip_windows(_corpus(s, d).select("doc_id", "n_chars"), "doc_id", "n_chars", 500), "select doc_id, cast(unnest(range(n_chars // 500)) * 500 as int) start from documents where n_chars >= 500")
