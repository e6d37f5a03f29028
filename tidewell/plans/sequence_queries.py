"""Queries over runs, segments, peaks and ranks of the view ``signal``."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewell.functions import tables as T
from tidewell.operators import sequences as S

from .views import SIGNAL, rounded, signal, table

LOUD = "x >= 0.1"
ISLANDS = "i as (select *, idx - row_number() over (partition by track order by idx) g from signal where {c}), runs as (select track, min(idx) start, max(idx) \"end\", count(*) length, avg(x) mean from i group by track, g)"
PEAKS = "t as (select *, avg(x) over w + 1.0 * stddev_pop(x) over w lim, lag(x) over o a, lead(x) over o b from signal window w as (partition by track order by idx rows between 4 preceding and {h} following), o as (partition by track order by idx)), peaks as (select track, idx, x from t where x > lim and x > a and x > b)"

ENTRIES = {
    "deltas": (lambda s: S.deltas(s, 3), f"with {SIGNAL} select track, idx, round(x - lag(x, 1, -144.0) over w, 6) delta, round(abs(coalesce(x - lag(x, 3) over w, 0)), 6) back_delta from signal window w as (partition by track order by idx)"),
    "rolling_count": (lambda s: S.rolling_count(s, F.expr(LOUD), 10), f"with {SIGNAL} select track, idx, case when count(*) over w = 10 then sum(cast({LOUD} as int)) over w end hits from signal window w as (partition by track order by idx rows 9 preceding)"),
    "islands": (lambda s: S.runs(s, F.expr("x < 0")), f"with {SIGNAL}, {ISLANDS.format(c='x < 0')} select track, start, \"end\", length, round(mean, 6) mean from runs"),
    "long_runs": (lambda s: S.long_runs(s, F.expr("x < 0.1"), 3), f"with {SIGNAL}, {ISLANDS.format(c='x < 0.1')} select track, count(*) events, sum(length) as \"rows\", max(length) longest, array_to_string(list_sort(list(start))[1:5], ',') first_starts from runs where length >= 3 group by 1"),
    "longest_run": (lambda s: S.longest_run(s, F.expr("x < 0.1")), f"with {SIGNAL}, {ISLANDS.format(c='x < 0.1')}, b as (select track, min({{'neg': -length, 'start': start}}) b from runs group by 1) select track, b.start start, -b.neg length from b"),
    "quiet_ends": (lambda s: S.quiet_ends(s, F.expr("x > 0.5")), f"with {SIGNAL} select track, coalesce(min(case when x > 0.5 then idx end), count(*)) head, coalesce(count(*) - 1 - max(case when x > 0.5 then idx end), 0) tail from signal group by 1"),
    "local_peaks_batch": (lambda s: S.local_peaks(s, 4, 1.0, False), f"with {SIGNAL}, {PEAKS.format(h=3)} select track, idx, round(x, 6) x from peaks"),
    "local_peaks_centred": (lambda s: S.local_peaks(s, 4, 1.0, True), f"with {SIGNAL}, {PEAKS.format(h=4)} select track, idx, round(x, 6) x from peaks"),
    "spaced_peaks": (lambda s: S.spaced(S.local_peaks(s, 4, 0.5, True), 6), "with recursive " + SIGNAL + ", " + PEAKS.format(h=4).replace("1.0 * stddev", "0.5 * stddev") + ", walk as (select track, min(idx) idx from peaks group by 1 union all select track, nxt from (select w.track, (select min(p.idx) from peaks p where p.track = w.track and p.idx >= w.idx + 6) nxt from walk w) where nxt is not null) select track, idx from walk"),
    "sliding_median": (lambda s: S.sliding_median(s, 3), f"with {SIGNAL}, e as (select track, min(idx) a, max(idx) b from signal group by 1), n as (select s.track, s.idx, o.i from signal s, range(-3, 4) o(i)), v as (select n.track, n.idx, t.x from n join e using (track) join signal t on t.track = n.track and t.idx = greatest(least(n.idx + n.i, e.b), e.a)) select track, idx, round(list_sort(list(x))[4], 6) median from v group by 1, 2"),
    "fir_smoothing": (lambda s: S.smoothed(s), f"with {SIGNAL} select track, idx, round(avg(x) over (partition by track order by idx rows between 1 preceding and 1 following), 6) fir from signal"),
    "majority_vote": (lambda s: S.majority(s, F.expr("x > 0"), 2), f"with {SIGNAL} select track, idx, 2 * sum(cast(x > 0 as int)) over w > count(*) over w vote from signal window w as (partition by track order by idx rows between 2 preceding and 2 following)"),
    "confident_smoothing": (lambda s: S.confident_smoothing(s), f"with recursive {SIGNAL}, walk as (select track, idx, c * x a from signal where idx = 0 union all select s.track, s.idx, w.a + s.c * (s.x - w.a) from walk w join signal s on s.track = w.track and s.idx = w.idx + 1) select track, idx, round(a, 6) a from walk"),
    "change_segments": (lambda s: S.segments(s, F.expr("x > 0.2")), f"with {SIGNAL}, f as (select *, cast(x > 0.2 as int) k from signal), g as (select *, cast(k <> lag(k, 1, -1) over (partition by track order by idx) as int) n from f), h as (select *, sum(n) over (partition by track order by idx) segment from g) select track, segment, min(idx) start, max(idx) + 1 as \"end\", max(k) kind, round(avg(x), 6) mean from h group by 1, 2"),
    "best_window": (lambda s: S.best_window(s, 6), f"with {SIGNAL}, t as (select track, idx, round(sum(x) over w, 9) sum, count(*) over w k from signal window w as (partition by track order by idx rows 5 preceding)), b as (select track, max({{'sum': sum, 'idx': idx}}) b from t where k = 6 group by 1) select track, b.idx - 5 start, round(b.sum, 6) total from b"),
    "monocultures": (lambda s: S.monocultures(s, 0.05, 3), f"with recursive {SIGNAL}, walk as (select track, min(x) start from signal group by 1 union all select track, nxt from (select w.track, (select min(s.x) from signal s where s.track = w.track and s.x - w.start > 0.05) nxt from walk w) where nxt is not null), m as (select w.track, w.start, count(*) members from walk w join signal s on s.track = w.track and s.x >= w.start and s.x - w.start <= 0.05 group by 1, 2) select track, round(start, 6) start, members from m where members >= 3"),
}

QUERIES = {name: (lambda spark, d, f=f: rounded(f(signal(spark, d)))) for name, (f, _) in ENTRIES.items()}
ORACLE = {name: sql for name, (_, sql) in ENTRIES.items()}

QUERIES |= {
    "rank_by_score": lambda spark, d: rounded(S.top(S.zscores(table(spark, d, "part").select("p_partkey", "p_retailprice"), "p_retailprice"), [F.desc(F.round("z", 9)), F.col("p_partkey")], 40)),
    "retention_cap": lambda spark, d: S.retained(table(spark, d, "orders").select("o_custkey", "o_orderkey", "o_orderdate"), "o_custkey", [F.desc("o_orderdate"), F.desc("o_orderkey")], 3).drop("o_orderdate"),
    "contiguous_positions": lambda spark, d: S.contiguous(table(spark, d, "lineitem"), "l_orderkey", "l_linenumber"),
}
ORACLE |= {
    "rank_by_score": "with t as (select avg(p_retailprice) m, stddev_pop(p_retailprice) sd from part), z as (select p_partkey, p_retailprice, case when sd > 0 then (p_retailprice - m) / sd else 0 end z from part, t) select p_partkey, round(p_retailprice, 6) p_retailprice, round(z, 6) z, cast(row_number() over (order by round(z, 9) desc, p_partkey) as int) as rank from z qualify rank <= 40",
    "retention_cap": "select o_custkey, o_orderkey from orders qualify row_number() over (partition by o_custkey order by o_orderdate desc, o_orderkey desc) <= 3",
    "contiguous_positions": "select l_orderkey, count(*) n, min(l_linenumber) = 1 and max(l_linenumber) = count(*) and count(distinct l_linenumber) = count(*) contiguous from lineitem group by 1",
}


def segmenter(spark, d):
    """Segments by the table function, one pass over each ordered track."""
    return rounded(T.segmented(signal(spark, d), 1.0, 2))


def value_spread(spark, d):
    """Median distance from the median, by an aggregate of ours."""
    return rounded(signal(spark, d).groupBy("track").agg(T.spread("x").alias("spread")))


QUERIES |= {"segmenter": segmenter, "value_spread": value_spread}
ORACLE |= {
    "segmenter": f"""with {SIGNAL}, q as (select *, idx - lag(idx) over (partition by track order by idx) > 3 fresh from signal where abs(x) >= 1), g as (select *, sum(case when fresh then 1 else 0 end) over (partition by track order by idx) g from q)
 select track, min(idx) "start", max(idx) "end", count(*) loud, round(max(abs(x)), 6) peak, round(sum(x * x), 6) power from g group by track, g""",
    "value_spread": f"with {SIGNAL} select track, round(mad(x), 6) spread from signal group by 1",
}
