"""Queries over levels of the view ``signal``."""

from __future__ import annotations

from tidewell.operators import levels as L

from .views import SIGNAL, rounded, signal

DB = "case when {p} is null or {p} < 1e-30 then -144.0 else 10 * log10({p}) end"


def _db(p: str) -> str:
    return DB.format(p=p)


def _blocks(size: int) -> str:
    return f"blocks as (select track, idx // {size} as block, avg(x * x) p from signal group by 1, 2 having count(*) = {size})"


def _sliding(hop: int, hops: int) -> str:
    return _blocks(hop) + f", sliding as (select * from (select track, block, avg(p) over w z, count(*) over w k from blocks window w as (partition by track order by block rows between {hops - 1} preceding and current row)) where k = {hops})"


def _pick(p: int, rule: str) -> str:
    at = {"floor_n": f"len(v) * {p} // 100", "round": f"cast(floor((len(v) - 1) * {p} / 100.0 + 0.5) as int)", "floor": f"cast(floor((len(v) - 1) * {p} / 100.0) as int)"}[rule]
    return f"v[least({at}, len(v) - 1) + 1]"


def _range(hop: int, hops: int, strict: bool, rule: str, scale: float) -> str:
    over = ">" if strict else ">="
    return f"""with {SIGNAL}, {_sliding(hop, hops)}, s as (select track, z * {scale} z, -0.691 + {_db(f'(z * {scale})')} db from sliding),
 f as (select *, avg(z) over (partition by track) m from s where db {over} -70), k as (select track, list_sort(list(db)) v from f where db {over} -0.691 + {_db('m')} - 20 group by 1)
 select track, round({_pick(95, rule)} - {_pick(10, rule)}, 6) range_db from k"""


def _floor(edge: int) -> str:
    return f"""with {SIGNAL}, {_blocks(2)}, b as (select *, count(*) over (partition by track) a, row_number() over (partition by track order by block) rn from blocks),
 c as (select * from b where rn > {edge} and rn <= a - {edge}), m as (select *, avg(p) over w m, count(*) over w k from c window w as (partition by track order by block rows between current row and 4 following)),
 r as (select track, min(case when k = 5 and a >= 10 then {{'m': m, 'block': block}} end) best from m group by 1)
 select track, round(case when best is not null then {_db('best.m')} end, 6) floor_db, best.block start_block from r"""


HIST = "hist as (select i::int bin, coalesce(n, 0) n from range(40) t(i) left join (select cast(greatest(least(floor((x - -0.4) / 0.05), 39), 0) as int) bin, count(*) n from signal group by 1) h on h.bin = i)"
OTSU = """c as (select bin, sum(n) over w w0, sum(n * bin) over w s0 from hist window w as (order by bin rows unbounded preceding)), t as (select sum(n) w, sum(n * bin) s from hist),
 v as (select bin, w0::double * (w - w0) * pow(s0 / w0 - (s - s0) / (w - w0), 2) b from c, t where w0 > 0 and w0 < w), best as (select min({'neg': -b, 'bin': bin}) b from v)"""

ENTRIES = {
    "level_stats": (lambda s: L.level_stats(s), f"""with {SIGNAL}, a as (select track, count(*) n, avg(x * x) p, max(abs(x)) peak, avg(x) mu, max(x) hi, min(x) lo from signal group by 1)
 select track, n, round({_db('p')}, 6) rms_db, round(case when sqrt(p) < 1e-10 then 0 else 20 * log10(peak / sqrt(p)) end, 6) crest_db, round(peak, 6) peak, round(greatest(hi - mu, mu - lo), 6) dc_free_peak, round(sqrt(greatest(p - mu * mu, 0)), 6) dc_free_rms from a"""),
    "block_spread": (lambda s: L.block_spread(s, 3), f"""with {SIGNAL}, {_blocks(3)}, a as (select track, list_sort(list({_db('p')})) v from blocks where {_db('p')} > -144 group by 1)
 select track, round({_pick(95, 'floor_n')}, 6) p95, round({_pick(5, 'floor_n')}, 6) p5, round({_pick(95, 'floor_n')} - {_pick(5, 'floor_n')}, 6) spread_db from a"""),
    "noise_floor": (lambda s: L.noise_floor(s, 2), _floor(0)),
    "interior_noise_floor": (lambda s: L.noise_floor(s, 2, edge=3), _floor(3)),
    "gated_level": (lambda s: L.gated_level(s, 2), f"""with {SIGNAL}, {_sliding(2, 4)}, s as (select *, -0.691 + {_db('z')} db from sliding), f as (select *, avg(z) over (partition by track) m from s where db >= -70)
 select track, round(-0.691 + {_db('avg(z)')}, 6) level_db, count(*) windows from f where db >= -0.691 + {_db('m')} - 10 group by 1"""),
    "level_range_long": (lambda s: L.level_range(s, 2, 3, True, "round", 0.5), _range(2, 3, True, "round", 0.5)),
    "level_range_short": (lambda s: L.level_range(s, 2, 4, False, "floor_n"), _range(2, 4, False, "floor_n", 1.0)),
    "level_range_plain": (lambda s: L.level_range(s, 2, 3, True, "floor"), _range(2, 3, True, "floor", 1.0)),
    "momentary_level": (lambda s: L.last_level(s, 50), f"""with {SIGNAL}, t as (select *, max(idx) over (partition by track) top from signal), a as (select track, avg(x * x) p, count(*) n from t where idx > top - 50 group by 1)
 select track, round(case when n < 50 then '-infinity'::double else -0.691 + {_db('p')} end, 6) level_db from a"""),
    "stereo_image": (lambda s: L.stereo(s), f"""with {SIGNAL}, a as (select track, sum(l * r) lr, sum(l * l) ll, sum(r * r) rr, var_samp(l) vl, var_samp(r) vr, covar_samp(l, r) c, count(*) n from signal group by 1),
 b as (select *, case when sqrt(ll * rr) < 1e-10 then 1.0 else lr / sqrt(ll * rr) end corr, (vl + vr) / 2 half, sqrt(pow((vl - vr) / 2, 2) + c * c) root from a)
 select track, round(corr, 6) corr, round(1 - abs(corr), 6) width, round(case when n < 2 then 0 else half + root end, 6) eig1, round(case when n < 2 then 0 else half - root end, 6) eig2, round(case when n < 2 then 0 else 0.5 * atan2(2 * c, vl - vr) end, 6) angle from b"""),
    "distortion": (lambda s: L.distortion_db(s), f"with {SIGNAL} select track, round(case when sum((l - r) * (l - r)) < 1e-10 then 100.0 else 10 * log10(sum(l * l) / sum((l - r) * (l - r))) end, 6) sdr_db from signal group by 1"),
    "zero_crossings": (lambda s: L.crossings(s, 8, 4), f"""with {SIGNAL}, t as (select track, idx, x, case when (lag(x) over (partition by track order by idx) >= 0) <> (x >= 0) then 1 else 0 end flip from signal),
 f as (select track, idx, flip, unnest(range(greatest(cast(ceil((idx - 7) / 4.0) as bigint), 0), idx // 4 + 1)) frame from t), z as (select track, frame, sum(case when idx > frame * 4 then flip else 0 end) / 7.0::double z from f group by 1, 2 having count(*) = 8)
 select track, round(avg(z), 6) zcr_mean, round(sqrt(greatest(avg(z * z) - avg(z) * avg(z), 0)), 6) zcr_std from z group by 1"""),
    "clip_ratio": (lambda s: L.clip_ratio(s, 0.9), f"with {SIGNAL} select track, round(avg(case when abs(x) >= 0.9 then 1.0 else 0.0 end), 6) clip_ratio, round(max(abs(x)), 6) peak from signal group by 1"),
    "histogram_dense": (lambda s: L.histogram(s, -0.4, 0.05, 40), f"with {SIGNAL}, {HIST} select bin, n from hist"),
    "otsu_split": (lambda s: L.otsu(L.histogram(s, -0.4, 0.05, 40)), f"with {SIGNAL}, {HIST}, {OTSU} select b.bin split_bin, round(-b.neg, 6) between from best".replace("between from", '"between" from')),
    "valley_guard": (lambda s: L.valley_guard(L.histogram(s, -0.4, 0.05, 40)), f"""with {SIGNAL}, {HIST}, {OTSU}, g as (select b.bin s from best)
 select s split_bin, max(case when bin < s then n end) left_peak, max(case when bin > s then n end) right_peak, max(case when bin = s then n end) valley, max(case when bin = s then n end) < max(case when bin < s then n end) and max(case when bin = s then n end) < max(case when bin > s then n end) bimodal from hist, g group by 1"""),
    "sparse_scan": (lambda s: L.sparse_scan(s, 5, 4), f"""with {SIGNAL}, t as (select *, greatest(count(*) over (partition by track) // 5, 1) step from signal), a as (select track, idx // step k, max(abs(x)) peak, avg(x * x) p from t where idx // step < 5 and idx - idx // step * step < 4 group by 1, 2)
 select track, count(*) windows, round(max(peak), 6) peak, round(sqrt(avg(p)), 6) rms from a group by 1"""),
    "loudest_window": (lambda s: L.loudest_window(s, 2, 4), f"with {SIGNAL}, {_sliding(2, 4)}, a as (select track, min({{'neg': -z, 'block': block}}) b from sliding group by 1) select track, b.block - 3 start_block, round(-b.neg, 6) power from a"),
    "interval_variation": (lambda s: L.intervals(s, 0.0), f"""with {SIGNAL}, u as (select *, lag(x) over (partition by track order by idx) q from signal), o as (select track, idx, idx - lag(idx) over (partition by track order by idx) gap from u where x > 0 and coalesce(q, '-infinity'::double) <= 0)
 select track, count(*) onsets, round(case when count(*) >= 3 then stddev_pop(gap) / avg(gap) end, 6) cv from o group by 1"""),
    "interval_mode": (lambda s: L.interval_mode(s, 0.0, 2), f"""with {SIGNAL}, u as (select *, lag(x) over (partition by track order by idx) q from signal), o as (select track, idx - lag(idx) over (partition by track order by idx) gap from u where x > 0 and coalesce(q, '-infinity'::double) <= 0),
 b as (select track, gap // 2 bin, count(*) n from o where gap is not null group by 1, 2), a as (select track, min({{'neg': -n, 'bin': bin}}) b from b group by 1) select track, b.bin * 2 gap, -b.neg votes from a"""),
    "transient_density": (lambda s: L.transient_density(s, 2, 10, 1.5), f"""with {SIGNAL}, h as (select track, idx, cast(avg(abs(x)) over (partition by track order by idx rows 1 preceding) > 1.5 * avg(abs(x)) over (partition by track order by idx rows 9 preceding) as int) hot from signal),
 e as (select track, idx, hot = 1 and coalesce(lag(hot) over (partition by track order by idx), 0) = 0 edge from h) select track, sum(cast(edge as int)) edges, round(avg(cast(edge as int)), 6) density from e where idx >= 10 group by 1"""),
    "jump_density": (lambda s: L.jump_density(s), f"""with {SIGNAL}, d as (select track, abs(x - lag(x) over (partition by track order by idx)) d from signal), l as (select *, avg(d) over (partition by track) + stddev_pop(d) over (partition by track) lim from d)
 select track, round(avg(case when d > lim then 1.0 else 0.0 end), 6) density from l group by 1"""),
    "lag_correlation": (lambda s: L.lag_correlation(s, 2, 10), f"""with {SIGNAL}, c as (select track, idx, x - avg(x) over (partition by track) y from signal), z as (select track, sum(y * y) r0 from c group by 1),
 r as (select a.track, b.lag, sum(a.y * a2.y) r from c a, range(2, 11) b(lag), c a2 where a2.track = a.track and a2.idx + b.lag = a.idx group by 1, 2), b as (select track, min({{'neg': -round(r, 9), 'lag': lag}}) b from r group by 1)
 select track, cast(b.lag as int) lag, round(-b.neg / r0, 6) confidence from b join z using (track)"""),
}

QUERIES = {name: (lambda spark, d, f=f: rounded(f(signal(spark, d)))) for name, (f, _) in ENTRIES.items()}
ORACLE = {name: sql for name, (_, sql) in ENTRIES.items()}
