"""URL filters: rules first, then trust and distrust that spread over the links between hosts.

Everything is DataFrame functions. Host edges come from absolute links and base addresses in the pages
(relative links stay within the host), counted once per pair of hosts. Trust is a personalised PageRank
that starts from trusted hosts and follows the links; what hosts without links hold goes back to the
seeds, so none is lost. Distrust starts from blocked hosts and follows the links backwards: it is the
chance that a surfer who follows links from a host, and stops with chance ``1 - damping`` at each, meets
a blocked one, so it does not fall with the number of hosts that link to the same one. Rounds go on until
no score moves by more than ``SETTLED``. A host whose distrust passes the threshold and its trust is blocked.

All tables behind the loop have one row per host or per pair of hosts. Pages are read once for the
edges and once for the verdicts; hot hosts meet partial aggregates and a join that Spark can split.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .scratch import Scratch

RULES = (("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"), ("block", "net/fr/"))
DAMPING, THRESHOLD = 0.85, 0.3
SETTLED = 1e-5
LINK = r"""(?i)href\s*=\s*["']?(?:[a-z][a-z0-9+.\-]*:)?//([^/?#"'\s>]+)"""
UPPER, LOW = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path; both empty where the url is null or lacks ``://``."""
    at = F.coalesce(F.instr(url, "://"), F.lit(0))
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    host = F.regexp_extract(rest, r"^([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return F.translate(host, UPPER, LOW), path


def rule_of(host: Column, path: Column, rules: tuple[tuple[str, str], ...]) -> tuple[Column, Column]:
    """The longest rule that fits, and what it says; null where none does."""
    name, says = F.lit(None).cast("string"), F.lit(None).cast("string")
    for verdict, rule in sorted(rules, key=lambda r: (len(r[1]), r[1])):
        cut = rule.index("/")
        fits = ((host == rule[:cut]) | host.endswith("." + rule[:cut])) & path.startswith(rule[cut:])
        name, says = F.when(fits, F.lit(rule)).otherwise(name), F.when(fits, F.lit(verdict)).otherwise(says)
    return name, says


def url_verdicts(pages: DataFrame, rules: tuple[tuple[str, str], ...] = RULES, seeds: DataFrame | None = None, damping: float = DAMPING, settled: float = SETTLED, threshold: float = THRESHOLD) -> DataFrame:
    """One row per row of ``pages(page_id, url, html)``: page_id, host, path, rule, verdict.

    A host is trusted as far as its pages are allowed by rules (their share), and blocked as far as rules
    block its pages; rows of ``seeds(host, trust, distrust)`` add to that, up to 1. A page without a rule
    is blocked when its host's distrust is at least ``threshold`` and above its trust, else allowed.

    * Null url, or one without ``://``: host and path empty, no rule; allowed, as an empty host has
      no seed and no edge. Null or empty html: no edges.
    * Repeated rows are each judged, and count once each in a host's shares; repeated links count once.
    * Links of a host to itself count nothing. Distrust equal to the trust does not block.
    * Extra columns, whatever their names, are ignored; an empty table gives none. Pages are read whole.
    """
    scratch = Scratch(pages.sparkSession, "url-filter")
    host, path = host_and_path(F.col("url"))
    split = pages.select("page_id", "html", host.alias("host"), path.alias("path"))
    name, says = rule_of(F.col("host"), F.col("path"), rules)
    judged = split.select("page_id", "host", "path", name.alias("rule"), says.alias("says"))
    links = split.filter("host <> '' and html is not null").select("host", F.explode(F.array_distinct(F.regexp_extract_all("html", F.lit(LINK), 1))).alias("to"))
    edges = scratch.save(links.select("host", F.translate("to", UPPER, LOW).alias("to")).filter("host <> to and to <> ''").distinct())
    share = lambda v: F.avg(F.when(F.col("says") == v, 1.0).otherwise(0.0))
    seen = judged.filter("host <> ''").groupBy("host").agg(share("allow").alias("t0"), share("block").alias("d0"))
    met = edges.select(F.col("to").alias("host")).distinct()
    part = lambda c: F.least(F.lit(1.0), F.coalesce(F.sum(c), F.lit(0.0))).alias(c)
    given = seen.unionByName(met, allowMissingColumns=True)
    if seeds is not None:
        given = given.unionByName(seeds.select("host", F.col("trust").alias("t0"), F.col("distrust").alias("d0")))
    hosts = scratch.save(given.groupBy("host").agg(part("t0"), part("d0")))
    scores = hosts.select("host", F.col("t0").alias("t"), F.col("d0").alias("d"))
    if edges.limit(1).count():
        out = edges.groupBy("host").agg(F.count("*").alias("outs"))
        weighted = scratch.save(edges.join(out, "host").select("host", "to", "outs"))
        hosts = scratch.save(hosts.join(out, "host", "left"))
        start = hosts.agg(F.sum("t0")).first()[0] or 1.0
        lost = lambda s: s.join(hosts.filter("outs is null").select("host"), "host").agg(F.sum("t")).first()[0] or 0.0
        scores, moved = scratch.save(scores), settled + 1
        while moved > settled:
            back = lost(scores) / start
            forward = weighted.join(scores, "host").select(F.col("to").alias("host"), (F.col("t") / F.col("outs")).alias("t"), F.lit(0.0).alias("d"))
            reverse = weighted.join(scores.withColumnRenamed("host", "to"), "to").select("host", F.lit(0.0).alias("t"), (F.col("d") / F.col("outs")).alias("d"))
            flow = forward.unionByName(reverse).groupBy("host").agg(F.sum("t").alias("ft"), F.sum("d").alias("fd"))
            trust = F.col("t0") * (1 - damping + damping * back) + damping * F.coalesce("ft", F.lit(0.0))
            distrust = F.col("d0") + (1 - F.col("d0")) * damping * F.coalesce("fd", F.lit(0.0))
            new = scratch.save(hosts.join(flow, "host", "left").select("host", trust.alias("t"), distrust.alias("d")))
            change = F.greatest(F.abs(F.col("t") - F.col("t1")), F.abs(F.col("d") - F.col("d1")))
            moved = new.join(scores.select("host", F.col("t").alias("t1"), F.col("d").alias("d1")), "host").agg(F.max(change)).first()[0] or 0.0
            scratch.drop(scores)
            scores = new
    blocked = scores.filter((F.col("d") >= threshold) & (F.col("d") > F.col("t"))).select("host", F.lit(True).alias("bad"))
    method = F.when(F.col("bad"), "block").otherwise("allow")
    return judged.join(blocked, "host", "left").select("page_id", "host", "path", "rule", F.coalesce("says", method).alias("verdict"))


def oracle(rules: tuple[tuple[str, str], ...] = RULES, damping: float = DAMPING, rounds: int = 12, threshold: float = THRESHOLD) -> str:
    """DuckDB SQL for :func:`url_verdicts` without a table of seeds, for scores that settle in ``rounds``."""
    ordered = sorted(rules, key=lambda r: (-len(r[1]), r[1]))
    fits = lambda r: f"((host = '{r[: r.index('/')]}' or ends_with(host, '.{r[: r.index('/')]}')) and starts_with(path, '{r[r.index('/') :]}'))"
    rule = "case " + " ".join(f"when {fits(r)} then '{r}'" for _, r in ordered) + " end"
    says = "case " + " ".join(f"when {fits(r)} then '{v}'" for v, r in ordered) + " end"
    link = LINK.replace("'", "''")
    steps = ["s0 as materialized (select host, t0 t, d0 d from seeds)"]
    for i in range(1, rounds + 1):
        steps.append(f"""s{i} as materialized (select seeds.host, t0 * ({1 - damping} + {damping} * (select coalesce(sum(t), 0) from s{i - 1} anti join weighted using (host)) / (select greatest(sum(t0), 1e-9) from seeds)) + {damping} * coalesce(ft, 0) t,
    d0 + (1 - d0) * {damping} * coalesce(fd, 0) d
  from seeds left join (select "to" host, sum(t / outs) ft from weighted join s{i - 1} using (host) group by 1) f using (host)
  left join (select w.host, sum(d / outs) fd from weighted w join s{i - 1} p on p.host = w."to" group by 1) b on b.host = seeds.host)""")
    return f"""with rest as (select page_id, html, case when instr(url, '://') > 0 then substr(url, instr(url, '://') + 3) else '' end r from pages),
split as (select page_id, html, translate(regexp_extract(r, '^([^/?#]*)', 1), '{UPPER}', '{LOW}') host, regexp_extract(r, '^[^/?#]*([^?#]*)', 1) path from rest),
judged as (select page_id, host, path, {rule} as rule, {says} as says from split),
edges as (select distinct host, "to" from (select host, translate(unnest(regexp_extract_all(html, '{link}', 1)), '{UPPER}', '{LOW}') "to" from split where host <> '') where host <> "to" and "to" <> ''),
seen as (select host, avg(case when says = 'allow' then 1.0::double else 0 end) t0, avg(case when says = 'block' then 1.0::double else 0 end) d0 from judged where host <> '' group by 1),
seeds as materialized (select host, coalesce(t0, 0) t0, coalesce(d0, 0) d0 from seen full join (select distinct "to" host from edges) using (host)),
weighted as materialized (select host, "to", count(*) over (partition by host) outs from edges),
{", ".join(steps)}
select page_id, host, path, rule, coalesce(says, case when d >= {threshold} and d > t then 'block' else 'allow' end) verdict from judged left join s{rounds} using (host)"""
