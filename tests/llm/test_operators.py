"""Each operator against a brute-force version, and on edge cases: nulls, empty tables, ties, clashing names."""

import collections
import html
import random
import re
import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tidewell.llm import bpe, cotraining, html_text, jpeg, media, mixing, ngram_join, packing, quality, ragged, token_counts, url_filter
from tidewell.llm.line_dedup import dedup_lines

from ..conftest import SMALL

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def docs(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], DOCS)


def words(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def shingles(text, k=5):
    w = words(text)
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set()


def components(rows):
    """Brute force over all pairs."""
    sets = collections.defaultdict(list)
    for i, t in rows:
        if i is not None:
            sets[i].append(shingles(t))
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            if any(x and y and 100 * len(x & y) >= 80 * len(x | y) for x in sets[a] for y in sets[b]):
                lo, hi = sorted((find(a), find(b)))
                parent[hi] = lo
    return {i: find(i) for i in ids}


def family(seed, copies, n, edits):
    """Texts that differ from a base in a few words each."""
    r = random.Random(seed)
    base = [f"w{r.randint(0, 10**6)}" for _ in range(n)]
    out = []
    for _ in range(copies):
        t = list(base)
        for _ in range(r.randint(0, edits)):
            t[r.randrange(n)] = f"x{r.randint(0, 10**6)}"
        out.append(" ".join(t))
    return out


@pytest.mark.parametrize("least", [64, 4])
def test_ngram_join_equals_brute_force(spark, least):
    """A low bound makes most shingles frequent, so that combination keys and blocks do the work."""
    shared = " ".join(f"common{i}" for i in range(60))
    texts = [t for s in range(3) for t in family(s, 14, 120, 7)] + [f"{shared} {a} {b}" for a, b in zip(family(9, 12, 14, 12), family(10, 12, 4, 4))]
    texts += ["", None, "one", "ONE", "one two", " \t\n", "a b c d e", "A b  c d e", *["same text here for all of you"] * 5]
    rows = [(i * 3, t) for i, t in enumerate(texts)]
    random.Random(1).shuffle(rows)
    got = {r.doc_id: r for r in ngram_join.ngram_components(docs(spark, rows), least=least).collect()}
    want = components(rows)
    assert {i: r.component_id for i, r in got.items()} == want
    assert all(got[i].n_shingles == len(shingles(t)) for i, t in rows)


def test_ngram_join_edges(spark):
    rows = [(None, "a b c d e f"), (2, "a b c d e f"), (2, "a b c d e f"), (1, "a b c d e f"), (5, None)]
    got = sorted((r.doc_id or -1, r.component_id) for r in ngram_join.ngram_components(docs(spark, rows)).collect())
    assert got == [(-1, None), (1, 1), (2, 1), (2, 1), (5, 5)]
    assert ngram_join.ngram_components(docs(spark, [])).count() == 0
    long = " ".join(f"w{i}" for i in range(150_000))
    clash = docs(spark, [(1, long), (2, long + " end"), (3, "end")]).withColumns({c: F.lit("x") for c in ("component_id", "n_shingles", "key", "sig")})
    assert sorted((r.doc_id, r.component_id) for r in ngram_join.ngram_components(clash).collect()) == [(1, 1), (2, 1), (3, 3)]


def test_short_frequent_sets_equal_brute_force(spark):
    """Few different words and a low bound: all shingles are frequent and sets hold a handful of them."""
    g = random.Random(12)
    rows = [(i, " ".join(g.choice("abc") for _ in range(g.randint(5, 11)))) for i in range(150)]
    got = {r.doc_id: r.component_id for r in ngram_join.ngram_components(docs(spark, rows), least=4).collect()}
    assert got == components(rows)


def test_passages_of_unlike_documents_are_not_compared_in_blocks(spark, monkeypatch):
    """A large corpus: 60 documents a passage, and so many shingles that a bound in proportion to them would be 120."""
    r = random.Random(4)
    word = lambda: "".join(r.choices("abcdefgh", k=6))
    passages = [" ".join(word() for _ in range(40)) for _ in range(4)]
    rows = [(i, " ".join([*(word() for _ in range(60)), passages[i % 4], *(word() for _ in range(40))])) for i in range(240)]
    rows += [(1000 + i, t + " and more") for i, t in rows[:20]]
    monkeypatch.setattr(ngram_join, "HEAVY", 300)
    compared = []
    monkeypatch.setattr(ngram_join, "_blocks", lambda hot, *rest, f=ngram_join._blocks: compared.append(hot.count()) or f(hot, *rest))
    got = {x.doc_id: x.component_id for x in ngram_join.ngram_components(docs(spark, rows), least=8).collect()}
    assert got == components(rows) and got[1003] == 3
    assert not compared


def test_no_combination_key_is_common_to_random_sets():
    g = np.random.default_rng(1)
    seen = collections.Counter(k for _ in range(2000) for k in {key for key, _, _ in ngram_join.combination_keys(np.unique(g.integers(0, 2**63, int(g.integers(4, 7))).astype(np.uint64)), 5)})
    assert max(seen.values()) == 1


def test_combination_keys_meet_for_linked_sets():
    g = np.random.default_rng(0)
    for n in (4, 5, 6, 9, 30, 200, 777):
        for _ in range(30):
            x = np.unique(g.integers(0, 2**63, n).astype(np.uint64))
            cut = int(len(x) * g.integers(0, 12) / 100)
            y = np.unique(np.concatenate([x[cut:], g.integers(0, 2**63, g.integers(0, cut + 1)).astype(np.uint64)]))
            common = len(np.intersect1d(x, y))
            if 100 * common >= 80 * (len(x) + len(y) - common):
                a, b = (ngram_join.combination_keys(v, len(v)) for v in (x, y))
                shared = collections.Counter(f for k, f, _ in a if (k, f) in {(k2, f2) for k2, f2, _ in b})
                assert any(shared[f] >= max(1, *(m for _, f2, m in a + b if f2 == f)) for f in shared)


PAGES = "page_id long, url string, html string"
LINK = '<a href="http://{}/x">'


def blocked(spark, *hosts):
    return spark.createDataFrame([(h, 0.0, 1.0) for h in hosts], "host string, trust double, distrust double")


def test_url_rules_and_propagation(spark):
    rows = [
        (1, "http://WWW.Example.com/en/a?x", ""), (2, "http://example.com/en/", ""), (3, "https://a.net/es/x", None), (4, "https://a.net/en/x", LINK.format("casino-x.org")),
        (5, "http://b.org/1", LINK.format("casino-x.org") + " x" * 300_000), (6, "casino", ""), (7, None, ""), (8, "http://casino-x.org/#a", LINK.format("c.org")), (9, "http://c.org", ""), (10, "http://com", ""), (10, "http://com/", ""),
        (11, "http://d.org", '<base href="//casino-x.org/sub/"><a href="y">y</a>'),
    ]
    table = spark.createDataFrame([(*r, "x", "y") for r in rows], PAGES + ", host string, verdict string")
    got = sorted(tuple(r) for r in url_filter.url_verdicts(table, seeds=blocked(spark, "casino-x.org")).collect())
    rule = {(i, p): (h, r, v) for i, h, p, r, v in got}
    assert rule[1, "/en/a"] == ("www.example.com", "www.example.com/en/", "allow")
    assert rule[2, "/en/"][1:] == ("example.com/en/", "block") and rule[3, "/es/x"][1:] == ("net/es/", "block")
    assert rule[8, "/"] == ("casino-x.org", None, "block") and rule[5, "/1"] == ("b.org", None, "block") and rule[11, ""][2] == "block"
    assert rule[6, ""] == rule[7, ""] == ("", None, "allow")
    assert rule[9, ""] == ("c.org", None, "allow") and rule[10, "/"][1:] == ("com/", "allow") and rule[10, ""][1] is None
    assert url_filter.url_verdicts(spark.createDataFrame([], PAGES)).count() == 0


def test_distrust_does_not_fall_with_in_degree(spark):
    rows = [(i, f"http://f{n}-{i}.org/", LINK.format(f"casino-{n}.org")) for n in (3, 100, 10_000) for i in range(n)]
    rows += [(-1, "http://fair.org/", "".join(LINK.format(f"h{i}.org") for i in range(29)) + LINK.format("casino-100.org"))]
    chain = ["casino-c.org", *(f"c{i}.org" for i in range(1, 10))]
    rows += [(-2, f"http://{a}/", LINK.format(b)) for b, a in zip(chain, chain[1:])]
    seeds = blocked(spark, "casino-3.org", "casino-100.org", "casino-10000.org", "casino-c.org")
    out = url_filter.url_verdicts(spark.createDataFrame(rows, PAGES), seeds=seeds).toPandas().set_index("host").verdict
    assert (out[out.index.str.match(r"f\d+-")] == "block").all() and out["fair.org"] == "allow"
    assert [out[f"c{i}.org"] for i in range(1, 10)] == ["block"] * 7 + ["allow"] * 2  # 0.85**7 is above the threshold


def random_web(n=60, seed=4):
    g = random.Random(seed)
    hosts = [f"h{i}.{g.choice(['com', 'net', 'org'])}" for i in range(n)]
    return hosts, [(i, f"http://{h}/{g.choice(['es', 'fr', 'en'])}/x", "".join(LINK.format(g.choice(hosts)) for _ in range(g.choice([0, 1, 2, 5])))) for i, h in enumerate(hosts * 3)]


def test_scores_equal_numpy(spark):
    """Both scores of a random graph with hosts without links, against matrices; and against the SQL."""
    hosts, rows = random_web()
    at = {h: i for i, h in enumerate(hosts)}
    n, m = len(hosts), np.zeros((len(hosts), len(hosts)))
    for _, url, page in rows:
        h = url.split("/")[2]
        for to in re.findall(r"http://([^/]+)", page):
            m[at[h], at[to]] = h != to
    says = lambda url: "allow" if ".com/" in url else "block" if re.search(r"\.net/(es|fr)/", url) else None
    t0, d0 = (np.array([np.mean([says(u) == v for _, u, _ in rows if u.split("/")[2] == h]) for h in hosts]) for v in ("allow", "block"))
    out = m.sum(axis=1)
    walk, idle = m / np.maximum(out, 1)[:, None], out == 0
    t, d = t0.copy(), d0.copy()
    for _ in range(400):
        t, d = 0.15 * t0 + 0.85 * (walk.T @ t + t[idle].sum() * t0 / t0.sum()), d0 + (1 - d0) * 0.85 * (walk @ d)
    assert t.sum() == pytest.approx(t0.sum())
    bad = {h for h, x, y in zip(hosts, d, t) if x >= 0.3 and x > y}
    want = {(i, says(u) or ("block" if u.split("/")[2] in bad else "allow")) for i, u, _ in rows}
    table = spark.createDataFrame(rows, PAGES)
    got = url_filter.url_verdicts(table).toPandas()
    assert {(r.page_id, r.verdict) for r in got.itertuples()} == want and len({v for _, v in want}) == 2 and bad
    import duckdb

    pages = table.toPandas()  # noqa: F841
    sql = duckdb.sql(url_filter.oracle(rounds=60)).df()
    assert sorted(sql.itertuples(index=False), key=str) == sorted(got.itertuples(index=False), key=str)


def test_text_counts_equal_brute_force():
    g = random.Random(3)
    texts = ["", "\n\n", "a", "x y\nx y\n x y\nx y", "a b c d e f g h " * 3, "é#ß %|  z"]
    texts += ["\n".join(" ".join(g.choice(["a", "b", "Üx", "#", "c"]) for _ in range(g.randint(0, 9))) for _ in range(g.randint(1, 9))) for _ in range(60)]
    got = quality.text_counts(pa.array(texts))
    for i, t in enumerate(texts):
        w = WORD.findall(t)
        lines = [x for x in t.split("\n") if WORD.search(x)]
        grams = collections.Counter(tuple(w[j : j + 8]) for j in range(len(w) - 7))
        hit = {k for j in range(len(w) - 7) if grams[tuple(w[j : j + 8])] > 1 for k in range(j, j + 8)}
        want = (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(hit))
        assert tuple(int(got[c][i]) for c in quality.STATS) == want, t


def kneser_ney(counts):
    """Modified Kneser-Ney over dicts: log probability of each six-byte sequence, one group."""
    levels = {6: dict(counts)}
    for w in range(5, 0, -1):
        levels[w] = collections.Counter({k[1:]: 0 for k in levels[w + 1]})
        levels[w].update(k[1:] for k, n in levels[w + 1].items() if n)
    cuts, sums = {}, {}
    for w, level in levels.items():
        of = collections.Counter(n for n in level.values() if n)
        y = of[1] / (of[1] + 2 * of[2]) if of[1] + of[2] else 0.5
        cuts[w] = [0.0] + [min(max(i - (i + 1) * y * of[i + 1] / of[i], 0.1), i - 0.1) if of[i] and of[i + 1] else 0.5 for i in (1, 2, 3)]
        for k, n in level.items():
            total, cut = sums.get((w, k[:-1]), (0, 0.0))
            sums[w, k[:-1]] = total + n, cut + cuts[w][min(n, 3)]

    def p(k):
        if not k:
            return 1 / 256
        total, left = sums[len(k), k[:-1]]
        n = levels[len(k)][k]
        return (n - cuts[len(k)][min(n, 3)] + left * p(k[1:])) / total if total else p(k[1:])

    return {k: float(np.log(p(k))) for k in counts}


def test_kneser_ney_equals_brute_force(spark, tmp_path):
    from tidewell.llm.scratch import Scratch

    g = random.Random(2)
    texts = [" ".join(g.choice(["the", "then", "of", "öl", "a,", "你好"]) for _ in range(g.randint(20, 60))) for _ in range(25)] + ["#### $$$$ %%%% " * 30, "of", None]
    rows = [(i, t, g.choice(["en", "xx"]), "s", 0) for i, t in enumerate(texts)]
    names = ("en", "xx")
    counted = quality.count_sequences(spark.createDataFrame(rows, DOCS), names)
    got = {r.key: r.log_p for r in quality.kneser_ney(counted, Scratch(spark, "test")).collect()}
    learn = quality.prose(quality.text_counts(pa.array(texts)))
    want = {}
    for g_, name in enumerate(names):
        counts = collections.Counter()
        for i, t in enumerate(texts):
            raw = (t or "").encode()
            for j in range(len(raw) - 5):
                if rows[i][2] == name:
                    counts[raw[j : j + 6]] += int(learn[i])
        want |= {int.from_bytes(k, "big") | g_ << 48: v for k, v in kneser_ney(counts).items()}
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k], abs=1e-9) for k in want)
    key = np.array(sorted(want), np.int64)
    table = quality.HashArrays(key, np.array([want[k] for k in key.tolist()]))
    assert (np.diff(table.hash.astype(object)) > 0).all()
    assert np.allclose(table.find(np.append(key, [5, 6])), [*(want[k] for k in key.tolist()), 0, 0], atol=1e-5)


def test_scores_by_broadcast_and_by_join_agree(spark):
    from tidewell.llm.scratch import Scratch

    body = spark.read.parquet(f"{SMALL}/documents.parquet").limit(60).unionByName(docs(spark, [(None, None), (1, ""), (1, "ab"), (1, "ab"), (2, "word " * 200_000)])).select(F.struct("doc_id", F.lit(1).alias("kept")).alias("row"), "lang", "text")
    model = quality.kneser_ney(quality.count_sequences(body), Scratch(spark, "test"))
    a, b = (sorted(map(str, quality.score(body, model, quality.share(model, n)).withColumn("mean_log_p", F.round("mean_log_p", 4)).collect())) for n in (1 << 20, 0))
    assert a == b and len(a) == 65


def test_quality_rejects_shuffled_bytes_of_any_script(spark):
    """Other scripts keep their letters: text with its letters in another order stands out."""
    g = random.Random(11)
    syllables = ["мо", "ре", "на", "ко", "ли", "та"]
    text = lambda: " ".join("".join(g.choice(syllables) for _ in range(g.randint(1, 4))) for _ in range(60))
    rows = [(i, text(), "ru", "s", 0) for i in range(200)]
    rows += [(1000 + i, " ".join("".join(g.sample(w, len(w))) for w in text().split()), "ru", "s", 0) for i in range(5)]
    out = quality.quality(spark.createDataFrame(rows, DOCS), ["doc_id"]).select("row.doc_id", "kept").toPandas().set_index("doc_id").kept
    assert out.loc[:199].mean() > 0.98


def test_quality_on_small_tables(spark):
    d = spark.read.parquet(f"{SMALL}/documents.parquet")
    out = quality.quality(d, ["doc_id"]).select("row.doc_id", "base_failed", "kept").toPandas()
    labels = spark.read.parquet(f"{SMALL}/labels.parquet").toPandas().merge(out, on="doc_id")
    good = labels[(labels.quality == 1) & ~labels.base_failed]
    assert len(out) == d.count() and good.kept.mean() > 0.98
    assert not out[out.base_failed].kept.any()
    edge = quality.quality(spark.createDataFrame([(1, None, None, 5), (1, "", "xx", 6), (1, "ab", "en", 7)], "doc_id long, text string, lang string, n_words long"))
    assert [r.kept for r in edge.collect()] == [False] * 3 and edge.columns[0] == "row"
    nulls = quality.quality(spark.createDataFrame([(None, None, None)] * 3, "doc_id long, text string, lang string")).collect()
    assert [(r.n_words, r.kept) for r in nulls] == [(0, False)] * 3
    assert quality.quality(d.limit(0), ["doc_id"]).count() == 0


def test_every_language_has_bands_or_no_perplexity(spark):
    g = random.Random(8)
    text = lambda letters: " ".join("".join(g.choice(letters) for _ in range(g.randint(2, 7))) for _ in range(60))
    rows = [(i, text("abcdef"), "en", "s", 0) for i in range(150)] + [(i, text("uvwxyz"), "xx", "s", 0) for i in range(150, 180)] + [(180, text("abcdef"), "xx", "s", 0)]
    rows += [(i, text("##$$ab"), None, "s", 0) for i in range(200, 212)] + [(i, text("mnopqr"), "r%d" % i, "s", 0) for i in range(300, 303)] + [(303, text("uvwxyz"), "en", "s", 0)]
    out = quality.quality(spark.createDataFrame(rows, DOCS), ["doc_id"]).select("row.doc_id", "base_failed", "kept", "log_perplexity", "lang_group").toPandas().set_index("doc_id")
    assert not out.base_failed.any() and out.kept.loc[:179].mean() > 0.98 and not out.kept[180] and not out.kept[303]
    assert out.log_perplexity.loc[200:211].isna().all() and not out.kept.loc[200:211].any()
    assert out.lang_group.loc[[0, 150, 200, 300, 302]].tolist() == [0, 1, 2, 3, 3] and out.log_perplexity.loc[300:302].notna().all()


def test_mixing_meets_targets(spark):
    g = random.Random(5)
    rows = [(i, " ".join(f"t{g.randint(0, 400)}" for _ in range(30)), g.choice(["en", "de", None]), g.choice(["a", "a", "a", "b", "c"]), 0) for i in range(600)]
    d = spark.createDataFrame(rows, DOCS)
    out = mixing.mix(d, {"source": {"a": 0.2, "b": 0.4, "c": 0.4}}, carry=["doc_id"]).toPandas()
    w = (out.n_tokens * out.probability).groupby(out.source).sum()
    assert np.allclose(w / w.sum(), [0.2, 0.4, 0.4], atol=1e-3)
    assert out.probability.max() == pytest.approx(1) and 0 < out.sampled.sum() < len(out)
    again = mixing.mix(d, {"source": {"a": 0.2, "b": 0.4, "c": 0.4}}, carry=["doc_id"]).toPandas()
    assert (out.set_index(out.row.map(str)).sampled.sort_index() == again.set_index(again.row.map(str)).sampled.sort_index()).all()
    assert mixing.mix(d.limit(0), carry=["doc_id"]).count() == 0
    assert mixing.mix(docs(spark, [(1, None), (2, "")])).count() == 2
    clash = mixing.mix(docs(spark, [(1, "a b"), (1, "a b"), (2, "word " * 100_000)]).withColumns({c: F.lit(1) for c in ("topic", "row", "sampled", "w")}))
    assert clash.columns[0] == "row" and len(clash.select("row.*").columns) == 9 and len({r.sampled for r in clash.filter("row.doc_id = 1").collect()}) == 1


def raked(w, codes, goals):
    """Plain proportional fitting, without limits on what a cell holds."""
    z = w.copy()
    for _ in range(2000):
        for c, g in zip(codes, goals):
            z = z * (g / np.maximum(np.bincount(c, z, len(g)), 1e-300))[c]
    return z


def test_raking_equals_numpy(spark):
    """A small budget, so that no cell is exhausted: default and given targets, as arrays and as a table."""
    from tidewell.llm.scratch import Scratch

    g = np.random.default_rng(8)
    cells = [(s, lang, t, int(g.integers(500, 3000))) for s in "abc" for lang in ("en", "de", None) for t in range(3)]
    w = np.array([c[3] for c in cells], float)
    values = [sorted({c[d] for c in cells}, key=str) for d in range(3)]
    codes = [np.array([values[d].index(c[d]) for c in cells]) for d in range(3)]
    for targets in (None, {"source": {"a": 0.2, "b": 0.2, "c": 0.6}}):
        shares = [np.bincount(c, w) ** mixing.TEMPER for c in codes]
        if targets:
            shares[0] = np.array([0.2, 0.2, 0.6])
        want = raked(w, codes, [x / x.sum() * 0.05 * w.sum() for x in shares]) / w
        assert np.allclose(mixing.rake_arrays(np.array(codes), w, shares, 0.05)[0], want, rtol=1e-3)
        table = spark.createDataFrame(cells, "source string, lang string, topic long, w long")
        for out in (mixing.rake(table, targets, Scratch(spark, "test"), 0.05), mixing._raked_in_one_task(table, targets, 0.05)):
            got = {(r.source, r.lang, r.topic): r.probability for r in out.collect() if r.settled}
            assert len(got) == len(cells) and all(got[c[:3]] == pytest.approx(x, rel=1e-3) for c, x in zip(cells, want))


def test_default_targets_hold_in_the_sample(spark):
    out = mixing.mix(spark.read.parquet(f"{SMALL}/documents.parquet"), carry=["doc_id"], budget=0.1, vocabulary=public_tokenizers.path("word_bpe_49k.json")).toPandas()
    for d in mixing.DIMENSIONS:
        aim = out.n_tokens.groupby(out[d]).sum() ** mixing.TEMPER
        share = (out.n_tokens * out.probability).groupby(out[d]).sum() / (out.n_tokens * out.probability).sum()
        assert out.probability.max() == pytest.approx(1) or np.allclose(share, aim / aim.sum(), atol=1e-3)
    assert out.topic.nunique() > 3


def test_contradicting_targets_warn():
    p, settled = mixing.rake_arrays(np.array([[0, 1], [0, 1], [0, 1]]), np.array([100.0, 100.0]), [np.array([0.9, 0.1]), np.array([0.1, 0.9]), np.ones(2)], 0.5)
    assert not settled and len(p) == 2


def test_topics_are_clusters(spark):
    """Texts over different words fall in different topics; each vector is nearest to its own centroid."""
    g = random.Random(1)
    rows = [(i, " ".join(f"{'abc'[i % 3]}{g.randint(0, 30)}" for _ in range(40)), "en", "s", 0) for i in range(300)]
    out = mixing.mix(spark.createDataFrame(rows, DOCS), carry=["doc_id"]).toPandas()
    groups = out.groupby(out.row.map(lambda r: r["doc_id"] % 3)).topic
    assert (groups.agg(lambda t: t.value_counts(normalize=True).iloc[0]) > 0.4).all() and not set(out[out.topic == groups.agg(lambda t: t.mode()[0])[0]].row.map(lambda r: r["doc_id"] % 3)) - {0}


def test_one_rare_row_leaves_the_mix_alone(spark):
    g = random.Random(6)
    rows = [(i, " ".join(f"t{g.randint(0, 400)}" for _ in range(30)), g.choice(["en", "en", "en", "de"]), g.choice("aaab"), 0) for i in range(1500)]
    before = mixing.mix(spark.createDataFrame(rows, DOCS), carry=["doc_id"]).toPandas()
    after = mixing.mix(spark.createDataFrame([*rows, (1500, rows[0][1], None, "a", 0)], DOCS), carry=["doc_id"]).toPandas()
    for out in (before, after):
        assert (out.n_tokens * out.probability).sum() == pytest.approx(mixing.BUDGET * out.n_tokens.sum(), rel=0.01)
    p, q = (out.set_index(out.row.map(lambda r: r["doc_id"])).probability.sort_index() for out in (before, after))
    t, u = (out.set_index(out.row.map(lambda r: r["doc_id"])).topic.sort_index() for out in (before, after))
    moved = t != u[:1500]  # centroids are fitted to all rows, so a row between two topics may change sides
    assert q[1500] == 1 and (p - q[:1500]).abs()[~moved].max() < 0.02 and (p - q[:1500]).abs().mean() < 0.01 and moved.mean() < 0.1 and (p > 0).all()


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_encoder_equals_library(name):
    g = random.Random(7)
    alphabet = [*"aAbstZ'  \n\t123!?.<|>éÉßİıΣσς你好́ 😀한े٣İǅ\x00\x1c\x85’", "'s", "'re", "'ll", "<|endoftext|>", "<|startoftext|>", " the", "aaaaaa"]
    texts = ["", *("".join(g.choice(alphabet) for _ in range(g.randint(0, 50))) for _ in range(800)), "a" * 5000]
    library = Tokenizer.from_file(public_tokenizers.path(name))
    want = [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]
    code = bpe.Encoder(public_tokenizers.path(name))
    for _ in range(2):  # the second time from the table of known pre-tokens
        ids, count = code.encode(texts)
        cut = np.append(0, np.cumsum(count))
        assert [ids[a:b].tolist() for a, b in zip(cut[:-1], cut[1:])] == want
        assert code.encode(texts, ids=False)[1].tolist() == [len(w) for w in want]


def test_encoder_has_ids_of_what_it_only_counted():
    """One worker may count texts first and encode them later with the same encoder."""
    texts = ["of the sea", "the other", "sea of the of"]
    code, library = (f(public_tokenizers.path("word_bpe_49k.json")) for f in (bpe.Encoder, Tokenizer.from_file))
    want = [library.encode(t, add_special_tokens=False).ids for t in texts]
    assert code.encode(texts, ids=False)[1].tolist() == [len(w) for w in want]
    assert code.encode(texts)[0].tolist() == sum(want, [])


def test_search_index_equals_counting():
    """The index built block by block holds how many hashes lie below each bin."""
    g = np.random.default_rng(4)
    for size in (0, 1, 2, 1000, 300_000):
        key = np.unique(g.integers(0, 1 << 50, size))
        table = quality.HashArrays(key, -np.arange(1.0, len(key) + 1))
        assert (table.find(key) == -np.arange(1.0, len(key) + 1, dtype=np.float32)).all() and (table.find(np.array([1 << 51])) == 0).all()
        if size:
            shift = np.uint64(64 - max(1, len(key).bit_length()))
            bins = np.bincount((table.hash >> shift).astype(np.int64), minlength=1 << int(64 - shift))
            assert (table.start == np.append(0, np.cumsum(bins))).all()


def test_token_counts(spark):
    rows = [(1, None), (None, "abc <|endoftext|> ü"), (1, "x" * 3000), (1, "x" * 3000)]
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    out = token_counts.token_counts(docs(spark, rows), public_tokenizers.path("byte_bpe_50k.json"), 10).collect()
    want = [(i, len((t or "").encode()), len(library.encode(t or "", add_special_tokens=False).ids)) for i, t in rows]
    assert sorted(((r.doc_id or 0, r.n_bytes, r.n_tokens) for r in out)) == sorted((i or 0, b, n) for i, b, n in want)
    assert [r.over_limit for r in sorted(out, key=lambda r: r.n_tokens)] == [False, False, True, True]
    path = public_tokenizers.path("byte_bpe_50k.json")
    assert token_counts.token_counts(docs(spark, []), path).count() == 0
    clash = docs(spark, [(1, "a b")]).withColumns({"n_tokens": F.lit(9), "n_bytes": F.lit("x")})
    assert token_counts.token_counts(clash, path).first().n_bytes == 3


def test_progressive_round_trip():
    g = np.random.default_rng(1)
    planes = []
    for i in range(25):
        wide, high = (int(v) for v in g.integers(1, 5, 2))
        n = wide * high
        c = [g.integers(-400, 400, (m, 64)) * (g.random((m, 64)) < g.random()) for m in (4 * n, n, n)]
        planes.append(((wide, high), [np.clip(x, -2, 2) for x in c] if i % 3 == 0 else c))
    images, out = jpeg.read(jpeg.write(planes))
    for (_, c), image in zip(planes, images):
        assert all((out[b : b + len(x)] == x).all() for b, x in zip(image.base, c))
    grey = jpeg.pixels(images[0], jpeg.samples(images, np.zeros_like(out)))
    assert grey.shape == (images[0].height, images[0].width, 3) and (grey == 128).all()


def test_inverse_transform_and_colour():
    flat = np.zeros((4, 64), np.int64)
    flat[:, 0] = 8 * 50
    red = np.zeros((1, 64), np.int64)
    red[:, 0] = 8 * 20  # one value all over, so upsampling leaves it
    images, out = jpeg.read(jpeg.write([((1, 1), [flat, np.zeros_like(red), red])]))
    rgb = jpeg.pixels(images[0], jpeg.samples(images, out))
    assert (rgb[..., 0] == round(178 + 1.402 * 20)).all() and (rgb[..., 2] == 178).all()


def test_inverse_transform_equals_the_definition():
    """Random coefficients of all three components, against the cosine sums written out, chroma between samples."""
    g = np.random.default_rng(6)
    c = [(g.integers(-30, 30, (n, 64)) * (g.random((n, 64)) < 0.2)) for n in (8, 2, 2)]
    images, out = jpeg.read(jpeg.write([((2, 1), c)]))
    rgb = jpeg.pixels(images[0], jpeg.samples(images, out)).astype(float)
    x = np.arange(8)
    wave = np.array([[np.cos((2 * a + 1) * u * np.pi / 16) * (np.sqrt(0.125) if u == 0 else 0.5) for a in x] for u in x])
    order = zigzag()

    def plane(blocks, wide, high):
        full = np.zeros((8 * high, 8 * wide))
        for i, b in enumerate(blocks):
            f = np.zeros((8, 8))
            for k, (v, u) in enumerate(order):
                f[v, u] = b[k]
            full[8 * (i // wide) : 8 * (i // wide) + 8, 8 * (i % wide) : 8 * (i % wide) + 8] = wave.T @ f @ wave
        return full

    y, cb, cr = plane(c[0], 4, 2) + 128, plane(c[1], 2, 1), plane(c[2], 2, 1)
    big = []
    for p in (cb, cr):
        for axis in (0, 1):
            at = (np.arange(2 * p.shape[axis]) - 0.5) / 2
            low = np.floor(at).astype(int)
            take = lambda i: np.take(p, np.clip(i, 0, p.shape[axis] - 1), axis)  # noqa: E731, B023
            share = (at - low).reshape((-1, 1) if axis == 0 else (1, -1))
            p = take(low) * (1 - share) + take(low + 1) * share
        big.append(p)
    want = np.stack([y + 1.402 * big[1], y - 0.344136 * big[0] - 0.714136 * big[1], y + 1.772 * big[0]], axis=-1)
    assert rgb.shape == want.shape and np.abs(rgb - want.clip(0, 255)).max() <= 0.51


def zigzag():
    return sorted(((v, u) for v in range(8) for u in range(8)), key=lambda p: (sum(p), p[0] if sum(p) % 2 else p[1]))


def test_media_digests(spark):
    texts = ["", None, "abc", "abc", "\x01\x00é" * 500, "z" * 64, bytes(range(128)).decode() * 40]
    clash = docs(spark, list(enumerate(texts))).withColumns({"media": F.lit(1), "feature": F.lit(2)})
    out = media.media_digests(clash, keep_files=True, keep_tensors=True).orderBy("doc_id").collect()
    assert media.media_digests(docs(spark, [])).count() == 0
    for t, r in zip(texts, out):
        raw = (t or "").encode()
        want = raw + b"\0" * (max(64, -(-len(raw) // 64) * 64) - len(raw))
        images, c = jpeg.read([bytes(r.media)])
        assert media.payload(images[0], c, r.payload_bytes) == want and r.n_bytes == len(raw)
        assert r.tail_crc32 == zlib.crc32(want[-64:]) and r.media_bytes == len(r.media)
        rgb = np.frombuffer(r.rgb, np.uint8).reshape(r.height, r.width, 3)
        assert media.feature(rgb) == r.feature and (rgb == media.tensors([bytes(r.media)])[0]).all()
    assert out[0].feature == out[1].feature and out[2].media_sha256 == out[3].media_sha256


def line_blocks(weight):
    """Surge and dive line by line: the start and end of each block."""
    out, start, run = [], None, []
    for i in range(len(weight) + 1):
        window = sum(weight[i : i + 3]) if i < len(weight) else 0
        if window > 0:
            run.append(i)
            if start is None and window >= 86:
                start = i
        else:
            if start is not None:
                out.append((start, i))
            start, run = None, []
    return out


def test_line_blocks_equal_brute_force():
    g = np.random.default_rng(3)
    for _ in range(300):
        w = g.choice([0, 0, 0, 5, 30, 90, 400], g.integers(0, 40)).astype(float)
        want = line_blocks(w.tolist())
        got = html_text.blocks_of(w)
        assert got == want if want else len(got) <= 1 and (got or not w.any())


def test_html_text(spark):
    page = '<html><head><title>no</title><style>p{}</style></head><body><nav><a href="/">menu</a></nav><div class="cookies">no</div><article><header><h1>A &amp; B</h1></header><p>One <b>bo</b>ld&nbsp; x<br>two</p><aside>no</aside><form>no</form><p>Short.</p><script>"</p>no"</script></article><section id="comments"><p>no</p></section><footer>no</footer>'
    assert html_text.main_text(page) == "A & B\nOne bold x\ntwo\nShort."
    plain = "<div>Home</div><div><a href=x>Menu entry</a></div>" + "<p>" + "long text " * 20 + "</p><p>end</p>"
    assert html_text.main_text(plain).endswith("text\nend") and html_text.main_text("<p>x") == "x"
    assert html_text.main_text("<!-- open <p>x</p>") == "" == html_text.main_text(None) == html_text.main_text("")
    pages = "page_id long, url string, html string, text long, n_chars string"
    rows = [(1, "u", page, 3, "c"), (None, None, None, 3, "c"), (1, "u", page, 3, "c")]
    out = html_text.extract(spark.createDataFrame(rows, pages)).collect()
    assert sorted(r.n_chars for r in out) == [0, 27, 27] and len(out[0]) == 4
    assert html_text.extract(spark.createDataFrame([], pages)).count() == 0


BODY = "<p>" + "long body text " * 20 + "</p>"
WHOLE = " ".join(["long body text"] * 20)


def test_html_text_with_misleading_marks():
    assert WHOLE in html_text.main_text(f"<div>{BODY * 3}</div><article><a href=x>Teaser</a> more</article><article>Other teaser</article>")
    assert WHOLE in html_text.main_text(f"<main><h1>Hero</h1></main><div>{BODY * 2}</div>")
    assert html_text.main_text(f'<article>{BODY}</article><div class="sidebar">short</div><p>outside</p>') == WHOLE


@pytest.mark.parametrize("mark", ['class="content has-sidebar"', 'class="ad-free"', 'class="search-results"', 'id="post" data-class="menu"'])
def test_html_text_keeps_bodies_of_suspect_names(mark):
    assert html_text.main_text(f"<div {mark}>{BODY * 2}</div><div>end</div>").startswith(f"{WHOLE}\n{WHOLE}")
    assert html_text.main_text(f"<section {mark}><article>{BODY}</article></section>") == WHOLE


def test_html_text_blocks_without_an_article():
    notice = "<div><p>" + "All rights reserved. " * 5 + "</p></div>"
    page = f"<div><ul><li>Home</li><li>News</li></ul></div><div><h1>Title</h1><p>Short.</p>{BODY * 3}<p>The end.</p></div>" + "<div></div>" + "<div>" + notice * 2 + "<p>Tel. 1</p></div>"
    assert html_text.main_text(page) == "\n".join(["Title", "Short.", WHOLE, WHOLE, WHOLE, "The end."])
    two = f"<div>{BODY * 2}</div><div></div><ul><li><a href=x>{'linked ' * 30}</a></li></ul><div></div><div>{BODY}<p>more</p></div>"
    assert html_text.main_text(two) == "\n".join([WHOLE] * 3 + ["more"])


def test_html_text_differs_from_all_article_lines():
    """Density decides inside an article too: a run of links at its end is no text of it."""
    links = "".join(f"<p><a href=/{i}>Read this other story {i}</a></p>" for i in range(5))
    assert html_text.main_text(f"<article><h1>T</h1>{BODY}<p>Short.</p>{links}</article>").split("\n")[:3] == ["T", WHOLE, "Short."]
    assert "story 4" not in html_text.main_text(f"<article><h1>T</h1>{BODY}<p>Short.</p>{links}</article>")
    assert html_text.main_text(f"<article>{BODY}</article><div><p>{'An offer that nobody asked for. ' * 4}</p></div>") == WHOLE


def test_html_text_parses_odd_tags():
    assert html_text.main_text("<p it's>one two</p><p it's>three</p>") == "one two\nthree"
    assert html_text.main_text("<p title='a>b' x=\"c>d\">one</p><p title=>two</p>") == "one\ntwo"
    assert html_text.main_text("<div>" * 3000 + BODY) == WHOLE
    assert html_text.main_text(f"<article>{BODY * 4000}</article>").count("\n") == 3999


def test_html_text_equals_articles(spark):
    for r in spark.read.parquet(f"{SMALL}/pages.parquet").collect():
        body = re.search(r"<article>(.*?)(</article>|$)", r.html, re.S)[1]
        blocks = [" ".join(html.unescape(re.sub(r"<[^>]*>", "", x)).split()) for x in re.split(r"</?(?:p|h1|br)[^>]*>", body)]
        assert html_text.main_text(r.html) == "\n".join(b for b in blocks if b)


def test_best_fit_and_bounds():
    g = np.random.default_rng(2)
    for top in (10, 60, 2048):
        lengths = g.integers(1, top + 1, 400)
        bins, places, room = packing.best_fit_decreasing(lengths, 2048 if top > 60 else 100)
        cap = 2048 if top > 60 else 100
        for b in range(len(room)):
            mine = np.flatnonzero(bins == b)
            spans = sorted((places[i], places[i] + lengths[i]) for i in mine)
            assert spans[0][0] == 0 and all(x[1] == y[0] for x, y in zip(spans, spans[1:])) and spans[-1][1] == cap - room[b]
        assert packing.lower_bound(lengths, cap) <= len(room)
    assert packing.lower_bound(np.array([60] * 5), 100) == 5 and packing.lower_bound(np.array([34] * 6), 100) == 3


def test_packing(spark):
    g = random.Random(4)
    rows = [(i, " ".join(g.choice(["alpha", "beta", "gamma's", "12"]) for _ in range(g.randint(0, 90)))) for i in range(300)] + [(7, "alpha " * 500), (None, None)]
    out = packing.pack(docs(spark, rows), public_tokenizers.path("word_bpe_49k.json"), capacity=100, rows=40).toPandas()
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = collections.Counter()
    for i, t in rows:
        ids = library.encode(t or "", add_special_tokens=False).ids + [0]
        for p, s in enumerate(range(0, len(ids), 100)):
            want[(i, p, s, len(ids[s : s + 100]), zlib.crc32(np.array(ids[s : s + 100], "<u4").tobytes()))] += 1
    got = collections.Counter((None if pd.isna(r.doc_id) else int(r.doc_id), r.piece, r.start, r.length, r.ids_crc32) for r in out.itertuples())
    assert got == want
    for _, seq in out.groupby("sequence_id"):
        seq = seq.sort_values("offset")
        assert seq.offset.tolist() == [0, *seq.length.cumsum().tolist()[:-1]] and seq.length.sum() <= 100
    assert out.sequence_id.nunique() <= packing.lower_bound(out.length.to_numpy(), 100) + 3
    assert packing.pack(docs(spark, []), public_tokenizers.path("word_bpe_49k.json")).count() == 0


def test_line_dedup(spark):
    shared = "p\nq\nr\ns"
    rows = [(3, f"a\n{shared}\nb"), (1, f"x\n{shared}"), (2, "only\ntwo"), (4, None), (5, ""), (6, "\n\n\n\n"), (7, "\n\n\n\n"), (8, "m\nm\nm\nm\nm"), (None, f"{shared}\nz")]
    d = docs(spark, rows).withColumn("n_lines", F.lit("clash"))
    got = {r.doc_id: r for r in dedup_lines(d).collect()}
    assert got[1].text == f"x\n{shared}" and got[3].text == "a\nb" and got[3].n_removed == 4 and got[None].text == "z"
    assert got[2].text == "only\ntwo" and got[4].text is None and got[5].text == "" and got[6].text == "\n\n\n\n" == got[7].text
    assert got[8].text == "m" and got[8].n_removed == 4
    assert dedup_lines(d.limit(0)).count() == 0


def test_line_dedup_of_long_texts(spark):
    long = "\n".join(f"line {i}" for i in range(200_000))
    out = {r.doc_id: r for r in dedup_lines(docs(spark, [(1, long), (2, f"own\n{long}\nend")])).collect()}
    assert out[1].text == long and out[2].text == "own\nend" and out[2].n_removed == 200_000


def test_cotraining_on_small_tables(spark):
    d, labels = spark.read.parquet(f"{SMALL}/../sf0.01/documents.parquet"), spark.read.parquet(f"{SMALL}/../sf0.01/labels.parquet")
    out = cotraining.score(d, labels).toPandas().merge(labels.toPandas(), on="doc_id")
    assert out[out.quality == 1].kept.mean() > 0.98 and out[out.quality == 0].kept.mean() < 0.4
    some = docs(spark, [(1, None), (None, "x"), (1, "x"), (1, "x")]).withColumns({c: F.lit(1) for c in ("y", "quality", "score", "kept")})
    none = cotraining.score(some, labels.limit(0)).collect()
    assert [(r.score, r.kept) for r in none] == [(None, True)] * 4
    nulls = labels.select("doc_id", F.lit(None).cast("int").alias("quality"))
    assert cotraining.score(d, nulls).filter("not kept").count() == 0
    assert cotraining.score(d.limit(0), labels).count() == 0


def test_cotraining_rounds_equal_brute_force(spark):
    """The sums of a pass, the bins that are chosen and the new weights, document by document."""
    g = random.Random(9)
    rows = []
    for i in range(260):
        good = g.random() < 0.7
        text = " ".join(g.choice(["alpha", "beta", "gamma"] if good else ["###", "$$$", "alpha"]) for _ in range(g.randint(3, 12)))
        rows.append((i, text if i % 50 else None, g.choice(["en", "de", None]), g.choice(["a", "b"]) if good else "c", len(text)))
    y = {r[0]: int(r[3] != "c") for r in rows}
    told, held = {i: y[i] for i in range(0, 90)}, set(range(90, 110))
    table = spark.createDataFrame([*rows, (None, "alpha", None, None, None)], DOCS)
    base = cotraining.tally(table, told, held, None, None)
    weights = [cotraining.ratios(x[:2], base.docs) for x in (base.text, base.meta)]
    now = cotraining.tally(table, told, held, *weights)

    def features(row):
        raw = (row[1] or "").encode()
        text = np.zeros(cotraining.BUCKETS)
        for j in range(len(raw) - 3):
            key = np.array([int.from_bytes(raw[j : j + 4], "big")], np.uint64)
            text[int((ragged.mix(key) >> np.uint64(32))[0] % cotraining.BUCKETS)] += cotraining.GRAIN // max(1, len(raw) - 3)
        side = np.zeros(cotraining.SIDE)
        name = lambda x, size: 0 if x is None else 1 + zlib.crc32(x.encode()) % (size - 1)
        for b in (name(row[3], 1024), 1024 + name(row[2], 512), 1536 + (0 if row[4] is None else 1 + int(4 * np.log2(row[4] + 1)))):
            side[b] += cotraining.GRAIN
        return text, side, max(1, len(raw) - 3)

    made = [(r, *features(r)) for r in [*rows, (None, "alpha", None, None, None)]]
    for view in (0, 1):
        want = np.array([sum((m[1 + view] for m in made if told.get(m[0][0]) == c), np.zeros(len(weights[view]))) for c in (0, 1)])
        assert (want == (base.text, base.meta)[view][:2]).all()
    bins = [[], []]
    for r, text, side, many in made:
        z = (text / (cotraining.GRAIN // many) @ weights[0] / many, side / cotraining.GRAIN @ weights[1])
        tops = (np.abs(weights[0]).max(), 3 * np.abs(weights[1]).max())
        for v in (0, 1):
            bins[v].append(int(cotraining.bin_of(np.array([z[v]]), tops[v])[0]))
    pool = [i for i, m in enumerate(made) if m[0][0] not in told and m[0][0] not in held]
    for v in (0, 1):
        assert collections.Counter(bins[v][i] for i in pool) == {b: n for b, n in enumerate(now.pool[v].tolist()) if n}
    got = cotraining.exchange(base, now, 60)
    for v in (0, 1):
        zero, one = cotraining.chosen(now.known[1 - v], now.pool[1 - v], 60)
        sums, count = [], []
        for c, chosen in ((0, zero), (1, one)):
            mine = [i for i in pool if bins[1 - v][i] in chosen] + [i for i, m in enumerate(made) if told.get(m[0][0]) == c]
            sums.append(sum((made[i][1 + v] for i in mine), np.zeros(len(weights[v]))))
            count.append(len(mine))
        assert sum(count) > 90 and np.allclose(got[v], cotraining.ratios(np.array(sums), np.array(count)))


def test_slices_cover_all_rows():
    batch = pa.RecordBatch.from_arrays([pa.array(["a" * n if n % 3 else None for n in range(200)])], ["text"])
    assert sum((p.column("text").to_pylist() for p in ragged.slices(batch, "text", 500)), []) == batch.column("text").to_pylist()
