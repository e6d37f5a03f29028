"""Hand-built edge cases: empty input, short tracks, silence, ties, exact bounds, trailing windows."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewell.functions import scalars as X
from tidewell.operators import graphs as G, joins as J, levels as L, rules as R, sequences as S, spectral as P
from tidewell.sources import storage
from tidewell.streaming import twins


def track(spark, xs, name=1):
    return spark.createDataFrame([(name, i, float(x)) for i, x in enumerate(xs)], "track long, idx long, x double")


def test_empty_and_short(spark):
    none = track(spark, [])
    for f in (L.level_stats, lambda s: L.gated_level(s, 2), lambda s: L.noise_floor(s, 2), lambda s: S.sliding_median(s, 3), lambda s: S.long_runs(s, F.expr("x < 1"), 2), lambda s: L.crossings(s, 8, 4)):
        assert f(none).count() == 0
    assert L.noise_floor(track(spark, range(8)), 2).first()["floor_db"] is None
    assert L.last_level(track(spark, [1, 1]), 3).first()["level_db"] == float("-inf")
    assert L.otsu(L.histogram(none, 0.0, 1.0, 5)).first()["split_bin"] is None


def test_silence_and_ties(spark):
    a = L.level_stats(track(spark, [0] * 10)).first()
    assert a.rms_db == -144 and a.crest_db == 0
    assert L.gated_level(track(spark, [0] * 40), 2).count() == 0
    assert S.longest_run(track(spark, [0, 0, 5, 0, 0]), F.expr("x < 1")).first().start == 0
    assert S.best_window(track(spark, [1, 0, 1, 0]), 2).first().start == 2
    assert S.quiet_ends(track(spark, [0, 0]), F.expr("x > 1")).first()[1:] == (2, 0)


def test_runs_reach_the_end(spark):
    got = S.runs(track(spark, [9, 0, 0, 9, 0]), F.expr("x < 1")).orderBy("start").select("start", "end", "length").collect()
    assert [tuple(r) for r in got] == [(1, 2, 2), (4, 4, 1)]
    assert L.blocks(track(spark, range(7)), 3).count() == 2 and L.blocks(track(spark, range(7)), 3, full=False).count() == 3


def test_spaced_peaks_are_greedy(spark):
    p = spark.createDataFrame([(1, i) for i in (0, 4, 6, 9, 12)], "track long, idx long")
    assert sorted(r.idx for r in S.spaced(p, 6).collect()) == [0, 6, 12]


def test_intervals(spark):
    spans = spark.createDataFrame([(1, 0.0, 10.0), (2, 5.0, 6.0), (3, 10.0, 10.0), (4, 10.0, 31.0)], "span long, lo double, hi double")
    points = spark.createDataFrame([(1, 0.0), (2, 5.5), (3, 10.0), (4, 31.0), (5, -1.0)], "id long, t double")
    assert {r.id: r.span for r in J.point_in_interval(points, spans, 3.0).collect()} == {1: 1, 2: 1, 3: 4, 4: None, 5: None}
    assert sorted(tuple(r) for r in J.overlaps(spans, 3.0).collect()) == [(1, 2), (1, 3), (1, 4), (3, 4)]


def test_rules_keep_order_and_severity(spark):
    d = spark.createDataFrame([(1, 3.0, None), (2, 0.5, 0.0)], "track long, a double, b double")
    issues = R.evaluate(d, ["track"], [R.deviation("x", F.col("a"), F.col("b"), 0.5), R.above("y", F.col("a"), F.lit(1.0), "High")])
    assert [(r.track, r.rule) for r in issues.collect()] == [(1, "y")]
    assert R.at_least(issues, "High").count() == 1


def test_cycles_are_found(spark):
    storage.checkpoints(spark)
    nodes = spark.createDataFrame([(i,) for i in "abcde"], "node string")
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "b"), ("a", "d")], "src string, dst string")
    assert {r.node: r.depth for r in G.peel(nodes, edges).collect()} == {"a": 0, "b": None, "c": None, "d": 1, "e": 0}
    assert {r.node: r.comp for r in G.connected(edges).collect()} == {x: "a" for x in "abcd"}


def test_deep_graphs(spark):
    storage.checkpoints(spark)
    chain = spark.createDataFrame([(i, i + 1) for i in range(60)], "src int, dst int")
    nodes = spark.createDataFrame([(i,) for i in range(61)], "node int")
    assert {r.node: r.depth for r in G.peel(nodes, chain).collect()} == {i: i for i in range(61)}
    assert {r.comp for r in G.connected(chain).collect()} == {0}
    commits = spark.createDataFrame([(i, i - 1 if i else None) for i in range(300)], "node int, parent int")
    got = G.history(commits, spark.createDataFrame([(299,), (3,)], "node int")).collect()
    assert sorted((r.head, r.node, r.distance) for r in got) == sorted([(299, 299 - k, k) for k in range(300)] + [(3, 3 - k, k) for k in range(4)])


def test_fallback_that_does_not_exist(spark):
    d, presets = spark.createDataFrame([("a",), ("x",)], "name string"), spark.createDataFrame([("a", ["b"], 1.0)], "id string, aliases array<string>, target double")
    assert {(r.name, r.target) for r in R.lookup(d, "name", presets, "none").collect()} == {("a", 1.0), ("x", None)}


def test_similar_pairs_equal_brute_force(spark):
    storage.checkpoints(spark)
    g = np.random.default_rng(4)
    base = g.normal(size=(12, 9))
    v = np.concatenate([base[i % 12] + g.normal(size=9) * 0.4 for i in range(120)]).reshape(120, 9)
    v[7] = 1.0
    d = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "id long, v array<double>")
    with np.errstate(invalid="ignore"):
        c = np.corrcoef(v)
    want = {(a, b) for a in range(120) for b in range(a + 1, 120) if c[a, b] > 0.9}
    pairs = J.similar_pairs(d)
    assert {(r.a, r.b) for r in pairs.collect()} == want and len(want) > 50
    rejected: set[int] = set()
    for b in range(120):
        if any(a not in rejected for a in range(b) if (a, b) in want):
            rejected.add(b)
    assert {r.id for r in J.greedy_accept(pairs, d.select("id")).filter("rejected").collect()} == rejected
    assert J.similar_pairs(d.limit(0)).count() == 0


def test_late_blocks_of_a_finished_track_are_dropped(spark, tmp_path):
    schema = "track long, seq long, x array<double>, last boolean"
    for n, rows in enumerate([[(1, 0, [0.5] * 8, False)], [(1, 1, [0.5] * 8, True)], [(1, 0, [0.9] * 8, False), (1, 2, [0.9] * 8, True)]]):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{tmp_path}/in/{n}")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(f"{tmp_path}/in")
    out = twins.metered(stream, 2, 4, 0.3, 3).writeStream.outputMode("append").option("checkpointLocation", f"{tmp_path}/at").format("parquet").option("path", f"{tmp_path}/out")
    q = out.trigger(availableNow=True).start()
    q.awaitTermination()
    got = spark.read.schema(twins.RESULT).parquet(f"{tmp_path}/out").collect()
    assert [(r.n, r.peak, r.windows) for r in got] == [(16, 0.5, 5)]


def test_transforms():
    g = np.random.default_rng(0)
    x = g.normal(size=300)
    assert np.allclose(P.istft(P.stft(x, 32, 8), 32, 8, 300)[:290], x[:290])
    assert np.allclose(P.walsh_hadamard(P.walsh_hadamard(x[:64])), x[:64])
    t = np.sin(2 * np.pi * 50 * np.arange(2000) / 1000)
    assert np.abs(P.dehum(t, 1000.0, 50.0, 1)[1500:]).max() < 0.05
    assert np.abs(P.limited(3 * x, 0.5, 5, 0.1)).max() <= 0.5 + 1e-9
    assert P.true_peak(np.sin(2 * np.pi * (np.arange(400) / 4 + 1 / 8))) == pytest.approx(1, abs=0.02)
    low = np.sin(2 * np.pi * np.arange(500) / 50)
    assert np.allclose(P.resampled(low, 1, 2)[100:900:2], low[50:450], atol=1e-3)
    w, h = P.nmf(np.outer([1.0, 2, 3], [1.0, 0, 2, 1]), 1, 200, 0.0)
    assert np.allclose(w @ h, np.outer([1, 2, 3], [1, 0, 2, 1]), atol=1e-3)
    with pytest.raises(KeyError):
        P.chain(x, [("unknown", {})])


def test_streaming_meter_equals_batch(spark):
    xs = np.random.default_rng(1).normal(size=103)
    m = twins.Meter(2, 4, 0.9, 2)
    for a in range(0, 103, 7):
        m.feed(xs[a : a + 7].tolist())
    n, rms, peak, _, windows, level = m.finish()
    s = track(spark, xs)
    a, b = L.level_stats(s).first(), L.gated_level(s, 2).first()
    assert n == a.n and rms == pytest.approx(a.rms_db) and peak == pytest.approx(a.peak)
    assert windows == b.windows and level == pytest.approx(b.level_db)


def test_sources(spark, tmp_path):
    x = np.random.default_rng(2).normal(size=(50, 2)).astype("<f4") * 0.1
    (tmp_path / "a.wav").write_bytes(storage.encode_wave(x, 48000))
    got = storage.waves(spark, str(tmp_path), 20).orderBy("block").collect()
    assert [len(r.l) for r in got] == [20, 20, 10] and np.allclose(sum((r.l for r in got), []), x[:, 0])
    (tmp_path / "dump").write_bytes(x.tobytes())
    spark.dataSource.register(storage.RawFrames)
    raw = spark.read.format("rawframes").option("path", str(tmp_path / "dump")).option("frames", 9).option("first", 5).load()
    assert raw.count() == 45 and raw.agg(F.min("idx")).first()[0] == 5
    good = {"protocol_version": "900", "session_id": "s", "stems": [{"stem_type": "v", "events": [{"state": "a", "start_ms": 1, "end_ms": 2, "confidence": 0.5, "attributes": {"rms_db": -1.0, "transient_density": 2.0}}]}]}
    (tmp_path / "session_1.corpus.json").write_text(json.dumps(good))
    (tmp_path / "session_2.corpus.json").write_text('{"session_id": 3')
    assert [r.session_id for r in storage.sessions(spark, str(tmp_path)).collect()] == ["s"]
    (tmp_path / "in" / "odd").mkdir(parents=True)
    (tmp_path / "in" / "odd" / "f").write_bytes(b"x")
    with pytest.raises(Exception, match="unknown bucket"):
        storage.bucketed(spark, str(tmp_path / "in"), ["a"]).collect()
    storage.audit(spark.sql("select timestamp '2024-01-02 03:04:05' as timestamp, 'x' as event_type"), str(tmp_path / "log"))
    assert (tmp_path / "log" / "day=20240102").is_dir()


def test_scalars(spark):
    d = spark.createDataFrame([(float("nan"), 1.0), (float("inf"), 1.0), (0.0, 0.0)], "x double, y double")
    lean, sure = X.projected(F.col("x"), F.col("y"), 0.0, 0.0, 1.0, 0.0)
    assert [(r[0], r[1]) for r in d.select(lean, sure).collect()] == [(0.5, 0.0), (0.5, 0.0), (0.0, 1.0)]
    assert [r[0] for r in d.select(X.finite(F.col("x"))).collect()] == [0.0] * 3


def test_points_make_no_pairs_with_spans(spark):
    """Against all pairs, with ties, nests and copies; nothing but ids is joined."""
    r = np.random.default_rng(8)
    spans = [(i, float(lo), float(lo + n)) for i, (lo, n) in enumerate(zip(r.integers(0, 40, 300), r.integers(0, 25, 300)))]
    points = [(i, float(t)) for i, t in enumerate(r.uniform(-2, 70, 200).round(1))] + [(900, None)]
    df, p = spark.createDataFrame(spans, "span long, lo double, hi double"), spark.createDataFrame(points, "id long, t double")
    want = {i: min(((lo, s) for s, lo, hi in spans if t is not None and lo <= t < hi), default=(None, None))[1] for i, t in points}
    found = J.point_in_interval(p, df, 7.0)
    assert {x.id: x.span for x in found.collect()} == want and found.count() == len(points)
    joins = found._jdf.queryExecution().optimizedPlan().toString().count("Join")
    assert joins == 1  # the one that brings the result to the points


def test_overlaps_equal_all_pairs(spark, monkeypatch):
    """Ties at both ends, spans that end before they begin; one bin is the work of many tasks."""
    monkeypatch.setattr(J, "DEALT", 10)
    r = np.random.default_rng(9)
    spans = [(i, float(lo), float(lo + n)) for i, (lo, n) in enumerate(zip(r.integers(0, 40, 150), r.integers(-2, 12, 150)))]
    found = J.overlaps(spark.createDataFrame(spans, "span long, lo double, hi double"), 200.0)
    want = sorted((a, b) for a, la, ha in spans for b, lb, hb in spans if a < b and la <= hb and lb <= ha)
    assert sorted(tuple(x) for x in found.collect()) == want
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    try:
        assert found.select("a").groupBy(F.spark_partition_id()).count().count() > 4
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
        spark.conf.set("spark.sql.adaptive.enabled", "true")


def test_overlaps_broadcast_no_spans(spark, tmp_path, monkeypatch):
    """Spans that look small and cover many bins; equal ones, ones with the same number, ones without an end."""
    monkeypatch.setattr(J, "DEALT", 7)
    r = np.random.default_rng(4)
    spans = [(i % 90, float(lo), float(lo + n)) for i, (lo, n) in enumerate(zip(r.integers(0, 30, 100), r.integers(-2, 25, 100)))]
    spark.createDataFrame([*spans, *spans[:9], (200, 3.0, None), (None, 3.0, 9.0)], "span long, lo double, hi double").write.parquet(f"{tmp_path}/spans")
    found = J.overlaps(spark.read.parquet(f"{tmp_path}/spans"), 10.0)
    every = [*spans, *spans[:9]]
    assert sorted(tuple(x) for x in found.collect()) == sorted((a, b) for a, la, ha in every for b, lb, hb in every if a < b and la <= hb and lb <= ha)
    joins = [x for x in found._jdf.queryExecution().sparkPlan().toString().splitlines() if "Join" in x]
    assert "SortMergeJoin" in joins[0]  # the one that makes the pairs


def test_greedy_over_blocks_and_copies(spark, monkeypatch):
    """Copies are decided by their first; no pair of them is made; several blocks and tiles, vectors without a direction."""
    storage.checkpoints(spark)
    monkeypatch.setattr(J, "BLOCK", 30)
    monkeypatch.setattr(J, "TILE", 7)
    g = np.random.default_rng(6)
    base = g.normal(size=(9, 6))
    near = [base[i % 9] + g.normal(size=6) * 0.35 for i in range(70)]
    v = [*near, *near[10:50], *near[10:50], np.ones(6), np.ones(6), np.full(6, np.nan), np.full(6, np.nan)]
    d = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)] + [(500, None), (501, [])], "id long, v array<double>")
    with np.errstate(invalid="ignore"):
        c = np.corrcoef(np.array(v)) > 0.9
    rejected: set[int] = set()
    for b in range(len(v)):
        if any(c[a, b] and a not in rejected for a in range(b)):
            rejected.add(b)
    made, close = [], J._close
    monkeypatch.setattr(J, "_close", lambda u, least: made.append(u.count()) or close(u, least))
    got = J.greedy_distinct(d, 0.9).collect()
    assert {r.id for r in got if r.rejected} == rejected and len(got) == len(v) + 2
    assert made == [70]
