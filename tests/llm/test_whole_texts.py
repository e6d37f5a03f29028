"""Fill-in-the-middle, exact clustering and removal of repeated strings against brute force, and on edge cases."""

import collections
import hashlib
import math
import random
import re
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewell.llm import clustering, fill_middle, queries, suffix_dedup

from ..conftest import SMALL

TEXTS = "doc_id long, text string"


# --- fill in the middle


def turned(doc_id, text, rate=100):
    text = text or ""
    lines = re.findall("[^\n]*\n|[^\n]+", text)
    n, digest = len(lines), hashlib.sha256(f"7:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[8 * i : 8 * i + 8], 16) for i in range(4)]
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = "".join(lines[:a]), "".join(lines[a:b]), "".join(lines[b:])
    if not text or re.search("<[PSM]>", text) or h[2] % 100 >= rate:
        return n, "plain", None, None, text
    return (n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}") if h[3] % 100 < 50 else (n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}")


def odd_texts():
    r = random.Random(11)
    pieces = ["a", "é", "\n", "<P>", "<", ">", "bc\n", "\n\n", "€𝄞", " ", "\r\n"] + ["x"] * 12
    rows = [(i, "".join(r.choice(pieces[3 * (i % 2) :] if i % 3 else "ab\n<P>") for _ in range(r.randint(0, 60)))) for i in range(200)]
    return rows + [(None, None), (None, ""), (7, "a\nb"), (7, "a\nb"), (None, "\n" * 50), (-1, "q" * 70), (8, "<P"), (9, "a<<M>>")]


@pytest.mark.parametrize("chunk", [3, 16, fill_middle.CHUNK])
def test_fill_middle_equals_brute_force(spark, monkeypatch, chunk):
    monkeypatch.setattr(fill_middle, "FAN", 3)
    rows = odd_texts()
    out = fill_middle.fill_middle(spark.createDataFrame(rows, TEXTS), rate=90, chunk=chunk)
    found = out.withColumn("again", fill_middle.restored(F.col("output"), F.col("form"))).collect()
    got = [(r.doc_id, r.text, r.n, r.form, r.prefix_chars, r.middle_chars, r.output) for r in found]
    assert sorted(got, key=str) == sorted(((i, t, *turned(i, t, 90)) for i, t in rows), key=str)
    assert all(r.again == (r.text or "") for r in found)


def test_chunk_functions_compose():
    """A chunk's function is that of its parts one after the other, for every state."""
    r = random.Random(3)
    for _ in range(200):
        data = np.frombuffer("".join(r.choice("a\n<PM>é") for _ in range(r.randint(0, 40))).encode(), np.uint8)
        cut = r.randint(0, len(data))
        whole, left, right = (fill_middle.Chunk(x).function() for x in (data, data[:cut], data[cut:]))
        for s in range(fill_middle.STATES):
            assert whole[0][s] == right[0][left[0][s]] and whole[1][s] == left[1][s] + right[1][left[0][s]]
            for rank in range(1, whole[1][s] + 1):
                at = fill_middle.Chunk(data).select(rank, s)
                assert fill_middle.Chunk(data[: at + 1]).function()[1][s] == rank and fill_middle.Chunk(data[:at]).function()[1][s] == rank - 1


def test_fill_middle_edges(spark):
    empty = spark.createDataFrame([], TEXTS)
    assert fill_middle.fill_middle(empty).collect() == []
    clash = spark.createDataFrame([(1, "a\nb\n", "x", 5)], "doc_id long, text string, form string, scan long")
    row = fill_middle.fill_middle(clash, chunk=2).first()
    assert row.scan == 5 and (row.n, row.form, row.prefix_chars, row.middle_chars, row.output) == turned(1, "a\nb\n")
    long = "".join(f"line {i} é\n" for i in range(60_000)) + "end"
    done = fill_middle.fill_middle(spark.createDataFrame([(2, long)], TEXTS)).first()
    assert (done.n, done.form, done.prefix_chars, done.middle_chars, done.output) == turned(2, long)


# --- exact clustering


def clustered(rows, k, rounds, dim, scale=1024, salt=3):
    kept = [(i, [math.floor(scale * Fraction(v)) for v in x]) for i, x in rows if x is not None and len(x) == dim and all(v is not None and math.isfinite(v) for v in x)]
    if not kept:
        return []
    digest = lambda i: (i is None, "" if i is None else hashlib.sha256(f"{salt}:{i}".encode()).hexdigest())
    centroids = [x for _, x in sorted(kept, key=lambda r: (digest(r[0]), r[1]))[:k]]
    near = lambda x: min((sum((a - b) ** 2 for a, b in zip(x, c)), j) for j, c in enumerate(centroids))
    for _ in range(rounds):
        groups = collections.defaultdict(list)
        for _, x in kept:
            groups[near(x)[1]].append(x)
        centroids = [[sum(v) // len(groups[j]) for v in zip(*groups[j])] if groups[j] else c for j, c in enumerate(centroids)]
    found = [(i, *near(x)) for i, x in kept]
    total = collections.Counter()
    for _, d, j in found:
        total[j] += d
    fits = lambda v: v if v < 2**63 else None
    return [(i, j, fits(d), fits(total[j]), fits(sum(total.values())), hashlib.sha256(",".join(map(str, centroids[j])).encode()).hexdigest()) for i, d, j in found]


@pytest.mark.parametrize("size", [1.0, 3e4, 3e9, 1e30])
def test_clusters_equal_whole_numbers(spark, size):
    """Small components take the matrix product, large ones Python's integers; 3e9 and 1e30 overflow a long."""
    r = random.Random(int(size))
    rows = [(i, [size * r.gauss(c, 0.2) for c in (i % 3, -1, 0)]) for i in range(120)] + [(i, [0.0, -0.5, 1e-9]) for i in range(200, 204)]
    rows += [(None, [1.0, 2.0, 3.0]), (None, [1.0, 2.0, 3.0]), (5, [0.0, 0.0, 0.0]), (300, None), (301, [1.0, 2.0]), (302, [1.0, None, 2.0]), (303, [float("nan")] * 3), (304, [float("inf"), 0.0, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    got = clustering.cluster(df, k=5, rounds=4, dim=3).collect()
    assert sorted(map(tuple, got), key=str) == sorted(clustered(rows, 5, 4, 3), key=str)


def test_product_is_exact_up_to_its_bound():
    """Around the bound the matrix product and Python's integers agree; beyond it the product alone would be wrong."""
    r = np.random.default_rng(1)
    for scale in (2.0**20, 2.0**24, 2.0**28):
        y = np.floor(r.uniform(-scale, scale, (50, 16)))
        c = [[int(v) for v in row] for row in np.floor(r.uniform(-scale, scale, (4, 16)))]
        at, distance = clustering.nearest(y, c)
        want = [min((sum((int(a) - b) ** 2 for a, b in zip(x, m)), j) for j, m in enumerate(c)) for x in y.tolist()]
        assert [(int(d), int(a)) for a, d in zip(at, distance)] == want


def test_clusters_edges(spark):
    schema = "vec_id long, embedding array<float>, cluster string"
    assert clustering.cluster(spark.createDataFrame([], schema)).collect() == []
    assert clustering.cluster(spark.createDataFrame([(1, [1.0], "x")], schema)).collect() == []
    few = [(1, [0.5, 1.5], "x"), (2, [0.5, 1.5], "x")]
    assert sorted(map(tuple, clustering.cluster(spark.createDataFrame(few, schema), dim=2).collect())) == sorted(clustered([r[:2] for r in few], 8, 10, 2))


# --- repeated strings


def left_over(rows, depth):
    texts = [(t or "").encode() for _, t in rows]
    seen = collections.Counter(b[i : i + depth] for b in texts for i in range(len(b) - depth + 1))
    out = []
    for (name, _), b in zip(rows, texts):
        gone = bytearray(len(b))
        for i in range(len(b) - depth + 1):
            if seen[b[i : i + depth]] > 1:
                gone[i : i + depth] = b"\1" * depth
        spans = sum(1 for i in range(len(b)) if gone[i] and not (i and gone[i - 1]))
        out.append((name, len(b), sum(gone), spans, hashlib.sha256(bytes(x for x, g in zip(b, gone) if not g)).hexdigest()))
    return out


@pytest.mark.parametrize("letters, depth", [("ab", 8), ("abcdé", 6), ("ab c\n", 12), ("a", 5), ("abcdefgh", 3), ("abcdefghijklmno", 40)])
def test_repeated_strings_equal_brute_force(spark, letters, depth):
    r = random.Random(depth)
    parts = ["".join(r.choice(letters) for _ in range(r.randint(1, 3 * depth))) for _ in range(12)]
    rows = [(i, "".join(r.choice(parts) + r.choice(letters) * r.randint(0, 3) for _ in range(r.randint(0, 15)))) for i in range(50)]
    rows += [(None, None), (None, ""), (3, "a" * 23), (3, "a" * 23), (None, "x" * depth), (None, "x" * depth), (4, "y" * depth), (5, "z" * (2 * depth)), (6, "short")]
    got = suffix_dedup.digests(spark.createDataFrame(rows, TEXTS), depth)
    assert sorted(map(tuple, got.collect()), key=str) == sorted(left_over(rows, depth), key=str)


def test_repeated_strings_across_parts(spark, monkeypatch):
    """Texts far longer than a part of the scan, and one passage that most texts share between other words."""
    monkeypatch.setattr(suffix_dedup, "PART", 1 << 10)
    r = random.Random(5)
    word = lambda: "".join(r.choice("abcdefghij") for _ in range(5))
    shared = " ".join(word() for _ in range(20))
    rows = [(i, " ".join([*(word() for _ in range(r.randint(5, 40))), shared, *(word() for _ in range(r.randint(5, 40)))])) for i in range(60)]
    whole = " ".join(word() for _ in range(2_000))
    rows += [(100, whole), (101, whole[:6_000] + "#" + whole[6_000:]), (102, whole[1_000:1_099])]
    got = list(map(tuple, suffix_dedup.digests(spark.createDataFrame(rows, TEXTS), 100).collect()))
    assert sorted(got) == sorted(left_over(rows, 100))
    assert all(121 <= n <= 131 for i, _, n, *_ in got if i < 60)
    runs = list(suffix_dedup.runs(np.frombuffer(whole.encode(), np.uint8), np.array([0, len(whole)]), 100, 50))
    low, high = (np.concatenate([x[i] for x in runs]) for i in (0, 1))
    assert low[0] == 0 and (low[1:] == high[:-1] + 1).all() and high[-1] == len(whole) - 100


def test_repeated_strings_edges(spark):
    assert suffix_dedup.dedup_substrings(spark.createDataFrame([], TEXTS)).collect() == []
    clash = spark.createDataFrame([(1, "ab" * 20, 7, "s")], "doc_id long, text string, kept long, row string")
    row = suffix_dedup.dedup_substrings(clash, 10).first()
    assert row.row == "s" and bytes(row.kept) == b"" and [tuple(s) for s in row.spans] == [(0, 40)]
    once = suffix_dedup.dedup_substrings(spark.createDataFrame([(1, "é" + "x" * 30 + "é")], TEXTS), 29).first()
    assert bytes(once.kept) == "éé".encode() and [tuple(s) for s in once.spans] == [(2, 32)]


@pytest.mark.parametrize("name", ["op11_fill_middle", "op12_clustering", "op13_suffix_dedup"])
def test_equals_sql(spark, name):
    import os

    import duckdb

    con = duckdb.connect()
    for f in os.listdir(SMALL):
        con.execute(f"create view {f[:-8]} as select * from '{SMALL}/{f}'")
    df = queries.QUERIES[name](spark, SMALL)
    cursor = con.execute(queries.ORACLE[name])
    names = [d[0] for d in cursor.description]
    assert sorted(tuple(r) for r in df.select(*names).collect()) == sorted(cursor.fetchall())
