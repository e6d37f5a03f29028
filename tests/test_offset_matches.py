"""Aligned sequences against all pairs: copies with an offset, common hashes, gaps, several hashes at a position."""

import collections
import random

import pytest

from tidewell.operators import joins as J


def by_all_pairs(rows, others, offsets, least):
    a, b = collections.defaultdict(set), collections.defaultdict(set)
    for i, p, h in rows:
        a[i].add((p, h))
    for i, p, h in others:
        b[i].add((p, h))
    out = {}
    for i, x in a.items():
        n = len({p for p, _ in x})
        for j, y in b.items():
            best = max(len({p for p, h in x if (p - off, h) in y}) for off in range(-offsets, offsets + 1))
            if best and best / n >= least:
                out[i, j] = best / n
    return out


@pytest.mark.parametrize("kinds, least, gaps", [(40, 0.3, False), (5, 0.3, True), (3, 0.5, True), (40, 0.9, False), (12, 0.26, True)])
def test_offset_matches_equal_all_pairs(spark, kinds, least, gaps):
    r = random.Random(kinds)
    rows = []
    base = [r.randrange(kinds) for _ in range(30)]
    for i in range(25):
        n = r.choice([1, 2, 3, 5, 8, 17, 30])
        copied, shift = i % 3 == 0, r.randint(-4, 4)
        for p in range(n):
            if gaps and r.random() < 0.3:
                continue
            same = copied and 0 <= p + shift < len(base) and r.random() < 0.6
            rows.append((i, p, base[p + shift] if same else r.randrange(kinds)))
            if r.random() < 0.1:
                rows.append((i, p, r.randrange(kinds)))
    others = [(100 + i, p + 3, h) for i, p, h in rows if i % 2]
    schema = "id long, pos long, hash long"
    got = J.offset_matches(spark.createDataFrame(rows, schema), spark.createDataFrame(others, schema), 5, least).collect()
    want = by_all_pairs(rows, others, 5, least)
    assert {(x.id, x.other): pytest.approx(x.score) for x in got} == want and len(got) == len(want)


def test_offset_matches_of_nothing(spark):
    empty = spark.createDataFrame([], "id long, pos long, hash long")
    assert J.offset_matches(empty, empty, 5, 0.3).collect() == []


def test_offset_matches_compares_few_that_do_not_match(spark):
    r = random.Random(1)
    steps = [[int(r.expovariate(0.05)) for _ in range(66)] for _ in range(400)]
    rows = [(i, p, v[p] * 1000 + v[p + 1]) for i, v in enumerate(steps) for p in range(65)]
    rows += [(1000 + i, p, h) for i in range(50) for s, p, h in rows if s == 0]  # and 50 copies of the first
    prints = spark.createDataFrame(rows, "id long, pos long, hash long")
    firsts, every = J._sequences(prints)
    met = J._candidates(firsts, firsts, 5, 0.3).filter("id <> other").count()
    assert firsts.count() == 400 and every.count() == 450 and met < 400
    found = {(x.id, x.other) for x in J.offset_matches(prints, prints, 5, 0.3).collect()}
    same = [0, *range(1000, 1050)]
    assert found == {(i, i) for i in range(1, 400)} | {(i, j) for i in same for j in same}


@pytest.mark.parametrize("least", [0.3, 0.1])
def test_offset_matches_of_distant_positions(spark, least):
    r = random.Random(7)
    rows = []
    for i in range(12):
        places = sorted(r.sample([*range(12), *range(40, 60), 10**6, 2**45], r.choice([2, 9, 20, 30])))
        rows += [(i, p, r.choice([r.randrange(6), None, p % 7])) for p in places]
    df = spark.createDataFrame(rows, "id long, pos long, hash long")
    want = {}
    for i in range(12):
        n = sum(x[0] == i for x in rows)
        for j in range(12):
            y = {(p, h) for s, p, h in rows if s == j}
            best = max(sum((p - off, h) in y for s, p, h in rows if s == i and h is not None) for off in range(-3, 4))
            if best and best / n >= least:
                want[i, j] = best / n
    assert {(x.id, x.other): pytest.approx(x.score) for x in J.offset_matches(df, df, 3, least).collect()} == want and len(want) > 12


def test_offset_matches_judges_neighbouring_blocks_together(spark):
    """Chance leaves hardly a candidate; copies that agree in just enough positions stay, wherever these lie, those with one less go."""
    r = random.Random(5)
    steps = [[int(r.expovariate(0.05)) for _ in range(67)] for _ in range(400)]
    rows = [(i, p, v[p] * 1000 + v[p + 1]) for i, v in enumerate(steps) for p in range(66)]
    prints = spark.createDataFrame(rows, "id long, pos long, hash long")
    firsts, _ = J._sequences(prints)
    assert J._candidates(firsts, firsts, 5, 0.3).filter("id <> other").count() < 10
    some, others = [x for x in rows if x[0] < 40], []
    for i in range(40):
        agree, off = 20 - i % 2, r.randint(-5, 5)
        near = sorted(range(66), key=lambda p: (p - r.choice([0, 30, 65])) ** 2 if i % 3 else r.random())[:agree]
        others += [(100 + i, p - off, h if p in near else -1 - p) for s, p, h in some if s == i]
    want = by_all_pairs(some, others, 5, 0.3)
    got = J.offset_matches(spark.createDataFrame(some, prints.schema), spark.createDataFrame(others, prints.schema), 5, 0.3).collect()
    assert {(x.id, x.other): pytest.approx(x.score) for x in got} == want and set(want) == {(i, 100 + i) for i in range(0, 40, 2)}
