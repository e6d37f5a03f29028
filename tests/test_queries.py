"""Every registered query against its oracle on the smallest tables; the others for a stable schema."""

import math
import os

import duckdb
import pytest

from tidewell.plans import catalog

from .conftest import SMALL


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for f in os.listdir(SMALL):
        c.execute(f"create view {f[:-8]} as select * from '{SMALL}/{f}'")
    return c


def value(v):
    """A cell as something to compare: numbers as floats, the rest as text."""
    return float(v) if type(v).__name__ in ("float", "Decimal") else v if isinstance(v, int) and not isinstance(v, bool) else repr(v)


def rows(found, names):
    """Rows with their columns by name, in an order that a last digit does not change."""
    at = sorted(range(len(names)), key=lambda i: names[i])
    coarse = lambda v: f"{v + 0.0:.3f}" if isinstance(v, float) and math.isfinite(v) else str(v)
    out = [tuple(value(r[i]) for i in at) for r in found]
    return sorted(out, key=lambda r: ([str(v) for v in r if not isinstance(v, float)], [coarse(v) for v in r if isinstance(v, float)], [v for v in r if isinstance(v, float) and v == v]))


def near(a, b):
    """Equal, or numbers that differ in what rounding to six digits may leave."""
    if isinstance(a, float) and isinstance(b, float):
        return a == b or (math.isnan(a) and math.isnan(b)) or math.isclose(a, b, rel_tol=1e-6, abs_tol=2e-6)
    return a == b


def differing(got, want):
    return [(a, b) for a, b in zip(got, want) if len(a) != len(b) or not all(map(near, a, b))]


@pytest.mark.parametrize("name", sorted(catalog.ORACLE))
def test_equals_oracle(spark, duck, name):
    df = catalog.QUERIES[name](spark, SMALL)
    cursor = duck.execute(catalog.ORACLE[name])
    names = [d[0] for d in cursor.description]
    assert sorted(names) == sorted(df.columns)
    got, want = rows(df.collect(), df.columns), rows(cursor.fetchall(), names)
    assert len(got) == len(want) and differing(got, want)[:3] == []


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLE)))
def test_runs(spark, name):
    a, b = (catalog.QUERIES[name](spark, SMALL) for _ in range(2))
    assert a.schema == b.schema and differing(rows(a.collect(), a.columns), rows(b.collect(), b.columns)) == []
