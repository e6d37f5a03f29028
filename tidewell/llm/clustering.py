"""Exact k-means on integer components by the expansion |x|^2 - 2 x.c + |c|^2.

Vectors are scaled to integers and stored once as blocks of ``ROWS`` vectors. In a round each block
multiplies its vectors with all centroids in one float64 matrix product. Every term and every partial
sum is an integer; where dim * (largest |x| + largest |c|)^2 is below 2^53 they are all exact in
float64, in whatever order BLAS adds them. A block that cannot promise that computes the same in
Python's integers. Sums and counts of the clusters are integers without a bound, added up by
``treeAggregate``; what reaches the driver is one sum per cluster and component, whatever the rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from . import ragged
from .scratch import Scratch

ROWS = 4096
EXACT = 2.0**53
LONG = 2**63
Sums = tuple[list[list[int]], list[int], list[int]]


def scaled(x: np.ndarray, scale: int) -> np.ndarray:
    """floor(scale * x), as float64 where all of it is exact, else as Python's integers."""
    if not x.size or np.abs(x).max() * scale < EXACT:
        return np.floor(x * float(scale))
    whole = lambda v: (lambda n, d: n * scale // d)(*v.as_integer_ratio())
    return np.array([whole(v) for v in x.ravel().tolist()], object).reshape(x.shape)


def nearest(y: np.ndarray, centroids: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    """(number, squared distance) of each vector's nearest centroid, the smaller number of equal ones."""
    most = max(abs(v) for c in centroids for v in c) if centroids[0] else 0
    if y.dtype != object and y.shape[1] * (np.abs(y).max(initial=0.0) + float(most)) ** 2 < EXACT:
        c = np.array(centroids, np.float64).reshape(len(centroids), -1)
    else:
        y, c = np.array([[int(v) for v in row] for row in y.tolist()], object).reshape(y.shape), np.array(centroids, object)
    distance = (y * y).sum(axis=1)[:, None] - 2 * y.dot(c.T) + (c * c).sum(axis=1)
    at = np.argmin(distance, axis=1)
    return at, distance[np.arange(len(y)), at]


def _added(a: Sums, b: Sums) -> Sums:
    return [[x + y for x, y in zip(p, q)] for p, q in zip(a[0], b[0])], [x + y for x, y in zip(a[1], b[1])], [x + y for x, y in zip(a[2], b[2])]


def _block(raw: bytes, dim: int, scale: int) -> np.ndarray:
    return scaled(np.frombuffer(raw, np.float64).reshape(-1, dim), scale)


def sums(blocks: DataFrame, centroids: list[list[int]], dim: int, scale: int) -> Sums:
    """Componentwise sums, counts and summed distances of each centroid's vectors."""
    k = len(centroids)
    shared = blocks.sparkSession.sparkContext.broadcast(centroids)

    def add(have: Sums, row: tuple) -> Sums:
        y = _block(row[0], dim, scale)
        at, distance = nearest(y, shared.value)
        exact = y.dtype != object and np.abs(y).max(initial=0.0) * len(y) < EXACT
        total, count, inertia = [], [], []
        for i in range(k):
            mine = np.flatnonzero(at == i)
            part = y[mine] if exact else np.array(y[mine].tolist(), object).reshape(len(mine), dim)
            total.append([int(v) for v in part.sum(axis=0)] if exact else [sum(int(v) for v in column) for column in part.T])
            count.append(len(mine))
            inertia.append(sum(int(v) for v in distance[mine].tolist()))
        return _added(have, (total, count, inertia))

    zero: Sums = ([[0] * dim for _ in range(k)], [0] * k, [0] * k)
    try:
        return blocks.select("block").rdd.treeAggregate(zero, add, _added)
    finally:
        shared.destroy()


def moved(centroids: list[list[int]], found: Sums) -> list[list[int]]:
    """floor(sum / count) of each component; a centroid without vectors stays."""
    return [[v // n for v in total] if n else old for old, total, n in zip(centroids, found[0], found[1])]


def _vectors(rows: DataFrame, dim: int) -> DataFrame:
    """(vec_id, x) of the vectors with ``dim`` components, none null or non-finite."""
    x = F.col("embedding").cast("array<double>")
    finite = F.forall("x", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf"))))
    return rows.select(F.col("vec_id"), x.alias("x")).filter((F.size("x") == dim) & finite)


def _blocks(vectors: DataFrame, id_type: str) -> DataFrame:
    """(ids, block): vectors of ``ROWS`` rows at most, as bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, ROWS):
                part = batch.slice(a, ROWS)
                x = np.asarray(part.column("x").flatten(), np.float64)
                ids = part.column("vec_id")
                ids = pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids)
                yield pa.RecordBatch.from_arrays([ids, pa.array([x.tobytes()], pa.binary())], ["ids", "block"])

    return vectors.mapInArrow(ragged.tidy(run), f"ids array<{id_type}>, block binary")


def _long(v: int) -> Column:
    return F.lit(v if -LONG <= v < LONG else None).cast("long")


def cluster(rows: DataFrame, k: int = 8, rounds: int = 10, dim: int = 64, scale: int = 1024, salt: int = 3) -> DataFrame:
    """``(vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256)`` of every vector of ``rows(vec_id, embedding)``.

    Components are floor(scale * x). The first centroids are the ``k`` vectors with the smallest sha256
    of ``salt:vec_id``; each round assigns all vectors and moves every centroid to the floor of its mean.

    * Vectors that are null, have another number of components, or hold a null, NaN or infinite one are left out.
    * A null vec_id comes last among the first centroids; rows with equal ids come in the order of their components.
      Repeated rows count each; two of them may be two centroids, of which the second stays empty.
    * Fewer than ``k`` vectors: as many centroids as vectors. No vectors, or an empty table: an empty result.
    * A squared distance or a sum of them that a long cannot hold is null; it is computed exactly all the same.
    * Other columns are not read.
    """
    spark = rows.sparkSession
    scratch = Scratch(spark, "clustering")
    vectors = _vectors(rows, dim)
    id_type = vectors.schema["vec_id"].dataType.simpleString()
    named = F.sha2(F.concat(F.lit(f"{salt}:"), F.col("vec_id").cast("string")), 256)
    first = vectors.orderBy(named.asc_nulls_last(), "x").limit(k).select("x").collect()
    result = f"vec_id {id_type}, cluster int, distance long"
    if not first:
        return spark.createDataFrame([], f"{result}, cluster_inertia long, inertia long, centroid_sha256 string")
    centroids = [[int(v) for v in scaled(np.array(r["x"], np.float64), scale).tolist()] for r in first]
    blocks = scratch.save(_blocks(vectors, id_type))
    for _ in range(rounds):
        new = moved(centroids, sums(blocks, centroids, dim, scale))
        if new == centroids:
            break
        centroids = new
    _, _, inertia = sums(blocks, centroids, dim, scale)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, raw in zip(batch.column("ids"), batch.column("block")):
                at, distance = nearest(_block(raw.as_buffer(), dim, scale), centroids)
                fits = pa.array([int(v) if v < LONG else None for v in distance.tolist()], pa.int64())
                yield pa.RecordBatch.from_arrays([ids.values, pa.array(at.astype(np.int32)), fits], ["vec_id", "cluster", "distance"])

    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    mine = lambda values: F.element_at(F.array(*values), F.col("cluster") + 1)
    return blocks.mapInArrow(ragged.tidy(assign), result).select("*", mine([_long(v) for v in inertia]).alias("cluster_inertia"), _long(sum(inertia)).alias("inertia"), mine([F.lit(d) for d in digest]).alias("centroid_sha256"))


def oracle(k: int = 8, rounds: int = 10, dim: int = 64, scale: int = 1024, salt: int = 3) -> str:
    """DuckDB SQL for :func:`cluster` over ``embeddings``, the rounds written out."""
    near = "select vec_id, v, arg_min(n, d * {k} + n) n, min(d) d from (select vec_id, v, n, list_sum(list_transform(range(1, {dim} + 1), lambda i: (v[i] - c[i]) * (v[i] - c[i])))::bigint d from kept cross join {c}) group by vec_id, v"
    floor = "((s - ((s % m) + m) % m) // m)::bigint"
    steps = [
        f"kept as materialized (select vec_id, list_transform(embedding, lambda x: floor({scale} * x::double)::bigint) v from embeddings where len(embedding) = {dim} and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0)",
        f"c0 as materialized (select row_number() over (order by sha256('{salt}:' || vec_id)) - 1 n, v c from kept qualify n < {k})",
    ]
    for i in range(rounds + 1):
        steps.append(f"a{i} as materialized ({near.format(k=k, dim=dim, c=f'c{i}')})")
        if i < rounds:
            mean = f"select n, list({floor} order by i) c from (select n, i, sum(v[i]) s, count(*) m from a{i} cross join range(1, {dim} + 1) r(i) group by n, i) group by n"
            steps.append(f"c{i + 1} as materialized (select n, coalesce(m.c, o.c) c from c{i} o left join ({mean}) m using (n))")
    return f"with {', '.join(steps)} select vec_id, n::int as \"cluster\", d distance, sum(d) over (partition by n)::bigint cluster_inertia, sum(d) over ()::bigint inertia, sha256(array_to_string(c, ',')) centroid_sha256 from a{rounds} join c{rounds} using (n)"
