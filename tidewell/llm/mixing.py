"""Mixing sources to target weights by iterative proportional fitting.

Documents fall into cells of source, language and topic. The tokens of the cells are raked until the
marginals of all three have their target shares of a stated budget of tokens; a document is then
sampled with the probability of its cell, by a hash of its id and text, so that the same corpus gives
the same sample. A value too rare to fill its share is kept whole and sets nobody else's rate.

Topics are clusters of texts: words are hashed to terms, terms weighted by how rare they are among all
documents, and projected to ``DIMS`` numbers; centroids are moved over all documents' vectors. Spark reads
the texts once for the weights and once for vectors and tokens, which are written beside the rows; the
rest works on these and on the table of cells. Up to ``ARRAY_CELLS`` cells are raked in one task, more as
a table; only up to ``BROADCAST_CELLS`` probabilities are broadcast.
"""

from __future__ import annotations

import warnings
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F

from . import ragged
from .bpe import encoder, runs
from .scratch import Scratch

DIMENSIONS = ("source", "lang", "topic")
TOPICS, TERMS, DIMS, MOVES = 8, 1 << 16, 32, 5
TEMPER, TURNS, CLOSE, OFF = 0.7, 200, 1e-5, 1e-3
BUDGET = 0.4
ARRAY_CELLS = BROADCAST_CELLS = 100_000
GRAIN = 1 << 40


def terms(text: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The hashed term of each word of all texts, and where each text's begin."""
    w = ragged.Words(*ragged.utf8(text))
    return (w.hashes() % np.uint64(TERMS)).astype(np.int64), w.first


def rarity(docs: DataFrame) -> np.ndarray:
    """The weight of each term: the log of how many documents there are for one that has it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        have, rows = np.zeros(TERMS, np.int64), 0
        for batch in batches:
            rows += batch.num_rows
            for part in ragged.slices(batch, "text"):
                term, first = terms(part.column("text"))
                key = np.unique(np.repeat(np.arange(part.num_rows), np.diff(first)) * TERMS + term)
                have += np.bincount(key % TERMS, minlength=TERMS)
        some = np.flatnonzero(have)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(some, TERMS)), pa.array(np.append(have[some], rows))], ["term", "n"])

    found = docs.select("text").mapInArrow(ragged.tidy(run), "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(TERMS + 1)
    out[found.column("term").to_numpy()] = found.column("n").to_numpy()
    return np.log((1 + out[-1]) / (1 + out[:-1])).astype(np.float32)


def vectors(text: pa.Array, weight: np.ndarray) -> np.ndarray:
    """Each text's weighted terms projected on random signs, as bytes of one length; zeros without words."""
    sign = np.random.Generator(np.random.PCG64(7)).integers(0, 2, (TERMS, DIMS), dtype=np.int8) * 2 - 1 if not _signs else _signs[0]
    if not _signs:
        _signs.append(sign)
    term, first = terms(text)
    out = np.zeros((len(first) - 1, DIMS), np.float64)
    has = np.flatnonzero(np.diff(first))
    for a in range(0, len(has), 256):  # runs of texts, so that no large array of words times dimensions is made
        rows = has[a : a + 256]
        for lo in range(first[rows[0]], first[rows[-1] + 1], ragged.CHUNK):
            hi = min(lo + ragged.CHUNK, first[rows[-1] + 1])
            owner = np.searchsorted(first, np.arange(lo, hi), side="right") - 1
            at = np.flatnonzero(np.append(True, owner[1:] != owner[:-1]))
            out[owner[at]] += np.add.reduceat(sign[term[lo:hi]] * weight[term[lo:hi], None], at, axis=0)
    size = np.sqrt((out**2).sum(axis=1, keepdims=True))
    return np.rint(out / np.maximum(size, 1e-9) * 127).astype(np.int8)


_signs: list[np.ndarray] = []


def nearest(vector: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """The number of the nearest centroid of each vector; the first of equally near ones."""
    return np.argmin((centroids**2).sum(axis=1) - 2 * vector.astype(np.float64) @ centroids.T, axis=1)


def _stacked(col: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(col.to_pylist()), np.int8).reshape(-1, DIMS)


def centroids_of(told: DataFrame) -> np.ndarray:
    """Centroids of all rows' vectors, moved at most ``MOVES`` times from the octants of the first three numbers.

    A centroid nearest to no vector stays where it is. Sums are of whole numbers, so the result is always the same.
    """
    now = np.zeros((TOPICS, DIMS))
    now[:, :3] = [[60 if t >> b & 1 else -60 for b in range(3)] for t in range(TOPICS)]
    for _ in range(MOVES):

        def run(batches: Iterator[pa.RecordBatch], now: np.ndarray = now) -> Iterator[pa.RecordBatch]:
            total = np.zeros((TOPICS, DIMS + 1), np.int64)
            for batch in batches:
                v = _stacked(batch.column("vector"))
                mine = nearest(v, now)
                for t in range(TOPICS):
                    total[t] += np.append(v[mine == t].sum(axis=0, dtype=np.int64), (mine == t).sum())
            slot = np.arange(total.size)
            yield pa.RecordBatch.from_arrays([pa.array(slot), pa.array(total.ravel())], ["slot", "n"])

        got = told.select("vector").mapInArrow(ragged.tidy(run), "slot long, n long").groupBy("slot").agg(F.sum("n").alias("n")).toArrow()
        total = np.zeros(TOPICS * (DIMS + 1))
        total[got.column("slot").to_numpy()] = got.column("n").to_numpy()
        total = total.reshape(TOPICS, DIMS + 1)
        new = np.where(total[:, -1:] > 0, total[:, :-1] / np.maximum(total[:, -1:], 1), now)
        if (new == now).all():
            break
        now = new
    return now


def described(docs: DataFrame, weight: np.ndarray, vocabulary: str | None) -> DataFrame:
    """``docs(row, source, lang, u, text)`` with ``vector`` and ``n_tokens`` instead of the text."""
    shared = docs.sparkSession.sparkContext.broadcast(weight)  # TERMS numbers

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = encoder(vocabulary) if vocabulary else None
        for batch in batches:
            for part in ragged.slices(batch, "text"):
                text, count = pc.fill_null(part.column("text"), ""), []
                for a, b in runs(pc.binary_length(text).to_pylist()) if code else ():
                    count += code.encode(text.slice(a, b - a).to_pylist(), ids=False)[1].tolist()
                n = pa.array(count if code else np.diff(terms(text)[1]), pa.int64())
                v = pa.array([x.tobytes() for x in vectors(text, shared.value)], pa.binary())
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in ("row", "source", "lang", "u")), v, n], ["row", "source", "lang", "u", "vector", "n_tokens"])

    kind = docs.select("row", "source", "lang", "u").schema
    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in kind)
    return docs.select("row", "source", "lang", "u", "text").mapInArrow(ragged.tidy(run), fields + ", vector binary, n_tokens long")


def with_topics(told: DataFrame, centroids: np.ndarray) -> DataFrame:
    """``told`` with ``topic`` from its ``vector``."""

    @F.pandas_udf("long")
    def topic(v: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for x in v:
            yield pd.Series(nearest(np.frombuffer(b"".join(x), np.int8).reshape(-1, DIMS), centroids))

    return told.withColumn("topic", topic("vector"))


def fill(shares: DataFrame, budget: float) -> dict[str, float]:
    """Scale ``l`` of each dimension of ``shares(d, g, have)`` at which min(have, l * g) sums to the budget.

    A value that cannot fill its share is kept whole and the others take what it leaves. Each round
    keeps more values whole, so the scale grows until no further value is exhausted.
    """
    scale: dict[str, float] = {}
    while True:
        at = F.coalesce(F.element_at(F.create_map(*(F.lit(x) for kv in scale.items() for x in kv)), F.col("d")), F.lit(0.0)) if scale else F.lit(0.0)
        whole = at * F.col("g") >= F.col("have")
        found = shares.filter("g > 0 and have > 0").groupBy("d").agg(F.sum(F.when(whole, F.col("have")).otherwise(0.0)).alias("kept"), F.sum(F.when(whole, 0.0).otherwise(F.col("g"))).alias("left")).collect()
        new = {r["d"]: max(scale.get(r["d"], 0.0), (budget - r["kept"]) / r["left"] if r["left"] > 0 else 0.0) for r in found}
        if all(v <= scale.get(d, 0.0) * (1 + 1e-12) for d, v in new.items()):
            return scale
        scale = new


def rake_arrays(codes: np.ndarray, w: np.ndarray, shares: list[np.ndarray], budget: float = BUDGET) -> tuple[np.ndarray, bool]:
    """What :func:`rake` does, over arrays: the probability of each cell, and whether the marginals settled.

    ``codes[d, cell]`` numbers the values of each dimension, ``shares[d][value]`` are their target shares.
    """
    cap = np.where(np.all([g[c] > 0 for g, c in zip(shares, codes)], axis=0), w, 0).astype(float)
    goal, aims = min(budget * w.sum(), cap.sum()), []
    for g, c in zip(shares, codes):
        have, scale = np.bincount(c, cap, len(g)), 0.0
        while True:
            whole = scale * g >= have
            left = g[~whole & (have > 0)].sum()
            new = (goal - have[whole].sum()) / left if left > 0 else scale
            if new <= scale * (1 + 1e-12):
                break
            scale = new
        aims.append(np.minimum(have, scale * g))
    z = cap.copy()
    for _ in range(TURNS):
        before = np.minimum(z, cap)
        for aim, c in zip(aims, codes):
            free = z < cap
            full, some, total = (np.bincount(c, x, len(aim)) for x in (np.where(free, 0, cap), np.where(free, z, 0), np.minimum(z, cap)))
            grow = np.where(some > 0, (aim - full) / np.where(some > 0, some, 1), 1.0)
            z = z * np.where(total <= 0, 0, np.where(aim >= total, grow, aim / np.where(total > 0, total, 1)))[c]
        if np.abs(np.minimum(z, cap) - before).sum() <= CLOSE * w.sum():
            break
    kept = np.minimum(z, cap)
    off = max((np.abs(np.bincount(c, kept, len(aim)) - aim).sum() for aim, c in zip(aims, codes)), default=0.0)
    return np.where(w > 0, kept / np.maximum(w, 1), 0.0), bool(off <= OFF * goal)


def _raked_in_one_task(cells: DataFrame, targets: dict[str, dict] | None, budget: float) -> DataFrame:
    def run(table: pa.Table) -> pa.Table:
        w, codes, shares = table.column("w").to_numpy().astype(float), [], []
        for d in DIMENSIONS:
            column = pc.dictionary_encode(table.column(d).combine_chunks(), null_encoding="encode")
            values, code = column.dictionary.to_pylist(), column.indices.to_numpy()
            codes.append(code)
            shares.append(np.array([float(targets[d].get(v, 0.0)) for v in values]) if targets and d in targets else np.bincount(code, w, len(values)) ** TEMPER)
        p, settled = rake_arrays(np.array(codes), w, shares, budget)
        return table.append_column("probability", pa.array(p)).append_column("settled", pa.array([settled] * len(p)))

    kind = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in cells.schema)
    return cells.groupBy().applyInArrow(run, kind + ", probability double, settled boolean")


def rake(cells: DataFrame, targets: dict[str, dict] | None, scratch: Scratch, budget: float = BUDGET) -> DataFrame:
    """``cells(source, lang, topic, w)`` with ``probability``, the part of each cell's weight to keep, and ``settled``.

    Targets are shares per value of a dimension; a value without one gets none. A dimension without
    targets aims at its present shares to the power ``TEMPER``. The kept weight is ``budget`` times
    the whole, or all that the targets admit if this is less. No cell gives more than it has: a factor
    acts on the weight ``z`` before it is clipped, and is solved for what the clipped cells leave.
    """
    total = cells.agg(F.sum("w")).first()[0] or 0
    now = cells
    for d in DIMENSIONS:
        if targets and d in targets:
            names, shares = list(targets[d]), [float(v) for v in targets[d].values()]
            now = now.withColumn(f"g_{d}", F.coalesce(F.element_at(F.map_from_arrays(F.array(*map(F.lit, names)), F.array(*map(F.lit, shares))), F.col(d)), F.lit(0.0)))
        else:
            share = cells.groupBy(F.col(d).alias("v")).agg(F.pow(F.sum("w").cast("double"), F.lit(TEMPER)).alias(f"g_{d}"))
            now = now.join(share, now[d].eqNullSafe(share["v"]), "left").drop("v")
    open_ = F.lit(True)
    for d in DIMENSIONS:
        open_ = open_ & (F.col(f"g_{d}") > 0)
    now = scratch.save(now.withColumn("cap", F.when(open_, F.col("w").cast("double")).otherwise(0.0)))
    goal = min(budget * total, now.agg(F.sum("cap")).first()[0] or 0.0)
    shares = None
    for d in DIMENSIONS:
        part = now.groupBy(F.col(d)).agg(F.lit(d).alias("d"), F.first(f"g_{d}").alias("g"), F.sum("cap").alias("have")).select("d", "g", "have")
        shares = part if shares is None else shares.unionByName(part)
    scale = fill(scratch.save(shares), goal)
    for d in DIMENSIONS:
        have = now.groupBy(F.col(d).alias("v")).agg(F.sum("cap").alias("have"))
        now = now.join(have, now[d].eqNullSafe(have["v"]), "left").drop("v").withColumn(f"t_{d}", F.least("have", F.col(f"g_{d}") * F.lit(scale.get(d, 0.0)))).drop("have")
    now = scratch.save(now.withColumn("z", F.col("cap")))
    kept = lambda z: F.least("cap", F.col(z))
    for _ in range(TURNS):
        new = now.withColumn("y", F.col("z"))
        for d in DIMENSIONS:
            free = F.col("z") < F.col("cap")
            sums = new.groupBy(F.col(d).alias("v")).agg(F.sum(kept("z")).alias("s"), F.sum(F.when(free, 0.0).otherwise(F.col("cap"))).alias("full"), F.sum(F.when(free, F.col("z")).otherwise(0.0)).alias("some"))
            met = new.join(sums, new[d].eqNullSafe(sums["v"]), "left").drop("v")
            grow = F.when(F.col("some") > 0, (F.col(f"t_{d}") - F.col("full")) / F.col("some")).otherwise(1.0)
            new = met.withColumn("z", F.when(F.col("s") <= 0, 0.0).when(F.col(f"t_{d}") >= F.col("s"), F.col("z") * grow).otherwise(F.col("z") * F.col(f"t_{d}") / F.col("s"))).drop("s", "full", "some")
        new = scratch.save(new)
        moved = new.agg(F.sum(F.abs(kept("z") - kept("y")))).first()[0] or 0
        scratch.drop(now)
        now = new.drop("y")
        now._scratch_path = new._scratch_path
        if moved <= CLOSE * total:
            break
    gaps = [now.groupBy(d).agg(F.abs(F.sum(kept("z")) - F.first(f"t_{d}")).alias("off")).agg(F.sum("off")).first()[0] or 0.0 for d in DIMENSIONS]
    settled = max(gaps) <= OFF * goal
    return now.select(*DIMENSIONS, "w", F.when(F.col("w") > 0, kept("z") / F.col("w")).otherwise(0.0).alias("probability"), F.lit(settled).alias("settled"))


def draw(seed: int = 0) -> Column:
    """A number in [0, 1) fixed by a row's id and text."""
    return F.pmod(F.xxhash64(F.col("doc_id").cast("long"), F.col("text").cast("string"), F.lit(seed)), F.lit(GRAIN)) / F.lit(float(GRAIN))


def mix(docs: DataFrame, targets: dict[str, dict] | None = None, seed: int = 0, carry: list[str] | None = None, budget: float = BUDGET, vocabulary: str | None = None, array_cells: int = ARRAY_CELLS) -> DataFrame:
    """Every row of ``docs(doc_id, text, source, lang, ...)`` as ``row``, with topic, n_tokens, probability, sampled.

    The expected tokens of the sample are ``budget`` times those of all rows and have the raked shares;
    cells whose share is more than they hold are kept whole (probability 1), and the others make up
    for what these lack. Tokens are those of the ``vocabulary`` file, or words without one.

    * A null source or language is a value like any other. Null or empty text: a vector of zeros, no
      tokens; such a row's cell may have no tokens at all, then its probability is 0.
    * Targets that contradict each other cannot all be met: the last turn's result is taken, and a
      warning says that marginals are off by more than ``OFF`` of the budget.
    * Repeated rows share one draw: all or none of them are sampled. Of equally near topics the first counts.
    * Extra columns come back inside ``row``, whatever their names (``carry`` names those wanted); an
      empty table gives an empty result. Texts are read whole.
    """
    scratch = Scratch(docs.sparkSession, "mixing")
    body = docs.select(F.struct(*(carry or docs.columns)).alias("row"), F.col("source").alias("source"), F.col("lang").alias("lang"), draw(seed).alias("u"), F.col("text").cast("string").alias("text"))
    told = scratch.save(described(body, rarity(body), vocabulary))
    told = with_topics(told, centroids_of(told)).drop("vector")
    cells = scratch.save(told.groupBy(*DIMENSIONS).agg(F.sum("n_tokens").alias("w")))
    many = cells.count()
    raked = scratch.save(_raked_in_one_task(cells, targets, budget) if many <= array_cells else rake(cells, targets, scratch, budget))
    if raked.filter("not settled").limit(1).count():
        warnings.warn(f"the targets cannot all be met: a marginal is off by more than {OFF} of the budget", stacklevel=2)
    chance = raked.select(*(F.col(d).alias(f"c_{d}") for d in DIMENSIONS), F.round("probability", 9).alias("probability"))
    if many <= BROADCAST_CELLS:
        chance = F.broadcast(chance)
    same = [told[d].eqNullSafe(F.col(f"c_{d}")) for d in DIMENSIONS]
    return told.join(chance, same, "left").select("row", "source", "lang", "topic", "n_tokens", "probability", (F.col("u") < F.col("probability")).alias("sampled"))
