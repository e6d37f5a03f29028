"""Quality classifier by co-training of two views, over all documents.

The text view sees the content as hashed sequences of four bytes; the metadata view sees source,
language and length as the table states them. Both are naive Bayes models, which add up: a fit is a sum
over documents, so Spark fits them on any number.

At most ``LABELLED`` labelled documents start both models (a fifth more are held out). In each round every
other document is scored by both views and adds its features to the sums of the score bin it falls in; a
view then labels for the other one the outermost bins of all documents, where it is sure: they hold at most
``SHARE`` more of the documents per round, and of the labelled documents in them ``SURE`` are of that class.
What leaves the executors is one vector per bin, whatever the number of documents. At the end each view is
calibrated on the held-out fold, where the weights of the two calibrated logits are fitted too.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from . import ragged
from .scratch import Scratch

LABELLED, ROUNDS, SURE, SHARE = 3000, 3, 0.95, 0.1
WIDTH, BUCKETS, SIDE, GRAIN, BINS = 4, 4096, 2048, 1 << 20, 33
LANG, LENGTH = 1024, 1536


def grams(col: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The bucket of each run of four bytes of all texts, the row of each, and how many each row has."""
    data, offs = ragged.utf8(col)
    d, many = data.astype(np.uint64), np.maximum(np.diff(offs) - (WIDTH - 1), 0)
    key = np.zeros(max(0, len(d) - WIDTH + 1), np.uint64)
    for j in range(WIDTH):
        key = key << np.uint64(8) | d[j : j + len(key)]
    begin = np.append(0, np.cumsum(many))
    at = np.arange(begin[-1]) + np.repeat(offs[:-1] - begin[:-1], many)
    return ((ragged.mix(key[at]) >> np.uint64(32)) % np.uint64(BUCKETS)).astype(np.int64), np.repeat(np.arange(len(many)), many), many


def meta(batch: pa.RecordBatch) -> np.ndarray:
    """The three buckets of each row: of its source, its language and its stated length; null is a value."""
    name = lambda x, size: 0 if x is None else 1 + zlib.crc32(x.encode()) % (size - 1)
    source, lang = ([name(x, size) for x in batch.column(c).to_pylist()] for c, size in (("source", LANG), ("lang", LENGTH - LANG)))
    chars = [0 if x is None else 1 + min(400, int(4 * np.log2(max(x, 0) + 1))) for x in batch.column("n_chars").to_pylist()]
    return np.array([source, np.add(lang, LANG), np.add(chars, LENGTH)], np.int64).T.reshape(-1, 3)


def ratios(sums: np.ndarray, docs: np.ndarray) -> np.ndarray:
    """Log ratios of the two classes' shares in each bucket, from ``sums[class, bucket]`` in grains, smoothed."""
    smooth = GRAIN * 0.5 / sums.shape[1] * np.maximum(docs, 1)[:, None] ** 0.5
    share = (sums + smooth) / (sums + smooth).sum(axis=1, keepdims=True)
    return np.log(share[1] / share[0])


def bin_of(z: np.ndarray, top: float) -> np.ndarray:
    """The bin of each score between ``-top`` and ``top``, narrow around zero; the middle bin is empty but for zero itself."""
    half = BINS // 2
    steps = np.ceil(np.sqrt(np.minimum(np.abs(z) / top, 1)) * half) if top > 0 else np.zeros(len(z))
    return (half + np.sign(z) * steps).astype(np.int64)


def chosen(known: np.ndarray, pool: np.ndarray, most: float) -> tuple[list[int], list[int]]:
    """The bins a view labels as class 0 and class 1.

    ``known[class, bin]`` counts labelled documents, ``pool[bin]`` the others. From the outermost bin
    inwards, bins are taken while those taken hold at most the class's part of ``most`` documents of the
    pool and at least ``SURE`` of their labelled documents are of the class.
    """
    out: list[list[int]] = [[], []]
    prior = known.sum(axis=1) / max(1, known.sum())
    for label, order in ((0, range(BINS // 2)), (1, range(BINS - 1, BINS // 2, -1))):
        right = total = size = 0
        for b in order:
            right, total, size = right + known[label, b], total + known[:, b].sum(), size + pool[b]
            if size > most * prior[label] or (total and right < SURE * total):
                break
            if total:
                out[label].append(b)
    return out[0], out[1]


class Pass:
    """The sums of one pass: of labelled documents by class, of the others by the bin of the other view's score."""

    def __init__(self) -> None:
        self.text, self.meta = np.zeros((2 + BINS, BUCKETS)), np.zeros((2 + BINS, SIDE))
        self.known, self.pool = np.zeros((2, 2, BINS), np.int64), np.zeros((2, BINS), np.int64)
        self.docs = np.zeros(2, np.int64)

    def arrays(self) -> list[tuple[int, np.ndarray]]:
        """Rows of one length each, numbered, for the way through Spark."""
        small = np.concatenate([self.known.ravel(), self.pool.ravel(), self.docs]).astype(float)
        rows = [*self.text, *self.meta, small]
        return [(i, r) for i, r in enumerate(rows) if r.any()]

    def put(self, i: int, row: np.ndarray) -> None:
        if i < 2 + BINS:
            self.text[i] = row
        elif i < 2 * (2 + BINS):
            self.meta[i - 2 - BINS] = row
        else:
            k, p = self.known.size, self.pool.size
            self.known, self.pool, self.docs = row[:k].reshape(2, 2, BINS).astype(int), row[k : k + p].reshape(2, BINS).astype(int), row[k + p :].astype(int)


def scores(part: pa.RecordBatch, w_text: np.ndarray, w_meta: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Mean log ratio of the runs of bytes, and the sum over the metadata, of each row."""
    bucket, row, many = grams(part.column("text"))
    return np.bincount(row, weights=w_text[bucket], minlength=len(many)) / np.maximum(many, 1), w_meta[meta(part)].sum(axis=1)


def tally(docs: DataFrame, told: dict[int, int], held: set[int], w_text: np.ndarray | None, w_meta: np.ndarray | None) -> Pass:
    """One pass over ``docs``; without weights, over the labelled documents alone."""
    shared = docs.sparkSession.sparkContext.broadcast((told, held, w_text, w_meta))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        told, held, w_text, w_meta = shared.value
        out = Pass()
        for batch in batches:
            for part in ragged.slices(batch, "text"):
                ids = part.column("doc_id").to_pylist()
                label = np.array([-2 if i in held else told.get(i, -1) for i in ids], np.int64)
                bucket, row, many = grams(part.column("text"))
                side = meta(part)
                grain = np.where(many > 0, GRAIN // np.maximum(many, 1), 0)
                slot_text = slot_meta = np.where(label >= 0, label, -1)
                if w_text is not None:
                    z = (np.bincount(row, weights=w_text[bucket], minlength=len(many)) / np.maximum(many, 1), w_meta[side].sum(axis=1))
                    b = [bin_of(z[0], np.abs(w_text).max()), bin_of(z[1], 3 * np.abs(w_meta).max())]
                    slot_meta, slot_text = (np.where(label == -1, 2 + x, slot_text) for x in b)
                    for v in (0, 1):
                        out.pool[v] += np.bincount(b[v][label == -1], minlength=BINS)
                        for y in (0, 1):
                            out.known[v, y] += np.bincount(b[v][label == y], minlength=BINS)
                out.docs += np.bincount(label[label >= 0], minlength=2)
                ok = slot_text[row] >= 0
                out.text += np.bincount(slot_text[row][ok] * BUCKETS + bucket[ok], weights=grain[row][ok], minlength=out.text.size).reshape(out.text.shape)
                ok = slot_meta >= 0
                out.meta += np.bincount((slot_meta[ok, None] * SIDE + side[ok]).ravel(), minlength=out.meta.size).reshape(out.meta.shape) * GRAIN
        rows = out.arrays()
        salt = TaskContext.get().partitionId() % 64
        yield pa.RecordBatch.from_arrays([pa.array([i for i, _ in rows], pa.int32()), pa.array([salt] * len(rows), pa.int32()), pa.array([r.tobytes() for _, r in rows], pa.binary())], ["slot", "salt", "sums"])

    def add(table: pa.Table) -> pa.Table:
        total = np.sum([np.frombuffer(x, np.float64) for x in table.column("sums").to_pylist()], axis=0)
        return pa.table({"slot": table.column("slot")[:1].cast(pa.int32()), "salt": table.column("salt")[:1].cast(pa.int32()), "sums": pa.array([total.tobytes()], pa.binary())})

    if w_text is None:
        ids = docs.sparkSession.createDataFrame([(i,) for i in [*told, *held]], "doc_id long")
        docs = docs.join(F.broadcast(ids), "doc_id", "left_semi")  # at most LABELLED ids
    kind = "slot int, salt int, sums binary"
    summed = docs.select("doc_id", "text", "lang", "source", "n_chars").mapInArrow(run, kind).groupBy("slot", "salt").applyInArrow(add, kind).groupBy("slot").applyInArrow(add, kind)
    out = Pass()
    for r in summed.toArrow().to_pylist():
        out.put(r["slot"], np.frombuffer(r["sums"], np.float64))
    return out


def exchange(base: Pass, now: Pass, most: float) -> tuple[np.ndarray, np.ndarray]:
    """New weights of the text and the metadata view: labelled documents, and those the other view is sure of."""
    out = []
    for view, (own, sums) in enumerate(((base.text[:2], now.text), (base.meta[:2], now.meta))):
        bins = chosen(now.known[1 - view], now.pool[1 - view], most)
        total = np.array([own[y] + sums[[2 + b for b in bins[y]]].sum(axis=0) for y in (0, 1)])
        out.append(ratios(total, base.docs + np.array([now.pool[1 - view][bins[y]].sum() for y in (0, 1)])))
    return out[0], out[1]


def fit(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2, steps: int = 400, rate: float = 0.5) -> np.ndarray:
    """Logistic regression on a few columns by gradient steps with momentum; the last weight is the constant."""
    x = np.append(x, np.ones((len(x), 1), x.dtype), axis=1)
    w, speed = np.zeros(x.shape[1]), np.zeros(x.shape[1])
    for _ in range(steps):
        g = x.T @ (1 / (1 + np.exp(-np.clip(x @ w, -30, 30))) - y) / len(y) + ridge * np.append(w[:-1], 0)
        speed = 0.9 * speed - rate * g
        w += speed
    return w


def calibrate(z: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Slope and constant of each view's logit, and the weights that combine the logits."""
    sides = []
    for v in (0, 1):
        mid, wide = z[:, v].mean(), z[:, v].std() + 1e-9
        w = fit((z[:, v] - mid)[:, None] / wide, y)
        sides.append((w[0] / wide, w[1] - w[0] * mid / wide))
    sides = np.array(sides)
    logits = np.clip(z * sides[:, 0] + sides[:, 1], -30, 30)
    return sides, fit(logits / 4, y) * [0.25, 0.25, 1]


def score(docs: DataFrame, labels: DataFrame, threshold: float = 0.5) -> DataFrame:
    """One row per row of ``docs(doc_id, text, lang, source, n_chars)``: doc_id, p_text, p_meta, score, kept.

    * Null or empty text has no sequences; its text view is the constant of the model.
    * Null languages, sources and lengths are values of their own. Null ids are scored.
    * Null labels say nothing; labels that contradict each other count as their rounded mean.
    * Fewer than 50 labelled documents, or labels all alike (in the held-out fold too): no model;
      probabilities are null and all is kept.
    * Repeated rows are each scored. Documents with equal scores fall in one bin together.
    * Extra columns are ignored; an empty table gives an empty result. Texts are read whole.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), *(F.col(c).cast("string").alias(c) for c in ("text", "lang", "source")), F.col("n_chars").cast("long").alias("n_chars"))
    without = docs.select("doc_id", *(F.lit(None).cast("double").alias(c) for c in ("p_text", "p_meta", "score")), F.lit(True).alias("kept"))
    known = labels.filter("doc_id is not null and quality is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.round(F.avg("quality")).cast("int").alias("y"))
    rows = known.orderBy(F.xxhash64("doc_id", F.lit(10)), "doc_id").limit(LABELLED).collect()
    told = {r["doc_id"]: r["y"] for i, r in enumerate(rows) if i % 5 != 4}
    held = {r["doc_id"]: r["y"] for i, r in enumerate(rows) if i % 5 == 4}
    if len(rows) < 50:
        return without
    base = tally(docs, told, set(held), None, None)
    if base.docs.sum() < 40 or not base.docs.all():
        return without
    w_text, w_meta = ratios(base.text[:2], base.docs), ratios(base.meta[:2], base.docs)
    for turn in range(ROUNDS):
        now = tally(docs, told, set(held), w_text, w_meta)
        w_text, w_meta = exchange(base, now, SHARE * (turn + 1) * now.pool[0].sum())

    shared = docs.sparkSession.sparkContext.broadcast((w_text, w_meta))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in ragged.slices(batch, "text"):
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), *map(pa.array, scores(part, *shared.value))], ["doc_id", "zt", "zm"])

    scored = Scratch(docs.sparkSession, "cotraining").save(docs.mapInArrow(run, "doc_id long, zt double, zm double"))
    ids = docs.sparkSession.createDataFrame(list(held.items()), "doc_id long, y int")
    seen = scored.join(F.broadcast(ids), "doc_id").groupBy("doc_id").agg(*(F.min(c).alias(c) for c in ("y", "zt", "zm"))).orderBy("doc_id").collect()  # one row per held-out label
    y = np.array([r["y"] for r in seen], float)
    if len(np.unique(y)) < 2:
        return without
    sides, joint = calibrate(np.array([[r["zt"], r["zm"]] for r in seen]), y)
    logit = lambda c, v: F.least(F.lit(30.0), F.greatest(F.lit(-30.0), F.col(c) * F.lit(float(sides[v, 0])) + F.lit(float(sides[v, 1]))))
    sigmoid = lambda x: F.round(1 / (1 + F.exp(-x)), 9)
    a, b = logit("zt", 0), logit("zm", 1)
    out = scored.select("doc_id", sigmoid(a).alias("p_text"), sigmoid(b).alias("p_meta"), sigmoid(a * float(joint[0]) + b * float(joint[1]) + float(joint[2])).alias("score"))
    return out.withColumn("kept", F.col("score") >= threshold)
