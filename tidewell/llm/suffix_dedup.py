"""Removal of byte strings that occur more than once, by a radix sort of suffixes limited in depth.

Suffixes are ordered only through their first ``depth`` bytes, most significant digit first; a suffix
that is alone in its group after a digit leaves the sort, and the groups that are left after the last
digit are exactly the repeated windows. The digits are not taken from left to right: the first is the
window's *anchor*, the ``GRAM`` bytes inside it with the smallest hash (the leftmost of equal ones). Equal
windows have equal anchors at equal offsets, so the order of digits is the same for them, and neighbours
mostly share their anchor: one row stands for a run of suffixes, not for one.

1. Anchor: runs of suffixes are grouped by it. Runs of wholly equal bytes are repeated as they are.
2. Where runs of one anchor differ, their suffixes go on in blocks of ``BLOCK`` offsets, with all bytes
   that the suffixes of a block have in common as the digit.
3. Where blocks differ as well, single suffixes with all ``depth`` bytes.

Every pass counts by partial aggregates, and one representative of equal runs goes on, so a passage that
a third of all documents share is one row per task. A pass costs a shuffle of what is still open and
one of the texts that hold it.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from . import ragged
from .scratch import Scratch

DEPTH, GRAM, BLOCK = 400, 200, 16
PART = 1 << 17
SHIFT = np.uint64(18)
ROW = "row struct<id:long,tie:long>"
#: A pass's rows: what suffixes have in common, all their bytes, from where to where they start, the anchor, how many.
FOUND = f"digit long, span binary, {ROW}, low int, high int, anchor int, many int"


def runs(data: np.ndarray, offs: np.ndarray, depth: int, gram: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(low, high, anchor, hash of the anchor's bytes) of all runs of windows, as places in ``data``, part by part."""
    width = depth - gram + 1
    held: tuple | None = None
    stop = np.maximum(offs[1:] - depth + 1, offs[:-1])  # windows of a text start before this
    for a in range(0, max(len(data) - depth + 1, 0), PART):
        b = min(a + PART, len(data) - depth + 1)
        part = data[a : b + depth - 1]
        n = len(part) - gram + 1
        total = np.zeros(len(part) + 1, np.uint64)
        np.cumsum(ragged.BYTE[part] * ragged.powers(int(ragged.BASE), len(part)), out=total[1:])
        h = ragged.mix((total[gram:] - total[:n]) * ragged.powers(ragged._INVERSE, len(part) + 1)[:n])
        key = (h >> SHIFT << SHIFT) | np.arange(n, dtype=np.uint64)
        padded = np.full(-(-n // width) * width, np.uint64(2**64 - 1))
        padded[:n] = key
        padded = padded.reshape(-1, width)
        before, after = np.minimum.accumulate(padded, axis=1).ravel(), np.minimum.accumulate(padded[:, ::-1], axis=1)[:, ::-1].ravel()
        at = (np.minimum(after[: b - a], before[width - 1 : width - 1 + b - a]) & np.uint64((1 << 18) - 1)).astype(np.int64)

        first, last = np.searchsorted(offs, a, side="right") - 1, np.searchsorted(offs, b, side="left")
        inside = np.zeros(b - a + 1, np.int64)
        np.add.at(inside, np.clip(offs[first:last], a, b) - a, 1)
        np.add.at(inside, np.clip(stop[first:last], a, b) - a, -1)
        p = np.flatnonzero(np.cumsum(inside)[:-1])
        if not len(p):
            continue
        at = at[p]
        cut = np.flatnonzero(np.append(True, (at[1:] != at[:-1]) | (p[1:] != p[:-1] + 1)))
        low, high, anchor = p[cut] + a, p[np.append(cut[1:], len(p)) - 1] + a, at[cut] + a
        digit = h[at[cut]]
        if held is not None:
            if held[2][0] == anchor[0] and held[1][0] + 1 == low[0]:
                low[0] = held[0][0]
            else:
                yield held
        if len(low) > 1:
            yield low[:-1], high[:-1], anchor[:-1], digit[:-1]
        held = low[-1:], high[-1:], anchor[-1:], digit[-1:]
    if held is not None:
        yield held


def _digests(data: memoryview, low: np.ndarray, end: np.ndarray) -> list[bytes]:
    return [hashlib.blake2b(data[a:b], digest_size=16).digest() for a, b in zip(low.tolist(), end.tolist())]


def _anchored(depth: int, gram: int):  # noqa: ANN202
    """The first pass: runs of all texts. Equal single windows one byte apart, as in ``aaaa``, are one row with ``many``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in ragged.slices(batch, "text"):
                data, offs = ragged.utf8(part.column("text"))
                whole = memoryview(np.ascontiguousarray(data))
                for low, high, anchor, digit in runs(data, offs, depth, gram):
                    span = _digests(whole, low, high + depth)
                    owner = np.searchsorted(offs, low, side="right") - 1
                    near = (np.diff(low) == 1) & (np.diff(high) == 1) & (low == high)[1:] & (digit[1:] == digit[:-1]) & (owner[1:] == owner[:-1])
                    new = np.append(True, ~near)
                    for i in np.flatnonzero(near).tolist():
                        new[i + 1] = span[i] != span[i + 1]
                    at = np.flatnonzero(new)
                    place = lambda x: pa.array((x - offs[owner])[at].astype(np.int32))
                    cols = [pa.array(digit[at].view(np.int64)), pa.array([span[i] for i in at.tolist()], pa.binary()), part.column("row").take(pa.array(owner[at]))]
                    yield pa.RecordBatch.from_arrays([*cols, place(low), place(high), place(anchor), pa.array(np.diff(np.append(at, len(low))).astype(np.int32))], ["digit", "span", "row", "low", "high", "anchor", "many"])

    return run


def _divided(depth: int, block: int):  # noqa: ANN202
    """A later pass: the runs of each text in blocks of ``block`` offsets from their anchor."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, text, todo in zip(batch.column("row").to_pylist(), batch.column("text"), batch.column("runs").to_pylist()):
                data = text.as_buffer()
                out: dict[str, list] = {"digit": [], "span": [], "low": [], "high": [], "anchor": [], "open": []}
                for r in todo:
                    a = r["anchor"]
                    for j in range((a - r["high"]) // block, (a - r["low"]) // block + 1):
                        low, high = max(a - block * (j + 1) + 1, r["low"]), min(a - block * j, r["high"])
                        shared = hashlib.blake2b(data[a - block * j : a - block * (j + 1) + 1 + depth], digest_size=8, salt=j.to_bytes(8, "little", signed=True)).digest()
                        values = int.from_bytes(shared, "little", signed=True), hashlib.blake2b(data[low : high + depth], digest_size=16).digest(), low, high, a, r["open"]
                        for name, value in zip(out, values):
                            out[name].append(value)
                kinds = pa.int64(), pa.binary(), pa.int32(), pa.int32(), pa.int32(), pa.bool_()
                cols = {name: pa.array(values, kind) for (name, values), kind in zip(out.items(), kinds)}
                n = len(out["low"])
                cols |= {"row": pa.array([row] * n, batch.schema.field("row").type), "many": pa.array(np.ones(n, np.int32))}
                yield pa.RecordBatch.from_arrays([cols[c] for c in ("digit", "span", "row", "low", "high", "anchor", "many", "open")], ["digit", "span", "row", "low", "high", "anchor", "many", "open"])

    return run


def _sorted(found: DataFrame, scratch: Scratch, depth: int) -> tuple[DataFrame, DataFrame]:
    """After a pass: (row, start, end) of what is repeated, and the runs that go on, one of each kind."""
    place = F.struct("row", "low", "high", "anchor")
    kinds = scratch.save(found.groupBy("digit", "span").agg(F.sum("many").alias("n"), F.min(place).alias("one"), F.max("open").alias("open")))
    again = kinds.filter("n > 1 and open").select("digit", "span")
    end = F.col("high") + F.col("many") - 1 + depth
    covered = scratch.save(found.filter("open").join(again, ["digit", "span"]).select("row", F.col("low").alias("start"), end.alias("end")))
    unsettled = kinds.groupBy("digit").agg(F.count("*").alias("kinds"), F.max((F.col("n") == 1) & F.col("open")).alias("any")).filter("kinds > 1 and any").select("digit")
    left = scratch.save(kinds.join(unsettled, "digit").select("one.*", ((F.col("n") == 1) & F.col("open")).alias("open")))
    scratch.drop(kinds)
    return covered, left


def _name() -> Column:
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return F.struct(F.col("doc_id").cast("long").alias("id"), F.xxhash64(text).alias("tie")).alias("row")


def _cut(texts: pa.Array, spans: pa.Array) -> pa.Array:
    """Maximal removed runs and what remains of each text's bytes."""
    runs_, kept = [], []
    for text, todo in zip(texts, spans.to_pylist()):
        data = text.as_buffer().to_pybytes() if text.is_valid else b""
        merged: list[list[int]] = []
        for s in sorted((s["start"], s["end"]) for s in todo or []):
            if merged and s[0] <= merged[-1][1]:
                merged[-1][1] = max(merged[-1][1], s[1])
            else:
                merged.append(list(s))
        edges = [0, *(x for s in merged for x in s), len(data)]
        kept.append(b"".join(data[a:b] for a, b in zip(edges[::2], edges[1::2])) if merged else data)
        runs_.append([{"start": a, "end": b} for a, b in merged])
    kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
    return pa.StructArray.from_arrays([pa.array(runs_, kind), pa.array(kept, pa.binary())], ["spans", "kept"])


def dedup_substrings(docs: DataFrame, depth: int = DEPTH, gram: int | None = None, block: int = BLOCK) -> DataFrame:
    """The rows of ``docs(doc_id, text, ...)`` with ``n_bytes``, ``spans`` (start, end; maximal removed runs) and ``kept`` (bytes) added.

    A byte goes if a string of ``depth`` bytes around it also starts anywhere else, in the same text or another;
    all occurrences go, overlapping ones too. Strings never cross texts and are judged on the input.

    * Null text counts as empty; it and texts shorter than ``depth`` lose nothing. ``kept`` need not be UTF-8.
    * Every row is a text of its own, so a row that comes twice loses all of a text of ``depth`` bytes or more.
      Null ids are ids like others.
    * Extra columns are kept, whatever their names, but for the three that are added, which are replaced; an
      empty table gives an empty result. Texts are read whole, in parts of 128 KB.
    * Windows are told apart by 128-bit hashes.
    """
    gram, block = gram or max(1, depth // 2), max(1, min(block, depth // 4))
    scratch = Scratch(docs.sparkSession, "suffix-dedup")
    texts = docs.select(_name(), F.col("text").cast("string").alias("text")).filter(F.octet_length("text") >= depth)
    found = scratch.save(texts.mapInArrow(ragged.tidy(_anchored(depth, gram)), FOUND).withColumn("open", F.lit(True)))
    covered, left = _sorted(found, scratch, depth)
    scratch.drop(found)
    for width in dict.fromkeys((block, 1)):
        lists = left.groupBy("row").agg(F.collect_list(F.struct("low", "high", "anchor", "open")).alias("runs"))
        met = texts.withColumnRenamed("row", "name").join(lists.hint("shuffle_merge"), F.col("name").eqNullSafe(F.col("row"))).select("row", "text", "runs")
        found = scratch.save(met.mapInArrow(ragged.tidy(_divided(depth, width)), f"{FOUND}, open boolean"))
        scratch.drop(left)
        more, left = _sorted(found, scratch, depth)
        scratch.drop(found)
        covered = covered.unionByName(more)
    spans = covered.groupBy("row").agg(F.collect_list(F.struct("start", "end")).alias("todo"))
    named = docs.select(_name().alias("name"), F.struct("*").alias("doc"))
    met = named.join(spans.hint("shuffle_merge"), F.col("name").eqNullSafe(F.col("row")), "left")
    cut = F.arrow_udf(_cut, "spans array<struct<start:int,end:int>>, kept binary").asNondeterministic()
    done = met.select("doc", F.col("doc.text").cast("string").alias("text"), "todo").withColumn("cut", cut("text", "todo"))
    new = ("n_bytes", "spans", "kept")
    return done.select(*(F.col("doc").getField(c).alias(c) for c in docs.columns if c not in new), F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"), "cut.spans", "cut.kept")


def digests(docs: DataFrame, depth: int = DEPTH) -> DataFrame:
    """The result of :func:`dedup_substrings` in figures."""
    gone = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    return dedup_substrings(docs, depth).select("doc_id", "n_bytes", gone.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def oracle(depth: int = DEPTH) -> str:
    """DuckDB SQL for :func:`digests` over ``documents`` with unique ids: all windows of the texts in hexadecimal digits."""
    return f"""with t as (select doc_id, hex(encode(coalesce(text, ''))) x, strlen(coalesce(text, '')) n from documents),
w as (select doc_id, p, md5(substr(x, 2 * p + 1, {2 * depth})) h from (select doc_id, x, unnest(range(n - {depth - 1})) p from t)),
twice as (select h from w group by h having count(*) > 1),
hit as (select doc_id, p from w semi join twice using (h)),
led as (select doc_id, p, p > lag(p) over (partition by doc_id order by p) + {depth} as fresh from hit),
part as (select doc_id, p, sum(case when fresh or fresh is null then 1 else 0 end) over (partition by doc_id order by p) g from led),
span as (select doc_id, min(p) a, max(p) + {depth} b from part group by doc_id, g),
gap as (select doc_id, b as a, lead(a) over (partition by doc_id order by a, b) as b from (select doc_id, a, b from span union all select distinct doc_id, 0, 0 from span)),
kept as (select doc_id, string_agg(substr(x, 2 * a + 1, 2 * (coalesce(b, n) - a)), '' order by a) k from gap join t using (doc_id) group by 1),
sums as (select doc_id, sum(b - a) r, count(*) c from span group by 1)
select doc_id, n n_bytes, cast(coalesce(r, 0) as bigint) n_removed, coalesce(c, 0) n_spans, sha256(unhex(coalesce(k, x))) kept_sha256 from t left join sums using (doc_id) left join kept using (doc_id)"""
