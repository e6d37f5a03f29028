"""N-gram Jaccard join by token-combination prefixes.

A document is the set of its distinct 5-word shingles. Two documents link when their Jaccard
similarity is at least 0.8; the result says which documents hang together.

1. *Token classes.* Shingles are counted over all documents: each task ships sorted arrays of
   32-bit keys with their counts, split by range. A key with at least ``F`` occurrences is frequent, all others
   are rare. ``F`` is ``least``, doubled until at most 2**21 keys are frequent, which bounds what is broadcast.
2. *Prefixes.* Shingles are ordered rare first, then by hash. Linked sets of size n share at least
   ``t = ceil(0.8 n)`` shingles, so their first common shingle lies within the first ``n - t + 1`` of
   both. If it is rare, a single-token key finds the pair. Otherwise all they share is frequent: the
   prefix is extended to the whole frequent part, which is split by hash into more parts than the
   pair may have differing shingles, so one part is equal in both: the combination of that part's
   tokens is the key. Parts are counted per size class, as linked sizes differ by 1.25 at most. There
   are more parts than the argument asks for, so several keys must be equal; that lets each document
   leave out its most common combinations, and tells pairs apart by the number of equal keys.
3. *Verification* compares whole sets exactly (integer arithmetic). It starts with a star: every
   document is compared with the one centre it shares most keys with, so a group of m copies costs m
   comparisons. Keys whose members already hang together are done. What remains is compared across
   components only: pairs where fewer than ``F`` documents share a key, as is so for every rare one, and
   blocks of documents where more do.

Documents with equal sets are joined beforehand through a 128-bit hash of the set.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from . import ragged
from .components import components
from .scratch import Scratch

FLUSH = 1 << 19
HEAVY = 1 << 21
BLOCK = 1_000_000
LEAST_BITS, MOST_BITS = 1 << 20, 1 << 28
LEVELS, FAMILIES = 12, 1000
MEMBERS = 4096


def size_class(n: np.ndarray | int, ratio: float = 1.25) -> np.ndarray:
    """Class i holds sizes from ratio**i to below ratio**(i+1)."""
    return np.searchsorted(_edges(ratio), n, side="right") - 1


def _edges(ratio: float) -> np.ndarray:
    """Class borders; rounding can put sizes exactly a ratio apart two classes apart, so they are cut a hair early."""
    return ratio ** np.arange(0, 190, dtype=float) * (1 - 1e-9)


def combination_keys(tokens: np.ndarray, n: int, percent: int = 80) -> list[tuple[int, int, int]]:
    """(key, family, need) of the frequent tokens of a set of size ``n``, for the size classes it can meet.

    A linked pair whose common tokens are all frequent has at least ``need`` of a family's keys in
    common. Sizes whose ratio is at least percent/100 are in one class or in neighbours.

    Where no more parts hold tokens than may differ, the guarantee says nothing; such a set splits its
    tokens anew by another hash, level by level. Of a linked pair, either one set has keys enough at a
    level, all made by the other too, or both go on to the next.
    """
    edges, mine, out = _edges(100 / percent), int(size_class(n, 100 / percent)), []
    for family in range(max(0, mine - 1), mine + 1):
        widest = int(np.ceil(edges[family + 2])) - 1
        differ = 2 * widest * (100 - percent) // (100 + percent)
        parts = 1 + differ + differ // 2
        for level in range(LEVELS):
            salt = ragged.U64(family * 0x9E3779B1 + 77 + (level << 40))
            part = (ragged.mix(tokens + salt) % ragged.U64(parts)).astype(np.int64)
            order = np.argsort(part, kind="stable")
            where = np.flatnonzero(np.append(True, np.diff(part[order]) != 0)) if len(order) else np.zeros(0, int)
            if len(where):
                made = np.add.reduceat(ragged.mix(tokens[order] * ragged.STEP + ragged.U64(1)), where)
                key = ragged.mix(made + ragged.mix(part[order][where].astype(ragged.U64) * ragged.BASE + salt))
                out += [(x, family + FAMILIES * level, len(where) - differ) for x in key.tolist()]
            if len(where) > differ:
                break
        else:  # so many tokens fall in so few parts at no level but by a chance of about 10**-11 at most
            out.append((int(ragged.mix(np.array([family + 1], ragged.U64) * ragged.BASE)[0]), family, 0))
    return out


def _sets(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[tuple[int, np.ndarray]]:
    for batch in batches:
        for part in ragged.slices(batch, "text"):
            yield from zip(part.column("doc_id").to_pylist(), ragged.shingle_sets(part.column("text"), k))


def _signatures(docs: DataFrame, k: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [(len(x), hashlib.blake2b(x.tobytes(), digest_size=16).digest()) for part in ragged.slices(batch, "text") for x in ragged.shingle_sets(part.column("text"), k)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([x[0] for x in found], pa.int64()), pa.array([x[1] for x in found], pa.binary())], ["doc_id", "n_shingles", "sig"])

    return docs.select("doc_id", "text").mapInArrow(ragged.tidy(run), "doc_id long, n_shingles long, sig binary")


def _frequent(docs: DataFrame, k: int, total: int, least: int, scratch: Scratch) -> tuple[np.ndarray, int]:
    """The sorted 32-bit keys that at least F documents have, and F.

    F follows the keys found, not the size of the corpus: were it to grow with that, so would the number of
    documents that share a rare key.
    """
    ranges = max(1, -(-total // (1 << 20)))
    width = -(-(1 << 32) // ranges)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for _, x in _sets(batches, k):
            held.append((x >> np.uint64(32)).astype(np.uint32))
            size += len(x)
            if size >= FLUSH:
                yield flush(held)
                held, size = [], 0
        if size:
            yield flush(held)

    def flush(held: list[np.ndarray]) -> pa.RecordBatch:
        keys = np.sort(np.concatenate(held))
        at = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
        many = np.diff(np.append(at, len(keys))).astype(np.uint32)
        keys = keys[at]
        cut = np.searchsorted(keys, np.arange(ranges + 1, dtype=np.uint64) * np.uint64(width))
        cut[-1] = len(keys)
        blobs = [(ragged.planes(np.diff(keys[a:b], prepend=np.uint32(0))), ragged.planes(many[a:b])) if b > a else (None, None) for a, b in zip(cut[:-1], cut[1:])]
        return pa.RecordBatch.from_arrays([pa.array(range(ranges), pa.int32()), *(pa.array([x[i] for x in blobs], pa.binary()) for i in (0, 1))], ["range", "keys", "counts"])

    def heavy(table: pa.Table) -> pa.Table:
        keys = np.concatenate([np.cumsum(ragged.unplanes(x, np.uint32), dtype=np.uint32) for x in table.column("keys").to_pylist()])
        many = np.concatenate([ragged.unplanes(x, np.uint32) for x in table.column("counts").to_pylist()])
        order = np.argsort(keys)
        keys, many = keys[order], many[order].astype(np.int64)
        at = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
        many = np.add.reduceat(many, at)
        often = many >= least
        return pa.table({"key": pa.array(keys[at[often]].astype(np.int64)), "n": pa.array(many[often])})

    counted = docs.select("doc_id", "text").mapInArrow(ragged.tidy(count), "range int, keys binary, counts binary").filter("keys is not null")
    found = scratch.save(counted.groupBy("range").applyInArrow(heavy, "key long, n long"))
    bound = least
    while found.filter(F.col("n") >= bound).count() > HEAVY:
        bound *= 2
    keys = found.filter(F.col("n") >= bound).select("key").toArrow()
    scratch.drop(found)
    return np.sort(keys.column("key").to_numpy().astype(np.uint32)), bound


def _index(docs: DataFrame, k: int, percent: int, heavy: np.ndarray, total: int) -> tuple[DataFrame, DataFrame]:
    """Rows (key, doc_id, n): of rare keys that several documents have, and of combination keys."""
    ranges = max(1, -(-total * (100 - percent) // 100 // (1 << 18)))
    table = docs.sparkSession.sparkContext.broadcast(heavy)

    def split(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
        h, keys = table.value, (x >> np.uint64(32)).astype(np.uint32)
        often = h[np.minimum(np.searchsorted(h, keys), len(h) - 1)] == keys if len(h) else np.zeros(len(x), bool)
        return x[~often], x[often], len(x) - (percent * len(x) + 99) // 100 + 1

    def rare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, ids, size, done = [], [], 0, set()
        for doc, x in _sets(batches, k):
            if len(x) and (same := hash(x.tobytes())) not in done:
                done.add(same)
                few, _, prefix = split(x)
                keys.append(few[:prefix])
                ids.append((doc, len(x), len(keys[-1]), len(x) - len(keys[-1])))
                size += len(keys[-1])
            if size >= FLUSH:
                yield flush(keys, ids)
                keys, ids, size, done = [], [], 0, set()
        if size:
            yield flush(keys, ids)

    def flush(keys: list[np.ndarray], ids: list[tuple[int, int, int, int]]) -> pa.RecordBatch:
        key, (doc, n, many, rest) = np.concatenate(keys), np.array(ids, np.int64).T
        slot = (key >> np.uint64(32)) * np.uint64(ranges) >> np.uint64(32)
        order = np.lexsort((key, slot))
        key, slot = key[order], slot[order]
        doc, n, rest = np.repeat(doc, many)[order], np.repeat(n, many)[order].astype(np.uint32), np.repeat(rest, many)[order].astype(np.uint32)
        cut = np.searchsorted(slot, np.arange(ranges + 1, dtype=np.uint64))
        cols = [[ragged.planes(c[a:b]) if b > a else None for a, b in zip(cut[:-1], cut[1:])] for c in (key, doc, n, rest)]
        return pa.RecordBatch.from_arrays([pa.array(range(ranges), pa.int32()), *(pa.array(c, pa.binary()) for c in cols)], ["range", "keys", "docs", "ns", "rests"])

    def several(table: pa.Table) -> pa.Table:
        key, doc, n, rest = (np.concatenate([ragged.unplanes(x, t) for x in table.column(c).to_pylist()]) for c, t in (("keys", np.uint64), ("docs", np.int64), ("ns", np.uint32), ("rests", np.uint32)))
        order = np.argsort(key, kind="stable")
        key = key[order]
        same = key[1:] == key[:-1]
        keep = np.append(same, False) | np.append(False, same)
        return pa.table({"key": key[keep].view(np.int64), "doc_id": doc[order][keep], "n": n[order][keep].astype(np.int64), "family": np.full(keep.sum(), -1, np.int32), "need": rest[order][keep].astype(np.int64)})

    def combos(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, doc, size, done = [], [], [], set()
        for d, x in _sets(batches, k):
            few, often, prefix = split(x)
            if len(x) and len(few) < prefix and (same := hash(x.tobytes())) not in done:
                done.add(same)
                made = combination_keys(often, len(x), percent)
                key += made
                doc += [d] * len(made)
                size += [len(x)] * len(made)
            if len(key) >= FLUSH // 4:
                yield rows(key, doc, size)
                key, doc, size, done = [], [], [], set()
        if key:
            yield rows(key, doc, size)

    def rows(key: list[tuple[int, int, int]], doc: list[int], size: list[int]) -> pa.RecordBatch:
        name, family, need = ([k[i] for k in key] for i in range(3))
        return pa.RecordBatch.from_arrays([pa.array(np.array(name, np.uint64).view(np.int64)), pa.array(doc, pa.int64()), pa.array(size, pa.int64()), pa.array(family, pa.int32()), pa.array(need, pa.int64())], ["key", "doc_id", "n", "family", "need"])

    text = docs.select("doc_id", "text")
    out = "key long, doc_id long, n long, family int, need long"
    singles = text.mapInArrow(ragged.tidy(rare), "range int, keys binary, docs binary, ns binary, rests binary").filter("keys is not null").groupBy("range").applyInArrow(several, out)
    return singles, text.mapInArrow(ragged.tidy(combos), out) if len(heavy) else None


def _rarest(rows: DataFrame) -> DataFrame:
    """Combination keys without the most common ones of each document and family: half of ``need``.

    What a linked pair has in common is cut from its common end, so at least the other half of the
    keys they need stays. Keys that stand for a passage which many documents have go this way.
    """
    common = rows.groupBy("key").agg(F.count("*").alias("docs")).filter("docs > 1")
    order = Window.partitionBy("doc_id", "family").orderBy(F.desc("docs"), "key")
    ranked = rows.join(common, "key", "left").withColumn("at", F.row_number().over(order))
    spare = F.greatest(F.col("need"), F.lit(0)) / 2
    return ranked.filter((F.col("docs") > 1) & (F.col("at") > F.floor(spare))).select("key", "doc_id", "n", "family", (F.col("need") - F.floor(spare)).alias("need"))


def _bitmap(ids: DataFrame) -> np.ndarray:
    """Bits of all ids, some sixteen an id up to 32 MB; more ids make more false hits, never a miss."""
    size = min(MOST_BITS, max(LEAST_BITS, 1 << (16 * ids.count()).bit_length()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = _bits(np.asarray(batch.column(0), np.int64), size)
            order = np.argsort(at)
            word, bit = at[order] >> 6, np.uint64(1) << (at[order] & 63).astype(np.uint64)
            if len(word):
                where = np.flatnonzero(np.append(True, word[1:] != word[:-1]))
                yield pa.RecordBatch.from_arrays([pa.array(word[where]), pa.array(np.bitwise_or.reduceat(bit, where).view(np.int64))], ["word", "bits"])

    got = ids.mapInArrow(ragged.tidy(run), "word long, bits long").groupBy("word").agg(F.bit_or("bits").alias("bits")).toArrow()
    out = np.zeros(size // 64, np.int64)
    out[got.column("word").to_numpy()] = got.column("bits").to_numpy()
    return out.view(np.uint64)


def _bits(ids: np.ndarray, size: int) -> np.ndarray:
    return (ragged.mix(ids.view(np.uint64) + np.uint64(12345)) % np.uint64(size)).astype(np.int64)


def _tokens(docs: DataFrame, bitmap: np.ndarray, k: int) -> DataFrame:
    """(doc_id, n, tokens) of the documents whose id the bitmap has."""
    table = docs.sparkSession.sparkContext.broadcast(bitmap)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = _bits(np.asarray(batch.column("doc_id"), np.int64), 64 * len(table.value))
            has = (table.value[at >> 6] >> (at & 63).astype(np.uint64)) & np.uint64(1) == 1
            for part in ragged.slices(batch.filter(pa.array(has)), "text"):
                sets = list(ragged.shingle_sets(part.column("text"), k))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array([x.tobytes() for x in sets], pa.binary())], ["doc_id", "tokens"])

    return docs.select("doc_id", "text").mapInArrow(ragged.tidy(run), "doc_id long, tokens binary")


def _verify(pairs: DataFrame, tokens: DataFrame, percent: int) -> DataFrame:
    """Those of ``pairs(a, b)`` whose sets are similar enough; a is a star's centre, b its member.

    Members stream past their centre in sorted partitions, so a task holds one centre at a time;
    a centre is dealt out by a salt, one for each ``MEMBERS`` members.
    """
    many = pairs.groupBy("a").agg(F.ceil(F.count("*") / MEMBERS).alias("salts"))
    some = pairs.join(many, "a").select("a", "b", F.pmod(F.xxhash64("b"), "salts").alias("salt"))
    members = some.join(tokens.select(F.col("doc_id").alias("b"), "tokens"), "b").select("a", "salt", F.lit(1).alias("kind"), "b", "tokens")
    centres = some.select("a", "salt").distinct().join(tokens.select(F.col("doc_id").alias("a"), "tokens"), "a").select("a", "salt", F.lit(0).alias("kind"), F.col("a").alias("b"), "tokens")
    both = members.unionByName(centres).repartition("a", "salt").sortWithinPartitions("a", "salt", "kind")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held = None, []
        for batch in batches:
            out = []
            raw, cols = batch.column("tokens"), [batch.column(c).to_pylist() for c in ("a", "salt", "kind", "b")]
            for a, salt, kind, b, x in zip(*cols, raw):
                x = np.frombuffer(x.as_buffer(), np.uint64)
                if kind == 0:
                    held = held + [x] if at == (a, salt) else [x]
                    at = (a, salt)
                    continue
                for y in held if at == (a, salt) else []:
                    i, j = (x, y) if len(x) <= len(y) else (y, x)
                    common = int(np.count_nonzero(j[np.minimum(np.searchsorted(j, i), len(j) - 1)] == i))
                    if common and 100 * common >= percent * (len(x) + len(y) - common):
                        out.append((a, b))
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], pa.int64()) for i in (0, 1)], ["a", "b"])

    return both.mapInArrow(ragged.tidy(run), "a long, b long").distinct()


def ngram_components(docs: DataFrame, k: int = 5, percent: int = 80, least: int = 64) -> DataFrame:
    """One row per row of ``docs(doc_id, text)``: doc_id, n_shingles, component_id.

    ``component_id`` is the smallest doc_id reachable over links, the document's own included.

    * Null or empty text, or text of separators only: n_shingles 0, linked with nothing.
    * A null doc_id names no document: component_id is null and the row links with nothing.
    * Ties: of equally good centres the largest id is taken; links and components do not depend on it.
    * Repeated rows: each is returned; rows with one id are one document, linked if any text is.
    * Extra columns of ``docs``, whatever their names, are ignored; an empty table gives an empty result.
    * Texts are read whole. 64-bit hashes stand for shingles.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "ngram-join")
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    known = base.filter("doc_id is not null")
    rows = scratch.save(_signatures(base, k))
    real = rows.filter("doc_id is not null and n_shingles > 0")
    firsts = real.groupBy("sig").agg(F.min("doc_id").alias("rep"), F.count("*").alias("copies"))
    total = real.agg(F.sum("n_shingles")).first()[0] or 0
    copies = scratch.save(real.select("doc_id", "sig").join(firsts.filter("copies > 1"), "sig").select("doc_id", "rep").filter("doc_id <> rep").distinct())

    heavy, bound = _frequent(known, k, total, least, scratch) if total else (np.zeros(0, np.uint32), least)
    singles, combos = _index(known, k, percent, heavy, total)
    firsts_only = lambda part: part.join(copies, "doc_id", "left").select("key", F.coalesce("rep", "doc_id").alias("doc_id"), "n", "family", "need").distinct()
    members = firsts_only(singles)
    if combos is not None:
        members = members.unionByName(_rarest(scratch.save(firsts_only(combos))))
    members = scratch.save(members)
    del singles, combos
    edges = [copies.select(F.col("doc_id").alias("a"), F.col("rep").alias("b"))]
    edges += _links(known, members, k, percent, bound, scratch)
    scratch.drop(members)
    comp = scratch.save(components(_union(edges), scratch))
    return rows.join(comp.withColumnRenamed("node", "doc_id"), "doc_id", "left").select("doc_id", "n_shingles", F.coalesce("comp", "doc_id").alias("component_id"))


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def _links(docs: DataFrame, members: DataFrame, k: int, percent: int, bound: int, scratch: Scratch) -> list[DataFrame]:
    """Edges enough to connect all that links connect, among the members of common keys.

    Keys of ``bound`` documents or more are hot. Tokens are made for the documents that a step compares, and dropped after it.
    """
    fields = (("doc_id", "d"), ("size", "s"), ("need", "n"), ("comp", "c"))
    side = lambda x: [F.col(c).alias(y + x) for c, y in fields]

    def pairs(met: DataFrame) -> DataFrame:
        """Pairs that share as many keys as their sizes ask for, with that number."""
        close = 100 * F.least("sa", "sb") >= percent * F.greatest("sa", "sb")  # before they are counted, as most pairs are not
        shared = met.filter(close).groupBy("da", "db", "family").agg(F.count("*").alias("keys"), *(F.first(c).alias(c) for c in ("sa", "sb", "na", "nb")))
        least = F.expr(f"({percent} * (sa + sb) + {99 + percent}) div {100 + percent}") - F.greatest("na", "nb")
        enough = F.col("keys") >= F.when(F.col("family") < 0, least).otherwise(F.greatest("na", "nb"))
        return shared.filter(enough).groupBy(F.col("da").alias("a"), F.col("db").alias("b")).agg(F.sum("keys").alias("keys"))

    rows = members.withColumnRenamed("n", "size").withColumn("comp", F.col("doc_id"))
    centres = rows.groupBy("key", "family").agg(F.count("*").alias("m"), F.min(F.struct(*side("a"))).alias("c")).filter("m > 1").select("key", "family", "c.*")
    met = rows.select("key", "family", *side("b")).join(centres, ["key", "family"]).filter("da <> db")
    star = scratch.save(pairs(met).groupBy("b").agg(F.max_by("a", F.struct("keys", "a")).alias("a")).select("a", "b"))
    both = lambda p: p.select(F.col("a").alias("doc_id")).union(p.select("b"))
    found = [_checked(star, docs, k, percent, both(star), scratch)]

    del met
    comp = scratch.save(components(found[0], scratch)).select(F.col("node").alias("doc_id"), F.col("comp").alias("c"))
    now = rows.drop("comp").join(comp, "doc_id", "left").withColumn("comp", F.coalesce("c", "doc_id")).drop("c")
    keys = now.groupBy("key", "comp").agg(F.count("*").alias("m")).groupBy("key").agg(F.count("*").alias("comps"), F.sum("m").alias("m")).filter("comps > 1")
    live = scratch.save(now.join(keys.select("key", (F.col("m") >= bound).alias("hot")), "key"))
    cold = live.filter("not hot")
    met = cold.select("key", "family", *side("a")).join(cold.select("key", "family", *side("b")), ["key", "family"]).filter("ca < cb")
    rest = scratch.save(pairs(met).select("a", "b"))
    del met, now, keys
    found.append(_checked(rest, docs, k, percent, both(rest), scratch))
    hot = live.filter("hot")
    if hot.limit(1).count():
        tokens = scratch.save(_tokens(docs, _bitmap(hot.select("doc_id")), k))
        found.append(scratch.save(_blocks(hot, tokens, percent, scratch)))
        scratch.drop(tokens)
    scratch.drop(live, star, rest)
    return found


def _checked(pairs: DataFrame, docs: DataFrame, k: int, percent: int, ids: DataFrame, scratch: Scratch) -> DataFrame:
    """The linked ones of ``pairs``, saved."""
    tokens = scratch.save(_tokens(docs, _bitmap(ids), k))
    linked = scratch.save(_verify(pairs, tokens, percent))
    scratch.drop(tokens)
    return linked


def _blocks(hot: DataFrame, tokens: DataFrame, percent: int, scratch: Scratch) -> DataFrame:
    """Edges between components among documents that common keys hold in large numbers.

    Documents that share such keys form clusters. In each, what lies outside its largest component
    is compared with all its documents, block by block, through an inverted index of the block's
    tokens; a block holds a bounded number of tokens. One edge per pair of components leaves a block.
    """
    spokes = hot.groupBy("key").agg(F.min("doc_id").alias("a"))
    docs = hot.select("doc_id", "comp", "size").distinct()
    cluster = scratch.save(components(hot.join(spokes, "key").select("a", F.col("doc_id").alias("b")).distinct(), scratch)).select(F.col("node").alias("doc_id"), F.col("comp").alias("cluster"))
    docs = scratch.save(docs.join(cluster, "doc_id"))
    largest = docs.groupBy("cluster", "comp").agg(F.count("*").alias("m")).groupBy("cluster").agg(F.max_by("comp", F.struct("m", "comp")).alias("main"))
    out = F.col("comp") != F.col("main")
    split = docs.join(largest, "cluster").groupBy("cluster", "main").agg(*(F.ceil(x / BLOCK).alias(c) for c, x in (("rs", F.sum("size")), ("qs", F.sum(F.when(out, F.col("size")).otherwise(0))))))
    dealt = docs.join(split, "cluster")
    own = lambda n: F.pmod(F.xxhash64("doc_id"), F.greatest(F.col(n), F.lit(1)))
    asks = dealt.filter(out).select("cluster", own("qs").alias("q"), F.explode(F.sequence(F.lit(0), F.col("rs") - 1)).alias("r"), F.lit(1).alias("ask"), "doc_id", "comp")
    given = dealt.filter("qs > 0").select("cluster", F.explode(F.sequence(F.lit(0), F.col("qs") - 1)).alias("q"), own("rs").alias("r"), F.lit(0).alias("ask"), "doc_id", "comp")

    def compare(table: pa.Table) -> pa.Table:
        ask, doc, comp = (table.column(c).to_numpy() for c in ("ask", "doc_id", "comp"))
        sets = [np.frombuffer(x.as_buffer(), np.uint64) for x in table.column("tokens").combine_chunks()] if table.num_rows else []
        size = np.array([len(x) for x in sets], np.int64)
        rs, edges, done = np.flatnonzero(ask == 0), [], set()
        if len(rs):
            flat, who = np.concatenate([sets[i] for i in rs]), np.repeat(np.arange(len(rs)), size[rs])
            order = np.argsort(flat, kind="stable")
            flat, who = flat[order], who[order]
            for q in np.flatnonzero(ask == 1):
                low, high = np.searchsorted(flat, sets[q]), np.searchsorted(flat, sets[q], side="right")
                many = high - low
                at = np.arange(many.sum()) + np.repeat(low - (np.cumsum(many) - many), many)
                common = np.bincount(who[at], minlength=len(rs))
                for r in rs[np.flatnonzero((100 * common >= percent * (size[rs] + size[q] - common)) & (common > 0) & (comp[rs] != comp[q]))]:
                    if (comp[q], comp[r]) not in done:
                        done.add((comp[q], comp[r]))
                        edges.append((doc[q], doc[r]))
        return pa.table({"a": pa.array([int(a) for a, _ in edges], pa.int64()), "b": pa.array([int(b) for _, b in edges], pa.int64())})

    return asks.unionByName(given).join(tokens, "doc_id").groupBy("cluster", "q", "r").applyInArrow(compare, "a long, b long")
