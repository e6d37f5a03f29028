"""Joins that are not plain equalities, and the checks built on semi and anti joins."""

from __future__ import annotations

import itertools
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window, functions as F

from .graphs import connected

DEALT = 4096  # spans of a block of ``overlaps``
BLOCK, TILE = 1 << 14, 1 << 11  # vectors of a block, of a side of a product
PLACES, ROWS = 8, 1 << 17  # positions in a word of ``offset_matches``, prints it takes at a time
FILL = np.uint64(2**64 - 1)


def point_in_interval(points: DataFrame, spans: DataFrame, width: float) -> DataFrame:
    """For ``points(id, t)``, the first of ``spans(span, lo, hi)`` with lo <= t < hi; null if none.

    Spans are dealt over the bins of ``width`` that they cover, points fall into one bin. In the order of (lo, span) only
    spans that reach beyond all before them can be first for a point, from where the one before ends to their own end. These
    stretches do not overlap: one pass over a bin's points and stretches in order finds each point's, and no pair is made.
    """
    dealt = spans.filter("hi > lo").withColumn("bin", F.explode(F.sequence(F.floor(F.col("lo") / width), F.floor(F.col("hi") / width))))
    dealt = dealt.groupBy("bin", "lo", "hi").agg(F.min("span").alias("span"))
    before = Window.partitionBy("bin").orderBy("lo", "span", "hi").rowsBetween(Window.unboundedPreceding, -1)
    reach = dealt.withColumn("reach", F.max("hi").over(before)).filter("reach is null or hi > reach")
    stretch = F.struct("lo", "hi", "span")
    rows = reach.select("bin", F.greatest("lo", "reach").alias("t"), F.lit(0).alias("side"), F.lit(None).cast(points.schema["id"].dataType).alias("id"), stretch.alias("b"))
    p = points.filter("id is not null and t is not null").select(F.floor(F.col("t") / width).alias("bin"), "t", F.lit(1).alias("side"), "id", F.lit(None).cast(rows.schema["b"].dataType).alias("b"))
    last = F.last("b", ignorenulls=True).over(Window.partitionBy("bin").orderBy("t", "side").rowsBetween(Window.unboundedPreceding, 0))
    met = rows.unionByName(p).withColumn("b", last).filter("side = 1 and b.lo <= t and t < b.hi").groupBy("id").agg(F.min(F.struct("b.lo", "b.span")).alias("b"))
    return points.join(met, "id", "left").select("id", "t", F.col("b.span").alias("span"))


def overlaps(spans: DataFrame, width: float) -> DataFrame:
    """Pairs a < b of spans (closed) that overlap.

    The one that starts later starts inside the other. In the order of their starts those that start inside a span are
    neighbours, from its own place to that of its end, so no pair meets in vain. Places are counted within bins, a quarter of
    ``width``, in one pass over starts and ends in order. A bin's starts are cut into blocks of ``DEALT``, held as arrays, and a
    span goes to the blocks it reaches with the first and last place there: what is shuffled is in proportion to the spans and to a
    ``DEALT``-th of the pairs. Blocks are dealt over four times as many tasks as there are shuffle partitions, as their bytes
    say nothing of their work. The spans that go to blocks look small to Spark, so it is told not to broadcast them.
    """
    bin_ = lambda c: F.floor(F.col(c) / (width / 4))
    held = spans.filter("span is not null and lo is not null and hi is not null").select("span", "lo", "hi")
    ends = held.select("*", F.explode(F.when(F.col("lo") <= F.col("hi"), F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("end"))
    ends = ends.withColumn("t", F.when(F.col("end") == 0, F.col("lo")).otherwise(F.col("hi"))).withColumn("bin", bin_("t"))
    upto = Window.partitionBy("bin").orderBy("t", "end", "span", "hi").rowsBetween(Window.unboundedPreceding, 0)
    placed = ends.withColumn("n", F.sum(1 - F.col("end")).over(upto))  # a start's place, and how many start up to an end
    starts = placed.filter("end = 0")
    blocks = starts.withColumn("block", F.expr(f"(n - 1) div {DEALT}")).groupBy("bin", "block").agg(F.array_sort(F.collect_list(F.struct("n", "span", "hi"))).alias("a"), F.max(F.col("lo") > F.col("hi")).alias("back"))
    blocks = blocks.select("bin", "block", F.col("a.span").alias("ids"), F.when(F.col("back"), F.col("a.hi")).alias("his"))  # needed where some end before they begin

    own, last = F.collect_list(F.when(F.col("end") == 0, F.col("n"))), F.max(F.when(F.col("end") == 1, F.col("n")))
    early = placed.filter("lo <= hi").groupBy("span", "lo", "hi").agg(own.alias("own"), last.alias("last"))  # equal spans have places of their own
    early = early.select("span", "lo", "hi", "last", F.explode("own").alias("own")).withColumn("bin", F.explode(F.sequence(bin_("lo"), bin_("hi"))))
    early = early.join(starts.groupBy("bin").agg(F.count("*").alias("many")), "bin")
    first = F.when(F.col("bin") == bin_("lo"), F.col("own")).otherwise(0)
    final = F.when(F.col("bin") == bin_("hi"), F.col("last")).otherwise(F.col("many")) - 1
    early = early.select("bin", F.col("span").alias("y"), "lo", first.alias("i"), final.alias("j")).filter("i <= j").withColumn("block", F.explode(F.expr(f"sequence(i div {DEALT}, j div {DEALT})")))
    early = early.select("bin", "block", "y", "lo", F.expr(f"cast(greatest(i - block * {DEALT}, 0) as int)").alias("i"), F.expr(f"cast(least(j - block * {DEALT}, {DEALT - 1}) as int)").alias("j"))

    tasks = 4 * int(spans.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    met = early.repartition(tasks, "bin", "block").hint("merge").join(blocks.repartition(tasks, "bin", "block"), ["bin", "block"])
    met = met.select("y", "lo", "i", "his", F.posexplode(F.expr("slice(ids, i + 1, j - i + 1)")).alias("k", "x"))  # no lambdas here: they are not compiled
    return met.filter("x <> y and (his is null or lo <= his[i + k])").select(F.expr("if(x < y, x, y)").alias("a"), F.expr("if(x < y, y, x)").alias("b"))


def first_found(keys: DataFrame, key: str, sources: list[DataFrame], value: str) -> DataFrame:
    """The value of the first source that has the key, and which one that was."""
    out = keys
    for i, s in enumerate(sources):
        out = out.join(s.select(key, F.col(value).alias(f"v{i}")), key, "left")
    n = len(sources)
    level = F.lit(None).cast("int")
    for i in reversed(range(n)):
        level = F.when(F.col(f"v{i}").isNotNull(), i).otherwise(level)
    return out.select(key, F.coalesce(*(F.col(f"v{i}") for i in range(n))).alias(value), level.alias("source"))


def missing(expected: DataFrame, present: DataFrame, on: list[str]) -> DataFrame:
    """Expected rows that are not present."""
    return expected.join(present.select(*on).distinct(), on, "left_anti")


def present_only(d: DataFrame, keep: DataFrame, on: str) -> DataFrame:
    """Rows whose key is on a list."""
    return d.join(keep.select(on).distinct(), on, "left_semi")


def _spread(x: np.ndarray) -> np.ndarray:
    """Bits of 64-bit integers spread, without a collision."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _flat(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(ids, their lengths, then for each print the sequence, the position and the hash), some ``ROWS`` prints at a time."""
    for batch in batches:
        edges = np.append(0, np.cumsum(pc.list_value_length(batch.column("a")).to_numpy(zero_copy_only=False)))
        a = 0
        while a < batch.num_rows:
            b = max(a + 1, int(np.searchsorted(edges, edges[a] + ROWS, side="right")) - 1)
            part = batch.slice(a, b - a)
            prints = part.column("a").flatten()
            pos, hash_ = (prints.field(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("pos", "hash"))
            yield part.column("id"), part.column("n").to_numpy(), np.repeat(np.arange(b - a), np.diff(edges[a : b + 1])), pos, hash_.view(np.uint64)
            a = b


def _marks(seq: np.ndarray, pos: np.ndarray, hash_: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A byte 1..254 of each print's hash, and whether its position has several hashes."""
    same = np.append(False, (np.diff(seq) == 0) & (np.diff(pos) == 0))
    return np.uint64(1) + _spread(hash_) % np.uint64(254), same | np.append(same[1:], False)


def _steps(seq: np.ndarray, pos: np.ndarray, reach: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of prints of a sequence at most ``reach`` positions apart, not of one position."""
    i, k = np.arange(len(seq)), 1
    while len(i := i[i + k < len(seq)]):
        i = i[(seq[i + k] == seq[i]) & (pos[i + k] - pos[i] <= reach)]
        apart = i[pos[i + k] > pos[i]]
        yield apart, apart + k
        k += 1


def _keys(hash_: np.ndarray, then: np.ndarray, gap: np.ndarray, bin_: np.ndarray) -> np.ndarray:
    x = _spread(then + _spread(gap.astype(np.uint64)) * (gap > 0))
    return _spread(hash_ + _spread(x + _spread(bin_.astype(np.uint64)))).view(np.int64)


def _blocks(n: np.ndarray, seq: np.ndarray, pos: np.ndarray, least: float, size: int) -> tuple[np.ndarray, ...]:
    """For each print: its block, where that starts, its extent and how many agreements in it decide nothing; whether more can be.

    A block covers ``size`` positions at most. A sequence needs ``m`` agreements, and the m - 1 that are too few
    are shared out over its blocks: where m agree, more than its share do in one block.
    """
    new = np.append(True, np.diff(seq) > 0)
    at = np.flatnonzero(new)
    first, last = pos[at], pos[np.append(at[1:], len(pos)) - 1]
    which = np.cumsum(new) - 1
    m = np.ceil(least * n)
    m = np.where((m - 1) / n >= least, m - 1, np.where(m / n < least, m + 1, m)).astype(np.int64)
    spare = np.maximum(m, 1)[seq] - 1
    extent = (last - first + 1)[which]
    many = -(-extent // size)
    place = pos - first[which]
    block = np.where(extent < 1 << 31, place * np.where(extent < 1 << 31, many, 0) // extent, place // -(-extent // many))
    held = new | np.append(True, np.diff(pos) > 0)  # the first print of a position
    upto = np.cumsum(held)
    before = (upto - held)[at][which]
    cut = np.append(True, (np.diff(which) > 0) | (np.diff(block) > 0))
    start, stop = np.flatnonzero(cut), np.append(np.flatnonzero(cut)[1:], len(pos)) - 1
    mine = np.cumsum(cut) - 1
    total = (upto[np.append(at[1:], len(pos)) - 1] - (upto - held)[at])[which]
    share = spare * (upto[stop][mine] - before) // total - spare * ((upto - held)[start][mine] - before) // total
    return mine, pos[start][mine], (pos[stop] - pos[start])[mine], share, (upto[stop] - (upto - held)[start])[mine] > share


def _gaps(least: float, size: int):  # noqa: ANN202
    """The distances in the keys of :func:`_wanted`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for _, n, seq, pos, _ in _flat(batches):
            if len(pos):
                _, _, extent, share, more = _blocks(n, seq, pos, least, size)
                single = more & (share == 0)
                seen |= ({0} if single.any() else set()) | set(range(1, int((extent // np.maximum(share, 1))[more & ~single].max(initial=0)) + 1))
        yield pa.RecordBatch.from_arrays([pa.array(sorted(seen), pa.int32())], ["gap"])

    return run


def _wanted(offsets: int, least: float, size: int):  # noqa: ANN202
    """Keys of the first's blocks, with the marks of the block and the next in two words, the place in them and how many places must agree.

    Where too many agree for the shares of all blocks, there is a block from which on every sum of neighbouring blocks has more than
    its shares: the one after the last least sum from the start. So a block and the next are judged together, the last alone.
    """
    bins = 2 * offsets + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, n, seq, pos, hash_ in _flat(batches):
            if not len(pos):
                continue
            mark, several = _marks(seq, pos, hash_)
            block, start, extent, share, more = _blocks(n, seq, pos, least, size)
            cut = np.flatnonzero(np.append(True, np.diff(block) > 0))
            inside = np.minimum(pos - start, PLACES - 1)
            low = np.bitwise_or.reduceat(mark << (np.uint64(8) * inside.astype(np.uint64)), cut)
            open_ = np.logical_or.reduceat(several, cut) | (extent[cut] >= PLACES)
            need = np.where(open_, 0, share[cut] + 1)
            away = start[cut[1:]] - start[cut[:-1]]
            two = np.flatnonzero((seq[cut[1:]] == seq[cut[:-1]]) & ~open_[1:] & ~open_[:-1] & (away + extent[cut[1:]] < 2 * PLACES))
            then, away, high = low[two + 1], away[two], np.zeros_like(low)
            byte = lambda n: np.uint64(8) * np.clip(n, 0, PLACES - 1).astype(np.uint64)
            high[two] = np.where(away < PLACES, then >> byte(PLACES - away), then << byte(away - PLACES))
            low[two] |= np.where(away < PLACES, then << byte(away), np.uint64(0))
            need[two] += share[cut[two + 1]]
            low, high, need = low[block], high[block], need[block]
            single = np.flatnonzero(more & (share == 0))
            reach = extent // np.maximum(share, 1)
            for i, j in itertools.chain([(single, single)], _steps(block, pos, int(reach.max()))):
                gap = pos[j] - pos[i]
                ok = more[i] & (gap <= reach[i]) & ((share[i] > 0) == (gap > 0))
                i, j, gap = i[ok], j[ok], gap[ok]
                from_, to = (pos[i] - offsets) // bins, (pos[i] + offsets) // bins
                for bin_, ok in ((from_, from_ == from_), (to, to > from_)):
                    a, b, g = i[ok], j[ok], gap[ok]
                    key = _keys(hash_[a], np.where(g > 0, hash_[b], np.uint64(0)), g, bin_[ok])
                    yield pa.RecordBatch.from_arrays([pa.array(key), ids.take(pa.array(seq[a])), pa.array(pos[a]), pa.array(low[a].view(np.int64)), pa.array(high[a].view(np.int64)), pa.array(inside[a].astype(np.int32)), pa.array(need[a].astype(np.int32))], ["key", "id", "pos", "low", "high", "place", "need"])

    return run


def _offered(offsets: int):  # noqa: ANN202
    """Keys of the others at every position with ``gaps``, with the marks from there on, in two words, and up to there; ``open`` where a mark is not certain."""
    bins = 2 * offsets + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            gaps = np.array(batch.column("gaps")[0].as_py() if batch.num_rows else [], np.int64)
            if len(gaps):
                yield from offered([batch], gaps)

    def offered(batches: Iterable[pa.RecordBatch], gaps: np.ndarray) -> Iterator[pa.RecordBatch]:
        for ids, _, seq, pos, hash_ in _flat(batches):
            if not len(pos):
                continue
            mark, several = _marks(seq, pos, hash_)
            byte = lambda away: np.uint64(8) * away.astype(np.uint64)
            ahead, far, behind, open_ = mark.copy(), np.zeros_like(mark), mark << np.uint64(56), several.copy()
            held, beyond, kept = np.full(len(pos), 255, np.uint64), np.zeros_like(mark), np.full(len(pos), 255 << 56, np.uint64)
            for i, j in _steps(seq, pos, 2 * PLACES - 1):
                open_[i] |= several[j]
                away = pos[j] - pos[i]
                f, g, away_f = i[away >= PLACES], j[away >= PLACES], away[away >= PLACES]
                far[f] |= mark[g] << byte(away_f - PLACES)
                beyond[f] |= np.uint64(255) << byte(away_f - PLACES)
                i, j, away = i[away < PLACES], j[away < PLACES], away[away < PLACES]
                ahead[i] |= mark[j] << byte(away)
                held[i] |= np.uint64(255) << byte(away)
                behind[j] |= mark[i] << byte(PLACES - 1 - away)
                kept[j] |= np.uint64(255) << byte(PLACES - 1 - away)
                open_[j] |= several[i]
            ahead, far, behind = ((x | (y ^ FILL)).view(np.int64) for x, y in ((ahead, held), (far, beyond), (behind, kept)))  # a place without a print agrees with none
            every = np.arange(len(pos))
            for i, j in itertools.chain([(every, every)], _steps(seq, pos, int(gaps.max()))):
                ok = np.isin(pos[j] - pos[i], gaps)
                i, j = i[ok], j[ok]
                gap = pos[j] - pos[i]
                key = _keys(hash_[i], np.where(gap > 0, hash_[j], np.uint64(0)), gap, pos[i] // bins)
                yield pa.RecordBatch.from_arrays([pa.array(key), ids.take(pa.array(seq[i])), pa.array(pos[i]), pa.array(ahead[i]), pa.array(far[i]), pa.array(behind[i]), pa.array(open_[i])], ["key", "other", "p2", "ahead", "far", "behind", "open"])

    return run


def _sequences(prints: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(id, n, a)`` for one of each group of equal sequences, their prints in order, and ``(id, one)`` for all."""
    held = prints.filter("id is not null and pos is not null").groupBy("id").agg(
        F.size(F.collect_set("pos")).alias("n"), F.array_sort(F.collect_set(F.when(F.col("hash").isNotNull(), F.struct(F.col("pos").cast("long").alias("pos"), F.col("hash").cast("long").alias("hash"))))).alias("a")
    )
    firsts = held.groupBy("n", "a").agg(F.min("id").alias("id"))
    return firsts, held.join(firsts.withColumnRenamed("id", "one"), ["n", "a"]).select("id", "one")


def _candidates(mine: DataFrame, theirs: DataFrame, offsets: int, least: float) -> DataFrame:
    """``(id, other, off)`` of sequences ``(id, n, a)`` that may agree at an offset: all that do, and few others."""
    size = max(PLACES, int(1 / least) + 2)
    kind, other = (d.schema["id"].dataType.simpleString() for d in (mine, theirs))
    gaps = mine.mapInArrow(_gaps(least, size), "gap int").agg(F.collect_set("gap").alias("gaps"))  # one row, ``size`` numbers at most
    wanted = mine.mapInArrow(_wanted(offsets, least, size), f"key long, id {kind}, pos long, low long, high long, place int, need int")
    offered = theirs.crossJoin(F.broadcast(gaps)).mapInArrow(_offered(offsets), f"key long, other {other}, p2 long, ahead long, far long, behind long, open boolean")
    met = wanted.hint("merge").join(offered, "key").withColumn("off", F.col("pos") - F.col("p2")).filter(F.abs("off") <= offsets)  # keys look small to Spark
    alike = F.lit(2 * PLACES)
    for word in ("low ^ (shiftleft(ahead, 8 * place) | shiftrightunsigned(behind, 56 - 8 * place))", "high ^ (shiftleft(far, 8 * place) | shiftrightunsigned(shiftrightunsigned(ahead, 8), 56 - 8 * place))"):
        unlike = F.expr(word)
        for k in (4, 2, 1):  # the lowest bit of each byte says whether one is set
            unlike = unlike.bitwiseOR(F.shiftrightunsigned(unlike, k))
        alike -= F.bit_count(unlike.bitwiseAND(F.lit(0x0101010101010101)))
    return met.filter(F.col("open") | (alike >= F.col("need"))).select("id", "other", "off").distinct()


def _agreeing(least: float):  # noqa: ANN202
    """Of candidates with both sequences ``a`` and ``b``, those where enough of a's positions agree, with their share."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            edges = np.append(0, np.cumsum(sum(pc.list_value_length(batch.column(c)).to_numpy(zero_copy_only=False).astype(np.int64) for c in "ab")))
            i = 0
            while i < batch.num_rows:
                j = max(i + 1, int(np.searchsorted(edges, edges[i] + ROWS, side="right")) - 1)
                yield agreeing(batch.slice(i, j - i))
                i = j

    def agreeing(part: pa.RecordBatch) -> pa.RecordBatch:
        sides = []
        for side, c in enumerate("ab"):
            row = np.repeat(np.arange(part.num_rows), pc.list_value_length(part.column(c)).to_numpy(zero_copy_only=False))
            pos, hash_ = (part.column(c).flatten().field(x).to_numpy(zero_copy_only=False).astype(np.int64) for x in ("pos", "hash"))
            sides.append((np.full(len(row), side), hash_, pos + part.column("off").to_numpy()[row] * side, row))
        keys = [np.concatenate(x) for x in zip(*sides)]
        side, hash_, pos, row = (x[order] for order in [np.lexsort(keys)] for x in keys)
        met = np.flatnonzero((row[1:] == row[:-1]) & (pos[1:] == pos[:-1]) & (hash_[1:] == hash_[:-1]) & (side[1:] > side[:-1]))
        row, pos = row[met], pos[met]
        first = np.append(True, (np.diff(row) > 0) | (np.diff(pos) > 0))[: len(row)]
        share = np.bincount(row[first], minlength=part.num_rows) / part.column("n").to_numpy()
        enough = pa.array(np.flatnonzero(share >= least))
        return pa.RecordBatch.from_arrays([part.column("id").take(enough), part.column("other").take(enough), pa.array(share).take(enough)], ["id", "other", "score"])

    return run


def offset_matches(prints: DataFrame, others: DataFrame, offsets: int, least: float) -> DataFrame:
    """Pairs of sequences ``(id, pos, hash)`` whose best alignment within +-offsets agrees in ``least`` of the first's positions.

    Equal sequences are compared once. A single hash may be common, so it is not what is joined on. The first's positions
    are cut into blocks of eight, and where all in all ``least`` agree, more than a block's share does in one block
    (see :func:`_blocks`): usually three or more, of which two are close. The keys are pairs of hashes with their distance;
    single hashes only for blocks whose share is none, mostly those of very short sequences. Keys carry the place in
    bins, so that only what an offset can bring together meets. What meets has words with a byte of each hash of the block and the
    next (see :func:`_wanted`) and of what lies around the other's: where too few bytes are equal it goes before anything is shuffled.
    Candidates, with their offset, are then counted out on the whole sequences. A position may have several hashes, or null, which
    agrees with none; rows without an id or a position are left out.
    """
    mine, all_mine = _sequences(prints)
    theirs, all_theirs = _sequences(others)
    met = _candidates(mine, theirs, offsets, least)
    seen = met.join(mine.select("id", "n", "a").hint("merge"), "id").join(theirs.select(F.col("id").alias("other"), F.col("a").alias("b")).hint("merge"), "other")
    kind, other = (d.schema["id"].dataType.simpleString() for d in (mine, theirs))
    best = seen.select("id", "other", "off", "n", "a", "b").mapInArrow(_agreeing(least), f"id {kind}, other {other}, score double").groupBy("id", "other").agg(F.max("score").alias("score"))
    best = best.select(F.col("id").alias("one"), F.col("other").alias("two"), "score").join(all_mine, "one")
    return best.join(all_theirs.select(F.col("id").alias("other"), F.col("one").alias("two")), "two").select("id", "other", "score")


def unit(vectors: DataFrame) -> DataFrame:
    """``vectors(id, v)`` centred and of length one; those that are null, empty, constant or not finite correlate with none and go."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for d in batches:
            out: dict[str, list] = {"id": [], "v": []}
            for i, v in zip(d["id"], d["v"]):
                x = np.asarray(v, float) - np.mean(v) if v is not None and len(v) else np.zeros(0)
                if x.any() and np.isfinite(x).all():
                    out["id"].append(i)
                    out["v"].append(x / np.linalg.norm(x))
            yield pd.DataFrame(out)

    return vectors.select("id", F.col("v").cast("array<double>").alias("v")).mapInPandas(run, "id long, v array<double>")


def similar_pairs(vectors: DataFrame, least: float = 0.9) -> DataFrame:
    """Pairs ``a < b`` of ``vectors(id, v)`` whose correlation is above ``least``; see :func:`unit` for those that correlate with none."""
    return _close(unit(vectors), least)


def _close(units: DataFrame, least: float) -> DataFrame:
    """Pairs ``a < b`` of ``units(id, v)`` whose product is above ``least``, of equal lengths only.

    All pairs are compared, as random vectors of many numbers have no order that would tell them apart. Vectors are dealt
    into blocks of some ``BLOCK`` by their id; a task holds two blocks and multiplies them tile by tile.
    """
    n = units.count()
    blocks = max(1, -(-n // BLOCK))
    own = F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int")
    dealt = units.select("id", "v", own.alias("own")).withColumn("other", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    dealt = dealt.select("id", "v", "own", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"))

    def compare(t: pa.Table) -> pa.Table:
        i, own = t.column("i")[0].as_py(), t.column("own").to_numpy()
        ids, v = t.column("id").to_numpy(), t.column("v").combine_chunks()
        size = np.asarray(pc.list_value_length(v))
        found = [(np.zeros(0, np.int64),) * 2]
        for k in np.unique(size):
            rows = [np.flatnonzero((size == k) & ((own == i) == mine)) for mine in (True, False)]
            x, y = (np.asarray(v.take(pa.array(r)).flatten(), np.float64).reshape(-1, k) for r in rows)
            same = t.column("j")[0].as_py() == i
            right, y = (rows[0], x) if same else (rows[1], y)
            for a in range(0, len(x), TILE):
                for b in range(a if same else 0, len(y), TILE):
                    p, q = np.nonzero(x[a : a + TILE] @ y[b : b + TILE].T > least)
                    p, q = ids[rows[0][a + p]], ids[right[b + q]]
                    found.append((np.minimum(p, q), np.maximum(p, q)))
        a, b = (np.concatenate(x) for x in zip(*found))
        return pa.table({"a": a[a != b], "b": b[a != b]})

    return dealt.groupBy("i", "j").applyInArrow(compare, "a long, b long").distinct()


def greedy_distinct(vectors: DataFrame, least: float) -> DataFrame:
    """``vectors(id, v)`` in id order, each rejected where it correlates by over ``least`` with an accepted one.

    Of equal vectors the first decides: if it is accepted it rejects the others, if not what rejected it does. So only firsts
    are compared.
    """
    units = unit(vectors).checkpoint()
    firsts = units.groupBy("v").agg(F.min("id").alias("id")).checkpoint()
    kept = greedy_accept(_close(firsts, least).checkpoint(), firsts.select("id"))  # few pairs, used in every round
    copies = units.select("id").join(kept, "id", "left").select("id", F.coalesce("rejected", F.lit(True)).alias("rejected"))
    return vectors.select("id").join(copies, "id", "left").select("id", F.coalesce("rejected", F.lit(False)).alias("rejected"))


def greedy_accept(pairs: DataFrame, items: DataFrame) -> DataFrame:
    """Items in id order, each rejected if a similar earlier one was accepted; ``pairs(a, b)`` with a < b.

    Only items that occur in pairs take part in the fold, one connected group of pairs per task.
    """

    def fold(t: pd.DataFrame) -> pd.DataFrame:
        near: dict[int, list[int]] = {}
        for a, b in zip(t["a"], t["b"]):
            near.setdefault(b, []).append(a)
        out: set[int] = set()
        for b in sorted(near):
            if any(a not in out for a in near[b]):
                out.add(b)
        return pd.DataFrame({"id": sorted(out)})

    group = connected(pairs.select(F.col("a").alias("src"), F.col("b").alias("dst"))).select(F.col("node").alias("a"), F.col("comp").alias("grp"))
    rejected = pairs.join(group, "a").groupBy("grp").applyInPandas(fold, "id long")
    return items.join(rejected.withColumn("rejected", F.lit(True)), "id", "left").select("id", F.coalesce("rejected", F.lit(False)).alias("rejected"))


def as_of(left: DataFrame, right: DataFrame, key: str, at: str, value: str) -> DataFrame:
    """Each left row with the last right value at or before it: union, then the last value so far."""
    both = left.select(key, at, F.lit(1).alias("side"), F.lit(None).cast("double").alias("v"), F.col("id")).unionByName(right.select(key, at, F.lit(0).alias("side"), F.col(value).cast("double").alias("v"), F.lit(None).cast("long").alias("id")))
    w = Window.partitionBy(key).orderBy(at, "side").rowsBetween(Window.unboundedPreceding, 0)
    return both.withColumn("v", F.last("v", ignorenulls=True).over(w)).filter("side = 1").select("id", F.col("v").alias(value))


def allowed(d: DataFrame, column: str, prefixes: list[str]) -> DataFrame:
    """Deny by default: whether a value starts with a listed prefix."""
    hit: Column = F.lit(False)
    for p in prefixes:
        hit = hit | F.col(column).startswith(p)
    return d.withColumn("allowed", hit)
