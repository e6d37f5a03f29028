"""Quality rules: counts per text, and bands on the perplexity of a Kneser-Ney model per language.

The model predicts bytes from the five before them, so every script keeps its letters. Spark counts the
six-byte sequences of all documents; those that read like prose (they pass the counts below, at most 2 %
of the characters in words are of ``#*$%&|<>``, at most 30 % capitals) teach the model, so that it does
not learn junk. The tables of counts grow with what the corpus holds and stay in Spark: each level's
modified Kneser-Ney estimate (three discounts) is a window over the at most 256 continuations of a
context and a join with the level below.

The result, one log probability per sequence that occurs anywhere, is stored as arrays sorted by hash,
in which a task looks its sequences up. They are broadcast while they hold at most ``MOST`` sequences;
beyond that nothing is broadcast, and the documents' distinct sequences join the table.

Each group then gets a lower and an upper band around the median of its documents' perplexity; documents
outside are rejected. The band of a document is wider by ``SURPRISE / sqrt(bytes)``, as the mean over a
short text strays further.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, Window, functions as F

from . import ragged
from .scratch import Scratch

LANGUAGES = ("de", "en", "es", "fr")
MOST_GROUPS, LEAST_ROWS = 24, 10
ORDER, BYTES, GROUP = 6, 256, 48
HELD = 1 << 20
BLOCK = 1 << 18
MOST = 1 << 23
SPREADS, LEAST_BELOW, LEAST_ABOVE, SURPRISE, STEP = 6.0, 0.15, 0.7, 4.0, 0.005
MOST_SYMBOLS, MOST_CAPITALS = 0.02, 0.3
STATS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
LOOK = np.zeros(256, bool)
LOOK[list(b"#*$%&|<>")] = True


def text_counts(col: pa.Array) -> dict[str, np.ndarray]:
    """The five counts of each text; see the package's query op3 for what they mean."""
    data, offs = ragged.utf8(col)
    w = ragged.Words(data, offs)
    n, texts = np.diff(w.first), len(offs) - 1
    per_text = lambda flag: np.diff(np.append(0, np.cumsum(flag))[offs])
    out = {"n_words": n, "word_chars": per_text(((data & 0xC0) != 0x80) & ~ragged.SPACE[data]), "n_symbols": per_text(LOOK[data]), "n_capitals": per_text((data >= 65) & (data <= 90))}

    ends = np.sort(np.concatenate([np.flatnonzero(w.buf == 10), w.text_start + np.diff(offs)]))
    starts = np.concatenate([[0], ends[:-1] + 1]) if len(ends) else ends
    text = np.searchsorted(w.text_start, starts, side="right") - 1
    some = np.searchsorted(w.start, ends) > np.searchsorted(w.start, starts)
    key = ragged.mix(ragged.span_hashes(w.buf, starts, ends)[some] + text[some].astype(np.uint64) * ragged.STEP)
    order = np.argsort(key)
    again = np.append(False, key[order][1:] == key[order][:-1]) if len(key) else np.zeros(0, bool)
    out["n_dup_lines"] = np.bincount(text[some][order][again], minlength=texts)

    h, count = w.hashes(lower=False), len(w.start)
    covered = np.zeros(count, bool)
    if count >= 8:
        m = count - 7
        full = np.zeros(m, np.uint64)
        for j in range(8):
            full = full * ragged.STEP + h[j : j + m]
        owner = np.repeat(np.arange(texts), n)
        inside = np.flatnonzero(owner[:m] == owner[7:])
        key = ragged.mix(full[inside] + owner[inside].astype(np.uint64) * ragged.BASE)
        order = np.argsort(key)
        same = key[order][1:] == key[order][:-1]
        twice = inside[order[np.append(same, False) | np.append(False, same)]]
        edge = np.zeros(count + 1, np.int64)
        np.add.at(edge, twice, 1)
        np.add.at(edge, twice + 8, -1)
        covered = np.cumsum(edge)[:-1] > 0
    out["n_repeat_words"] = np.diff(np.append(0, np.cumsum(covered))[w.first])
    return out


def failed(counts: dict[str, np.ndarray]) -> np.ndarray:
    return (counts["n_words"] < 20) | (100 * counts["n_repeat_words"] > 30 * counts["n_words"])


def prose(counts: dict[str, np.ndarray]) -> np.ndarray:
    """Which texts the model learns from."""
    odd = (counts["n_symbols"] > MOST_SYMBOLS * counts["word_chars"]) | (counts["n_capitals"] > MOST_CAPITALS * counts["word_chars"])
    return ~failed(counts) & ~odd


def sequences(col: pa.Array, group: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The packed sequences of all texts with their row's group, and the row of each, in runs of bounded size."""
    data, offs = ragged.utf8(col)
    for a in range(0, len(data), BLOCK):
        part = data[a : a + BLOCK + ORDER - 1].astype(np.int64)
        key = np.zeros(max(0, len(part) - ORDER + 1), np.int64)
        for j in range(ORDER):
            key = key << 8 | part[j : j + len(key)]
        cut = np.clip(offs, a, a + len(key))
        row = np.repeat(np.arange(len(offs) - 1), np.diff(cut))
        inside = np.arange(a, a + len(key)) + ORDER <= np.repeat(offs[1:], np.diff(cut))
        row = row[inside]
        yield key[inside] | group[row] << GROUP, row


def groups(col: pa.Array, names: tuple[str | None, ...] = LANGUAGES) -> np.ndarray:
    """The number of each row's language group; the last is for all values not in ``names``."""
    place = {x: i for i, x in enumerate(names)}
    return np.array([place.get(x, len(names)) for x in col.to_pylist()], np.int64)


def languages(docs: DataFrame) -> tuple[str | None, ...]:
    """The values of ``lang``, null among them, that have a model of their own; all others are pooled.

    They are the ``MOST_GROUPS`` most frequent ones with at least ``LEAST_ROWS`` rows, in order, null last.
    """
    found = docs.groupBy("lang").agg(F.count("*").alias("n")).filter(F.col("n") >= LEAST_ROWS).orderBy(F.desc("n"), "lang").limit(MOST_GROUPS).collect()
    return tuple(sorted((r["lang"] for r in found), key=lambda x: (x is None, x or "")))


def _merge(held: list[tuple[np.ndarray, np.ndarray]]) -> None:
    """Make one pair of arrays, sorted keys and their sums, of all; each part is let go as soon as it is copied."""
    key, n = [k for k, _ in held], [m for _, m in held]
    held.clear()
    key = np.concatenate(key)
    order = np.argsort(key)
    key = key[order]
    n = np.concatenate(n)[order]
    del order
    at = np.flatnonzero(np.append(True, key[1:] != key[:-1])) if len(key) else np.zeros(0, int)
    key = key[at]
    held.append((key, np.add.reduceat(n, at) if len(at) else n))


def _dealt(key: np.ndarray, n: np.ndarray, parts: int) -> pa.RecordBatch:
    """(part, run): sorted keys dealt out by their first four bytes, so that neighbours stay together, as differences with counts."""
    part = (ragged.mix((key >> 16).astype(np.uint64)) % np.uint64(parts)).astype(np.int32)
    order = np.argsort(part, kind="stable")
    part, key, n = part[order], key[order], n[order].astype(np.uint32)
    start = np.flatnonzero(np.append(True, part[1:] != part[:-1])) if len(part) else np.zeros(0, int)
    runs = [ragged.planes(np.diff(key[a:b], prepend=0)) + ragged.planes(n[a:b]) for a, b in zip(start.tolist(), [*start[1:].tolist(), len(key)])]
    return pa.RecordBatch.from_arrays([pa.array(part[start]), pa.array(runs, pa.binary())], ["part", "run"])


def _run(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    """The keys and counts of a run."""
    many = len(raw) // 12
    return np.cumsum(ragged.unplanes(raw[: 8 * many], np.int64)), ragged.unplanes(raw[8 * many :], np.uint32).astype(np.int64)


def count_sequences(docs: DataFrame, names: tuple[str | None, ...] = LANGUAGES) -> DataFrame:
    """(key, n) of every sequence of every group: how often prose has it, 0 where only other documents do.

    Tasks add up what they have read in a buffer of fixed size and ship it as runs of a few bytes a sequence, dealt out over
    four times as many parts as there are shuffle partitions; a task of the second stage adds up the sequences of its parts.
    """
    parts = 4 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        for batch in batches:
            for part in ragged.slices(batch, "text"):
                learn = prose(text_counts(part.column("text")))
                for key, row in sequences(part.column("text"), groups(part.column("lang"), names)):
                    order = np.argsort(key)
                    key, n = key[order], np.append(0, np.cumsum(learn[row][order].astype(np.int64)))
                    at = np.flatnonzero(np.append(True, key[1:] != key[:-1])) if len(key) else np.zeros(0, int)
                    held.append((key[at], np.diff(n[np.append(at, len(key))]).astype(np.int32)))
                if sum(len(k) for k, _ in held) > HELD:
                    _merge(held)
                    if len(held[0][0]) > HELD // 2:
                        yield _dealt(*held.pop(), parts)
        if held:
            _merge(held)
            yield _dealt(*held.pop(), parts)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        settled = 0
        for batch in batches:
            for raw in batch.column("run"):
                held.append(_run(raw.as_buffer().to_pybytes()))
                if sum(len(k) for k, _ in held) > 2 * settled + BLOCK:
                    _merge(held)
                    settled = len(held[0][0])
        if held:
            _merge(held)
            key, n = held.pop()
            for a in range(0, len(key), 1 << 16):
                yield pa.RecordBatch.from_arrays([pa.array(key[a : a + (1 << 16)]), pa.array(n[a : a + (1 << 16)])], ["key", "n"])

    counted = docs.select("lang", "text").mapInArrow(ragged.tidy(run), "part int, run binary")
    return counted.repartition("part").mapInArrow(ragged.tidy(add), "key long, n long")


def discounts(n1: float, n2: float, n3: float, n4: float) -> list[float]:
    """What is taken off counts of 1, 2 and more; a half where the counts of counts say nothing."""
    y = n1 / (n1 + 2 * n2) if n1 + n2 else 0.5
    return [min(max(i - (i + 1) * y * b / a, 0.1), i - 0.1) if a and b else 0.5 for i, a, b in ((1, n1, n2), (2, n2, n3), (3, n3, n4))]


def kneser_ney(counted: DataFrame, scratch: Scratch) -> DataFrame:
    """(key, log_p) for every sequence of ``counted(key, n)``; groups of which no sequence is counted have none."""
    group = F.shiftright("key", GROUP)
    low = lambda c, width: F.shiftleft(F.shiftright(c, GROUP), GROUP) + F.col(c).bitwiseAND(F.lit((1 << 8 * width) - 1))
    levels = {ORDER: scratch.save(counted)}
    for width in range(ORDER - 1, 0, -1):
        levels[width] = scratch.save(levels[width + 1].groupBy(low("key", width).alias("key")).agg(F.count_if(F.col("n") > 0).alias("n")))
    few = None
    for width, level in levels.items():
        part = level.filter("n between 1 and 4").groupBy(F.lit(width).alias("width"), group.alias("g"), "n").agg(F.count("*").alias("m"))
        few = part if few is None else few.unionByName(part)
    found = {(r["width"], r["g"], r["n"]): float(r["m"]) for r in few.collect()}
    learnt = sorted({g for _, g, _ in found} | {r[0] for r in levels[1].filter("n > 0").select(group).distinct().collect()})
    if not learnt:
        return counted.limit(0).select("key", F.lit(0.0).alias("log_p"))
    lower: DataFrame | None = None
    for width in range(1, ORDER + 1):
        cuts = [F.array(*(F.lit(x) for x in discounts(*(found.get((width, g, n), 0.0) for n in (1, 2, 3, 4))))) for g in learnt]
        table = F.map_from_arrays(F.array(*(F.lit(g) for g in learnt)), F.array(*cuts))
        cut = F.when(F.col("n") > 0, F.element_at(F.element_at(table, group), F.least("n", F.lit(3)).cast("int"))).otherwise(0.0)
        context = Window.partitionBy(F.shiftright("key", GROUP), F.shiftright(F.col("key").bitwiseAND(F.lit((1 << 8 * width) - 1)), 8))
        now = levels[width].filter(group.isin(learnt)).withColumn("cut", cut).select("key", "n", "cut", F.sum("n").over(context).alias("total"), F.sum("cut").over(context).alias("left"))
        if lower is None:
            now = now.withColumn("q", F.lit(1.0 / BYTES))
        else:
            now = now.withColumn("suffix", low("key", width - 1)).join(lower.select(F.col("key").alias("suffix"), F.col("p").alias("q")), "suffix")
        p = F.when(F.col("total") > 0, (F.col("n") - F.col("cut") + F.col("left") * F.col("q")) / F.col("total")).otherwise(F.col("q"))
        lower = now.select("key", p.alias("p"))
    return scratch.save(lower.select("key", F.log("p").alias("log_p")))


class HashArrays:
    """Sorted hashes of sequences with their log probabilities, found through the first bits of a hash."""

    def __init__(self, key: np.ndarray, log_p: np.ndarray) -> None:
        h = ragged.mix(key.astype(np.uint64))
        order = np.argsort(h)
        self.hash, self.log_p = h[order], log_p[order].astype(np.float32)
        self.start: np.ndarray | None = None

    def find(self, key: np.ndarray) -> np.ndarray:
        """The log probability of each sequence; 0 for those this slice does not hold."""
        h, out = ragged.mix(key.astype(np.uint64)), np.zeros(len(key), np.float32)
        if not len(self.hash):
            return out
        shift = np.uint64(64 - max(1, len(self.hash).bit_length()))
        if self.start is None:
            bins = 1 << int(64 - shift)
            self.start = np.full(bins + 1, len(self.hash), np.int32)
            for a in range(0, bins, BLOCK):  # block by block, as all at once takes several times the table's memory
                self.start[a : min(a + BLOCK, bins)] = np.searchsorted(self.hash, np.arange(a, min(a + BLOCK, bins), dtype=np.uint64) << shift)
        at, todo = self.start[(h >> shift).astype(np.int64)], np.arange(len(h))
        while len(todo):
            todo = todo[at[todo] < len(self.hash)]
            mine = self.hash[at[todo]]
            hit = mine == h[todo]
            out[todo[hit]] = self.log_p[at[todo[hit]]]
            todo = todo[mine < h[todo]]
            at[todo] += 1
        return out


SCORED = ", ".join(f"{c} long" for c in STATS) + ", base_failed boolean, lang_group long, n_scored long"


def _counted(part: pa.RecordBatch, names: tuple[str | None, ...], many: np.ndarray, group: np.ndarray) -> tuple[list, list]:
    counts = text_counts(part.column("text"))
    return [*(pa.array(counts[c], pa.int64()) for c in STATS), pa.array(failed(counts)), pa.array(group), pa.array(many)], [*STATS, "base_failed", "lang_group", "n_scored"]


def share(model: DataFrame, most: int = MOST) -> Broadcast | None:
    """The model as arrays that every task can search; None where it holds more than ``most`` sequences."""
    if model.count() > most:
        return None
    table = model.toArrow()
    return model.sparkSession.sparkContext.broadcast(HashArrays(table.column("key").to_numpy(), table.column("log_p").to_numpy()))


def score(docs: DataFrame, model: DataFrame, shared: Broadcast | None, names: tuple[str | None, ...] = LANGUAGES) -> DataFrame:
    """Counts, language group and mean log probability (null under one sequence or without a model) of every row.

    ``shared`` is what :func:`share` made of ``model``; without it the documents' sequences join the model.
    """
    if shared is None:
        return _joined(docs, model, names)
    learnt = [r[0] for r in model.select(F.shiftright("key", GROUP)).distinct().collect()]

    @F.arrow_udf(returnType=f"{SCORED}, mean_log_p double")
    def judged(lang: pa.Array, text: pa.Array) -> pa.Array:
        out = []
        for part in ragged.slices(pa.RecordBatch.from_arrays([lang, text], ["lang", "text"]), "text"):
            group, total, many = groups(part.column("lang"), names), np.zeros(part.num_rows), np.zeros(part.num_rows, np.int64)
            for key, row in sequences(part.column("text"), group):
                total += np.bincount(row, weights=shared.value.find(key), minlength=len(total))
                many += np.bincount(row, minlength=len(total))
            cols, labels = _counted(part, names, many, group)
            mean = pa.array(total / np.maximum(many, 1), mask=(many == 0) | ~np.isin(group, learnt))
            out.append(pa.StructArray.from_arrays([*cols, mean], [*labels, "mean_log_p"]))
        ragged.give_back()
        return pa.concat_arrays(out)

    # only language and text go to Python, the row itself stays in Spark; not deterministic, so that no filter repeats it
    return docs.select("row", judged.asNondeterministic()("lang", "text").alias("judged")).select("row", "judged.*")


def _joined(docs: DataFrame, model: DataFrame, names: tuple[str | None, ...]) -> DataFrame:
    """What :func:`score` returns, by a join of the documents' sequences with the model.

    Rows of equal text and language have equal scores, so these two name the row in the join.
    """
    named = docs.select("*", F.xxhash64("lang", "text").alias("h1"), F.xxhash64(F.lit(1), "text", "lang").alias("h2"))

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in ragged.slices(batch, "text"):
                h1, h2 = (np.asarray(part.column(c)) for c in ("h1", "h2"))
                for key, row in sequences(part.column("text"), groups(part.column("lang"), names)):
                    order = np.lexsort((key, row))
                    key, row = key[order], row[order]
                    at = np.flatnonzero(np.append(True, (key[1:] != key[:-1]) | (row[1:] != row[:-1]))) if len(key) else np.zeros(0, int)
                    n = np.diff(np.append(at, len(key)))
                    yield pa.RecordBatch.from_arrays([pa.array(h1[row[at]]), pa.array(h2[row[at]]), pa.array(key[at]), pa.array(n)], ["h1", "h2", "key", "n"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in ragged.slices(batch, "text"):
                many = np.maximum(np.diff(ragged.utf8(part.column("text"))[1]) - ORDER + 1, 0)
                cols, labels = _counted(part, names, many, groups(part.column("lang"), names))
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in ("row", "h1", "h2")), *cols], ["row", "h1", "h2", *labels])

    texts = named.select("h1", "h2", "lang", "text").dropDuplicates(["h1", "h2"])
    pairs = texts.mapInArrow(ragged.tidy(split), "h1 long, h2 long, key long, n long")
    sums = pairs.join(model, "key").groupBy("h1", "h2").agg(F.sum(F.col("n") * F.col("log_p")).alias("sum"))
    counted = named.select("row", "h1", "h2", "lang", "text").mapInArrow(ragged.tidy(count), f"row {docs.schema['row'].dataType.simpleString()}, h1 long, h2 long, {SCORED}")
    return counted.join(sums, ["h1", "h2"], "left").withColumn("mean_log_p", F.when(F.col("n_scored") > 0, F.col("sum") / F.col("n_scored"))).drop("h1", "h2", "sum")


def bands(scored: DataFrame) -> list[tuple[int, float, float]]:
    """(group, lower, upper) bounds of the log perplexity, from a histogram over all documents.

    The middle is the median of the documents that pass the counts; the width is six times their
    median distance from it, with least widths below and above: prose that quotes another language
    reads a little worse than its kind, junk far worse, and what repeats itself reads better.
    """
    bins = scored.filter("mean_log_p is not null and not base_failed").groupBy("lang_group", F.round(-F.col("mean_log_p") / STEP).cast("long").alias("bin")).agg(F.count("*").alias("n")).toArrow().to_pandas()
    out = []
    for g, part in bins.groupby("lang_group"):
        part = part.sort_values("bin")
        at, n = part["bin"].to_numpy() * STEP, part["n"].to_numpy()
        middle = lambda x, k: x[np.searchsorted(np.cumsum(k), k.sum() / 2)]
        mid = middle(at, n)
        order = np.argsort(np.abs(at - mid))
        width = SPREADS * 1.4826 * middle(np.abs(at - mid)[order], n[order])
        out.append((int(g), float(mid - max(LEAST_BELOW, width)), float(mid + max(LEAST_ABOVE, width))))
    return out


def quality(docs: DataFrame, carry: list[str] | None = None) -> DataFrame:
    """Every row of ``docs(text, lang, ...)`` as ``row``, with counts, ``base_failed``, ``log_perplexity`` and ``kept``.

    ``base_failed``: under 20 words, or more than 30 % of them in 8-word windows that repeat within
    the text. ``kept``: not failed, and the perplexity lies within its language group's bands.

    * Null or empty text: all counts 0, failed. A text of under six bytes has no perplexity.
    * Groups are the values of ``lang`` found in the rows (see ``languages``), null being one; values
      with few rows are pooled in the last group.
    * A group of which no document reads like prose has no model: its documents have no perplexity
      and are not kept.
    * Repeated rows are judged each. The other columns come back inside ``row``, whatever
      their names; ``carry`` names those wanted.
    * An empty table gives an empty result. Texts are read whole; nothing is sampled.
    """
    body = docs.select(F.struct(*(carry or docs.columns)).alias("row"), F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"))
    names = languages(body)
    scratch = Scratch(docs.sparkSession, "quality")
    model = kneser_ney(count_sequences(body, names), scratch)
    shared = share(model)
    scored = score(body, model, shared, names)
    if carry and "text" not in carry:
        scored = scratch.save(scored)
        limits = bands(scored)
    else:  # scored a second time rather than written with its texts
        limits = bands(score(body.select(F.struct(F.lit(0)).alias("row"), "lang", "text"), model, shared, names))
    return _judge(scored, limits)


def _judge(scored: DataFrame, limits: list[tuple[int, float, float]]) -> DataFrame:
    inside = F.lit(False)
    for g, low, high in limits:
        stray = SURPRISE / F.sqrt(F.greatest("n_scored", F.lit(1)))
        inside = inside | ((F.col("lang_group") == g) & (-F.col("mean_log_p") >= low - stray) & (-F.col("mean_log_p") <= high + stray))
    return scored.withColumn("log_perplexity", -F.col("mean_log_p")).withColumn("kept", ~F.col("base_failed") & F.coalesce(inside, F.lit(False)))
