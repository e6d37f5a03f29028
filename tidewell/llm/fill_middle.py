"""Fill-in-the-middle by a scan of texts with an automaton whose chunks run in parallel.

The automaton reads bytes; its state says whether a unit (a line) is open, and how much of a marker has
been read. A chunk's *function* says for every state it may be entered in which state it is left and
how many units begin in it. Functions compose associatively: inside a chunk by halves, as a tree of numpy
arrays; over the chunks of a text in Spark, by groups of ``FAN`` and then over the groups.

A cut after r units lies where unit r + 1 begins. It is selected from above: the group of chunks in which
the count passes r, the chunk, then down the chunk's own tree. A text of one chunk is done where its row
is; chunks of longer texts are dealt out to all tasks twice, for their functions and for the cuts they hold.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from . import ragged
from .scratch import Scratch

CHUNK, FAN = 1 << 16, 256
MARKERS = ("<P>", "<S>", "<M>")
#: Classes of bytes: any other, line feed, the three parts of a marker.
OTHER, FEED, OPEN, LETTER, CLOSE = range(5)
CLASS = np.zeros(256, np.int8)
CLASS[10], CLASS[ord("<")], CLASS[ord(">")] = FEED, OPEN, CLOSE
CLASS[[ord(c) for c in "PSM"]] = LETTER
#: A state is 4 * (a unit is open) + marker; marker: 0 none, 1 "<", 2 "<" and a letter, 3 a whole one was read.
STATES, FOUND = 8, 3


def _automaton() -> tuple[np.ndarray, np.ndarray]:
    """Where each class of byte leads from each state, and whether a unit begins with it."""
    go, begins = np.zeros((5, STATES), np.int8), np.zeros((5, STATES), np.int64)
    for byte in range(5):
        for state in range(STATES):
            unit, marker = divmod(state, 4)
            read = {OPEN: 1, LETTER: 2 if marker == 1 else 0, CLOSE: FOUND if marker == 2 else 0}.get(byte, 0)
            go[byte, state] = 4 * (byte != FEED) + (FOUND if marker == FOUND else read)
            begins[byte, state] = unit == 0
    return go, begins


GO, BEGINS = _automaton()


class Chunk:
    """A chunk's function, and the tree of those it is composed of."""

    def __init__(self, data: np.ndarray) -> None:
        code = CLASS[data]
        plain = code == OTHER
        # of bytes of no class that follow each other only the first changes anything
        self.at = np.flatnonzero(~plain | np.append(True, ~plain[:-1])) if len(code) else np.zeros(0, np.int64)
        exits, counts = GO[code[self.at]], BEGINS[code[self.at]]
        self.levels = [(exits, counts)]
        while len(exits) > 1:
            if len(exits) % 2:  # the identity at the end
                exits, counts = np.vstack([exits, np.arange(STATES, dtype=np.int8)]), np.vstack([counts, np.zeros(STATES, np.int64)])
                self.levels[-1] = exits, counts
            left, right = exits[0::2], exits[1::2]
            counts = counts[0::2] + np.take_along_axis(counts[1::2], left.astype(np.int64), axis=1)
            exits = np.take_along_axis(right, left.astype(np.int64), axis=1)
            self.levels.append((exits, counts))

    def function(self) -> tuple[list[int], list[int]]:
        """(state it is left in, units that begin) for every state it may be entered in."""
        exits, counts = self.levels[-1]
        return (exits[0].tolist(), counts[0].tolist()) if len(exits) else (list(range(STATES)), [0] * STATES)

    def select(self, rank: int, state: int) -> int:
        """The byte with which unit number ``rank`` (from 1) begins, if the chunk is entered in ``state``."""
        i = 0
        for exits, counts in reversed(self.levels):
            i *= 2
            if i + 1 < len(exits) and counts[i, state] < rank:
                rank -= int(counts[i, state])
                state = int(exits[i, state])
                i += 1
        return int(self.at[i])


def _points(data: np.ndarray) -> int:
    """Code points that begin in these bytes."""
    return int(np.count_nonzero((data & 0xC0) != 0x80))


SCAN = "n long, found boolean, first long, second long, first_chars long, second_chars long"
SCANNED = pa.struct([("n", pa.int64()), ("found", pa.bool_()), *((c, pa.int64()) for c in ("first", "second", "first_chars", "second_chars"))])


def _scan(texts: pa.Array, one: pa.Array, two: pa.Array) -> pa.Array:
    """Units, whether a marker is there, and the two cuts of texts of one chunk; null stays null."""
    out = []
    for text, a, b in zip(texts, one.to_pylist(), two.to_pylist()):
        if not text.is_valid:
            out.append(None)
            continue
        data = np.frombuffer(text.as_buffer(), np.uint8)
        chunk = Chunk(data)
        exits, counts = chunk.function()
        n, cut = counts[0], []
        for rank in sorted((a % (n + 1), b % (n + 1))):
            at = chunk.select(rank + 1, 0) if rank < n else len(data)
            cut += [(at, _points(data[:at]))]
        out.append({"n": n, "found": exits[0] % 4 == FOUND, "first": cut[0][0], "second": cut[1][0], "first_chars": cut[0][1], "second_chars": cut[1][1]})
    return pa.array(out, SCANNED)


def _functions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(row, seq, exits, counts, chars) of every chunk."""
    for batch in batches:
        exits, counts, chars = [], [], []
        for raw in batch.column("part"):
            data = np.frombuffer(raw.as_buffer(), np.uint8)
            out, many = Chunk(data).function()
            exits.append(out)
            counts.append(many)
            chars.append(_points(data))
        cols = [pa.array(exits, pa.list_(pa.int32())), pa.array(counts, pa.list_(pa.int64())), pa.array(chars, pa.int64())]
        yield pa.RecordBatch.from_arrays([batch.column("row"), batch.column("seq"), *cols], ["row", "seq", "exits", "counts", "chars"])


def _selected(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(row, cut, at, chars): the place of each cut within its chunk."""
    for batch in batches:
        at, chars = [], []
        for raw, rank, state in zip(batch.column("part"), batch.column("rank").to_pylist(), batch.column("state").to_pylist()):
            data = np.frombuffer(raw.as_buffer(), np.uint8)
            at.append(Chunk(data).select(rank, state))
            chars.append(_points(data[: at[-1]]))
        yield pa.RecordBatch.from_arrays([batch.column("row"), batch.column("cut"), pa.array(at, pa.int64()), pa.array(chars, pa.int64())], ["row", "cut", "at", "chars"])


def _composed(functions: DataFrame, *by: Column) -> DataFrame:
    """Functions with one key composed in the order of ``seq``; ``parts`` keeps them."""
    parts = functions.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("seq", "exits", "counts", "chars"))).alias("parts"))
    start = F.struct(F.array(*(F.lit(i) for i in range(STATES))).alias("exits"), F.array(*[F.lit(0).cast("long")] * STATES).alias("counts"))

    def then(a: Column, b: Column) -> Column:
        return F.struct(
            F.transform(a["exits"], lambda s: F.get(b["exits"], s)).alias("exits"),
            F.zip_with(a["counts"], a["exits"], lambda n, s: n + F.get(b["counts"], s)).alias("counts"),
        )

    whole = F.aggregate("parts", start, then)
    chars = F.aggregate("parts", F.lit(0).cast("long"), lambda n, p: n + p["chars"])
    return parts.select("*", whole.alias("whole"), chars.alias("chars")).select("*", "whole.exits", "whole.counts").drop("whole")


def _descend(parts: str, rank: Column, state: Column) -> Column:
    """The part in which unit ``rank`` begins: its seq, the rank and state it is entered with, code points before it."""
    start = F.struct(F.lit(None).cast("long").alias("seq"), rank.cast("long").alias("rank"), state.cast("int").alias("state"), F.lit(0).cast("long").alias("before"))

    def then(a: Column, p: Column) -> Column:
        here = F.get(p["counts"], a["state"])
        found = F.struct(p["seq"].alias("seq"), a["rank"].alias("rank"), a["state"].alias("state"), a["before"].alias("before"))
        past = F.struct(F.lit(None).cast("long").alias("seq"), (a["rank"] - here).alias("rank"), F.get(p["exits"], a["state"]).alias("state"), (a["before"] + p["chars"]).alias("before"))
        return F.when(a["seq"].isNotNull(), a).when(here >= a["rank"], found).otherwise(past)

    return F.aggregate(parts, start, then)


def _dealt(long: DataFrame, scratch: Scratch, chunk: int) -> DataFrame:
    """(name, scan) of texts of several chunks, from chunks that are dealt out over all tasks."""
    raw = F.col("text").cast("binary")
    starts = F.sequence(F.lit(0), F.floor((F.octet_length("text") - 1) / chunk).cast("int"))
    each = long.select("row", "one", "two", F.octet_length("text").cast("long").alias("size"), F.posexplode(F.transform(starts, lambda i: F.substring(raw, i * chunk + 1, F.lit(chunk)))).alias("seq", "part"))
    chunks = scratch.save(each.select("row", F.col("seq").cast("long").alias("seq"), "part").dropDuplicates(["row", "seq"]))
    kind = chunks.schema["row"].dataType.simpleString()
    functions = chunks.mapInArrow(ragged.tidy(_functions), f"row {kind}, seq long, exits array<int>, counts array<long>, chars long")
    groups = _composed(functions, "row", F.floor(F.col("seq") / FAN).alias("group"))
    groups = scratch.save(groups.select("row", F.col("group").alias("seq"), "parts", "exits", "counts", "chars"))
    texts = scratch.save(_composed(groups.select("row", "seq", "exits", "counts", "chars"), "row"))
    n = F.get("counts", F.lit(0))
    facts = long.select("row", "one", "two", F.octet_length("text").cast("long").alias("size")).distinct()
    told = facts.withColumnRenamed("row", "name").join(texts.hint("shuffle_merge"), F.col("name").eqNullSafe(F.col("row"))).drop("name")
    told = told.withColumn("n", n).withColumn("found", F.get("exits", F.lit(0)) % 4 == FOUND)
    ranks = F.array_sort(F.array(F.col("one") % (F.col("n") + 1), F.col("two") % (F.col("n") + 1)))
    told = scratch.save(told.withColumn("ranks", ranks).select("row", "size", "n", "found", "chars", "ranks", "parts"))

    cuts = told.select("row", "n", "parts", F.posexplode("ranks").alias("cut", "after")).filter(F.col("after") < F.col("n"))
    cuts = cuts.select("row", "cut", _descend("parts", F.col("after") + 1, F.lit(0)).alias("into")).select("row", "cut", F.col("into.seq").alias("seq"), "into.rank", "into.state", "into.before")
    meet = lambda a, b: (a["row"].eqNullSafe(b["row"])) & (a["seq"] == b["seq"])
    cuts = cuts.alias("c").join(groups.hint("shuffle_merge").alias("g"), meet(cuts, groups)).select("c.row", "c.cut", "c.before", _descend("g.parts", F.col("c.rank"), F.col("c.state")).alias("into"))
    cuts = scratch.save(cuts.select("row", "cut", F.col("into.seq").alias("seq"), "into.rank", "into.state", (F.col("before") + F.col("into.before")).alias("before")))
    met = chunks.alias("t").join(cuts.hint("shuffle_merge").alias("c"), meet(chunks, cuts)).select("c.row", "c.cut", "t.part", "c.rank", "c.state")
    local = met.mapInArrow(ragged.tidy(_selected), f"row {kind}, cut int, at long, chars long")
    key = lambda d: F.struct("row", "cut").alias("key")
    placed = cuts.select(key(cuts), F.col("seq"), "before").join(local.select(key(local), "at", "chars"), "key")
    placed = placed.select("key.row", "key.cut", (F.col("seq") * chunk + F.col("at")).alias("at"), (F.col("before") + F.col("chars")).alias("chars"))
    placed = placed.groupBy("row").agg(F.map_from_entries(F.collect_list(F.struct("cut", F.struct("at", "chars")))).alias("at"))
    done = told.drop("parts").withColumnRenamed("row", "name").join(placed.hint("shuffle_merge"), F.col("name").eqNullSafe(F.col("row")), "left")
    place = lambda i, field, end: F.coalesce(F.element_at("at", F.lit(i))[field], F.col(end))
    scan = F.struct("n", "found", place(0, "at", "size").alias("first"), place(1, "at", "size").alias("second"), place(0, "chars", "chars").alias("first_chars"), place(1, "chars", "chars").alias("second_chars"))
    return done.select("name", scan.alias("scan"))


def _unsigned(group: int, salt: int) -> Column:
    digest = F.sha2(F.concat(F.lit(f"{salt}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256)
    return F.conv(F.substring(digest, 8 * group + 1, 8), 16, 10).cast("long")


def fill_middle(docs: DataFrame, rate: int = 100, spm: int = 50, salt: int = 7, chunk: int = CHUNK) -> DataFrame:
    """The rows of ``docs(doc_id, text, ...)`` with ``n`` (lines), ``form``, ``prefix_chars``, ``middle_chars`` and ``output`` added.

    The text's n lines are cut after the smaller and the larger of h1 % (n + 1) and h2 % (n + 1); h1 to h4 are the
    first 32-bit groups of the sha256 of ``salt:doc_id``. ``form`` is plain if the text is empty, holds a marker
    already or h3 % 100 >= ``rate``; else spm if h4 % 100 < ``spm``, else psm. Lengths are code points, null if plain.

    * Null text counts as empty; a null doc_id is hashed as an empty one. Rows with one id have the same h1 to h4.
    * Repeated rows give repeated results. Extra columns are kept, whatever their names, but for the five that
      are added, which are replaced; an empty table gives an empty result.
    * Texts are read whole. Those of more than ``chunk`` bytes are scanned by several tasks; only their
      output is put together in one.
    """
    scratch = Scratch(docs.sparkSession, "fill-middle")
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    body = docs.select(F.struct("*").alias("doc"), "doc_id", text.alias("text"), *(_unsigned(i, salt).alias(c) for i, c in enumerate(("one", "two", "three", "four"))))
    short = F.octet_length("text") <= chunk
    scan = F.arrow_udf(_scan, SCAN).asNondeterministic()
    near = body.filter(short).withColumn("scan", scan("text", "one", "two"))
    name = F.struct(F.col("doc_id").cast("long").alias("id"), F.xxhash64("text").alias("tie"))
    long = body.filter(~short).withColumn("row", name)
    dealt = _dealt(long.select("row", "text", "one", "two"), scratch, chunk)
    far = long.join(dealt.hint("shuffle_merge"), F.col("row").eqNullSafe(F.col("name"))).drop("row", "name")
    met = near.unionByName(far)

    form = F.when((F.col("text") == "") | F.col("scan.found") | (F.col("three") % 100 >= rate), "plain").when(F.col("four") % 100 < spm, "spm").otherwise("psm")
    raw, first, second = F.col("text").cast("binary"), F.col("scan.first").cast("int"), F.col("scan.second").cast("int")
    piece = lambda a, n: F.substring(raw, a + 1, n).cast("string")
    prefix, middle, suffix = piece(F.lit(0), first), piece(first, second - first), piece(second, F.octet_length("text") - second)
    p, s, m = (F.lit(x) for x in MARKERS)
    output = F.when(F.col("form") == "plain", F.col("text")).when(F.col("form") == "psm", F.concat(p, prefix, s, suffix, m, middle)).otherwise(F.concat(s, suffix, p, prefix, m, middle))
    cut = lambda c: F.when(F.col("form") != "plain", c)
    new = ("n", "form", "prefix_chars", "middle_chars", "output")
    kept = [F.col("doc").getField(c).alias(c) for c in docs.columns if c not in new]
    return met.withColumn("form", form).select(*kept, F.col("scan.n").alias("n"), "form", cut(F.col("scan.first_chars")).alias("prefix_chars"), cut(F.col("scan.second_chars") - F.col("scan.first_chars")).alias("middle_chars"), output.alias("output"))


def restored(output: Column, form: Column) -> Column:
    """The text that :func:`fill_middle` made ``output`` of; pieces hold no marker, so the markers show where they end."""
    end = lambda mark: F.locate(mark, output)
    between = lambda a, b: F.substring(output, end(a) + 3, end(b) - end(a) - 3)
    middle = F.substring(output, end("<M>") + 3, F.length(output))
    psm = F.concat(between("<P>", "<S>"), middle, between("<S>", "<M>"))
    spm = F.concat(between("<P>", "<M>"), middle, between("<S>", "<P>"))
    return F.when(form == "plain", output).when(form == "psm", psm).otherwise(spm)


def digests(docs: DataFrame) -> DataFrame:
    """The result of :func:`fill_middle` in figures, with the text rebuilt from each output."""
    done = fill_middle(docs)
    return done.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(restored(F.col("output"), F.col("form")), 256).alias("restored_sha256"))


def oracle(rate: int = 100, spm: int = 50, salt: int = 7) -> str:
    """DuckDB SQL for :func:`digests` over ``documents``."""
    h = ", ".join(f"('0x' || substr(h, {8 * i + 1}, 8))::bigint h{i + 1}" for i in range(4))
    return f"""with t as (select doc_id, coalesce(text, '') x, regexp_extract_all(coalesce(text, ''), '[^\n]*\n|[^\n]+') u, sha256('{salt}:' || coalesce(doc_id::varchar, '')) h from documents),
c as (select doc_id, x, u, len(u) n, {h} from t),
f as (select *, least(h1 % (n + 1), h2 % (n + 1)) a, greatest(h1 % (n + 1), h2 % (n + 1)) b, case when x = '' or contains(x, '<P>') or contains(x, '<S>') or contains(x, '<M>') or h3 % 100 >= {rate} then 'plain' when h4 % 100 < {spm} then 'spm' else 'psm' end form from c),
g as (select doc_id, n, form, x, array_to_string(u[1:a], '') p, array_to_string(u[a + 1:b], '') m, array_to_string(u[b + 1:], '') s from f)
select doc_id, n, form, case when form <> 'plain' then length(p) end prefix_chars, case when form <> 'plain' then length(m) end middle_chars,
sha256(case form when 'plain' then x when 'psm' then '<P>' || p || '<S>' || s || '<M>' || m else '<S>' || s || '<P>' || p || '<M>' || m end) output_sha256, sha256(p || m || s) restored_sha256 from g"""
