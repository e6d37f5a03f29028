"""Line dedup by overlapping three-line windows.

Every window of three consecutive lines of a document is hashed. A window that occurs more than once
in the corpus is repeated; all but its first occurrence (smallest document, then position) are
covered, and the lines under any covered window are removed. Overlapping windows merge.

Windows are shipped as 128-bit keys with a position, the first occurrence is a partial minimum per
key, so a passage that a third of all documents share costs one row per task after the partial
aggregate; the join that finds the later occurrences is one Spark can split.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from . import ragged
from .scratch import Scratch

WINDOW = 3


def _windows(rows: DataFrame, width: int) -> DataFrame:
    """(key, row, at) of every window that is not blank throughout."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            key, doc, at = [], [], []
            for name, text in zip(batch.column("row").to_pylist(), batch.column("text").to_pylist()):
                lines = (text or "").encode().split(b"\n")
                for i in range(len(lines) - width + 1):
                    window = b"\n".join(lines[i : i + width])
                    if window.strip():
                        key.append(hashlib.blake2b(window, digest_size=16).digest())
                        doc.append(name)
                        at.append(i)
            yield pa.RecordBatch.from_arrays([pa.array(key, pa.binary()), pa.array(doc, pa.struct([("id", pa.int64()), ("tie", pa.int64())])), pa.array(at, pa.int32())], ["key", "row", "at"])

    return rows.select("row", "text").mapInArrow(ragged.tidy(run), "key binary, row struct<id:long,tie:long>, at int")


def dedup_lines(docs: DataFrame, width: int = WINDOW) -> DataFrame:
    """The rows of ``docs(doc_id, text, ...)`` with ``text`` cleaned, ``n_lines`` and ``n_removed`` added.

    Lines are what stands between ``\\n``. A row keeps its place in the order by doc_id (null last);
    rows with one doc_id come in order of a hash of their text, and equal rows of them count as one
    document: all keep what the first of them keeps.

    * Null or empty text, and texts of fewer lines than a window: unchanged. Null text stays null.
    * Windows of blank lines only are never repeated ones.
    * Extra columns are kept, whatever their names, but for ``n_lines`` and ``n_removed``, which are
      replaced; an empty table gives an empty result. Texts are read whole.
    """
    scratch = Scratch(docs.sparkSession, "line-dedup")
    text = lambda c: F.col(c).cast("string")
    name = F.struct(F.col("doc_id").cast("long").alias("id"), F.xxhash64(F.coalesce(text("text"), F.lit(""))).alias("tie"))
    windows = scratch.save(_windows(docs.select(name.alias("row"), text("text").alias("text")), width))
    place = F.struct(F.col("row.id").isNull().alias("none"), "row", "at")
    first = windows.groupBy("key").agg(F.min(place).alias("first"), F.count("*").alias("n")).filter("n > 1").select("key", "first")
    later = windows.join(first, "key").filter(place > F.col("first"))
    covered = scratch.save(later.groupBy("row").agg(F.collect_set("at").alias("at")))

    met = docs.select(name.alias("row"), F.struct("*").alias("doc"))
    met = met.join(covered.hint("shuffle_merge"), met["row"].eqNullSafe(covered["row"]), "left").select("doc", "at", text("doc.text").alias("text"))
    n_lines = F.when(F.col("text").isNull(), 0).otherwise(F.size(F.split("text", "\n")))
    gone = F.array_distinct(F.flatten(F.transform("at", lambda a: F.sequence(a, a + (width - 1)))))
    met = met.withColumn("n_lines", n_lines).withColumn("gone", gone)
    left = F.array_except(F.sequence(F.lit(0), F.size(F.split("text", "\n")) - 1), "gone")  # by a hash set
    both = F.array(F.struct(F.split("text", "\n").alias("lines"), left.alias("left")))
    lines = F.transform(both, lambda b: F.array_join(F.transform(b["left"], lambda i: F.get(b["lines"], i)), "\n"))[0]
    new = F.when(F.col("gone").isNull(), F.col("text")).otherwise(lines)
    out = [new.alias("text") if c == "text" else F.col("doc").getField(c).alias(c) for c in docs.columns if c not in ("n_lines", "n_removed")]
    removed = F.when(F.col("gone").isNull(), 0).otherwise(F.size("gone"))
    return met.select(*out, F.col("n_lines").cast("long").alias("n_lines"), removed.cast("long").alias("n_removed"))


def oracle(width: int = WINDOW) -> str:
    """DuckDB SQL for :func:`dedup_lines` over ``documents`` with unique ids."""
    window = " || chr(10) || ".join(f"ls[i + {j}]" for j in range(width))
    return f"""with l as (select doc_id, text, string_split(text, chr(10)) ls from documents),
w as (select doc_id, i, {window} win from (select doc_id, ls, unnest(range(1, len(ls) - {width - 2})) i from l)),
seen as (select doc_id, i, row_number() over (partition by win order by doc_id nulls last, i) k from w where regexp_matches(win, '[^ \t\n\r\f\x0b]')),
gone as (select distinct doc_id, i + unnest(range({width})) i from seen where k > 1),
kept as (select doc_id, string_agg(line, chr(10) order by i) text, count(*) n from (select doc_id, i, ls[i] line from (select doc_id, ls, unnest(range(1, len(ls) + 1)) i from l)) anti join gone using (doc_id, i) group by 1)
select l.doc_id, case when l.text is null then null else coalesce(kept.text, '') end as text, coalesce(len(ls), 0) as n_lines, coalesce(len(ls), 0) - coalesce(kept.n, 0) as n_removed from l left join kept using (doc_id)"""
