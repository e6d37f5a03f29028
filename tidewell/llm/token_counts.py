"""Token counts of whole texts by rank-synchronous merging (see :mod:`.bpe`)."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from . import ragged
from .bpe import encoder, runs

SCHEMA = "doc_id long, n_bytes long, n_tokens long, over_limit boolean"


def token_counts(docs: DataFrame, vocabulary: str, limit: int = 512) -> DataFrame:
    """One row per row of ``docs(doc_id, text)``: doc_id, n_bytes, n_tokens, over_limit.

    ``vocabulary`` is the path of a byte-level BPE file on every executor. Special strings in a text
    count as the one token the library makes of them; none are added.

    * Null or empty text: no bytes, no tokens. A null doc_id is kept. Repeated rows are each counted.
    * A text is read whole, in one task, which holds some 30 bytes for each byte of the longest one (measured on
      26 MB), a few MB of shorter ones, and a table of fixed size.
    * Extra columns are ignored; an empty table gives an empty result. No shuffle takes place.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = encoder(vocabulary)
        for batch in batches:
            column = pc.fill_null(batch.column("text"), "")
            size = pc.binary_length(column).cast(pa.int64())
            for a, b in runs(size.to_pylist()):
                _, count = code.encode(column.slice(a, b - a).to_pylist(), ids=False)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(a, b - a), size.slice(a, b - a), pa.array(count, pa.int64()), pa.array(count > limit)], ["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(ragged.tidy(run), SCHEMA)
