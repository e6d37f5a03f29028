"""From raw documents to packed sequences in five stages, each over all rows its predecessor kept.

Every stage is ``f(spark, docs, sf_dir) -> DataFrame``; its result is written as Parquet and read
again as the ``docs`` of the next. All but the last return the columns of ``documents``.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from tidewell.llm.line_dedup import dedup_lines
from tidewell.llm.mixing import mix
from tidewell.llm.ngram_join import ngram_components
from tidewell.llm.packing import pack
from tidewell.llm.quality import quality
from tidewell.llm.scratch import Scratch

ORACLE_SQL = None  # the language model and the tokens of the stages are not expressible in SQL


def _rows(judged: DataFrame, docs: DataFrame) -> DataFrame:
    return judged.select(*(F.col("row").getField(c).alias(c) for c in docs.columns))


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep."""
    return _rows(quality(docs).filter("kept"), docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the lines of repeated windows; ``n_chars`` follows the text."""
    cleaned = dedup_lines(docs)
    length = F.length("text").cast(docs.schema["n_chars"].dataType)
    return cleaned.select(*(F.when(F.col("n_removed") > 0, length).otherwise(F.col(c)).alias(c) if c == "n_chars" else c for c in docs.columns))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of near duplicates: the one with the smallest id."""
    scratch = Scratch(spark, "near-duplicates")
    others = scratch.save(ngram_components(docs).filter("doc_id <> component_id").select("doc_id").distinct())
    return docs.join(others, "doc_id", "left_anti").select(*docs.columns)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents sampled to tempered shares of source, language and topic."""
    return _rows(mix(docs, vocabulary=public_tokenizers.path("word_bpe_49k.json")).filter("sampled"), docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in sequences of at most 2048 tokens."""
    return pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [("quality rules", quality_rules), ("line dedup", line_dedup), ("n-gram jaccard join", near_duplicates), ("mixing", mixing), ("packing", packing)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the table ``documents``."""
    scratch = Scratch(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = scratch.save(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
