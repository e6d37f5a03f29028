"""One query per operator of this subpackage, over its whole table, with production parameters."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from . import clustering, cotraining, fill_middle, line_dedup, suffix_dedup, url_filter
from .ngram_join import ngram_components
from .html_text import extract
from .line_dedup import dedup_lines
from .media import media_digests
from .mixing import mix
from .packing import pack
from .quality import STATS, quality
from .token_counts import token_counts


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate components of ``documents``: five-word shingles, Jaccard of 0.8 or more."""
    return ngram_components(table(spark, sf_dir, "documents"))


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The verdict on every page's url: rules, else trust and distrust over links."""
    return url_filter.url_verdicts(table(spark, sf_dir, "pages"))


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and verdict for every document."""
    judged = quality(table(spark, sf_dir, "documents"), ["doc_id"])
    return judged.select("row.doc_id", *STATS, "base_failed", "kept", "log_perplexity", "lang_group")


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's cell, calibrated probability and whether it is sampled."""
    mixed = mix(table(spark, sf_dir, "documents"), carry=["doc_id"], vocabulary=public_tokenizers.path("word_bpe_49k.json"))
    return mixed.select("row.doc_id", "source", "lang", "topic", "n_tokens", "probability", "sampled")


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every document in a byte-level vocabulary."""
    return token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op6_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document stored as a progressive JPEG, read back, and its tensor's features."""
    return media_digests(table(spark, sf_dir, "documents"), keep_tensors=True)


def op7_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every page."""
    return extract(table(spark, sf_dir, "pages"))


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed into sequences of at most 2048 tokens."""
    return pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the lines of windows that occurred before."""
    return dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op10_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calibrated quality of every document from two co-trained views."""
    return cotraining.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op11_fill_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document turned around a middle of whole lines, and rebuilt."""
    return fill_middle.digests(table(spark, sf_dir, "documents"))


def op12_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cluster of every vector of ``embeddings`` and its squared distance, in whole numbers."""
    return clustering.cluster(table(spark, sf_dir, "embeddings"))


def op13_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of every document without the 400-byte strings that occur more than once."""
    return suffix_dedup.digests(table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (op1_ngram_join, op2_url_filter, op3_quality_rules, op4_mixing, op5_token_counts, op6_media, op7_html_text, op8_packing, op9_line_dedup, op10_quality_classifier, op11_fill_middle, op12_clustering, op13_suffix_dedup)}

ORACLE: dict[str, str] = {"op2_url_filter": url_filter.oracle(), "op9_line_dedup": line_dedup.oracle(), "op11_fill_middle": fill_middle.oracle(), "op12_clustering": clustering.oracle(), "op13_suffix_dedup": suffix_dedup.oracle()}
