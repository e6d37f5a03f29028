"""The pipeline end to end on small tables, and its registration."""

import __spark_entry__
import corpus_pipeline

from ..conftest import SMALL


def test_stages_and_run(spark):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality rules", "line dedup", "n-gram jaccard join", "mixing", "packing"]
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    kept = corpus_pipeline.quality_rules(spark, docs, SMALL)
    assert kept.columns == docs.columns and 0 < kept.count() < docs.count()
    out = corpus_pipeline.run(spark, SMALL)
    assert {"doc_id", "piece", "sequence_id", "offset"} <= set(out.columns) and out.count() > 0


def test_registered():
    names = __spark_entry__.queries()
    assert all(any(n.startswith(f"op{i}_") for n in names) for i in range(1, 11)) and "pipeline" in names
    assert set(__spark_entry__.oracle_sql()) <= set(names)
