"""The registered queries and, where SQL can express them, their oracles."""

from __future__ import annotations

from . import beat_queries, level_queries, meter_queries, model_queries, report_queries, scalar_queries, sequence_queries, source_queries, transform_queries, voice_queries

MODULES = (level_queries, sequence_queries, model_queries, transform_queries, scalar_queries, report_queries, meter_queries, beat_queries, voice_queries, source_queries)
QUERIES: dict = {name: query for m in MODULES for name, query in m.QUERIES.items()}
ORACLE: dict[str, str] = {name: sql for m in MODULES for name, sql in m.ORACLE.items()}
FLAGSHIP = "gated_level"
