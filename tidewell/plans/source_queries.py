"""Queries over sources and sinks: what is written from the given tables is read back by the library's readers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tidewell.operators import levels as L
from tidewell.sources import storage

from .level_queries import ORACLE as LEVEL_ORACLE
from .transform_queries import _folder
from .views import rounded, signal, table


def audit_log(spark: SparkSession, d: str) -> DataFrame:
    """Events as an audit log in JSON lines by day, counted by day and level."""
    root = _folder(spark)
    e = table(spark, d, "events")
    level = F.when(F.col("event_type") == "purchase", "audit").otherwise("info")
    rows = e.select(F.col("ts").cast("timestamp").alias("timestamp"), "event_type", level.alias("level"), F.concat(F.lit("user "), F.col("user_id")).alias("message"), F.col("props").alias("metadata"))
    storage.audit(rows, root)
    back = spark.read.schema("timestamp timestamp, event_type string, level string, message string, metadata string, day string").json(root)
    return back.groupBy("day", "level").agg(F.count("*").alias("n"), F.count_distinct("message").alias("messages"), F.sum(F.get_json_object("metadata", "$.k").cast("long")).alias("k"))


def teed_levels(spark: SparkSession, d: str) -> DataFrame:
    """Levels of samples that were written on their way."""
    return rounded(L.level_stats(storage.tee(signal(spark, d).select("track", "idx", "x"), _folder(spark))))


def bucketed_files(spark: SparkSession, d: str) -> DataFrame:
    """Lines and bytes of files that lie in a folder for each kind of event."""
    root = _folder(spark)
    e = table(spark, d, "events")
    e.select("event_type", F.concat_ws(",", "event_id", "user_id").alias("line")).write.partitionBy("event_type").text(root)
    kinds = [f"event_type={r[0]}" for r in e.select("event_type").distinct().collect()]  # the names of the buckets, a handful
    files = storage.bucketed(spark, root, kinds)
    lines = F.size(F.split(F.col("content").cast("string"), "\n")) - 1
    return files.groupBy(F.substring_index("bucket", "=", -1).alias("kind")).agg(F.sum(lines.cast("long")).alias("lines"), F.sum("length").alias("bytes"))


QUERIES = {f.__name__: f for f in (audit_log, teed_levels, bucketed_files)}
ORACLE = {
    "audit_log": "select strftime(ts, '%Y%m%d') as \"day\", case when event_type = 'purchase' then 'audit' else 'info' end as level, count(*) n, count(distinct user_id) messages, sum(cast(json_extract(props, '$.k') as bigint))::bigint k from events group by 1, 2",
    "teed_levels": LEVEL_ORACLE["level_stats"],
    "bucketed_files": "select event_type kind, count(*) as lines, sum(strlen(event_id || ',' || user_id) + 1)::bigint bytes from events group by 1",
}
