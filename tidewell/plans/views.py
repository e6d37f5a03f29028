"""Logical views of the driver's tables that the registered queries read, in Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def signal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as samples: track = user, in time order, x = l = value scaled, r from the properties."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    k = F.get_json_object("props", "$.k").cast("int")
    e = table(spark, sf_dir, "events")
    return e.select(F.col("user_id").alias("track"), (F.row_number().over(w) - 1).cast("long").alias("idx"), (F.col("value") / 50 - 0.4).alias("x"), (F.col("value") / 50 - 0.4).alias("l"), ((k - 50) / 50).alias("r"), F.col("event_type").alias("state"), "ts", "event_id", ((k % 10) / 10).alias("c"))


SIGNAL = """signal as (select user_id as track, row_number() over (partition by user_id order by ts, event_id) - 1 as idx, value / 50 - 0.4 as x, value / 50 - 0.4 as l,
 (cast(json_extract(props, '$.k') as int) - 50) / 50.0::double as r, event_type as state, ts, event_id, (cast(json_extract(props, '$.k') as int) % 10) / 10.0::double as c from events)"""


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles rounded for comparison; sums of doubles depend on their order."""
    return df.select(*(F.round(c, digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes))
