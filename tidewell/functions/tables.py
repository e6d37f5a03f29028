"""Functions that take ordered tables or whole groups: a segmenter for SQL, and an aggregate of a group's values."""

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Row, SparkSession, functions as F, types as T

SEGMENTS = T.StructType([*(T.StructField(c, T.LongType()) for c in ("track", "start", "end", "loud")), *(T.StructField(c, T.DoubleType()) for c in ("peak", "power"))])


@F.udtf(returnType=SEGMENTS, useArrow=False)  # with Arrow every row given becomes a table of its own
class Segmenter:
    """Segments of one track's rows ``(track, idx, x)``, which must come in order.

    A segment goes from a loud row (|x| at the threshold or above) to the last loud one that is at most ``gap`` quiet rows
    after another. It keeps one segment's sums, whatever the track's length. Null and NaN are quiet.
    """

    def __init__(self) -> None:
        self.open: list | None = None

    def eval(self, row: Row, threshold: float, gap: int) -> Iterator[tuple]:
        x = row["x"]
        if x is None or not abs(x) >= threshold:
            return
        i = row["idx"]
        if self.open is not None and i - self.open[2] > gap + 1:
            yield tuple(self.open)
            self.open = None
        if self.open is None:
            self.open = [row["track"], i, i, 0, 0.0, 0.0]
        self.open[2:] = [i, self.open[3] + 1, max(self.open[4], abs(x)), self.open[5] + x * x]

    def terminate(self) -> Iterator[tuple]:
        if self.open is not None:
            yield tuple(self.open)


def segmented(s: DataFrame, threshold: float, gap: int) -> DataFrame:
    """Segments of every track of ``s(track, idx, x)`` by the table function in SQL: one shuffle and sort, one pass over the loud rows."""
    spark: SparkSession = s.sparkSession
    spark.udtf.register("segmenter", Segmenter)
    x = F.col("x").cast("double")
    rows = s.select("track", "idx", x.alias("x")).filter(~F.isnan(x) & (F.abs(x) >= float(threshold)))  # quiet rows say nothing that idx does not
    query = "select * from segmenter(table(select track, idx, x from {rows}) partition by (track) order by (idx), :threshold, :gap)"
    return spark.sql(query, args={"threshold": float(threshold), "gap": int(gap)}, rows=rows)


@F.pandas_udf(T.DoubleType())
def spread(v: pd.Series) -> float:
    """Median distance from the median, of the values that are numbers; null where there is none."""
    x = np.asarray(v, np.float64)
    x = x[np.isfinite(x)]
    return float(np.median(np.abs(x - np.median(x)))) if len(x) else None
