"""Tables that cut lineage: written once to the folder all executors share, then read back.

The folder is the session's ``spark.checkpoint.dir``. Only where that is unset and Spark runs in one
process (local tests) a temporary folder of this machine is chosen; on a cluster the lack is an error.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
BATCH, ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch", 2000


def shared_dir(spark: SparkSession) -> str:
    """The session's checkpoint folder; a temporary one where none is configured."""
    found = spark.conf.get("spark.checkpoint.dir", "") or spark.sparkContext.getCheckpointDir() or ""
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="tidewell-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


class Scratch:
    """Intermediate tables of one run of an operator, each dropped as soon as it is not needed."""

    def __init__(self, spark: SparkSession, name: str) -> None:
        self.spark = spark
        self.root = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
        self.made = 0

    def save(self, df: DataFrame) -> DataFrame:
        """Write ``df`` and read it back: later work starts from files, not from lost executors."""
        self.made += 1
        path = f"{self.root}/{self.made}"
        before = {k: self.spark.conf.get(k) for k in (CLEANUP, BATCH)}
        self.spark.conf.set(CLEANUP, "true")  # this plan never runs again, so its shuffle files can go with it
        if not 0 < int(before[BATCH]) < ROWS:
            self.spark.conf.set(BATCH, str(ROWS))  # rows hold whole texts: a few MB at a time
        try:
            df.write.parquet(path)
        finally:
            for k, v in before.items():
                self.spark.conf.set(k, v)
        back = self.spark.read.schema(df.schema).parquet(path)
        back._scratch_path = path
        return back

    def drop(self, *tables: DataFrame) -> None:
        """Remove saved tables that nothing reads any more."""
        for df in tables:
            path = self.spark._jvm.org.apache.hadoop.fs.Path(df._scratch_path)
            path.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf()).delete(path, True)
