"""Sources and sinks: bucketed scans, session files, audit logs, headed waveform files, tees."""

from __future__ import annotations

import struct
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SESSION = "protocol_version string, session_id string, stems array<struct<stem_type: string, events: array<struct<state: string, start_ms: long, end_ms: long, confidence: double, attributes: struct<rms_db: double, transient_density: double>>>>>"


def checkpoints(spark: SparkSession) -> None:
    """Make sure that a checkpoint folder is set: the session's, or in one process a temporary one."""
    if not spark.sparkContext.getCheckpointDir():
        folder = spark.conf.get("spark.checkpoint.dir", "")
        if not folder and not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        spark.sparkContext.setCheckpointDir(folder or "file://" + tempfile.mkdtemp(prefix="tidewell-"))


def saved(df: DataFrame, instead: DataFrame | None = None) -> DataFrame:
    """Write a table to the checkpoint folder and read it back: computed once, and safe from lost executors.

    ``instead`` is a saved table that is not needed once this one is there; it is removed.
    """
    spark = df.sparkSession
    checkpoints(spark)
    path = f"{spark.sparkContext.getCheckpointDir().rstrip('/')}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    if instead is not None:
        old = spark._jvm.org.apache.hadoop.fs.Path(instead._saved_at)
        old.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(old, True)
    back = spark.read.schema(df.schema).parquet(path)
    back._saved_at = path
    return back


def sessions(spark: SparkSession, path: str) -> DataFrame:
    """Events of ``session_*.corpus.json`` files; malformed files are left out."""
    raw = spark.read.schema(SESSION).option("mode", "DROPMALFORMED").option("multiLine", True).option("pathGlobFilter", "session_*.corpus.json").json(path)
    stems = raw.select("session_id", F.explode("stems").alias("s"))
    return stems.select("session_id", "s.stem_type", F.explode("s.events").alias("e")).select("session_id", "stem_type", "e.*")


def bucketed(spark: SparkSession, path: str, buckets: list[str]) -> DataFrame:
    """Files below folders named after buckets; an unknown bucket is an error."""
    d = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    b = F.element_at(F.split("path", "/"), -2)
    checked = F.when(b.isin(*buckets), b).otherwise(F.raise_error(F.concat(F.lit("unknown bucket: "), b)))
    return d.select(checked.alias("bucket"), "path", "length", "content")


def audit(events: DataFrame, path: str) -> None:
    """Append rows as JSON lines, one folder per day."""
    events.withColumn("day", F.date_format("timestamp", "yyyyMMdd")).write.mode("append").partitionBy("day").json(path)


def tee(df: DataFrame, path: str) -> DataFrame:
    """Write a table and go on reading from what was written."""
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def parse_wave(raw: bytes) -> tuple[int, int, int, int, int, int]:
    """Format, channels, rate, bits, where the samples begin and their bytes, of a RIFF file."""
    at, fmt = 12, (1, 1, 48000, 16)
    while at + 8 <= len(raw):
        name, size = raw[at : at + 4], struct.unpack("<I", raw[at + 4 : at + 8])[0]
        if name == b"fmt ":
            kind, channels, rate, _, _, bits = struct.unpack("<HHIIHH", raw[at + 8 : at + 24])
            fmt = (kind, channels, rate, bits)
        if name == b"data":
            return *fmt, at + 8, min(size, len(raw) - at - 8)
        at += 8 + size + (size & 1)
    raise ValueError("no samples")


def decode_wave(raw: bytes) -> tuple[np.ndarray, int]:
    """Samples as doubles in -1..1, one row per frame, and the rate; a torn last frame is dropped."""
    kind, channels, rate, bits, at, size = parse_wave(raw)
    step = channels * bits // 8
    body = raw[at : at + size // step * step]
    if kind == 3:
        x = np.frombuffer(body, "<f4" if bits == 32 else "<f8").astype(float)
    elif bits == 24:
        b = np.frombuffer(body, np.uint8).reshape(-1, 3).astype(np.int32)
        x = ((b[:, 0] << 8 | b[:, 1] << 16 | b[:, 2] << 24) >> 8) / float(1 << 23)
    elif bits == 8:
        x = (np.frombuffer(body, np.uint8).astype(float) - 128) / 128
    else:
        x = np.frombuffer(body, f"<i{bits // 8}") / float(1 << (bits - 1))
    return x.reshape(-1, channels), rate


def encode_wave(x: np.ndarray, rate: int) -> bytes:
    """A 32-bit float file of frames."""
    body = np.ascontiguousarray(x, "<f4").tobytes()
    fmt = struct.pack("<HHIIHH", 3, x.shape[1], rate, rate * 4 * x.shape[1], 4 * x.shape[1], 32)
    return b"RIFF" + struct.pack("<I", 36 + len(body)) + b"WAVEfmt " + struct.pack("<I", 16) + fmt + b"data" + struct.pack("<I", len(body)) + body


def waves(spark: SparkSession, path: str, block: int = 65536) -> DataFrame:
    """Blocks ``(path, block, rate, l, r)`` of all waveform files below a path: one task reads a file."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for name, raw in zip(batch["path"], batch["content"]):
                x, rate = decode_wave(raw)
                l, r = x[:, 0::2].mean(axis=1), x[:, 1::2].mean(axis=1) if x.shape[1] > 1 else x[:, 0]
                for i, a in enumerate(range(0, len(x), block)):
                    yield pd.DataFrame({"path": [name], "block": [i], "rate": [rate], "l": [l[a : a + block]], "r": [r[a : a + block]]})

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.wav").load(path)
    return files.select("path", "content").mapInPandas(run, "path string, block long, rate long, l array<double>, r array<double>")


class Frames(InputPartition):
    def __init__(self, first: int, last: int) -> None:
        super().__init__(0)
        self.first, self.last = first, last


class RawFrames(DataSource):
    """Interleaved 32-bit float stereo frames of one local dump, read by ranges of frames in parallel.

    Options: ``path``, ``frames`` per partition, and optionally ``first`` and ``last`` (a bounded read).
    """

    @classmethod
    def name(cls) -> str:
        return "rawframes"

    def schema(self) -> T.StructType:
        return T.StructType([T.StructField("idx", T.LongType()), T.StructField("l", T.DoubleType()), T.StructField("r", T.DoubleType())])

    def reader(self, schema: T.StructType) -> DataSourceReader:
        return RawFramesReader(dict(self.options))


class RawFramesReader(DataSourceReader):
    def __init__(self, options: dict[str, str]) -> None:
        self.path, self.step = options["path"], int(options.get("frames", 1 << 20))
        self.first, self.last = int(options.get("first", 0)), options.get("last")

    def partitions(self) -> list[InputPartition]:
        import os

        end = os.path.getsize(self.path) // 8
        end = min(end, int(self.last)) if self.last else end
        return [Frames(a, min(a + self.step, end)) for a in range(self.first, end, self.step)]

    def read(self, partition: InputPartition) -> Iterator[tuple[int, float, float]]:
        x = np.fromfile(self.path, "<f4", 2 * (partition.last - partition.first), offset=8 * partition.first).reshape(-1, 2).astype(float)
        for i, (l, r) in enumerate(x.tolist(), partition.first):
            yield i, l, r
