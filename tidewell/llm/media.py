"""Media columns: bytes kept in progressive JPEG files, and features of the decoded tensors.

A payload of n bytes becomes the quantised coefficients of n / 64 blocks, one byte each, so the file
holds it without loss: four luma blocks a unit first, then one of each chroma component. Files are
written, read back and transformed in batches of about a megabyte, chroma is upsampled to full
resolution, and the payload is taken from the coefficients that were read. The RGB tensors are a column.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from . import jpeg

BLOCK, BATCH = 64, 1 << 20
DIGEST = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def padded(text: bytes) -> bytes:
    """The bytes with zeros up to a positive multiple of 64."""
    return text.ljust(max(BLOCK, -(-len(text) // BLOCK) * BLOCK), b"\0")


def store(payloads: list[bytes]) -> list[bytes]:
    """A progressive JPEG file for each payload (a positive multiple of 64 bytes)."""
    planes = []
    for p in payloads:
        blocks = np.frombuffer(p, np.uint8).reshape(-1, BLOCK)
        wide, high = jpeg.geometry(len(blocks))
        units, parts = wide * high, []
        for n in (4 * units, units, units):
            plane = np.zeros((n, BLOCK), np.int64)
            plane[: len(blocks[:n])] = blocks[:n]
            parts.append(plane)
            blocks = blocks[n:]
        planes.append(((wide, high), parts))
    return jpeg.write(planes)


def payload(image: jpeg.Image, coefficients: np.ndarray, size: int) -> bytes:
    """The bytes that a file read back holds."""
    parts = [coefficients[base : base + w * h] for base, (w, h) in zip(image.base, image.grid)]
    return np.concatenate(parts)[: size // BLOCK].astype(np.uint8).tobytes()


def tensors(files: list[bytes]) -> list[np.ndarray]:
    """Height x width x 3 tensors of progressive files."""
    images, coefficients = jpeg.read(files)
    samples = jpeg.samples(images, coefficients)
    return [jpeg.pixels(i, samples) for i in images]


def feature(rgb: np.ndarray) -> str:
    """Shape, channel sums and a checksum of a tensor."""
    total = rgb.reshape(-1, 3).sum(axis=0, dtype=np.int64)
    return f"{rgb.shape[0]}x{rgb.shape[1]}x3:{total[0]}:{total[1]}:{total[2]}:{zlib.crc32(np.ascontiguousarray(rgb)):08x}"


def _runs(sizes: list[int]) -> Iterator[tuple[int, int]]:
    begin = total = 0
    for i, n in enumerate(sizes):
        if total and total + n > BATCH:
            yield begin, i
            begin, total = i, 0
        total += n
    if begin < len(sizes):
        yield begin, len(sizes)


def media_digests(docs: DataFrame, keep_files: bool = False, keep_tensors: bool = False) -> DataFrame:
    """One row per row of ``docs(doc_id, text)`` about its text stored as a file and read back.

    ``keep_files`` adds the file itself as ``media``; ``keep_tensors`` the RGB tensor as ``height``,
    ``width`` and ``rgb`` (rows of three bytes a pixel). Features are those of the tensor.

    * Null and empty text: a payload of 64 zero bytes, ``n_bytes`` 0. Texts are stored whole: one text is
      one file, made and read in one task, which holds some 64 bytes for each byte of it (measured on 8 MB).
    * Equal texts have equal files, tensors and features. Repeated rows and null ids are kept.
    * Extra columns are ignored; an empty table gives an empty result. No shuffle takes place.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column, names = pc.fill_null(batch.column("text"), ""), batch.column("doc_id")
            for a, b in _runs(pc.binary_length(column).to_pylist()):
                texts = [x.encode() for x in column.slice(a, b - a).to_pylist()]
                files = store([padded(x) for x in texts])
                images, coefficients = jpeg.read(files)
                samples = jpeg.samples(images, coefficients)
                rows, rgbs = [], []
                for text, file, image in zip(texts, files, images):
                    back = payload(image, coefficients, len(padded(text)))
                    rgbs.append(jpeg.pixels(image, samples))
                    rows.append((len(text), len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-BLOCK:]), len(file), hashlib.sha256(file).hexdigest(), feature(rgbs[-1])))
                kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
                cols = [names.slice(a, b - a), *(pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds))]
                labels = [x.split()[0] for x in DIGEST.split(", ")]
                if keep_files:
                    cols, labels = [*cols, pa.array(files, pa.binary())], [*labels, "media"]
                if keep_tensors:
                    sides = [pa.array([x.shape[i] for x in rgbs], pa.int32()) for i in (0, 1)]
                    cols, labels = [*cols, *sides, pa.array([x.tobytes() for x in rgbs], pa.binary())], [*labels, "height", "width", "rgb"]
                yield pa.RecordBatch.from_arrays(cols, labels)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, DIGEST + (", media binary" if keep_files else "") + (", height int, width int, rgb binary" if keep_tensors else ""))
