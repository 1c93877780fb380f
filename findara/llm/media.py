"""Media columns: payloads stored as lossless WebP images and read back as pixel arrays."""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import documents, in_small_batches, lean, written
from .packing import slices
from .webp import decode_grey, encode_grey

#: Samples of an image row; payloads are filled up to whole rows, at least one, with this byte.
WIDTH, FILL = 576, 255
#: Most rows of an image of the format: longer payloads are several files, one after the other.
ROWS = 1 << 14
#: Payload bytes that are encoded, and stored bytes that are decoded, at a time; and rows.
SLICE, STORED, MANY = 6 << 20, 4 << 20, 1 << 13


def filled(payload: bytes) -> bytes:
    return payload + bytes([FILL]) * ((-len(payload) % WIDTH) if payload else WIDTH)


def to_media(payloads: list[bytes]) -> list[bytes]:
    """Each filled payload as a WebP file, from 9 MB on as several that follow each other; the same bytes give the same files."""
    frames, owners = [], []
    for k, p in enumerate(payloads):
        data = np.frombuffer(p, np.uint8)
        for at in range(0, len(data), WIDTH * ROWS):
            frames.append(data[at : at + WIDTH * ROWS])
            owners.append(k)
    out: list[list[bytes]] = [[] for _ in payloads]
    for k, f in zip(owners, encode_grey(frames, WIDTH)):
        out[k].append(f)
    return [b"".join(o) for o in out]


def store(df: DataFrame, payload: Column, id_col: str = "doc_id") -> DataFrame:
    """``<id_col>, n_bytes, media``, a row for each row: the payload (binary, null as empty) as a lossless image.

    An empty payload is a row of filling.  Rows that repeat are stored alike, each for itself; an empty table gives an
    empty result.  Whole payloads are stored, a slice of ``SLICE`` bytes of rows at a time and a longer one by itself.
    Other columns are not read, so their names may clash with ours.
    """

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in slices(whole, "_payload", SLICE, MANY):
                media = to_media([filled(p or b"") for p in b["_payload"].to_pylist()])
                yield pa.RecordBatch.from_arrays([b["_id"], b["n_bytes"], pa.array(media, pa.binary())], ["_id", "n_bytes", "media"])

    rows = in_small_batches(df).select(F.col(id_col).alias("_id"), F.coalesce(F.octet_length(payload), F.lit(0)).cast("long").alias("n_bytes"), payload.alias("_payload"))
    schema = T.StructType([rows.schema["_id"], T.StructField("n_bytes", T.LongType()), T.StructField("media", T.BinaryType())])
    return rows.mapInArrow(lean(scan), schema).withColumnRenamed("_id", id_col)


def feature(samples: np.ndarray) -> str:
    """Rows, and of the samples the mean, the deviation, the mean step to the right neighbour and the different values."""
    grid = samples.reshape(-1, WIDTH)
    counts = np.bincount(samples, minlength=256)
    values = np.arange(256)
    mean = counts @ values / len(samples)
    deviation = max(0.0, counts @ (values * values) / len(samples) - mean * mean) ** 0.5
    step = np.abs(np.diff(grid.astype(np.int16), axis=1)).mean()
    return f"rows={len(grid)} mean={mean:.3f} dev={deviation:.3f} step={step:.3f} values={np.count_nonzero(counts)}"


def load(stored: DataFrame, id_col: str = "doc_id", pixels: bool = True) -> DataFrame:
    """Decode stored media: ``<id_col>, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes,
    media_sha256, feature`` and, if asked, ``pixels`` (8-bit samples, rows of ``WIDTH``).

    Rows stay rows, repeated ones too; an empty table gives an empty result.  A null or damaged medium is an error, not
    a row.  Columns beside these three are an error as well, as nothing is known of them.
    """
    fields = [("payload_bytes", T.LongType()), ("payload_sha256", T.StringType()), ("tail_crc32", T.LongType()), ("media_bytes", T.LongType()), ("media_sha256", T.StringType()), ("feature", T.StringType())]
    fields += [("pixels", T.BinaryType())] if pixels else []

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in slices(whole, "media", STORED, MANY):
                media = b["media"].to_pylist()
                rows = []
                for m, samples in zip(media, decode_grey(media)):
                    raw = samples.tobytes()
                    rows.append((len(raw), hashlib.sha256(raw).hexdigest(), zlib.crc32(raw[-32:]), len(m), hashlib.sha256(m).hexdigest(), feature(samples), raw))
                columns = list(zip(*rows))[: len(fields)]
                yield pa.RecordBatch.from_arrays([b["_id"], b["n_bytes"], *map(pa.array, columns)], ["_id", "n_bytes", *(f for f, _ in fields)])

    rows = in_small_batches(stored).withColumnRenamed(id_col, "_id")
    schema = T.StructType([rows.schema["_id"], T.StructField("n_bytes", T.LongType()), *(T.StructField(*f) for f in fields)])
    return rows.mapInArrow(lean(scan), schema).withColumnRenamed("_id", id_col)


def op5_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text as lossless WebP, written, read back and decoded."""
    text = F.coalesce(F.col("text"), F.lit(""))
    stored = written(store(documents(spark, sf_dir), F.encode(text, "UTF-8")), "media")
    return load(stored, pixels=False)
