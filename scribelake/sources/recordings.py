"""Recordings as rows: inventory verdicts and bounded sample blocks."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scribelake.functions import wav
from scribelake.functions.text import basename, suffix

# Accepted extensions and unfinished-download endings.
EXTENSIONS = (
    "wav", "wave", "m4a", "mp3", "flac", "aac", "aiff", "aif", "aifc", "ogg", "oga", "opus", "mp4", "mov",
)
UNFINISHED = (".tmp", ".partial", ".download")

INVENTORY = (
    "path string, sha256 string, reason string, encoding string, rate int, channels int, frames bigint, "
    "orphan_bytes int, duration_seconds double, clock string, chunks array<struct<id:string,size:bigint>>"
)
BLOCKS = (
    "path string, reason string, rate int, block bigint, start_frame bigint, frames bigint, "
    "channels array<array<double>>"
)


def allowed_media(paths: DataFrame, column: str = "path", extensions: tuple[str, ...] = EXTENSIONS) -> DataFrame:
    """Rows whose name is a visible, finished media file."""
    name = basename(column)
    unfinished = F.lit(False)
    for end in UNFINISHED:
        unfinished = unfinished | name.endswith(end)
    return paths.where(suffix(column).isin(*extensions) & ~name.startswith(".") & ~unfinished)


def read_recordings(spark: SparkSession, folder: str) -> DataFrame:
    """Direct children of a folder as binary rows; content is read only if a query uses it."""
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", "false").load(folder)
    return allowed_media(rows)


def _inventory(batches):
    names = [f.split(" ")[0] for f in INVENTORY.split(", ")]
    for batch in batches:
        rows = []
        for path, sha, data in zip(*(batch.column(c).to_pylist() for c in ("path", "sha256", "content"))):
            try:
                h = wav.header(data)
                rows.append(
                    (path, sha, None, h["encoding"], h["rate"], h["channels"], h["frames"], h["orphan_bytes"],
                     h["frames"] / h["rate"], wav.embedded_clock(data), [{"id": i, "size": s} for i, s in h["chunks"]])
                )
            except wav.Refused as refused:
                rows.append((path, sha, str(refused), *[None] * 8))
        if rows:
            kinds = [
                pa.string(), pa.string(), pa.string(), pa.string(), pa.int32(), pa.int32(), pa.int64(), pa.int32(),
                pa.float64(), pa.string(), pa.list_(pa.struct([("id", pa.string()), ("size", pa.int64())])),
            ]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)


def inventory(recordings: DataFrame, orphan_allowed: DataFrame | None = None) -> DataFrame:
    """Header facts or the refusal reason of every file.

    Stray bytes after the last frame are refused unless the file's hash is listed.
    """
    hashed = recordings.select("path", F.sha2("content", 256).alias("sha256"), "content")
    rows = hashed.mapInArrow(_inventory, INVENTORY)
    stray = F.coalesce(F.col("orphan_bytes") > 0, F.lit(False))
    if orphan_allowed is not None:
        known = orphan_allowed.select("sha256").distinct().withColumn("__known", F.lit(True))
        rows = rows.join(known, "sha256", "left").withColumn(
            "reason", F.when(stray & F.col("__known").isNull(), "frame_misalignment").otherwise(F.col("reason"))
        ).drop("__known")
    else:
        rows = rows.withColumn("reason", F.when(stray, "frame_misalignment").otherwise(F.col("reason")))
    return rows


def inventory_summary(rows: DataFrame) -> DataFrame:
    return rows.groupBy("encoding", "reason").agg(
        F.count(F.lit(1)).alias("files"), F.sum("frames").alias("frames"), F.sum("duration_seconds").alias("seconds")
    )


def _blocks(batches):
    names = [f.split(" ")[0] for f in BLOCKS.split(", ")]
    kinds = [pa.string(), pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.list_(pa.float64()))]
    for batch in batches:
        for path, data in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist()):
            try:
                head = wav.header(data)
                size = wav.block_frames(head)
                for n, first in enumerate(range(0, head["frames"], size)):
                    last = min(head["frames"], first + size)
                    values = wav.samples(data, head, first, last)
                    row = (path, None, head["rate"], n, first, last - first, [c for c in values.T])
                    yield pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(row, kinds)], names=names)
            except wav.Refused as refused:
                row = (path, str(refused), None, None, None, None, None)
                yield pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(row, kinds)], names=names)


def sample_blocks(recordings: DataFrame) -> DataFrame:
    """Bounded blocks of samples in [-1, 1], one row per block; refusals carry a reason."""
    return recordings.select("path", "content").mapInArrow(_blocks, BLOCKS)
