"""WAV files as a data source: samples by byte range, headers without the samples.

``spark.read.format("wav_blocks").load(folder)`` yields bounded blocks of samples. Files are cut by their sizes alone, so planning opens none;
a task reads the first kilobyte of its file (and the eight bytes of every later chunk), then only the blocks that begin in its range. So a
recording of any length is read by many tasks, and small files share one. ``spark.read.format("wav_headers").load(folder)`` yields one row
per file from its header. Folders are local paths or URIs that ``pyarrow.fs`` opens; every executor must reach them.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from scribelake.functions import wav

#: Bytes of files in a partition, and bytes of a file that are read to begin with.
PARTITION_BYTES = 64 << 20
HEAD_BYTES = 1024
#: Bytes read at a time where a whole file must be hashed.
HASH_BYTES = 1 << 20

BLOCKS = "path string, reason string, rate int, channels int, block bigint, start_frame bigint, frames bigint, samples array<array<double>>"
HEADERS = (
    "path string, size_bytes bigint, reason string, encoding string, rate int, channels int, frames bigint, orphan_bytes int, "
    "duration_seconds double, clock string, chunks array<struct<id:string,size:bigint>>, sha256 string"
)
_BLOCK_TYPES = [pa.string(), pa.string(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.list_(pa.float64()))]
_HEADER_TYPES = [
    pa.string(), pa.int64(), pa.string(), pa.string(), pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.float64(), pa.string(),
    pa.list_(pa.struct([("id", pa.string()), ("size", pa.int64())])), pa.string(),
]


class Ranges:
    """A file as if it were bytes: slices are read when they are asked for, the first kilobyte once."""

    def __init__(self, file, size: int):
        self.file, self.size = file, size
        self.head = file.read_at(min(HEAD_BYTES, size), 0) if size else b""

    def __len__(self) -> int:
        return self.size

    def __getitem__(self, part: slice) -> bytes:
        a, b, _ = part.indices(self.size)
        return self.head[a:b] if b <= len(self.head) else self.file.read_at(max(0, b - a), a)


def _opened(path: str):
    from pyarrow import fs

    system, inside = fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path.removeprefix("file:"))
    return system, inside


@dataclass
class Range(InputPartition):
    """Byte ranges of files: path, size, first byte, end."""

    parts: tuple[tuple[str, int, int, int], ...]


def planned(files: list[tuple[str, int]], limit: int) -> list[Range]:
    """Ranges of at most ``limit`` bytes; files smaller than that share a partition."""
    out: list[Range] = []
    held: list[tuple[str, int, int, int]] = []
    weight = 0
    for path, size in sorted(files):
        if size >= limit:
            out += [Range(((path, size, a, min(size, a + limit)),)) for a in range(0, size, limit)]
            continue
        if weight + size > limit and held:
            out.append(Range(tuple(held)))
            held, weight = [], 0
        held.append((path, size, 0, size))
        # A file costs an opening, however small it is.
        weight += max(size, HEAD_BYTES)
    return out + ([Range(tuple(held))] if held else [])


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.path = options.get("path") or ""
        self.limit = int(options.get("partitionbytes") or PARTITION_BYTES)
        self.block = int(options.get("blockframes") or 0)
        if not self.path:
            raise ValueError("Name a folder of WAV files.")

    def files(self) -> list[tuple[str, int]]:
        from pyarrow import fs

        system, inside = _opened(self.path)
        prefix = self.path[: len(self.path) - len(inside)] if self.path.endswith(inside) else ""
        found = system.get_file_info(fs.FileSelector(inside, recursive=False))
        visible = (f for f in found if f.type == fs.FileType.File and not f.base_name.startswith(".") and f.extension.lower() in ("wav", "wave"))
        return [(prefix + f.path, f.size) for f in visible]


class BlockReader(_Reader):
    def partitions(self) -> list[Range]:
        return planned(self.files(), self.limit)

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        names = [f.split(" ")[0] for f in BLOCKS.split(", ")]

        def row(*values) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(values, _BLOCK_TYPES)], names=names)

        for path, size, first, end in partition.parts:
            system, inside = _opened(path)
            with system.open_input_file(inside) as file:
                data = Ranges(file, size)
                try:
                    head = wav.header(data)
                except wav.Refused as refused:
                    if first == 0:  # told once, by the range that holds the header
                        yield row(path, str(refused), *[None] * 6)
                    continue
                step = self.block or wav.block_frames(head)
                width = step * head["align"]
                # A block belongs to the range in which it begins.
                n = max(0, -(-(first - head["at"]) // width))
                while n * step < head["frames"] and head["at"] + n * width < end:
                    start, stop = n * step, min(head["frames"], (n + 1) * step)
                    try:
                        values = wav.samples(data, head, start, stop)
                        yield row(path, None, head["rate"], head["channels"], n, start, stop - start, [c for c in np.ascontiguousarray(values.T)])
                    except wav.Refused as refused:
                        yield row(path, str(refused), head["rate"], head["channels"], n, start, stop - start, None)
                    n += 1


class HeaderReader(_Reader):
    def partitions(self) -> list[Range]:
        # Only a kilobyte of each is read: files are counted, not weighed.
        return planned([(p, HEAD_BYTES) for p, _ in self.files()], max(HEAD_BYTES, self.limit // HEAD_BYTES))

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        rows = []
        for path, *_ in partition.parts:
            system, inside = _opened(path)
            with system.open_input_file(inside) as file:
                data = Ranges(file, file.size())
                try:
                    h = wav.header(data)
                    sha = _hashed(data) if h["orphan_bytes"] else None
                    listed = [{"id": i, "size": s} for i, s in h["chunks"]]
                    seconds = h["frames"] / h["rate"]
                    rows.append((path, len(data), None, h["encoding"], h["rate"], h["channels"], h["frames"], h["orphan_bytes"], seconds, wav.embedded_clock(data), listed, sha))
                except wav.Refused as refused:
                    rows.append((path, len(data), str(refused), *[None] * 9))
        if rows:
            names = [f.split(" ")[0] for f in HEADERS.split(", ")]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), _HEADER_TYPES)], names=names)


def _hashed(data: Ranges) -> str:
    """Only files with stray bytes need their hash, to be looked up among those allowed."""
    h = hashlib.sha256()
    for at in range(0, len(data), HASH_BYTES):
        h.update(data[at : at + HASH_BYTES])
    return h.hexdigest()


class WavBlocks(DataSource):
    """Options: ``path``, ``partitionBytes``, ``blockFrames`` (default: five seconds, at most 1,048,576 samples)."""

    @classmethod
    def name(cls) -> str:
        return "wav_blocks"

    def schema(self) -> str:
        return BLOCKS

    def reader(self, schema) -> BlockReader:
        return BlockReader({k.lower(): v for k, v in dict(self.options).items()})


class WavHeaders(DataSource):
    """Options: ``path``, ``partitionBytes``."""

    @classmethod
    def name(cls) -> str:
        return "wav_headers"

    def schema(self) -> str:
        return HEADERS

    def reader(self, schema) -> HeaderReader:
        return HeaderReader({k.lower(): v for k, v in dict(self.options).items()})


def register(spark: SparkSession) -> None:
    """Make both formats known to a session."""
    spark.dataSource.register(WavBlocks)
    spark.dataSource.register(WavHeaders)
