"""Small helpers shared by the corpus operators."""

from __future__ import annotations

import zlib

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from scribelake.session import stored  # noqa: F401

_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"
#: Rows per batch in which whole texts cross to Python.
TEXT_ROWS = 1_000


def bounded_batches(spark: SparkSession) -> None:
    """Smaller Arrow batches than Spark's default, for rows as wide as texts; a value set by the user stays."""
    if spark.conf.get(_BATCH) == "10000":
        spark.conf.set(_BATCH, str(TEXT_ROWS))


def held_out(id_col: str | Column) -> Column:
    """The third of the documents whose labels are never learnt from: crc32 of the id as text, modulo 3, is 1."""
    as_text = (F.col(id_col) if isinstance(id_col, str) else id_col).cast("string")
    return F.crc32(F.coalesce(as_text, F.lit(""))) % 3 == 1


def crc_of(ids) -> int:
    """CRC-32 of an array of ids as little-endian unsigned 32-bit integers."""
    return zlib.crc32(ids.astype("<u4").tobytes())


def mixed(x):
    """A fixed 64-bit mixing of unsigned NumPy integers (splitmix64's finaliser)."""
    import numpy as np

    x = np.asarray(x, np.uint64)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))
