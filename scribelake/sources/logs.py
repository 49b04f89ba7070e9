"""Log and sample files as rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scribelake.functions.text import cpu_seconds

# Page counters that are kept.
PAGE_NAMES = (
    "Pages free", "Pages active", "Pages inactive", "Pages speculative", "Pages wired down",
    "Pages occupied by compressor", "Pages stored in compressor", "Swapins", "Swapouts",
)
PAGE_LINE = r"^([^:]+):\s*([0-9]+)\.?$"


def read_log_lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines of every log with their number and end offset inside the file.

    Files are read whole per row and split in place, so line numbers do not
    depend on how a file was cut.
    """
    files = spark.read.option("wholetext", True).option("recursiveFileLookup", True).text(path).select(
        F.col("_metadata.file_path").alias("log_id"), "value"
    )
    lines = files.select("log_id", F.octet_length("value").alias("log_bytes"), F.posexplode(F.split("value", "\n")).alias("line_no", "value"))
    return with_offsets(lines)


def with_offsets(lines: DataFrame) -> DataFrame:
    from scribelake.operators.ordered import ordered

    return ordered(lines, ["log_id"], ["line_no"], upto={"end_offset": ("sum", F.octet_length("value") + 1)})


def process_rows(lines: DataFrame) -> DataFrame:
    """Six-field process listings; rows that do not parse are not processes."""
    v = F.split(F.trim("value"), r"\s+")
    return lines.where(F.size(v) == 6).select(
        "sample", v[0].try_cast("int").alias("pid"), v[1].try_cast("int").alias("ppid"),
        (v[2].try_cast("bigint") * 1024).alias("rss_bytes"), v[3].try_cast("double").alias("cpu_percent"),
        cpu_seconds(v[4]).alias("cpu_seconds"), cpu_seconds(v[5]).alias("process_elapsed_seconds"),
    ).where("pid >= 1 AND ppid >= 0 AND rss_bytes >= 0 AND cpu_percent IS NOT NULL AND NOT isnan(cpu_percent)")


def page_rows(lines: DataFrame) -> DataFrame:
    name = F.regexp_extract(F.trim("value"), PAGE_LINE, 1)
    return lines.where(name.isin(*PAGE_NAMES)).select(
        "sample", F.replace(F.lower(name), F.lit(" "), F.lit("_")).alias("counter"),
        F.regexp_extract(F.trim("value"), PAGE_LINE, 2).cast("bigint").alias("pages"),
    )
