"""Writers. Nothing is overwritten: an existing target is an error."""

from __future__ import annotations

from pyspark.sql import DataFrame


def write_table(df: DataFrame, path: str, *, partition_by: list[str] | None = None, fmt: str = "parquet") -> None:
    writer = df.write.mode("errorifexists").format(fmt)
    (writer.partitionBy(*partition_by) if partition_by else writer).save(path)


def write_lines(lines: DataFrame, path: str, keys: list[str], order: list[str], line: str = "line") -> None:
    """Text parts per key in line order; a long key spans several ordered parts."""
    placed = lines.repartitionByRange(*keys, *order).sortWithinPartitions(*keys, *order)
    placed.select(*keys, line).write.mode("errorifexists").partitionBy(*keys).text(path)


def write_documents(documents: DataFrame, path: str, column: str = "document") -> None:
    documents.select(column).write.mode("errorifexists").text(path)
