"""JSON documents with explicit schemas; what does not fit is set aside, not dropped."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scribelake import schemas
from scribelake.functions.text import json_defect, valid_id


def read_documents(spark: SparkSession, path: str, schema: str, *, depth: int = 1) -> DataFrame:
    """Documents with the file they came from and the folder that names them."""
    files = spark.read.option("wholetext", True).option("recursiveFileLookup", True).text(path)
    file = F.col("_metadata.file_path")
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"}
    parsed = files.select(file.alias("file_path"), F.from_json("value", schema, options).alias("d"))
    return parsed.select("d.*", "file_path", F.element_at(F.split("file_path", "/"), -1 - depth).alias("folder"))


def healthy(documents: DataFrame) -> DataFrame:
    return documents.where("_corrupt_record IS NULL").drop("_corrupt_record")


def quarantined(documents: DataFrame) -> DataFrame:
    return documents.where("_corrupt_record IS NOT NULL").select("file_path", "_corrupt_record")


def named_by_folder(documents: DataFrame, ident: str) -> DataFrame:
    """Documents whose id is valid and names their folder; hidden folders are skipped."""
    hidden = F.col("file_path").rlike(r"/\.[^/]+/")
    return documents.where(valid_id(ident) & (F.col(ident) == F.col("folder")) & ~hidden)


def read_native_segments(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Segments of decoder documents, and the documents refused.

    A missing array, a non-integer time or a missing text refuses its document.
    """
    docs = read_documents(spark, path, schemas.NATIVE_DOCUMENT)
    t = F.col("transcription")
    whole = t.isNotNull() & F.forall(
        t, lambda s: s["offsets"]["from"].isNotNull() & s["offsets"]["to"].isNotNull() & s["text"].isNotNull()
    )
    good = docs.where(F.col("_corrupt_record").isNull() & F.coalesce(whole, F.lit(False)))
    bad = docs.where(F.col("_corrupt_record").isNotNull() | ~F.coalesce(whole, F.lit(False))).select("file_path", "_corrupt_record")
    return native_segments(good), bad


def native_segments(documents: DataFrame) -> DataFrame:
    return documents.select(
        "run_id", "source_id", F.posexplode("transcription").alias("pos", "s")
    ).select(
        "run_id", "source_id", (F.col("pos") + 1).alias("idx"), F.col("s.offsets.from").alias("from_ms"),
        F.col("s.offsets.to").alias("to_ms"), F.col("s.text").alias("text"),
    )


def strict_json(texts: DataFrame, column: str) -> DataFrame:
    """Rows with the defect of their JSON text, null when it is acceptable."""
    return texts.withColumn("defect", json_defect(column))


def read_profiles(spark: SparkSession, path: str) -> DataFrame:
    return healthy(read_documents(spark, path, schemas.PROFILE_DOCUMENT, depth=1))
