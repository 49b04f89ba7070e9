"""Audits: rebuild what a run claims and compare it row by row."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def reconcile(expected: DataFrame, stored: DataFrame, keys: list[str], values: list[str], *, run: str = "source_id") -> DataFrame:
    """Whether a run's stored rows equal the rebuilt ones: same keys, same values, same count."""
    e = expected.select(*keys, F.lit(True).alias("__e"), *[F.col(v).alias(f"__e_{v}") for v in values])
    s = stored.select(*keys, F.lit(True).alias("__s"), *[F.col(v).alias(f"__s_{v}") for v in values])
    same = F.col("__e").isNotNull() & F.col("__s").isNotNull()
    for v in values:
        same = same & F.col(f"__e_{v}").eqNullSafe(F.col(f"__s_{v}"))
    return e.join(s, keys, "full").groupBy(run).agg(
        F.count("__e").alias("expected_rows"), F.count("__s").alias("stored_rows"),
        F.count_if(~same).alias("different_rows"), F.bool_and(same).alias("equal"),
    )


def field_checks(expected: DataFrame, stored: DataFrame, keys: list[str], values: list[str], *, run: str = "source_id") -> DataFrame:
    """Per run: equal row counts, and for every field whether all rows agree on it."""
    e = expected.select(*keys, F.lit(True).alias("__e"), *[F.col(v).alias(f"__e_{v}") for v in values])
    s = stored.select(*keys, F.lit(True).alias("__s"), *[F.col(v).alias(f"__s_{v}") for v in values])
    both = F.col("__e").isNotNull() & F.col("__s").isNotNull()
    same = [
        F.bool_and(~both | F.col(f"__e_{v}").eqNullSafe(F.col(f"__s_{v}"))).alias(f"{v}_equal") for v in values
    ]
    return e.join(s, keys, "full").groupBy(run).agg(F.bool_and(both).alias("rows_equal"), *same)


def trusted_equals(trusted: DataFrame, imported: DataFrame) -> DataFrame:
    """Paths at which an imported document differs from the trusted one.

    Both: doc_id, path, type, value. A type change counts even if the text is equal.
    """
    a = trusted.select("doc_id", "path", F.struct("type", "value").alias("__a"))
    b = imported.select("doc_id", "path", F.struct("type", "value").alias("__b"))
    return a.join(b, ["doc_id", "path"], "full").where(~F.col("__a").eqNullSafe(F.col("__b"))).select(
        "doc_id", "path",
        F.when(F.col("__b").isNull(), "missing").when(F.col("__a").isNull(), "added")
        .when(F.col("__a.type") != F.col("__b.type"), "type_changed").otherwise("value_changed").alias("difference"),
    )


def coverage(sources: DataFrame, *keys: str) -> DataFrame:
    """Whether every frame of every source was submitted.

    ``sources``: input_start, input_end, complete_frames, output_frames, decoded_frames, rate.
    """
    expected = F.call_function("div", F.col("complete_frames") * 16000 + F.col("rate") - 1, F.col("rate").cast("bigint"))
    full = (
        (F.col("input_start") == 0) & (F.col("input_end") == F.col("complete_frames"))
        & (F.col("output_frames") == expected) & (F.col("decoded_frames") == F.col("output_frames"))
    )
    return sources.groupBy(*keys).agg(
        F.bool_and(full).alias("complete"), (F.sum("decoded_frames") / 16000).alias("duration_seconds")
    )


def same_interval(results: DataFrame) -> DataFrame:
    """Candidates of a clip share bounds; candidates of one policy share audio."""
    bounds = results.groupBy("clip_id").agg(
        F.count_distinct(F.struct("first_frame", "last_frame")).alias("intervals")
    )
    audio = results.where(F.col("policy") == "A").groupBy("clip_id").agg(F.count_distinct("audio_sha256").alias("recordings"))
    return bounds.join(audio, "clip_id", "left").select(
        "clip_id", (F.col("intervals") == 1).alias("same_bounds"), (F.coalesce("recordings", F.lit(0)) == 1).alias("same_audio")
    )


def checks(rows: DataFrame, key: str, named: Mapping[str, Column]) -> DataFrame:
    """One row per (run, check) from wide facts; null counts as failed."""
    pairs = F.array(*[
        F.struct(F.lit(i).alias("nr"), F.lit(n).alias("check_code"), F.coalesce(c, F.lit(False)).alias("ok"))
        for i, (n, c) in enumerate(named.items())
    ])
    return rows.select(key, F.explode(pairs).alias("c")).select(key, "c.nr", "c.check_code", "c.ok")


def audit_verdict(results: DataFrame, key: str) -> DataFrame:
    """PASS or FAIL with the first failed check and the number of checks passed before it."""
    failed = F.when(~F.col("ok"), F.struct("nr", "check_code"))
    first = results.groupBy(key).agg(F.min(failed).alias("f"), F.count(F.lit(1)).alias("n"))
    return first.select(
        key, F.when(F.col("f").isNull(), "PASS").otherwise("FAIL").alias("state"),
        F.col("f.check_code").alias("first_failed"), F.coalesce("f.nr", "n").cast("bigint").alias("assertions_passed"),
    )
