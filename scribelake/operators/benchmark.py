"""Bounded comparisons: which candidates run on which clips."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scribelake.operators.timeline import nearest_frame
from scribelake.operators.joins import with_key_facts

# Candidates; the second only where every clip is of a known source.
CANDIDATES = ("large-v3-A", "large-v3-B", "large-v3-turbo-A")
SCOPED = "large-v3-B"


def candidate_clips(clips: DataFrame) -> DataFrame:
    """Each clip once per candidate. The three candidates are a literal, so no join is needed."""
    known = clips.groupBy("benchmark_id").agg(F.bool_and("known_source").alias("all_known"))
    named = F.array(*[F.lit(c) for c in CANDIDATES])
    return with_key_facts(clips, known, "benchmark_id", "inner").withColumn("candidate", F.explode(named)).where(
        (F.col("candidate") != SCOPED) | F.col("all_known")
    )


def interval_valid(start: Column, end: Column, duration: Column, rate: Column, frames: Column) -> Column:
    """Nonempty, inside the recording, and at least one frame after rounding."""
    first, last = nearest_frame(start, rate), F.least(frames, nearest_frame(end, rate))
    return F.coalesce((start >= 0) & (start < end) & (end <= duration + 1e-9) & (last > first), F.lit(False))
