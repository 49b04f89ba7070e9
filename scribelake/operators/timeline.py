"""Exact audit of segment times against the measured length of their source.

Seconds are never compared as floats: milliseconds meet frames and rate by
cross-multiplication in BIGINT.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scribelake.operators.ordered import BLOCK_ROWS, ordered
from scribelake.operators.joins import with_key_facts

# Decoder tick and the order in which reasons are listed.
TICK_MS = 10
REASONS = (
    "negative_start", "end_before_start", "nonmonotonic_start", "nonmonotonic_end",
    "start_after_eof", "end_after_eof",
)


def past_end(ms: Column, frames: Column, rate: Column) -> Column:
    return ms * rate > 1000 * frames


def end_tick_ms(frames: Column, rate: Column) -> Column:
    """First 10 ms tick at or after the exact end."""
    return TICK_MS * quotient(100 * frames + rate - 1, rate)


def quotient(a: Column, b: Column) -> Column:
    """Integer quotient, exact in BIGINT."""
    return F.call_function("div", a, b)


def frames_at(frames: Column, rate: Column, target: int = 16000) -> Column:
    """Frames after resampling, rounded up."""
    return quotient(frames * target + rate - 1, rate)


def nearest_frame(seconds: Column, rate: Column) -> Column:
    return F.floor(seconds * rate + 0.5).cast("bigint")


def audited(segments: DataFrame, clocks: DataFrame, *, width: int = BLOCK_ROWS) -> DataFrame:
    """Segments with ``reasons`` (array) and ``normalized`` (last end on the tick enclosing EOF).

    ``segments``: source_id, idx, from_ms, to_ms, ...; ``clocks``: source_id, frames, rate.
    """
    rows = ordered(
        segments, ["source_id"], ["idx"],
        lag={"prev_from": "from_ms", "prev_to": "to_ms"},
        total={"last_idx": ("max", "idx")},
        attach=clocks, width=width,
    )
    start, end, frames, rate = (F.col(c) for c in ("from_ms", "to_ms", "frames", "rate"))
    normalized = (
        past_end(end, frames, rate)
        & (F.col("idx") == F.col("last_idx"))
        & (start >= 0)
        & (start * rate < 1000 * frames)
        & (end % TICK_MS == 0)
        & (end == end_tick_ms(frames, rate))
    )
    checks = {
        "negative_start": start < 0,
        "end_before_start": end < start,
        "nonmonotonic_start": start < F.col("prev_from"),
        "nonmonotonic_end": end < F.col("prev_to"),
        "start_after_eof": past_end(start, frames, rate),
        "end_after_eof": past_end(end, frames, rate) & ~normalized,
    }
    reasons = F.array_compact(F.array(*[F.when(checks[r], F.lit(r)) for r in REASONS]))
    return rows.withColumns({"normalized": F.coalesce(normalized, F.lit(False)), "reasons": reasons}).drop(
        "prev_from", "prev_to", "last_idx"
    )


def violations(rows: DataFrame) -> DataFrame:
    """One row per segment and reason, with exact distances as num / den seconds."""
    return rows.select(
        "source_id", F.col("idx").alias("segment"), F.explode("reasons").alias("reason"),
        F.col("from_ms").alias("start_ms"), F.col("to_ms").alias("end_ms"),
        (F.col("from_ms") * F.col("rate") - 1000 * F.col("frames")).alias("start_minus_eof_num"),
        (F.col("to_ms") * F.col("rate") - 1000 * F.col("frames")).alias("end_minus_eof_num"),
        (1000 * F.col("rate").cast("bigint")).alias("eof_den"),
    )


def normalizations(rows: DataFrame) -> DataFrame:
    return rows.where("normalized").select(
        "source_id", F.col("idx").alias("segment"), F.col("to_ms").alias("raw_end_ms"),
        F.col("frames").alias("end_num"), F.col("rate").alias("end_den"),
    )


def verdicts(rows: DataFrame, clocks: DataFrame) -> DataFrame:
    """Audit verdict of every clocked source, also of those without segments."""
    counted = rows.groupBy("source_id").agg(
        F.count(F.lit(1)).alias("segment_count"),
        F.sum(F.size("reasons")).alias("violation_count"),
        F.count_if("normalized").alias("normalization_count"),
    )
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).alias(c)
    return clocks.join(counted, "source_id", "left").select(
        "source_id", "frames", "rate", zero("segment_count"), zero("violation_count"),
        zero("normalization_count"), (F.coalesce(F.col("violation_count"), F.lit(0)) == 0).alias("valid"),
    )


def segment_times(
    rows: DataFrame, clocks: DataFrame, offsets: DataFrame | None = None
) -> DataFrame:
    """Assembled segments: source and global seconds, raw milliseconds kept.

    ``offsets``: source_id, source_start, global_offset (seconds); default zero.
    A normalized end is written only when the whole source is valid.
    """
    about = verdicts(rows, clocks).select("source_id", "valid")
    if offsets is not None:
        about = about.join(offsets, "source_id", "left")
    joined = with_key_facts(rows, about, "source_id", "inner")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0.0)) if offsets is not None else F.lit(0.0)
    clamped = F.col("normalized") & F.col("valid")
    start = F.col("from_ms") / 1000
    end = F.when(clamped, F.col("frames") / F.col("rate")).otherwise(F.col("to_ms") / 1000)
    return joined.select(
        "source_id", "idx",
        (start + zero("source_start")).alias("start_seconds"),
        (end + zero("source_start")).alias("end_seconds"),
        (start + zero("global_offset")).alias("global_start_seconds"),
        (end + zero("global_offset")).alias("global_end_seconds"),
        F.col("from_ms").alias("native_start_milliseconds"),
        F.col("to_ms").alias("native_end_milliseconds"),
        clamped.alias("endpoint_rounding_clamped"), F.col("valid").alias("timestamp_valid"), "text",
    )


def global_offsets(
    sources: DataFrame, *, key: str = "session_id", pos: str = "pos", duration: str = "duration",
    width: int = BLOCK_ROWS,
) -> DataFrame:
    """Sum of the durations of earlier sources of a session."""
    return ordered(sources, [key], [pos], before={"global_offset": ("sum", duration)}, width=width)


def segment_valid(start: Column, end: Column, text: Column) -> Column:
    finite = lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf")))
    return text.isNotNull() & finite(start) & finite(end)


def in_range(start: Column, end: Column, duration: Column, provisional: Column) -> Column:
    inside = (start >= 0) & (start <= end) & (end <= duration + 0.05)
    return provisional | inside


def srt_ready(segments: DataFrame, facts: DataFrame, *, width: int = BLOCK_ROWS) -> DataFrame:
    """Whether subtitles may be written per result.

    ``segments``: result_id, idx, start_seconds, end_seconds, text;
    ``facts``: result_id, timestamp_valid, duration_seconds. No cue means no.
    """
    rows = ordered(
        segments, ["result_id"], ["idx"], lag={"prev_start": "start_seconds"},
        attach=facts, width=width,
    )
    start, end, limit = F.col("start_seconds"), F.col("end_seconds"), F.col("duration_seconds")
    good = (
        (F.trim(F.regexp_replace("text", r"[\s\p{Z}]+", " ")) != "")
        & (start >= 0) & (start < end) & (end <= limit)
        & (start >= F.coalesce(F.col("prev_start"), F.lit(-1.0)))
        & (F.bround(end * 1000) > F.bround(start * 1000))
    )
    cues = rows.groupBy("result_id").agg(F.bool_and(F.coalesce(good, F.lit(False))).alias("cues_good"))
    finite = limit.isNotNull() & ~F.isnan(limit) & (F.abs(limit) < F.lit(float("inf")))
    not_false = F.coalesce(F.col("timestamp_valid"), F.lit(True))
    return facts.join(cues, "result_id", "left").select(
        "result_id", (not_false & finite & F.coalesce(F.col("cues_good"), F.lit(False))).alias("srt_valid")
    )
