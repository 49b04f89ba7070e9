"""Exports as ordered line tables.

A text file is one row per line with its place, never one string per source: a
source of any length stays spread over tasks. ``sinks.write_lines`` writes them
in order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scribelake.functions.text import clock_text, md_escape, strip, text_lines
from scribelake.operators.ordered import numbered
from scribelake.operators.results import state_counts

# Phrases of generated documents.
RUN_TITLE = "# Raw English transcription"
RUN_INTRO = "Unedited ASR; accuracy acceptance pending. Times are source-relative."
REVIEW_TAIL = ". All raw text is retained; automatic checks did not establish reliability."
GLOSSARY_NOTE = (
    "**Glossary warning:** no-context decoding disables glossary prompting in this runtime. Check terminology against "
    "the audio."
)
TIMING_NOTE = (
    "**Unvalidated timestamps:** these are raw model predictions, including out-of-range times. The recording has no "
    "imposed length limit. No subtitle file is exported for this run."
)
REPORT_TITLE = "# Transcript Report"
BANNERS = {
    "partial": "**PARTIAL REPORT — one or more selected recordings failed or were cancelled.**",
    "review": "**REVIEW REQUIRED — provisional transcription includes flagged passages.**",
    "complete": "**Complete transcript compilation.**",
}
TIMESTAMP_NOTE = (
    "Timestamps restart at zero for each source. File order does not imply a shared lecture, speaker or continuous "
    "real-world timeline."
)
RETAINED_NOTE = (
    "All stored ASR text is retained. Existing listening-review flags remain separate from the raw transcript."
)
FAILED_NOTE = "**FAILED — no transcript is included for this selected source.**"
CANCELLED_NOTE = (
    "**CANCELLED — this selection was cancelled; already saved source artifacts remain preserved.**"
)
REVIEW_NOTE = (
    "**REVIEW REQUIRED — provisional text is shown below; flagged timestamps or repeated passages must be checked "
    "against the audio.**"
)
EMPTY_NOTE = "The completed ASR run returned no text segments."


def txt_lines(segments: DataFrame, sources: DataFrame) -> DataFrame:
    """One line per segment; a single blank line for a source without any."""
    have = segments.select("source_id").distinct()
    blank = sources.join(have, "source_id", "left_anti").select(
        "source_id", F.lit(0).cast("bigint").alias("line_no"), F.lit("").alias("line")
    )
    return segments.select(
        "source_id", F.col("idx").cast("bigint").alias("line_no"), F.col("text").alias("line")
    ).unionByName(blank)


def md_run_lines(segments: DataFrame, sources: DataFrame) -> DataFrame:
    """Run markdown: a heading per source, then ``[start – end] text`` and a blank line each."""
    head = sources.select(
        "source_id", F.posexplode(F.array(F.concat(F.lit("## Source "), F.col("source_id")), F.lit(""))).alias("part", "line")
    ).select("source_id", F.lit(0).cast("bigint").alias("seq"), "part", "line")
    text = F.concat(
        F.lit("["), clock_text("start_seconds"), F.lit(" – "), clock_text("end_seconds"), F.lit("] "), F.col("text")
    )
    body = segments.select(
        "source_id", F.col("idx").cast("bigint").alias("seq"), F.posexplode(F.array(text, F.lit(""))).alias("part", "line")
    )
    return head.unionByName(body)


def md_result_lines(segments: DataFrame) -> DataFrame:
    """Result markdown body: the time, a blank line, the escaped text."""
    return segments.select(
        "result_id", "idx",
        F.concat(F.lit("["), clock_text("start_seconds"), F.lit("]")).alias("time_line"), md_escape("text").alias("text_line"),
    )


def front_matter(results: DataFrame, fields: dict[str, Column]) -> DataFrame:
    """``key: value`` provenance lines in a fixed order; unknown stays null."""
    pairs = F.array(*[
        F.struct(F.lit(i).alias("line_no"), F.concat(F.lit(f"{k}: "), F.coalesce(c.cast("string"), F.lit("null"))).alias("line"))
        for i, (k, c) in enumerate(fields.items())
    ])
    return results.select("result_id", F.explode(pairs).alias("p")).select("result_id", "p.line_no", "p.line")


def srt_cues(
    segments: DataFrame, ready: DataFrame, *, whole_run: bool = False, width: int | None = None
) -> DataFrame:
    """Numbered cues of results that may have subtitles.

    A result's cues use source times and join inner lines with spaces; a run's
    cues use global times and keep inner lines.
    """
    kept = segments.join(ready.where("srt_valid").select("result_id"), "result_id", "left_semi")
    rows = numbered(kept, ["result_id"], ["idx"], "cue", **({"width": width} if width else {}))
    prefix = "global_" if whole_run else ""
    inner = F.col("text") if whole_run else F.array_join(text_lines("text"), " ")
    times = F.concat(
        clock_text(f"{prefix}start_seconds", srt=True), F.lit(" --> "), clock_text(f"{prefix}end_seconds", srt=True)
    )
    return rows.select("result_id", "cue", times.alias("times"), strip(inner).alias("body"))


def run_head_lines(verdicts: DataFrame) -> DataFrame:
    """Head of a run's markdown: title, intro, and what asks for review.

    ``verdicts``: run_id, status, reasons, timestamp_valid.
    """
    review = F.when(
        F.col("status") == "review_required",
        F.concat(F.lit("**Review required:** "), F.array_join("reasons", ", "), F.lit(REVIEW_TAIL)),
    )
    glossary = F.when(F.array_contains("reasons", "glossary_context_disabled"), GLOSSARY_NOTE)
    timing = F.when(F.col("timestamp_valid") == F.lit(False), TIMING_NOTE)
    lines = F.array_compact(F.array(F.lit(RUN_TITLE), F.lit(RUN_INTRO), review, glossary, timing))
    return verdicts.select("run_id", F.posexplode(lines).alias("line_no", "line"))


def json_documents(results: DataFrame) -> DataFrame:
    """One JSON document per row; unknown values are written as null."""
    return results.select(
        "result_id", F.to_json(F.struct(*[F.col(c) for c in results.columns]), {"ignoreNullFields": "false"}).alias("document")
    )


def report_lines(entries: DataFrame, segments: DataFrame) -> DataFrame:
    """Lines of every batch report as (batch_id, section, position, seq, line).

    ``entries``: batch_id, position, filename, state, duration_seconds,
    duplicate_of, recorded_at, provenance, timezone, failure_message;
    ``segments``: batch_id, position, idx, start_seconds, end_seconds, text.
    """
    counts = state_counts(entries, "batch_id")
    broken, review = F.col("failed") + F.col("cancelled") > 0, F.col("review_required") > 0
    banner = F.when(broken, BANNERS["partial"]).when(review, BANNERS["review"]).otherwise(BANNERS["complete"])
    text = lambda *parts: F.concat(*[p if isinstance(p, Column) else F.lit(p) for p in parts])
    summary = text(
        "Selected files: ", F.col("selected").cast("string"), " · Completed: ", F.col("completed").cast("string"),
        " · Review required: ", F.col("review_required").cast("string"), " · Failed: ", F.col("failed").cast("string"),
        " · Cancelled: ", F.col("cancelled").cast("string"),
    )
    row = lambda section, position, seq, line: [
        F.lit(section).alias("section"), position.cast("bigint").alias("position"), seq.cast("bigint").alias("seq"), line.alias("line")
    ]
    head = counts.select(
        "batch_id", F.posexplode(F.array(F.lit(REPORT_TITLE), F.lit(""), banner, F.lit(""), summary, F.lit(TIMESTAMP_NOTE), F.lit(""), F.lit(RETAINED_NOTE), F.lit(""))).alias("seq", "line")
    ).select("batch_id", *row(0, F.lit(0), F.col("seq"), F.col("line")))
    unknown = lambda c: F.coalesce(F.col(c), F.lit("unknown"))
    title = text("## ", F.col("position").cast("string"), ". ", md_escape("filename"))
    clock = text("Recording clock: ", unknown("recorded_at"), " · Evidence: ", F.col("provenance"), " · Timezone: ", unknown("timezone"), ".")
    measured = F.when(
        F.col("duration_seconds").isNotNull(),
        text("Measured duration: ", clock_text("duration_seconds"), " (", fixed("duration_seconds", 6), " seconds)."),
    ).otherwise("Measured duration: unavailable.")
    note = F.when(F.col("state") == "cancelled", CANCELLED_NOTE).when(F.col("state") == "failed", FAILED_NOTE).when(
        F.col("state") == "review_required", REVIEW_NOTE
    )
    same = text("Identical audio to selection ", F.col("duplicate_of").cast("string"), "; its complete transcript is intentionally repeated here.")
    shown = F.col("state").isin("completed", "review_required")
    parts = F.array_compact(F.array(title, clock, measured, note, F.when(F.col("state") == "failed", md_escape("failure_message")), F.when(shown & F.col("duplicate_of").isNotNull(), same)))
    per_entry = entries.select("batch_id", "position", F.posexplode(parts).alias("seq", "line")).select(
        "batch_id", *row(1, F.col("position"), F.col("seq"), F.col("line"))
    )
    kept = entries.where(shown).select("batch_id", "position")
    # Both joins read these rows: the same filter on both sides lets Spark shuffle them once.
    whole = F.col("batch_id").isNotNull() & F.col("position").isNotNull()
    placed = kept.where(whole)
    spoken = segments.join(placed, ["batch_id", "position"], "left_semi")
    body = spoken.select(
        "batch_id",
        *row(1, F.col("position"), F.col("idx") + 100,
             text("[", clock_text("start_seconds"), " – ", clock_text("end_seconds"), "] ", md_escape("text"))),
    )
    unheard = placed.join(segments.select("batch_id", "position").distinct(), ["batch_id", "position"], "left_anti")
    silent = unheard.unionByName(kept.where(~whole)).select(
        "batch_id", *row(1, F.col("position"), F.lit(100), F.lit(EMPTY_NOTE))
    )
    return head.unionByName(per_entry).unionByName(body).unionByName(silent)


def copy_lines(entries: DataFrame, segments: DataFrame, verified: Column) -> DataFrame:
    """Literal texts of all entries of a report, failed ones as ``[state]``.

    A report with an unverified piece gives nothing. ``verified`` is per entry.
    """
    ended = F.col("state").isin("failed", "cancelled")
    good = entries.groupBy("batch_id").agg(F.bool_and(ended | F.coalesce(verified, F.lit(False))).alias("ok")).where("ok")
    usable = entries.join(good.select("batch_id"), "batch_id", "left_semi")
    head = usable.select("batch_id", "position", F.lit(0).cast("bigint").alias("seq"), F.col("filename").alias("line"))
    state = usable.where(ended).select(
        "batch_id", "position", F.lit(1).cast("bigint").alias("seq"), F.concat(F.lit("["), "state", F.lit("]")).alias("line")
    )
    spoken = segments.join(usable.where(~ended).select("batch_id", "position"), ["batch_id", "position"], "left_semi").select(
        "batch_id", "position", (F.col("idx") + 1).cast("bigint").alias("seq"), F.col("text").alias("line")
    )
    return head.unionByName(state).unionByName(spoken)


def fixed(c: str, digits: int) -> Column:
    """Fixed decimals; halves round to even."""
    return F.format_string(f"%.{digits}f", F.bround(c, digits))


def comparison_table(results: DataFrame) -> DataFrame:
    """Per clip and candidate: runtime, real-time factor, gain; WER stays unmeasured."""
    return results.select(
        "clip_id", "candidate", fixed("elapsed_seconds", 2).alias("runtime"),
        fixed("real_time_factor", 3).alias("rtf"), "gain_db", F.lit("unmeasured").alias("WER"),
    ).orderBy("clip_id", "candidate")
