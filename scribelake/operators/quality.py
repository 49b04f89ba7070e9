"""Source-local review gates: loops, compression, empties, bad times.

Text is never edited; findings are rows beside it. A clean verdict means that
these checks passed, never that the words are right.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scribelake.functions.text import folded_words, tokens_ws, word_count
from scribelake.operators.ordered import BLOCK_ROWS, islands, ordered, split_runs
from scribelake.session import checkpointed

# Thresholds of the gates.
MAX_PERIOD = 64
MIN_LOOP_WORDS = 24
MIN_CYCLES = 3
WINDOW_SECONDS = 30
MIN_WINDOW_WORDS = 40
MAX_RATIO = 2.4

CHUNK_WORDS = 1 << 14
# Segments carry text, so fewer of them fill a block.
TEXT_BLOCK_ROWS = 1 << 13


def segment_words(segments: DataFrame) -> DataFrame:
    return segments.withColumn("word_count", word_count("text"))


def counted(segments: DataFrame) -> DataFrame:
    """Words per segment, stored once: a narrow table in place of tokenizing again.

    Positions, per-source totals and empties all read it.
    """
    return checkpointed(segment_words(segments).select("source_id", "idx", "word_count"))


def word_locations(segments: DataFrame, *, width: int = TEXT_BLOCK_ROWS) -> DataFrame:
    """Segments with the position of their first word inside the source."""
    return ordered(
        segment_words(segments), ["source_id"], ["idx"],
        before={"first_word": ("sum", "word_count")}, width=width,
    )


_PIECES = (
    "source_id string, chunk bigint, lo bigint, hi bigint, w string, idx bigint, start_seconds double, end_seconds double"
)


def _cutter(size: int):
    """Segments as the pieces of their words that each chunk sees, words space-joined."""

    def cut(batches):
        schema = pa.schema([(n, {"string": pa.string(), "bigint": pa.int64(), "double": pa.float64()}[t]) for n, t in (c.split(" ") for c in _PIECES.split(", "))])
        for batch in batches:
            out = []
            names = ("source_id", "first_word", "text", "idx", "start_seconds", "end_seconds")
            for source, first, text, *about in zip(*(batch.column(n).to_pylist() for n in names)):
                words = folded_words(text)
                stop = first + len(words)
                for chunk in range(first // size, (stop - 1 + MAX_PERIOD) // size + 1):
                    lo, hi = max(first, chunk * size - MAX_PERIOD), min(stop, (chunk + 1) * size)
                    if hi > lo:
                        out.append((source, chunk, lo, hi, " ".join(words[lo - first : hi - first]), *about))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), schema)], schema=schema)

    return cut


def _chunks(located: DataFrame, size: int) -> DataFrame:
    """Words of bounded number per (source, chunk) by segment, each chunk with the 64 words before it."""
    pieces = located.where("word_count > 0").select(
        "source_id", F.col("first_word").cast("bigint").alias("first_word"), "text", F.col("idx").cast("bigint").alias("idx"),
        *[F.col(c).cast("double").alias(c) for c in ("start_seconds", "end_seconds")],
    ).mapInArrow(_cutter(size), _PIECES)
    return (
        pieces.groupBy("source_id", "chunk")
        .agg(
            F.min("lo").alias("lo"), F.max("hi").alias("hi"),
            F.array_sort(F.collect_list(F.struct("lo", "w", "idx", "start_seconds", "end_seconds"))).alias("parts"),
        )
        .where(F.col("hi") > F.col("chunk") * size)
        .select(
            "source_id", "chunk", "lo", F.col("parts.w").alias("seg_words"),
            *[F.col(f"parts.{c}").alias(f"seg_{c}") for c in ("idx", "start_seconds", "end_seconds")],
        )
    )


_RUNS = (
    "source_id string, period int, start bigint, end bigint, open_left boolean, open_right boolean, "
    "first_idx bigint, start_seconds double, last_idx bigint, end_seconds double"
)


def _run_finder(size: int):
    """Equal-to-one-period-earlier runs of each chunk; runs at an edge stay open."""

    def runs_of(codes, row_of, lo, own_lo, own_hi):
        """``codes``/``row_of`` of all words of a batch; bounds per chunk row."""
        base = np.concatenate(([0], np.cumsum(np.bincount(row_of, minlength=len(lo)))))[:-1]
        for period in range(1, MAX_PERIOD + 1):
            if len(codes) <= period:
                break
            same = (codes[period:] == codes[:-period]) & (row_of[period:] == row_of[:-period])
            at = np.flatnonzero(same) + period
            if not len(at):
                continue
            row = row_of[at]
            pos = lo[row] + (at - base[row])
            keep = (pos >= own_lo[row]) & (pos < own_hi[row])
            row, pos = row[keep], pos[keep]
            if not len(pos):
                continue
            brk = np.flatnonzero((np.diff(pos) != 1) | (np.diff(row) != 0)) + 1
            head, tail = np.concatenate(([0], brk)), np.concatenate((brk, [len(pos)])) - 1
            r, start, end = row[head], pos[head], pos[tail] + 1
            left = (start == own_lo[r]) & (own_lo[r] > 0)
            right = end == own_lo[r] + size
            long_enough = end - start + period >= max(MIN_CYCLES * period, MIN_LOOP_WORDS)
            pick = left | right | long_enough
            if pick.any():
                yield period, r[pick], start[pick], end[pick], left[pick], right[pick]

    def find(batches):
        flat = lambda column, kind: column.flatten().to_numpy(zero_copy_only=False).astype(kind)
        names = [c.split(" ")[0] for c in _RUNS.split(", ")]
        for whole in batches:
            for offset in range(0, whole.num_rows, 64):
                batch = whole.slice(offset, 64)
                words = pc.split_pattern(batch.column("seg_words").flatten(), " ")
                # Words and segments of the batch lie one after another: word -> segment by count.
                in_segment = pc.list_value_length(words).to_numpy(zero_copy_only=False).astype(np.int64)
                segment_of = np.repeat(np.arange(len(in_segment)), in_segment)
                upto = np.concatenate(([0], np.cumsum(in_segment)))
                last_segment = np.cumsum(pc.list_value_length(batch.column("seg_words")).to_numpy(zero_copy_only=False))
                counts = np.diff(upto[last_segment], prepend=0)
                codes = words.flatten().dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int64)
                row_of = np.repeat(np.arange(len(counts)), counts)
                lo = batch.column("lo").to_numpy(zero_copy_only=False)
                own_lo = batch.column("chunk").to_numpy(zero_copy_only=False) * size
                found = list(runs_of(codes, row_of, lo, own_lo, lo + counts))
                if not found:
                    continue
                period = np.concatenate([np.full(len(f[1]), f[0], np.int32) for f in found])
                row, start, end, left, right = (np.concatenate([f[i] for f in found]) for i in range(1, 6))
                base = np.cumsum(counts) - counts
                first = segment_of[base[row] + start - period - lo[row]]
                last = segment_of[base[row] + end - 1 - lo[row]]
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("source_id").take(pa.array(row)),
                        pa.array(period), pa.array(start), pa.array(end), pa.array(left), pa.array(right),
                        pa.array(flat(batch.column("seg_idx"), np.int64)[first]),
                        pa.array(flat(batch.column("seg_start_seconds"), np.float64)[first]),
                        pa.array(flat(batch.column("seg_idx"), np.int64)[last]),
                        pa.array(flat(batch.column("seg_end_seconds"), np.float64)[last]),
                    ],
                    names=names,
                )

    return find


def loop_candidates(
    segments: DataFrame, *, counts: DataFrame | None = None, width: int = BLOCK_ROWS, chunk_words: int = CHUNK_WORDS,
) -> DataFrame:
    """Periodic word runs before merging: source_id, start, end, period, and the
    segments that hold the first and last word.

    Runs are found per bounded chunk; the few that touch a chunk edge are joined
    with their neighbours afterwards, so a run may be as long as its source.
    """
    # Positions come from the narrow counts; the text itself moves once to meet them, spread by segment.
    places = ordered(
        counts if counts is not None else counted(segments), ["source_id"], ["idx"],
        before={"first_word": ("sum", "word_count")}, width=width,
    ).where("word_count > 0")
    located = (
        segments.select("source_id", "idx", "start_seconds", "end_seconds", "text")
        .join(places, ["source_id", "idx"])
    )
    chunks = _chunks(located, chunk_words)
    # Few rows out of an expensive pass, read several times below: stored once.
    runs = checkpointed(chunks.mapInArrow(_run_finder(chunk_words), _RUNS))
    is_open = F.col("open_left") | F.col("open_right")
    touches = F.col("open_left") & F.col("prev_open") & (F.col("prev_end") == F.col("start"))
    edge = split_runs(
        runs.where(is_open), ["source_id", "period"], ["start"],
        lag={"prev_end": "end", "prev_open": "open_right"}, uses=["open_left"],
        starts=~F.coalesce(touches, F.lit(False)), name="run", width=width * chunk_words,
    )
    joined = (
        edge
        .groupBy("source_id", "period", "run")
        .agg(
            F.min("start").alias("start"), F.max("end").alias("end"),
            *[F.min_by(c, "start").alias(c) for c in ("first_idx", "start_seconds")],
            *[F.max_by(c, "start").alias(c) for c in ("last_idx", "end_seconds")],
        )
    )
    period = F.col("period")
    every = runs.where(~is_open).drop("open_left", "open_right").unionByName(joined.drop("run"))
    needed = F.greatest(MIN_CYCLES * period, F.lit(MIN_LOOP_WORDS))
    return every.where(F.col("end") - F.col("start") + period >= needed).select(
        "source_id", (F.col("start") - period).alias("start"), "end", "period",
        "first_idx", "start_seconds", "last_idx", "end_seconds",
    )


def merged_ranges(candidates: DataFrame, *, width: int = 1 << 20) -> DataFrame:
    """Overlapping candidates of a source as one; period null when a later one reaches further."""
    # Candidates are few; the two passes below read them from storage, not from the text again.
    rows = checkpointed(candidates).withColumn("rev_end", -F.col("end"))
    order = ["start", "rev_end", "period"]
    rows = ordered(rows, ["source_id"], order, before={"reach": ("max", "end")}, width=width)
    fresh = F.col("reach").isNull() | (F.col("start") >= F.col("reach"))
    rows = rows.withColumn("extends", ~fresh & (F.col("end") > F.col("reach")))
    rows = islands(rows, ["source_id"], order, fresh, "island", width=width)
    return (
        rows.groupBy("source_id", "island")
        .agg(
            F.min("start").alias("start"), F.max("end").alias("end"),
            F.bool_or("extends").alias("mixed"),
            F.min_by("period", F.struct(*order)).alias("first_period"),
            *[F.min_by(c, F.struct(*order)).alias(c) for c in ("first_idx", "start_seconds")],
            *[F.max_by(c, "end").alias(c) for c in ("last_idx", "end_seconds")],
        )
        .select(
            "source_id", "start", "end", F.when(~F.col("mixed"), F.col("first_period")).alias("period"),
            "first_idx", "start_seconds", "last_idx", "end_seconds",
        )
    )


def loop_findings(ranges: DataFrame) -> DataFrame:
    """Loops with the times of the segments that hold their first and last word."""
    return ranges.select(
        "source_id", "start_seconds", "end_seconds", F.lit("repeated_phrase_loop").alias("category"),
        (F.col("end") - F.col("start")).alias("repeated_word_count"),
        F.col("period").alias("phrase_word_count"),
        (F.col("last_idx") - F.col("first_idx") + 1).alias("segment_count"),
    )


_WINDOW = "source_id string, bucket bigint, start_seconds double, end_seconds double, word_count bigint, ratio double, shown_ratio double"


def _window_ratios(batches):
    """Sorted rows stream by; only the open window's compressor is held."""
    key, state = None, None
    out = []

    def close():
        packed = state["bytes"] + len(state["z"].flush())
        if state["words"] >= MIN_WINDOW_WORDS:
            ratio = state["raw"] / packed
            out.append((*key, state["start"], state["end"], state["words"], ratio, round(ratio, 4)))

    def drain():
        columns = list(zip(*out))
        out.clear()
        types = [pa.string(), pa.int64(), pa.float64(), pa.float64(), pa.int64(), pa.float64(), pa.float64()]
        names = [c.split(" ")[0] for c in _WINDOW.split(", ")]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=names)

    for batch in batches:
        names = ("source_id", "bucket", "start_seconds", "end_seconds", "text")
        for source, bucket, start, end, text in zip(*(batch.column(n).to_pylist() for n in names)):
            if (source, bucket) != key:
                if key is not None:
                    close()
                key = (source, bucket)
                state = {"z": zlib.compressobj(), "bytes": 0, "raw": 0, "words": 0, "start": start}
                raw = text.encode("utf-8")
            else:
                raw = b" " + text.encode("utf-8")
            state["bytes"] += len(state["z"].compress(raw))
            state["raw"] += len(raw)
            state["words"] += len(folded_words(text))
            state["end"] = end
        if out:
            yield drain()
    if key is not None:
        close()
    if out:
        yield drain()


def window_ratios(segments: DataFrame) -> DataFrame:
    """Compression ratio of every 30-second window with at least 40 words.

    Deflate is one sequential stream per window, so a window is one pass; rows
    arrive sorted and are never held together.
    """
    bucket = F.greatest(F.lit(0), F.floor(F.col("start_seconds") / WINDOW_SECONDS)).cast("bigint")
    rows = segments.select("source_id", bucket.alias("bucket"), "idx", "start_seconds", "end_seconds", "text")
    return (
        rows.repartition("source_id", "bucket")
        .sortWithinPartitions("source_id", "bucket", "idx")
        .mapInArrow(_window_ratios, _WINDOW)
    )


def compression_findings(segments: DataFrame) -> DataFrame:
    return window_ratios(segments).where(F.col("ratio") > MAX_RATIO).select(
        "source_id", "start_seconds", "end_seconds", F.lit("high_compression_ratio").alias("category"),
        F.col("shown_ratio").alias("compression_ratio"),
    )


def timestamp_findings(violations: DataFrame) -> DataFrame:
    return violations.select(
        "source_id", (F.col("start_ms") / 1000).alias("start_seconds"),
        (F.col("end_ms") / 1000).alias("end_seconds"), F.lit("invalid_timestamp").alias("category"),
        "reason", "segment",
    )


def empty_findings(counts: DataFrame) -> DataFrame:
    """``counts``: source_id, segment_count, word_count of every known source."""
    return counts.where("word_count = 0").select(
        "source_id", F.lit(0.0).alias("start_seconds"), F.lit(0.0).alias("end_seconds"),
        F.lit("empty_transcript").alias("category"), "segment_count",
    )


def glossary_findings(sources: DataFrame, terms: Column, max_context: Column) -> DataFrame:
    """Sources whose glossary cannot reach the decoder; terms themselves are not shown."""
    return sources.where((F.size(terms) > 0) & (F.coalesce(max_context, F.lit(0)) == 0)).select(
        "source_id", F.lit(0.0).alias("start_seconds"), F.lit(0.0).alias("end_seconds"),
        F.lit("glossary_context_disabled").alias("category"),
    )


def word_counts(counts: DataFrame, audits: DataFrame | None = None) -> DataFrame:
    """Segments and words of every source with segments (``counted``) or an audit."""
    counts = counts.groupBy("source_id").agg(
        F.count(F.lit(1)).alias("segment_count"), F.sum("word_count").alias("word_count")
    )
    if audits is not None:
        counts = counts.join(audits.select("source_id", F.col("valid").alias("timestamp_valid")), "source_id", "full")
    else:
        counts = counts.withColumn("timestamp_valid", F.lit(None).cast("boolean"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).alias(c)
    return counts.select("source_id", zero("segment_count"), zero("word_count"), "timestamp_valid")


def findings(
    segments: DataFrame, *, counts: DataFrame | None = None, audits: DataFrame | None = None,
    violations: DataFrame | None = None, settings: DataFrame | None = None, compression: bool = True, width: int = BLOCK_ROWS,
    chunk_words: int = CHUNK_WORDS,
) -> DataFrame:
    """All findings as one long table with sparse columns.

    ``audits`` and ``violations`` bring the timestamp gate, ``settings`` (source_id, terms,
    max_context) the glossary gate; timing that is not audited is not assessed.
    """
    counts = counts if counts is not None else counted(segments)
    ranges = merged_ranges(loop_candidates(segments, counts=counts, width=width, chunk_words=chunk_words))
    parts = [empty_findings(word_counts(counts, audits)), loop_findings(ranges)]
    if compression:
        parts.append(compression_findings(segments))
    if violations is not None:
        parts.append(timestamp_findings(violations))
    if settings is not None:
        known = settings.join(word_counts(counts, audits).select("source_id"), "source_id", "left_semi")
        parts.append(glossary_findings(known, F.col("terms"), F.col("max_context")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out


def by_source(
    segments: DataFrame, found: DataFrame, audits: DataFrame | None = None, *, counts: DataFrame | None = None
) -> DataFrame:
    """Per-source summary: status, timing, segment, word and finding counts."""
    counts = counts if counts is not None else counted(segments)
    totals = found.groupBy("source_id").agg(F.count(F.lit(1)).alias("finding_count"))
    n = F.coalesce(F.col("finding_count"), F.lit(0))
    return word_counts(counts, audits).join(totals, "source_id", "left").select(
        "source_id", F.when(n > 0, "review_required").otherwise("passed_checks").alias("status"),
        "timestamp_valid", "segment_count", "word_count", n.alias("finding_count"),
    )


def all_valid(flag: str) -> Column:
    """AND of a three-valued flag: null unless every row was assessed."""
    n, known = F.count(F.lit(1)), F.count(F.col(flag))
    return F.when((n > 0) & (n == known), F.bool_and(F.col(flag)))


def verdict(summary: DataFrame, found: DataFrame, keys: list[str], asked: DataFrame | None = None) -> DataFrame:
    """One verdict per ``keys`` (e.g. a run): any finding asks for review.

    ``summary`` and ``found`` carry ``keys`` columns. Reasons are a sorted set of categories.
    ``asked`` lists all keys: one without any source is an empty transcript.
    """
    if asked is not None:
        bare = asked.select(*keys).distinct().join(summary.select(*keys), keys, "left_anti")
        found = found.select(*keys, "category").unionByName(bare.withColumn("category", F.lit("empty_transcript")))
    reasons = found.groupBy(*keys).agg(F.array_sort(F.collect_set("category")).alias("reasons"))
    timing = summary.groupBy(*keys).agg(all_valid("timestamp_valid").alias("timestamp_valid"))
    none = F.array().cast("array<string>")
    return timing.join(reasons, keys, "full").select(
        *keys, F.coalesce("reasons", none).alias("reasons"),
        F.when(F.size(F.coalesce("reasons", none)) > 0, "review_required").otherwise("passed_checks").alias("status"),
        "timestamp_valid", F.lit(False).alias("accuracy_verified"),
    )


# Listening flags.
MARKER = r"(?i)\[(?:blank_audio|music|silence)\]|\(inaudible\)"
REPETITION_MIN_WORDS = 12
REPETITION_SHARE = 0.3


def segment_flags(tokens: Column, start: Column, end: Column, text: Column) -> dict[str, Column]:
    repetitive = (F.size(tokens) >= REPETITION_MIN_WORDS) & (
        F.size(F.array_distinct(tokens)) / F.size(tokens) < REPETITION_SHARE
    )
    return {
        "high_internal_repetition": repetitive,
        "zero_length_timestamp": end <= start,
        "non_speech_or_inaudible_marker": text.rlike(MARKER),
    }


def review_flags(segments: DataFrame, *, width: int = TEXT_BLOCK_ROWS) -> DataFrame:
    """Segments worth a listen, with their reasons; equal neighbours only within a source."""
    rows = segments.withColumn("t", tokens_ws("text"))
    own = segment_flags(F.col("t"), F.col("start_seconds"), F.col("end_seconds"), F.col("text"))
    rows = rows.select(
        "source_id", "idx", "start_seconds", "end_seconds",
        F.when(F.size("t") > 0, F.sha2(F.array_join("t", " "), 256)).alias("digest"),
        F.array_compact(F.array(*[F.when(c, F.lit(n)) for n, c in own.items()])).alias("own"),
    )
    rows = ordered(rows, ["source_id"], ["idx"], lag={"prev_digest": "digest"}, width=width)
    same = F.col("digest") == F.col("prev_digest")
    reasons = F.concat(
        F.when(same, F.array(F.lit("identical_adjacent_segment"))).otherwise(F.array().cast("array<string>")),
        F.col("own"),
    )
    return rows.withColumn("reasons", reasons).where(F.size("reasons") > 0).select(
        "source_id", "idx", "start_seconds", "end_seconds", "reasons"
    )
