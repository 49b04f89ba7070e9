"""Spans, milestones, cache rates, process trees and log counters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scribelake.operators.ordered import BLOCK_ROWS, numbered, ordered, split_runs
from scribelake.session import checkpointed

SPAN_KEYS = ["batch_id", "job_id", "attempt_id", "stage"]

# Log line formats and markers.
TIMING = (
    r"^whisper_print_timings:\s+(load|fallback|mel|sample|encode|decode|batchd|prompt|total)\s+time\s*=\s*"
    r"([0-9]+(?:\.[0-9]+)?)\s*ms(?:\s*/\s*([0-9]+)\s+runs)?"
)
PROGRESS = r"^whisper_print_progress_callback: progress =\s+([0-9]{1,3})%\r?$"
BACKEND_PREFIX = r"^(ggml_metal|whisper_init|whisper_backend|system_info:)"
BACKEND_TERM = r"metal|gpu|device|backend|system_info"
BACKEND_PROOF = r"using device|gpu name|metal backend|found device"
ALLOCATION_MARK = r"ggml|metal|malloc|whisper"
ALLOCATION_MESSAGE = r"out of memory|failed to allocate|cannot allocate memory|allocation failed"
TAIL_BYTES = 65536
CACHE_KINDS = ("derived_audio", "transcript", "report", "decoder_receipt", "source_import")


def paired_spans(events: DataFrame, *, width: int = BLOCK_ROWS) -> DataFrame:
    """Each n-th start with the n-th end of its batch, job, attempt and stage."""
    edges = events.where(F.col("kind").isin("stage_start", "stage_end"))
    keyed = edges.withColumns({k: F.coalesce(k, F.lit("")) for k in ("job_id", "attempt_id")})
    nth = numbered(keyed, [*SPAN_KEYS, "kind"], ["sequence"], "nth", width=width)
    start, end = F.col("kind") == "stage_start", F.col("kind") == "stage_end"
    at = F.col("elapsed_seconds")
    return nth.groupBy(*SPAN_KEYS, "nth").agg(
        F.max(F.when(start, at)).alias("started_at"), F.max(F.when(end, at)).alias("ended_at"),
        F.max(F.when(end, F.coalesce("outcome", F.lit("completed")))).alias("outcome"),
    ).where("started_at IS NOT NULL AND ended_at IS NOT NULL").withColumn(
        "worker_seconds", F.col("ended_at") - F.col("started_at")
    )


def stage_totals(spans: DataFrame) -> DataFrame:
    """Worker seconds per stage; they overlap and are not wall time."""
    return spans.groupBy("batch_id", "stage").agg(F.sum("worker_seconds").alias("worker_seconds"))


def milestones(events: DataFrame, *, per_job: bool = False) -> DataFrame:
    keys = ["batch_id", "job_id", "name"] if per_job else ["batch_id", "name"]
    marks = events.where(F.col("kind") == "milestone")
    if per_job:
        marks = marks.where("job_id IS NOT NULL")
    return marks.groupBy(*keys).agg(F.min("elapsed_seconds").alias("first_elapsed"))


def throughput(events: DataFrame, audio: DataFrame, observed: str = "observed_seconds") -> DataFrame:
    """Batch wall time, and audio per wall second only once the batch is complete.

    ``audio``: batch_id, audio_seconds, observed_seconds.
    """
    done = events.where((F.col("kind") == "milestone") & (F.col("name") == "batch_complete")).groupBy("batch_id").agg(
        F.min("elapsed_seconds").alias("completed_at")
    )
    wall = F.coalesce("completed_at", observed)
    return audio.join(done, "batch_id", "left").select(
        "batch_id", wall.alias("batch_wall_seconds"), F.col(observed).alias("observation_wall_seconds"),
        F.col("completed_at").isNotNull().alias("batch_complete"),
        F.when(F.col("completed_at").isNotNull() & (wall > 0), F.col("audio_seconds") / wall).alias("audio_per_wall_second"),
    )


def cache_rates(events: DataFrame) -> DataFrame:
    hits = events.where((F.col("kind") == "cache") & F.col("cache").isin(*CACHE_KINDS))
    return hits.groupBy("cache").agg(
        F.count_if("hit").alias("hits"), F.count_if(~F.col("hit")).alias("misses"),
        F.avg(F.col("hit").cast("int")).alias("hit_rate"),
    )


def process_peaks(samples: DataFrame) -> DataFrame:
    """Sample count and sampled maximum per process; shared pages forbid a sum."""
    return samples.groupBy("pid").agg(
        F.count(F.lit(1)).alias("sample_count"), F.max("rss_bytes").alias("sampled_max_rss_bytes")
    )


def descendants(processes: DataFrame, root: Column) -> DataFrame:
    """The root and all processes below it, per sample: one join per tree level.

    ``processes``: sample, pid, ppid. Each level only joins the pids found in the
    level before; the loop ends with the tree and cannot cycle.
    """
    tree = processes.select("sample", "pid", "ppid")
    frontier = checkpointed(tree.where(F.col("pid") == root).select("sample", "pid"))
    members = frontier
    while not frontier.isEmpty():
        below = tree.join(frontier.select("sample", F.col("pid").alias("ppid")), ["sample", "ppid"], "left_semi")
        frontier = checkpointed(below.select("sample", "pid").join(members, ["sample", "pid"], "left_anti"))
        members = members.unionByName(frontier)
    return members


def swap_deltas(samples: DataFrame, *, width: int = BLOCK_ROWS) -> DataFrame:
    """New swap-outs since the sample before; a falling counter is unknown."""
    rows = ordered(samples, ["host"], ["sample"], lag={"prev_swapouts": "swapouts"}, width=width)
    delta = F.col("swapouts") - F.col("prev_swapouts")
    return rows.withColumn("swap_delta", F.when(delta >= 0, delta)).drop("prev_swapouts")


def log_counters(lines: DataFrame) -> DataFrame:
    """Timing counters of decoder logs; milliseconds become seconds."""
    line = F.trim("value")
    name = F.regexp_extract(line, TIMING, 1)
    runs = F.regexp_extract(line, TIMING, 3)
    return lines.where(line.rlike(TIMING)).select(
        "log_id", "line_no", F.when(name == "load", "model_load").otherwise(name).alias("counter"),
        (F.regexp_extract(line, TIMING, 2).cast("double") / 1000).alias("seconds"),
        F.when(runs != "", runs.try_cast("bigint")).alias("runs"),
    )


def log_progress(lines: DataFrame, *, width: int = BLOCK_ROWS) -> DataFrame:
    """Percent lines in 0..100 with the running maximum of their log."""
    percent = F.regexp_extract("value", PROGRESS, 1).try_cast("int")
    rows = lines.where(F.col("value").rlike(PROGRESS)).withColumn("percent", percent).where("percent BETWEEN 0 AND 100")
    return ordered(rows, ["log_id"], ["line_no"], upto={"reached": ("max", "percent")}, width=width)


def log_backend(lines: DataFrame) -> DataFrame:
    """Whether a log proves the accelerated backend; only infrastructure lines are read."""
    low = F.lower("value")
    marker = F.col("value").rlike(BACKEND_PREFIX) & low.rlike(BACKEND_TERM)
    return lines.groupBy("log_id").agg(
        F.count_if(marker).alias("markers"),
        (F.bool_or(marker & F.contains(low, F.lit("metal"))) & F.bool_or(marker & low.rlike(BACKEND_PROOF))).alias("metal_observed"),
    )


def log_allocation_failures(lines: DataFrame) -> DataFrame:
    """Whether the last 64 KiB of a log hold an allocation failure (marker and message)."""
    low = F.lower("value")
    failed = F.contains(low, F.lit("mtlcommandbuffererroroutofmemory")) | (
        low.rlike(ALLOCATION_MARK) & low.rlike(ALLOCATION_MESSAGE)
    )
    recent = F.col("end_offset") > F.col("log_bytes") - TAIL_BYTES
    return lines.groupBy("log_id").agg(F.bool_or(failed & recent).alias("allocation_failure"))


def stage_percent(events: DataFrame, *, block: Column | None = None, width: int = BLOCK_ROWS) -> DataFrame:
    """Percent never falls inside a stage and starts anew with each stage."""
    rows = split_runs(
        events, ["job_id"], ["seq"], lag={"prev_stage": "stage"}, uses=["stage"],
        starts=F.col("stage") != F.col("prev_stage"), name="stage_no", block=block, width=width,
    ).drop("prev_stage")
    valid = F.when(F.col("percent").between(0, 100), F.col("percent"))
    return ordered(
        rows, ["job_id", "stage_no"], ["seq"], upto={"shown_percent": ("max", valid)}, block=block, width=width
    )


def valid_event(
    states: tuple[str, ...] = (
        "waiting", "checking", "processing", "completed", "review_required", "failed", "cancelled"
    ),
    admission: Column | None = None,
) -> Column:
    """Schema check of a progress event before any state is touched.

    ``admission`` says whether an admission event is well formed (``valid_admission``);
    without it no such event is.
    """
    elapsed = F.col("elapsed")
    good = elapsed.isNotNull() & ~F.isnan(elapsed) & (elapsed >= 0) & (elapsed < F.lit(float("inf")))
    per_job = F.col("job_id").isNotNull() & F.col("attempt_id").isNotNull() & F.col("index").isNotNull()
    kind = F.col("type")
    return F.coalesce(
        (F.col("seq") >= 0)
        & F.when(kind.isin("file", "progress"), per_job & F.col("state").isin(*states) & (F.col("stage") != "") & good)
        .when(kind.isin("metadata", "drained", "cleanup_required"), per_job)
        .when(kind == "admission", F.lit(False) if admission is None else admission)
        .when(kind.isin("batch", "result", "cancelled", "error"), F.lit(True))
        .otherwise(False),
        F.lit(False),
    )


def valid_admission(requested: Column, admitted: Column, reason: Column) -> Column:
    return F.coalesce(
        requested.between(1, 9) & (admitted >= 0) & (admitted <= requested) & (reason != ""), F.lit(False)
    )


def run_rtf(decodes: DataFrame, *keys: str) -> DataFrame:
    return decodes.groupBy(*keys).agg(
        F.sum("elapsed_seconds").alias("inference_seconds"), F.sum("duration_seconds").alias("audio_seconds"),
        F.sum("segment_count").alias("segment_count"),
    ).withColumn("real_time_factor", F.try_divide("inference_seconds", "audio_seconds"))
