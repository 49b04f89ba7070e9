"""One result per recording: identity, labels, lookups, integrity, listing rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scribelake.functions.text import valid_sha
from scribelake.operators.joins import with_key_facts

# Representation names and terminal states.
SAMPLE_FORMATS = {
    "IEEE_FLOAT32": "float32", "IEEE_FLOAT64": "float64", "PCM_S16": "int16", "PCM_S24": "int24",
    "PCM_S32": "int32", "PCM16": "int16", "PCM24": "int24", "PCM32": "int32",
}
TERMINAL = ("completed", "review_required", "failed", "cancelled")
QUEUE_STATES = ("waiting", "checking", "processing", *TERMINAL)


def sha_of(*parts: Column) -> Column:
    """Identity of an ordered list of texts."""
    return F.sha2(F.to_json(F.array(*parts)), 256)


def result_id(*parts: Column) -> Column:
    return F.concat(F.lit("r-"), F.substring(sha_of(*parts), 1, 40))


def newest_first(rows: DataFrame, key: str, at: str, ident: str) -> DataFrame:
    """Rows of a key ranked newest first without gathering a key: the best one only."""
    best = F.max_by(F.struct(*[F.col(c) for c in rows.columns]), F.struct(F.coalesce(at, F.lit("")), ident))
    return rows.groupBy(key).agg(best.alias("b")).select("b.*")


def verified_by_hash(results: DataFrame) -> DataFrame:
    """Per content hash: verified results and the newest of them."""
    usable = results.where((F.col("source_integrity") == "verified") & (F.col("run_integrity") == "verified"))
    newest = F.struct(F.coalesce("generated_at", F.lit("")), "result_id")
    return usable.groupBy(F.col("source_sha256").alias("sha256")).agg(
        F.count(F.lit(1)).alias("existing"), F.max_by("result_id", newest).alias("newest_result"),
        F.max_by("generated_at", newest).alias("newest_at"),
    )


def lookup_by_hash(paths: DataFrame, results: DataFrame) -> DataFrame:
    """Each asked path with the number of verified results of its bytes and the newest.

    Copies are counted per hash before the join, so many paths of one much-copied
    recording do not multiply with its results.
    """
    return with_key_facts(paths, verified_by_hash(results), "sha256").withColumn(
        "existing", F.coalesce("existing", F.lit(0))
    )


def results_with_hash(results: DataFrame, sha256: str) -> DataFrame:
    """All verified results of one recording, newest first."""
    usable = results.where((F.col("source_integrity") == "verified") & (F.col("run_integrity") == "verified"))
    return usable.where(F.col("source_sha256") == sha256).orderBy(
        F.coalesce("generated_at", F.lit("")).desc(), F.col("result_id").desc()
    )


def not_adopted(historical: DataFrame, current: DataFrame) -> DataFrame:
    return historical.join(current.select("session_id", "source_id", "run_id"), ["session_id", "source_id", "run_id"], "left_anti")


def with_labels(results: DataFrame, labels: DataFrame) -> DataFrame:
    return results.join(labels.select("result_id", "course", "speaker", "event"), "result_id", "left")


def open_rows(queue: DataFrame, results: DataFrame, watched: DataFrame) -> DataFrame:
    """Queue rows, results no queue row links to, and watched files neither processed nor queued."""
    linked = queue.where("result_id IS NOT NULL").select("result_id").distinct()
    own = results.join(linked, "result_id", "left_anti")
    by_version = queue.select("path", F.col("watched_version_key").alias("version_key")).where(
        "version_key IS NOT NULL"
    ).distinct()
    busy = queue.where(F.col("state").isin("checking", "waiting", "processing") & F.col("result_id").isNull()).select("path").distinct()
    fresh = (
        watched.where(~F.col("state").isin("processed", "processed_candidate"))
        .join(by_version, ["path", "version_key"], "left_anti")
        .join(busy, "path", "left_anti")
    )
    row = lambda df, kind, ident: df.select(F.lit(kind).alias("kind"), F.col(ident).cast("string").alias("row_id"), "state")
    return row(queue, "job", "job_id").unionByName(row(own, "result", "result_id")).unionByName(row(fresh, "watched", "path"))


def startable(watched: DataFrame, queue: DataFrame, fences: DataFrame) -> DataFrame:
    """Ready files with a full version, not queued under it and not fenced."""
    queued = queue.select("path", F.col("watched_version_key").alias("version_key")).distinct()
    busy = queue.where(F.col("state").isin("checking", "waiting", "processing") & F.col("result_id").isNull()).select("path").distinct()
    return (
        watched.where((F.col("state") == "ready") & valid_sha("version_key"))
        .join(queued, ["path", "version_key"], "left_anti")
        .join(busy, "path", "left_anti")
        .join(fences.select("path", "version_key"), ["path", "version_key"], "left_anti")
    )


def accept_files(offered: DataFrame, queue: DataFrame) -> DataFrame:
    """Offered paths not already at work, each once (the first offer)."""
    busy = queue.where(F.col("state").isin("checking", "waiting", "processing")).select("path").distinct()
    once = offered.groupBy("path").agg(F.min("pos").alias("pos"))
    return once.join(busy, "path", "left_anti")


def source_integrity(results: DataFrame, observed: DataFrame) -> DataFrame:
    """verified / missing_or_changed / pending / not_applicable; texts stay readable.

    ``observed``: path, sha256, stat_before, stat_after.
    """
    o = observed.select(
        "path", F.col("sha256").alias("__sha"), F.col("stat_before").alias("__a"), F.col("stat_after").alias("__b")
    )
    same = (
        (F.col("__sha") == F.col("source_sha256")) & F.col("__a").eqNullSafe(F.col("__b"))
        & F.col("__a").isNotNull()
    )
    return results.join(o, "path", "left").withColumn(
        "source_integrity",
        F.when(F.col("kind") == "report", "not_applicable")
        .when(F.col("deferred"), "pending")
        .when(F.coalesce(same, F.lit(False)), "verified")
        .otherwise("missing_or_changed"),
    ).drop("__sha", "__a", "__b")


# Messages by integrity and state.
MESSAGES = {
    "pending": "Saved transcript is ready; original audio verification is pending.",
    "unavailable": "Original audio is unavailable or changed; playback and duplicate reuse are disabled. Saved transcript retained.",
    "review": "Saved transcript needs review.",
    "unverified": "Automatic checks do not establish recognition accuracy.",
}


def quality_message(integrity: Column, state: Column) -> Column:
    return (
        F.when(integrity == "pending", MESSAGES["pending"])
        .when(integrity != "verified", MESSAGES["unavailable"])
        .when(state == "review_required", MESSAGES["review"])
        .otherwise(MESSAGES["unverified"])
    )


def sample_format(name: Column) -> Column:
    known = F.create_map(*[F.lit(x) for pair in SAMPLE_FORMATS.items() for x in pair])
    return F.coalesce(known[name], name)


def available_formats(srt_valid: Column) -> Column:
    return F.array_compact(F.array(F.lit("md"), F.lit("txt"), F.lit("json"), F.when(srt_valid, F.lit("srt"))))


def batch_state(failed: Column, cancelled: Column, review: Column) -> Column:
    broken = (failed + cancelled) > 0
    return F.struct(
        F.when(broken, "partial").when(review > 0, "review_required").otherwise("completed").alias("state"),
        F.when(broken, "incomplete").when(review > 0, "review_required").otherwise("passed_checks").alias("quality"),
    )


def state_counts(entries: DataFrame, *keys: str) -> DataFrame:
    n = lambda s: F.count_if(F.col("state") == s)
    return entries.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("selected"), n("completed").alias("completed"),
        n("review_required").alias("review_required"), n("failed").alias("failed"),
        n("cancelled").alias("cancelled"), F.count("duplicate_of").alias("duplicates"),
    )


def enriched_terminal(events: DataFrame, published: DataFrame) -> DataFrame:
    """Result summary on terminal success events of published positions; others unchanged."""
    p = published.select("batch_id", "index", F.col("result_id").alias("__result"), F.col("duration_seconds").alias("__duration"))
    done = (F.col("type") == "file") & F.col("state").isin("completed", "review_required")
    return events.join(p, ["batch_id", "index"], "left").withColumns(
        {"result_id": F.when(done, F.col("__result")), "duration_seconds": F.when(done, F.col("__duration"))}
    ).drop("__result", "__duration")


# Shape of a generated report head.
REPORT_TITLE = "# Transcript Report"
PREAMBLE = (
    "Selected files: ",
    "Timestamps restart at zero for each source.",
    "All stored ASR text is retained.",
)


def reading_body(markdown: Column, integrity: Column) -> Column:
    """Text from the first heading after the generated head; null unless intact and recognised."""
    lines = F.split(markdown, "\n")
    first = lines[0] == REPORT_TITLE
    heads = F.filter(
        F.transform(lines, lambda l, i: F.when((i > 0) & (l.startswith("# ") | l.startswith("## ")), i)),
        lambda i: i.isNotNull(),
    )
    at = F.get(heads, F.lit(0))
    head = F.slice(lines, F.lit(1), F.coalesce(at, F.lit(0)))
    known = F.lit(True)
    for wanted in PREAMBLE:
        known = known & F.exists(head, _starts(wanted))
    body = F.array_join(F.slice(lines, F.coalesce(at, F.lit(0)) + 1, F.size(lines)), "\n")
    return F.when((integrity == "intact") & first & at.isNotNull() & known, body)


def _starts(text: str):
    return lambda line: line.startswith(text)


def report_integrity(text: Column, expected: Column) -> Column:
    return F.when(F.sha2(text, 256).eqNullSafe(expected), "intact").otherwise("modified")


def import_version(path: Column, seen_path: Column, seen_state: Column, version: Column) -> Column:
    ok = (path == seen_path) & (seen_state == "ready") & valid_sha(version)
    return F.when(ok, version)


def same_order(submitted: Column, saved: Column, saved_states: Column) -> Column:
    """Saved list equals the submitted one by position, and all its rows are terminal."""
    return (F.size(submitted) > 0) & (submitted == saved) & F.forall(saved_states, lambda s: s.isin(*TERMINAL))


def revalidated(stored: Column, provisional: Column, timing_ok: Column, quality: Column) -> Column:
    """Today's state of a stored result: never better than what the checks allow now."""
    doubtful = (
        provisional | ~F.coalesce(timing_ok, F.lit(False))
        | F.coalesce(quality, F.lit("unknown")).isin("unknown", "review_required")
    )
    return F.when(stored.isin("completed", "review_required") & doubtful, "review_required").otherwise(stored)


def inherited_version(asked: DataFrame, saved: DataFrame, keys: list[str]) -> DataFrame:
    """App version claimed by saved records of exactly the same run; conflict gives null."""
    pair = F.struct("app_version", "app_build")
    claims = saved.where(F.col("app_version").isNotNull() & (F.col("app_version") != "")).groupBy(*keys).agg(
        F.count_distinct(F.struct("app_version", F.coalesce("app_build", F.lit("")))).alias("__claims"),
        F.max(pair).alias("__claim"),
    )
    agreed = F.col("__claims") == 1
    return asked.join(claims, keys, "left").select(
        *asked.columns, F.when(agreed, F.col("__claim.app_version")).alias("app_version"),
        F.when(agreed, F.col("__claim.app_build")).alias("app_build"),
    )


# Queue rows


def restore_queue(paths: DataFrame, saved: DataFrame) -> DataFrame:
    """Restored queue rows: position and path must match, in-flight work waits again,
    an id seen at an earlier position is not kept."""
    s = saved.select(
        F.col("position"), F.col("path"), F.col("state").alias("__state"), F.col("message").alias("__message"),
        F.col("job_id").alias("__job"),
    )
    rows = paths.join(s, ["position", "path"], "left")
    known = F.when(F.col("__state").isin(*QUEUE_STATES), F.col("__state")).otherwise("waiting")
    unknown = F.col("__state").isNotNull() & ~F.col("__state").isin(*QUEUE_STATES)
    inflight = F.col("__state").isin("checking", "processing")
    firsts = rows.where("__job IS NOT NULL").groupBy("__job").agg(F.min("position").alias("__first"))
    return with_key_facts(rows, firsts, "__job").select(
        "position", "path", F.when(inflight, "waiting").otherwise(known).alias("state"),
        F.when(inflight, "interrupted").when(unknown, F.lit(None)).otherwise(F.col("__message")).alias("message"),
        F.when(F.col("position") == F.col("__first"), F.col("__job")).alias("kept_job_id"),
    )


def next_batch(queue: DataFrame, keys: list[str]) -> DataFrame:
    """Waiting auto-start rows sharing model and force with the first of them."""
    ready = queue.where((F.col("state") == "waiting") & F.col("auto_start") & ~F.col("deletion_pending"))
    lead = ready.groupBy(*keys).agg(F.min_by(F.struct("model", "force"), "position").alias("lead")).select(
        *keys, "lead.model", "lead.force"
    )
    return ready.join(lead, [*keys, "model", "force"], "left_semi")


def resuming(queue: DataFrame) -> DataFrame:
    """A retried row waits again without its batch; only a failed one starts afresh."""
    none = F.lit(None).cast("string")
    return queue.withColumns(
        {
            "force": F.col("force") | (F.col("state") == "failed"), "state": F.lit("waiting"),
            "batch_id": none, "attempt_id": none, "message": none, "auto_start": F.lit(True),
        }
    )


def permute(rows: DataFrame, answers: DataFrame) -> DataFrame:
    """Rows in the user's order where the answer is a permutation of 1..n, else none.

    ``rows``: list_id, row_no, path; ``answers``: list_id, slot, row_no.
    """
    size = rows.groupBy("list_id").agg(F.count(F.lit(1)).alias("__n"))
    given = answers.groupBy("list_id").agg(
        F.count(F.lit(1)).alias("__given"), F.count_distinct("row_no").alias("__distinct"),
        F.min("row_no").alias("__lo"), F.max("row_no").alias("__hi"),
    )
    good = size.join(given, "list_id").where("__given = __n AND __distinct = __n AND __lo = 1 AND __hi = __n")
    return answers.join(good.select("list_id"), "list_id", "left_semi").join(rows, ["list_id", "row_no"]).select(
        "list_id", "slot", "path"
    )
