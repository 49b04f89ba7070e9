"""Purge planning as set algebra: what a selection owns minus what others still use.

Plans are tables; committing one writes tombstones and a new table version.
Files are never touched here.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scribelake.functions.text import strip
from scribelake.operators.identity import tree_digest


def selected_scopes(records: DataFrame, jobs: DataFrame, chosen_results: DataFrame, chosen_jobs: DataFrame) -> DataFrame:
    """Scopes reached by chosen results and chosen jobs."""
    a = records.join(chosen_results, "result_id", "left_semi").select("scope")
    b = jobs.join(chosen_jobs, "job_id", "left_semi").select("scope")
    return a.unionByName(b).where("scope IS NOT NULL").distinct()


def closure(records: DataFrame, jobs: DataFrame, scopes: DataFrame) -> DataFrame:
    """Every result variant and job of the scopes; active jobs must be stopped first."""
    variants = records.join(scopes, "scope", "left_semi").select(
        F.lit("result").alias("kind"), F.col("result_id").alias("id"), F.lit(False).alias("active")
    )
    work = jobs.join(scopes, "scope", "left_semi").select(
        F.lit("job").alias("kind"), F.col("job_id").alias("id"), (F.col("state") == "active").alias("active")
    )
    return variants.unionByName(work)


def retained_refs(consumers: DataFrame, scopes: DataFrame) -> DataFrame:
    """(session, source) still used by a consumer outside the selection.

    ``consumers``: session_id, source_id, scope (null for reports), visible.
    """
    outside = consumers.where("visible").join(scopes.withColumn("__in", F.lit(True)), "scope", "left").where("__in IS NULL")
    return outside.select("session_id", "source_id").distinct()


def removable_cache(cache: DataFrame, selected_hashes: DataFrame, retained_hashes: DataFrame) -> DataFrame:
    """Cached objects of selected bytes no retained source shares."""
    return cache.join(selected_hashes.select("sha256"), "sha256", "left_semi").join(
        retained_hashes.select("sha256"), "sha256", "left_anti"
    )


def solely_produced(runs: DataFrame, producers: DataFrame, chosen_jobs: DataFrame, deleted_jobs: DataFrame) -> DataFrame:
    """Runs with a chosen producer and no other live one."""
    outside = producers.join(chosen_jobs, "job_id", "left_anti").join(deleted_jobs, "job_id", "left_anti")
    inside = producers.join(chosen_jobs, "job_id", "left_semi")
    return runs.join(inside.select("run_id"), "run_id", "left_semi").join(outside.select("run_id"), "run_id", "left_anti")


def totals(targets: DataFrame, *keys: str) -> DataFrame:
    """Targets counted by path; bytes counted once per inode."""
    per_inode = targets.groupBy(*keys, "device", "inode").agg(
        F.count(F.lit(1)).alias("paths"), F.min("size").alias("size"), F.min("allocated").alias("allocated")
    )
    return per_inode.groupBy(*keys).agg(
        F.sum("paths").alias("item_count"), F.sum("size").alias("logical_bytes"),
        F.sum("allocated").alias("allocated_bytes"),
    )


def plan(sources: DataFrame, artifacts: DataFrame, refs: DataFrame, retained: DataFrame) -> DataFrame:
    """Artifacts of the selected refs with a decision and its reason.

    A session goes only when all its sources are selected and none is retained.
    """
    key = ["session_id", "source_id"]
    known = F.when(F.col("session_id").isNotNull() & F.col("source_id").isNotNull(), F.lit(1)).otherwise(F.lit(0))
    none = F.lit(0)

    def marks(rows: DataFrame, own: Column, chosen: Column, kept: Column) -> DataFrame:
        return rows.select(*key, own.alias("__own"), chosen.alias("__sel"), kept.alias("__kept"))

    # One aggregation for the three sets instead of joins that sort each of them: a null id equals none.
    every = marks(sources, F.lit(1), none, none).unionByName(marks(refs, none, known, none)).unionByName(marks(retained, none, none, known))
    marked = every.groupBy(*key).agg(*[F.max(c).alias(c) for c in ("__own", "__sel", "__kept")]).where("__own = 1")
    sessions = marked.groupBy("session_id").agg(
        F.sum("__sel").alias("chosen"), F.count(F.lit(1)).alias("all"), F.sum(F.col("__sel") * F.col("__kept")).alias("kept"),
    ).where("chosen > 0")
    decided = sessions.select(
        "session_id",
        F.when(F.col("chosen") < F.col("all"), "mixed_session")
        .when(F.col("kept") > 0, "used_elsewhere").otherwise("remove").alias("decision"),
    )
    return artifacts.join(decided, "session_id")


def token(planned: DataFrame, key: str, path: str, decision: str) -> DataFrame:
    return tree_digest(planned, key, path, decision)


def committed(results: DataFrame, targets: DataFrame, expected_token: Column, operations: DataFrame) -> DataFrame:
    """The next table version: targets removed, once, under a matching token.

    ``operations``: operation_id, plan_token already committed. Repeating one changes nothing.
    """
    allowed = targets.where(F.col("plan_token") == expected_token).join(
        operations.select("operation_id"), "operation_id", "left_anti"
    )
    return results.join(allowed.select("result_id"), "result_id", "left_anti")


def tombstones(scopes: DataFrame, epochs: DataFrame, operation_id: str) -> DataFrame:
    """Fences of newly deleted scopes, each one epoch later."""
    return scopes.join(epochs, "scope", "left").select(
        "scope", (F.coalesce("epoch", F.lit(0)) + 1).alias("epoch"), F.lit(operation_id).alias("operation_id")
    )


def publishable(incoming: DataFrame, jobs: DataFrame, epochs: DataFrame, pending: DataFrame) -> DataFrame:
    """Incoming results whose job lives, whose scope and epoch are current, and that no open purge covers."""
    j = jobs.select("job_id", F.col("state").alias("__state"), F.col("scope").alias("__scope"), F.col("epoch").alias("__bound"))
    e = epochs.select("scope", F.col("epoch").alias("__now"))
    return (
        incoming.join(pending.select("scope").distinct(), "scope", "left_anti")
        .join(j, "job_id")
        .join(e, "scope", "left")
        .where(
            (F.col("__state") != "deleted") & (F.col("__scope") == F.col("scope"))
            & (F.coalesce("__bound", F.lit(0)) == F.coalesce("__now", F.lit(0)))
        )
        .drop("__state", "__scope", "__bound", "__now")
    )


def bind_scopes(jobs: DataFrame, bindings: DataFrame, epochs: DataFrame) -> DataFrame:
    """Jobs with scope and the epoch current at first binding; a changed scope is refused."""
    b = bindings.select("job_id", F.col("scope").alias("__scope"))
    e = epochs.select(F.col("scope").alias("__scope"), F.col("epoch").alias("__epoch"))
    clash = F.col("scope").isNotNull() & (F.col("scope") != F.col("__scope"))
    return jobs.join(b, "job_id", "left").join(e, "__scope", "left").select(
        "job_id", F.coalesce("scope", "__scope").alias("scope"),
        F.when(F.coalesce("scope", "__scope").isNotNull(),
               F.coalesce("epoch", F.when(~F.coalesce(clash, F.lit(False)), F.col("__epoch")), F.lit(0))).alias("epoch"),
        F.coalesce(clash, F.lit(False)).alias("refused"),
    )


def add_active(selection: DataFrame, active: DataFrame, values: list[str]) -> DataFrame:
    """A plan's active jobs merged into the selection; the active values win."""
    a = active.select("job_id", *[F.col(v).alias(f"__{v}") for v in values])
    return selection.join(a, "job_id", "full").select(
        "job_id", *[F.coalesce(f"__{v}", v).alias(v) for v in values]
    )


def upsert(current: DataFrame, edits: DataFrame, key: str, values: list[str]) -> DataFrame:
    """Side-table rewrite: an edited key takes all its new values, others keep theirs."""
    e = edits.select(key, F.lit(True).alias("__edited"), *[F.col(v).alias(f"__{v}") for v in values])
    return current.join(e, key, "full").select(
        key, *[F.when(F.col("__edited"), F.col(f"__{v}")).otherwise(F.col(v)).alias(v) for v in values]
    )


def annotated(reports: DataFrame, edits: DataFrame) -> DataFrame:
    """Titles and trash marks after renaming, trashing or restoring; edits of unknown reports change nothing.

    ``edits``: report_id (once), action, new_title, at. Trashing again keeps the first mark.
    """
    e = edits.select("report_id", F.col("action").alias("__do"), F.col("new_title").alias("__title"), F.col("at").alias("__at"))
    do = F.col("__do")
    return reports.join(e, "report_id", "left").withColumns({
        "title": F.when(do == "rename", F.col("__title")).otherwise(F.col("title")),
        "deleted_at": F.when(do == "restore", F.lit(None)).when(do == "trash", F.coalesce("deleted_at", "__at")).otherwise(F.col("deleted_at")),
    }).drop("__do", "__title", "__at")


# Fixed value: longest label.
MAX_LABEL = 500


def relabelled(current: DataFrame, edits: DataFrame, key: str, labels: list[str]) -> DataFrame:
    """Trimmed labels of accepted edits; one label that is too long or holds a NUL refuses its edit."""
    good = F.lit(True)
    for c in labels:
        good = good & F.coalesce((F.length(c) <= MAX_LABEL) & ~F.contains(F.col(c), F.lit("\x00")), F.lit(True))
    accepted = edits.where(good).withColumns({c: clean_label(F.col(c)) for c in labels})
    known = accepted.join(current.select(key), key, "left_semi")
    return upsert(current, known, key, labels)


def clean_label(c: Column) -> Column:
    """Trimmed label; empty becomes null."""
    text = strip(c)
    return F.when(text != "", text)
