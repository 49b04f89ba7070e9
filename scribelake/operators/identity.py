"""Sources, sessions and runs: ordering, integrity, reuse of earlier work."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scribelake.functions.text import valid_id, valid_sha
from scribelake.operators.joins import with_key_facts

# Artifacts a finished run must have hashed, and session states that are busy.
REQUIRED = {
    "completed": [
        "transcript.txt", "transcript.md", "transcript.srt", "transcript.json", "resolved-config.yaml",
        "diagnostics.json", "review.md",
    ],
    "review_required": [
        "transcript.txt", "transcript.md", "transcript.json", "resolved-config.yaml", "diagnostics.json", "review.md",
    ],
}
BUSY = ("running", "processing", "importing", "active", "in_progress")


def listed_sources(sessions: DataFrame) -> DataFrame:
    """(session_id, pos, source_id) rows of session documents with a ``source_order`` list."""
    return sessions.select("session_id", F.posexplode("source_order").alias("pos", "source_id"))


def ordered_sources(order: DataFrame, sources: DataFrame) -> DataFrame:
    """Sources of a session with their position in its declared order.

    ``order``: session_id, pos, source_id rows (``listed_sources`` of documents).
    """
    return order.join(sources, ["session_id", "source_id"])


def sessions_with_hash(sources: DataFrame, hashes: DataFrame) -> DataFrame:
    return sources.join(hashes.select("sha256"), "sha256", "left_semi").select("session_id").distinct()


def live_or_archived(live: DataFrame, archived: DataFrame) -> DataFrame:
    """Sessions of both places; an id kept twice is ambiguous and given with its count."""
    every = live.withColumn("place", F.lit("live")).unionByName(archived.withColumn("place", F.lit("archive")))
    return every.groupBy("session_id").agg(
        F.count(F.lit(1)).alias("copies"), F.when(F.count(F.lit(1)) == 1, F.max("place")).alias("place")
    )


def source_rules(sources: DataFrame) -> DataFrame:
    """One row per broken rule of a managed or referenced source."""
    managed = F.coalesce("ownership", F.lit("managed")) == "managed"
    folders = F.split("path", "/")
    rules = {
        "source_id": valid_id("source_id"),
        "sha256": valid_sha("sha256"),
        "size": F.coalesce(F.col("size_bytes") >= 0, F.lit(False)),
        "order": F.col("order").eqNullSafe(F.col("listed_at")),
        "observed_size": F.col("size_bytes").eqNullSafe(F.col("observed_size")),
        "contained": ~managed | F.coalesce(
            (folders[0] == "source") & ~F.array_contains(folders, "..") & ~F.col("path").startswith("/"), F.lit(False)
        ),
        "basename": ~managed | F.element_at(folders, -1).eqNullSafe(F.col("basename")),
    }
    broken = F.array_compact(F.array(*[F.when(~ok, F.lit(name)) for name, ok in rules.items()]))
    return sources.select("session_id", "source_id", F.explode(broken).alias("broken_rule"))


def hashed_artifacts(manifests: DataFrame) -> DataFrame:
    """(run_id, path, expected) rows of manifests with a ``hashes`` map."""
    return manifests.select("run_id", F.explode("hashes").alias("path", "expected"))


def artifact_checks(runs: DataFrame, named: DataFrame, observed: DataFrame) -> DataFrame:
    """Whether every hashed artifact of a run is present, inside its folder and unchanged.

    ``runs``: run_id; ``named``: run_id, path, expected; ``observed``: run_id,
    path, sha256. A run without hashes is not verified.
    """
    seen = observed.select("run_id", "path", F.col("sha256").alias("__seen"))
    inside = ~F.col("path").startswith("/") & ~F.col("path").rlike(r"(^|/)\.\.(/|$)")
    rows = named.join(seen, ["run_id", "path"], "left").withColumn(
        "ok", inside & F.coalesce(F.col("__seen") == F.col("expected"), F.lit(False))
    )
    checked = rows.groupBy("run_id").agg(F.count(F.lit(1)).alias("artifacts"), F.bool_and("ok").alias("all_ok"))
    return runs.select("run_id").join(checked, "run_id", "left").select(
        "run_id", F.coalesce("artifacts", F.lit(0)).alias("artifacts"),
        F.coalesce("all_ok", F.lit(False)).alias("verified"),
    )


def has_required(state: Column, hashes: Column) -> Column:
    """State is terminal and every artifact that state needs is hashed."""
    missing = lambda s: F.size(F.array_except(F.array(*[F.lit(x) for x in REQUIRED[s]]), F.map_keys(hashes))) == 0
    return F.when(state == "completed", missing("completed")).when(
        state == "review_required", missing("review_required")
    ).otherwise(False)


def reusable_run(requests: DataFrame, runs: DataFrame, same: list[str], compatible: DataFrame | None = None) -> DataFrame:
    """Best earlier run per request: exact fingerprint first, then newest.

    ``runs`` must be intact and pass today's rules (``usable``) and be terminal
    successes; a newer failure therefore never hides an older success. Keys are
    null-safe. ``compatible``: pairs (wanted, saved) of transform identities also
    accepted; identical ones always are.
    """
    good = runs.where(F.col("usable") & F.col("state").isin("completed", "review_required"))
    if compatible is not None:
        own = requests.select("transform_identity").distinct().select(
            F.col("transform_identity").alias("wanted"), F.col("transform_identity").alias("saved")
        )
        pairs = own.unionByName(compatible.select("wanted", "saved")).distinct()
        asked = requests.join(pairs, requests["transform_identity"].eqNullSafe(pairs["wanted"]), "left").drop("wanted")
    else:
        asked = requests.withColumn("saved", F.col("transform_identity"))
    digest = lambda extra: F.sha2(F.to_json(F.struct(*[F.col(c).alias(c) for c in same], extra.alias("transform")), {"ignoreNullFields": "false"}), 256)
    asked = asked.withColumn("__identity", digest(F.col("saved")))
    # One best run per identity, and one per identity and fingerprint: a popular
    # identity is reduced before the join, and no pair of request and run is formed.
    kept = good.select(
        digest(F.col("transform_identity")).alias("__identity"), F.col("run_id"), "fingerprint",
        F.col("state").alias("reused_state"), F.coalesce("completed_at", F.lit("")).alias("at"),
    )
    newest = F.max(F.struct("at", F.col("run_id").alias("reused_run"), "reused_state"))
    exact = kept.groupBy("__identity", "fingerprint").agg(newest.alias("__exact"))
    any_ = kept.groupBy("__identity").agg(newest.alias("__any"))
    hit = with_key_facts(with_key_facts(asked, any_, "__identity", "inner"), exact, ["__identity", "fingerprint"])
    best = hit.groupBy("request_id").agg(F.max("__exact").alias("e"), F.max("__any").alias("a"))
    pick = lambda c: F.coalesce(F.col(f"e.{c}"), F.col(f"a.{c}")).alias(c)
    return requests.join(best, "request_id", "left").select(
        "request_id", pick("reused_run"), pick("reused_state"),
        F.when(F.col("a").isNotNull(), F.col("e").isNotNull()).alias("exact_fingerprint"),
    )


def negative_reuse(requests: DataFrame, failed: DataFrame, violations: DataFrame, same: list[str]) -> DataFrame:
    """Failed attempts with equal identity and a timing violation that still reproduces.

    They serve only to reject again, never as a result.
    """
    broken = failed.where(F.col("state") == "failed").join(violations.select("run_id").distinct(), "run_id", "left_semi")
    worst = broken.groupBy(*same).agg(F.max("run_id").alias("rejected_by_run"))
    on = [requests[c].eqNullSafe(worst[c]) for c in same]
    return requests.join(worst, on).select("request_id", "rejected_by_run")


def latest_success(runs: DataFrame, accepted: DataFrame) -> DataFrame:
    """Newest verified completed run per session; pending unless it is the accepted one."""
    newest = runs.where(F.col("verified") & (F.col("state") == "completed")).groupBy("session_id").agg(
        F.max_by("run_id", F.struct("completed_at", "run_id")).alias("latest_run")
    )
    return newest.join(accepted, "session_id", "left").select(
        "session_id", "latest_run", "accepted_run",
        F.when(F.col("accepted_run").eqNullSafe(F.col("latest_run")), "accepted").otherwise("pending").alias("acceptance"),
    )


def session_overview(sessions: DataFrame, sources: DataFrame, latest: DataFrame) -> DataFrame:
    n = sources.groupBy("session_id").agg(F.count(F.lit(1)).alias("source_count"))
    return sessions.join(n, "session_id", "left").join(latest, "session_id", "left").select(
        "session_id", "processing_status", F.coalesce("source_count", F.lit(0)).alias("source_count"),
        "latest_run", "accepted_run",
    )


def tree_digest(files: DataFrame, key: str, path: str, sha: str) -> DataFrame:
    """Digest of a set of (path, sha), whatever its size or order.

    Item hashes are summed word by word, which merges map-side, and the sums are hashed.
    """
    item = F.sha2(F.concat_ws(":", path, sha), 256)
    # Halves of the 32-bit words: their sums stay exact as long integers, which take a fraction of a decimal's memory and time.
    halves = [F.conv(F.substring("item", 1 + 4 * i, 4), 16, 10).cast("bigint").alias(f"h{i}") for i in range(16)]
    words = files.select(F.col(key), item.alias("item")).select(key, *halves)
    sums = words.groupBy(key).agg(F.count(F.lit(1)).alias("files"), *[F.sum(f"h{i}").alias(f"h{i}") for i in range(16)])
    word = lambda i: (F.col(f"h{2 * i}") % (1 << 16) * (1 << 16) + F.col(f"h{2 * i + 1}")) % (1 << 32)
    text = F.concat_ws(":", F.col("files").cast("string"), *[word(i).cast("string") for i in range(8)])
    return sums.select(key, "files", F.sha2(text, 256).alias("digest"))


def import_overlap(selections: DataFrame, sessions: DataFrame) -> DataFrame:
    """reuse when the ordered hashes equal a session's, conflict when they share one, else new.

    Both inputs: id, pos, sha256 rows. Order equality is equality of a digest over
    (pos, sha256); sharing is a semi-join on distinct hashes. No selection is
    paired with the sessions it touches.
    """
    place = F.col("pos").cast("string").alias("place")
    mine = tree_digest(selections.select("selection_id", place, "sha256"), "selection_id", "place", "sha256")
    theirs = tree_digest(sessions.select("session_id", place, "sha256"), "session_id", "place", "sha256")
    equal = theirs.groupBy("digest").agg(F.min("session_id").alias("reused_session"))
    shared = selections.join(sessions.select("sha256").distinct(), "sha256", "left_semi").select("selection_id").distinct()
    return (
        mine.join(equal, "digest", "left")
        .join(shared.withColumn("__shared", F.lit(True)), "selection_id", "left")
        .select(
            "selection_id", "reused_session",
            F.when(F.col("reused_session").isNotNull(), "reuse").when(F.col("__shared"), "conflict").otherwise("new").alias("decision"),
        )
    )


def referenced_unchanged(sources: DataFrame, observed: DataFrame, fields: list[str]) -> DataFrame:
    """External sources whose every stored stat field equals the observation of their path."""
    o = observed.select("path", *[F.col(f).alias(f"__{f}") for f in fields])
    equal = F.lit(True)
    for f in fields:
        equal = equal & (F.col(f).isNull() | F.coalesce(F.col(f) == F.col(f"__{f}"), F.lit(False)))
    return sources.join(o, "path", "left").withColumn("reusable", equal).drop(*[f"__{f}" for f in fields])


def snapshot_diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """missing, changed and new paths between two listings (path, version)."""
    a, b = old.select("path", F.col("version").alias("old")), new.select("path", F.col("version").alias("new"))
    return a.join(b, "path", "full").select(
        "path",
        F.when(F.col("new").isNull(), "missing").when(F.col("old").isNull(), "new")
        .when(F.col("old") != F.col("new"), "changed").otherwise("same").alias("change"),
    )


def shared_cancel(jobs: DataFrame, identified: Column) -> DataFrame:
    """Work of a key stops only when all its consumers are cancelled and all are known."""
    return jobs.groupBy("key").agg(
        F.count(F.lit(1)).alias("consumers"), (F.bool_and("cancelled") & F.bool_and(identified)).alias("stop")
    )


def archive(sessions: DataFrame, asked: DataFrame, year: str) -> DataFrame:
    """Asked, idle, live sessions move to a four-digit year; busy ones are refused."""
    marks = asked.select("session_id").distinct().withColumn("__asked", F.lit(True))
    rows = sessions.join(marks, "session_id", "left")
    busy = F.col("processing_status").isin(*BUSY)
    move = F.col("__asked") & F.col("archived_year").isNull() & ~busy & F.lit(year).rlike("^[0-9]{4}$")
    return rows.select(
        "session_id", "processing_status",
        F.when(move, F.lit(year)).otherwise(F.col("archived_year")).alias("archived_year"),
        F.coalesce(F.col("__asked") & F.col("archived_year").isNull() & busy, F.lit(False)).alias("refused"),
    )


def relink(results: DataFrame, candidates: DataFrame) -> DataFrame:
    """External paths replaced only where the candidate has the recorded bytes."""
    c = candidates.select("result_id", F.col("path").alias("__path"), F.col("sha256").alias("__sha"))
    ok = (F.col("ownership") == "external_referenced") & (F.col("__sha") == F.col("source_sha256"))
    return results.join(c, "result_id", "left").withColumns(
        {"external_path": F.when(ok, F.col("__path")).otherwise(F.col("external_path")),
         "relinked": F.coalesce(ok, F.lit(False))}
    ).drop("__path", "__sha")
