"""Report library: clocks, gap groups, search, sorting, facets, annotations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scribelake.functions.clocks import instant
from scribelake.functions.text import casefold, fold_nfc, natural_key, text_lines
from scribelake.operators.ordered import BLOCK_ROWS, numbered, split_runs
from scribelake.operators.joins import with_key_facts
from scribelake.session import stored

# Longest gap inside a group, and the UI state buckets.
GAP_SECONDS = 15 * 60
BUCKETS = {
    "processing": ["checking", "processing", "transcribing"],
    "waiting": ["ready", "copying", "waiting", "unavailable"],
    "completed": ["completed", "review_required"],
    "review": ["review_required"],
    "failed": ["failed"],
    "cancelled": ["cancelled"],
}


def plain_number(c: Column) -> Column:
    """A count of seconds as text without a trailing '.0'; six significant digits."""
    digits = F.floor(F.log10(F.greatest(F.abs(c), F.lit(1e-4))))
    scale = F.pow(F.lit(10.0), 5 - digits)
    return F.regexp_replace((F.bround(c * scale) / scale).cast("string"), r"\.0$", "")


def gap_groups(recordings: DataFrame, *, block: Column | None = None, width: int = BLOCK_ROWS) -> DataFrame:
    """Recordings of a batch with their proposed group and issue.

    ``recordings``: batch_id, pos, day, at_seconds (civil), offset, duration
    (null unknown). The gap runs from the previous end, in selection order.
    """
    uses = ["day", "at_seconds", "offset", "duration"]
    lag = {f"prev_{c}": c for c in uses}
    same_day = F.coalesce(F.col("day") == F.col("prev_day"), F.lit(False))
    same_zone = F.col("offset").eqNullSafe(F.col("prev_offset"))
    gap = F.col("at_seconds") - F.col("prev_at_seconds") - F.col("prev_duration")
    joins = same_day & same_zone & F.coalesce((gap >= 0) & (gap <= GAP_SECONDS), F.lit(False))
    rows = split_runs(
        recordings, ["batch_id"], ["pos"], lag=lag, uses=uses, starts=~joins, name="group_no",
        block=block, width=width,
    )
    issue = (
        F.when(~same_day, F.lit(None).cast("string"))
        .when(~same_zone, "timezone bases differ")
        .when(F.col("prev_duration").isNull(), "previous duration unknown")
        .when(gap < 0, "recording times overlap")
        .when((gap > 0) & (gap <= GAP_SECONDS), F.concat(plain_number(gap), F.lit(" second gap")))
        .when(gap > GAP_SECONDS, F.concat(F.bround(gap).cast("bigint").cast("string"), F.lit(" second gap; separate")))
    )
    return rows.withColumns({"gap_seconds": F.when(same_day & same_zone, gap), "issue": issue}).drop(*lag)


def group_spans(grouped: DataFrame) -> DataFrame:
    """One row per proposed group, from its first member."""
    first = lambda c: F.min_by(c, "pos")
    day, clock = first("day"), first("clock")
    return grouped.groupBy("batch_id", "group_no").agg(
        F.count(F.lit(1)).alias("members"), F.min("pos").alias("first_pos"), day.alias("date"),
        clock.alias("start_time"),
        F.coalesce(F.concat(F.substring(clock, 1, 5), F.lit(" recordings")), F.lit("Undated recordings")).alias("title"),
        F.when(day.isNotNull(), "suggested").otherwise("unknown").alias("status"),
        F.count("issue").alias("issue_count"),
    )


def single_value(c: str) -> Column:
    """The one distinct value, null counted as a value; null otherwise."""
    kinds = F.count_distinct(F.struct(F.col(c).isNull(), F.col(c)))
    return F.when(kinds == 1, F.max(c))


def single_known_value(c: str) -> Column:
    return F.when(F.min(c) == F.max(c), F.max(c))


def default_group(entries: DataFrame) -> DataFrame:
    """One unconfirmed group per batch when none was confirmed."""
    only_day = F.when(
        (F.count(F.lit(1)) == F.count("date")) & (F.min("date") == F.max("date")), F.max("date")
    )
    n = F.count(F.lit(1))
    return entries.groupBy("batch_id").agg(
        n.alias("members"), only_day.alias("date"), F.min_by("time", "position").alias("start_time"),
        F.concat(n.cast("string"), F.when(n == 1, " recording").otherwise(" recordings")).alias("title"),
        F.when(only_day.isNull(), "unknown")
        .when(F.bool_or(F.col("provenance") == "explicit_metadata"), "explicit_metadata")
        .otherwise("filename").alias("date_provenance"),
    )


def state_bucket(state: Column) -> Column:
    """All filters a state belongs to, besides ``all``."""
    return F.array_compact(
        F.array(F.lit("all"), *[F.when(state.isin(v), F.lit(k)) for k, v in BUCKETS.items()])
    )


def matches_text(haystack: Column, needle: str) -> Column:
    """Substring after casefolding both sides; an empty needle matches all."""
    wanted = needle.casefold().strip()
    return F.contains(casefold(haystack), F.lit(wanted)) if wanted else F.lit(True)


def library_search(reports: DataFrame, needle: str) -> DataFrame:
    """Reports whose title, dates or filenames hold the needle, else whose text does.

    The wide text is only folded for reports the short columns did not decide.
    """
    short = F.concat_ws(" ", "title", F.concat_ws(" ", "dates"), F.concat_ws(" ", "filenames"))
    marked = reports.withColumn("__short", matches_text(short, needle))
    by_text = matches_text(F.when(~F.col("__short"), F.col("report_text")), needle)
    return marked.where(F.col("__short") | F.coalesce(by_text, F.lit(False))).drop("__short")


def result_search(results: DataFrame, segments: DataFrame, labels: DataFrame, needle: str) -> DataFrame:
    """Results whose filename, labels or any segment text hold the needle."""
    with_labels = results.join(labels, "result_id", "left")
    tags = F.concat_ws("\n", "course", "speaker", "event")
    short = with_labels.where(matches_text(F.col("filename"), needle) | matches_text(tags, needle))
    spoken = segments.where(matches_text(F.col("text"), needle)).select("result_id")
    hit = short.select("result_id").unionByName(spoken).distinct()
    return results.join(hit, "result_id", "left_semi")


def line_matches(reports: DataFrame, needle: str) -> DataFrame:
    return (
        reports.select("report_id", F.posexplode(text_lines("report_text")).alias("pos", "text"))
        .where(F.contains(casefold("text"), F.lit(needle.casefold())) if needle else F.lit(False))
        .select("report_id", (F.col("pos") + 1).alias("line"), "text")
    )


def visible(records: DataFrame, deleted_results: DataFrame, deleted_scopes: DataFrame, epochs: DataFrame) -> DataFrame:
    """Records not fenced: by id, or by scope unless a new record of a current epoch."""
    scoped = records.join(deleted_results.select("result_id"), "result_id", "left_anti")
    fenced = deleted_scopes.select("scope").distinct().withColumn("__fenced", F.lit(True))
    now = epochs.select("scope", F.col("epoch").alias("__epoch"))
    rows = scoped.join(fenced, "scope", "left").join(now, "scope", "left")
    current = (F.col("kind") == "new") & (F.coalesce("lifecycle_epoch", F.lit(0)) >= F.coalesce("__epoch", F.lit(0)))
    return rows.where(F.col("__fenced").isNull() | current).drop("__fenced", "__epoch")


def with_annotations(reports: DataFrame, annotations: DataFrame) -> DataFrame:
    notes = annotations.select(
        F.col("report_id"), F.col("title").alias("__title"), F.col("deleted_at").alias("deleted_at")
    )
    return reports.join(notes, "report_id", "left").withColumn(
        "title", F.coalesce("__title", "title")
    ).drop("__title")


def in_view(reports: DataFrame, view: str) -> DataFrame:
    trashed = F.coalesce(F.col("deleted_at") != "", F.lit(False))
    return reports.where(trashed if view == "trash" else ~trashed)


def view_counts(reports: DataFrame) -> DataFrame:
    trashed = F.coalesce(F.col("deleted_at") != "", F.lit(False))
    return reports.agg(F.count_if(~trashed).alias("active_count"), F.count_if(trashed).alias("trash_count"))


def sort_recorded(reports: DataFrame) -> DataFrame:
    blank = lambda c: F.coalesce(F.col(c), F.lit("")).desc()
    return reports.orderBy(blank("date"), blank("start_time"), blank("created_at"), F.col("report_id").desc())


def sort_recent(reports: DataFrame) -> DataFrame:
    return reports.withColumn("created_instant", instant("created_at")).orderBy(
        F.col("created_instant").desc_nulls_last(), F.col("report_id").desc()
    )


def sort_rows(rows: DataFrame, mode: str) -> DataFrame:
    """``rows``: row_id, filename, imported_at, duration, state."""
    first = {
        "newest": [F.coalesce("imported_at", F.lit(0.0)).desc()],
        "filename": [natural_key("filename").asc()],
        "longest": [F.coalesce("duration", F.lit(-1.0)).desc()],
        "status": [F.col("state").asc()],
    }[mode]
    return rows.orderBy(*first, F.col("row_id").asc())


def natural_sort(paths: DataFrame, column: str = "path", *ties: str) -> DataFrame:
    return paths.orderBy(natural_key(column), F.col(column), *ties)


def per_date(reports: DataFrame) -> DataFrame:
    """Reports under each of their dates with that date's clock; dates newest first, unknown last."""
    rows = reports.select(
        "report_id", "created_at", F.explode("date_start_times").alias("d")
    ).select("report_id", "created_at", F.col("d.date").alias("date"), F.col("d.start_time").alias("start_time"))
    blank = lambda c: F.coalesce(F.col(c), F.lit("")).desc()
    return rows.orderBy(blank("date"), blank("start_time"), blank("created_at"), F.col("report_id").desc())


def date_facets(clocks: DataFrame, key: str) -> DataFrame:
    """Distinct dates of a report, null allowed, with the earliest known time of each."""
    return clocks.groupBy(key, "date").agg(F.min("time").alias("start_time"))


def unambiguous(rows: DataFrame, key: str) -> DataFrame:
    """Rows whose id occurs once; ids seen more often are dropped entirely."""
    once = rows.groupBy(key).agg(F.count(F.lit(1)).alias("__n")).where("__n = 1").select(key)
    return rows.join(once, key, "left_semi")


def known_recordings(sources: DataFrame, sessions: DataFrame) -> DataFrame:
    """Declared time per managed path; a session's time only if it has one source."""
    single = sources.groupBy("session_id").agg(F.count(F.lit(1)).alias("__n")).where("__n = 1").join(
        sessions.select("session_id", F.col("recorded_at").alias("__session_at")), "session_id"
    ).drop("__n")
    return with_key_facts(sources, single, "session_id").select(
        "path", F.coalesce("recorded_at", "__session_at").alias("recorded_at")
    )


def confirmed_partition(groups: DataFrame, sizes: DataFrame) -> DataFrame:
    """Whether the groups of a batch list every entry once, in order.

    ``groups``: batch_id, group_no, indices; ``sizes``: batch_id, entries.
    The flattened list is compared position by position, not collected.
    """
    members = groups.select(
        "batch_id", (F.col("group_no") * F.lit(1 << 32)).alias("g"), F.posexplode("indices").alias("at", "index")
    ).withColumn("slot", F.col("g") + F.col("at"))
    placed = numbered(members, ["batch_id"], ["slot"], "nth", width=1 << 40)
    checks = placed.groupBy("batch_id").agg(
        F.count(F.lit(1)).alias("listed"), F.bool_and(F.col("nth") - 1 == F.col("index")).alias("in_place")
    )
    return sizes.join(checks, "batch_id", "left").select(
        "batch_id",
        F.coalesce((F.col("listed") == F.col("entries")) & F.col("in_place"), F.lit(False)).alias("valid"),
    )


#: So many short hashes of keys that come again are looked up in every task; with more, all rows move to their keys.
AGAIN = 500_000


def coming_again(rows: DataFrame, key: str) -> DataFrame | None:
    """Rows whose key may come again, null keys left out; none if there are too many such keys, or nothing may be broadcast.

    Where keys seldom come again, only eight bytes a row are shuffled. Two keys of one hash are kept both, so whoever groups them is exact.
    """
    if rows.sparkSession.conf.get("spark.sql.autoBroadcastJoinThreshold").startswith("-"):
        return None
    short = rows.where(F.col(key).isNotNull()).withColumn("__short", F.xxhash64(key))
    again = stored(short.groupBy("__short").agg(F.count(F.lit(1)).alias("__n")).where("__n > 1").select("__short"), "again")
    return short.join(again, "__short", "left_semi").drop("__short") if again.count() <= AGAIN else None


def first_of_key(rows: DataFrame, key: str, pos: str, name: str = "duplicate_of", *, seldom: bool = False) -> DataFrame:
    """Position of the first row with the same key, null on that row itself.

    ``seldom``: most keys are expected once. One more pass over the rows, run at once, then finds those that come again, and only their rows
    move. Where more do than expected, all rows move as without it.
    """
    n = F.count(F.lit(1)).alias("__n")
    firsts, few = F.min(pos).alias("__first"), coming_again(rows.select(key, pos), key) if seldom else None
    if few is None:
        groups = rows.groupBy(key).agg(firsts, n)
    else:
        # Grouped once more, so that the optimizer sees one row a key and drops the join where nobody asks for duplicates.
        groups = stored(few.groupBy(key).agg(firsts, n), "firsts").groupBy(key).agg(F.min("__first").alias("__first"), F.sum("__n").alias("__n"))
    # A key of one row has no other: only keys that come again move to the join.
    firsts = groups.where("__n > 1").drop("__n")
    return with_key_facts(rows, firsts, key).withColumn(
        name, F.when(F.col("__first") < F.col(pos), F.col("__first"))
    ).drop("__first")


def name_collisions(sources: DataFrame) -> DataFrame:
    """Folded basenames already used earlier in the session get a folder of their own."""
    rows = sources.withColumn("folded", fold_nfc("basename"))
    firsts = rows.groupBy("session_id", "folded").agg(F.min("pos").alias("__first"))
    taken = F.col("pos") > F.col("__first")
    return with_key_facts(rows, firsts, ["session_id", "folded"], "inner").select(
        "session_id", "pos", "basename",
        F.when(taken, F.concat_ws("/", F.lit("source"), "source_id", "basename"))
        .otherwise(F.concat_ws("/", F.lit("source"), "basename")).alias("relative_path"),
    )


def reusable_report(requests: DataFrame, reports: DataFrame, trashed: DataFrame) -> DataFrame:
    """Newest intact, untrashed report of an equal fingerprint for each request."""
    intact = reports.where(
        (F.col("report_id") == F.col("folder")) & (F.sha2("report_text", 256) == F.col("report_sha256"))
    ).join(trashed.select("report_id"), "report_id", "left_anti")
    newest = intact.groupBy("fingerprint").agg(F.max("report_id").alias("reused_report"))
    return with_key_facts(requests, newest, "fingerprint")
