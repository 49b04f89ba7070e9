"""Human listening reviews: which references count, and what they measure."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scribelake.functions.alignment import wer_counts
from scribelake.functions.clocks import iso_parts
from scribelake.functions.text import tokens_review
from scribelake.operators.joins import with_key_facts

# Review vocabulary.
CATEGORIES = (
    "technicalterm", "propernoun", "number", "negation", "logicalcondition", "math", "sentenceomission", "hallucination",
)
JUDGMENTS = ("correct", "incorrect", "unclear", "pending")
TAGS = (
    "technical_term_error", "missing_word", "inserted_hallucinated_word", "negation_condition_error", "number_error",
    "timestamp_problem", "unintelligible_source_audio",
)
PREFERENCES = ("baseline", "comparison", "same", "unclear")
UNCERTAINTY = (
    r"(?i)\?{3,}|[\[(（【][^\])）】\r\n]*(?:\b(?:inaudible|unclear|unintelligible)\b|听不清|无法听清|无法辨认|不清楚)[^\])）】\r\n]*[\])）】]"
)
AVAILABLE = ("completed", "review_required")
TOLERANCE = 1e-9


def zoned(c: str) -> Column:
    return F.coalesce(iso_parts(c)["offset"].isNotNull(), F.lit(False))


def attested(references: DataFrame, tokens: Column) -> DataFrame:
    """(usable, reject_reason) of each human reference; a draft is neither.

    Any reject reason fails the whole review, not one clip.
    """
    reason = (
        F.when(~F.coalesce("status", F.lit("not_verified")).isin("not_verified", "draft", "verified"), "unknown_status")
        .when(F.coalesce("status", F.lit("not_verified")) != "verified", None)
        .when(~F.coalesce("human_confirmed", F.lit(False)), "not_confirmed")
        .when(~(zoned("created_at") & zoned("updated_at") & zoned("verified_at")), "timestamp")
        .when(~F.sha2("human_text", 256).eqNullSafe(F.col("verified_text_sha256")), "text_changed")
        .when(F.col("human_text").rlike(UNCERTAINTY), "uncertainty_marker")
        .when(F.size(tokens) == 0, "no_tokens")
    )
    verified = F.coalesce("status", F.lit("not_verified")) == "verified"
    return references.withColumns(
        {"reject_reason": reason, "usable": verified & reason.isNull()}
    )


def scored(pairs: DataFrame, ref: str, hyp: str, usable: Column) -> DataFrame:
    """S, D, I, N and WER of each pair; nulls unless the reference counts.

    Alignment is quadratic, so pairs are dealt out evenly first: neither a hot
    clip nor a much-copied pair fills a task.
    """
    spread = pairs.repartition(int(pairs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    counts = wer_counts(F.when(usable, F.col(ref)), F.when(usable, F.col(hyp)))
    return spread.withColumn("w", counts).withColumns({c: F.col("w")[c] for c in ("S", "D", "I", "N")}).withColumn(
        "WER", F.when(F.col("N") > 0, (F.col("S") + F.col("D") + F.col("I")) / F.col("N"))
    ).drop("w")


def aggregate_wer(scores: DataFrame, *keys: str) -> DataFrame:
    """Token-weighted WER of the measured clips, never a mean of clip rates."""
    measured = F.col("N") > 0
    total = lambda c: F.sum(F.when(measured, F.col(c)))
    return scores.groupBy(*keys).agg(
        *[total(c).alias(c) for c in ("S", "D", "I", "N")], F.count_if(measured).alias("verified_clips"),
        F.count(F.lit(1)).alias("total_clips"),
    ).withColumn("WER", F.when(F.col("N") > 0, (F.col("S") + F.col("D") + F.col("I")) / F.col("N")))


# States whose text can be scored.
SCORABLE = ("completed", "review_required")


def score_review(references: DataFrame, hypotheses: DataFrame) -> DataFrame:
    """One row per review and candidate: refusal, status, counts and token-weighted WER.

    ``references``: review_id, clip_id and the columns of ``attested``; ``hypotheses``: review_id,
    clip_id, candidate, state, hyp_text. A single bad reference refuses its whole review; of the
    others only attested references are scored, against candidates that have a result.
    """
    refs = attested(references, tokens_review("human_text"))
    # A review's reasons are a set of at most seven names.
    about = refs.groupBy("review_id").agg(
        F.array_sort(F.collect_set("reject_reason")).alias("refused"), F.count(F.lit(1)).alias("clips"), F.count_if("usable").alias("verified")
    )
    status = (
        F.when(F.size("refused") > 0, "refused").when(F.col("verified") == F.col("clips"), "verified_references")
        .when(F.col("verified") > 0, "partially_verified").otherwise("awaiting_human_review")
    )
    about = about.select("review_id", "refused", status.alias("status"))
    rows = refs.select("review_id", "clip_id", "usable", tokens_review("human_text").alias("ref")).join(hypotheses, ["review_id", "clip_id"])
    rows = rows.join(about, "review_id").withColumn("hyp", tokens_review("hyp_text"))
    counts = scored(rows, "ref", "hyp", F.col("usable") & (F.size("refused") == 0) & F.col("state").isin(*SCORABLE))
    return aggregate_wer(counts, "review_id", "candidate").join(about, "review_id")


def judgment_counts(rows: DataFrame, candidates: DataFrame) -> DataFrame:
    """Category x judgment counts of verified rows per candidate, zeros shown.

    ``rows``: candidate, category, judgment, verified.
    """
    domain = candidates.select("candidate").distinct().select(
        "candidate", F.explode(F.array(*[F.lit(c) for c in CATEGORIES])).alias("category")
    ).select("candidate", "category", F.explode(F.array(*[F.lit(j) for j in JUDGMENTS])).alias("judgment"))
    n = rows.where("verified").groupBy("candidate", "category", "judgment").agg(F.count(F.lit(1)).alias("n"))
    return domain.join(n, ["candidate", "category", "judgment"], "left").withColumn("n", F.coalesce("n", F.lit(0)))


def term_accuracy(rows: DataFrame, *keys: str) -> DataFrame:
    """Correct share of verified technical terms, only when every one is decided and available."""
    term = F.col("category") == "technicalterm"
    verified = term & F.col("verified")
    decided = verified & F.col("judgment").isin("correct", "incorrect")
    counts = rows.groupBy(*keys).agg(
        F.count_if(verified).alias("terms"), F.count_if(decided).alias("decided"),
        F.count_if(decided & (F.col("judgment") == "correct")).alias("correct"),
        F.count_if(term & ~F.col("verified")).alias("unverified"),
        F.count_if(verified & ~F.col("available")).alias("unavailable"),
    )
    complete = (F.col("terms") > 0) & (F.col("decided") == F.col("terms")) & (F.col("unavailable") == 0)
    return counts.select(
        *keys, "terms", "decided", "correct", "unverified",
        F.when(complete, F.col("correct") / F.col("terms")).alias("term_accuracy"),
        F.when(F.col("unavailable") > 0, "candidate_unavailable").when(complete, "verified_subset")
        .when(F.col("terms") > 0, "incomplete_judgments").otherwise("not_measured").alias("status"),
    )


def phrase_occurrences(tokens: Column, phrase: Column) -> Column:
    """Overlapping occurrences of a phrase in a token list."""
    n, m = F.size(tokens), F.size(phrase)
    starts = F.when((m > 0) & (n >= m), F.sequence(F.lit(1), n - m + 1)).otherwise(F.array().cast("array<int>"))
    return F.size(F.filter(starts, lambda i: F.slice(tokens, i, m) == phrase))


def rows_in_clip(rows: DataFrame, clips: DataFrame) -> DataFrame:
    """Critical rows with whether their second lies inside their clip."""
    c = clips.select("clip_id", "source_start_seconds", "source_end_seconds")
    inside = F.col("source_seconds").isNull() | F.col("source_seconds").between(
        F.col("source_start_seconds"), F.col("source_end_seconds")
    )
    return with_key_facts(rows, c, "clip_id", "inner").withColumn("inside", inside)


def package_rules(clips: DataFrame) -> DataFrame:
    """Broken rules per clip of a review package.

    ``clips``: clip_id, start_frame, end_frame, sample_rate, source_start_seconds,
    source_end_seconds, frames, rate, preference, tags, copies (rows with this id).
    """
    near = lambda a, b: F.coalesce(F.abs(a - b) <= TOLERANCE, F.lit(False))
    rate = F.col("rate")
    checks = {
        "unique_id": (F.col("copies") == 1) & (F.col("clip_id") != ""),
        "bounds": (F.col("start_frame") >= 0) & (F.col("start_frame") < F.col("end_frame")) & (F.col("end_frame") <= F.col("frames")),
        "rate": F.col("sample_rate") == rate,
        "start_offset": near(F.col("source_start_seconds"), F.col("start_frame") / rate),
        "end_offset": near(F.col("source_end_seconds"), F.col("end_frame") / rate),
        "preference": F.col("preference").isNull() | F.col("preference").isin(*PREFERENCES),
        "tags": F.forall("tags", lambda t: t.isin(*TAGS)),
    }
    broken = F.array_compact(F.array(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(n)) for n, ok in checks.items()]))
    return clips.select("clip_id", F.explode(broken).alias("broken_rule"))


def critical_rules(rows: DataFrame) -> DataFrame:
    """Broken rules per critical row.

    ``rows``: clip_id, row_id, category, status, baseline, comparison, copies,
    inside, reference_sha256 (null unless attested), human_confirmed,
    verified_reference_sha256, snapshot_sha256, current_sha256, reference_text.
    """
    verified = F.col("status") == "verified"
    judged = F.col("baseline").isin(*JUDGMENTS) & F.col("comparison").isin(*JUDGMENTS)
    checks = {
        "unique_id": (F.col("copies") == 1) & (F.col("row_id") != ""),
        "category": F.col("category").isin(*CATEGORIES),
        "status": F.col("status").isin("pending", "unclear", "verified"),
        "inside_clip": F.col("inside"),
        "judgment": judged,
        "attested": ~verified | (F.col("reference_sha256").isNotNull() & F.col("human_confirmed")),
        "same_reference": ~verified | F.col("verified_reference_sha256").eqNullSafe(F.col("reference_sha256")),
        "snapshot": ~verified | F.col("snapshot_sha256").eqNullSafe(F.col("current_sha256")),
        "described": ~verified | (F.trim("reference_text") != ""),
    }
    broken = F.array_compact(F.array(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(n)) for n, ok in checks.items()]))
    return rows.select("clip_id", "row_id", F.explode(broken).alias("broken_rule"))


def review_status(references: DataFrame) -> DataFrame:
    n, v = F.count(F.lit(1)), F.count_if("usable")
    return references.agg(
        n.alias("clips"), v.alias("verified"),
        F.when((v == n) & (n > 0), "verified_references").when(v > 0, "partially_verified").otherwise("awaiting_human_review").alias("status"),
    )
