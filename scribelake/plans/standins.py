"""Stand-in tables: the engine's inputs derived from the shared tables.

Each builder has a SQL twin (``*_SQL``, a CTE) that derives the same rows.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scribelake.session import shared_folder

FOLD = "replace(lower({0}), 'ß', 'ss')"
WORDS_SQL = r"regexp_extract_all(replace(lower({0}), 'ß', 'ss'), '[\p{{L}}\p{{N}}_]+(?:[''’][\p{{L}}\p{{N}}_]+)*')"
WS_SQL = r"list_filter(string_split_regex(replace(lower({0}), 'ß', 'ss'), '[\s\p{{Z}}]+'), lambda x: x <> '')"


def turns(t) -> DataFrame:
    """Conversation turns as decoder segments, with deterministic timing defects."""
    conv, turn = F.col("conv_id"), F.col("turn")
    start = (
        turn * 5000 + (conv * 37 % 20) * 10
        - F.when((conv % 13 == 0) & (turn == 0), 700).otherwise(0)
        - F.when(((conv + turn) % 29 == 3) & (turn > 0), 5100).otherwise(0)
    )
    length = F.when((conv * 3 + turn) % 31 == 5, -10).otherwise(4800)
    return t.conversations.select(
        F.concat(F.lit("src-"), conv.cast("string")).alias("source_id"),
        (turn + 1).cast("int").alias("idx"), "text",
        start.cast("bigint").alias("from_ms"), (start + length).cast("bigint").alias("to_ms"),
    )


TURNS_SQL = """turns AS (
  SELECT 'src-' || conv_id AS source_id, CAST(turn + 1 AS INTEGER) AS idx, text, from_ms,
         from_ms + CASE WHEN (conv_id * 3 + turn) % 31 = 5 THEN -10 ELSE 4800 END AS to_ms
  FROM (SELECT *, turn * 5000 + (conv_id * 37 % 20) * 10
          - CASE WHEN conv_id % 13 = 0 AND turn = 0 THEN 700 ELSE 0 END
          - CASE WHEN (conv_id + turn) % 29 = 3 AND turn > 0 THEN 5100 ELSE 0 END AS from_ms
        FROM conversations))"""


def clocks(t) -> DataFrame:
    """Exact length of each conversation: on the tick, within it, short and long."""
    n = t.conversations.groupBy("conv_id").agg((F.max("turn") + 1).alias("n"))
    rate = F.when(F.col("conv_id") % 3 == 0, 16000).when(F.col("conv_id") % 3 == 1, 44100).otherwise(48000)
    end_ms = (F.col("n") - 1) * 5000 + (F.col("conv_id") * 37 % 20) * 10 + 4800
    spare = (
        F.when(F.col("conv_id") % 4 == 0, -F.col("rate"))
        .when(F.col("conv_id") % 4 == 1, F.call_function("div", F.col("rate"), F.lit(100)) - 1)
        .when(F.col("conv_id") % 4 == 2, F.lit(0))
        .otherwise(F.col("rate") * 2)
    )
    return (
        n.withColumn("rate", rate.cast("int")).withColumn("end_ms", end_ms)
        .select(
            F.concat(F.lit("src-"), F.col("conv_id").cast("string")).alias("source_id"),
            (F.call_function("div", F.col("end_ms") * F.col("rate"), F.lit(1000)) - spare).cast("bigint").alias("frames"),
            "rate",
        )
    )


CLOCKS_SQL = """clocks AS (
  SELECT 'src-' || conv_id AS source_id, rate,
         (end_ms * rate) // 1000 - CASE conv_id % 4 WHEN 0 THEN -rate WHEN 1 THEN rate // 100 - 1
                                                    WHEN 2 THEN 0 ELSE rate * 2 END AS frames
  FROM (SELECT conv_id, CASE conv_id % 3 WHEN 0 THEN 16000 WHEN 1 THEN 44100 ELSE 48000 END AS rate,
               max(turn) * 5000 + (conv_id * 37 % 20) * 10 + 4800 AS end_ms
        FROM conversations GROUP BY conv_id))"""


def audit_sql(segments: str, clocks: str, prefix: str = "") -> str:
    """CTEs that audit the times of ``segments`` against ``clocks``; the last is ``{prefix}audited``."""
    return f""", {prefix}placed AS (
  SELECT t.*, c.frames, c.rate,
         lag(from_ms) OVER w AS prev_from, lag(to_ms) OVER w AS prev_to, lead(idx) OVER w IS NULL AS is_last
  FROM {segments} t JOIN {clocks} c USING (source_id)
  WINDOW w AS (PARTITION BY source_id ORDER BY idx)), {prefix}ticked AS (
  SELECT *, is_last AND from_ms >= 0 AND from_ms * rate < 1000 * frames AND to_ms * rate > 1000 * frames
            AND to_ms % 10 = 0 AND to_ms = 10 * ((100 * frames + rate - 1) // rate) AS normalized
  FROM {prefix}placed), {prefix}audited AS (
  SELECT *, list_filter([
      CASE WHEN from_ms < 0 THEN 'negative_start' END,
      CASE WHEN to_ms < from_ms THEN 'end_before_start' END,
      CASE WHEN from_ms < prev_from THEN 'nonmonotonic_start' END,
      CASE WHEN to_ms < prev_to THEN 'nonmonotonic_end' END,
      CASE WHEN from_ms * rate > 1000 * frames THEN 'start_after_eof' END,
      CASE WHEN to_ms * rate > 1000 * frames AND NOT normalized THEN 'end_after_eof' END], lambda x: x IS NOT NULL) AS reasons
  FROM {prefix}ticked)"""


AUDIT_SQL = TURNS_SQL + ", " + CLOCKS_SQL + audit_sql("turns", "clocks")


def lines(t) -> DataFrame:
    """Document lines as two-second segments."""
    return t.documents.select(
        F.concat(F.lit("doc-"), F.col("doc_id").cast("string")).alias("source_id"),
        F.posexplode(F.split("text", "\n")).alias("pos", "text"),
    ).select(
        "source_id", (F.col("pos") + 1).alias("idx"),
        (F.col("pos") * 2.0).alias("start_seconds"), ((F.col("pos") + 1) * 2.0).alias("end_seconds"), "text",
    )


LINES_SQL = """lines AS (
  SELECT source_id, idx, (idx - 1) * 2.0::DOUBLE AS start_seconds, idx * 2.0::DOUBLE AS end_seconds, text
  FROM (SELECT 'doc-' || doc_id AS source_id, unnest(string_split(text, chr(10))) AS text,
               generate_subscripts(string_split(text, chr(10)), 1) AS idx FROM documents))"""


def line_times(t) -> DataFrame:
    """Times of document lines as a decoder gave them, without their text: some begin before zero."""
    early = (F.col("doc_id") % 13 == 0) & (F.col("pos") == 0)
    counts = t.documents.select("doc_id", F.explode(F.sequence(F.lit(0), F.size(F.split("text", "\n")) - 1)).alias("pos"))
    return counts.select(
        F.concat(F.lit("doc-"), F.col("doc_id").cast("string")).alias("source_id"), (F.col("pos") + 1).alias("idx"),
        (F.col("pos") * 2000 - F.when(early, 700).otherwise(0)).cast("bigint").alias("from_ms"),
        (F.col("pos") * 2000 + 2000).cast("bigint").alias("to_ms"),
    )


def line_clocks(t) -> DataFrame:
    """Exact length of each document's recording: long, within the last tick, exact, and short."""
    n = F.size(F.split("text", "\n")).cast("bigint")
    spare = F.when(F.col("doc_id") % 4 == 0, -16000).when(F.col("doc_id") % 4 == 1, 159).when(F.col("doc_id") % 4 == 2, 0).otherwise(32000)
    return t.documents.select(
        F.concat(F.lit("doc-"), F.col("doc_id").cast("string")).alias("source_id"), (n * 32000 - spare).cast("bigint").alias("frames"),
        F.lit(16000).alias("rate"),
    )


def glossaries(t) -> DataFrame:
    """Decoder settings per document: some have terms, some a context."""
    return t.documents.select(
        F.concat(F.lit("doc-"), F.col("doc_id").cast("string")).alias("source_id"),
        F.when(F.col("doc_id") % 6 == 0, F.array(F.col("source"))).alias("terms"),
        F.when(F.col("doc_id") % 4 == 0, 224).alias("max_context"),
    )


LINE_AUDIT_SQL = """line_times AS (
  SELECT source_id, idx, (idx - 1) * 2000 - CASE WHEN doc_id % 13 = 0 AND idx = 1 THEN 700 ELSE 0 END AS from_ms, idx * 2000 AS to_ms
  FROM (SELECT doc_id, 'doc-' || doc_id AS source_id, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS idx FROM documents)), line_clocks AS (
  SELECT 'doc-' || doc_id AS source_id, 16000 AS rate, len(string_split(text, chr(10))) * 32000 - CASE doc_id % 4 WHEN 0 THEN -16000 WHEN 1 THEN 159 WHEN 2 THEN 0 ELSE 32000 END AS frames
  FROM documents)""" + audit_sql("line_times", "line_clocks", "line_")


def _two(c):
    return F.lpad(c.cast("string"), 2, "0")


def entries(t) -> DataFrame:
    """Order lines as report entries: an order is a batch, a part its bytes."""
    day = F.date_format("l_shipdate", "yyMMdd")
    clock = F.concat(_two(F.col("l_linenumber") + 8), _two(F.col("l_suppkey") % 60), _two(F.col("l_partkey") % 60))
    state = (
        F.when(F.col("l_returnflag") == "R", "review_required")
        .when((F.col("l_returnflag") == "A") & (F.col("l_linestatus") == "F"), "failed")
        .when((F.col("l_returnflag") == "A") & (F.col("l_linestatus") == "O"), "cancelled")
        .otherwise("completed")
    )
    return t.lineitem.select(
        F.concat(F.lit("b-"), F.col("l_orderkey").cast("string")).alias("batch_id"),
        ((F.col("l_linenumber") * 100000000 + F.col("l_partkey")) * 1000000 + F.col("l_suppkey")).alias("position"),
        F.when(F.col("l_discount") == 0, F.concat(F.lit("notes_"), F.col("l_partkey").cast("string"), F.lit(".wav")))
        .otherwise(F.concat(F.lit("audio_"), day, F.lit("_"), clock, F.lit(".wav"))).alias("filename"),
        state.alias("state"),
        F.sha2(F.concat(F.lit("part-"), F.col("l_partkey").cast("string")), 256).alias("sha256"),
        (F.col("l_quantity") * 60).alias("duration_seconds"),
        F.when(F.col("l_tax") == 0.08, F.concat(F.date_format("l_shipdate", "yyyy-MM-dd"), F.lit("T09:30:00+02:00")))
        .when(F.col("l_tax") == 0.07, F.lit("2024-02-30T00:00:00")).alias("recorded_at"),
    )


def copy_key() -> Column:
    """The batch and the bytes of an entry: the digest of a copy in 32 bytes, not 64 digits."""
    none = F.lit("").cast("binary")
    return F.concat(F.coalesce(F.unhex("sha256"), none), F.coalesce(F.col("batch_id").cast("binary"), none))


ENTRIES_SQL = """entries AS (
  SELECT 'b-' || l_orderkey AS batch_id, (l_linenumber::BIGINT * 100000000 + l_partkey) * 1000000 + l_suppkey AS position,
         CASE WHEN l_discount = 0 THEN 'notes_' || l_partkey || '.wav'
              ELSE 'audio_' || strftime(l_shipdate, '%y%m%d') || '_' || lpad((l_linenumber + 8)::VARCHAR, 2, '0')
                   || lpad((l_suppkey % 60)::VARCHAR, 2, '0') || lpad((l_partkey % 60)::VARCHAR, 2, '0') || '.wav' END AS filename,
         CASE WHEN l_returnflag = 'R' THEN 'review_required' WHEN l_returnflag = 'A' AND l_linestatus = 'F' THEN 'failed'
              WHEN l_returnflag = 'A' AND l_linestatus = 'O' THEN 'cancelled' ELSE 'completed' END AS state,
         sha256('part-' || l_partkey) AS sha256, l_quantity * 60 AS duration_seconds,
         CASE WHEN l_tax = 0.08 THEN strftime(l_shipdate, '%Y-%m-%d') || 'T09:30:00+02:00'
              WHEN l_tax = 0.07 THEN '2024-02-30T00:00:00' END AS recorded_at
  FROM lineitem)"""

CLOCKED_SQL = ENTRIES_SQL + r""", clocked AS (
  SELECT *, CASE WHEN recorded_at LIKE '%+02:00' THEN 'explicit_metadata' WHEN recorded_at IS NOT NULL THEN 'invalid_explicit_metadata'
                 WHEN named IS NOT NULL THEN 'filename' ELSE 'unknown' END AS provenance,
         CASE WHEN recorded_at LIKE '%+02:00' THEN left(recorded_at, 10) WHEN recorded_at IS NULL THEN strftime(named, '%Y-%m-%d') END AS date,
         CASE WHEN recorded_at LIKE '%+02:00' THEN substr(recorded_at, 12, 8) WHEN recorded_at IS NULL THEN strftime(named, '%H:%M:%S') END AS time,
         CASE WHEN recorded_at LIKE '%+02:00' THEN 'UTC+02:00' END AS timezone,
         CASE WHEN recorded_at LIKE '%+02:00' THEN recorded_at WHEN recorded_at IS NULL THEN strftime(named, '%Y-%m-%dT%H:%M:%S') END AS shown_at
  FROM (SELECT *, try_strptime('20' || regexp_extract(filename, '^audio_(\d{6})_(\d{6})(?:_[^.]+)?\.[A-Za-z0-9]+$', 1)
                   || regexp_extract(filename, '^audio_(\d{6})_(\d{6})(?:_[^.]+)?\.[A-Za-z0-9]+$', 2), '%Y%m%d%H%M%S') AS named FROM entries))"""


def results(t) -> DataFrame:
    """Documents as published results."""
    doc = F.col("doc_id").cast("string")
    at = F.concat(F.lit("2024-01-"), _two(F.col("n_chars") % 28 + 1), F.lit("T10:00:00+00:00"))
    return t.documents.select(
        F.concat(F.lit("r-"), doc).alias("result_id"),
        F.concat("source", F.lit("_"), "lang", F.lit("_"), doc, F.lit(".wav")).alias("filename"),
        F.sha2("text", 256).alias("source_sha256"), F.col("source").alias("session_id"),
        F.concat(F.lit("doc-"), doc).alias("source_id"), F.concat(F.lit("run-"), "lang").alias("run_id"),
        F.when(F.col("lang") == "de", "review_required").otherwise("completed").alias("state"),
        F.when(F.col("lang") != "es", at).alias("generated_at"), (F.col("n_chars") / 10).alias("duration_seconds"),
        "lang", "text",
    )


RESULTS_SQL = """results AS (
  SELECT 'r-' || doc_id AS result_id, source || '_' || lang || '_' || doc_id || '.wav' AS filename, sha256(text) AS source_sha256,
         source AS session_id, 'doc-' || doc_id AS source_id, 'run-' || lang AS run_id,
         CASE WHEN lang = 'de' THEN 'review_required' ELSE 'completed' END AS state,
         CASE WHEN lang <> 'es' THEN '2024-01-' || lpad((n_chars % 28 + 1)::VARCHAR, 2, '0') || 'T10:00:00+00:00' END AS generated_at,
         n_chars / 10 AS duration_seconds, lang, text FROM documents)"""


def labels(t) -> DataFrame:
    return t.labels.select(
        F.concat(F.lit("r-"), F.col("doc_id").cast("string")).alias("result_id"),
        F.when(F.col("quality") == 1, "good course").alias("course"),
        F.when(F.col("toxic") == 1, "rude speaker").alias("speaker"), F.lit(None).cast("string").alias("event"),
    )


LABELS_SQL = """tags AS (
  SELECT 'r-' || doc_id AS result_id, CASE WHEN quality = 1 THEN 'good course' END AS course,
         CASE WHEN toxic = 1 THEN 'rude speaker' END AS speaker, NULL::VARCHAR AS event FROM labels)"""


def reports(t) -> DataFrame:
    """Orders as saved batch reports; partly shipped ones lie in the trash."""
    day = F.date_format("o_orderdate", "yyyy-MM-dd")
    zone = (
        F.when(F.col("o_orderpriority") == "1-URGENT", "").when(F.col("o_orderpriority") == "2-HIGH", "+02:00").otherwise("Z")
    )
    key = F.col("o_orderkey")
    return t.orders.select(
        F.concat(F.lit("b-"), key.cast("string")).alias("report_id"),
        F.concat(F.lit("Class of "), F.col("o_custkey").cast("string")).alias("title"),
        F.when(F.col("o_orderpriority") != "4-NOT SPECIFIED", day).alias("date"),
        F.when(F.col("o_orderpriority") != "5-LOW", F.concat(_two(key % 24), F.lit(":15:00"))).alias("start_time"),
        F.concat(day, F.lit("T"), _two(key % 24), F.lit(":00:00"), zone).alias("created_at"),
        F.when(F.col("o_orderstatus") == "P", day).alias("deleted_at"),
    )


REPORTS_SQL = """reports AS (
  SELECT 'b-' || o_orderkey AS report_id, 'Class of ' || o_custkey AS title,
         CASE WHEN o_orderpriority <> '4-NOT SPECIFIED' THEN strftime(o_orderdate, '%Y-%m-%d') END AS date,
         CASE WHEN o_orderpriority <> '5-LOW' THEN lpad((o_orderkey % 24)::VARCHAR, 2, '0') || ':15:00' END AS start_time,
         strftime(o_orderdate, '%Y-%m-%dT') || lpad((o_orderkey % 24)::VARCHAR, 2, '0') || ':00:00'
           || CASE o_orderpriority WHEN '1-URGENT' THEN '' WHEN '2-HIGH' THEN '+02:00' ELSE 'Z' END AS created_at,
         CASE WHEN o_orderstatus = 'P' THEN strftime(o_orderdate, '%Y-%m-%d') END AS deleted_at FROM orders)"""


def queue(t) -> DataFrame:
    """Orders as queue rows of their customer's list."""
    key = F.col("o_orderkey")
    return t.orders.select(
        F.concat(F.lit("list-"), F.col("o_custkey").cast("string")).alias("list_id"), key.alias("position"),
        F.concat(F.lit("j-"), key.cast("string")).alias("job_id"),
        F.concat(F.lit("/rec/"), F.col("o_custkey").cast("string"), F.lit(".wav")).alias("path"),
        F.when(F.col("o_orderstatus") == "F", "failed").when(F.col("o_orderstatus") == "O", "waiting").otherwise("processing").alias("state"),
        F.when(F.col("o_orderpriority") == "1-URGENT", F.concat(F.lit("r-"), key.cast("string"))).alias("result_id"),
        F.when(F.col("o_orderpriority") == "2-HIGH", F.sha2(F.col("o_custkey").cast("string"), 256)).alias("watched_version_key"),
        F.when(F.col("o_orderpriority") == "3-MEDIUM", "large-v3").otherwise("large-v3-turbo").alias("model"),
        (F.col("o_orderpriority") == "5-LOW").alias("force"), F.lit(True).alias("auto_start"),
        (F.col("o_orderpriority") == "4-NOT SPECIFIED").alias("deletion_pending"),
        F.lit("b-1").alias("batch_id"), F.lit("a-1").alias("attempt_id"), F.col("o_orderpriority").alias("message"),
    )


QUEUE_SQL = """queue AS (
  SELECT 'list-' || o_custkey AS list_id, o_orderkey AS position, 'j-' || o_orderkey AS job_id, '/rec/' || o_custkey || '.wav' AS path,
         CASE o_orderstatus WHEN 'F' THEN 'failed' WHEN 'O' THEN 'waiting' ELSE 'processing' END AS state,
         CASE WHEN o_orderpriority = '1-URGENT' THEN 'r-' || o_orderkey END AS result_id,
         CASE WHEN o_orderpriority = '2-HIGH' THEN sha256(o_custkey::VARCHAR) END AS watched_version_key,
         CASE WHEN o_orderpriority = '3-MEDIUM' THEN 'large-v3' ELSE 'large-v3-turbo' END AS model,
         o_orderpriority = '5-LOW' AS force, o_orderpriority = '4-NOT SPECIFIED' AS deletion_pending, o_orderpriority AS message FROM orders)"""


def watched(t) -> DataFrame:
    """Customers as watched files."""
    key = F.col("c_custkey").cast("string")
    return t.customer.select(
        F.concat(F.lit("/rec/"), F.when(F.col("c_acctbal") > 5000, "new-").otherwise(""), key, F.lit(".wav")).alias("path"),
        F.when(F.col("c_mktsegment") == "BUILDING", "processed").when(F.col("c_mktsegment") == "MACHINERY", "copying")
        .otherwise("ready").alias("state"),
        F.when(F.col("c_acctbal") > 0, F.sha2(key, 256)).otherwise("partial").alias("version_key"),
        F.col("c_mktsegment").alias("segment"),
    )


WATCHED_SQL = """watched AS (
  SELECT '/rec/' || CASE WHEN c_acctbal > 5000 THEN 'new-' ELSE '' END || c_custkey || '.wav' AS path,
         CASE c_mktsegment WHEN 'BUILDING' THEN 'processed' WHEN 'MACHINERY' THEN 'copying' ELSE 'ready' END AS state,
         CASE WHEN c_acctbal > 0 THEN sha256(c_custkey::VARCHAR) ELSE 'partial' END AS version_key, c_mktsegment AS segment FROM customer)"""


def telemetry(t) -> DataFrame:
    """Events as telemetry: ten batches, a job per user."""
    user = F.col("user_id")
    kind = (
        F.when(F.col("event_type") == "click", "stage_start").when(F.col("event_type") == "view", "stage_end")
        .when(F.col("event_type") == "purchase", "cache").otherwise("milestone")
    )
    return t.events.select(
        F.concat(F.lit("batch-"), (user % 10).cast("string")).alias("batch_id"), F.col("event_id").alias("sequence"),
        (F.col("event_id") / 4).alias("elapsed_seconds"), kind.alias("kind"),
        F.concat(F.lit("stage-"), (user % 4).cast("string")).alias("stage"),
        F.when(F.col("value") < 5, "batch_complete").otherwise(F.col("event_type")).alias("name"),
        F.when(user % 3 == 0, "transcript").when(user % 3 == 1, "report").otherwise("other").alias("cache"),
        (F.col("value") < 40).alias("hit"), F.when(F.col("value") > 100, "interrupted_or_failed").alias("outcome"),
        F.concat(F.lit("job-"), user.cast("string")).alias("job_id"), F.lit("a").alias("attempt_id"),
    )


TELEMETRY_SQL = """telemetry AS (
  SELECT 'batch-' || (user_id % 10) AS batch_id, event_id AS sequence, event_id / 4 AS elapsed_seconds,
         CASE event_type WHEN 'click' THEN 'stage_start' WHEN 'view' THEN 'stage_end' WHEN 'purchase' THEN 'cache' ELSE 'milestone' END AS kind,
         'stage-' || (user_id % 4) AS stage, CASE WHEN value < 5 THEN 'batch_complete' ELSE event_type END AS name,
         CASE user_id % 3 WHEN 0 THEN 'transcript' WHEN 1 THEN 'report' ELSE 'other' END AS cache, value < 40 AS hit,
         CASE WHEN value > 100 THEN 'interrupted_or_failed' END AS outcome, 'job-' || user_id AS job_id, 'a' AS attempt_id FROM events)"""


def progress(t) -> DataFrame:
    """Events as progress messages; error events arrive late, under an old number."""
    late = F.col("event_type") == "error"
    state = F.when(F.col("event_type") == "signup", "waiting").when(F.col("event_type") == "purchase", "completed").otherwise("processing")
    stage = (
        F.when(F.col("event_type") == "signup", "queued").when(F.col("event_type") == "purchase", "finished")
        .when(F.col("event_type") == "view", "transcribing").otherwise("preparing")
    )
    kind = (
        F.when(F.col("event_id") % 97 == 5, "admission").when(F.col("event_id") % 89 == 7, "drained")
        .when((F.col("event_id") % 7 == 3) & (F.col("user_id") % 10 == 9) & (F.col("event_id") > 700), "result")
        .when(F.col("event_type") == "view", "progress").otherwise("file")
    )
    return t.events.select(
        F.col("event_id").alias("arrival"), F.concat(F.lit("batch-"), (F.col("user_id") % 10).cast("string")).alias("batch_id"),
        (F.col("event_id") - F.when(late, 300).otherwise(0)).alias("seq"), F.col("value").alias("elapsed"), kind.alias("type"),
        F.concat(F.lit("job-"), F.col("user_id").cast("string")).alias("job_id"),
        F.when(F.col("value") < 60, "a1").otherwise("a2").alias("attempt_id"), F.col("user_id").cast("int").alias("index"),
        state.alias("state"), stage.alias("stage"), F.floor("value").cast("int").alias("percent"),
        (F.col("user_id") % 11).cast("int").alias("requested"), (F.col("event_id") % 7).cast("int").alias("admitted"),
        F.when(F.col("event_id") % 2 == 0, "memory").otherwise("").alias("reason"),
    )


PROGRESS_SQL = """progress AS (
  SELECT event_id AS arrival, 'batch-' || (user_id % 10) AS batch_id, event_id - CASE WHEN event_type = 'error' THEN 300 ELSE 0 END AS seq, value AS elapsed,
         CASE WHEN event_id % 97 = 5 THEN 'admission' WHEN event_id % 89 = 7 THEN 'drained' WHEN event_id % 7 = 3 AND user_id % 10 = 9 AND event_id > 700 THEN 'result'
              WHEN event_type = 'view' THEN 'progress' ELSE 'file' END AS type, 'job-' || user_id AS job_id, CASE WHEN value < 60 THEN 'a1' ELSE 'a2' END AS attempt_id,
         user_id AS index, CASE event_type WHEN 'signup' THEN 'waiting' WHEN 'purchase' THEN 'completed' ELSE 'processing' END AS state,
         CASE event_type WHEN 'signup' THEN 'queued' WHEN 'purchase' THEN 'finished' WHEN 'view' THEN 'transcribing' ELSE 'preparing' END AS stage,
         CAST(floor(value) AS INTEGER) AS percent, user_id % 11 AS requested, event_id % 7 AS admitted, CASE WHEN event_id % 2 = 0 THEN 'memory' ELSE '' END AS reason FROM events)"""


def sample_blocks(t) -> DataFrame:
    """Embeddings as stereo blocks of 32 frames; the label is the source."""
    x = F.transform("embedding", lambda v: v.cast("double") * 4)
    return t.embeddings.select(
        F.concat(F.lit("rec-"), F.col("label").cast("string")).alias("source_id"), F.col("vec_id").alias("block"),
        (F.col("vec_id") * 32).alias("start_frame"), F.lit(16000).alias("rate"),
        F.array(F.slice(x, 1, 32), F.slice(x, 33, 32)).alias("channels"),
    )


BLOCKS_SQL = """samples AS (
  SELECT source_id, block, (i - 1) // 32 AS channel, block * 32 + (i - 1) % 32 AS frame, v FROM (
    SELECT 'rec-' || label AS source_id, vec_id AS block, unnest(embedding)::DOUBLE * 4 AS v, generate_subscripts(embedding, 1) AS i FROM embeddings))"""


@F.pandas_udf(T.BinaryType())
def wav_bytes(embedding, clock):
    """A two-channel 32-bit float file holding the vector's values, with a clock chunk if there is a clock."""
    import struct

    import numpy as np

    def build(v, at):
        data = np.asarray(v, "<f4").tobytes()
        fmt = struct.pack("<HHIIHH", 3, 2, 16000, 16000 * 8, 8, 32)
        bext = b"" if at is None else b"bext" + struct.pack("<I", 602) + bytes(320) + at.encode().ljust(282, b"\0")
        body = b"WAVE" + bext + b"fmt " + struct.pack("<I", len(fmt)) + fmt + b"data" + struct.pack("<I", len(data)) + data
        return b"RIFF" + struct.pack("<I", len(body)) + body

    return embedding.combine(clock, build)


def recordings(t) -> DataFrame:
    """Embeddings as small files; some are cut short, some have no clock or one that is no date."""
    n = F.col("vec_id")
    month = F.when(n % 7 == 0, 13).otherwise(1 + n % 12)
    clock = F.when(n % 5 != 0, F.format_string("2024-%02d-%02d%02d:%02d:00", month, 1 + n % 28, n % 24, n % 60))
    whole = wav_bytes("embedding", clock)
    return t.embeddings.select(F.concat(F.lit("/rec/"), F.col("vec_id").cast("string"), F.lit(".wav")).alias("path"), "label", whole.alias("content")).withColumn(
        "content", F.when(F.col("label") == 3, F.substring("content", 1, 100)).otherwise(F.col("content"))
    )


def recording_files(t) -> str:
    """The same as files in a new folder that executors share; a task that runs again writes the same bytes."""
    from pyarrow import fs

    folder = f"{shared_folder(t.spark)}/recordings-{uuid.uuid4().hex}"

    def write(batches):
        system, inside = fs.FileSystem.from_uri(folder) if "://" in folder else (fs.LocalFileSystem(), folder.removeprefix("file:"))
        system.create_dir(inside, recursive=True)
        for batch in batches:
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                with system.open_output_stream(f"{inside}/{path.rsplit('/', 1)[-1]}") as file:
                    file.write(content)
            yield batch.select([0])

    recordings(t).select("path", "content").mapInArrow(write, "path string").count()
    return folder
