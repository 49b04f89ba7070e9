"""Telemetry, levels, review, audit, purge and export queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from scribelake.functions.text import REVIEW_TOKEN, agreement_ratio, compression_ratio, tokens_review, tokens_ws
from scribelake.operators import audit, exports, levels, review, timeline
from scribelake.operators import telemetry as tel
from scribelake.plans import standins as st
from scribelake.plans.catalog import query
from scribelake.session import checkpointed
from scribelake.sources import documents as docs
from scribelake.sources import logs, recordings, wav_source
from scribelake.streaming import progress as prog

# Telemetry

SPANS_SQL = f"""{st.TELEMETRY_SQL}, nth AS (
  SELECT *, row_number() OVER (PARTITION BY batch_id, job_id, attempt_id, stage, kind ORDER BY sequence) AS n FROM telemetry WHERE kind IN ('stage_start', 'stage_end')), spans AS (
  SELECT s.batch_id, s.job_id, s.attempt_id, s.stage, s.n AS nth, s.elapsed_seconds AS started_at, e.elapsed_seconds AS ended_at, coalesce(e.outcome, 'completed') AS outcome,
         e.elapsed_seconds - s.elapsed_seconds AS worker_seconds FROM nth s JOIN nth e USING (batch_id, job_id, attempt_id, stage, n) WHERE s.kind = 'stage_start' AND e.kind = 'stage_end')"""


@query("W13_pair_spans", f"WITH {SPANS_SQL} SELECT * FROM spans")
def w13(t):
    return tel.paired_spans(st.telemetry(t))


@query("A8_stage_totals", f"WITH {SPANS_SQL} SELECT batch_id, stage, sum(worker_seconds) AS worker_seconds FROM spans GROUP BY ALL")
def a8(t):
    return tel.stage_totals(tel.paired_spans(st.telemetry(t)))


@query("A9_milestones", f"WITH {st.TELEMETRY_SQL} SELECT batch_id, name, min(elapsed_seconds) AS first_elapsed FROM telemetry WHERE kind = 'milestone' GROUP BY ALL")
def a9(t):
    return tel.milestones(st.telemetry(t))


@query("A9_milestones_per_job", f"WITH {st.TELEMETRY_SQL} SELECT batch_id, job_id, name, min(elapsed_seconds) AS first_elapsed FROM telemetry WHERE kind = 'milestone' GROUP BY ALL")
def a9_job(t):
    return tel.milestones(st.telemetry(t), per_job=True)


@query("A10_throughput", f"""WITH {st.TELEMETRY_SQL}, a AS (SELECT 'batch-' || (user_id % 10) AS batch_id, count(*) * 60.0 AS audio, max(event_id) / 4 + 1 AS seen FROM events GROUP BY ALL), d AS (
  SELECT batch_id, min(elapsed_seconds) AS done FROM telemetry WHERE kind = 'milestone' AND name = 'batch_complete' GROUP BY batch_id)
SELECT batch_id, coalesce(done, seen) AS batch_wall_seconds, seen AS observation_wall_seconds, done IS NOT NULL AS batch_complete, round(CASE WHEN done > 0 THEN audio / done END, 6) AS audio_per_wall_second FROM a LEFT JOIN d USING (batch_id)""")
def a10(t):
    ev = st.telemetry(t)
    audio = ev.groupBy("batch_id").agg((F.count(F.lit(1)) * 60.0).alias("audio_seconds"), (F.max("elapsed_seconds") + 1).alias("observed_seconds"))
    return tel.throughput(ev, audio).withColumn("audio_per_wall_second", F.round("audio_per_wall_second", 6))


@query("A11_cache_rates", f"""WITH {st.TELEMETRY_SQL} SELECT cache, count(*) FILTER (hit) AS hits, count(*) FILTER (NOT hit) AS misses, round(avg(hit::INT), 6) AS hit_rate FROM telemetry WHERE kind = 'cache' AND cache <> 'other' GROUP BY cache""")
def a11(t):
    return tel.cache_rates(st.telemetry(t)).withColumn("hit_rate", F.round("hit_rate", 6))


@query("A12_process_max_rss", "SELECT l_suppkey AS pid, count(*) AS sample_count, max(CAST(l_extendedprice AS BIGINT) * 1024) AS sampled_max_rss_bytes FROM lineitem GROUP BY l_suppkey")
def a12(t):
    return tel.process_peaks(t.lineitem.select(F.col("l_suppkey").alias("pid"), (F.bround("l_extendedprice").cast("bigint") * 1024).alias("rss_bytes")))


@query("U6_transitive_members", """WITH RECURSIVE p AS (SELECT 1 AS sample, c_custkey + 1 AS pid, (c_custkey + 1) // 4 AS ppid FROM customer), m AS (
 SELECT sample, pid FROM p WHERE pid = 2 UNION ALL SELECT p.sample, p.pid FROM p JOIN m ON p.sample = m.sample AND p.ppid = m.pid) SELECT * FROM m""")
def u6(t):
    pid = F.col("c_custkey") + 1
    rows = t.customer.select(F.lit(1).alias("sample"), pid.alias("pid"), F.call_function("div", pid, F.lit(4)).alias("ppid"))
    return tel.descendants(rows, F.lit(2))


@query("W14_swap_delta", """WITH s AS (SELECT c_nationkey AS host, c_custkey AS sample, CAST(floor(c_acctbal) AS BIGINT) AS swapouts, CAST(floor(c_acctbal) AS BIGINT) - lag(CAST(floor(c_acctbal) AS BIGINT)) OVER (PARTITION BY c_nationkey ORDER BY c_custkey) AS d FROM customer)
SELECT host, sample, swapouts, CASE WHEN d >= 0 THEN d END AS swap_delta FROM s""")
def w14(t):
    return tel.swap_deltas(t.customer.select(F.col("c_nationkey").alias("host"), F.col("c_custkey").alias("sample"), F.floor("c_acctbal").cast("bigint").alias("swapouts")))


@query("A19_run_rtf", """SELECT l_orderkey AS run_id, sum(l_quantity) AS inference_seconds, sum(l_quantity * 10) AS audio_seconds, sum(l_linenumber) AS segment_count, round(sum(l_quantity) / sum(l_quantity * 10), 6) AS real_time_factor FROM lineitem GROUP BY l_orderkey""", bigint="segment_count")
def a19(t):
    rows = t.lineitem.select(
        F.col("l_orderkey").alias("run_id"), F.col("l_quantity").alias("elapsed_seconds"), (F.col("l_quantity") * 10).alias("duration_seconds"), F.col("l_linenumber").alias("segment_count")
    )
    return tel.run_rtf(rows, "run_id").withColumn("real_time_factor", F.round("real_time_factor", 6))


@query("S8_log_counters", """SELECT l_orderkey || '/' || l_linenumber || '/' || l_partkey AS log_id, l_suppkey AS line_no, CASE l_returnflag WHEN 'R' THEN 'model_load' WHEN 'A' THEN 'mel' ELSE 'total' END AS counter, round(round(l_extendedprice, 2) / 1000, 6) AS seconds, CASE WHEN l_linestatus = 'O' THEN l_partkey END AS runs FROM lineitem WHERE l_discount > 0""")
def s8(t):
    name = F.when(F.col("l_returnflag") == "R", "load").when(F.col("l_returnflag") == "A", "mel").otherwise("total")
    tail = F.when(F.col("l_linestatus") == "O", F.concat(F.lit(" / "), F.lpad(F.col("l_partkey").cast("string"), 8, " "), F.lit(" runs"))).otherwise("")
    line = F.concat(F.lit("whisper_print_timings: "), F.lpad(name, 8, " "), F.lit(" time = "), F.format_string("%10.2f", "l_extendedprice"), F.lit(" ms"), tail)
    rows = t.lineitem.select(
        F.concat_ws("/", "l_orderkey", "l_linenumber", "l_partkey").alias("log_id"), F.col("l_suppkey").alias("line_no"),
        F.when(F.col("l_discount") > 0, line).otherwise("main: spoken words").alias("value"),
    )
    return tel.log_counters(rows).withColumn("seconds", F.round("seconds", 6))


@query("S9_progress_log", """WITH e AS (SELECT user_id AS log_id, event_id AS line_no, CAST(floor(value) AS INTEGER) AS percent FROM events WHERE event_type <> 'error' AND floor(value) <= 100)
SELECT log_id, line_no, percent, max(percent) OVER (PARTITION BY log_id ORDER BY line_no) AS reached FROM e""")
def s9(t):
    line = F.concat(F.lit("whisper_print_progress_callback: progress = "), F.lpad(F.floor("value").cast("string"), 3, " "), F.lit("%"))
    rows = t.events.select(F.col("user_id").alias("log_id"), F.col("event_id").alias("line_no"), F.when(F.col("event_type") != "error", line).otherwise("error").alias("value"))
    return tel.log_progress(rows).select("log_id", "line_no", "percent", "reached")


@query("S10_backend_evidence", """SELECT user_id AS log_id, count(*) FILTER (event_type IN ('click', 'view')) AS markers, bool_or(event_type = 'click') AND bool_or(event_type = 'view') AS metal_observed FROM events GROUP BY user_id""")
def s10(t):
    line = F.when(F.col("event_type") == "click", "ggml_metal_init: allocating").when(F.col("event_type") == "view", "whisper_init_state: GPU name: X").otherwise("metal words spoken")
    return tel.log_backend(t.events.select(F.col("user_id").alias("log_id"), line.alias("value")))


@query("S10_allocation_failures", """WITH l AS (SELECT user_id AS log_id, event_type = 'error' AND value > 100 AS failed, sum(20) OVER (PARTITION BY user_id ORDER BY event_id) AS e, count(*) OVER (PARTITION BY user_id) * 20 AS total FROM events)
SELECT log_id, bool_or(failed AND e > total - 65536) AS allocation_failure FROM l GROUP BY log_id""")
def s10_alloc(t):
    from scribelake.operators.ordered import ordered

    line = F.when((F.col("event_type") == "error") & (F.col("value") > 100), "ggml: failed to allocate buffer").otherwise("ggml: fine")
    rows = t.events.select(F.col("user_id").alias("log_id"), F.col("event_id").alias("line_no"), line.alias("value"))
    placed = ordered(rows, ["log_id"], ["line_no"], upto={"end_offset": ("sum", F.lit(20))}, total={"log_bytes": ("sum", F.lit(20))})
    return tel.log_allocation_failures(placed)


@query("S13_sample_scan", """SELECT c_nationkey AS sample, c_custkey + 1 AS pid, (c_custkey + 1) // 4 AS ppid, CAST(floor(c_acctbal) AS BIGINT) * 1024 AS rss_bytes, 1.5::DOUBLE AS cpu_percent, 3723::DOUBLE AS cpu_seconds, 93784::DOUBLE AS process_elapsed_seconds FROM customer WHERE floor(c_acctbal) >= 0""")
def s13(t):
    pid = F.col("c_custkey") + 1
    line = F.concat_ws(" ", F.lit(""), pid.cast("string"), F.call_function("div", pid, F.lit(4)).cast("string"), F.floor("c_acctbal").cast("string"), F.lit("1.5"), F.lit("1:02:03"), F.lit("1-02:03:04"))
    return logs.process_rows(t.customer.select(F.col("c_nationkey").alias("sample"), line.alias("value")))


# Progress

# The oracle replays each batch event by event, carrying the last accepted number and one entry per job.
JUDGED_SQL = f"""RECURSIVE {st.PROGRESS_SQL}, placed AS (
  SELECT *, row_number() OVER (PARTITION BY batch_id ORDER BY arrival) AS nth,
         seq >= 0 AND CASE type WHEN 'admission' THEN requested BETWEEN 1 AND 9 AND admitted BETWEEN 0 AND requested AND reason <> '' ELSE true END AS valid FROM progress), fold AS (
  SELECT batch_id, 0::BIGINT AS nth, NULL::BIGINT AS arrival, -1::BIGINT AS last, false AS closed, MAP {{}}::MAP(VARCHAR, STRUCT(who VARCHAR, fin BOOLEAN)) AS jobs, '' AS verdict FROM (SELECT DISTINCT batch_id FROM placed)
  UNION ALL
  SELECT batch_id, nth, arrival, CASE WHEN v = 'accepted' THEN seq ELSE last END, closed OR (v = 'accepted' AND type = 'result'),
         CASE WHEN v = 'accepted' AND type IN ('file', 'progress') THEN map_concat(jobs, MAP {{job_id: {{'who': attempt_id, 'fin': state = 'completed'}}}}) ELSE jobs END, v
  FROM (SELECT *, CASE WHEN NOT valid THEN 'invalid' WHEN closed THEN 'batch_closed' WHEN seq <= last THEN 'stale' WHEN type IN ('admission', 'result') THEN 'accepted'
                       WHEN job IS NULL THEN CASE WHEN type = 'file' AND state = 'waiting' AND stage = 'queued' THEN 'accepted' ELSE 'unbound' END
                       WHEN job.who <> attempt_id THEN 'other_attempt' WHEN job.fin AND type <> 'drained' THEN 'job_ended' ELSE 'accepted' END AS v
        FROM (SELECT p.*, f.last, f.closed, f.jobs, map_extract_value(f.jobs, p.job_id) AS job FROM fold f JOIN placed p ON p.batch_id = f.batch_id AND p.nth = f.nth + 1))), judged AS (
  SELECT p.*, f.verdict FROM fold f JOIN placed p USING (batch_id, nth) WHERE f.nth > 0), acc AS (SELECT * FROM judged WHERE verdict = 'accepted'), l AS (
  SELECT batch_id, job_id, arg_max(state, seq) AS state, arg_max(stage, seq) AS stage, arg_max(attempt_id, seq) AS attempt_id, max(seq) AS last_seq, max(elapsed) AS elapsed, count(*) AS events FROM acc WHERE type IN ('file', 'progress') GROUP BY ALL), settled AS (
  SELECT l.*, (SELECT max(a.percent) FROM acc a WHERE a.batch_id = l.batch_id AND a.job_id = l.job_id AND a.type IN ('file', 'progress') AND a.stage = 'transcribing' AND l.stage = 'transcribing' AND a.percent BETWEEN 0 AND 100
     AND a.seq > coalesce((SELECT max(x.seq) FROM acc x WHERE x.batch_id = l.batch_id AND x.job_id = l.job_id AND x.type IN ('file', 'progress') AND x.stage <> l.stage), -1)) AS percent FROM l)"""


@query("R3_progress_state", f"WITH {JUDGED_SQL} SELECT batch_id, job_id, state, stage, attempt_id, last_seq, elapsed, percent, events FROM settled")
def r3(t):
    return prog.settled(_accepted(t))


def _accepted(t):
    return checkpointed(prog.judged(st.progress(t)).where("verdict = 'accepted'"))


@query("R4_stale_reject", f"WITH {JUDGED_SQL} SELECT arrival, verdict FROM judged")
def r4(t):
    return prog.judged(st.progress(t)).select("arrival", "verdict")


@query("R10_batch_rollup", f"""WITH {JUDGED_SQL} SELECT batch_id, count(*) AS jobs, count(*) FILTER (state = 'completed') AS completed, 0 AS review_required, 0 AS failed, 0 AS cancelled, count(*) FILTER (state = 'completed') AS finished,
 count(*) FILTER (state <> 'completed' AND stage = 'transcribing') AS decoding FROM settled GROUP BY batch_id""")
def r10(t):
    return prog.rollup(prog.settled(_accepted(t)))


@query("P24_event_valid", f"WITH {st.PROGRESS_SQL} SELECT arrival, seq >= 0 AND CASE type WHEN 'admission' THEN requested BETWEEN 1 AND 9 AND admitted BETWEEN 0 AND requested AND reason <> '' WHEN 'file' THEN stage <> 'finished' WHEN 'progress' THEN stage <> 'finished' ELSE true END AS valid FROM progress")
def p24(t):
    state = F.when(F.col("stage") == "finished", "odd").otherwise(F.col("state"))
    return st.progress(t).withColumn("state", state).select("arrival", tel.valid_event(admission=tel.valid_admission(F.col("requested"), F.col("admitted"), F.col("reason"))).alias("valid"))


@query("W9_running_percent", f"""WITH {st.PROGRESS_SQL}, c AS (SELECT *, lag(stage) OVER (PARTITION BY job_id ORDER BY arrival) AS p FROM progress), i AS (SELECT *, sum(CASE WHEN stage = p THEN 0 ELSE 1 END) OVER (PARTITION BY job_id ORDER BY arrival) AS stage_no FROM c)
SELECT job_id, arrival AS seq, stage, stage_no, max(CASE WHEN percent BETWEEN 0 AND 100 THEN percent END) OVER (PARTITION BY job_id, stage_no ORDER BY arrival) AS shown_percent FROM i""", bigint="stage_no")
def w9(t):
    rows = st.progress(t).drop("seq").withColumnRenamed("arrival", "seq")
    return tel.stage_percent(rows).select("job_id", "seq", "stage", "stage_no", "shown_percent")


# Levels

BLOCK_ROWS_SQL = f"""{st.BLOCKS_SQL}, ch AS (
  SELECT source_id, channel, count(*) AS frames, sum(v * v) AS q, sum(v) AS s, max(abs(v)) AS peak, arg_max(frame, (abs(v), -frame)) AS peak_frame, count(*) FILTER (abs(v) >= 1) AS clips, count(*) FILTER (v = 0) AS zeros FROM samples GROUP BY ALL), pair AS (
  SELECT source_id, block, frame, max(v) FILTER (channel = 0) AS a, max(v) FILTER (channel = 1) AS b FROM samples GROUP BY ALL)"""


@query("A13_channel_levels", f"""WITH {BLOCK_ROWS_SQL} SELECT source_id, channel, frames, round(20 * log10(sqrt(q / frames)), 6) AS rms_dbfs, round(20 * log10(peak), 6) AS peak_dbfs, peak_frame, clips AS clip_count, zeros AS zero_count FROM ch""")
def a13(t):
    rows = levels.channel_levels(levels.block_partials(st.sample_blocks(t)))
    return rows.withColumns({c: F.round(c, 6) for c in ("rms_dbfs", "peak_dbfs")}).drop("finite")


@query("A13_source_levels", f"""WITH {BLOCK_ROWS_SQL}, s AS (SELECT source_id, count(*) AS n, sum(((a + b) / 2) ** 2) AS m, max(abs((a + b) / 2)) AS mp, sum(a * a + b * b) / 2 AS e, sum(a) AS sa, sum(b) AS sb, sum(a * a) AS qa, sum(b * b) AS qb, sum(a * b) AS ab FROM pair GROUP BY source_id)
SELECT source_id, round(20 * log10(sqrt(m / n)), 6) AS mono_rms_dbfs, round(20 * log10(mp), 6) AS mono_peak_dbfs, round(20 * log10(sqrt(m / e)), 6) AS downmix_ratio_db, m / e < 10 ** -1.2 AS whole_cancellation,
 round((ab - sa * sb / n) / sqrt((qa - sa * sa / n) * (qb - sb * sb / n)), 6) AS stereo_correlation FROM s""")
def a13_source(t):
    rows = levels.source_levels(levels.block_partials(st.sample_blocks(t))).drop("frames", "channels")
    return rows.withColumns({c: F.round(c, 6) for c in ("mono_rms_dbfs", "mono_peak_dbfs", "downmix_ratio_db", "stereo_correlation")})


CANCEL_SQL = f"""{BLOCK_ROWS_SQL}, k AS (SELECT source_id, block, sum(((a + b) / 2) ** 2) / (sum(a * a + b * b) / 2) AS r FROM pair GROUP BY ALL HAVING sum(a * a + b * b) > 0), c AS (SELECT * FROM k WHERE r < 0.3)"""


def _cancelled(t):
    """Opposite phase made common: the second channel is mirrored in most labels."""
    return levels.cancellation_blocks(levels.block_partials(_mirrored(t)))


def _mirrored(t):
    x = F.transform("embedding", lambda v: v.cast("double") * 4)
    left = F.slice(x, 1, 32)
    right = F.zip_with(left, F.slice(x, 33, 32), lambda a, b: F.when(F.col("vec_id") % 2 == 0, -a + b * 0.01).otherwise(b))
    return t.embeddings.select(
        F.concat(F.lit("rec-"), F.col("label").cast("string")).alias("source_id"), F.col("vec_id").alias("block"),
        (F.col("vec_id") * 32).alias("start_frame"), F.lit(16000).alias("rate"), F.array(left, right).alias("channels"),
    )


MIRROR_SQL = """pair AS (SELECT 'rec-' || label AS source_id, vec_id AS block, unnest(embedding[1:32])::DOUBLE * 4 AS a, unnest(embedding[33:64])::DOUBLE * 4 AS y FROM embeddings), mix AS (
  SELECT source_id, block, a, CASE WHEN block % 2 = 0 THEN -a + y * 0.01 ELSE y END AS b FROM pair), k AS (
  SELECT source_id, block, sum(((a + b) / 2) ** 2) / (sum(a * a + b * b) / 2) AS r FROM mix GROUP BY ALL), c AS (SELECT * FROM k WHERE r < 10 ** -1.2)"""


@query("A14_cancellation", f"WITH {MIRROR_SQL} SELECT source_id, block, block * 32 / 16000 AS start_seconds, (block + 1) * 32 / 16000 AS end_seconds, round(20 * log10(sqrt(r)), 4) AS downmix_ratio_db FROM c")
def a14(t):
    return _cancelled(t).withColumn("downmix_ratio_db", F.round("downmix_ratio_db", 4))


@query("A14_cancellation_report", f"""WITH {MIRROR_SQL}, n AS (SELECT *, row_number() OVER (PARTITION BY source_id ORDER BY block) AS i FROM c) SELECT source_id, count(*) AS interval_count, string_agg(block::VARCHAR, ',' ORDER BY block) FILTER (i <= 16) AS first_blocks, true AS warning FROM n GROUP BY source_id""")
def a14_report(t):
    rows = levels.cancellation_report(_cancelled(t))
    return rows.select("source_id", "interval_count", F.array_join(F.transform("first_intervals", lambda i: i["block"].cast("string")), ",").alias("first_blocks"), "warning")


MONO_SQL = """mono AS (SELECT 'rec-' || label AS source_id, vec_id AS block, vec_id * 64 + generate_subscripts(embedding, 1) - 1 AS frame, unnest(embedding)::DOUBLE AS v FROM embeddings)"""


def _mono(t):
    return t.embeddings.select(
        F.concat(F.lit("rec-"), F.col("label").cast("string")).alias("source_id"), F.col("vec_id").alias("block"), (F.col("vec_id") * 64).alias("start_frame"), F.col("embedding").alias("samples")
    )


def _intervals(t):
    first = F.col("event_id") * 3
    return t.events.select(
        F.col("event_id").alias("interval_id"), F.concat(F.lit("rec-"), (F.col("user_id") % 10).cast("string")).alias("source_id"), first.alias("first"), (first + 50 + F.floor("value")).alias("last")
    )


INTERVALS_SQL = "i AS (SELECT event_id AS interval_id, 'rec-' || (user_id % 10) AS source_id, event_id * 3 AS first, event_id * 3 + 50 + CAST(floor(value) AS BIGINT) AS last FROM events)"


@query("J15_interval_slice", f"""WITH {MONO_SQL}, {INTERVALS_SQL} SELECT interval_id, i.source_id, block, min(frame) AS first_frame, max(frame) + 1 AS last_frame, round(sum(v), 4) AS total FROM i JOIN mono m ON m.source_id = i.source_id AND frame >= first AND frame < last GROUP BY ALL""")
def j15(t):
    rows = levels.sliced(_intervals(t), _mono(t), 64)
    return rows.select("interval_id", "source_id", "block", "first_frame", "last_frame", F.round(F.aggregate("samples", F.lit(0.0), lambda a, x: a + x), 4).alias("total"))


@query("A15_tail_metrics", f"""WITH {MONO_SQL}, e AS (SELECT 'rec-' || label AS source_id, max(vec_id) * 64 + 64 AS n, min(vec_id) * 64 + 640 AS start FROM embeddings GROUP BY label)
SELECT source_id, count(*) AS frames, round(20 * log10(max(abs(v))), 6) AS peak_dbfs, round(20 * log10(sqrt(sum(v * v) / count(*))), 6) AS rms_dbfs FROM mono JOIN e USING (source_id) WHERE frame >= start AND frame < n GROUP BY source_id""")
def a15(t):
    ends = _mono(t).groupBy("source_id").agg((F.min("start_frame") + 640).alias("first"), (F.max("start_frame") + 64).alias("last"))
    pieces = levels.sliced(ends.withColumn("interval_id", F.col("source_id")), _mono(t), 64)
    return levels.slice_levels(pieces, "source_id").withColumns({c: F.round(c, 6) for c in ("peak_dbfs", "rms_dbfs")})


@query("A16_safe_gain", f"""WITH {MONO_SQL} SELECT source_id, round(least(30.0, 20 * log10(floor(10 ** (-3.0 / 20) * 32768) / 32768 / max(abs(v)))), 6) AS gain_db FROM mono GROUP BY source_id""")
def a16(t):
    peaks = _mono(t).groupBy("source_id").agg(F.max(F.array_max(F.transform("samples", lambda x: F.abs(x.cast("double"))))).alias("peak"))
    return peaks.select("source_id", F.round(levels.safe_gain(F.col("peak"), F.lit(-3.0), F.lit(30.0)), 6).alias("gain_db"))


@query("A17_active_frames", f"""WITH {MONO_SQL}, f AS (SELECT source_id, block, count(*) AS n, sum(CASE WHEN block % 3 = 0 THEN v / 100 ELSE v END ** 2) AS q FROM mono GROUP BY ALL), w AS (SELECT source_id, sum(q) / sum(n) AS m FROM f GROUP BY source_id)
SELECT source_id, count(*) AS frames, count(*) FILTER (sqrt(q / n) >= greatest(10 ** (-90 / 20), sqrt(m) * 10 ** (-30 / 20))) AS active FROM f JOIN w USING (source_id) GROUP BY source_id""")
def a17(t):
    scaled = F.transform("samples", lambda x: F.when(F.col("block") % 3 == 0, x.cast("double") / 100).otherwise(x.cast("double")))
    frames = _mono(t).select("source_id", F.size("samples").alias("n"), F.aggregate(scaled, F.lit(0.0), lambda a, x: a + x * x).alias("square_sum"))
    return levels.active_frames(frames)


@query("S3_wav_inventory", """SELECT '/rec/' || vec_id || '.wav' AS path, CASE WHEN label = 3 THEN 'riff_size_mismatch' END AS reason, CASE WHEN label <> 3 THEN 'IEEE_FLOAT32' END AS encoding, CASE WHEN label <> 3 THEN 2 END AS channels, CASE WHEN label <> 3 THEN 32 END AS frames, CASE WHEN label <> 3 THEN 0.002 END AS duration_seconds FROM embeddings""", double="duration_seconds")
def s3(t):
    return recordings.inventory(st.recordings(t)).select("path", "reason", "encoding", "channels", "frames", "duration_seconds")


@query("S3_inventory_summary", """SELECT CASE WHEN label <> 3 THEN 'IEEE_FLOAT32' END AS encoding, CASE WHEN label = 3 THEN 'riff_size_mismatch' END AS reason, count(*) AS files, sum(CASE WHEN label <> 3 THEN 32 END) AS frames, round(sum(CASE WHEN label <> 3 THEN 0.002 END), 6) AS seconds FROM embeddings GROUP BY ALL""", bigint="frames", double="seconds")
def s3_summary(t):
    return recordings.inventory_summary(recordings.inventory(st.recordings(t))).withColumn("seconds", F.round("seconds", 6))


@query("S4_pcm_blocks", """SELECT '/rec/' || vec_id || '.wav' AS path, 0 AS block, 0 AS start_frame, 32 AS frames, round(list_sum(list_transform(range(32), lambda i: embedding[i * 2 + 1]::DOUBLE)), 5) AS left_sum FROM embeddings WHERE label <> 3""")
def s4(t):
    rows = recordings.sample_blocks(st.recordings(t)).where("reason IS NULL")
    return rows.select("path", "block", "start_frame", "frames", F.round(F.aggregate(F.col("channels")[0], F.lit(0.0), lambda a, x: a + x), 5).alias("left_sum"))


CLOCK_SQL = """CASE WHEN label <> 3 AND vec_id % 5 <> 0 AND vec_id % 7 <> 0 THEN printf('2024-%02d-%02dT%02d:%02d:00', 1 + vec_id % 12, 1 + vec_id % 28, vec_id % 24, vec_id % 60) END"""


@query("S5_bwf_clock", f"SELECT '/rec/' || vec_id || '.wav' AS path, {CLOCK_SQL} AS clock FROM embeddings")
def s5(t):
    return recordings.inventory(st.recordings(t)).select("path", "clock")


def _files(t, format_: str, **options):
    """The stand-in files through a data source, by their names."""
    wav_source.register(t.spark)
    rows = t.spark.read.format(format_).options(**options).load(st.recording_files(t))
    return rows.withColumn("path", F.concat(F.lit("/rec/"), F.substring_index("path", "/", -1)))


@query("S3_wav_headers", f"""SELECT '/rec/' || vec_id || '.wav' AS path, CASE WHEN label = 3 THEN 'riff_size_mismatch' END AS reason, CASE WHEN label <> 3 THEN 'IEEE_FLOAT32' END AS encoding, CASE WHEN label <> 3 THEN 2 END AS channels,
 CASE WHEN label <> 3 THEN 32 END AS frames, {CLOCK_SQL} AS clock, CASE WHEN label = 3 THEN 100 WHEN vec_id % 5 = 0 THEN 300 ELSE 910 END AS size_bytes FROM embeddings""", bigint="frames size_bytes")
def s3_headers(t):
    """Facts of every file from its first kilobyte."""
    return _files(t, "wav_headers").select("path", "reason", "encoding", "channels", "frames", "clock", "size_bytes")


@query("S4_channel_blocks", """SELECT '/rec/' || vec_id || '.wav' AS path, NULL::VARCHAR AS reason, b AS block, b * 8 AS start_frame, c AS channel, 8 AS frames, round(list_sum(list_transform(range(8), lambda i: embedding[(b * 8 + i) * 2 + c + 1]::DOUBLE)), 5) AS total
 FROM embeddings, range(4) AS r(b), range(2) AS s(c) WHERE label <> 3 UNION ALL SELECT '/rec/' || vec_id || '.wav', 'riff_size_mismatch', NULL, NULL, NULL, NULL, NULL FROM embeddings WHERE label = 3""", bigint="block start_frame frames")
def s4_channels(t):
    """All channels, block by block, and the refused files with their reasons."""
    rows = _files(t, "wav_blocks", blockFrames=8).select("path", "reason", "block", "start_frame", "frames", F.posexplode_outer("samples").alias("channel", "values"))
    return rows.select("path", "reason", "block", "start_frame", "channel", "frames", F.round(F.aggregate("values", F.lit(0.0), lambda a, x: a + x), 5).alias("total"))


# Documents


@query("S6_native_segments", f"WITH {st.LINES_SQL} SELECT 'run-1' AS run_id, source_id, idx, (idx - 1) * 2000 AS from_ms, idx * 2000 AS to_ms, text FROM lines")
def s6(t):
    from scribelake.schemas import NATIVE_DOCUMENT

    item = lambda l, i: F.struct(F.struct((i * 2000).alias("from"), ((i + 1) * 2000).alias("to")).alias("offsets"), l.alias("text"))
    raw = t.documents.select(F.to_json(F.struct(
        F.lit("run-1").alias("run_id"), F.concat(F.lit("doc-"), F.col("doc_id").cast("string")).alias("source_id"),
        F.transform(F.split("text", "\n"), item).alias("transcription"),
    )).alias("json"))
    return docs.native_segments(raw.select(F.from_json("json", NATIVE_DOCUMENT).alias("d")).select("d.*"))


@query("S7_manifest_scan", r"""WITH p AS (SELECT page_id, url, string_split(regexp_replace(url, '[?#].*$', ''), '/') AS f FROM pages), x AS (SELECT page_id, f[-2] AS folder, CASE WHEN page_id % 4 = 0 THEN 'other' ELSE f[-2] END AS id, url FROM p)
SELECT page_id, id FROM x WHERE regexp_full_match(id, '[A-Za-z0-9][A-Za-z0-9_-]{0,95}') AND id = folder""")
def s7(t):
    folder = F.element_at(F.split(F.regexp_replace("url", r"[?#].*$", ""), "/"), -2)
    rows = t.pages.select("page_id", folder.alias("folder"), F.when(F.col("page_id") % 4 == 0, "other").otherwise(folder).alias("id"), F.col("url").alias("file_path"))
    return docs.named_by_folder(rows, "id").select("page_id", "id")


@query("S11_strict_json", """SELECT event_id, CASE event_type WHEN 'click' THEN 'duplicate_key' WHEN 'view' THEN 'non_finite_number' WHEN 'error' THEN 'syntax' END AS defect FROM events""")
def s11(t):
    text = (
        F.when(F.col("event_type") == "click", F.concat(F.lit('{"k": 1, "k": '), F.col("event_id").cast("string"), F.lit("}")))
        .when(F.col("event_type") == "view", F.lit('{"k": NaN}')).when(F.col("event_type") == "error", F.concat("props", F.lit("}"))).otherwise(F.col("props"))
    )
    return docs.strict_json(t.events.select("event_id", text.alias("json")), "json").select("event_id", "defect")


# Review

REVIEW_SQL = (
    "regexp_extract_all(translate(replace(lower({0}), 'ß', 'ss'), '‘’ʼ−', '" + "''" * 3 + "-'), '"
    + REVIEW_TOKEN.replace("'", "''").replace("{", "{{").replace("}", "}}") + "')"
)
PAIRS_ONLY_SQL = f"""pairs AS (SELECT a.conv_id, a.turn, a.role, {st.WS_SQL.format('a.text')} AS ref, {st.WS_SQL.format('b.text')} AS hyp FROM conversations a JOIN conversations b ON b.conv_id = a.conv_id AND b.turn = a.turn + 1)"""
SCORED_SQL = """scored AS (
  SELECT conv_id, turn, role, len(ref) AS n, list_reduce(ref, lambda rr, w: list_reduce(hyp, lambda r, h: list_append(r,
     CASE WHEN h = w THEN rr[len(r)]
          WHEN rr[len(r)] // 1000000000000 <= rr[len(r) + 1] // 1000000000000 AND rr[len(r)] // 1000000000000 <= r[len(r)] // 1000000000000 THEN rr[len(r)] + 1000100000000
          WHEN rr[len(r) + 1] // 1000000000000 <= r[len(r)] // 1000000000000 THEN rr[len(r) + 1] + 1000000010000
          ELSE r[len(r)] + 1000000000001 END), [rr[1] + 1000000010000]), list_transform(range(len(hyp) + 1), lambda j: j * 1000000000001)) AS last FROM pairs), wer AS (
  SELECT conv_id, turn, role, n AS "N", last[-1] // 100000000 % 10000 AS "S", last[-1] // 10000 % 10000 AS "D", last[-1] % 10000 AS "I" FROM scored)"""
PAIRS_SQL = f"{PAIRS_ONLY_SQL}, {SCORED_SQL}"
REVIEW_PAIRS_SQL = f"""pairs AS (SELECT a.conv_id, a.turn, a.role, {REVIEW_SQL.format('a.text')} AS ref, {REVIEW_SQL.format('b.text')} AS hyp FROM conversations a JOIN conversations b ON b.conv_id = a.conv_id AND b.turn = a.turn + 1), {SCORED_SQL}"""


def _pairs(t):
    a = t.conversations.select("conv_id", "turn", "role", F.col("text").alias("ref_text"))
    b = t.conversations.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("hyp_text"))
    return a.join(b, ["conv_id", "turn"])


def _wer(t):
    rows = _pairs(t).select("conv_id", "turn", "role", tokens_ws("ref_text").alias("ref"), tokens_ws("hyp_text").alias("hyp"))
    return review.scored(rows, "ref", "hyp", F.lit(True)).drop("ref", "hyp")


@query("F16_wer_counts", f"""WITH {PAIRS_SQL} SELECT conv_id, turn, role, "S", "D", "I", "N", round(("S" + "D" + "I") / "N", 6) AS "WER" FROM wer""")
def f16(t):
    return _wer(t).withColumn("WER", F.round("WER", 6))


@query("A4_wer_aggregate", f"""WITH {PAIRS_SQL} SELECT role, sum("S") AS "S", sum("D") AS "D", sum("I") AS "I", sum("N") AS "N", count(*) AS verified_clips, count(*) AS total_clips, round(sum("S" + "D" + "I") / sum("N"), 6) AS "WER" FROM wer GROUP BY role""", bigint="S D I N")
def a4(t):
    return review.aggregate_wer(_wer(t), "role").withColumn("WER", F.round("WER", 6))


@query("F3_tokens_review", f"""WITH {st.LINES_SQL} SELECT source_id, idx, array_to_string({REVIEW_SQL.format('text')}, '|') AS tokens FROM lines""")
def f3(t):
    return st.lines(t).select("source_id", "idx", F.array_join(tokens_review("text"), "|").alias("tokens"))


@query("F12_compression_ratio")
def f12(t):
    return t.documents.select("doc_id", F.bround(compression_ratio("text"), 4).alias("ratio"))


@query("F15_agreement_ratio")
def f15(t):
    return _pairs(t).select("conv_id", "turn", F.round(agreement_ratio("ref_text", "hyp_text"), 6).alias("agreement"))


REF_SQL = """refs AS (SELECT conv_id, turn, text, CASE role WHEN 'user' THEN 'verified' WHEN 'assistant' THEN 'draft' ELSE 'odd' END AS status, conv_id % 7 <> 3 AS confirmed, conv_id % 11 <> 0 AS zoned, turn % 5 <> 0 OR conv_id % 2 = 0 AS same FROM conversations), judged_refs AS (
  SELECT *, CASE WHEN status = 'odd' THEN 'unknown_status' WHEN status <> 'verified' THEN NULL WHEN NOT confirmed THEN 'not_confirmed' WHEN NOT zoned THEN 'timestamp' WHEN NOT same THEN 'text_changed'
    WHEN regexp_matches(text, '\\?{3,}') THEN 'uncertainty_marker' END AS reject_reason FROM refs)"""


def _references(t):
    conv, turn = F.col("conv_id"), F.col("turn")
    at = F.when(conv % 11 != 0, "2024-01-01T00:00:00Z").otherwise("2024-01-01T00:00:00")
    saved = F.when((turn % 5 != 0) | (conv % 2 == 0), F.sha2("text", 256)).otherwise("x")
    return t.conversations.select(
        "conv_id", "turn", F.col("text").alias("human_text"), (conv % 7 != 3).alias("human_confirmed"),
        F.when(F.col("role") == "user", "verified").when(F.col("role") == "assistant", "draft").otherwise("odd").alias("status"),
        at.alias("created_at"), at.alias("updated_at"), at.alias("verified_at"), saved.alias("verified_text_sha256"),
    )


def _attested(t):
    return review.attested(_references(t), tokens_review("human_text"))


@query("P16_attested_reference", f"WITH {REF_SQL} SELECT conv_id, turn, status = 'verified' AND reject_reason IS NULL AS usable, reject_reason FROM judged_refs")
def p16(t):
    return _attested(t).select("conv_id", "turn", "usable", "reject_reason")


@query("Q4_score_review", f"""WITH {REF_SQL}, {REVIEW_PAIRS_SQL} SELECT role, sum("S") FILTER (u) AS "S", sum("D") FILTER (u) AS "D", sum("I") FILTER (u) AS "I", sum("N") FILTER (u) AS "N", count(*) FILTER (u) AS verified_clips, count(*) AS total_clips, round(sum("S" + "D" + "I") FILTER (u) / sum("N") FILTER (u), 6) AS "WER"
FROM (SELECT w.*, status = 'verified' AND reject_reason IS NULL AS u FROM wer w JOIN judged_refs USING (conv_id, turn)) GROUP BY role""", bigint="S D I N")
def q4(t):
    """Only attested references are scored; the totals are token-weighted."""
    usable = _attested(t).select("conv_id", "turn", "usable")
    rows = _pairs(t).join(usable, ["conv_id", "turn"]).select("conv_id", "turn", "role", "usable", tokens_review("ref_text").alias("ref"), tokens_review("hyp_text").alias("hyp"))
    scores = review.scored(rows, "ref", "hyp", F.col("usable"))
    return review.aggregate_wer(scores, "role").withColumn("WER", F.round("WER", 6))


@query("Q4_whole_review", f"""WITH {REF_SQL}, {REVIEW_PAIRS_SQL}, about AS (
  SELECT conv_id, coalesce(string_agg(DISTINCT reject_reason, ',' ORDER BY reject_reason), '') AS refused, count(*) AS clips, count(*) FILTER (status = 'verified' AND reject_reason IS NULL) AS v FROM judged_refs GROUP BY conv_id), x AS (
  SELECT w.*, status = 'verified' AND reject_reason IS NULL AND refused = '' AND turn % 6 <> 5 AND "N" > 0 AS u FROM wer w JOIN judged_refs USING (conv_id, turn) JOIN about USING (conv_id))
SELECT conv_id AS review_id, 'next' AS candidate, refused, CASE WHEN refused <> '' THEN 'refused' WHEN v = clips THEN 'verified_references' WHEN v > 0 THEN 'partially_verified' ELSE 'awaiting_human_review' END AS status,
 sum("S") FILTER (u) AS "S", sum("D") FILTER (u) AS "D", sum("I") FILTER (u) AS "I", sum("N") FILTER (u) AS "N", count(*) FILTER (u) AS verified_clips, count(*) AS total_clips, round(sum("S" + "D" + "I") FILTER (u) / sum("N") FILTER (u), 6) AS "WER"
FROM x JOIN about USING (conv_id) GROUP BY conv_id, refused, v, clips""", bigint="S D I N")
def q4_whole(t):
    """A review from gate to totals in one call; a conversation is a review, the next turn its only candidate."""
    references = _references(t)
    hypotheses = _pairs(t).select(
        F.col("conv_id").alias("review_id"), F.col("turn").alias("clip_id"), F.lit("next").alias("candidate"),
        F.when(F.col("turn") % 6 == 5, "failed").otherwise("completed").alias("state"), "hyp_text",
    )
    out = review.score_review(references.withColumnsRenamed({"conv_id": "review_id", "turn": "clip_id"}), hypotheses)
    return out.withColumns({"refused": F.array_join("refused", ","), "WER": F.round("WER", 6)})


@query("Q4_review_status", f"""WITH {REF_SQL} SELECT count(*) AS clips, count(*) FILTER (status = 'verified' AND reject_reason IS NULL) AS verified, 'partially_verified' AS status FROM judged_refs""")
def q4_status(t):
    return review.review_status(_attested(t))


@query("Q6_reference_eval", f"""WITH f AS (SELECT conv_id, {st.WS_SQL.format('text')} AS ref FROM conversations WHERE turn = 0), pairs AS (SELECT c.conv_id, c.turn, c.role, f.ref, {st.WS_SQL.format('c.text')} AS hyp FROM conversations c JOIN f USING (conv_id) WHERE c.turn > 0), {SCORED_SQL}
SELECT conv_id, turn AS candidate, "S", "D", "I", "N" FROM wer""")
def q6(t):
    c = t.conversations
    first = c.where("turn = 0").select("conv_id", tokens_ws("text").alias("ref"))
    rows = c.where("turn > 0").join(first, "conv_id").select("conv_id", F.col("turn").alias("candidate"), "ref", tokens_ws("text").alias("hyp"))
    return review.scored(rows, "ref", "hyp", F.lit(True)).select("conv_id", "candidate", "S", "D", "I", "N")


CATS = "['" + "', '".join(review.CATEGORIES) + "']"
ROWS_SQL = f"""crit AS (SELECT doc_id, {CATS}[doc_id % 8 + 1] AS category, lang <> 'de' AS verified, lang <> 'es' AS available, CASE WHEN l.doc_id IS NULL THEN 'pending' WHEN quality = 1 THEN 'correct' ELSE 'incorrect' END AS baseline,
  CASE WHEN l.doc_id IS NULL THEN 'pending' WHEN toxic = 1 THEN 'unclear' ELSE 'correct' END AS comparison, source FROM documents LEFT JOIN labels l USING (doc_id)), long AS (
  SELECT doc_id, source, category, verified, available, 'baseline' AS candidate, baseline AS judgment FROM crit UNION ALL SELECT doc_id, source, category, verified, available, 'comparison', comparison FROM crit)"""


def _critical(t):
    cats = F.array(*[F.lit(c) for c in review.CATEGORIES])
    base = F.when(F.col("quality").isNull(), "pending").when(F.col("quality") == 1, "correct").otherwise("incorrect")
    comp = F.when(F.col("quality").isNull(), "pending").when(F.col("toxic") == 1, "unclear").otherwise("correct")
    both = F.array(F.struct(F.lit("baseline").alias("candidate"), base.alias("judgment")), F.struct(F.lit("comparison").alias("candidate"), comp.alias("judgment")))
    return t.documents.join(t.labels, "doc_id", "left").select(
        "doc_id", "source", F.element_at(cats, (F.col("doc_id") % 8 + 1).cast("int")).alias("category"), (F.col("lang") != "de").alias("verified"),
        (F.col("lang") != "es").alias("available"), F.explode(both).alias("c"),
    ).select("doc_id", "source", "category", "verified", "available", "c.*")


@query("A5_critical_counts", f"""WITH {ROWS_SQL}, d AS (SELECT candidate, category, judgment FROM (SELECT DISTINCT candidate FROM long), (SELECT unnest({CATS}) AS category), (SELECT unnest(['correct', 'incorrect', 'unclear', 'pending']) AS judgment))
SELECT d.candidate, d.category, d.judgment, count(l.doc_id) AS n FROM d LEFT JOIN (SELECT * FROM long WHERE verified) l ON l.candidate = d.candidate AND l.category = d.category AND l.judgment = d.judgment GROUP BY ALL""")
def a5(t):
    rows = _critical(t)
    return review.judgment_counts(rows, rows)


@query("A6_term_accuracy", f"""WITH {ROWS_SQL}, c AS (SELECT source, candidate, count(*) FILTER (tt AND verified) AS terms, count(*) FILTER (tt AND verified AND judgment IN ('correct', 'incorrect')) AS decided, count(*) FILTER (tt AND verified AND judgment = 'correct') AS correct,
  count(*) FILTER (tt AND NOT verified) AS unverified, count(*) FILTER (tt AND verified AND NOT available) AS un FROM (SELECT *, category = 'technicalterm' AS tt FROM long) GROUP BY ALL)
SELECT source, candidate, terms, decided, correct, unverified, CASE WHEN terms > 0 AND decided = terms AND un = 0 THEN round(correct / terms, 6) END AS term_accuracy,
 CASE WHEN un > 0 THEN 'candidate_unavailable' WHEN terms > 0 AND decided = terms THEN 'verified_subset' WHEN terms > 0 THEN 'incomplete_judgments' ELSE 'not_measured' END AS status FROM c""")
def a6(t):
    return review.term_accuracy(_critical(t), "source", "candidate").withColumn("term_accuracy", F.round("term_accuracy", 6))


@query("A7_term_occurrences", f"""WITH x AS (SELECT conv_id, turn, {REVIEW_SQL.format('text')} AS k FROM conversations) SELECT conv_id, turn, len(list_filter(range(1, len(k)), lambda i: k[i] = k[1] AND k[i + 1] = k[2])) AS n FROM x""")
def a7(t):
    rows = t.conversations.select("conv_id", "turn", tokens_review("text").alias("k"))
    return rows.select("conv_id", "turn", review.phrase_occurrences(F.col("k"), F.slice("k", 1, 2)).alias("n"))


@query("J14_row_in_clip", """WITH c AS (SELECT source AS clip_id, min(n_chars) + 50 AS a, max(n_chars) - 50 AS b FROM documents GROUP BY source) SELECT doc_id, n_chars BETWEEN a AND b AS inside FROM documents JOIN c ON clip_id = source""")
def j14(t):
    d = t.documents.select("doc_id", F.col("source").alias("clip_id"), F.col("n_chars").alias("source_seconds"))
    clips = d.groupBy("clip_id").agg((F.min("source_seconds") + 50).alias("source_start_seconds"), (F.max("source_seconds") - 50).alias("source_end_seconds"))
    return review.rows_in_clip(d, clips).select("doc_id", "inside")


@query("Q3_package_rules", """WITH k AS (SELECT l_orderkey || '/' || l_linenumber AS clip_id, count(*) AS copies FROM lineitem GROUP BY ALL), x AS (SELECT l_orderkey || '/' || l_linenumber AS clip_id, l_partkey AS s, CAST(l_partkey + l_quantity - 3 AS BIGINT) AS e, l_returnflag, l_linestatus, l_suppkey FROM lineitem)
SELECT x.clip_id, unnest(list_filter([CASE WHEN copies > 1 THEN 'unique_id' END, CASE WHEN NOT (s < e AND e <= 2000) THEN 'bounds' END, CASE WHEN l_suppkey = 7 THEN 'rate' END, CASE WHEN l_returnflag = 'R' THEN 'end_offset' END, CASE WHEN l_linestatus = 'O' THEN 'tags' END], lambda v: v IS NOT NULL)) AS broken_rule FROM x JOIN k USING (clip_id)""")
def q3(t):
    line = t.lineitem
    ident = F.concat_ws("/", "l_orderkey", "l_linenumber")
    copies = line.groupBy(ident.alias("clip_id")).agg(F.count(F.lit(1)).alias("copies"))
    start, end = F.col("l_partkey"), (F.col("l_partkey") + F.col("l_quantity") - 3).cast("bigint")
    clips = line.select(
        ident.alias("clip_id"), start.alias("start_frame"), end.alias("end_frame"), F.when(F.col("l_suppkey") == 7, 8000).otherwise(16000).alias("sample_rate"),
        (start / 16000).alias("source_start_seconds"), F.when(F.col("l_returnflag") == "R", end / 16000 + 0.5).otherwise(end / 16000).alias("source_end_seconds"),
        F.lit(2000).alias("frames"), F.lit(16000).alias("rate"), F.lit("same").alias("preference"),
        F.when(F.col("l_linestatus") == "O", F.array(F.lit("odd"))).otherwise(F.array(F.lit("missing_word"))).alias("tags"),
    ).join(copies, "clip_id")
    return review.package_rules(clips)


@query("Q5_critical_rules", f"""WITH {ROWS_SQL} SELECT c.source AS clip_id, c.doc_id::VARCHAR AS row_id, unnest(list_filter([CASE WHEN c.verified AND NOT c.available THEN 'attested' END, CASE WHEN c.verified AND c.available AND c.baseline = 'incorrect' THEN 'same_reference' WHEN c.verified AND NOT c.available AND c.baseline <> 'incorrect' THEN 'same_reference' END, CASE WHEN c.verified AND c.comparison = 'unclear' THEN 'snapshot' END], lambda v: v IS NOT NULL)) AS broken_rule FROM crit c""")
def q5(t):
    wide = _critical(t).groupBy("doc_id", "source", "category", "verified", "available").agg(
        F.max(F.when(F.col("candidate") == "baseline", F.col("judgment"))).alias("baseline"), F.max(F.when(F.col("candidate") == "comparison", F.col("judgment"))).alias("comparison")
    )
    ref = F.when(F.col("available"), "ref")
    rows = wide.select(
        F.col("source").alias("clip_id"), F.col("doc_id").cast("string").alias("row_id"), "category", F.when(F.col("verified"), "verified").otherwise("pending").alias("status"), "baseline", "comparison",
        F.lit(1).alias("copies"), F.lit(True).alias("inside"), ref.alias("reference_sha256"), F.lit(True).alias("human_confirmed"),
        F.when(F.col("baseline") == "incorrect", F.when(F.col("available"), "old")).otherwise("ref").alias("verified_reference_sha256"),
        F.when(F.col("comparison") == "unclear", "old").otherwise("now").alias("snapshot_sha256"), F.lit("now").alias("current_sha256"), F.lit("term").alias("reference_text"),
    )
    return review.critical_rules(rows)


@query("J12_trusted_equals", """WITH a AS (SELECT l_orderkey AS doc_id, l_linenumber || '/' || l_partkey || '/' || l_suppkey AS path, l_quantity::BIGINT::VARCHAR AS value, l_returnflag, l_linestatus FROM lineitem)
SELECT doc_id, path, CASE WHEN l_returnflag = 'R' AND l_linestatus = 'F' THEN 'missing' WHEN l_returnflag = 'A' AND l_linestatus = 'F' THEN 'type_changed' ELSE 'value_changed' END AS difference FROM a WHERE (l_returnflag IN ('R', 'A') AND l_linestatus = 'F') OR (l_returnflag = 'N' AND l_linestatus = 'O')""")
def j12(t):
    flag, status = F.col("l_returnflag"), F.col("l_linestatus")
    base = t.lineitem.select(F.col("l_orderkey").alias("doc_id"), F.concat_ws("/", "l_linenumber", "l_partkey", "l_suppkey").alias("path"), F.col("l_quantity").cast("bigint").cast("string").alias("value"), "l_returnflag", "l_linestatus")
    trusted = base.withColumn("type", F.lit("int"))
    imported = base.where(~((flag == "R") & (status == "F"))).withColumns({
        "type": F.when((flag == "A") & (status == "F"), "bool").otherwise("int"), "value": F.when((flag == "N") & (status == "O"), "other").otherwise(F.col("value")),
    })
    return audit.trusted_equals(trusted, imported)


# Audits

STORED_VALUES = ["text", "start_seconds", "end_seconds", "global_start_seconds", "global_end_seconds", "native_start_milliseconds", "native_end_milliseconds"]


def _audit(t):
    """The audit, stored once: times, verdicts and comparisons all read it."""
    return checkpointed(timeline.audited(st.turns(t), st.clocks(t)))


def _stored(expected):
    """A saved copy in which some conversations were edited and some lost a segment."""
    conv = F.substr(F.col("source_id"), F.lit(5)).cast("bigint")
    rows = expected.withColumn("text", F.when((conv % 9 == 0) & (F.col("idx") == 1), F.concat("text", F.lit("!"))).otherwise(F.col("text")))
    return rows.where(~((conv % 10 == 1) & (F.col("idx") == 2)))


STORED_SQL = f"""{st.AUDIT_SQL}, facts AS (
  SELECT source_id, CAST(substr(source_id, 5) AS BIGINT) AS conv, count(*) AS expected_rows, count(*) FILTER (NOT (CAST(substr(source_id, 5) AS BIGINT) % 10 = 1 AND idx = 2)) AS stored_rows, sum(len(reasons)) = 0 AS valid, max(frames) AS frames, max(rate) AS rate FROM audited GROUP BY source_id)"""


@query("J10_reconcile_segments", f"""WITH {STORED_SQL} SELECT source_id, expected_rows, stored_rows, expected_rows - stored_rows + (conv % 9 = 0)::INT AS different_rows, expected_rows = stored_rows AND conv % 9 <> 0 AS equal FROM facts""")
def j10(t):
    expected = checkpointed(timeline.segment_times(_audit(t), st.clocks(t)))
    return audit.reconcile(expected, _stored(expected), ["source_id", "idx"], STORED_VALUES)


@query("A18_coverage", """SELECT l_orderkey AS run_id, bool_and(l_discount > 0) AS complete, sum((l_partkey * 16000 + 44099) // 44100 - (l_discount = 0)::INT)::BIGINT / 16000 AS duration_seconds FROM lineitem GROUP BY l_orderkey""")
def a18(t):
    frames = F.call_function("div", F.col("l_partkey") * 16000 + 44099, F.lit(44100))
    rows = t.lineitem.select(
        F.col("l_orderkey").alias("run_id"), F.lit(0).alias("input_start"), F.col("l_partkey").alias("input_end"), F.col("l_partkey").alias("complete_frames"),
        frames.alias("output_frames"), (frames - (F.col("l_discount") == 0).cast("int")).alias("decoded_frames"), F.lit(44100).alias("rate"),
    )
    return audit.coverage(rows, "run_id")


def _candidates(t):
    return t.lineitem.select(
        F.col("l_partkey").alias("clip_id"), F.when(F.col("l_returnflag") == "R", "B").otherwise("A").alias("policy"),
        F.when(F.col("l_quantity") > 49, 1).otherwise(0).alias("first_frame"), F.lit(9).alias("last_frame"), F.when(F.col("l_quantity") < 2, "x").otherwise("y").alias("audio_sha256"),
    )


@query("A27_same_interval", """SELECT l_partkey AS clip_id, count(DISTINCT l_quantity > 49) = 1 AS same_bounds, count(DISTINCT l_quantity < 2) FILTER (l_returnflag <> 'R') = 1 AS same_audio FROM lineitem GROUP BY l_partkey""")
def a27(t):
    return audit.same_interval(_candidates(t))


RUN_CHECKS = (
    "artifact_hashes", "required_artifacts", "segment_count", "native_text", "source_times", "global_times", "native_milliseconds",
    "endpoint_record", "timeline_valid", "frames_covered", "plain_text_artifact", "markdown_artifact", "latest_pointer",
)


@query("Q1_run_audit", f"""WITH {STORED_SQL}, c AS (SELECT *, [conv % 7 <> 0, conv % 8 <> 1, expected_rows = stored_rows, conv % 9 <> 0, conv % 12 <> 5 OR expected_rows < 3, true, true, true, valid, frames > 0, conv % 6 <> 5, true, conv % 17 <> 4] AS ok FROM facts)
SELECT source_id AS run_id, CASE WHEN list_position(ok, false) IS NULL THEN 'PASS' ELSE 'FAIL' END AS state, CASE WHEN list_position(ok, false) IS NOT NULL THEN {list(RUN_CHECKS)}[list_position(ok, false)] END AS first_failed,
 coalesce(list_position(ok, false) - 1, {len(RUN_CHECKS)}) AS assertions_passed FROM c""")
def q1(t):
    """Named checks per run over rebuilt facts, texts and pointers; the first failure decides."""
    conv = F.substr(F.col("source_id"), F.lit(5)).cast("bigint")
    rows_audited = _audit(t)
    expected = checkpointed(timeline.segment_times(rows_audited, st.clocks(t)))
    moved = (conv % 12 == 5) & (F.col("idx") == 3)
    stored = _stored(expected).withColumn("start_seconds", F.when(moved, F.col("start_seconds") + 1).otherwise(F.col("start_seconds")))
    values = [*STORED_VALUES, "endpoint_rounding_clamped"]
    fields = audit.field_checks(expected, stored, ["source_id", "idx"], values)
    timing = timeline.verdicts(rows_audited, st.clocks(t)).select("source_id", "valid", "frames")
    # Saved text files, as lines, against the lines rebuilt from the stored segments.
    clocks = st.clocks(t).select("source_id")
    rebuilt = exports.txt_lines(st.turns(t), clocks)
    saved = rebuilt.withColumn("line", F.when((conv % 6 == 5) & (F.col("line_no") == 1), F.lit("edited")).otherwise(F.col("line")))
    text = audit.reconcile(rebuilt, saved, ["source_id", "line_no"], ["line"]).select("source_id", F.col("equal").alias("text_equal_file"))
    md = exports.md_run_lines(expected, clocks)
    markdown = audit.reconcile(md, md, ["source_id", "seq", "part"], ["line"]).select("source_id", F.col("equal").alias("md_equal_file"))
    rows = fields.join(timing, "source_id").join(text, "source_id").join(markdown, "source_id").withColumn("conv", conv)
    ok = {
        "artifact_hashes": F.col("conv") % 7 != 0, "required_artifacts": F.col("conv") % 8 != 1, "segment_count": F.col("rows_equal"),
        "native_text": F.col("text_equal"), "source_times": F.col("start_seconds_equal") & F.col("end_seconds_equal"),
        "global_times": F.col("global_start_seconds_equal") & F.col("global_end_seconds_equal"),
        "native_milliseconds": F.col("native_start_milliseconds_equal") & F.col("native_end_milliseconds_equal"),
        "endpoint_record": F.col("endpoint_rounding_clamped_equal"), "timeline_valid": F.col("valid"), "frames_covered": F.col("frames") > 0,
        "plain_text_artifact": F.col("text_equal_file"), "markdown_artifact": F.col("md_equal_file"), "latest_pointer": F.col("conv") % 17 != 4,
    }
    named = audit.checks(rows.withColumnRenamed("source_id", "run_id"), "run_id", {n: ok[n] for n in RUN_CHECKS})
    return audit.audit_verdict(named, "run_id")


@query("Q2_benchmark_audit", """WITH c AS (SELECT l_partkey AS clip_id, count(DISTINCT l_quantity > 49) = 1 AS b, coalesce(count(DISTINCT l_quantity < 2) FILTER (l_returnflag <> 'R'), 0) = 1 AS a FROM lineitem GROUP BY l_partkey)
SELECT clip_id, CASE WHEN a AND b THEN 'PASS' ELSE 'FAIL' END AS state, CASE WHEN NOT b THEN 'same_interval' WHEN NOT a THEN 'same_audio' END AS first_failed, CASE WHEN NOT b THEN 1 WHEN NOT a THEN 2 ELSE 3 END AS assertions_passed FROM c""")
def q2(t):
    rows = audit.same_interval(_candidates(t))
    named = audit.checks(rows, "clip_id", {"wer_unmeasured": F.lit(True), "same_interval": F.col("same_bounds"), "same_audio": F.col("same_audio")})
    return audit.audit_verdict(named, "clip_id")


@query("J13_candidate_x_clip", """WITH s AS (SELECT source, bool_and(lang = 'en' OR lang = 'de') AS known FROM documents GROUP BY source) SELECT doc_id AS clip_id, c AS candidate FROM documents JOIN s USING (source), (SELECT unnest(['large-v3-A', 'large-v3-B', 'large-v3-turbo-A']) AS c) WHERE c <> 'large-v3-B' OR known""")
def j13(t):
    from scribelake.operators.benchmark import candidate_clips

    clips = t.documents.select(F.col("doc_id").alias("clip_id"), F.col("source").alias("benchmark_id"), F.col("lang").isin("en", "de").alias("known_source"))
    return candidate_clips(clips).select("clip_id", "candidate")


@query("P15_interval_rules", """SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_discount * 10 AS s, l_tax * 10 AS e, l_discount * 10 >= 0 AND l_discount * 10 < l_tax * 10 AND l_tax * 10 <= l_quantity / 50 + 1e-9 AND least(CAST(floor(l_quantity / 50 * 16000) AS BIGINT), CAST(floor(l_tax * 10 * 16000 + 0.5) AS BIGINT)) > CAST(floor(l_discount * 10 * 16000 + 0.5) AS BIGINT) AS valid FROM lineitem""")
def p15(t):
    from scribelake.operators.benchmark import interval_valid

    s, e, limit = F.col("l_discount") * 10, F.col("l_tax") * 10, F.col("l_quantity") / 50
    frames = F.floor(limit * 16000).cast("bigint")
    return t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", s.alias("s"), e.alias("e"), interval_valid(s, e, limit, F.lit(16000), frames).alias("valid"))
