"""Timeline and quality-gate queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from scribelake.functions.text import tokens_word, tokens_ws
from scribelake.operators import quality, timeline
from scribelake.plans.catalog import query
from scribelake.plans.standins import (
    AUDIT_SQL, LINE_AUDIT_SQL, LINES_SQL, WORDS_SQL, WS_SQL, clocks, glossaries, line_clocks, line_times, lines, turns,
)
from scribelake.session import checkpointed


def _audit(t):
    return timeline.audited(turns(t), clocks(t))


@query("W1_timeline_audit", f"""WITH {AUDIT_SQL}
SELECT source_id, idx AS segment, unnest(reasons) AS reason, from_ms AS start_ms, to_ms AS end_ms,
       from_ms * rate - 1000 * frames AS start_minus_eof_num, to_ms * rate - 1000 * frames AS end_minus_eof_num,
       1000 * rate AS eof_den FROM audited""")
def w1(t):
    return timeline.violations(_audit(t))


@query("W2_eof_normalise", f"""WITH {AUDIT_SQL}
SELECT source_id, idx AS segment, to_ms AS raw_end_ms, frames AS end_num, rate AS end_den FROM audited WHERE normalized""")
def w2(t):
    return timeline.normalizations(_audit(t))


@query("D9_audit_verdicts", f"""WITH {AUDIT_SQL}
SELECT source_id, c.frames, c.rate, count(a.idx) AS segment_count, coalesce(sum(len(reasons)), 0) AS violation_count,
       count(*) FILTER (normalized) AS normalization_count, coalesce(sum(len(reasons)), 0) = 0 AS valid
FROM clocks c LEFT JOIN audited a USING (source_id) GROUP BY source_id, c.frames, c.rate""", bigint="violation_count")
def d9(t):
    return timeline.verdicts(_audit(t), clocks(t))


@query("W3_global_offset", """SELECT source AS session_id, doc_id AS pos, n_chars AS duration,
 coalesce(sum(n_chars) OVER (PARTITION BY source ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS global_offset
FROM documents""", bigint="global_offset")
def w3(t):
    return timeline.global_offsets(
        t.documents.select(F.col("source").alias("session_id"), F.col("doc_id").alias("pos"), F.col("n_chars").alias("duration"))
    )


@query("P1_segment_times", f"""WITH {AUDIT_SQL}, verdict AS (
  SELECT source_id, sum(len(reasons)) = 0 AS valid FROM audited GROUP BY source_id)
SELECT source_id, idx, from_ms / 1000 + 90.0 AS start_seconds,
       CASE WHEN normalized AND valid THEN frames / rate ELSE to_ms / 1000 END + 90.0 AS end_seconds,
       from_ms / 1000 + 3600.0 AS global_start_seconds,
       CASE WHEN normalized AND valid THEN frames / rate ELSE to_ms / 1000 END + 3600.0 AS global_end_seconds,
       from_ms AS native_start_milliseconds, to_ms AS native_end_milliseconds,
       normalized AND valid AS endpoint_rounding_clamped, valid AS timestamp_valid, text
FROM audited JOIN verdict USING (source_id)""")
def p1(t):
    offsets = clocks(t).select(
        "source_id", F.lit(90.0).alias("source_start"), F.lit(3600.0).alias("global_offset")
    )
    return timeline.segment_times(_audit(t), clocks(t), offsets)


@query("F11_exact_cmp", f"""WITH {AUDIT_SQL}
SELECT source_id, idx, to_ms * rate > 1000 * frames AS past_end, 10 * ((100 * frames + rate - 1) // rate) AS end_tick_ms FROM audited""")
def f11(t):
    rows = turns(t).join(clocks(t), "source_id")
    return rows.select(
        "source_id", "idx", timeline.past_end(F.col("to_ms"), F.col("frames"), F.col("rate")).alias("past_end"),
        timeline.end_tick_ms(F.col("frames"), F.col("rate")).alias("end_tick_ms"),
    )


@query("F19_frame_rounding", f"""WITH {AUDIT_SQL}
SELECT source_id, idx, (frames * 16000 + rate - 1) // rate AS frames_16k, CAST(floor(from_ms / 1000 * rate + 0.5) AS BIGINT) AS first_frame FROM audited""")
def f19(t):
    rows = turns(t).join(clocks(t), "source_id")
    return rows.select(
        "source_id", "idx", timeline.frames_at(F.col("frames"), F.col("rate")).alias("frames_16k"),
        timeline.nearest_frame(F.col("from_ms") / 1000, F.col("rate")).alias("first_frame"),
    )


@query("P2_segment_valid", f"""WITH {AUDIT_SQL}
SELECT source_id, idx, text IS NOT NULL AND s IS NOT NULL AND NOT isnan(s) AND NOT isinf(s) AS valid
FROM (SELECT *, CASE WHEN idx % 5 = 0 THEN 'nan'::DOUBLE WHEN idx % 7 = 0 THEN 'inf'::DOUBLE ELSE from_ms / 1000 END AS s FROM audited)""")
def p2(t):
    nan, inf = F.lit(float("nan")), F.lit(float("inf"))
    start = F.when(F.col("idx") % 5 == 0, nan).when(F.col("idx") % 7 == 0, inf).otherwise(F.col("from_ms") / 1000)
    rows = turns(t).withColumn("s", start)
    return rows.select(
        "source_id", "idx",
        timeline.segment_valid(F.col("s"), F.col("to_ms") / 1000, F.col("text")).alias("valid"),
    )


@query("P3_in_range", f"""WITH {AUDIT_SQL}
SELECT source_id, idx FROM audited WHERE from_ms >= 0 AND from_ms <= to_ms AND to_ms / 1000 <= frames / rate + 0.05""")
def p3(t):
    rows = turns(t).join(clocks(t), "source_id")
    return rows.where(
        timeline.in_range(
            F.col("from_ms") / 1000, F.col("to_ms") / 1000, F.col("frames") / F.col("rate"), F.lit(False)
        )
    ).select("source_id", "idx")


@query("W4_adjacent_identical", f"""WITH {LINES_SQL}, n AS (
  SELECT *, {WS_SQL.format('text')} AS t FROM lines), m AS (
  SELECT *, array_to_string(t, ' ') AS norm FROM n), l AS (
  SELECT *, lag(norm) OVER (PARTITION BY source_id ORDER BY idx) AS prev FROM m), r AS (
  SELECT *, list_filter([
     CASE WHEN norm <> '' AND norm = prev THEN 'identical_adjacent_segment' END,
     CASE WHEN len(t) >= 12 AND len(list_distinct(t)) / len(t) < 0.3 THEN 'high_internal_repetition' END,
     CASE WHEN end_seconds <= start_seconds THEN 'zero_length_timestamp' END,
     CASE WHEN regexp_matches(text, '(?i)\\[(?:blank_audio|music|silence)\\]|\\(inaudible\\)') THEN 'non_speech_or_inaudible_marker' END
     ], lambda x: x IS NOT NULL) AS reasons FROM l)
SELECT source_id, idx, start_seconds, end_seconds, array_to_string(reasons, ',') AS reasons FROM r WHERE len(reasons) > 0""")
def w4(t):
    return quality.review_flags(lines(t)).withColumn("reasons", F.array_join("reasons", ","))


@query("F17_review_reasons", f"""WITH {LINES_SQL}, n AS (SELECT *, {WS_SQL.format('text')} AS t FROM lines)
SELECT source_id, idx, len(t) AS word_count, len(t) >= 12 AND len(list_distinct(t)) / len(t) < 0.3 AS high_internal_repetition
FROM n""")
def f17(t):
    rows = lines(t).withColumn("t", tokens_ws("text"))
    flags = quality.segment_flags(F.col("t"), F.col("start_seconds"), F.col("end_seconds"), F.col("text"))
    return rows.select(
        "source_id", "idx", F.size("t").alias("word_count"),
        flags["high_internal_repetition"].alias("high_internal_repetition"),
    )


@query("F1_tokens_ws", f"""WITH {LINES_SQL} SELECT source_id, idx, array_to_string({WS_SQL.format('text')}, '|') AS tokens FROM lines""")
def f1(t):
    return lines(t).select("source_id", "idx", F.array_join(tokens_ws("text"), "|").alias("tokens"))


@query("F2_tokens_word", f"""WITH {LINES_SQL} SELECT source_id, idx, array_to_string({WORDS_SQL.format('text')}, '|') AS tokens FROM lines""")
def f2(t):
    return lines(t).select("source_id", "idx", F.array_join(tokens_word("text"), "|").alias("tokens"))


WORD_TABLE_SQL = f"""{LINES_SQL}, counted AS (
  SELECT *, {WORDS_SQL.format('text')} AS words FROM lines), located AS (
  SELECT *, coalesce(sum(len(words)) OVER (PARTITION BY source_id ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS first_word
  FROM counted)"""


@query("F18_ms_tokens_locations", f"""WITH {WORD_TABLE_SQL}
SELECT source_id, idx, first_word, len(words) AS word_count FROM located""")
def f18(t):
    return quality.word_locations(lines(t)).select("source_id", "idx", "first_word", "word_count")


LOOPS_SQL = f"""{WORD_TABLE_SQL}, w AS MATERIALIZED (
  SELECT source_id, first_word + generate_subscripts(words, 1) - 1 AS pos, unnest(words) AS word FROM located), eq AS (
  SELECT a.source_id, p.period, a.pos FROM w a CROSS JOIN range(1, 65) p(period)
  JOIN w b ON b.source_id = a.source_id AND b.pos = a.pos - p.period WHERE a.word = b.word), runs AS (
  SELECT source_id, period, min(pos) - period AS "start", max(pos) + 1 AS "end" FROM (
    SELECT *, pos - row_number() OVER (PARTITION BY source_id, period ORDER BY pos) AS g FROM eq)
  GROUP BY source_id, period, g), cand AS (
  SELECT source_id, "start", "end", period FROM runs WHERE "end" - "start" >= greatest(3 * period, 24))"""


@query("W5_phrase_loops", f"""WITH {LOOPS_SQL} SELECT * FROM cand""")
def w5(t):
    return quality.loop_candidates(lines(t)).select("source_id", "start", "end", "period")


MERGED_SQL = f"""{LOOPS_SQL}, reach AS (
  SELECT *, max("end") OVER (PARTITION BY source_id ORDER BY "start", "end" DESC, period ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS r FROM cand), isl AS (
  SELECT *, sum(CASE WHEN r IS NULL OR "start" >= r THEN 1 ELSE 0 END) OVER (PARTITION BY source_id ORDER BY "start", "end" DESC, period) AS island FROM reach), merged AS (
  SELECT source_id, min("start") AS "start", max("end") AS "end",
         CASE WHEN bool_or("start" < r AND "end" > r) THEN NULL ELSE arg_min(period, ("start", -"end", period)) END AS period
  FROM isl GROUP BY source_id, island)"""


@query("W6_merge_ranges", f"""WITH {MERGED_SQL} SELECT * FROM merged""")
def w6(t):
    ranges = quality.merged_ranges(quality.loop_candidates(lines(t)))
    return ranges.select("source_id", "start", "end", "period")


@query("D7_loop_findings", f"""WITH {MERGED_SQL}
SELECT m.source_id, f.start_seconds, l.end_seconds, 'repeated_phrase_loop' AS category,
       m."end" - m."start" AS repeated_word_count, m.period AS phrase_word_count, l.idx - f.idx + 1 AS segment_count
FROM merged m JOIN located f ON f.source_id = m.source_id AND m."start" >= f.first_word AND m."start" < f.first_word + len(f.words)
JOIN located l ON l.source_id = m.source_id AND m."end" - 1 >= l.first_word AND m."end" - 1 < l.first_word + len(l.words)""")
def d7(t):
    return quality.loop_findings(quality.merged_ranges(quality.loop_candidates(lines(t))))


@query("W7_window30")
def w7(t):
    return quality.compression_findings(lines(t))


@query("W7_window_words", f"""WITH {WORD_TABLE_SQL}
SELECT source_id, CAST(greatest(0, floor(start_seconds / 30)) AS BIGINT) AS bucket, min(start_seconds) AS start_seconds,
       max(end_seconds) AS end_seconds, sum(len(words)) AS word_count FROM located GROUP BY ALL HAVING sum(len(words)) >= 40""", bigint="word_count")
def w7_words(t):
    return quality.window_ratios(lines(t)).select("source_id", "bucket", "start_seconds", "end_seconds", "word_count")


# Every gate but compression, which SQL cannot compute.
FOUND_SQL = f"""{MERGED_SQL}, totals AS (
  SELECT source_id, count(*) AS segment_count, sum(len(words)) AS word_count FROM located GROUP BY source_id), {LINE_AUDIT_SQL}, timing AS (
  SELECT source_id, sum(len(reasons)) = 0 AS timestamp_valid FROM line_audited GROUP BY source_id), found AS (
  SELECT source_id, 'repeated_phrase_loop' AS category FROM merged
  UNION ALL SELECT source_id, 'empty_transcript' FROM totals WHERE word_count = 0
  UNION ALL SELECT source_id, 'invalid_timestamp' FROM (SELECT source_id, unnest(reasons) AS reason FROM line_audited)
  UNION ALL SELECT 'doc-' || doc_id, 'glossary_context_disabled' FROM documents WHERE doc_id % 6 = 0 AND doc_id % 4 <> 0)"""


def _summary(t, *, compression):
    """Findings of all gates and the per-source summary, over one count of the words and one audit."""
    segments, clock = lines(t), line_clocks(t)
    counts = quality.counted(segments)
    audit = checkpointed(timeline.audited(line_times(t), clock))
    audits = timeline.verdicts(audit, clock)
    found = checkpointed(quality.findings(
        segments, counts=counts, audits=audits, violations=timeline.violations(audit), settings=glossaries(t), compression=compression
    ))
    return found, quality.by_source(segments, found, audits, counts=counts)


@query("A1_quality_by_source", f"""WITH {FOUND_SQL}
SELECT t.source_id, CASE WHEN count(f.category) > 0 THEN 'review_required' ELSE 'passed_checks' END AS status,
       timestamp_valid, segment_count, word_count, count(f.category) AS finding_count
FROM totals t JOIN timing USING (source_id) LEFT JOIN found f USING (source_id) GROUP BY t.source_id, timestamp_valid, segment_count, word_count""", bigint="word_count")
def a1(t):
    """Which documents need review, by every gate that SQL can express too: loops, empties, timestamps, glossary."""
    return _summary(t, compression=False)[1]


@query("A1_quality_with_compression")
def a1_full(t):
    """Which documents need review, by all gates."""
    return _summary(t, compression=True)[1]


@query("A2_verdict", f"""WITH {FOUND_SQL}, members AS (SELECT 'doc-' || doc_id AS source_id, source AS run_id FROM documents), valid AS (
  SELECT run_id, bool_and(timestamp_valid) AS timestamp_valid FROM members JOIN timing USING (source_id) GROUP BY run_id)
SELECT m.run_id, coalesce(string_agg(DISTINCT f.category, ',' ORDER BY f.category), '') AS reasons,
       CASE WHEN count(f.category) > 0 THEN 'review_required' ELSE 'passed_checks' END AS status,
       any_value(v.timestamp_valid) AS timestamp_valid, FALSE AS accuracy_verified
FROM members m JOIN valid v USING (run_id) LEFT JOIN found f USING (source_id) GROUP BY m.run_id
UNION ALL SELECT n_name, 'empty_transcript', 'review_required', NULL, FALSE FROM nation""")
def a2(t):
    """One verdict per run; the nations stand for runs without a source."""
    runs = t.documents.select(
        F.concat(F.lit("doc-"), F.col("doc_id").cast("string")).alias("source_id"), F.col("source").alias("run_id")
    )
    asked = runs.select("run_id").unionByName(t.nation.select(F.col("n_name").alias("run_id")))
    found, by_source = _summary(t, compression=False)
    summary = by_source.join(runs, "source_id")
    verdicts = quality.verdict(summary, found.select("source_id", "category").join(runs, "source_id"), ["run_id"], asked)
    return verdicts.withColumn("reasons", F.array_join("reasons", ","))


@query("A28_all_valid_3v", f"""WITH {AUDIT_SQL}, v AS (
  SELECT source_id, CASE WHEN ascii(right(source_id, 1)) % 5 = 0 AND source_id LIKE '%5' THEN NULL ELSE sum(len(reasons)) = 0 END AS ok,
         right(source_id, 1) AS run_id FROM audited GROUP BY source_id)
SELECT run_id, CASE WHEN count(*) = count(ok) THEN bool_and(ok) END AS timestamp_valid FROM v GROUP BY run_id""")
def a28(t):
    ok = F.when(~((F.ascii(F.right("source_id", F.lit(1))) % 5 == 0) & F.col("source_id").endswith("5")), F.col("valid"))
    rows = timeline.verdicts(_audit(t), clocks(t)).select(
        F.right("source_id", F.lit(1)).alias("run_id"), ok.alias("ok")
    )
    return rows.groupBy("run_id").agg(quality.all_valid("ok").alias("timestamp_valid"))


@query("A29_finding_counts", f"""WITH {AUDIT_SQL}
SELECT 'invalid_timestamp' AS category, reason, count(*) AS n FROM (SELECT unnest(reasons) AS reason FROM audited) GROUP BY reason""")
def a29(t):
    found = quality.timestamp_findings(timeline.violations(_audit(t)))
    return found.groupBy("category", "reason").agg(F.count(F.lit(1)).alias("n"))
