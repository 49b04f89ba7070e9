"""Library and result-list queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from scribelake.functions import clocks as clk
from scribelake.functions import text as tx
from scribelake.operators import library as lib
from scribelake.operators import results as res
from scribelake.operators import timeline
from scribelake.operators.ordered import numbered, placed
from scribelake.plans import standins as st
from scribelake.plans.catalog import query
from scribelake.sources.recordings import allowed_media

NEEDLE = "the "


@query("S1_media_scan", r"""SELECT page_id, url, lower(regexp_extract(regexp_extract(url, '[^/]*$'), '^.+\.([^.]+)$', 1)) AS extension
FROM pages WHERE lower(regexp_extract(regexp_extract(url, '[^/]*$'), '^.+\.([^.]+)$', 1)) IN ('html', 'com', 'net', 'org')
AND NOT starts_with(regexp_extract(url, '[^/]*$'), '.')""")
def s1(t):
    kept = allowed_media(t.pages, "url", ("html", "com", "net", "org"))
    return kept.select("page_id", "url", tx.suffix("url").alias("extension"))


@query("S2_content_hash", "SELECT doc_id, sha256(text) AS sha256 FROM documents")
def s2(t):
    return t.documents.select("doc_id", F.sha2("text", 256).alias("sha256"))


@query("F4_fmt_timestamp", r"""WITH x AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, v, neg, CAST(greatest(0, round_even((CASE WHEN neg THEN -v ELSE v END) * 1000, 0)) AS BIGINT) AS ms,
  CAST(greatest(0, round_even(v * 1000, 0)) AS BIGINT) AS sms
  FROM (SELECT *, (l_extendedprice - 40000) / 8 AS v, l_extendedprice < 40000 AS neg FROM lineitem))
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey,
 CASE WHEN neg THEN '-' ELSE '' END || printf('%02d:%02d:%02d.%03d', ms // 3600000, ms // 60000 % 60, ms // 1000 % 60, ms % 1000) AS md,
 printf('%02d:%02d:%02d,%03d', sms // 3600000, sms // 60000 % 60, sms // 1000 % 60, sms % 1000) AS srt FROM x""")
def f4(t):
    v = (F.col("l_extendedprice") - 40000) / 8
    return t.lineitem.select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", tx.clock_text(v).alias("md"), tx.clock_text(v, srt=True).alias("srt")
    )


@query("F5_md_escape", r"""SELECT doc_id, regexp_replace(text, '([\\`*_{}\[\]<>#!|])', '\\\1', 'g') AS escaped FROM documents""")
def f5(t):
    return t.documents.select("doc_id", tx.md_escape("text").alias("escaped"))


@query("F6_dbfs", """SELECT c_custkey, CASE WHEN c_acctbal > 0 THEN round(20 * log10(c_acctbal / 10000), 6) END AS db FROM customer""")
def f6(t):
    return t.customer.select("c_custkey", F.round(tx.dbfs(F.col("c_acctbal") / 10000), 6).alias("db"))


@query("F7_recording_time", f"""WITH {st.CLOCKED_SQL}
SELECT batch_id, position, date, time, shown_at AS recorded_at, timezone, provenance, provenance = 'explicit_metadata' AS confirmed FROM clocked""")
def f7(t):
    return st.entries(t).select(
        "batch_id", "position", clk.recording_time("filename", "recorded_at").alias("r")
    ).select("batch_id", "position", "r.*")


@query("F8_recording_interval", f"""WITH {st.ENTRIES_SQL}, x AS (SELECT *, CASE WHEN recorded_at LIKE '%+02:00' THEN recorded_at WHEN filename LIKE 'notes%' THEN NULL ELSE '2020-03-04T05:06:07' END AS used FROM entries)
SELECT batch_id, position, used AS started_at,
  strftime(strptime(left(used, 19), '%Y-%m-%dT%H:%M:%S') + to_seconds(duration_seconds::BIGINT), '%Y-%m-%dT%H:%M:%S') || CASE WHEN used LIKE '%+02:00' THEN '+02:00' ELSE '' END AS ended_at,
  CASE WHEN recorded_at LIKE '%+02:00' THEN 'explicit_source_metadata' WHEN used IS NOT NULL THEN 'embedded_bwf_origination' ELSE 'unknown' END AS time_source,
  CASE WHEN recorded_at LIKE '%+02:00' THEN 'user_supplied' WHEN used IS NOT NULL THEN 'embedded_metadata' ELSE 'unknown' END AS time_confidence,
  CASE WHEN used LIKE '%+02:00' THEN '+0200' END AS timezone, CASE WHEN used LIKE '%+02:00' THEN 'explicit_offset' ELSE 'unknown' END AS timezone_status,
  CASE WHEN used IS NOT NULL THEN 'declared start plus decoded duration' END AS end_time_basis,
  recorded_at IS NOT NULL AND recorded_at NOT LIKE '%+02:00' AS invalid_explicit_recorded_at FROM x""")
def f8(t):
    embedded = F.when(~F.col("filename").startswith("notes"), "2020-03-04T05:06:07")
    rows = st.entries(t).withColumn("embedded", embedded)
    return rows.select(
        "batch_id", "position", clk.recording_interval("recorded_at", "embedded", "duration_seconds").alias("r")
    ).select("batch_id", "position", "r.*")


@query("F9_natural_key", r"""SELECT page_id, array_to_string(list_transform(regexp_extract_all(lower(regexp_extract(url, '[^/]*$')), '[0-9]+|[^0-9]+'),
  lambda p: CASE WHEN regexp_matches(p, '^[0-9]') THEN '0:' || length(regexp_replace(p, '^0+(.)', '\1')) || ':' || regexp_replace(p, '^0+(.)', '\1') ELSE '1:' || p END), '|') AS sort_key FROM pages""")
def f9(t):
    key = F.transform(
        tx.natural_key("url"),
        lambda p: F.concat(p["kind"].cast("string"), F.lit(":"), F.when(p["kind"] == 0, F.concat(p["digits"].cast("string"), F.lit(":"), p["text"])).otherwise(p["text"])),
    )
    return lib.natural_sort(t.pages, "url").select("page_id", F.array_join(key, "|").alias("sort_key"))


@query("F10_identity_keys", f"""WITH {st.RESULTS_SQL} SELECT result_id, 'r-' || left(sha256('["' || source_sha256 || '","' || filename || '","' || run_id || '"]'), 40) AS identity,
 sha256('["' || session_id || '","' || source_id || '","' || filename || '"]') AS scope_key FROM results""")
def f10(t):
    return st.results(t).select(
        "result_id", res.result_id(F.col("source_sha256"), F.col("filename"), F.col("run_id")).alias("identity"),
        res.sha_of(F.col("session_id"), F.col("source_id"), F.col("filename")).alias("scope_key"),
    )


@query("F13_clean_title_slug", r"""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents), x AS (SELECT doc_id, trim(regexp_replace(line, '[\s\p{Z}]+', ' ', 'g')) AS t FROM l), y AS (
 SELECT doc_id, CASE WHEN length(t) BETWEEN 1 AND 160 AND NOT regexp_matches(t, '\p{C}') THEN t END AS title FROM x), z AS (
 SELECT *, substr(regexp_replace(regexp_replace(regexp_replace(title, '[^\p{L}\p{N}_-]', '-', 'g'), '-+', '-', 'g'), '^[-_]+|[-_]+$', '', 'g'), 1, 72) AS s FROM y)
SELECT doc_id, title, CASE WHEN s = '' THEN 'recordings' ELSE s END AS slug FROM z""")
def f13(t):
    lines = t.documents.select("doc_id", F.explode(F.split("text", "\n")).alias("line"))
    return lines.select("doc_id", tx.clean_title("line").alias("title")).withColumn("slug", tx.slug("title"))


@query("F14_cpu_seconds", """SELECT event_id, (user_id % 3) * 86400 + (event_id % 24) * 3600 + (event_id % 60) * 60 + round(value % 60, 2) AS seconds FROM events""")
def f14(t):
    shown = F.concat(
        F.when(F.col("user_id") % 3 > 0, F.concat((F.col("user_id") % 3).cast("string"), F.lit("-"))).otherwise(""),
        F.concat_ws(":", (F.col("event_id") % 24).cast("string"), (F.col("event_id") % 60).cast("string"), F.round(F.col("value") % 60, 2).cast("string")),
    )
    return t.events.select("event_id", F.round(tx.cpu_seconds(shown), 6).alias("seconds"))


@query("F20_uuid_case", """SELECT o_orderkey, count(*) AS matches FROM orders JOIN customer ON lower(upper('Job-' || o_custkey)) = lower('JOB-' || c_custkey) GROUP BY o_orderkey""")
def f20(t):
    a = t.orders.select("o_orderkey", F.lower(F.concat(F.lit("Job-"), F.col("o_custkey").cast("string"))).alias("job"))
    b = t.customer.select(F.lower(F.concat(F.lit("JOB-"), F.col("c_custkey").cast("string"))).alias("job"))
    return a.join(b, "job").groupBy("o_orderkey").agg(F.count(F.lit(1)).alias("matches"))


@query("F21_date_check", r"""WITH x AS (SELECT o_orderkey, '20' || lpad((o_orderkey % 30)::VARCHAR, 2, '0') || '-02-' || lpad((o_orderkey % 31 + 1)::VARCHAR, 2, '0') AS d FROM orders)
SELECT o_orderkey, regexp_full_match(d, '\d{4}-\d{2}-\d{2}') AND try_cast(d AS DATE) IS NOT NULL AS valid FROM x""")
def f21(t):
    two = lambda c: F.lpad(c.cast("string"), 2, "0")
    d = F.concat(F.lit("20"), two(F.col("o_orderkey") % 30), F.lit("-02-"), two(F.col("o_orderkey") % 31 + 1))
    return t.orders.select("o_orderkey", clk.real_date(d).alias("valid"))


@query("F22_export_name", f"""WITH {st.RESULTS_SQL} SELECT result_id, regexp_replace(filename, '\\.[^.]*$', '') || '_transcript.' || CASE lang WHEN 'en' THEN 'srt' WHEN 'de' THEN 'txt' ELSE 'md' END AS export_name FROM results""")
def f22(t):
    fmt = F.when(F.col("lang") == "en", "srt").when(F.col("lang") == "de", "txt").otherwise("docx")
    return st.results(t).select("result_id", tx.export_name("filename", fmt).alias("export_name"))


GROUPED_SQL = """e AS (SELECT user_id, event_id, ts, strftime(ts, '%Y-%m-%d') AS day, epoch_us(date_trunc('second', ts)) // 1000000 AS at_s,
    CASE WHEN event_type = 'error' THEN NULL ELSE floor(value * 100) END AS duration, CASE WHEN event_type = 'signup' THEN '+01:00' END AS "offset" FROM events), l AS (
  SELECT *, lag(day) OVER w AS pday, lag(at_s) OVER w AS pat, lag(duration) OVER w AS pdur, lag("offset") OVER w AS poff FROM e WINDOW w AS (PARTITION BY user_id ORDER BY event_id)), g AS (
  SELECT *, CASE WHEN day = pday AND "offset" IS NOT DISTINCT FROM poff THEN at_s - pat - pdur END AS gap, coalesce(day = pday, false) AS same_day, "offset" IS NOT DISTINCT FROM poff AS same_zone FROM l), h AS (
  SELECT *, sum(CASE WHEN coalesce(gap >= 0 AND gap <= 900, false) THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY event_id) AS group_no,
    CASE WHEN NOT same_day THEN NULL WHEN NOT same_zone THEN 'timezone bases differ' WHEN pdur IS NULL THEN 'previous duration unknown'
         WHEN gap < 0 THEN 'recording times overlap' WHEN gap > 0 AND gap <= 900 THEN gap::BIGINT || ' second gap' WHEN gap > 900 THEN gap::BIGINT || ' second gap; separate' END AS issue FROM g)"""


def _gap_rows(t):
    ts = F.date_trunc("second", F.col("ts").cast("timestamp"))
    return t.events.select(
        F.col("user_id").cast("string").alias("batch_id"), F.col("event_id").alias("pos"),
        F.date_format("ts", "yyyy-MM-dd").alias("day"), F.date_format("ts", "HH:mm:ss").alias("clock"),
        F.unix_timestamp(ts).cast("double").alias("at_seconds"),
        F.when(F.col("event_type") == "signup", "+01:00").alias("offset"),
        F.when(F.col("event_type") != "error", F.floor(F.col("value") * 100).cast("double")).alias("duration"),
    )


@query("W8_gap_groups", f"""WITH {GROUPED_SQL} SELECT user_id::VARCHAR AS batch_id, event_id AS pos, group_no, gap AS gap_seconds, issue FROM h""", bigint="group_no")
def w8(t):
    return lib.gap_groups(_gap_rows(t)).select("batch_id", "pos", "group_no", "gap_seconds", "issue")


@query("A30_group_span", f"""WITH {GROUPED_SQL} SELECT user_id::VARCHAR AS batch_id, group_no, count(*) AS members, min(event_id) AS first_pos, arg_min(day, event_id) AS date,
 arg_min(strftime(ts, '%H:%M:%S'), event_id) AS start_time, arg_min(strftime(ts, '%H:%M'), event_id) || ' recordings' AS title, 'suggested' AS status, count(issue) AS issue_count FROM h GROUP BY user_id, group_no""", bigint="group_no")
def a30(t):
    return lib.group_spans(lib.gap_groups(_gap_rows(t)))


def _clocked(t):
    return st.entries(t).withColumn("r", clk.recording_time("filename", "recorded_at")).select(
        "batch_id", "position", "state", "sha256", "filename", "r.date", "r.time", "r.provenance"
    )


@query("A22_date_facets", f"""WITH {st.CLOCKED_SQL} SELECT batch_id, date, min(time) AS start_time FROM clocked GROUP BY batch_id, date""")
def a22(t):
    return lib.date_facets(_clocked(t), "batch_id")


@query("A33_single_group_default", f"""WITH {st.CLOCKED_SQL}, g AS (SELECT batch_id, count(*) AS members, CASE WHEN count(*) = count(date) AND min(date) = max(date) THEN max(date) END AS date,
  arg_min_null(time, position) AS start_time, bool_or(provenance = 'explicit_metadata') AS explicit FROM clocked GROUP BY batch_id)
SELECT batch_id, members, date, start_time, members || CASE WHEN members = 1 THEN ' recording' ELSE ' recordings' END AS title,
 CASE WHEN date IS NULL THEN 'unknown' WHEN explicit THEN 'explicit_metadata' ELSE 'filename' END AS date_provenance FROM g""")
def a33(t):
    return lib.default_group(_clocked(t))


@query("A23_view_counts", f"""WITH {st.REPORTS_SQL} SELECT count(*) FILTER (deleted_at IS NULL) AS active_count, count(*) FILTER (deleted_at IS NOT NULL) AS trash_count FROM reports""")
def a23(t):
    return lib.view_counts(st.reports(t))


@query("A24_single_value_or_null", f"""WITH {st.CLOCKED_SQL} SELECT batch_id, CASE WHEN count(DISTINCT coalesce(date, '-')) = 1 THEN max(date) END AS date FROM clocked GROUP BY batch_id""")
def a24(t):
    return _clocked(t).groupBy("batch_id").agg(lib.single_value("date").alias("date"))


@query("A25_unambiguous_only", """SELECT l_orderkey, l_linenumber, min(l_partkey) AS l_partkey FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING count(*) = 1""")
def a25(t):
    rows = t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", F.struct("l_orderkey", "l_linenumber").alias("id"))
    return lib.unambiguous(rows, "id").drop("id")


@query("A3_state_counts", f"""WITH {st.ENTRIES_SQL}, d AS (SELECT *, min(position) OVER (PARTITION BY batch_id, sha256) AS firstpos FROM entries)
SELECT batch_id, count(*) AS selected, count(*) FILTER (state = 'completed') AS completed, count(*) FILTER (state = 'review_required') AS review_required,
 count(*) FILTER (state = 'failed') AS failed, count(*) FILTER (state = 'cancelled') AS cancelled, count(*) FILTER (firstpos < position) AS duplicates FROM d GROUP BY batch_id""")
def a3(t):
    rows = st.entries(t).withColumn("key", st.copy_key())
    return res.state_counts(lib.first_of_key(rows, "key", "position", seldom=True), "batch_id")


@query("P7_state_bucket", f"""WITH {st.QUEUE_SQL}, b AS (SELECT unnest(['all'] || CASE state WHEN 'processing' THEN ['processing'] WHEN 'waiting' THEN ['waiting'] ELSE ['failed'] END) AS bucket FROM queue)
SELECT bucket, count(*) AS n FROM b GROUP BY bucket""")
def p7(t):
    rows = st.queue(t).select(F.explode(lib.state_bucket(F.col("state"))).alias("bucket"))
    return rows.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"))


@query("P8_library_search", """SELECT doc_id AS report_id FROM documents WHERE contains(replace(lower(source || ' ' || lang || ' ' || doc_id), 'ß', 'ss'), 'src1')
 OR contains(replace(lower(text), 'ß', 'ss'), 'src1')""")
def p8(t):
    rows = t.documents.select(
        F.col("doc_id").alias("report_id"), F.col("source").alias("title"), F.array("lang").alias("dates"),
        F.array(F.col("doc_id").cast("string")).alias("filenames"), F.col("text").alias("report_text"),
    )
    return lib.library_search(rows, " SRC1").select("report_id")


@query("P9_result_search", f"""WITH {st.RESULTS_SQL}, {st.LABELS_SQL} SELECT r.result_id, filename FROM results r LEFT JOIN tags USING (result_id)
WHERE contains(lower(filename), 'rude') OR contains(lower(coalesce(course, '')), 'rude') OR contains(lower(coalesce(speaker, '')), 'rude') OR contains(replace(lower(text), 'ß', 'ss'), 'rude')""")
def p9(t):
    rows = st.results(t).select("result_id", "filename")
    segments = st.lines(t).select(F.concat(F.lit("r-"), F.substr(F.col("source_id"), F.lit(5))).alias("result_id"), "text")
    return lib.result_search(rows, segments, st.labels(t), "RUDE")


@query("P10_line_matches", """SELECT doc_id AS report_id, idx AS line, text FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS text, generate_subscripts(string_split(text, chr(10)), 1) AS idx FROM documents)
WHERE contains(replace(lower(text), 'ß', 'ss'), 'the ')""")
def p10(t):
    return lib.line_matches(t.documents.select(F.col("doc_id").alias("report_id"), F.col("text").alias("report_text")), NEEDLE).withColumn("line", F.col("line"))


@query("P12_view_filter", f"""WITH {st.REPORTS_SQL} SELECT report_id FROM reports WHERE deleted_at IS NOT NULL""")
def p12(t):
    return lib.in_view(st.reports(t), "trash").select("report_id")


@query("T1_sort_recorded", f"""WITH {st.REPORTS_SQL} SELECT report_id, date, start_time, created_at, row_number() OVER (ORDER BY coalesce(date,'') DESC, coalesce(start_time,'') DESC, coalesce(created_at, '') DESC, report_id DESC) AS place FROM reports""")
def t1(t):
    return placed(lib.sort_recorded(st.reports(t)).select("report_id", "date", "start_time", "created_at"))


@query("T2_sort_recent", f"""WITH {st.REPORTS_SQL} SELECT report_id, CASE WHEN created_at LIKE '%Z' THEN epoch(strptime(left(created_at, 19), '%Y-%m-%dT%H:%M:%S')) WHEN created_at LIKE '%+02:00' THEN epoch(strptime(left(created_at, 19), '%Y-%m-%dT%H:%M:%S')) - 7200 END AS created_instant, row_number() OVER (ORDER BY created_instant DESC NULLS LAST, report_id DESC) AS place FROM reports""")
def t2(t):
    return placed(lib.sort_recent(st.reports(t)).select("report_id", "created_instant"))


NATURAL_SQL = r"""list_transform(regexp_extract_all(replace(lower(regexp_extract({0}, '[^/]*$')), 'ß', 'ss'), '[0-9]+|[^0-9]+'),
  lambda p: {{'kind': CASE WHEN regexp_matches(p, '^[0-9]') THEN 0 ELSE 1 END, 'digits': CASE WHEN regexp_matches(p, '^[0-9]') THEN length(regexp_replace(p, '^0+(.)', '\1')) END,
             'text': CASE WHEN regexp_matches(p, '^[0-9]') THEN regexp_replace(p, '^0+(.)', '\1') ELSE p END}})"""
_MODES = {
    "newest": "coalesce(generated_at, '') DESC", "filename": NATURAL_SQL.format("filename"), "longest": "coalesce(duration, -1) DESC", "status": "state",
}
for _mode, _order in _MODES.items():

    def _t3(t, mode=_mode):
        rows = st.results(t).select(
            F.col("result_id").alias("row_id"), "filename", clk.instant("generated_at").alias("imported_at"),
            F.when(F.col("lang") != "fr", F.col("duration_seconds")).alias("duration"), "state",
        )
        return placed(lib.sort_rows(rows, mode).select("row_id", "filename", "duration", "state"))

    query(f"T3_sort_rows_{_mode}", f"""WITH {st.RESULTS_SQL}, d AS (SELECT *, CASE WHEN lang <> 'fr' THEN duration_seconds END AS duration FROM results)
SELECT result_id AS row_id, filename, duration, state, row_number() OVER (ORDER BY {_order}, result_id) AS place FROM d""")(_t3)


@query("T4_natural_sort", f"""SELECT page_id, url, row_number() OVER (ORDER BY {NATURAL_SQL.format('url')}, url, page_id) AS place FROM pages""")
def t4(t):
    return placed(lib.natural_sort(t.pages, "url", "page_id").select("page_id", "url"))


@query("T5_first_n", f"""WITH {st.ENTRIES_SQL} SELECT batch_id, position FROM entries QUALIFY row_number() OVER (PARTITION BY batch_id ORDER BY position) <= 2""")
def t5(t):
    rows = numbered(st.entries(t), ["batch_id"], ["position"], "nth", width=10**11)
    return rows.where("nth <= 2").select("batch_id", "position")


@query("T6_per_date_sort", f"""WITH {st.CLOCKED_SQL} SELECT *, row_number() OVER (ORDER BY coalesce(date, '') DESC, coalesce(start_time, '') DESC, report_id DESC) AS place FROM (SELECT batch_id AS report_id, date, min(time) AS start_time FROM clocked GROUP BY batch_id, date)""")
def t6(t):
    facets = lib.date_facets(_clocked(t), "batch_id").withColumnsRenamed({"batch_id": "report_id"})
    rows = facets.select("report_id", F.lit(None).cast("string").alias("created_at"), F.array(F.struct("date", "start_time")).alias("date_start_times"))
    return placed(lib.per_date(rows).select("report_id", "date", "start_time"))


@query("T7_newest_per_hash", f"""WITH {st.RESULTS_SQL} SELECT source_sha256, result_id, generated_at FROM results QUALIFY row_number() OVER (PARTITION BY source_sha256 ORDER BY coalesce(generated_at, '') DESC, result_id DESC) = 1""")
def t7(t):
    return res.newest_first(st.results(t).select("source_sha256", "result_id", "generated_at"), "source_sha256", "generated_at", "result_id")


@query("T8_selection_order", f"""WITH {st.ENTRIES_SQL} SELECT batch_id, position, state, row_number() OVER (ORDER BY batch_id, position) AS place FROM entries""")
def t8(t):
    return placed(st.entries(t).select("batch_id", "position", "state").orderBy("batch_id", "position"))


@query("W10_numbering", f"""WITH {st.ENTRIES_SQL} SELECT batch_id, position, row_number() OVER (PARTITION BY batch_id ORDER BY position) AS number FROM entries""")
def w10(t):
    return numbered(st.entries(t).select("batch_id", "position"), ["batch_id"], ["position"], "number", width=10**11)


@query("W11_duplicate_of", """SELECT doc_id, CASE WHEN min(doc_id) OVER (PARTITION BY sha256(text)) < doc_id THEN min(doc_id) OVER (PARTITION BY sha256(text)) END AS duplicate_of FROM documents""")
def w11(t):
    rows = t.documents.select("doc_id", F.sha2("text", 256).alias("key"))
    return lib.first_of_key(rows, "key", "doc_id").select("doc_id", "duplicate_of")


@query("W12_name_collision", """WITH x AS (SELECT source AS session_id, doc_id AS pos, CASE WHEN doc_id % 2 = 0 THEN upper(lang) ELSE lang END || '.wav' AS basename FROM documents)
SELECT session_id, pos, basename, CASE WHEN row_number() OVER (PARTITION BY session_id, lower(basename) ORDER BY pos) > 1 THEN 'source/doc-' || pos || '/' || basename ELSE 'source/' || basename END AS relative_path FROM x""")
def w12(t):
    name = F.concat(F.when(F.col("doc_id") % 2 == 0, F.upper("lang")).otherwise(F.col("lang")), F.lit(".wav"))
    rows = t.documents.select(
        F.col("source").alias("session_id"), F.col("doc_id").alias("pos"),
        F.concat(F.lit("doc-"), F.col("doc_id").cast("string")).alias("source_id"), name.alias("basename"),
    )
    return lib.name_collisions(rows)


@query("J8_with_annotations", f"""WITH {st.REPORTS_SQL}, notes AS (SELECT 'b-' || c_custkey AS report_id, c_name AS title, CASE WHEN c_mktsegment = 'BUILDING' THEN '2024-01-01' END AS deleted_at FROM customer)
SELECT r.report_id, coalesce(n.title, r.title) AS title, n.deleted_at FROM reports r LEFT JOIN notes n USING (report_id)""")
def j8(t):
    notes = t.customer.select(
        F.concat(F.lit("b-"), F.col("c_custkey").cast("string")).alias("report_id"), F.col("c_name").alias("title"),
        F.when(F.col("c_mktsegment") == "BUILDING", "2024-01-01").alias("deleted_at"),
    )
    return lib.with_annotations(st.reports(t).drop("deleted_at"), notes).select("report_id", "title", "deleted_at")


@query("J27_known_recordings", """WITH s AS (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY l_orderkey)
SELECT l_orderkey || '/' || l_linenumber || '/' || l_partkey || '/' || l_suppkey AS path, coalesce(CASE WHEN l_returnflag = 'R' THEN strftime(l_shipdate, '%Y-%m-%d') END, CASE WHEN n = 1 THEN strftime(o_orderdate, '%Y-%m-%d') END) AS recorded_at
FROM lineitem JOIN s USING (l_orderkey) LEFT JOIN orders ON o_orderkey = l_orderkey""")
def j27(t):
    sources = t.lineitem.select(
        F.col("l_orderkey").alias("session_id"), F.concat_ws("/", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").alias("path"),
        F.when(F.col("l_returnflag") == "R", F.date_format("l_shipdate", "yyyy-MM-dd")).alias("recorded_at"),
    )
    sessions = t.orders.select(F.col("o_orderkey").alias("session_id"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("recorded_at"))
    return lib.known_recordings(sources, sessions)


@query("J22_group_entries", """WITH g AS (SELECT l_orderkey AS batch_id, count(*) AS n, count(DISTINCT l_linenumber) AS d, min(l_linenumber) AS lo, max(l_linenumber) AS hi FROM lineitem GROUP BY l_orderkey)
SELECT batch_id, n = d AND lo = 1 AND hi = n AS valid FROM g""")
def j22(t):
    groups = t.lineitem.select(
        F.col("l_orderkey").alias("batch_id"),
        (F.col("l_linenumber") * 1000000 + F.hash("l_partkey", "l_suppkey") % 1000).cast("bigint").alias("group_no"),
        F.array(F.col("l_linenumber") - 1).alias("indices"),
    )
    sizes = t.lineitem.groupBy(F.col("l_orderkey").alias("batch_id")).agg(F.count(F.lit(1)).alias("entries"))
    return lib.confirmed_partition(groups, sizes)


@query("J28_reusable_report", """WITH r AS (SELECT doc_id, sha256(text) AS fingerprint, lang FROM documents)
SELECT d.doc_id AS request_id, max(r.doc_id) FILTER (r.lang <> 'de') AS reused_report FROM r d JOIN r USING (fingerprint) GROUP BY d.doc_id""")
def j28(t):
    docs = t.documents.select("doc_id", F.sha2("text", 256).alias("fingerprint"), "text", "lang")
    kept = docs.select(
        F.col("doc_id").alias("report_id"), F.col("doc_id").alias("folder"), "fingerprint", F.col("text").alias("report_text"),
        F.col("fingerprint").alias("report_sha256"),
    )
    trashed = docs.where("lang = 'de'").select(F.col("doc_id").alias("report_id"))
    return lib.reusable_report(docs.select(F.col("doc_id").alias("request_id"), "fingerprint"), kept, trashed).select("request_id", "reused_report")


@query("P11_visible", """WITH rec AS (SELECT o_orderkey AS result_id, o_custkey AS scope, CASE WHEN o_orderpriority = '1-URGENT' THEN 'source' ELSE 'new' END AS kind, CASE o_orderpriority WHEN '2-HIGH' THEN 2 WHEN '3-MEDIUM' THEN 1 END AS epoch, o_orderstatus FROM orders)
SELECT result_id FROM rec LEFT JOIN customer ON c_custkey = scope WHERE o_orderstatus <> 'P' AND (c_mktsegment IS DISTINCT FROM 'BUILDING' OR (kind = 'new' AND coalesce(epoch, 0) >= CASE WHEN c_nationkey < 12 THEN 2 ELSE 1 END))""")
def p11(t):
    records = t.orders.select(
        F.col("o_orderkey").alias("result_id"), F.col("o_custkey").alias("scope"),
        F.when(F.col("o_orderpriority") == "1-URGENT", "source").otherwise("new").alias("kind"),
        F.when(F.col("o_orderpriority") == "2-HIGH", 2).when(F.col("o_orderpriority") == "3-MEDIUM", 1).alias("lifecycle_epoch"),
    )
    deleted = t.orders.where("o_orderstatus = 'P'").select(F.col("o_orderkey").alias("result_id"))
    scopes = t.customer.where("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("scope"))
    epochs = t.customer.select(F.col("c_custkey").alias("scope"), F.when(F.col("c_nationkey") < 12, 2).otherwise(1).alias("epoch"))
    return lib.visible(records, deleted, scopes, epochs).select("result_id")


@query("P6_srt_valid", f"""WITH {st.AUDIT_SQL}, x AS (SELECT *, lag(from_ms) OVER (PARTITION BY source_id ORDER BY idx) AS p FROM audited), c AS (
 SELECT source_id, bool_and(coalesce(trim(text) <> '' AND from_ms >= 0 AND from_ms < to_ms AND to_ms / 1000 <= frames / rate AND from_ms >= coalesce(p, -1), false)) AS good, sum(len(reasons)) = 0 AS ok FROM x GROUP BY source_id)
SELECT source_id AS result_id, good AND ok AS srt_valid FROM c""")
def p6(t):
    audit = timeline.audited(st.turns(t), st.clocks(t))
    facts = timeline.verdicts(audit, st.clocks(t)).select(
        F.col("source_id").alias("result_id"), F.col("valid").alias("timestamp_valid"), (F.col("frames") / F.col("rate")).alias("duration_seconds")
    )
    segments = st.turns(t).select(
        F.col("source_id").alias("result_id"), "idx", (F.col("from_ms") / 1000).alias("start_seconds"), (F.col("to_ms") / 1000).alias("end_seconds"), "text"
    )
    return timeline.srt_ready(segments, facts)
