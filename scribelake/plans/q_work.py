"""Identity, reuse, queue, configuration and purge queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from scribelake.functions.text import valid_id
from scribelake.operators import config as cfg
from scribelake.operators import identity as idn
from scribelake.operators import results as res
from scribelake.plans import standins as st
from scribelake.plans.catalog import query


@query("P4_valid_id", r"""SELECT page_id, regexp_full_match(replace(substr(url, 9), '/', '_'), '[A-Za-z0-9][A-Za-z0-9_-]{0,95}') AS valid FROM pages""")
def p4(t):
    return t.pages.select("page_id", valid_id(F.replace(F.substr(F.col("url"), F.lit(9)), F.lit("/"), F.lit("_"))).alias("valid"))


@query("P5_source_rules", """WITH s AS (SELECT l_orderkey AS session_id, l_linenumber || '-' || l_partkey || '-' || l_suppkey AS source_id, l_returnflag, l_linestatus, l_linenumber, l_quantity, l_partkey FROM lineitem)
SELECT session_id, source_id, unnest(list_filter([CASE WHEN l_returnflag = 'R' THEN 'sha256' END, CASE WHEN l_quantity % 7 <> l_linenumber THEN 'order' END,
 CASE WHEN l_linestatus = 'O' AND l_returnflag = 'A' THEN 'contained' END, CASE WHEN l_partkey % 5 = 0 THEN 'basename' END], lambda x: x IS NOT NULL)) AS broken_rule FROM s""")
def p5(t):
    line = t.lineitem
    folder = F.when((F.col("l_linestatus") == "O") & (F.col("l_returnflag") == "A"), "other/").otherwise("source/")
    rows = line.select(
        F.col("l_orderkey").alias("session_id"), F.concat_ws("-", "l_linenumber", "l_partkey", "l_suppkey").alias("source_id"),
        F.lit("managed").alias("ownership"), F.concat(folder, F.lit("a.wav")).alias("path"),
        F.when(F.col("l_partkey") % 5 == 0, "b.wav").otherwise("a.wav").alias("basename"),
        F.when(F.col("l_returnflag") == "R", F.lit("short")).otherwise(F.sha2(F.col("l_partkey").cast("string"), 256)).alias("sha256"),
        F.lit(10).alias("size_bytes"), F.lit(10).alias("observed_size"),
        (F.col("l_quantity") % 7).cast("int").alias("order"), F.col("l_linenumber").alias("listed_at"),
    )
    return idn.source_rules(rows)


@query("J1_ordered_sources", f"""WITH o AS (SELECT conv_id AS session_id, turn AS pos, conv_id || '-' || turn AS source_id, length(text) AS n FROM conversations)
SELECT session_id, pos, source_id, n FROM o""")
def j1(t):
    key = F.concat_ws("-", "conv_id", "turn")
    sources = t.conversations.select(F.col("conv_id").alias("session_id"), key.alias("source_id"), F.length("text").alias("n"), "turn")
    order = t.conversations.select(F.col("conv_id").alias("session_id"), F.col("turn").alias("pos"), key.alias("source_id"))
    return idn.ordered_sources(order, sources.drop("turn")).select("session_id", "pos", "source_id", "n")


@query("J2_segments_by_source", """SELECT d.doc_id, c.turn, c.text FROM documents d LEFT JOIN conversations c ON c.conv_id = d.doc_id""")
def j2(t):
    d = t.documents.select("doc_id")
    return d.join(t.conversations.select(F.col("conv_id").alias("doc_id"), "turn", "text"), "doc_id", "left")


@query("J3_lookup_by_hash", f"""WITH {st.RESULTS_SQL}, p AS (SELECT item_id AS index, sha256(text) AS sha256 FROM benchmark UNION ALL SELECT doc_id + 1000000, sha256(text) FROM documents), k AS (SELECT source_sha256 AS sha256, count(*) AS existing, arg_max(result_id, (coalesce(generated_at, ''), result_id)) AS newest_result, arg_max_null(generated_at, (coalesce(generated_at, ''), result_id)) AS newest_at FROM results WHERE lang <> 'fr' GROUP BY ALL)
SELECT index, sha256, coalesce(existing, 0) AS existing, newest_result, newest_at FROM p LEFT JOIN k USING (sha256)""")
def j3(t):
    r = st.results(t).select(
        "result_id", "source_sha256", "generated_at", F.lit("verified").alias("run_integrity"),
        F.when(F.col("lang") != "fr", "verified").otherwise("missing_or_changed").alias("source_integrity"),
    )
    paths = t.benchmark.select(F.col("item_id").alias("index"), F.sha2("text", 256).alias("sha256")).unionByName(
        t.documents.select((F.col("doc_id") + 1000000).alias("index"), F.sha2("text", 256).alias("sha256"))
    )
    return res.lookup_by_hash(paths, r)


@query("J4_sessions_with_hash", """SELECT DISTINCT l_orderkey AS session_id FROM lineitem WHERE l_partkey IN (SELECT p_partkey FROM part WHERE p_type = 'ECONOMY')""")
def j4(t):
    sources = t.lineitem.select(F.col("l_orderkey").alias("session_id"), F.col("l_partkey").alias("sha256"))
    return idn.sessions_with_hash(sources, t.part.where("p_type = 'ECONOMY'").select(F.col("p_partkey").alias("sha256")))


@query("J5_reusable_run", """WITH req AS (SELECT c_custkey AS request_id, c_nationkey AS nation, c_mktsegment AS seg FROM customer), run AS (
 SELECT o_orderkey AS run_id, c_nationkey AS nation, c_mktsegment AS seg, o_custkey AS fp, CASE o_orderstatus WHEN 'F' THEN 'failed' WHEN 'O' THEN 'completed' ELSE 'review_required' END AS state,
        strftime(o_orderdate, '%Y-%m-%d') AS done_at, o_orderpriority <> '5-LOW' AS usable FROM orders JOIN customer ON c_custkey = o_custkey), hit AS (
 SELECT request_id, run_id, state, fp = request_id AS exact, row_number() OVER (PARTITION BY request_id ORDER BY (fp = request_id) DESC, done_at DESC, run_id DESC) AS r
 FROM req JOIN run ON req.nation = run.nation AND (req.seg = run.seg OR (req.seg = 'BUILDING' AND run.seg = 'FURNITURE')) WHERE usable AND state <> 'failed')
SELECT request_id, run_id AS reused_run, state AS reused_state, exact AS exact_fingerprint FROM req LEFT JOIN (SELECT * FROM hit WHERE r = 1) USING (request_id)""")
def j5(t):
    c = t.customer
    requests = c.select(
        F.col("c_custkey").alias("request_id"), F.col("c_nationkey").alias("nation"),
        F.col("c_mktsegment").alias("transform_identity"), F.col("c_custkey").alias("fingerprint"),
    )
    runs = t.orders.join(c, F.col("c_custkey") == F.col("o_custkey")).select(
        F.col("o_orderkey").alias("run_id"), F.col("c_nationkey").alias("nation"), F.col("c_mktsegment").alias("transform_identity"),
        F.col("o_custkey").alias("fingerprint"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("completed_at"),
        F.when(F.col("o_orderstatus") == "F", "failed").when(F.col("o_orderstatus") == "O", "completed").otherwise("review_required").alias("state"),
        (F.col("o_orderpriority") != "5-LOW").alias("usable"),
    )
    pairs = c.where("c_mktsegment IN ('BUILDING', 'FURNITURE')").agg(
        F.max("c_mktsegment").alias("saved"), F.min("c_mktsegment").alias("wanted")
    )
    return idn.reusable_run(requests, runs, ["nation"], pairs)


@query("J29_negative_reuse", """SELECT c_custkey AS request_id, max(o_orderkey) AS rejected_by_run FROM customer JOIN orders ON o_custkey = c_custkey
 WHERE o_orderstatus = 'F' AND o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R') GROUP BY c_custkey""")
def j29(t):
    requests = t.customer.select(F.col("c_custkey").alias("request_id"), F.col("c_custkey").alias("fingerprint"))
    failed = t.orders.select(
        F.col("o_orderkey").alias("run_id"), F.col("o_custkey").alias("fingerprint"), F.when(F.col("o_orderstatus") == "F", "failed").otherwise("completed").alias("state")
    )
    broken = t.lineitem.where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("run_id"))
    return idn.negative_reuse(requests, failed, broken, ["fingerprint"])


@query("J6_not_adopted", f"""WITH {st.RESULTS_SQL} SELECT result_id FROM results WHERE lang NOT IN ('en')""")
def j6(t):
    r = st.results(t)
    return res.not_adopted(r, r.where("lang = 'en'")).select("result_id")


@query("J7_with_labels", f"""WITH {st.RESULTS_SQL}, {st.LABELS_SQL} SELECT r.result_id, filename, course, speaker, event FROM results r LEFT JOIN tags USING (result_id)""")
def j7(t):
    return res.with_labels(st.results(t).select("result_id", "filename"), st.labels(t))


@query("J9_open_rows", f"""WITH {st.QUEUE_SQL}, {st.WATCHED_SQL}, r AS (SELECT 'r-' || o_orderkey AS result_id, 'completed' AS state FROM orders)
SELECT 'job' AS kind, job_id AS row_id, state FROM queue
UNION ALL SELECT 'result', result_id, state FROM r WHERE result_id NOT IN (SELECT result_id FROM queue WHERE result_id IS NOT NULL)
UNION ALL SELECT 'watched', path, state FROM watched w WHERE state <> 'processed' AND NOT EXISTS (SELECT 1 FROM queue q WHERE q.path = w.path AND q.watched_version_key = w.version_key)
 AND NOT EXISTS (SELECT 1 FROM queue q WHERE q.path = w.path AND q.state IN ('waiting', 'processing') AND q.result_id IS NULL)""")
def j9(t):
    r = t.orders.select(F.concat(F.lit("r-"), F.col("o_orderkey").cast("string")).alias("result_id"), F.lit("completed").alias("state"))
    return res.open_rows(st.queue(t), r, st.watched(t))


@query("J30_startable_new", f"""WITH {st.QUEUE_SQL}, {st.WATCHED_SQL} SELECT path FROM watched w WHERE state = 'ready' AND length(version_key) = 64 AND segment <> 'FURNITURE'
 AND NOT EXISTS (SELECT 1 FROM queue q WHERE q.path = w.path AND q.watched_version_key = w.version_key)
 AND NOT EXISTS (SELECT 1 FROM queue q WHERE q.path = w.path AND q.state IN ('waiting', 'processing') AND q.result_id IS NULL)""")
def j30(t):
    w = st.watched(t)
    return res.startable(w, st.queue(t), w.where("segment = 'FURNITURE'")).select("path")


@query("J31_accept_files", f"""WITH {st.QUEUE_SQL}, o AS (SELECT '/rec/' || CASE WHEN c_mktsegment = 'BUILDING' THEN 'new-' ELSE '' END || c_nationkey || '.wav' AS path, c_custkey AS pos FROM customer)
SELECT path, min(pos) AS pos FROM o WHERE path NOT IN (SELECT path FROM queue WHERE state IN ('waiting', 'processing') AND NOT deletion_pending) GROUP BY path""")
def j31(t):
    offered = t.customer.select(
        F.concat(
            F.lit("/rec/"), F.when(F.col("c_mktsegment") == "BUILDING", "new-").otherwise(""), F.col("c_nationkey").cast("string"), F.lit(".wav")
        ).alias("path"), F.col("c_custkey").alias("pos")
    )
    return res.accept_files(offered, st.queue(t).where("NOT deletion_pending"))


@query("J11_hash_verify", """WITH m AS (SELECT l_orderkey AS run_id, l_linenumber || '/' || l_partkey || '/' || l_suppkey AS path, l_partkey, l_returnflag, l_linestatus FROM lineitem)
SELECT o_orderkey AS run_id, count(path) AS artifacts, coalesce(bool_and(NOT (l_returnflag = 'R' AND l_linestatus = 'F')), false) AS verified FROM orders LEFT JOIN m ON run_id = o_orderkey GROUP BY o_orderkey""")
def j11(t):
    path = F.concat_ws("/", "l_linenumber", "l_partkey", "l_suppkey")
    files = t.lineitem.select(F.col("l_orderkey").alias("run_id"), path.alias("path"), F.col("l_partkey").cast("string").alias("sha"), "l_returnflag", "l_linestatus")
    runs = t.orders.select(F.col("o_orderkey").alias("run_id"))
    named = files.select("run_id", "path", F.col("sha").alias("expected"))
    changed = (F.col("l_returnflag") == "R") & (F.col("l_linestatus") == "F")
    seen = files.select("run_id", "path", F.when(changed, "other").otherwise(F.col("sha")).alias("sha256"))
    return idn.artifact_checks(runs, named, seen)


@query("P21_required_artifacts", """SELECT o_orderkey, CASE o_orderstatus WHEN 'O' THEN o_orderpriority <> '1-URGENT' WHEN 'P' THEN true ELSE false END AS complete FROM orders""")
def p21(t):
    names = idn.REQUIRED["completed"]
    full = F.create_map(*[x for n in names for x in (F.lit(n), F.lit("h"))])
    lacking = F.create_map(*[x for n in names if n != "transcript.srt" for x in (F.lit(n), F.lit("h"))])
    state = F.when(F.col("o_orderstatus") == "O", "completed").when(F.col("o_orderstatus") == "P", "review_required").otherwise("failed")
    hashes = F.when(F.col("o_orderpriority") == "1-URGENT", lacking).otherwise(full)
    return t.orders.select("o_orderkey", idn.has_required(state, hashes).alias("complete"))


@query("J20_overlap_check", """WITH b AS (SELECT conv_id AS ses, turn AS pos, sha256(text) AS h FROM conversations), a AS (
  SELECT conv_id + 1000000 AS sel, turn AS pos, CASE WHEN conv_id % 3 = 0 OR (conv_id % 3 = 1 AND turn = 0) THEN sha256(text) ELSE sha256(text || '!') END AS h FROM conversations),
 wb AS (SELECT ses, string_agg(pos || ':' || h, ',' ORDER BY pos, h) AS l FROM b GROUP BY ses), wa AS (SELECT sel, string_agg(pos || ':' || h, ',' ORDER BY pos, h) AS l FROM a GROUP BY sel), e AS (SELECT l, min(ses) AS ses FROM wb GROUP BY l)
SELECT sel AS selection_id, ses AS reused_session, CASE WHEN ses IS NOT NULL THEN 'reuse' WHEN sel IN (SELECT sel FROM a WHERE h IN (SELECT h FROM b)) THEN 'conflict' ELSE 'new' END AS decision FROM wa LEFT JOIN e USING (l)""")
def j20(t):
    conv, turn = F.col("conv_id"), F.col("turn")
    kept = (conv % 3 == 0) | ((conv % 3 == 1) & (turn == 0))
    a = t.conversations.select(
        (conv + 1000000).alias("selection_id"), turn.alias("pos"),
        F.sha2(F.when(kept, F.col("text")).otherwise(F.concat("text", F.lit("!"))), 256).alias("sha256"),
    )
    b = t.conversations.select(conv.alias("session_id"), turn.alias("pos"), F.sha2("text", 256).alias("sha256"))
    return idn.import_overlap(a, b)


@query("J21_inherited_version", """WITH s AS (SELECT o_custkey AS run, CASE WHEN o_orderstatus = 'P' THEN '' ELSE o_orderpriority END AS v FROM orders), c AS (SELECT run, count(DISTINCT v) AS n, max(v) AS v FROM s WHERE v <> '' GROUP BY run)
SELECT c_custkey AS run_id, CASE WHEN n = 1 THEN v END AS app_version, NULL::VARCHAR AS app_build FROM customer LEFT JOIN c ON run = c_custkey""")
def j21(t):
    asked = t.customer.select(F.col("c_custkey").alias("run_id"))
    saved = t.orders.select(
        F.col("o_custkey").alias("run_id"), F.when(F.col("o_orderstatus") == "P", "").otherwise(F.col("o_orderpriority")).alias("app_version"),
        F.lit(None).cast("string").alias("app_build"),
    )
    return res.inherited_version(asked, saved, ["run_id"])


@query("J23_referenced_identity", """SELECT o_orderkey, c_custkey IS NOT NULL AND o_orderkey % 25 = c_nationkey AS reusable FROM orders LEFT JOIN customer ON c_custkey = o_custkey""")
def j23(t):
    sources = t.orders.select("o_orderkey", F.col("o_custkey").alias("path"), (F.col("o_orderkey") % 25).alias("inode"), F.lit(None).cast("bigint").alias("ctime_ns"))
    seen = t.customer.select(F.col("c_custkey").alias("path"), F.col("c_nationkey").cast("bigint").alias("inode"), F.lit(1).cast("bigint").alias("ctime_ns"))
    return idn.referenced_unchanged(sources, seen, ["inode", "ctime_ns"]).select("o_orderkey", "reusable")


@query("J24_snapshot_diff", """WITH a AS (SELECT c_custkey AS path, c_nationkey AS v FROM customer), b AS (SELECT o_custkey AS path, min(o_orderkey) % 25 AS v FROM orders GROUP BY o_custkey)
SELECT coalesce(a.path, b.path) AS path, CASE WHEN b.path IS NULL THEN 'missing' WHEN a.path IS NULL THEN 'new' WHEN a.v <> b.v THEN 'changed' ELSE 'same' END AS change FROM a FULL JOIN b ON a.path = b.path""")
def j24(t):
    old = t.customer.select(F.col("c_custkey").alias("path"), F.col("c_nationkey").cast("bigint").alias("version"))
    new = t.orders.groupBy(F.col("o_custkey").alias("path")).agg((F.min("o_orderkey") % 25).alias("version"))
    return idn.snapshot_diff(old, new)


@query("J25_archived_lookup", """WITH e AS (SELECT c_custkey AS session_id, 'live' AS place FROM customer UNION ALL SELECT o_custkey, 'archive' FROM orders)
SELECT session_id, count(*) AS copies, CASE WHEN count(*) = 1 THEN max(place) END AS place FROM e GROUP BY session_id""")
def j25(t):
    return idn.live_or_archived(t.customer.select(F.col("c_custkey").alias("session_id")), t.orders.select(F.col("o_custkey").alias("session_id")))


@query("J26_source_integrity", f"""WITH {st.RESULTS_SQL} SELECT result_id, CASE WHEN lang = 'es' THEN 'not_applicable' WHEN lang = 'fr' THEN 'pending' WHEN l.doc_id IS NOT NULL AND quality = 1 AND toxic = 0 THEN 'verified' ELSE 'missing_or_changed' END AS source_integrity
FROM results r LEFT JOIN labels l ON 'r-' || l.doc_id = result_id""")
def j26(t):
    r = st.results(t).select(
        "result_id", "source_sha256", F.col("result_id").alias("path"), F.when(F.col("lang") == "es", "report").otherwise("new").alias("kind"),
        (F.col("lang") == "fr").alias("deferred"),
    )
    hashes = t.documents.select("doc_id", F.sha2("text", 256).alias("sha256"))
    seen = t.labels.join(hashes, "doc_id").select(
        F.concat(F.lit("r-"), F.col("doc_id").cast("string")).alias("path"), F.when(F.col("quality") == 1, F.col("sha256")).otherwise("x").alias("sha256"),
        F.lit(0).alias("stat_before"), F.col("toxic").alias("stat_after"),
    )
    return res.source_integrity(r, seen).select("result_id", "source_integrity")


@query("P17_batch_state", f"""WITH {st.ENTRIES_SQL}, c AS (SELECT batch_id, count(*) FILTER (state IN ('failed', 'cancelled')) AS b, count(*) FILTER (state = 'review_required') AS r FROM entries GROUP BY batch_id)
SELECT batch_id, CASE WHEN b > 0 THEN 'partial' WHEN r > 0 THEN 'review_required' ELSE 'completed' END AS state, CASE WHEN b > 0 THEN 'incomplete' WHEN r > 0 THEN 'review_required' ELSE 'passed_checks' END AS quality FROM c""")
def p17(t):
    counts = res.state_counts(st.entries(t).withColumn("duplicate_of", F.lit(None)), "batch_id")
    return counts.select("batch_id", res.batch_state(F.col("failed"), F.col("cancelled"), F.col("review_required")).alias("s")).select("batch_id", "s.*")


@query("P18_quality_message", f"""WITH {st.RESULTS_SQL} SELECT result_id, CASE WHEN lang = 'fr' THEN '{res.MESSAGES["pending"]}' WHEN lang = 'es' THEN '{res.MESSAGES["unavailable"]}' WHEN state = 'review_required' THEN '{res.MESSAGES["review"]}' ELSE '{res.MESSAGES["unverified"]}' END AS message FROM results""")
def p18(t):
    integrity = F.when(F.col("lang") == "fr", "pending").when(F.col("lang") == "es", "missing_or_changed").otherwise("verified")
    return st.results(t).select("result_id", res.quality_message(integrity, F.col("state")).alias("message"))


@query("P19_format_map", """SELECT p_partkey, CASE p_type WHEN 'SMALL' THEN 'int16' WHEN 'ECONOMY' THEN 'float32' ELSE p_type END AS sample_format FROM part""")
def p19(t):
    name = F.when(F.col("p_type") == "SMALL", "PCM_S16").when(F.col("p_type") == "ECONOMY", "IEEE_FLOAT32").otherwise(F.col("p_type"))
    return t.part.select("p_partkey", res.sample_format(name).alias("sample_format"))


@query("P20_available_formats", f"""WITH {st.RESULTS_SQL} SELECT result_id, CASE WHEN lang = 'en' THEN 'md,txt,json,srt' ELSE 'md,txt,json' END AS formats FROM results""")
def p20(t):
    return st.results(t).select("result_id", F.array_join(res.available_formats(F.col("lang") == "en"), ",").alias("formats"))


@query("P22_enriched_terminal", """WITH p AS (SELECT user_id, min(event_id) AS eid FROM events WHERE event_type = 'purchase' GROUP BY user_id)
SELECT event_id, CASE WHEN event_type = 'purchase' AND p.eid IS NOT NULL THEN 'r-' || p.eid END AS result_id FROM events LEFT JOIN p USING (user_id)""")
def p22(t):
    done = F.col("event_type") == "purchase"
    events = t.events.select(
        "event_id", F.lit("b").alias("batch_id"), F.col("user_id").alias("index"), F.lit("file").alias("type"),
        F.when(done, "completed").otherwise("processing").alias("state"),
    )
    published = t.events.where(done).groupBy(F.col("user_id").alias("index")).agg(
        F.concat(F.lit("r-"), F.min("event_id").cast("string")).alias("result_id"), F.max("value").alias("duration_seconds")
    ).withColumn("batch_id", F.lit("b"))
    return res.enriched_terminal(events, published).select("event_id", "result_id")


@query("P23_reading_body", """SELECT doc_id, CASE WHEN lang <> 'de' THEN '## 1. ' || source || chr(10) || text END AS body FROM documents""")
def p23(t):
    head = F.lit("# Transcript Report\n\nSelected files: 1 · Completed: 1\nTimestamps restart at zero for each source. x\nAll stored ASR text is retained. y\n\n## 1. ")
    markdown = F.concat(head, F.col("source"), F.lit("\n"), F.col("text"))
    integrity = F.when(F.col("lang") == "de", "modified").otherwise("intact")
    return t.documents.select("doc_id", res.reading_body(markdown, integrity).alias("body"))


@query("P25_revalidated_state", f"""WITH {st.RESULTS_SQL} SELECT result_id, CASE WHEN lang = 'de' OR duration_seconds < 100 THEN 'review_required' ELSE state END AS state FROM results""")
def p25(t):
    quality = F.when(F.col("lang") == "de", F.lit(None).cast("string")).otherwise("passed_checks")
    return st.results(t).select("result_id", res.revalidated(F.col("state"), F.lit(False), F.col("duration_seconds") >= 100, quality).alias("state"))


@query("P26_report_integrity", """SELECT doc_id, CASE WHEN lang = 'fr' THEN 'modified' ELSE 'intact' END AS integrity FROM documents""")
def p26(t):
    saved = F.when(F.col("lang") == "fr", F.sha2(F.concat("text", F.lit("x")), 256)).otherwise(F.sha2("text", 256))
    return t.documents.select("doc_id", res.report_integrity(F.col("text"), saved).alias("integrity"))


@query("P27_import_version", f"""WITH {st.WATCHED_SQL} SELECT path, CASE WHEN state = 'ready' AND length(version_key) = 64 THEN version_key END AS version FROM watched""")
def p27(t):
    return st.watched(t).select("path", res.import_version(F.col("path"), F.col("path"), F.col("state"), F.col("version_key")).alias("version"))


@query("P28_same_order", """SELECT o_orderkey, o_orderstatus <> 'P' AND o_orderpriority <> '1-URGENT' AS finished FROM orders""")
def p28(t):
    paths = F.array(F.lit("/a"), F.col("o_custkey").cast("string"))
    saved = F.when(F.col("o_orderpriority") == "1-URGENT", F.reverse(paths)).otherwise(paths)
    states = F.array(F.lit("completed"), F.when(F.col("o_orderstatus") == "P", "processing").otherwise("failed"))
    return t.orders.select("o_orderkey", res.same_order(paths, saved, states).alias("finished"))


@query("A20_latest_success", """WITH n AS (SELECT o_custkey AS s, arg_max(o_orderkey, (strftime(o_orderdate, '%Y-%m-%d'), o_orderkey)) AS latest FROM orders WHERE o_orderstatus = 'O' AND o_orderpriority <> '5-LOW' GROUP BY o_custkey), a AS (SELECT o_custkey AS s, max(o_orderkey) AS acc FROM orders WHERE o_orderstatus = 'O' GROUP BY o_custkey)
SELECT s AS session_id, latest AS latest_run, acc AS accepted_run, CASE WHEN latest = acc THEN 'accepted' ELSE 'pending' END AS acceptance FROM n LEFT JOIN a USING (s)""")
def a20(t):
    return _latest(t)


def _latest(t):
    runs = t.orders.select(
        F.col("o_custkey").alias("session_id"), F.col("o_orderkey").alias("run_id"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("completed_at"),
        F.when(F.col("o_orderstatus") == "O", "completed").otherwise("failed").alias("state"), (F.col("o_orderpriority") != "5-LOW").alias("verified"),
    )
    accepted = t.orders.where("o_orderstatus = 'O'").groupBy(F.col("o_custkey").alias("session_id")).agg(F.max("o_orderkey").alias("accepted_run"))
    return idn.latest_success(runs, accepted)


@query("A32_session_overview", """WITH n AS (SELECT o_custkey AS s, arg_max(o_orderkey, (strftime(o_orderdate, '%Y-%m-%d'), o_orderkey)) AS latest FROM orders WHERE o_orderstatus = 'O' AND o_orderpriority <> '5-LOW' GROUP BY o_custkey), a AS (SELECT o_custkey AS s, max(o_orderkey) AS acc FROM orders WHERE o_orderstatus = 'O' GROUP BY o_custkey), k AS (SELECT o_custkey AS s, count(*) AS k FROM orders GROUP BY o_custkey)
SELECT c_custkey AS session_id, c_mktsegment AS processing_status, coalesce(k, 0) AS source_count, latest AS latest_run, CASE WHEN latest IS NOT NULL THEN acc END AS accepted_run
FROM customer LEFT JOIN k ON k.s = c_custkey LEFT JOIN n ON n.s = c_custkey LEFT JOIN a ON a.s = c_custkey""")
def a32(t):
    sessions = t.customer.select(F.col("c_custkey").alias("session_id"), F.col("c_mktsegment").alias("processing_status"))
    return idn.session_overview(sessions, t.orders.select(F.col("o_custkey").alias("session_id")), _latest(t))


@query("A26_tree_digest", """WITH i AS (SELECT l_orderkey AS run_id, sha256(l_linenumber || '/' || l_suppkey || ':' || l_partkey) AS h FROM lineitem), w AS (
 SELECT run_id, count(*) AS files, list_transform(range(8), lambda k: 0) AS z, """ + ", ".join(f"sum(('0x' || substr(h, {1 + 8 * k}, 8))::BIGINT) % 4294967296 AS w{k}" for k in range(8)) + """ FROM i GROUP BY run_id)
SELECT run_id, files, sha256(files || ':' || """ + " || ':' || ".join(f"w{k}" for k in range(8)) + """) AS digest FROM w""")
def a26(t):
    files = t.lineitem.select(
        F.col("l_orderkey").alias("run_id"), F.concat_ws("/", "l_linenumber", "l_suppkey").alias("path"), F.col("l_partkey").cast("string").alias("sha")
    )
    return idn.tree_digest(files, "run_id", "path", "sha")


@query("A31_shared_cancel", """SELECT l_partkey AS key, count(*) AS consumers, bool_and(l_returnflag = 'A') AND bool_and(l_linestatus = 'F') AS stop FROM lineitem GROUP BY l_partkey""")
def a31(t):
    jobs = t.lineitem.select(F.col("l_partkey").alias("key"), (F.col("l_returnflag") == "A").alias("cancelled"), (F.col("l_linestatus") == "F").alias("known"))
    return idn.shared_cancel(jobs, F.col("known"))


@query("W15_rank_runs", """SELECT o_custkey AS session_id, o_orderkey AS run_id, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey DESC) AS rank FROM orders""")
def w15(t):
    from scribelake.operators.ordered import numbered

    runs = t.orders.select(F.col("o_custkey").alias("session_id"), F.col("o_orderkey").alias("run_id"), (-F.col("o_orderkey")).alias("age"))
    return numbered(runs, ["session_id"], ["age"], "rank").drop("age")


# Queue


@query("M9_queue_restore", """WITH s AS (SELECT o_custkey AS list_id, o_orderkey AS position, CASE o_orderstatus WHEN 'F' THEN 'failed' WHEN 'O' THEN 'odd' ELSE 'processing' END AS state, o_orderpriority AS message, 'j-' || (o_orderkey // 2) AS job FROM orders)
SELECT position, list_id::VARCHAR AS path, CASE WHEN state = 'failed' THEN 'failed' ELSE 'waiting' END AS state, CASE state WHEN 'processing' THEN 'interrupted' WHEN 'odd' THEN NULL ELSE message END AS message,
 CASE WHEN position = min(position) OVER (PARTITION BY job) THEN job END AS kept_job_id FROM s""")
def m9(t):
    saved = t.orders.select(
        F.col("o_orderkey").alias("position"), F.col("o_custkey").cast("string").alias("path"),
        F.when(F.col("o_orderstatus") == "F", "failed").when(F.col("o_orderstatus") == "O", "odd").otherwise("processing").alias("state"),
        F.col("o_orderpriority").alias("message"), F.concat(F.lit("j-"), F.call_function("div", "o_orderkey", F.lit(2)).cast("string")).alias("job_id"),
    )
    return res.restore_queue(saved.select("position", "path"), saved)


@query("M10_next_batch", f"""WITH {st.QUEUE_SQL}, r AS (SELECT * FROM queue WHERE state = 'waiting' AND NOT deletion_pending), f AS (SELECT list_id, arg_min(model, position) AS m, arg_min(force, position) AS fo FROM r GROUP BY list_id)
SELECT r.job_id FROM r JOIN f USING (list_id) WHERE r.model = f.m AND r.force = f.fo""")
def m10(t):
    return res.next_batch(st.queue(t), ["list_id"]).select("job_id")


@query("M12_resume_row", f"""WITH {st.QUEUE_SQL} SELECT job_id, 'waiting' AS state, force OR state = 'failed' AS force, NULL::VARCHAR AS batch_id FROM queue""")
def m12(t):
    return res.resuming(st.queue(t)).select("job_id", "state", "force", "batch_id")


@query("M15_permute_rows", """WITH r AS (SELECT conv_id AS list_id, turn + 1 AS row_no, conv_id || '/' || turn AS path FROM conversations), a AS (SELECT conv_id AS list_id, turn + 1 AS slot, CASE WHEN conv_id % 3 = 0 THEN 1 ELSE max(turn) OVER (PARTITION BY conv_id) - turn + 1 END AS row_no FROM conversations), g AS (
 SELECT list_id FROM a GROUP BY list_id HAVING count(DISTINCT row_no) = count(*) AND min(row_no) = 1 AND max(row_no) = count(*))
SELECT a.list_id, slot, path FROM a JOIN r USING (list_id, row_no) WHERE list_id IN (SELECT list_id FROM g)""")
def m15(t):
    c = t.conversations
    rows = c.select(F.col("conv_id").alias("list_id"), (F.col("turn") + 1).alias("row_no"), F.concat_ws("/", "conv_id", "turn").alias("path"))
    last = c.groupBy("conv_id").agg(F.max("turn").alias("last"))
    answers = c.join(last, "conv_id").select(
        F.col("conv_id").alias("list_id"), (F.col("turn") + 1).alias("slot"),
        F.when(F.col("conv_id") % 3 == 0, 1).otherwise(F.col("last") - F.col("turn") + 1).alias("row_no"),
    )
    return res.permute(rows, answers)


# Configuration

LAYERS_SQL = """layers AS (
  SELECT c_custkey AS request_id, 'channel' AS field, 'mean' AS value, 0 AS precedence, 'application_defaults' AS origin FROM customer
  UNION ALL SELECT c_custkey, 'threads', '4', 0, 'application_defaults' FROM customer
  UNION ALL SELECT c_custkey, 'threads', (c_nationkey - 3)::VARCHAR, 1, 'speaker:' || c_nationkey FROM customer
  UNION ALL SELECT o_custkey, 'channel', CASE o_orderstatus WHEN 'F' THEN 'left' WHEN 'O' THEN 'right' ELSE 'both' END, 2 + o_orderkey, 'explicit_override' FROM orders)"""


def _layers(t):
    c, o = t.customer, t.orders
    row = lambda df, key, field, value, prec, origin: df.select(
        F.col(key).alias("request_id"), F.lit(field).alias("field"), value.alias("value"), prec.cast("bigint").alias("precedence"), origin.alias("origin")
    )
    channel = F.when(F.col("o_orderstatus") == "F", "left").when(F.col("o_orderstatus") == "O", "right").otherwise("both")
    default = F.lit("application_defaults")
    return (
        row(c, "c_custkey", "channel", F.lit("mean"), F.lit(0), default)
        .unionByName(row(c, "c_custkey", "threads", F.lit("4"), F.lit(0), default))
        .unionByName(row(c, "c_custkey", "threads", (F.col("c_nationkey") - 3).cast("string"), F.lit(1), F.concat(F.lit("speaker:"), F.col("c_nationkey").cast("string"))))
        .unionByName(row(o, "o_custkey", "channel", channel, F.col("o_orderkey") + 2, F.lit("explicit_override")))
    )


@query("M8_resolve_config", f"""WITH {LAYERS_SQL} SELECT request_id, field, arg_max(value, precedence) AS value, arg_max(origin, precedence) AS origin FROM layers GROUP BY request_id, field""")
def m8(t):
    return cfg.resolved(_layers(t))


@query("M8_recipes", """WITH r AS (SELECT p_brand AS sp, p_type AS ca, p_size AS gl, count(*) AS n, min(p_partkey) AS id FROM part WHERE p_name LIKE 'red%' GROUP BY ALL)
SELECT l_orderkey || '/' || l_linenumber || '/' || l_partkey || '/' || l_suppkey AS request_id, coalesce(n, 0) AS matches, CASE WHEN n = 1 THEN id END AS recipe_id, coalesce(n > 1, false) AS conflict
FROM lineitem JOIN part p ON p.p_partkey = l_partkey LEFT JOIN r ON sp = p_brand AND ca = p_type AND gl = p_size""")
def m8_recipes(t):
    requests = t.lineitem.join(t.part, F.col("p_partkey") == F.col("l_partkey")).select(
        F.concat_ws("/", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").alias("request_id"),
        F.col("p_brand").alias("speaker_id"), F.col("p_type").alias("capture_id"), F.col("p_size").alias("glossary_sha256"),
    )
    recipes = t.part.select(
        F.col("p_partkey").alias("recipe_id"), F.col("p_brand").alias("speaker_id"), F.col("p_type").alias("capture_id"), F.col("p_size").alias("glossary_sha256"),
        F.when(F.col("p_name").startswith("red"), "validated_for_listed_clips").otherwise("provisional").alias("state"), F.lit(True).alias("apply_to_matching_profiles"),
    )
    return cfg.applicable_recipes(requests, recipes)


@query("P13_policy_rules", f"""WITH {LAYERS_SQL} SELECT request_id, field, value FROM layers WHERE (field = 'channel' AND value NOT IN ('mean', 'left', 'right')) OR (field = 'threads' AND NOT (value::INT BETWEEN 1 AND 128))""")
def p13(t):
    return cfg.broken_policies(_layers(t))


@query("P13_gain_limit", """SELECT o_orderkey AS request_id, (o_custkey % 50)::DOUBLE AS gain_db, CASE WHEN o_orderkey % 3 = 0 THEN 30.0 ELSE o_orderkey % 61 END::DOUBLE AS max_gain_db FROM orders
WHERE o_orderkey % 7 <> 0 AND o_custkey % 50 > CASE WHEN o_orderkey % 3 = 0 THEN 30 ELSE o_orderkey % 61 END""")
def p13_gain(t):
    """A gain above the request's own limit, or above the usual one where it has none; some gains are no numbers."""
    key = F.col("o_orderkey")
    gain = F.when(key % 7 == 0, F.lit("loud")).otherwise((F.col("o_custkey") % 50).cast("string"))
    limit = F.when(key % 3 != 0, (key % 61).cast("string"))
    fields = F.array(F.struct(F.lit("gain_db").alias("field"), gain.alias("value")), F.struct(F.lit("max_gain_db").alias("field"), limit.alias("value")))
    rows = t.orders.select(key.alias("request_id"), F.explode(fields).alias("f")).select("request_id", "f.field", "f.value")
    return cfg.gains_above_limit(rows.where("value IS NOT NULL"))


@query("P14_profile_rules", """WITH p AS (SELECT doc_id AS profile_id, string_split(text, chr(10)) AS terms FROM documents)
SELECT profile_id, unnest(list_filter([CASE WHEN len(terms) > 100 THEN 'too_many_terms' END, CASE WHEN len(list_filter(terms, lambda x: trim(x) = '')) > 0 THEN 'blank_term' END,
 CASE WHEN len(list_filter(terms, lambda x: length(x) > 200)) > 0 THEN 'long_term' END], lambda x: x IS NOT NULL)) AS broken_rule FROM p""")
def p14(t):
    return cfg.broken_terms(t.documents.select(F.col("doc_id").alias("profile_id"), F.split("text", "\n").alias("terms")))


@query("S12_profile_scan", """SELECT p_type AS kind, p_brand AS profile_id, count(*) AS definitions, count(*) = 1 AS usable FROM part GROUP BY p_type, p_brand""")
def s12(t):
    return cfg.unique_profiles(t.part.select(F.col("p_type").alias("kind"), F.col("p_brand").alias("profile_id")))


@query("M11_add_profile", """SELECT DISTINCT p_type AS kind, p_brand AS profile_id FROM part p WHERE NOT EXISTS (SELECT 1 FROM part q WHERE q.p_name LIKE 'red%' AND q.p_type = p.p_type AND q.p_brand = p.p_brand)""")
def m11(t):
    rows = t.part.select(F.col("p_type").alias("kind"), F.col("p_brand").alias("profile_id"), "p_name")
    return cfg.addable_profiles(rows.drop("p_name").distinct(), rows.where(F.col("p_name").startswith("red")))


@query("F23_identity_projection", """SELECT c_custkey, 'asr.model=' || c_mktsegment || ',glossary=' || c_nationkey AS kept FROM customer""")
def f23(t):
    settings = F.create_map(
        F.lit("asr.model"), F.col("c_mktsegment"), F.lit("execution.mode"), F.lit("auto"), F.lit("origins.execution.mode"), F.lit("x"),
        F.lit("glossary"), F.col("c_nationkey").cast("string"),
    )
    kept = F.transform(F.map_entries(cfg.inference_settings(settings)), lambda e: F.concat(e["key"], F.lit("="), e["value"]))
    return t.customer.select("c_custkey", F.array_join(F.array_sort(kept), ",").alias("kept"))


@query("U2_distinct_keep_order", r"""WITH a AS (SELECT p_partkey, string_split(p_name, ' ') || string_split(lower(p_type || ' ' || p_name), ' ') AS terms FROM part), u AS (SELECT p_partkey, unnest(terms) AS term, generate_subscripts(terms, 1) AS i FROM a), f AS (SELECT p_partkey, term, min(i) AS i FROM u GROUP BY p_partkey, term)
SELECT p_partkey, string_agg(term, ',' ORDER BY i) AS terms FROM f GROUP BY p_partkey""")
def u2(t):
    merged = cfg.merged_terms(F.split("p_name", " "), F.split(F.lower(F.concat_ws(" ", "p_type", "p_name")), " "))
    return t.part.select("p_partkey", F.array_join(merged, ",").alias("terms"))


# Set operations


@query("U1_union", """SELECT 'orders' AS kind, o_custkey AS id, o_orderstatus AS state FROM orders UNION ALL SELECT 'customers', c_custkey, NULL FROM customer""")
def u1(t):
    a = t.orders.select(F.lit("orders").alias("kind"), F.col("o_custkey").alias("id"), F.col("o_orderstatus").alias("state"))
    return a.unionByName(t.customer.select(F.lit("customers").alias("kind"), F.col("c_custkey").alias("id")), allowMissingColumns=True)


@query("U3_except", "SELECT doc_id AS id FROM documents EXCEPT SELECT doc_id FROM labels")
def u3(t):
    return t.documents.select(F.col("doc_id").alias("id")).join(t.labels.select(F.col("doc_id").alias("id")), "id", "left_anti").distinct()


@query("U4_intersect", "SELECT sha256(text) AS sha256 FROM documents INTERSECT SELECT sha256(text) FROM conversations UNION SELECT sha256(text) FROM documents GROUP BY text HAVING count(*) > 1")
def u4(t):
    d = t.documents.select(F.sha2("text", 256).alias("sha256"))
    c = t.conversations.select(F.sha2("text", 256).alias("sha256"))
    copies = d.groupBy("sha256").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("sha256")
    return d.intersect(c).union(copies).distinct()


@query("U5_set_equality", """SELECT conv_id, list_sort(list(turn)) = range(count(*)::BIGINT) AS whole FROM conversations GROUP BY conv_id""")
def u5(t):
    n = F.count(F.lit(1))
    whole = (F.min("turn") == 0) & (F.max("turn") == n - 1) & (F.count_distinct("turn") == n)
    return t.conversations.groupBy("conv_id").agg(whole.alias("whole"))
