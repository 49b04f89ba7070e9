"""The stream forms over the shared event table, drained to a table and compared like any query."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scribelake.operators import results as res
from scribelake.plans import standins as st
from scribelake.plans.catalog import query
from scribelake.plans.q_change import OBS_SQL, _known_results, _observations
from scribelake.plans.q_measure import JUDGED_SQL, SPANS_SQL
from scribelake.session import shared_folder
from scribelake.streaming import folder, ledger, progress, spans

_STATE_STORE = "spark.sql.streaming.stateStore.providerClass"
_ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class _Streamed:
    """The same tables, arriving as streams."""

    def __init__(self, t):
        self.t = t

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        schema = self.t.spark.read.parquet(f"{self.t.folder}/{name}.parquet").schema
        return self.t.spark.readStream.schema(schema).option("pathGlobFilter", f"{name}.parquet").parquet(self.t.folder)


def drained(t, stream: DataFrame) -> DataFrame:
    """Run a stream over everything there is now and read what it wrote."""
    spark = t.spark
    base = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    before = spark.conf.get(_STATE_STORE)
    spark.conf.set(_STATE_STORE, _ROCKSDB)
    try:
        run = (
            stream.writeStream.format("parquet").outputMode("append").option("path", f"{base}/out")
            .option("checkpointLocation", f"{base}/state").trigger(availableNow=True).start()
        )
        run.awaitTermination()
    finally:
        spark.conf.set(_STATE_STORE, before)
    return spark.read.schema(stream.schema).parquet(f"{base}/out")


def entered(t, stream: DataFrame, step: ledger.Rows, schema: str, merge: ledger.Rows) -> DataFrame:
    """Run a stream into a ledger, hand all its batches over a second time, and read what the ledger says."""
    spark = t.spark
    base = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    book = ledger.BatchLedger(spark, f"{base}/book", schema, merge)
    before = spark.conf.get(_STATE_STORE)
    spark.conf.set(_STATE_STORE, _ROCKSDB)
    try:
        for turn in ("first", "again"):
            book.start(stream, step, f"{base}/{turn}", availableNow=True).awaitTermination()
    finally:
        spark.conf.set(_STATE_STORE, before)
    return book.table()


@query("R9_invalidated_live", """WITH o AS (SELECT o_custkey AS path, o_orderkey AS at_ms, CASE WHEN o_orderkey % 11 = 3 THEN 'missing' WHEN o_orderpriority = '1-URGENT' THEN 'touched'
  WHEN o_orderkey % 3 = 0 AND o_orderkey % 25 <> o_custkey % 25 THEN 'changed' END AS why FROM orders)
SELECT c_custkey AS result_id, path, min(at_ms) AS at_ms, arg_min(why, at_ms) AS why, count(*) AS hits FROM o JOIN customer ON path = c_custkey WHERE why IS NOT NULL GROUP BY ALL""")
def r9_live(t):
    """Every micro-batch arrives twice; results are told once, with the first look that contradicts them."""
    seen = _Streamed(t).orders.select(
        F.col("o_custkey").alias("path"), F.col("o_orderkey").alias("at_ms"), (F.col("o_orderpriority") == "1-URGENT").alias("touched"),
        F.when(F.col("o_orderkey") % 11 == 3, None).when(F.col("o_orderkey") % 3 == 0, F.col("o_orderkey") % 25).otherwise(F.col("o_custkey") % 25).alias("version"),
    )
    held = t.customer.select(F.col("c_custkey").alias("result_id"), F.col("c_custkey").alias("path"), (F.col("c_custkey") % 25).alias("version"))
    out = entered(t, seen, lambda rows: ledger.invalidations(rows, held), ledger.INVALIDATED, ledger.merged_invalidations)
    return out.select("result_id", "path", "first.at_ms", "first.why", "hits")


@query("R10_rollup_live", f"""WITH {JUDGED_SQL} SELECT batch_id, count(*) AS jobs, count(*) FILTER (state = 'completed') AS completed, 0::BIGINT AS review_required, 0::BIGINT AS failed, 0::BIGINT AS cancelled,
 count(*) FILTER (state = 'completed') AS finished, count(*) FILTER (state <> 'completed' AND stage = 'transcribing') AS decoding FROM settled GROUP BY batch_id""")
def r10_live(t):
    """Counts kept up by the changes of each micro-batch: the same as those of the stored events."""
    return entered(t, progress.rollup_changes(st.progress(_Streamed(t))), lambda rows: rows, progress.CHANGES, progress.summed_changes)


@query("R6_span_stream", f"WITH {SPANS_SQL} SELECT batch_id, job_id, attempt_id, stage, started_at, ended_at, outcome, worker_seconds FROM spans")
def r6_stream(t):
    return drained(t, spans.span_stream(st.telemetry(_Streamed(t))))


@query("R1_folder_stream", f"""WITH {OBS_SQL}, s AS (SELECT *, coalesce(at_ms > hashed_at AND NOT forced, false) AS cand, age > 0 AND age >= 750 AS settled, user_id % 5 = 0 AS done FROM hashed)
SELECT path, at_ms, CASE WHEN age = 0 THEN 'copying' WHEN cand THEN CASE WHEN done THEN 'processed_candidate' ELSE 'ready' END WHEN NOT settled THEN 'copying'
  WHEN NOT wav_ok THEN CASE WHEN age >= 5000 THEN 'failed' ELSE 'copying' END WHEN done THEN 'processed' ELSE 'ready' END AS state,
 CASE WHEN NOT cand AND settled AND wav_ok THEN sha256 END AS source_sha256 FROM s""")
def r1_stream(t):
    seen = _observations(_Streamed(t)).drop("user_id").withColumns(
        {"kind": F.lit("observe"), "version_key": F.lit(None).cast("string")}
    )
    return drained(t, folder.folder_stream(seen, _known_results(t))).drop("version_key")


@query("R3_progress_stream", f"WITH {JUDGED_SQL} SELECT batch_id, job_id, seq, verdict FROM judged")
def r3_stream(t):
    """Verdicts of the live form: the same as those of the stored form."""
    return drained(t, progress.progress_stream(st.progress(_Streamed(t)))).select("batch_id", "job_id", "seq", "verdict")


@query("R7_retry_timers", """WITH o AS (SELECT '/watch/' || c_custkey || '.wav' AS path, 1000 + c_custkey * 10 AS seen, c_mktsegment <> 'BUILDING' AS ok FROM customer),
 w AS (SELECT max(seen) AS until FROM o), looks AS (SELECT path, seen + 1200 * k AS at_ms, k, ok FROM o, range(0, 6) AS r(k) WHERE k = 0 OR k <= CASE WHEN ok THEN 1 ELSE 5 END)
SELECT path, at_ms, CASE WHEN k = 0 THEN 'event' ELSE 'timer' END AS origin, CASE WHEN k = 0 THEN 'copying' WHEN ok THEN 'ready' WHEN k = 5 THEN 'failed' ELSE 'copying' END AS state,
 (CASE WHEN k = 0 OR (NOT ok AND k < 5) THEN k + 1 ELSE 0 END)::INTEGER AS attempt FROM looks, w WHERE at_ms <= until""", bigint="at_ms")
def r7_timers(t):
    """One event per file; every other row comes from a timer, up to where the stream's time has got."""
    version = F.lit("1")
    seen = _Streamed(t).customer.select(
        F.concat(F.lit("/watch/"), F.col("c_custkey").cast("string"), F.lit(".wav")).alias("path"), (1000 + F.col("c_custkey") * 10).alias("at_ms"),
        F.lit("observe").alias("kind"), version.alias("stat"), F.sha2(F.col("c_custkey").cast("string"), 256).alias("sha256"),
        (F.col("c_mktsegment") != "BUILDING").alias("wav_ok"), F.lit(False).alias("forced"), F.lit(None).cast("string").alias("version_key"),
    )
    none = _known_results(t).where("false")
    return drained(t, folder.watch_stream(seen, none)).select("path", "at_ms", "origin", "state", "attempt")


@query("R1_folder_live")
def r1_live(t):
    """The watched folder with everything that may happen to a file: looks by timers, versions ignored and added again, files away or gone."""
    events = _Streamed(t).events
    version = F.call_function("div", "event_id", F.lit(2000)).cast("string")
    path = F.concat(F.lit("/watch/"), F.col("user_id").cast("string"), F.lit(".wav"))
    sha = F.sha2(F.concat_ws(":", F.col("user_id").cast("string"), version), 256)
    turn = F.col("event_id") % 13
    kind = F.when(turn == 3, "ignore").when(turn == 7, "readd").when(turn == 11, "unavailable").when(F.col("event_id") % 97 == 5, "missing").otherwise("observe")
    seen = events.select(
        path.alias("path"), (1000 + F.col("event_id") * 40).alias("at_ms"), kind.alias("kind"), version.alias("stat"), sha.alias("sha256"),
        (F.col("event_type") != "error").alias("wav_ok"), (F.col("event_type") == "signup").alias("forced"), res.sha_of(path, sha).alias("version_key"),
    )
    return drained(t, folder.watch_stream(seen, _known_results(t)))
