import tempfile
import tracemalloc

import pandas as pd
import pytest
from pyspark.sql import functions as F

from scribelake.operators import telemetry as tel
from scribelake.streaming import folder, progress, spans


def run_stream(spark, df, transform, *, order):
    """All rows through a stream in several micro-batches, in order."""
    base = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    rows = df.orderBy(order).collect()
    parts = [rows[i : i + max(1, len(rows) // 3)] for i in range(0, len(rows), max(1, len(rows) // 3))]
    for part in parts:
        spark.createDataFrame(part, df.schema).coalesce(1).write.mode("append").parquet(f"{base}/in")
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(f"{base}/in")
    q = (
        transform(stream).writeStream.format("parquet").outputMode("append").option("path", f"{base}/out")
        .option("checkpointLocation", f"{base}/cp").trigger(availableNow=True).start()
    )
    q.awaitTermination(240)
    assert q.exception() is None
    return spark.read.parquet(f"{base}/out")


GOLDEN = [
    ("observe", 0, "v1", "h1"), ("observe", 1000, "v1", "h1"), ("observe", 2000, "v1", "h1"), ("ignore", 2500, None, None),
    ("observe", 3000, "v1", "h1"), ("readd", 3500, None, None), ("observe", 4000, "v1", "h1"), ("observe", 5000, "v2", "h2"), ("observe", 6000, "v2", "h2"),
]


def test_one_path_through_its_life(spark):
    import hashlib

    key = hashlib.sha256(b'["/w/a.wav","h1"]').hexdigest()
    rows = [("/w/a.wav", at, kind, stat, sha, True, False, key if kind != "observe" else None) for kind, at, stat, sha in GOLDEN]
    df = spark.createDataFrame(rows, "path string, at_ms long, kind string, stat string, sha256 string, wav_ok boolean, forced boolean, version_key string")
    none = spark.createDataFrame([], "source_sha256 string, filename string, result_id string")
    out = run_stream(spark, df, lambda s: folder.folder_stream(s, none), order="at_ms")
    got = [(r["state"], r["source_sha256"], r["version_key"]) for r in out.orderBy("at_ms").collect()]
    assert [g[0] for g in got] == ["copying", "ready", "ready", "ignored", "ignored", "ready", "ready", "copying", "ready"]
    assert got[1][1] == "h1" and got[2][1] is None and got[1][2] == key
    assert got[6][1] == "h1" and got[8][1] == "h2" and got[8][2] != key


def test_folder_stream_equals_batch(spark):
    rows = [
        (f"/w/{p}.wav", at, str((at + p * 700) // 6000), f"h{p}-{(at + p * 700) // 6000}", p != 4 and (at // 100 + p) % 4 != 0, (at // 100 + p) % 11 == 0)
        for p in range(6) for at in range(p, 15000, 300 + 150 * p)
    ]
    df = spark.createDataFrame(rows, "path string, at_ms long, stat string, sha256 string, wav_ok boolean, forced boolean")
    results = spark.createDataFrame([("h1-1", "1.wav", "r"), ("h2-0", "2.wav", "r")], "source_sha256 string, filename string, result_id string")
    ignored = spark.createDataFrame([], "version_key string")
    for width in (1000, 10**9):
        batch = {(r["path"], r["at_ms"]): (r["state"], r["source_sha256"]) for r in folder.classified(df, results, ignored, width=width).collect()}
        assert len(batch) == len(rows)
    live = df.withColumns({"kind": F.lit("observe"), "version_key": F.lit(None).cast("string")})
    out = run_stream(spark, live, lambda s: folder.folder_stream(s, results), order="at_ms")
    assert {(r["path"], r["at_ms"]): (r["state"], r["source_sha256"]) for r in out.collect()} == batch
    assert {"failed", "processed", "processed_candidate", "ready", "copying"} == {s for s, _ in batch.values()}


PROGRESS = "arrival long, batch_id string, seq long, type string, job_id string, attempt_id string, index int, state string, stage string, percent int, elapsed double"


def test_progress_stream_equals_batch(spark):
    rows, n = [], 0

    def say(job, state, stage, percent=None, attempt="a", kind="file", seq=None):
        nonlocal n
        n += 1
        rows.append((n, "b", n if seq is None else seq, kind, f"j{job}", attempt, job, state, stage, percent, float(n)))

    for job in range(3):
        say(job, "processing", "preparing")
        say(job, "waiting", "queued")
        say(job, "processing", "preparing")
        say(job, "processing", "transcribing", 10, kind="progress")
        say(job, "processing", "transcribing", 5, kind="progress")
        say(job, "processing", "transcribing", 60, kind="progress", seq=1)
        say(job, "processing", "transcribing", 50, attempt="other", kind="progress")
        say(job, "processing", "validating")
        if job != 2:
            say(job, "completed", "finished")
            say(job, "processing", "transcribing", 99, kind="progress")
        say(job, "odd", "x")
    df = spark.createDataFrame(rows, PROGRESS)
    judged = progress.judged(df, width=4)
    verdicts = {r["arrival"]: r["verdict"] for r in judged.collect()}
    out = run_stream(spark, df, progress.progress_stream, order="arrival")
    live = sorted((r["job_id"], r["seq"], r["verdict"]) for r in out.collect())
    assert live == sorted((r[4], r[2], verdicts[r[0]]) for r in rows)
    assert set(verdicts.values()) == {"accepted", "unbound", "stale", "other_attempt", "job_ended", "invalid"}
    states = progress.settled(judged.where("verdict = 'accepted'"))
    got = {r["job_id"]: (r["state"], r["stage"], r["percent"]) for r in states.collect()}
    assert got == {"j0": ("completed", "finished", None), "j1": ("completed", "finished", None), "j2": ("processing", "validating", None)}
    last = {r["job_id"]: (r["state"], r["stage"], r["percent"]) for r in out.where("verdict = 'accepted'").orderBy("seq").collect()}
    assert last == got
    assert progress.rollup(states).first()["finished"] == 2


class _Value:
    """A state value without a stream."""

    def __init__(self):
        self.held = None

    def exists(self):
        return self.held is not None

    def get(self):
        return self.held

    def update(self, value):
        self.held = value


class _Map(dict):
    getValue, containsKey = dict.__getitem__, dict.__contains__

    def updateValue(self, key, value):
        self[key] = value


def _stateful(kind):
    found = kind(None)
    found.head, found.jobs = _Value(), _Map()
    return found


def _told_events(n, size):
    """Numbered events of 50 jobs in chunks, the last event first."""
    for stop in range(n, 0, -size):
        at = range(stop - 1, max(stop - size, 0) - 1, -1)
        yield pd.DataFrame(
            [
                (i, "b", i, "file" if i < 50 or i % 3 else "progress", f"job-{i % 50}", "a", i % 50, "waiting" if i < 50 else "processing",
                 "queued" if i < 50 else ("transcribing" if i % 3 == 0 else "preparing"), i % 100, float(i)) for i in at
            ],
            columns=[c.split(" ")[0] for c in PROGRESS.split(", ")],
        )


def test_progress_events_of_a_batch_are_held_as_numbers():
    def peak(n):
        tracemalloc.start()
        told, largest = 0, 0
        for out in _stateful(progress.ProgressState).handleInputRows(("b",), _told_events(n, 1000), None):
            told, largest = told + (out["verdict"] == "accepted").sum(), max(largest, len(out))
        most = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert told == n and largest <= progress.TOLD_ROWS
        return most

    # Frames of all events and rows of all verdicts took over 500 bytes an event.
    assert (peak(80_000) - peak(30_000)) / 50_000 < 150


def test_rollup_changes_do_not_depend_on_the_size_of_chunks():
    def changes(size):
        return [r for out in _stateful(progress.RollupChanges).handleInputRows(("b",), _told_events(25_000, size), None) for r in out.itertuples(index=False, name=None)]

    assert changes(1000) == changes(25_000) == [("b", 50, 0, 0, 0, 0, 0, 17)]


def test_span_stream_equals_batch(spark):
    rows = [("b", i, i / 2, "stage_start" if (i // 3) % 2 == 0 else "stage_end", f"s{i % 3}", None, "j", "a") for i in range(40)]
    df = spark.createDataFrame(rows, "batch_id string, sequence long, elapsed_seconds double, kind string, stage string, outcome string, job_id string, attempt_id string")
    pick = lambda d: sorted((r["stage"], r["started_at"], r["ended_at"], r["outcome"]) for r in d.collect())
    assert pick(run_stream(spark, df, spans.span_stream, order="sequence")) == pick(tel.paired_spans(df, width=5))


def test_work_is_shared_on_a_stream(spark):
    df = spark.range(20).select(F.timestamp_seconds("id").alias("at"), (F.col("id") % 4).cast("string").alias("key"))
    out = run_stream(spark, df, lambda s: spans.distinct_work(s, at="at", key="key"), order="at")
    assert sorted(r["key"] for r in out.collect()) == ["0", "1", "2", "3"]


@pytest.mark.parametrize("kind", ["documents", "segments"])
def test_documents_are_quarantined(spark, kind):
    import json
    import os

    from scribelake import schemas
    from scribelake.sources import documents as docs
    from scribelake.sources import sinks

    base = tempfile.mkdtemp(prefix="spark-", dir="/tmp")

    def put(name, text):
        os.makedirs(f"{base}/{name}", exist_ok=True)
        with open(f"{base}/{name}/doc.json", "w") as f:
            f.write(text)

    if kind == "documents":
        for name, ident in (("s1", "s1"), ("s2", "other"), (".hidden", "hidden")):
            put(name, json.dumps({"id": ident, "schema_version": 1, "source_order": ["a"]}))
        put("broken", "{")
        read = docs.read_documents(spark, base, schemas.SESSION_DOCUMENT)
        assert [r["id"] for r in docs.named_by_folder(docs.healthy(read), "id").collect()] == ["s1"]
        assert docs.quarantined(read).count() == 1
        return
    item = lambda a, b, t: {"offsets": {"from": a, "to": b}, "text": t}
    put("good", json.dumps({"run_id": "r", "source_id": "s", "transcription": [item(0, 10, "x"), item(10, 20, "y")]}))
    put("float", json.dumps({"run_id": "r", "source_id": "f", "transcription": [item(0.5, 10, "x")]}))
    put("none", json.dumps({"run_id": "r", "source_id": "n"}))
    rows, bad = docs.read_native_segments(spark, base)
    assert [(r["idx"], r["from_ms"], r["text"]) for r in rows.orderBy("idx").collect()] == [(1, 0, "x"), (2, 10, "y")]
    assert bad.count() == 2
    lines = rows.select("source_id", "idx", F.col("text").alias("line"))
    sinks.write_lines(lines, f"{base}/out", ["source_id"], ["idx"])
    assert [r["value"] for r in spark.read.text(f"{base}/out").collect()] == ["x", "y"]
    with pytest.raises(Exception, match="(?i)exist"):
        sinks.write_lines(lines, f"{base}/out", ["source_id"], ["idx"])
