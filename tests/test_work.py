import pytest
from pyspark.sql import functions as F

from scribelake.operators import config as cfg
from scribelake.operators import identity as idn
from scribelake.operators import library as lib
from scribelake.operators import purge
from scribelake.operators import results as res
from scribelake.operators import telemetry as tel


def test_older_success_wins_over_newer_failure(spark):
    requests = spark.createDataFrame([("q", "m", None, "t1", "f1")], "request_id string, model string, media string, transform_identity string, fingerprint string")
    runs = spark.createDataFrame(
        [("r1", "m", None, "t1", "f0", "completed", "2024-01-01", True), ("r2", "m", None, "t1", "f1", "failed", "2024-01-03", True), ("r3", "m", "x", "t1", "f1", "completed", "2024-01-04", True), ("r4", "m", None, "t0", "f9", "completed", "2024-01-05", True)],
        "run_id string, model string, media string, transform_identity string, fingerprint string, state string, completed_at string, usable boolean",
    )
    got = idn.reusable_run(requests, runs, ["model", "media"]).first()
    assert (got["reused_run"], got["exact_fingerprint"]) == ("r1", False)
    pairs = spark.createDataFrame([("t1", "t0")], "wanted string, saved string")
    assert idn.reusable_run(requests, runs, ["model", "media"], pairs).first()["reused_run"] == "r4"


def test_same_bytes_twice(spark):
    jobs = spark.createDataFrame([("k", 1), ("j", 2), ("k", 3)], "key string, position int")
    got = {r["position"]: r["duplicate_of"] for r in lib.first_of_key(jobs, "key", "position").collect()}
    assert got == {1: None, 2: None, 3: 1}


def test_empty_hash_set_is_not_verified(spark):
    manifest = spark.createDataFrame([("a", {"x": "1"}), ("b", {}), ("c", {"../x": "1"}), ("d", {"x": "2", "y": "1"})], "run_id string, hashes map<string,string>")
    seen = spark.createDataFrame([("a", "x", "1"), ("c", "../x", "1"), ("d", "x", "2")], "run_id string, path string, sha256 string")
    assert {r["run_id"]: r["verified"] for r in idn.artifact_checks(manifest, idn.hashed_artifacts(manifest), seen).collect()} == {"a": True, "b": False, "c": False, "d": False}


def test_import_overlap(spark):
    a = spark.createDataFrame([("same", 0, "x"), ("same", 1, "y"), ("turned", 0, "y"), ("turned", 1, "x"), ("new", 0, "z")], "selection_id string, pos int, sha256 string")
    b = spark.createDataFrame([("s1", 0, "x"), ("s1", 1, "y")], "session_id string, pos int, sha256 string")
    assert {r["selection_id"]: r["decision"] for r in idn.import_overlap(a, b).collect()} == {"same": "reuse", "turned": "conflict", "new": "new"}


def test_purging_one_alias_keeps_the_shared_session(spark):
    records = spark.createDataFrame([("r1", "a"), ("r2", "b")], "result_id string, scope string")
    jobs = spark.createDataFrame([("j1", "a", "active")], "job_id string, scope string, state string")
    scopes = purge.selected_scopes(records, jobs, records.where("result_id = 'r1'").select("result_id"), jobs.select("job_id").limit(0))
    closure = {(r["kind"], r["id"], r["active"]) for r in purge.closure(records, jobs, scopes).collect()}
    assert closure == {("result", "r1", False), ("job", "j1", True)}
    consumers = spark.createDataFrame([("s", "src", "a", True), ("s", "src", "b", True)], "session_id string, source_id string, scope string, visible boolean")
    retained = purge.retained_refs(consumers, scopes)
    sources = spark.createDataFrame([("s", "src")], "session_id string, source_id string")
    artifacts = spark.createDataFrame([("s", "audio.wav")], "session_id string, path string")
    assert purge.plan(sources, artifacts, sources, retained).first()["decision"] == "used_elsewhere"
    assert purge.plan(sources, artifacts, sources, retained.limit(0)).first()["decision"] == "remove"


def test_commit_needs_token_and_happens_once(spark):
    results = spark.createDataFrame([("a",), ("b",)], "result_id string")
    targets = spark.createDataFrame([("a", "t", "op")], "result_id string, plan_token string, operation_id string")
    none = targets.select("operation_id").limit(0)
    left = lambda token, ops: sorted(r["result_id"] for r in purge.committed(results, targets, F.lit(token), ops).collect())
    assert left("t", none) == ["b"] and left("old", none) == ["a", "b"] and left("t", targets.select("operation_id")) == ["a", "b"]


def test_inode_bytes_count_once(spark):
    t = spark.createDataFrame([(1, 5, 10, 16), (1, 5, 10, 16), (1, 6, 1, 16)], "device int, inode int, size int, allocated int")
    assert tuple(purge.totals(t).first()) == (3, 11, 32)


def test_process_tree_and_cycle(spark):
    rows = [(1, 1, 0), (1, 2, 1), (1, 3, 2), (1, 9, 0), (1, 10, 9), (2, 1, 3), (2, 3, 1)]
    df = spark.createDataFrame(rows, "sample int, pid int, ppid int")
    got = sorted((r["sample"], r["pid"]) for r in tel.descendants(df, F.lit(1)).collect())
    assert got == [(1, 1), (1, 2), (1, 3), (2, 1), (2, 3)]


def _events(spark, rows):
    schema = "batch_id string, sequence long, elapsed_seconds double, kind string, stage string, name string, outcome string, job_id string, attempt_id string"
    return spark.createDataFrame([("b", i, *r) for i, r in enumerate(rows, 1)], schema)


def test_stage_seconds_are_not_wall_time(spark):
    ev = _events(spark, [
        (0.0, "stage_start", "d", None, None, "a", None), (1.0, "stage_start", "d", None, None, "b", None), (5.0, "stage_end", "d", None, "completed", "b", None),
        (6.0, "stage_end", "d", None, "completed", "a", None), (8.0, "milestone", None, "first_readable_report", None, None, None), (9.0, "milestone", None, "batch_complete", None, None, None),
    ])
    assert tel.stage_totals(tel.paired_spans(ev, width=2)).first()["worker_seconds"] == 10
    audio = spark.createDataFrame([("b", 90.0, 59.0)], "batch_id string, audio_seconds double, observed_seconds double")
    got = tel.throughput(ev, audio).first()
    assert (got["batch_wall_seconds"], got["observation_wall_seconds"], got["audio_per_wall_second"]) == (9, 59, 10)
    open_batch = tel.throughput(ev.where("name IS NULL OR name <> 'batch_complete'"), audio).first()
    assert open_batch["audio_per_wall_second"] is None and open_batch["batch_wall_seconds"] == 59


def test_failed_span_keeps_only_its_outcome(spark):
    ev = _events(spark, [(0.0, "stage_start", "d", None, None, "a", None), (2.0, "stage_end", "d", None, "interrupted_or_failed", "a", None)])
    assert tel.paired_spans(ev).first()["outcome"] == "interrupted_or_failed"


def test_queue_rules(spark):
    paths = spark.createDataFrame([(0, "/a"), (1, "/b"), (2, "/c"), (3, "/d")], "position int, path string")
    saved = spark.createDataFrame([(0, "/a", "processing", "m", "j"), (1, "/b", "odd", "m", "j"), (2, "/x", "failed", "m", "k"), (3, "/d", "failed", "m", "l")], "position int, path string, state string, message string, job_id string")
    got = {r["position"]: (r["state"], r["message"], r["kept_job_id"]) for r in res.restore_queue(paths, saved).collect()}
    assert got == {0: ("waiting", "interrupted", "j"), 1: ("waiting", None, None), 2: ("waiting", None, None), 3: ("failed", "m", "l")}


def test_permutation_only(spark):
    rows = spark.createDataFrame([("l", i, f"p{i}") for i in (1, 2, 3)], "list_id string, row_no int, path string")
    answer = lambda order: res.permute(rows, spark.createDataFrame([("l", s, n) for s, n in enumerate(order, 1)], "list_id string, slot int, row_no int"))
    assert [r["path"] for r in answer([3, 1, 2]).orderBy("slot").collect()] == ["p3", "p1", "p2"]
    assert answer([1, 1, 2]).count() == 0 and answer([1, 2]).count() == 0 and answer([1, 2, 4]).count() == 0


def test_layers_and_recipes(spark):
    layers = spark.createDataFrame([("q", "threads", "4", 0, "application_defaults"), ("q", "threads", "8", 3, "explicit_override"), ("q", "threads", "6", 1, "speaker:x")], "request_id string, field string, value string, precedence int, origin string")
    got = cfg.resolved(layers).first()
    assert (got["value"], got["origin"]) == ("8", "explicit_override")
    bad = spark.createDataFrame([("a", "beam_size", "0"), ("b", "beam_size", "5"), ("c", "vad", "true"), ("d", "peak_dbfs", "-30"), ("e", "peak_dbfs", "nan"), ("f", "unknown", "1"), ("g", "threads", "1.5")], "request_id string, field string, value string")
    assert sorted(r["request_id"] for r in cfg.broken_policies(bad).collect()) == ["a", "c", "e", "f", "g"]


@pytest.mark.parametrize("integrity, shown", [("intact", True), ("modified", False)])
def test_reading_body(spark, integrity, shown):
    text = "# Transcript Report\nSelected files: 1\nTimestamps restart at zero for each source. x\nAll stored ASR text is retained.\n\n## 1. a\nbody\n# x"
    got = spark.range(1).select(res.reading_body(F.lit(text), F.lit(integrity)).alias("b")).first()["b"]
    assert got == ("## 1. a\nbody\n# x" if shown else None)
    assert spark.range(1).select(res.reading_body(F.lit("# Other\n## 1"), F.lit("intact")).alias("b")).first()["b"] is None
