"""Tables changed exactly once per micro-batch, and what is kept in them."""

import os
import random
import tempfile

import pytest
from pyspark.sql import functions as F

from scribelake.streaming import ledger, progress


def book_of(spark, every=50, merge=None, schema="k long, n long"):
    merge = merge or (lambda rows: rows.groupBy("k").agg(F.sum("n").alias("n")))
    return ledger.BatchLedger(spark, tempfile.mkdtemp(prefix="spark-", dir="/tmp") + "/book", schema, merge, every)


def test_batches_count_once(spark):
    book = book_of(spark, every=3)
    assert book.table().collect() == []
    rows = lambda *r: spark.createDataFrame(r, "k long, n long")
    same = lambda df: df
    for i in range(8):
        assert book.apply(rows((1, 1), (i, 10)), i, same)
        assert not book.apply(rows((1, 1), (i, 10)), i, same)
    # Batches that are in a base by now are in as well.
    assert not any(book.apply(rows((1, 1)), i, same) for i in range(8))
    assert len(book._committed("base")) >= 2 and len(book._state()[1]) < 3
    assert {r["k"]: r["n"] for r in book.table().collect()} == {1: 18} | {i: 10 for i in range(8) if i != 1}


def test_cut_off_attempt_is_replaced(spark):
    book = book_of(spark)
    rows = spark.createDataFrame([(1, 5)], "k long, n long")

    def fails(df):
        return df.withColumn("n", F.raise_error(F.lit("lost")).cast("long"))

    with pytest.raises(Exception, match="lost"):
        book.apply(rows, 0, fails)
    assert not book.seen(0) and book.table().collect() == []
    # Files without the mark of a commit do not count.
    rows.write.parquet(f"{book.folder}/left")
    jvm = spark._jvm
    top = jvm.org.apache.hadoop.fs.Path(book.folder)
    fs = top.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    rows.write.option("mapreduce.fileoutputcommitter.marksuccessfuljobs", "false").mode("overwrite").parquet(f"{book.folder}/batch-0")
    assert not fs.exists(jvm.org.apache.hadoop.fs.Path(top, "batch-0/_SUCCESS")) and not book.seen(0)
    assert book.apply(rows, 0, lambda df: df)
    assert [tuple(r) for r in book.table().collect()] == [(1, 5)]


def test_invalidations_in_any_order(spark):
    r = random.Random(8)
    seen = [(r.randrange(12), at, r.choice([None, 1, 1, 1, 2]), r.choice([None, False, False, True])) for at in range(200)]
    held = [(100 + p, p, 1) for p in range(10)] + [(200, 3, 2), (201, 4, None), (202, 99, 1)]
    want = {}
    for result, path, version in held:
        for p, at, v, touched in seen:
            why = "missing" if v is None else "touched" if touched else "changed" if v != version else None
            if p == path and why:
                old = want.get(result, (at, why, 0))
                want[result] = (*min(old[:2], (at, why)), old[2] + 1)
    results = spark.createDataFrame(held, "result_id long, path long, version long")
    book = book_of(spark, 4, ledger.merged_invalidations, ledger.INVALIDATED)
    r.shuffle(seen)
    for i in range(0, 200, 35):
        part = spark.createDataFrame(seen[i : i + 35], "path long, at_ms long, version long, touched boolean")
        for _ in range(2):
            book.apply(part, i // 35, lambda rows: ledger.invalidations(rows, results))
    assert {x["result_id"]: (x["first"]["at_ms"], x["first"]["why"], x["hits"]) for x in book.table().collect()} == want
    assert 202 not in want


EVENTS = "arrival long, batch_id string, seq long, type string, job_id string, attempt_id string, index int, state string, stage string, percent int, elapsed double"


def test_live_counts_after_every_micro_batch(spark):
    """After each micro-batch the ledger equals the stored form over all that has arrived, also when batches come again."""
    r = random.Random(3)
    rows, n = [], 0
    for _ in range(240):
        n += 1
        job, batch = r.randrange(6), r.choice("ab")
        state, stage = r.choice([("waiting", "queued")] * 3 + [("processing", "transcribing")] * 4 + [("completed", "finished"), ("failed", "finished"), ("processing", "preparing")])
        kind = "cancelled" if n == 170 else r.choice(["file", "file", "file", "drained"])
        rows.append((n, batch, n - r.choice([0, 0, 0, 4]), kind, f"{batch}{job}", r.choice(["x", "x", "x", "y"]), job, state, stage, 5, 1.0))
    base = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    os.mkdir(f"{base}/in")
    stream = spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", 1).parquet(f"{base}/in")
    book = book_of(spark, 3, progress.summed_changes, progress.CHANGES)
    for i in range(0, 240, 60):
        spark.createDataFrame(rows[i : i + 60], EVENTS).coalesce(1).write.mode("append").parquet(f"{base}/in")
        q = book.start(progress.rollup_changes(stream), lambda rows: rows, f"{base}/cp", availableNow=True)
        q.awaitTermination(240)
        so_far = progress.judged(spark.createDataFrame(rows[: i + 60], EVENTS)).where("verdict = 'accepted'")
        want = progress.rollup(progress.settled(so_far))
        got = book.table().select(want.columns)
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    book.start(progress.rollup_changes(stream), lambda rows: rows, f"{base}/again", availableNow=True).awaitTermination(240)
    assert sorted(map(tuple, book.table().select(want.columns).collect())) == sorted(map(tuple, want.collect()))
