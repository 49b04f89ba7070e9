"""A key with a third of all rows does not gather in one task, and no key's facts are copied without need."""

import re

from pyspark.sql import functions as F

from scribelake.operators import library
from scribelake.operators.joins import with_key_facts

#: A join of shuffled sides whose crowded partitions are split at test size.
SMALL = {
    "spark.sql.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
    "spark.sql.shuffle.partitions": "40",
    "spark.sql.adaptive.coalescePartitions.enabled": "false",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "16k",
    "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "16k",
    "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.5",
}


def configured(spark, settings):
    before = {k: spark.conf.get(k, None) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    return before


def restore(spark, before):
    for k, v in before.items():
        spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def hot(spark):
    ids = spark.range(0, 60_000, 1, 24)
    return ids.select(F.col("id").alias("pos"), F.when(F.col("id") % 3 == 0, "hot").otherwise(F.col("id").cast("string")).alias("key"))


def test_hot_key_is_split(spark):
    before = configured(spark, SMALL)
    try:
        out = library.first_of_key(hot(spark), "key", "pos")
        per_task = out.select("*", F.spark_partition_id().alias("task")).groupBy("task").count().collect()
        assert sum(r["count"] for r in per_task) == 60_000
        assert max(r["count"] for r in per_task) < 0.1 * 60_000
        assert out.where("duplicate_of = 0").count() == 19_999 and out.where("duplicate_of IS NULL").count() == 40_001
    finally:
        restore(spark, before)


def test_facts_are_never_multiplied(spark):
    """The build side of a broadcast is as large as Spark thinks, and a shuffled side holds one row per key."""
    out = library.first_of_key(hot(spark), "key", "pos")
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Generate" not in plan
    before = configured(spark, SMALL)
    try:
        plan = library.first_of_key(hot(spark), "key", "pos")._jdf.queryExecution().executedPlan().toString()
        # Rows, the aggregate, and the aggregate once more by the join's own keys.
        assert "Generate" not in plan and len(re.findall(r"Exchange hashpartitioning\(key", plan)) == 3
    finally:
        restore(spark, before)


def test_keys_without_facts(spark):
    rows = spark.createDataFrame([("a", 1), ("b", 2), (None, 3)], "key string, n int")
    facts = spark.createDataFrame([("a", 10)], "key string, fact int")
    assert sorted((r["n"], r["fact"]) for r in with_key_facts(rows, facts, "key").collect()) == [(1, 10), (2, None), (3, None)]
    assert [r["n"] for r in with_key_facts(rows, facts, "key", "inner").collect()] == [1]
    bare = rows.select("key")
    assert with_key_facts(bare, facts, "key").count() == 3


def test_keys_of_one_row_do_not_move(spark):
    """Only keys that come again are facts; the key of an entry is its digest in bytes, batches and absent digests kept apart."""
    from scribelake.plans import standins

    plan = library.first_of_key(hot(spark), "key", "pos")._jdf.queryExecution().optimizedPlan().toString()
    assert re.search(r"Filter .*__n#\d+L? > 1", plan)
    a, b = "ab" * 32, "cd" * 32
    rows = [("b-1", 1, a), ("b-1", 2, a), ("b-1", 3, b), ("b-2", 4, a), ("b-2", 5, None), ("b-2", 6, None), ("b-1", 7, None), ("b-2", 4, a)]
    keyed = spark.createDataFrame(rows, "batch_id string, position int, sha256 string").withColumn("key", standins.copy_key())
    assert keyed.agg(F.max(F.octet_length("key"))).first()[0] == 35
    got = {(r["position"], r["duplicate_of"]) for r in library.first_of_key(keyed, "key", "position").collect()}
    assert got == {(1, None), (2, 1), (3, None), (4, None), (5, None), (6, 5), (7, None)}


def test_rows_stay_where_keys_seldom_come_again(spark, monkeypatch):
    """beyond the size of a broadcast, rows are not shuffled to their keys if few keys come again; the result is the same if many do."""
    ids = spark.range(0, 200_000, 1, 8)
    seldom = ids.select(
        F.col("id").alias("pos"), F.when(F.col("id") % 50_000 == 7, "again").when(F.col("id") % 1_000 != 1, F.sha2(F.col("id").cast("string"), 256)).alias("key")
    )
    before = configured(spark, {"spark.sql.autoBroadcastJoinThreshold": "64k", "spark.sql.adaptive.autoBroadcastJoinThreshold": "64k"})
    try:
        out = library.first_of_key(seldom, "key", "pos", seldom=True)
        got = {r["pos"]: r["duplicate_of"] for r in out.where("duplicate_of IS NOT NULL").collect()}
        assert got == {50_007: 7, 100_007: 7, 150_007: 7} and out.count() == 200_000
        plan = out._jdf.queryExecution().executedPlan().toString()
        # The groups of keys that come again; neither the rows nor the facts by the join's own keys.
        assert "BroadcastHashJoin" in plan and len(re.findall(r"Exchange hashpartitioning\(key", plan)) == 1
        # Nobody asks for duplicates: the join goes.
        assert "Join" not in out.groupBy().agg(F.max("pos"))._jdf.queryExecution().optimizedPlan().toString()
        monkeypatch.setattr(library, "AGAIN", 0)
        many = library.first_of_key(seldom, "key", "pos", seldom=True)
        assert library.coming_again(seldom, "key") is None
        assert {r["pos"]: r["duplicate_of"] for r in many.where("duplicate_of IS NOT NULL").collect()} == got and many.count() == 200_000
    finally:
        restore(spark, before)


def test_a_short_hash_of_two_keys_keeps_both(spark, monkeypatch):
    """Keys that share their hash are suspects only: the keys themselves decide."""
    rows = spark.createDataFrame([("a", 1), ("b", 2), ("a", 3), ("c", 4), (None, 5), (None, 6)], "key string, pos int")
    monkeypatch.setattr(library.F, "xxhash64", lambda *c: F.lit(1).cast("long"))
    assert library.coming_again(rows, "key").count() == 4
    got = {r["pos"]: r["duplicate_of"] for r in library.first_of_key(rows, "key", "pos", seldom=True).collect()}
    assert got == {1: None, 2: None, 3: 1, 4: None, 5: None, 6: None}


def test_a_report_shuffles_its_entries_once(spark):
    """the lines that are spoken and the entries without any are found from one shuffle; entries without a place keep their lines."""
    from scribelake.operators import exports

    rows = [("b-1", 1, "completed"), ("b-1", 2, "review_required"), ("b-1", 3, "failed"), (None, 4, "completed"), ("b-2", None, "completed")]
    entries = spark.createDataFrame(rows, "batch_id string, position long, state string").select(
        "*", F.lit("x.wav").alias("filename"), F.lit(60.0).alias("duration_seconds"), F.lit(None).cast("long").alias("duplicate_of"), F.lit(None).cast("string").alias("recorded_at"),
        F.lit("unknown").alias("provenance"), F.lit(None).cast("string").alias("timezone"), F.lit("lost").alias("failure_message"),
    )
    said = [("b-1", 1, 1, "one"), ("b-1", 1, 2, "two"), ("b-1", 3, 1, "never"), ("b-9", 1, 1, "nobody"), (None, 4, 1, "null")]
    segments = spark.createDataFrame(said, "batch_id string, position long, idx int, text string").select("*", F.lit(0.0).alias("start_seconds"), F.lit(1.0).alias("end_seconds"))
    before = configured(spark, SMALL)
    try:
        out = exports.report_lines(entries, segments)
        lines = out.where("seq >= 100").collect()
        texts = sorted((str(r["batch_id"]), str(r["position"]), r["line"].split("] ")[-1]) for r in lines)
        note = exports.EMPTY_NOTE
        assert texts == [("None", "4", note), ("b-1", "1", "one"), ("b-1", "1", "two"), ("b-1", "2", note), ("b-2", "None", note)]
        spark.conf.set("spark.sql.adaptive.enabled", "false")
        plan = exports.report_lines(entries, segments)._jdf.queryExecution().executedPlan().toString()
        assert len(re.findall(r"ReusedExchange", plan)) == 1
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
        restore(spark, before)
