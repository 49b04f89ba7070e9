import random

import pytest
from pyspark.sql import functions as F

from scribelake.operators.ordered import islands, numbered, ordered, split_runs


def _rows(seed):
    rng = random.Random(seed)
    out = []
    for key, n in (("hot", 60), ("cold", 3), ("one", 1)):
        positions = sorted(rng.sample(range(200), n))
        out += [(key, p, rng.choice([None, 1, 2, 3]), rng.randint(0, 1)) for p in positions]
    rng.shuffle(out)
    return out


@pytest.mark.parametrize("width", [3, 7, 1000])
def test_ordered_equals_replay(spark, width):
    rows = _rows(width)
    df = spark.createDataFrame(rows, "k string, pos long, v int, flag int")
    got = ordered(
        df, ["k"], ["pos"], lag={"p": "v"}, lead={"n": "v"}, before={"s": ("sum", "v"), "c": ("count", "v")},
        upto={"m": ("max", "v")}, total={"t": ("sum", "v"), "least": ("min", "pos")}, width=width,
    )
    have = {(r["k"], r["pos"]): r for r in got.collect()}
    assert len(have) == len(rows)
    for key in {r[0] for r in rows}:
        mine = sorted(r for r in rows if r[0] == key)
        for i, (_, pos, v, _) in enumerate(mine):
            r = have[key, pos]
            earlier = [x[2] for x in mine[:i] if x[2] is not None]
            through = [x[2] for x in mine[: i + 1] if x[2] is not None]
            assert r["p"] == (mine[i - 1][2] if i else None)
            assert r["n"] == (mine[i + 1][2] if i + 1 < len(mine) else None)
            assert r["s"] == sum(earlier) and r["c"] == len(earlier)
            assert r["m"] == (max(through) if through else None)
            assert r["t"] == sum(x[2] for x in mine if x[2] is not None)
            assert r["least"] == mine[0][1]


@pytest.mark.parametrize("width", [2, 5, 1000])
def test_split_runs_equals_replay(spark, width):
    rows = _rows(width + 50)
    df = spark.createDataFrame(rows, "k string, pos long, v int, flag int")
    got = split_runs(
        df, ["k"], ["pos"], lag={"before": "flag"}, uses=["flag"], starts=F.col("flag") != F.col("before"),
        name="run", width=width,
    )
    have = {(r["k"], r["pos"]): (r["before"], r["run"]) for r in got.collect()}
    for key in {r[0] for r in rows}:
        run, previous = 0, None
        for _, pos, _, flag in sorted(r for r in rows if r[0] == key):
            run += previous is None or flag != previous
            assert have[key, pos] == (previous, run)
            previous = flag


def test_numbered_and_islands(spark):
    rows = _rows(9)
    df = spark.createDataFrame(rows, "k string, pos long, v int, flag int")
    n = {(r["k"], r["pos"]): r["n"] for r in numbered(df, ["k"], ["pos"], "n", width=4).collect()}
    i = {(r["k"], r["pos"]): r["i"] for r in islands(df, ["k"], ["pos"], F.col("flag") == 1, "i", width=4).collect()}
    for key in {r[0] for r in rows}:
        seen = 0
        for at, (_, pos, _, flag) in enumerate(sorted(r for r in rows if r[0] == key), 1):
            seen += flag
            assert n[key, pos] == at and i[key, pos] == seen


def test_rows_shuffle_once(spark):
    """The join with the block summaries and the in-block window share one exchange of the rows."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        df = spark.range(1000).select((F.col("id") % 3).alias("k"), F.col("id").alias("pos"), F.col("id").alias("v"))
        plan = ordered(df, ["k"], ["pos"], lag={"p": "v"}, width=10)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    top = plan.split("SortMergeJoin")[0]
    assert "Exchange" not in top and "Window" in top
