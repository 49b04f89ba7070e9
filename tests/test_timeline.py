import pytest
from pyspark.sql import functions as F

from scribelake.functions.text import clock_text
from scribelake.operators import timeline

SEGMENTS = "source_id string, idx int, from_ms long, to_ms long, text string"


def audit(spark, times, frames, rate, width=2):
    rows = [("s", i, a, b, f"t{i}") for i, (a, b) in enumerate(times, 1)]
    segments = spark.createDataFrame(rows, SEGMENTS)
    clocks = spark.createDataFrame([("s", frames, rate)], "source_id string, frames long, rate int")
    return timeline.audited(segments, clocks, width=width), clocks


def reasons(rows):
    return [(r["segment"], r["reason"]) for r in timeline.violations(rows).orderBy("segment").collect()]


def test_overshoot_is_exact(spark):
    rows, _ = audit(spark, [(997860, 999860), (999860, 1001860)], 48053232, 48000)
    (only,) = timeline.violations(rows).collect()
    assert only["reason"] == "end_after_eof"
    assert only["end_minus_eof_num"] * 1000 == 751 * only["eof_den"]


def test_last_end_on_enclosing_tick(spark):
    rows, clocks = audit(spark, [(1795820, 1800180)], 86408176, 48000)
    assert reasons(rows) == []
    n = timeline.normalizations(rows).collect()[0]
    assert n["raw_end_ms"] == 1800180 and n["end_num"] * 3000 == 5400511 * n["end_den"]
    out = timeline.segment_times(rows, clocks).collect()[0]
    assert out["endpoint_rounding_clamped"] and out["native_end_milliseconds"] == 1800180
    assert out["end_seconds"] == pytest.approx(5400511 / 3000)


@pytest.mark.parametrize("times", [[(1795820, 1800181)], [(1795820, 1800200)], [(1795820, 1800180), (1800180, 1800180)]])
def test_no_other_overshoot(spark, times):
    assert reasons(audit(spark, times, 86408176, 48000)[0])


def test_aligned_end_has_no_allowance(spark):
    assert reasons(audit(spark, [(900, 1010)], 16000, 16000)[0]) == [(1, "end_after_eof")]


def test_start_past_end(spark):
    assert {r for _, r in reasons(audit(spark, [(1001, 1010)], 16000, 16000)[0])} == {"start_after_eof", "end_after_eof"}


def test_previous_row_decides(spark):
    rows, _ = audit(spark, [(0, 1100), (800, 900)], 16000, 16000)
    assert reasons(rows) == [(1, "end_after_eof"), (2, "nonmonotonic_end")]


def test_offsets(spark):
    rows, clocks = audit(spark, [(1250, 2250)], 16000 * 9, 16000)
    offsets = spark.createDataFrame([("s", 90.0, 3600.0)], "source_id string, source_start double, global_offset double")
    out = timeline.segment_times(rows, clocks, offsets).collect()[0]
    assert (out["start_seconds"], out["global_end_seconds"], out["native_end_milliseconds"]) == (91.25, 3602.25, 2250)


def test_odd_rate(spark):
    frames = spark.range(1).select(timeline.frames_at(F.lit(44101).cast("long"), F.lit(44100)).alias("n")).first()["n"]
    assert frames == 16001
    assert reasons(audit(spark, [(0, 1000)], 44101, 44100)[0]) == []
    assert reasons(audit(spark, [(0, 1001)], 44101, 44100)[0]) == [(1, "end_after_eof")]


def test_eleven_thousand_segments_over_blocks(spark):
    times = [(i * 100, i * 100 + 90) for i in range(11000)]
    times[7000] = (times[6999][0] - 50, times[7000][1])
    rows, _ = audit(spark, times, 11000 * 1600 + 1600, 16000, width=500)
    assert reasons(rows) == [(7001, "nonmonotonic_start")]


@pytest.mark.parametrize(
    "seconds, srt, shown",
    [(-0.02, False, "-00:00:00.020"), (1.25, True, "00:00:01,250"), (360000.0, False, "100:00:00.000"), (0.0005, False, "00:00:00.000"), (0.0015, False, "00:00:00.002"), (-3.0, True, "00:00:00,000")],
)
def test_clock_text(spark, seconds, srt, shown):
    assert spark.range(1).select(clock_text(F.lit(seconds), srt=srt).alias("t")).first()["t"] == shown


def test_srt_needs_a_cue(spark):
    facts = spark.createDataFrame([("a", None, 5.0), ("b", True, 5.0), ("c", False, 5.0), ("d", True, 5.0)], "result_id string, timestamp_valid boolean, duration_seconds double")
    segments = spark.createDataFrame(
        [("a", 1, 0.0, 1.0, "x"), ("c", 1, 0.0, 1.0, "x"), ("d", 1, 0.0, 1.0, "x"), ("d", 2, 0.5, 0.5001, "y")],
        "result_id string, idx int, start_seconds double, end_seconds double, text string",
    )
    got = {r["result_id"]: r["srt_valid"] for r in timeline.srt_ready(segments, facts, width=1).collect()}
    assert got == {"a": True, "b": False, "c": False, "d": False}
