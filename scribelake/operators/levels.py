"""Digital sample levels from block partials that merge in any order."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scribelake.functions.text import dbfs
from scribelake.operators.joins import with_key_facts

# Levels and block lengths.
CANCELLATION = 10 ** (-12 / 10)
FIRST_INTERVALS = 16
FRAME_SAMPLES = 320
FLOOR_DBFS, BELOW_WHOLE_DB = -90.0, -30.0

_PARTIAL = T.StructType(
    [T.StructField(n, T.ArrayType(T.DoubleType())) for n in ("sums", "squares", "peaks")]
    + [T.StructField(n, T.ArrayType(T.LongType())) for n in ("peak_frames", "clips", "zeros")]
    + [T.StructField(n, T.DoubleType()) for n in ("mono_square", "mono_peak", "cross")]
)


@F.pandas_udf(_PARTIAL)
def _partials(channels: pd.Series, start: pd.Series) -> pd.DataFrame:
    rows = []
    for block, first in zip(channels, start):
        x = np.stack([np.asarray(c, np.float64) for c in block])
        size = np.abs(x)
        mono = x.mean(axis=0)
        at = size.argmax(axis=1)
        rows.append(
            (x.sum(axis=1), np.einsum("ij,ij->i", x, x), size.max(axis=1), at + first, (size >= 1.0).sum(axis=1),
             (x == 0).sum(axis=1), float(mono @ mono), float(np.abs(mono).max()),
             float(x[0] @ x[1]) if len(x) == 2 else None)
        )
    return pd.DataFrame(rows, columns=_PARTIAL.names)


def block_partials(blocks: DataFrame) -> DataFrame:
    """``blocks``: source_id, block, start_frame, rate, channels -> one row of sums per block."""
    return blocks.select(
        "source_id", "block", "start_frame", "rate", F.size("channels").alias("channel_count"),
        F.size(F.col("channels")[0]).alias("frames"), _partials("channels", "start_frame").alias("p"),
    ).select("source_id", "block", "start_frame", "rate", "channel_count", "frames", "p.*")


def channel_levels(partials: DataFrame) -> DataFrame:
    """Per channel: RMS, peak and its first frame, clipped and zero samples."""
    per = partials.select(
        "source_id", "frames",
        F.posexplode(F.arrays_zip("sums", "squares", "peaks", "peak_frames", "clips", "zeros")).alias("channel", "c"),
    )
    merged = per.groupBy("source_id", "channel").agg(
        F.sum("frames").alias("frames"), F.sum("c.squares").alias("squares"), F.max("c.peaks").alias("peak"),
        # First frame of the highest peak: the larger peak wins, then the earlier frame.
        F.max(F.struct(F.col("c.peaks"), -F.col("c.peak_frames").alias("f"))).alias("top"),
        F.sum("c.clips").alias("clip_count"), F.sum("c.zeros").alias("zero_count"),
    )
    finite = F.col("squares") < F.lit(float("inf"))
    return merged.select(
        "source_id", "channel", "frames",
        F.when(finite, dbfs(F.sqrt(F.col("squares") / F.col("frames")))).alias("rms_dbfs"),
        dbfs("peak").alias("peak_dbfs"), F.when(F.col("peak") > 0, -F.col("top")["col2"]).otherwise(0).alias("peak_frame"),
        "clip_count", "zero_count", finite.alias("finite"),
    )


def correlation(s0: Column, s1: Column, q0: Column, q1: Column, cross: Column, n: Column) -> Column:
    """Correlation from sums; null when a channel is constant; clipped to [-1, 1]."""
    var = lambda s, q: F.greatest(F.lit(0.0), q - s * s / n)
    scale = F.sqrt(var(s0, q0) * var(s1, q1))
    r = (cross - s0 * s1 / n) / F.when(scale > 0, scale)
    # greatest and least skip nulls, so a null must be kept apart.
    return F.when(r.isNotNull(), F.greatest(F.lit(-1.0), F.least(F.lit(1.0), r)))


def _energy(squares: Column) -> Column:
    return F.aggregate(squares, F.lit(0.0), lambda a, x: a + x) / F.size(squares)


def source_levels(partials: DataFrame) -> DataFrame:
    """Per source: mono RMS and peak, downmix energy ratio, stereo correlation."""
    at = lambda c, i: F.sum(F.get(F.col(c), F.lit(i)))
    sums = partials.groupBy("source_id").agg(
        F.sum("frames").alias("frames"), F.max("channel_count").alias("channels"),
        F.sum("mono_square").alias("mono_square"), F.max("mono_peak").alias("mono_peak"),
        F.sum(_energy(F.col("squares"))).alias("energy"), F.sum("cross").alias("cross"),
        at("sums", 0).alias("s0"), at("sums", 1).alias("s1"), at("squares", 0).alias("q0"), at("squares", 1).alias("q1"),
    )
    ratio = F.when(F.col("energy") > 0, F.col("mono_square") / F.col("energy")).otherwise(1.0)
    return sums.select(
        "source_id", "frames", "channels",
        dbfs(F.sqrt(F.col("mono_square") / F.col("frames"))).alias("mono_rms_dbfs"),
        dbfs("mono_peak").alias("mono_peak_dbfs"), dbfs(F.sqrt(ratio)).alias("downmix_ratio_db"),
        ((F.col("energy") > 0) & (ratio < CANCELLATION)).alias("whole_cancellation"),
        F.when(
            F.col("channels") == 2,
            correlation(*[F.col(c) for c in ("s0", "s1", "q0", "q1", "cross", "frames")]),
        ).alias("stereo_correlation"),
    )


def cancellation_blocks(partials: DataFrame) -> DataFrame:
    """Stereo blocks whose downmix loses most of the channels' energy."""
    energy = _energy(F.col("squares"))
    ratio = F.col("mono_square") / energy
    return partials.where((F.col("channel_count") == 2) & (energy > 0) & (ratio < CANCELLATION)).select(
        "source_id", "block", (F.col("start_frame") / F.col("rate")).alias("start_seconds"),
        ((F.col("start_frame") + F.col("frames")) / F.col("rate")).alias("end_seconds"),
        dbfs(F.sqrt(ratio)).alias("downmix_ratio_db"),
    )


def cancellation_report(cancelled: DataFrame) -> DataFrame:
    """Count and the first sixteen intervals of each source.

    The sixteen smallest block numbers come from partial top-k lists of bounded
    size (hash buckets first), not from ranking a whole source.
    """
    item = F.struct("block", "start_seconds", "end_seconds")
    firsts = lambda c: F.slice(F.array_sort(c), 1, FIRST_INTERVALS)
    part = cancelled.groupBy("source_id", F.floor(F.col("block") / 4096).alias("part")).agg(
        F.count(F.lit(1)).alias("n"), firsts(F.collect_list(item)).alias("head")
    )
    # Parts hold disjoint ranges in order: the first sixteen lie in the first sixteen non-empty parts.
    merged = part.groupBy("source_id").agg(
        F.sum("n").alias("interval_count"), F.min_by("head", "part").alias("h0"), F.min("part").alias("p0")
    )
    short = merged.where(F.size("h0") < FIRST_INTERVALS).select("source_id")
    w = Window.partitionBy("source_id").orderBy("part")
    several = part.join(short, "source_id", "left_semi").withColumn("r", F.row_number().over(w)).where(
        F.col("r") <= FIRST_INTERVALS
    ).groupBy("source_id").agg(firsts(F.flatten(F.collect_list("head"))).alias("h1"))
    return merged.join(several, "source_id", "left").select(
        "source_id", "interval_count", F.coalesce("h1", "h0").alias("first_intervals"),
        (F.col("interval_count") > 0).alias("warning"),
    )


def safe_gain(peak: Column, peak_dbfs: Column, max_gain_db: Column) -> Column:
    """Largest gain keeping the peak under the quantised ceiling; 0 for silence."""
    ceiling = F.floor(F.pow(F.lit(10.0), peak_dbfs / 20) * 32768) / 32768
    return F.when(peak > 0, F.least(max_gain_db, 20 * F.log10(ceiling / peak))).otherwise(0.0)


def sliced(intervals: DataFrame, blocks: DataFrame, block_frames: int) -> DataFrame:
    """Samples of requested frame intervals, cut at block edges.

    An interval is listed under every block it covers, so the range join is an
    equi-join on (source, block).
    """
    i = intervals.withColumn(
        "block",
        F.explode(F.sequence(
            F.floor(F.col("first") / block_frames).cast("bigint"),
            F.floor((F.col("last") - 1) / block_frames).cast("bigint"),
        )),
    )
    lo = F.greatest(F.col("first"), F.col("start_frame"))
    hi = F.least(F.col("last"), F.col("start_frame") + F.size("samples"))
    return i.join(blocks.select("source_id", "block", "start_frame", "samples"), ["source_id", "block"]).where(hi > lo).select(
        "interval_id", "source_id", "block", lo.alias("first_frame"), hi.alias("last_frame"),
        F.slice("samples", (lo - F.col("start_frame") + 1).cast("int"), (hi - lo).cast("int")).alias("samples"),
    )


def slice_levels(pieces: DataFrame, *keys: str) -> DataFrame:
    """Frames, peak and RMS of sliced samples."""
    s = F.col("samples")
    square = F.aggregate(s, F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))
    peak = F.array_max(F.transform(s, lambda x: F.abs(x.cast("double"))))
    sums = pieces.select(*keys, F.size("samples").alias("n"), square.alias("q"), peak.alias("p")).groupBy(*keys).agg(
        F.sum("n").alias("frames"), F.sum("q").alias("q"), F.max("p").alias("p")
    )
    return sums.select(
        *keys, "frames", dbfs("p").alias("peak_dbfs"), dbfs(F.sqrt(F.col("q") / F.col("frames"))).alias("rms_dbfs")
    )


def active_frames(frames: DataFrame) -> DataFrame:
    """Frames per source at or above the activity threshold.

    ``frames``: source_id, n, square_sum of each 20 ms frame.
    """
    whole = frames.groupBy("source_id").agg((F.sum("square_sum") / F.sum("n")).alias("mean_square"))
    threshold = F.greatest(
        F.lit(10 ** (FLOOR_DBFS / 20)), F.sqrt("mean_square") * F.lit(10 ** (BELOW_WHOLE_DB / 20))
    )
    return with_key_facts(frames, whole, "source_id", "inner").groupBy("source_id").agg(
        F.count(F.lit(1)).alias("frames"),
        F.count_if(F.sqrt(F.col("square_sum") / F.col("n")) >= threshold).alias("active"),
    )
