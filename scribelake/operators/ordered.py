"""Ordered work inside a key that may hold a large share of all rows.

A plain ``Window.partitionBy(key).orderBy(pos)`` puts a whole key into one task.
Here a key is cut into blocks of its ordering column. Rows are windowed per
(key, block); what must cross a block edge (the previous row, a running total)
travels as one summary row per block, and only those summaries are windowed per
key. The rows are shuffled once, by (key, block), for the join with the
summaries and the in-block window alike.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scribelake.session import checkpointed

BLOCK_ROWS = 1 << 16

BLOCK = "__block"

_MERGE = {"sum": F.sum, "count": F.sum, "max": F.max, "min": F.min}
_PARTIAL = {"sum": F.sum, "count": F.count, "max": F.max, "min": F.min}
_EMPTY = {"sum": 0, "count": 0, "max": None, "min": None}


def block_of(pos: str | Column, width: int = BLOCK_ROWS) -> Column:
    """Block number of an integer ordering column."""
    pos = F.col(pos) if isinstance(pos, str) else pos
    return F.floor(pos / F.lit(width)).cast("bigint")


def _combine(kind: str, left: Column, right: Column) -> Column:
    if kind in ("sum", "count"):
        return F.coalesce(left, F.lit(0)) + F.coalesce(right, F.lit(0))
    return (F.greatest if kind == "max" else F.least)(left, right)


def ordered(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    *,
    lag: Mapping[str, Column | str] | None = None,
    lead: Mapping[str, Column | str] | None = None,
    before: Mapping[str, tuple[str, Column | str]] | None = None,
    upto: Mapping[str, tuple[str, Column | str]] | None = None,
    total: Mapping[str, tuple[str, Column | str]] | None = None,
    attach: DataFrame | None = None,
    block: Column | None = None,
    width: int = BLOCK_ROWS,
) -> DataFrame:
    """Add ordered columns per key without gathering a key in one task.

    ``lag``/``lead``: value of the neighbouring row. ``before``: aggregate of all
    earlier rows. ``upto``: aggregate including the current row. ``total``:
    aggregate over the key. Aggregates are ``(kind, value)`` with kind one of
    sum, count, max, min. ``order`` must be unique inside a key; ``block`` must
    never decrease along it (default: the first order column cut by ``width``).
    ``attach`` is a table with one row per key; it rides on the block summaries,
    so it costs the rows no shuffle of their own (left join: keys it lacks keep
    nulls). Keys and block must not be null.
    """
    lag, lead = dict(lag or {}), dict(lead or {})
    before, upto, total = dict(before or {}), dict(upto or {}), dict(total or {})
    as_col = lambda c: F.col(c) if isinstance(c, str) else c

    rows = df.withColumn(BLOCK, block if block is not None else block_of(order[0], width))
    for name, value in {**lag, **lead}.items():
        rows = rows.withColumn(f"__v_{name}", as_col(value))
    for name, (_, value) in {**before, **upto, **total}.items():
        rows = rows.withColumn(f"__v_{name}", as_col(value))

    by = [*keys, BLOCK]
    pos = F.struct(*[F.col(c) for c in order])
    partials = []
    if lag:
        partials.append(F.max_by(F.struct(*[F.col(f"__v_{n}").alias(n) for n in lag]), pos).alias("__last"))
    if lead:
        partials.append(F.min_by(F.struct(*[F.col(f"__v_{n}").alias(n) for n in lead]), pos).alias("__first"))
    for name, (kind, _) in {**before, **upto, **total}.items():
        partials.append(_PARTIAL[kind](F.col(f"__v_{name}")).alias(f"__p_{name}"))
    blocks = rows.groupBy(*by).agg(*partials)

    along = Window.partitionBy(*keys).orderBy(BLOCK)
    earlier = along.rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*keys)
    carried = [F.col(c) for c in by]
    if lag:
        carried.append(F.lag("__last").over(along).alias("__last"))
    if lead:
        carried.append(F.lead("__first").over(along).alias("__first"))
    for name, (kind, _) in {**before, **upto}.items():
        carried.append(_MERGE[kind](f"__p_{name}").over(earlier).alias(f"__c_{name}"))
    for name, (kind, _) in total.items():
        carried.append(_MERGE[kind](f"__p_{name}").over(whole).alias(f"__c_{name}"))
    edges = blocks.select(*carried)
    if attach is not None:
        edges = edges.join(attach, on=list(keys), how="left")
    # Plain equality keeps the join's partitioning usable by the window below.
    joined = rows.join(edges, on=by, how="inner")

    inside = Window.partitionBy(*by).orderBy(*order)
    prior = inside.rowsBetween(Window.unboundedPreceding, -1)
    running = inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    out = {}
    at_start = F.row_number().over(inside) == 1
    for name in lag:
        out[name] = F.when(at_start, F.col("__last")[name]).otherwise(F.lag(f"__v_{name}").over(inside))
    if lead:
        backwards = Window.partitionBy(*by).orderBy(*[F.col(c).desc() for c in order])
        at_end = F.row_number().over(backwards) == 1
        for name in lead:
            out[name] = F.when(at_end, F.col("__first")[name]).otherwise(F.lead(f"__v_{name}").over(inside))
    for name, (kind, _) in before.items():
        here = _PARTIAL[kind](f"__v_{name}").over(prior)
        out[name] = _combine(kind, F.col(f"__c_{name}"), here)
    for name, (kind, _) in upto.items():
        here = _PARTIAL[kind](f"__v_{name}").over(running)
        out[name] = _combine(kind, F.col(f"__c_{name}"), here)
    for name, (kind, _) in total.items():
        value = F.col(f"__c_{name}")
        out[name] = F.coalesce(value, F.lit(0)) if _EMPTY[kind] == 0 else value
    result = joined.withColumns(out)
    helpers = [c for c in result.columns if c.startswith("__") and c not in df.columns]
    return result.drop(*helpers)


def islands(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    starts: Column | str,
    name: str,
    *,
    block: Column | None = None,
    width: int = BLOCK_ROWS,
) -> DataFrame:
    """Number the islands of a key: ``starts`` is true on the first row of each."""
    flag = F.col(starts) if isinstance(starts, str) else starts
    return ordered(
        df, keys, order, upto={name: ("sum", flag.cast("bigint"))}, block=block, width=width
    )


def numbered(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    name: str,
    *,
    block: Column | None = None,
    width: int = BLOCK_ROWS,
) -> DataFrame:
    """``row_number`` per key, starting at 1."""
    return ordered(df, keys, order, upto={name: ("count", F.lit(1))}, block=block, width=width)


def split_runs(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    *,
    lag: Mapping[str, str],
    uses: Sequence[str],
    starts: Column,
    name: str,
    block: Column | None = None,
    width: int = BLOCK_ROWS,
) -> DataFrame:
    """Number the islands of a key where a row starts one by comparison with the row before.

    ``lag`` names the previous row's columns; ``starts`` may use them and the
    columns in ``uses``. On the first row of a key they are null, and that row
    always starts an island. One pass instead of ``ordered`` and ``islands``:
    a block summary holds its edge rows and the starts inside it.
    """
    by = [*keys, BLOCK]
    rows = df.withColumn(BLOCK, block if block is not None else block_of(order[0], width))
    flag = F.coalesce(starts, F.lit(False)).cast("bigint")
    inside = Window.partitionBy(*by).orderBy(*order)

    need = list(dict.fromkeys([*by, *order, *uses, *lag.values()]))
    narrow = rows.select(*need)
    narrow = narrow.withColumns(
        {"__rn": F.row_number().over(inside), **{n: F.lag(c).over(inside) for n, c in lag.items()}}
    )
    first_cols = list(dict.fromkeys([*order, *uses, *lag.values()]))
    blocks = narrow.groupBy(*by).agg(
        F.max(F.when(F.col("__rn") == 1, F.struct(*first_cols))).alias("__first"),
        F.max_by(F.struct(*[F.col(c).alias(n) for n, c in lag.items()]), "__rn").alias("__last"),
        F.sum(F.when(F.col("__rn") > 1, flag).otherwise(0)).alias("__inner"),
    )
    along = Window.partitionBy(*keys).orderBy(BLOCK)
    edges = blocks.withColumns({"__carry": F.lag("__last").over(along), "__nth": F.row_number().over(along)})
    opened = edges.select(
        *by, "__carry", "__nth", "__inner", *[F.col(f"__first.{c}").alias(c) for c in first_cols],
        *[F.col(f"__carry.{n}").alias(n) for n in lag],
    ).select(
        *by, "__carry",
        (F.col("__inner") + F.when(F.col("__nth") == 1, F.lit(1)).otherwise(flag)).alias("__starts"),
    )
    earlier = along.rowsBetween(Window.unboundedPreceding, -1)
    edges = opened.select(
        *by, "__carry", F.coalesce(F.sum("__starts").over(earlier), F.lit(0)).alias("__before")
    )
    joined = rows.join(edges, on=by, how="inner")
    first = F.row_number().over(inside) == 1
    placed = joined.withColumns(
        {
            "__rn": F.row_number().over(inside),
            **{n: F.when(first, F.col("__carry")[n]).otherwise(F.lag(c).over(inside)) for n, c in lag.items()},
        }
    )
    begins = F.when((F.col("__rn") == 1) & (F.col("__before") == 0), F.lit(1)).otherwise(flag)
    running = inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return placed.withColumn("__begins", begins).withColumn(
        name, F.col("__before") + F.sum("__begins").over(running)
    ).drop(BLOCK, "__carry", "__before", "__rn", "__begins")


def placed(rows: DataFrame, name: str = "place") -> DataFrame:
    """Rows of a sorted DataFrame with their place in it, from 1.

    The sorted parts are stored once; a row's place is its place in its part plus the
    sizes of the parts before, of which there is one row each.
    """
    stored = checkpointed(rows)
    own = stored.withColumn("__at", F.monotonically_increasing_id())
    part = F.shiftright("__at", 33).alias("__part")
    sizes = own.groupBy(part).agg(F.count(F.lit(1)).alias("__n"))
    before = F.sum("__n").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1))
    starts = sizes.select("__part", F.coalesce(before, F.lit(0)).alias("__before"))
    inside = F.col("__at") - F.shiftleft(F.shiftright("__at", 33), 33)
    joined = own.withColumn("__part", part).join(starts, "__part")
    return joined.withColumn(name, (F.col("__before") + inside + 1).cast("bigint")).drop("__part", "__at", "__before")
