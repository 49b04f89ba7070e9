"""Sharding by histogram sort: splitters refined by exact byte counts, then one exchange.

Every row gets a 62-bit key from its text, so equal texts lie together. The bytes below candidate key boundaries are counted
exactly in one aggregation per round; each round cuts the interval of every open splitter into ``PROBES`` parts and keeps the
part that holds its target. A round returns at most ``shards * PROBES`` sums, whatever the size of the input.

A group of equal texts stays in one shard as long as it fits a shard's share. Groups too large for a boundary to pass them
evenly (over ``heavy`` of a share) are placed first, largest first, and the splitters of all other rows fill what is left; there
are at most ``shards / heavy`` such groups. A group larger than a share cannot stay whole: its rows get a key of their own each.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scribelake.session import checkpointed

KEY_BITS = 62
PROBES = 1024


def sized(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``row, id, size, text_crc32, group_key``: the narrow table all rounds read; ``row`` numbers the stored rows."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    narrow = docs.select(
        F.col(id_col).alias("id"),
        (F.octet_length(text) + 1).cast("bigint").alias("size"),
        F.crc32(text).alias("text_crc32"),
        F.shiftrightunsigned(F.xxhash64(text), 64 - KEY_BITS).alias("group_key"),
    )
    return checkpointed(narrow).withColumn("row", F.monotonically_increasing_id())


def _part(key: Column, spans: list[tuple[int, int]]) -> Column:
    """Index of the part of a span in which a key lies: span * PROBES + part; null outside all spans."""
    out = F.lit(None).cast("bigint")
    for i, (low, high) in enumerate(spans):
        step = max(1, (high - low) // PROBES)
        inside = (key >= low) & (key < high)
        out = F.when(inside, F.lit(i * PROBES) + F.floor((key - F.lit(low)) / F.lit(step)).cast("bigint")).otherwise(out)
    return out


def splitters(rows: DataFrame, targets: list[int], tolerance: int) -> list[int]:
    """Key boundaries with ``targets[i]`` bytes below boundary i, each within ``tolerance`` bytes or at a single key.

    ``rows`` has ``key`` and ``size``. Spans are powers of two, so parts have equal width.
    """
    found: dict[int, int] = {}
    # Per open splitter: its span and the bytes below the span.
    open_ = {i: (0, 1 << KEY_BITS, 0) for i in range(len(targets))}
    while open_:
        spans = sorted({(low, high) for low, high, _ in open_.values()})
        part = _part(F.col("key"), spans).alias("part")
        sums = {r["part"]: r["bytes"] for r in rows.select(part, "size").where("part IS NOT NULL").groupBy("part").agg(F.sum("size").alias("bytes")).collect()}
        for i, (low, high, below) in list(open_.items()):
            at, step, total, best = spans.index((low, high)), max(1, (high - low) // PROBES), below, None
            for p in range((high - low) // step):
                grown = total + sums.get(at * PROBES + p, 0)
                if grown >= targets[i]:
                    # The boundary nearer to the target, on either side of the part.
                    best = (low + p * step, total) if targets[i] - total <= grown - targets[i] else (low + (p + 1) * step, grown)
                    if abs(best[1] - targets[i]) <= tolerance or step == 1:
                        found[i] = best[0]
                        del open_[i]
                    else:
                        open_[i] = (low + p * step, low + (p + 1) * step, total)
                    break
                total = grown
            else:
                found[i] = high
                del open_[i]
    # Targets rise, so boundaries must as well.
    out: list[int] = []
    for i in range(len(targets)):
        out.append(max([found[i], *out[-1:]]))
    return out


def assign(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shards: int = 8, tolerance: float = 0.001, heavy: float = 0.005
) -> DataFrame:
    """``id, size, text_crc32, shard, slot`` for every row of ``docs``.

    Shards get near equal bytes (UTF-8 bytes of the text plus 1). ``slot`` counts from 0 without gaps inside a shard. A null
    text has size 1; null ids and repeated rows are rows like any other. An empty input gives an empty result. Other columns
    of ``docs`` are not read, so their names do not matter.
    """
    rows = sized(docs, id_col, text_col)
    groups = rows.groupBy("group_key").agg(F.sum("size").alias("bytes"))
    total = rows.agg(F.sum("size")).first()[0] or 0
    share = total / shards
    # At most shards / heavy rows: each holds over heavy * total / shards bytes.
    large = groups.where(F.col("bytes") > heavy * share).orderBy(F.desc("bytes"), "group_key").collect()
    scattered = [r["group_key"] for r in large if r["bytes"] > share]
    load, placed = [0] * shards, []
    for r in large:
        if r["bytes"] <= share:
            to = min(range(shards), key=lambda s: (load[s], s))
            load[to] += r["bytes"]
            placed.append((r["group_key"], to))
    spark = docs.sparkSession
    fixed = spark.createDataFrame(
        [(k, s, False) for k, s in placed] + [(k, None, True) for k in scattered], "group_key bigint, fixed int, scatter boolean"
    )
    keyed = rows.join(F.broadcast(fixed), "group_key", "left").withColumn(
        "key",
        F.when(F.col("scatter"), F.shiftrightunsigned(F.xxhash64("group_key", "row"), 64 - KEY_BITS)).otherwise(F.col("group_key")),
    )
    free = [max(0.0, share - x) for x in load]
    light = total - sum(load)
    scale = light / sum(free) if sum(free) else 0.0
    targets, below = [], 0.0
    for x in free[:-1]:
        below += x * scale
        targets.append(round(below))
    bounds = splitters(keyed.where("fixed IS NULL"), targets, int(tolerance * share)) if total else [0] * (shards - 1)
    shard = F.lit(0)
    for b in bounds:
        shard = shard + (F.col("key") >= F.lit(b)).cast("int")
    return _slots(keyed.withColumn("shard", F.coalesce("fixed", shard).cast("int")))


def _slots(rows: DataFrame) -> DataFrame:
    """Number the rows of a shard: place inside the part of the stored table, after the rows of earlier parts."""
    parted = rows.withColumn("part", F.shiftright("row", 33))
    # One row per shard and part: grows with the number of parts only.
    before = Window.partitionBy("shard").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    counts = parted.groupBy("shard", "part").agg(F.count("*").alias("n"))
    starts = counts.select("shard", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    inside = F.row_number().over(Window.partitionBy("shard", "part").orderBy("row")) - 1
    return (
        parted.withColumn("inside", inside)
        .join(starts, ["shard", "part"])
        .select("id", "size", "text_crc32", "shard", (F.col("start") + F.col("inside")).cast("bigint").alias("slot"))
    )


def write(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", shards: int = 8, files: int = 4) -> None:
    """Write ``docs`` once, by shard: ``path/shard=k`` with ``files`` files each; refuses an existing folder.

    Rows go by id; ids must be unique here, or equal ids meet every shard their rows were given.
    """
    placed = assign(docs, id_col, text_col, shards).select(F.col("id").alias("_id"), "shard", "slot")
    joined = docs.join(placed, docs[id_col].eqNullSafe(placed["_id"])).drop("_id")
    joined.repartition(shards * files, "shard", F.pmod("slot", F.lit(files))).write.partitionBy("shard").parquet(path)
