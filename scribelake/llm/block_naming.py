"""Exact deduplication by block naming.

A text is cut into blocks of a fixed number of characters. Equal blocks get one integer name: distinct blocks are grouped by
their bytes, sorted, and numbered. Then adjacent pairs of names are named in the same way, level by level, until one name is left per
document. Two documents have the same (level, name) exactly if their texts are equal: names are given to bytes, not to digests.

Block bytes are shuffled once, after equal blocks of a task have met. Documents find their names by a 128-bit digest; the same
pass that groups the bytes shows whether two different blocks share a digest, and if so all is done again with another salt.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scribelake.session import checkpointed

BLOCK_CHARS = 4096
#: White space of the contract, in RE2 and Java syntax alike.
SPACES = r"[\x20\x09-\x0D]+"


def normalised(text):
    """Each run of ASCII white space becomes one space; null becomes empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), SPACES, " ")


def _blocks(text, chars: int):
    """Blocks of a text, cut in one pass over it; an empty text is one empty block."""
    return F.when(text == "", F.array(F.lit(""))).otherwise(F.regexp_extract_all(text, F.lit(f"(?s).{{1,{chars}}}"), F.lit(0)))


def _digests(block, salt: int):
    return F.struct(F.xxhash64(block).alias("h1"), F.xxhash64(F.lit(salt), block).alias("h2"))


def _named(df: DataFrame, *keys: str) -> DataFrame:
    """Distinct keys with an integer name each, numbered in sorted order inside each hash bucket."""
    return df.select(*keys).distinct().sortWithinPartitions(*keys).withColumn("name", F.monotonically_increasing_id())


def identities(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block_chars: int = BLOCK_CHARS) -> DataFrame:
    """``row, id, text_sha256, level, name`` per row; equal normalised texts have equal (level, name) and no others do."""
    text = normalised(F.col(text_col))
    plain = docs.select(F.col(id_col).alias("id"), text.alias("text"))
    salt = 0
    while True:
        blocks = plain.select(F.explode(_blocks(F.col("text"), block_chars)).alias("block"))
        distinct = blocks.select(_digests(F.col("block"), salt).alias("d"), "block").select("d.h1", "d.h2", "block")
        names = checkpointed(_named(distinct, "h1", "h2", "block").drop("block"))
        if names.groupBy("h1", "h2").count().where("count > 1").isEmpty():
            break
        salt += 1
    listed = plain.select(
        "id",
        F.sha2("text", 256).alias("text_sha256"),
        F.transform(_blocks(F.col("text"), block_chars), lambda b: _digests(b, salt)).alias("digests"),
    )
    rows = checkpointed(listed).withColumn("row", F.monotonically_increasing_id())
    level = 0
    # One name per document and place; `n` places are left at this level.
    places = (
        rows.select("row", F.size("digests").alias("n"), F.posexplode("digests").alias("place", "d"))
        .select("row", "n", "place", "d.h1", "d.h2")
        .join(names, ["h1", "h2"])
        .select("row", "n", "place", "name")
    )
    done = []
    while True:
        places = checkpointed(places)
        done.append(places.where("n = 1").select("row", F.lit(level).alias("level"), "name"))
        longer = places.where("n > 1")
        if longer.isEmpty():
            break
        side = F.pmod("place", F.lit(2))
        pairs = longer.groupBy("row", "n", F.shiftright("place", 1).alias("place")).agg(
            F.max(F.when(side == 0, F.col("name"))).alias("left"),
            F.coalesce(F.max(F.when(side == 1, F.col("name"))), F.lit(-1)).alias("right"),
        )
        pairs = checkpointed(pairs)
        places = pairs.join(checkpointed(_named(pairs, "left", "right")), ["left", "right"]).select(
            "row", F.shiftright(F.col("n") + 1, 1).alias("n"), "place", "name"
        )
        level += 1
    found = done[0]
    for d in done[1:]:
        found = found.unionByName(d)
    return rows.select("row", "id", "text_sha256").join(found, "row")


def groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block_chars: int = BLOCK_CHARS) -> DataFrame:
    """``id, keep_id, group_size, kept, text_sha256`` for every row of ``docs``, dropped ones too.

    Texts are equal when identical after replacing each run of ASCII white space by one space; null counts as empty. Of equal
    texts the row with the smallest id stays; null ids come last, and of repeated ids one row stays. An empty input gives an
    empty result. Other columns are not read.
    """
    known = checkpointed(identities(docs, id_col, text_col, block_chars))
    best = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "row")).alias("best")
    # Stored, so that the join below has two plain shuffles and a hot group can be split.
    classes = checkpointed(known.groupBy("level", "name").agg(best, F.count("*").alias("group_size")))
    return known.join(classes, ["level", "name"]).select(
        "id",
        F.col("best.id").alias("keep_id"),
        F.col("group_size").cast("bigint"),
        (F.col("row") == F.col("best.row")).alias("kept"),
        "text_sha256",
    )
