"""Near-duplicate detection over SimHash fingerprints with pivot distance tables.

Every distinct fingerprint gets its Hamming distances to ``PIVOTS`` fixed reference fingerprints, once. By the triangle
inequality two fingerprints within ``radius`` bits differ by at most ``radius`` in every coordinate, so a candidate pair whose
largest coordinate difference is above it is discarded, and only survivors are compared bit by bit.

Which pairs become candidates: one coordinate lets about 57 % of random pairs pass, so pivots alone would mean looking at all
pairs. Fingerprints are therefore cut into ``m`` blocks; two within ``radius`` bits agree in at least ``m - radius`` of them, so
every linked pair meets under one of C(m, radius) keys. ``m`` is chosen from the number of fingerprints so that a key holds a few.
No pair is missed, whatever ``m``.

Keys with many fingerprints (a large family of near copies) are cut into tiles of bounded size; a tile yields a spanning forest of
its links, not the links, so a dense family makes as many edges as it has members.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from scribelake.llm import components
from scribelake.llm.common import mixed
from scribelake.session import checkpointed

SHINGLE = 4
SEED = 42
RADIUS = 4
#: Reference fingerprints: a fixed sequence.
PIVOTS = [int(x) for x in mixed(np.arange(1, 17, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))]
#: Fingerprints under one key from which the key is cut into tiles, and the size of a tile's side.
CROWD = 24
TILE = 1024


def fingerprint(text: str | None, width: int = SHINGLE) -> int:
    """Signed 64-bit SimHash of a whole text; 0 if it has no words."""
    import xxhash

    raw = np.frombuffer((text or "").encode("utf-8").lower(), np.uint8)  # bytes.lower() touches A-Z only
    space = (raw == 0x20) | ((raw >= 9) & (raw <= 13))
    edge = np.flatnonzero(np.diff(np.concatenate(([True], space, [True])).astype(np.int8)))
    first, last = edge[0::2], edge[1::2]
    if not len(first):
        return 0
    # One space between words: a space stays where a word ended just before it.
    keep = ~space
    keep[last[:-1]] = True
    plain = np.where(space, np.uint8(0x20), raw)[keep].tobytes()
    ends = np.cumsum(last - first) + np.arange(len(first))
    starts = ends - (last - first)
    n = max(1, len(first) - width + 1)
    stops = ends[width - 1 :] if len(first) >= width else ends[-1:]
    digest, counts = xxhash.xxh64_intdigest, np.zeros(64, np.int64)
    for at in range(0, n, 1 << 16):
        spans = zip(starts[at : min(n, at + (1 << 16))].tolist(), stops[at : at + (1 << 16)].tolist())
        hashes = np.array([digest(plain[a:b], SEED) for a, b in spans], ">u8")
        counts += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(counts * 2 > n).tobytes(), "big", signed=True)


@F.pandas_udf(LongType())
def _fingerprints(text: pd.Series) -> pd.Series:
    return pd.Series([fingerprint(t) for t in text], dtype="int64")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id, fp`` per row, stored."""
    return checkpointed(docs.select(F.col(id_col).alias("id"), _fingerprints(F.col(text_col)).alias("fp")))


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def with_pivots(fps: DataFrame) -> DataFrame:
    """Add ``dist``: the distances of ``fp`` to all reference fingerprints."""
    near = [F.bit_count(F.col("fp").bitwiseXOR(F.lit(_signed(p)))).cast("tinyint") for p in PIVOTS]
    return fps.withColumn("dist", F.array(*near))


def blocks_for(n: int, radius: int = RADIUS) -> int:
    """The least number of blocks whose keys hold at most about four of ``n`` spread fingerprints."""
    m = radius + 2
    while m < 3 * radius and (64 * (m - radius)) // m < np.log2(max(n, 1)) - 2:
        m += 1
    return m


def _keys(fp: Column, m: int, radius: int) -> Column:
    bounds = [64 * i // m for i in range(m + 1)]
    masks = [sum(1 << b for b in range(bounds[i], bounds[i + 1])) for i in range(m)]
    chosen = [sum(masks[i] for i in c) for c in combinations(range(m), m - radius)]
    return F.array(*[F.struct(F.lit(i).alias("c"), fp.bitwiseAND(F.lit(_signed(x))).alias("key")) for i, x in enumerate(chosen)])


def links(fps: DataFrame, radius: int = RADIUS) -> DataFrame:
    """``u, v``: edges that join all distinct fingerprints within ``radius`` bits. ``fps`` has distinct ``fp``.

    Every pair within ``radius`` is an edge or joined by a path of edges; every edge is within ``radius``.
    """
    m = blocks_for(fps.count(), radius)
    keyed = with_pivots(fps).select("fp", "dist", F.explode(_keys(F.col("fp"), m, radius)).alias("k")).select("fp", "dist", "k.c", "k.key")
    shared = checkpointed(keyed.groupBy("c", "key").agg(F.count("*").alias("n")).where("n > 1"))
    met = checkpointed(keyed.join(shared, ["c", "key"]))
    few = met.where(F.col("n") <= CROWD)
    a, b = few.alias("a"), few.alias("b")
    within = F.lit(True)
    for i in range(len(PIVOTS)):
        within = within & (F.abs(F.col("a.dist")[i] - F.col("b.dist")[i]) <= radius)
    same = (F.col("a.c") == F.col("b.c")) & (F.col("a.key") == F.col("b.key")) & (F.col("a.fp") < F.col("b.fp"))
    close = F.bit_count(F.col("a.fp").bitwiseXOR(F.col("b.fp"))) <= radius
    pairs = a.join(b, same & within & close).select(F.col("b.fp").alias("u"), F.col("a.fp").alias("v"))
    return pairs.unionByName(_tiled(met.where(F.col("n") > CROWD), radius)).distinct()


def _tiled(met: DataFrame, radius: int) -> DataFrame:
    """Edges of crowded keys: every two sides of a key meet in one tile of bounded size."""
    sides = F.ceil(F.col("n") / TILE).cast("int")
    own = met.withColumn("sides", sides).withColumn("own", F.pmod(F.xxhash64("fp"), F.col("sides")).cast("int"))
    dealt = own.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("sides") - 1))).select(
        "c", "key", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "fp", "dist"
    )

    def forest(rows: pd.DataFrame) -> pd.DataFrame:
        fp = rows["fp"].to_numpy(np.int64).view(np.uint64)
        near = np.stack(rows["dist"].to_numpy()).astype(np.int16)
        order = np.argsort(near[:, 0], kind="stable")
        fp, near = fp[order], near[order]
        label = np.arange(len(fp))
        mine, other = [], []
        for at in range(0, len(fp), 256):
            # Sorted by the first coordinate: partners lie in one run.
            stop = np.searchsorted(near[:, 0], near[min(at + 255, len(fp) - 1), 0] + radius, "right")
            left, right = near[at : at + 256], near[at:stop]
            ok = np.ones((len(left), len(right)), bool)
            for p in range(near.shape[1]):
                ok &= np.abs(left[:, p, None] - right[None, :, p]) <= radius
            x, y = np.nonzero(ok)
            close = np.bitwise_count(fp[at + x] ^ fp[at + y]) <= radius
            mine.append(at + x[close])
            other.append(at + y[close])
        x, y = np.concatenate(mine), np.concatenate(other)
        while True:
            low = np.minimum(label[x], label[y])
            new = label.copy()
            np.minimum.at(new, x, low)
            np.minimum.at(new, y, low)
            new = new[new]
            if (new == label).all():
                break
            label = new
        # A label is a member of the same linked family; a path inside the tile joins it, so (member, label) is a sound edge.
        moved = label != np.arange(len(fp))
        return pd.DataFrame({"u": fp[moved].view(np.int64), "v": fp[label[moved]].view(np.int64)})

    return dealt.groupBy("c", "key", "i", "j").applyInPandas(forest, "u bigint, v bigint")


def classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = RADIUS) -> DataFrame:
    """``id, fp, component`` for every row of ``docs``; ``component`` is the smallest id reachable over links.

    A null or wordless text has fingerprint 0 and is linked like any other. Null ids belong to components but never name one
    unless a component has no other; an empty input gives an empty result. Other columns are not read.
    """
    rows = fingerprints(docs, id_col, text_col)
    # Stored: the joins below have plain shuffles on both sides, so a hot fingerprint can be split.
    fps = checkpointed(rows.groupBy("fp").agg(F.min("id").alias("least")))
    tied = components.stars(links(fps.select("fp"), radius))
    rooted = fps.join(tied.withColumnRenamed("u", "fp"), "fp", "left").select("fp", "least", F.coalesce("v", "fp").alias("root"))
    rooted = checkpointed(rooted)
    named = checkpointed(rooted.groupBy("root").agg(F.min("least").alias("component")))
    of_fp = checkpointed(rooted.join(named, "root").select("fp", "component"))
    return rows.join(of_fp, "fp").select("id", "fp", "component")


def representatives(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay: of each component the one with its smallest id; of equal ids, one with the least text.

    Decided by id, so rows that repeat an id share a fate: if their fingerprints are in different components, the id stays if it
    names one of them.
    """
    keep = classes(docs, id_col, text_col).where(F.col("id").eqNullSafe(F.col("component"))).select(F.col("id").alias("_keep")).distinct()
    return docs.join(keep, F.col(id_col).eqNullSafe(F.col("_keep")), "left_semi")
