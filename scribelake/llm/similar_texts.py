"""One document of each group of near copies, by 5-word shingles and a Jaccard similarity of 0.8 or more.

SimHash fingerprints within 4 bits are found as ``simhash_pivots`` finds them, by exact block keys and pivot distances, none missed. At a
similarity of 0.8 fingerprints differ in about ten of 64 bits, though, too many for exact block keys: half of the pairs would be missed. So
texts also meet under bands of minimum hashes of their shingles (a pair at similarity 0.8 shares one with a chance of 0.998), where the pivot
distances and the fingerprints discard again. The similarity of all survivors is computed from their whole shingle sets.

Equal texts are one candidate. Under a band with few candidates all pairs are looked at. Under a crowded one, texts that the links so far
have not joined are compared in tiles of bounded size. A tile yields a spanning forest of its links, not its pairs. So near copies that
fingerprints join cost about as many comparisons as there are of them; texts that share a crowded band but are similar to none cost the
square of their number in comparisons, and rows in proportion to the number of tiles. Shingle sets are built a second time, once for each
text that shares a key.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StructField, StructType

from scribelake.llm import components, simhash_pivots
from scribelake.llm.common import mixed, stored
from scribelake.llm.simhash_pivots import CROWD, PIVOTS, SEED, with_pivots
from scribelake.session import checkpointed

SHINGLE = 5
SIMILARITY = 0.8
BANDS, ROWS = 20, 6
#: Bits in which fingerprints of similar texts differ at most: the mean at similarity 0.8 and four deviations.
RADIUS = 21
#: Texts and shingles on one side of a tile.
TILE, TILE_SHINGLES = 256, 1 << 20
#: Shingles times permutations held at a time.
HELD = 1 << 20

_TIMES = mixed(np.arange(1, BANDS * ROWS + 1, dtype=np.uint64)) | np.uint64(1)
_BAND = mixed(np.arange(1001, 1001 + BANDS, dtype=np.uint64))


def shingle_hashes(text: str | None, width: int = SHINGLE) -> np.ndarray:
    """XXH64 of each shingle in order, repeats included; a text with fewer words than ``width`` has one, one without words none."""
    import xxhash

    words = (text or "").encode("utf-8").lower().split()  # of bytes: lower() touches A-Z, split() cuts at 0x20 and 0x09 to 0x0D only
    spans = [words] if 0 < len(words) < width else [words[i : i + width] for i in range(len(words) - width + 1)]
    return np.array([xxhash.xxh64_intdigest(b" ".join(s), SEED) for s in spans], np.uint64)


def sketch(text: str | None, width: int = SHINGLE) -> tuple[int, list[int]]:
    """Signed SimHash fingerprint and the band keys; no keys without words."""
    hashes = shingle_hashes(text, width)
    if not len(hashes):
        return 0, []
    counts = np.zeros(64, np.int64)
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(hashes), step := max(1, HELD // len(_TIMES))):
        part = hashes[at : at + step]
        counts += np.unpackbits(part.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
        # Equal shingles have equal products: repeats do not move a minimum.
        np.minimum(least, (part[:, None] * _TIMES).min(axis=0), out=least)
    keys = np.bitwise_xor.reduce(mixed(least.reshape(BANDS, ROWS) + np.arange(ROWS, dtype=np.uint64)), axis=1)
    keys = mixed(keys ^ _BAND)
    fp = int.from_bytes(np.packbits(counts * 2 > len(hashes)).tobytes(), "big", signed=True)
    return fp, keys.view(np.int64).tolist()


@F.pandas_udf(StructType([StructField("fp", LongType()), StructField("keys", ArrayType(LongType()))]))
def _sketches(text: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([sketch(t) for t in text], columns=["fp", "keys"])


@F.pandas_udf(ArrayType(LongType()))
def _sets(text: pd.Series) -> pd.Series:
    return pd.Series([np.unique(shingle_hashes(t)).view(np.int64) for t in text], dtype=object)


def _text_key(text: Column) -> Column:
    """A digest of the text, the same for all texts without words."""
    return F.when(text.rlike(r"[^\x20\x09-\x0D]"), F.md5(text)).otherwise(F.lit(""))


def _close(a: str, b: str) -> Column:
    """The pivot table first, then all bits."""
    within = F.lit(True)
    for i in range(len(PIVOTS)):
        within = within & (F.abs(F.col(f"{a}.dist")[i] - F.col(f"{b}.dist")[i]) <= RADIUS)
    return within & (F.bit_count(F.col(f"{a}.fp").bitwiseXOR(F.col(f"{b}.fp"))) <= RADIUS)


def _verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs ``u, v`` of text keys whose shingle sets are similar; stored."""
    one, other = (sets.select(F.col("k").alias(c), F.col("shingles").alias(f"of_{c}")) for c in "uv")
    both = F.size(F.array_intersect("of_u", "of_v"))
    alike = both / (F.size("of_u") + F.size("of_v") - both)
    return stored(pairs.join(one, "u").join(other, "v").where(alike >= SIMILARITY).select("u", "v"), "similar")


def _bitmaps(sets: list[np.ndarray]) -> np.ndarray:
    """One row of bits per set over the members that two sets or more have: the others are in no intersection."""
    member, at, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    column = np.cumsum(times > 1) - 1
    row = np.repeat(np.arange(len(sets)), [len(x) for x in sets])
    common = times[at] > 1
    row, bit = row[common], column[at[common]]
    bits = np.zeros((len(sets), int((times > 1).sum()) // 64 + 1), np.uint64)
    np.bitwise_or.at(bits, (row, bit >> 6), np.uint64(1) << (bit & 63).astype(np.uint64))
    return bits


def _forest(n: int, x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of the links ``x, y`` among ``n`` nodes, as many as join what they join."""
    parent = list(range(n))

    def top(a: int) -> int:
        while parent[a] != a:
            parent[a] = parent[parent[a]]
            a = parent[a]
        return a

    kept = []
    for at, (a, b) in enumerate(zip(x.tolist(), y.tolist())):
        a, b = top(a), top(b)
        if a != b:
            parent[max(a, b)] = min(a, b)
            kept.append(at)
    return x[kept], y[kept]


def _tile_links(rows: pd.DataFrame) -> pd.DataFrame:
    """Links between the two sides of a tile (or inside its only side), as a forest. Texts of one group already are not compared."""
    cross = rows["i"].iat[0] != rows["j"].iat[0]
    rows = rows.sort_values("own", kind="stable")
    k, root = rows["k"].to_numpy(object), pd.factorize(rows["root"])[0]
    fp, dist = rows["fp"].to_numpy(np.int64).view(np.uint64), np.stack(rows["dist"].to_numpy()).astype(np.int16)
    sets = [np.asarray(x, np.int64) for x in rows["shingles"]]
    size, bits = np.array([len(x) for x in sets]), _bitmaps(sets)
    split = int((rows["own"] == rows["i"]).sum()) if cross else len(rows)
    mine, other = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for a in range(split):
        b = np.arange(split if cross else a + 1, len(rows))
        b = b[(root[b] != root[a]) & (np.bitwise_count(fp[b] ^ fp[a]) <= RADIUS)]
        b = b[(np.abs(dist[b] - dist[a]) <= RADIUS).all(axis=1)]
        both = np.bitwise_count(bits[b] & bits[a]).sum(axis=1, dtype=np.int64)
        b = b[both / (size[b] + size[a] - both) >= SIMILARITY]
        mine.append(np.full(len(b), a))
        other.append(b)
    x, y = _forest(len(rows), np.concatenate(mine), np.concatenate(other))
    return pd.DataFrame({"u": np.maximum(k[x], k[y]), "v": np.minimum(k[x], k[y])}, dtype=object)


def _tiled(apart: DataFrame, sets: DataFrame) -> DataFrame:
    """``u, v``: links that join all similar texts of different ``root`` under one ``key``; stored.

    ``apart``: key, k, fp, dist, root. Every two sides of a key meet in one tile.
    """
    sized = apart.join(sets.select("k", F.size("shingles").alias("size")), "k")
    sides = F.greatest(F.ceil(F.count("*") / TILE), F.ceil(F.sum("size") / TILE_SHINGLES)).cast("int")
    cut = checkpointed(sized.groupBy("key").agg(sides.alias("sides")))
    own = apart.join(cut, "key").withColumn("own", F.pmod(F.xxhash64("k"), F.col("sides")).cast("int"))
    dealt = own.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("sides") - 1))).select(
        "key", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "k", "root", "fp", "dist"
    )
    tiles = dealt.join(sets, "k").groupBy("key", "i", "j")
    return stored(tiles.applyInPandas(_tile_links, "u string, v string"), "tiled")


def by_fingerprint(texts: DataFrame) -> DataFrame:
    """``u, v``: pairs of text keys that join all texts whose fingerprints are within ``simhash_pivots.RADIUS`` bits. ``texts``: k, fp."""
    faces = checkpointed(texts.groupBy("fp").agg(F.min("k").alias("face")))
    same = texts.join(faces, "fp").where("k <> face").select(F.col("k").alias("u"), F.col("face").alias("v"))
    one, other = (faces.select(F.col("fp").alias(c), F.col("face").alias(f"face_{c}")) for c in "uv")
    near = simhash_pivots.links(faces.select("fp")).join(one, "u").join(other, "v")
    return same.unionByName(near.select(F.greatest("face_u", "face_v").alias("u"), F.least("face_u", "face_v").alias("v")))


def links(texts: DataFrame, docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``u, v``: links that join all groups of similar texts, by key. ``texts`` holds ``k, fp, keys`` once per text."""
    keyed = with_pivots(texts.select("k", "fp", F.explode("keys").alias("key")))
    shared = checkpointed(keyed.groupBy("key").agg(F.count("*").alias("n")).where("n > 1"))
    met = stored(keyed.join(shared, "key"), "met")
    few, crowd = met.where(F.col("n") <= CROWD).drop("n"), met.where(F.col("n") > CROWD).drop("n")
    same = (F.col("a.key") == F.col("b.key")) & (F.col("a.k") < F.col("b.k"))
    pairs = few.alias("a").join(few.alias("b"), same & _close("a", "b")).select(F.col("b.k").alias("u"), F.col("a.k").alias("v"))
    pairs = stored(by_fingerprint(texts.select("k", "fp")).unionByName(pairs).distinct(), "pairs")
    needed = pairs.select("u").union(pairs.select("v")).union(crowd.select("k")).toDF("k").distinct()
    needed = stored(needed, "needed")
    whole = docs.select(_text_key(F.col(text_col)).alias("k"), F.col(text_col).alias("text")).join(needed, "k", "left_semi").dropDuplicates(["k"])
    sets = stored(whole.select("k", _sets("text").alias("shingles")), "shingles")
    # A link inside a group that is joined already says nothing new: only texts of different groups are compared, under keys that hold such.
    tied = components.stars(_verified(pairs, sets))
    grouped = stored(crowd.join(tied.withColumnRenamed("u", "k"), "k", "left").withColumn("root", F.coalesce("v", "k")).drop("v"), "grouped")
    split = grouped.groupBy("key").agg(F.min("root").alias("least"), F.max("root").alias("last")).where("least <> last").select("key")
    apart = stored(grouped.join(split, "key", "left_semi"), "apart")
    return tied if apart.isEmpty() else tied.unionByName(_tiled(apart, sets))


def representatives(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay: one of each group of documents that links of similar texts join.

    It is the one with the smallest id (null ids come last, of equal ids the one with the least text key), a single row even if that row is
    repeated. Texts without words, null ones among them, are copies of each other. An empty table stays empty.
    """
    text = F.col(text_col)
    rows = docs.select(F.col(id_col).alias("id"), _text_key(text).alias("k"), _sketches(text).alias("s"))
    rows = checkpointed(rows.select("id", "k", "s.fp", "s.keys"))
    order = F.struct(F.col("id").isNull().alias("none"), "id")
    texts = checkpointed(rows.groupBy("k").agg(F.min(order).alias("first"), F.first("fp").alias("fp"), F.first("keys").alias("keys")))
    tied = components.stars(links(texts.where("k <> ''").select("k", "fp", "keys"), docs, text_col))
    rooted = texts.select("k", "first").join(tied.withColumnRenamed("u", "k"), "k", "left")
    rooted = checkpointed(rooted.select("k", "first", F.coalesce("v", "k").alias("root")))
    best = rooted.groupBy("root").agg(F.min(F.struct("first", "k")).alias("best"))
    stays = checkpointed(best.select("best.k", _id_key(F.col("best.first.id")).alias("i"), F.lit(True).alias("stays")))
    counted = checkpointed(rows.groupBy(_id_key(F.col("id")).alias("i"), "k").agg(F.count("*").alias("n")))
    fate = checkpointed(counted.join(stays, ["i", "k"], "left"))
    named = docs.withColumn("__i", _id_key(F.col(id_col))).withColumn("__k", _text_key(text))
    gone, again = (fate.where(c).select(F.col("i").alias("__i"), F.col("k").alias("__k")) for c in ("stays IS NULL", "stays AND n > 1"))
    kept = named.join(gone, ["__i", "__k"], "left_anti")
    if not again.isEmpty():
        one_each = named.join(again, ["__i", "__k"], "left_semi").dropDuplicates(["__i", "__k"])
        kept = kept.join(again, ["__i", "__k"], "left_anti").unionByName(one_each)
    return kept.select(docs.columns)


def _id_key(id_: Column) -> Column:
    return F.coalesce(F.concat(F.lit("="), id_.cast("string")), F.lit(""))
