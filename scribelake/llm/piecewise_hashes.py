"""Context-triggered piecewise hashes of whole documents, and their likeness.

A rolling hash over the last seven bytes of a text cuts it wherever it falls below a bound, once in ``block`` bytes on average, so
cuts depend on what stands around them and not on where they are; a stretch without cuts ends after ``LONGEST`` blocks. Every chunk
gives one signature letter of twelve bits (two characters), a polynomial hash of its bytes. The block size is the least power of two
that makes at most ``CHUNKS`` blocks of the text; a fingerprint holds the signatures at that size and at twice that size.

Two fingerprints are comparable where they share a block size. Their likeness there is that of the signatures by edit distance with
insertions and deletions (a replacement counts twice): ``1 - distance / (letters of both)``. With a longest common subsequence of L letters
that is ``2 * L / (letters of both)``, which one big integer per letter computes bit-parallel. The most alike common size counts; without
a common size the likeness is 0.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType

from scribelake.llm.common import mixed
from scribelake.session import checkpointed

#: Bytes the rolling hash looks back on.
WINDOW = 7
CHUNKS = 64
LEAST_BLOCK = 4
#: Blocks after which a chunk ends at the latest.
LONGEST = 8
#: Bytes of a text that are hashed at a time.
SLICE = 1 << 20

_LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789-_"
_BYTE = mixed(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_ROLL = [(_BYTE >> np.uint64(8)).astype(np.uint32) * np.uint32(pow(0x2C1B3C6D, k, 1 << 32)) for k in range(WINDOW)]
_BASE = 0x5851F42D4C957F2D
_POWERS: dict[int, np.ndarray] = {}


def _powers(n: int) -> np.ndarray:
    """1, b, b ** 2, ... modulo 2 ** 64, at least ``n`` of them."""
    size = 1 << max(10, (n - 1).bit_length())
    if size not in _POWERS:
        out = np.full(size, _BASE, np.uint64)
        out[0] = 1
        _POWERS[size] = np.multiply.accumulate(out)
    return _POWERS[size]


def _rolled(raw: np.ndarray, before: np.ndarray) -> np.ndarray:
    """For each byte a hash of it and the six before it (fewer at the start of the text), as 32 bits."""
    wide = np.concatenate((before, raw))
    n, skip = len(raw), len(before)
    h = np.zeros(n, np.uint32)
    for k in range(WINDOW):
        short = min(n, max(0, k - skip))
        h[short:] += _ROLL[k][wide[skip + short - k : max(0, skip + n - k)]]
    h ^= h >> np.uint32(15)
    h *= np.uint32(0x2C1B3C6D)
    return h ^ (h >> np.uint32(13))


def block_size(n: int) -> int:
    """The least power of two, from ``LEAST_BLOCK`` on, of which at most ``CHUNKS`` make ``n`` bytes."""
    size = LEAST_BLOCK
    while size * CHUNKS < n:
        size *= 2
    return size


def _cuts(raw: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Ends of the chunks for ``size`` and for ``2 * size``; the second are among the places of the first unless forced."""
    fine, coarse = [], []
    for at in range(0, len(raw), SLICE):
        h = _rolled(raw[at : at + SLICE], raw[max(0, at - WINDOW + 1) : at])
        ends = np.flatnonzero(h < np.uint32((1 << 32) // size))
        fine.append(ends + at + 1)
        coarse.append(ends[h[ends] < np.uint32((1 << 32) // (2 * size))] + at + 1)
    return tuple(_bounded(np.concatenate(x), len(raw), LONGEST * s) for x, s in ((fine, size), (coarse, 2 * size)))


def _bounded(ends: np.ndarray, n: int, longest: int) -> np.ndarray:
    """The ends with the text's own end and a cut in every stretch longer than ``longest``."""
    if not len(ends) or ends[-1] != n:
        ends = np.append(ends, n)
    gaps = np.diff(ends, prepend=0)
    wide = np.flatnonzero(gaps > longest)
    if len(wide):
        more = [np.arange(ends[i] - gaps[i] + longest, ends[i], longest) for i in wide]
        ends = np.sort(np.concatenate((ends, *more)))
    return ends


def _signature(raw: np.ndarray, ends: np.ndarray) -> str:
    starts = np.concatenate(([0], ends[:-1]))
    sums = np.zeros(len(ends), np.uint64)
    for at in range(0, len(raw), SLICE):
        part = raw[at : at + SLICE]
        first, last = np.searchsorted(ends, at, "right"), np.searchsorted(starts, at + len(part), "left")
        inside = np.maximum(starts[first:last], at) - at
        # Powers count from the start of each piece, so that equal chunks have equal sums wherever they stand.
        lengths = np.diff(np.append(inside, len(part)))
        place = np.arange(len(part)) - np.repeat(inside, lengths)
        values = (part.astype(np.uint64) + np.uint64(1)) * _powers(len(part))[place]
        pieces = np.add.reduceat(values, inside)
        if starts[first] < at:
            pieces[:1] *= np.uint64(pow(_BASE, int(at - starts[first]), 1 << 64))
        sums[first:last] += pieces
    letters = (mixed(sums) >> np.uint64(52)).tolist()
    return "".join(_LETTERS[x >> 6] + _LETTERS[x & 63] for x in letters)


def fingerprint(raw: bytes) -> str:
    """``block size:signature:signature at twice the size`` of a text in UTF-8; both are empty for an empty text."""
    size = block_size(len(raw))
    if not raw:
        return f"{size}::"
    data = np.frombuffer(raw, np.uint8)
    return f"{size}:" + ":".join(_signature(data, ends) for ends in _cuts(data, size))


def common_letters(a: list[str], b: list[str]) -> int:
    """Length of the longest common subsequence, a bit of an integer for each letter of ``a``."""
    places: dict[str, int] = {}
    for i, letter in enumerate(a):
        places[letter] = places.get(letter, 0) | 1 << i
    full = (1 << len(a)) - 1
    row = full
    for letter in b:
        here = places.get(letter)
        if here:
            met = row & here
            row = ((row + met) | (row - met)) & full
    return len(a) - row.bit_count()


def likeness(a: str, b: str) -> float:
    """Likeness of two fingerprints, 0 to 1; equal ones have 1, also if they are those of empty texts."""
    if a == b:
        return 1.0
    (size_a, *own), (size_b, *other) = a.split(":"), b.split(":")
    sizes = {int(size_a) << k: s for k, s in enumerate(own)}
    best = 0.0
    for k, s in enumerate(other):
        mine = sizes.get(int(size_b) << k)
        if mine and s:
            x, y = ([t[i : i + 2] for i in range(0, len(t), 2)] for t in (mine, s))
            best = max(best, 2 * common_letters(x, y) / (len(x) + len(y)))
    return best


@F.pandas_udf(StringType())
def _fingerprints(text: pd.Series) -> pd.Series:
    return pd.Series([fingerprint((t or "").encode("utf-8")) for t in text], dtype=object)


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id, fingerprint`` per row; a null text counts as empty."""
    return docs.select(F.col(id_col).alias("id"), _fingerprints(F.col(text_col)).alias("fingerprint"))


@F.pandas_udf(DoubleType())
def _likenesses(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([None if x is None or y is None else likeness(x, y) for x, y in zip(a, b)], dtype="float64")


def likeness_of(a: Column, b: Column) -> Column:
    """``likeness`` of two fingerprint columns."""
    return _likenesses(a, b)


# --- a document beside its edited text and the next document -------------------------------------------------------------------------


def edited(text: str, following: str) -> str:
    """``text`` with its last third replaced by as many first characters of ``following`` (or all)."""
    third = len(text) // 3
    return text[: len(text) - third] + following[:third]


def _compared(id_, text: str, fp: str, following: str, next_fp: str) -> tuple:
    changed = edited(text, following).encode("utf-8")
    changed_fp = fingerprint(changed)
    return id_, len(text), hashlib.sha256(changed).hexdigest(), fp, changed_fp, likeness(fp, changed_fp), likeness(fp, next_fp)


_COLUMNS = ["id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]


def beside_next(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next`` for every row of ``docs``.

    The next document is the one with the next smaller id, after the last the first. Equal ids follow each other by a hash of the text and
    then by the text, null ids come last; null texts count as empty. A single document is its own next one. An empty table gives no rows.
    Other columns are not read.

    Rows are dealt by ranges of that order, once; a task then streams its range and holds two texts. The last row of a range needs the
    first of the next one: both are put aside (two texts a range) and meet in a join by the number of the range.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    plain = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).withColumn("tie", F.xxhash64("text"))
    order = [F.col("id").desc_nulls_last(), F.col("tie")]
    dealt = plain.repartitionByRange(*order).sortWithinPartitions(*order, "text").select("id", "text")

    def stream(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        held = first = None
        for batch in batches:
            out = []
            for id_, text in zip(batch["id"].astype(object).where(batch["id"].notna(), None), batch["text"]):
                fp = fingerprint(text.encode("utf-8"))
                if held is None:
                    first = (id_, text, fp)
                else:
                    out.append((*_compared(*held, text, fp), None, None, None))
                held = (id_, text, fp)
            yield pd.DataFrame(out, columns=[*_COLUMNS, "part", "head", "tail"])
        if held is not None:
            row = (held[0], len(held[1]), None, held[2], first[2], None, None, part, first[1], held[1])
            yield pd.DataFrame([row], columns=[*_COLUMNS, "part", "head", "tail"])

    fields = f"id {kind}, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    rows = checkpointed(dealt.mapInPandas(stream, f"{fields}, part int, head string, tail string"))
    inner = rows.where("part IS NULL").select(*_COLUMNS)

    # One row per range: its number, the first text with its fingerprint, the last text with its own.
    ends = rows.where("part IS NOT NULL").select("part", "id", "head", F.col("edited_fingerprint").alias("head_fp"), "tail", "fingerprint")
    after = {a: b for a, b in zip(*_cycle(sorted(r["part"] for r in ends.select("part").collect())))}
    follows = docs.sparkSession.createDataFrame(list(after.items()), "part int, following int")

    def close(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            ids = b["id"].astype(object).where(b["id"].notna(), None)
            yield pd.DataFrame([_compared(*x) for x in zip(ids, b["tail"], b["fingerprint"], b["head"], b["head_fp"])], columns=_COLUMNS)

    heads = ends.select(F.col("part").alias("following"), "head", "head_fp")
    last = ends.drop("head", "head_fp").join(follows, "part").join(heads, "following").select("id", "tail", "fingerprint", "head", "head_fp")
    return inner.unionByName(last.mapInPandas(close, fields))


def _cycle(parts: list[int]) -> tuple[list[int], list[int]]:
    return parts, parts[1:] + parts[:1]
