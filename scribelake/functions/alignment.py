"""Word alignment counts for batches of token lists."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

WER = T.StructType(
    [
        T.StructField("S", T.LongType()),
        T.StructField("D", T.LongType()),
        T.StructField("I", T.LongType()),
        T.StructField("N", T.LongType()),
    ]
)

# Cells of one diagonal over all pairs aligned together: a few such vectors stay in a core's cache.
BATCH_CELLS = 1 << 16
# Pairs are put together by reference lengths of so many words, then by hypothesis length.
STEP_WORDS = 16


def batch_counts(pairs: list[tuple]) -> np.ndarray:
    """Substitutions, deletions, insertions per (reference, hypothesis); ties prefer them in this order.

    Pairs of like length are aligned together. Cells of an anti-diagonal do not
    depend on each other, so a diagonal of all pairs is one vector step. What pads
    a shorter pair lies behind its last cell and cannot reach it.
    """
    out = np.zeros((len(pairs), 3), np.int64)
    ids: dict[str, int] = {}
    coded = [tuple(np.fromiter((ids.setdefault(w, len(ids)) for w in side), np.int32, len(side)) for side in pair) for pair in pairs]
    sizes = np.array([(len(a), len(b)) for a, b in coded], np.int64).reshape(-1, 2)
    order = np.lexsort((sizes[:, 1], sizes[:, 0] // STEP_WORDS))
    at = 0
    while at < len(order):
        stop, widest = at, 0
        while stop < len(order):
            widest = max(widest, int(sizes[order[stop], 0]))
            if stop > at and (stop + 1 - at) * (widest + 1) > BATCH_CELLS:
                break
            stop += 1
        group = order[at:stop]
        out[group] = _aligned([coded[k] for k in group], sizes[group])
        at = stop
    return out


def _aligned(pairs: list[tuple], sizes: np.ndarray) -> np.ndarray:
    """A cell is one number: its cost, two bits for the step that led to it, its deletions.

    The least of the three steps is then the cheapest, and of equal costs the one
    preferred; the step's bits are cleared behind it. Insertions follow from the
    place of the cell, since deletions less insertions are i - j.
    """
    n, m = (int(x) for x in sizes.max(axis=0))
    kind, bits = (np.int32, 14) if max(n, m) < 1 << 14 else (np.int64, 30)
    cost, keep = 1 << bits + 2, ~(3 << bits)
    delete, insert = cost + (1 << bits) + 1, cost + (2 << bits)
    # Second axis: the pairs, so that what a diagonal reads and writes lies together.
    ref, hyp = np.full((n, len(pairs)), -1, np.int32), np.full((m, len(pairs)), -2, np.int32)
    for k, (a, b) in enumerate(pairs):
        ref[: len(a), k], hyp[: len(b), k] = a, b
    hyp = hyp[::-1]
    ends = sizes.sum(axis=1)
    last = np.zeros(len(pairs), np.int64)
    # Row i of diagonal d is cell (i, d - i).
    older, newer, cell, spare = (np.zeros((n + 1, len(pairs)), kind) for _ in range(4))
    for d in range(1, n + m + 1):
        if d <= m:
            cell[0] = d * cost
        if d <= n:
            cell[d] = d * (cost + 1)
        low, high = max(1, d - m), min(n, d - 1)
        if low <= high:
            best, other = cell[low : high + 1], spare[low : high + 1]
            np.multiply(ref[low - 1 : high] != hyp[m - d + low : m - d + high + 1], cost, out=best, dtype=kind)
            best += older[low - 1 : high]
            np.minimum(best, np.add(newer[low - 1 : high], delete, out=other), out=best)
            np.minimum(best, np.add(newer[low : high + 1], insert, out=other), out=best)
            best &= keep
        older, newer, cell = newer, cell, older
        done = np.flatnonzero(ends == d)
        last[done] = newer[sizes[done, 0], done]
    deleted = last & ((1 << bits) - 1)
    inserted = deleted - (sizes[:, 0] - sizes[:, 1])
    return np.stack([(last >> bits + 2) - deleted - inserted, deleted, inserted], axis=1)


def edit_counts(ref, hyp) -> tuple[int, int, int]:
    """The counts of one pair."""
    return tuple(int(x) for x in batch_counts([(ref, hyp)])[0])


@F.pandas_udf(WER)
def wer_counts(ref: pd.Series, hyp: pd.Series) -> pd.DataFrame:
    """S, D, I and N per pair of token arrays; nulls where either side is null."""
    both = [i for i, (r, h) in enumerate(zip(ref, hyp)) if r is not None and h is not None]
    pairs = [(ref.iloc[i], hyp.iloc[i]) for i in both]
    out = pd.DataFrame(index=range(len(ref)), columns=["S", "D", "I", "N"], dtype="Int64")
    if pairs:
        out.loc[both, ["S", "D", "I"]] = batch_counts(pairs)
        out.loc[both, "N"] = [len(r) for r, _ in pairs]
    return out
