"""Packing token sequences by best fit and swap-based local search.

Documents become pieces of at most ``capacity`` tokens. Full pieces are sequences by themselves; the others are dealt by a hash into
buckets of about ``bucket_rows`` pieces, and each bucket is packed by itself: best fit, longest first, then exchanges between
underfull bins. An exchange moves a document, swaps one for one, or one for two, always from the emptiest bin that can still give
to a bin that gets fuller, so the sum of squared fills rises; bins that run empty are gone. A bucket wastes less than one bin more
than its lower bound in practice, and tokens themselves are never shuffled.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scribelake.llm.token_ids import encoder
from scribelake.session import checkpointed

CAPACITY = 1024
END_ID = 2
BUCKET_ROWS = 20_000


def pieces(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """``id, piece, start, length, ids_crc32``: pieces of every document; a null text has the end id only.

    Only documents longer than ``capacity`` are cut; their first piece takes what does not fill a sequence.
    """
    end = np.array([end_id], "<u4").tobytes()

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        enc = encoder(tokenizer)
        for batch in batches:
            out = []
            for id_, text in zip(batch["id"], batch["text"]):
                ids = enc.encode(text or "") + end
                n = len(ids) // 4
                first = n if n <= capacity else (n % capacity or capacity)
                bounds = [0, *range(first, n + 1, capacity)]
                out += [(id_, k, a, b - a, zlib.crc32(ids[4 * a : 4 * b])) for k, (a, b) in enumerate(zip(bounds, bounds[1:]))]
            yield pd.DataFrame(out, columns=["id", "piece", "start", "length", "ids_crc32"])

    kind = docs.schema[id_col].dataType.simpleString()
    plain = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return plain.mapInPandas(cut, f"id {kind}, piece int, start bigint, length bigint, ids_crc32 bigint")


def best_fit(lengths: np.ndarray, capacity: int) -> list[list[int]]:
    """Bins of item numbers: items in falling length, each into the bin it fills best."""
    by_gap: list[list[int]] = [[] for _ in range(capacity + 1)]
    bins: list[list[int]] = []
    open_gaps = 0  # bit g: some bin has gap g
    for i in np.argsort(-lengths, kind="stable").tolist():
        need = int(lengths[i])
        fits = open_gaps >> need
        if fits:
            gap = need + (fits & -fits).bit_length() - 1
            at = by_gap[gap].pop()
            if not by_gap[gap]:
                open_gaps ^= 1 << gap
            bins[at].append(i)
        else:
            gap, at = capacity, len(bins)
            bins.append([i])
        left = gap - need
        if left:
            by_gap[left].append(at)
            open_gaps |= 1 << left
    return bins


class _Search:
    """Local search over the underfull bins of one bucket."""

    def __init__(self, lengths: np.ndarray, bins: list[list[int]], capacity: int):
        self.lengths, self.bins, self.capacity = lengths, bins, capacity
        self.fill = np.array([int(lengths[b].sum()) for b in bins], np.int64)
        self.of = np.empty(len(lengths), np.int64)
        for k, b in enumerate(bins):
            self.of[b] = k
        self.pairs = None

    def _shift(self, give: list[int], take: list[int], source: int, target: int) -> None:
        for i in give:
            self.bins[source].remove(i)
            self.bins[target].append(i)
            self.of[i] = target
        for i in take:
            self.bins[target].remove(i)
            self.bins[source].append(i)
            self.of[i] = source
        self.pairs = None
        moved = int(self.lengths[give].sum() - (self.lengths[take].sum() if take else 0))
        self.fill[source] -= moved
        self.fill[target] += moved

    def _move(self, source: int, i: int) -> bool:
        gaps = self.capacity - self.fill
        fits = np.flatnonzero((gaps >= self.lengths[i]) & (self.fill > 0))
        fits = fits[(fits != source) & (self.fill[fits] + self.lengths[i] > self.fill[source])]
        if not len(fits):
            return False
        self._shift([i], [], source, int(fits[np.argmin(gaps[fits])]))
        return True

    def _swap(self, source: int, give: list[int]) -> bool:
        """Give one or two items for one: the exchange that moves most."""
        weight = int(self.lengths[give].sum())
        gaps = (self.capacity - self.fill)[self.of]
        gain = weight - self.lengths
        ok = (gain > 0) & (gain <= gaps) & (self.of != source) & (self.fill[self.of] + gain > self.fill[source])
        if not ok.any():
            return False
        take = int(np.argmax(np.where(ok, gain, 0)))
        self._shift(give, [take], source, int(self.of[take]))
        return True

    def _neighbours(self) -> tuple[np.ndarray, np.ndarray]:
        """Pairs of items next to each other in length inside a bin; kept until something moves."""
        if self.pairs is None:
            order = np.lexsort((self.lengths, self.of))
            same = self.of[order[:-1]] == self.of[order[1:]]
            self.pairs = order[:-1][same], order[1:][same]
        return self.pairs

    def _swap_for_two(self, source: int, i: int) -> bool:
        a, b = self._neighbours()
        target = self.of[a]
        gain = int(self.lengths[i]) - self.lengths[a] - self.lengths[b]
        ok = (gain > 0) & (gain <= self.capacity - self.fill[target]) & (target != source) & (self.fill[target] + gain > self.fill[source])
        if not ok.any():
            return False
        best = int(np.argmax(np.where(ok, gain, 0)))
        self._shift([i], [int(a[best]), int(b[best])], source, int(target[best]))
        return True

    def _improve(self, source: int) -> bool:
        held = sorted(self.bins[source], key=lambda j: (-self.lengths[j], j))
        return (
            any(self._move(source, i) for i in held)
            or any(self._swap(source, [i]) for i in held)
            or any(self._swap(source, [i, j]) for k, i in enumerate(held[:32]) for j in held[k + 1 : 32])
            or any(self._swap_for_two(source, i) for i in held)
        )

    def run(self) -> list[list[int]]:
        """Sweep over the underfull bins, emptiest first, until a sweep changes nothing or no fewer bins can do."""
        least, changed = math.ceil(int(self.lengths.sum()) / self.capacity), True
        while changed:
            changed = False
            for source in np.argsort(self.fill, kind="stable").tolist():
                if int((self.fill > 0).sum()) <= least:
                    return [b for b in self.bins if b]
                while 0 < self.fill[source] < self.capacity and self._improve(source):
                    changed = True
        return [b for b in self.bins if b]


def pack_bucket(lengths: np.ndarray, capacity: int = CAPACITY) -> list[list[int]]:
    return _Search(lengths, best_fit(lengths, capacity), capacity).run()


def packed(
    docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, bucket_rows: int = BUCKET_ROWS
) -> DataFrame:
    """``id, piece, start, length, ids_crc32, sequence_id, offset`` for every piece of every row of ``docs``.

    Sequences hold at most ``capacity`` tokens without gaps. Repeated rows and null ids are packed like any other rows; an empty
    input gives an empty result. Other columns are not read.
    """
    rows = checkpointed(pieces(docs, tokenizer, id_col, text_col, capacity)).withColumn("row", F.monotonically_increasing_id())
    whole = rows.where(F.col("length") == capacity).withColumn("sequence_id", F.col("row")).withColumn("offset", F.lit(0).cast("bigint"))
    part = rows.where(F.col("length") < capacity)
    buckets = max(1, math.ceil(part.count() / bucket_rows))
    dealt = part.withColumn("bucket", F.pmod(F.xxhash64("row"), F.lit(buckets)))

    def fit(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("row", kind="stable").reset_index(drop=True)
        lengths = group["length"].to_numpy(np.int64)
        sequence, offset = np.zeros(len(group), np.int64), np.zeros(len(group), np.int64)
        first = int(group["bucket"].iloc[0]) << 32
        for k, items in enumerate(pack_bucket(lengths, capacity)):
            sequence[items] = -1 - first - k  # below zero: never the number of a full piece
            offset[items] = np.cumsum(lengths[items]) - lengths[items]
        return pd.DataFrame({"row": group["row"], "sequence_id": sequence, "offset": offset})

    # A fixed number of partitions: small as the rows are, a bucket is seconds of work and should not share its task with many.
    spread = dealt.select("row", "length", "bucket").repartition(min(buckets, 8192), "bucket")
    placed = spread.groupBy("bucket").applyInPandas(fit, "row bigint, sequence_id bigint, offset bigint")
    return whole.unionByName(part.join(placed, "row")).drop("row")
