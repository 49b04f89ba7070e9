"""Sampled segmentation over the lattice of pieces of a SentencePiece vocabulary.

Forward filtering, backward sampling: a forward pass sums the weight of all segmentations of every prefix of a word; a backward pass
draws the last piece in proportion to its share, then the one before it, until the word is used up. Draws are seeded by the row's
key and the word's place in the row, so a row has the same segmentation in any batch, on any executor and in any retry.

No piece reaches over the start of a run of spaces, so the lattice of a text falls apart into words; the forward pass is done once
for the distinct words of a batch, all words advancing together in NumPy. Characters without a piece become byte pieces, as does a
literal U+2581, which inside pieces stands for a space: decoding gives back every text.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import cache
from itertools import chain

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType, StringType

from scribelake.llm.common import crc_of, mixed

SPACE = 0x2581
LITERAL = 0x110000  # no character: stands for a literal U+2581 while matching
_WORD = re.compile(r" +[^ ]*")
#: Characters of text segmented together. Memory grows with them; below a third of this, words are met again too often.
CHUNK_CHARS = 800_000


def _spelling(model) -> tuple[list[int], list[bytes]]:
    """The ids of pieces of text, and the bytes that each id of the model stands for (none for control pieces)."""
    n = model.get_piece_size()
    plain = [i for i in range(n) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))]
    # Pieces with a space behind another character would reach over two words.
    plain = [i for i in plain if "▁" not in model.id_to_piece(i).lstrip("▁")]
    bytes_of = [b""] * n
    for i in plain:
        bytes_of[i] = model.id_to_piece(i).replace("▁", " ").encode()
    for i in range(n):
        if model.is_byte(i):
            bytes_of[i] = bytes([int(model.id_to_piece(i)[3:5], 16)])
    return plain, bytes_of


def _text(ids, bytes_of: list[bytes]) -> str:
    """The text of a segmentation."""
    return b"".join([bytes_of[i] for i in ids]).decode("utf-8", "replace")[1:]


class Pieces:
    """A vocabulary as a trie, with the log-weight of each piece.

    Unigram models have log-probabilities as scores. The scores of BPE models are merge ranks; rank r weighs 1 / (r + 2), after
    Zipf. ``sharpness`` multiplies log-weights: larger values favour few, frequent pieces.
    """

    def __init__(self, path: str, sharpness: float = 1.0):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        n = model.get_piece_size()
        plain, self.bytes_of = _spelling(model)
        score = np.array([model.get_score(i) for i in range(n)])
        self.weight = sharpness * (score if score.min() > -1000 else -np.log(2.0 - score))
        self.byte_ids = np.full(256, -1, np.int64)
        for i in range(n):
            if model.is_byte(i):
                self.byte_ids[int(model.id_to_piece(i)[3:5], 16)] = i
        # Byte pieces are the way out for any character, so they weigh less than every piece.
        self.byte_weight = float(self.weight[plain].min()) - sharpness
        nodes: dict[int, int] = {}
        ends = {}
        for i in plain:
            at = 0
            for c in model.id_to_piece(i):
                at = nodes.setdefault((at << 21) | ord(c), len(nodes) + 1)
            ends[at] = i
        keys = np.fromiter(nodes, np.int64, len(nodes))
        order = np.argsort(keys)
        self.keys, self.to = keys[order], np.fromiter(nodes.values(), np.int64, len(nodes))[order]
        # First steps, by character: every place of every word begins there.
        self.root = np.zeros(LITERAL + 1, np.int32)
        self.root[self.keys[self.keys < 1 << 21]] = self.to[self.keys < 1 << 21]
        self.piece = np.full(len(nodes) + 1, -1, np.int64)
        self.piece[list(ends)] = list(ends.values())

    def _edges(self, code: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """All pieces that match: start, length, id; id -1 is a character in bytes."""
        live = np.flatnonzero(self.root[code])
        node = self.root[code[live]].astype(np.int64)
        starts, sizes, ids, step = [], [], [], 1
        while True:
            found = self.piece[node]
            ok = found >= 0
            starts.append(live[ok])
            sizes.append(np.full(int(ok.sum()), step, np.int64))
            ids.append(found[ok])
            more = live + step < stop[live]
            live, node = live[more], node[more]
            if not len(live):
                break
            key = (node << 21) | code[live + step]
            at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            hit = self.keys[at] == key
            live, node = live[hit], self.to[at[hit]]
            step += 1
        single = np.zeros(len(code), bool)
        single[starts[0]] = True
        lone = np.flatnonzero(~single)
        return np.concatenate([*starts, lone]), np.concatenate([*sizes, np.ones(len(lone), np.int64)]), np.concatenate([*ids, np.full(len(lone), -1)])

    def segment(self, texts: list[str], seeds: np.ndarray) -> list[np.ndarray]:
        """Ids of each text, drawn by its seed."""
        # A word is named without the space it begins with.
        cut = [[] if not t else t.split(" ") if "  " not in t and t[0] != " " and t[-1] != " " else [w[1:] for w in _WORD.findall(" " + t)] for t in texts]
        words = dict.fromkeys(chain.from_iterable(cut))
        if not words:
            return [np.zeros(0, np.int32) for _ in texts]
        words = dict(zip(words, range(len(words))))
        per_row = np.array([len(ws) for ws in cut], np.int64)
        word = np.fromiter(map(words.__getitem__, chain.from_iterable(cut)), np.int64, int(per_row.sum()))
        code = np.frombuffer("".join([" " + w for w in words]).encode("utf-32-le"), np.uint32).astype(np.int64)
        literal = code == SPACE
        code[code == 0x20] = SPACE
        code[literal] = LITERAL
        size = np.fromiter(map(len, words), np.int64, len(words)) + 1
        begin = np.concatenate(([0], np.cumsum(size)))
        of = np.repeat(np.arange(len(words)), size)
        # Node of a place in a word: words have one place more than characters.
        start, length, piece = self._edges(code, begin[1:][of])
        own = of[start]
        source, target = start + own, start + length + own
        weight = np.where(piece >= 0, self.weight[piece], self.byte_weight)
        place = start + length - begin[own]
        # By place, then target, long pieces first; one number sorts faster than three columns.
        most = int(length.max()) + 1
        order = np.argsort((place * (len(code) + len(words)) + target) * most + most - length)
        source, target, weight, place, piece, start = (x[order] for x in (source, target, weight, place, piece, start))
        # Forward: places in rising order, all words at once.
        total = np.full(len(code) + len(words), -np.inf)
        total[begin[:-1] + np.arange(len(words))] = 0.0
        bounds = np.concatenate(([0], np.flatnonzero(np.diff(place)) + 1, [len(place)]))
        head = np.concatenate(([True], np.diff(target) != 0)) if len(target) else np.zeros(0, bool)
        share = np.empty(len(weight))
        for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
            into = total[source[a:b]] + weight[a:b]
            at = np.flatnonzero(head[a:b])
            summed = np.logaddexp.reduceat(into, at)
            total[target[a:b][at]] = summed
            share[a:b] = np.exp(into - np.repeat(summed, np.diff(np.append(at, b - a))))
        # Cumulated shares of the edges into each node, added node by node so that they do not depend on the batch.
        first = np.flatnonzero(head)
        sizes = np.diff(np.append(first, len(head)))
        for k in range(1, int(sizes.max())):
            at = first[sizes > k] + k
            share[at] += share[at - 1]
        share[first + sizes - 1] = 1.0
        group_of = np.full(len(total), -1, np.int64)
        group_of[target[first]] = np.arange(len(first))
        # Backward: one piece per step for every word that is not used up.
        row = np.repeat(np.arange(len(texts)), per_row)
        nth = np.arange(len(word)) - np.repeat(np.cumsum(per_row) - per_row, per_row)
        key = mixed(seeds[row] ^ mixed(nth.astype(np.uint64) + np.uint64(1)))
        home = begin[:-1][word] + word
        # In the order of words, so that lookups run through the shares instead of jumping about in them.
        live, step = np.argsort(word.astype(np.int32), kind="stable"), 0
        node = (home + size[word])[live]
        drawn_by, drawn = [], []
        while len(live):
            u = (mixed(key[live] + np.uint64(step)) >> np.uint64(11)).astype(np.float64) / (1 << 53)
            edge = first[group_of[node]]
            # Long pieces come first and hold most of the weight, so few draws go on to the next.
            on = np.flatnonzero(share[edge] <= u)
            while len(on):
                edge[on] += 1
                on = on[share[edge[on]] <= u[on]]
            drawn_by.append(live)
            drawn.append(edge)
            node = source[edge]
            more = node != home[live]
            live, node = live[more], node[more]
            step += 1
        by, edge = np.concatenate(drawn_by), np.concatenate(drawn)
        count = np.bincount(by, minlength=len(word))
        # Step s of a word was drawn s-th from its end.
        back = np.concatenate([np.full(len(x), s, np.int64) for s, x in enumerate(drawn_by)])
        slot = np.cumsum(count)[by] - 1 - back
        line = np.empty(len(edge), np.int64)
        line[slot] = edge
        ids, word_ids = piece[line], np.repeat(np.arange(len(word)), count)
        lone = np.flatnonzero(ids < 0)
        if len(lone):
            spelled = [self.byte_ids[list(chr(SPACE if c == LITERAL else c).encode())] for c in code[start[line[lone]]].tolist()]
            width = np.ones(len(ids), np.int64)
            width[lone] = [len(x) for x in spelled]
            out = np.repeat(ids, width)
            out[out < 0] = np.concatenate(spelled)
            ids, word_ids = out, np.repeat(word_ids, width)
        ends = np.cumsum(np.bincount(row[word_ids], minlength=len(texts)))
        return np.split(ids.astype(np.int32), ends[:-1])

    def join(self, ids) -> str:
        """The text of a segmentation."""
        return _text(ids, self.bytes_of)


_LOADED: dict[tuple[str, float], Pieces] = {}


def loaded(path: str, sharpness: float) -> Pieces:
    """One vocabulary per Python worker."""
    if (path, sharpness) not in _LOADED:
        _LOADED[path, sharpness] = Pieces(path, sharpness)
    return _LOADED[path, sharpness]


@cache
def spelling(path: str) -> list[bytes]:
    """The bytes of each id, without the trie that drawing needs."""
    import sentencepiece

    return _spelling(sentencepiece.SentencePieceProcessor(model_file=path))[1]


def drawn(keys: pd.Series, texts: pd.Series, path: str, sharpness: float) -> pd.Series:
    """Ids of a batch of texts, segmented in chunks of bounded size; null for null."""
    pieces = loaded(path, sharpness)
    plain = [t or "" for t in texts]
    seeds = mixed(keys.to_numpy(np.int64).view(np.uint64))
    out, at, held = [], 0, 0
    for i, t in enumerate(plain):
        held += len(t)
        if held >= CHUNK_CHARS or i == len(plain) - 1:
            out += pieces.segment(plain[at : i + 1], seeds[at : i + 1])
            at, held = i + 1, 0
    return pd.Series([x if isinstance(t, str) else None for t, x in zip(texts, out)], dtype=object, index=texts.index)


def encoded(key: Column, text: Column, path: str, sharpness: float = 1.0) -> Column:
    """Sampled ids of a text column; null stays null, an empty text has no ids. ``key`` is a bigint that seeds the row."""

    @F.pandas_udf(ArrayType(IntegerType()))
    def of(keys: pd.Series, texts: pd.Series) -> pd.Series:
        return drawn(keys, texts, path, sharpness)

    return of(key, text)


def decoded(ids: Column, path: str) -> Column:
    """The text of an ids column."""

    @F.pandas_udf(StringType())
    def of(rows: pd.Series) -> pd.Series:
        bytes_of = spelling(path)
        return pd.Series([None if r is None else _text(np.asarray(r).tolist(), bytes_of) for r in rows], dtype=object)

    return of(ids)


def ids_crc32(ids: Column) -> Column:
    """CRC-32 of ids as little-endian unsigned 32-bit integers; null for null."""

    @F.pandas_udf(LongType())
    def of(rows: pd.Series) -> pd.Series:
        return pd.Series([None if r is None else crc_of(np.asarray(r)) for r in rows], dtype="Int64")

    return of(ids)


def segmentations(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", seed: int = 0, sharpness: float = 1.0) -> DataFrame:
    """``id, text, ids`` for every row of ``docs``. The row key is the id (as text) and the seed; rows that repeat an id draw alike.

    A step of its own, so that whatever reads ``ids`` does not draw them again.
    """
    key = F.xxhash64(F.lit(seed), F.coalesce(F.col(id_col).cast("string"), F.lit("")))
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), key.alias("key"))

    def draw(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            ids = drawn(batch["key"], batch["text"], path, sharpness)
            yield pd.DataFrame({"id": batch["id"], "text": batch["text"], "ids": ids})

    return rows.mapInPandas(draw, f"id {docs.schema[id_col].dataType.simpleString()}, text string, ids array<int>")
