"""Language identification by cross-parsing entropy.

For each language a suffix automaton is built over labelled text. A text is parsed against it greedily: the longest match from the
current place is one phrase, the next begins behind it (Ziv and Merhav, 1993). The language that needs fewest phrases per symbol
wins. Texts are lower-cased; letters are symbols, each run of other characters is one blank. Every letter of every language's sample
is a symbol of its own; a language's table is over the symbols of its own text, and sparse if these are many.

Learning uses a bounded sample: of each of the ``max_languages`` most frequent labels the ``sample_docs`` learnable documents with the
least hash, of each at most ``doc_symbols`` symbols, together at most ``train_symbols``. Every prediction reads the whole text. The
parse starts anew every ``SEGMENT`` symbols, so a text of any length is many short lanes that advance together in NumPy.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from scribelake.llm.common import held_out

SEGMENT = 512
SAMPLE_DOCS = 64
DOC_SYMBOLS = 2_000
TRAIN_SYMBOLS = 24_000
MAX_LANGUAGES = 200
#: Bytes of all automata together; with many languages each learns from less text.
TABLE_BYTES = 64 << 20
#: Symbols of a language up to which its table is dense, and about how many bytes a symbol of its text takes in a sparse one.
DENSE_WIDTH = 128
SPARSE_BYTES = 64
UNKNOWN = "und"
#: Phrases per symbol above which no learnt language is taken to fit, for filtering.
MAX_RATE = 0.6
#: Characters a text must have to be judged by its rate: the first phrase counts in full, so short clean texts have high rates.
JUDGED_CHARS = 60

_LETTER = re.compile(r"[^\W\d_]")


def suffix_automaton(symbols: np.ndarray) -> list[dict[int, int]]:
    """Transitions of the automaton of all substrings; state 0 is the empty string."""
    step, link, length = [{}], [-1], [0]
    last = 0
    for c in symbols.tolist():
        new = len(step)
        step.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p >= 0 and c not in step[p]:
            step[p][c] = new
            p = link[p]
        if p >= 0:
            q = step[p][c]
            if length[q] == length[p] + 1:
                link[new] = q
            else:
                twin = len(step)
                step.append(dict(step[q]))
                length.append(length[p] + 1)
                link.append(link[q])
                while p >= 0 and step[p].get(c) == q:
                    step[p][c] = twin
                    p = link[p]
                link[q] = link[new] = twin
        last = new
    return step


def parse_table(step: list[dict[int, int]], width: int) -> np.ndarray:
    """The automaton as a flat table of ``(next state * width) * 2 + 1 if a phrase ended``; the last symbol is padding.

    Where a match cannot go on, the symbol opens the next phrase. A symbol that the language lacks is a phrase of its own: it leads to
    one more state, from which every symbol opens a phrase. State 0 is the start only.
    """
    alone = len(step)
    opened = np.full(width, alone, np.int64)
    for c, to in step[0].items():
        opened[c] = to
    table = np.tile(opened * width * 2 + 1, (len(step) + 1, 1))
    table[0] -= 1
    for s, moves in enumerate(step):
        for c, to in moves.items():
            table[s, c] = to * width * 2
    table[:, width - 1] = np.arange(len(step) + 1) * width * 2
    return table.ravel().astype(np.int32 if table.max() < 1 << 31 else np.int64)


class Dense:
    """A parse table that is looked up by place."""

    def __init__(self, step: list[dict[int, int]], width: int):
        self.table = parse_table(step, width)
        self.dtype = self.table.dtype

    def moved(self, state: np.ndarray, symbol: np.ndarray) -> np.ndarray:
        return self.table.take(state + symbol)


class Sparse:
    """The same moves from the automaton's transitions only, found by bisection."""

    dtype = np.dtype(np.int64)

    def __init__(self, step: list[dict[int, int]], width: int):
        moves = sorted((s * width + c, to) for s, row in enumerate(step) for c, to in row.items())
        # The last key is above all others, so a place behind the rest can be read.
        self.keys = np.array([k for k, _ in moves] + [(len(step) + 2) * width], np.int64)
        self.to = np.array([to for _, to in moves] + [0], np.int64) * width * 2
        self.opened = np.full(width, len(step), np.int64)
        self.opened[list(step[0])] = list(step[0].values())
        self.opened *= width * 2

    def moved(self, state: np.ndarray, symbol: np.ndarray) -> np.ndarray:
        key = state + symbol
        at = np.searchsorted(self.keys, key)
        return np.where(self.keys[at] == key, self.to[at], self.opened[symbol] + (state != 0))


@dataclass
class Model:
    """Letters, and per language the text it was learnt from; automata are built once per Python worker."""

    letters: str
    languages: list[str]
    texts: list[str]

    def _prepare(self) -> None:
        if "_lookup" in self.__dict__:
            return
        # 0 is blank, then the letters, then any other letter, then padding.
        n = len(self.letters)
        lookup = np.zeros(0x110000, np.int32)
        lookup[[i for i in range(0x110000) if chr(i).isalpha()]] = n + 1
        lookup[[ord(c) for c in self.letters]] = np.arange(1, n + 1)
        self.__dict__.update(_lookup=lookup, _width=n + 3)
        self.__dict__["_tables"] = [self._table(self.symbols(t)) for t in self.texts]

    def _table(self, symbols: np.ndarray) -> tuple[np.ndarray, Dense | Sparse]:
        """A language's own symbols (all it lacks are one, behind them; then padding), and its moves."""
        own = np.unique(symbols)
        to_own = np.full(self._width, len(own), np.int32)
        to_own[own] = np.arange(len(own))
        to_own[self._width - 1] = len(own) + 1
        kind = Dense if len(own) + 2 <= DENSE_WIDTH else Sparse
        return to_own, kind(suffix_automaton(to_own[symbols]), len(own) + 2)

    def symbols(self, text: str) -> np.ndarray:
        found = self._lookup[np.frombuffer(text.lower().encode("utf-32-le", "replace"), np.uint32)]
        blank = found == 0
        return found[~(blank & np.concatenate(([True], blank[:-1])))] if len(found) else found

    def phrases(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Phrases of each text (row) in each language (column), and symbols of each text."""
        self._prepare()
        rows = [self.symbols(t) for t in texts]
        sizes = np.array([len(r) for r in rows], np.int64)
        lanes = -(-sizes // SEGMENT)
        of = np.repeat(np.arange(len(rows)), lanes)
        total = np.zeros((len(rows), len(self.texts)), np.int64)
        for at in range(0, len(of), 8192):
            own = of[at : at + 8192]
            grid = np.full((len(own), SEGMENT), self._width - 1, np.int32)
            first = at - np.concatenate(([0], np.cumsum(lanes)))[own]
            for k, (r, f) in enumerate(zip(own.tolist(), first.tolist())):
                part = rows[r][(f + k) * SEGMENT : (f + k + 1) * SEGMENT]
                grid[k, : len(part)] = part
            # Longest lanes first: those still running at a step are a prefix.
            used = (grid != self._width - 1).sum(axis=1)
            order = np.argsort(-used, kind="stable")
            steps, own, used = np.ascontiguousarray(grid[order].T), own[order], used[order]
            running = np.searchsorted(-used, -np.arange(SEGMENT), "left")
            for j, (to_own, table) in enumerate(self._tables):
                mine = to_own[steps]
                state, count = np.zeros(len(own), table.dtype), np.ones(len(own), np.int32)
                for t in range(int(used[0]) if len(used) else 0):
                    n = int(running[t])
                    moved = table.moved(state[:n], mine[t, :n])
                    count[:n] += moved & 1
                    state[:n] = moved >> 1
                total[:, j] += np.bincount(own, count, len(rows)).astype(np.int64)
        return total, sizes

    def predict(self, texts) -> pd.DataFrame:
        texts = [t or "" for t in texts]
        count, sizes = self.phrases(texts)
        known = np.array([bool(_LETTER.search(t)) for t in texts]) & (len(self.texts) > 0)
        out = pd.DataFrame({"lang_pred": [UNKNOWN] * len(texts), "score": 0.0, "rate": 1.0})
        if len(self.texts):
            best = count.argmin(axis=1)
            weight = (count.min(axis=1)[:, None] / np.maximum(count, 1)) ** 4.0
            out.loc[known, "lang_pred"] = np.array(self.languages, object)[best[known]]
            out.loc[known, "score"] = (1 / np.maximum(weight.sum(axis=1), 1.0))[known]
            out.loc[known, "rate"] = (count.min(axis=1) / np.maximum(sizes, 1))[known]
        return out

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if not k.startswith("_")}


_BUILT: dict[tuple, Model] = {}


def built(model: Model) -> Model:
    """One set of automata per Python worker, whatever the number of batches."""
    key = (model.letters, *model.languages, *model.texts)
    if key not in _BUILT:
        _BUILT.clear()
        _BUILT[key] = model
    return _BUILT[key]


def train(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    lang_col: str = "lang",
    sample_docs: int = SAMPLE_DOCS,
    doc_symbols: int = DOC_SYMBOLS,
    train_symbols: int = TRAIN_SYMBOLS,
    max_languages: int = MAX_LANGUAGES,
) -> Model:
    """Learn from text and non-null label of documents that are not held out."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang"))
    learn = rows.where(~held_out("id")).where("lang IS NOT NULL AND text IS NOT NULL AND length(text) > 0")
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.xxhash64("text"), "id"))
    # Ranked inside each task first (a window group limit), so few rows per language are exchanged.
    picked = learn.withColumn("rank", rank).where(F.col("rank") <= sample_docs)
    shown = picked.select("lang", "rank", F.substring("text", 1, 2 * doc_symbols).alias("text"))
    often = learn.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(max_languages).select("lang")
    got = shown.join(often, "lang").orderBy("lang", "rank").collect()
    by_lang: dict[str, list[str]] = {}
    for r in got:
        by_lang.setdefault(r["lang"], []).append(r["text"].lower()[: 2 * doc_symbols])
    alphabets = [{c for t in ts for c in t if c.isalpha()} for ts in by_lang.values()]
    widths = [len(x) + 4 for x in alphabets]
    each = max(500, min(train_symbols, TABLE_BYTES // max(1, sum(w * 4 * 2 if w <= DENSE_WIDTH else SPARSE_BYTES for w in widths))))
    texts = []
    for ts in by_lang.values():
        plain = [re.sub(r"[\W\d_]+", " ", t)[:doc_symbols] for t in ts]
        texts.append(" ".join(plain)[:each])
    return Model("".join(sorted(set().union(*alphabets))), list(by_lang), texts)


def predicted(model: Model, text: Column) -> Column:
    """A struct ``lang_pred, score, rate`` for a text column."""
    kind = StructType([StructField("lang_pred", StringType()), StructField("score", DoubleType()), StructField("rate", DoubleType())])

    @F.pandas_udf(kind)
    def of(texts: pd.Series) -> pd.DataFrame:
        return built(model).predict(texts)

    return of(text)


def languages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """``id, held_out, lang_pred, score, rate`` for every row of ``docs``.

    ``und`` if the text is null or has no letter, or nothing could be learnt. Ties go to the language first in order. ``score`` is
    the winner's share of inverse phrase counts (to the fourth power), ``rate`` its phrases per symbol. Repeated rows and null ids
    are rows like any other.
    """
    model = train(docs, id_col, text_col, lang_col)
    out = docs.select(F.col(id_col).alias("id"), predicted(model, F.col(text_col)).alias("p"))
    return out.select("id", held_out("id").alias("held_out"), "p.lang_pred", "p.score", "p.rate")


def accepted(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", max_rate: float = MAX_RATE) -> DataFrame:
    """The rows of ``docs`` whose text has a letter and, if it is long enough to tell, fits a learnt language; with their columns.

    A language that shares most of its letter sequences with a learnt one fits it too: this drops noise, not every unlabelled language.
    """
    model = train(docs, id_col, text_col, lang_col)
    found = predicted(model, F.col(text_col))
    fits = (found["rate"] <= max_rate) | (F.length(text_col) < JUDGED_CHARS)
    return docs.where(F.when(found["lang_pred"] == UNKNOWN, False).otherwise(fits))
