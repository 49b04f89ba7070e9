"""Toxicity by non-negative positive-unlabelled learning.

A document is a set of hashed features: its words and the first 4, 5 and 6 letters of each word, and which of these are dense in it. Features that occur in confirmed
toxic examples far more often than elsewhere are found by counting over all learnable documents; a linear model over the presence of
these is trained with NumPy from confirmed toxic examples and unlabelled text. The risk corrects the unlabelled part by the class
prior and never lets it fall below zero (Kiryo et al., 2017). Negative labels serve for nothing but the prior.

The model is fitted on a bounded sample: about ``max_positive`` toxic and ``max_unlabelled`` other documents, those with the least
hashes, one of each text. Counting, too, covers this sample only; scoring covers every whole text.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from scribelake.llm.common import held_out, mixed
from scribelake.session import checkpointed

BITS = 20
PREFIXES = (4, 5, 6)
#: Occurrences per 1000 words from which two or more count as dense.
DENSE = 7
MAX_POSITIVE = 6_000
MAX_UNLABELLED = 18_000
MAX_FEATURES = 4_096
THRESHOLD = 0.7
DECAY = 2e-5


def _levels(states: np.ndarray, kind: int, words: int) -> np.ndarray:
    """Features of hashed prefixes: that they occur, and that they occur repeatedly and densely."""
    value, times = np.unique(states, return_counts=True)
    dense = value[(times >= 2) & (1000 * times >= DENSE * words)]
    # `kind` keeps prefixes apart from whole words, and both apart from their dense forms.
    return np.concatenate([mixed(value ^ np.uint64(kind)), mixed(dense ^ np.uint64(kind | 64))])


def features(text: str | None) -> np.ndarray:
    """Distinct feature numbers of a whole text, sorted. Words are runs of letters (ASCII, and all from U+00C0 on), lower-cased."""
    code = np.frombuffer((text or "").lower().encode("utf-32-le", "replace"), np.uint32)
    letter = np.concatenate(([False], ((code >= 97) & (code <= 122)) | (code >= 0xC0), [False]))
    edge = np.flatnonzero(letter[1:] != letter[:-1])
    first, size = edge[0::2], edge[1::2] - edge[0::2]
    if not len(first):
        return np.zeros(0, np.int64)
    # A prefix's hash is a polynomial over its letters: the same for all words that begin with it.
    state, found, whole = np.zeros(len(first), np.uint64), [], []
    live, step = np.arange(len(first)), 0
    while len(live):
        state[live] = (state[live] + code[first[live] + step].astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
        step += 1
        if step in PREFIXES:
            found.append(_levels(state[live], step, len(first)))
        done = size[live] == step
        if done.any():
            whole.append(state[live[done]])
            live = live[~done]
    found.append(_levels(np.concatenate(whole), 0, len(first)))
    return np.unique(np.concatenate(found) >> np.uint64(64 - BITS)).astype(np.int64)


@dataclass
class Model:
    """``weights[f]`` for chosen features, zero elsewhere."""

    chosen: np.ndarray
    weights: np.ndarray
    bias: float

    def score(self, texts) -> np.ndarray:
        """Probabilities; the same model is a dense table inside a task."""
        table = np.zeros(1 << BITS)
        table[self.chosen] = self.weights
        logit = np.array([self.bias + table[features(t)].sum() for t in texts])
        return 1 / (1 + np.exp(-np.clip(logit, -30, 30)))


def sample(
    docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, max_positive: int, max_unlabelled: int
) -> DataFrame:
    """``text, positive``: about ``max_positive`` and ``max_unlabelled`` learnable documents, one of each text.

    A text is taken if its hash lies in the share of the hash range that leaves this many rows; no rows are ranked or gathered.
    """
    plain = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    toxic = labels.where(F.col(label_col) == 1).select(F.col(id_col).alias("id"), F.lit(1).alias("positive")).distinct()
    learn = plain.where(~held_out("id")).where("text IS NOT NULL").join(toxic, "id", "left")
    keyed = learn.select("text", F.coalesce("positive", F.lit(0)).alias("positive"), F.xxhash64("text").alias("h"))
    # The texts stay where they are while the classes are counted: ids and labels only.
    ids = docs.where(F.col(text_col).isNotNull()).select(F.col(id_col).alias("id")).where(~held_out("id"))
    marked = ids.join(toxic, "id", "left").groupBy(F.coalesce("positive", F.lit(0)).alias("positive")).count().collect()
    n = {r["positive"]: r["count"] for r in marked}
    share = F.lit(0.0)
    for kind, most in ((0, max_unlabelled), (1, max_positive)):
        share = F.when(F.col("positive") == kind, min(1.0, most / max(1, n.get(kind, 0)))).otherwise(share)
    place = F.shiftrightunsigned("h", 11) / float(1 << 53)
    return keyed.where(place < share).groupBy("positive", "h").agg(F.first("text").alias("text")).select("text", "positive")


def _counts(rows: DataFrame) -> DataFrame:
    """``feature, p, u``: documents of the sample with a feature, summed inside each task first."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums = np.zeros((2, 1 << BITS), np.int64)
        for batch in batches:
            for text, positive in zip(batch["text"], batch["positive"]):
                sums[int(positive), features(text)] += 1
        at = np.flatnonzero(sums.any(axis=0))
        yield pd.DataFrame({"feature": at, "p": sums[1, at], "u": sums[0, at]})

    parts = rows.mapInPandas(count, "feature bigint, p bigint, u bigint")
    return parts.groupBy("feature").agg(F.sum("p").alias("p"), F.sum("u").alias("u"))


def _chosen(rows: DataFrame, n_p: int, n_u: int, most: int) -> np.ndarray:
    """Features far more frequent in positives: at least 5, three times the rate and 6 deviations above it, strongest first."""
    rate_p, rate_u = (F.col("p") + 0.0) / n_p, (F.col("u") + 1.0) / (n_u + 1.0)
    strong = _counts(rows).where((F.col("p") >= 5) & (rate_p >= 3 * rate_u) & (F.col("p") - n_p * rate_u >= 6 * F.sqrt(n_p * rate_u)))
    top = strong.select("feature", ((rate_p - rate_u) / F.sqrt(rate_u)).alias("s")).orderBy(F.desc("s"), "feature").limit(most)
    return np.sort(np.array([r["feature"] for r in top.collect()], np.int64))


def _nonnegative(rows: list[np.ndarray], positive: np.ndarray, width: int, prior: float, share: float, steps: int = 600) -> tuple[np.ndarray, float]:
    """Logistic nnPU risk minimised by Adam over all rows; ``rows`` hold column numbers.

    All text is the unlabelled rows and the ``share`` of confirmed examples together, so the negatives' risk is
    ``(1 - share) * unlabelled - (prior - share) * positive``, kept at or above zero.
    """
    at = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    col = np.concatenate(rows) if rows else np.zeros(0, np.int64)
    is_p, is_u = positive == 1, positive == 0
    n_p, n_u = max(1, is_p.sum()), max(1, is_u.sum())
    hidden = max(0.0, prior - share)
    w, b = np.zeros(width), np.log(prior / (1 - prior))
    m, v = np.zeros(width + 1), np.zeros(width + 1)
    for t in range(1, steps + 1):
        z = b + np.bincount(at, w[col], len(rows))
        s = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
        loss = np.logaddexp(0, z)
        rest = (1 - share) * loss[is_u].sum() / n_u - hidden * loss[is_p].sum() / n_p
        # Derivatives by z: s - 1 of the positive loss, s of the negative one.
        up = np.where(is_p, (prior * (s - 1) - hidden * s) / n_p, (1 - share) * s / n_u)
        if rest < 0:  # the corrected part is overfitted: step back on it alone
            up = np.where(is_p, hidden * s / n_p, -(1 - share) * s / n_u)
        grad = np.append(np.bincount(col, up[at], width)[:width] + DECAY * w, up.sum())
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        step = 0.05 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-9)
        w, b = w - step[:-1], b - step[-1]
    return w, float(b)


def train(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "toxic",
    max_positive: int = MAX_POSITIVE,
    max_unlabelled: int = MAX_UNLABELLED,
    max_features: int = MAX_FEATURES,
) -> Model:
    """Fit on the documents that are not held out. Without toxic examples every score is the prior's floor."""
    rows = checkpointed(sample(docs, labels, id_col, text_col, label_col, max_positive, max_unlabelled).repartition(16))
    # The prior: the share of toxic labels among all learnable ones. The share: confirmed examples among learnable documents.
    known = labels.where(~held_out(id_col)).where(F.col(label_col).isNotNull()).agg(
        F.avg((F.col(label_col) == 1).cast("double")).alias("rate"), F.sum((F.col(label_col) == 1).cast("bigint")).alias("n")
    ).first()
    prior = min(0.9, max(1e-3, known["rate"] or 0.0))
    share = min(prior, (known["n"] or 0) / max(1, docs.where(~held_out(id_col)).count()))
    sizes = {r["positive"]: r["n"] for r in rows.groupBy("positive").agg(F.count("*").alias("n")).collect()}
    if not sizes.get(1):
        return Model(np.zeros(0, np.int64), np.zeros(0), float(np.log(1e-3)))
    chosen = _chosen(rows, sizes[1], sizes.get(0, 0), max_features)

    def narrow(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            held = [np.searchsorted(chosen, np.intersect1d(features(t), chosen, assume_unique=True)) for t in batch["text"]]
            yield pd.DataFrame({"columns": held, "positive": batch["positive"]})

    # Bounded: max_positive + max_unlabelled rows of at most max_features numbers each, in practice a few.
    got = rows.mapInPandas(narrow, "columns array<bigint>, positive int").collect()
    got.sort(key=lambda r: (r["positive"], r["columns"]))
    held = [np.array(r["columns"], np.int64) for r in got]
    w, b = _nonnegative(held, np.array([r["positive"] for r in got]), len(chosen), prior, share)
    return Model(chosen, w, b)


def scored(model: Model, text: Column) -> Column:
    """The toxicity of a text column, 0 to 1; null counts as empty."""

    @F.pandas_udf(DoubleType())
    def of(texts: pd.Series) -> pd.Series:
        return pd.Series(model.score(texts))

    return of(text)


def scores(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """``id, held_out, score, predicted`` for every row of ``docs``.

    Empty and null texts get the bias alone. Repeated rows and null ids are scored like any other; a null id is not held out.
    Columns other than id and text are not read.
    """
    model = train(docs, labels, id_col, text_col)
    out = docs.select(F.col(id_col).alias("id"), scored(model, F.col(text_col)).alias("score"))
    return out.select("id", held_out("id").alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def accepted(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` below the threshold, with their columns."""
    model = train(docs, labels, id_col, text_col)
    return docs.where(scored(model, F.col(text_col)) < threshold)
