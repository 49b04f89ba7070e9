"""Quality rules as a ledger of bits.

Every rule is evaluated once per document: its measurements are stored, and each failed rule sets one bit. A policy is a named set
of rules; applying one, or comparing several, or asking what each rule alone drops, reads the stored bits only.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

#: Rules in bit order, as SQL over the measurements; an empty text fails `few_words` only. Append only: bits are stored.
RULES = {
    "few_words": "n_words < 50",
    "repeated_words": "100 * n_repeat_words > 50 * n_words",
    "symbols": "n_words > 0 AND 5 * n_symbols > n_words",
    "duplicate_lines": "n_lines >= 4 AND 2 * n_dup_lines > n_lines",
    "shouting": "n_letters >= 200 AND 2 * n_upper > n_letters",
    "long_words": "n_words >= 50 AND word_chars > 20 * n_words",
    "no_letters": "n_words >= 50 AND 4 * n_letters < word_chars",
}
BASE = ("few_words", "repeated_words")
#: Versioned policies: which rules drop a document.
POLICIES = {
    "base": BASE,
    "v1": (*BASE, "symbols", "duplicate_lines"),
    "v2": tuple(RULES),
}
FIELDS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_letters", "n_upper")
SYMBOLS = "#*$%&|<>"


def measure(text: str | None) -> tuple[int, ...]:
    """The measurements of one whole text, in the order of FIELDS."""
    text = text or ""
    words = text.encode("utf-8").split()  # bytes split at ASCII white space only
    n = len(words)
    spaces = sum(map(text.count, " \t\n\v\f\r"))
    repeats = 0
    if n >= 4:
        last = dict(zip(words, range(n)))
        ids = np.fromiter(map(last.__getitem__, words), np.int64, n)
        _, pair = np.unique(ids[:-1] * n + ids[1:], return_inverse=True)
        _, at, times = np.unique(pair[:-1] * n + ids[2:], return_inverse=True, return_counts=True)
        found = times[at] > 1
        covered = np.zeros(n, bool)
        for shift in range(3):
            covered[shift : shift + n - 2] |= found
        repeats = int(covered.sum())
    lines = [x for x in text.split("\n") if x.strip(" \t\v\f\r")]
    letters = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    upper = int(((letters >= 65) & (letters <= 90)).sum())
    # Letters: ASCII ones and everything from U+00C0 on.
    alphabetic = upper + int((((letters >= 97) & (letters <= 122)) | (letters >= 0xC0)).sum())
    return n, len(text) - spaces, sum(map(text.count, SYMBOLS)), len(lines) - len(set(lines)), repeats, len(lines), alphabetic, upper


@F.pandas_udf(StructType([StructField(f, LongType()) for f in FIELDS]))
def _measured(text: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([measure(t) for t in text], columns=list(FIELDS), dtype="int64")


def ledger(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id``, the measurements and ``failed`` (bits of RULES) for every row of ``docs``; null texts have no words.

    Repeated rows and null ids are rows like any other; an empty input gives an empty ledger. Other columns are not read.
    """
    rows = docs.select(F.col(id_col).alias("id"), _measured(F.col(text_col)).alias("m")).select("id", "m.*")
    failed = F.lit(0).cast("bigint")
    for bit, rule in enumerate(RULES.values()):
        failed = failed.bitwiseOR(F.when(F.expr(rule), F.lit(1 << bit)).otherwise(F.lit(0)).cast("bigint"))
    return rows.withColumn("failed", failed)


def mask(rules) -> int:
    names = list(RULES)
    return sum(1 << names.index(r) for r in rules)


def passes(policy: str, failed: str = "failed") -> Column:
    """Whether a document fails none of the policy's rules."""
    return F.col(failed).bitwiseAND(F.lit(mask(POLICIES[policy])).cast("bigint")) == 0


def ablations(led: DataFrame, policy: str) -> DataFrame:
    """``rule, dropped, dropped_alone, kept_without``: per rule of a policy, in one pass over the stored bits.

    ``dropped_alone`` counts documents that no other rule of the policy drops: they come back if the rule is left out.
    """
    whole = mask(POLICIES[policy])
    # At most one row per combination of failed rules.
    sets = led.groupBy(F.col("failed").bitwiseAND(F.lit(whole).cast("bigint")).alias("bits")).agg(F.count("*").alias("n"))
    names = list(RULES)
    each = F.explode(F.array(*[F.struct(F.lit(r).alias("rule"), F.lit(1 << names.index(r)).cast("bigint").alias("bit")) for r in POLICIES[policy]]))
    hit = F.col("bits").bitwiseAND(F.col("r.bit")) != 0
    alone = F.col("bits") == F.col("r.bit")
    total = lambda c: F.coalesce(F.sum(F.when(c, F.col("n"))), F.lit(0)).cast("bigint")
    return sets.withColumn("r", each).groupBy("r.rule").agg(
        total(hit).alias("dropped"), total(alone).alias("dropped_alone"), total((F.col("bits") == 0) | alone).alias("kept_without")
    )
