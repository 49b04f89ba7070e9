"""Joins of rows with one row per key, for keys that may hold a third of all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def with_key_facts(rows: DataFrame, facts: DataFrame, keys: str | list[str], how: str = "left") -> DataFrame:
    """``rows`` joined with ``facts``, which hold at most one row per key.

    The adaptive join splits a crowded partition only if both sides come straight from a shuffle. An aggregate by the same keys is
    already dealt by them and gets none. The extra key (zero everywhere, but not to the optimizer) asks for one: the facts move
    once more, a single row per key, and the rows of a hot key are then split by their measured size. Nothing is copied for keys
    that are not crowded, and a small side is broadcast by its real size.
    """
    on = [keys] if isinstance(keys, str) else list(keys)
    zero = F.pmod(F.xxhash64(*on), F.lit(1)).alias("__zero")
    return rows.select("*", zero).join(facts.select("*", zero), [*on, "__zero"], how).drop("__zero")
