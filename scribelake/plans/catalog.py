"""Registry of queries: a Spark plan and, where SQL can say it, the same in SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Plan = Callable[[SparkSession, str], DataFrame]

_PLANS: dict[str, Plan] = {}
_ORACLES: dict[str, str] = {}


class Tables:
    """Lazy parquet readers for one data folder."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        df = self.spark.read.parquet(f"{self.folder}/{name}.parquet")
        parts = self.spark.conf.get(DEAL, None)
        return df.repartition(int(parts)) if parts and name in WORDY else df


#: Session setting of the bench alone: into how many parts tables that are one row group in one file are dealt.
DEAL = "spark.scribelake.dealInto"
#: Tables whose rows are much work each.
WORDY = ("documents", "conversations", "pages", "lineitem")


def query(name: str, oracle: str | None = None, *, bigint: str = "", double: str = ""):
    """Register ``fn(tables) -> DataFrame`` under ``name``.

    ``bigint`` and ``double`` name SQL columns to bring to the Spark column's type.
    """
    casts = [f'CAST("{c}" AS BIGINT) AS "{c}"' for c in bigint.split()]
    casts += [f'CAST("{c}" AS DOUBLE) AS "{c}"' for c in double.split()]
    if casts:
        oracle = f"SELECT * REPLACE ({', '.join(casts)}) FROM ({oracle}) AS q"

    def register(fn):
        if name in _PLANS:
            raise ValueError(f"Duplicate query {name}")

        def plan(spark: SparkSession, folder: str) -> DataFrame:
            return fn(Tables(spark, folder))

        plan.__name__ = name
        plan.__doc__ = fn.__doc__
        _PLANS[name] = plan
        if oracle is not None:
            _ORACLES[name] = oracle.strip()
        return fn

    return register


def plans() -> dict[str, Plan]:
    return dict(_PLANS)


def oracles() -> dict[str, str]:
    return dict(_ORACLES)
