"""Tables that micro-batches change exactly once.

``foreachBatch`` may hand over a batch again after a failure. A ``BatchLedger`` keeps what each batch adds as a table of its own, named by the
batch's id; a batch whose table has been committed is in, and handing it over again changes nothing. What the batches add up to is read by
merging their tables, so the merge must not depend on the order of rows (sums, extremes, counts). Every ``every`` batches the merge so far is
written as a base, so that a read never opens more than ``every`` tables and the base.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

Rows = Callable[[DataFrame], DataFrame]


class BatchLedger:
    """Changes of micro-batches under one folder. A table counts once its write has been committed, which Spark marks last.

    ``merge`` brings rows of several batches to one row per key and keeps the columns; ``schema`` is that of such rows. One stream writes to
    a ledger.
    """

    def __init__(self, spark: SparkSession, folder: str, schema: StructType | str, merge: Rows, every: int = 50):
        self.spark, self.folder, self.schema, self.merge, self.every = spark, folder, schema, merge, every

    def _committed(self, kind: str) -> list[int]:
        """Ids of the committed tables of a kind (batch or base), in order. Only names are listed."""
        jvm = self.spark._jvm
        top = jvm.org.apache.hadoop.fs.Path(self.folder)
        fs = top.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        found = fs.globStatus(jvm.org.apache.hadoop.fs.Path(top, f"{kind}-*/_SUCCESS")) or []
        return sorted(int(s.getPath().getParent().getName().split("-")[1]) for s in found)

    def _state(self) -> tuple[int, list[int]]:
        """The last batch in the base (-1 without one) and the batches after it."""
        base = max(self._committed("base"), default=-1)
        return base, [i for i in self._committed("batch") if i > base]

    def seen(self, batch_id: int) -> bool:
        base, later = self._state()
        return batch_id <= base or batch_id in later

    def apply(self, rows: DataFrame, batch_id: int, step: Rows) -> bool:
        """Add what ``step`` makes of a batch; False, and nothing is computed, if the batch is in already."""
        if self.seen(batch_id):
            return False
        # What an attempt that was cut off left behind has no mark and is replaced.
        self.merge(step(rows)).write.mode("overwrite").parquet(f"{self.folder}/batch-{batch_id}")
        base, later = self._state()
        if len(later) >= self.every:
            self.table().write.mode("overwrite").parquet(f"{self.folder}/base-{later[-1]}")
        return True

    def table(self) -> DataFrame:
        """All batches merged; empty before the first."""
        base, later = self._state()
        paths = [f"{self.folder}/base-{base}"] * (base >= 0) + [f"{self.folder}/batch-{i}" for i in later]
        if not paths:
            return self.spark.createDataFrame([], self.schema)
        return self.merge(self.spark.read.schema(self.schema).parquet(*paths))

    def start(self, stream: DataFrame, step: Rows, checkpoint: str, **trigger) -> StreamingQuery:
        """Run a stream into the ledger.

        A batch that is in already is still read to its end: the stream's own state stores are brought up to it by doing so.
        """

        def enter(rows: DataFrame, batch_id: int) -> None:
            if not self.apply(rows, batch_id, step):
                rows.write.format("noop").mode("overwrite").save()

        writer = stream.writeStream.outputMode("append").option("checkpointLocation", checkpoint).trigger(**trigger)
        return writer.foreachBatch(enter).start()


INVALIDATED = "result_id long, path long, first struct<at_ms: long, why: string>, hits long"


def invalidations(observations: DataFrame, open_results: DataFrame) -> DataFrame:
    """Observations that contradict an open result, per result: the first one with its reason, and how many there were.

    ``observations``: path, at_ms, version (null: the path is missing), touched; ``open_results``: result_id, path, version. A result stays
    invalid when its version comes back: what was shown in between was not its source. Nulls in ``touched`` mean no; results without a
    version are contradicted by any version. Equal times: missing before touched before changed does not matter, the least reason counts.
    """
    seen = observations.select("path", "at_ms", F.col("version").alias("__seen"), F.coalesce("touched", F.lit(False)).alias("__touched"))
    why = (
        F.when(F.col("__seen").isNull(), "missing").when(F.col("__touched"), "touched")
        .when(~F.col("__seen").eqNullSafe(F.col("version")), "changed")
    )
    hit = seen.join(open_results, "path").withColumn("why", why).where("why IS NOT NULL")
    return hit.select("result_id", "path", F.struct("at_ms", "why").alias("first"), F.lit(1).cast("long").alias("hits"))


def merged_invalidations(rows: DataFrame) -> DataFrame:
    return rows.groupBy("result_id", "path").agg(F.min("first").alias("first"), F.sum("hits").alias("hits"))
