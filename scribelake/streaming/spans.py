"""Open and finished spans on a stream, and sharing of equal work."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

OUTPUT = (
    "batch_id string, job_id string, attempt_id string, stage string, started_at double, ended_at double, "
    "outcome string, worker_seconds double"
)


class SpanState(StatefulProcessor):
    """Starts and ends waiting for their counterpart, first in first out, per batch, job, attempt and stage."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.starts = handle.getListState("starts", "at double")
        self.ends = handle.getListState("ends", "at double, outcome string")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        starts = [r[0] for r in self.starts.get()] if self.starts.exists() else []
        ends = [tuple(r) for r in self.ends.get()] if self.ends.exists() else []
        for e in pd.concat(list(rows)).sort_values("sequence").itertuples(index=False):
            if e.kind == "stage_start":
                starts.append(float(e.elapsed_seconds))
            elif e.kind == "stage_end":
                ends.append((float(e.elapsed_seconds), e.outcome or "completed"))
        n = min(len(starts), len(ends))
        done = [(*key, s, at, outcome, at - s) for s, (at, outcome) in zip(starts, ends)]
        for state, left in ((self.starts, [(s,) for s in starts[n:]]), (self.ends, ends[n:])):
            state.clear()
            if left:
                state.put(left)
        yield pd.DataFrame(done, columns=[c.split(" ")[0] for c in OUTPUT.split(", ")])

    def close(self) -> None:
        pass


def span_stream(events: DataFrame) -> DataFrame:
    return events.where("kind IN ('stage_start', 'stage_end')").groupBy("batch_id", "job_id", "attempt_id", "stage").transformWithStateInPandas(
        statefulProcessor=SpanState(), outputStructType=OUTPUT, outputMode="Append", timeMode="None"
    )


def distinct_work(requests: DataFrame, *, at: str, key: str, keep: str = "1 hour") -> DataFrame:
    """First request of each key on a stream; later ones within ``keep`` join it."""
    return requests.withWatermark(at, keep).dropDuplicatesWithinWatermark([key])
