"""Progress events: current state per job from numbered messages.

``settled`` is the batch form over stored events; ``ProgressState`` keeps the
same state on a stream, one state per batch.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from scribelake.operators.ordered import BLOCK_ROWS, ordered
from scribelake.operators.telemetry import valid_admission, valid_event
from scribelake.session import checkpointed
from scribelake.operators.joins import with_key_facts

# Terminal states and the events that end a batch.
TERMINAL = ("completed", "review_required", "failed", "cancelled")
BATCH_END = ("result", "cancelled", "error")
STATES = ("waiting", "checking", "processing", *TERMINAL)


def judged(events: DataFrame, *, width: int = BLOCK_ROWS) -> DataFrame:
    """Events in arrival order with ``verdict``: accepted, or why not.

    ``events``: batch_id, arrival, seq, type, job_id, attempt_id, index, state,
    stage, percent, elapsed; requested, admitted and reason where there are
    admissions. Only accepted events move a batch's number, so a verdict depends
    on the verdicts before it. They are found by repetition: given a guess of
    what is accepted, all events are judged at once; a verdict is right as soon
    as those before it are, so the guess that reproduces itself is the answer.
    No batch is replayed in one task.
    """
    valid = valid_event(admission=_admission(events))
    rows = checkpointed(events.withColumn("__valid", valid).withColumn("__accepted", F.col("__valid")))
    while True:
        told = checkpointed(_verdicts(rows, width))
        now = F.col("verdict") == "accepted"
        if told.where(now != F.col("__accepted")).isEmpty():
            return told.drop("__valid", "__accepted")
        rows = told.withColumn("__accepted", now).drop("verdict")


def _admission(events: DataFrame) -> Column:
    if {"requested", "admitted", "reason"} <= set(events.columns):
        return valid_admission(F.col("requested"), F.col("admitted"), F.col("reason"))
    return F.lit(False)


def _verdicts(rows: DataFrame, width: int) -> DataFrame:
    """Verdict of every event if exactly the events marked ``__accepted`` were accepted."""
    taken = F.col("__accepted")
    ending = taken & F.col("type").isin(*BATCH_END)
    placed = ordered(
        rows, ["batch_id"], ["arrival"],
        before={"seen_high": ("max", F.when(taken, F.col("seq"))), "seen_end": ("max", F.when(ending, F.lit(1)))}, width=width,
    )
    placed = placed.withColumn("__fresh", F.col("__valid") & F.coalesce(F.col("seq") > F.col("seen_high"), F.lit(True)))
    opens = F.col("__fresh") & (F.col("type") == "file") & (F.col("state") == "waiting") & (F.col("stage") == "queued")
    job = ["batch_id", "job_id"]
    bound = placed.where(opens).groupBy(*job).agg(
        F.min("arrival").alias("__bound"), F.min_by(F.struct("attempt_id", "index"), "arrival").alias("__who")
    )
    mine = (F.col("arrival") >= F.col("__bound")) & (F.col("attempt_id") == F.col("__who.attempt_id")) & (
        F.col("index") == F.col("__who.index")
    )
    final = F.col("__fresh") & F.col("type").isin("file", "progress") & F.col("state").isin(*TERMINAL)
    ends = placed.where(final).join(bound, job).where(mine).groupBy(*job).agg(F.min("arrival").alias("__end"))
    whole = with_key_facts(placed, bound.join(ends, job, "left"), job)
    moves = F.col("type").isin("file", "progress", "metadata")
    verdict = (
        F.when(~F.col("__valid"), "invalid")
        .when(F.col("seen_end").isNotNull(), "batch_closed")
        .when(~F.col("__fresh"), "stale")
        .when(F.col("type").isin("batch", "admission", *BATCH_END), "accepted")
        .when(F.col("__bound").isNull() | (F.col("arrival") < F.col("__bound")), "unbound")
        .when(~mine, "other_attempt")
        # What a job leaves behind may be told after its end.
        .when(moves & F.coalesce(F.col("arrival") > F.col("__end"), F.lit(False)), "job_ended")
        .otherwise("accepted")
    )
    return whole.withColumn("verdict", verdict).drop("__fresh", "__bound", "__who", "__end", "seen_end", "seen_high")


def settled(accepted: DataFrame) -> DataFrame:
    """Last state per job, elapsed as a maximum, percent as the maximum of the last stage."""
    per_job = accepted.where(F.col("type").isin("file", "progress"))
    last = per_job.groupBy("batch_id", "job_id").agg(
        F.max_by(F.struct("state", "stage", "attempt_id", "seq"), "seq").alias("l"), F.max("elapsed").alias("elapsed"),
        F.count(F.lit(1)).alias("events"),
    )
    turned = per_job.join(last.select("batch_id", "job_id", F.col("l.stage").alias("__stage")), ["batch_id", "job_id"])
    since = turned.groupBy("batch_id", "job_id", "__stage").agg(
        F.max(F.when(F.col("stage") != F.col("__stage"), F.col("seq"))).alias("__before")
    )
    shown = F.when(
        (F.col("stage") == "transcribing") & F.col("percent").between(0, 100)
        & (F.col("seq") > F.coalesce("__before", F.lit(-1))), F.col("percent")
    )
    percent = turned.join(since, ["batch_id", "job_id", "__stage"]).groupBy("batch_id", "job_id").agg(F.max(shown).alias("percent"))
    return last.join(percent, ["batch_id", "job_id"], "left").select(
        "batch_id", "job_id", "l.state", "l.stage", "l.attempt_id", F.col("l.seq").alias("last_seq"), "elapsed", "percent", "events"
    )


def rollup(jobs: DataFrame) -> DataFrame:
    """Live counts per batch."""
    n = lambda s: F.count_if(F.col("state") == s)
    return jobs.groupBy("batch_id").agg(
        F.count(F.lit(1)).alias("jobs"), *[n(s).alias(s) for s in TERMINAL],
        F.count_if(F.col("state").isin(*TERMINAL)).alias("finished"),
        F.count_if(~F.col("state").isin(*TERMINAL) & (F.col("stage") == "transcribing")).alias("decoding"),
    )


def _admits(e) -> bool:
    wanted, given, reason = (getattr(e, c, None) for c in ("requested", "admitted", "reason"))
    return all(pd.notna(x) for x in (wanted, given, reason)) and 1 <= wanted <= 9 and 0 <= given <= wanted and reason != ""


OUTPUT = (
    "batch_id string, job_id string, seq long, verdict string, state string, stage string, percent int, elapsed double"
)
_HEAD = "last_seq long, ended boolean"
_JOB = "job_index int, attempt_id string, state string, stage string, percent int, elapsed double"


# Events judged and told at a time.
TOLD_ROWS = 10_000


def _arrived(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """All events of a group in order of arrival, a bounded number at a time.

    Order is known only when all have come, so all are held: each as a few numbers,
    with every text once.
    """
    held: dict[str, list[np.ndarray]] = {}
    codes: dict[str | None, int] = {None: 0}
    texts: list[str | None] = [None]
    worded = set()
    for part in parts:
        for name in part.columns:
            column = part[name]
            if name in ("batch_id", "type", "job_id", "attempt_id", "state", "stage", "reason"):
                worded.add(name)
                column = np.empty(len(part), np.int32)
                for i, text in enumerate(part[name]):
                    at = codes.get(text)
                    if at is None and pd.notna(text):
                        at = codes[text] = len(texts)
                        texts.append(text)
                    column[i] = at or 0
            elif column.dtype == object:
                column = pd.to_numeric(column).to_numpy()
            else:
                column = column.to_numpy()
            held.setdefault(name, []).append(column)
    whole = {name: np.concatenate(held.pop(name)) for name in list(held)}
    order = np.argsort(whole["arrival"], kind="stable")
    words = np.array(texts, dtype=object)
    for at in range(0, len(order), TOLD_ROWS):
        rows = order[at : at + TOLD_ROWS]
        yield pd.DataFrame({name: words[v[rows]] if name in worded else v[rows] for name, v in whole.items()})


class ProgressState(StatefulProcessor):
    """State of one batch: the last accepted number and a small row per job.

    Emits every event with its verdict and the job's state after it. Only an
    accepted event moves the number. The jobs are forgotten when the batch ends;
    with ``ttl_ms``, what is left and batches that never end go after that time without an update.
    """

    def __init__(self, ttl_ms: int | None):
        self.ttl_ms = ttl_ms

    def _ttl(self) -> tuple[int, ...]:
        return () if self.ttl_ms is None else (self.ttl_ms,)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.head = handle.getValueState("head", _HEAD, *self._ttl())
        self.jobs = handle.getMapState("jobs", "job_id string", _JOB, *self._ttl())

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        last, ended = self.head.get() if self.head.exists() else (-1, False)
        held: dict[str, list] = {}
        columns = [c.split(" ")[0] for c in OUTPUT.split(", ")]
        for events in _arrived(rows):
            out = []
            for e in events.itertuples(index=False):
                job = None
                if pd.notna(e.job_id):
                    if e.job_id not in held:
                        ident = (e.job_id,)
                        held[e.job_id] = list(self.jobs.getValue(ident)) if self.jobs.containsKey(ident) else None
                    job = held[e.job_id]
                verdict, job = self._judge(e, last, ended, job)
                if verdict == "accepted":
                    last = int(e.seq)
                    ended = ended or e.type in BATCH_END
                    if job is not None:
                        held[e.job_id] = job
                shown = job or [None] * 6
                out.append((key[0], e.job_id, e.seq, verdict, shown[2], shown[3], shown[4], shown[5]))
            yield pd.DataFrame(out, columns=columns).astype({"percent": "Int32", "seq": "int64"})
        # The state changes only when all events have been told.
        if ended:
            self.jobs.clear()
        else:
            for ident, job in held.items():
                if job is not None:
                    self.jobs.updateValue((ident,), tuple(job))
        self.head.update((last, ended))

    @staticmethod
    def _judge(e, last, ended, job):
        per_job = e.type in ("file", "progress", "metadata", "drained", "cleanup_required")
        if not (per_job or e.type in ("batch", "admission", *BATCH_END)) or pd.isna(e.seq) or e.seq < 0:
            return "invalid", job
        moves = e.type in ("file", "progress")
        if per_job and (pd.isna(e.job_id) or pd.isna(e.attempt_id) or pd.isna(e.index)):
            return "invalid", job
        if moves and (e.state not in STATES or not e.stage or pd.isna(e.elapsed) or not 0 <= e.elapsed < float("inf")):
            return "invalid", job
        if e.type == "admission" and not _admits(e):
            return "invalid", job
        if ended:
            return "batch_closed", job
        if e.seq <= last:
            return "stale", job
        if not per_job:
            return "accepted", job
        if job is None:
            if not (e.type == "file" and e.state == "waiting" and e.stage == "queued"):
                return "unbound", None
            job = [int(e.index), e.attempt_id, "waiting", "queued", None, 0.0]
        elif job[1] != e.attempt_id or job[0] != e.index:
            return "other_attempt", job
        if job[2] in TERMINAL and e.type not in ("drained", "cleanup_required"):
            return "job_ended", job
        if moves:
            job = list(job)
            if e.stage != job[3]:
                job[4] = None
            job[2], job[3], job[5] = e.state, e.stage, max(job[5], float(e.elapsed))
            if e.stage == "transcribing" and pd.notna(e.percent) and 0 <= e.percent <= 100:
                job[4] = max(job[4] or 0, int(e.percent))
        return "accepted", job

    def close(self) -> None:
        pass


def progress_stream(events: DataFrame, *, ttl_ms: int | None = None) -> DataFrame:
    """``ttl_ms`` needs a trigger that goes on without data, so it is for streams that never stop."""
    return events.groupBy("batch_id").transformWithStateInPandas(
        statefulProcessor=ProgressState(ttl_ms), outputStructType=OUTPUT, outputMode="Append",
        timeMode="None" if ttl_ms is None else "ProcessingTime",
    )


# --- live counts ------------------------------------------------------------------------------------------------------------------------

COUNTS = ("jobs", *TERMINAL, "finished", "decoding")
CHANGES = "batch_id string, " + ", ".join(f"{c} long" for c in COUNTS)


def _counted(state: str | None, stage: str | None) -> list[int]:
    """What one job adds to its batch's counts; nothing if there is no such job."""
    ended = state in TERMINAL
    return [int(state is not None), *(int(state == s) for s in TERMINAL), int(ended), int(state is not None and not ended and stage == "transcribing")]


class RollupChanges(ProgressState):
    """What a micro-batch changes in a batch's counts: every job's counts after it, less those before it."""

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        before, now = {}, {}
        for told in super().handleInputRows(key, rows, timerValues):
            after = told[(told["verdict"] == "accepted") & told["state"].notna()].groupby("job_id").tail(1)
            for job, state, stage in zip(after["job_id"], after["state"], after["stage"]):
                if job not in before:
                    before[job] = self.jobs.getValue((job,))[2:4] if self.jobs.containsKey((job,)) else (None, None)
                now[job] = (state, stage)
        change = [0] * len(COUNTS)
        for job in now:
            old, new = _counted(*before[job]), _counted(*now[job])
            change = [c + n - o for c, n, o in zip(change, new, old)]
        if any(change):
            yield pd.DataFrame([(key[0], *change)], columns=["batch_id", *COUNTS])


def rollup_changes(events: DataFrame, *, ttl_ms: int | None = None) -> DataFrame:
    """Changes of the live counts, one row per batch that a micro-batch changes; their sums are ``rollup`` of what has arrived.

    Only what changed moves on: a job that goes from one state to another is taken from one count and added to the next. Sums must see every
    change once, so they belong in a ``BatchLedger``.
    """
    return events.groupBy("batch_id").transformWithStateInPandas(
        statefulProcessor=RollupChanges(ttl_ms), outputStructType=CHANGES, outputMode="Append",
        timeMode="None" if ttl_ms is None else "ProcessingTime",
    )


def summed_changes(changes: DataFrame) -> DataFrame:
    return changes.groupBy("batch_id").agg(*[F.sum(c).alias(c) for c in COUNTS])
