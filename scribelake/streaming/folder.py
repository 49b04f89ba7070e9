"""Watched files: what each observation of a path means.

``classified`` is the batch form over stored observations; ``FolderState`` is
the same machine on a stream, one small state per path. ``WatchTimers`` looks
again at files that are still copying by itself, when their time comes. Time
comes with the observation, so all are deterministic.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from typing import Any, NamedTuple

import pandas as pd
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from scribelake.functions.text import basename
from scribelake.operators.ordered import BLOCK_ROWS, ordered, split_runs
from scribelake.operators.results import sha_of
from scribelake.session import checkpointed
from scribelake.operators.joins import with_key_facts

# Milliseconds until a file counts as settled, and as broken; observation budget.
STABLE_MS, INVALID_MS, UI_STABLE_MS = 750, 5000, 800
MAX_ATTEMPTS = 7
STAT = ("device", "inode", "size_bytes", "mtime_ns", "ctime_ns")


def classified(
    observations: DataFrame, results: DataFrame, ignored: DataFrame, *, width: int = BLOCK_ROWS * 1000
) -> DataFrame:
    """State of every observation.

    ``observations``: path, at_ms, stat (any version text), sha256, wav_ok,
    forced; ``results``: source_sha256, filename, result_id; ``ignored``:
    version_key. A hash is only offered once the stat has rested; afterwards the
    unchanged version is a candidate without a new hash.
    """
    # Versions are numbered once; first sight, first hash and states read the result.
    rows = checkpointed(split_runs(
        observations, ["path"], ["at_ms"], lag={"prev_stat": "stat"}, uses=["stat"],
        starts=F.col("stat") != F.col("prev_stat"), name="version_no", width=width,
    ).drop("prev_stat"))
    key = ["path", "version_no"]
    seen = rows.groupBy(*key).agg(F.min("at_ms").alias("first_seen"))
    aged = with_key_facts(rows, seen, key, "inner").withColumn("age", F.col("at_ms") - F.col("first_seen"))
    settled = (F.col("age") > 0) & (F.col("age") >= STABLE_MS)
    hashed = aged.where(settled & F.col("wav_ok")).groupBy(*key).agg(
        F.min("at_ms").alias("hashed_at"), F.min_by("sha256", "at_ms").alias("known_sha")
    )
    known = results.select(
        F.col("source_sha256").alias("known_sha"), F.col("filename").alias("__name"), F.lit(True).alias("__processed")
    ).distinct()
    fences = ignored.select("version_key").distinct().withColumn("__ignored", F.lit(True))
    full = (
        aged.join(hashed, key, "left")
        .withColumn("__name", basename("path"))
        .withColumn("version_key", F.when(F.col("known_sha").isNotNull(), sha_of(F.col("path"), F.col("known_sha"))))
        .join(known, ["known_sha", "__name"], "left")
        .join(fences, "version_key", "left")
    )
    candidate = (F.col("at_ms") > F.col("hashed_at")) & ~F.col("forced")
    state = (
        F.when(F.col("age") == 0, "copying")
        .when(F.coalesce(candidate, F.lit(False)),
              F.when(F.col("__ignored"), "ignored").when(F.col("__processed"), "processed_candidate").otherwise("ready"))
        .when(~settled, "copying")
        .when(~F.col("wav_ok"), F.when(F.col("age") >= INVALID_MS, "failed").otherwise("copying"))
        .when(F.col("__ignored"), "ignored").when(F.col("__processed"), "processed").otherwise("ready")
    )
    shown = F.coalesce(F.col("at_ms") >= F.col("hashed_at"), F.lit(False))
    return full.select(
        "path", "at_ms", "version_no", state.alias("state"),
        F.when(shown, F.col("version_key")).alias("version_key"),
        F.when(~F.coalesce(candidate, F.lit(False)) & settled & F.col("wav_ok"), F.col("sha256")).alias("source_sha256"),
    )


def stable_twice(observations: DataFrame, *, width: int = BLOCK_ROWS * 1000) -> DataFrame:
    """Whether a version was seen before and has rested long enough for the list."""
    rows = split_runs(
        observations, ["path"], ["at_ms"], lag={"prev_stat": "stat"}, uses=["stat"],
        starts=F.col("stat") != F.col("prev_stat"), name="version_no", width=width,
    )
    seen = rows.groupBy("path", "version_no").agg(F.min("at_ms").alias("first_seen"))
    return with_key_facts(rows, seen, ["path", "version_no"], "inner").select(
        "path", "at_ms", (F.col("at_ms") - F.col("first_seen") >= UI_STABLE_MS).alias("stable")
    )


def within_budget(observations: DataFrame, *, width: int = BLOCK_ROWS * 1000) -> DataFrame:
    """Whether another look is scheduled after an observation of a version: seven at most."""
    rows = split_runs(
        observations, ["path"], ["at_ms"], lag={"prev_stat": "stat"}, uses=["stat"],
        starts=F.col("stat") != F.col("prev_stat"), name="version_no", width=width,
    ).drop("prev_stat")
    rows = ordered(rows, ["path", "version_no"], ["at_ms"], upto={"attempt": ("count", F.lit(1))}, width=width)
    return rows.select("path", "at_ms", "attempt", (F.col("attempt") < MAX_ATTEMPTS).alias("retry"))


def control_log(controls: DataFrame, current: DataFrame) -> DataFrame:
    """Last valid control per version: ignored, or to be checked again.

    ``controls``: path, version_key, at_ms, kind (ignore / readd). A control of a
    version that is not the path's current one is refused.
    """
    valid = controls.join(current.select("path", "version_key"), ["path", "version_key"], "left_semi")
    return valid.groupBy("path", "version_key").agg(F.max_by("kind", "at_ms").alias("last")).select(
        "path", "version_key", (F.col("last") == "ignore").alias("ignored"), (F.col("last") == "readd").alias("revalidate")
    )


def invalidated(open_results: DataFrame, diff: DataFrame, touched: DataFrame) -> DataFrame:
    """Open results whose path was touched, is missing, or has another version."""
    hit = diff.where(F.col("change").isin("missing", "changed")).select("path").unionByName(touched.select("path")).distinct()
    return open_results.join(hit, "path", "left_semi")


OUTPUT = "path string, at_ms long, state string, version_key string, source_sha256 string"
_STATE = "stat string, first_seen long, sha256 string, version_key string, revalidate boolean, ignored string"


_NAMES = [c.split(" ")[0] for c in _STATE.split(", ")]


def stepped(held: dict | None, path: str, e: Any) -> tuple[dict | None, tuple]:
    """What one event makes of a path's state, and the row to report.

    ``e``: at_ms, kind, stat, sha256, wav_ok, forced, version_key, processed. Kinds: observe; ignore and readd (a version, refused unless it
    is the current one); unavailable (nothing is known now, what was stays); missing (the file is gone, and with it all but its fence).
    """
    import hashlib
    import json

    at = int(e.at_ms)
    if e.kind == "unavailable":
        return held, (path, at, "unavailable", None if held is None else held["version_key"], None)
    if e.kind == "missing":
        gone = held and held["ignored"] and dict.fromkeys(_NAMES) | {"ignored": held["ignored"], "revalidate": False}
        return gone or None, (path, at, "missing", None, None)
    if e.kind != "observe":
        if held is None or held["version_key"] is None or held["version_key"] != e.version_key:
            return held, (path, at, "refused", e.version_key, None)
        held = held | {"ignored": held["version_key"] if e.kind == "ignore" else None, "revalidate": e.kind == "readd"}
        return held, (path, at, "ignored" if e.kind == "ignore" else "ready", e.version_key, None)
    if held is None or held["stat"] != e.stat:
        ignored = None if held is None else held["ignored"]
        held = dict(stat=e.stat, first_seen=at, sha256=None, version_key=None, revalidate=False, ignored=ignored)
        return held, (path, at, "copying", None, None)
    if not e.forced and not held["revalidate"] and held["version_key"]:
        fenced = held["ignored"] == held["version_key"]
        state = "ignored" if fenced else "processed_candidate" if e.processed else "ready"
        return held, (path, at, state, held["version_key"], None)
    age = at - held["first_seen"]
    if not held["revalidate"] and age < STABLE_MS:
        return held, (path, at, "copying", held["version_key"], None)
    if not e.wav_ok:
        return held, (path, at, "failed" if age >= INVALID_MS else "copying", held["version_key"], None)
    text = json.dumps([path, e.sha256], ensure_ascii=False, separators=(",", ":"))
    held = held | dict(sha256=e.sha256, version_key=hashlib.sha256(text.encode()).hexdigest(), revalidate=False)
    fenced = held["ignored"] == held["version_key"]
    state = "ignored" if fenced else "processed" if e.processed else "ready"
    return held, (path, at, state, held["version_key"], e.sha256)


class FolderState(StatefulProcessor):
    """Observations and controls of one path.

    Input: path, at_ms, kind (see ``stepped``), stat, sha256, wav_ok, forced, version_key, processed (from the stream-static join).
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.cache = handle.getValueState("cache", _STATE)

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        held = dict(zip(_NAMES, self.cache.get())) if self.cache.exists() else None
        out = []
        for e in pd.concat(list(rows)).sort_values("at_ms").itertuples(index=False):
            held, row = stepped(held, key[0], e)
            out.append(row)
        if held is not None:
            self.cache.update(tuple(held[n] for n in _NAMES))
        else:
            self.cache.clear()
        yield pd.DataFrame(out, columns=[c.split(" ")[0] for c in OUTPUT.split(", ")])

    def close(self) -> None:
        pass


def _with_results(observations: DataFrame, results: DataFrame) -> DataFrame:
    known = results.select(
        F.col("source_sha256").alias("sha256"), F.col("filename").alias("__name"), F.lit(True).alias("__known")
    ).distinct()
    rows = observations.withColumn("__name", basename("path")).join(known, ["sha256", "__name"], "left")
    return rows.withColumn("processed", F.coalesce("__known", F.lit(False))).drop("__name", "__known")


def folder_stream(observations: DataFrame, results: DataFrame) -> DataFrame:
    """States of a stream of observations; finished results are joined in as a static side."""
    rows = _with_results(observations, results)
    return rows.groupBy("path").transformWithStateInPandas(
        statefulProcessor=FolderState(), outputStructType=OUTPUT, outputMode="Append", timeMode="None"
    )


# --- watching with timers ---------------------------------------------------------------------------------------------------------------

#: Fixed value: milliseconds after which a file that is not settled is looked at again.
RETRY_MS = 1200
LIVE = "path string, at_ms long, origin string, state string, attempt int, version_key string, source_sha256 string"
_EVENT = "at_ms long, kind string, stat string, sha256 string, wav_ok boolean, forced boolean, version_key string, processed boolean"
_WATCHED = _STATE + ", attempt int, due long, seen_sha256 string, seen_ok boolean, seen_processed boolean"
_WATCHED_NAMES = [c.split(" ")[0] for c in _WATCHED.split(", ")]
_LIVE_ROW = Row(*[c.split(" ")[0] for c in LIVE.split(", ")])
#: Rows of a path handed to its state in one message.
ROWS_AT_ONCE = 1000


class Event(NamedTuple):
    at_ms: int
    kind: str
    stat: str | None
    sha256: str | None
    wav_ok: bool | None
    forced: bool | None
    version_key: str | None
    processed: bool | None


def watched(held: dict | None, path: str, events: Iterable[Event], until: int) -> tuple[dict | None, list[tuple]]:
    """Events in order and the looks that fall due between them and up to ``until``.

    ``held`` holds a path's state with ``attempt``, ``due`` and what was last seen of the file. A look that finds the file still copying makes
    the next one due ``RETRY_MS`` later, up to ``MAX_ATTEMPTS`` looks; any other state and any new version starts over. A look due at the
    time of an event comes first.
    """
    extra = ["attempt", "due", "seen_sha256", "seen_ok", "seen_processed"]
    out = []

    def look(e: Event, origin: str) -> None:
        nonlocal held
        known = None if held is None else {n: held[n] for n in _NAMES}
        kept = dict.fromkeys(extra) if held is None else {n: held[n] for n in extra}
        now, row = stepped(known, path, e)
        if e.kind == "observe":
            fresh = known is None or known["stat"] != e.stat
            copying = row[2] == "copying"
            attempt = ((0 if fresh else kept["attempt"] or 0) + 1) if copying else 0
            due = e.at_ms + RETRY_MS if copying and attempt < MAX_ATTEMPTS else None
            kept = dict(attempt=attempt, due=due, seen_sha256=e.sha256, seen_ok=e.wav_ok, seen_processed=e.processed)
        elif e.kind in ("unavailable", "missing"):
            kept = kept | {"attempt": 0, "due": None}
        held = None if now is None else now | kept
        out.append((row[0], row[1], origin, row[2], kept["attempt"] or 0, row[3], row[4]))

    def due_before(limit: int) -> None:
        while held is not None and held["due"] is not None and held["due"] <= limit:
            look(Event(held["due"], "observe", held["stat"], held["seen_sha256"], held["seen_ok"], False, None, held["seen_processed"]), "timer")

    for e in events:
        due_before(e.at_ms)
        look(e, "event")
    due_before(until)
    return held, out


class WatchTimers(StatefulProcessor):
    """Files looked at again by event-time timers, without a new row.

    Rows of a path wait in its state until the watermark has reached them (Spark takes no row at or before it any more), so they are taken in
    the order of their times whatever batch brought them; a timer stands at the first waiting row or the look that is due.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.cache = handle.getValueState("cache", _WATCHED)
        self.waiting = handle.getListState("waiting", _EVENT)

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:
        arrived = [tuple(r[n] for n in Event._fields) for r in rows]
        for at in range(0, len(arrived), ROWS_AT_ONCE):
            self.waiting.appendList(arrived[at : at + ROWS_AT_ONCE])
        if arrived:
            self.handle.registerTimer(min(r[0] for r in arrived))
        return iter(())

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[Row]:
        # Every call of the state is a message to the JVM and back: none is made that changes nothing.
        now = timerValues.getCurrentWatermarkInMs()
        known = self.cache.get()
        before = held = None if known is None else dict(zip(_WATCHED_NAMES, known))
        rows = sorted((Event(*r) for r in self.waiting.get()), key=lambda e: (e.at_ms, e.kind != "observe", str(e)))
        ready = [e for e in rows if e.at_ms <= now]
        rest = rows[len(ready) :]
        held, out = watched(held, key[0], ready, now)
        if rest and ready:
            self.waiting.put([tuple(e) for e in rest])
        elif ready:
            self.waiting.clear()
        if held is not None and held != before:
            self.cache.update(tuple(held[n] for n in _WATCHED_NAMES))
        elif held is None and before is not None:
            self.cache.clear()
        coming = [e.at_ms for e in rest[:1]] + ([held["due"]] if held is not None and held["due"] is not None else [])
        # Timers at or before the watermark have fired or are about to; none is set twice.
        if coming and min(coming) > expiredTimerInfo.getExpiryTimeInMs():
            self.handle.registerTimer(min(coming))
        for row in out:
            yield _LIVE_ROW(*row)

    def close(self) -> None:
        pass


def watch_stream(events: DataFrame, results: DataFrame, delay: str = "0 seconds") -> DataFrame:
    """States of watched files as time goes by.

    ``events``: path, at_ms, kind (observe, ignore, readd, unavailable, missing), stat, sha256, wav_ok, forced, version_key. Time is that of the
    events: a row or a due look is taken once the watermark, ``delay`` behind the latest event of any path, is past it. ``origin`` tells whether
    an event or a timer made the row.
    """
    rows = _with_results(events, results).withColumn("event_time", F.timestamp_millis("at_ms")).withWatermark("event_time", delay)
    return rows.groupBy("path").transformWithState(
        statefulProcessor=WatchTimers(), outputStructType=LIVE, outputMode="Append", timeMode="EventTime"
    )
