"""Watched files with timers against a replay with a clock."""

import random
import tempfile

import pytest
from pyspark.sql import functions as F

from scribelake.streaming import folder

SCHEMA = "path string, at_ms long, kind string, stat string, sha256 string, wav_ok boolean, forced boolean, version_key string"
END = 10**9


def streamed(spark, rows, results, *, batches=1, delay="0 seconds", shuffled=None):
    """The rows in several micro-batches; a last event far ahead moves the watermark past all others."""
    base = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    rows = sorted(rows, key=lambda r: r[1]) if shuffled is None else shuffled
    size = max(1, -(-len(rows) // batches))
    parts = [rows[i : i + size] for i in range(0, len(rows), size)] + [[("/tick", END, "observe", "x", "x", True, False, None)]]
    for part in parts:
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.mode("append").parquet(f"{base}/in")
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(f"{base}/in")
    q = (
        folder.watch_stream(stream, results, delay).writeStream.format("parquet").outputMode("append").option("path", f"{base}/out")
        .option("checkpointLocation", f"{base}/cp").trigger(availableNow=True).start()
    )
    q.awaitTermination(300)
    assert q.exception() is None
    out = spark.read.schema(folder.LIVE).parquet(f"{base}/out").collect()
    return sorted(tuple(r) for r in out)


def key_of(path, sha):
    import hashlib
    import json

    return hashlib.sha256(json.dumps([path, sha], separators=(",", ":")).encode()).hexdigest()


def replay(rows, processed=frozenset(), until=END):
    """A clock that ticks through every event and every look, by the rules in words: settled after 0.75 s, broken after 5 s, looks 1.2 s apart,
    seven in a row; kept apart from the library's code."""
    out = []
    for path in sorted({r[0] for r in rows}):
        mine = sorted((r for r in rows if r[0] == path), key=lambda r: (r[1], r[2] != "observe"))
        version = since = key = fence = due = None
        again, count, seen = False, 0, None
        moments = mine + [None]
        for e in moments:
            limit = until if e is None else e[1]
            queue = []
            while due is not None and (due < limit or (e is not None and due == limit)):
                queue.append(("timer", due, "observe", version, seen[0], seen[1], False, None))
                state, key, again, count, due, shown = look(queue[-1], path, version, since, key, fence, again, count, processed)
                out.append((path, queue[-1][1], "timer", state, count, key if state != "copying" or key else None, shown))
            if e is None:
                break
            _, at, kind, stat, sha, ok, forced, vkey = e
            if kind == "unavailable":
                count, due = 0, None
                out.append((path, at, "event", "unavailable", 0, key, None))
            elif kind == "missing":
                version = since = key = due = None
                again, count = False, 0
                out.append((path, at, "event", "missing", 0, None, None))
            elif kind in ("ignore", "readd"):
                if key is None or vkey != key:
                    out.append((path, at, "event", "refused", count, vkey, None))
                else:
                    fence, again = (key, False) if kind == "ignore" else (None, True)
                    out.append((path, at, "event", "ignored" if kind == "ignore" else "ready", count, vkey, None))
            elif version != stat:
                version, since, key, again, count, due, seen = stat, at, None, False, 1, at + 1200, (sha, ok)
                out.append((path, at, "event", "copying", 1, None, None))
            else:
                seen = (sha, ok)
                state, key, again, count, due, shown = look(("event", at, kind, stat, sha, ok, forced, None), path, version, since, key, fence, again, count, processed)
                out.append((path, at, "event", state, count, key, shown))
    return sorted(out)


def look(e, path, version, since, key, fence, again, count, processed):
    _, at, _, _, sha, ok, forced, _ = e
    done = (sha, path.rsplit("/", 1)[-1]) in processed
    shown = None
    if key and not forced and not again:
        state = "ignored" if fence == key else "processed_candidate" if done else "ready"
    elif not again and at - since < 750:
        state = "copying"
    elif not ok:
        state = "failed" if at - since >= 5000 else "copying"
    else:
        key, again, shown = key_of(path, sha), False, sha
        state = "ignored" if fence == key else "processed" if done else "ready"
    count = count + 1 if state == "copying" else 0
    return state, key, again, count, at + 1200 if state == "copying" and count < 7 else None, shown


@pytest.fixture(scope="module")
def rows():
    r = random.Random(21)
    out = []
    for p in range(30):
        path, at, stat = f"/w/{p}.wav", 1 + r.randrange(3000), 0
        for _ in range(r.randrange(1, 14)):
            kind = r.choices(["observe", "ignore", "readd", "unavailable", "missing"], [10, 2, 2, 1, 1])[0]
            stat += kind == "observe" and r.random() < 0.4
            sha = f"h{p}-{stat}"
            vkey = key_of(path, sha if r.random() < 0.8 else "other")
            out.append((path, at, kind, str(stat), sha, r.random() < 0.6, r.random() < 0.15, None if kind == "observe" else vkey))
            at += r.choice([1, 300, 700, 1200, 1200, 2400, 5000, 9000])
    return out


@pytest.fixture(scope="module")
def results(spark):
    done = [(f"h{p}-{v}", f"{p}.wav", "r") for p in range(0, 30, 3) for v in range(3)]
    return spark.createDataFrame(done, "source_sha256 string, filename string, result_id string")


def test_timers_fire_without_a_new_row(spark, results):
    rows = [("/w/good.wav", 50, "observe", "1", "g", True, False, None), ("/w/bad.wav", 100, "observe", "1", "b", False, False, None)]
    got = [r for r in streamed(spark, rows, results) if r[0] != "/tick"]
    assert [(r[1], r[2], r[3], r[4]) for r in got if r[0] == "/w/good.wav"] == [(50, "event", "copying", 1), (1250, "timer", "ready", 0)]
    # Bad bytes are forgiven for five seconds, then the file has failed.
    bad = [(r[1], r[2], r[3], r[4]) for r in got if r[0] == "/w/bad.wav"]
    assert bad == [(100, "event", "copying", 1)] + [(100 + 1200 * k, "timer", "copying", k + 1) for k in range(1, 5)] + [(6100, "timer", "failed", 0)]


def test_looks_are_bounded_and_start_over_with_a_new_version():
    """Seven looks at most: here the file never rests, as its grace begins anew."""
    event = lambda at, stat: folder.Event(at, "observe", stat, "h", False, False, None, False)
    held, out = folder.watched(None, "/w/a", [event(0, "1"), event(4000, "2")], 20_000)
    assert [(r[1], r[3], r[4]) for r in out] == [(0, "copying", 1), (1200, "copying", 2), (2400, "copying", 3), (3600, "copying", 4)] + [
        (4000, "copying", 1), (5200, "copying", 2), (6400, "copying", 3), (7600, "copying", 4), (8800, "copying", 5), (10_000, "failed", 0)]
    # A look without an end: the same version observed every 100 ms before it settles uses the budget up.
    held, out = folder.watched(None, "/w/b", [event(100 * k, "1") for k in range(9)], 50_000)
    assert [r[4] for r in out] == [1, 2, 3, 4, 5, 6, 7, 8, 9] and held["due"] is None


@pytest.mark.parametrize("batches", [1, 4])
def test_stream_equals_a_replay_with_a_clock(spark, rows, results, batches):
    processed = {(r["source_sha256"], r["filename"]) for r in results.collect()}
    got = [r for r in streamed(spark, rows, results, batches=batches) if r[0] != "/tick"]
    assert got == replay(rows, processed)
    assert {r[3] for r in got} >= {"copying", "ready", "failed", "ignored", "refused", "unavailable", "missing", "processed", "processed_candidate"}
    assert sum(r[2] == "timer" for r in got) > 50


def test_order_of_arrival_does_not_matter(spark, rows, results):
    """Rows up to the delay late are taken in the order of their times."""
    r = random.Random(5)
    late = sorted(rows, key=lambda x: x[1] + r.randrange(4000))
    processed = {(x["source_sha256"], x["filename"]) for x in results.collect()}
    got = [x for x in streamed(spark, rows, results, batches=5, delay="60 seconds", shuffled=late) if x[0] != "/tick"]
    assert got == replay(rows, processed)


def test_registered_stream_equals_the_replay(spark):
    """All events of the smallest table, up to where the stream's own time has got."""
    from pathlib import Path

    from scribelake.plans import registered

    at = "/root/testdata/sf0.001"
    if not Path(at).exists():
        pytest.skip("no shared tables")
    got = sorted(tuple(r) for r in registered().plans()["R1_folder_live"](spark, at).collect())
    rows = []
    for e in spark.read.parquet(f"{at}/events.parquet").collect():
        i, u = e["event_id"], e["user_id"]
        kind = {3: "ignore", 7: "readd", 11: "unavailable"}.get(i % 13, "missing" if i % 97 == 5 else "observe")
        import hashlib

        sha = hashlib.sha256(f"{u}:{i // 2000}".encode()).hexdigest()
        rows.append((f"/watch/{u}.wav", 1000 + 40 * i, kind, str(i // 2000), sha, e["event_type"] != "error", e["event_type"] == "signup", key_of(f"/watch/{u}.wav", sha)))
    done = {(r[4], r[0].rsplit("/", 1)[-1]) for r in rows if int(r[0].split("/")[-1][:-4]) % 5 == 0}
    until = max(r[1] for r in rows)
    want = replay(rows, done, until + 1)
    assert len(got) == len(want)
    assert got == want
    assert {r[2] for r in got} == {"event", "timer"}


class _Held:
    """A value or list state in memory that counts its messages."""

    def __init__(self, calls):
        self.calls, self.value = calls, None

    def _told(self, value, *, write):
        self.calls.append("write" if write else "read")
        if write:
            self.value = value

    def get(self):
        self._told(None, write=False)
        return iter(list(self.value or ())) if isinstance(self.value, list) or self.value is None and self.is_list else self.value

    def exists(self):
        self._told(None, write=False)
        return self.value is not None

    def update(self, value):
        self._told(value, write=True)

    def put(self, value):
        self._told(list(value), write=True)

    def appendList(self, rows):
        self._told([*(self.value or []), *rows], write=True)

    def clear(self):
        self._told(None, write=True)


def test_a_look_makes_few_messages():
    """Rows come and go without frames; a file that is seen once and looked at later costs seven messages at most."""
    from types import SimpleNamespace

    from pyspark.sql import Row

    calls, timers, states = [], [], {}

    def state(name, schema):
        states[name] = _Held(calls)
        states[name].is_list = name == "waiting"
        return states[name]

    handle = SimpleNamespace(getValueState=state, getListState=state, registerTimer=lambda at: (calls.append("timer"), timers.append(at)))
    machine = folder.WatchTimers()
    machine.init(handle)
    fields = ("at_ms", "kind", "stat", "sha256", "wav_ok", "forced", "version_key", "processed")
    list(machine.handleInputRows(("/a",), iter([Row(*fields)(1000, "observe", "1", "s", True, False, None, False)]), None))
    at = lambda ms: SimpleNamespace(getCurrentWatermarkInMs=lambda: ms)
    out = list(machine.handleExpiredTimer(("/a",), at(5000), SimpleNamespace(getExpiryTimeInMs=lambda: 1000)))
    assert [tuple(r)[:4] for r in out] == [("/a", 1000, "event", "copying"), ("/a", 2200, "timer", "ready")]
    assert timers == [1000] and len(calls) <= 7
