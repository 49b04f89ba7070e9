"""All quality gates over whole documents, replayed in plain Python."""

import os
import re
import zlib
from collections import defaultdict

import pytest

import __spark_entry__ as entry

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="shared tables not here")


def words_of(text):
    return re.findall(r"\w+(?:['’]\w+)*", text.casefold())


def windows_of(lines):
    """Ratio of each half minute with at least 40 words; a line lasts two seconds."""
    text = defaultdict(list)
    for k, line in enumerate(lines):
        text[2 * k // 30].append(line)
    for at, held in sorted(text.items()):
        whole = " ".join(held)
        if len(words_of(whole)) >= 40:
            raw = whole.encode()
            yield at, len(raw) / len(zlib.compress(raw))


def loops_of(words):
    """Number of merged ranges in which a phrase of up to 64 words comes at least three times."""
    found = []
    for period in range(1, 65):
        run = 0
        for i in range(period, len(words) + 1):
            if i < len(words) and words[i] == words[i - period]:
                run += 1
                continue
            if run and run + period >= max(3 * period, 24):
                found.append((i - run - period, i))
            run = 0
    reach, n = -1, 0
    for start, end in sorted(found):
        n += start >= reach
        reach = max(reach, end)
    return n


def timing_of(doc_id, n):
    """Number of broken time rules of a document's recording."""
    frames = n * 32000 - {0: -16000, 1: 159, 2: 0, 3: 32000}[doc_id % 4]
    end = n * 2000
    past = end * 16000 > 1000 * frames
    on_tick = end == 10 * -(-100 * frames // 16000) and (n > 1 or doc_id % 13) and (n - 1) * 2000 * 16000 < 1000 * frames
    return int(doc_id % 13 == 0) + int(past and not on_tick) + int((n - 1) * 2000 * 16000 > 1000 * frames)


def test_all_gates(spark):
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()}
    got = {r["source_id"]: r for r in entry.queries()["A1_quality_with_compression"](spark, FOLDER).collect()}
    assert len(got) == len(docs)
    for i, text in docs.items():
        lines = text.split("\n")
        words = [w for line in lines for w in words_of(line)]
        timing = timing_of(i, len(lines))
        want = loops_of(words) + (not words) + sum(r > 2.4 for _, r in windows_of(lines)) + timing + (i % 6 == 0 and i % 4 != 0)
        row = got[f"doc-{i}"]
        assert (row["finding_count"], row["timestamp_valid"], row["word_count"]) == (want, timing == 0, len(words)), i
        assert row["status"] == ("review_required" if want else "passed_checks")


def test_window_ratios(spark):
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()}
    want = {(f"doc-{i}", round(r, 4)) for i, t in docs.items() for _, r in windows_of(t.split("\n")) if r > 2.4}
    got = {(r["source_id"], r["compression_ratio"]) for r in entry.queries()["W7_window30"](spark, FOLDER).collect()}
    assert got == want and want
