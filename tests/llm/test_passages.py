"""Repeated passages of short lines against plain Python."""

import random

from conftest import prose

from scribelake.llm import line_chunks


def _left(rows, least=50):
    """By definition: a line goes if it lies in a run of ``least`` words that occurs earlier and apart; quadratic."""
    texts = {i: t.split("\n") for i, t in sorted(rows)}
    seen, out = {}, {}
    for i, lines in texts.items():
        gone = set()
        for a in range(len(lines)):
            for b in range(a + 1, len(lines) + 1):
                if sum(len(x.split()) for x in lines[a:b]) >= least:
                    doc, at = seen.setdefault(tuple(lines[a:b]), (i, a))
                    if doc != i or at + b - a <= a:
                        gone.update(range(a, b))
        out[i] = "\n".join(x for k, x in enumerate(lines) if k not in gone)
    return out


def test_passages_of_short_lines_go_whole(spark):
    rows, planted = [], []
    for p, (lines, words) in enumerate(((2, 30), (3, 20), (4, 15), (10, 10), (30, 10), (1, 50))):
        passage = [prose(1000 * (p + 1) + k, words) for k in range(lines)]
        planted.append(passage)
        for i in range(12):
            rows.append((100 * p + i, "\n".join([prose(9000 + 100 * p + i, 9), *passage, prose(7000 + 100 * p + i, 7)])))
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = {r["doc_id"]: r["text"].split("\n") for r in line_chunks.deduplicated(docs, passages=True).collect()}
    for p, passage in enumerate(planted):
        assert got[100 * p] == rows[12 * p][1].split("\n")
        for i in range(1, 12):
            assert got[100 * p + i] == [prose(9000 + 100 * p + i, 9), prose(7000 + 100 * p + i, 7)], (p, i)


def test_passages_equal_the_definition(spark):
    r = random.Random(4)
    pool = [prose(k, r.choice([1, 6, 14, 27, 55])) for k in range(40)]
    rows = []
    for i in range(40):
        lines = []
        for _ in range(r.randrange(1, 5)):
            at = r.randrange(len(pool))
            lines += pool[at : at + r.randrange(1, 9)] if r.random() < 0.7 else [prose(500 + 10 * i + len(lines), 8)]
        rows.append((i, "\n".join(lines)))
    rows += [(50, "\n".join(["same ten words in a line that comes again and"] * 17)), (51, "\n\n".join(pool[3:9])), (52, "x\n" + "\n\n".join(pool[3:9]) + "\ny")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    # No chunk of several lines without the words: only the windows cut.
    got = {x["doc_id"]: x["text"] for x in line_chunks.deduplicated(docs, divisor=1, passages=True).collect()}
    assert got == _left(rows)
    report = {x["id"]: x for x in line_chunks.deduplicated(docs, divisor=1, passages=True, report=True).collect()}
    assert all(x["lines_out"] == (0 if not x["text"] and x["chunks_removed"] else x["text"].count("\n") + 1) for x in report.values())
