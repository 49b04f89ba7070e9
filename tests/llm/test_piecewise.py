"""Piecewise hashes against a byte-by-byte version, and edited texts against plain Python."""

import hashlib
import random

import numpy as np
import pytest
from conftest import prose

from scribelake.llm import piecewise_hashes as P
from scribelake.llm.common import mixed


def slow_fingerprint(raw: bytes) -> str:
    """The same definition, one byte at a time."""
    size = P.block_size(len(raw))
    table = [int(x) >> 8 & 0xFFFFFFFF for x in mixed(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))]

    def signature(block):
        letters, chunk = "", []

        def end():
            h = int(mixed(np.array([sum((c + 1) * pow(P._BASE, i, 1 << 64) for i, c in enumerate(chunk)) % (1 << 64)], np.uint64))[0]) >> 52
            chunk.clear()
            return P._LETTERS[h >> 6] + P._LETTERS[h & 63]

        for i, c in enumerate(raw):
            chunk.append(c)
            h = sum(table[raw[i - k]] * pow(0x2C1B3C6D, k, 1 << 32) for k in range(min(7, i + 1))) % (1 << 32)
            h = (h ^ (h >> 15)) * 0x2C1B3C6D % (1 << 32)
            h ^= h >> 13
            if h < (1 << 32) // block or len(chunk) == P.LONGEST * block:
                letters += end()
        return letters + (end() if chunk else "")

    return f"{size}:" + (":".join(signature(s) for s in (size, 2 * size)) if raw else ":")


TEXTS = ["", "a", "ab cd", "hello hello hello", "a" * 500, "\n" * 40, prose(1, 3), prose(2, 60), prose(3, 400), "你好 🙂 ñ " * 30, "x y " * 300]


@pytest.mark.parametrize("piece", [1 << 20, 64, 7])
def test_fingerprint_equals_the_slow_one(monkeypatch, piece):
    monkeypatch.setattr(P, "SLICE", piece)
    for text in TEXTS:
        raw = text.encode()
        assert P.fingerprint(raw) == slow_fingerprint(raw), text[:20]


def test_common_letters_by_table():
    r = random.Random(0)
    for _ in range(60):
        a, b = ([r.choice("abcd") for _ in range(r.randrange(80))] for _ in range(2))
        best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                best[i + 1][j + 1] = best[i][j] + 1 if x == y else max(best[i][j + 1], best[i + 1][j])
        assert P.common_letters(a, b) == best[-1][-1]


def test_likeness():
    a, b = prose(1, 2000), prose(2, 2000)
    f = lambda t: P.fingerprint(t.encode())
    assert P.likeness(f(a), f(a)) == 1.0 and P.likeness(f(""), f("")) == 1.0 and P.likeness(f(""), f("x")) == 0.0
    assert P.likeness(f(a), f(b)) < 0.1
    # Words put in front or in the middle move no other cuts; a size twice as large is still comparable.
    assert P.likeness(f(a), f("new words here " + a)) > 0.9 and P.likeness(f(a), f(a[:3000] + " inserted " + a[3000:])) > 0.9
    assert 0.5 < P.likeness(f(a), f(P.edited(a, b))) < 0.9 and P.likeness(f(a), f(a + " " + a[: len(a) // 2])) > 0.6
    assert P.likeness(f(a), f(a * 8)) == 0.0  # no common size
    assert all(P.likeness(f(x), f(y)) == P.likeness(f(y), f(x)) for x in TEXTS for y in TEXTS)
    assert len(f("z" * 3_000_000)) < 400


def brute(rows):
    fp = lambda t: P.fingerprint(t.encode())
    order = sorted(((i, t or "") for i, t in rows), key=lambda x: (x[0] is None, -(x[0] or 0)))
    out = []
    for (i, t), (_, after) in zip(order, order[1:] + order[:1]):
        e = t[: len(t) - len(t) // 3] + after[: len(t) // 3]
        out.append((i, len(t), hashlib.sha256(e.encode()).hexdigest(), fp(t), fp(e), P.likeness(fp(t), fp(e)), P.likeness(fp(t), fp(after))))
    return out


def test_rows_against_plain_python(spark):
    r = random.Random(8)
    rows = [(i, prose(i, r.randrange(1, 200))) for i in range(0, 400, 3)]
    rows += [(1000 + i, t) for i, t in enumerate(TEXTS)] + [(2000, None), (2001, "\n".join(prose(i, 40) for i in range(500))), (None, "last of all")]
    rows += [(3000 + i, "one and the same text") for i in range(60)] + [(-5, "ends")]
    df = spark.createDataFrame([(i, t, 1, "x", 2) for i, t in rows], "doc_id bigint, text string, id int, tail string, part int").repartition(3)
    assert sorted(map(repr, map(tuple, P.beside_next(df).collect()))) == sorted(map(repr, brute(rows)))


def test_repeated_rows_ties_and_small_tables(spark):
    df = spark.createDataFrame([(1, "a b c d e f"), (1, "a b c d e f"), (1, "other"), (None, None), (None, None)], "doc_id bigint, text string")
    got = P.beside_next(df).collect()
    assert sorted((r["id"] is None, r["n_chars"]) for r in got) == [(False, 5), (False, 11), (False, 11), (True, 0), (True, 0)]
    assert {r["fingerprint"] for r in got if r["n_chars"] == 11} == {P.fingerprint(b"a b c d e f")}
    (one,) = P.beside_next(df.where("text = 'other'")).collect()
    assert one["near_next"] == 1.0 and one["edited_sha256"] == hashlib.sha256(b"otheo").hexdigest()
    assert P.beside_next(df.where("false")).collect() == []


def test_query(spark):
    from scribelake.llm import queries

    rows = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()
    got = queries.op13_piecewise_hashes(spark, "/root/testdata/sf0.001").collect()
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, brute([tuple(r) for r in rows])))
    copies = spark.createDataFrame([(1, TEXTS[8]), (2, TEXTS[8]), (3, None)], "doc_id int, text string")
    fps = P.fingerprints(copies).collect()
    assert fps[0]["fingerprint"] == fps[1]["fingerprint"] and fps[2]["fingerprint"] == "4::"
    pair = P.fingerprints(copies.where("doc_id < 3")).select(P.likeness_of(P.F.col("fingerprint"), P.F.col("fingerprint")).alias("x")).collect()
    assert {p["x"] for p in pair} == {1.0}
