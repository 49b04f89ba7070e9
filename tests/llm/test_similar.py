"""Near copies at five-word shingles against all pairs in plain Python."""

import random

import numpy as np
import pytest
from conftest import WORDS, prose

from scribelake.llm import similar_texts


def shingles(text):
    words = (text or "").encode().lower().split()
    return {b" ".join(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def similarity(a, b):
    return 1.0 if a == b else len(a & b) / len(a | b)


def brute_groups(rows, limit=0.8):
    """For each row number its group's least row number, by links of similar texts."""
    sets = [shingles(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if similarity(sets[i], sets[j]) >= limit:
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return [find(i) for i in range(len(rows))]


def changed(r, text, n):
    words = text.split()
    for _ in range(n):
        words[r.randrange(len(words))] = r.choice(WORDS)
    return " ".join(words)


@pytest.fixture(scope="module")
def family():
    r = random.Random(12)
    rows = []
    for base in range(60):
        n = r.choice([8, 30, 80, 200, 600])
        text = prose(base, n)
        rows.append((base * 100, text))
        rows += [(base * 100 + k, changed(r, text, max(1, int(n * r.choice([0.005, 0.01, 0.02, 0.03]))))) for k in range(1, r.choice([2, 3, 5]))]
    long = prose(9999, 400)
    rows += [(90_000 + k, changed(r, long, 3)) for k in range(70)]  # a crowded key
    rows += [(50 + k, long) for k in range(5)] + [(None, long + " tail"), (None, None), (7, " \n\t"), (8, None), (9, "a b c"), (10, "A  b\nC"), (10, "A  b\nC")]
    return rows


def test_one_of_each_group_stays(spark, family):
    df = spark.createDataFrame([(i, t, 1, "x", 2.0) for i, t in family], "doc_id bigint, text string, k int, stays string, n double").repartition(5)
    out = similar_texts.representatives(df)
    assert out.columns == df.columns
    got = [(r["doc_id"], r["text"]) for r in out.collect()]
    groups = brute_groups(family)
    least = {}
    for (i, t), g in zip(family, groups):
        least[g] = min(least.get(g, (True, 0)), (i is None, i or 0))
    assert len(got) == len(least) and sorted((i is None, i or 0) for i, _ in got) == sorted(least.values())


@pytest.mark.parametrize("tile, shingles_held", [(256, 1 << 20), (16, 1 << 20), (256, 3000)])
def test_loose_families_under_crowded_keys(spark, monkeypatch, tile, shingles_held):
    """Texts that share keys with many others of which few are similar: groups are those of all pairs, in one tile or in many."""
    monkeypatch.setattr(similar_texts, "TILE", tile)
    monkeypatch.setattr(similar_texts, "TILE_SHINGLES", shingles_held)
    r = random.Random(31)
    base = prose(4242, 300)
    rows = [(i, changed(r, base, 11)) for i in range(90)] + [(200 + i, changed(r, base, 2)) for i in range(3)]
    groups = brute_groups(rows)
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    got = sorted(x["doc_id"] for x in similar_texts.representatives(df).collect())
    assert got == sorted({rows[g][0] for g in groups})


def test_tiles_count_intersections_exactly():
    """Bitmaps leave out what only one set has; forests join what all links join."""
    r = random.Random(5)
    sets = [np.array(sorted(r.sample(range(-300, 300), r.randrange(1, 200)))) for _ in range(40)] + [np.zeros(0, np.int64)]
    bits = similar_texts._bitmaps(sets)
    for i in range(len(sets)):
        for j in range(i):
            assert int(np.bitwise_count(bits[i] & bits[j]).sum()) == len(np.intersect1d(sets[i], sets[j]))
    x, y = np.array([3, 2, 3, 5, 4]), np.array([2, 1, 1, 4, 5])
    kept = list(zip(*similar_texts._forest(6, x, y)))
    assert kept == [(3, 2), (2, 1), (5, 4)]


def test_recall_of_links(spark, family):
    """All pairs at 0.8 or more, by bands alone: the chance that the stage sees a pair."""
    sets, keys, fps = [], [], []
    for _, t in family:
        fp, k = similar_texts.sketch(t)
        sets.append(shingles(t))
        keys.append(set(k))
        fps.append(fp & (1 << 64) - 1)
    pairs = [(i, j) for i in range(len(sets)) for j in range(i) if sets[i] and sets[i] != sets[j] and similarity(sets[i], sets[j]) >= 0.8]
    met = [bool(keys[i] & keys[j]) and (fps[i] ^ fps[j]).bit_count() <= similar_texts.RADIUS for i, j in pairs]
    print("pairs", len(pairs), "recall", sum(met) / len(met))
    assert len(pairs) > 500 and sum(met) / len(met) > 0.99


def test_odd_tables(spark):
    schema = "doc_id bigint, text string"
    assert similar_texts.representatives(spark.createDataFrame([], schema)).collect() == []
    rows = [(None, "same words here now then"), (None, "same words here now then"), (None, "same words here now then"), (3, "other"), (3, "other"), (3, "another one")]
    got = similar_texts.representatives(spark.createDataFrame(rows, schema)).collect()
    assert sorted(map(tuple, got), key=str) == [(3, "another one"), (3, "other"), (None, "same words here now then")]
    long = prose(5, 30_000)
    got = similar_texts.representatives(spark.createDataFrame([(2, long), (1, long + " end")], schema)).collect()
    assert [r["doc_id"] for r in got] == [1]


def test_sketch_by_blocks(monkeypatch):
    text = prose(3, 3000)
    whole = similar_texts.sketch(text)
    monkeypatch.setattr(similar_texts, "HELD", 500)
    assert similar_texts.sketch(text) == whole and similar_texts.sketch("") == (0, []) and len(similar_texts.sketch("one")[1]) == similar_texts.BANDS


def test_fingerprints_join_what_no_band_joins(spark):
    """SimHash and pivots are a step of their own: near copies within 4 bits are linked though no two texts share a band."""
    r = random.Random(8)
    rows = [(f"{base}-{k}", changed(r, text, k)) for base, text in ((b, prose(600 + b, 700)) for b in range(12)) for k in range(4)]
    sketched = [(k, similar_texts.sketch(t)[0], [i]) for i, (k, t) in enumerate(rows)]
    bits = {k: fp & (1 << 64) - 1 for k, fp, _ in sketched}
    near = [(a, b) for a in bits for b in bits if a < b and (bits[a] ^ bits[b]).bit_count() <= 4]
    texts = spark.createDataFrame(sketched, "k string, fp bigint, keys array<bigint>")
    tops = {x["u"]: x["v"] for x in similar_texts.components.stars(similar_texts.by_fingerprint(texts.select("k", "fp"))).collect()}
    assert len(near) > 15 and all(tops.get(a, a) == tops.get(b, b) for a, b in near)
    # Keys by which the stage finds the texts again are digests of the texts.
    docs = spark.createDataFrame([(t,) for _, t in rows], "text string")
    named = spark.createDataFrame([(t, *s[1:]) for (_, t), s in zip(rows, sketched)], "text string, fp bigint, keys array<bigint>")
    named = named.select(similar_texts._text_key(similar_texts.F.col("text")).alias("k"), "fp", "keys")
    assert similar_texts.links(named, docs).count() >= len({b for _, b in near}) // 2
    assert similar_texts.links(named.where("false"), docs).count() == 0


def test_components_take_tasks_by_their_edges(spark):
    """A few edges among many shuffle partitions: rounds do not run a task for each partition and exchange."""
    names = ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")
    before = {n: spark.conf.get(n) for n in names}
    edges = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 140)] + [(7, 7), (201, 200), (200, 201)]
    sc = spark.sparkContext
    try:
        spark.conf.set(names[0], "100")
        spark.conf.set(names[1], "false")
        sc.setJobGroup("stars", "stars")
        got = similar_texts.components.stars(spark.createDataFrame(edges, "u bigint, v bigint"))
        got = {x["u"]: x["v"] for x in got.collect()}
    finally:
        sc.setLocalProperty("spark.jobGroup.id", None)
        for n, v in before.items():
            spark.conf.set(n, v)
    assert got == {i: 0 for i in range(1, 41)} | {i: 100 for i in range(101, 140)} | {201: 200}
    status = sc.statusTracker()
    stages = {s for j in status.getJobIdsForGroup("stars") for s in status.getJobInfo(j).stageIds}
    done = sum(info.numCompletedTasks for s in stages if (info := status.getStageInfo(s)))
    print("tasks", done)
    assert 0 < done < 4000
