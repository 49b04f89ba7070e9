"""The pipeline's stages against plain Python over a small table."""

import random
from collections import Counter, defaultdict

import pytest
from conftest import prose
from test_similar import brute_groups, changed

import corpus_pipeline
from scribelake.llm import line_chunks

public_tokenizers = pytest.importorskip("public_tokenizers")


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    r = random.Random(11)
    rows = []
    for i in range(240):
        words = prose(i, 70).split()
        if i % 8 == 0:
            for _ in range(3):
                words.insert(r.randrange(60), r.choice(["vile", "scumbag", "hateful"]))
        rows.append((i, " ".join(words), "en"))
    for i in range(12):  # copies, near copies, junk
        rows.append((300 + i, rows[3][1], "en"))
        rows.append((320 + i, rows[5][1] + f" x{i}", "en"))
        rows.append((340 + i, "12 34 " * i, None))
    passage = "\n".join(prose(700 + k, 60) for k in range(3))
    rows += [(400 + i, prose(800 + i, 40) + "\n" + passage + "\n" + prose(900 + i, 40), "en") for i in range(4)]
    base = prose(77, 120)
    rows += [(600 + i, changed(r, base, 1), "en") for i in range(12)]
    rows += [(500, None, None), (501, "", "en"), (502, "Why", "en"), (503, "Jazz.", "en")]
    docs = spark.createDataFrame([(i, t, g, "s", len(t or "")) for i, t, g in rows], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    labels = spark.createDataFrame([(i, 1, int(i % 8 == 0)) for i in range(240)], "doc_id bigint, quality int, toxic int")
    at = str(tmp_path_factory.mktemp("corpus"))
    docs.repartition(4).write.parquet(f"{at}/documents.parquet")
    labels.coalesce(1).write.parquet(f"{at}/labels.parquet")
    return at


def test_stages(spark, folder, tmp_path):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    kept = {}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, folder)
        if k < 4:
            assert out.columns == docs.columns
        out.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        kept[name] = docs.collect()
    ids = {n: {r["doc_id"] for r in rows} for n, rows in kept.items()}
    toxic = {i for i in range(240) if i % 8 == 0}
    clean = {i for i in range(240)} - toxic
    assert len(ids["toxicity"] & toxic) <= 1 and clean <= ids["toxicity"]
    # Texts without a letter go, all others stay.
    texts = {r["doc_id"]: r["text"] for r in kept["toxicity"]}
    assert ids["language"] == {i for i, t in texts.items() if any(c.isalpha() for c in t or "")}
    # The shared passage, each line of which is long enough, stays once.
    after = {r["doc_id"]: r for r in kept["line_dedup"]}
    lines = Counter(line for r in after.values() for line in r["text"].split("\n") if len(line.split()) >= line_chunks.MIN_WORDS)
    assert max(lines.values()) == 1 and ids["line_dedup"] == ids["language"]
    assert all(r["n_chars"] == len(r["text"]) for r in after.values())
    ordered = sorted((i, r["text"]) for i, r in after.items())
    groups = brute_groups(ordered)
    assert ids["near_dedup"] == {ordered[g][0] for g in groups} and len(kept["near_dedup"]) == len(set(groups))
    # Near copies: one word put behind a text, one word changed.
    assert len(ids["near_dedup"] & set(range(320, 332))) + (5 in ids["near_dedup"]) == 1
    assert len(ids["near_dedup"] & set(range(600, 612))) == 1
    total = defaultdict(int)
    for r in kept["packing"]:
        total[r["doc_id"]] += r["length"]
    assert set(total) == ids["near_dedup"]


def test_run_equals_the_stages(spark, folder):
    rows = corpus_pipeline.run(spark, folder)
    assert rows.columns[:5] == ["doc_id", "piece", "start", "length", "ids_crc32"] and rows.count() > 100
    assert rows.groupBy("sequence_id").agg({"length": "sum"}).where("`sum(length)` > 1024").isEmpty()
