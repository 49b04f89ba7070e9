"""Block naming, histogram shards and line chunks against plain Python."""

import hashlib
import re
from collections import defaultdict

import pytest
from conftest import prose
from pyspark.sql import functions as F

from scribelake.llm import block_naming, histogram_shards, line_chunks


def _groups(rows):
    by = defaultdict(list)
    for i, t in rows:
        by[re.sub(r"[\x20\x09-\x0D]+", " ", t or "")].append(i)
    return by


@pytest.mark.parametrize("block", [3, 4096])
def test_block_naming(odd_docs, block):
    got = block_naming.groups(odd_docs, block_chars=block).collect()
    rows = [(r["doc_id"], r["text"]) for r in odd_docs.collect()]
    want = []
    for text, ids in _groups(rows).items():
        keep = min((i for i in ids if i is not None), default=None)
        want += [(i, keep, len(ids), hashlib.sha256(text.encode()).hexdigest()) for i in ids]
    key = lambda r: str(r)
    assert sorted([(r["id"], r["keep_id"], r["group_size"], r["text_sha256"]) for r in got], key=key) == sorted(want, key=key)
    # One row of each group stays.
    assert sum(r["kept"] for r in got) == len(_groups(rows))
    assert all(r["id"] == r["keep_id"] for r in got if r["kept"])


def test_block_names_tell_apart_what_a_digest_cannot(spark, monkeypatch):
    """With a digest of one bit that depends on the salt, naming must go on to a salt without collisions."""
    docs = spark.createDataFrame([(1, "aa"), (2, "bb"), (3, "aa")], "doc_id int, text string")
    salts = []

    def weak(block, salt):
        salts.append(salt)
        wide = F.xxhash64(block)
        return F.struct((wide if salt >= 2 else F.lit(0).cast("bigint")).alias("h1"), F.lit(0).cast("bigint").alias("h2"))

    monkeypatch.setattr(block_naming, "_digests", weak)
    got = {r["id"]: r["keep_id"] for r in block_naming.groups(docs).collect()}
    assert got == {1: 1, 2: 2, 3: 1} and max(salts) == 2


def test_empty_tables(no_docs):
    assert block_naming.groups(no_docs).count() == 0
    assert histogram_shards.assign(no_docs).count() == 0
    assert line_chunks.deduplicated(no_docs).count() == 0


def test_shards(spark, odd_docs):
    rows = [(i, prose(i % 90, 20 + i % 37)) for i in range(1200)] + [(5000 + i, "hot copy " * 30) for i in range(500)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(7)
    for table, spread in ((docs, 1.02), (odd_docs, None)):
        got = histogram_shards.assign(table).collect()
        assert len(got) == table.count()
        slots, sizes, where = defaultdict(list), defaultdict(int), defaultdict(set)
        for r in got:
            slots[r["shard"]].append(r["slot"])
            sizes[r["shard"]] += r["size"]
            where[r["text_crc32"], r["size"]].add(r["shard"])
        assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and set(slots) <= set(range(8))
        if spread:
            assert max(sizes.values()) <= spread * sum(sizes.values()) / 8
            # Only the group that is larger than a shard is split.
            assert [len(s) for s in where.values() if len(s) > 1] == [8]


def test_splitters_count_exactly(spark):
    keys = [(k, 1 + k % 5) for k in range(0, 1 << 62, (1 << 62) // 997)]
    rows = spark.createDataFrame(keys, "key bigint, size int")
    total = sum(s for _, s in keys)
    bounds = histogram_shards.splitters(rows, [total // 4, total // 2], 0)
    for b, t in zip(bounds, [total // 4, total // 2]):
        assert abs(sum(s for k, s in keys if k < b) - t) <= 5


def test_written_shards(spark, tmp_path):
    docs = spark.createDataFrame([(i, prose(i, 30)) for i in range(80)], "doc_id bigint, text string")
    histogram_shards.write(docs, str(tmp_path / "out"), shards=4, files=2)
    back = spark.read.parquet(str(tmp_path / "out"))
    assert back.count() == 80 and back.select("shard").distinct().count() == 4


def test_line_chunks_remove_shifted_passages(spark):
    passage = [prose(900 + i, 14) for i in range(12)]
    rows = [(i, "\n".join([prose(i, 9)] * (i % 4) + [prose(i + 50, 11)] + passage + [prose(i + 99, 7)])) for i in range(1, 7)]
    single = prose(77, 60)
    rows += [(20, prose(200, 5) + "\n" + single), (21, single + "\n" + prose(201, 5)), (22, "only here\nand here")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = {r["id"]: r for r in line_chunks.deduplicated(docs, report=True).collect()}
    assert got[1]["text"] == dict(rows)[1]
    # Chunks of several lines inside the passage are cut wherever it starts; single lines and its edges stay.
    for i in range(2, 7):
        assert sum(line in got[i]["text"].split("\n") for line in passage) <= 7
        assert prose(i + 50, 11) in got[i]["text"] and prose(i + 99, 7) in got[i]["text"]
    assert single in got[20]["text"] and got[21]["text"] == prose(201, 5)
    assert got[22]["text"] == "only here\nand here" and got[22]["chunks_removed"] == 0


def test_line_chunks_equal_plain_python(spark, odd_docs):
    """Every removed chunk occurs earlier; every chunk that stays is the first or not able."""
    held = {(r["_doc"], r["_h1"], r["start"]): r["n_lines"] for r in line_chunks.chunks(odd_docs).collect()}
    texts = {}
    for r in line_chunks._keyed(odd_docs, "doc_id", "text").select("doc_id", "text", "_h1").collect():
        texts[r["doc_id"], r["_h1"]] = r["text"]
    chunk, order = defaultdict(list), {}
    for (doc, h, start), n in held.items():
        lines = (texts[doc, h] or "").split("\n")[start : start + n]
        words = sum(len(x.split(" ")) if x.strip() else 0 for x in lines)
        if (n > 1 or words >= line_chunks.MIN_WORDS) and words:
            chunk["\n".join(lines)].append((doc is None, doc or 0, h, start))
            order[doc, h, start] = n
    cut = {x for at in chunk.values() for x in sorted(at)[1:]}
    want = {}
    for (doc, h), t in texts.items():
        gone = {i for none, d, g, s in cut if (d, g, none) == (doc or 0, h, doc is None) for i in range(s, s + held[doc, h, s])}
        keep = [line for i, line in enumerate((t or "").split("\n")) if i not in gone]
        want[doc, t] = t if not gone else "\n".join(keep)
    out = line_chunks.deduplicated(odd_docs, report=True).collect()
    assert len(out) == odd_docs.count()
    joined = line_chunks.deduplicated(odd_docs)
    assert joined.columns == odd_docs.columns
    left = sorted((str(r["doc_id"]), str(r["text"])) for r in joined.collect())
    both = sorted((str(i), str(want[i, t])) for i, t in [(r["doc_id"], r["text"]) for r in odd_docs.collect()])
    assert left == both
