"""Toxicity, language, quality rules, SimHash."""

import random
import re
from collections import Counter

import numpy as np
import xxhash
from conftest import prose

from scribelake.llm import components, cross_parsing, rule_ledger, simhash_pivots, toxicity_pu
from scribelake.llm.common import held_out


def _fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def _components(fps):
    """Brute force: every pair."""
    ids = list(fps)
    root = {i: i for i in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(ids)):
        for b in range(a):
            if bin(fps[ids[a]] ^ fps[ids[b]]).count("1") <= 4:
                x, y = find(ids[a]), find(ids[b])
                root[max(x, y)] = min(x, y)
    return {i: find(i) for i in ids}


def test_fingerprints(odd_docs):
    for r in simhash_pivots.classes(odd_docs).join(odd_docs.select("doc_id", "text").where("doc_id IS NOT NULL").distinct().withColumnRenamed("doc_id", "id"), "id").collect():
        assert r["fp"] % (1 << 64) == _fingerprint(r["text"]), r["id"]
    assert simhash_pivots.fingerprint("The  cat\nsat on\tTHE mat É") % (1 << 64) == _fingerprint("The  cat\nsat on\tTHE mat É")


def test_simhash_classes_equal_brute_force(spark, odd_docs, monkeypatch):
    r = random.Random(5)
    rows = []
    for f in range(12):
        words = prose(f, 160).split()
        for k in range(1 + 9 * (f % 3)):
            near = list(words)
            near[r.randrange(160)] = f"x{k}"
            rows.append((len(rows), " ".join(near)))
    rows += [(len(rows) + i, prose(500 + i, 3 + i)) for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    want = _components({i: _fingerprint(t) for i, t in rows})
    for crowd, tile in ((24, 1024), (2, 3)):
        monkeypatch.setattr(simhash_pivots, "CROWD", crowd)
        monkeypatch.setattr(simhash_pivots, "TILE", tile)
        got = {x["id"]: x["component"] for x in simhash_pivots.classes(docs).collect()}
        assert got == want
    kept = sorted(x["doc_id"] for x in simhash_pivots.representatives(docs).collect())
    assert kept == sorted(set(want.values()))
    # Null texts and wordless ones are one class; a component of null ids has no name.
    odd = simhash_pivots.classes(odd_docs).collect()
    assert len(odd) == odd_docs.count() and {x["component"] for x in odd if x["fp"] == 0} == {4}


def test_links_for_any_number_of_blocks(spark):
    r = random.Random(9)
    base = [r.getrandbits(64) for _ in range(60)]
    fps = set(base)
    for x in base[:30]:
        for _ in range(4):
            y = x
            for b in r.sample(range(64), r.randrange(1, 7)):
                y ^= 1 << b
            fps.add(y)
    table = spark.createDataFrame([(simhash_pivots._signed(x),) for x in fps], "fp bigint")
    want = _components({simhash_pivots._signed(x): x for x in fps})
    got = {x["u"]: x["v"] for x in components.stars(simhash_pivots.links(table)).collect()}
    assert len(set(want.values())) == len(fps) - len(got)
    for u, v in got.items():
        assert want[u] == want[v]
    assert simhash_pivots.blocks_for(10) == 6 and simhash_pivots.blocks_for(10**10) > simhash_pivots.blocks_for(10**8)


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(0, 40)] + [(100, i) for i in range(101, 160)] + [(7, 7)]
    got = {r["u"]: r["v"] for r in components.stars(spark.createDataFrame(edges, "u bigint, v bigint")).collect()}
    assert got == {i: 0 for i in range(1, 41)} | {i: 100 for i in range(101, 160)}


def test_simhash_of_nothing(no_docs):
    assert simhash_pivots.classes(no_docs).count() == 0
    assert simhash_pivots.representatives(no_docs).columns == no_docs.columns


def _measures(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    times = Counter(windows)
    covered = {i + k for i, w in enumerate(windows) if times[w] > 1 for k in range(3)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered)


def test_measurements(odd_docs):
    for r in odd_docs.collect():
        assert rule_ledger.measure(r["text"])[:5] == _measures(r["text"])
    for text in ("a b c a b c", "a b c d a b c", "x x x x", "a\x0bb\x0cc\rd", "l1\nl1\n\n\nl1", "#*$%&|<> £", "a b a b a", "\x1fa \x85b"):
        assert rule_ledger.measure(text)[:5] == _measures(text), text


def test_ledger_policies_and_ablations(spark, odd_docs, no_docs):
    led = rule_ledger.ledger(odd_docs)
    rows = led.collect()
    assert len(rows) == odd_docs.count()
    for r in rows:
        assert (r["failed"] & 1 == 1) == (r["n_words"] < 50)
    for r in rule_ledger.ablations(led, "v2").collect():
        bit = rule_ledger.mask([r["rule"]])
        assert r["dropped"] == sum(x["failed"] & bit != 0 for x in rows)
        assert r["dropped_alone"] == sum(x["failed"] == bit for x in rows)
        assert r["kept_without"] == sum(x["failed"] & ~bit == 0 for x in rows)
    assert rule_ledger.ledger(no_docs).count() == 0


def _toxic_table(spark, n=600):
    r = random.Random(3)
    docs, labels = [], []
    for i in range(n):
        words, toxic = prose(i, 60).split(), i % 6 == 0
        if toxic:
            for _ in range(3):
                words.insert(r.randrange(60), r.choice(["vile", "scumbag", "hateful"]))
        docs.append((i, " ".join(words), "en"))
        if i % 2 == 0 or toxic:
            labels.append((i, 1, int(toxic)))
    return spark.createDataFrame(docs, "doc_id bigint, text string, lang string"), spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int")


def test_toxicity_on_held_out_documents(spark, odd_docs):
    docs, labels = _toxic_table(spark)
    got = toxicity_pu.scores(docs, labels).collect()
    held = [r for r in got if r["held_out"]]
    assert 100 < len(held) < 300 and all(r["predicted"] == int(r["score"] >= 0.7) for r in got)
    assert sum(r["predicted"] == int(r["id"] % 6 == 0) for r in held) / len(held) > 0.98
    odd = toxicity_pu.scores(odd_docs, labels).collect()  # no learnable document is labelled toxic but id 0 and 6
    assert len(odd) == odd_docs.count() and all(0 <= r["score"] <= 1 for r in odd)
    kept = toxicity_pu.accepted(docs, labels)
    assert kept.columns == docs.columns and 480 <= kept.count() <= 510


def test_toxicity_without_examples(spark, odd_docs, no_docs):
    none = spark.createDataFrame([], "doc_id bigint, toxic int")
    assert {r["predicted"] for r in toxicity_pu.scores(odd_docs, none).collect()} == {0}
    assert toxicity_pu.scores(no_docs, none).count() == 0


def test_risk_is_never_negative():
    """Every positive shares one column: the model must not send unlabelled rows without it to certainty of the wrong kind."""
    rows = [np.array([0])] * 30 + [np.array([0])] * 5 + [np.zeros(0, np.int64)] * 65
    w, b = toxicity_pu._nonnegative(rows, np.array([1] * 30 + [0] * 70), 1, 0.3, 0.2)
    assert w[0] + b > 0 > b


def test_features_do_not_depend_on_case_or_place():
    a, b = toxicity_pu.features("Scumbag reads"), toxicity_pu.features("reads, SCUMBAG!")
    assert (a == b).all() and len(toxicity_pu.features(None)) == 0 == len(toxicity_pu.features("12 !"))


def _phrases(text, known):
    """Greedy parse by substring search."""
    count, at = 0, 0
    while at < len(text):
        size = 0
        while at + size < len(text) and text[at : at + size + 1] in known:
            size += 1
        count, at = count + 1, at + max(1, size)
    return count


def test_phrases_equal_substring_search():
    texts = ["the cat sat on the mat the end", "der hund lag auf der matte am ende"]
    letters = "".join(sorted(set("".join(texts)) - {" "}))
    model = cross_parsing.Model(letters, ["en", "de"], texts)
    tries = ["the mat", "auf der matte lag der hund", "zzz q", "the dog lay", "x", "cat" * 400]
    got, sizes = model.phrases(tries)
    for t, row, n in zip(tries, got, sizes):
        plain = re.sub(r"[\W\d_]+", " ", t).lower()
        assert n == len(plain)
        for j, known in enumerate(texts):
            want = sum(_phrases(plain[k : k + cross_parsing.SEGMENT], known) for k in range(0, len(plain), cross_parsing.SEGMENT))
            assert row[j] == want, (t, known)


def test_languages(spark, odd_docs, no_docs):
    rows = [(i, prose(i, 50), "aa") for i in range(60)] + [(100 + i, prose(i, 50)[::-1], "bb") for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    got = {r["id"]: r for r in cross_parsing.languages(docs).collect()}
    assert all(got[i]["lang_pred"] == g for i, _, g in rows) and all(0 < r["score"] <= 1 for r in got.values())
    odd = cross_parsing.languages(odd_docs).collect()
    assert len(odd) == odd_docs.count()
    texts = {r["doc_id"]: r["text"] for r in odd_docs.collect()}
    for r in odd:
        if r["id"] is not None:
            assert (r["lang_pred"] == "und") == (not any(c.isalpha() for c in texts[r["id"]] or ""))
    assert cross_parsing.languages(no_docs).count() == 0
    kept = cross_parsing.accepted(odd_docs)
    assert kept.columns == odd_docs.columns and kept.where("text IS NULL").count() == 0


def test_held_out_third(spark):
    import zlib

    rows = spark.range(300).select("id", held_out("id").alias("h")).collect()
    assert all(r["h"] == (zlib.crc32(str(r["id"]).encode()) % 3 == 1) for r in rows)
