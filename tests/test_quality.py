import random
import re
import unicodedata
import zlib

import pytest
from pyspark.sql import functions as F

from scribelake.functions.text import folded_words, tokens_word, word_count
from scribelake.operators import quality

SEGMENTS = "source_id string, idx int, start_seconds double, end_seconds double, text string"


def segs(spark, texts, source="s"):
    return spark.createDataFrame(
        [(source, i, 2.0 * (i - 1), 2.0 * i, t) for i, t in enumerate(texts, 1)], SEGMENTS
    )


def categories(df):
    return sorted({r["category"] for r in df.collect()})


def words(text):
    return re.findall(r"\w+(?:['’]\w+)*", unicodedata.normalize("NFKC", text).casefold())


def brute_candidates(w):
    out = set()
    for p in range(1, min(64, len(w) // 3) + 1):
        i = p
        while i < len(w):
            j = i
            while j < len(w) and w[j] == w[j - p]:
                j += 1
            if j > i and j - (i - p) >= max(3 * p, 24):
                out.add((i - p, j, p))
            i = max(j, i) + 1
    return out


def brute_merge(found):
    merged = []
    for s, e, p in sorted(found, key=lambda c: (c[0], -c[1], c[2])):
        if merged and s < merged[-1][1]:
            if e > merged[-1][1]:
                merged[-1][1:] = [e, None]
        else:
            merged.append([s, e, p])
    return {tuple(m) for m in merged}


def test_loop_over_split_lines(spark):
    phrase = "this is the first thing they said today honest".split()
    many = phrase * 7
    texts = [" ".join(many[i : i + 7]) for i in range(0, len(many), 7)]
    assert "repeated_phrase_loop" in categories(quality.findings(segs(spark, texts), compression=False))
    summary = quality.by_source(segs(spark, texts), quality.findings(segs(spark, texts), compression=False)).first()
    assert summary["status"] == "review_required" and summary["timestamp_valid"] is None


def test_case_and_punctuation_do_not_hide_a_loop(spark):
    texts = ["We will all go home now.", "we will ALL go home, now", "We, will all go home now!", "we will all go home now"]
    found = quality.findings(segs(spark, texts), compression=False).collect()
    assert [r["repeated_word_count"] for r in found] == [24]


def test_sources_are_not_joined(spark):
    eight = "one two three four five six seven eight"
    both = segs(spark, [eight, eight], "a").unionByName(segs(spark, [eight, eight], "b"))
    assert quality.findings(both, compression=False).count() == 0


def test_short_repetition_passes(spark):
    assert quality.findings(segs(spark, ["no no no", "yes we can yes we can"]), compression=False).count() == 0


def test_empty_source_with_valid_audit(spark):
    audits = spark.createDataFrame([("s", True)], "source_id string, valid boolean")
    none = spark.createDataFrame([], SEGMENTS)
    found = quality.findings(none, audits=audits, compression=False)
    assert categories(found) == ["empty_transcript"]
    got = quality.by_source(none, found, audits).first()
    assert (got["status"], got["timestamp_valid"], got["segment_count"]) == ("review_required", True, 0)


@pytest.mark.parametrize("chunk", [5, 64, 100, 100000])
def test_loops_equal_brute_force_over_chunks(spark, chunk):
    rng = random.Random(chunk)
    sources = {}
    for n in range(6):
        w = []
        while len(w) < 500:
            phrase = [rng.choice("abcdefgh") for _ in range(rng.choice([1, 2, 3, 5, 9, 30, 64]))]
            w += phrase * rng.choice([1, 1, 2, 4, 9])
        sources[f"s{n}"] = w[:500]
    sources["loop"] = ["x", "y", "z"] * 200
    rows = []
    for s, w in sources.items():
        i, at = 0, 1
        while i < len(w):
            n = rng.choice([0, 1, 3, 17])
            rows.append((s, at, float(at), float(at + 1), " ".join(w[i : i + n])))
            i, at = i + n, at + 1
    df = spark.createDataFrame(rows, SEGMENTS)
    found = quality.loop_candidates(df, width=10, chunk_words=chunk)
    ranges = quality.merged_ranges(found, width=50)
    got, merged = {}, {}
    for r in found.collect():
        got.setdefault(r["source_id"], set()).add((r["start"], r["end"], r["period"]))
    for r in ranges.collect():
        merged.setdefault(r["source_id"], set()).add((r["start"], r["end"], r["period"]))
    for s, w in sources.items():
        assert got.get(s, set()) == brute_candidates(w)
        assert merged.get(s, set()) == brute_merge(brute_candidates(w))
    first = {(r["source_id"], r["start"]): r for r in ranges.collect()}
    for (s, start), r in first.items():
        holder = [i for (q, i, _, _, t) in rows if q == s for _ in t.split()]
        assert r["first_idx"] == holder[start] and r["last_idx"] == holder[r["end"] - 1]


def test_window_ratio_equals_one_shot(spark):
    rng = random.Random(5)
    texts = [" ".join(rng.choice(["alpha", "beta", "ça va", "x"]) for _ in range(rng.randint(0, 12))) for _ in range(90)]
    got = {r["bucket"]: r for r in quality.window_ratios(segs(spark, texts)).collect()}
    for b in range(6):
        text = " ".join(texts[15 * b : 15 * b + 15])
        if len(words(text)) >= 40:
            raw = text.encode()
            assert got[b]["ratio"] == len(raw) / len(zlib.compress(raw))
        else:
            assert b not in got


def test_three_valued_and(spark):
    df = spark.createDataFrame([("a", True), ("a", None), ("b", True), ("b", False), ("c", True)], "k string, v boolean")
    got = {r["k"]: r["x"] for r in df.groupBy("k").agg(quality.all_valid("v").alias("x")).collect()}
    assert got == {"a": None, "b": False, "c": True}


def test_verdict_lists_sorted_reasons(spark):
    summary = spark.createDataFrame([("r", "s", True), ("q", "t", None)], "run_id string, source_id string, timestamp_valid boolean")
    found = spark.createDataFrame([("r", "b"), ("r", "a"), ("r", "b")], "run_id string, category string")
    got = {r["run_id"]: r for r in quality.verdict(summary, found, ["run_id"]).collect()}
    assert got["r"]["reasons"] == ["a", "b"] and got["r"]["status"] == "review_required"
    assert got["q"]["status"] == "passed_checks" and not got["q"]["accuracy_verified"]


def test_review_flags(spark):
    texts = ["Hello there", "hello  THERE", "", "", "[Music]", "a b a b a b a b a b a b"]
    got = {r["idx"]: r["reasons"] for r in quality.review_flags(segs(spark, texts), width=2).collect()}
    assert got == {2: ["identical_adjacent_segment"], 5: ["non_speech_or_inaudible_marker"], 6: ["high_internal_repetition"]}


def test_glossary_warning_shows_no_terms(spark):
    sources = spark.createDataFrame([("s", ["Neyman"], 0), ("t", ["Neyman"], 224), ("u", [], 0)], "source_id string, terms array<string>, ctx int")
    got = quality.glossary_findings(sources, F.col("terms"), F.col("ctx"))
    assert [r["source_id"] for r in got.collect()] == ["s"] and "terms" not in got.columns


def test_words_in_python_are_those_of_the_column(spark):
    rng = random.Random(5)
    signs = "aZ09_ '’-.,\n\t\x1c\x0b\x85\u00a0ßéÀÿµ²ⅣﬁΣςİЖ中½①\u0301"
    texts = ["", "'", "a'b'c''d' 'e", "Don't STOP_now 3.5", None]
    texts += ["".join(rng.choice(signs[:some]) for _ in range(rng.randint(1, 30))) for some in (19, len(signs)) for _ in range(300)]
    rows = spark.createDataFrame([(t,) for t in texts], "text string").select("text", tokens_word("text").alias("w"), word_count("text").alias("n"))
    for r in rows.collect():
        if r["text"] is None:
            assert r["w"] is None and r["n"] is None
        else:
            assert (folded_words(r["text"]), r["n"]) == (r["w"], len(r["w"])), r["text"]


def test_text_is_not_matched_by_patterns_on_the_way_to_chunks(spark):
    """Words are found in one pass of Python per step and travel as text, not by three patterns a line and as arrays."""
    located = segs(spark, ["one two", "three"]).withColumns({"first_word": F.lit(0).cast("bigint"), "word_count": F.size(F.split("text", " "))})
    plan = quality._chunks(located, 64)._jdf.queryExecution().optimizedPlan().toString().lower()
    assert "regexp" not in plan and "rlike" not in plan
    assert "regexp" not in quality.window_ratios(located)._jdf.queryExecution().optimizedPlan().toString().lower()
    assert "regexp" not in quality.segment_words(located)._jdf.queryExecution().optimizedPlan().toString().lower()
    assert quality._chunks(located, 64).schema["seg_words"].dataType.simpleString() == "array<string>"


def test_pieces_are_cut_at_chunks_of_any_size(spark):
    words_of = " ".join(f"w{i % 7}" for i in range(300))
    located = segs(spark, [words_of]).withColumns({"first_word": F.lit(10).cast("bigint"), "word_count": F.lit(300)})
    got = {r["chunk"]: (r["lo"], " ".join(r["seg_words"]).split()) for r in quality._chunks(located, 100).collect()}
    want = words_of.split()
    assert sorted(got) == [0, 1, 2, 3]
    for chunk, (lo, part) in got.items():
        first = max(10, chunk * 100 - quality.MAX_PERIOD)
        assert lo == first and part == want[first - 10 : (chunk + 1) * 100 - 10]
