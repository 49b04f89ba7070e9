import random
import time

import pytest
from pyspark.sql import functions as F

from scribelake.functions.alignment import batch_counts, edit_counts
from scribelake.functions.text import tokens_review
from scribelake.operators import review


def slow_counts(ref, hyp):
    """Row by row, with the tie order spelled out."""
    table = {(0, j): (j, 0, 0, j) for j in range(len(hyp) + 1)}
    for i in range(1, len(ref) + 1):
        table[i, 0] = (i, 0, i, 0)
        for j in range(1, len(hyp) + 1):
            if ref[i - 1] == hyp[j - 1]:
                table[i, j] = table[i - 1, j - 1]
                continue
            options = []
            for (a, b), (s, d, n) in (((i - 1, j - 1), (1, 0, 0)), ((i - 1, j), (0, 1, 0)), ((i, j - 1), (0, 0, 1))):
                c, x, y, z = table[a, b]
                options.append((c + 1, x + s, y + d, z + n))
            table[i, j] = min(options, key=lambda o: o[0])
    return table[len(ref), len(hyp)][1:]


@pytest.mark.parametrize(
    "hyp, counts",
    [("alpha beta delta", (1, 0, 0)), ("alpha gamma", (0, 1, 0)), ("alpha beta extra gamma", (0, 0, 1)), ("", (0, 3, 0)), ("alpha delta gamma extra", (1, 0, 1))],
)
def test_counts(hyp, counts):
    assert edit_counts("alpha beta gamma".split(), hyp.split()) == counts


def test_counts_equal_slow_form():
    rng = random.Random(11)
    for _ in range(300):
        a = [rng.choice("abc") for _ in range(rng.randint(0, 14))]
        b = [rng.choice("abc") for _ in range(rng.randint(0, 14))]
        assert edit_counts(a, b) == slow_counts(a, b), (a, b)


def test_counts_of_many_pairs_together():
    rng = random.Random(12)
    text = lambda most: [rng.choice("abcd") for _ in range(rng.randint(0, most))]
    pairs = [(text(60), text(60)) for _ in range(200)]
    assert [tuple(row) for row in batch_counts(pairs)] == [slow_counts(a, b) for a, b in pairs]


@pytest.mark.parametrize("n, m", [(17000, 4), (4, 17000)])
def test_counts_of_texts_beyond_small_cells(n, m):
    rng = random.Random(13)
    a, b = [rng.choice("abc") for _ in range(n)], [rng.choice("abc") for _ in range(m)]
    assert edit_counts(a, b) == slow_counts(a, b)


def test_texts_of_unlike_length_cost_their_own_cells():
    rng = random.Random(14)
    text = lambda: [rng.choice("abcdefgh") for _ in range(rng.randint(0, 300))]
    pairs = [(text(), text()) for _ in range(1200)]
    began = time.process_time()
    batch_counts(pairs)
    # 27 million cells: 15 s where pairs meet by their sum alone and a cell is three numbers, 0.3 s now.
    assert time.process_time() - began < 5


def refs(spark, **changes):
    import hashlib

    text = changes.pop("human_text", "alpha beta")
    row = dict(
        clip_id="c", status="verified", human_text=text, human_confirmed=True, created_at="2024-01-01T00:00:00Z",
        updated_at="2024-01-01T00:00:00+00:00", verified_at="2024-01-01T00:00:00Z", verified_text_sha256=hashlib.sha256(text.encode()).hexdigest(),
    )
    row.update(changes)
    schema = "clip_id string, status string, human_text string, human_confirmed boolean, created_at string, updated_at string, verified_at string, verified_text_sha256 string"
    df = spark.createDataFrame([tuple(row[c.split(" ")[0]] for c in schema.split(", "))], schema)
    return review.attested(df, tokens_review("human_text")).first()


def test_attested(spark):
    assert refs(spark)["usable"]
    assert not refs(spark, status="draft")["usable"] and refs(spark, status="draft")["reject_reason"] is None
    assert refs(spark, human_confirmed=False)["reject_reason"] == "not_confirmed"
    assert refs(spark, verified_at="2024-01-01T00:00:00")["reject_reason"] == "timestamp"
    assert refs(spark, verified_text_sha256="0")["reject_reason"] == "text_changed"
    assert refs(spark, human_text="...")["reject_reason"] == "no_tokens"
    assert refs(spark, status="strange")["reject_reason"] == "unknown_status"


@pytest.mark.parametrize("text", ["a [inaudible] b", "(unclear word) x", "【听不清】", "what ??? now", "[quite Unclear]"])
def test_uncertain_text_is_no_reference(spark, text):
    assert refs(spark, human_text=text)["reject_reason"] == "uncertainty_marker"


@pytest.mark.parametrize("text", ["it is unclear to me", "what?? [music] now"])
def test_plain_words_stay(spark, text):
    assert refs(spark, human_text=text)["usable"]


def test_unverified_gives_null_and_totals_are_weighted(spark):
    rows = [("a", ["x"] * 10, ["x"] * 10, True), ("b", ["x"], ["y"], True), ("c", ["x"], ["z"], False)]
    df = spark.createDataFrame(rows, "clip string, ref array<string>, hyp array<string>, ok boolean")
    scores = review.scored(df, "ref", "hyp", F.col("ok"))
    got = {r["clip"]: r["WER"] for r in scores.collect()}
    assert got == {"a": 0.0, "b": 1.0, "c": None}
    total = review.aggregate_wer(scores).first()
    assert total["WER"] == 1 / 11 and (total["verified_clips"], total["total_clips"]) == (2, 3)
    none = review.aggregate_wer(review.scored(df, "ref", "hyp", F.lit(False))).first()
    assert none["WER"] is None and none["S"] is None


def test_term_accuracy_needs_every_judgment(spark):
    rows = [("m", "technicalterm", True, True, "correct"), ("m", "technicalterm", True, True, "incorrect"), ("n", "technicalterm", True, True, "pending"), ("o", "number", True, True, "correct"), ("p", "technicalterm", True, False, "correct")]
    df = spark.createDataFrame(rows, "clip string, category string, verified boolean, available boolean, judgment string")
    got = {r["clip"]: (r["term_accuracy"], r["status"]) for r in review.term_accuracy(df, "clip").collect()}
    assert got == {"m": (0.5, "verified_subset"), "n": (None, "incomplete_judgments"), "o": (None, "not_measured"), "p": (None, "candidate_unavailable")}


def test_overlapping_occurrences(spark):
    df = spark.createDataFrame([(["a", "a", "a", "b"], ["a", "a"]), (["a"], ["a", "a"]), (["a"], [])], "t array<string>, p array<string>")
    assert [r["n"] for r in df.select(review.phrase_occurrences(F.col("t"), F.col("p")).alias("n")).collect()] == [2, 0, 0]
