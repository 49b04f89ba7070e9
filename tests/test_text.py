import random
import unicodedata

import pytest
from pyspark.sql import functions as F

from scribelake.functions import clocks as clk
from scribelake.functions import text as tx
from scribelake.operators import library as lib


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def test_fold_equals_python(spark):
    rng = random.Random(3)
    pool = "aZ ßÉ½ﬁΣςİıμµª…’–٣Ａé" + "é" + "  한ﾊ" + "".join(chr(c) for c in range(0xA1, 0x180))
    texts = ["".join(rng.choice(pool) for _ in range(rng.randint(0, 12))) for _ in range(400)] + ["Straße", "plain"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    for r in df.select("t", tx.fold("t").alias("k"), tx.fold_nfc("t").alias("c"), tx.tokens_ws("t").alias("w")).collect():
        assert r["k"] == unicodedata.normalize("NFKC", r["t"]).casefold()
        assert r["c"] == unicodedata.normalize("NFC", r["t"]).casefold()
        assert r["w"] == unicodedata.normalize("NFKC", r["t"]).casefold().split()


def test_plain_set_is_exact():
    import re

    plain = re.compile(tx._PLAIN)
    for code in range(0x3000):
        ch = chr(code)
        if plain.match(ch):
            assert ch.lower().replace("ß", "ss") == unicodedata.normalize("NFKC", ch).casefold(), hex(code)


@pytest.mark.parametrize(
    "text, tokens",
    [
        ("O’Neill can’t reject H1N1 at −2.50%; Neyman, not Newman.", "o'neill can't reject h1n1 at - 2.50 % neyman not newman".split()),
        ("1,000 1000 2e-3 ¬p ∧ q ≠ 0 $5", "1,000 1000 2e-3 ¬ p ∧ q ≠ 0 $ 5".split()),
        ("", []),
    ],
)
def test_review_tokens(spark, text, tokens):
    assert one(spark, tx.tokens_review(F.lit(text))) == tokens


def test_markdown_and_lines(spark):
    assert one(spark, tx.md_escape(F.lit(r"a*b_[c]<d>#!|`\{}"))) == r"a\*b\_\[c\]\<d\>\#\!\|\`\\\{\}"
    text = "a\r\nb\rc\x0bd e\n"
    assert one(spark, tx.text_lines(F.lit(text))) == text.splitlines()


def test_natural_order(spark):
    names = ["a10.wav", "a2.wav", "a02.wav", "10.wav", "9.wav", "b1.wav", "a.wav", "A3.wav", "a99999999999999999999999.wav"]
    df = spark.createDataFrame([(n,) for n in names], "path string")
    got = [r["path"] for r in lib.natural_sort(df).collect()]

    def key(n):
        import re

        return tuple((0, int(p)) if p.isdigit() else (1, p) for p in re.split(r"([0-9]+)", n.casefold()) if p), n

    assert got == sorted(names, key=key)


def test_small_forms(spark):
    assert one(spark, tx.cpu_seconds(F.lit("1-02:03:04.5"))) == 93784.5
    assert one(spark, tx.cpu_seconds(F.lit("x:1"))) is None
    assert one(spark, tx.export_name(F.lit("/x/talk.v2.wav"), F.lit("srt"))) == "talk.v2_transcript.srt"
    assert one(spark, tx.slug(F.lit("Ära / Kurs  1!"))) == "Ära-Kurs-1"
    assert one(spark, tx.slug(F.lit("///"))) == "recordings"
    assert one(spark, tx.clean_title(F.lit("  a \t b "))) == "a b"
    assert one(spark, tx.clean_title(F.lit("x" * 161))) is None
    assert one(spark, tx.dbfs(F.lit(0.0))) is None
    assert one(spark, tx.suffix(F.lit("/a/.wav"))) == ""


@pytest.mark.parametrize(
    "name, explicit, day, clock, zone, provenance",
    [
        ("audio_240229_235959_32bit_orig.wav", None, "2024-02-29", "23:59:59", None, "filename"),
        ("audio_230229_000000.wav", None, None, None, None, "unknown"),
        ("audio_240132_000000.wav", None, None, None, None, "unknown"),
        ("audio_240101_240000.wav", None, None, None, None, "unknown"),
        ("notes_240101_000000.wav", None, None, None, None, "unknown"),
        ("audio_240101_000000.wav", "2024-05-06T07:08:09Z", "2024-05-06", "07:08:09", "UTC", "explicit_metadata"),
        ("x.wav", "2024-05-06T07:08:09.25+02:30", "2024-05-06", "07:08:09", "UTC+02:30", "explicit_metadata"),
        ("audio_240101_000000.wav", "2024-02-30T00:00:00", None, None, None, "invalid_explicit_metadata"),
        ("audio_240101_000000.wav", "yesterday", None, None, None, "invalid_explicit_metadata"),
    ],
)
def test_recording_time(spark, name, explicit, day, clock, zone, provenance):
    r = one(spark, clk.recording_time(F.lit(name), F.lit(explicit).cast("string")))
    assert (r["date"], r["time"], r["timezone"], r["provenance"]) == (day, clock, zone, provenance)
    assert r["confirmed"] == (provenance == "explicit_metadata")


def test_recording_interval_keeps_no_zone(spark):
    r = one(spark, clk.recording_interval(F.lit(None).cast("string"), F.lit("2024-01-01T23:59:59"), F.lit(1.5)))
    assert (r["started_at"], r["ended_at"], r["timezone_status"]) == ("2024-01-01T23:59:59", "2024-01-02T00:00:00.500000", "unknown")
    r = one(spark, clk.recording_interval(F.lit("bad"), F.lit(None).cast("string"), F.lit(1.0)))
    assert r["invalid_explicit_recorded_at"] and r["started_at"] is None


def test_instant_honours_offset(spark):
    assert one(spark, clk.instant(F.lit("1970-01-01T02:00:00.5+02:00"))) == 0.5
    assert one(spark, clk.instant(F.lit("1970-01-01T02:00:00"))) is None


def test_gap_groups(spark):
    def at(h, m, s):
        return 86400.0 * 19000 + h * 3600 + m * 60 + s

    rows = [("b", 0, "d", at(9, 0, 0)), ("b", 1, "d", at(9, 1, 10)), ("b", 2, "d", at(9, 1, 30)), ("b", 3, "d", at(11, 0, 0))]
    df = spark.createDataFrame([(*r, None, 60.0) for r in rows], "batch_id string, pos long, day string, at_seconds double, offset string, duration double")
    for width in (1, 2, 100):
        got = {r["pos"]: (r["group_no"], r["issue"]) for r in lib.gap_groups(df, width=width).collect()}
        assert [got[i][0] for i in range(4)] == [1, 1, 2, 3]
        assert got[1][1] == "10 second gap" and "overlap" in got[2][1] and got[0][1] is None


@pytest.mark.parametrize(
    "text, defect",
    [('{"a": 1}', None), ('{"a": 1, "a": 2}', "duplicate_key"), ('{"a": {"b": 1, "b": 1}}', "duplicate_key"), ("[NaN]", "non_finite_number"), ("{", "syntax"), (None, "missing")],
)
def test_strict_json(spark, text, defect):
    assert one(spark, tx.json_defect(F.lit(text).cast("string"))) == defect
