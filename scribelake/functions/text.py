"""Text functions. Built-in SQL wherever it says the same; Arrow UDFs where not."""

from __future__ import annotations

import difflib
import re
import unicodedata
import zlib

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Characters whose NFKC + casefold equals lower() with ß -> ss.
# ASCII, the Latin-1 letters, and plain punctuation without compatibility forms.
_PLAIN = (
    r"^[\x00-\x7F¡-§©«-®°±¶·»¿-ÿ"
    r"‐‒-―‘-‟•€]*$"
)

# Word and whitespace classes equal to the reference's Unicode ones.
WORD = r"[\p{L}\p{N}_]+(?:['’][\p{L}\p{N}_]+)*"
SPACE = r"[\s\x1C-\x1F\x85\p{Z}]+"

# Markdown characters that are escaped.
MARKDOWN_SPECIAL = r"([\\`*_{}\[\]<>#!|])"

# Line boundaries besides LF that also end a line.
LINE_END = r"\r\n|[\r\x0B\x0C\x1C-\x1E\x85  ]"


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


@F.pandas_udf(T.StringType())
def _fold_nfkc(s: pd.Series) -> pd.Series:
    return s.map(lambda x: None if x is None else unicodedata.normalize("NFKC", x).casefold())


@F.pandas_udf(T.StringType())
def _casefold(s: pd.Series) -> pd.Series:
    return s.map(lambda x: None if x is None else x.casefold())


@F.pandas_udf(T.StringType())
def _fold_nfc(s: pd.Series) -> pd.Series:
    return s.map(lambda x: None if x is None else unicodedata.normalize("NFC", x).casefold())


def _fold(c: Column, general) -> Column:
    """Plain text is folded in the JVM; only the rest crosses to Python."""
    plain = c.rlike(_PLAIN)
    native = F.when(plain, F.replace(F.lower(c), F.lit("ß"), F.lit("ss")))
    return F.coalesce(native, general(F.when(~plain, c)))


def fold(c: Column | str) -> Column:
    """NFKC and casefold."""
    return _fold(_col(c), _fold_nfkc)


def fold_nfc(c: Column | str) -> Column:
    """NFC and casefold."""
    return _fold(_col(c), _fold_nfc)


def casefold(c: Column | str) -> Column:
    """Casefold alone: compatibility forms stay as they are."""
    return _fold(_col(c), _casefold)


def tokens_ws(c: Column | str) -> Column:
    """Folded tokens split on whitespace, as an array."""
    return F.filter(F.split(fold(c), SPACE), lambda t: t != "")


def tokens_word(c: Column | str) -> Column:
    """Folded words; inner apostrophes join."""
    return F.regexp_extract_all(fold(c), F.lit(WORD), F.lit(0))


# The same words in Python, whose word class holds exactly the letters, numbers and underscore.
_WORDS = re.compile(r"\w+(?:['’]\w+)*")
# ASCII that is in no word; apostrophes, which may be inside one, are left to the pattern.
_GAPS = {i: " " for i in range(128) if not re.match(r"\w", chr(i))}


def folded_words(text: str) -> list[str]:
    """``tokens_word`` of one text, for passes that run in Python anyway or cut the words there."""
    if not text.isascii():
        return _WORDS.findall(unicodedata.normalize("NFKC", text).casefold())
    return _WORDS.findall(text.lower()) if "'" in text else text.lower().translate(_GAPS).split()


@F.pandas_udf(T.IntegerType())
def word_count(s: pd.Series) -> pd.Series:
    """Size of ``tokens_word``."""
    return s.map(lambda x: None if x is None else len(folded_words(x))).astype("Int32")


# Review tokens are words, numbers, other runs, operators and symbols; apostrophe and minus forms are one.
REVIEW_TOKEN = (
    r"[\p{L}\p{Nl}\p{No}][\p{L}\p{N}]*(?:'[\p{L}\p{N}]+)*|\p{Nd}+(?:[.,]\p{Nd}+)*(?:e[+-]?\p{Nd}+)?"
    r"|[\p{L}\p{N}]+(?:'[\p{L}\p{N}]+)*|[+\-*/=<>≤≥≠±×÷%]|[\p{Sm}\p{Sc}]"
)
REVIEW_FORMS = ("\u2018\u2019\u02bc\u2212", "'''-")


def tokens_review(c: Column | str) -> Column:
    """Scored tokens: words, numbers, operators, and mathematical or currency symbols between them."""
    return F.regexp_extract_all(F.translate(fold_nfc(c), *REVIEW_FORMS), F.lit(REVIEW_TOKEN), F.lit(0))


def clock_text(seconds: Column | str, *, srt: bool = False) -> Column:
    """Signed HH:MM:SS.mmm; hours may pass 99; halves round to even."""
    x = _col(seconds)
    negative = F.lit(False) if srt else x < 0
    ms = F.greatest(F.lit(0), F.bround(F.when(negative, F.abs(x)).otherwise(x) * 1000).cast("bigint"))
    hours = F.floor(ms / 3600000).cast("bigint")
    two = lambda c: F.lpad(c.cast("string"), 2, "0")
    hours_text = F.when(hours < 100, two(hours)).otherwise(hours.cast("string"))
    minutes = F.floor(ms / 60000).cast("bigint") % 60
    secs = F.floor(ms / 1000).cast("bigint") % 60
    mark = "," if srt else "."
    return F.concat(
        F.when(negative, "-").otherwise(""), hours_text, F.lit(":"), two(minutes), F.lit(":"), two(secs),
        F.lit(mark), F.lpad((ms % 1000).cast("string"), 3, "0"),
    )


def md_escape(c: Column | str) -> Column:
    return F.regexp_replace(_col(c), MARKDOWN_SPECIAL, r"\\$1")


def text_lines(c: Column | str) -> Column:
    """Lines of a text under every line boundary, without a trailing empty line."""
    unified = F.regexp_replace(_col(c), LINE_END, "\n")
    lines = F.split(unified, "\n")
    last_empty = F.element_at(lines, -1) == ""
    return F.when(last_empty, F.slice(lines, 1, F.size(lines) - 1)).otherwise(lines)


def strip(c: Column | str) -> Column:
    """Without leading and trailing whitespace of any kind."""
    return F.regexp_replace(_col(c), f"^{SPACE}|{SPACE}$", "")


def squeeze(c: Column | str) -> Column:
    """Trim and collapse whitespace to single spaces."""
    return F.trim(F.regexp_replace(_col(c), SPACE, " "))


@F.pandas_udf(T.StringType())
def _nfc(s: pd.Series) -> pd.Series:
    return s.map(lambda x: None if x is None else unicodedata.normalize("NFC", x))


def nfc(c: Column | str) -> Column:
    x = _col(c)
    plain = x.rlike(_PLAIN)
    return F.coalesce(F.when(plain, x), _nfc(F.when(~plain, x)))


def clean_title(c: Column | str) -> Column:
    """One-line title of 1 to 160 characters without control characters, else null."""
    t = squeeze(nfc(c))
    ok = (F.length(t) >= 1) & (F.length(t) <= 160) & ~t.rlike(r"\p{C}")
    return F.when(ok, t)


def slug(title: Column | str) -> Column:
    """Folder-safe form of a cleaned title, at most 72 characters."""
    t = F.regexp_replace(_col(title), r"[^\p{L}\p{N}_-]", "-")
    t = F.regexp_replace(t, r"-+", "-")
    t = F.substring(F.regexp_replace(t, r"^[-_]+|[-_]+$", ""), 1, 72)
    return F.when(t == "", F.lit("recordings")).otherwise(t)


def basename(path: Column | str) -> Column:
    return F.substring_index(_col(path), "/", -1)


def suffix(path: Column | str) -> Column:
    """Lower-case extension of the last path component; empty when there is none."""
    name = basename(path)
    return F.lower(F.regexp_extract(name, r"^.+\.([^.]+)$", 1))


def natural_key(path: Column | str) -> Column:
    """Order key: digit runs compare as integers and come before text."""
    name = fold_nfc(basename(path))
    parts = F.regexp_extract_all(name, F.lit("[0-9]+|[^0-9]+"), F.lit(0))
    return F.transform(
        parts,
        lambda p: F.struct(
            (~p.rlike("^[0-9]")).cast("int").alias("kind"),
            # Leading zeros do not count; length first makes the text order numeric at any size.
            F.when(p.rlike("^[0-9]"), F.length(F.regexp_replace(p, "^0+(?=.)", ""))).alias("digits"),
            F.when(p.rlike("^[0-9]"), F.regexp_replace(p, "^0+(?=.)", "")).otherwise(p).alias("text"),
        ),
    )


def export_name(filename: Column | str, fmt: Column | str) -> Column:
    """``talk.wav`` -> ``talk_transcript.md``; unknown formats become md."""
    f = _col(fmt)
    known = F.when(f.isin("md", "txt", "srt", "json"), f).otherwise("md")
    base = F.regexp_replace(basename(filename), r"(?<=.)\.[^.]*$", "")
    return F.concat(base, F.lit("_transcript."), known)


def dbfs(v: Column | str) -> Column:
    x = _col(v)
    return F.when(x > 0, 20 * F.log10(x))


def cpu_seconds(c: Column | str) -> Column:
    """``[dd-]hh:mm:ss.ss`` to seconds, null when a piece is not a number."""
    x = _col(c)
    has_days = F.instr(x, "-") > 0
    days = F.when(has_days, F.substring_index(x, "-", 1).try_cast("int")).otherwise(0)
    rest = F.when(has_days, F.regexp_replace(x, "^[^-]*-", "")).otherwise(x)
    pieces = F.transform(F.split(rest, ":"), lambda p: F.trim(p).try_cast("double"))
    total = F.aggregate(pieces, F.lit(0.0), lambda acc, p: acc * 60 + p)
    return total + days * 86400


def valid_id(c: Column | str) -> Column:
    x = _col(c)
    return x.isNotNull() & x.rlike(r"^[A-Za-z0-9][A-Za-z0-9_-]{0,95}$") & ~x.rlike(r"\n")


def valid_sha(c: Column | str) -> Column:
    x = _col(c)
    return x.isNotNull() & x.rlike(r"^[0-9a-f]{64}$") & (F.length(x) == 64)


@F.pandas_udf(T.DoubleType())
def agreement_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """Sequence agreement of whitespace tokens."""
    return pd.Series(
        [
            None if x is None or y is None else difflib.SequenceMatcher(None, x.split(), y.split()).ratio()
            for x, y in zip(a, b)
        ],
        dtype="float64",
    )


@F.pandas_udf(T.DoubleType())
def compression_ratio(s: pd.Series) -> pd.Series:
    """UTF-8 bytes per zlib byte, unrounded."""

    def ratio(x):
        if x is None:
            return None
        raw = x.encode("utf-8")
        return len(raw) / len(zlib.compress(raw))

    return s.map(ratio).astype("float64")


@F.pandas_udf(T.StringType())
def json_defect(s: pd.Series) -> pd.Series:
    """Why a JSON text is refused: duplicate key, non-finite number, or syntax."""
    import json

    class _Refused(ValueError):
        pass

    def unique(pairs):
        seen = dict(pairs)
        if len(seen) != len(pairs):
            raise _Refused("duplicate_key")
        return seen

    def no_constant(_):
        raise _Refused("non_finite_number")

    def check(x):
        if x is None:
            return "missing"
        try:
            json.loads(x, object_pairs_hook=unique, parse_constant=no_constant)
        except _Refused as refused:
            return str(refused)
        except (ValueError, RecursionError):
            return "syntax"
        return None

    return s.map(check)
