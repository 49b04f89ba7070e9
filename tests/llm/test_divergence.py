"""The divergence audit against a dense count in plain Python."""

import random
import re
from collections import Counter, defaultdict

import pytest
from conftest import prose
from pyspark.sql import functions as F

from scribelake.llm import source_divergence

TERM = re.compile("[^\x00-\x40\x5b-\x60\x7b-\x7f]+")


def brute(rows, min_docs=10, top=10):
    docs = [((g or "", s or ""), Counter(TERM.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")))) for t, g, s in rows]
    seen, total, own = defaultdict(Counter), defaultdict(Counter), defaultdict(Counter)
    for (g, s), terms in docs:
        seen[g].update(set(terms))
        total[g].update(terms)
        own[g, s].update(terms)
    groups = {k for k, _ in docs}
    kept = {g: [t for t, n in seen[g].items() if n >= min_docs] for g in {g for g, _ in groups}}

    def share(counts, terms):
        n = sum(counts[t] for t in terms)
        return {t: 1 + 1_000_000_000 * (counts[t] + 2) // (n + 2 * len(terms)) for t in terms}

    p = {k: share(own[k], kept[k[0]]) for k in groups}
    q = {g: share(total[g], kept[g]) for g in kept}

    def f(a, b):
        return (a - b) ** 2 // (a + b)

    out = set()
    for g, s in groups:
        pairs = [(o, sum(f(p[g, s][t], p[g, o][t]) for t in kept[g])) for h, o in groups if h == g and o != s]
        terms = [(t, f(p[g, s][t], q[g][t])) for t in kept[g] if own[g, s][t] and p[g, s][t] > q[g][t]]
        for part, items, limit in (("pair", pairs, None), ("term", terms, top)):
            ranked = sorted(items, key=lambda x: (-x[1], x[0].encode()))[:limit]
            out |= {(g, s, part, item, value, k) for k, (item, value) in enumerate(ranked, 1)}
    return out


@pytest.fixture(scope="module")
def rows():
    r = random.Random(4)
    accents = ["ÀB", "àb", "Ünï", "Straße", "ÉCOLE", "你好", "🙂", "x\x85y", "a b", "don't", "A1b2", "_k_", "\x00z"]
    out = []
    for i in range(240):
        source = "hot" if i % 3 == 0 else f"s{r.randrange(5)}"
        words = prose(i, r.randrange(1, 40)).split() + [r.choice(accents) for _ in range(3)] + [f"{source}word"] * r.randrange(3)
        out.append((" ".join(words).title() if i % 7 == 0 else "\n".join(words), "en" if i % 5 else "de", source))
    out += [(" ".join(prose(9, 5000).split()), "en", "long")]
    out += [(None, "en", "silent"), ("", None, None), ("12 34", None, "n"), (None, None, None), ("rare words only", "fr", "f"), ("", "fr", None), ("alone", "it", "i")]
    out += [("same row again", "en", "s1")] * 12  # repeated rows are documents
    out += [("tied one two six ten", "tie", f"t{i % 3}") for i in range(36)]
    return out


@pytest.mark.parametrize("bits", [64, 6, 3])
def test_audit_is_exact_whatever_the_digest(spark, rows, bits):
    df = spark.createDataFrame([(t, g, s, 1, "x", 2) for t, g, s in rows], "text string, lang string, source string, n int, term string, digest int").repartition(6)
    got = source_divergence.audit(df, digest_bits=bits).collect()
    assert len(got) == len(set(map(tuple, got)))
    assert set(map(tuple, got)) == brute(rows)


def test_counts_passed_on_early_and_empty_tables(spark, rows, monkeypatch):
    monkeypatch.setattr(source_divergence, "HELD", 7)
    df = spark.createDataFrame(rows, "text string, lang string, source string").repartition(2)
    assert set(map(tuple, source_divergence.audit(df, min_docs=3, top=2).collect())) == brute(rows, 3, 2)
    assert source_divergence.audit(df.where("false")).collect() == []


def test_digests_with_one_text_are_not_split(spark, rows):
    df = spark.createDataFrame(rows, "text string, lang string, source string")
    kept, names = source_divergence.kept_counts(df)
    assert kept.where("split <> ''").isEmpty() and kept.join(names, "digest", "left_anti").isEmpty()
    kept, names = source_divergence.kept_counts(df, digest_bits=3)
    assert kept.where("split <> ''").count() > 8 and kept.where("split = ''").join(names, "digest", "left_anti").isEmpty()


def test_a_task_adds_up_what_it_sees(spark):
    """Of 900,000 terms that a task meets twice there is one row each: what is stored and shuffled does not repeat them."""
    letters = "abcdefghijklmnopqrstuvwxyz"
    texts = [" ".join("".join(letters[n // 26**k % 26] for k in range(5)) for n in range(a, a + 300_000)) for a in (0, 300_000, 600_000)]
    df = spark.createDataFrame([(t, "en", "s") for t in [*texts, *texts]], "text string, lang string, source string").coalesce(1)
    found = source_divergence._counted(df, F.col("lang"), F.col("source"), F.col("text"))
    assert tuple(found.agg(F.count("*"), F.min("n"), F.max("n"), F.sum("docs")).first()) == (900_000, 2, 2, 1_800_000)
