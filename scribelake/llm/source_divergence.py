"""How the sources of a language differ in their words, with the words' text moved last.

Tasks count terms by (language, source) and pass their counts on when they hold too many, into a table in the shared folder. From there
on terms are 64-bit digests: counts per source, document counts per language, shares and divergences are shuffled, joined and ranked by
digest. One pass over the table finds the least and the greatest text under every digest. Where they differ, terms collide: the counts
under such a digest are split by the text itself, so results are exact whatever the digest. Text returns in a join with the few rows
of the term report that are kept.

The sum of a pair of sources over all kept terms needs no row for a term that neither has: with f0 the value of a term at count zero
in both, it is V * f0, plus what the terms of either source add against zero in the other (a histogram of shares per source suffices for
that), plus a correction for terms that both have (a join by digest of the counts that exist).
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scribelake.llm.common import stored
from scribelake.session import checkpointed

#: A kept term is in so many documents of its language at least.
MIN_DOCS = 10
#: Terms of a group in the report.
TOP = 10
#: Terms a task counts before it passes them on.
HELD = 1_200_000
UNIT = 1_000_000_000
DIGEST_BITS = 64

# A term is a run of letters a to z and of characters above ASCII, so its bytes are those letters and bytes above 127.
_BYTES = bytes(b if b > 127 or 97 <= b <= 122 else b + 32 if 65 <= b <= 90 else 32 for b in range(256))


def terms_of(text: bytes) -> list[bytes]:
    """The terms of a text in UTF-8, in order; only A to Z are lower-cased."""
    return text.translate(_BYTES).split()


def _counted(docs: DataFrame, lang: Column, source: Column, text: Column) -> DataFrame:
    """``lang, source, term, n, docs``: occurrences and documents, one row per term of a group and batch of work."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[str, str], tuple[Counter, Counter]] = {}

        def passed_on() -> Iterator[pa.RecordBatch]:
            for (lang_, source_), (n, docs_) in held.items():
                size = len(n)
                columns = [pa.array([lang_] * size, pa.string()), pa.array([source_] * size, pa.string()), pa.array(list(n), pa.binary())]
                columns += [pa.array(list(n.values()), pa.int64()), pa.array([docs_[t] for t in n], pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, ["lang", "source", "term", "n", "docs"])
            held.clear()

        terms = 0
        for batch in batches:
            texts = batch.column(2)
            texts = texts.cast(pa.large_binary() if pa.types.is_large_string(texts.type) else pa.binary())
            for lang_, source_, text_ in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), texts.to_pylist()):
                found = terms_of(text_)
                if not found:
                    continue
                n, docs_ = held.setdefault((lang_, source_), (Counter(), Counter()))
                before = len(n)
                n.update(found)
                docs_.update(set(found))
                terms += len(n) - before
                if terms >= HELD:
                    yield from passed_on()
                    terms = 0
        yield from passed_on()

    plain = docs.select(lang.alias("lang"), source.alias("source"), text.alias("text"))
    found = plain.mapInArrow(count, "lang string, source string, term binary, n bigint, docs bigint")
    return found.withColumn("term", F.col("term").cast("string"))


def _div(a: Column, b: Column) -> Column:
    return F.call_function("div", a, b)


def _share(n: Column, total: Column) -> Column:
    """1 + floor(UNIT * (n + 2) / total), exactly."""
    scaled = (n + 2).cast("decimal(20,0)") * F.lit(UNIT).cast("decimal(10,0)")
    return _div(scaled, total.cast("decimal(20,0)")) + 1


def _apart(p: Column, q: Column) -> Column:
    """floor((p - q) ** 2 / (p + q))."""
    return _div((p - q) * (p - q), p + q)


def _identified(parts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``parts`` with ``split`` (empty, or the text of a term whose digest is another's too), and ``digest, text`` of all other digests."""
    names = stored(parts.groupBy("digest").agg(F.min("term").alias("text"), F.max("term").alias("last")), "divergence-names")
    clash = names.where("text <> last").select("digest", F.lit(True).alias("clash"))
    if clash.isEmpty():
        return parts.withColumn("split", F.lit("")), names.select("digest", "text")
    split = F.when(F.col("clash"), F.col("term")).otherwise(F.lit(""))
    return parts.join(clash, "digest", "left").withColumn("split", split), names.where("text = last").select("digest", "text")


def kept_counts(
    docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source", min_docs: int = MIN_DOCS, digest_bits: int = DIGEST_BITS
) -> tuple[DataFrame, DataFrame]:
    """``lang, source, digest, split, n, lang_n, lead`` of the kept terms that occur (one row of a term in its language has ``lead``),
    and ``digest, text``."""
    empty = F.lit("")
    columns = [F.coalesce(F.col(c).cast("string"), empty) for c in (lang_col, source_col, text_col)]
    digest = F.shiftrightunsigned(F.xxhash64("term"), 64 - digest_bits)
    parts, names = _identified(stored(_counted(docs, *columns).withColumn("digest", digest), "divergence-counts"))
    # Tasks have added up what they saw, so one exchange by term serves the sums by source and the window over a term's sources alike.
    met = parts.select("lang", "source", "digest", "split", "n", "docs").repartition("lang", "digest")
    counts = met.groupBy("lang", "source", "digest", "split").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    # As many rows as the language has sources.
    term = Window.partitionBy("lang", "digest", "split")
    known = counts.select(
        "lang", "source", "digest", "split", "n", F.sum("n").over(term).alias("lang_n"), F.sum("docs").over(term).alias("lang_docs"),
        (F.col("source") == F.min("source").over(term)).alias("lead"),
    )
    return stored(known.where(F.col("lang_docs") >= min_docs).drop("lang_docs"), "divergence-kept"), names


def group_facts(docs: DataFrame, kept: DataFrame, lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """``lang, source, v, total, lang_total, p0``: for every group its share at count zero and what shares are divided by."""
    groups = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(k) for c, k in ((lang_col, "lang"), (source_col, "source"))]).distinct()
    own = kept.groupBy("lang", "source").agg(F.sum("n").alias("n"), F.count_if("lead").alias("leads"))
    of_lang = own.groupBy("lang").agg(F.sum("leads").alias("v"), F.sum("n").alias("lang_n"))
    zero = F.lit(0).cast("bigint")
    rows = groups.join(own.drop("leads"), ["lang", "source"], "left").join(of_lang, "lang", "left").fillna(0, ["n", "v", "lang_n"])
    total = F.col("n") + 2 * F.col("v")
    facts = rows.select("lang", "source", "v", total.alias("total"), (F.col("lang_n") + 2 * F.col("v")).alias("lang_total"))
    return checkpointed(facts.withColumn("p0", F.when(F.col("v") > 0, _share(zero, F.col("total"))).otherwise(zero)))


def _terms(shares: DataFrame, names: DataFrame, top: int) -> DataFrame:
    """The terms that a source has most above its language; texts join the rows that can still be among the first."""
    above = shares.where("p > q").withColumn("value", _apart(F.col("p"), F.col("q")))
    by_value = Window.partitionBy("lang", "source").orderBy(F.desc("value"))
    near = above.withColumn("place", F.rank().over(by_value)).where(F.col("place") <= top)
    # Stored: Spark knows the size of these few rows and need not shuffle all names to meet them.
    named = stored(near, "divergence-near").join(names, "digest", "left").withColumn("item", F.when(F.col("split") != "", F.col("split")).otherwise(F.col("text")))
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    ranked = named.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    return ranked.select("lang", "source", F.lit("term").alias("part"), "item", "value", "rank")


def _pairs(shares: DataFrame, facts: DataFrame) -> DataFrame:
    """Every two sources of a language."""
    side = facts.select("lang", "source", "v", "p0")
    two = side.alias("a").join(side.alias("b"), (F.col("a.lang") == F.col("b.lang")) & (F.col("a.source") < F.col("b.source"))).select(
        F.col("a.lang").alias("lang"), F.col("a.source").alias("one"), F.col("b.source").alias("other"), F.col("a.v").alias("v"),
        F.col("a.p0").alias("one0"), F.col("b.p0").alias("other0"),
    )
    # Terms of one source against zero in another: as many rows as a source has different shares.
    steps = checkpointed(shares.groupBy("lang", "source", "p", "p0").agg(F.count("*").alias("k")))
    alone = steps.alias("s").join(side.alias("o"), (F.col("s.lang") == F.col("o.lang")) & (F.col("s.source") != F.col("o.source")))
    gain = F.col("s.k") * (_apart(F.col("s.p"), F.col("o.p0")) - _apart(F.col("s.p0"), F.col("o.p0")))
    single = alone.groupBy(
        F.col("s.lang").alias("lang"), F.least("s.source", "o.source").alias("one"), F.greatest("s.source", "o.source").alias("other")
    ).agg(F.sum(gain).alias("gain"))
    # Terms of both.
    cell = shares.select("lang", "digest", "split", "source", "p", "p0")
    a, b = cell.alias("a"), cell.alias("b")
    same = (F.col("a.lang") == F.col("b.lang")) & (F.col("a.digest") == F.col("b.digest")) & (F.col("a.split") == F.col("b.split"))
    p, q, p0, q0 = F.col("a.p"), F.col("b.p"), F.col("a.p0"), F.col("b.p0")
    more = _apart(p, q) - _apart(p, q0) - _apart(p0, q) + _apart(p0, q0)
    both = a.join(b, same & (F.col("a.source") < F.col("b.source"))).groupBy(
        F.col("a.lang").alias("lang"), F.col("a.source").alias("one"), F.col("b.source").alias("other")
    ).agg(F.sum(more).alias("gain"))
    gains = single.unionByName(both).groupBy("lang", "one", "other").agg(F.sum("gain").alias("gain"))
    base = F.when(F.col("v") > 0, F.col("v") * _apart(F.col("one0"), F.col("other0"))).otherwise(F.lit(0).cast("bigint"))
    value = base + F.coalesce("gain", F.lit(0).cast("bigint"))
    apart = two.join(gains, ["lang", "one", "other"], "left").select("lang", "one", "other", value.alias("value"))
    sides = F.explode(F.array(F.struct(F.col("one").alias("source"), F.col("other").alias("item")), F.struct(F.col("other").alias("source"), F.col("one").alias("item"))))
    rows = apart.select("lang", sides.alias("s"), "value").select("lang", "s.source", F.lit("pair").alias("part"), "s.item", "value")
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")))


def audit(
    docs: DataFrame,
    text_col: str = "text",
    lang_col: str = "lang",
    source_col: str = "source",
    min_docs: int = MIN_DOCS,
    top: int = TOP,
    digest_bits: int = DIGEST_BITS,
) -> DataFrame:
    """``lang, source, part, item, value, rank``.

    Part ``pair`` holds every other source of the language and how far the two differ, over all kept terms; part ``term`` holds a
    source's ``top`` terms above its language. Null texts, languages and sources count as empty; a group without terms takes part in the
    pairs; repeated rows are documents like any other. A language without kept terms has pairs of value 0 and no terms. Equal values
    are ranked by item in byte order. An empty table gives no rows. Other columns are not read. ``digest_bits`` below 64 is for tests.
    """
    kept, names = kept_counts(docs, text_col, lang_col, source_col, min_docs, digest_bits)
    facts = group_facts(docs, kept, lang_col, source_col)
    shares = kept.join(facts, ["lang", "source"]).select(
        "lang", "source", "digest", "split", "p0",
        _share(F.col("n"), F.col("total")).alias("p"), _share(F.col("lang_n"), F.col("lang_total")).alias("q"),
    )
    return _pairs(shares, facts).unionByName(_terms(shares, names, top)).select("lang", "source", "part", "item", "value", "rank")
