"""Line dedup by content-defined chunks.

Lines are hashed, and a hash over each pair of neighbouring line hashes decides whether a chunk ends there: a boundary depends
on the two lines beside it only, so text put in before a passage does not move the boundaries inside. A line of ``min_words``
words or more is a chunk by itself. Chunks of several lines (or of one such long line) that occur more than once in the whole
corpus are removed, except for their first occurrence, by document id and place.

With ``passages`` (the query and the pipeline) every repeated run of lines of ``min_words`` words or more goes as well, wherever
chunks end. Such a run is covered by windows: the shortest runs of that many words that begin, or end, at one of its lines. A line
from which no window fits into the rest of the run lies in the window that ends with the run. A window depends on its own lines
only, so equal runs have equal windows, and a line goes if it lies in a window that occurs earlier without overlapping it. Blank
lines in a row count as one line here; where two runs differ in the number of blank lines at an edge, those stay.

Chunks and windows meet by a 128-bit digest. Before anything is removed, repeated ones are compared as sequences of line digests,
and their lines by bytes, each line once; if two different ones share a digest, all is done again with another salt. So what is
removed is equal byte for byte.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scribelake.session import checkpointed

#: Mean number of lines between two boundaries.
DIVISOR = 2
MIN_WORDS = 50
KEY = ["_id", "_h1", "_h2"]
#: Above the number of lines of any text.
LINES = 1 << 31


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Rows are named by id and text, so repeated rows share one fate; ids compare null-safe as text."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.select(
        "*",
        F.coalesce(F.concat(F.lit("="), F.col(id_col).cast("string")), F.lit("")).alias("_id"),
        F.xxhash64(text).alias("_h1"),
        F.xxhash64(F.lit(7), text).alias("_h2"),
    )


def _lines(docs: DataFrame, id_col: str, text_col: str, salt: int) -> DataFrame:
    """``_id, _h1, _h2, _doc, pos, a, b, words``: all lines by two hashes, of repeated rows once."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    keyed = _keyed(docs.select(F.col(id_col).alias("_doc"), text.alias("_text")), "_doc", "_text")
    lines = keyed.select(*KEY, "_doc", F.posexplode(F.split("_text", "\n", -1)).alias("pos", "line"))
    words = F.when(F.length(F.trim("line")) == 0, 0).otherwise(F.length("line") - F.length(F.replace("line", F.lit(" "), F.lit(""))) + 1)
    narrow = lines.select(
        *KEY, "_doc", "pos", F.xxhash64("line").alias("a"), F.xxhash64(F.lit(salt), F.col("line")).alias("b"), words.alias("words")
    )
    # Repeated rows have repeated lines; one of each is enough.
    return narrow.dropDuplicates([*KEY, "pos"])


def chunks(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", salt: int = 0, min_words: int = MIN_WORDS, divisor: int = DIVISOR) -> DataFrame:
    """``_id, _h1, _h2, rank, start, n_lines, n_words, g1, g2``: all chunks, one row each, without their text."""
    inside = Window.partitionBy(*KEY).orderBy("pos")
    marked = _lines(docs, id_col, text_col, salt).select(
        "*", F.lag("a").over(inside).alias("before"), F.lag("words").over(inside).alias("words_before")
    )
    starts = (
        F.col("before").isNull()
        | (F.col("words") >= min_words)
        | (F.col("words_before") >= min_words)
        | (F.pmod(F.xxhash64("before", "a"), F.lit(divisor)) == 0)
    )
    ranged = marked.withColumn("start", F.max(F.when(starts, F.col("pos"))).over(inside.rowsBetween(Window.unboundedPreceding, 0)))
    place = F.col("pos") - F.col("start")
    return ranged.groupBy(*KEY, "start").agg(
        F.first("_doc").alias("_doc"),
        F.count("*").alias("n_lines"),
        F.sum("words").alias("n_words"),
        F.bit_xor(F.xxhash64(place, "a")).alias("g1"),
        F.bit_xor(F.xxhash64(place, "b")).alias("g2"),
    )


def windows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", salt: int = 0, min_words: int = MIN_WORDS) -> DataFrame:
    """The columns of ``chunks`` for the shortest runs of ``min_words`` words or more that begin or end at a line."""
    inside = Window.partitionBy(*KEY).orderBy("pos")
    marked = _lines(docs, id_col, text_col, salt).withColumn("words_before", F.lag("words").over(inside))
    # Blank lines in a row are one unit, so a window has a bounded number of them.
    begins = (F.col("words") > 0) | F.col("words_before").isNull() | (F.col("words_before") > 0)
    ranged = marked.withColumn("start", F.max(F.when(begins, F.col("pos"))).over(inside.rowsBetween(Window.unboundedPreceding, 0)))
    place = F.col("pos") - F.col("start")
    units = ranged.groupBy(*KEY, "start").agg(
        F.first("_doc").alias("_doc"),
        F.count("*").alias("n"),
        F.sum("words").alias("own"),
        F.bit_xor(F.xxhash64(place, "a")).alias("a"),
        F.bit_xor(F.xxhash64(place, "b")).alias("b"),
    )
    upto = F.sum("own").over(Window.partitionBy(*KEY).orderBy("start").rowsBetween(Window.unboundedPreceding, 0))
    # Words before (up to) a unit, then its place: the frames hold what is less than min_words away.
    placed = units.withColumn("aft", upto * LINES + F.col("start")).withColumn("fore", F.col("aft") - F.col("own") * LINES)
    reach = min_words * LINES - 1
    forth = Window.partitionBy(*KEY).orderBy("fore").rangeBetween(0, reach)
    back = Window.partitionBy(*KEY).orderBy("aft").rangeBetween(-reach, 0)

    def run(frame) -> Column:
        return F.struct(
            F.min("start").over(frame).alias("start"),
            F.sum("n").over(frame).alias("n_lines"),
            F.sum("own").over(frame).alias("n_words"),
            F.xxhash64(F.collect_list("a").over(frame)).alias("g1"),
            F.xxhash64(F.lit(7), F.collect_list("b").over(frame)).alias("g2"),
        )

    both = placed.select(*KEY, "_doc", "own", run(forth).alias("f"), run(back).alias("r"))
    # One that still has the words without its last unit is no window of its first line; all others are there already.
    able = F.filter(
        F.array(F.struct(F.lit(0).cast("bigint").alias("rest"), "f.*"), F.struct((F.col("r.n_words") - F.col("own")).alias("rest"), "r.*")),
        lambda w, i: (w["n_words"] >= min_words) & ((i == 0) | (w["rest"] >= min_words)),
    )
    return both.select(*KEY, "_doc", F.inline(able)).select(*KEY, "start", "_doc", "n_lines", "n_words", "g1", "g2")


def repeated(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS, divisor: int = DIVISOR, passages: bool = False
) -> DataFrame:
    """``_id, _h1, _h2, spans``: per document the spans (start, n_lines, ...) that occur more than once, in order.

    ``cut`` marks those that go: all but the first occurrence and what overlaps it. ``reach`` is where the cuts before end, null
    if there are none. Verified by bytes.
    """
    salt = 0
    while True:
        able = chunks(docs, id_col, text_col, salt, min_words, divisor).where((F.col("n_lines") > 1) | (F.col("n_words") >= min_words)).where("n_words > 0")
        if passages:
            able = able.where(F.col("n_words") < min_words).unionByName(windows(docs, id_col, text_col, salt, min_words))
        able = checkpointed(able)
        order = F.struct(F.col("_doc").isNull().alias("none"), "_doc", *KEY, "start")
        # Stored, so that the join has two plain shuffles and a hot chunk can be split.
        often = checkpointed(
            able.groupBy("g1", "g2", "n_lines").agg(F.count("*").alias("times"), F.min(order).alias("best")).where("times > 1")
        )
        apart = (F.col("start") >= F.col("best.start") + F.col("n_lines")) | ~(F.struct(*KEY) == F.struct(*[F.col(f"best.{c}") for c in KEY]))
        hits = able.join(often, ["g1", "g2", "n_lines"]).select(*KEY, "start", "n_lines", "g1", "g2", apart.alias("cut"))
        before = Window.partitionBy(*KEY).orderBy("start", "n_lines", "g1").rowsBetween(Window.unboundedPreceding, -1)
        reach = F.max(F.when(F.col("cut"), F.col("start") + F.col("n_lines"))).over(before)
        seen = F.max(F.col("start") + F.col("n_lines")).over(before)
        span = F.struct("start", "n_lines", "g1", "g2", "cut", "reach", "seen")
        spans = hits.withColumn("reach", reach).withColumn("seen", F.coalesce(seen, F.lit(0).cast("bigint"))).groupBy(*KEY).agg(F.sort_array(F.collect_list(span)).alias("spans"))
        spans = checkpointed(spans)
        if _collisions(docs, spans, id_col, text_col, salt).isEmpty():
            return spans
        salt += 1


def _collisions(docs: DataFrame, spans: DataFrame, id_col: str, text_col: str, salt: int) -> DataFrame:
    """Digests that two different spans share, by their line digests, or two different lines, by their bytes."""
    keyed = _keyed(docs.select(F.col(id_col).alias("_doc"), F.col(text_col).alias("_text")), "_doc", "_text")
    held = keyed.select(*KEY, "_text").join(spans, KEY).select(F.split("_text", "\n", -1).alias("lines"), "spans")
    digests = F.transform("lines", lambda x: F.struct(F.xxhash64(x).alias("a"), F.xxhash64(F.lit(salt), x).alias("b")))
    each = held.select(digests.alias("digests"), F.explode("spans").alias("s"))
    runs = each.select("s.g1", "s.g2", "s.n_lines", F.slice("digests", F.col("s.start") + 1, F.col("s.n_lines").cast("int")).alias("t"))
    # The lines of the spans, each once: what of a span lies behind all spans before it.
    fresh = F.greatest(F.col("s.start"), F.col("s.seen"))
    rest = F.greatest(F.col("s.start") + F.col("s.n_lines") - fresh, F.lit(0).cast("bigint"))
    lines = held.select("lines", F.explode("spans").alias("s")).select(F.explode(F.slice("lines", (fresh + 1).cast("int"), rest.cast("int"))).alias("t"))
    shared = lines.select(F.xxhash64("t").alias("g1"), F.xxhash64(F.lit(salt), "t").alias("g2"), F.lit(0).cast("bigint").alias("n_lines"), "t").distinct()
    several = shared.groupBy("g1", "g2", "n_lines").count().where("count > 1")
    return runs.distinct().groupBy("g1", "g2", "n_lines").count().where("count > 1").unionByName(several)


def deduplicated(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS, divisor: int = DIVISOR, report: bool = False, passages: bool = False
) -> DataFrame:
    """All rows and columns of ``docs`` with repeated chunks cut out of the text; with ``passages`` all repeated runs of lines.

    With ``report`` the columns are ``id, text, lines_in, lines_out, chunks_removed`` instead. A null text stays null; a
    document all of whose chunks came before keeps its row with an empty text. ``chunks_removed`` counts what was cut out in one
    piece if ``passages`` is set. Rows that repeat id and text are treated alike.
    An empty input gives an empty result. The input's columns travel in a struct, so their names cannot clash.
    """
    spans = repeated(docs, id_col, text_col, min_words, divisor, passages)
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    keyed = _keyed(docs.select(whole, F.col(id_col).alias("_doc"), F.col(text_col).alias("_text")), "_doc", "_text")
    none = F.array().cast(spans.schema["spans"].dataType)
    staged = keyed.join(spans, KEY, "left").select(
        "row",
        "_doc",
        "_text",
        F.filter(F.coalesce("spans", none), lambda s: s["cut"]).alias("cut"),
        F.split(F.coalesce("_text", F.lit("")), "\n", -1).alias("lines"),
    )
    # What stays lies between the cuts before and the start of the next, and behind the last: linear in lines and cuts.
    last = F.array_max(F.transform("cut", lambda s: (s["start"] + s["n_lines"]).cast("int")))
    begun = F.filter("cut", lambda s: s["reach"].isNull() | (s["start"] > s["reach"]))
    gaps = F.transform(begun, lambda s: F.struct(F.coalesce(s["reach"], F.lit(0)).cast("int").alias("a"), s["start"].cast("int").alias("b")))
    gaps = F.concat(gaps, F.array(F.struct(last.alias("a"), F.size("lines").alias("b"))))
    kept = F.flatten(F.transform(gaps, lambda g: F.slice(F.col("lines"), g["a"] + 1, g["b"] - g["a"])))
    text = F.when(F.size("cut") == 0, F.col("_text")).otherwise(F.array_join(kept, "\n"))
    if report:
        left = F.when(F.size("cut") == 0, F.size("lines")).otherwise(F.size(kept))
        return staged.select(
            F.col("_doc").alias("id"),
            text.alias("text"),
            F.size("lines").alias("lines_in"),
            left.alias("lines_out"),
            F.size(begun if passages else F.col("cut")).alias("chunks_removed"),
        )
    return staged.select(*[text.alias(c) if c == text_col else F.col(f"row.`{c}`").alias(c) for c in docs.columns])
