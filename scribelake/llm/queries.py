"""Registered queries of the corpus operators: thin digests over what the operators return."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scribelake.llm import (
    block_naming,
    cross_parsing,
    histogram_shards,
    html_wrappers,
    line_chunks,
    piece_sampling,
    piecewise_hashes,
    rule_ledger,
    simhash_pivots,
    source_divergence,
    swap_packing,
    toxicity_pu,
    whitening,
)
from scribelake.llm.common import bounded_batches


def _table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    bounded_batches(spark)
    return spark.read.parquet(f"{folder}/{name}.parquet")


def tokenizer(name: str) -> str:
    """A public vocabulary file, at the same place on every machine."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_html_wrappers(spark: SparkSession, folder: str) -> DataFrame:
    """Main text of ``pages``."""
    out = html_wrappers.extracted(_table(spark, folder, "pages"))
    return out.select(F.col("id").alias("page_id"), "url", "text", F.char_length("text").cast("bigint").alias("n_chars"))


def op2_block_naming(spark: SparkSession, folder: str) -> DataFrame:
    """Exact dedup of ``documents`` by block names."""
    return block_naming.groups(_table(spark, folder, "documents")).withColumnRenamed("id", "doc_id")


def op3_toxicity_pu(spark: SparkSession, folder: str) -> DataFrame:
    """Toxicity scores of ``documents``, learnt from two thirds of ``labels``."""
    out = toxicity_pu.scores(_table(spark, folder, "documents"), _table(spark, folder, "labels"))
    return out.withColumnRenamed("id", "doc_id")


def op4_cross_parsing(spark: SparkSession, folder: str) -> DataFrame:
    """Languages of ``documents`` by cross-parsing."""
    return cross_parsing.languages(_table(spark, folder, "documents")).withColumnRenamed("id", "doc_id")


def op5_swap_packing(spark: SparkSession, folder: str) -> DataFrame:
    """``documents`` packed into sequences of 1024 tokens."""
    out = swap_packing.packed(_table(spark, folder, "documents"), tokenizer("byte_bpe_50k.json"))
    return out.withColumnRenamed("id", "doc_id")


def op6_simhash_pivots(spark: SparkSession, folder: str) -> DataFrame:
    """Near-duplicate classes of ``documents`` by SimHash."""
    out = simhash_pivots.classes(_table(spark, folder, "documents"))
    return out.select(
        F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.col("component").alias("component_id")
    )


def op7_rule_ledger(spark: SparkSession, folder: str) -> DataFrame:
    """Measurements, failed rules and the verdict of policy v2 for ``documents``."""
    led = rule_ledger.ledger(_table(spark, folder, "documents"))
    return led.select(
        F.col("id").alias("doc_id"),
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        "n_repeat_words",
        (~rule_ledger.passes("base")).alias("base_failed"),
        rule_ledger.passes("v2").alias("kept"),
        "failed",
    )


def op8_line_chunks(spark: SparkSession, folder: str) -> DataFrame:
    """What line dedup leaves of each document: counts and a digest of the text."""
    out = line_chunks.deduplicated(_table(spark, folder, "documents"), report=True, passages=True)
    return out.select(
        F.col("id").alias("doc_id"),
        "lines_in",
        "lines_out",
        "chunks_removed",
        F.length(F.coalesce("text", F.lit(""))).alias("n_chars_out"),
        F.sha2(F.coalesce("text", F.lit("")), 256).alias("text_sha256"),
    )


def op9_piece_sampling(spark: SparkSession, folder: str) -> DataFrame:
    """Sampled segmentations of ``documents``: size and digest of the ids, digest of the decoded text, and whether it is the text."""
    path = tokenizer("piece_bpe_32k.model")
    rows = piece_sampling.segmentations(_table(spark, folder, "documents"), path)
    back = rows.select("id", "text", F.size("ids").alias("n_pieces"), piece_sampling.ids_crc32(F.col("ids")).alias("ids_crc32"), piece_sampling.decoded(F.col("ids"), path).alias("back"))
    return back.select(
        F.col("id").alias("doc_id"),
        F.when(F.col("text").isNotNull(), F.col("n_pieces")).alias("n_pieces"),
        "ids_crc32",
        F.sha2("back", 256).alias("decoded_sha256"),
        F.col("back").eqNullSafe(F.col("text")).alias("lossless"),
    )


def op10_histogram_shards(spark: SparkSession, folder: str) -> DataFrame:
    """Shards of near equal bytes for ``documents``."""
    out = histogram_shards.assign(_table(spark, folder, "documents"))
    return out.select(
        F.col("id").alias("doc_id"), "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )


def op11_whitening(spark: SparkSession, folder: str) -> DataFrame:
    """``embeddings`` along their 16 leading components, each of unit variance."""
    return whitening.whitened(_table(spark, folder, "embeddings")).withColumnRenamed("id", "vec_id")


def op12_source_divergence(spark: SparkSession, folder: str) -> DataFrame:
    """How the sources of each language of ``documents`` differ in their terms."""
    return source_divergence.audit(_table(spark, folder, "documents"))


def op13_piecewise_hashes(spark: SparkSession, folder: str) -> DataFrame:
    """Piecewise fingerprints of ``documents`` and of their edited texts, with likenesses."""
    return piecewise_hashes.beside_next(_table(spark, folder, "documents")).withColumnRenamed("id", "doc_id")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = {k: v for k, v in globals().items() if k.startswith("op")}
    return dict(sorted(found.items(), key=lambda x: int(x[0][2:].split("_")[0])))


OP2_SQL = r"""
WITH t AS (
    SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS norm FROM documents
)
SELECT doc_id, min(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
       row_number() OVER (PARTITION BY norm ORDER BY doc_id) = 1 AS kept, sha256(norm) AS text_sha256
FROM t WINDOW g AS (PARTITION BY norm)
"""


OP7_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
w AS (
    SELECT doc_id, unnest(ws) AS w, generate_subscripts(ws, 1) AS pos
    FROM (SELECT doc_id, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws FROM d)
),
tri AS (
    SELECT doc_id, pos, w, lead(w) OVER o AS w2, lead(w, 2) OVER o AS w3 FROM w WINDOW o AS (PARTITION BY doc_id ORDER BY pos)
),
hit AS (SELECT doc_id, pos, w, w3 IS NOT NULL AND count(*) OVER (PARTITION BY doc_id, w, w2, w3) > 1 AS h FROM tri),
cov AS (
    SELECT doc_id, w, h OR coalesce(lag(h) OVER o, false) OR coalesce(lag(h, 2) OVER o, false) AS c
    FROM hit WINDOW o AS (PARTITION BY doc_id ORDER BY pos)
),
ws AS (SELECT doc_id, count(*) AS n_words, sum(length(w)) AS word_chars, count(*) FILTER (c) AS n_repeat_words FROM cov GROUP BY doc_id),
ln AS (
    SELECT doc_id, count(*) AS n_lines, count(*) - count(DISTINCT l) AS n_dup_lines
    FROM (SELECT doc_id, unnest(string_split(t, chr(10))) AS l FROM d) WHERE regexp_matches(l, '[^\x20\x09-\x0D]') GROUP BY doc_id
),
m AS (
    SELECT d.doc_id, coalesce(n_words, 0) AS n_words, coalesce(word_chars, 0)::BIGINT AS word_chars,
           length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS n_symbols, coalesce(n_dup_lines, 0) AS n_dup_lines,
           coalesce(n_repeat_words, 0) AS n_repeat_words, coalesce(n_lines, 0) AS n_lines,
           length(regexp_replace(t, '[^A-Z]', '', 'g')) AS n_upper,
           length(regexp_replace(t, '[^A-Za-z\x{C0}-\x{10FFFF}]', '', 'g')) AS n_letters
    FROM d LEFT JOIN ws ON d.doc_id = ws.doc_id LEFT JOIN ln ON d.doc_id = ln.doc_id
),
b AS (
    SELECT *, (n_words < 50)::BIGINT + 2 * (100 * n_repeat_words > 50 * n_words)::BIGINT
        + 4 * (n_words > 0 AND 5 * n_symbols > n_words)::BIGINT + 8 * (n_lines >= 4 AND 2 * n_dup_lines > n_lines)::BIGINT
        + 16 * (n_letters >= 200 AND 2 * n_upper > n_letters)::BIGINT + 32 * (n_words >= 50 AND word_chars > 20 * n_words)::BIGINT
        + 64 * (n_words >= 50 AND 4 * n_letters < word_chars)::BIGINT AS failed
    FROM m
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, (failed & 3) <> 0 AS base_failed, failed = 0 AS kept, failed
FROM b
"""


OP12_SQL = r"""
WITH d AS (
    SELECT row_number() OVER () AS doc, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
           translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t
    FROM documents
),
w AS (SELECT doc, lang, source, unnest(regexp_extract_all(t, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
per AS (SELECT doc, lang, source, term, count(*) AS n FROM w GROUP BY ALL),
k AS (SELECT lang, term, sum(n) AS ln FROM per GROUP BY ALL HAVING count(*) >= 10),
v AS (SELECT lang, count(*) AS v, sum(ln) AS nl FROM k GROUP BY lang),
g AS (SELECT DISTINCT lang, source FROM d),
c AS (SELECT lang, source, term, sum(n) AS n FROM per GROUP BY ALL),
dense AS (
    SELECT g.lang, g.source, k.term, coalesce(c.n, 0)::HUGEINT AS n, k.ln, v.v, v.nl,
           sum(coalesce(c.n, 0)) OVER (PARTITION BY g.lang, g.source)::HUGEINT AS total
    FROM g JOIN k ON g.lang = k.lang JOIN v ON v.lang = g.lang
         LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term
),
p AS (
    SELECT lang, source, term, n, 1 + (1000000000::HUGEINT * (n + 2)) // (total + 2 * v)::HUGEINT AS p,
           1 + (1000000000::HUGEINT * (ln + 2)::HUGEINT) // (nl + 2 * v)::HUGEINT AS q
    FROM dense
),
both_ AS (
    SELECT a.lang, a.source, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // (a.p + b.p)) AS value
    FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL
),
pairs AS (
    SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(x.value, 0) AS value
    FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
         LEFT JOIN both_ x ON x.lang = a.lang AND x.source = a.source AND x.item = b.source
),
terms AS (SELECT lang, source, 'term' AS part, term AS item, ((p - q) * (p - q)) // (p + q) AS value FROM p WHERE n > 0 AND p > q),
ranked AS (
    SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank
    FROM (SELECT * FROM pairs UNION ALL SELECT * FROM terms)
)
SELECT lang, source, part, item, value::BIGINT AS value, rank::INTEGER AS rank FROM ranked WHERE part = 'pair' OR rank <= 10
"""


def oracle_sql() -> dict[str, str]:
    return {"op2_block_naming": OP2_SQL, "op7_rule_ledger": OP7_SQL, "op12_source_divergence": OP12_SQL}
