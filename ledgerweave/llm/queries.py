"""Registered queries of the corpus operators, each over its whole table, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerweave.llm import alignment, exact_dedup, langid, license_scan, mixing, ngram_join, packing, rolling_median, sentence_spans, simhash, sketches, suffix_dedup, toxicity
from ledgerweave.llm.common import table

Query = Callable[[SparkSession, str], DataFrame]


def remainder(id_col: str, divisor: int):
    """crc32 of an id's text modulo ``divisor``: a fixed way to hold rows out."""
    return F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(divisor))


def op1_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.jaccard_components(table(spark, sf_dir, "documents"), width=4, percent=85)


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = remainder("doc_id", 5) == 0
    scored = toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), learn_from=~held)
    return scored.select("doc_id", F.coalesce(held, F.lit(False)).alias("held_out"), "score", "predicted")


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = F.coalesce(remainder("doc_id", 4) == 2, F.lit(False))
    return langid.identify_language(table(spark, sf_dir, "documents"), learn_from=~held).withColumn("held_out", held)


def op3_sentence_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = sentence_spans.remove_repeated_spans(table(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_sentences", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


def op4_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = suffix_dedup.remove_repeats(table(spark, sf_dir, "documents"))
    gone = F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + s["end"] - s["start"])
    return found.select("doc_id", "n_bytes", gone.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), "kept_sha256")


def op5_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sketches.fingerprints(table(spark, sf_dir, "documents"))


def op6_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.license_scan(table(spark, sf_dir, "documents"))


def op7_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(table(spark, sf_dir, "documents"), prefer_longer=True)


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_sources(table(spark, sf_dir, "documents")).drop("source", "copies")


def op11_rolling_median(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rolling_median.rolling_medians(table(spark, sf_dir, "clicks"))


def op12_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.simhash_components(table(spark, sf_dir, "documents"), width=3, radius=3)


def op13_tokenizer_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    by_doc, _ = alignment.align_tokenizers(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))
    return by_doc


def queries() -> dict[str, Query]:
    return {
        "op1_ngram_jaccard_join": op1_ngram_jaccard_join,
        "op2_toxicity": op2_toxicity,
        "op9_language_id": op9_language_id,
        "op3_sentence_spans": op3_sentence_spans,
        "op4_suffix_array_dedup": op4_suffix_array_dedup,
        "op5_document_fingerprints": op5_document_fingerprints,
        "op6_license_scan": op6_license_scan,
        "op7_best_fit_packing": op7_best_fit_packing,
        "op8_exact_dedup": op8_exact_dedup,
        "op10_mixing": op10_mixing,
        "op11_rolling_median": op11_rolling_median,
        "op12_simhash": op12_simhash,
        "op13_tokenizer_alignment": op13_tokenizer_alignment,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op3_sentence_spans": OP3_SQL,
        "op8_exact_dedup": OP8_SQL,
        "op10_mixing": OP10_SQL,
        "op11_rolling_median": OP11_SQL,
    }


OP3_SQL = r"""
WITH c AS (SELECT doc_id, regexp_extract(coalesce(text, ''), '^[\x20\x09-\x0D]*') AS ahead, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+[\x20\x09-\x0D]*') AS chunks, coalesce(text, '') AS text FROM documents),
w AS (SELECT doc_id, unnest(range(len(chunks))) AS i, unnest(chunks) AS chunk FROM c),
x AS (SELECT *, regexp_extract(chunk, '^[^\x20\x09-\x0D]+') AS word FROM w),
m AS (SELECT *, coalesce(sum((regexp_matches(word, '[.!?]$') OR contains(chunk, chr(10)))::INT) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS pos FROM x),
s AS (SELECT doc_id, pos, string_agg(chunk, '' ORDER BY i) AS part, string_agg(word, ' ' ORDER BY i) AS bare, count(*) AS n FROM m GROUP BY ALL),
p AS (SELECT *, sum(n) OVER (PARTITION BY doc_id ORDER BY pos) AS upto FROM s),
-- From and to every sentence, the smallest run of 2 sentences and 16 words or of 30 words
r AS (SELECT a.doc_id, a.pos AS lo, min(b.pos) AS hi FROM p a JOIN p b ON a.doc_id = b.doc_id AND b.pos BETWEEN a.pos AND a.pos + 30
      AND (b.upto - a.upto + a.n >= 30 OR (b.pos > a.pos AND b.upto - a.upto + a.n >= 16)) GROUP BY ALL
      UNION
      SELECT b.doc_id, max(a.pos), b.pos FROM p a JOIN p b ON a.doc_id = b.doc_id AND b.pos BETWEEN a.pos AND a.pos + 30
      AND (b.upto - a.upto + a.n >= 30 OR (b.pos > a.pos AND b.upto - a.upto + a.n >= 16)) GROUP BY b.doc_id, b.pos),
t AS (SELECT r.doc_id, lo, hi, string_agg(bare, ' ' ORDER BY pos) AS run FROM r JOIN p ON r.doc_id = p.doc_id AND pos BETWEEN lo AND hi GROUP BY ALL),
k AS (SELECT *, row_number() OVER (PARTITION BY run ORDER BY doc_id, lo) AS n FROM t),
g AS (SELECT DISTINCT doc_id, unnest(range(lo, hi + 1)) AS pos FROM k WHERE n > 1),
j AS (SELECT p.doc_id, count(*) AS n_sentences, count(g.pos) AS n_removed, string_agg(part, '' ORDER BY p.pos) FILTER (WHERE g.pos IS NULL) AS kept, bool_or(p.pos = 0 AND g.pos IS NULL) AS opens
      FROM p LEFT JOIN g ON p.doc_id = g.doc_id AND p.pos = g.pos GROUP BY p.doc_id)
SELECT c.doc_id, coalesce(n_sentences, 0)::BIGINT AS n_sentences, coalesce(n_removed, 0)::BIGINT AS n_removed,
       sha256(CASE WHEN n_sentences IS NULL THEN text WHEN opens THEN ahead || coalesce(kept, '') ELSE coalesce(kept, '') END) AS kept_sha256
FROM c LEFT JOIN j ON c.doc_id = j.doc_id
"""

OP8_SQL = r"""
WITH n AS (
  SELECT doc_id, length(coalesce(text, '')) AS chars,
         regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', '', 'g') AS bare
  FROM documents)
SELECT doc_id,
       first_value(doc_id) OVER w AS keep_id,
       count(*) OVER (PARTITION BY bare) AS group_size,
       row_number() OVER w = 1 AS kept,
       sha256(bare) AS text_sha256
FROM n WINDOW w AS (PARTITION BY bare ORDER BY chars DESC, doc_id)
"""

OP10_SQL = r"""
WITH RECURSIVE d AS MATERIALIZED (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size,
         (CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '') || ':7'), 1, 13) AS BIGINT)::DOUBLE + 0.5) / 4503599627370496.0 AS u
  FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
r AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS n FROM s),
w AS (SELECT *, [3.0, 1.0, 2.0][(n % 3 + 1)::INT]::DOUBLE AS w, source_size * 2.0::DOUBLE AS cap FROM r),
l AS (SELECT *, (1.5::DOUBLE * sum(source_size) OVER () - coalesce(sum(cap) OVER (ORDER BY cap / w, n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
             / sum(w) OVER (ORDER BY cap / w, n ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM w),
f AS (SELECT *, first_value(CASE WHEN level * w < cap THEN level END IGNORE NULLS)
             OVER (ORDER BY cap / w, n ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS final FROM l),
t AS (SELECT n, source, source_size, least(cap, coalesce(w * final, cap)) AS target FROM f),
p AS (SELECT *, floor(CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END + 1e-12) AS whole FROM t),
g AS MATERIALIZED (SELECT *, greatest(CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END - whole, 0) * source_size AS need FROM p),
-- Inclusion probabilities least(1, factor / sqrt(size)) whose expected words are the need
h AS (SELECT g.n, need, size, count(*) AS m FROM d JOIN g ON d.source IS NOT DISTINCT FROM g.source WHERE size > 0 AND need > 0 GROUP BY ALL),
i AS (SELECT n, size, (need - coalesce(sum(m * size) OVER (PARTITION BY n ORDER BY size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
             / sum(m * size * (1 / sqrt(size))) OVER (PARTITION BY n ORDER BY size ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS factor FROM h),
c AS (SELECT n, arg_min(factor, size) AS factor FROM i WHERE factor * (1 / sqrt(size)) < 1 GROUP BY n),
q AS (SELECT d.doc_id, g.n, size, u, source_size, target, whole, need, least(1.0::DOUBLE, factor * (1 / sqrt(greatest(size, 1)))) AS pr
      FROM d JOIN g ON d.source IS NOT DISTINCT FROM g.source LEFT JOIN c ON g.n = c.n),
k AS MATERIALIZED (SELECT *, (u / (1 - u)) * ((1 - pr) / pr) AS q, row_number() OVER (PARTITION BY n ORDER BY (u / (1 - u)) * ((1 - pr) / pr), doc_id) AS rn FROM q),
-- Down the order, each document that still fits
v AS (SELECT n, 0::BIGINT AS rn, need AS room, false AS taken_in FROM g
      UNION ALL
      SELECT v.n, k.rn, room - CASE WHEN need > 0 AND size <= room THEN size ELSE 0 END, need > 0 AND size <= room FROM v JOIN k ON v.n = k.n AND k.rn = v.rn + 1),
e AS (SELECT n, arg_max(room, rn) AS miss FROM v GROUP BY n),
m AS (SELECT k.*, v.taken_in, miss FROM k JOIN v ON k.n = v.n AND k.rn = v.rn JOIN e ON k.n = e.n),
z AS (SELECT *, row_number() OVER (PARTITION BY n ORDER BY taken_in OR NOT (need > 0 AND abs(miss - size) < miss), abs(miss - size), q, doc_id) = 1
             AND NOT taken_in AND need > 0 AND abs(miss - size) < miss AS closing FROM m)
SELECT doc_id, size, source_size, round(target, 6) AS target,
       ((whole + CASE WHEN taken_in OR closing THEN 1 ELSE 0 END) * size)::BIGINT AS taken FROM z
"""

OP11_SQL = r"""
WITH c AS (SELECT DISTINCT click_id, ts, kind, floor(100 * value + 0.5)::BIGINT AS cents FROM clicks WHERE ts IS NOT NULL),
w AS (SELECT *, list_sort(list(cents) FILTER (WHERE cents IS NOT NULL) OVER (PARTITION BY kind ORDER BY epoch_us(ts) RANGE BETWEEN 3599999999 PRECEDING AND CURRENT ROW)) AS v FROM c),
m AS (SELECT *, coalesce(len(v), 0) AS n, v[(len(v) + 1) // 2] + v[len(v) // 2 + 1] AS median2 FROM w),
d AS (SELECT *, list_sort(list_transform(v, lambda x: abs(2 * x - median2))) AS dev FROM m),
r AS (SELECT click_id, kind, cents, n, CASE WHEN n > 1 THEN median2 END AS median2, CASE WHEN n > 1 THEN dev[(n + 1) // 2] + dev[n // 2 + 1] END AS mad4 FROM d)
SELECT click_id, kind, n, median2, mad4, 2 * abs(2 * cents - median2) > 3 * mad4 AS far FROM r
"""
