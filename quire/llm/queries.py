"""The queries opN_<name> over the driver's tables, and their SQL where there is one."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm.common import load, word_count


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quire.llm.line_dedup import dedup_lines

    docs = load(spark, sf_dir, "documents").select("doc_id", "text")
    return dedup_lines(docs, "common", 10).select("doc_id", "n_lines", "n_dropped", F.sha2("kept", 256).alias("kept_sha256"))


def op2_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quire.llm.mixing import mix_report

    docs = load(spark, sf_dir, "documents").select("doc_id", "text", "source")
    sized = docs.select("doc_id", "source", word_count(F.col("text")).alias("words"), F.xxhash64("text").cast("string").alias("text"))
    return mix_report(sized, size=F.col("words"))


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from quire.llm.tokens import token_report

    return token_report(load(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quire.llm.toxicity import toxicity

    found = toxicity(load(spark, sf_dir, "documents").select("doc_id", "text"), load(spark, sf_dir, "labels"), keep_text=False)
    return found.select("doc_id", "held_out", "score", "predicted", F.size("offending").alias("n_offending"))


def op6_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quire.llm.pii import find_personal_data

    found = find_personal_data(load(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans", F.coalesce(F.expr("size(filter(discovered, x -> x.seed))"), F.lit(0)).cast("long").alias("n_secret"), F.coalesce(F.expr("size(filter(discovered, x -> not x.seed))"), F.lit(0)).cast("long").alias("n_discovered"))


def op4_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quire.llm.html_extract import extract_main_text

    return extract_main_text(load(spark, sf_dir, "pages").select("page_id", "url", "html"))


def op9_similar_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quire.llm.jaccard import similar_documents

    return similar_documents(load(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


def op3_remove_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quire.llm.repeats import remove_repeats

    found = remove_repeats(load(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "n_bytes", F.expr("aggregate(spans, 0L, (a, x) -> a + x.hi - x.lo)").alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), "kept_sha256")


def op1_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quire.llm.ann import search

    vectors = load(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return search(vectors, vectors.filter(F.col("vec_id") % 50 == 0))


def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quire.llm.decontaminate import matches

    return matches(load(spark, sf_dir, "documents").select("doc_id", "text"), load(spark, sf_dir, "benchmark")).select("doc_id", "item_id", "edits", "rate", "first_word")


QUERIES = {
    "op10_decontaminate": op10_decontaminate,
    "op1_nearest_neighbours": op1_nearest_neighbours,
    "op3_remove_repeats": op3_remove_repeats,
    "op9_similar_documents": op9_similar_documents,
    "op4_main_text": op4_main_text,
    "op6_personal_data": op6_personal_data,
    "op8_toxicity": op8_toxicity,
    "op2_mix_sources": op2_mix_sources,
    "op5_token_counts": op5_token_counts,
    "op7_line_dedup": op7_line_dedup,
}

ASCII_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

ORACLE = {
    "op9_similar_documents": rf"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array({ASCII_LOWER.format("coalesce(text, '')")}, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')]
        ELSE list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i+4], ' ')) END) AS g FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS k FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT x, y FROM p JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * k >= 75 * (a.n + b.n - k)),
e AS (SELECT x, y FROM l UNION SELECT y, x FROM l),
r(doc_id, c) AS (SELECT doc_id, doc_id FROM documents UNION SELECT e.y, r.c FROM r JOIN e ON e.x = r.doc_id)
SELECT r.doc_id, coalesce(any_value(n.n), 0)::BIGINT AS n_shingles, min(c) AS component_id FROM r LEFT JOIN n USING (doc_id) GROUP BY r.doc_id""",
    "op7_line_dedup": rf"""
WITH lines AS (
  SELECT d.doc_id, i, list_extract(ls, i) AS line
  FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents) d, generate_series(1, len(ls)) g(i)),
keyed AS (SELECT *, {ASCII_LOWER.format("trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))")} AS k FROM lines),
common AS (SELECT k FROM keyed WHERE length(k) >= 1 GROUP BY k HAVING count(DISTINCT doc_id) >= 10)
SELECT doc_id, count(*)::BIGINT AS n_lines, count(common.k)::BIGINT AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (common.k IS NULL), '')) AS kept_sha256
FROM keyed LEFT JOIN common USING (k) GROUP BY doc_id""",
}
