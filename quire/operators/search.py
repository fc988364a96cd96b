"""Ranked full-text search without diacritics: an inverted index and BM25."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.functions.text import remove_diacritics

K1, B = 1.2, 0.75
# Words too common to index.
STOP_WORDS = ("a", "an", "and", "are", "as", "at", "be", "by", "for", "from", "has", "he", "in", "is", "it", "its", "of", "on", "that", "the", "to", "was", "were", "will", "with")


def terms(text: Column) -> Column:
    """Lower-case words without outer punctuation, stop words left out."""
    words = F.transform(F.split(F.lower(text), r"\s+"), lambda w: F.regexp_replace(w, r"^[^a-z0-9]+|[^a-z0-9]+$", ""))
    return F.filter(words, lambda w: (w != "") & ~w.isin(*STOP_WORDS))


def search_documents(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, text and raw_text, the text without diacritics."""
    return docs.select(key, text, remove_diacritics(text).alias("raw_text"))


def postings(docs: DataFrame, key: str = "doc_id", text: str = "raw_text") -> DataFrame:
    """term, key, tf, n_terms (of the document)."""
    rows = docs.select(key, terms(F.col(text)).alias("t")).select(key, F.size("t").alias("n_terms"), F.explode("t").alias("term"))
    return rows.groupBy("term", key, "n_terms").agg(F.count("*").alias("tf"))


def bm25(index: DataFrame, query: str, key: str = "doc_id") -> DataFrame:
    """key, score over the query's terms (any of them). Only the query's postings meet."""
    spark = index.sparkSession
    asked = spark.createDataFrame([(query,)], "q string").select(F.explode(F.array_distinct(terms(remove_diacritics("q")))).alias("term"))
    docs = index.groupBy(key).agg(F.first("n_terms").alias("n"))
    totals = docs.agg(F.count("*").alias("n_docs"), F.avg("n").alias("mean_n"))
    hits = index.join(F.broadcast(asked), "term")
    df = hits.groupBy("term").agg(F.count("*").alias("df"))
    rows = hits.join(F.broadcast(df), "term").crossJoin(F.broadcast(totals))
    idf = F.ln(1 + (F.col("n_docs") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    score = idf * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("n_terms") / F.col("mean_n")))
    return rows.groupBy(key).agg(F.sum(score).alias("score"))
