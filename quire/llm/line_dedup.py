"""Removal of lines that many documents share, as compressed keep bitmaps. [native]

Line hashes are range-partitioned with a secondary sort by document and position; a window streams over each run of
equal hashes, counts its documents and knows its first occurrence. A hash is dealt over SALTS chunks by document, so that
a line found in a third of all rows is no single task's work; chunk counts meet in one small aggregation. What comes back
per document are bit words of the lines to drop (64 lines a word, words without a drop left out), never text.

Null or empty texts are one empty line. Rows that share a doc_id (or a null doc_id) count as one document. Rows
with the same doc_id and the same text get the same bitmap; so do rows that differ in text, by their own text's hash.
Very long texts need no special care: a row's lines are exploded one by one. An empty table gives an empty one. Columns of docs that are named
like a result (n_lines, n_dropped, kept) are replaced by it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.llm.common import ascii_lower, ascii_strip, cut_dealt, n_partitions

SALTS = 256


def line_keys(text: Column) -> Column:
    """Array of the keys of a text's lines: ASCII white space stripped, A-Z lower-cased."""
    return F.transform(F.split(F.coalesce(text, F.lit("")), "\n"), lambda x: ascii_lower(ascii_strip(x)))


def line_rows(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", min_chars: int = 1) -> DataFrame:
    """(h, salt, doc, th, pos) for each line whose key has min_chars code points or more."""
    rows = docs.select(F.col(doc_id).alias("doc"), F.xxhash64(F.col(text)).alias("th"), F.posexplode(line_keys(F.col(text))).alias("pos", "key"))
    rows = rows.filter(F.char_length("key") >= min_chars)
    return rows.select(F.unhex(F.md5("key")).alias("h"), F.pmod(F.xxhash64("doc"), F.lit(SALTS)).cast("int").alias("salt"), "doc", "th", "pos")


def line_drops(docs: DataFrame, mode: str = "common", min_docs: int = 2, text: str = "text", doc_id: str = "doc_id", min_chars: int = 1) -> DataFrame:
    """(doc, th, pos) of the lines to drop.

    mode "common": every line whose key occurs in min_docs documents or more.
    mode "first": every line but the first by document and position, of keys in min_docs documents or more.
    """
    n = n_partitions(docs.sparkSession)
    rows = line_rows(docs, text, doc_id, min_chars).repartitionByRange(n, "h", "salt")
    chunk = Window.partitionBy("h", "salt").orderBy("doc", "th", "pos")
    rows = rows.select(  # stored once: counted, then joined with what is counted
        "*",
        (F.row_number().over(chunk) == 1).alias("opens"),
        F.when(F.row_number().over(chunk) == 1, 1).otherwise((~F.col("doc").eqNullSafe(F.lag("doc").over(chunk))).cast("int")).cast("long").alias("new_doc"),
    )
    rows = cut_dealt(rows)
    chunks = rows.groupBy("h", "salt").agg(F.sum("new_doc").alias("n"), F.min(F.when(F.col("opens"), F.struct(F.col("doc").isNull().alias("nil"), "doc", "th", "pos"))).alias("first"))
    hits = chunks.groupBy("h").agg(F.sum("n").alias("n_docs"), F.min("first").alias("first"), F.collect_set("salt").alias("salts"))
    hits = hits.filter(F.col("n_docs") >= min_docs).select("h", "first", F.explode("salts").alias("salt"))
    found = rows.select("h", "salt", "doc", "th", "pos").join(hits, ["h", "salt"])
    if mode == "first":
        found = found.filter(~(F.col("doc").eqNullSafe(F.col("first.doc")) & (F.col("th") == F.col("first.th")) & (F.col("pos") == F.col("first.pos"))))
    return found.select("doc", "th", "pos")


def keep_bitmaps(drops: DataFrame) -> DataFrame:
    """(doc, th, words): words maps i to the bits of lines 64*i to 64*i+63, 1 for a kept line; absent words are all ones."""
    words = drops.groupBy("doc", "th", F.expr("int(pos div 64)").alias("i")).agg(F.bit_or(F.expr("shiftleft(1L, pos % 64)")).alias("dropped"))
    words = words.select("doc", "th", F.struct("i", F.bitwise_not("dropped").alias("bits")).alias("w"))
    return words.groupBy("doc", "th").agg(F.map_from_entries(F.collect_list("w")).alias("words"))


def apply_bitmaps(docs: DataFrame, bitmaps: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """docs with n_lines, n_dropped and kept, the text of the lines whose bit is 1."""
    left = docs.withColumns({"__th": F.xxhash64(F.col(text))})
    right = bitmaps.select(F.col("doc").alias("__doc"), F.col("th").alias("__th2"), F.col("words").alias("__words"))
    joined = left.join(right.hint("shuffle_hash"), F.col(doc_id).eqNullSafe(F.col("__doc")) & (F.col("__th") == F.col("__th2")), "left")
    lines = F.split(F.coalesce(F.col(text), F.lit("")), "\n")
    kept = F.filter(lines, lambda x, i: F.coalesce(F.getbit(F.element_at("__words", (i / 64).cast("int")), i % 64), F.lit(1)) == 1)
    joined = joined.withColumns({"n_lines": F.size(lines).cast("long"), "n_dropped": F.when(F.col("__words").isNull(), F.lit(0)).otherwise(F.aggregate(F.map_values("__words"), F.lit(0), lambda a, w: a + 64 - F.bit_count(w))).cast("long")})
    joined = joined.withColumn("kept", F.when(F.col("__words").isNull(), F.coalesce(F.col(text), F.lit(""))).otherwise(F.array_join(kept, "\n")))
    return joined.drop("__th", "__doc", "__th2", "__words")


def dedup_lines(docs: DataFrame, mode: str = "common", min_docs: int = 10, text: str = "text", doc_id: str = "doc_id", min_chars: int = 1) -> DataFrame:
    """docs with n_lines, n_dropped and kept."""
    return apply_bitmaps(docs, keep_bitmaps(line_drops(docs, mode, min_docs, text, doc_id, min_chars)), text, doc_id)
