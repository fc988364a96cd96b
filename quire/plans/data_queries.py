"""Queries on labels, datasets, search and exports; some more on events and vectors."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from quire.operators import containers as C
from quire.operators import datasets as D
from quire.operators import labels as B
from quire.operators import search as S
from quire.plans import model as M
from quire.plans.model import sql, table
from quire.plans.registry import query

GOLD = "CASE pos % 11 WHEN 0 THEN 'B-PERS' WHEN 1 THEN 'I-PERS' WHEN 4 THEN 'B-LOC' WHEN 5 THEN 'I-LOC' WHEN 7 THEN 'I-WORK' ELSE 'O' END"
FOUND = f"CASE WHEN pos % 13 = 0 THEN 'O' ELSE {GOLD} END"
IOB = f"iob AS (SELECT source, doc_id, pos, word_idx, text, {GOLD} AS gold, {FOUND} AS found FROM words)"
SPANS = """sp_{0} AS (SELECT doc_id, any_value(k) AS type, min(pos) AS first, max(pos) AS last FROM (SELECT *, sum(o) OVER (PARTITION BY doc_id ORDER BY pos) AS run FROM (
  SELECT *, CASE WHEN p = 'B' OR k IS DISTINCT FROM lag(k) OVER (PARTITION BY doc_id ORDER BY pos) THEN 1 ELSE 0 END AS o FROM (SELECT doc_id, pos, left({0}, 1) AS p, CASE WHEN {0} <> 'O' THEN substr({0}, 3) END AS k FROM iob))) WHERE k IS NOT NULL GROUP BY doc_id, run)"""


def iob(spark, d):
    ws = M.words(table(spark, d, "documents"))
    return ws.withColumns({"gold": F.expr(GOLD), "found": F.expr(FOUND)})


@query("a26_o04_label_ids", sql(f", {IOB} SELECT label, row_number() OVER (ORDER BY label = 'O', substr(label, 3) || left(label, 1)) - 1 AS id FROM (SELECT DISTINCT gold AS label FROM iob)"))
def label_ids(spark, d):
    """A-26, O-04: label numbers."""
    return B.label_ids(iob(spark, d), "gold")


@query("w05_bio_spans", sql(f", {IOB}, {SPANS.format('gold')} SELECT doc_id, type, first, last FROM sp_gold"))
def bio_spans(spark, d):
    """W-05, T-35: entities as spans."""
    return B.spans(iob(spark, d), "gold", ["doc_id"], "pos")


@query("a18_span_scores", sql(f", {IOB}, {SPANS.format('gold')}, {SPANS.format('found')}, t AS (SELECT type, count(*) FILTER (g AND p) AS tp, count(*) FILTER (g) AS n_gold, count(*) FILTER (p) AS n_found FROM (SELECT type, bool_or(g) AS g, bool_or(NOT g) AS p FROM (SELECT *, true AS g FROM sp_gold UNION ALL SELECT *, false FROM sp_found) GROUP BY doc_id, type, first, last) GROUP BY ROLLUP (type)) SELECT type, tp, n_gold, n_found, round(tp / n_found::DOUBLE, 6) AS precision, round(tp / n_gold::DOUBLE, 6) AS recall, round(2 * (tp / n_found::DOUBLE) * (tp / n_gold::DOUBLE) / (tp / n_found::DOUBLE + tp / n_gold::DOUBLE), 6) AS f1 FROM t"))
def span_scores(spark, d):
    """A-18: entity scores by type and over all."""
    t = iob(spark, d)
    return B.span_scores(B.spans(t, "gold", ["doc_id"], "pos"), B.spans(t, "found", ["doc_id"], "pos"), ["doc_id"])


@query("j26_token_alignment", "SELECT conv_id, turn, CASE WHEN len(ws) = 0 THEN [] ELSE flatten(list_transform(range(1, len(ws) + 1), lambda i: CASE WHEN length(ws[i]) > 5 THEN ['L' || i, 'X'] ELSE ['L' || i] END)) END::VARCHAR AS labels FROM (SELECT conv_id, turn, list_filter(string_split(text, ' '), lambda w: w <> '') AS ws FROM conversations)")
def token_alignment(spark, d):
    """J-26: labels of words on their sub-tokens; words of more than five characters have two."""
    c = table(spark, d, "conversations").select("conv_id", "turn", M.line_words(F.col("text")).alias("ws"))
    c = c.withColumns({"labels": F.transform("ws", lambda w, i: F.concat(F.lit("L"), i + 1)), "ids": F.flatten(F.transform("ws", lambda w, i: F.when(F.char_length(w) > 5, F.array(i, i)).otherwise(F.array(i))))})
    out = B.align_to_tokens(F.col("labels"), F.col("ids"), F.lit("X"))
    return c.select("conv_id", "turn", F.concat(F.lit("["), F.array_join(out, ", "), F.lit("]")).alias("labels"))


@query("k10_j27_write_back", sql(f", {IOB} SELECT doc_id, word_idx, source, CASE WHEN pos % 13 = 0 THEN found ELSE gold END AS label FROM iob"))
def written_back(spark, d):
    """K-10, J-27: predictions put into a label column by line."""
    t = iob(spark, d).select("source", "doc_id", "word_idx", F.concat_ws(":", "source", "word_idx").alias("n"), F.col("gold").alias("label"), "found", "pos")
    return B.write_back(t, t.filter("pos % 13 = 0").select("n", F.col("found").alias("label"))).select("source", "doc_id", "word_idx", "label")


@query("w10_ctc_decode", "SELECT part, array_to_string(list_transform(list_filter(range(1, len(s) + 1), lambda i: s[i] <> '0' AND (i = 1 OR s[i] <> s[i - 1])), lambda i: s[i]), '') AS decoded FROM (SELECT p_partkey AS part, string_split(lpad((p_partkey * 7919 % 100000)::VARCHAR, 5, '0') || lpad((p_partkey * 31 % 1000)::VARCHAR, 3, '0'), '') AS s FROM part)")
def ctc_decode(spark, d):
    """W-10, R-01: best path without blanks and repeats."""
    k = F.col("p_partkey")
    s = F.concat(F.lpad((k * 7919 % 100000).cast("string"), 5, "0"), F.lpad((k * 31 % 1000).cast("string"), 3, "0"))
    return table(spark, d, "part").select(k.alias("part"), B.greedy_decode(F.split(s, ""), "0").alias("decoded"))


@query("a09_f31_normalised_height", sql("SELECT doc_id, line_idx, round(h / avg(h) OVER (PARTITION BY source), 6) AS height FROM (SELECT source, doc_id, line_idx, 20 + (w_end - w_start + 1) % 9 + CASE WHEN line_idx % 40 = 39 THEN 60 ELSE 0 END AS h FROM lines) QUALIFY h / avg(h) OVER (PARTITION BY source) < 1.8"))
def normalised_height(spark, d):
    """A-09, F-31: line heights over their work's mean, double lines dropped; the mean joins back as one row a work."""
    ls = M.line_containers(M.words(table(spark, d, "documents")))
    ls = ls.select("source", "doc_id", "line_idx", (20 + (F.col("w_end") - F.col("w_start") + 1) % 9 + F.when(F.col("line_idx") % 40 == 39, 60).otherwise(0)).alias("h"))
    mean = ls.groupBy("source").agg(F.avg("h").alias("m"))
    return ls.join(mean, "source").withColumn("r", F.col("h") / F.col("m")).filter("r < 1.8").select("doc_id", "line_idx", F.round("r", 6).alias("height"))


@query("a12_s33_weighted_rows", "SELECT doc_id, i AS copy FROM (SELECT doc_id, CASE lang WHEN 'fr' THEN 3 WHEN 'de' THEN 0 ELSE 1 END AS w FROM documents), generate_series(1, w) g(i)")
def weighted_rows(spark, d):
    """A-12, S-33: rows repeated by weight, 0 drops."""
    rows = table(spark, d, "documents").select("doc_id", "lang")
    return D.replicate(rows, F.when(F.col("lang") == "fr", 3).when(F.col("lang") == "de", 0).otherwise(1)).select("doc_id", "copy")


@query("a27_line_metadata", sql("SELECT doc_id, line_idx, total, words, CASE WHEN total = 0 THEN 'unk' WHEN lat >= 0.5 * total AND num < 0.3 * total THEN 'lat' WHEN num >= 0.5 * total THEN 'num' WHEN lat > 0 AND num > 0 THEN 'mix' ELSE 'unk' END AS script FROM (SELECT doc_id, line_idx, length(line) AS total, len(list_filter(string_split(line, ' '), lambda w: w <> '')) AS words, length(line) - length(regexp_replace(line, '[A-Za-zÀ-ÿŒœ]', '', 'g')) AS lat, length(line) - length(regexp_replace(line, '[0-9]', '', 'g')) AS num FROM ln)"))
def line_metadata(spark, d):
    """A-27: lengths and scripts."""
    from quire.functions.text import count_charset

    ls = M.lines(table(spark, d, "documents")).select("doc_id", "line_idx", F.char_length("line").alias("total"), F.size(M.line_words(F.col("line"))).alias("words"), count_charset(F.col("line"), "latin").alias("lat"), count_charset(F.col("line"), "numeral").alias("num"))
    script = F.when(F.col("total") == 0, "unk").when((F.col("lat") >= 0.5 * F.col("total")) & (F.col("num") < 0.3 * F.col("total")), "lat").when(F.col("num") >= 0.5 * F.col("total"), "num").when((F.col("lat") > 0) & (F.col("num") > 0), "mix").otherwise("unk")
    return ls.select("doc_id", "line_idx", "total", "words", script.alias("script"))


@query("u09_hash_sample", "SELECT doc_id FROM documents WHERE ('0x' || left(md5(doc_id || '|42'), 8))::BIGINT < 858993459")
def hash_sample(spark, d):
    """U-09: a fifth of the rows, always the same."""
    return D.sample_rows(table(spark, d, "documents"), "doc_id", 0.2).select("doc_id")


@query("u09_balanced_sample", "SELECT source, doc_id FROM (SELECT source, lang, doc_id, row_number() OVER (PARTITION BY source, lang ORDER BY md5(doc_id || '|42'), doc_id) AS r, count(*) OVER (PARTITION BY source, lang) AS n FROM documents) WHERE r <= 4 AND n >= 3")
def balanced_sample(spark, d):
    """U-09: a few rows of every group that is large enough."""
    return D.at_most_per_group(table(spark, d, "documents").select("source", "lang", "doc_id"), ["source", "lang"], "doc_id", 4, 3).select("source", "doc_id")


@query("u10_u11_splits", "SELECT doc_id, CASE WHEN r <= 5 THEN 'test' WHEN r <= 8 THEN 'dev' ELSE 'train' END AS split FROM (SELECT doc_id, row_number() OVER (PARTITION BY source, lang ORDER BY md5(doc_id || '|42'), doc_id) AS r FROM documents)")
def splits(spark, d):
    """U-10, U-11: stratified splits by hash."""
    return D.split_by_hash(table(spark, d, "documents").select("source", "lang", "doc_id"), ["source", "lang"], "doc_id", 5, 3).select("doc_id", "split")


@query("u12_augmentations", "SELECT doc_id, CASE WHEN k < 10 THEN 'none' WHEN k < 35 THEN 'rotate' WHEN k < 45 THEN 'blur' WHEN k < 60 THEN 'noise' WHEN k < 75 THEN 'ink' WHEN k < 90 THEN 'stretch' ELSE 'crop' END AS kind FROM (SELECT doc_id, ('0x' || left(md5(doc_id || '|7'), 6))::BIGINT % 101 AS k FROM documents)")
def augmentations(spark, d):
    """U-12: a seeded choice of augmentation."""
    k = F.conv(F.left(D.seeded("doc_id", seed=7), F.lit(6)), 16, 10).cast("long") % 101
    kind = F.when(k < 10, "none").when(k < 35, "rotate").when(k < 45, "blur").when(k < 60, "noise").when(k < 75, "ink").when(k < 90, "stretch").otherwise("crop")
    return table(spark, d, "documents").select("doc_id", kind.alias("kind"))


@query("u08_exclusion", "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1)")
def exclusion(spark, d):
    """U-08: rows whose id is not taken."""
    return table(spark, d, "documents").join(table(spark, d, "labels").filter("toxic = 1"), "doc_id", "left_anti").select("doc_id")


@query("w11_batches", """
WITH RECURSIVE o AS (SELECT source, doc_id, n_chars AS n, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS k FROM documents),
r AS (SELECT source, k, doc_id, CASE WHEN n > 10000 THEN 1 ELSE 0 END::BIGINT AS batch, n AS held FROM o WHERE k = 1 UNION ALL
SELECT o.source, o.k, o.doc_id, r.batch + CASE WHEN r.held + o.n > 10000 THEN 1 ELSE 0 END, CASE WHEN r.held + o.n > 10000 THEN o.n ELSE r.held + o.n END FROM r JOIN o ON o.source = r.source AND o.k = r.k + 1)
SELECT source, doc_id, batch FROM r""")
def batches(spark, d):
    """W-11: rows packed in order into batches of bounded size."""
    return D.pack_batches(table(spark, d, "documents").select("source", "doc_id", "n_chars"), ["source"], "doc_id", "n_chars", 10000).select("source", "doc_id", "batch")


@query("w12_overlapping_chunks", sql("SELECT doc_id, line_idx, ceil(greatest(w - 100, 1) / 300.0)::INT AS n, (ceil(greatest(w - 100, 1) / 300.0) * 400 - (ceil(greatest(w - 100, 1) / 300.0) - 1) * 100 - w)::BIGINT AS padding FROM (SELECT doc_id, line_idx, x2 - x1 + 1 AS w FROM lines)"))
def overlapping_chunks(spark, d):
    """W-12: number and padding of overlapping chunks of a line."""
    w = F.col("x2") - F.col("x1") + 1
    return M.line_containers(M.words(table(spark, d, "documents"))).select("doc_id", "line_idx", D.chunk_count(w, 400, 100).alias("n"), D.chunk_padding(w, 400, 100).cast("long").alias("padding"))


@query("w13_worker_ranges", sql("SELECT source, least((page_number - 1) // greatest(n // 7, 1), 6)::INT AS worker, min(page_number) AS first, max(page_number) AS last FROM (SELECT source, page_number, count(*) OVER (PARTITION BY source) AS n FROM pages) GROUP BY ALL"))
def worker_ranges(spark, d):
    """W-13: contiguous ranges of pages by worker."""
    p = M.pages(table(spark, d, "documents")).select("source", "page_number")
    n = p.groupBy("source").agg(F.count("*").alias("n"))
    p = p.join(n, "source").withColumn("worker", D.worker_of(F.col("page_number") - 1, F.col("n"), 7))
    return p.groupBy("source", "worker").agg(F.min("page_number").alias("first"), F.max("page_number").alias("last"))


@query("w15_grouped_tokens", "SELECT doc_id, i AS block, ws[i * 64 + 1: i * 64 + 64][1] AS first_word, ws[i * 64 + 64] AS last_word FROM (SELECT doc_id, list_filter(regexp_split_to_array(text, '\\s+'), lambda w: w <> '') AS ws FROM documents), generate_series(0, len(ws) // 64 - 1) g(i)")
def grouped_tokens(spark, d):
    """W-15: full blocks of 64 tokens, the rest dropped."""
    x = table(spark, d, "documents").select("doc_id", F.filter(F.split("text", r"\s+"), lambda w: w != "").alias("ws")).filter("size(ws) >= 64")
    x = x.select("doc_id", "ws", F.explode(F.expr("sequence(0, int(size(ws) div 64) - 1)")).alias("block"))
    return x.select("doc_id", "block", F.get("ws", F.col("block") * 64).alias("first_word"), F.get("ws", F.col("block") * 64 + 63).alias("last_word"))


@query("w18_pagified", sql("SELECT source, (k - 1) // 20 AS page, count(*) AS n, min(doc_id) AS first_doc FROM (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY doc_id, line_idx) AS k FROM ln) GROUP BY ALL"))
def pagified(spark, d):
    """W-18: twenty lines to a page, none left over."""
    docs = table(spark, d, "documents").select("source", "doc_id", F.size(F.split("text", "\n")).cast("long").alias("n"))
    first = M.prefix_sum(docs, "source", "doc_id", "n", "before")
    ls = first.select("source", "doc_id", F.explode(F.expr("sequence(before, before + n - 1)")).alias("k"))
    return ls.groupBy("source", F.expr("k div 20").alias("page")).agg(F.count("*").alias("n"), F.min("doc_id").alias("first_doc"))


@query("w19_even_word_boxes", sql("SELECT doc_id, line_idx, i AS word, i * w // n AS x1, (i + 1) * w // n AS x2 FROM (SELECT doc_id, line_idx, x2 - x1 + 1 AS w, w_end - w_start + 1 AS n FROM lines), generate_series(0, n - 1) g(i)"))
def even_word_boxes(spark, d):
    """W-19, M-03: a line's width dealt evenly to its words."""
    ls = M.line_containers(M.words(table(spark, d, "documents"))).select("doc_id", "line_idx", (F.col("x2") - F.col("x1") + 1).alias("w"), (F.col("w_end") - F.col("w_start") + 1).alias("n"))
    return ls.select("*", F.explode(F.expr("sequence(0, n - 1)")).alias("word")).select("doc_id", "line_idx", "word", F.expr("word * w div n").alias("x1"), F.expr("(word + 1) * w div n").alias("x2"))


@query("w09_widest_gaps", sql("SELECT doc_id, line_idx, gap_at, width FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, line_idx ORDER BY width DESC, gap_at) AS r FROM (SELECT doc_id, line_idx, x2 + 1 AS gap_at, lead(x1) OVER (PARTITION BY doc_id, line_idx ORDER BY x1) - x2 - 1 AS width FROM (SELECT doc_id, line_idx, x1, x2 - length(text) % 4 * 3 AS x2 FROM words)) WHERE width > 0) WHERE r <= 3"))
def widest_gaps(spark, d):
    """W-09: the widest gaps between a line's words."""
    ws = M.words(table(spark, d, "documents")).select("doc_id", "line_idx", "x1", (F.col("x2") - F.char_length("text") % 4 * 3).alias("x2"))
    line = Window.partitionBy("doc_id", "line_idx")
    g = ws.select("doc_id", "line_idx", (F.col("x2") + 1).alias("gap_at"), (F.lead("x1").over(line.orderBy("x1")) - F.col("x2") - 1).alias("width")).filter("width > 0")
    return g.withColumn("r", F.row_number().over(line.orderBy(F.desc("width"), "gap_at"))).filter("r <= 3").drop("r")


@query("w08_word_groups", sql(", o AS (SELECT doc_id, pos, text, CASE WHEN pos % 25 IN (3, 4, 5) THEN pos // 25 END AS ent FROM words), r AS (SELECT *, sum(opens) OVER (PARTITION BY doc_id ORDER BY pos) AS run FROM (SELECT *, CASE WHEN ent IS NULL OR ent IS DISTINCT FROM lag(ent) OVER (PARTITION BY doc_id ORDER BY pos) THEN 1 ELSE 0 END AS opens FROM o)) SELECT doc_id, run::BIGINT AS run, CASE WHEN any_value(ent) IS NULL THEN '<w>' || string_agg(text, ' ' ORDER BY pos) || '</w>' ELSE '<ref>' || string_agg(text, ' ' ORDER BY pos) || '</ref>' END AS xml FROM r GROUP BY doc_id, run"))
def word_groups(spark, d):
    """W-08: words of one entity share an element, in document order."""
    ws = M.words(table(spark, d, "documents")).withColumn("ent", F.expr("if(pos % 25 in (3, 4, 5), pos div 25, null)"))
    order = Window.partitionBy("doc_id").orderBy("pos")
    ws = C.islands(ws.withColumn("o", F.col("ent").isNull() | ~F.col("ent").eqNullSafe(F.lag("ent").over(order))), ["doc_id"], "pos", F.col("o"), "run")
    g = C.text_of(ws.withColumn("e", F.col("ent").isNotNull()), "doc_id", "run", "e", order="pos")
    tag = F.when(F.col("e"), "ref").otherwise("w")
    return g.select("doc_id", "run", F.concat(F.lit("<"), tag, F.lit(">"), "text", F.lit("</"), tag, F.lit(">")).alias("xml"))


@query("o10_capped_selection", "SELECT source, doc_id FROM (SELECT source, doc_id, tier, row_number() OVER (PARTITION BY source ORDER BY tier, doc_id) AS r FROM (SELECT source, doc_id, CASE WHEN n_chars > 5000 THEN 1 WHEN n_chars > 2000 THEN 2 ELSE 3 END AS tier FROM documents)) WHERE r <= 12 OR tier = 1")
def capped_selection(spark, d):
    """O-10: the first tier whole, then up to a dozen pages a source."""
    x = table(spark, d, "documents").select("source", "doc_id", F.when(F.col("n_chars") > 5000, 1).when(F.col("n_chars") > 2000, 2).otherwise(3).alias("tier"))
    return x.withColumn("r", F.row_number().over(Window.partitionBy("source").orderBy("tier", "doc_id"))).filter("r <= 12 or tier = 1").select("source", "doc_id")


@query("o07_o09_extremes", sql("SELECT doc_id, arg_min(line_idx, x2 - x1) FILTER (x2 - x1 > 300) AS narrow, max(line_idx) AS last, arg_max(line_idx, (x2 - x1) * 100000 - line_idx) AS widest FROM (SELECT doc_id, line_idx, x1, x2 FROM lines WHERE (x2 - x1) % 1 = 0) GROUP BY doc_id HAVING count(DISTINCT x2 - x1) = count(*)"))
def extremes(spark, d):
    """O-06, O-07, O-09: firsts and extremes by ordered aggregates."""
    ls = M.line_containers(M.words(table(spark, d, "documents"))).withColumn("w", F.col("x2") - F.col("x1"))
    g = ls.groupBy("doc_id").agg(F.min_by("line_idx", F.when(F.col("w") > 300, F.col("w"))).alias("narrow"), F.max("line_idx").alias("last"), F.max_by("line_idx", F.col("w").cast("long") * 100000 - F.col("line_idx")).alias("widest"), F.count_distinct("w").alias("a"), F.count("*").alias("b"))
    return g.filter("a = b").select("doc_id", "narrow", "last", "widest")


@query("o08_nulls_first_top", "SELECT o_orderkey, o_custkey, price FROM (SELECT o_orderkey, o_custkey, CASE WHEN o_orderkey % 50 = 0 THEN NULL ELSE o_totalprice END AS price FROM orders) ORDER BY price ASC NULLS FIRST, o_orderkey LIMIT 400")
def nulls_first(spark, d):
    """O-08, O-11: several keys, nulls first, the head of the order (a top-k)."""
    o = table(spark, d, "orders").select("o_orderkey", "o_custkey", F.when(F.col("o_orderkey") % 50 != 0, F.col("o_totalprice")).alias("price"))
    return o.orderBy(F.asc_nulls_first("price"), "o_orderkey").limit(400)


@query("a24_best_rows", "SELECT o_orderpriority, arg_max(o_orderkey, o_totalprice) AS best, max(o_totalprice) AS price FROM orders GROUP BY ALL")
def best_rows(spark, d):
    """A-24: the best row of each group."""
    return table(spark, d, "orders").groupBy("o_orderpriority").agg(F.max_by("o_orderkey", "o_totalprice").alias("best"), F.max("o_totalprice").alias("price"))


@query("u03_u04_unions", "SELECT k, name, NULL::DOUBLE AS acctbal, p_size AS size FROM (SELECT p_partkey AS k, p_name AS name, p_size FROM part) UNION ALL SELECT s_suppkey, s_name, s_acctbal, NULL FROM supplier")
def unions(spark, d):
    """U-03, U-04, A-28: frames joined by column names."""
    a = table(spark, d, "part").select(F.col("p_partkey").alias("k"), F.col("p_name").alias("name"), F.col("p_size").alias("size"))
    b = table(spark, d, "supplier").select(F.col("s_suppkey").alias("k"), F.col("s_name").alias("name"), F.col("s_acctbal").alias("acctbal"))
    return a.unionByName(b, allowMissingColumns=True).select("k", "name", "acctbal", "size")


@query("j30_config_results", "SELECT c.n_name, o.o_orderstatus, o.n FROM (SELECT n_name FROM nation WHERE n_nationkey = 3) c CROSS JOIN (SELECT o_orderstatus, count(*) AS n FROM orders GROUP BY ALL) o")
def config_results(spark, d):
    """J-30: one row of settings beside each result row."""
    one = table(spark, d, "nation").filter("n_nationkey = 3").select("n_name")
    return one.crossJoin(table(spark, d, "orders").groupBy("o_orderstatus").agg(F.count("*").alias("n")))


@query("j31_tokens_in_sentences", sql(", s AS (SELECT doc_id, line_idx, coalesce(sum(length(line) + 1) OVER (PARTITION BY doc_id ORDER BY line_idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS b, length(line) AS n FROM ln) SELECT doc_id, line_idx, b AS \"begin\", b + n AS \"end\", CASE WHEN n > 0 THEN regexp_extract('primlit.' || line_idx, '^[^.]*') END AS coarse FROM s"))
def tokens_in_sentences(spark, d):
    """J-31: sentences by offsets, fine labels to coarse ones."""
    order = Window.partitionBy("doc_id").orderBy("line_idx").rowsBetween(Window.unboundedPreceding, -1)
    s = M.lines(table(spark, d, "documents")).select("doc_id", "line_idx", F.char_length("line").alias("n"), F.coalesce(F.sum(F.char_length("line") + 1).over(order), F.lit(0)).cast("long").alias("begin"))
    return s.select("doc_id", "line_idx", "begin", (F.col("begin") + F.col("n")).alias("end"), F.when(F.col("n") > 0, F.substring_index(F.concat(F.lit("primlit."), "line_idx"), ".", 1)).alias("coarse"))


@query("j32_unmatched_lines", sql("SELECT DISTINCT a.line FROM ln a WHERE a.doc_id % 2 = 0 AND NOT EXISTS (SELECT 1 FROM ln b WHERE b.doc_id % 2 = 1 AND b.line = a.line)"))
def unmatched_lines(spark, d):
    """J-32: lines of one half without a twin in the other."""
    ls = M.lines(table(spark, d, "documents"))
    return ls.filter("doc_id % 2 = 0").select("line").distinct().join(ls.filter("doc_id % 2 = 1").select("line"), "line", "left_anti")


@query("j33_box_fallback", sql("SELECT doc_id, line_idx, CASE WHEN a = n THEN 'gaps' WHEN b = n THEN 'projection' ELSE 'even' END AS method FROM (SELECT l.doc_id, l.line_idx, l.w_end - l.w_start + 1 AS n, l.w_end - l.w_start + 1 - CASE WHEN line_idx % 3 = 0 THEN 1 ELSE 0 END AS a, l.w_end - l.w_start + 1 - CASE WHEN line_idx % 2 = 0 THEN 1 ELSE 0 END AS b FROM lines l)"))
def box_fallback(spark, d):
    """J-33: the first method that found as many boxes as there are words."""
    n = F.col("w_end") - F.col("w_start") + 1
    ls = M.line_containers(M.words(table(spark, d, "documents"))).select("doc_id", "line_idx", n.alias("n"), (n - F.when(F.col("line_idx") % 3 == 0, 1).otherwise(0)).alias("a"), (n - F.when(F.col("line_idx") % 2 == 0, 1).otherwise(0)).alias("b"))
    return ls.select("doc_id", "line_idx", F.when(F.col("a") == F.col("n"), "gaps").when(F.col("b") == F.col("n"), "projection").otherwise("even").alias("method"))


TERMS = "list_filter(list_transform(regexp_split_to_array(lower(strip_accents(text)), '\\s+'), lambda w: regexp_replace(w, '^[^a-z0-9]+|[^a-z0-9]+$', '', 'g')), lambda w: w <> '' AND w NOT IN ('a','an','and','are','as','at','be','by','for','from','has','he','in','is','it','its','of','on','that','the','to','was','were','will','with'))"
INDEX = f"idx AS (SELECT term, doc_id, n_terms, count(*) AS tf FROM (SELECT doc_id, len(t) AS n_terms, unnest(t) AS term FROM (SELECT doc_id, {TERMS} AS t FROM documents)) GROUP BY ALL)"


def indexed(spark, d):
    return S.postings(S.search_documents(table(spark, d, "documents")))


@query("x03_k14_postings", f"WITH {INDEX} SELECT term, count(*) AS df, sum(tf)::BIGINT AS tf FROM idx GROUP BY term")
def index_terms(spark, d):
    """X-02, X-03, K-14: the inverted index by term."""
    return indexed(spark, d).groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("tf"))


@query("x04_bm25", f"WITH {INDEX}, n AS (SELECT doc_id, any_value(n_terms) AS n FROM idx GROUP BY doc_id), h AS (SELECT *, count(*) OVER (PARTITION BY term) AS df FROM idx WHERE term IN ('idiot', 'elle', 'rerely', 'ciones')) SELECT doc_id, round(sum(ln(1 + (nd - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * n_terms / mean_n))), 6) AS score FROM h CROSS JOIN (SELECT count(*) AS nd, avg(n) AS mean_n FROM n) GROUP BY doc_id")
def bm25(spark, d):
    """X-04: ranked search, diacritics aside."""
    return S.bm25(indexed(spark, d), "idiot Elle, rerely ciónes").select("doc_id", F.round("score", 6).alias("score"))


# -- Exports as strings -----------------------------------------------------------------------------------------------


@query("k02_page_json", sql("SELECT doc_id, to_json({'id': doc_id, 'regions': list(r ORDER BY region_idx)})::VARCHAR AS page FROM (SELECT doc_id, region_idx, {'region_type': region_type, 'bbox': [x1, y1, x2 - x1 + 1, y2 - y1 + 1]} AS r FROM regions) GROUP BY doc_id"))
def page_json(spark, d):
    """K-01, K-02, J-S1: nested JSON of pages, boxes as x, y, width, height."""
    from quire.sinks.json_export import page_regions

    return page_regions(M.regions(M.words(table(spark, d, "documents"))))


@query("k04_alto_lines", sql("SELECT doc_id, line_idx, '<TextLine HPOS=\"' || min(x1) || '\" VPOS=\"' || min(y1) || '\">' || string_agg('<String CONTENT=\"' || replace(replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;') || '\" HPOS=\"' || x1 || '\"/>', '' ORDER BY pos) || '</TextLine>' AS xml FROM words GROUP BY doc_id, line_idx"))
def alto_lines(spark, d):
    """K-04: lines of an ALTO page."""
    from quire.sinks.xml_export import alto_text_lines

    return alto_text_lines(M.words(table(spark, d, "documents")))


@query("k05_tei_pages", sql("SELECT doc_id, '<div n=\"' || doc_id || '\">' || string_agg(xml, '' ORDER BY line_idx) || '</div>' AS xml FROM (SELECT doc_id, line_idx, '<l n=\"' || line_idx || '\">' || string_agg(replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), ' ' ORDER BY pos) || '</l>' AS xml FROM words GROUP BY doc_id, line_idx) GROUP BY doc_id"))
def tei_pages(spark, d):
    """K-05: pages as TEI divisions of lines."""
    from quire.sinks.xml_export import tei_divisions

    return tei_divisions(M.words(table(spark, d, "documents")))


@query("k06_via_regions", sql("SELECT doc_id, '_OLR_' || region_type AS label, x1 AS x, y1 AS y, x2 - x1 AS width, y2 - y1 AS height FROM regions WHERE region_type <> 'running_header' UNION ALL SELECT doc_id, '_OLR_line_region', x1, y1, x2 - x1, y2 - y1 FROM lines UNION ALL SELECT doc_id, text, x1, y1, x2 - x1, y2 - y1 FROM words"))
def via_regions(spark, d):
    """K-06: the shapes of an annotation project: words, lines, regions."""
    from quire.sinks.json_export import via_shapes

    ws = M.words(table(spark, d, "documents"))
    return via_shapes(ws, M.line_containers(ws), M.regions(ws), excluded=("running_header",)).drop("part", "n")


@query("k07_line_pairs", sql("SELECT doc_id || '_' || (row_number() OVER (PARTITION BY doc_id ORDER BY line_idx) - 1) AS line_id, t AS text FROM (SELECT doc_id, line_idx, string_agg(text, ' ' ORDER BY pos) AS t FROM words GROUP BY ALL)"))
def numbered_lines(spark, d):
    """K-07: lines numbered in their page."""
    t = C.text_of(M.words(table(spark, d, "documents")), "doc_id", "line_idx", order="pos")
    k = F.row_number().over(Window.partitionBy("doc_id").orderBy("line_idx")) - 1
    return t.select(F.concat_ws("_", "doc_id", k).alias("line_id"), "text")


@query("k11_s14_yolo_labels", sql("SELECT doc_id, region_idx, list_position(['primary_text','commentary','footnote','introduction','running_header'], region_type) - 1 AS cls, round(((x1 + x2) / 2) / w, 6) AS cx, round((x2 - x1 + 1) / w::DOUBLE, 6) AS bw FROM regions JOIN (SELECT doc_id, max(x2) + 1 AS w FROM regions GROUP BY doc_id) USING (doc_id)"))
def yolo_labels(spark, d):
    """K-11, S-14: normalised centres and sizes."""
    from quire.sinks.tables import yolo_rows

    r = M.regions(M.words(table(spark, d, "documents")))
    size = r.groupBy("doc_id").agg((F.max("x2") + 1).alias("page_width"), (F.max("y2") + 1).alias("page_height"))
    y = yolo_rows(r.join(size, "doc_id"), M.REGION_TYPES)
    return y.select("doc_id", "region_idx", "cls", F.round("cx", 6).alias("cx"), F.round("w", 6).alias("bw"))


@query("k13_s25_corpus_text", "SELECT source, sha256(string_agg(text, chr(10) || chr(10) || chr(10) ORDER BY doc_id)) AS digest, sum(length(text))::BIGINT AS n FROM documents GROUP BY source")
def corpus_text(spark, d):
    """K-13, S-19, S-25: a corpus as one text, documents apart by two empty lines."""
    g = table(spark, d, "documents").groupBy("source").agg(F.array_sort(F.collect_list(F.struct("doc_id", "text"))).alias("d"), F.sum(F.char_length("text")).alias("n"))
    return g.select("source", F.sha2(F.array_join(F.col("d.text"), "\n\n\n"), 256).alias("digest"), "n")


@query("k16_segmonto", sql("SELECT doc_id, list(zone ORDER BY region_idx)::VARCHAR AS zones FROM (SELECT doc_id, region_idx, CASE region_type WHEN 'footnote' THEN 'MarginTextZone' WHEN 'running_header' THEN 'RunningTitleZone' ELSE 'MainZone' END AS zone FROM regions) GROUP BY doc_id"))
def segmonto(spark, d):
    """K-16: pages' zones under mapped names."""
    from quire.plans.layout_queries import COARSE

    names = F.create_map(*[F.lit(x) for kv in COARSE.items() for x in kv])
    g = M.regions(M.words(table(spark, d, "documents"))).groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("region_idx", F.element_at(names, F.col("region_type")).alias("zone")))).alias("z"))
    return g.select("doc_id", F.concat(F.lit("["), F.array_join(F.col("z.zone"), ", "), F.lit("]")).alias("zones"))


@query("k17_correction_json", sql("SELECT doc_id, line_idx, to_json({'ocr': {'line': translate(t, 'eao', 'coa')}, 'groundtruth': {'line': t}})::VARCHAR AS json FROM (SELECT doc_id, line_idx, string_agg(text, ' ' ORDER BY pos) AS t FROM words GROUP BY ALL)"))
def correction_json(spark, d):
    """K-17, S-17: pairs for post-correction as JSON lines."""
    t = C.text_of(M.words(table(spark, d, "documents")), "doc_id", "line_idx", order="pos")
    j = F.to_json(F.struct(F.struct(F.translate("text", "eao", "coa").alias("line")).alias("ocr"), F.struct(F.col("text").alias("line")).alias("groundtruth")))
    return t.select("doc_id", "line_idx", j.alias("json"))


@query("s24_lexicon", "SELECT p_brand AS lemma, arg_max(def, p_partkey) AS definition FROM (SELECT p_brand, p_partkey, CASE WHEN ends_with(p_name, '.') THEN p_name ELSE p_name || '.' END AS def FROM part) GROUP BY ALL")
def lexicon(spark, d):
    """S-24: entries end in a stop, the last of a lemma wins."""
    name = F.col("p_name")
    return table(spark, d, "part").groupBy(F.col("p_brand").alias("lemma")).agg(F.max_by(F.when(name.endswith("."), name).otherwise(F.concat(name, F.lit("."))), "p_partkey").alias("definition"))


# -- Beyond the reference: streams' windows, vectors -------------------------------------------------------------------


@query("x_event_windows", "SELECT event_type, time_bucket(INTERVAL 1 DAY, ts) AS day, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def event_windows(spark, d):
    """Additional: tumbling windows."""
    e = table(spark, d, "events").groupBy("event_type", F.window("ts", "1 day").alias("w")).agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))
    return e.select("event_type", F.col("w.start").cast("timestamp_ntz").alias("day"), "n", "total")


@query("x_event_sessions", "SELECT user_id, run::BIGINT AS session, count(*) AS n FROM (SELECT user_id, sum(o) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS run FROM (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) < INTERVAL 12 HOUR THEN 0 ELSE 1 END AS o FROM events)) GROUP BY ALL")
def event_sessions(spark, d):
    """Additional: sessions by gaps."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    e = table(spark, d, "events").withColumn("o", F.coalesce(F.col("ts") - F.lag("ts").over(w) < F.expr("interval 12 hours"), F.lit(False)))
    return e.withColumn("session", F.sum(F.when(F.col("o"), 0).otherwise(1)).over(w.rowsBetween(Window.unboundedPreceding, 0))).groupBy("user_id", "session").agg(F.count("*").alias("n"))
