"""Queries on the text model: containers, intervals, boxes and lookups."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from quire.functions import geometry as G
from quire.functions import interval as I
from quire.functions.text import base_code
from quire.operators import containers as C
from quire.operators import layout_eval as L
from quire.plans import model as M
from quire.plans.model import sql, table
from quire.plans.registry import query


def docs(spark, d):
    return table(spark, d, "documents")


@query(
    "lines_with_digits",
    sql("SELECT source, count(*) AS n_lines, sum(w_end - w_start + 1)::BIGINT AS n_words FROM lines l JOIN (SELECT doc_id, line_idx, string_agg(text, ' ' ORDER BY word_idx) AS t FROM words GROUP BY ALL) x USING (doc_id, line_idx) WHERE regexp_matches(t, '[0-9]') GROUP BY source"),
)
def lines_with_digits(spark, d):
    """J-01, P-03: words joined into lines by interval, lines' text, those with digits counted."""
    ws = M.words(docs(spark, d))
    children = ws.select("source", F.col("word_idx").alias("w_start"), F.col("word_idx").alias("w_end"), "text")
    pairs = C.contained(children, M.line_containers(ws).select("source", "doc_id", "line_idx", "w_start", "w_end"))
    texts = C.text_of(pairs, "source", "p_doc_id", "p_line_idx", "p_w_start", "p_w_end", order="w_start")
    return texts.filter(F.col("text").rlike("[0-9]")).groupBy("source").agg(F.count("*").alias("n_lines"), F.sum(F.col("p_w_end") - F.col("p_w_start") + 1).alias("n_words"))


@query("w01_word_ranges", sql("SELECT source, doc_id, page_number, n_words, w_start::BIGINT AS w_start, w_end::BIGINT AS w_end FROM pages"))
def word_ranges(spark, d):
    """W-01: every page's interval of word numbers."""
    return M.pages(docs(spark, d))


@query("w01_word_table", sql("SELECT source, doc_id, count(*) AS n, sum(word_idx)::BIGINT AS sum_idx, min(word_idx) AS first_idx, sum(x1)::BIGINT AS sum_x1, sum(x2)::BIGINT AS sum_x2, max(y2) AS bottom FROM words GROUP BY ALL"))
def word_table(spark, d):
    ws = M.words(docs(spark, d))
    return ws.groupBy("source", "doc_id").agg(F.count("*").alias("n"), F.sum("word_idx").alias("sum_idx"), F.min("word_idx").alias("first_idx"), F.sum("x1").alias("sum_x1"), F.sum("x2").alias("sum_x2"), F.max("y2").alias("bottom"))


@query("j01_children_by_range", sql("SELECT r.source, r.doc_id, r.region_idx, r.region_type, count(l.line_idx) AS n_lines, sum(l.w_end - l.w_start + 1)::BIGINT AS n_words FROM regions r JOIN lines l ON l.source = r.source AND l.w_start >= r.w_start AND l.w_end <= r.w_end GROUP BY ALL"))
def children_by_range(spark, d):
    """J-01: lines within regions."""
    ws = M.words(docs(spark, d))
    pairs = C.contained(M.line_containers(ws).select("source", "line_idx", "w_start", "w_end"), M.regions(ws).select("source", "doc_id", "region_idx", "region_type", "w_start", "w_end"))
    return pairs.groupBy("source", F.col("p_doc_id").alias("doc_id"), F.col("p_region_idx").alias("region_idx"), F.col("p_region_type").alias("region_type")).agg(F.count("*").alias("n_lines"), F.sum(F.col("w_end") - F.col("w_start") + 1).alias("n_words"))


@query("j02_parent_lookup", sql("SELECT l.source, l.doc_id, l.line_idx, min(s.section_idx) AS section_idx FROM lines l JOIN sections s ON l.source = s.source AND l.w_start >= s.w_start AND l.w_end <= s.w_end GROUP BY ALL"))
def parent_lookup(spark, d):
    """J-02: the first section that holds each line."""
    ws, ps = M.words(docs(spark, d)), M.pages(docs(spark, d))
    pairs = C.contained(M.line_containers(ws).select("source", "doc_id", "line_idx", "w_start", "w_end"), M.sections(ps), bucket=4096)
    return C.first_parent(pairs.select("source", "doc_id", "line_idx", "p_section_idx"), ["source", "doc_id", "line_idx"], "p_section_idx").withColumnRenamed("p_section_idx", "section_idx")


@query("j03_section_pages", sql("SELECT s.source, s.section_idx, s.start_page, s.end_page, count(*) AS n_pages, sum(p.n_words)::BIGINT AS n_words FROM sections s JOIN pages p ON p.source = s.source AND p.page_number BETWEEN s.start_page AND s.end_page GROUP BY ALL"))
def section_pages(spark, d):
    """J-03: pages by number between a section's first and last."""
    ps = M.pages(docs(spark, d))
    as_range = ps.select("source", F.col("page_number").alias("w_start"), F.col("page_number").alias("w_end"), "n_words")
    by_page = M.sections(ps).select("source", "section_idx", F.col("start_page").alias("w_start"), F.col("end_page").alias("w_end"))
    pairs = C.contained(as_range, by_page, bucket=16)
    return pairs.groupBy("source", F.col("p_section_idx").alias("section_idx"), F.col("p_w_start").alias("start_page"), F.col("p_w_end").alias("end_page")).agg(F.count("*").alias("n_pages"), F.sum("n_words").alias("n_words"))


@query("j04_words_in_regions_spatial", sql("SELECT r.doc_id, r.region_idx, count(*) AS n_words FROM regions r JOIN noisy w ON w.doc_id = r.doc_id AND greatest(least(w.x2, r.x2) + 1 - greatest(w.x1, r.x1), 0) * greatest(least(w.y2, r.y2) + 1 - greatest(w.y1, r.y1), 0) > 0.7 * ((w.x2 - w.x1 + 1) * (w.y2 - w.y1 + 1)) GROUP BY ALL"))
def words_in_regions(spark, d):
    """J-04: more than 0.7 of a word's box in a region's."""
    ws = M.words(docs(spark, d))
    pairs = C.spatially_in(M.noisy(ws).select("doc_id", "word_idx", "x1", "y1", "x2", "y2"), M.regions(ws).select("doc_id", "region_idx", "x1", "y1", "x2", "y2"), 0.7)
    return pairs.groupBy("doc_id", F.col("p_region_idx").alias("region_idx")).agg(F.count("*").alias("n_words"))


@query("j05_line_assignment", sql("SELECT doc_id, line AS line_idx, count(*) AS n_words FROM (SELECT w.doc_id, w.word_idx, min(l.line_idx) AS line FROM noisy w JOIN lines l ON w.doc_id = l.doc_id AND greatest(least(w.x2, l.x2 + 2) + 1 - greatest(w.x1, l.x1), 0) * greatest(least(w.y2, l.y2) + 1 - greatest(w.y1, l.y1), 0) > 0.7 * ((w.x2 - w.x1 + 1) * (w.y2 - w.y1 + 1)) GROUP BY ALL) GROUP BY ALL"))
def line_assignment(spark, d):
    """J-05: a word belongs to the first line that takes it."""
    ws = M.words(docs(spark, d))
    ls = M.line_containers(ws).select("doc_id", "line_idx", "x1", "y1", (F.col("x2") + 2).alias("x2"), "y2")
    pairs = C.spatially_in(M.noisy(ws).select("doc_id", "word_idx", "x1", "y1", "x2", "y2"), ls, 0.7)
    first = C.assign_once(pairs.select("doc_id", "word_idx", "p_line_idx"), ["doc_id", "word_idx"], "p_line_idx")
    return first.groupBy("doc_id", F.col("p_line_idx").alias("line_idx")).agg(F.count("*").alias("n_words"))


ANNOTATIONS = "annotations AS (SELECT source, doc_id, pos AS ann, word_idx AS w_start, least(word_idx + pos % 3, w_end) AS w_end FROM words JOIN (SELECT doc_id, w_end FROM pages) USING (doc_id) WHERE pos % 25 = 3)"


def annotations(ws, ps):
    """A short span of words at every 25th word of a page, starting with the fourth."""
    rows = ws.filter("pos % 25 = 3").join(ps.select("doc_id", "w_end"), "doc_id")
    return rows.select("source", "doc_id", F.col("pos").alias("ann"), F.col("word_idx").alias("w_start"), F.least(F.col("word_idx") + F.col("pos") % 3, F.col("w_end")).alias("w_end"))


@query("p03_annotation_text", sql(f", {ANNOTATIONS} SELECT a.doc_id, a.ann, string_agg(w.text, ' ' ORDER BY w.word_idx) AS text FROM annotations a JOIN words w ON w.source = a.source AND w.word_idx BETWEEN a.w_start AND a.w_end GROUP BY ALL"))
def annotation_text(spark, d):
    """P-03: text of annotations."""
    ws = M.words(docs(spark, d))
    children = ws.select("source", F.col("word_idx").alias("w_start"), F.col("word_idx").alias("w_end"), "text")
    pairs = C.contained(children, annotations(ws, M.pages(docs(spark, d))))
    return C.text_of(pairs, "p_doc_id", "p_ann", order="w_start").select(F.col("p_doc_id").alias("doc_id"), F.col("p_ann").alias("ann"), "text")


@query("p04_annotation_shifts", sql(f", {ANNOTATIONS}, t AS (SELECT a.doc_id, a.ann, string_agg(w.text, ' ' ORDER BY w.word_idx) AS text FROM annotations a JOIN words w ON w.source = a.source AND w.word_idx BETWEEN a.w_start AND a.w_end GROUP BY ALL) SELECT doc_id, ann, substr(text, 2, greatest(length(text) - 1 - ann % 2, 0)) AS text FROM t"))
def annotation_shifts(spark, d):
    """P-04: the annotation's own part of its words, by offsets from either end; 0 at the end is the end."""
    t = annotation_text(spark, d)
    return t.select("doc_id", "ann", F.substring("text", F.lit(2), F.greatest(F.char_length("text") - 1 - F.col("ann") % 2, F.lit(0))).alias("text"))


@query("p05_text_windows", sql(f", {ANNOTATIONS} SELECT a.doc_id, a.ann, string_agg(w.text, ' ' ORDER BY w.word_idx) AS window_text FROM annotations a JOIN words w ON w.source = a.source AND w.word_idx BETWEEN greatest(0, a.w_start - 5) AND a.w_end + 5 GROUP BY ALL"))
def text_windows(spark, d):
    """P-05: five words to either side."""
    ws = M.words(docs(spark, d))
    return C.text_window(ws, annotations(ws, M.pages(docs(spark, d))), 5, ["doc_id", "ann"])


@query("p02_section_by_type", sql("SELECT source, min(section_idx) AS section_idx FROM (SELECT *, CASE WHEN section_idx % 2 = 0 THEN ['introduction','commentary'] ELSE ['commentary'] END AS section_types FROM sections) WHERE list_contains(section_types, 'commentary') GROUP BY source"))
def section_by_type(spark, d):
    """P-02: the first section whose types hold a value."""
    s = M.sections(M.pages(docs(spark, d)))
    s = s.withColumn("section_types", F.when(F.col("section_idx") % 2 == 0, F.array(F.lit("introduction"), F.lit("commentary"))).otherwise(F.array(F.lit("commentary"))))
    return s.filter(F.array_contains("section_types", "commentary")).groupBy("source").agg(F.min("section_idx").alias("section_idx"))


@query("p06_container_ids", sql("SELECT 'region_' || (row_number() OVER (PARTITION BY source ORDER BY w_start) - 1) AS id, source, doc_id, region_idx FROM regions"))
def container_ids(spark, d):
    """P-06: type and number within the source."""
    r = M.regions(M.words(docs(spark, d)))
    n = r.groupBy("source", "doc_id").agg(F.count("*").alias("n"))
    first = M.prefix_sum(n, "source", "doc_id", "n", "first").select("doc_id", "first")
    own = Window.partitionBy("doc_id").orderBy("region_idx")
    r = r.withColumn("k", F.row_number().over(own) - 1).join(first, "doc_id")
    return r.select(F.concat(F.lit("region_"), F.col("first") + F.col("k")).alias("id"), "source", "doc_id", "region_idx")


@query("p08_box_measures", sql("SELECT doc_id, region_idx, x2 - x1 + 1 AS width, y2 - y1 + 1 AS height, (x2 - x1 + 1) * (y2 - y1 + 1) AS area, trunc(x1 + (x2 - x1 + 1) / 2)::INT AS cx, trunc(y1 + (y2 - y1 + 1) / 2)::INT AS cy FROM regions"))
def box_measures(spark, d):
    """P-08, F-06, M-02."""
    b = G.box()
    return M.regions(M.words(docs(spark, d))).select("doc_id", "region_idx", b.width.alias("width"), b.height.alias("height"), b.area.alias("area"), b.center_x.alias("cx"), b.center_y.alias("cy"))


@query("p09_box_from_center", sql("SELECT doc_id, region_idx, trunc(cx - w / 2)::INT AS x1, trunc(cy - h / 2)::INT AS y1, trunc(cx - w / 2)::INT + w::INT AS x2, trunc(cy - h / 2)::INT + h::INT AS y2 FROM (SELECT doc_id, region_idx, (x1 + x2) / 2 AS cx, (y1 + y2) / 2 AS cy, x2 - x1 AS w, y2 - y1 AS h FROM regions)"))
def box_from_center(spark, d):
    """P-09: boxes from centre and size, truncated."""
    r = M.regions(M.words(docs(spark, d)))
    b = G.from_center((F.col("x1") + F.col("x2")) / 2, (F.col("y1") + F.col("y2")) / 2, F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1"))
    return r.select("doc_id", "region_idx", b.x1.alias("x1"), b.y1.alias("y1"), b.x2.alias("x2"), b.y2.alias("y2"))


@query("p10_box_of_words", sql("SELECT source, doc_id, min(x1) AS x1, min(y1) AS y1, max(x2) AS x2, max(y2) AS y2 FROM noisy GROUP BY ALL"))
def box_of_words(spark, d):
    """P-10: the box around a page's words."""
    return M.noisy(M.words(docs(spark, d))).groupBy("source", "doc_id").agg(*G.bounding())


@query("p11_normalised_boxes", sql("SELECT r.doc_id, region_idx, trunc(1000 * r.x1 / p.x2)::INT AS x1, trunc(1000 * r.y1 / p.y2)::INT AS y1, trunc(1000 * r.x2 / p.x2)::INT AS x2, trunc(1000 * r.y2 / p.y2)::INT AS y2 FROM regions r JOIN (SELECT doc_id, max(x2) AS x2, max(y2) AS y2 FROM regions GROUP BY doc_id) p USING (doc_id)"))
def normalised_boxes(spark, d):
    """P-11: coordinates on a grid of 1000."""
    r = M.regions(M.words(docs(spark, d)))
    p = r.groupBy("doc_id").agg(F.max("x2").alias("pw"), F.max("y2").alias("ph"))
    b = G.box().scaled(F.col("pw"), F.col("ph"))
    return r.join(p, "doc_id").select("doc_id", "region_idx", b.x1.alias("x1"), b.y1.alias("y1"), b.x2.alias("x2"), b.y2.alias("y2"))


@query("p13_iiif_urls", sql("SELECT doc_id, region_idx, 'https://example.org/iiif/' || doc_id || '/' || x1 || ',' || y1 || ',' || (x2 - x1 + 1) || ',' || (y2 - y1 + 1) || '/full/0/default.jpg' AS url FROM regions"))
def iiif_urls(spark, d):
    """P-13: image addresses of boxes."""
    b = G.box()
    r = M.regions(M.words(docs(spark, d)))
    return r.select("doc_id", "region_idx", F.concat_ws("/", F.lit("https://example.org/iiif"), "doc_id", F.concat_ws(",", "x1", "y1", b.width, b.height), F.lit("full/0/default.jpg")).alias("url"))


@query("p14_page_numbers", sql("SELECT source || '_' || lpad(page_number::VARCHAR, 4, '0') AS page_id, page_number::INT AS number, source AS commentary FROM pages"))
def page_numbers(spark, d):
    """P-14, T-33: a page id's last part as a number, what stands before as the collection; ids are shown with four places."""
    p = M.pages(docs(spark, d)).select(F.concat("source", F.lit("_"), F.col("page_number").cast("string")).alias("id"))
    number, source = F.substring_index("id", "_", -1), F.regexp_extract("id", "(?s)^(.*)_", 1)
    return p.select(F.concat(source, F.lit("_"), F.lpad(number, 4, "0")).alias("page_id"), number.cast("int").alias("number"), source.alias("commentary"))


#: Labels of drawn regions, as derived from the types; every other one is ground truth.
LABELLED = "labelled AS (SELECT doc_id, region_idx, '_OLR_' || CASE WHEN region_idx % 2 = 0 THEN 'OCRGT_' ELSE '' END || region_type AS label FROM regions)"


def labelled(r):
    return r.withColumn("label", F.concat(F.lit("_OLR_"), F.when(F.col("region_idx") % 2 == 0, "OCRGT_").otherwise(""), F.col("region_type")))


@query("p15_region_labels", sql(f", {LABELLED} SELECT doc_id, region_idx, replace(replace(label, '_OLR_', ''), 'OCRGT_', '') AS region_type, contains(label, 'OCRGT_') AS is_ocr_gt FROM labelled WHERE starts_with(label, '_OLR_') AND NOT contains(label, 'running_header')"))
def region_labels(spark, d):
    """P-15, F-14: types and ground-truth flags from labels, excluded types left out."""
    r = labelled(M.regions(M.words(docs(spark, d)))).filter(F.col("label").startswith("_OLR_") & ~F.col("label").contains("running_header"))
    return r.select("doc_id", "region_idx", F.replace(F.replace("label", F.lit("_OLR_"), F.lit("")), F.lit("OCRGT_"), F.lit("")).alias("region_type"), F.col("label").contains("OCRGT_").alias("is_ocr_gt"))


#: Coarse names of region types.
COARSE = {"primary_text": "MainZone", "commentary": "MainZone", "footnote": "MarginTextZone", "introduction": "MainZone", "running_header": "RunningTitleZone"}


@query("p16_coarse_labels", sql("SELECT CASE region_type WHEN 'footnote' THEN 'MarginTextZone' WHEN 'running_header' THEN 'RunningTitleZone' ELSE 'MainZone' END AS coarse, count(*) AS n FROM regions GROUP BY ALL"))
def coarse_labels(spark, d):
    """P-16: fine to coarse types by a literal map."""
    names = F.create_map(*[F.lit(x) for kv in COARSE.items() for x in kv])
    return M.regions(M.words(docs(spark, d))).groupBy(F.element_at(names, F.col("region_type")).alias("coarse")).agg(F.count("*").alias("n"))


@query("p19_list_chunks", "SELECT user_id, i AS chunk, ids[i * 4 + 1: i * 4 + 4] || list_resize([]::BIGINT[], greatest(0, (i * 4 + 4 - len(ids))::INT)) AS ids FROM (SELECT user_id, list(event_id ORDER BY event_id) AS ids FROM events GROUP BY user_id), generate_series(0, (len(ids) - 1) // 4) g(i)")
def list_chunks(spark, d):
    """P-19: lists in chunks of four, the last padded with nulls."""
    rows = table(spark, d, "events").groupBy("user_id").agg(F.array_sort(F.collect_list("event_id")).alias("ids"))
    parts = F.transform(F.sequence(F.lit(0), (F.size("ids") - 1), F.lit(4)), lambda i: F.slice("ids", i + 1, 4))
    rows = rows.select("user_id", F.posexplode(parts).alias("chunk", "part"))
    return rows.select("user_id", "chunk", F.concat("part", F.array_repeat(F.lit(None).cast("long"), 4 - F.size("part"))).alias("ids"))


ALPHABET = "0123456789abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ"


SQL_PLACES = " || ".join(f"CASE WHEN {k} < 3 OR event_id >= {62**k} THEN substr('{ALPHABET}', (event_id // {62**k} % 62 + 1)::INT, 1) ELSE '' END" for k in range(10, -1, -1))


@query("p20_base62_codes", f"SELECT event_id, {SQL_PLACES} AS code, substr('{ALPHABET}', (year(ts) % 10 + 1)::INT, 1) || substr('{ALPHABET}', (month(ts) + 1)::INT, 1) || substr('{ALPHABET}', (day(ts) + 1)::INT, 1) || substr('{ALPHABET}', (hour(ts) + 1)::INT, 1) || substr('{ALPHABET}', (minute(ts) + 1)::INT, 1) || substr('{ALPHABET}', (second(ts) + 1)::INT, 1) AS datecode FROM (SELECT event_id * 65537 AS event_id, ts FROM events)")
def base62_codes(spark, d):
    """P-20, D-02: numbers and dates in base 62, with as many places as a number needs and three at least."""
    e = table(spark, d, "events").select((F.col("event_id") * 65537).alias("event_id"), "ts")
    date = F.concat(*[F.substring(F.lit(ALPHABET), (v % 62 + 1).cast("int"), F.lit(1)) for v in (F.year("ts") % 10, *[f("ts") for f in (F.month, F.day, F.hour, F.minute, F.second)])])
    return e.select("event_id", base_code(F.col("event_id"), ALPHABET, 3).alias("code"), date.alias("datecode"))


@query("f01_interval_overlap", sql("SELECT a.doc_id, a.region_idx, b.region_idx AS other, greatest(least(a.w_end, b.w_end + 20) + 1 - greatest(a.w_start, b.w_start - 20), 0) AS overlap FROM regions a JOIN regions b ON a.doc_id = b.doc_id AND a.region_idx < b.region_idx WHERE greatest(least(a.w_end, b.w_end + 20) + 1 - greatest(a.w_start, b.w_start - 20), 0) > 0"))
def interval_overlap(spark, d):
    """F-01: overlap lengths of regions with neighbours widened by twenty words."""
    r = M.regions(M.words(docs(spark, d))).select("doc_id", "region_idx", "w_start", "w_end")
    o = r.select(F.col("doc_id").alias("o_doc"), F.col("region_idx").alias("other"), (F.col("w_start") - 20).alias("s"), (F.col("w_end") + 20).alias("e"))
    pairs = r.join(o, (F.col("doc_id") == F.col("o_doc")) & (F.col("region_idx") < F.col("other")))
    return pairs.select("doc_id", "region_idx", "other", I.overlap_length(F.col("w_start"), F.col("w_end"), F.col("s"), F.col("e")).alias("overlap")).filter("overlap > 0")


@query("f03_interval_lists", sql("SELECT doc_id, bool_and(ok) AS inside FROM (SELECT l.doc_id, bool_or(l.w_start >= r.w_start AND l.w_end <= r.w_end + l.line_idx % 2) AS ok FROM lines l JOIN regions r USING (doc_id) GROUP BY l.doc_id, l.line_idx) GROUP BY doc_id"))
def interval_lists(spark, d):
    """F-03: whether every line of a page lies in a single region."""
    ws = M.words(docs(spark, d))
    span = lambda e: F.collect_list(F.struct(F.col("w_start").alias("s"), e.alias("e")))
    ls = M.line_containers(ws).groupBy("doc_id").agg(span(F.col("w_end") - F.col("line_idx") % 2).alias("ls"))
    rs = M.regions(ws).groupBy("doc_id").agg(span(F.col("w_end")).alias("rs"))
    return ls.join(rs, "doc_id").select("doc_id", I.all_within(F.col("ls"), F.col("rs")).alias("inside"))


@query("f04_points_in_boxes", sql("SELECT r.doc_id, r.region_idx, count(*) AS n FROM regions r JOIN words w ON w.doc_id = r.doc_id AND (w.x1 + w.x2) // 2 BETWEEN r.x1 AND r.x2 AND (w.y1 + w.y2) // 2 BETWEEN r.y1 AND r.y2 GROUP BY ALL"))
def points_in_boxes(spark, d):
    """F-04: words by their centre."""
    ws = M.words(docs(spark, d))
    r = M.regions(ws).select(F.col("doc_id").alias("p_doc"), "region_idx", *[F.col(c).alias("p_" + c) for c in ("x1", "y1", "x2", "y2")])
    w = ws.select("doc_id", F.expr("(x1 + x2) div 2").alias("cx"), F.expr("(y1 + y2) div 2").alias("cy"))
    return w.join(r, (F.col("doc_id") == F.col("p_doc")) & G.box("p_").holds_point(F.col("cx"), F.col("cy"))).groupBy("doc_id", "region_idx").agg(F.count("*").alias("n"))


@query("f05_j11_words_in_boxes", sql("SELECT region, count(*) AS n FROM (SELECT w.word_idx, r.region_type AS region FROM words w JOIN regions r ON w.doc_id = r.doc_id AND w.x1 >= r.x1 AND w.y1 >= r.y1 AND w.x2 <= r.x2 AND w.y2 <= r.y2 UNION ALL SELECT word_idx, 'global' FROM words) GROUP BY region"))
def words_in_boxes(spark, d):
    """F-05, J-11: words by the type of region that holds them, and all words."""
    ws = M.words(docs(spark, d))
    r = M.regions(ws).select(F.col("doc_id").alias("p_doc"), "region_type", *[F.col(c).alias("p_" + c) for c in ("x1", "y1", "x2", "y2")])
    held = ws.join(r, (F.col("doc_id") == F.col("p_doc")) & G.box().inside(G.box("p_"))).select(F.col("region_type").alias("region"))
    return held.union(ws.select(F.lit("global"))).groupBy("region").agg(F.count("*").alias("n"))


IOU = "greatest(least(a.x2, b.x2) + 1 - greatest(a.x1, b.x1), 0) * greatest(least(a.y2, b.y2) + 1 - greatest(a.y1, b.y1), 0)"
UNION = f"((a.x2 - a.x1 + 1) * (a.y2 - a.y1 + 1) + (b.x2 - b.x1 + 1) * (b.y2 - b.y1 + 1) - {IOU})"


def paired_boxes(spark, d):
    """Words and the second reading's words of the same line, as boxes with prefixes a_ and b_."""
    ws = M.words(docs(spark, d))
    cols = ("x1", "y1", "x2", "y2")
    a = ws.select("doc_id", "line_idx", F.col("word_idx").alias("a_word"), *[F.col(c).alias("a_" + c) for c in cols])
    b = M.noisy(ws).select("doc_id", "line_idx", F.col("word_idx").alias("b_word"), *[F.col(c).alias("b_" + c) for c in cols])
    return a.join(b, ["doc_id", "line_idx"])


@query("f07_f11_iou_pairs", sql(f"SELECT a.doc_id, count(*) AS n, sum({IOU})::BIGINT AS overlap, round(sum(({IOU})::DOUBLE / {UNION}), 4) AS iou_sum, count(*) FILTER (({IOU}) >= 0.85 * {UNION}) AS n_high FROM words a JOIN noisy b ON a.doc_id = b.doc_id AND a.line_idx = b.line_idx WHERE ({IOU}) > 0 GROUP BY a.doc_id"))
def iou_pairs(spark, d):
    """F-07, F-08, F-10, F-11: overlaps of two readings' boxes."""
    a, b = G.box("a_"), G.box("b_")
    pairs = paired_boxes(spark, d).filter(a.overlaps(b))
    return pairs.groupBy("doc_id").agg(F.count("*").alias("n"), F.sum(a.overlap_area(b)).alias("overlap"), F.round(F.sum(a.iou(b)), 4).alias("iou_sum"), F.count_if(a.iou_at_least(b, 0.85)).alias("n_high"))


@query("f12_entities_in_range", sql(f", {ANNOTATIONS} SELECT r.doc_id, r.region_idx, count(*) AS n FROM regions r JOIN annotations a ON a.doc_id = r.doc_id AND a.w_start >= r.w_start AND a.w_start <= r.w_end AND a.w_end <= r.w_end + 1 GROUP BY ALL"))
def entities_in_range(spark, d):
    """F-12: spans that start in a range and end at most one word past it."""
    ws = M.words(docs(spark, d))
    r = M.regions(ws).select(F.col("doc_id").alias("r_doc"), "region_idx", F.col("w_start").alias("rs"), F.col("w_end").alias("re"))
    a = annotations(ws, M.pages(docs(spark, d)))
    pairs = a.join(r, (F.col("doc_id") == F.col("r_doc")) & I.starts_in_range(F.col("w_start"), F.col("w_end"), F.col("rs"), F.col("re")))
    return pairs.groupBy("doc_id", "region_idx").agg(F.count("*").alias("n"))


@query("f13_safe_divide", sql("SELECT doc_id, line_idx, CASE WHEN n_digits = 0 THEN NULL ELSE round(n / n_digits, 6) END AS ratio FROM (SELECT doc_id, line_idx, length(line)::DOUBLE AS n, length(regexp_replace(line, '[^0-9]', '', 'g')) AS n_digits FROM ln)"))
def safe_divide(spark, d):
    """F-13: null where the divisor is 0."""
    return M.lines(docs(spark, d)).select("doc_id", "line_idx", F.round(F.try_divide(F.char_length("line").cast("double"), F.regexp_count("line", F.lit("[0-9]"))), 6).alias("ratio"))


@query("f15_f16_ground_truth_pages", sql(f", {LABELLED} SELECT doc_id, bool_and(contains(label, 'OCRGT_')) AS full_gt, bool_or(contains(label, 'OCRGT_')) AND NOT bool_and(contains(label, 'OCRGT_')) AS partial_gt FROM labelled GROUP BY doc_id"))
def ground_truth_pages(spark, d):
    """F-15: pages that are ground truth wholly or in part."""
    gt = F.col("label").contains("OCRGT_")
    return labelled(M.regions(M.words(docs(spark, d)))).groupBy("doc_id").agg(F.bool_and(gt).alias("full_gt"), (F.bool_or(gt) & ~F.bool_and(gt)).alias("partial_gt"))


@query("f16_selected_pages", sql("SELECT p.source, p.doc_id, p.n_words FROM pages p WHERE p.doc_id IN (SELECT doc_id FROM labels WHERE quality = 1)"))
def selected_pages(spark, d):
    """F-16, J-28: pages whose id is in a selection, as a left semi join."""
    chosen = table(spark, d, "labels").filter("quality = 1").select("doc_id")
    return M.pages(docs(spark, d)).join(chosen, "doc_id", "left_semi").select("source", "doc_id", "n_words")


@query("f18_f20_layout_criteria", sql("SELECT doc_id, region_idx FROM regions WHERE 2 * ((x2 - x1 + 1) + (y2 - y1 + 1)) > 1500 AND (x2 - x1 + 1) * (y2 - y1 + 1) > 0.5 * 100000 AND (x2 - x1 + 1) * (y2 - y1 + 1) < 1.2 * 100000 AND abs(y1 - 160) <= 100"))
def layout_criteria(spark, d):
    """F-18, F-19, F-20: perimeter, area and vertical position."""
    b = G.box()
    keep = (2 * (b.width + b.height) > 1500) & (b.area > 0.5 * 100000) & (b.area < 1.2 * 100000) & (F.abs(b.y1 - 160) <= 100)
    return M.regions(M.words(docs(spark, d))).filter(keep).select("doc_id", "region_idx")


@query("f32_margin_filter", sql("SELECT doc_id, count(*) AS n FROM words WHERE NOT (x2 < 100 OR x1 > 2000) GROUP BY doc_id"))
def margin_filter(spark, d):
    """F-32: boxes that touch the area between the margins."""
    return M.words(docs(spark, d)).filter(~((F.col("x2") < 100) | (F.col("x1") > 2000))).groupBy("doc_id").agg(F.count("*").alias("n"))


OVER = "greatest(least({0}x2, b.x2) + 1 - greatest({0}x1, b.x1), 0) * greatest(least(a.y2, b.y2) + 1 - greatest(a.y1, b.y1), 0)"


@query("j06_relaxed_words", sql(f"""
, spans AS (SELECT doc_id, min(word_idx) AS k, min(x1) + 30 + CASE WHEN min(word_idx) % 97 = 0 THEN 100000 ELSE 0 END AS x1, min(y1) + 3 * (min(word_idx) % 9) AS y1, min(x2) + 10 * (min(word_idx) % 13) + CASE WHEN min(word_idx) % 97 = 0 THEN 100000 ELSE 0 END AS x2, min(y2) + 3 AS y2 FROM words WHERE pos % 40 = 5 GROUP BY doc_id, line_idx),
boxes AS (SELECT doc_id, k, 0 AS box_no, x1, y1, greatest(x1, x2) AS x2, y2 FROM spans UNION ALL SELECT doc_id, k, 1, x1 - 60, y1 + 40, greatest(x1, x2) - 60, y2 + 40 FROM spans WHERE k % 3 = 0),
pad AS (SELECT *, x1 - (x2 - x1 + 1) // 5 AS wx1, x2 + (x2 - x1 + 1) // 5 AS wx2 FROM boxes),
pairs AS (SELECT a.doc_id, a.k, b.word_idx, max({OVER.format("a.")} * 10 / ((b.x2 - b.x1 + 1) * (b.y2 - b.y1 + 1))) AS inner_share, max({OVER.format("a.w")} * 10 / ((b.x2 - b.x1 + 1) * (b.y2 - b.y1 + 1))) AS wide_share FROM pad a JOIN words b ON a.doc_id = b.doc_id AND a.y1 <= b.y2 AND b.y1 <= a.y2 GROUP BY ALL),
tries AS (SELECT doc_id, k, 9 AS t, word_idx FROM pairs WHERE inner_share > 8 UNION ALL SELECT doc_id, k, t, word_idx FROM pairs, generate_series(2, 8) g(t) WHERE wide_share > t),
hits AS (SELECT doc_id, k, t, word_idx FROM tries QUALIFY t = max(t) OVER (PARTITION BY doc_id, k)),
lost AS (SELECT * FROM boxes WHERE box_no = 0 AND (doc_id, k) NOT IN (SELECT (doc_id, k) FROM hits)),
near AS (SELECT a.doc_id, a.k, arg_min(b.word_idx, power(b.x1 + (b.x2 - b.x1 + 1) // 2 - a.x1 - (a.x2 - a.x1 + 1) // 2, 2) + 10 * power(b.y1 + (b.y2 - b.y1 + 1) // 2 - a.y1 - (a.y2 - a.y1 + 1) // 2, 2) + b.word_idx * 1e-9) AS w FROM lost a JOIN words b USING (doc_id) GROUP BY a.doc_id, a.k)
SELECT doc_id, k, CASE WHEN max(t) = 9 THEN 'inside' ELSE 'wide' END AS how, string_agg(word_idx, ' ' ORDER BY word_idx) AS words FROM hits GROUP BY doc_id, k UNION ALL SELECT doc_id, k, 'nearest', w::VARCHAR FROM near"""))
def relaxed_words(spark, d):
    """J-06: words of the page under the drawn boxes of annotations (some of two boxes, some beside the page)."""
    ws = M.words(docs(spark, d))
    away = F.when(F.col("k") % 97 == 0, 100000).otherwise(0)
    spans = ws.filter("pos % 40 = 5").groupBy("doc_id", "line_idx").agg(F.min("word_idx").alias("k"), *[F.min(c).alias(c) for c in ("x1", "y1", "x2", "y2")])
    spans = spans.select("doc_id", "k", (F.col("x1") + 30 + away).alias("x1"), (F.col("y1") + 3 * (F.col("k") % 9)).alias("y1"), (F.col("x2") + 10 * (F.col("k") % 13) + away).alias("x2"), (F.col("y2") + 3).alias("y2")).withColumn("x2", F.greatest("x1", "x2"))
    # both boxes come from each span where it is, so that spans are made once
    boxed = lambda no, x, y: F.struct(F.lit(no).alias("box_no"), *[(F.col(c) + by).alias(c) for c, by in (("x1", x), ("y1", y), ("x2", x), ("y2", y))])
    boxes = spans.select("doc_id", "k", F.explode(F.array(boxed(0, 0, 0), F.when(F.col("k") % 3 == 0, boxed(1, -60, 40)))).alias("b")).filter("b is not null")
    found = L.drawn_words(boxes.select("doc_id", "k", "b.*"), ws)
    return found.select("doc_id", "k", "how", F.array_join(F.transform("words", lambda w: w.cast("string")), " ").alias("words"))


OFFSETS = "offs AS (SELECT source, doc_id, word_idx, text, coalesce(sum(length(text) + 1) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS b FROM words)"


def offsets(ws):
    """Character offsets of words in a page's text joined by spaces; a word ends at the space after it."""
    before = Window.partitionBy("doc_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    ws = ws.withColumn("begin", F.coalesce(F.sum(F.char_length("text") + 1).over(before), F.lit(0)).cast("long"))
    return ws.withColumn("end", F.col("begin") + F.char_length("text"))


@query("w02_rebuild_offsets", sql(f", {OFFSETS} SELECT doc_id, word_idx, b AS \"begin\", b + length(text) AS \"end\" FROM offs"))
def rebuild_offsets(spark, d):
    """W-02, W-03: running offsets."""
    return offsets(M.words(docs(spark, d))).select("doc_id", "word_idx", "begin", "end")


@query("j07_offset_alignment", sql(f"""
, {OFFSETS}, anns AS (SELECT doc_id, k, 7 * k + 100 * k AS b, 7 * k + 100 * k + 12 AS e FROM documents, generate_series(0, 8) g(k))
SELECT a.doc_id, a.k, min(o.word_idx) AS first_word, max(o.word_idx) AS last_word, (a.b - min(o.b))::BIGINT AS shift_start, (a.e - max(o.b + length(o.text)))::BIGINT AS shift_end, CASE WHEN count(o.word_idx) = 0 THEN 'no words' END AS warning
FROM anns a LEFT JOIN offs o ON o.doc_id = a.doc_id AND greatest(least(a.e, o.b + length(o.text)) + 1 - greatest(a.b, o.b), 0) > 0 GROUP BY a.doc_id, a.k, a.b, a.e"""))
def offset_alignment(spark, d):
    """J-07: annotations on words by overlapping character offsets, shifts from the outer words, a warning where none is met."""
    anns = docs(spark, d).select("doc_id", F.explode(F.sequence(F.lit(0), F.lit(8))).alias("k")).select("doc_id", F.col("k").cast("long").alias("k"), (F.col("k") * 107).cast("long").alias("begin"), (F.col("k") * 107 + 12).cast("long").alias("end"))
    ws = offsets(M.words(docs(spark, d))).select("doc_id", "word_idx", "begin", "end")
    hits = C.overlapping(anns, ws, "doc_id", "begin", "end").groupBy("doc_id", "k").agg(F.min("o_word_idx").alias("first_word"), F.max("o_word_idx").alias("last_word"), F.min("o_begin").alias("b"), F.max("o_end").alias("e"))
    out = anns.join(hits, ["doc_id", "k"], "left")
    return out.select("doc_id", "k", "first_word", "last_word", (F.col("begin") - F.col("b")).alias("shift_start"), (F.col("end") - F.col("e")).alias("shift_end"), F.when(F.col("first_word").isNull(), "no words").alias("warning"))


@query("j08_covered_text", "SELECT doc_id, substr(text, greatest(51 - 10, 1), 32) AS \"window\", coalesce(CASE WHEN doc_id % 3 = 0 THEN 'given' END, substr(text, 51, 12)) AS transcript FROM documents")
def covered_text(spark, d):
    """J-08: ten characters around a span; the transcript, or the text covered."""
    return docs(spark, d).select("doc_id", F.substring("text", 41, 32).alias("window"), F.coalesce(F.when(F.col("doc_id") % 3 == 0, "given"), F.substring("text", 51, 12)).alias("transcript"))


@query("j13_positional_zip", sql("SELECT a.doc_id, count(*) AS n_pairs, count(*) FILTER (a.text = b.text) AS n_same FROM (SELECT doc_id, text, row_number() OVER (PARTITION BY doc_id ORDER BY word_idx) AS k FROM words) a JOIN (SELECT doc_id, text, row_number() OVER (PARTITION BY doc_id ORDER BY word_idx) AS k FROM noisy) b USING (doc_id, k) GROUP BY a.doc_id"))
def positional_zip(spark, d):
    """J-12, J-13: two readings of a page zipped by place, to the shorter."""
    ws = M.words(docs(spark, d))
    place = Window.partitionBy("doc_id").orderBy("word_idx")
    a = ws.select("doc_id", "text", F.row_number().over(place).alias("k"))
    b = M.noisy(ws).select("doc_id", F.col("text").alias("other"), F.row_number().over(place).alias("k"))
    return a.join(b, ["doc_id", "k"]).groupBy("doc_id").agg(F.count("*").alias("n_pairs"), F.count_if(F.col("text") == F.col("other")).alias("n_same"))


@query("j16_j17_tightened_boxes", sql("SELECT r.doc_id, r.region_idx, coalesce(min(w.x1), r.x1) AS x1, coalesce(min(w.y1), r.y1) AS y1, coalesce(max(w.x2), r.x2) AS x2, coalesce(max(w.y2), r.y2) AS y2 FROM (SELECT doc_id, region_idx, x1 - 5 AS x1, y1 - 5 AS y1, x2 - 40 AS x2, y2 + 5 AS y2 FROM regions) r LEFT JOIN noisy w ON w.doc_id = r.doc_id AND greatest(least(w.x2, r.x2) + 1 - greatest(w.x1, r.x1), 0) * greatest(least(w.y2, r.y2) + 1 - greatest(w.y1, r.y1), 0) > 0 AND w.y1 >= r.y1 AND w.y2 <= r.y2 GROUP BY r.doc_id, r.region_idx, r.x1, r.y1, r.x2, r.y2"))
def tightened_boxes(spark, d):
    """J-16, J-17: a box drawn in to the contours that overlap it and do not exceed it vertically; unchanged without any."""
    ws = M.words(docs(spark, d))
    r = M.regions(ws).select(F.col("doc_id").alias("r_doc"), "region_idx", (F.col("x1") - 5).alias("r_x1"), (F.col("y1") - 5).alias("r_y1"), (F.col("x2") - 40).alias("r_x2"), (F.col("y2") + 5).alias("r_y2"))
    w = M.noisy(ws).select("doc_id", "x1", "y1", "x2", "y2")
    hit = (F.col("doc_id") == F.col("r_doc")) & G.box().overlaps(G.box("r_")) & (F.col("y1") >= F.col("r_y1")) & (F.col("y2") <= F.col("r_y2"))
    out = r.join(w, hit, "left").groupBy("r_doc", "region_idx", "r_x1", "r_y1", "r_x2", "r_y2").agg(*G.bounding())
    return out.select(F.col("r_doc").alias("doc_id"), "region_idx", *[F.coalesce(c, "r_" + c).alias(c) for c in ("x1", "y1", "x2", "y2")])


@query("j18_word_region_labels", sql("SELECT w.doc_id, coalesce(r.region_type, 'O') AS label, count(*) AS n FROM noisy w LEFT JOIN (SELECT w.doc_id, w.word_idx, arg_min(r.region_type, r.region_idx) AS region_type FROM noisy w JOIN regions r ON r.doc_id = w.doc_id AND greatest(least(w.x2, r.x2) + 1 - greatest(w.x1, r.x1), 0) * greatest(least(w.y2, r.y2) + 1 - greatest(w.y1, r.y1), 0) > 0.9 * ((w.x2 - w.x1 + 1) * (w.y2 - w.y1 + 1)) GROUP BY ALL) r USING (doc_id, word_idx) GROUP BY ALL"))
def word_region_labels(spark, d):
    """J-18: each word's label is the first region's that holds 0.9 of it, else O."""
    ws = M.words(docs(spark, d))
    w = M.noisy(ws).select("doc_id", "word_idx", "x1", "y1", "x2", "y2")
    pairs = C.spatially_in(w, M.regions(ws).select("doc_id", "region_idx", "region_type", "x1", "y1", "x2", "y2"), 0.9)
    first = C.first_parent(pairs.select("doc_id", "word_idx", "p_region_idx", "p_region_type"), ["doc_id", "word_idx"], "p_region_idx")
    return w.join(first, ["doc_id", "word_idx"], "left").groupBy("doc_id", F.coalesce("p_region_type", F.lit("O")).alias("label")).agg(F.count("*").alias("n"))


WORD_LABELS = "wl AS (SELECT doc_id, line_idx // 4 AS region_idx, CASE word_idx % 5 WHEN 0 THEN 'primary_text' WHEN 1 THEN 'commentary' ELSE 'footnote' END AS label FROM words)"


@query("j19_region_majority", sql(f", {WORD_LABELS} SELECT doc_id, region_idx, arg_max(label, n * 10 - CASE label WHEN 'commentary' THEN 0 WHEN 'footnote' THEN 1 ELSE 2 END) AS label, max(label) AS last_label FROM (SELECT doc_id, region_idx, label, count(*) AS n FROM {'wl'} GROUP BY ALL) GROUP BY doc_id, region_idx"))
def region_majority(spark, d):
    """J-19: a region's commonest word label (ties to the alphabet), and the last by the alphabet."""
    ws = M.words(docs(spark, d)).select("doc_id", F.expr("int(line_idx div 4)").alias("region_idx"), F.when(F.col("word_idx") % 5 == 0, "primary_text").when(F.col("word_idx") % 5 == 1, "commentary").otherwise("footnote").alias("label"))
    counts = ws.groupBy("doc_id", "region_idx", "label").agg(F.count("*").alias("n"))
    best = counts.groupBy("doc_id", "region_idx").agg(F.min(F.struct(-F.col("n"), F.col("label").alias("label"))).alias("b"), F.max("label").alias("last_label"))
    return best.select("doc_id", "region_idx", F.col("b.label").alias("label"), "last_label")


@query("j21_layout_template", sql("SELECT t.source, t.section_idx, p.doc_id, r.region_idx, min(q.region_type) AS region_type FROM sections t JOIN pages tp ON tp.source = t.source AND tp.page_number = t.start_page + 1 JOIN regions q ON q.doc_id = tp.doc_id JOIN pages p ON p.source = t.source AND p.page_number BETWEEN t.start_page AND t.end_page JOIN regions r ON r.doc_id = p.doc_id AND (r.x2 - r.x1 + 1) * (r.y2 - r.y1 + 1) > 0.5 * ((q.x2 - q.x1 + 1) * (q.y2 - q.y1 + 1)) AND (r.x2 - r.x1 + 1) * (r.y2 - r.y1 + 1) < 1.2 * ((q.x2 - q.x1 + 1) * (q.y2 - q.y1 + 1)) AND abs(r.y1 - q.y1) <= 100 GROUP BY ALL"))
def layout_template(spark, d):
    """J-21: the second page of a section lends its labels to regions of like area and height on the section's pages."""
    ws, ps = M.words(docs(spark, d)), M.pages(docs(spark, d))
    r, s = M.regions(ws), M.sections(ps).select("source", "section_idx", "start_page")
    where = ps.select("source", "doc_id", "page_number", F.expr(f"(page_number - 1) div {M.PAGES_PER_SECTION}").alias("section_idx")).join(s, ["source", "section_idx"])
    q = where.filter("page_number = start_page + 1").join(r.select("doc_id", F.col("region_type").alias("region_type"), *[F.col(c).alias("q_" + c) for c in ("x1", "y1", "x2", "y2")]), "doc_id").drop("doc_id", "page_number", "start_page")
    rows = where.join(r.select("doc_id", "region_idx", "x1", "y1", "x2", "y2"), "doc_id").join(q, ["source", "section_idx"])
    a, b = G.box(), G.box("q_")
    rows = rows.filter((a.area > 0.5 * b.area) & (a.area < 1.2 * b.area) & (F.abs(a.y1 - b.y1) <= 100))
    return rows.groupBy("source", "section_idx", "doc_id", "region_idx").agg(F.min("region_type").alias("region_type"))


@query("j22_primary_full", sql(f"""
, {ANNOTATIONS}, prim AS (SELECT source, doc_id, pos AS k, word_idx AS w_start, word_idx + 25 AS w_end FROM words WHERE pos % 50 = 0),
ents AS (SELECT *, CASE WHEN ann % 2 = 0 THEN 'work.primlit' ELSE 'scope' END AS label, 'Q' || (ann % 17) AS wikidata FROM annotations)
SELECT p.doc_id, p.k, coalesce(arg_min(e.wikidata, e.w_start) FILTER (e.label = 'work.primlit'), arg_min(e.wikidata, e.w_start)) AS work FROM prim p JOIN ents e ON e.doc_id = p.doc_id AND e.w_start BETWEEN p.w_start AND p.w_end AND e.w_end <= p.w_end + 1 GROUP BY p.doc_id, p.k"""))
def primary_full(spark, d):
    """J-22: the work a full reference names: its first work entity's, else its first scope's."""
    ws = M.words(docs(spark, d))
    p = ws.filter("pos % 50 = 0").select("source", F.col("doc_id").alias("p_doc"), F.col("pos").alias("k"), F.col("word_idx").alias("ps"), (F.col("word_idx") + 25).alias("pe"))
    e = annotations(ws, M.pages(docs(spark, d))).withColumns({"label": F.when(F.col("ann") % 2 == 0, "work.primlit").otherwise("scope"), "wikidata": F.concat(F.lit("Q"), F.col("ann") % 17)}).drop("source")
    pairs = p.join(e, (F.col("p_doc") == F.col("doc_id")) & I.starts_in_range(F.col("w_start"), F.col("w_end"), F.col("ps"), F.col("pe")))
    work = F.min_by("wikidata", F.when(F.col("label") == "work.primlit", F.col("w_start")))
    return pairs.groupBy("doc_id", "k").agg(F.coalesce(work, F.min_by("wikidata", "w_start")).alias("work"))


@query("j23_entity_for_word", sql(f"""
, {ANNOTATIONS}, prim AS (SELECT doc_id, pos AS k, word_idx AS w_start, word_idx + 6 AS w_end FROM words WHERE pos % 50 = 0)
SELECT w.doc_id, count(p.k) AS n_primary, count(e.ann) FILTER (p.k IS NULL) AS n_entity, count(*) AS n FROM words w LEFT JOIN (SELECT w.doc_id, w.word_idx, min(p.k) AS k FROM words w JOIN prim p ON p.doc_id = w.doc_id AND w.word_idx BETWEEN p.w_start AND p.w_end GROUP BY ALL) p USING (doc_id, word_idx)
LEFT JOIN (SELECT w.doc_id, w.word_idx, min(a.ann) AS ann FROM words w JOIN annotations a ON a.doc_id = w.doc_id AND w.word_idx >= a.w_start AND w.word_idx < a.w_end GROUP BY ALL) e USING (doc_id, word_idx) GROUP BY w.doc_id"""))
def entity_for_word(spark, d):
    """J-23: a word's full reference, else its entity (whose last word is not covered)."""
    ws = M.words(docs(spark, d))
    one = ws.select("source", "doc_id", F.col("word_idx").alias("w_start"), F.col("word_idx").alias("w_end"))
    prim = ws.filter("pos % 50 = 0").select("source", F.col("doc_id").alias("d"), F.col("pos").alias("k"), F.col("word_idx").alias("w_start"), (F.col("word_idx") + 6).alias("w_end"))
    ents = annotations(ws, M.pages(docs(spark, d))).select("source", F.col("doc_id").alias("d"), "ann", "w_start", (F.col("w_end") - 1).alias("w_end"))
    first = lambda parents, k: C.contained(one, parents).filter(F.col("doc_id") == F.col("p_d")).groupBy("doc_id", "w_start").agg(F.min("p_" + k).alias(k))
    out = one.join(first(prim, "k"), ["doc_id", "w_start"], "left").join(first(ents.filter("w_end >= w_start"), "ann"), ["doc_id", "w_start"], "left")
    return out.groupBy("doc_id").agg(F.count("k").alias("n_primary"), F.count_if(F.col("ann").isNotNull() & F.col("k").isNull()).alias("n_entity"), F.count("*").alias("n"))


@query("j24_t30_selectors", sql("SELECT doc_id, selector, regexp_extract(selector, '@n=(\\d+)\\[(\\d+)\\]:', 1)::INT AS first_line, regexp_extract(selector, '@n=(\\d+)\\[(\\d+)\\]:', 2)::INT AS first_char, b + 2 AS \"begin\", b2 + 3 AS \"end\" FROM (SELECT doc_id, line_idx, lead(line_idx) OVER w AS next_line, b, lead(b) OVER w AS b2, 'tei-l@n=' || line_idx || '[2]:tei-l@n=' || lead(line_idx) OVER w || '[3]' AS selector FROM (SELECT doc_id, line_idx, coalesce(sum(length(line)) OVER (PARTITION BY doc_id ORDER BY line_idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS b FROM ln) WINDOW w AS (PARTITION BY doc_id ORDER BY line_idx)) WHERE next_line IS NOT NULL"))
def selectors(spark, d):
    """J-24, T-30: line and character selectors to offsets in the text of all lines."""
    before = Window.partitionBy("doc_id").orderBy("line_idx").rowsBetween(Window.unboundedPreceding, -1)
    ls = M.lines(docs(spark, d)).withColumn("b", F.coalesce(F.sum(F.char_length("line")).over(before), F.lit(0)).cast("long")).select("doc_id", "line_idx", "b")
    order = Window.partitionBy("doc_id").orderBy("line_idx")
    s = ls.withColumn("nxt", F.lead("line_idx").over(order)).filter("nxt is not null").select("doc_id", F.concat(F.lit("tei-l@n="), "line_idx", F.lit("[2]:tei-l@n="), "nxt", F.lit("[3]")).alias("selector"))
    part = lambda side, k: F.regexp_extract("selector", {"a": r"^tei-l@n=(\d+)\[(\d+)\]:", "b": r":tei-l@n=(\d+)\[(\d+)\]$"}[side], k).cast("int")
    s = s.select("doc_id", "selector", part("a", 1).alias("first_line"), part("a", 2).alias("first_char"), part("b", 1).alias("l2"), part("b", 2).alias("c2"))
    s = s.join(ls.withColumnsRenamed({"line_idx": "first_line", "b": "b1"}), ["doc_id", "first_line"]).join(ls.withColumnsRenamed({"line_idx": "l2", "b": "b2"}), ["doc_id", "l2"])
    return s.select("doc_id", "selector", "first_line", "first_char", (F.col("b1") + F.col("first_char")).alias("begin"), (F.col("b2") + F.col("c2")).alias("end"))


@query("o02_reading_lines", sql("SELECT doc_id, region_idx, list(line_idx ORDER BY y1, line_idx)::VARCHAR AS in_order FROM (SELECT doc_id, line_idx // 4 AS region_idx, line_idx, y1 - (line_idx % 3) * 50 AS y1 FROM lines) GROUP BY ALL"))
def reading_lines(spark, d):
    """O-01, O-02: lines of a region by height, then by their own order."""
    ls = M.line_containers(M.words(docs(spark, d))).select("doc_id", F.expr("int(line_idx div 4)").alias("region_idx"), "line_idx", (F.col("y1") - (F.col("line_idx") % 3) * 50).alias("y1"))
    by = ls.groupBy("doc_id", "region_idx").agg(F.array_sort(F.collect_list(F.struct("y1", "line_idx"))).alias("l"))
    return by.select("doc_id", "region_idx", F.concat(F.lit("["), F.array_join(F.col("l.line_idx"), ", "), F.lit("]")).alias("in_order"))
