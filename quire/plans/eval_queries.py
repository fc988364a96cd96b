"""Queries on evaluation: readings against ground truth, predicted shapes, order-dependent layout."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from quire.functions import geometry as G
from quire.operators import containers as C
from quire.operators import evaluation as E
from quire.operators import layout_eval as L
from quire.plans import model as M
from quire.plans.model import sql, table
from quire.plans.registry import query

#: ASCII letters only, as one engine's edit distance counts bytes.
LINE_PAIRS = "pairs AS (SELECT doc_id, line_idx, a AS gt, translate(a, 'eao', 'coa') || CASE WHEN line_idx % 3 = 0 THEN ' x' ELSE '' END AS ocr FROM (SELECT doc_id, line_idx, regexp_replace(line, '[^ -~]', '', 'g') AS a FROM ln) WHERE a <> '')"


def line_pairs(spark, d, whole=True):
    """Lines as in LINE_PAIRS, or cut to 60 characters."""
    a = F.regexp_replace("line", "[^ -~]", "")
    a = a if whole else F.left(a, F.lit(60))
    ls = M.lines(table(spark, d, "documents")).select("doc_id", "line_idx", a.alias("gt")).filter("gt <> ''")
    # edit distances are quadratic in a line: the long lines of one file are dealt to all tasks
    ls = ls.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "doc_id", "line_idx")
    return ls.withColumn("ocr", F.concat(F.translate("gt", "eao", "coa"), F.when(F.col("line_idx") % 3 == 0, " x").otherwise("")))


@query("t27_a04_line_error_rate", sql(f", {LINE_PAIRS} SELECT doc_id, count(*) AS n_lines, sum(length(gt))::BIGINT AS chars, sum(levenshtein(gt, ocr))::BIGINT AS distance, round(sum(levenshtein(gt, ocr))::DOUBLE / sum(length(gt)), 3) AS cer FROM pairs GROUP BY doc_id"))
def line_error_rate(spark, d):
    """T-27, A-02, A-04: character error rates of lines."""
    p = line_pairs(spark, d).withColumn("distance", E.line_distance(F.col("gt"), F.col("ocr")))
    return p.groupBy("doc_id").agg(F.count("*").alias("n_lines"), F.sum(F.char_length("gt")).alias("chars"), F.sum("distance").alias("distance"), E.error_rate(F.col("distance"), F.char_length("gt")).alias("cer"))


@query("a04_word_error_rate")
def word_error_rate(spark, d):
    """A-04: characters and words (as split at single spaces), their distances and error rates over all lines."""
    e = E.line_errors(line_pairs(spark, d))
    sums = [F.sum(c).alias(c) for c in ("chars", "chars_distance", "words", "words_distance")]
    rates = [F.round(F.try_divide(f"{c}_distance", c), 3).alias(f"{c}_er") for c in ("chars", "words")]
    return e.agg(F.count("*").alias("n_lines"), *sums).select("*", *rates)


@query("a04_line_record")
def line_record(spark, d):
    """A-04: the whole record by line, words' distances included."""
    return E.line_errors(line_pairs(spark, d))


@query("a05_edit_histogram")
def edit_histogram(spark, d):
    """A-05, O-03, T-28: edit operations of all lines."""
    return E.edit_histogram(line_pairs(spark, d, whole=False))


@query("a06_charset_errors")
def charset_errors(spark, d):
    """A-06: errors by charset."""
    p = line_pairs(spark, d, whole=False).select(E.charset_error_counts("gt", "ocr").alias("e"))
    return p.agg(*[F.sum(f"e.{c}").alias(c) for c in ("latin", "greek", "numeral", "punctuation")])


@query("a25_mean_improvement", sql(f", {LINE_PAIRS} SELECT doc_id, round(avg((levenshtein(gt, ocr) - levenshtein(gt, replace(ocr, 'c', 'e')))::DOUBLE / length(gt)), 6) AS improvement FROM pairs GROUP BY doc_id"))
def mean_improvement(spark, d):
    """A-25: what a correction gains, as edits per character."""
    gain = (E.line_distance(F.col("gt"), F.col("ocr")) - E.line_distance(F.col("gt"), F.replace("ocr", F.lit("c"), F.lit("e")))) / F.char_length("gt")
    return line_pairs(spark, d).groupBy("doc_id").agg(F.round(F.avg(gain), 6).alias("improvement"))


def two_sides(spark, d):
    """Words and their second reading (as M.noisy() has it), both made of each word where it is: words are split and placed once."""
    cols = ["text", "x1", "y1", "x2", "y2"]
    side = lambda name, c: F.struct(F.lit(name).alias("side"), *c)
    both = F.array(side("gt", cols), F.when(M.is_read(), side("pred", M.misread())))
    rows = M.words(table(spark, d, "documents")).select("doc_id", F.col("word_idx").alias("n"), F.explode(both).alias("s"))
    return rows.filter("s is not null").select("s.side", "doc_id", "n", *["s." + c for c in cols])


@query("a01_j10_bag_of_words")
def bag_of_words(spark, d):
    """A-01, J-10: words of a page matched lexically, one to one."""
    return E.bag_of_words_scores(M.page_readings(table(spark, d, "documents")))


@query("j09_greedy_boxes")
def greedy_boxes(spark, d):
    """J-09: words of a page matched by boxes, one to one, in order."""
    return E.match_by_boxes(two_sides(spark, d), 0.8)


@query("a03_coordinate_cube", sql("""
, m AS (SELECT a.doc_id, a.line_idx, a.word_idx, a.text AS gt, b.text AS pred FROM words a LEFT JOIN noisy b ON a.word_idx = b.word_idx AND a.source = b.source),
r AS (SELECT m.*, g.region_type AS region FROM m JOIN regions g ON g.doc_id = m.doc_id AND g.region_idx = m.line_idx // 4 UNION ALL SELECT m.*, 'global' FROM m)
SELECT region, level, sum(total)::BIGINT AS total, sum(CASE WHEN pred IS NULL THEN 0 ELSE total END)::BIGINT AS evaluated, sum(CASE WHEN pred IS NOT NULL AND gt <> pred THEN CASE WHEN level = 'words' THEN 1 ELSE length(gt) END ELSE 0 END)::BIGINT AS false FROM (SELECT region, gt, pred, 'words' AS level, 1 AS total FROM r UNION ALL SELECT region, gt, pred, 'chars', length(gt) FROM r) GROUP BY region, level"""))
def coordinate_cube(spark, d):
    """A-03: totals, evaluated and false by region and level, in one pass over melted rows."""
    ws = M.words(table(spark, d, "documents"))
    m = ws.select("source", "doc_id", "line_idx", "word_idx", F.col("text").alias("gt")).join(M.noisy(ws).select("source", "word_idx", F.col("text").alias("pred")), ["source", "word_idx"], "left")
    m = m.withColumn("region", M.region_type(F.col("doc_id"), F.expr(f"line_idx div {M.LINES_PER_REGION}")))
    m = m.select(F.explode(F.array("region", F.lit("global"))).alias("region"), "gt", "pred", F.expr("stack(2, 'words', 1, 'chars', char_length(gt)) as (level, total)"))
    wrong = F.col("pred").isNotNull() & (F.col("gt") != F.col("pred"))
    return m.groupBy("region", "level").agg(F.sum("total").alias("total"), F.sum(F.when(F.col("pred").isNull(), 0).otherwise(F.col("total"))).alias("evaluated"), F.sum(F.when(wrong, F.when(F.col("level") == "words", 1).otherwise(F.char_length("gt"))).otherwise(0)).alias("false"))


@query("a07_duplicate_boxes", sql("SELECT doc_id, count(*) - count(DISTINCT (x1, y1, x2, y2)) AS duplicates FROM (SELECT doc_id, x1 - x1 % 200 AS x1, y1, x2 - x2 % 200 AS x2, y2 FROM words) GROUP BY doc_id"))
def duplicate_boxes(spark, d):
    """A-07: boxes (on a coarse grid) that stand twice on a page."""
    ws = M.words(table(spark, d, "documents")).select("doc_id", (F.col("x1") - F.col("x1") % 200).alias("x1"), "y1", (F.col("x2") - F.col("x2") % 200).alias("x2"), "y2")
    once = ws.groupBy("doc_id", "x1", "y1", "x2", "y2").agg(F.count("*").alias("n"))
    return once.groupBy("doc_id").agg((F.sum("n") - F.count("*")).alias("duplicates"))


@query("u06_first_of_boxes", sql("SELECT doc_id, min(word_idx) AS word_idx, x1, y1, x2, y2 FROM (SELECT doc_id, word_idx, x1 - x1 % 200 AS x1, y1, x2 - x2 % 200 AS x2, y2 FROM words) GROUP BY doc_id, x1, y1, x2, y2"))
def first_of_boxes(spark, d):
    """U-06: of equal boxes the first."""
    ws = M.words(table(spark, d, "documents")).select("doc_id", "word_idx", (F.col("x1") - F.col("x1") % 200).alias("x1"), "y1", (F.col("x2") - F.col("x2") % 200).alias("x2"), "y2")
    return ws.groupBy("doc_id", "x1", "y1", "x2", "y2").agg(F.min("word_idx").alias("word_idx"))


@query("a08_region_counts", sql("SELECT source, t AS region_type, count(r.region_type) AS n FROM (SELECT DISTINCT source FROM documents) s CROSS JOIN (SELECT unnest(['primary_text','commentary','footnote','introduction','running_header','total']) AS t) x LEFT JOIN (SELECT source AS rs, region_type FROM regions UNION ALL SELECT source, 'total' FROM regions) r ON r.rs = s.source AND r.region_type = x.t GROUP BY source, t"))
def region_counts(spark, d):
    """A-08: regions by type, zeros and a total included: the types are explicit columns, then melted."""
    r = M.regions(M.words(table(spark, d, "documents")))
    by = table(spark, d, "documents").select("source").distinct().join(r.groupBy("source").agg(*[F.count_if(F.col("region_type") == t).alias(t) for t in M.REGION_TYPES], F.count("*").alias("total")), "source", "left")
    return by.fillna(0).unpivot("source", [*M.REGION_TYPES, "total"], "region_type", "n")


@query("a10_a11_lines_rollup", sql("SELECT lang, source, sum(n) AS n_lines, count(DISTINCT doc_id) AS n_pages FROM (SELECT d.lang, l.source, l.doc_id, count(*)::BIGINT AS n FROM ln l JOIN documents d USING (doc_id) GROUP BY ALL) GROUP BY ROLLUP (lang, source)"))
def lines_rollup(spark, d):
    """A-10, A-11: lines and pages with subtotals and a grand total."""
    docs = table(spark, d, "documents").select("lang", "source", "doc_id", F.size(F.split("text", "\n")).cast("long").alias("n"))
    return docs.rollup("lang", "source").agg(F.sum("n").cast("decimal(38,0)").alias("n_lines"), F.count_distinct("doc_id").alias("n_pages"))


@query("a13_trimmed_mean", sql("SELECT doc_id, round(avg(w), 6) AS mean FROM (SELECT doc_id, x2 - x1 + 1 AS w, row_number() OVER (PARTITION BY doc_id ORDER BY x2 - x1, line_idx) AS k, count(*) OVER (PARTITION BY doc_id) AS n FROM lines) WHERE n < 5 OR (k > n // 5 AND k <= n - (n + 4) // 5) GROUP BY doc_id"))
def trimmed_mean(spark, d):
    """A-13: the mean without a fifth at either end, from five lines on."""
    ls = M.line_containers(M.words(table(spark, d, "documents"))).select("doc_id", "line_idx", (F.col("x2") - F.col("x1") + 1).alias("w"))
    page = Window.partitionBy("doc_id")
    ls = ls.withColumns({"k": F.row_number().over(page.orderBy("w", "line_idx")), "n": F.count("*").over(page)})
    return ls.filter(F.expr("n < 5 or (k > n div 5 and k <= n - (n + 4) div 5)")).groupBy("doc_id").agg(F.round(F.avg("w"), 6).alias("mean"))


#: Predicted regions: shifted by the region's number, every sixth missing.
PREDICTED = "pred AS (SELECT doc_id, region_idx, region_type AS label, x1 + 30 * (region_idx % 4) AS x1, y1 + 10 * (region_idx % 3) AS y1, x2 + 30 * (region_idx % 4) AS x2, y2 + 10 * (region_idx % 3) AS y2 FROM regions WHERE (doc_id + region_idx) % 6 <> 0)"
O = "greatest(least(a.x2, b.x2) + 1 - greatest(a.x1, b.x1), 0) * greatest(least(a.y2, b.y2) + 1 - greatest(a.y1, b.y1), 0)"
IOU = f"({O})::DOUBLE / ((a.x2 - a.x1 + 1) * (a.y2 - a.y1 + 1) + (b.x2 - b.x1 + 1) * (b.y2 - b.y1 + 1) - {O})"
BEST = f"pb AS (SELECT a.doc_id, a.region_idx, coalesce(max({IOU}), 0) AS best FROM pred a LEFT JOIN regions b USING (doc_id) GROUP BY a.doc_id, a.region_idx), gb AS (SELECT a.doc_id, a.region_idx, coalesce(max({IOU}), 0) AS best FROM regions a LEFT JOIN pred b USING (doc_id) GROUP BY a.doc_id, a.region_idx)"


def predicted(r):
    dx, dy = 30 * (F.col("region_idx") % 4), 10 * (F.col("region_idx") % 3)
    return r.filter("(doc_id + region_idx) % 6 <> 0").select("doc_id", "region_idx", F.col("region_type").alias("label"), (F.col("x1") + dx).alias("x1"), (F.col("y1") + dy).alias("y1"), (F.col("x2") + dx).alias("x2"), (F.col("y2") + dy).alias("y2"))


def best_of_both(spark, d):
    r = M.regions(M.words(table(spark, d, "documents")))
    p = predicted(r)
    return L.best_iou(p, r, ["region_idx"]), L.best_iou(r, p, ["region_idx"])


@query("j14_best_matches", sql(f", {PREDICTED}, {BEST} SELECT doc_id, region_idx, round(best, 6) AS best FROM pb"))
def best_matches(spark, d):
    """J-14: each predicted region's best IoU."""
    return best_of_both(spark, d)[0].select("doc_id", "region_idx", F.round("best", 6).alias("best"))


CONFUSION = f"{PREDICTED}, {BEST}, cf AS (SELECT doc_id, coalesce(tp, 0) AS tp, coalesce(fp, 0) AS fp, coalesce(fn, 0) AS fn FROM (SELECT doc_id, count(*) FILTER (best > 0.8) AS tp, count(*) FILTER (best <= 0.8) AS fp FROM pb GROUP BY doc_id) FULL JOIN (SELECT doc_id, count(*) FILTER (best < 0.8) AS fn FROM gb GROUP BY doc_id) USING (doc_id))"


@query("a14_confusion", sql(f", {CONFUSION} SELECT * FROM cf"))
def confusion(spark, d):
    """A-14: true and false positives and misses by page."""
    return L.confusion(*best_of_both(spark, d))


@query("a16_macro_scores", sql(f", {CONFUSION} SELECT round(avg(tp / nullif(tp + fp, 0)::DOUBLE), 6) AS precision, round(avg(tp / nullif(tp + fn, 0)::DOUBLE), 6) AS recall, round(avg(2 * tp / nullif(2 * tp + fp + fn, 0)::DOUBLE), 6) AS f1 FROM cf"))
def macro_scores(spark, d):
    """A-16: scores averaged over pages."""
    return L.macro_scores(L.confusion(*best_of_both(spark, d)))


@query("a15_mean_iou", sql(f", {PREDICTED}, {BEST} SELECT doc_id, round(sum(best) / max(greatest(n, m)), 6) AS mean_iou FROM pb JOIN (SELECT doc_id, count(*) AS n FROM pred GROUP BY doc_id) USING (doc_id) JOIN (SELECT doc_id, count(*) AS m FROM regions GROUP BY doc_id) USING (doc_id) GROUP BY doc_id"))
def mean_iou(spark, d):
    """A-15: the sum of best IoUs over the larger number of shapes."""
    p, g = best_of_both(spark, d)
    p = p.groupBy("doc_id").agg(F.sum("best").alias("s"), F.count("*").alias("n"))
    return p.join(g.groupBy("doc_id").agg(F.count("*").alias("m")), "doc_id").select("doc_id", F.round(F.col("s") / F.greatest("n", "m"), 6).alias("mean_iou"))


@query("a17_average_precision", sql(f"""
, {PREDICTED}, dets AS (SELECT doc_id * 100000 + region_idx AS id, doc_id, CASE WHEN region_idx % 5 = 4 THEN 'footnote' ELSE label END AS label, (doc_id * 31 + region_idx * 17) % 101 AS conf, x1, y1, x2, y2 FROM pred UNION ALL SELECT doc_id * 100000 + 50000 + region_idx, doc_id, region_type, (doc_id * 13 + region_idx * 7) % 101, x1 + 2, y1 + 2, x2 + 2, y2 + 2 FROM regions WHERE region_idx % 2 = 0),
ranked AS (SELECT a.id, a.doc_id, a.label, a.conf, b.region_idx AS truth, {IOU} AS o, row_number() OVER (PARTITION BY a.id ORDER BY {IOU} DESC, b.region_idx) AS k FROM dets a JOIN regions b ON a.doc_id = b.doc_id AND a.label = b.region_type),
turns AS (SELECT id, row_number() OVER (PARTITION BY doc_id, label, truth ORDER BY conf DESC, id) AS turn FROM ranked WHERE k = 1 AND o > 0.5),
h AS (SELECT label, conf, id, CASE WHEN turn = 1 THEN 1 ELSE 0 END AS hit FROM dets LEFT JOIN turns USING (id)), n AS (SELECT region_type AS label, count(*) AS n_gt FROM regions GROUP BY ALL),
c AS (SELECT label, hit, conf, id, n_gt, sum(hit) OVER w::DOUBLE / count(*) OVER w AS prec FROM h JOIN n USING (label) WINDOW w AS (PARTITION BY label ORDER BY conf DESC, id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
v AS (SELECT *, max(prec) OVER (PARTITION BY label ORDER BY conf DESC, id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS env FROM c)
SELECT label, round(sum(hit * env / n_gt), 6) AS ap, count(*) AS n_pred, max(n_gt) AS n_gt, sum(hit)::BIGINT AS tp, round(avg(hit), 6) AS precision, round(sum(hit) / max(n_gt), 6) AS recall FROM v GROUP BY label"""))
def average_precision(spark, d):
    """A-17: average precision by label, of shaken regions (some under a wrong label) and second finds of some."""
    # read three times: regions are few beside the words that they are made of, which so are made once
    r = M.regions(M.words(table(spark, d, "documents"))).localCheckpoint()
    n, id_ = F.col("region_idx"), F.col("doc_id") * 100000 + F.col("region_idx")

    def shape(id_, label, conf, dx, dy):
        box = [(F.col(c) + by).cast("long").alias(c) for c, by in zip(L.BOX, (dx, dy, dx, dy))]
        return F.struct(id_.alias("id"), label.alias("label"), conf.alias("conf"), *box)

    first = F.when((F.col("doc_id") + n) % 6 != 0, shape(id_, F.when(n % 5 == 4, "footnote").otherwise(F.col("region_type")), (F.col("doc_id") * 31 + n * 17) % 101, 30 * (n % 4), 10 * (n % 3)))
    second = F.when(n % 2 == 0, shape(id_ + 50000, F.col("region_type"), (F.col("doc_id") * 13 + n * 7) % 101, F.lit(2), F.lit(2)))
    found = r.select("doc_id", F.explode(F.array_compact(F.array(first, second))).alias("s")).select("doc_id", "s.*")
    truths = r.select("doc_id", F.col("region_type").alias("label"), F.col("region_idx").alias("n"), *L.BOX)
    return L.average_precision(L.first_hits(found, truths), truths.groupBy("label").agg(F.count("*").alias("n_gt")))


@query("w04_reading_order")
def reading_order(spark, d):
    """W-04: words of a page, shaken vertically, in reading order."""
    ws = M.words(table(spark, d, "documents"))
    return L.reading_order(ws.select("doc_id", F.col("word_idx").alias("n"), "x1", (F.col("y1") + F.col("word_idx") % 9).alias("y1"), "x2", (F.col("y2") + F.col("word_idx") % 9).alias("y2")))


@query("u05_prune_duplicates")
def pruned(spark, d):
    """U-05: regions and their shifted copies, near copies of a kept one dropped in order."""
    r = M.regions(M.words(table(spark, d, "documents")))
    copies = predicted(r).select("doc_id", (F.col("region_idx") + 1000).alias("n"), "label", "x1", "y1", "x2", "y2")
    return L.prune_duplicates(r.select("doc_id", F.col("region_idx").alias("n"), F.col("region_type").alias("label"), "x1", "y1", "x2", "y2").unionByName(copies))


@query("j15_merged_lines")
def merged_lines(spark, d):
    """J-15: the lines of two detectors merged."""
    ls = M.line_containers(M.words(table(spark, d, "documents"))).select("doc_id", F.col("line_idx").alias("n"), "x1", "y1", "x2", "y2")
    second = ls.filter("n % 5 <> 0").select("doc_id", "n", (F.col("x1") + 3).alias("x1"), "y1", (F.col("x2") - 20).alias("x2"), (F.col("y2") + 2).alias("y2"))
    return L.combine_lines(ls.withColumn("side", F.lit("first")).unionByName(second.withColumn("side", F.lit("second"))))


@query("u07_overlapping_regions", sql("SELECT a.doc_id, a.region_idx, b.region_idx AS other FROM regions a JOIN (SELECT doc_id, region_idx, x1, y1 - 100 AS y1, x2, y2 FROM regions) b ON a.doc_id = b.doc_id AND a.region_idx < b.region_idx WHERE " + O + " > 0.4 * least((a.x2 - a.x1 + 1) * (a.y2 - a.y1 + 1), (b.x2 - b.x1 + 1) * (b.y2 - b.y1 + 1))"))
def overlapping_regions(spark, d):
    """U-07: regions that overlap by more than 0.4 of the smaller."""
    r = M.regions(M.words(table(spark, d, "documents")))
    o = r.select(F.col("doc_id").alias("o_doc"), F.col("region_idx").alias("other"), F.col("x1").alias("o_x1"), (F.col("y1") - 100).alias("o_y1"), F.col("x2").alias("o_x2"), F.col("y2").alias("o_y2"))
    a, b = G.box(), G.box("o_")
    pairs = r.join(o, (F.col("doc_id") == F.col("o_doc")) & (F.col("region_idx") < F.col("other")))
    return pairs.filter(a.overlap_area(b) > 0.4 * F.least(a.area, b.area)).select("doc_id", "region_idx", "other")


@query("u07_label_typos", sql("SELECT label, count(*) AS n FROM (SELECT CASE WHEN region_idx % 7 = 0 THEN replace(region_type, 'o', '0') ELSE region_type END AS label FROM regions) WHERE label NOT IN ('primary_text','commentary','footnote','introduction','running_header') GROUP BY label"))
def label_typos(spark, d):
    """U-07: labels outside the known types."""
    r = M.regions(M.words(table(spark, d, "documents")))
    r = r.select(F.when(F.col("region_idx") % 7 == 0, F.replace("region_type", F.lit("o"), F.lit("0"))).otherwise(F.col("region_type")).alias("label"))
    return r.filter(~F.col("label").isin(*M.REGION_TYPES)).groupBy("label").agg(F.count("*").alias("n"))


@query("u01_sheet_conformity", sql(", v AS (SELECT doc_id, bool_or(region_type NOT IN ('commentary', 'introduction')) AS is_full, bool_and(region_type IN ('commentary', 'introduction')) AND bool_or(region_type = 'commentary') AS comm_only FROM regions GROUP BY doc_id), s AS (SELECT doc_id FROM labels WHERE quality = 1) SELECT 'page only' AS side, doc_id FROM (SELECT doc_id FROM v WHERE is_full EXCEPT SELECT doc_id FROM s) UNION ALL SELECT 'sheet only', doc_id FROM (SELECT doc_id FROM s EXCEPT SELECT doc_id FROM v WHERE is_full)"))
def sheet_conformity(spark, d):
    """U-01, F-33: pages fully labelled against a sheet's list, both set differences."""
    r = M.regions(M.words(table(spark, d, "documents")))
    full = r.groupBy("doc_id").agg(F.bool_or(~F.col("region_type").isin("commentary", "introduction")).alias("f")).filter("f").select("doc_id")
    sheet = table(spark, d, "labels").filter("quality = 1").select("doc_id")
    return full.subtract(sheet).select(F.lit("page only").alias("side"), "doc_id").union(sheet.subtract(full).select(F.lit("sheet only"), "doc_id"))


@query("w07_section_gaps", sql("SELECT source, section_idx, CASE WHEN s <= prev THEN 'overlap' WHEN s > prev + 1 THEN 'gap' END AS problem FROM (SELECT source, section_idx, s, lag(e) OVER (PARTITION BY source ORDER BY section_idx) AS prev FROM (SELECT source, section_idx, start_page + section_idx % 3 - 1 AS s, end_page AS e FROM sections)) WHERE s <= prev OR s > prev + 1"))
def section_gaps(spark, d):
    """W-07: sections that overlap the one before or leave a gap."""
    s = M.sections(M.pages(table(spark, d, "documents"))).select("source", "section_idx", (F.col("start_page") + F.col("section_idx") % 3 - 1).alias("s"), F.col("end_page").alias("e"))
    s = s.withColumn("prev", F.lag("e").over(Window.partitionBy("source").orderBy("section_idx")))
    return s.select("source", "section_idx", F.when(F.col("s") <= F.col("prev"), "overlap").when(F.col("s") > F.col("prev") + 1, "gap").alias("problem")).filter("problem is not null")


@query("j20_partial_gt_pages", sql("SELECT r.doc_id, r.region_idx, coalesce(CASE WHEN r.region_idx % 2 = 0 THEN r.x1 END, p.x1, r.x1) AS x1 FROM regions r LEFT JOIN (SELECT a.doc_id, a.region_idx, arg_min(b.x1, b.region_idx) AS x1 FROM regions a JOIN (SELECT doc_id, region_idx, x1 + 2 AS x1, y1, x2 + 2 AS x2, y2 FROM regions) b USING (doc_id) WHERE " + IOU + " >= 0.85 GROUP BY a.doc_id, a.region_idx) p USING (doc_id, region_idx)"))
def partial_gt_pages(spark, d):
    """J-20: a region that is ground truth as it is, else the first of the reading's that is nearly the same, else as it is."""
    r = M.regions(M.words(table(spark, d, "documents"))).select("doc_id", "region_idx", "x1", "y1", "x2", "y2")
    o = r.select(F.col("doc_id").alias("o_doc"), F.col("region_idx").alias("o_idx"), (F.col("x1") + 2).alias("o_x1"), F.col("y1").alias("o_y1"), (F.col("x2") + 2).alias("o_x2"), F.col("y2").alias("o_y2"))
    near = r.join(o, (F.col("doc_id") == F.col("o_doc")) & (G.box().iou(G.box("o_")) >= 0.85)).groupBy("doc_id", "region_idx").agg(F.min_by("o_x1", "o_idx").alias("p_x1"))
    return r.join(near, ["doc_id", "region_idx"], "left").select("doc_id", "region_idx", F.coalesce(F.when(F.col("region_idx") % 2 == 0, F.col("x1")), "p_x1", "x1").alias("x1"))


@query("w06_label_run_regions", sql(", o AS (SELECT *, CASE WHEN lab IS DISTINCT FROM lag(lab) OVER w OR lag(y1) OVER w - y1 > 50 THEN 1 ELSE 0 END AS opens FROM (SELECT doc_id, pos, x1, y1, x2, y2, (pos // 13) % 3 AS lab FROM words) WINDOW w AS (PARTITION BY doc_id ORDER BY pos)), g AS (SELECT *, sum(opens) OVER (PARTITION BY doc_id ORDER BY pos) AS run FROM o), b AS (SELECT doc_id, run, any_value(lab) AS lab, min(x1) AS x1, min(y1) AS y1, max(x2) AS x2, max(y2) AS y2 FROM g GROUP BY doc_id, run) SELECT doc_id, run::BIGINT AS run, lab, x1, y1, x2, y2 FROM b a WHERE NOT EXISTS (SELECT 1 FROM b WHERE b.doc_id = a.doc_id AND b.run <> a.run AND a.x1 >= b.x1 AND a.y1 >= b.y1 AND a.x2 <= b.x2 AND a.y2 <= b.y2)"))
def label_run_regions(spark, d):
    """W-06: regions from runs of one label, without those inside another."""
    ws = M.words(table(spark, d, "documents")).withColumn("lab", F.expr("(pos div 13) % 3"))
    order = Window.partitionBy("doc_id").orderBy("pos")
    opens = ~F.col("lab").eqNullSafe(F.lag("lab").over(order)) | F.coalesce(F.lag("y1").over(order) - F.col("y1") > 50, F.lit(False))
    ws = C.islands(ws.withColumn("__o", opens), ["doc_id"], "pos", F.col("__o"), "run")
    b = ws.groupBy("doc_id", "run").agg(F.first("lab").alias("lab"), *G.bounding())
    o = b.select(F.col("doc_id").alias("o_doc"), F.col("run").alias("o_run"), *[F.col(c).alias("o_" + c) for c in ("x1", "y1", "x2", "y2")])
    return b.join(o, (F.col("doc_id") == F.col("o_doc")) & (F.col("run") != F.col("o_run")) & G.box().inside(G.box("o_")), "left_anti")
