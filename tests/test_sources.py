"""Readers, writers and streams on small hand-made files."""

import gzip
import json

from pyspark.sql import functions as F

from quire.operators import cleaning as K
from quire.sinks import json_export, tables, xml_export
from quire.sources import corpora, ocr, projects
from quire.streaming import incremental

HOCR = """<html><body><div class='ocr_page'><span class='{line}' title='bbox 0 0 90 20'><span class='{word}' title='bbox 1 2 30 18; x_wconf 9'>Ἀθη</span> <span class='{word}' title='bbox 40 2 60 18'> <b>ab</b></span></span>
<span class='ocr_header' title='bbox 0 30 90 50'><span class='{word}' title='bbox 1 32 30 48'>c&amp;d</span><span class='{word}' title='bbox 31 32 32 48'> </span></span></div></body></html>"""
PAGE = """<PcGts xmlns="http://schema.primaresearch.org/PAGE/gts/pagecontent/2019-07-15"><Page><TextRegion><TextLine><Word><Coords points="1,2 30,2 30,18 1,18"/><TextEquiv><Unicode>Ἀθη</Unicode></TextEquiv></Word>
<Word><Coords points="40,2 60,18"/><TextEquiv><Unicode>ab</Unicode></TextEquiv></Word></TextLine><TextLine><Word><Coords points="1,32 30,48"/><TextEquiv><Unicode>c&amp;d</Unicode></TextEquiv></Word></TextLine></TextRegion></Page></PcGts>"""
JSON = [{"words": [{"text": "Ἀθη", "xyxy": [1, 2, 30, 18]}, {"text": "ab", "xyxy": [40, 2, 60, 18]}]}, {"words": [{"text": "c&d", "xyxy": [1, 32, 30, 48]}]}]
WANT = {("p_0001", 0, "Ἀθη", 1, 2, 30, 18), ("p_0001", 0, "ab", 40, 2, 60, 18), ("p_0001", 1, "c&d", 1, 32, 30, 48)}


def test_ocr_formats_agree(spark, tmp_path):
    for suffix, content in ((".hocr", HOCR.format(line="ocr_line", word="ocrx_word")), (".html", HOCR.format(line="ocrx_line", word="ocr_word")), (".xml", PAGE), (".json", json.dumps(JSON))):
        (tmp_path / f"p_0001{suffix}").write_text(content)
        rows = ocr.read_ocr(spark, str(tmp_path), suffix).collect()
        assert {(r["page_id"], r["line_idx"], r["text"], r["x1"], r["y1"], r["x2"], r["y2"]) for r in rows} == WANT, suffix


def test_canonical(spark, tmp_path):
    words = spark.createDataFrame([("s", i, t, 10 * i, 0, 10 * i + 9, 9) for i, t in enumerate(("a", "b", "c"))], "source string, word_idx int, text string, x1 int, y1 int, x2 int, y2 int")
    lines = spark.createDataFrame([("s", 0, 0, 1), ("s", 1, 2, 2)], "source string, idx int, w_start int, w_end int")
    regions = spark.createDataFrame([("s", 0, 0, 2, "commentary")], "source string, idx int, w_start int, w_end int, region_type string")
    text = json_export.canonical(words, {"lines": lines, "regions": regions}).first()["json"]
    (tmp_path / "c.json").write_text(text)
    c = projects.read_canonical(spark, str(tmp_path / "c.json"))
    assert [(r["word_idx"], r["text"], r["x1"], r["y2"]) for r in projects.canonical_words(c).orderBy("word_idx").collect()] == [(0, "a", 0, 9), (1, "b", 10, 9), (2, "c", 20, 9)]
    assert [(r["w_start"], r["w_end"]) for r in projects.canonical_containers(c, "lines").orderBy("tc_idx").collect()] == [(0, 1), (2, 2)]
    assert projects.canonical_containers(c, "regions").first()["region_type"] == "commentary"
    assert projects.canonical_containers(c, "lemmas").count() == 0


def test_projects(spark, tmp_path):
    shape = lambda label, *b: {"shape_attributes": dict(zip(("name", "x", "y", "width", "height"), ("rect", *b))), "region_attributes": {"label": label}}
    via = {"_via_img_metadata": {"p1.png-1": {"filename": "p1.png", "size": 1, "regions": [shape("_OLR_ commentary", 1, 2, 3, 4), shape("word", 0, 0, 9, 9)], "file_attributes": {"is_ground_truth": {"ocr": True}}}}}
    (tmp_path / "via.json").write_text(json.dumps(via))
    rows = projects.read_via(spark, str(tmp_path / "via.json")).orderBy("region_seq").collect()
    assert [(r["page_id"], r["label"], r["x2"], r["y2"], r["ocr_gt"], r["olr_gt"]) for r in rows] == [("p1", "_OLR_commentary", 4, 6, True, False), ("p1", "word", 9, 9, True, False)]
    (tmp_path / "sections.json").write_text(json.dumps([{"section_types": ["preface"], "section_title": "t", "start": "3", "end": 9}]))
    assert tuple(projects.read_sections(spark, str(tmp_path / "sections.json")).first()) == (0, ["preface"], "t", 3, 9)
    (tmp_path / "x").mkdir()
    (tmp_path / "x" / "p9.xmi").write_text('<a xmlns:t="http://t"><t:Entity begin="3" end="8" value="PERS"/><t:Other begin="1" end="2"/></a>')
    (tmp_path / "x" / "bad.xmi").write_text("<a>")
    assert [tuple(r)[:6] for r in projects.read_xmi(spark, str(tmp_path / "x"), {"Entity": "value"}).collect()] == [("p9", "Entity", 0, 3, 8, "PERS")]


def test_corpora(spark, tmp_path):
    (tmp_path / "t.tsv").write_text("TOKEN\tNE\n# hipe2022:document_id = d1\nAjax\tB-pers\ngoes\tO\n# hipe2022:document_id = d2\nHe\tO\n")
    rows = corpora.hipe_tokens(spark, str(tmp_path / "t.tsv")).orderBy("n").collect()
    assert [(r["document_id"], r["n"], r["TOKEN"], r["NE"]) for r in rows] == [("d1", 0, "Ajax", "B-pers"), ("d1", 1, "goes", "O"), ("d2", 2, "He", "O")]
    (tmp_path / "l.tsv").write_text('a"\tB-note\t\t\t\t\tx\nb\tB-work\t\t\t\t\tx\n')
    assert [(r["n"], r["TOKEN"], r["LABEL"]) for r in corpora.lemlink_tokens(spark, str(tmp_path / "l.tsv")).orderBy("n").collect()] == [(0, 'a"', "O"), (1, "b", "B-work")]
    for side, text in (("gt", "abc"), ("ocr", "abd")):
        (tmp_path / side).mkdir()
        (tmp_path / side / "l1.txt").write_text(text)
    assert tuple(corpora.line_pairs(spark, str(tmp_path / "gt"), str(tmp_path / "ocr")).first()) == ("l1", "abc", "abd")
    with gzip.open(tmp_path / "j.jsonl.gz", "wt") as f:
        f.write(json.dumps({"id": "a", "fullText": ["p0", "p1"]}) + "\n")
    assert [tuple(r) for r in corpora.json_pages(spark, str(tmp_path / "j.jsonl.gz")).collect()] == [("a", 0, "p0"), ("a", 1, "p1")]
    (tmp_path / "y.txt").write_text("2 0.5 0.5 0.2 0.1 0.9\n")
    assert tuple(corpora.yolo_boxes(spark, str(tmp_path / "y.txt"), 100, 200).first()) == ("y", 2, 0.9, 40, 90, 60, 110)
    (tmp_path / "tei").mkdir()
    (tmp_path / "tei" / "a.xml").write_text("<TEI><teiHeader>no</teiHeader><text><p>one &amp; <hi>two</hi></p></text></TEI>")
    (tmp_path / "tei" / "_b.xml").write_text("<TEI><text>no</text></TEI>")
    assert [tuple(r) for r in corpora.tei_texts(spark, str(tmp_path / "tei")).collect()] == [("a", "one & two")]
    for i, o in enumerate(({"a": "x", "b": "y."}, {"a": "z"})):
        (tmp_path / f"lex{i}.json").write_text(json.dumps(o))
    assert {tuple(r) for r in corpora.lexicon(spark, [str(tmp_path / f"lex{i}.json") for i in (0, 1)]).collect()} == {("a", "z."), ("b", "y.")}
    (tmp_path / "oai.xml").write_text("<r><record><header/><metadata><dc:title>A</dc:title><dc:title>B</dc:title></metadata></record><record><header/></record></r>")
    assert [tuple(r) for r in corpora.oai_records(spark, str(tmp_path / "oai.xml"), ("title", "date")).collect()] == [(["A", "B"], [])]
    parts = corpora.corpus_parts(spark.createDataFrame([("n", "a\nb\n\nc\n\n\nd")], "name string, text string")).collect()
    assert [tuple(r) for r in parts] == [("n", 0, 0, 0, "a"), ("n", 0, 0, 1, "b"), ("n", 0, 1, 0, "c"), ("n", 1, 0, 0, "d")]
    assert corpora.beta_texts(spark.createDataFrame([("n", "mh=nin"), ("m", "μῆνιν")], "name string, text string")).select(F.collect_list("text")).first()[0] == ["μῆνιν", "μῆνιν"]


def test_exports(spark):
    w = spark.createDataFrame([(1, 0, 0, 0, "a<", 0, 0, 9, 9), (1, 0, 1, 1, "b", 10, 0, 19, 9)], "doc_id long, line_idx int, pos int, word_idx int, text string, x1 int, y1 int, x2 int, y2 int")
    assert "<type:Token begin=\"0\" end=\"2\"/>" in xml_export.xmi_pages(w).first()["xml"]
    page = w.withColumns({"region_idx": F.lit(0), "region_type": F.lit("commentary")})
    assert 'CONTENT="a&lt;"' in xml_export.alto_pages(page).first()["xml"]
    one = page.limit(1).select("doc_id", "region_idx", "line_idx", "region_type", "x1", "y1", "x2", "y2")
    out = json.loads(json_export.nested_pages(page, one, one).first()["json"])
    assert out["regions"][0]["lines"][0]["words"][1] == {"bbox": [10, 0, 10, 10], "text": "b"}
    via = json.loads(json_export.via_project(json_export.via_shapes(w, one, one)).first()["json"])
    assert [r["region_attributes"]["label"] for r in via["regions"]] == ["a<", "b", "_OLR_line_region", "_OLR_commentary"]
    sized = one.withColumns({"page_width": F.lit(100), "page_height": F.lit(100)})
    assert tables.yolo_lines(sized, ("commentary",)).first()["line"].startswith("0 0.045")


def test_cleaning(spark):
    assert K.without_headers(["HEAD 12 one two", "HEAD 13 three four", "own page"]) == {0: "one two", 1: "three four", 2: "own page"}
    assert K.without_headers(["", "a b x", "c d", "a b y", "c e", "12"]) == {1: "x", 2: "d", 3: "y", 4: "e"}  # empty pages out, one word a round
    assert K.without_headers(["a", "a b c", "d a"]) == {0: "a", 1: "b c", 2: "d"}  # no page loses its last word
    words = spark.createDataFrame([("Ajbx,",), ("AJBX",), ("zzzzz",), ("ajax",)], "word string")
    out = K.correct_words(words, spark.createDataFrame([("ajax",), ("troy",)], "entry string")).collect()
    assert {(r["word"], r["corrected"]) for r in out} == {("Ajbx,", "Ajax,"), ("AJBX", "AJAX"), ("zzzzz", "zzzzz"), ("ajax", "ajax")}


def test_streams(spark, tmp_path):
    src, out, check = (str(tmp_path / n) for n in ("src", "out", "check"))
    spark.range(5).write.parquet(src)
    run = lambda: incremental.new_files(spark, src, "id long", lambda d: d.withColumn("x", F.col("id") * 2), out, check).awaitTermination()
    run()
    spark.range(5, 8).write.mode("append").parquet(src)
    run()
    assert sorted(r["x"] for r in spark.read.parquet(out).collect()) == [0, 2, 4, 6, 8, 10, 12, 14]
    ev = spark.createDataFrame([(1, "2024-01-01 01:00:00", "a"), (1, "2024-01-01 01:00:00", "a"), (2, "2024-01-01 02:00:00", "a")], "event_id long, t string, event_type string").select("event_id", F.to_timestamp("t").alias("ts"), "event_type")
    ev.write.parquet(str(tmp_path / "ev"))
    stream = incremental.event_counts(spark.readStream.schema(ev.schema).parquet(str(tmp_path / "ev")))
    q = stream.writeStream.format("memory").queryName("counted").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    assert [(r["event_type"], r["n"]) for r in spark.table("counted").collect()] == [("a", 2)]
    new = spark.createDataFrame([("a", "1"), ("b", "2")], "commentary_id string, source_version string")
    assert [r["commentary_id"] for r in incremental.changed(new, new.filter("commentary_id = 'a'")).collect()] == ["b"]
