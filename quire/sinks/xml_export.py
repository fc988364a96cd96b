"""XML exports, as strings built in order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.sinks.json_export import ordered


def escaped(text: Column, quotes: bool = False) -> Column:
    for sign, name in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), *((('"', "&quot;"),) if quotes else ())):
        text = F.replace(text, F.lit(sign), F.lit(name))
    return text


def alto_text_lines(words: DataFrame) -> DataFrame:
    """doc_id, line_idx, xml."""
    string = F.concat(F.lit('<String CONTENT="'), escaped(F.col("text"), quotes=True), F.lit('" HPOS="'), "x1", F.lit('"/>'))
    g = words.groupBy("doc_id", "line_idx").agg(F.min("x1").alias("x"), F.min("y1").alias("y"), F.array_join(ordered("pos", string), "").alias("strings"))
    return g.select("doc_id", "line_idx", F.concat(F.lit('<TextLine HPOS="'), "x", F.lit('" VPOS="'), "y", F.lit('">'), "strings", F.lit("</TextLine>")).alias("xml"))


def alto_pages(words: DataFrame) -> DataFrame:
    """doc_id, xml: whole ALTO files, a text block to a region; words have region_idx and region_type."""
    lines = alto_text_lines(words).join(words.select("doc_id", "line_idx", "region_idx", "region_type").distinct(), ["doc_id", "line_idx"])
    blocks = lines.groupBy("doc_id", "region_idx", "region_type").agg(F.array_join(ordered("line_idx", F.col("xml")), "").alias("t"))
    blocks = blocks.withColumn("block", F.concat(F.lit('<TextBlock ID="b'), "region_idx", F.lit('" TAGREFS="'), "region_type", F.lit('">'), "t", F.lit("</TextBlock>")))
    pages = blocks.groupBy("doc_id").agg(F.array_join(ordered("region_idx", F.col("block")), "").alias("b"), F.array_join(F.transform(F.array_sort(F.collect_set("region_type")), lambda t: F.concat(F.lit('<OtherTag ID="'), t, F.lit('"/>'))), "").alias("tags"))
    head = '<?xml version="1.0" encoding="UTF-8"?><alto xmlns="http://www.loc.gov/standards/alto/ns-v4#"><Tags>'
    return pages.select("doc_id", F.concat(F.lit(head), "tags", F.lit("</Tags><Layout><Page><PrintSpace>"), "b", F.lit("</PrintSpace></Page></Layout></alto>")).alias("xml"))


def tei_divisions(words: DataFrame) -> DataFrame:
    """doc_id, xml: a division of lines for each page."""
    lines = words.groupBy("doc_id", "line_idx").agg(F.array_join(ordered("pos", escaped(F.col("text"))), " ").alias("t"))
    line = F.concat(F.lit('<l n="'), "line_idx", F.lit('">'), "t", F.lit("</l>"))
    pages = lines.groupBy("doc_id").agg(F.array_join(ordered("line_idx", line), "").alias("t"))
    return pages.select("doc_id", F.concat(F.lit('<div n="'), "doc_id", F.lit('">'), "t", F.lit("</div>")).alias("xml"))


def xmi_pages(words: DataFrame, layer: str = "custom") -> DataFrame:
    """doc_id, xml: text, tokens and a sentence for each line, with offsets into the text of all words joined by spaces."""
    from pyspark.sql import Window

    before = Window.partitionBy("doc_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    ws = words.withColumn("b", F.coalesce(F.sum(F.char_length("text") + 1).over(before), F.lit(0)).cast("long")).withColumn("e", F.col("b") + F.char_length("text"))
    token = F.concat(F.lit('<type:Token begin="'), "b", F.lit('" end="'), "e", F.lit('"/>'))
    lines = ws.groupBy("doc_id", "line_idx").agg(F.min("b").alias("b"), F.max("e").alias("e"))
    sentence = F.concat(F.lit('<type:Sentence begin="'), "b", F.lit('" end="'), "e", F.lit('"/>'))
    pages = ws.groupBy("doc_id").agg(F.array_join(ordered("pos", F.col("text")), " ").alias("t"), F.array_join(ordered("pos", token), "").alias("tokens"))
    pages = pages.join(lines.groupBy("doc_id").agg(F.array_join(ordered("line_idx", sentence), "").alias("sentences")), "doc_id")
    head = f'<xmi:XMI xmlns:xmi="http://www.omg.org/XMI" xmlns:cas="http:///uima/cas.ecore" xmlns:type="http:///{layer}/type.ecore">'
    return pages.select("doc_id", F.concat(F.lit(head), F.lit('<cas:Sofa sofaString="'), escaped(F.col("t"), quotes=True), F.lit('"/>'), "sentences", "tokens", F.lit("</xmi:XMI>")).alias("xml"))
