"""Canonical JSON, annotation projects, sections, stand-off annotations."""

from __future__ import annotations

import xml.etree.ElementTree as ET
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.schemas import CANONICAL, KINDS, SECTIONS, VIA_PROJECT


def read_canonical(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(CANONICAL).option("multiLine", True).json(path)


def canonical_words(canonical: DataFrame) -> DataFrame:
    """commentary_id, word_idx, text and box; boxes as pairs of points or as four numbers."""
    w = canonical.select(F.col("id").alias("commentary_id"), F.posexplode("children.words").alias("word_idx", "w"))
    box = F.transform(F.regexp_extract_all("w.bbox", F.lit(r"-?\d+"), F.lit(0)), lambda x: x.cast("int"))
    return w.select("commentary_id", "word_idx", "w.text", *[F.get(box, F.lit(i)).alias(c) for i, c in enumerate(("x1", "y1", "x2", "y2"))])


def canonical_containers(canonical: DataFrame, kind: str) -> DataFrame:
    """commentary_id, tc_type, tc_idx, w_start, w_end and the kind's own columns; a missing kind has no rows."""
    if kind not in KINDS:
        raise ValueError(kind)
    rows = canonical.select(F.col("id").alias("commentary_id"), F.posexplode(f"children.{kind}").alias("tc_idx", "c"))
    own = [F.col(f"c.{c}").alias(c) for c in ("id", "region_type", "is_ocr_gt", "section_types", "section_title", "label", "transcript", "wikidata_id", "anchor_target", "shifts")]
    return rows.select("commentary_id", F.lit(kind).alias("tc_type"), "tc_idx", F.get("c.word_range", F.lit(0)).alias("w_start"), F.get("c.word_range", F.lit(1)).alias("w_end"), *own)


def read_via(spark: SparkSession, path: str) -> DataFrame:
    """page_id, region_seq, label, box and ground-truth flags of an annotation project's shapes."""
    project = spark.read.schema(VIA_PROJECT).option("multiLine", True).json(path)
    pages = project.select(F.explode("_via_img_metadata").alias("k", "p")).select(F.regexp_replace("p.filename", r"\.[^.]*$", "").alias("page_id"), "p.regions", F.coalesce("p.file_attributes.is_ground_truth.ocr", F.lit(False)).alias("ocr_gt"), F.coalesce("p.file_attributes.is_ground_truth.olr", F.lit(False)).alias("olr_gt"))
    rows = pages.select("page_id", "ocr_gt", "olr_gt", F.posexplode("regions").alias("region_seq", "r"))
    s = "r.shape_attributes."
    return rows.select("page_id", "region_seq", F.regexp_replace("r.region_attributes.label", r"\s", "").alias("label"), F.col(s + "x").alias("x1"), F.col(s + "y").alias("y1"), (F.col(s + "x") + F.col(s + "width")).alias("x2"), (F.col(s + "y") + F.col(s + "height")).alias("y2"), "ocr_gt", "olr_gt")


def read_sections(spark: SparkSession, path: str) -> DataFrame:
    """section_idx, section_types, section_title, start and end as page numbers."""
    rows = spark.read.text(path, wholetext=True).select(F.posexplode(F.from_json("value", SECTIONS)).alias("section_idx", "s"))
    return rows.select("section_idx", "s.section_types", "s.section_title", F.col("s.start").try_cast("int").alias("start"), F.col("s.end").try_cast("int").alias("end"))


def xmi_annotations(xmi: str, layers: dict[str, str]) -> list[tuple]:
    """(layer, begin, end, value, attributes) of the asked layers; layers: element name to the attribute that is the value."""
    out = []
    for e in ET.fromstring(xmi.encode()).iter():
        name = e.tag.rsplit("}", 1)[-1]
        if name in layers and e.get("begin") is not None:
            out.append((name, int(e.get("begin")), int(e.get("end")), e.get(layers[name]), dict(e.attrib)))
    return out


def read_xmi(spark: SparkSession, path: str, layers: dict[str, str]) -> DataFrame:
    """page_id, layer, ann_seq, begin, end, value, attrs; files that can't be parsed give no rows."""
    files = spark.read.option("pathGlobFilter", "*.xmi").text(path, wholetext=True).select(F.regexp_extract(F.input_file_name(), r"([^/]+)\.xmi$", 1).alias("page_id"), "value")

    def parsed(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for page_id, xmi in zip(frame["page_id"], frame["value"]):
                try:
                    found = xmi_annotations(xmi, layers)
                except ET.ParseError:
                    continue
                out += [(page_id, layer, i, b, e, v, a) for i, (layer, b, e, v, a) in enumerate(found)]
            yield pd.DataFrame(out, columns=["page_id", "layer", "ann_seq", "begin", "end", "value", "attrs"])

    return files.mapInPandas(parsed, "page_id string, layer string, ann_seq int, begin int, end int, value string, attrs map<string,string>")
