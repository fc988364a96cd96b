"""Nested JSON exports."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.functions.geometry import box


def ordered(by: str, value: Column) -> Column:
    """Aggregate: the values in order."""
    return F.transform(F.array_sort(F.collect_list(F.struct(F.col(by).alias("__o"), value.alias("__v")))), lambda x: x["__v"])


def xywh() -> Column:
    b = box()
    return F.array(b.x1, b.y1, b.width, b.height)


def page_regions(regions: DataFrame, page: str = "doc_id") -> DataFrame:
    """page, its regions as JSON."""
    region = F.struct("region_type", xywh().alias("bbox"))
    return regions.groupBy(page).agg(F.to_json(F.struct(F.first(page).alias("id"), ordered("region_idx", region).alias("regions"))).alias("page"))


def nested_pages(words: DataFrame, lines: DataFrame, regions: DataFrame, page: str = "doc_id", iiif: str = "", cdate: Column | None = None) -> DataFrame:
    """page, json: regions of lines of words, boxes as x, y, width, height. words have region_idx and line_idx."""
    w = words.groupBy(page, "region_idx", "line_idx").agg(ordered("word_idx", F.struct(xywh().alias("bbox"), "text")).alias("words"))
    ls = lines.join(w, [page, "region_idx", "line_idx"]).groupBy(page, "region_idx").agg(ordered("line_idx", F.struct(xywh().alias("bbox"), "words")).alias("lines"))
    rs = regions.join(ls, [page, "region_idx"]).groupBy(page).agg(ordered("region_idx", F.struct("region_type", xywh().alias("bbox"), "lines")).alias("regions"))
    stamp = F.date_format(F.current_timestamp() if cdate is None else cdate, "yyyy-MM-dd HH:mm:ss")
    return rs.select(page, F.to_json(F.struct(F.col(page).cast("string").alias("id"), F.lit(iiif).alias("iiif"), stamp.alias("cdate"), "regions")).alias("json"))


def canonical(words: DataFrame, containers: dict[str, DataFrame], key: str = "source") -> DataFrame:
    """key, json: per collection the words and, for each kind of container, its intervals in order.

    Each kind has key, idx, w_start and w_end; other columns go along.
    """
    box_pairs = F.array(F.array("x1", "y1"), F.array("x2", "y2"))
    out = words.groupBy(key).agg(ordered("word_idx", F.struct("text", box_pairs.alias("bbox"))).alias("words"))
    for kind, rows in containers.items():
        extra = [c for c in rows.columns if c not in (key, "idx", "w_start", "w_end")]
        one = F.struct(*extra, F.array("w_start", "w_end").alias("word_range"))
        out = out.join(rows.groupBy(key).agg(ordered("idx", one).alias(kind)), key, "left")
    children = F.struct("words", *[F.coalesce(F.col(k), F.array().cast(out.schema[k].dataType)).alias(k) for k in containers])
    return out.select(key, F.to_json(F.struct(F.col(key).alias("id"), children.alias("children"))).alias("json"))


def via_shapes(words: DataFrame, lines: DataFrame, regions: DataFrame, excluded: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, part, n, label, x, y, width, height: words, then lines, then regions that are not excluded."""
    b = box()
    shape = [b.x1.alias("x"), b.y1.alias("y"), (b.x2 - b.x1).alias("width"), (b.y2 - b.y1).alias("height")]
    parts = [
        words.select("doc_id", F.lit(0).alias("part"), F.col("word_idx").alias("n"), F.col("text").alias("label"), *shape),
        lines.select("doc_id", F.lit(1).alias("part"), F.col("line_idx").alias("n"), F.lit("_OLR_line_region").alias("label"), *shape),
        regions.filter(~F.col("region_type").isin(*excluded)).select("doc_id", F.lit(2).alias("part"), F.col("region_idx").alias("n"), F.concat(F.lit("_OLR_"), "region_type").alias("label"), *shape),
    ]
    return reduce(DataFrame.unionByName, parts)


def via_project(shapes: DataFrame, page: str = "doc_id") -> DataFrame:
    """page, json: the regions array of one page of an annotation project."""
    region = F.struct(F.struct(F.lit("rect").alias("name"), "x", "y", "width", "height").alias("shape_attributes"), F.struct("label").alias("region_attributes"))
    rows = shapes.withColumn("__k", F.struct("part", "n"))
    return rows.groupBy(page).agg(F.to_json(F.struct(F.first(page).cast("string").alias("filename"), F.lit(-1).alias("size"), ordered("__k", region).alias("regions"))).alias("json"))
