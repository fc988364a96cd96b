"""Flat exports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def yolo_rows(shapes: DataFrame, classes: tuple[str, ...], label: str = "region_type") -> DataFrame:
    """shapes with page_width and page_height, as class number, centre and size in shares of the page."""
    w, h = F.col("page_width").cast("double"), F.col("page_height").cast("double")
    cls = F.array_position(F.array(*map(F.lit, classes)), F.col(label)) - 1
    return shapes.withColumns({"cls": cls, "cx": (F.col("x1") + F.col("x2")) / 2 / w, "cy": (F.col("y1") + F.col("y2")) / 2 / h, "w": (F.col("x2") - F.col("x1") + 1) / w, "h": (F.col("y2") - F.col("y1") + 1) / h})


def yolo_lines(shapes: DataFrame, classes: tuple[str, ...], label: str = "region_type") -> DataFrame:
    return yolo_rows(shapes, classes, label).select("doc_id", F.concat_ws(" ", "cls", "cx", "cy", "w", "h").alias("line"))


def write_tsv(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").csv(path, sep="\t", header=True)


def write_texts(rows: DataFrame, path: str, text: str = "text") -> None:
    rows.select(text).write.mode("overwrite").text(path, lineSep="\n\n\n")
