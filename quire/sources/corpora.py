"""Corpora, token tables, line pairs and other flat inputs."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quire.functions.text import beta_to_greek
from quire.schemas import LEMLINK, LINE_PAIR


def file_stem():
    return F.regexp_extract(F.input_file_name(), r"([^/]+?)(?:\.[^./]*)?$", 1)


def plain_text(spark: SparkSession, path: str, glob: str = "*.txt") -> DataFrame:
    return spark.read.option("pathGlobFilter", glob).option("recursiveFileLookup", True).text(path, wholetext=True).select(file_stem().alias("name"), F.col("value").alias("text"))


def corpus_parts(texts: DataFrame) -> DataFrame:
    """name, doc_idx, region_idx, line_idx, line: documents apart by two empty lines, regions by one."""
    d = texts.select("name", F.posexplode(F.split("text", "\n\n\n")).alias("doc_idx", "d"))
    r = d.select("name", "doc_idx", F.posexplode(F.split("d", "\n\n")).alias("region_idx", "r"))
    return r.select("name", "doc_idx", "region_idx", F.posexplode(F.split("r", "\n")).alias("line_idx", "line"))


def hipe_tokens(spark: SparkSession, path: str) -> DataFrame:
    """document_id, n and the columns of a token table with a header; # lines carry the document's metadata."""
    raw = spark.read.text(path).select(F.input_file_name().alias("file"), F.monotonically_increasing_id().alias("at"), "value")
    names = spark.read.text(path).filter(~F.col("value").startswith("#") & F.col("value").startswith("TOKEN")).first()["value"].split("\t")
    order = Window.partitionBy("file").orderBy("at")
    raw = raw.withColumn("document_id", F.last(F.when(F.col("value").rlike(r"^#\s*(?:hipe2022:)?document_id"), F.trim(F.regexp_extract("value", "=(.*)$", 1))), ignorenulls=True).over(order))
    rows = raw.filter((F.col("value") != "") & ~F.col("value").startswith("#") & ~F.col("value").startswith("TOKEN\t"))
    cells = F.split("value", "\t")
    return rows.select("file", "document_id", (F.row_number().over(order) - 1).alias("n"), *[F.get(cells, F.lit(i)).alias(c) for i, c in enumerate(names)])


def lemlink_tokens(spark: SparkSession, path: str) -> DataFrame:
    """Token tables without a header; notes are read as O."""
    rows = spark.read.schema(LEMLINK).option("sep", "\t").option("quote", "").option("emptyValue", "").option("nullValue", "\u0000").csv(path).withColumn("at", F.monotonically_increasing_id())
    rows = rows.withColumn("n", F.row_number().over(Window.partitionBy(F.input_file_name()).orderBy("at")) - 1).drop("at")
    return rows.withColumn("LABEL", F.when(F.col("LABEL").isin("B-note", "I-note"), "O").otherwise(F.col("LABEL")))


def line_pairs(spark: SparkSession, gt_path: str, ocr_path: str, glob: str = "*.txt") -> DataFrame:
    """line_id, gt, ocr: files of the same stem in two folders."""
    return plain_text(spark, gt_path, glob).withColumnsRenamed({"name": "line_id", "text": "gt"}).join(plain_text(spark, ocr_path, glob).withColumnsRenamed({"name": "line_id", "text": "ocr"}), "line_id")


def json_line_pairs(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(LINE_PAIR).json(path).select(F.col("groundtruth.line").alias("gt"), F.col("ocr.line").alias("ocr"))


def json_pages(spark: SparkSession, path: str) -> DataFrame:
    """name, page_idx, text of (gzipped) JSON lines with an array of pages."""
    return spark.read.schema("id string, fullText array<string>").json(path).select(F.col("id").alias("name"), F.posexplode("fullText").alias("page_idx", "text"))


def yolo_boxes(spark: SparkSession, path: str, width: int, height: int) -> DataFrame:
    """page_id, cls, conf and pixel boxes of label files."""
    rows = spark.read.text(path).select(file_stem().alias("page_id"), F.split("value", " ").alias("v")).filter("size(v) >= 5")
    n = lambda i: F.get("v", F.lit(i)).cast("double")
    cx, cy, w, h = (n(1) * width).cast("int"), (n(2) * height).cast("int"), (n(3) * width).cast("int"), (n(4) * height).cast("int")
    x1, y1 = (cx - w / 2).cast("int"), (cy - h / 2).cast("int")
    return rows.select("page_id", n(0).cast("int").alias("cls"), n(5).alias("conf"), x1.alias("x1"), y1.alias("y1"), (x1 + w).alias("x2"), (y1 + h).alias("y2"))


def tei_texts(spark: SparkSession, path: str) -> DataFrame:
    """name, text: the contents of the files' text elements, tags out; names that start with _ are skipped."""
    files = spark.read.option("pathGlobFilter", "*.xml").option("recursiveFileLookup", True).text(path, wholetext=True).select(file_stem().alias("name"), "value").filter(~F.col("name").startswith("_"))
    bodies = F.regexp_extract_all("value", F.lit(r"(?s)<(?:tei:)?text\b[^>]*>(.*?)</(?:tei:)?text>"), F.lit(1))
    plain = F.transform(bodies, lambda b: F.regexp_replace(b, r"<[^>]*>", ""))
    text = F.array_join(plain, "\n\n\n")
    for name, sign in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'"), ("&amp;", "&")):
        text = F.replace(text, F.lit(name), F.lit(sign))
    return files.select("name", text.alias("text"))


def beta_texts(texts: DataFrame, greek_share: float = 0.9) -> DataFrame:
    """Texts in beta code to Greek, unless they are Greek already."""
    from quire.functions.text import greek_ratio

    return texts.withColumn("text", F.when(F.coalesce(greek_ratio(F.regexp_replace("text", " ", "")), F.lit(0.0)) >= greek_share, F.col("text")).otherwise(beta_to_greek("text")))


def lexicon(spark: SparkSession, paths: list[str]) -> DataFrame:
    """lemma, definition: JSON objects, later files win; a definition ends in a stop."""
    one = lambda i, p: spark.read.text(p, wholetext=True).select(F.lit(i).alias("rank"), F.explode(F.from_json("value", "map<string,string>")).alias("lemma", "definition"))
    rows = reduce(DataFrame.union, [one(i, p) for i, p in enumerate(paths)])
    best = rows.groupBy("lemma").agg(F.max_by("definition", "rank").alias("d"))
    return best.select("lemma", F.when(F.col("d").endswith("."), F.col("d")).otherwise(F.concat("d", F.lit("."))).alias("definition"))


def first_column(spark: SparkSession, path: str) -> DataFrame:
    """name, text: the first column of tab-separated files joined by spaces; masked files are left out."""
    rows = spark.read.option("sep", "\t").option("header", True).option("quote", "").csv(path)
    rows = rows.select(file_stem().alias("name"), F.monotonically_increasing_id().alias("at"), F.col(rows.columns[0]).alias("t")).filter(~F.col("name").contains("masked"))
    return rows.groupBy("name").agg(F.array_sort(F.collect_list(F.struct("at", "t"))).alias("x")).select("name", F.array_join(F.col("x.t"), " ").alias("text"))


def oai_records(spark: SparkSession, path: str, fields: tuple[str, ...]) -> DataFrame:
    """One row a record, list-valued columns; records without header or metadata are left out."""
    files = spark.read.text(path, wholetext=True)
    records = files.select(F.explode(F.regexp_extract_all("value", F.lit(r"(?s)<record\b[^>]*>(.*?)</record>"), F.lit(1))).alias("r")).filter(F.col("r").contains("<header") & F.col("r").contains("<metadata"))
    return records.select(*[F.regexp_extract_all("r", F.lit(rf"(?s)<(?:\w+:)?{f}\b[^>]*>(.*?)</(?:\w+:)?{f}>"), F.lit(1)).alias(f) for f in fields])
