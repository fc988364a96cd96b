"""OCR output as word tables: Tesseract and Kraken hOCR, PAGE XML and JSON.

Files are read whole by Spark (one row a page) and parsed with the standard library, page by page, in Arrow batches.
"""

from __future__ import annotations

import html.parser
import re
import xml.etree.ElementTree as ET
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.schemas import JSON_PAGE, OCR_WORDS

LINE_CLASSES = frozenset(("ocr_line", "ocrx_line", "ocr_textfloat", "ocr_header"))
BBOX = re.compile(r"(?:^|;)\s*bbox (\d+) (\d+) (\d+) (\d+)")
Word = tuple[int, str, int, int, int, int]


class HocrReader(html.parser.HTMLParser):
    """Words (line, text, box) of a page; a word is an element of the given class inside a line."""

    def __init__(self, word_class: str):
        super().__init__(convert_charrefs=True)
        self.word_class, self.line, self.words = word_class, -1, []
        self.stack: list[bool] = []
        self.open: list | None = None

    def handle_starttag(self, tag, attributes):
        values = dict(attributes)
        classes = (values.get("class") or "").split()
        if LINE_CLASSES.intersection(classes):
            self.line += 1
        word = self.word_class in classes
        if word and (m := BBOX.search(values.get("title") or "")):
            self.open = [self.line, "", *map(int, m.groups())]
        if tag not in ("br", "img", "meta", "link", "input", "hr"):
            self.stack.append(word)

    def handle_data(self, data):
        if self.open is not None:
            self.open[1] += data

    def handle_endtag(self, tag):
        if self.stack and self.stack.pop() and self.open is not None:
            self.words.append(tuple(self.open))
            self.open = None


def hocr_words(page: str, word_class: str = "ocrx_word") -> list[Word]:
    reader = HocrReader(word_class)
    reader.feed(page)
    return reader.words


def kraken_words(page: str) -> list[Word]:
    return hocr_words(page, "ocr_word")


def pagexml_words(page: str) -> list[Word]:
    out = []
    local = lambda e: e.tag.rsplit("}", 1)[-1]
    lines = [e for e in ET.fromstring(page.encode()).iter() if local(e) == "TextLine"]
    for i, line in enumerate(lines):
        for word in (e for e in line if local(e) == "Word"):
            points = next((e.get("points", "") for e in word if local(e) == "Coords"), "")
            xs, ys = zip(*[tuple(map(int, p.split(","))) for p in points.split()]) if points else ((0,), (0,))
            text = next((u.text or "" for e in word if local(e) == "TextEquiv" for u in e if local(u) == "Unicode"), "")
            out.append((i, text, min(xs), min(ys), max(xs), max(ys)))
    return out


READERS: dict[str, Callable[[str], list[Word]]] = {".hocr": hocr_words, ".html": kraken_words, ".xml": pagexml_words}


def page_words(suffix: str, page: str) -> list[Word]:
    if suffix not in READERS:
        raise NotImplementedError(f"no reader for {suffix}")
    return READERS[suffix](page)


def page_files(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """page_id, suffix and content of the files below a path."""
    rows = spark.read.option("pathGlobFilter", glob).option("recursiveFileLookup", True).text(path, wholetext=True).select(F.input_file_name().alias("f"), F.col("value").alias("content"))
    name = F.element_at(F.split("f", "/"), -1)
    return rows.select(F.regexp_replace(name, r"\.[^.]*$", "").alias("page_id"), F.regexp_extract(name, r"\.[^.]*$", 0).alias("suffix"), "content")


def read_ocr(spark: SparkSession, path: str, suffix: str) -> DataFrame:
    """Words of all pages with the suffix (.hocr, .html, .xml or .json), blank ones left out, stripped."""
    files = page_files(spark, path, "*" + suffix)
    if suffix == ".json":
        lines = files.select("page_id", F.posexplode(F.from_json("content", JSON_PAGE)).alias("line_idx", "line"))
        words = lines.select("page_id", "line_idx", F.posexplode("line.words").alias("word_idx", "w"))
        rows = words.select("page_id", "line_idx", "word_idx", F.trim("w.text").alias("text"), *[F.get("w.xyxy", F.lit(i)).alias(c) for i, c in enumerate(("x1", "y1", "x2", "y2"))])
        return rows.filter("text <> ''")

    def parsed(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for page_id, page in zip(frame["page_id"], frame["content"]):
                words = [w for w in page_words(suffix, page) if w[1].strip()]
                out += [(page_id, line, i, text.strip(), *b) for i, (line, text, *b) in enumerate(words)]
            yield pd.DataFrame(out, columns=["page_id", "line_idx", "word_idx", "text", "x1", "y1", "x2", "y2"])

    return files.select("page_id", "content").mapInPandas(parsed, OCR_WORDS)
