"""Joins and lookups on word intervals and boxes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.functions.geometry import box
from quire.functions.interval import overlap_length, within

BUCKET = 64


def bucketed(rows: DataFrame, start: Column, end: Column, bucket: int) -> DataFrame:
    """A row for each bucket of word numbers that [start, end] touches."""
    first, last = F.floor(start / bucket), F.floor(F.greatest(start, end) / bucket)
    return rows.withColumn("__bucket", F.explode(F.sequence(first, last)))


def contained(children: DataFrame, parents: DataFrame, key: str = "source", bucket: int = BUCKET, prefix: str = "p_") -> DataFrame:
    """Pairs of a child and a parent (columns prefixed) whose interval holds the child's.

    An equi-join on key and bucket of the child's start, then the exact condition: no nested loops, and a source is as
    many join keys as it has buckets. Both sides have w_start and w_end.
    """
    left = children.withColumn("__bucket", F.floor(F.col("w_start") / bucket))
    right = bucketed(parents, F.col("w_start"), F.col("w_end"), bucket).select(*[F.col(c).alias(prefix + c if c not in ("__bucket",) else c) for c in [*parents.columns, "__bucket"]])
    on = (left[key] == right[prefix + key]) & (left["__bucket"] == right["__bucket"]) & within(F.col("w_start"), F.col("w_end"), F.col(prefix + "w_start"), F.col(prefix + "w_end"))
    return left.hint("merge").join(right, on).drop(left["__bucket"]).drop(right["__bucket"])


def overlapping(a: DataFrame, b: DataFrame, key: str, start: str, end: str, prefix: str = "o_", bucket: int = BUCKET) -> DataFrame:
    """Pairs of intervals that share at least a point; each pair once."""
    left = bucketed(a, F.col(start), F.col(end), bucket)
    right = bucketed(b, F.col(start), F.col(end), bucket).select(*[F.col(c).alias(prefix + c) for c in [*b.columns, "__bucket"]])
    hit = (left[key] == right[prefix + key]) & (left["__bucket"] == right[prefix + "__bucket"]) & (overlap_length(F.col(start), F.col(end), F.col(prefix + start), F.col(prefix + end)) > 0)
    once = left["__bucket"] == F.floor(F.greatest(F.col(start), F.col(prefix + start)) / bucket)
    return left.join(right, hit & once).drop("__bucket", prefix + "__bucket")


def text_of(words: DataFrame, *by: str, order: str = "word_idx", text: str = "text", out: str = "text") -> DataFrame:
    """Words of each group joined by spaces in order."""
    return words.groupBy(*by).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, F.col(text).alias("__t")))), lambda x: x["__t"]), " ").alias(out))


def first_parent(pairs: DataFrame, child: list[str], order: str) -> DataFrame:
    """Of each child's parents the first in order, by an aggregate that combines on the map side."""
    rest = [c for c in pairs.columns if c not in child]
    return pairs.groupBy(*child).agg(F.min_by(F.struct(*rest), order).alias("__first")).select(*child, "__first.*")


def spatially_in(inner: DataFrame, outer: DataFrame, share: float, on: str = "doc_id", prefix: str = "p_") -> DataFrame:
    """Pairs on the same page with more than the share of the inner box in the outer one."""
    right = outer.select(*[F.col(c).alias(prefix + c) for c in outer.columns])
    return inner.join(right, (inner[on] == right[prefix + on]) & box().mostly_inside(box(prefix), share))


def assign_once(pairs: DataFrame, item: list[str], order: str) -> DataFrame:
    """Each item to the first taker in order, as a sequential pass in that order would."""
    return first_parent(pairs, item, order)


def text_window(words: DataFrame, spans: DataFrame, size: int, span_keys: list[str]) -> DataFrame:
    """Text of `size` words to either side of each span (source, w_start, w_end), never before the first word."""
    wide = spans.withColumns({"__s": F.greatest(F.lit(0), F.col("w_start") - size), "__e": F.col("w_end") + size})
    parents = wide.select(*span_keys, "source", F.col("__s").alias("w_start"), F.col("__e").alias("w_end"))
    children = words.select("source", F.col("word_idx").alias("w_start"), F.col("word_idx").alias("w_end"), "text")
    pairs = contained(children, parents)
    return text_of(pairs, *["p_" + k for k in span_keys], order="w_start", out="window_text").select(*[F.col("p_" + k).alias(k) for k in span_keys], "window_text")


def nearest(a: DataFrame, b: DataFrame, on: str, x: str = "cx", y: str = "cy", weight_y: int = 10) -> DataFrame:
    """For each row of a the word of b on the same page least in dx^2 + weight_y * dy^2."""
    right = b.select(F.col(on).alias("__on"), F.col(x).alias("__x"), F.col(y).alias("__y"), F.col("word_idx").alias("near_word"))
    d = (F.col(x) - F.col("__x")) * (F.col(x) - F.col("__x")) + weight_y * (F.col(y) - F.col("__y")) * (F.col(y) - F.col("__y"))
    pairs = a.join(right, a[on] == right["__on"]).withColumn("distance", d.cast("long"))
    return pairs.groupBy(*a.columns).agg(F.min(F.struct("distance", "near_word")).alias("n")).select(*a.columns, "n.*")


def islands(rows: DataFrame, by: list[str], order: str, opens: Column, out: str = "island") -> DataFrame:
    """Numbers runs: opens is true where a new one starts."""
    return rows.withColumn(out, F.sum(F.when(opens, 1).otherwise(0)).over(Window.partitionBy(*by).orderBy(order)))
