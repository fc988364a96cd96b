"""Sequence labels: alignment with sub-tokens, spans, scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.operators.containers import islands


def align_to_tokens(values: Column, word_ids: Column, missing: Column, all_tokens: bool = False, inside=None) -> Column:
    """Array per sub-token: a word's value on its first sub-token, `missing` elsewhere (or inside(value) if all_tokens).

    word_ids: array of the words the sub-tokens come from, null for special ones; a word taken up again after a null starts anew.
    """

    def one(word: Column, i: Column) -> Column:
        before = F.when(i > 0, F.get(word_ids, i - 1))
        value = F.get(values, word)
        later = (inside(value) if inside else value) if all_tokens else missing
        return F.when(word.isNull(), missing).when(~word.eqNullSafe(before), value).otherwise(later)

    return F.transform(word_ids, one)


def align_from_tokens(values: Column, word_ids: Column) -> Column:
    """Values of the sub-tokens that open a word; nulls between sub-tokens do not split a word."""
    pairs = F.filter(F.arrays_zip(values.alias("v"), word_ids.alias("w")), lambda x: x["w"].isNotNull())
    opening = F.filter(pairs, lambda x, i: (i == 0) | ~x["w"].eqNullSafe(F.get(F.transform(pairs, lambda y: y["w"]), i - 1)))
    return F.transform(opening, lambda x: x["v"])


def inside_label(label: Column) -> Column:
    """B-x as I-x."""
    return F.when(label.startswith("B-"), F.concat(F.lit("I"), F.substring(label, 2, 1 << 20))).otherwise(label)


def label_ids(labels: DataFrame, column: str = "label") -> DataFrame:
    """label, id: by entity, B before I, O last."""
    distinct = labels.select(column).distinct()
    order = Window.orderBy(F.col(column) == "O", F.concat(F.substring(column, 3, 1 << 20), F.left(column, F.lit(1))))
    return distinct.select(F.col(column).alias("label"), (F.row_number().over(order) - 1).alias("id"))


def spans(tokens: DataFrame, label: str, by: list[str], order: str) -> DataFrame:
    """Entities of a BIO column: type, first and last token. An I that does not go on an entity of its type opens one."""
    w = Window.partitionBy(*by).orderBy(order)
    kind = F.when(F.col(label) != "O", F.substring(label, 3, 1 << 20))
    rows = tokens.withColumns({"__k": kind, "__p": F.left(label, F.lit(1))})
    rows = rows.withColumn("__o", (F.col("__p") == "B") | ~F.col("__k").eqNullSafe(F.lag("__k").over(w)))
    rows = islands(rows, by, order, F.col("__o"), "__run").filter(F.col("__k").isNotNull())
    return rows.groupBy(*by, "__run").agg(F.first("__k").alias("type"), F.min(order).alias("first"), F.max(order).alias("last")).drop("__run")


def span_scores(gold: DataFrame, found: DataFrame, by: list[str]) -> DataFrame:
    """type, tp, n_gold, n_found, precision, recall, f1; the row without a type is over all. 0 where undefined."""
    keys = [*by, "type", "first", "last"]
    both = gold.withColumn("g", F.lit(1)).join(found.withColumn("p", F.lit(1)), keys, "full")
    t = both.rollup("type").agg(F.count_if(F.col("g").isNotNull() & F.col("p").isNotNull()).alias("tp"), F.count("g").alias("n_gold"), F.count("p").alias("n_found"))
    part = lambda a, b: F.coalesce(F.try_divide(a.cast("double"), b), F.lit(0.0))
    p, r = part(F.col("tp"), F.col("n_found")), part(F.col("tp"), F.col("n_gold"))
    return t.select("type", "tp", "n_gold", "n_found", F.round(p, 6).alias("precision"), F.round(r, 6).alias("recall"), F.round(part(2 * p * r, p + r), 6).alias("f1"))


def write_back(tokens: DataFrame, predictions: DataFrame, label: str = "label", key: str = "n") -> DataFrame:
    """One label column overwritten where there is a prediction for the line."""
    p = predictions.select(key, F.col(label).alias("__new"))
    return tokens.join(p, key, "left").withColumn(label, F.coalesce("__new", label)).drop("__new")


def greedy_decode(steps: Column, blank: str = "") -> Column:
    """Best symbol of each step; repeats of the step before and blanks go."""
    kept = F.filter(steps, lambda s, i: (s != blank) & ((i == 0) | (s != F.get(steps, i - 1))))
    return F.array_join(kept, "")
