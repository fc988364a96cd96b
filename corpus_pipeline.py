"""From raw documents to a training mix, in five stages; each takes (spark, docs, sf_dir) and works on all that the one before kept.

Every stage returns the columns of docs (the last one the mix's besides), whatever they are called: a stage sees other columns than those it needs
under names of its own. Nulls: a null text is empty, a null doc_id keeps a document out of comparisons by id (it stays), a null source is one
source. Empty texts are not toxic, hold no lines or items, resemble nothing and have no words to mix. Rows that repeat doc_id and text are one
document to drop_near_copies (the least by a hash of its other columns stays) and rows of their own to the other stages; rows that share a doc_id
with different texts are documents of their own. An empty table gives an empty table.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quire.llm.common import ascii_strip, cut, free_shuffles, load, shared_folder
from quire.llm.decontaminate import contaminated
from quire.llm.jaccard import similar_documents
from quire.llm.line_dedup import dedup_lines
from quire.llm.mixing import mixed_documents
from quire.llm.toxicity import toxicity

USED = ("doc_id", "text", "source")


def shielded(docs: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """docs with every column that is not in USED renamed, and the new names by the old ones."""
    names = {c: c if c in USED else f"__col{i}" for i, c in enumerate(docs.columns)}
    return docs.select(*[F.col(f"`{c}`").alias(n) for c, n in names.items()]), names


def restored(found: DataFrame, names: dict[str, str], *more: str) -> DataFrame:
    return found.select(*[F.col(n).alias(c) for c, n in names.items() if c not in more], *more)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier learnt from `labels` rejects go."""
    inner, names = shielded(docs)
    return restored(toxicity(inner, load(spark, sf_dir, "labels")).filter("predicted = 0"), names)


def drop_common_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of lines that ten documents or more share, all but the first go; so do documents that lost lines and have nothing but white space left.

    n_chars, if there, follows the text.
    """
    inner, names = shielded(docs)
    found = dedup_lines(inner, "first", 10)
    lost = F.col("n_dropped") > 0
    found = found.filter(~lost | (ascii_strip(F.col("kept")) != "")).withColumn("text", F.when(lost, F.col("kept")).otherwise(F.col("text")))
    if "n_chars" in names:
        own = names["n_chars"]
        found = found.withColumn(own, F.when(lost, F.char_length("kept").cast(docs.schema["n_chars"].dataType)).otherwise(F.col(own)))
    return restored(found, names)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents that similarity links, the one of the smallest doc_id stays (of the smallest hash of its text, if several have that id).

    Rows without a doc_id stay. Of rows with equal doc_id and text one stays.
    """
    # stored: it is read twice, and the driver would hold its joins twice in the plan of the result
    found = cut(similar_documents(docs).filter("doc_id is not null and n_shingles > 0").select("doc_id", "th", "group", "component_id"))
    free_shuffles(spark)
    heads = found.filter("doc_id = component_id").groupBy("doc_id", "group").agg(F.min("th").alias("least"))
    apart = found.join(heads, ["doc_id", "group"], "left")
    gone = apart.filter("doc_id <> component_id or th <> least").select(F.col("doc_id").alias("__gone"), F.col("th").alias("__gone_th")).distinct()
    inner, names = shielded(docs)
    inner = inner.withColumn("__th", F.xxhash64("text"))
    kept = inner.join(gone, (F.col("doc_id") == F.col("__gone")) & (F.col("__th") == F.col("__gone_th")), "left_anti")
    others = [n for n in names.values() if n not in ("doc_id", "text")]
    copy = F.row_number().over(Window.partitionBy("doc_id", "__th").orderBy(F.xxhash64(*others) if others else F.lit(0)))
    return restored(kept.withColumn("__copy", copy).filter("doc_id is null or __copy = 1"), names)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    inner, names = shielded(docs)
    return restored(contaminated(inner, load(spark, sf_dir, "benchmark"), keep=tuple(inner.columns)).filter(F.size("hits") == 0), names)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix: a row for each copy taken, with mix_shard, mix_copy and mix_order (in place of columns of those names)."""
    inner, names = shielded(docs)
    return restored(mixed_documents(inner), names, "mix_shard", "mix_copy", "mix_order")


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_common_lines),
    ("jaccard_join", drop_near_copies),
    ("decontamination", drop_contaminated),
    ("mixing", mix_sources),
]

#: A learnt classifier has no SQL.
ORACLE_SQL = None


def remove(spark: SparkSession, folder: str) -> None:
    """By the file system that the folder is in."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; what each keeps is written to the shared folder and read again, and removed once the next one is written."""
    at = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    docs, before = load(spark, sf_dir, "documents"), None
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            folder = f"{at}/{k}-{name}"
            docs.write.parquet(folder)
            docs = spark.read.parquet(folder)
            if before:
                remove(spark, before)
            before = folder
    return docs
