"""Building datasets: sampling, splitting, weighting, batching."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def seeded(*cols: str, seed: int = 42) -> Column:
    """A hash that any engine can compute: md5 of the columns and the seed."""
    return F.md5(F.concat_ws("|", *[F.col(c).cast("string") for c in cols], F.lit(str(seed))))


def sample_rows(rows: DataFrame, key: str, share: float, seed: int = 42) -> DataFrame:
    """Rows whose hash falls in the first share of its range: no sort, no shuffle, the same rows every time."""
    return rows.filter(F.conv(F.left(seeded(key, seed=seed), F.lit(8)), 16, 10).cast("long") < int(share * (1 << 32)))


def at_most_per_group(rows: DataFrame, by: list[str], key: str, most: int, least: int = 0, seed: int = 42) -> DataFrame:
    """Up to `most` rows of each group by hash; groups of fewer than `least` go."""
    w = Window.partitionBy(*by)
    ranked = rows.withColumns({"__r": F.row_number().over(w.orderBy(seeded(key, seed=seed), key)), "__n": F.count("*").over(w)})
    return ranked.filter((F.col("__r") <= most) & (F.col("__n") >= least)).drop("__r", "__n")


def split_by_hash(rows: DataFrame, strata: list[str], key: str, test: int, dev: int = 0, seed: int = 42) -> DataFrame:
    """split: the first `test` rows of each stratum by hash, then `dev`, then training."""
    r = F.row_number().over(Window.partitionBy(*strata).orderBy(seeded(key, seed=seed), key))
    return rows.withColumn("__r", r).withColumn("split", F.when(F.col("__r") <= test, "test").when(F.col("__r") <= test + dev, "dev").otherwise("train")).drop("__r")


def replicate(rows: DataFrame, weight: Column) -> DataFrame:
    """Each row as often as its weight says; 0 drops it."""
    return rows.withColumn("__w", weight).filter("__w > 0").withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("__w")))).drop("__w")


def pack_batches(rows: DataFrame, by: list[str], order: str, size: str, most: int) -> DataFrame:
    """batch: rows in order, a new batch where one more would pass `most`; by groups, each read as a stream."""
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)

    def one(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, batch, held = None, 0, 0
        for frame in frames:
            out = []
            for k, n in zip(frame[by].itertuples(index=False, name=None), frame[size]):
                if k != key:
                    key, batch, held = k, 0, 0
                if held + n > most:
                    batch, held = batch + 1, 0
                held += n
                out.append(batch)
            yield frame.assign(batch=pd.Series(out, index=frame.index, dtype="int64"))

    return rows.repartition(*by).sortWithinPartitions(*by, order).mapInPandas(one, fields + ", batch long")


def worker_of(index: Column, n: Column, workers: int) -> Column:
    """Contiguous ranges of equal size, the last takes the rest."""
    size = F.greatest(F.floor(n / workers), F.lit(1))
    return F.least(F.floor(index / size), F.lit(workers - 1)).cast("int")


def chunk_count(width: Column, chunk: int, overlap: int) -> Column:
    return F.ceil(F.greatest(width - overlap, F.lit(1)) / (chunk - overlap)).cast("int")


def chunk_padding(width: Column, chunk: int, overlap: int) -> Column:
    n = chunk_count(width, chunk, overlap)
    return n * chunk - (n - 1) * overlap - width
