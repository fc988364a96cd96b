"""Column expressions and storage helpers shared by the operators of this subpackage."""

from __future__ import annotations

import ctypes
import functools
import gc
import sys
import tempfile
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space, as the contracts of this subpackage use it: space and U+0009 to U+000D.
SPACE_CHARS = " \t\n\x0b\x0c\r"
WORD_PATTERN = r"[^\x20\x09-\x0D]+"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def ascii_lower(text: Column) -> Column:
    """A-Z lower-cased, all else as it is. Only rows with non-ASCII characters pay for translate()."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, UPPER.lower()))


def ascii_strip(text: Column) -> Column:
    return F.btrim(text, F.lit(SPACE_CHARS))


def word_count(text: Column) -> Column:
    """Number of maximal runs of anything but ASCII white space; null counts 0."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD_PATTERN)), F.lit(0)).cast("long")


def unit_hash(*cols: Column) -> Column:
    """A 63-bit non-negative hash."""
    return F.xxhash64(*cols).bitwiseAND(F.lit(0x7FFFFFFFFFFFFFFF))


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or the one set by setCheckpointDir.

    Where neither is set a local session gets one of its own; on a cluster that is an error, as executors would not see it.
    """
    sc = spark.sparkContext
    given, held = spark.conf.get("spark.checkpoint.dir", None), sc._jsc.sc().getCheckpointDir()
    if held.isDefined():
        return given or held.get()
    if not given and not sc.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir is not set: it has to name a folder that driver and executors share")
    sc.setCheckpointDir(given or tempfile.mkdtemp(prefix="quire-checkpoint-"))
    return given or sc._jsc.sc().getCheckpointDir().get()


def cut(df: DataFrame) -> DataFrame:
    """Store df in the checkpoint folder all executors share and go on from there.

    shared_folder() says which one.
    """
    shared_folder(df.sparkSession)
    return df.checkpoint()


@contextmanager
def setting(spark: SparkSession, name: str, value: str) -> Iterator[None]:
    """What is stored meanwhile is planned with this setting."""
    before = spark.conf.get(name)
    spark.conf.set(name, value)
    try:
        yield
    finally:
        spark.conf.set(name, before)


def planned_once(spark: SparkSession):
    """Plans are not made again after each of their stages: that costs the driver a job, an event and a plan for every exchange."""
    return setting(spark, "spark.sql.adaptive.enabled", "false")


def cut_dealt(df: DataFrame) -> DataFrame:
    """cut(), remembering how the last shuffle dealt df out, so that joins on its keys need not shuffle it again.

    Adaptive plans forget that: they are off while df is stored.
    """
    with planned_once(df.sparkSession):
        return cut(df)


def trim_memory() -> None:
    """Give what this Python process has freed back to the system: Arrow's pool and the C library keep it else (the latter by glibc only)."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None) if sys.platform == "linux" else None
    if trim:
        trim(0)


def free_memory() -> None:
    gc.collect()
    trim_memory()


def trimmed(rows: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """An Arrow function whose worker keeps no freed memory when a task ends: workers are used again, and idle ones stay."""

    @functools.wraps(rows)
    def run(batches: Iterator) -> Iterator:
        try:
            yield from rows(batches)
        finally:
            trim_memory()

    return run


def trimmed_group(table: Callable) -> Callable:
    """trimmed() for a function of a group's frame."""

    @functools.wraps(table)
    def run(frame):
        try:
            return table(frame)
        finally:
            trim_memory()

    return run


def free_shuffles(spark: SparkSession) -> None:
    """Let Spark's cleaner drop shuffle files that no live plan refers to any more."""
    free_memory()
    spark.sparkContext._jvm.System.gc()


def n_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def partitions(spark: SparkSession, n: int):
    """Shuffles of what is stored meanwhile have n partitions: the driver keeps something of every task and of every map output."""
    return setting(spark, "spark.sql.shuffle.partitions", str(n))


def input_bytes(df: DataFrame) -> int:
    """The planner's size estimate of df's sources (file sizes for a scan)."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def load(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


_shipped: dict[str, str] = {}


def ship(spark: SparkSession) -> None:
    """Send this package to the executors' Python workers through Spark's own file server, once per application."""
    import os
    import zipfile

    import quire

    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    root = os.path.dirname(os.path.abspath(quire.__file__))
    path = os.path.join(tempfile.mkdtemp(prefix="quire-ship-"), "quire_package.zip")
    with zipfile.ZipFile(path, "w") as z:
        for d, _, names in os.walk(root):
            for name in names:
                if name.endswith(".py"):
                    z.write(os.path.join(d, name), os.path.relpath(os.path.join(d, name), os.path.dirname(root)))
    spark.sparkContext.addPyFile(path)
    _shipped[app] = path
