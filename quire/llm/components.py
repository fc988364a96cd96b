"""Connected components of an edge table, by label spreading and shortcuts."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.common import cut, trimmed

#: Partitions whose forests are joined into one.
JOINED = 16


@trimmed
def forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of a partition's edges those that join what the ones before have not: fewer than it has nodes."""
    above: dict[int, int] = {}

    def top(x: int) -> int:
        while (up := above.setdefault(x, x)) != x:
            above[x] = x = above[up]
        return x

    for batch in batches:
        keep = []
        for x, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            x, y = top(x), top(y)
            above[max(x, y)] = min(x, y)
            keep.append(x != y)
        yield batch.filter(pa.array(keep, pa.bool_()))


def thinned(edges: DataFrame) -> DataFrame:
    """Edges (x, y) with the same components: a large group's grow with its members (and the partitions), not with its pairs.

    Stored between the two passes: a task of both takes two Python workers at a time, and an executor keeps and uses all that it ever had.
    """
    kind = "x long, y long"
    once = cut(edges.mapInArrow(forest, kind))
    return once.coalesce(max(1, once.rdd.getNumPartitions() // JOINED)).mapInArrow(forest, kind)


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component): component is the smallest node reached. Nodes without an edge are not listed.

    Each round every node takes the least label among its neighbours' and then that label's own label, so chains
    shorten fast. Edges that close a circle are left out first, as far as a few tasks see them. All steps are joins and map-side combined minima, cut at the shared checkpoint folder.
    """
    both = thinned(edges.select(F.col(a).alias("x"), F.col(b).alias("y")).filter("x <> y"))
    both = cut(both.select(F.inline(F.array(F.struct("x", "y"), F.struct(F.col("y").alias("x"), F.col("x").alias("y"))))).distinct())
    labels = cut(both.groupBy(F.col("x").alias("node")).agg(F.least(F.min("y"), F.first("x")).alias("label")))
    while True:
        heard = both.join(labels, both.y == labels.node).groupBy("x").agg(F.min("label").alias("least"))
        new = labels.join(heard, labels.node == heard.x).select("node", F.col("label").alias("old"), F.least("label", "least").alias("label"))
        up = new.select(F.col("node").alias("up"), F.col("label").alias("up_label"))
        new = cut(new.join(up, new.label == up.up).select("node", "old", F.least("label", "up_label").alias("label")))
        labels = new.select("node", "label")
        if new.filter("label <> old").isEmpty():
            return labels.withColumnRenamed("label", "component")
