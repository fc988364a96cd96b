"""Mixing sources to target weights by a multivariate-hypergeometric splitting tree. [native]

Each source is a stream: its documents in a seeded permutation, repeated when the target asks for more than there is.
The first `target` words of that stream are the mix's share, cut into blocks of equally many words. The vector of block
quotas is split recursively over the output shards: each node of the tree draws, source by source, how many of its
blocks go to its left half from the exact hypergeometric distribution. A shard then takes the next blocks of each
source's block permutation (disjoint by construction), and its rows are shuffled by a seeded hash within the shard.

Places in a stream are prefix sums over seeded hash buckets (BUCKETS to a source), so that a source with a third of all
rows is spread over as many tasks; only bucket sums meet in windows over a source. Everything is DataFrame operations.

A document that straddles a source's target is taken if its middle lies below, so a source misses its target by half a
document at most. Null sources are one source, the last; null or empty texts have size 0 and are never taken. Rows
that repeat a doc_id are documents of their own (equal rows in any order). Empty tables give empty results.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.llm.common import cut, unit_hash, word_count

BUCKETS = 4096
WEIGHTS = (5, 2, 1)
CAP = 3
MAX_SHARDS = 4096
BLOCKS_PER_SHARD = 32
WORDS_PER_SHARD = 1 << 22


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, cap: int = CAP) -> DataFrame:
    """(source, source_size) with idx (code-point order, null last) and target.

    Targets share the sum of all sizes by weight; what a source would get beyond cap times its size is shared
    again among the others by weight until none is above. Sorted by cap/weight, that is one running sum.
    """
    everything = Window.partitionBy()
    rows = sizes.withColumn("idx", F.row_number().over(everything.orderBy(F.col("source").isNull(), "source")).cast("int") - 1)
    rows = rows.withColumn("w", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), F.col("idx") % len(weights) + 1))
    rows = rows.withColumns({"most": F.col("source_size") * float(cap), "all": F.sum("source_size").over(everything).cast("double"), "all_w": F.sum("w").over(everything)})
    before = everything.orderBy(F.col("most") / F.col("w"), "idx").rowsBetween(Window.unboundedPreceding, -1)
    share = (F.col("all") - F.coalesce(F.sum("most").over(before), F.lit(0.0))) / (F.col("all_w") - F.coalesce(F.sum("w").over(before), F.lit(0.0)))
    rows = rows.withColumn("share", share).withColumn("share", F.max("share").over(everything))
    return rows.select("source", "source_size", "idx", F.least("most", F.col("share") * F.col("w")).alias("target"))


def hypergeometric(pop: str, hits: str, draws: str, u: str) -> str:
    """SQL for an exact draw by inversion: how many of `draws` out of `pop` fall on `hits`, at the uniform number u."""
    low, high = f"greatest(0L, {draws} - ({pop} - {hits}))", f"least({draws}, {hits})"
    step = f"ln(cast({hits} - k as double) * ({draws} - k)) - ln(cast(k + 1 as double) * ({pop} - {hits} - {draws} + k + 1))"
    mass = f"aggregate(sequence({low}, {high}), named_struct('lp', 0D, 'm', -1e300D, 's', 0D), (b, k) -> named_struct('lp', b.lp + {step}, 'm', greatest(b.m, b.lp), 's', b.s * exp(b.m - greatest(b.m, b.lp)) + exp(b.lp - greatest(b.m, b.lp))))"
    found = f"aggregate(sequence({low}, {high}), named_struct('lp', 0D, 'c', 0D, 'd', -1L), (b, k) -> named_struct('lp', b.lp + {step}, 'c', b.c + exp(b.lp - z.m), 'd', if(b.d < 0 and b.c + exp(b.lp - z.m) >= {u} * z.s, k, b.d)), b -> if(b.d < 0, {high}, b.d))"
    return f"element_at(transform(array({mass}), z -> {found}), 1)"


def split_quotas(quotas: DataFrame, n_shards: int, seed: int) -> DataFrame:
    """quotas: one row with an array of block quotas by source. One row per shard: (shard, quotas), summing to the input."""
    nodes = quotas.select(F.lit(0).alias("lo"), F.lit(n_shards).alias("n"), "quotas")
    left = f"""aggregate(
        transform(quotas, (q, i) -> named_struct('k', q, 'u', cast(xxhash64({seed}, lo, n, i) & 9223372036854775807 as double) / 9223372036854775807D)),
        named_struct('pop', aggregate(quotas, 0L, (a, q) -> a + q), 'n', aggregate(quotas, 0L, (a, q) -> a + q) * (n div 2) div n, 'left', cast(array() as array<bigint>)),
        (a, q) -> element_at(transform(array({hypergeometric("a.pop", "q.k", "a.n", "q.u")}), d -> named_struct('pop', a.pop - q.k, 'n', a.n - d, 'left', concat(a.left, array(d)))), 1),
        a -> a.left)"""
    for _ in range(math.ceil(math.log2(max(1, n_shards)))):
        parts = nodes.withColumn("first", F.when(F.col("n") > 1, F.expr(left)))
        children = """if(n <= 1, array(named_struct('lo', lo, 'n', n, 'quotas', quotas)), array(
            named_struct('lo', lo, 'n', int(n div 2), 'quotas', first),
            named_struct('lo', lo + int(n div 2), 'n', n - int(n div 2), 'quotas', zip_with(quotas, first, (q, f) -> q - f))))"""
        nodes = parts.select(F.explode(F.expr(children)).alias("c")).select("c.*")
    return nodes.select(F.col("lo").alias("shard"), "quotas")


def plan_blocks(sources: DataFrame, block_words: float, n_shards: int, seed: int) -> DataFrame:
    """(idx, block, shard): where each block of each source goes. At most n_shards * BLOCKS_PER_SHARD blocks and one a source."""
    blocks = sources.select("idx", F.ceil(F.col("target") / block_words).cast("long").alias("quota"))
    vector = blocks.agg(F.sort_array(F.collect_list(F.struct("idx", "quota"))).alias("q")).select(F.col("q.quota").alias("quotas"))
    shards = cut(split_quotas(vector, n_shards, seed))
    got = shards.select("shard", F.posexplode("quotas").alias("idx", "m")).filter("m > 0")
    up_to = Window.partitionBy("idx").orderBy("shard").rowsBetween(Window.unboundedPreceding, 0)
    dealt = got.withColumn("end", F.sum("m").over(up_to)).select("idx", "shard", F.explode(F.expr("sequence(end - m + 1, end)")).alias("rank"))
    permuted = blocks.filter("quota > 0").select("idx", F.explode(F.expr("sequence(0L, quota - 1)")).alias("block"))
    permuted = permuted.withColumn("rank", F.row_number().over(Window.partitionBy("idx").orderBy(F.xxhash64(F.lit(seed), "idx", "block"), "block")).cast("long"))
    return permuted.join(dealt, ["idx", "rank"]).select("idx", "block", "shard")


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, cap: int = CAP, n_shards: int | None = None, seed: int = 7, text: str = "text", doc_id: str = "doc_id", source: str = "source", size: Column | None = None) -> DataFrame:
    """One row per copy that the mix takes, and one with a null shard for each document it leaves out.

    docs' columns, then mix_size, mix_source_size, mix_target, mix_copy (from 0), mix_shard and mix_order (the place
    in the shard's shuffle, a hash). mix_row tells rows apart that repeat one another.
    """
    rows = docs.withColumns({"mix_size": word_count(F.col(text)) if size is None else size, "__s": F.col(source), "__h": unit_hash(F.lit(seed), F.col(doc_id)), "__th": F.xxhash64(F.col(text))})
    rows = rows.withColumn("__b", F.shiftright("__h", 63 - int(math.log2(BUCKETS))).cast("int"))
    sums = cut(rows.groupBy(F.col("__s").alias("source"), F.col("__b").alias("bucket")).agg(F.sum("mix_size").alias("words")))
    sources = cut(targets(sums.groupBy("source").agg(F.sum("words").alias("source_size")), weights, cap))
    total = sources.agg(F.sum("source_size")).first()[0] or 0
    n = n_shards or max(1, min(MAX_SHARDS, math.ceil(total / WORDS_PER_SHARD)))
    block_words = max(1.0, total / (n * BLOCKS_PER_SHARD))
    blocks = plan_blocks(sources, block_words, n, seed)
    earlier = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.withColumn("start", F.coalesce(F.sum("words").over(earlier), F.lit(0)))
    starts = starts.join(sources.withColumnRenamed("source", "s2"), F.col("source").eqNullSafe(F.col("s2"))).select(F.col("source").alias("s3"), F.col("bucket").alias("b3"), F.col("start").alias("__start"), F.col("idx").alias("__idx"), F.col("source_size").alias("mix_source_size"), F.col("target").alias("mix_target"))
    place = Window.partitionBy("__s", "__b").orderBy("__h", F.col(doc_id), "__th", "mix_size")
    rows = rows.withColumns({"__n": F.row_number().over(place), "__before": F.sum("mix_size").over(place.rowsBetween(Window.unboundedPreceding, 0)) - F.col("mix_size")})
    rows = rows.join(starts, F.col("__s").eqNullSafe(F.col("s3")) & (F.col("__b") == F.col("b3")))
    at = F.col("__start") + F.col("__before")
    copies = F.when(F.col("mix_size") > 0, F.least(F.lit(cap), F.greatest(F.lit(0), F.floor((F.col("mix_target") - at - F.col("mix_size") / 2) / F.col("mix_source_size")) + 1))).otherwise(0).cast("int")
    rows = rows.withColumns({"__at": at, "mix_row": F.concat_ws("-", "__idx", "__b", "__n")})
    rows = rows.withColumn("mix_copy", F.explode_outer(F.when(copies > 0, F.sequence(F.lit(0), copies - 1))))
    middle = F.col("mix_copy") * F.col("mix_source_size") + F.col("__at") + F.col("mix_size") / 2
    last = F.ceil(F.col("mix_target") / block_words) - 1
    rows = rows.withColumn("__block", F.when(F.col("mix_copy").isNotNull(), F.least(last, F.floor(middle / block_words))).cast("long"))
    rows = rows.join(blocks.select(F.col("idx").alias("i4"), F.col("block").alias("b4"), F.col("shard").alias("mix_shard")), (F.col("__idx") == F.col("i4")) & (F.col("__block") == F.col("b4")), "left")
    rows = rows.withColumn("mix_order", F.when(F.col("mix_copy").isNotNull(), F.xxhash64(F.lit(seed + 1), F.col(doc_id), "mix_row", "mix_copy")))
    return rows.select(*docs.columns, "mix_size", "mix_source_size", "mix_target", "mix_copy", "mix_shard", "mix_order", "mix_row")


def mix_report(docs: DataFrame, **options) -> DataFrame:
    """One row per document: size, source_size, target, taken and the shards its copies went to."""
    copies = mix(docs, **options)
    doc = copies.groupBy("mix_row").agg(*[F.first(c).alias(c) for c in ("doc_id", "mix_size", "mix_source_size", "mix_target")], F.count("mix_shard").alias("n_copies"), F.sort_array(F.collect_list("mix_shard")).alias("shards"))
    return doc.select("doc_id", F.col("mix_size").alias("size"), F.col("mix_source_size").alias("source_size"), F.col("mix_target").alias("target"), (F.col("n_copies") * F.col("mix_size")).alias("taken"), "n_copies", "shards")


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """The mix itself: docs' columns, a row for each copy, with mix_shard, mix_copy and mix_order."""
    return mix(docs, **options).filter("mix_shard is not null").select(*docs.columns, "mix_shard", "mix_copy", "mix_order")
