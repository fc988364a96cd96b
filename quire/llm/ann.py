"""Approximate nearest neighbours by learned partitions.

fit() takes a bounded sample of the vectors (at most sample_size, the least by a hash of their id), builds its neighbour graph,
and bisects the graph again and again: each part is split at the median of a smoothed random signal over the
graph (a power iteration towards its Fiedler vector), then improved by swaps that keep the halves equal. A small network
with one hidden layer learns where a vector's sampled neighbours lie. Every row is indexed: it goes to the part the network
finds most probable. A query visits its most probable parts until the sample says that `recall` of the neighbours are
reached; all rows there are scored exactly, in double precision.

Parts are dealt out in blocks of BLOCK_ROWS rows and BLOCK_QUERIES queries, so that neither a part that holds a third of all
rows nor many queries to one part is a single task's work; per block only the best k a query go on.

Vectors that are null, zero, of another length than most of the sample's, or hold null or non-finite components take no part. A query's
own id is no candidate; rows without an id take no part. Rows that repeat an id are one candidate, or one query, by the nearest of its vectors.
Ties of the double-precision scores go to the smaller id. An empty table has no neighbours.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.llm.common import cut, ship

BLOCK_ROWS = 8192
BLOCK_QUERIES = 2048
PART_ROWS = 128  # of the sample
MAX_PARTS = 64
NEIGHBOURS = 10


class Router:
    """Weights of the network, the vectors' length, and how many parts a query visits."""

    def __init__(self, dim: int, parts: int):
        rng = np.random.default_rng(11)
        self.dim, self.parts, self.visits = dim, parts, parts
        self.w1, self.b1 = rng.normal(0, np.sqrt(2 / max(1, dim)), (dim, 128)), np.zeros(128)
        self.w2, self.b2 = rng.normal(0, np.sqrt(1 / 128), (128, parts)), np.zeros(parts)

    def logits(self, x: np.ndarray) -> np.ndarray:
        return np.maximum(x @ self.w1 + self.b1, 0) @ self.w2 + self.b2

    def train(self, x: np.ndarray, goal: np.ndarray, epochs: int = 40, rate: float = 3e-3) -> None:
        rng, names = np.random.default_rng(12), ("w1", "b1", "w2", "b2")
        m, v, t = dict.fromkeys(names, 0.0), dict.fromkeys(names, 0.0), 0
        for _ in range(epochs):
            for at in np.array_split(rng.permutation(len(x)), max(1, len(x) // 256)):
                t += 1
                h = np.maximum(x[at] @ self.w1 + self.b1, 0)
                z = h @ self.w2 + self.b2
                z = np.exp(z - z.max(1, keepdims=True))
                dz = (z / z.sum(1, keepdims=True) - goal[at]) / len(at)
                dh = (dz @ self.w2.T) * (h > 0)
                for k, g in zip(names, (x[at].T @ dh, dh.sum(0), h.T @ dz, dz.sum(0))):
                    m[k] = 0.9 * m[k] + 0.1 * g
                    v[k] = 0.999 * v[k] + 0.001 * g * g
                    setattr(self, k, getattr(self, k) - rate * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.999**t)) + 1e-8))


def usable(vector: Column) -> Column:
    """Present, without null or non-finite components, and not zero."""
    d = vector.cast("array<double>")
    fine = F.forall(d, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(fine & F.exists(d, lambda x: x != 0), F.lit(False))


def neighbours(x: np.ndarray, k: int) -> np.ndarray:
    out = []
    for at in range(0, len(x), 512):
        s = x[at : at + 512] @ x.T
        s[np.arange(len(s)), at + np.arange(len(s))] = -2
        out.append(np.argpartition(-s, min(k, len(x) - 1) - 1, axis=1)[:, :k])
    return np.concatenate(out)


def bisect(nodes: np.ndarray, near: np.ndarray, rng: np.random.Generator) -> tuple[np.ndarray, np.ndarray]:
    """Two halves of the nodes with few graph edges between them."""
    at = np.full(len(near), -1)
    at[nodes] = np.arange(len(nodes))
    own = at[near[nodes]]
    inside = own >= 0
    degree = np.maximum(1, inside.sum(1) + np.bincount(own[inside], minlength=len(nodes)))
    row = np.repeat(np.arange(len(nodes)), own.shape[1])[inside.ravel()]
    col = own[inside]
    signal = rng.normal(size=len(nodes))
    for _ in range(60):
        spread = np.bincount(row, signal[col], len(nodes)) + np.bincount(col, signal[row], len(nodes))
        signal = 0.5 * signal + 0.5 * spread / degree
        signal -= np.average(signal, weights=degree)
        signal /= max(1e-12, np.abs(signal).max())
    right = np.zeros(len(nodes), bool)
    right[np.argsort(signal, kind="stable")[len(nodes) // 2 :]] = True
    for _ in range(5):
        side = np.where(right, 1.0, -1.0)
        pull = (np.bincount(row, side[col], len(nodes)) + np.bincount(col, side[row], len(nodes))) * side  # negative: better off there
        a, b = (x[np.argsort(pull[x], kind="stable")][: max(1, len(nodes) // 50)] for x in (np.nonzero(right)[0], np.nonzero(~right)[0]))
        m = min(len(a), len(b))
        good = pull[a[:m]] + pull[b[:m]] < 0
        if not good.any():
            break
        right[a[:m][good]], right[b[:m][good]] = False, True
    return nodes[~right], nodes[right]


def balanced_parts(near: np.ndarray, parts: int) -> np.ndarray:
    rng, found = np.random.default_rng(13), [np.arange(len(near))]
    while len(found) < parts:
        found = [half for nodes in found for half in bisect(nodes, near, rng)]
    label = np.zeros(len(near), int)
    for i, nodes in enumerate(found):
        label[nodes] = i
    return label


def fit(vectors: list[list[float]], recall: float = 0.97, k: int = 5) -> Router:
    if not vectors:
        return Router(0, 1)
    dim = Counter(map(len, vectors)).most_common(1)[0][0]
    x = np.array([v for v in vectors if len(v) == dim], float).reshape(-1, dim)
    x /= np.maximum(1e-300, np.sqrt((x * x).sum(1, keepdims=True)))
    parts = 1
    while parts < MAX_PARTS and len(x) // (2 * parts) >= PART_ROWS:
        parts *= 2
    router = Router(dim, parts)
    if parts == 1:
        return router
    near = neighbours(x, NEIGHBOURS)
    label = balanced_parts(near, parts)
    goal = np.eye(parts)[label] + np.eye(parts)[label[near]].sum(1)
    router.train(x, goal / goal.sum(1, keepdims=True))
    z = router.logits(x)
    home, ranked = z.argmax(1), np.argsort(-z, axis=1, kind="stable")
    rank = np.argsort(ranked, axis=1)
    seen = rank[np.arange(len(x))[:, None], home[neighbours(x, k)]]
    share = np.array([(seen < m).mean() for m in range(1, parts + 1)])
    router.visits = int(np.argmax(share >= recall)) + 1
    return router


def sample(vectors: DataFrame, id_col: str, vector_col: str, size: int) -> list[list[float]]:
    rows = vectors.filter(usable(F.col(vector_col))).select(id_col, F.col(vector_col).cast("array<double>").alias("v")).orderBy(F.xxhash64(id_col), id_col).limit(size)
    return rows.select("v").toArrow().column("v").to_pylist()


def place(vectors: DataFrame, router: Router, id_col: str, vector_col: str) -> DataFrame:
    """id, v (double) and parts: all parts, most probable first. Rows that take no part are gone."""
    shared = vectors.sparkSession.sparkContext.broadcast(router)
    rows = vectors.filter(usable(F.col(vector_col)) & (F.size(vector_col) == router.dim) & F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v"))

    def routed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        router = shared.value
        for batch in batches:
            x = batch.column(1).flatten().to_numpy().reshape(len(batch), -1)
            z = router.logits(x / np.sqrt((x * x).sum(1, keepdims=True)))
            order = np.argsort(-z, axis=1, kind="stable").astype(np.int32)
            parts = pa.ListArray.from_arrays(pa.array(np.arange(0, order.size + 1, order.shape[1]), pa.int32()), pa.array(order.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), parts], names=["id", "v", "parts"])

    return rows.mapInArrow(routed, "id long, v array<double>, parts array<int>")


def scorer(k: int):
    def best(rows: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        """The k nearest rows of a block for each query; every score is the same sum in the same order."""
        out = {"query_id": [], "vec_id": [], "score": []}
        if len(rows) and len(queries):
            ids, b = rows["id"].to_numpy(), np.array(rows["v"].tolist())
            nb = np.sqrt((b * b).sum(1))
            unit, spare = b / nb[:, None], len(ids) - len(np.unique(ids))
            for q_id, q in zip(queries["id"], queries["v"]):
                nq = np.sqrt((q * q).sum())
                rough = unit @ (q / nq)
                rough[ids == q_id] = -np.inf
                n = min(k + spare, int(np.isfinite(rough).sum()))
                if not n:
                    continue
                at = np.nonzero(rough >= np.partition(rough, len(rough) - n)[len(rough) - n] - 1e-9)[0]
                exact = (b[at] * q).sum(1) / (nb[at] * nq)
                first = np.lexsort((ids[at], -exact))
                if spare:  # of rows that repeat an id the nearest
                    first = first[np.sort(np.unique(ids[at][first], return_index=True)[1])]
                first = first[:k]
                out["query_id"] += [q_id] * len(first)
                out["vec_id"] += ids[at][first].tolist()
                out["score"] += exact[first].tolist()
        return pd.DataFrame(out).astype({"query_id": "int64", "vec_id": "int64", "score": "float64"})

    return best


def search(vectors: DataFrame, queries: DataFrame, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding", sample_size: int = 4096, recall: float = 0.97) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest (largest cosine) rows of vectors found for each row of queries."""
    spark = vectors.sparkSession
    ship(spark)
    router = fit(sample(vectors, id_col, vector_col, sample_size), recall, k)
    placed = cut(place(vectors, router, id_col, vector_col).withColumn("part", F.element_at("parts", 1)))
    asked = place(queries, router, id_col, vector_col)
    counts = {r["part"]: r["n"] for r in placed.groupBy("part").agg(F.count("*").alias("n")).collect()}  # a row a part
    n_blocks = F.array(*[F.lit(max(1, -(-counts.get(p, 0) // BLOCK_ROWS))) for p in range(router.parts)])
    rows_in = F.array(*[F.lit(counts.get(p, 0)).cast("long") for p in range(router.parts)])
    # parts in order until both the number of visits and twice k rows are reached
    before = lambda i: F.aggregate(F.slice("parts", 1, i), F.lit(0).cast("long"), lambda t, p: t + F.get(rows_in, p))
    visited = F.filter(F.col("parts"), lambda p, i: (i < router.visits) | (before(i) < 2 * k + 2))
    asked = cut(asked.select("id", "v", F.explode(visited).alias("part")))
    loads = asked.groupBy("part").agg(F.count("*").alias("n")).collect()  # a row a part
    q_blocks = {r["part"]: max(1, -(-r["n"] // BLOCK_QUERIES)) for r in loads}
    n_q = F.array(*[F.lit(q_blocks.get(p, 1)) for p in range(router.parts)])
    left = placed.select("id", "v", "part", F.pmod(F.xxhash64("id"), F.get(n_blocks, F.col("part"))).cast("int").alias("block"), F.explode(F.sequence(F.lit(0), F.get(n_q, F.col("part")) - 1)).alias("q_block"))
    right = asked.select("id", "v", "part", F.explode(F.sequence(F.lit(0), F.get(n_blocks, F.col("part")) - 1)).alias("block"), F.pmod(F.xxhash64(F.lit(1), "id"), F.get(n_q, F.col("part"))).cast("int").alias("q_block"))
    keys = ("part", "block", "q_block")
    near = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(scorer(k), "query_id long, vec_id long, score double")
    near = near.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return near.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
