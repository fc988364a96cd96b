"""Toxicity by multiple-instance learning: only documents are labelled, sentences are scored.

A sentence's probability is logistic in the distinct words it holds and in their beginnings (PREFIXES characters, so
that inflected forms of a stem share evidence); a document's is the noisy-or of its sentences',
1 - prod(1 - p). The weights are fitted on document labels alone (proximal Adagrad with an L1 penalty), so the sentences
that carry a label's blame get found on the way; score() returns them as spans.

fit() uses a bounded sample of labelled rows: at most max_docs of them (6,000), the first by a hash of doc_id, of texts
up to max_bytes (64 KiB), equal texts once. Scoring reads every whole text. Null and empty texts have no sentence: score 0.
Without any labelled row, or without a positive one, every score is 0. Rows that repeat score alike. The model holds the MODEL_FEATURES commonest
features of the sample. Columns named score, offending, held_out or predicted are replaced.
"""

from __future__ import annotations

import re
from array import array
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.common import free_memory, ship, trimmed

SENTENCE = re.compile(r"[^.!?\n]+")
WORD = re.compile(r"[^\W\d_]+")
PREFIXES = (4, 5)
MODEL_FEATURES = 100_000
CACHED_WORDS = 200_000
BLOCK_HITS = 1 << 18


def features(word: str) -> list[str]:
    """The word itself, and its beginnings with a dash."""
    return [word, *(word[:k] + "-" for k in PREFIXES if len(word) > k)]


class WordWeights(dict):
    """Weight of a word: the sum over its features. Bounded; emptied when full."""

    def __init__(self, weights: dict[str, float]):
        super().__init__()
        self.weights = weights

    def __missing__(self, word: str) -> float:
        if len(self) >= CACHED_WORDS:
            self.clear()
        self[word] = found = sum(self.weights.get(f, 0.0) for f in features(word))
        return found


def held_out(doc_id: str = "doc_id"):
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 5 == 0, F.lit(False))


def sample(docs: DataFrame, labels: DataFrame, max_docs: int = 6000, max_bytes: int = 1 << 16, label: str = "toxic") -> tuple[list[str], list[int]]:
    """Texts and labels of the rows to learn from; held-out rows are left out."""
    usable = labels.select("doc_id", F.col(label).cast("int").alias("__y")).filter(F.col("__y").isNotNull() & F.col("doc_id").isNotNull() & ~held_out()).dropDuplicates(["doc_id"])
    chosen = usable.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_docs).toPandas()  # ids and labels, bounded by max_docs
    if chosen.empty:
        return [], []
    # by Arrow: a list of rows would start Python workers of another kind on the executors, which keep them beside the others
    ids = docs.sparkSession.createDataFrame(pa.table({"__id": pa.array(chosen["doc_id"].tolist(), pa.int64()), "__y": pa.array(chosen["__y"].tolist(), pa.int32())}))
    rows = docs.filter(F.octet_length("text") <= max_bytes).join(F.broadcast(ids), F.col("doc_id") == F.col("__id")).select("doc_id", "text", "__y").toArrow().to_pydict()
    seen: dict[str, int] = {}
    for _, text, y in sorted(zip(rows["doc_id"], rows["text"], rows["__y"])):
        seen.setdefault(text, y)
    return list(seen), list(seen.values())


def fit(texts: list[str], labels: list[int], l1: float = 1.0, steps: int = 200, rate: float = 0.5, min_docs: int = 5) -> tuple[float, dict[str, float]]:
    """(bias, weights by feature); features of fewer than min_docs texts have no weight."""
    if not texts or not any(labels):
        return -50.0, {}
    found: Counter = Counter()
    for t in texts:
        found.update({f for w in set(WORD.findall(t.lower())) for f in features(w)})
    words = [w for w, n in sorted(found.items(), key=lambda x: (-x[1], x[0]))[:MODEL_FEATURES] if n >= min_docs]
    del found
    at = {w: i for i, w in enumerate(words)}
    doc_of, ends, hits = array("i"), array("q", [0]), array("i")
    for d, t in enumerate(texts):
        for s in SENTENCE.findall(t.lower()):
            doc_of.append(d)
            hits.extend([i for w in sorted(set(WORD.findall(s))) for f in features(w) if (i := at.get(f)) is not None])
            ends.append(len(hits))
    doc, col, end = np.frombuffer(doc_of, np.int32), np.frombuffer(hits, np.int32), np.frombuffer(ends, np.int64)
    # sentences by blocks of some BLOCK_HITS hits: what a step makes of the hits (three times their size and more) is a block's only
    cuts = np.unique([0, *np.searchsorted(end, np.arange(0, len(col), BLOCK_HITS)), len(doc)])
    blocks = [(a, e, end[a], end[e], np.diff(end[a : e + 1])) for a, e in zip(cuts[:-1], cuts[1:])]
    n, n_s, y = len(texts), len(doc), np.array(labels, dtype=bool)
    w, g2 = np.zeros(len(words)), np.full(len(words), 1e-6)
    bias, b2 = float(np.log(max(1e-4, y.mean()) * n / max(1, n_s))), 1e-6
    for _ in range(steps):
        z = bias + np.concatenate([np.zeros(0), *(np.bincount(np.repeat(np.arange(e - a), k), w[col[i:j]], e - a) for a, e, i, j, k in blocks)])
        p = 1 / (1 + np.exp(-np.clip(z, -50, 50)))
        mass = np.bincount(doc, np.logaddexp(0, z), n)  # -log(1 - P)
        slope = np.where(y, -1 / np.maximum(np.expm1(np.minimum(mass, 50)), 1e-3), 1.0)
        gz = slope[doc] * p
        g, gb = np.zeros(len(words)), gz.sum()
        for a, e, i, j, k in blocks:
            np.add.at(g, col[i:j], np.repeat(gz[a:e], k))
        g2 += g * g
        b2 += gb * gb
        step = rate / np.sqrt(g2)
        w -= step * g
        w = np.sign(w) * np.maximum(np.abs(w) - step * l1, 0)
        bias -= rate / np.sqrt(b2) * gb
    return float(bias), {words[i]: float(w[i]) for i in np.nonzero(w)[0]}


def document_score(text: str, bias: float, weights: WordWeights) -> tuple[float, list[tuple[int, int, float]]]:
    """The noisy-or, and the sentences at 0.5 or more as (start, end, p) in code points."""
    idle, mass, spans = float(np.logaddexp(0, bias)), 0.0, []
    for m in SENTENCE.finditer(text):
        if extra := sum(map(weights.__getitem__, sorted(set(WORD.findall(m[0].lower()))))):
            z = bias + extra
            mass += float(np.logaddexp(0, z))
            if z >= 0:
                spans.append((m.start(), m.end(), float(1 / (1 + np.exp(-z)))))
        else:
            mass += idle
    return float(-np.expm1(-mass)), spans


def score(docs: DataFrame, model: tuple[float, dict[str, float]], keep_text: bool = True) -> DataFrame:
    """docs with score (double) and offending (array of start, end, p): every sentence that is itself toxic."""
    spark = docs.sparkSession
    ship(spark)
    shared = spark.sparkContext.broadcast(model)  # at most MODEL_FEATURES weights
    names = [c for c in docs.columns if c not in ("score", "offending") and (keep_text or c != "text")]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields if f.name in names) + ", score double, offending array<struct<start:bigint,end:bigint,p:double>>"
    spans_type = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("p", pa.float64())]))

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bias, weights = shared.value[0], WordWeights(shared.value[1])
        for batch in batches:
            found = [document_score(t or "", bias, weights) for t in batch.column(batch.schema.get_field_index("text")).to_pylist()]
            extra = [pa.array([s for s, _ in found], pa.float64()), pa.array([[{"start": a, "end": b, "p": p} for a, b, p in spans] for _, spans in found], spans_type)]
            yield pa.RecordBatch.from_arrays([batch.column(batch.schema.get_field_index(c)) for c in names] + extra, names=[*names, "score", "offending"])

    return docs.mapInArrow(trimmed(scored), schema)


def toxicity(docs: DataFrame, labels: DataFrame, keep_text: bool = True, max_docs: int = 6000) -> DataFrame:
    """docs with held_out, score, predicted and offending, by a model learnt from labels of rows not held out."""
    model = fit(*sample(docs, labels, max_docs))
    free_memory()
    found = score(docs, model, keep_text)
    return found.withColumns({"held_out": held_out(), "predicted": (F.col("score") >= 0.5).cast("int")})
