"""Removal of long repeated byte strings by run-compressed Burrows-Wheeler indexes.

A byte goes if a `length`-byte string that covers it also starts earlier (smaller document, or earlier in the same
one). Strings are brought together by winnowing: of the K-byte strings in any `length` bytes the one of least hash is an
anchor, so equal strings share an anchor at the same place. Each anchor travels as (anchor hash, hash of its
context, document, position), where the context is the union of the strings it is the anchor of. Packed arrays are dealt by anchor hash; an anchor whose whole context stood earlier needs no more.

What is left, distinct contexts that share an anchor, goes through an index per bucket: the contexts are put in one text,
its suffixes sorted to depth `length`, the Burrows-Wheeler transform cut into runs, and only the samples at the run heads kept: position
p, the position before it in suffix order, and the length they match. From these samples the matching statistics of all
positions are streamed in text order (between samples the match moves along and shortens by one), and linking each
position to its neighbour where `length` bytes match leads every string to its first occurrence.

Results are exact but for collisions of 96-bit hashes. Null texts count as empty. Documents are ordered by doc_id
(null last), then by a hash of the text; equal rows are one document seen twice and do not repeat each other. Rows in
a task that hold an anchor and context again are settled there, so a passage in a third of all rows is sent once a task.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm import arrays as A
from quire.llm.common import cut, free_shuffles, input_bytes, n_partitions, ship

U = np.uint64
K = 24
BUCKET_BYTES = 8 << 20
INDEX_BYTES = 1 << 20
NO_ID = np.iinfo(np.int64).max
#: Layout of a packed anchor.
ANCHOR = np.dtype([("h", "<u4"), ("c", "<u8"), ("doc", "<i8"), ("th", "<u4"), ("pos", "<i8"), ("back", "<u2"), ("ahead", "<u2")])


def sliding(x: np.ndarray, w: int, f) -> np.ndarray:
    """f over each window of w, by doubling."""
    size, out = 1, x
    while 2 * size <= w:
        out = f(out[:-size], out[size:])
        size *= 2
    return f(out[: len(out) - (w - size)], out[w - size :]) if size < w else out


def anchors(data: np.ndarray, offsets: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """(doc, start, hash, context hash, bytes of context before and from start) of the anchors of a group of texts."""
    none = tuple(np.zeros(0, np.int64) for _ in range(6))
    w = length - K + 1
    if len(data) < length:
        return none
    h = A.prefix_hash(data)
    _, down = A.powers(len(h))
    gram = A.mix((h[K:] - h[:-K]) * down[: len(h) - K])
    small = (gram >> U(32)).astype(np.uint32)
    least = sliding(small, w, np.minimum)
    padded = np.concatenate([np.zeros(w - 1, np.uint32), least, np.zeros(w - 1, np.uint32)])
    chosen = np.nonzero(sliding(padded, w, np.maximum) == small)[0]
    # The windows an anchor is the least of are a run of equal minima; find each anchor's run among the few it can be in.
    opens = np.nonzero(np.append(True, least[1:] != least[:-1]))[0]
    closes, value = np.append(opens[1:], len(least)) - 1, least[opens]
    run = np.searchsorted(closes, chosen - (w - 1))
    own = small[chosen]
    while True:
        wrong = value[run] != own
        if not wrong.any():
            break
        run[wrong] += 1
    doc = np.searchsorted(offsets, chosen, "right") - 1
    first, end = offsets[doc], offsets[doc + 1]
    a = np.maximum(np.maximum(opens[run], chosen - (w - 1)), first)
    b = np.minimum(np.minimum(closes[run], chosen), end - length) + length
    fits = b - a >= length
    chosen, doc, first, a, b = chosen[fits], doc[fits], first[fits], a[fits], b[fits]
    return doc, chosen - first, gram[chosen], A.span_hash(h, a, b), chosen - a, b - chosen


def first_of_equal(order_keys: tuple[np.ndarray, ...], same: tuple[np.ndarray, ...]) -> tuple[np.ndarray, np.ndarray]:
    """Sort by same, then order_keys. (order, whether each row, in that order, opens its group)."""
    order = np.lexsort((*reversed(order_keys), *reversed(same)))
    opens = np.ones(len(order), bool)
    if len(order):
        opens[1:] = np.logical_or.reduce([s[order][1:] != s[order][:-1] for s in same])
    return order, opens


def covered(rows: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Bytes [lo, hi) of the strings an anchor's whole context holds: from `back` before it on, where `length` bytes fit."""
    return rows["pos"] - rows["back"], rows["pos"] + rows["ahead"]


def settle(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(rows that open their (anchor, context) group, rows whose context stood in an earlier place)."""
    order, opens = first_of_equal((rows["doc"], rows["th"], rows["pos"]), (rows["h"], rows["c"]))
    rows = rows[order]
    group = np.cumsum(opens) - 1
    head = rows[np.nonzero(opens)[0]][group] if len(rows) else rows
    again = ~opens & ((rows["doc"] != head["doc"]) | (rows["th"] != head["th"]) | (rows["pos"] != head["pos"]))
    return rows[opens], rows[again]


def spans_batch(kind: int, rows: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> pd.DataFrame:
    return pd.DataFrame({"kind": np.full(len(rows), kind, np.int32), "doc": rows["doc"].astype(np.int64), "th": rows["th"].astype(np.int64), "lo": lo.astype(np.int64), "hi": hi.astype(np.int64), "pos": rows["pos"].astype(np.int64), "h": rows["h"].astype(np.int64)})


SPANS = "kind int, doc long, th long, lo long, hi long, pos long, h long"


def bucket_function(length: int):
    def compare(frame: pd.DataFrame) -> pd.DataFrame:
        """kind 0: bytes to remove. kind 1: contexts to index, as they share an anchor with other ones."""
        rows = np.frombuffer(b"".join(frame.loc[frame["kind"] == 0, "payload"]), ANCHOR)
        done = np.frombuffer(b"".join(frame.loc[frame["kind"] == 1, "payload"]), ANCHOR)
        heads, again = settle(rows)
        done = np.concatenate([done, again])
        heads = heads[np.argsort(heads["h"], kind="stable")]
        n = np.diff(np.append(np.nonzero(np.append(True, heads["h"][1:] != heads["h"][:-1]))[0], len(heads))) if len(heads) else np.zeros(0, int)
        open_ = heads[np.repeat(n, n) > 1] if len(heads) else heads
        lo, hi = covered(done, length)
        order = np.lexsort((lo, done["th"], done["doc"]))
        return pd.concat([spans_batch(0, done[order], lo[order], hi[order]), spans_batch(1, open_, *covered(open_, length))])

    return compare


# -- The run-compressed index -----------------------------------------------------------------------------------------


def rank_of(keys: np.ndarray) -> np.ndarray:
    order = np.argsort(keys)
    k = keys[order]
    rank = np.empty(len(keys), np.int32)
    rank[order] = np.cumsum(np.append(0, (k[1:] != k[:-1]).astype(np.int32)))
    return rank


def suffix_order(text: np.ndarray) -> tuple[np.ndarray, list[tuple[int, np.ndarray]]]:
    """Suffix array by prefix doubling, and the ranks by prefix length; text holds symbols 1 to 256, 0 ends a context."""
    n = len(text)
    step = 7
    padded = np.append(text + 1, np.zeros(step, text.dtype)).astype(U)
    keys = np.zeros(n, U)
    for i in range(step):
        keys = (keys << U(9)) | padded[i : i + n]
    ranks = [(step, rank_of(keys))]
    while ranks[-1][1].max(initial=0) < n - 1:
        r = ranks[-1][1]
        nxt = np.zeros(n, U)
        nxt[: max(0, n - step)] = r[step:].astype(U) + U(1)
        ranks.append((2 * step, rank_of((r.astype(U) << U(32)) | nxt)))
        step *= 2
    order = np.empty(n, np.int64)
    order[ranks[-1][1]] = np.arange(n)
    return order, ranks


def match_length(ranks: list[tuple[int, np.ndarray]], a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Common prefix length of suffixes a and b, but for fewer symbols than the shortest ranked prefix has."""
    n = len(ranks[0][1])
    out = np.zeros(len(a), np.int64)
    for step, r in reversed(ranks):
        x, y = np.minimum(a + out, n - 1), np.minimum(b + out, n - 1)
        out[(a + out < n) & (b + out < n) & (r[x] == r[y])] += step
    return out


class RunIndex:
    """Samples at the run heads of a text's Burrows-Wheeler transform: position, its predecessor in suffix order, their match."""

    def __init__(self, text: np.ndarray):
        order, ranks = suffix_order(text)
        before = text[order - 1]  # the transform; suffix 0 is preceded by the last symbol, an end mark
        heads = np.append(True, before[1:] != before[:-1])
        self.n, self.n_runs = len(text), int(heads.sum())
        heads[1:] |= (order[1:] == 0) | (order[:-1] == 0)  # the text's ends do not move along
        at = np.nonzero(heads)[0]
        pos = order[at]
        prior = np.where(at > 0, order[at - 1], -1)
        match = np.zeros(len(at), np.int64)
        inner = at > 0
        match[inner] = self._common(text, ranks, pos[inner], prior[inner])
        by_place = np.argsort(pos)
        self.pos, self.prior, self.match = pos[by_place], prior[by_place], match[by_place]

    @staticmethod
    def _common(text: np.ndarray, ranks: list[tuple[int, np.ndarray]], a: np.ndarray, b: np.ndarray) -> np.ndarray:
        out, n = match_length(ranks, a, b), len(text)
        for _ in range(ranks[0][0] - 1):
            x, y = np.minimum(a + out, n - 1), np.minimum(b + out, n - 1)
            out += (a + out < n) & (b + out < n) & (text[x] == text[y])
        return out

    def statistics(self) -> tuple[np.ndarray, np.ndarray]:
        """For every text position: its predecessor in suffix order (or -1) and how far they match, streamed from the samples."""
        where = np.arange(self.n)
        s = np.searchsorted(self.pos, where, "right") - 1
        moved = where - self.pos[s]
        prior = np.where(self.prior[s] >= 0, self.prior[s] + moved, -1)
        return prior, np.maximum(self.match[s] - moved, 0)


def index_function(length: int):
    def mark(frame: pd.DataFrame) -> pd.DataFrame:
        """Bytes to remove in the contexts of one bucket."""
        frame = frame.sort_values(["doc", "th", "pos"], ignore_index=True)
        context = frame["context"].tolist()
        sizes = np.array([len(c) for c in context], np.int64)
        first = np.concatenate([[0], np.cumsum(sizes + 1)])[:-1]
        raw = np.frombuffer(b"\0".join(context) + b"\0", np.uint8).astype(np.uint16) + 1
        raw[first + sizes] = 0
        prior, match = RunIndex(raw).statistics()
        n = len(raw)
        root = np.where(match >= length, prior, np.arange(n))
        while not np.array_equal(further := root[root], root):
            root = further
        # Places of a string are chained to one root; the least of them in document order stays.
        d, t, lo = frame["doc"].to_numpy(), frame["th"].to_numpy(), frame["lo"].to_numpy()
        new_doc = np.append(False, (d[1:] != d[:-1]) | (t[1:] != t[:-1]))
        owner = np.repeat(np.arange(len(sizes)), sizes + 1)
        key = (np.cumsum(new_doc)[owner] << 40) + lo[owner] + np.arange(n) - first[owner]
        least = np.full(n, np.iinfo(np.int64).max)
        np.minimum.at(least, root, key)
        starts = np.nonzero((key > least[root]) & (np.arange(n) + length <= (first + sizes)[owner]))[0]
        own, place = owner[starts], lo[owner[starts]] + starts - first[owner[starts]]
        opens = np.ones(len(place), bool)
        if len(place):
            opens[1:] = (own[1:] != own[:-1]) | (place[1:] != place[:-1] + 1)
        at = np.nonzero(opens)[0]
        ends = np.append(at[1:], len(place)) - 1
        return pd.DataFrame({"doc": d[own[at]], "th": t[own[at]], "lo": place[at], "hi": place[ends] + length}).astype({"doc": "int64", "th": "int64"})

    return mark


def removed_spans(docs: DataFrame, length: int = 100) -> DataFrame:
    """(doc, th, lo, hi): byte ranges to remove, overlapping. docs: doc (never null), th, text."""
    spark = docs.sparkSession
    size = input_bytes(docs)
    if size >= 1 << 50:  # no estimate for what docs derives from
        size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = max(n_partitions(spark), math.ceil(2 * size / BUCKET_BYTES))

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []

        def flush() -> pa.RecordBatch:
            heads, again = settle(np.concatenate(held))
            held.clear()
            out = []
            for kind, rows in ((0, heads), (1, again)):
                rows = rows[np.lexsort((rows["pos"], rows["th"], rows["doc"]))]
                where = rows["h"] % buckets
                order = np.argsort(where, kind="stable")
                cuts = np.searchsorted(where[order], np.arange(buckets + 1))
                out += [(int(b), kind, rows[order[cuts[b] : cuts[b + 1]]].tobytes()) for b in np.nonzero(np.diff(cuts))[0]]
            return pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], t) for i, t in enumerate((pa.int32(), pa.int32(), pa.binary()))], names=["bucket", "kind", "payload"])

        for batch in batches:
            doc, th = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            for first, end, data, offsets in A.groups(batch.column(2)):
                d, pos, h, c, back, ahead = anchors(data, offsets, length)
                rows = np.empty(len(d), ANCHOR)
                rows["h"], rows["c"], rows["pos"], rows["back"], rows["ahead"] = h.astype(U) & U(0xFFFFFFFF), A.mix(c.astype(U) + A.mix(h.astype(U) + back.astype(U))), pos, back, ahead
                rows["doc"], rows["th"] = doc[first:end][d], th[first:end][d]
                held.append(rows)
                if sum(map(len, held)) > 600_000:
                    yield flush()
        if held and sum(map(len, held)):
            yield flush()

    met = cut(docs.select("doc", "th", "text").mapInArrow(found, "bucket int, kind int, payload binary").groupBy("bucket").applyInPandas(bucket_function(length), SPANS))
    free_shuffles(spark)
    asked = met.filter("kind = 1").groupBy("doc", "th").agg(F.collect_list(F.struct("lo", "hi", "pos", "h")).alias("asked"))
    wanted = docs.join(asked.withColumnsRenamed({"doc": "__doc", "th": "__th"}), (F.col("doc") == F.col("__doc")) & (F.col("th") == F.col("__th"))).dropDuplicates(["doc", "th"])
    to_index = met.filter("kind = 1").agg(F.sum(F.col("hi") - F.col("lo"))).first()[0] or 0
    parts = max(n_partitions(spark), math.ceil(to_index / INDEX_BYTES))
    contexts = wanted.select("doc", "th", F.encode("text", "UTF-8").alias("raw"), F.explode("asked").alias("a"))
    contexts = contexts.select("doc", "th", "a.lo", "a.hi", "a.pos", F.expr("substring(raw, int(a.lo + 1), int(a.hi - a.lo))").alias("context"), (F.col("a.h") % parts).alias("bucket"))
    indexed = contexts.groupBy("bucket").applyInPandas(index_function(length), "doc long, th long, lo long, hi long")
    return met.filter("kind = 0").select("doc", "th", "lo", "hi").union(indexed)


def remove_repeats(docs: DataFrame, length: int = 100) -> DataFrame:
    """doc_id, n_bytes, n_removed, spans (array of lo, hi; maximal, in order), kept (binary), a row for each row of docs."""
    ship(docs.sparkSession)
    text = F.coalesce(F.col("text"), F.lit(""))
    keyed = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("doc"), F.xxhash64(text).bitwiseAND(F.lit(0xFFFFFFFF)).alias("th"), text.alias("text"), F.col("doc_id"))
    spans = cut(removed_spans(keyed, length))
    free_shuffles(docs.sparkSession)
    by_doc = spans.groupBy("doc", "th").agg(F.collect_list(F.struct("lo", "hi")).alias("found")).withColumnsRenamed({"doc": "__doc", "th": "__th"})
    joined = keyed.join(by_doc.hint("shuffle_hash"), (F.col("doc") == F.col("__doc")) & (F.col("th") == F.col("__th")), "left").select("doc_id", "text", F.col("found.lo").alias("lo"), F.col("found.hi").alias("hi"))

    def cut_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.int64(), pa.list_(pa.struct([("lo", pa.int64()), ("hi", pa.int64())])), pa.binary(), pa.string()]
        for batch in batches:
            out: list[list] = [[] for _ in range(4)]
            for t, lo, hi in zip(batch.column(1).cast(pa.binary()).to_pylist(), batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                merged: list[list[int]] = []
                for a, b in sorted(zip(lo or (), hi or ())):
                    if merged and a <= merged[-1][1]:
                        merged[-1][1] = max(b, merged[-1][1])
                    else:
                        merged.append([a, b])
                edges = [0, *(x for m in merged for x in m), len(t)]
                kept = b"".join(t[a:b] for a, b in zip(edges[::2], edges[1::2]))
                for o, v in zip(out, (len(t), [{"lo": a, "hi": b} for a, b in merged], kept, hashlib.sha256(kept).hexdigest())):
                    o.append(v)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(o, k) for o, k in zip(out, kinds))], names=["doc_id", "n_bytes", "spans", "kept", "kept_sha256"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return joined.mapInArrow(cut_out, f"doc_id {kind}, n_bytes long, spans array<struct<lo:bigint,hi:bigint>>, kept binary, kept_sha256 string")
