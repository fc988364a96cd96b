"""N-gram Jaccard join by parity sketches, without losing a link.

A document's set is its distinct 5-word shingles. Its parity sketch has one bit per possible shingle hash, flipped by each
member, so the Hamming distance of two sketches is at most the sets' symmetric difference; at similarity 0.75 that is
at most D = (|A| + |B|) / 7. Sizes fall into bands [2^i, 2^(i+1)); a band cuts the sketch into 2^i segments, and a set is
joined in its own band and, if a partner can be smaller than 2^i, in the band below. D differing bits spoil at
most D segments, so two similar sets share one of the first D + 1 non-zero segments of either (kept as XOR fingerprints).
Shingles frequent in the corpus (a bounded list, found by map-side counts over all documents) stay out of the segments; a set
left with D or fewer non-zero segments in either band also joins by the |A| - ceil(0.75 |A|) + 1 first of its shingles, rare ones first, which
any similar set that is in the same position shares. Candidates are checked on parity sketches of more bits than the set has members, then on
the sets. A sketch folds to half its bits by XOR, so that sets of neighbouring bands compare.

Equal sets are one class from the start, so groups of exact copies never meet pairwise. In a group of more than GROUP
classes, each is first tried with the next in an order that differs from group to group, in every SPARSE-th group; each candidate of a small
group is tried with one other. Then all pairs of candidates, and of members of a large group, that are still in different components are
verified. Pairs within a component need no verifying, as the result is components. Signatures travel as packed arrays, a few rows per task.

No key is one task's work: a signature that more than LOCAL_GROUP classes of a flush hold goes out as members at once, dealt by flush (a mark
tells its bucket, so that the others it has there become members too); members are chained in blocks, and joined with their group by salts. Sets to verify are found by a bitmap of bounded size, so that texts are never shuffled.

Null and empty texts have no set and are linked with nothing; a text of fewer than five words is one shingle. Rows
without a doc_id are linked with nothing and have a null component. Rows that repeat a doc_id are documents of their own
with that id.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quire.llm import arrays as A
from quire.llm.common import cut, cut_dealt, free_shuffles, n_partitions, partitions, planned_once, ship, trimmed, trimmed_group
from quire.llm.components import components

U = np.uint64
SHINGLE = 5
GROUP = 8
#: Classes of a flush that make a signature hot there; members to a chain; parts that a group is dealt to in joins; members to a part of a group
#: that meets those outside its main component.
LOCAL_GROUP, BLOCK, SALTS, PART = 64, 1024, 32, 4096
#: Every SPARSE-th large group is chained.
SPARSE = 2
#: A size class: sizes whose ratio may be 4/3 are SIZE_APART classes apart at most.
SIZE_STEP, SIZE_APART = 1.05, 7
HOT_LOCAL, HOT_TOTAL, HOT_MOST = 2, 16, 1 << 19
HOT_BITS = 24
BUCKET_BYTES = 8 << 20
#: Partitions at least for the joins of classes and pairs.
LEAST_PARTS = 12
#: Bits to a class in the bitmap of those to verify, and bits at most (32 MiB): beyond that it lets more of the others pass.
BITMAP_RATE, BITMAP_BITS = 16, 1 << 28
SALT_SEGMENT, SALT_VALUE, SALT_ORDER, SALT_RARE = (U(x) for x in (0x1D8E4E27C47D124F, 0xEB44ACCAB455D165, 0x2545F4914F6CDD1D, 0x6C62272E07BB0142))


def sets(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(doc, hash), sorted, each once: the shingle sets of the texts of a group."""
    _, _, doc, h = A.word_hashes(data, offsets)
    k = SHINGLE
    mult = [U(pow(A.BASE, i + 1, 2**64)) for i in range(k)]
    parts_d, parts_h = [], []
    if len(h) >= k:
        whole = doc[: len(h) - k + 1] == doc[k - 1 :]
        s = np.zeros(len(h) - k + 1, U)
        for i in range(k):
            s += h[i : len(h) - k + 1 + i] * mult[i]
        parts_d.append(doc[: len(s)][whole])
        parts_h.append(A.mix(s[whole] + U(k)))
    if len(h):
        n = np.bincount(doc, minlength=len(offsets) - 1)
        first = np.concatenate([[0], np.cumsum(n)])[:-1]
        short = n[doc] < k
        if short.any():
            d, at = doc[short], np.nonzero(short)[0]
            terms = h[at] * np.array(mult, U)[at - first[d]]
            ids, starts = np.unique(d, return_index=True)
            parts_d.append(ids)
            parts_h.append(A.mix(np.add.reduceat(terms, starts) + n[ids].astype(U)))
    if not parts_d:
        return np.zeros(0, np.int64), np.zeros(0, U)
    d, s = np.concatenate(parts_d), np.concatenate(parts_h)
    order = np.lexsort((s, d))
    d, s = d[order], s[order]
    keep = np.ones(len(d), bool)
    keep[1:] = (d[1:] != d[:-1]) | (s[1:] != s[:-1])
    return d[keep], s[keep]


def classes(d: np.ndarray, s: np.ndarray, n_docs: int) -> tuple[np.ndarray, np.ndarray]:
    """(set size, class) per document: equal sets have equal classes; class 0 is the empty set."""
    n = np.bincount(d, minlength=n_docs)
    out = np.zeros(n_docs, U)
    full = np.nonzero(n)[0]
    if len(full):
        starts = np.searchsorted(d, full)
        total, parity = np.add.reduceat(A.mix(s + SALT_VALUE), starts), np.bitwise_xor.reduceat(A.mix(s ^ SALT_ORDER), starts)
        out[full] = A.mix(total ^ A.mix(parity + n[full].astype(U))) | U(1)
    return n, out


def bands(n: np.ndarray) -> np.ndarray:
    """i with 2**i <= n < 2**(i+1); 0 for empty sets."""
    return np.frexp(np.maximum(n, 1).astype(np.float64))[1].astype(np.int64) - 1


def sketches(d: np.ndarray, s: np.ndarray, n: np.ndarray) -> pa.ListArray:
    """Parity sketches: for a set of n members the power of two above n in bits, 64 at least, as 64-bit words."""
    bits = np.maximum(64, 2 << bands(n))
    start = np.concatenate([[0], np.cumsum(bits)])
    odd = np.bincount(start[d] + (s & (bits[d] - 1).astype(U)).astype(np.int64), minlength=start[-1]) & 1
    return pa.ListArray.from_arrays(pa.array(start // 64, pa.int32()), pa.array(np.packbits(odd.astype(np.uint8)).view(np.int64)))


@trimmed
def survey(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per document its id, size, class and sketch; per task the shingles that many of its classes hold."""
    schema = pa.schema([("doc_id", pa.int64()), ("th", pa.int64()), ("n", pa.int64()), ("class", pa.int64()), ("sketch", pa.list_(pa.int64())), ("shingle", pa.int64()), ("seen", pa.int64())])
    held: list[tuple[np.ndarray, np.ndarray]] = []
    size = 0
    known: set[int] = set()

    def merged() -> tuple[np.ndarray, np.ndarray]:
        h, c = np.concatenate([x for x, _ in held]), np.concatenate([x for _, x in held])
        u, at = np.unique(h, return_inverse=True)
        return u, np.bincount(at, c, len(u)).astype(np.int64)

    for batch in batches:
        ids, ths = batch.column(0), batch.column(2)
        for first, end, data, offsets in A.groups(batch.column(1)):
            d, s = sets(data, offsets)
            n, cls = classes(d, s, end - first)
            yield pa.RecordBatch.from_arrays([ids.slice(first, end - first), ths.slice(first, end - first), pa.array(n), pa.array(A.signed(cls)), sketches(d, s, n), pa.nulls(end - first, pa.int64()), pa.nulls(end - first, pa.int64())], schema=schema)
            fresh = np.zeros(end - first, bool)
            u, at = np.unique(cls, return_index=True)
            fresh[[i for c, i in zip(u.tolist(), at.tolist()) if c not in known]] = True
            if len(known) < 200_000:
                known.update(u.tolist())
            u, c = np.unique(s[fresh[d]], return_counts=True)
            held.append((u[c > 1], c[c > 1]))
            size += int((c > 1).sum())
            if size > 1_000_000:
                held = [merged()]
                size = 0
    if held:
        u, c = merged()
        u, c = u[c >= HOT_LOCAL], c[c >= HOT_LOCAL]
        nil = pa.nulls(len(u), pa.int64())
        yield pa.RecordBatch.from_arrays([nil, nil, nil, nil, pa.nulls(len(u), pa.list_(pa.int64())), pa.array(A.signed(u)), pa.array(c)], schema=schema)


def nonzero_segments(d: np.ndarray, s: np.ndarray, segments: np.ndarray, most: np.ndarray, band: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(doc, fingerprint) of the first most[doc] non-zero segments, and the number of non-zero segments per document."""
    seg = A.mix(s ^ SALT_SEGMENT ^ band[d].astype(U)) % segments[d].astype(U)
    order = np.lexsort((seg, d))
    d, seg, v = d[order], seg[order], A.mix(s[order] + SALT_VALUE)
    opens = np.ones(len(d), bool)
    opens[1:] = (d[1:] != d[:-1]) | (seg[1:] != seg[:-1])
    at = np.nonzero(opens)[0]
    value = np.bitwise_xor.reduceat(v, at) if len(at) else np.zeros(0, U)
    d, seg = d[at], seg[at]
    n = np.bincount(d, minlength=len(segments))
    rank = np.arange(len(d)) - np.concatenate([[0], np.cumsum(n)])[d]
    keep = rank < most[d]
    return d[keep], A.mix(value[keep] ^ A.mix(seg[keep] + (band[d[keep]].astype(U) << U(40)))), n


def signatures(d: np.ndarray, s: np.ndarray, n: np.ndarray, hot: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(doc, signature) of documents with a set; hot: whether each shingle is among the frequent ones."""
    size = np.maximum(n, 1)
    band = bands(n)
    low = 1 << band
    most = (size + 4 * size // 3) // 7 + 1
    cool_d, cool_s = d[~hot], s[~hot]
    d1, v1, filled = nonzero_segments(cool_d, cool_s, low, most, band)
    out_d, out_v = [d1], [v1]
    below = (3 * size < 4 * low) & (band > 0)
    pick = below[cool_d]
    most_below = (size + low - 1) // 7 + 1
    d2, v2, filled_below = nonzero_segments(cool_d[pick], cool_s[pick], np.maximum(low // 2, 1), most_below, band - 1)
    out_d.append(d2)
    out_v.append(v2)
    # in either band: a partner that is poor there is met by shingles only
    poor = ((filled < most) | (below & (filled_below < most_below))) & (n > 0)
    pick = poor[d]
    if pick.any():
        d3, s3, h3 = d[pick], s[pick], hot[pick]
        key = A.mix(s3 ^ SALT_ORDER)
        order = np.lexsort((key, h3, d3))
        d3, s3 = d3[order], s3[order]
        m = np.bincount(d3, minlength=len(n))
        rank = np.arange(len(d3)) - np.concatenate([[0], np.cumsum(m)])[d3]
        keep = rank < (n - (3 * n + 3) // 4 + 1)[d3]
        out_d.append(d3[keep])
        out_v.append(A.mix(s3[keep] ^ SALT_RARE))
    return np.concatenate(out_d), np.concatenate(out_v)


PACKED = "bucket int, kind int, signatures binary, owners binary, sizes binary"


def pack(v: np.ndarray, cls: np.ndarray, q: np.ndarray, buckets: int) -> pa.RecordBatch:
    """Rows (bucket, kind, signatures, classes, size classes) of a flush.

    kind 0: 5-byte signatures beside the bucket. kind 1: whole signatures with their members, in a bucket of no meaning. kind 2: marks
    of signatures that have such members, 5 bytes, without owners.
    """
    out: list[tuple[int, int, bytes, bytes, bytes]] = []
    order = np.argsort(v, kind="stable")
    w = v[order]
    opens = np.append(True, w[1:] != w[:-1]) if len(w) else np.zeros(0, bool)
    size = np.diff(np.append(np.nonzero(opens)[0], len(w)))
    hot = order[np.repeat(size, size) > LOCAL_GROUP]
    if len(hot):
        out.append((A.mix_one(int(v[hot[0]] ^ cls[hot[0]])) % buckets, 1, v[hot].tobytes(), cls[hot].tobytes(), b""))
    cold = np.ones(len(v), bool)
    cold[hot] = False
    for kind, pick in ((0, cold), (2, order[opens][size > LOCAL_GROUP])):  # cold ones as they came: equal classes side by side compress
        w, own, sizes = v[pick], cls[pick], q[pick]
        where = ((w >> U(40)) % U(buckets)).astype(np.int64)
        order = np.argsort(where, kind="stable")
        cuts = np.searchsorted(where[order], np.arange(buckets + 1))
        low = np.ascontiguousarray(w[order]).view(np.uint8).reshape(-1, 8)[:, :5]
        own, sizes = own[order], sizes[order]
        for b in np.nonzero(np.diff(cuts))[0]:
            a, e = cuts[b], cuts[b + 1]
            out.append((int(b), kind, low[a:e].tobytes(), own[a:e].tobytes() if kind == 0 else b"", sizes[a:e].tobytes() if kind == 0 else b""))
    types = (pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], t) for i, t in enumerate(types)], names=["bucket", "kind", "signatures", "owners", "sizes"])


def wide(raw: bytes) -> np.ndarray:
    """5-byte numbers."""
    out = np.zeros((len(raw) // 5, 8), np.uint8)
    out[:, :5] = np.frombuffer(raw, np.uint8).reshape(-1, 5)
    return out.view(U).ravel()


@trimmed_group
def meet(frame: pd.DataFrame) -> pd.DataFrame:
    """Candidate pairs (kind 0) of one bucket; members of large groups (kind 1: a is the group)."""
    of = lambda kind, column: b"".join(frame.loc[frame["kind"] == kind, column])
    v, cls, q = wide(of(0, "signatures")), np.frombuffer(of(0, "owners"), U), np.frombuffer(of(0, "sizes"), np.uint8).astype(np.int16)
    marked = np.unique(wide(of(2, "signatures")))
    bucket = int(frame["bucket"].iloc[0])
    order = np.lexsort((cls, v))
    v, cls, q = v[order], cls[order], q[order]
    keep = np.ones(len(v), bool)
    keep[1:] = (v[1:] != v[:-1]) | (cls[1:] != cls[:-1])
    v, cls, q = v[keep], cls[keep], q[keep]
    opens = np.ones(len(v), bool)
    opens[1:] = v[1:] != v[:-1]
    start = np.nonzero(opens)[0]
    size = np.diff(np.append(start, len(v)))
    large = (size > GROUP) | np.isin(v[start], marked)
    pairs = []
    for step in range(1, GROUP):  # the step-th neighbour within small groups: all pairs of them
        s0, n0 = start[(size > step) & ~large], size[(size > step) & ~large]
        if not len(s0):
            continue
        m = n0 - step
        at = np.repeat(s0, m) + np.arange(m.sum()) - np.repeat(np.cumsum(m) - m, m)
        at = at[np.abs(q[at] - q[at + step]) <= SIZE_APART]
        pairs.append((cls[at], cls[at + step]))
    members = np.repeat(large, size)
    a, b = (np.concatenate([p[i] for p in pairs]) if pairs else np.zeros(0, U) for i in (0, 1))
    if len(a):
        both = np.unique(np.stack([a, b], 1), axis=0)
        a, b = both[:, 0], both[:, 1]
    groups, owners = [A.mix(v[members] + ((U(bucket) + U(1)) << U(40)))], [cls[members]]
    for signatures, own in frame.loc[frame["kind"] == 1, ["signatures", "owners"]].itertuples(index=False):
        w, own = np.frombuffer(signatures, U), np.frombuffer(own, U)
        home = (w >> U(40)) % U(int(frame["buckets"].iloc[0]))
        groups.append(A.mix((w & U((1 << 40) - 1)) + ((home + U(1)) << U(40))))
        owners.append(own)
    group, own = np.concatenate(groups), np.concatenate(owners)
    return pd.DataFrame({"kind": np.repeat(np.array([0, 1], np.int32), [len(a), len(own)]), "a": A.signed(np.concatenate([a, group])), "b": A.signed(np.concatenate([b, own]))})


def sketch_distance(a: str, b: str):
    """Hamming distance of two sketches, the longer one folded (sizes that can be similar are one band apart at most)."""
    half = lambda x: f"int(size({x}) div 2)"
    folded = lambda x: f"zip_with(slice({x}, 1, {half(x)}), slice({x}, {half(x)} + 1, {half(x)}), (u, v) -> u ^ v)"
    apart = lambda x, y: f"aggregate(zip_with({x}, {y}, (u, v) -> bit_count(u ^ v)), 0, (t, x) -> t + x)"
    return F.expr(f"case when size({a}) = size({b}) then {apart(a, b)} when size({a}) > size({b}) then {apart(folded(a), b)} else {apart(a, folded(b))} end")


def chained(members: DataFrame) -> DataFrame:
    """Each member of a large group (a: group, b: class) with the next in an order of its own for every group, in chains of some BLOCK members.

    Each member is also tried with the group's hub, the member of most large groups: copies of one text resemble it more than one another.
    """
    members = members.withColumn("block", F.pmod(F.xxhash64(F.lit(2), "b"), F.ceil(F.col("k") / BLOCK)))
    after = Window.partitionBy("a", "block").orderBy(F.xxhash64("a", "b"), "b")
    o = members.select("b", "n", "hub", *[F.lead(c).over(after).alias("o_" + c) for c in ("b", "n")])
    next_ = o.filter("3 * greatest(n, o_n) <= 4 * least(n, o_n)").select("b", "o_b").union(o.filter("b <> hub").select("b", "hub"))
    return next_.select(F.least("b", "o_b").alias("a"), F.greatest("b", "o_b").alias("b"))


def salted(groups: DataFrame) -> DataFrame:
    """A row for each salt, to meet members that are dealt by salts."""
    return groups.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))


def folded(sketches_: np.ndarray, words: int) -> np.ndarray:
    return sketches_ if sketches_.shape[1] == words else sketches_[:, :words] ^ sketches_[:, words:]


@trimmed_group
def rivals(frame: pd.DataFrame) -> pd.DataFrame:
    """Pairs of the groups of one bucket that components, sizes and sketches allow: each caller with each member of its group's part.

    Groups of one family share most of their members, so a pair comes from many groups: it goes packed to the bucket of its own that drops the others.
    """
    order = np.lexsort((frame["part"], frame["a"]))
    frame = frame.iloc[order]
    group, part, b, n, component, caller = (frame[c].to_numpy() for c in ("a", "part", "b", "n", "component", "caller"))
    sketch = frame["sketch"].tolist()
    words = np.fromiter(map(len, sketch), np.int64, len(sketch))
    cuts = np.nonzero(np.append(True, (group[1:] != group[:-1]) | (part[1:] != part[:-1])))[0]
    found = [np.zeros((0, 2), np.int64)]
    for lo, hi in zip(cuts, np.append(cuts[1:], len(frame))):
        callers, members = lo + np.nonzero(caller[lo:hi])[0], lo + np.nonzero(~caller[lo:hi])[0]
        for w in np.unique(words[callers]):
            for v in (w // 2, w, 2 * w):
                x, y = callers[words[callers] == w], members[words[members] == v]
                if not len(y):
                    continue
                m = min(v, w)
                of_y = folded(np.stack([sketch[k] for k in y]).astype(np.int64), m).view(U)
                for own in np.array_split(x, -(-len(x) * len(y) * int(m) // (1 << 20))):
                    of_x = folded(np.stack([sketch[k] for k in own]).astype(np.int64), m).view(U)
                    far = np.bitwise_count(of_x[:, None, :] ^ of_y[None, :, :]).sum(2, dtype=np.int64)
                    p, q = n[own][:, None], n[y][None, :]
                    near = (component[own][:, None] != component[y][None, :]) & (3 * np.maximum(p, q) <= 4 * np.minimum(p, q)) & (7 * far <= p + q)
                    r, s = np.nonzero(near)
                    found.append(np.sort(np.stack([b[own][r], b[y][s]], 1), axis=1))
    pairs = np.unique(np.concatenate(found), axis=0)
    buckets = int(frame["buckets"].iloc[0])
    where = (A.mix(pairs[:, 0].view(U) ^ A.mix(pairs[:, 1].view(U))) % U(buckets)).astype(np.int64)
    pairs, where = pairs[np.argsort(where, kind="stable")], np.sort(where, kind="stable")
    to, cuts = np.unique(where, return_index=True)
    return pd.DataFrame({"bucket": to.astype(np.int32), "pairs": [x.tobytes() for x in np.split(pairs, cuts[1:])][: len(to)]})


@trimmed_group
def once(frame: pd.DataFrame) -> pd.DataFrame:
    """The distinct pairs (a, b) of one bucket of packed ones."""
    pairs = np.unique(np.frombuffer(b"".join(frame["pairs"]), np.int64).reshape(-1, 2), axis=0)
    return pd.DataFrame({"a": pairs[:, 0], "b": pairs[:, 1]})


def across(members: DataFrame, known: DataFrame, buckets: int) -> DataFrame:
    """Pairs of members of one large group that are in different components and that sizes and sketches allow. members: a, b, salt, component.

    Of each such pair one at least is outside the group's commonest component: only those are tried with the others, in parts of PART
    members. Sketches are compared in arrays: pairs that they refuse never become rows, and the others become one row each, however many groups
    they share.
    """
    sizes = members.groupBy("a", "component").agg(F.count("*").alias("k"))
    main = sizes.groupBy("a").agg(F.max(F.struct("k", "component")).alias("m"), F.sum("k").alias("k")).select("a", F.col("m.component").alias("main"), F.ceil(F.col("k") / PART).cast("int").alias("parts"))
    members = members.join(salted(main), ["a", "salt"])
    own = members.select("a", "b", "component", F.lit(False).alias("caller"), F.pmod(F.xxhash64(F.lit(1), "b"), F.col("parts")).cast("int").alias("part"))
    callers = members.filter("component <> main").select("a", "b", "component", F.lit(True).alias("caller"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
    rows = own.union(callers).join(known.select(F.col("class").alias("b"), "n", "sketch"), "b").withColumn("bucket", F.pmod(F.xxhash64("a", "part"), F.lit(buckets)).cast("int"))
    packed = rows.withColumn("buckets", F.lit(buckets)).groupBy("bucket").applyInPandas(rivals, "bucket int, pairs binary")
    return packed.groupBy("bucket").applyInPandas(once, "a long, b long")


def sketched(pairs: DataFrame, known: DataFrame) -> DataFrame:
    """The distinct candidate pairs that sizes and sketches allow. known: class, n, sketch, rep."""
    side = lambda x: known.select(F.col("class").alias(x), F.col("n").alias(f"n{x}"), F.col("sketch").alias(f"s{x}"))
    near = pairs.join(side("a"), "a").join(side("b"), "b")
    return cut(near.filter((3 * F.greatest("na", "nb") <= 4 * F.least("na", "nb")) & (7 * sketch_distance("sa", "sb") <= F.col("na") + F.col("nb"))).select("a", "b"))


def bitmap_of(classes_: DataFrame, bits: int) -> np.ndarray:
    """Bits of the hashes of rep, gathered word by word: bits / 8 bytes at most."""
    h = F.pmod(F.xxhash64("rep"), F.lit(bits))
    words = classes_.select(h.alias("h")).groupBy(F.expr("h div 64").alias("i")).agg(F.bit_or(F.expr("shiftleft(1L, int(h % 64))")).alias("w")).toArrow()
    out = np.zeros(bits // 64, np.int64)
    out[words.column("i").to_numpy()] = words.column("w").to_numpy()
    return out


def whole_sets(needed: DataFrame, docs: DataFrame) -> DataFrame:
    """(class, members) of the asked classes, 64 bits a shingle. needed: class, rep."""
    needed = cut(needed.select("class", "rep"))
    bits = 1 << min(int(math.log2(BITMAP_BITS)), max(16, (BITMAP_RATE * needed.count()).bit_length()))
    shared = docs.sparkSession.sparkContext.broadcast(bitmap_of(needed, bits))  # at most BITMAP_BITS

    @trimmed
    def members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = shared.value
        for batch in batches:
            at = batch.column(1).to_numpy()
            batch = batch.filter(pa.array((words[at >> 6] >> (at & 63)) & 1 == 1))
            for first, end, data, offsets in A.groups(batch.column(0)):
                d, s = sets(data, offsets)
                _, cls = classes(d, s, end - first)
                cuts = np.searchsorted(d, np.arange(end - first + 1))
                yield pa.RecordBatch.from_arrays([pa.array(A.signed(cls)), pa.array([s[a:e].tobytes() for a, e in zip(cuts[:-1], cuts[1:])], pa.binary())], names=["class", "members"])

    asked = docs.filter("doc_id is not null").select(F.coalesce("text", F.lit("")), F.pmod(F.xxhash64("doc_id"), F.lit(bits)).alias("at"))
    return asked.mapInArrow(members, "class long, members binary").join(needed.select("class"), "class", "left_semi").dropDuplicates(["class"])


def verified(near: DataFrame, found: DataFrame) -> DataFrame:
    """The pairs that link, by their whole sets."""

    @trimmed
    def linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2), batch.column(3)):  # one pair at a time: a batch of sets is large
                x, y = np.frombuffer(x.as_py(), U), np.frombuffer(y.as_py(), U)
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(100 * both >= 75 * (len(x) + len(y) - both))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

    full = near.join(found.select(F.col("class").alias("a"), F.col("members").alias("ma")), "a").join(found.select(F.col("class").alias("b"), F.col("members").alias("mb")), "b")
    return cut(full.select("a", "b", "ma", "mb").mapInArrow(linked, "a long, b long"))


def placed_classes(met: DataFrame, known: DataFrame, texts: DataFrame) -> DataFrame:
    """(node, component) of classes that are linked. met: what meet() found."""
    spark = texts.sparkSession
    near = sketched(met.filter("kind = 0").select("a", "b").distinct(), known)
    large = met.filter("kind = 1").select("a", "b", F.pmod(F.xxhash64("b"), F.lit(SALTS)).cast("int").alias("salt"))
    some = large.filter(F.pmod("a", F.lit(SPARSE)) == 0).join(large.groupBy("b").agg(F.count("*").alias("degree")), "b")
    groups = some.groupBy("a").agg(F.count("*").alias("k"), F.max(F.struct("degree", "b"))["b"].alias("hub"))
    sized = large.join(salted(groups), ["a", "salt"]).join(known.select(F.col("class").alias("b"), "n"), "b")
    # First each class with one candidate, and members of large groups with a few others; then what is still apart.
    both = near.union(near.select(F.col("b").alias("a"), F.col("a").alias("b")))
    tried = both.groupBy("b").agg(F.min("a").alias("a")).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    first = sketched(chained(sized).union(tried).distinct(), known)

    def confirmed(pairs: DataFrame) -> DataFrame:
        asked = pairs.select(F.col("a").alias("class")).union(pairs.select("b")).distinct()
        return verified(pairs, whole_sets(asked.join(known, "class"), texts))

    free_shuffles(spark)
    links = confirmed(first)
    free_shuffles(spark)
    placed = components(links)
    free_shuffles(spark)
    apart = large.join(placed, F.col("b") == F.col("node"), "left").select("a", "b", "salt", F.coalesce("component", "b").alias("component"))
    torn = apart.groupBy("a").agg(F.min("component").alias("x"), F.max("component").alias("y")).filter("x <> y").select("a")
    torn = cut(apart.join(salted(torn), ["a", "salt"]))
    place = lambda x: placed.select(F.col("node").alias(x), F.col("component").alias(f"c{x}"))
    rest = near.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).join(place("a"), "a", "left").join(place("b"), "b", "left")
    rest = rest.filter(F.coalesce("ca", "a") != F.coalesce("cb", "b")).select("a", "b")
    parts = max(n_partitions(spark), math.ceil(512 * torn.count() / BUCKET_BYTES))  # some 512 bytes a member
    joined = placed.select(F.col("node").alias("a"), F.col("component").alias("b"))
    others = cut(sketched(rest, known).union(across(torn, known, parts)).distinct())
    free_shuffles(spark)
    links = cut(joined.union(confirmed(others)))
    free_shuffles(spark)
    return components(links)


def similar_documents(docs: DataFrame) -> DataFrame:
    """doc_id, th, n_shingles, class, group and component_id, a row for each row of docs.

    th is the text's xxhash64, class its set, group the component itself: rows that repeat a doc_id can have one component_id in different ones.
    """
    spark = docs.sparkSession
    ship(spark)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("th"))
    seen = cut(texts.mapInArrow(survey, "doc_id long, th long, n long, class long, sketch array<bigint>, shingle long, seen long"))
    rows = seen.filter("shingle is null").select("doc_id", "th", "n", "class", "sketch")
    frequent = seen.filter("shingle is not null").groupBy("shingle").agg(F.sum("seen").alias("seen")).filter(F.col("seen") >= HOT_TOTAL).orderBy(F.desc("seen"), "shingle").limit(HOT_MOST)
    hot_list = np.sort(np.array(frequent.select("shingle").toArrow().column(0).to_numpy(), np.int64).view(U))
    shared = spark.sparkContext.broadcast(hot_list)  # at most HOT_MOST numbers
    # classes and pairs are a small part of the input: with as many partitions as the input their tasks would fill the driver
    held = rows.agg(F.sum(8 * F.size("sketch") + 64)).first()[0] or 0
    few = min(n_partitions(spark), max(LEAST_PARTS, math.ceil(held / BUCKET_BYTES)))
    with partitions(spark, few):
        known = cut_dealt(rows.filter("n > 0 and doc_id is not null").groupBy("class").agg(F.min("doc_id").alias("rep"), F.first("n").alias("n"), F.first("sketch").alias("sketch")))
    # some 14 bytes for every other member of a set
    buckets = max(n_partitions(spark), math.ceil(7 * (known.agg(F.sum("n")).first()[0] or 0) / BUCKET_BYTES))

    @trimmed
    def signed_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hot_list = shared.value
        bits = np.zeros(1 << HOT_BITS, bool)
        bits[(hot_list & U((1 << HOT_BITS) - 1)).astype(np.int64)] = True
        held: list[tuple] = []

        def flush() -> pa.RecordBatch:
            out = pack(*(np.concatenate([x[i] for x in held]) for i in range(3)), buckets)
            held.clear()
            return out

        for batch in batches:
            for first, end, data, offsets in A.groups(batch.column(0)):
                d, s = sets(data, offsets)
                n, cls = classes(d, s, end - first)
                once = np.zeros(end - first, bool)
                once[np.unique(cls, return_index=True)[1]] = True
                pick = once[d]
                d, s = d[pick], s[pick]
                maybe = bits[(s & U((1 << HOT_BITS) - 1)).astype(np.int64)]
                hot = np.zeros(len(s), bool)
                if maybe.any():
                    at = np.searchsorted(hot_list, s[maybe])
                    hot[maybe] = hot_list[np.minimum(at, len(hot_list) - 1)] == s[maybe]
                who, v = signatures(d, s, np.where(once, n, 0), hot)
                q = (np.log(np.maximum(n, 1)) / np.log(SIZE_STEP)).astype(np.uint16)
                held.append((v, cls[who], np.minimum(q, 255).astype(np.uint8)[who]))
                if sum(len(x[0]) for x in held) > 1_000_000:
                    yield flush()
        if held and sum(len(x[0]) for x in held):
            yield flush()

    packed = texts.filter("doc_id is not null").select("text").mapInArrow(signed_rows, PACKED)
    met = cut(packed.withColumn("buckets", F.lit(buckets)).groupBy("bucket").applyInPandas(meet, "kind int, a long, b long"))
    free_shuffles(spark)
    with partitions(spark, few), planned_once(spark):
        placed = placed_classes(met, known, texts)
    free_shuffles(spark)
    found = placed.join(known.select(F.col("class").alias("node"), "rep"), "node")
    least = found.groupBy("component").agg(F.min("rep").alias("component_id"))
    by_class = found.join(least, "component").select(F.col("node").alias("class"), F.col("component").alias("group"), "component_id")
    homes = known.select("class", "rep").join(by_class, "class", "left").select("class", F.coalesce("group", "class").alias("group"), F.coalesce("component_id", "rep").alias("component_id"))
    return rows.join(homes, "class", "left").select("doc_id", "th", F.col("n").alias("n_shingles"), "class", "group", F.when((F.col("n") > 0) & F.col("doc_id").isNotNull(), F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))
