"""Benchmark decontamination by CGK embeddings and bit-sampling LSH over item-sized windows.

Texts and items are sequences of words (A-Z lower-cased). A CGK random walk reads a window word by word, at each step staying or moving on
by a random bit of the step and the word it is at, and so maps edit distance to Hamming distance: windows a few edits apart mostly read
the same words at the same steps, once their walks have met again. REPEATS times, SAMPLED of the steps are sampled and the words read there
hashed to a key; equal keys make a candidate. A pair with share h of differing steps is found with probability
1 - (1 - (1 - h)**SAMPLED)**REPEATS, over 0.99 up to h = 0.3. Items are classed by length (4-7, 8-15, 16-31 words and so on), and a
class samples only steps that its shortest item reaches.

Edits spread over the words change far more than three words in ten, so no match hangs on the walks alone. An item of which k
characters may be edited is cut into k + 1 pieces. Taken two by two, some two hold one edit at most (or the odd one none), so one piece stands
unchanged in the text with half of its neighbour beside it, moved by one edit at most. The words from where an item can start
for such a piece to stand where it does are the windows: all that can match are among them. What the walks find is
verified first, so that the other windows of an item are given up sooner.

Each candidate is verified exactly: the least edit distance (characters, words joined by one space) between the item and the text from the
window's start to any end, by Myers' bit-parallel recurrence; a match has at most max_rate edits per character of the item.

Every item of a word or more is looked for (min_words leaves out shorter ones, which chance would find). Null and empty texts and items match
nothing, rows without an item_id are left out; rows that repeat are documents, or items, of their own. A column named hits is replaced. The items are
broadcast in groups of at most GROUP_CHARS characters, however many there are; texts never leave their rows and need no shuffle.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm import arrays as A
from quire.llm.common import ship, trimmed

U = np.uint64
WALKS = 4
KEYS_PER_WALK = 4
REPEATS = WALKS * KEYS_PER_WALK
SAMPLED = 3
MOST_STEPS = 48
GROUP_CHARS = 16 << 20
PIECE_BITS = 22
#: Bytes that one edited character can move what follows it.
MOVED = 4


#: A salt for each walk and step.
salts = [[A.mix_one((number << 32) + j) for j in range(MOST_STEPS)] for number in range(WALKS)]


def classed(n: int) -> int:
    """The class of an item of n words: the steps it can be sampled at."""
    return min(MOST_STEPS, 1 << (n.bit_length() - 1))


def sampled_steps(steps: int) -> list[list[tuple[int, ...]]]:
    """For each walk, KEYS_PER_WALK choices of SAMPLED of the first `steps` steps."""
    rng = np.random.default_rng(steps)
    return [[tuple(sorted(rng.choice(steps, min(SAMPLED, steps), replace=False).tolist())) for _ in range(KEYS_PER_WALK)] for _ in range(WALKS)]


def walk(h: np.ndarray, start: np.ndarray, end: np.ndarray, steps: int, number: int) -> np.ndarray:
    """Words read at each step, a row per step; 0 beyond a window's text."""
    out = np.zeros((steps, len(start)), U)
    at = start.copy()
    last = len(h) - 1
    for j in range(steps):
        inside = at < end
        word = np.where(inside, h[np.minimum(at, last)], U(0))
        out[j] = word
        salt = U(salts[number][j])
        turned = (word ^ salt) * U(0xFF51AFD7ED558CCD)
        at += (turned >> U(63)).astype(np.int64)
    return out


def keys(read: np.ndarray, number: int, steps: int, choice: int, at: tuple[int, ...]) -> np.ndarray:
    v = np.full(read.shape[1], U(A.mix_one((steps << 40) + (number << 20) + choice)), U)
    for j in at:
        v = A.mix(v + read[j])
    return v


def packed(parts: list[bytes]) -> np.ndarray:
    """Up to eight bytes each as a number, the first lowest."""
    return np.array([int.from_bytes(x, "little") for x in parts], U)


def mask(n: np.ndarray) -> np.ndarray:
    """Ones for n bytes, up to eight."""
    return np.where(n >= 8, ~U(0), (U(1) << (U(8) * np.minimum(n, 7).astype(U))) - U(1))


class Pieces:
    """Pieces of items, some of which a match holds unchanged: item, edits allowed, characters before; first and last bytes, and
    the near and far half of the neighbour (0 bytes of it where there is none)."""

    def __init__(self, patterns: list[str], max_rate: float):
        rows: list[tuple[int, int, int, bytes, bytes, int, bytes, int]] = []
        self.anywhere: list[int] = []
        for item, pattern in enumerate(patterns):
            allowed = int(max_rate * len(pattern))
            if allowed >= len(pattern):
                self.anywhere.append(item)
                continue
            n = allowed + 1
            cuts = [len(pattern) * i // n for i in range(n + 1)]
            for i in range(n):
                a, b = cuts[i], cuts[i + 1]
                own = pattern[a:b].encode()
                near, far, near_at, far_at = b"", b"", 0, 0
                if i ^ 1 < n:
                    c, e = cuts[i ^ 1], cuts[(i ^ 1) + 1]
                    left, right = pattern[c : (c + e) // 2].encode(), pattern[(c + e) // 2 : e].encode()
                    if c > a:
                        near, far, near_at, far_at = left[:8], right[:8], len(own), len(own) + len(left)
                    else:
                        near, far, near_at, far_at = right[-8:], left[-8:], -len(right[-8:]), -len(right) - len(left[-8:])
                rows.append((item, allowed, a, own, near, near_at, far, far_at))
        rows.sort(key=lambda r: (min(8, len(r[3])), int.from_bytes(r[3][:8], "little")))
        self.item, self.allowed, self.before = (np.array([r[i] for r in rows], np.int64) for i in range(3))
        size = np.array([len(r[3]) for r in rows], np.int64)
        self.size = np.minimum(size, 8)
        self.first, self.last, self.last_at = packed([r[3][:8] for r in rows]), packed([r[3][-8:] for r in rows]), size - self.size
        self.near, self.near_at, self.near_mask = packed([r[4] for r in rows]), np.array([r[5] for r in rows], np.int64), mask(np.array([len(r[4]) for r in rows], np.int64))
        self.far, self.far_at, self.far_mask = packed([r[6] for r in rows]), np.array([r[7] for r in rows], np.int64), mask(np.array([len(r[6]) for r in rows], np.int64))
        self.sizes = []
        for n in np.unique(self.size).tolist():
            a, b = np.searchsorted(self.size, [n, n + 1])
            bits = np.zeros(1 << PIECE_BITS, bool)
            bits[slot(self.first[a:b])] = True
            self.sizes.append((n, int(a), int(b), bits))

    def found(self, text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place in text, piece) of the pieces that stand there and have half of their neighbour beside them."""
        pad = 8 + 2 * MOVED
        around = np.concatenate([np.zeros(64, np.uint8), text, np.zeros(64 + pad, np.uint8)])
        at8 = np.ndarray((len(around) - 8,), "<u8", around.data, 0, (1,))
        places, pieces = [], []
        for n, a, b, bits in self.sizes:
            v = at8[64 : 64 + len(text)]
            v = v & mask(np.array([n]))[0] if n < 8 else v
            at = np.nonzero(bits[slot(v)])[0]
            lo, hi = np.searchsorted(self.first[a:b], v[at], "left"), np.searchsorted(self.first[a:b], v[at], "right")
            many = hi - lo
            at = np.repeat(at, many)
            piece = a + np.arange(len(at)) - np.repeat(np.cumsum(many) - many - lo, many)
            places.append(at)
            pieces.append(piece)
        at, piece = (np.concatenate([*x, np.zeros(0, np.int64)]) for x in (places, pieces))
        read = lambda where: at8[np.clip(where + 64, 0, len(at8) - 1)]
        ok = (read(at + self.last_at[piece]) & mask(self.size[piece])) == self.last[piece]
        at, piece = at[ok], piece[ok]
        ok = (read(at + self.near_at[piece]) & self.near_mask[piece]) == self.near[piece]
        for moved in range(-MOVED, MOVED + 1):
            ok |= (read(at + self.far_at[piece] + moved) & self.far_mask[piece]) == self.far[piece]
        return at[ok], piece[ok]


def slot(v: np.ndarray) -> np.ndarray:
    return ((v * U(0x9E3779B97F4A7C15)) >> U(64 - PIECE_BITS)).astype(np.int64)


class Items:
    """The items of a group: their words, their keys and their pieces."""

    def __init__(self, ids: list[int], texts: list[str], max_rate: float, min_words: int = 1):
        data = pa.array(texts, pa.string())
        self.ids: list[int] = []
        self.patterns: list[str] = []
        self.table: dict[int, list[int]] = defaultdict(list)
        self.classes: set[int] = set()
        for first, _, raw, offsets in A.groups(data):
            start, end, doc, h = A.word_hashes(raw, offsets)
            for i in range(len(offsets) - 1):
                a, b = np.searchsorted(doc, [i, i + 1])
                if b - a < max(1, min_words):
                    continue
                item = len(self.ids)
                self.ids.append(ids[first + i])
                self.patterns.append(joined(raw, start[a:b], end[a:b]))
                steps = classed(int(b - a))
                self.classes.add(steps)
                choices = sampled_steps(steps)
                for number in range(WALKS):
                    read = walk(h[a:b], np.zeros(1, np.int64), np.array([b - a]), steps, number)
                    for c, at in enumerate(choices[number]):
                        self.table[int(keys(read, number, steps, c, at)[0])].append(item)
        self.keys = np.sort(np.array(list(self.table), U))
        self.pieces = Pieces(self.patterns, max_rate)


def joined(raw: np.ndarray, start: np.ndarray, end: np.ndarray) -> str:
    if not len(start):
        return ""
    low = A.lower(raw[start[0] : end[-1]])
    return b" ".join(low[a:b].tobytes() for a, b in zip((start - start[0]).tolist(), (end - start[0]).tolist())).decode("utf-8", "replace")


def prefix_distance(pattern: str, text: str, allowed: int) -> tuple[int, int]:
    """(least edit distance between pattern and a prefix of text, length of the shortest such prefix); given up, with more than
    allowed, as soon as what is left of text can't bring it down that far."""
    m = len(pattern)
    if text.startswith(pattern):
        return 0, m
    where: dict[str, int] = {}
    for i, c in enumerate(pattern):
        where[c] = where.get(c, 0) | 1 << i
    full, top = (1 << m) - 1, 1 << (m - 1)
    plus, minus, score = full, 0, m
    best, best_at = m, 0
    for j, c in enumerate(text, 1):
        eq = where.get(c, 0)
        d0 = ((((eq & plus) + plus) ^ plus) | eq | minus) & full
        h_plus, h_minus = minus | (full & ~(d0 | plus)), plus & d0
        score += bool(h_plus & top) - bool(h_minus & top)
        h_plus, h_minus = ((h_plus << 1) | 1) & full, (h_minus << 1) & full
        plus, minus = h_minus | (full & ~(d0 | h_plus)), h_plus & d0
        if score < best:
            best, best_at = score, j
        if score - (len(text) - j) > allowed < best:
            break
    return best, best_at


def windows(items: Items, raw: np.ndarray, start: np.ndarray, end: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(word, item): the words from where an item can start so that one of its pieces stands where it does, sorted."""
    size = end - start
    new = np.cumsum(size + 1) - size - 1
    text = np.full(int(new[-1] + size[-1] + 1), 32, np.uint8)
    within = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
    text[np.repeat(new, size) + within] = A.lower(raw[np.repeat(start, size) + within])
    text[(new + size)[np.append(doc[1:] != doc[:-1], True)]] = 10
    at, piece = items.pieces.found(text)
    chars = np.concatenate([[0], np.cumsum((text & 0xC0) != 0x80)])
    starts = chars[new]
    own = doc[np.searchsorted(new, at, "right") - 1]
    origin, allowed = chars[at] - items.pieces.before[piece], items.pieces.allowed[piece]
    lo = np.maximum(np.searchsorted(starts, origin - allowed), np.searchsorted(doc, own))
    hi = np.minimum(np.searchsorted(starts, origin + allowed, "right"), np.searchsorted(doc, own, "right"))
    many = np.maximum(hi - lo, 0)
    word = np.arange(int(many.sum())) - np.repeat(np.cumsum(many) - many - lo, many)
    item = np.repeat(items.pieces.item[piece], many)
    for i in items.pieces.anywhere:
        word, item = np.concatenate([word, np.arange(len(start))]), np.concatenate([item, np.full(len(start), i)])
    both = np.unique(word * len(items.patterns) + item)
    return both // len(items.patterns), both % len(items.patterns)


def find(items: Items, raw: np.ndarray, offsets: np.ndarray, max_rate: float) -> list[tuple[int, int, int, int, int, float]]:
    """(text, item id, start, end, edits, rate) of the best match of each item in each text; start and end in words."""
    start, end, doc, h = A.word_hashes(raw, offsets)
    if not len(h) or not items.patterns:
        return []
    word, of = windows(items, raw, start, end, doc)
    if not len(word):
        return []
    near: set[tuple[int, int]] = set()
    at = np.unique(word)
    last = np.searchsorted(doc, doc[at], "right")
    ends = dict(zip(at.tolist(), last.tolist()))
    for c in sorted(items.classes):
        choices = sampled_steps(c)
        for number in range(WALKS):
            read = walk(h, at, last, c, number)
            for choice, sampled in enumerate(choices[number]):
                v = keys(read, number, c, choice, sampled)
                hit = np.nonzero(items.keys[np.minimum(np.searchsorted(items.keys, v), len(items.keys) - 1)] == v)[0]
                near.update((int(at[i]), item) for i in hit.tolist() for item in items.table[int(v[i])])
    pairs = list(zip(word.tolist(), of.tolist()))
    best: dict[tuple[int, int], tuple[int, int, int, float]] = {}
    for t, item in sorted(pairs, key=lambda x: (x not in near, x)):
        own, pattern = (int(doc[t]), item), items.patterns[item]
        allowed = int(max_rate * len(pattern))
        if own in best:
            # as few edits from an earlier word, or fewer
            allowed = best[own][0] - (t > best[own][1])
        if allowed < 0:
            continue
        most = len(pattern) + allowed
        # four bytes a character at most
        upto = min(ends[t], int(np.searchsorted(end, start[t] + 4 * most + 8)) + 1)
        edits, length = prefix_distance(pattern, joined(raw, start[t:upto], end[t:upto])[: most + 1], allowed)
        if edits <= allowed:
            best[own] = (edits, t, length, edits / len(pattern))
    first = np.searchsorted(doc, np.arange(len(offsets) - 1))
    return [(d, items.ids[item], int(t - first[d]), length, edits, rate) for (d, item), (edits, t, length, rate) in sorted(best.items())]


def item_groups(benchmark: DataFrame, id_col: str, text: str) -> Iterator[tuple[list[int], list[str]]]:
    """The items in groups of at most GROUP_CHARS characters, read one after the other."""
    ids: list[int] = []
    texts: list[str] = []
    size = 0
    for row in benchmark.select(F.col(id_col).cast("long").alias("i"), F.col(text).alias("t")).filter("i is not null and t is not null").orderBy("i", "t").toLocalIterator():
        if texts and size + len(row["t"]) > GROUP_CHARS:
            yield ids, texts
            ids, texts, size = [], [], 0
        ids.append(row["i"])
        texts.append(row["t"])
        size += len(row["t"])
    if texts:
        yield ids, texts


def contaminated(docs: DataFrame, benchmark: DataFrame, max_rate: float = 0.1, keep: tuple[str, ...] = ("doc_id",), text: str = "text", min_words: int = 1) -> DataFrame:
    """docs' columns `keep` with hits: array of item_id, first_word, n_chars, edits, rate; the best match of every item found."""
    spark = docs.sparkSession
    ship(spark)
    keep = tuple(c for c in keep if c != "hits")
    hit = pa.struct([("item_id", pa.int64()), ("first_word", pa.int64()), ("n_chars", pa.int64()), ("edits", pa.int64()), ("rate", pa.float64())])
    kinds = {f.name: f.dataType.simpleString() for f in docs.schema.fields}
    schema = ", ".join(f"`{c}` {kinds[c]}" for c in keep) + ", hits array<struct<item_id:bigint,first_word:bigint,n_chars:bigint,edits:bigint,rate:double>>"
    groups = [spark.sparkContext.broadcast((ids, texts)) for ids, texts in item_groups(benchmark, "item_id", "text")]

    def matched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        built = [Items(*g.value, max_rate, min_words) for g in groups]
        for batch in batches:
            out: list[list[dict]] = [[] for _ in range(len(batch))]
            for first, _, raw, offsets in A.groups(batch.column(len(keep))):
                for items in built:
                    for d, item, start, length, edits, rate in find(items, raw, offsets, max_rate):
                        out[first + d].append({"item_id": item, "first_word": start, "n_chars": length, "edits": edits, "rate": rate})
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(len(keep))), pa.array(out, pa.list_(hit))], names=[*keep, "hits"])

    return docs.select(*keep, F.col(text).alias("__text")).mapInArrow(trimmed(matched), schema)


def matches(docs: DataFrame, benchmark: DataFrame, max_rate: float = 0.1) -> DataFrame:
    """doc_id, item_id, first_word, n_chars, edits, rate: the best match of each item in each document that holds it."""
    return contaminated(docs, benchmark, max_rate).select("doc_id", F.explode("hits").alias("h")).select("doc_id", "h.*")
