"""Personal data by fixed patterns and bootstrapped contextual extraction.

One pass over the whole texts finds the base entities (email, ip, card, phone; see base_spans) and, with them, tokens that look like
identifiers (they hold a digit or an @) along with the lexical contexts they stand in. Seeds are the base
entities and long hexadecimal strings ("secret"). Spark then scores the graph of patterns and instances:

    confidence(pattern, kind) = sum of score(instance, kind) over its distinct instances / (number of them + 1)
    score(instance, kind)     = 1 - prod(1 - confidence(pattern, kind)) over its patterns; 1 for seeds of that kind

for `rounds` rounds, over the patterns that at least min_seeds distinct seeds of a kind support. Tokens in a pattern of
min_confidence or more are identifiers of that kind, though no fixed pattern knows them; a token that a base pattern matched
but its check refused (a card number failing Luhn, say) is a negative and is never taken up. Base spans always stay.

Rows are told apart by a number given before the pass's thin result (no texts) is stored, so repeated or null
doc_ids are fine. Null and empty texts have no spans. All scans are linear in the text's length.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.common import cut, ship

KINDS = ("email", "ip", "card", "phone")
SEED_KINDS = (*KINDS, "secret")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
#: Identifier-like: a run free of spaces and quotes, with a digit or an @ inside.
TOKEN = re.compile(r"[^\s\"'<>|,;(){}\[\]=]{6,}")
IDENTIFIER = re.compile(r"[0-9@]")
SECRET = re.compile(r"(?=[0-9a-f]*[0-9])(?=[0-9a-f]*[a-f])(?:[0-9a-f]{32}|[0-9a-f]{40}|[0-9a-f]{64})")
CONTEXT = re.compile(r"\w+|[^\w\s]")
CONTEXT_CHARS = 40
#: Salts of a pattern's occurrences, so that one pattern's many are not one task's.
SALTS = 16


def luhn(digits: str) -> bool:
    odd, even = digits[-1::-2], digits[-2::-2]
    return (sum(map(int, odd)) + sum(sum(divmod(2 * int(d), 10)) for d in even)) % 10 == 0


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Matches of the email pattern, left to right. Each @ is tried once, with all of the local part before it."""
    end, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in LOCAL:
            start -= 1
        m = DOMAIN.match(text, at + 1) if start < at else None
        if m:
            yield start, m.end()
            end = m.end()
        at = text.find("@", max(at + 1, end))


def base_spans(text: str) -> tuple[list[tuple[int, int, int]], list[tuple[int, int]]]:
    """(kind number, start, end) by kind and start; and the spans a pattern matched but its check refused."""
    found, refused = [], []
    if "@" in text:
        found += [(0, a, b) for a, b in emails(text)]
    for m in IP.finditer(text):
        good = all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or "0") <= 255 for p in m[0].split("."))
        found.append((1, *m.span())) if good else refused.append(m.span())
    for m in CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 16 <= len(digits) <= 19:
            found.append((2, *m.span())) if luhn(digits) else refused.append(m.span())
    if "+" in text:
        for m in PHONE.finditer(text):
            n = sum(c.isdigit() for c in m[0])
            found.append((3, *m.span())) if 8 <= n <= 15 else refused.append(m.span())
    return found, refused


def contexts(text: str, start: int, end: int) -> list[str]:
    """Lexical patterns around a span: three and two tokens to the left, and one each side; digits read as 0."""
    left, right, reach = [], [], CONTEXT_CHARS
    while True:  # wider until one more token than asked for shows that those are whole
        left, right = CONTEXT.findall(text[max(0, start - reach) : start].lower()), CONTEXT.findall(text[end : end + reach].lower())
        if (len(left) > 3 or reach >= start) and (len(right) > 1 or end + reach >= len(text)):
            break
        reach *= 4
    left, right = left[-3:], right[:1]
    left, right = ([re.sub(r"\d+", "0", x) for x in side] for side in (left, right))
    out = []
    if len(left) >= 3:
        out.append(" ".join(left) + " _")
    if len(left) >= 2:
        out.append(" ".join(left[-2:]) + " _")
        if right:
            out.append(" ".join(left[-2:]) + " _ " + right[0])
    return out


def candidates(text: str, taken: list[tuple[int, int, int]], refused: list[tuple[int, int]]) -> list[tuple[int, int, str, str | None]]:
    """(start, end, value, seed kind or None): the base entities, and identifier-like tokens clear of them and of what was refused."""
    out = [(a, b, text[a:b].lower(), KINDS[k]) for k, a, b in taken]
    closed = sorted([(a, b) for _, a, b in taken] + refused)
    i = 0
    for m in TOKEN.finditer(text):
        if not IDENTIFIER.search(m[0]):
            continue
        a, b = m.start(), m.start() + len(m[0].rstrip(".:!?*#$%&"))
        while i < len(closed) and closed[i][1] <= a:
            i += 1
        if b - a < 6 or not IDENTIFIER.search(text, a, b) or any(s < b and e > a for s, e in closed[i : i + 8]):
            continue
        out.append((a, b, text[a:b].lower(), "secret" if SECRET.fullmatch(text[a:b]) else None))
    return out


OCCURRENCE = pa.struct([("s", pa.int64()), ("e", pa.int64()), ("value", pa.int64()), ("kind", pa.string()), ("patterns", pa.list_(pa.string()))])
PASS_SCHEMA = "rid long, doc_id long, n_email long, n_ip long, n_card long, n_phone long, base string, base_sha256 string, occ array<struct<s:bigint,e:bigint,value:bigint,kind:string,patterns:array<string>>>"


def scan(docs: DataFrame) -> DataFrame:
    """Thin rows: counts and spans of base entities, and occurrences with their patterns."""
    ship(docs.sparkSession)

    def scanned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[] for _ in range(7)]
            for text in batch.column(2).to_pylist():
                text = text or ""
                base, refused = base_spans(text)
                for k in range(4):
                    out[k].append(sum(x[0] == k for x in base))
                spans = ",".join(f"{KINDS[k]}:{a}:{b}" for k, a, b in base)
                out[4].append(spans)
                out[5].append(hashlib.sha256(spans.encode()).hexdigest())
                out[6].append([{"s": a, "e": b, "value": int.from_bytes(hashlib.blake2b(v.encode(), digest_size=8).digest(), "little", signed=True), "kind": k, "patterns": contexts(text, a, b)} for a, b, v, k in candidates(text, base, refused)])
            types = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.list_(OCCURRENCE)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *(pa.array(x, t) for x, t in zip(out, types))], names=["rid", "doc_id", "n_email", "n_ip", "n_card", "n_phone", "base", "base_sha256", "occ"])

    return docs.select(F.monotonically_increasing_id().alias("rid"), F.col("doc_id").cast("long"), "text").mapInArrow(scanned, PASS_SCHEMA)


def score_patterns(edges: DataFrame, rounds: int = 3, min_seeds: int = 5, min_confidence: float = 0.6) -> DataFrame:
    """edges: distinct (pattern, value, kind or null). (pattern, kind, confidence) of the patterns to trust, the best kind each.

    Every step is an aggregation by pattern or by value over distinct edges, combined on the map side.
    """
    by_kind = edges.groupBy("pattern", "kind").agg(F.count("*").alias("n"))
    totals = by_kind.groupBy("pattern").agg(F.sum("n").alias("n_all"))
    support = cut(by_kind.filter(F.col("kind").isNotNull() & (F.col("n") >= min_seeds)).select(F.col("pattern"), F.col("kind").alias("k"), "n").join(totals, "pattern"))
    confidence = support.select("pattern", "k", "n_all", (F.col("n") / (F.col("n_all") + 1)).alias("c"))
    unknown = cut(edges.filter("kind is null").join(support.select("pattern", "k", F.col("n").alias("n_seeds"), "n_all"), "pattern").select("pattern", "value", "k", "n_seeds", "n_all"))
    for _ in range(rounds):
        scores = unknown.join(confidence.select("pattern", "k", "c"), ["pattern", "k"]).groupBy("value", "k").agg((1 - F.exp(F.sum(F.ln(1 - F.least("c", F.lit(0.999)))))).alias("score"))
        gained = unknown.join(scores, ["value", "k"]).groupBy("pattern", "k").agg(F.sum("score").alias("gain"))
        confidence = cut(support.join(gained, ["pattern", "k"], "left").select("pattern", "k", "n_all", ((F.col("n") + F.coalesce("gain", F.lit(0.0))) / (F.col("n_all") + 1)).alias("c")))
    best = confidence.groupBy("pattern").agg(F.max(F.struct("c", "k")).alias("b"))
    return best.select("pattern", F.col("b.k").alias("kind"), F.col("b.c").alias("confidence")).filter(F.col("confidence") >= min_confidence)


def find_personal_data(docs: DataFrame, rounds: int = 3, min_seeds: int = 5, min_confidence: float = 0.6) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base, base_sha256, discovered (array of kind, s, e, seed: whether a secret by its own form) and spans, a row for each row of docs.

    spans joins base and discovered as kind:start:end by kind (email, ip, card, phone, secret), then start.
    """
    rows = cut(scan(docs))
    occurrences = rows.select("rid", F.explode("occ").alias("o")).select("rid", "o.*").withColumn("pattern", F.explode("patterns"))
    edges = occurrences.groupBy("pattern", "value").agg(F.max("kind").alias("kind"))
    trusted = score_patterns(edges, rounds, min_seeds, min_confidence)
    salted = trusted.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    unseen = occurrences.filter(F.col("kind").isNull() | (F.col("kind") == "secret")).select("rid", "s", "e", "pattern", F.col("kind").isNotNull().alias("seed"), F.pmod("rid", F.lit(SALTS)).cast("int").alias("salt"))
    hits = unseen.join(salted, ["pattern", "salt"]).groupBy("rid", "s", "e", "seed").agg(F.max(F.struct("confidence", "kind")).alias("b"))
    rank = F.expr("array_position(array('email', 'ip', 'card', 'phone', 'secret'), b.kind)").alias("rank")
    by_row = hits.groupBy("rid").agg(F.sort_array(F.collect_list(F.struct(rank, F.col("s"), F.col("e"), F.col("b.kind").alias("kind"), "seed"))).alias("found"))
    out = rows.drop("occ").join(by_row, "rid", "left")
    base = F.expr("transform(filter(split(base, ','), x -> x <> ''), x -> struct(array_position(array('email', 'ip', 'card', 'phone', 'secret'), split_part(x, ':', 1)) as rank, bigint(split_part(x, ':', 2)) as s, bigint(split_part(x, ':', 3)) as e, split_part(x, ':', 1) as kind, true as seed))")
    every = F.array_sort(F.concat(base, F.coalesce("found", F.expr("cast(array() as array<struct<rank:bigint,s:bigint,e:bigint,kind:string,seed:boolean>>)"))))
    out = out.withColumn("spans", F.array_join(F.transform(every, lambda x: F.concat_ws(":", x.kind, x.s, x.e)), ","))
    return out.select("doc_id", "n_email", "n_ip", "n_card", "n_phone", "base", "base_sha256", F.expr("transform(found, x -> struct(x.kind as kind, x.s as s, x.e as e, x.seed as seed))").alias("discovered"), "spans")
