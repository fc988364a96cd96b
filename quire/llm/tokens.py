"""Token counts by a two-tier lookup on the map side, without a shuffle.

A sentencepiece model without pieces that run across a word start encodes each pre-token (a run of spaces and the word
after it) on its own, so a text's count is the sum over its pre-tokens. Tier one is a broadcast table of the lengths of
the pre-tokens most frequent in the tokenizer's own vocabulary (bounded by table_size); what it misses is encoded once
per worker and kept in a cache of at most cache_size entries that is emptied when full. A model for which this sum would
not hold (see separable()) encodes whole texts.

Null texts count as empty: 0 tokens. Very long texts are counted slice by slice at word starts. Other columns pass through.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.common import ship

MARK = "▁"
UNIT = re.compile(f"{MARK}+[^{MARK}]*")
CUT = re.compile(f"[^ {MARK}] (?=[^ {MARK}])")
SLICE_CHARS = 1 << 20
LONGEST_CACHED = 64


def processor(model: str | bytes):
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_proto=model) if isinstance(model, bytes) else sentencepiece.SentencePieceProcessor(model_file=model)


def separable(sp) -> bool:
    """No piece continues across a word start, and text is taken as it is, behind one added space."""
    pieces = [sp.id_to_piece(i) for i in range(sp.get_piece_size())]
    probe = ["a", " a", "a  b", "Äﬁ　x​", "x\ty\n"]
    prefixed = all(sp.encode(x, out_type=str)[0].startswith(MARK) for x in probe)
    return prefixed and not any(MARK in p.lstrip(MARK) for p in pieces) and all(sp.decode(sp.encode(x)) == x for x in probe)


class Lengths(dict):
    """Token counts by pre-token (without its first mark); encodes what it lacks."""

    def __init__(self, sp, table: dict[str, int], cache_size: int):
        super().__init__(table)
        self.sp, self.table, self.cache_size = sp, table, cache_size

    def __missing__(self, unit: str) -> int:
        n = len(self.sp.encode(unit)) if unit else 1
        if len(unit) <= LONGEST_CACHED:
            if len(self) >= len(self.table) + self.cache_size:
                self.clear()
                self.update(self.table)
            self[unit] = n
        return n


def slices(text: str) -> Iterator[str]:
    at = 0
    while len(text) - at > SLICE_CHARS and (m := CUT.search(text, at + SLICE_CHARS)):
        yield text[at : m.start() + 1]
        at = m.end()
    yield text[at:] if at else text


def count(text: str, lengths: Lengths) -> int:
    if not text:
        return 0
    total = 0
    for part in slices(text):
        words = part.split(" ")
        if MARK in part or "" in words:
            words = [u[1:] for u in UNIT.findall(MARK + part.replace(" ", MARK))]
        total += sum(map(lengths.__getitem__, words))
    return total


def frequent_lengths(sp, table_size: int) -> dict[str, int]:
    """Lengths of the pre-tokens that are single pieces, the earliest (most frequent) merges first."""
    words = (p[1:] for i in range(sp.get_piece_size()) if (p := sp.id_to_piece(i)).startswith(MARK) and len(p) > 1 and p[1] != MARK)
    return {w: len(sp.encode(w)) for _, w in zip(range(table_size), words)}


def count_tokens(docs: DataFrame, model_path: str, text: str = "text", out: str = "n_tokens", keep_text: bool = True, table_size: int = 32_768, cache_size: int = 400_000) -> DataFrame:
    """docs with n_bytes (UTF-8) and the number of tokens that the sentencepiece model at model_path (on the driver) gives."""
    spark = docs.sparkSession
    ship(spark)
    with open(model_path, "rb") as f:
        proto = f.read()
    sp = processor(proto)
    split = separable(sp)
    shared = spark.sparkContext.broadcast((proto, split, frequent_lengths(sp, table_size) if split else {}))

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        proto, split, table = shared.value
        sp = processor(proto)
        lengths = Lengths(sp, table, cache_size)
        for batch in batches:
            texts = batch.column(batch.schema.get_field_index(text))
            n = [count(t or "", lengths) if split else len(sp.encode(t or "")) for t in texts.to_pylist()]
            cols = [c for c in batch.schema.names if c not in (out, "n_bytes") and (keep_text or c != text)]
            extra = [pc.fill_null(pc.binary_length(texts), 0).cast(pa.int64()), pa.array(n, pa.int64())]
            yield pa.RecordBatch.from_arrays([batch.column(batch.schema.get_field_index(c)) for c in cols] + extra, names=[*cols, "n_bytes", out])

    fields = [f for f in docs.schema.fields if f.name not in (out, "n_bytes") and (keep_text or f.name != text)]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields) + f", n_bytes bigint, `{out}` bigint"
    return docs.mapInArrow(counted, schema)


def token_report(docs: DataFrame, model_path: str, limit: int = 4096) -> DataFrame:
    """doc_id, n_bytes, n_tokens and over_limit, without the texts on the way back from Python."""
    counted = count_tokens(docs.select("doc_id", "text"), model_path, keep_text=False)
    return counted.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
