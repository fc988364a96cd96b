"""Nulls, empty and long texts, repeated rows, clashing columns and empty tables through every stage and operator."""

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from quire.llm import ann, decontaminate, html_extract, line_dedup, pii, tokens, toxicity

CLASHES = ("hits", "score", "offending", "predicted", "held_out", "n_lines", "n_dropped", "kept", "mix_shard", "mix_size", "class", "th", "component_id", "__text", "__th", "__col0", "lang", "n_chars")
T = "one two three four five six seven eight nine ten"
U = "quite another text of some ten words that stands alone"


@pytest.fixture
def folder(spark, tmp_path):
    long = " ".join(f"w{i % 9973}" for i in range(50_000))
    texts = [(1, T), (2, T), (2, U), (2, U), (None, T), (None, T), (None, None), (3, None), (4, ""), (5, "\t\n \n"), (6, long), (7, long + " end"), (8, f"before {T} the item words are these seven"), (9, "only\nthe same line")]
    texts += [(100 + i, f"the same line\nown words of {i} {i * 7}") for i in range(12)]
    rows = [(i, t, "s" if k % 3 else None, *[k] * len(CLASHES)) for k, (i, t) in enumerate(texts)]
    schema = "doc_id long, text string, source string, " + ", ".join(f"`{c}` long" for c in CLASHES)
    d = str(tmp_path)
    spark.createDataFrame(rows, schema).write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(100 + i, 1, 0) for i in range(12)] + [(None, None, None)], "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    spark.createDataFrame([(1, "item words are these seven"), (None, "own"), (2, None), (3, "")], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    return d


def test_stages(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, folder)
        assert out.columns[: len(docs.columns)] == docs.columns or name == "mixing"
        rows = out.collect()
        empty = stage(spark, docs.limit(0), folder)
        assert empty.columns == out.columns and empty.count() == 0
        if name == "toxicity":
            assert len(rows) == docs.count()
        if name == "line_dedup":
            left = {r["doc_id"]: r["text"] for r in rows}
            assert left[5] == "\t\n \n" and left[9] == "only\nthe same line" and left[101] == "own words of 1 7" and len(rows) == docs.count()
            assert all(r["n_chars"] == len(r["text"]) for r in rows if r["doc_id"] and r["doc_id"] >= 100)
        if name == "jaccard_join":
            kept = sorted((r["doc_id"], r["text"][:5]) for r in rows if r["doc_id"] is not None and r["doc_id"] < 3)
            assert kept == [(1, "one t"), (2, "quite")]  # the copy goes, the other text of doc_id 2 stays, once
            assert sum(r["doc_id"] is None for r in rows) == 3 and {r["doc_id"] for r in rows} >= {3, 4, 5, 6} and 7 not in {r["doc_id"] for r in rows}
        if name == "decontamination":
            assert len(rows) == docs.count() - 1 and 8 not in {r["doc_id"] for r in rows}


def test_run_cleans_up(spark, folder, tmp_path):
    assert corpus_pipeline.run(spark, folder).count() > 10


def test_neighbours_without_and_with_repeated_ids(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(300, 8))
    rows = [(i if i % 7 else None, v.tolist()) for i, v in enumerate(x)] + [(50, x[51].tolist()), (50, x[52].tolist()), (50, None)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = [(r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in ann.search(df, df.filter("vec_id % 50 = 0")).collect()]
    ids = [(i, np.array(v)) for i, v in rows if i is not None and v is not None]
    for q in {i for i, _ in ids if i % 50 == 0}:
        best = {}
        for _, own in [r for r in ids if r[0] == q]:
            for i, v in ids:
                if i != q:
                    s = float(own @ v / np.linalg.norm(own) / np.linalg.norm(v))
                    best[i] = max(best.get(i, -2), s)
        found = sorted(r[1:] for r in got if r[0] == q)
        assert [r[0] for r in found] == [1, 2, 3, 4, 5] and all(abs(best[r[1]] - r[2]) < 1e-9 for r in found)
        assert len({r[1] for r in found} & set(sorted(best, key=lambda i: -best[i])[:5])) >= 4


def test_short_items(spark):
    docs = spark.createDataFrame([(1, "say Hello, dear world"), (2, "nothing here")], "doc_id long, text string")
    items = spark.createDataFrame([(1, "hello, dear"), (2, "world")], "item_id long, text string")
    assert {(r["doc_id"], r["item_id"]) for r in decontaminate.matches(docs, items).collect()} == {(1, 1), (1, 2)}
    assert decontaminate.matches(docs, items.limit(0)).count() == 0


def test_empty_tables(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, lang string")
    assert pii.find_personal_data(docs).count() == 0
    assert line_dedup.dedup_lines(docs).count() == 0
    assert toxicity.toxicity(docs, spark.createDataFrame([], "doc_id long, toxic int")).count() == 0
    assert html_extract.extract_main_text(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_long_identifiers(spark):
    token = "a1" * 400
    docs = spark.createDataFrame([(i, f"the access key : {token}{i} stands here") for i in range(8)] + [(100 + i, f"the access key : user{i}@example.org stands here") for i in range(60)], "doc_id long, text string")
    found = pii.find_personal_data(docs).filter("doc_id < 100").select(F.expr("size(filter(discovered, x -> not x.seed))").alias("n")).collect()
    assert [r["n"] for r in found] == [1] * 8
