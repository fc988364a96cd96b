"""The pipeline's stages on a small corpus whose fate is known."""

import random

import pytest

import corpus_pipeline


def test_stages(spark, tmp_path):
    random.seed(4)
    voc = ["".join(random.choice("abcdefghij") for _ in range(random.randint(3, 7))) for _ in range(800)]
    prose = lambda n: " ".join(random.choice(voc) for _ in range(n))
    rows = [(i, "\n".join(prose(40) for _ in range(4)), "en", f"s{i % 3}", 0) for i in range(200)]
    item = prose(30)
    rows[10] = (10, rows[10][1] + "\n" + item, "en", "s1", 0)
    near = rows[20][1].split(" ")
    near[5] = "changed"
    rows[21] = (21, " ".join(near), "en", "s0", 0)
    toxic = set(range(1, 200, 7))
    rows = [(i, t + (" such an idiot" if i in toxic else ""), a, b, c) for i, t, a, b, c in rows]
    rows = [(i, t + ("\nthe shared line of text" if i % 4 == 0 else ""), a, b, c) for i, t, a, b, c in rows]
    d = str(tmp_path)
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(i, 1, int(i in toxic)) for i in range(200)], "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    docs, kept = spark.read.parquet(f"{d}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, d)
        kept.append({r["doc_id"] for r in docs.select("doc_id").collect()})
    everything = set(range(200))
    assert kept[0] == everything - toxic
    assert kept[1] == kept[0]
    assert kept[2] == kept[1] - {21}
    assert kept[3] == kept[2] - {10}
    assert kept[4] <= kept[3] and len(kept[4]) > 100
    assert len(corpus_pipeline.run(spark, d).columns) == 8


def test_sample_starts_no_python_on_executors(spark, monkeypatch):
    """Executors keep the workers that a table made of Python rows starts beside those of the other steps."""
    from pyspark import SparkContext

    from quire.llm.toxicity import sample

    docs = spark.createDataFrame([(i, f"text {i}") for i in range(20)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(20)], "doc_id long, toxic int")
    monkeypatch.setattr(SparkContext, "parallelize", lambda *a, **b: pytest.fail("rows are made by Python workers"))
    texts, y = sample(docs, labels)
    assert texts and all(int(t.split()[1]) % 2 == k for t, k in zip(texts, y))
