"""Large groups of distinct texts that share a passage, against all pairs; parity sketches of any size."""

import random

import numpy as np
import pandas as pd
import pytest

from quire.llm import jaccard
from quire.llm.components import components as connected
from quire.llm.components import thinned

SCHEMA = "doc_id long, text string"


def components(texts):
    sets = [{tuple(w[i : i + 5]) for i in range(len(w) - 4)} for w in (t.split() for t in texts)]
    at = {}
    for s in sets:
        for g in s:
            at.setdefault(g, len(at))
    m = np.zeros((len(texts), len(at)), np.float32)
    for i, s in enumerate(sets):
        m[i, [at[g] for g in s]] = 1
    both, n = m @ m.T, m.sum(1)
    link = 100 * both >= 75 * (n[:, None] + n[None, :] - both) - 1e-3
    label = np.arange(len(texts))
    while True:
        new = np.array([label[row].min() for row in link])
        new = new[new]
        if np.array_equal(new, label):
            return label.tolist()
        label = new


@pytest.mark.parametrize("seed", [0, 1])
def test_group_of_distinct_texts(spark, seed):
    random.seed(seed)
    word = lambda: f"w{random.randrange(10**7)}"
    passage = [word() for _ in range(40)]
    texts = [passage + [word() for _ in range(random.randrange(0, 40))] for _ in range(2000 if seed else 1200)]
    for k in range(0, len(texts), 40):  # copies with another last word
        texts.append(texts[k][:-1] + [word()])
    texts = [" ".join(t) for t in texts]
    got = {r["doc_id"]: r["component_id"] for r in jaccard.similar_documents(spark.createDataFrame(list(enumerate(texts)), SCHEMA)).collect()}
    assert got == dict(enumerate(components(texts)))


def test_sketch_distance_is_a_lower_bound(spark):
    rng = np.random.default_rng(5)
    d, s, n, sets = [], [], [], []
    for i in range(60):
        if i % 2:
            own = np.unique(np.concatenate([sets[-1][: len(sets[-1]) * 9 // 10], rng.integers(0, 1 << 62, 3, dtype=np.uint64)]))
        else:
            own = np.unique(rng.integers(0, 1 << 62, int(rng.integers(1, 600)), dtype=np.uint64))
        sets.append(own)
        d.append(np.full(len(own), i))
        s.append(own)
        n.append(len(own))
    rows = jaccard.sketches(np.concatenate(d), np.concatenate(s), np.array(n)).to_pylist()
    pairs = [(i, i + 1, rows[i], rows[i + 1]) for i in range(0, 60, 2) if 3 * max(n[i], n[i + 1]) <= 4 * min(n[i], n[i + 1])]
    df = spark.createDataFrame(pairs, "a long, b long, x array<bigint>, y array<bigint>")
    for r in df.select("a", "b", jaccard.sketch_distance("x", "y").alias("far")).collect():
        apart = len(np.setxor1d(sets[r["a"]], sets[r["b"]]))
        assert 0 <= r["far"] <= apart and (r["far"] - apart) % 2 == 0
    assert len(pairs) > 15


def test_a_pair_that_groups_share_is_one_row():
    """rivals() and once() against all pairs of callers and members, with several groups of the same members."""
    rng = np.random.default_rng(1)
    ids, own = rng.integers(-(2**62), 2**62, 40), [rng.integers(-(2**62), 2**62, 2) for _ in range(40)]
    sketch = [own[0] if i % 2 else x for i, x in enumerate(own)]
    for groups, buckets in ((5, 7), (3, 1)):
        rows = [(g, 0, c, 60 + i % 3, c, caller, sketch[i], buckets) for g in range(groups) for i, c in enumerate(ids) for caller in (False, True) if i < 7 or not caller]
        packed = jaccard.rivals(pd.DataFrame(rows, columns=["a", "part", "b", "n", "component", "caller", "sketch", "buckets"]))
        found = [p for _, x in pd.concat([packed, packed]).groupby("bucket") for p in jaccard.once(x).itertuples(index=False, name=None)]
        far = lambda i, j: sum(((int(x) ^ int(y)) & 2**64 - 1).bit_count() for x, y in zip(sketch[i], sketch[j]))
        want = {tuple(sorted((ids[i], ids[j]))) for i in range(7) for j in range(40) if i != j and 7 * far(i, j) <= 120 + i % 3 + j % 3}
        assert len(found) == len(set(found)) and set(found) == want


def test_no_task_over_edges_takes_two_python_workers(spark):
    """The passes follow each other through a file, not in one task."""
    edges = spark.createDataFrame([(1, 2), (2, 3), (1, 3), (7, 8)], "a long, b long")
    thin = thinned(edges)
    assert thin._jdf.queryExecution().executedPlan().toString().count("MapInArrow") <= 1
    assert sorted(map(sorted, thin.collect())) == [[1, 2], [2, 3], [7, 8]]
    assert dict(connected(edges).collect()) == {1: 1, 2: 1, 3: 1, 7: 7, 8: 7}


def test_edges_of_a_group_are_thinned(spark):
    """Two cliques and a chain: the same components by fewer edges than pairs."""
    edges = [(a, b) for lo in (0, 100) for a in range(lo, lo + 60) for b in range(a) if b >= lo] + [(200 + k, 201 + k) for k in range(50)]
    random.Random(3).shuffle(edges)
    df = spark.createDataFrame(edges, "a long, b long").repartition(4)
    thin = thinned(df.select("a", "b")).collect()
    assert 59 + 59 + 50 <= len(thin) <= 4 * (59 + 59) + 50 and {tuple(r) for r in thin} <= set(edges)
    got = {r["node"]: r["component"] for r in connected(df).collect()}
    assert got == {n: lo for lo, hi in ((0, 60), (100, 160), (200, 251)) for n in range(lo, hi)}


def test_small_joins_have_few_partitions(spark):
    """Tasks must not grow with the input's partitions where classes and pairs are joined; the setting comes back."""
    n = spark.conf.get("spark.sql.shuffle.partitions")
    texts = [" ".join(f"w{i % 40}x{j}" for j in range(30)) + f" end{i}" for i in range(120)]
    used = []
    old = jaccard.sketched
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "64")
        jaccard.sketched = lambda pairs, known: used.append((spark.conf.get("spark.sql.shuffle.partitions"), known.rdd.getNumPartitions())) or old(pairs, known)
        got = jaccard.similar_documents(spark.createDataFrame(list(enumerate(texts)), SCHEMA)).collect()
        assert spark.conf.get("spark.sql.shuffle.partitions") == "64"
    finally:
        jaccard.sketched = old
        spark.conf.set("spark.sql.shuffle.partitions", n)
    assert used and set(used) == {(str(jaccard.LEAST_PARTS), jaccard.LEAST_PARTS)}
    assert {r["doc_id"]: r["component_id"] for r in got} == {i: i % 40 for i in range(120)}


def test_small_joins_are_planned_once(spark):
    """A plan that is made again after each stage runs a job for every exchange: the driver keeps something of all of them."""
    sc, texts = spark.sparkContext, [" ".join(f"w{i % 40}x{j}" for j in range(30)) + f" end{i}" for i in range(120)]
    sc.setJobGroup("small joins", "")
    try:
        got = jaccard.similar_documents(spark.createDataFrame(list(enumerate(texts)), SCHEMA)).collect()
    finally:
        sc.setLocalProperty("spark.jobGroup.id", None)
    assert {r["doc_id"]: r["component_id"] for r in got} == {i: i % 40 for i in range(120)}
    print("jobs", len(sc.statusTracker().getJobIdsForGroup("small joins")))
    assert len(sc.statusTracker().getJobIdsForGroup("small joins")) < 80
    assert spark.conf.get("spark.sql.adaptive.enabled") == "true"
