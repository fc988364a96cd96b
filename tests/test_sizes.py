"""What shows only on larger tables or longer rows than the smallest ones have."""

import random

import duckdb
import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from quire.functions.text import base_code
from quire.operators import evaluation as E
from quire.plans import catalog, eval_queries
from quire.plans import model as M

ALPHABET = "0123456789abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ"


def against_sql(spark, folder, name, table, rows):
    """Rows of a query over one table, Spark's and its SQL's, in one order."""
    rows.coalesce(1).write.parquet(f"{folder}/{table}.parquet")
    df = catalog.QUERIES[name](spark, str(folder))
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{folder}/{table}.parquet/*.parquet'")
    cur = con.execute(catalog.ORACLE[name])
    names = [c[0] for c in cur.description]
    plain = lambda r: tuple(str(r[c]) for c in range(len(names)))
    return sorted(map(plain, df.select(names).collect())), sorted(map(plain, cur.fetchall()))


def test_p14_pages_of_five_places(spark, tmp_path):
    docs = spark.range(10_050).selectExpr("id as doc_id", "if(id < 10020, 'a', 'b_c') as source", "'one two' as text")
    got, want = against_sql(spark, tmp_path, "p14_page_numbers", "documents", docs)
    assert got == want and max(int(r[1]) for r in got) == 10_020


def test_p20_numbers_just_below_a_multiple(spark):
    numbers = sorted({m * 62**k + by for k in range(11) for m in (1, 2, 61, 62) for by in (-1, 0, 1) if 0 <= m * 62**k + by < 1 << 63} | {(1 << 63) - 1})

    def code(n):
        out = ""
        while n or len(out) < 3:
            out, n = ALPHABET[n % 62] + out, n // 62
        return out

    got = spark.createDataFrame([(n,) for n in numbers], "n long").select("n", base_code(F.col("n"), ALPHABET, 3).alias("c")).collect()
    assert {r["n"]: r["c"] for r in got} == {n: code(n) for n in numbers}


def test_words_are_not_shuffled(spark):
    """Texts meet their pages before they are split: no exchange of words, nor of their lines and regions."""
    docs = spark.createDataFrame([(k, f"s{k % 2}", "one two\n\nthree  four\n" * k) for k in range(6)], "doc_id long, source string, text string")
    ws = M.words(docs)
    for df in (ws, M.line_containers(ws), M.regions(ws)):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert 0 < plan.index("Generate ") < plan.index("Exchange ")
    rows = [(r["doc_id"], r["pos"], r["word_idx"], r["text"], r["x1"], r["y1"]) for r in ws.orderBy("source", "word_idx").collect()]
    assert rows[8:12] == [(4, 0, 8, "one", 0, 0), (4, 1, 9, "two", 40, 0), (4, 2, 10, "three", 0, 80), (4, 3, 11, "four", 60, 80)]


def test_a17_makes_words_once(spark, tmp_path):
    docs = spark.range(30).selectExpr("id as doc_id", "concat('s', id % 2) as source", "repeat('one two\nthree  four five\n\nsix\n', int(id % 7)) as text")
    got, want = against_sql(spark, tmp_path, "a17_average_precision", "documents", docs)
    assert got == want and len(got) == 5
    plan = catalog.QUERIES["a17_average_precision"](spark, str(tmp_path))._jdf.queryExecution().executedPlan().toString()
    assert "posexplode" not in plan  # words are made before, in one pass, not in each of three branches
    assert "unboundedfollowing" not in plan.lower()  # quadratic in a label's predictions


def test_bag_of_words_measures_few_pairs(monkeypatch):
    """The nearest word left, the first on ties, as by all pairs, but distances only of words whose letters allow it."""
    rng, calls, plain = random.Random(2), [0], E.distance
    words = ["".join(rng.choices("abcdefghiklmnoprstu", k=rng.randrange(4, 9))) for _ in range(400)]
    gt = [rng.choice(words) for _ in range(500)]
    pred = [w.translate(str.maketrans("eao", "coa")) if i % 7 == 0 else w for i, w in enumerate(gt) if i % 31]
    left, true, total = list(pred), 0, 0
    for w in gt:
        if not left:
            total += len(w)
            continue
        far = [0 if w == x else plain(w, x) for x in left]
        k = far.index(min(far))
        total, true = total + far[k], true + (far[k] == 0)
        left.pop(k)
    want = (len(gt), len(pred), true, sum(map(len, gt)), total + sum(map(len, left)))

    def counted(a, b):
        calls[0] += 1
        return plain(a, b)

    monkeypatch.setattr(E, "distance", counted)
    assert E.bag_of_words(gt, pred) == want
    print("distances", calls[0])
    assert calls[0] < 4000


def test_bags_of_words_of_many_pages():
    """Pages that go on side by side give what each gives by all pairs: ties, long words, empty sides, words taken by others."""
    rng = random.Random(3)
    kinds = ["ab", "abc", "eao", "abcdefgh", "été", "\u4e2d\u6587\U00020000", "x\0", "q" * 99, "ab" * 60, "ba" * 150]
    word = lambda: rng.choice(kinds) if rng.random() < 0.2 else "".join(rng.choices("aabcdeé", k=rng.randint(1, 9)))
    pages, want = [([], []), (["ab"], []), ([], ["ab", "c"])], []
    for _ in range(60):
        gt = [word() for _ in range(rng.randint(0, 90))]
        pages.append((gt, [w.translate(str.maketrans("eao", "coa")) if i % 4 == 0 else w for i, w in enumerate(gt) if i % 5] + [word() for _ in range(rng.randint(0, 9))]))
    for gt, pred in pages:
        left, true, total = list(pred), 0, 0
        for w in gt:
            d, k = min((E.bit_distance(w, x), k) for k, x in enumerate(left)) if left else (len(w), 0)
            true, total = true + (bool(left) and d == 0), total + d
            del left[k : k + 1]
        want.append((len(gt), len(pred), true, sum(map(len, gt)), total + sum(map(len, left))))
    words = sorted({w for page in pages for side in page for w in side})
    number = {w: k for k, w in enumerate(words)}
    assert E.bags_of_words(words, [tuple(np.array([number[w] for w in side], np.int64) for side in page) for page in pages]) == want


def test_a01_deals_pages_to_all_tasks(spark, tmp_path, monkeypatch):
    """Words are never rows, and the few bytes of many pages are not gathered in one task."""
    docs = spark.range(40).selectExpr("id as doc_id", "concat('s', id % 2) as source", "if(id = 3, null, repeat('one two  eat\n\nthree\n', int(id % 9))) as text")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    df = catalog.QUERIES["a01_j10_bag_of_words"](spark, str(tmp_path))
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "explode" not in plan and "REPARTITION_BY_NUM" in plan
    ws = M.words(M.table(spark, str(tmp_path), "documents"))
    monkeypatch.setattr(E, "TOGETHER", 50)  # pages of a batch are taken in parts
    got = catalog.QUERIES["a01_j10_bag_of_words"](spark, str(tmp_path)).first()
    assert got == df.first() and got["gt_words"] == ws.count() and got["pred_words"] == M.noisy(ws).count()
    sides = [{}, {}]
    for side, frame in zip(sides, (ws, M.noisy(ws))):
        for r in frame.orderBy("word_idx").collect():
            side.setdefault(r["doc_id"], []).append(r["text"])
    assert {r["doc_id"]: (r["gt"], r["pred"]) for r in M.page_readings(docs).collect() if r["gt"]} == {k: (gt, sides[1].get(k, [])) for k, gt in sides[0].items()}


def test_boxes_of_one_line_meet_few_others(spark, tmp_path, monkeypatch):
    """A page of one long line: boxes are looked up along it too, and words are made once for both readings."""
    n, asked, plain = 3000, [0], np.minimum
    gt = np.array([(70 * k, 0, 70 * k + 59, 29) for k in range(n)])
    frame = pd.DataFrame([(side, k, *(b + k % 3 * (side == "pred"))) for side in ("gt", "pred") for k, b in enumerate(gt)], columns=["side", "n", "x1", "y1", "x2", "y2"])

    def counted(a, b, *more):
        asked[0] += np.size(b)
        return plain(a, b, *more)

    monkeypatch.setattr(E.np, "minimum", counted)
    assert E.greedy_boxes(frame, 0.8) == [(k, n + k) for k in range(n)]
    assert 0 < asked[0] < 20 * n
    monkeypatch.undo()
    docs = spark.createDataFrame([(k, "s", "one two\nthree  four five\n" * k) for k in range(9)], "doc_id long, source string, text string")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    df = eval_queries.two_sides(spark, str(tmp_path))
    assert df._jdf.queryExecution().executedPlan().toString().count("posexplode") == 1
    ws = M.words(docs)
    cols = ["doc_id", "word_idx", "text", "x1", "y1", "x2", "y2"]
    rows = lambda frame: sorted(map(tuple, frame.collect()))
    assert rows(df.filter("side = 'gt'").drop("side")) == rows(ws.select(cols)) and rows(df.filter("side = 'pred'").drop("side")) == rows(M.noisy(ws).select(cols))


def test_j06_goes_through_a_page_in_arrays(spark, tmp_path):
    """Words are made for the annotations and for their pages, not for each join; long lines and pages as in SQL."""
    docs = spark.range(12).selectExpr("id as doc_id", "concat('s', id % 2) as source", "repeat(concat(repeat('one three  of ', 1 + int(id * 9)), '\\n\\nfive\\n'), int(id)) as text")
    got, want = against_sql(spark, tmp_path, "j06_relaxed_words", "documents", docs)
    assert got == want and {r[2] for r in got} == {"inside", "wide", "nearest"}
    plan = catalog.QUERIES["j06_relaxed_words"](spark, str(tmp_path))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("posexplode") <= 2
