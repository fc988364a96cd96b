"""Golden values of intervals, boxes, charsets and evaluation."""

import os
import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from quire.functions import geometry as G
from quire.functions import interval as I
from quire.functions import text as T
from quire.operators import datasets as D
from quire.operators import evaluation as E
from quire.operators import labels as B
from quire.operators import layout_eval as L


def one(spark, *cols):
    return tuple(spark.range(1).select(*cols).first())


def test_intervals(spark):
    lit = lambda *v: [F.lit(x) for x in v]
    assert one(spark, I.overlap_length(*lit(1, 10, 2, 8)), I.overlap_length(*lit(1, 10, 8, 15)), I.overlap_length(*lit(1, 10, 11, 20))) == (7, 3, 0)
    assert one(spark, I.within(*lit(2, 8, 1, 10)), I.within(*lit(1, 10, 1, 10)), I.within(*lit(8, 15, 1, 10)), I.within(*lit(11, 20, 1, 10))) == (True, True, False, False)
    spans = lambda *p: F.array(*[F.struct(F.lit(a).alias("s"), F.lit(b).alias("e")) for a, b in p])
    base = spans((1, 10), (15, 15), (16, 20))
    assert one(spark, I.all_within(spans((1, 10), (19, 20)), base), I.all_within(spans((2, 12)), base), I.all_within(spans((0, 0), (30, 40)), base)) == (True, False, False)


def test_boxes(spark):
    b = lambda *v: G.Box(*[F.lit(x) for x in v])
    base, inner, over, off = b(0, 0, 2, 2), b(0, 0, 1, 1), b(1, 1, 3, 3), b(5, 5, 7, 7)
    assert one(spark, base.width, base.height, base.area) == (3, 3, 9)
    assert one(spark, base.overlap_area(inner), base.overlap_area(base), base.overlap_area(off)) == (4, 9, 0)
    assert one(spark, base.mostly_inside(over, 0.2), base.mostly_inside(over, 5 / 9)) == (True, False)
    assert one(spark, base.iou_at_least(over, 4 / 14), base.iou_at_least(over, 5 / 14)) == (True, False)
    points = F.array(*[F.struct(F.lit(x).alias("x"), F.lit(y).alias("y")) for x, y in ((0, 0), (2, 0), (1, 1), (2, 2), (0, 2))])
    box = G.from_points(points)
    assert one(spark, box.x1, box.y1, box.x2, box.y2) == (0, 0, 2, 2)
    assert one(spark, G.from_xywh(F.lit(1), F.lit(2), F.lit(3), F.lit(4)).width) == (4,)


def test_charsets(spark):
    t = F.lit("abdεθ-:123ξ,")
    assert one(spark, *[T.count_charset(t, c) for c in T.CHARSETS]) == (3, 3, 3, 3)
    assert one(spark, T.string_charset(F.lit("ab12")), T.is_charset(F.lit(""), "latin"), T.string_charset(F.lit("αβ1"))) == ("latin", False, "greek")


def test_text(spark):
    assert one(spark, T.harmonise(F.lit("ﬁn ‘a’  …×")), T.harmonise_linebreaks(F.lit("a\nb\n\nc\n\n\n\nd")), T.dehyphenate(F.lit("wo- rd é- t"))) == ("fin ‘a’ ...x", "a b\n\nc\n\n\nd", "word ét")
    assert one(spark, T.following(F.lit("12f.")), T.scope(F.lit("(12 ff.")), T.following(F.lit("12")), T.following(F.lit("ivf.")), T.scope(F.lit("1ff.2f.,"))) == ("12-13", ":12 ", "12", "iv", ":12f")
    assert one(spark, T.nfc(F.lit("é")), T.remove_diacritics(F.lit("Ἀθήνη é"))) == ("é", "Αθηνη e")
    assert T.beta_code("*)aqh/nh") .startswith("Ἀ")


def test_edit_scripts():
    gt, pred = "abdεθ-:123ξ,", "aaedεx-x1x3ξ,"
    assert E.charset_errors(gt, pred) == {"latin": 2, "greek": 1, "numeral": 1, "punctuation": 1}
    for a, b in (("", "abc"), ("kitten", "sitting"), ("aaaa", "aa"), ("abc", "")):
        assert len(E.edit_script(a, b)) == E.distance(a, b)


def test_bag_of_words():
    gt = "soleil maison je 122 courage".split()
    n, m, true, chars, d = E.bag_of_words(gt, "soleil maeson je 122.cou".split())
    assert (d, true / m, true / n, 1 - d / chars) == (12, 0.5, 0.4, 0.5)
    n, m, true, chars, d = E.bag_of_words(gt, "soleil maeson je 123 courage sole".split())
    assert (d, true / m, true / n, 1 - d / chars) == (6, 0.5, 0.6, 0.75)


def test_alignment(spark):
    labels = F.array(*map(F.lit, ("O", "B-PERS", "I-PERS")))
    ids = F.array(F.lit(None).cast("int"), *[F.lit(x) for x in (0, 0, 1, 1, 2, 2)])
    aligned = B.align_to_tokens(labels, ids, F.lit("-"))
    assert one(spark, aligned) == (["-", "O", "-", "B-PERS", "-", "I-PERS", "-"],)
    assert one(spark, B.align_from_tokens(aligned, ids)) == (["O", "B-PERS", "I-PERS"],)
    assert one(spark, B.greedy_decode(F.split(F.lit("0aa0ab"), ""), "0")) == ("aab",)


def test_order():
    assert L.in_reading_order([(50, 0, 90, 10), (0, 2, 40, 12), (0, 30, 40, 40)]) == [1, 0, 2]
    assert L.trimmed_mean([1, 2, 3, 4, 100]) == 3 and L.trimmed_mean([]) == 0
    assert len(L.merged_lines([(0, 0, 100, 20)], [(0, 1, 100, 21), (0, 40, 100, 60)])) == 2


def test_chunks(spark):
    assert one(spark, D.chunk_count(F.lit(1000), 400, 100), D.chunk_padding(F.lit(1000), 400, 100)) == (3, 0)


def test_pages_by_index():
    """The indexed page algorithms against plain loops."""
    rng = random.Random(6)
    for _ in range(60):
        gt, pred = (["".join(rng.choice("ab") for _ in range(rng.randint(1, 6))) for _ in range(rng.randint(0, 25))] for _ in range(2))
        left, true, total = list(pred), 0, 0
        for word in gt:
            if left:
                d, i = min((E.distance(word, w), i) for i, w in enumerate(left))
                true, total = true + (d == 0), total + d
                left.pop(i)
            else:
                total += len(word)
        assert E.bag_of_words(gt, pred) == (len(gt), len(pred), true, sum(map(len, gt)), total + sum(map(len, left)))

        boxes = [(x, y, x + rng.randint(0, 30), y + rng.randint(0, 90)) for x, y in ((rng.randint(0, 60), rng.randint(0, 300)) for _ in range(60))]
        left, want = sorted(range(60), key=lambda i: boxes[i][1]), []
        while left:
            top = boxes[left[0]]
            shared = lambda b: max(0, min(top[3], b[3]) + 1 - max(top[1], b[1]))  # noqa: B023, E731
            level = [i for i in left if i == left[0] or shared(boxes[i]) > 0.6 * min(top[3] - top[1] + 1, boxes[i][3] - boxes[i][1] + 1)]
            want.append(min(level, key=lambda i: boxes[i][0]))
            left.remove(want[-1])
        assert L.in_reading_order(boxes) == want

        frame = pd.DataFrame([("gt" if i < 30 else "pred", i, *b) for i, b in enumerate(boxes)], columns=["side", "n", "x1", "y1", "x2", "y2"])
        left, want = list(range(30, 60)), []
        for i in range(30):
            k = next((k for k in left if L.iou_of(boxes[i], boxes[k]) >= 0.1), None)
            if k is not None:
                want.append((i, k))
                left.remove(k)
        assert E.greedy_boxes(frame, 0.1) == want


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="no tables")
def test_whole_pages(spark):
    """Bag of words, greedy boxes and reading order take every word of a page."""
    from quire.plans import eval_queries as Q
    from quire.plans import model as M

    d = "/root/testdata/sf0.001"
    n = M.words(M.table(spark, d, "documents")).count()
    assert Q.reading_order(spark, d).count() == n
    assert Q.bag_of_words(spark, d).first()["gt_words"] == n
    pairs = Q.greedy_boxes(spark, d)
    assert pairs.agg(F.max("gt_n")).first()[0] > 0.9 * n / M.table(spark, d, "documents").select("source").distinct().count()


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="no tables")
def test_whole_lines(spark):
    """The record by line reads lines beyond 60 characters."""
    from quire.plans import eval_queries as Q

    pairs = Q.line_pairs(spark, "/root/testdata/sf0.001", whole=True)
    assert pairs.agg(F.max(F.char_length("gt"))).first()[0] > 60
    record = Q.line_record(spark, "/root/testdata/sf0.001")
    assert record.agg(F.max(F.char_length("gt"))).first()[0] == pairs.agg(F.max(F.char_length("gt"))).first()[0]


def test_lines_of_two_detectors():
    from quire.operators.layout_eval import merged_lines

    single = [(0, 100 * i, 999, 100 * i + 29) for i in range(8)]  # mean height 30
    assert merged_lines(single, []) == single
    assert merged_lines([*single, (0, 900, 999, 909)], []) == single  # flat: 10 is not above 0.35 * 30
    assert merged_lines(single, [(0, 900, 999, 909), (0, 950, 999, 979)]) == [*single, (0, 950, 999, 979)]
    tall = (0, 1000, 999, 1059)
    parts = [(0, 1000, 999, 1025), (0, 1030, 999, 1059)]
    assert merged_lines([*single, tall], parts) == [*single, *parts]
    assert merged_lines([*single, tall], [(2, 1001, 990, 1057)]) == [*single, tall]  # one part, double too
    assert merged_lines([*single, tall], []) == single  # a double line without parts
    assert merged_lines([*single, tall], parts[:1]) == [*single, parts[0]]  # one single part: the line goes, the part is added
    halves = [(0, 2, 399, 27), (700, 2, 999, 27)]
    assert merged_lines(single, halves, split=True)[:2] == [(0, 0, 399, 29), (399 + 200, 0, 999, 29)]
    assert merged_lines([], []) == []


def test_word_distance_against_the_table():
    rng = random.Random(5)
    for _ in range(300):
        a, b = ([rng.choice("ab cd ef g".split()) for _ in range(rng.randrange(9))] for _ in range(2))
        assert E.bit_distance(a, b) == E.distance_table(a, b)[-1][-1]


def test_a_truth_is_hit_once_and_under_its_label(spark):
    truths = spark.createDataFrame([(1, "x", 0, 0, 0, 9, 9), (1, "y", 1, 0, 0, 9, 9)], "doc_id long, label string, n int, x1 int, y1 int, x2 int, y2 int")
    found = [(1, "x", 1, 5, 0, 0, 9, 9), (1, "x", 2, 7, 0, 0, 9, 8), (1, "y", 3, 5, 0, 0, 9, 4), (2, "x", 4, 9, 0, 0, 9, 9), (1, "z", 5, 1, 0, 0, 9, 9)]
    predictions = spark.createDataFrame(found, "doc_id long, label string, id long, conf int, x1 int, y1 int, x2 int, y2 int")
    hits = {r.id: r.hit for r in L.first_hits(predictions, truths).collect()}
    assert hits == {1: 0, 2: 1, 3: 0, 4: 0, 5: 0}  # half an overlap is not more than half


def test_words_under_drawn_boxes(spark):
    shape = "x1 int, y1 int, x2 int, y2 int"
    words = spark.createDataFrame([(1, w, w * 100, 60, w * 100 + 79, 99) for w in range(6)], f"doc_id long, word_idx long, {shape}")
    drawn = [
        (1, 10, 0, 90, 50, 190, 110), (1, 10, 1, 300, 50, 400, 110),  # two boxes, a word inside each
        (1, 11, 0, 130, 60, 199, 99),  # grown by 14 it holds 64 of 80 columns: eight tenths are not more than eight
        (1, 12, 0, 100, 400, 180, 420),  # far below
        (2, 13, 0, 0, 0, 9, 9),  # a page without words
    ]
    boxes = spark.createDataFrame(drawn, f"doc_id long, k int, box_no int, {shape}")
    found = {r.k: (r.how, list(r.words)) for r in L.drawn_words(boxes, words).collect()}
    assert found == {10: ("inside", [1, 3]), 11: ("wide", [1]), 12: ("nearest", [1])}


def test_error_rates_of_whole_lines_against_the_table(spark, tmp_path):
    from quire.plans import catalog

    rng = random.Random(7)
    texts = ["\n".join(" ".join(rng.choice(["one", "sea", "oak  tree", "by", "area"]) for _ in range(rng.randrange(1, 9))) for _ in range(5)) for _ in range(4)]
    rows = [(i, "s", t) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, source string, text string").write.parquet(f"{tmp_path}/documents.parquet")
    want = [0] * 5
    for text in texts:
        for i, gt in enumerate(text.split("\n")):
            ocr = gt.translate(str.maketrans("eao", "coa")) + (" x" if i % 3 == 0 else "")
            pair = (len(gt), E.distance_table(gt, ocr)[-1][-1], len(gt.split(" ")), E.distance_table(gt.split(), ocr.split())[-1][-1])
            want = [a + b for a, b in zip(want, (1, *pair))]
    got = catalog.QUERIES["a04_word_error_rate"](spark, str(tmp_path)).first()
    assert [got[c] for c in ("n_lines", "chars", "chars_distance", "words", "words_distance")] == want
    assert (got.chars_er, got.words_er) == (round(want[2] / want[1], 3), round(want[4] / want[3], 3))
