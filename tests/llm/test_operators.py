"""The operators against brute force, on small tables with nulls, empty and long texts, repeated rows and clashing columns."""

import hashlib
import random
import re
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quire.llm import ann, decontaminate, html_extract, jaccard, line_dedup, mixing, pii, repeats, tokens, toxicity

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def docs_of(spark, rows):
    return spark.createDataFrame([(i, t, "en", s, len(t or "")) for i, t, s in rows], SCHEMA)


def awkward(spark, extra=()):
    """Nulls in every column, empty and long texts, repeated rows."""
    long = " ".join(f"w{i % 997}" for i in range(60_000))
    rows = [(1, "a b c d e f g", "x"), (1, "a b c d e f g", "x"), (2, "a b c d e f g", None), (3, None, "y"), (4, "", "y"), (None, "a b c d e f g", "x"), (None, None, None), (5, long, "z"), (6, "\n\n \n", "z"), *extra]
    return docs_of(spark, rows)


def test_neighbours(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(600, 8)).astype(np.float32)
    x[10:40] = x[0]
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(600, None), (601, [0.0] * 8), (602, [float("nan")] * 8), (603, [1.0, None] + [0.0] * 6)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = {(r["query_id"], r["rank"]): (r["vec_id"], r["score"]) for r in ann.search(df, df.filter("vec_id % 50 = 0")).collect()}
    unit = x.astype(float) / np.linalg.norm(x.astype(float), axis=1, keepdims=True)
    hits = 0
    for q in range(0, 600, 50):
        s = unit @ unit[q]
        s[q] = -2
        best = sorted(range(600), key=lambda i: (-round(s[i], 12), i))[:5]
        hits += len({got[(q, k)][0] for k in range(1, 6)} & set(best))
        assert all(abs(got[(q, k)][1] - s[got[(q, k)][0]]) < 1e-12 for k in range(1, 6))
    assert hits >= 0.9 * 60
    assert [got[(0, k)][0] for k in range(1, 6)] == [10, 11, 12, 13, 14]
    assert ann.search(df.limit(0), df.limit(0)).count() == 0


def test_mix(spark):
    random.seed(2)
    rows = [(i, " ".join(["w"] * random.randint(0, 50)), random.choice(["a", "a", "a", "b", "c", None])) for i in range(3000)]
    df = docs_of(spark, rows + rows[:3])
    a, b = ({tuple(r) for r in mixing.mix_report(df, n_shards=5).select("doc_id", "size", "source_size", "target", "taken", F.col("shards").cast("string")).collect()} for _ in range(2))
    assert a == b
    size = {}
    for _, t, s in rows + rows[:3]:
        size[s] = size.get(s, 0) + len(t.split())
    total, names = sum(size.values()), ["a", "b", "c", None]
    weight, capped = dict(zip(names, (5, 2, 1, 5))), set()
    while True:  # share, cap, share again
        left = total - sum(3 * size[s] for s in capped)
        target = {s: 3 * size[s] if s in capped else left * weight[s] / sum(weight[x] for x in names if x not in capped) for s in names}
        over = {s for s in names if s not in capped and target[s] > 3 * size[s] + 1e-9}
        if not over:
            break
        capped |= over
    report = mixing.mix_report(df, n_shards=5).collect()
    source = {i: s for i, _, s in rows}
    assert len(report) == 3003 and all(0 <= r["taken"] <= 3 * r["size"] and len(r["shards"]) == r["n_copies"] for r in report)
    for s in names:
        assert abs(sum(r["taken"] for r in report if source[r["doc_id"]] == s) - target[s]) <= 50
        assert all(abs(r["target"] - target[s]) < 1e-6 for r in report if source[r["doc_id"]] == s)
    out = mixing.mix_report(awkward(spark)).collect()
    assert len(out) == 9
    assert mixing.mix_report(awkward(spark).limit(0)).count() == 0


def test_splitting_tree(spark):
    q = spark.createDataFrame([([40, 7, 0, 13],)], "quotas array<bigint>")
    parts = mixing.split_quotas(q, 7, 3).collect()
    assert len(parts) == 7 and [sum(p["quotas"][i] for p in parts) for i in range(4)] == [40, 7, 0, 13]
    assert all(8 <= sum(p["quotas"]) <= 9 for p in parts)


def removed(docs, n):
    seen, out = set(), {}
    for i, t in docs:
        b = (t or "").encode()
        gone = bytearray(len(b))
        for k in range(len(b) - n + 1):
            if b[k : k + n] in seen:
                gone[k : k + n] = b"\1" * n
            else:
                seen.add(b[k : k + n])
        out[i] = (len(b), sum(gone), hashlib.sha256(bytes(x for x, g in zip(b, gone) if not g)).hexdigest())
    return out


@pytest.mark.parametrize("seed", [0, 1])
def test_repeats(spark, seed):
    random.seed(seed)
    words = ["".join(random.choice("aébcd") for _ in range(random.randint(1, 6))) for _ in range(60 if seed else 8)]
    base = [" ".join(random.choice(words) for _ in range(random.randint(1, 120))) for _ in range(20)]
    docs = []
    for i in range(80):
        t = random.choice(base)
        k = random.randint(0, len(t))
        t = random.choice([t, t[:k] + "x" + t[k + 2 :], t + " " + random.choice(base), "ab" * random.randint(0, 300), None])
        docs.append((i, t))
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    found = repeats.remove_repeats(df).collect()
    assert {r["doc_id"]: (r["n_bytes"], sum(s["hi"] - s["lo"] for s in r["spans"]), r["kept_sha256"]) for r in found} == removed(docs, 100)


def test_repeats_awkward(spark):
    assert repeats.remove_repeats(awkward(spark)).count() == 9
    assert repeats.remove_repeats(awkward(spark).limit(0)).count() == 0


def test_run_index():
    random.seed(1)
    for _ in range(60):
        t = np.array([random.choice([0, 1, 2, 2, 3]) for _ in range(random.randint(2, 60))] + [0], np.uint16)
        prior, match = repeats.RunIndex(t).statistics()
        order = sorted(range(len(t)), key=lambda i: t[i:].tolist())
        for a, b in zip(order, order[1:]):
            m = next((k for k in range(len(t)) if max(a, b) + k >= len(t) or t[a + k] != t[b + k]), 0)
            assert match[b] == m and (m == 0 or prior[b] == a)


def test_main_text(spark):
    t = "Some words of the article that are long enough."
    pages = [
        (f"<body><header><h1>Site</h1></header><div class=cookie-notice>We use cookies</div><main><h2>Ti&amp;tle</h2><p>fo<b>ob</b>ar {t}<form><label>Mail</label></form><aside>See that</aside><p>{t}</main><section class=comments><article class=comment>nice article</article></section><footer>c</footer>", f"Ti&tle foobar {t} {t}"),
        (f"<div id=wrapper class='has-sidebar'><div class=menu><a>Home</a></div><div class=post><p>{t}</p><div class='ad-box'>Buy now</div><p>{t}</p></div></div>", f"{t} {t}"),
        (f"<nav>a b c</nav><script>var x='<p>no</p>';</script><!-- ad --><p>{t}", t),
        ("", ""), (None, ""), ("<article>Be.</article>", "Be."), ("<a href='x", ""), ("<div>" * 3000 + t, t),
    ]
    df = spark.createDataFrame([(i, "u", h, "own") for i, (h, _) in enumerate(pages)], "page_id long, url string, html string, text string")
    got = {r["page_id"]: (r["text"], r["n_chars"]) for r in html_extract.extract_main_text(df).collect()}
    assert got == {i: (e, len(e)) for i, (_, e) in enumerate(pages)}


def test_tokens(spark):
    public = pytest.importorskip("public_tokenizers")
    path = public.path("piece_bpe_32k.model")
    sp = tokens.processor(path)
    random.seed(3)
    signs = " ▁  aeth.\n\t\x00é　ﬁ<s>1290👍"
    rows = ["".join(random.choice(signs) for _ in range(random.randint(0, 40))) for _ in range(2000)]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(rows)] + [(9000, None)], "doc_id long, text string")
    got = {r["doc_id"]: (r["n_bytes"], r["n_tokens"]) for r in tokens.token_report(df, path).collect()}
    assert got == {**{i: (len(t.encode()), len(sp.encode(t))) for i, t in enumerate(rows)}, 9000: (0, 0)}


EMAIL, IP = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD, PHONE = re.compile(r"[0-9]([\x20-]?[0-9])+"), re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def test_base_spans():
    random.seed(5)
    for signs in ("a@b.c-_%+1 ", "1.2..5 3", "4 -1230+().", "aB@.1-+ \né@@.."):
        for _ in range(4000):
            s = "".join(random.choice(signs) for _ in range(random.randint(0, 45)))
            want = [(0, *m.span()) for m in EMAIL.finditer(s)] + [(1, *m.span()) for m in IP.finditer(s) if all(int(x) <= 255 for x in m[0].split("."))]
            want += [(2, *m.span()) for m in CARD.finditer(s) if 16 <= sum(c.isdigit() for c in m[0]) <= 19 and pii.luhn(re.sub("[ -]", "", m[0]))]
            want += [(3, *m.span()) for m in PHONE.finditer(s) if 8 <= sum(c.isdigit() for c in m[0]) <= 15]
            assert pii.base_spans(s)[0] == want


def test_discovery(spark):
    rows = [(i, f"word{i} . please contact desk at user{i}@mail.example.org or call", "x") for i in range(12)] + [(100, "you can contact desk at badge-77-0199 or so", "x"), (101, "only a number 12345678 here", "x")]
    got = {r["doc_id"]: r for r in pii.find_personal_data(docs_of(spark, rows)).collect()}
    assert got[3]["spans"].startswith("email:") and got[3]["n_email"] == 1
    assert [d["kind"] for d in got[100]["discovered"]] == ["email"] and not got[101]["discovered"]
    assert pii.find_personal_data(awkward(spark)).count() == 9


def test_line_dedup(spark):
    rows = [(i, f"own {i}\n  The Same\n\nthe same ", "x") for i in range(12)] + [(50, "THE SAME", "x"), (51, None, "x"), (52, "", "x")]
    got = {r["doc_id"]: (r["n_lines"], r["n_dropped"], r["kept"]) for r in line_dedup.dedup_lines(docs_of(spark, rows), "common", 10).collect()}
    assert got[3] == (4, 2, "own 3\n") and got[50] == (1, 1, "") and got[51] == got[52] == (1, 0, "")
    first = {r["doc_id"]: r["n_dropped"] for r in line_dedup.dedup_lines(docs_of(spark, rows), "first", 10).collect()}
    assert first[0] == 1 and first[1] == 2
    many = docs_of(spark, [(1, "\n".join(f"l{i % 300}" for i in range(5000)), "x"), *((k, "l7\nq", "x") for k in range(2, 14))])
    out = {r["doc_id"]: (r["n_dropped"], r["kept"].count("\n") + 1) for r in line_dedup.dedup_lines(many, "common", 10).collect()}
    assert out[1] == (17, 4983) and out[2] == (2, 1)
    assert line_dedup.dedup_lines(awkward(spark), "common", 2).count() == 9


def test_toxicity_fit_in_blocks(monkeypatch):
    """What a step makes of all hits is held a block at a time; the sums are the same to the last bit."""
    rng = random.Random(6)
    voc = ["".join(rng.choices("abcdefghij", k=rng.randint(3, 8))) for _ in range(300)]
    texts = [". ".join(" ".join(rng.choices(voc, k=12)) for _ in range(100)) for _ in range(200)]
    labels = [int(voc[0] in t.split(" ")[:400]) for t in texts]
    whole = toxicity.fit(texts, labels, steps=2)
    monkeypatch.setattr(toxicity, "BLOCK_HITS", 5000)
    tracemalloc.start()
    try:
        assert toxicity.fit(texts, labels, steps=2) == whole
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    hits = sum(len({f for w in set(s.split()) for f in toxicity.features(w)}) for t in texts for s in t.split("."))
    assert peak < 12 * hits  # 8 bytes a hit for each of three arrays before
    assert toxicity.fit(["...", "a b", ""], [1, 0, 1])[1] == {}


def test_toxicity(spark):
    random.seed(6)
    clean = ["sun", "rain", "wind", "snow", "leaf", "tree", "road", "stone"]
    rows, labels = [], []
    for i in range(600):
        sentences = [" ".join(random.choice(clean) for _ in range(6)) for _ in range(random.randint(1, 6))]
        bad = i % 5 == 0
        if bad:
            sentences[random.randrange(len(sentences))] += " you " + random.choice(["idiot", "idiots", "moron"])
        rows.append((i, ". ".join(sentences) + ".", "x"))
        labels.append((i, 1, int(bad)))
    lab = spark.createDataFrame(labels + [(None, 1, 1), (3, None, None)], "doc_id long, quality int, toxic int")
    out = toxicity.toxicity(docs_of(spark, [*rows, (None, "", "x"), (7000, None, "x")]), lab).collect()
    held = [r for r in out if r["held_out"]]
    assert held and all(r["predicted"] == int(r["doc_id"] % 5 == 0) for r in held if r["doc_id"] < 600)
    assert any("idiot" in rows[r["doc_id"]][1][s["start"] : s["end"]] for r in held if r["doc_id"] is not None and r["doc_id"] < 600 for s in r["offending"])
    assert {r["score"] for r in out if not r["text"]} == {0.0}
    assert all(r["score"] < 1e-6 for r in toxicity.toxicity(awkward(spark), lab.limit(0)).collect())


def shingles(t):
    w = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


@pytest.mark.parametrize("seed", [0, 1, 2])
def test_jaccard(spark, seed):
    random.seed(seed)
    voc = [f"w{i}" for i in range(30 if seed else 400)]
    texts = []
    for _ in range(30):
        base = [random.choice(voc) for _ in range(random.choice([1, 3, 5, 6, 8, 20, 60, 200]))]
        for _ in range(random.randint(1, 12)):
            t = base[:]
            for _ in range(random.randint(0, max(1, len(t) // 30))):
                t[random.randrange(len(t))] = random.choice(voc)
            texts.append(" ".join(t) if random.random() < 0.9 else " ".join(t + base[:3]))
    texts += [None, "", " \n", texts[0].upper()]
    ids = list(range(len(texts)))
    random.shuffle(ids)
    sets, parent = {i: shingles(t) for i, t in zip(ids, texts)}, {i: i for i in ids}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in ids:
        for j in ids:
            if i < j and sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j]):
                a, b = sorted((root(i), root(j)))
                parent[b] = a
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard.similar_documents(docs_of(spark, [(i, t, "x") for i, t in zip(ids, texts)])).collect()}
    assert got == {i: (len(sets[i]), root(i)) for i in ids}


def test_jaccard_short_beginnings(spark):
    """Texts of eight words and their first seven: three of four shingles, in the band below."""
    random.seed(3)
    rows = []
    for i in range(0, 800, 2):
        words = [f"w{random.randrange(10**6)}" for _ in range(8)]
        rows += [(i, " ".join(words), "x"), (i + 1, " ".join(words[:7]), "x")]
    got = {r["doc_id"]: r["component_id"] for r in jaccard.similar_documents(docs_of(spark, rows)).collect()}
    assert got == {i: i - i % 2 for i in range(800)}


@pytest.mark.parametrize("share", [0.0, 0.5, 0.8, 1.0])
def test_jaccard_signatures_meet(share):
    """Sets of similarity 0.75 and more share a signature, within a band and across two, however many of their shingles are frequent."""
    rng = np.random.default_rng(4)
    for _ in range(1500):
        low = int(rng.choice([4, 8, 16, 32, 64]))
        large = int(rng.integers(low, 4 * low // 3 + 1))
        small = int(rng.integers(-(-3 * large // 4), large + 1))
        whole = np.unique(rng.integers(0, 2**63, large).astype(np.uint64))
        frequent = whole[rng.random(len(whole)) < share]
        signed = []
        for part in (whole, np.sort(rng.permutation(whole)[:small])):
            d = np.zeros(len(part), np.int64)
            signed.append(set(jaccard.signatures(d, part, np.array([len(part)]), np.isin(part, frequent))[1].tolist()))
        assert signed[0] & signed[1], (large, small)


def test_jaccard_awkward(spark):
    out = jaccard.similar_documents(awkward(spark)).collect()
    assert sorted((r["doc_id"], r["component_id"]) for r in out if r["doc_id"] is not None) == [(1, 1), (1, 1), (2, 1), (3, 3), (4, 4), (5, 5), (6, 6)]
    assert {r["component_id"] for r in out if r["doc_id"] is None} == {None}
    assert jaccard.similar_documents(awkward(spark).limit(0)).count() == 0


def test_decontamination(spark):
    random.seed(8)
    voc = ["".join(random.choice("abcdefgh") for _ in range(random.randint(2, 7))) for _ in range(300)]
    prose = lambda n: " ".join(random.choice(voc) for _ in range(n))
    items = [(i, prose(random.randint(14, 60))) for i in range(20)] + [(90, None), (91, ""), (92, "two words")]
    rows, want = [], set()
    for i in range(120):
        t = prose(random.randint(20, 200))
        if i % 3 == 0:
            k, item = random.choice(items[:20])
            if i % 2:
                at = random.randrange(len(item))
                item = item[:at] + "Z" + item[at + 1 :]
            t = f"{t} {item}\n{prose(5)}"
            want.add((i, k))
        rows.append((i, t, "x"))
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]): r["edits"] for r in decontaminate.matches(docs_of(spark, rows), bench).collect()}
    assert set(got) == want and max(got.values()) <= 1
    assert decontaminate.matches(awkward(spark), bench).count() == 0 and decontaminate.matches(awkward(spark), bench.limit(0)).count() == 0


@pytest.mark.parametrize("alphabet", ["abcdefgh", "aeñó€"])
def test_decontamination_spread_edits(alphabet):
    """Up to one edit in ten characters, spread over the words: all that brute force finds, and nothing else."""
    random.seed(10)
    voc = ["".join(random.choice(alphabet) for _ in range(random.randint(2, 7))) for _ in range(60)]
    prose = lambda n: " ".join(random.choice(voc) for _ in range(n))
    items = [prose(random.choice([4, 5, 8, 16, 30])) for _ in range(25)]
    texts = ["", "a", items[3]]
    for i in range(100):
        item = list(items[i % 25])
        edits = len(item) // 10 + (i % 4 == 3)
        for j in range(edits):
            at = len(item) * j // edits + random.randrange(5)
            item[at : at + 1] = random.choice([["Z"], [], [item[at], "z"], ["ß"]]) if at < len(item) else []
        texts.append(f"{prose(random.randint(0, 12))} {''.join(item)}\n{prose(3)}")
    want = {}
    for d, text in enumerate(texts):
        words = text.lower().split()
        for k, item in enumerate(items):
            tried = [(decontaminate.prefix_distance(item, " ".join(words[t:]), len(item))[0], t) for t in range(len(words))]
            if tried and 10 * min(tried)[0] <= len(item):
                want[d, k] = min(tried)[::-1]
    found = {}
    built = decontaminate.Items(list(range(25)), items, 0.1)
    for first, _, raw, offsets in decontaminate.A.groups(pa.array(texts)):
        found |= {(first + d, k): (t, edits) for d, k, t, _, edits, _ in decontaminate.find(built, raw, offsets, 0.1)}
    assert len(want) > 70 and found == want


def test_prefix_distance():
    random.seed(9)
    for _ in range(300):
        p, t = ("".join(random.choice("ab") for _ in range(random.randint(1, 12))) for _ in range(2))
        rows = [list(range(len(p) + 1))]
        for j, c in enumerate(t, 1):
            row = [j]
            for i, x in enumerate(p, 1):
                row.append(min(rows[-1][i - 1] + (x != c), rows[-1][i] + 1, row[-1] + 1))
            rows.append(row)
        assert decontaminate.prefix_distance(p, t, len(p))[0] == min(r[-1] for r in rows)
