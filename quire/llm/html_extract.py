"""Main text of web pages: the maximum-scoring subsequence of words and tags.

A page is read once into runs of words and tags. A word scores the weight of being a word plus the weights of the elements
it stands in (names, class and id words, roles), a tag scores its own negative weight; all weights come from a logistic
model and from counts over the labelled pages of labelled_pages(). One linear scan (Kadane's) finds the contiguous
region with the largest sum, and the region's words of positive score are the text: an advert inside the article
lies within the region but its words score negative.

Null and empty pages give an empty text. Tags that never close, quotes that never end, comments, scripts and truncated
pages are read as browsers do; the reading is linear in the page's length, and nothing is cut or capped.
"""

from __future__ import annotations

import functools
import html
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from quire.llm.common import ship

TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>")
LOOSE_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)>?")
ATTRIBUTE = re.compile(r"(class|id|role|hidden|aria-hidden|data-label)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+))?", re.I)
NAME_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])|[0-9]+")
#: Elements whose content is no markup; elements without content; elements that flow inside a line.
RAW = ("script", "style", "textarea", "title", "xmp", "iframe", "noembed", "noframes", "noscript", "template", "svg", "math", "select", "option")
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
SKIPPED = frozenset(RAW)
RAW_END = {name: re.compile(rf"</{name}(?=[\s/>])[^>]*>?", re.I) for name in RAW}
#: Names that tell what an element holds, not what it is.
WITH = re.compile(r"(?:has|with|no|without|show|hide)[-_A-Z]")
#: A tag of one of these closes an open p.
ENDS_P = frozenset("address article aside blockquote div dl fieldset footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split())

#: Bounds of a word's score in the scan; words of boilerplate are left out anyway, so they only weigh against reaching past them.
LEAST, MOST = -0.2, 1.0
Run = tuple[str | None, str, tuple[str, ...]]


def element_features(name: str, attributes: str, in_article: bool) -> tuple[str, ...]:
    """What an element adds to the score of the words inside: its name and the words of its class, id and role."""
    out = {name + "@article" if in_article and name in ("header", "footer", "section", "div") else name}
    for m in ATTRIBUTE.finditer(attributes):
        key, value = m[1].lower(), (m[2] or "").strip("\"'")
        if key in ("hidden", "aria-hidden"):
            if value.lower() != "false":
                out.add("." + "hidden")
        elif key == "data-label":
            out.add("=" + value)
        elif name not in ("html", "body"):
            out.update("." + w.lower() for own in value.split() if not WITH.match(own) for w in NAME_WORD.findall(own))
    return tuple(sorted(out))


def read(page: str) -> Iterator[tuple[str, str, str]]:
    """("text", text, ""), ("open", name, attributes) and ("close", name, "") in page order."""
    at, n = 0, len(page)
    while at < n:
        lt = page.find("<", at)
        if lt < 0:
            yield "text", page[at:], ""
            return
        if lt > at:
            yield "text", page[at:lt], ""
        if page.startswith("<!--", lt):
            end = page.find("-->", lt + 4)
            at = n if end < 0 else end + 3
            continue
        if page.startswith(("<!", "<?"), lt):
            end = page.find(">", lt)
            at = n if end < 0 else end + 1
            continue
        m = TAG.match(page, lt) or LOOSE_TAG.match(page, lt)
        if not m:
            yield "text", "<", ""
            at = lt + 1
            continue
        at, name = m.end(), m[2].lower()
        if m[1]:
            yield "close", name, ""
            continue
        yield "open", name, m[3]
        if name in SKIPPED and not m[3].endswith("/"):
            end = RAW_END[name].search(page, at)
            at = n if end is None else end.end()
            yield "close", name, ""
        elif name in VOID or m[3].endswith("/") and name not in INLINE and name not in ENDS_P:
            yield "close", name, ""


def runs(page: str) -> list[tuple[str, str, tuple[tuple[str, ...], ...]]]:
    """Runs ("word", text, stack of element features) and ("tag", name, ()). The first article or main outside asides clears what its wrappers are called."""
    out: list = []
    stack: list[tuple[str, list]] = []
    open_names: dict[str, int] = {}
    features: list[tuple[str, ...]] = []
    found_main = False
    shared: tuple = ()
    for kind, name, attributes in read(page):
        if kind == "text":
            if not name.isspace():
                out.append(["word", name, shared])
            elif name:
                out.append(["space", " ", ()])
            continue
        if kind == "open":
            if name in ENDS_P and stack and stack[-1][0] == "p" or name == "li" and stack and stack[-1][0] == "li":
                gone = stack.pop()[0]
                open_names[gone] -= 1
                shared = shared[0] if shared else ()
            own = element_features(name, attributes, open_names.get("article", 0) > 0)
            if name in ("article", "main") and not found_main and not any(open_names.get(x, 0) for x in ("aside", "nav", "footer")):
                found_main = True
                for _, holder in stack:
                    holder[:] = [f for f in holder if not f.startswith(".")]
            holder = list(own)
            shared = (shared, holder)
            stack.append((name, holder))
            open_names[name] = open_names.get(name, 0) + 1
            out.append(["tag", name, ()])
        else:
            out.append(["tag", "/" + name, ()])
            if open_names.get(name, 0):
                while True:
                    top = stack.pop()[0]
                    open_names[top] -= 1
                    shared = shared[0]
                    if top == name:
                        break
    return out


@functools.lru_cache(1)
def labelled_pages() -> list[str]:
    """Pages with data-label="main" on content and data-label="other" on anything else inside it.

    Each name that boilerplate goes by appears before, after and inside an article, and on a page without one.
    """
    #: Names of boilerplate elements; class, id and role words.
    elements = "nav footer aside form button menu dialog head select fieldset script style noscript iframe template textarea title option svg".split()
    words = """ad ads advert advertisement advertising adsense sponsor sponsored promo promotion banner cookie cookies consent gdpr popup modal overlay newsletter
        subscribe subscription signup sidebar widget menu nav navbar navigation breadcrumb breadcrumbs footer comment comments disqus reply respond replies related recommended share sharing
        social notice alert login register search searchbox toolbar pagination pager skip tags hidden contentinfo complementary masthead topbar copyright""".split()
    text = "the quick brown fox jumps over the lazy dog and runs"
    headings = "".join(f"<h{k}>{text}</h{k}>" for k in range(1, 7))
    flow = "".join(f"<{e}>{text}</{e}>" for e in "b i em strong span code pre figcaption".split())
    main = lambda inner: f'{headings}<p>{text} {text}</p>{inner}<p>{text} <a href="x">{text}</a></p>{flow}<div>{text}</div><section>{text}</section><ul><li>{text}</li></ul><ol><li>{text}</li></ol><dl><dt>{text}</dt><dd>{text}</dd></dl><blockquote>{text}<p>{text}</p></blockquote><table><tr><th>{text}</th><td>{text}</td></tr></table>'
    insides = [text, f"<p>{text}</p>", f'<ul><li><a href="x">{text}</a></li></ul>', f"<h3>{text}</h3><div><b>{text}</b></div>", f"<article><p>{text}</p></article>"]
    links = f'<nav><ul><li><a href="x">{text}</a></li></ul></nav><header><h1>{text}</h1><div><p>{text}</p></div></header>'
    pages = [f'<html><head><title>{text}</title></head><body data-label="main">{inner}</body></html>' for inner in (text, f"{text}<br>{text}", main(""), f"<div>{main('')}</div>", f"<div><div>{text}</div></div>", f"<p>{text}</p>")] * 20
    for i, (name, mark) in enumerate([(e, f"<{e}>") for e in elements] + [(e, f'<{e} class="{w}">') for w in words for e in ("div", "section")]):
        raw = name in RAW
        for inside in insides[:1] if raw else insides[: 5 if "comment" in mark else 4]:
            other = f"{mark}{inside}</{name}>".replace(">", ' data-label="other">', 1)
            pages += [
                f'<html><head><title>{text}</title></head><body>{links}{other}<article data-label="main"><header><h1>{text}</h1><p>{text}</p></header>{main("")}</article>{other}<footer><p>{text}</p></footer></body></html>',
                f'<html><body>{links}<main data-label="main"><article>{main(other)}</article></main></body></html>',
                f'<html><body>{links}<article data-label="main"><section><div>{main(other)}</div></section>{other}</article></body></html>',
                f'<html><body>{links}<div><div data-label="main" class="content">{main(other)}</div>{other}</div></body></html>',
                f'<html><body><div id="header"><p>{text}</p></div><div data-label="main">{main(other)}</div>{other}</body></html>',
            ]
    return pages


def flatten(shared: tuple) -> list[str]:
    out = []
    while shared:
        out += shared[1]
        shared = shared[0]
    return out


@functools.lru_cache(1)
def weights() -> tuple[float, dict[str, float], dict[str, float]]:
    """(a word's own weight, weights of element features, negative weights of tags) from the labelled pages."""
    rows, labels, tags_in, tags_all = [], [], {}, {}
    for page in labelled_pages():
        label = 0
        for kind, text, shared in runs(page):
            if kind == "word":
                own = set(flatten(shared))
                label = int("=main" in own and "=other" not in own)
                rows += [frozenset(f for f in own if f[0] != "=")] * len(text.split())
                labels += [label] * len(text.split())
            elif kind == "tag":
                tags_all[text] = tags_all.get(text, 0) + 1
                tags_in[text] = tags_in.get(text, 0) + label
    kinds = {}
    for r, y in zip(rows, labels):
        kinds.setdefault((r, y), 0)
        kinds[(r, y)] += 1
    names = sorted({f for r, _ in kinds for f in r})
    at = {f: i for i, f in enumerate(names)}
    x = np.zeros((len(kinds), len(names) + 1))
    x[:, -1] = 1
    for i, (r, _) in enumerate(kinds):
        x[i, [at[f] for f in r]] = 1
    y, n = np.array([y for _, y in kinds], float), np.sqrt(np.array(list(kinds.values()), float))
    w, m2 = np.zeros(x.shape[1]), np.full(x.shape[1], 1e-8)
    for _ in range(400):
        g = x.T @ (n * (1 / (1 + np.exp(-np.clip(x @ w, -40, 40))) - y)) + 0.02 * w
        m2 += g * g
        w -= 0.5 * g / np.sqrt(m2)
    cost = {t: -0.05 - 0.2 * (1 - tags_in[t] / tags_all[t]) for t in tags_all}
    return float(w[-1]), {f: float(w[i]) for f, i in at.items()}, cost


def extract(page: str | None, model: tuple[float, dict[str, float], dict[str, float]]) -> str:
    bias, by_feature, by_tag = model
    scored: dict[int, tuple[float, frozenset[str]]] = {}

    def element_sum(shared: tuple) -> float:
        """Each feature counts once, however often elements that bear it are nested."""
        trail = []
        while shared and id(shared) not in scored:
            trail.append(shared)
            shared = shared[0]
        total, seen = scored[id(shared)] if shared else (bias, frozenset())
        for s in reversed(trail):
            if new := {f for f in s[1] if f in by_feature and f not in seen}:
                total, seen = total + sum(by_feature[f] for f in new), seen | new
            scored[id(s)] = total, seen
        return total

    tokens = runs(page or "")
    best, best_at, total, start = 0.0, (0, 0), 0.0, 0
    scores = []
    for i, (kind, text, shared) in enumerate(tokens):
        if kind == "word":
            s = element_sum(shared)
            gain = min(MOST, max(LEAST, s)) * len(text.split())
        else:
            s, gain = 0.0, by_tag.get(text, -0.1) if kind == "tag" else 0.0
        scores.append(s)
        if total <= 0:
            total, start = 0.0, i
        total += gain
        if total > best:
            best, best_at = total, (start, i + 1)
    parts = []
    for i in range(*best_at):
        kind, text, _ = tokens[i]
        if kind == "word":
            if scores[i] > 0:
                parts.append(text)
        elif kind == "space":
            parts.append(" ")
        elif text.lstrip("/") not in INLINE:
            parts.append(" ")
    return " ".join(html.unescape("".join(parts)).split())


def extract_main_text(pages: DataFrame, column: str = "html", out: str = "text") -> DataFrame:
    """pages' other columns with out, the main text, and n_chars, its code points."""
    spark = pages.sparkSession
    ship(spark)
    shared = spark.sparkContext.broadcast(weights())  # some hundred numbers
    names = [c for c in pages.columns if c not in (column, out, "n_chars")]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pages.schema.fields if f.name in names) + f", `{out}` string, n_chars bigint"

    def extracted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [extract(h, shared.value) for h in batch.column(batch.schema.get_field_index(column)).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(batch.schema.get_field_index(c)) for c in names] + [pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=[*names, out, "n_chars"])

    return pages.mapInArrow(extracted, schema)
