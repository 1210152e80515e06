"""Main text of web pages: gradient-boosted trees over DOM nodes, decoded over the hierarchy.

Each element is described by its subtree (text, links, elements, punctuation, paragraphs), its place (depth,
siblings, share of the parent's text) and the tokens of its tag and attributes, its own and its ancestors'.
Boosted trees give the probability that an element holds main text. Decoding picks the most likely labelling
of the whole tree in which a dropped element has no kept descendant, so choices never contradict.

The trees are trained here, in one task, on a bounded set: up to ``SAMPLE_PAGES`` pages that mark their article
themselves, and ``TRAIN_PAGES`` pages composed from layout variants that are filled with sentences
of the same sample; main text and boilerplate draw on the same sentences, so only structure tells them apart.
The model is a few small arrays and is broadcast; extraction itself is one pass over all pages without a shuffle.

Defined results: a null or empty html gives an empty text; broken markup is read as far as it goes; rows repeated in
full give equal rows; null ids and urls pass through; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import html
import math
import pickle
import random
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framespan.llm.html_dom import HIDDEN, Dom, joined, parse

SAMPLE_PAGES, TRAIN_PAGES = 200, 800
TREES, DEPTH, RATE, SMOOTH, LEAST = 40, 4, 0.3, 1.0, 5
#: Tokens (of tags and attributes) that get a feature, most frequent first.
TOKENS, BINS = 160, 32


# --- features ------------------------------------------------------------------------------------


def numbers(dom: Dom) -> np.ndarray:
    """Subtree, depth and sibling statistics, one row per element."""
    n = len(dom.tag)
    parent, after, depth = np.array(dom.parent), np.array(dom.after), np.array(dom.depth, np.float64)
    own, marks = np.zeros(n), np.zeros(n)
    first = np.full(n, -1.0)
    total = 0.0
    for element, run in dom.runs:
        if run:
            size = len(run) - run.count(" ") if not run.isspace() else 0
            if size:
                own[element] += size
                marks[element] += sum(map(run.count, ".,;:!?"))
                if first[element] < 0:
                    first[element] = total
                total += size

    def below(values: np.ndarray) -> np.ndarray:
        sums = np.append(0.0, np.cumsum(values))
        return sums[after] - sums[np.arange(n)]

    tag = np.array(dom.tag)
    in_link = np.zeros(n, bool)
    for i in np.flatnonzero(tag == "a"):
        in_link[i : after[i]] = True
    chars, links = below(own), below(own * in_link)
    elements = (after - np.arange(n)).astype(np.float64)
    children = np.bincount(parent[1:], minlength=n).astype(np.float64)
    index, seen = np.zeros(n), Counter()
    for i, p in enumerate(dom.parent):
        index[i] = seen[p]
        seen[p] += 1
    siblings = children[np.maximum(parent, 0)]
    above = chars[np.maximum(parent, 0)]
    start = np.append(0.0, np.cumsum(own))[:n]
    fields = below(np.isin(tag, ["input", "select", "button", "textarea", "label"]).astype(np.float64))
    return np.stack(
        [
            np.log1p(chars),
            links / (chars + 1),
            np.log1p(elements),
            np.log1p(chars / elements),
            depth,
            np.log1p(children),
            index / np.maximum(siblings, 1),
            np.log1p(siblings),
            below(marks) / (chars + 10),
            chars / (total + 1),
            chars / (above + 1),
            np.log1p(below((tag == "p").astype(np.float64))),
            np.log1p(below((tag == "li").astype(np.float64))),
            np.log1p(own),
            start / (total + 1),
            np.log1p(fields),
        ],
        1,
    )


def masks(dom: Dom, vocabulary: dict[str, int]) -> np.ndarray:
    """A bit per known token: of the element, then of its ancestors."""
    size = -(-TOKENS // 8)
    own, over = [], []
    get = vocabulary.get
    for i, tag in enumerate(dom.tag):
        mask = 0
        for token in (f"<{tag}>", *dom.tokens[i]):
            k = get(token)
            if k is not None:
                mask |= 1 << k
        p = dom.parent[i]
        own.append(mask)
        over.append(own[p] | over[p] if p >= 0 else 0)
    packed = b"".join(m.to_bytes(size, "little") + o.to_bytes(size, "little") for m, o in zip(own, over))
    return np.unpackbits(np.frombuffer(packed, np.uint8).reshape(len(own), 2 * size), axis=1, bitorder="little")


# --- boosting ------------------------------------------------------------------------------------


class Trees:
    """Boosted regression trees for logistic loss on binned features; trees are complete, of fixed depth."""

    def __init__(self, vocabulary: dict[str, int], edges: list[np.ndarray]):
        self.vocabulary, self.edges, self.base = vocabulary, edges, 0.0
        self.feature: list[np.ndarray] = []
        self.limit: list[np.ndarray] = []
        self.value: list[np.ndarray] = []

    def matrix(self, doms: list[Dom]) -> np.ndarray:
        numeric = np.concatenate([numbers(d) for d in doms])
        binned = [np.searchsorted(e, numeric[:, k], side="right").astype(np.uint8) for k, e in enumerate(self.edges)]
        return np.concatenate([np.stack(binned, 1), np.concatenate([masks(d, self.vocabulary) for d in doms])], 1)

    def score(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.base)
        rows = np.arange(len(x))
        for feature, limit, value in zip(self.feature, self.limit, self.value):
            node = np.zeros(len(x), np.int64)
            for _ in range(DEPTH):
                node = 2 * node + 1 + (x[rows, feature[node]] > limit[node])
            out += value[node - (2**DEPTH - 1)]
        return out

    def fit(self, x: np.ndarray, y: np.ndarray) -> None:
        self.base = math.log((y.mean() + 1e-6) / (1 - y.mean() + 1e-6))
        score = np.full(len(y), self.base)
        m = len(self.edges)
        binary = x[:, m:].astype(np.float32)
        for _ in range(TREES):
            p = 1 / (1 + np.exp(-score))
            g, h = p - y, p * (1 - p)
            feature, limit = np.zeros(2**DEPTH - 1, np.int64), np.full(2**DEPTH - 1, 255, np.uint8)
            node = np.zeros(len(y), np.int64)
            for k in range(2**DEPTH - 1):
                at = np.flatnonzero(node == k)
                if len(at) >= 2 * LEAST:
                    feature[k], limit[k] = self._split(x[at], binary[at], g[at], h[at], m)
                node[at] = 2 * k + 1 + (x[at, feature[k]] > limit[k])
            leaf = node - (2**DEPTH - 1)
            value = -RATE * np.bincount(leaf, g, 2**DEPTH) / (np.bincount(leaf, h, 2**DEPTH) + SMOOTH)
            self.feature.append(feature)
            self.limit.append(limit)
            self.value.append(value)
            score += value[leaf]

    @staticmethod
    def _split(x, binary, g, h, m) -> tuple[int, int]:
        """The feature and bin with the largest gain; bin 255 (no split) if nothing gains."""
        whole_g, whole_h = g.sum(), h.sum()

        def gain(a, b, n):
            ok = (n >= LEAST) & (len(g) - n >= LEAST)
            return np.where(ok, a * a / (b + SMOOTH) + (whole_g - a) ** 2 / (whole_h - b + SMOOTH), 0.0)

        best, where = whole_g**2 / (whole_h + SMOOTH) + 1e-6, (0, 255)
        for k in range(m):
            a, b, n = (np.cumsum(np.bincount(x[:, k], w, BINS + 1))[:-1] for w in (g, h, np.ones(len(g))))
            gains = gain(a, b, n)
            t = int(gains.argmax())
            if gains[t] > best:
                best, where = gains[t], (k, t)
        one = binary.T @ np.stack([g, h, np.ones(len(g))], 1).astype(np.float32)
        gains = gain(whole_g - one[:, 0], whole_h - one[:, 1], len(g) - one[:, 2])
        t = int(gains.argmax())
        return (m + t, 0) if gains[t] > best else where


def decode(dom: Dom, score: np.ndarray) -> np.ndarray:
    """Kept elements: the likeliest labelling in which a dropped element keeps nothing below it."""
    n = len(dom.tag)
    keep_cost, drop_cost = np.logaddexp(0, -score).tolist(), np.logaddexp(0, score).tolist()
    kept_best, all_dropped = keep_cost[:], drop_cost[:]
    choose = [True] * n
    for i in range(n - 1, 0, -1):
        p = dom.parent[i]
        if dom.tag[i] in HIDDEN:
            choose[i] = False
            continue
        choose[i] = kept_best[i] < all_dropped[i]
        kept_best[p] += min(kept_best[i], all_dropped[i])
        all_dropped[p] += all_dropped[i]
    for i in range(1, n):
        choose[i] = choose[i] and choose[dom.parent[i]]
    return np.array(choose)


# --- training pages ------------------------------------------------------------------------------

#: Words of class and id attributes, as they are common on the web: of main text and of what surrounds it.
MAIN_NAMES = "content main-content post post-content post-body entry entry-content article article-body article-content story story-body body-text text page-content blog-post single-post markdown-body rich-text prose hentry".split()
AROUND = {
    "nav": "nav navbar navigation menu main-menu breadcrumbs breadcrumb topbar pagination pager toc".split(),
    "header": "header site-header masthead top banner branding page-header".split(),
    "footer": "footer site-footer bottom colophon copyright legal".split(),
    "aside": "sidebar side widget widgets related related-posts recommended trending popular more-stories secondary".split(),
    "ad": "ad ads advert advertisement sponsored promo promotion banner-ad sponsor adsbox".split(),
    "notice": "cookie cookie-banner cookie-notice consent gdpr notice alert popup modal newsletter-popup message disclaimer".split(),
    "form": "form search search-form subscribe newsletter signup login contact-form".split(),
    "comments": "comments comment-list comments-area discussion responses replies reader-comments disqus".split(),
    "share": "share social sharing share-buttons tags tag-list meta byline".split(),
}


class Composer:
    """Pages of random layout, filled with the given sentences; ``data-train`` marks main text (1) and the rest (0)."""

    def __init__(self, sentences: list[str], seed: int):
        self.sentences, self.r = sentences or ["A plain sentence of some words."], random.Random(seed)

    def say(self, low: int, high: int) -> str:
        return html.escape(" ".join(self.r.choice(self.sentences) for _ in range(self.r.randint(low, high))))

    def few(self) -> str:
        words = self.r.choice(self.sentences).split()
        return html.escape(" ".join(words[: self.r.randint(1, 5)]))

    def named(self, names: list[str], rate: float = 0.8) -> str:
        if self.r.random() > rate:
            return ""
        value = self.r.choice(names)
        if self.r.random() < 0.3:
            value += self.r.choice([" wrap", " block", " container", " clearfix", " col-8", " box", " inner"])
        return f' {self.r.choice(["class", "class", "id"])}="{value}"'

    def links(self, wrap: bool = True) -> str:
        items = [f'<a href="/{i}">{self.few()}</a>' for i in range(self.r.randint(2, 9))]
        return "<ul>" + "".join(f"<li>{x}</li>" for x in items) + "</ul>" if wrap else self.r.choice([" | ", " ", ""]).join(items)

    def body(self) -> str:
        """Paragraphs of main text, sometimes with lists, quotes, subheadings, inline markup or bare lines."""
        out, r = [], self.r
        for _ in range(r.choice([1, 1, 2, 3, 5, 8, 14, 25])):
            kind = r.random()
            text = self.say(1, r.choice([1, 2, 4, 8]))
            if r.random() < 0.2:
                words = text.split(" ")
                words[0] = f"<{(t := r.choice(['b', 'i', 'em', 'span', 'strong']))}>{words[0]}" + (f"</{t}>" if r.random() < 0.7 else "")
                text = " ".join(words)
            if r.random() < 0.15:
                text += f' <a href="#x">{self.few()}</a>'
            if kind < 0.68:
                out.append(f"<p>{text}" + ("</p>" if r.random() < 0.9 else ""))
            elif kind < 0.74:
                out.append(f"<{(t := r.choice(['h2', 'h3']))}>{self.few()}</{t}>")
            elif kind < 0.80:
                out.append("<ul>" + "".join(f"<li>{self.say(1, 2)}</li>" for _ in range(r.randint(2, 5))) + "</ul>")
            elif kind < 0.85:
                out.append(f"<blockquote><p>{text}</p></blockquote>")
            elif kind < 0.90:
                out.append(f"<div>{text}</div>")
            elif kind < 0.93:
                out.append("<table>" + "".join(f"<tr><td>{self.few()}</td><td>{self.say(1, 1)}</td></tr>" for _ in range(r.randint(2, 4))) + "</table>")
            else:
                out.append(text + "<br>" * r.randint(1, 2))
        return "".join(out)

    def around(self, kind: str) -> str:
        r, names = self.r, AROUND[kind]
        mark = ' data-train="0"'
        own = {"nav": "nav", "header": "header", "footer": "footer", "aside": "aside", "form": "form", "comments": "section"}.get(kind)
        tag = own if own and r.random() < 0.6 else "div"
        named = self.named(names, 0.55 if tag == own and kind != "comments" else 1.0)
        if kind == "nav":
            inner = self.links(r.random() < 0.8)
        elif kind == "header":
            inner = r.choice([f'<a href="/">{self.few()}</a>', f"<h2>{self.few()}</h2><p>{self.few()}</p>", f"{self.few()}{self.links()}"])
        elif kind == "footer":
            inner = r.choice([f"&copy; example.com &middot; {self.say(1, 2)}", f"<p>{self.say(1, 2)}</p>", self.links() + f"<p>&copy; {self.say(1, 1)}</p>"])
        elif kind == "aside":
            inner = r.choice([f"<h3>{self.few()}</h3>" + self.links(), f"<h3>{self.few()}</h3><p>{self.say(1, 3)}</p>", "".join(f'<div><a href="/x">{self.say(1, 1)}</a><p>{self.say(1, 2)}</p></div>' for _ in range(3))])
        elif kind == "form":
            inner = f"<label>{self.few()}</label><input type=text name=q>" + r.choice(["", f"<p>{self.say(1, 1)}</p>"]) + f"<button>{self.few()}</button>"
        elif kind == "comments":
            one = lambda: f'<{(t := r.choice(["div", "li", "article"]))} class="{r.choice(["comment", "reply", "comment-body", "response"])}"><{(u := r.choice(["span", "b", "cite"]))}>{self.few()}</{u}><p>{self.say(1, 5)}</p></{t}>'
            inner = r.choice(["", f"<h3>{self.few()}</h3>"]) + "".join(one() for _ in range(r.randint(1, 8)))
        elif kind == "share":
            inner = self.links(r.random() < 0.5)
        else:
            inner = r.choice([self.say(1, 3), f"<p>{self.say(1, 4)}</p>", f"<p>{self.say(1, 2)}</p><a href=/x>{self.few()}</a>"])
        return f"<{tag}{named}{mark}>{inner}</{tag}>"

    def page(self) -> str:
        r = self.r
        title = self.few()
        head = r.choice([f"<h1>{title}</h1>", f"<h1>{title}</h1>", f"<h2>{title}</h2>", ""])
        inside = self.around(r.choice(["ad", "share", "aside", "form", "notice", "nav", "comments"])) if r.random() < 0.35 else ""
        body = self.body()
        cut_at = body.find("<p>", len(body) // 2)
        text = body + inside if cut_at < 0 or "comments" in inside else body[:cut_at] + inside + body[cut_at:]
        tag, named = r.choice([("article", 0.4), ("article", 0.0), ("main", 0.4), ("div", 1.0), ("div", 1.0), ("section", 0.9), ("td", 0.9)])
        main = f'<{tag}{self.named(MAIN_NAMES, named)} data-train="1">{head}{text}</{tag}>'
        if tag == "td":
            main = f"<table><tr>{'<td data-train=0>' + self.links() + '</td>' if r.random() < 0.5 else ''}{main}</tr></table>"
        pick = lambda kinds, rate: "".join(self.around(k) for k in kinds if r.random() < rate)
        after = pick(["share", "comments"], 0.3) + pick(["aside", "form"], 0.2)
        if r.random() < 0.4:
            main = f"<{(t := r.choice(['div', 'main', 'div']))}{self.named(['wrapper', 'page', 'container', 'site', 'layout', 'main'], 0.7)}>{pick(['aside'], 0.3)}{main}{after}</{t}>"
            after = ""
        before = pick(["notice", "header", "nav", "ad", "form"], 0.45)
        return f"<!DOCTYPE html><html><head><title>{title}</title></head><body>{before}{main}{after}{pick(['aside', 'ad', 'footer', 'notice'], 0.5)}</body></html>"


def marked(dom: Dom) -> np.ndarray:
    """Whether the subtree of each element holds text that the training marks call main."""
    inherited = [False] * len(dom.tag)
    for i in range(1, len(dom.tag)):
        inherited[i] = {"1": True, "0": False}.get(dom.mark[i], inherited[dom.parent[i]])
    holds = np.zeros(len(dom.tag))
    for element, run in dom.runs:
        if run and not run.isspace() and inherited[element]:
            holds[element] += 1
    sums = np.append(0.0, np.cumsum(holds))
    return sums[np.array(dom.after)] - sums[np.arange(len(holds))] > 0


def self_marked(dom: Dom) -> bool:
    """Turn the page's own article element into training marks; false if there is not exactly one."""
    articles = [i for i, t in enumerate(dom.tag) if t == "article"]
    if len(articles) != 1:
        return False
    dom.mark[articles[0]] = "1"
    for i in range(articles[0] + 1, dom.after[articles[0]]):
        if dom.tag[i] in ("nav", "aside", "footer", "form"):
            dom.mark[i] = "0"
    return True


def train(pages: list[str], train_pages: int = TRAIN_PAGES, seed: int = 7) -> Trees:
    """Fit the trees on the sample pages that mark their article and on composed pages."""
    own = [parse(p) for p in pages]
    sentences = sorted({s.strip() for d in own for _, run in d.runs if run for s in html.unescape(run).split(". ") if 2 < len(s.strip()) < 400})
    composer = Composer(sentences, seed)
    doms = [d for d in own if self_marked(d)] + [parse(composer.page()) for _ in range(train_pages)]
    counts = Counter(t for d in doms for i in range(len(d.tag)) for t in {f"<{d.tag[i]}>", *d.tokens[i]})
    vocabulary = {t: k for k, (t, _) in enumerate(sorted(counts.items(), key=lambda c: (-c[1], c[0]))[:TOKENS])}
    numeric = np.concatenate([numbers(d) for d in doms])
    edges = [np.unique(np.quantile(numeric[:, k], np.linspace(0, 1, BINS + 1)[1:-1])) for k in range(numeric.shape[1])]
    model = Trees(vocabulary, edges)
    shown = np.concatenate([np.array([t not in HIDDEN and t != "#root" for t in d.tag]) for d in doms])
    model.fit(model.matrix(doms)[shown], np.concatenate([marked(d) for d in doms])[shown].astype(np.float64))
    return model


def extract(pages: list[str], model: Trees) -> list[str]:
    doms = [parse(p) for p in pages]
    score = model.score(model.matrix(doms)) if doms else np.empty(0)
    out, at = [], 0
    for dom in doms:
        n = len(dom.tag)
        out.append(joined(dom, decode(dom, score[at : at + n])))
        at += n
    return out


# --- Spark ---------------------------------------------------------------------------------------


def _train_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    pages = sorted(p for batch in batches for p in batch.column(0).to_pylist())
    yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(train(pages))], pa.binary())], names=["model"])


def fit(pages: DataFrame, html_col: str = "html", sample: int = SAMPLE_PAGES, longest: int = 200_000) -> Trees:
    """Train on a bounded sample: the ``sample`` pages with the smallest hashes among those of up to ``longest`` characters."""
    usable = pages.select(F.col(html_col).cast("string").alias("h")).where(F.length("h") <= longest)
    picked = usable.orderBy(F.xxhash64("h"), "h").limit(sample)
    rows = picked.repartition(1).mapInArrow(_train_task, "model binary").collect()
    return pickle.loads(rows[0].model) if rows else train([])


def main_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", model: Trees | None = None) -> DataFrame:
    """(id, url, text, n_chars) of each page."""
    shared = pages.sparkSession.sparkContext.broadcast(model or fit(pages, html_col))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held, size, lo = [], 0, 0
            for k, page in enumerate(batch.column(2)):
                page = page.as_py() or ""
                held.append(page)
                size += len(page)
                if size > 2_000_000 or k == batch.num_rows - 1:
                    texts = extract(held, shared.value)
                    part = batch.slice(lo, len(held))
                    yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], names=names)
                    held, size, lo = [], 0, k + 1

    plain = pages.select(F.col(id_col), F.col(url_col).cast("string"), F.col(html_col).cast("string"))
    names = [id_col, url_col, "text", "n_chars"]
    kind = pages.schema[id_col].dataType.simpleString()
    return plain.mapInArrow(run, f"`{id_col}` {kind}, `{url_col}` string, text string, n_chars long")
