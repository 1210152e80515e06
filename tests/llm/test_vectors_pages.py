"""Embeddings, web pages and archives against brute force, and their defined results on awkward rows."""

from __future__ import annotations

import gzip
import hashlib
import html
import re
import time

import numpy as np
import pytest

from framespan.llm import op3_embedding_dedup, op7_html_trees, op10_warc
from framespan.llm.common import components
from framespan.llm.html_dom import joined, parse


def brute(rows):
    """n_links and component by comparing all pairs in double precision."""
    ok = {}
    for i, x, label in rows:
        if i is not None and x and label is not None and all(v is not None and np.isfinite(v) for v in x) and any(x):
            ok[i] = (np.array(x, np.float64) / np.linalg.norm(np.array(x, np.float64)), label)
    links = {i: {j for j, (y, m) in ok.items() if j != i and m == label and len(y) == len(x) and x @ y >= 0.93} for i, (x, label) in ok.items()}
    out = {}
    for i in links:
        seen, todo = {i}, [i]
        while todo:
            for j in links[todo.pop()] - seen:
                seen.add(j)
                todo.append(j)
        out[i] = (len(links[i]), min(seen))
    return out


def vectors(seed=0, n=300, dim=24):
    rng = np.random.default_rng(seed)
    rows, i = [], 0
    while i < n:
        base = rng.standard_normal(dim)
        for _ in range(rng.choice([1, 1, 2, 5, 40])):
            x = base + rng.choice([0.0, 0.05, 0.2, 0.3]) * rng.standard_normal(dim)
            rows.append((i, [float(np.float32(v)) for v in x], int(rng.integers(0, 3))))
            i += 1
    return rows


def test_embeddings_brute_force(spark):
    rows = vectors()
    rows += [(10_000 + k, rows[0][1], rows[0][2]) for k in range(30)]
    nan, inf = float("nan"), float("inf")
    odd = [(20_000, None, 1), (20_001, [], 1), (20_002, [0.0] * 24, 1), (20_003, [nan] + [1.0] * 23, 1), (20_004, [inf] + [1.0] * 23, 1), (20_005, [None] + [1.0] * 23, 1), (20_006, rows[0][1], None), (20_007, [1.0, 2.0], 1), (20_008, [2.0, 4.0], 1), (None, rows[0][1], 1)]
    schema = "vec_id long, embedding array<float>, label int, _k0 string, component string"
    full = [(*r, "x", "y") for r in rows + odd + [rows[3]]]
    want = brute(rows + odd)
    for block in (500, 12):
        got = op3_embedding_dedup.near_duplicates(spark.createDataFrame(full, schema).repartition(4), cluster_block=block).collect()
        assert len(got) == len(rows) + len(odd)
        for g in got:
            assert (g.n_links, g.component_id) == want.get(g.vec_id, (0, g.vec_id)), g
            assert g.kept == (g.vec_id is None or g.component_id == g.vec_id)
    assert op3_embedding_dedup.near_duplicates(spark.createDataFrame([], schema)).count() == 0


def test_estimates_are_unbiased_and_bounds_hold():
    rng = np.random.default_rng(1)
    d = 64
    x = rng.standard_normal((400, d))
    y = x + 0.3 * rng.standard_normal((400, d))
    x, y = (v / np.linalg.norm(v, axis=1, keepdims=True) for v in (x, y))
    stack = op3_embedding_dedup.rotations(d, 4, 1) / 2
    a, b = x @ stack.T, y @ stack.T
    code = np.sign(a) / np.sqrt(a.shape[1])
    f = (a * code).sum(1)
    error = (code * b).sum(1) / f - (x * y).sum(1)
    assert abs(error.mean()) < 0.01
    assert (np.abs(error) <= 5 * np.sqrt((1 - f * f) / f**2 / (a.shape[1] - 1))).all()
    links, n_exact = op3_embedding_dedup.exact_links(np.concatenate([x, y]), 0.93)
    z = np.concatenate([x, y])
    want = z @ z.T >= 0.93
    np.fill_diagonal(want, False)
    assert (links == want).all() and n_exact < 0.05 * len(z) ** 2 / 2


def test_components(spark):
    rng = np.random.default_rng(3)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 400, (250, 2))] + [(k, k + 1) for k in range(1000, 1060)] + [(2000, 2000 + k) for k in range(1, 100)]
    parent = {n: n for e in edges for n in e}

    def root(n):
        while parent[n] != n:
            n = parent[n]
        return n

    for a, b in edges:
        a, b = sorted((root(a), root(b)))
        parent[b] = a
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {n: root(n) for a, b in edges if a != b for n in (a, b)}


# --- pages -------------------------------------------------------------------------------------------


def test_dom_reading():
    page = '<body><p>One<br>two <b>bold</b>er<p>Three &amp; four<script>var x="</p>";</script><!-- c --><ul><li>a<li>b</ul><div title="x>y">five'
    dom = parse(page)
    assert joined(dom, [True] * len(dom.tag)) == "One two bolder Three & four a b five"
    for odd in ("", "plain", "<", "<p", "<p title='", "</p></div>", "<b><p></b>x</p>", "<!--", "<script>never", "<table><tr><td>x<td>y<tr><td>z"):
        dom = parse(odd)
        assert len(dom.after) == len(dom.tag) and all(i < a <= len(dom.tag) for i, a in enumerate(dom.after))
    assert joined(parse("<table><tr><td>x<td>y<tr><td>z"), [True] * 9) == "x y z"
    assert parse("<div>" * 30_000 + "deep").depth[-1] == 30_000


@pytest.mark.parametrize("page", ["<b><i></u>" * 100_000, "<u><article>" + "<b>" * 20_000 + "</u>" * 20_000, "<a =x" + "a" * 1_000_000 + ">", "<p><td>" + "<b>" * 20_000 + "<hr>" * 20_000])
def test_reading_takes_linear_time(page):
    began = time.process_time()
    parse(page)
    assert time.process_time() - began < 10


@pytest.fixture(scope="module")
def model(spark):
    return op7_html_trees.fit(spark.read.parquet("/root/testdata/sf0.01/pages.parquet"))


def own_article(page):
    inner = re.search(r"<article>(.*)</article>", page, re.S)[1]
    parts = [html.unescape(re.sub(r"</?b>", "", x)) for x in re.split(r"</?(?:p|h1|br)>", inner)]
    return " ".join(p for p in (" ".join(x.split()) for x in parts) if p)


def test_pages_of_the_tables(spark, model):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    got = {r.page_id: r for r in op7_html_trees.main_text(pages, model=model).collect()}
    want = {r.page_id: own_article(r.html) for r in pages.collect()}
    wrong = [i for i in want if got[i].text != want[i] or got[i].n_chars != len(want[i])]
    assert not wrong


def test_layouts_that_were_not_trained_on(model):
    """Composed pages of another seed: most text of most pages is told apart, whatever the layout."""
    composer = op7_html_trees.Composer([f"Sentence {i} with a few more words in it" for i in range(300)], seed=12345)
    pages = [composer.page() for _ in range(150)]
    good = 0
    for page, text in zip(pages, op7_html_trees.extract([re.sub(r' data-train="?\d"?', "", p) for p in pages], model)):
        dom = parse(page)
        inherited = [False] * len(dom.tag)
        for i in range(1, len(dom.tag)):
            inherited[i] = {"1": True, "0": False}.get(dom.mark[i], inherited[dom.parent[i]])
        want, found = joined(dom, inherited).split(), text.split()
        both = len(set(want) & set(found))
        good += 2 * both >= 0.9 * (len(set(want)) + len(set(found)))
    assert good >= 0.85 * len(pages)


def test_decoding_never_contradicts(model):
    rng = np.random.default_rng(0)
    composer = op7_html_trees.Composer(["A few words here"], seed=5)
    for _ in range(20):
        dom = parse(composer.page())
        keep = op7_html_trees.decode(dom, rng.standard_normal(len(dom.tag)) * 3)
        assert all(keep[dom.parent[i]] for i in range(1, len(dom.tag)) if keep[i])


def test_pages_edges(spark, model):
    schema = "page_id long, url string, html string, text string, n_chars string, model string"
    rows = [(1, "u", None), (2, None, ""), (None, "u", "<article><p>Some words. And more of them here.</p></article>"), (4, "u", "<p>" * 50_000), (5, "u", "x" * 300_000), (6, "u", "<<<>>>&&amp;"), (6, "u", "<<<>>>&&amp;")]
    got = op7_html_trees.main_text(spark.createDataFrame([(*r, "a", "b", "c") for r in rows], schema), model=model)
    assert got.columns == ["page_id", "url", "text", "n_chars"]
    found = got.collect()
    assert len(found) == len(rows) and {r.text for r in found if r.page_id in (1, 2)} == {""}
    empty = spark.createDataFrame([], schema)
    assert op7_html_trees.main_text(empty).count() == 0


# --- archives ----------------------------------------------------------------------------------------


def test_archive_round_trip(spark, tmp_path):
    big, other = "é" * 700, "z" * 1000
    rows = [(1, "http://a b", big), (2, "u", big), (9, None, big), (3, "u", None), (4, "u", ""), (5, "u", "s" * 999), (6, "u", "s" * 999), (7, "u", other), (7, "u", other), (None, "u", other), (8, "u", "q" * 500_000), (10, "u", "\r\n\r\nWARC/1.1\r\n\r\n" * 100)]
    pages = spark.createDataFrame([(*r, "x", "y") for r in rows], "page_id long, url string, html string, digest string, file string").repartition(3)
    folder = f"file://{tmp_path}/arc"
    got = op10_warc.archive(pages, folder).collect()
    want = []
    for i, _, text in rows:
        body = (text or "").encode()
        same = [j for j, _, t in rows if (t or "").encode() == body]
        first = max((j for j in same if j is not None), default=None)
        again = len(body) >= 1000 and i != first
        want.append((-1 if i is None else i, len(body), hashlib.sha1(body).hexdigest(), "revisit" if again else "response", first if again else None))
    want.remove((7, 1000, hashlib.sha1(other.encode()).hexdigest(), "response", None))
    want.append((7, 1000, hashlib.sha1(other.encode()).hexdigest(), "revisit", 7))
    assert sorted(map(str, want)) == sorted(str((-1 if g.page_id is None else g.page_id, g.payload_bytes, g.payload_digest, g.record_type, g.refers_to)) for g in got)
    for path in (tmp_path / "arc/normal").glob("*.warc.gz"):
        whole = gzip.decompress(path.read_bytes())
        lines = path.with_name(path.name + ".idx").read_text().splitlines()
        assert whole.count(b"WARC-Record-ID") == len(lines)
        at, size = map(int, lines[-1].split("\t")[:2])
        assert at + size == path.stat().st_size
    assert op10_warc.archive(pages.limit(0)).count() == 0


def test_monolithic_files_roll_over(spark, tmp_path):
    pages = spark.range(50).selectExpr("id AS page_id", "'u' AS url", "repeat(cast(id AS string), 2000) AS html").coalesce(1)
    mono, normal = f"file://{tmp_path}/m", f"file://{tmp_path}/n"
    (tmp_path / "m").mkdir()
    (tmp_path / "n").mkdir()
    written = op10_warc.write_monolithic(pages, mono, file_bytes=20_000)
    assert written.select("file").distinct().count() > 3
    files = op10_warc.normalise(written, mono, normal)
    assert op10_warc.read_indexed(files, normal).count() == 50
    n = written.select("file").distinct().count()
    assert n > 3 and op10_warc.per_file(files).rdd.getNumPartitions() == n


def test_inflate_reads_members_and_refuses_cut_archives():
    one = op10_warc.record("response", 1, "u", b"abc", "d")
    packed = gzip.compress(one) + gzip.compress(one)

    class Stream:
        def __init__(self, data):
            self.data = data

        def read(self, n):
            out, self.data = self.data[:7], self.data[7:]
            return out

    assert [b for _, b in op10_warc.records(op10_warc.inflate(Stream(packed)))] == [b"abc", b"abc"]
    with pytest.raises(ValueError):
        list(op10_warc.records(iter([one[:-3]])))
