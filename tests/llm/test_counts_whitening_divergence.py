"""Token counts against the library, whitening against dense algebra, the divergence audit against brute force."""

from __future__ import annotations

import random
import re
from collections import Counter, defaultdict
from fractions import Fraction

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import types as T
from tokenizers import Tokenizer

from framespan.llm import op11_token_counts as op11
from framespan.llm import op12_whitening as op12
from framespan.llm import op13_divergence as op13

PATH = public_tokenizers.path("byte_bpe_50k.json")
CLASHES = ["_id", "_bytes", "_chunks", "n", "docs", "term", "digest", "alt", "value", "rank", "at", "_x", "deviation", "whitened"]
AWKWARD = [None, "", " ", "\n\n  \n", "a", "word " * 30_000, "x" * 150_000, "'" * 5_000, "Ünïcödé \U0001f600 tëxt\r\n'll don't 12'3's", "<|endoftext|>", "a  <|endoftext|>  b<|endoftext|>", "same", "same", "\x00\x7f­ end"]


def table(spark, rows, names, kinds):
    fields = [T.StructField(n, k) for n, k in zip(names, kinds)] + [T.StructField(c, T.StringType()) for c in CLASHES]
    return spark.createDataFrame([(*r, *["x"] * len(CLASHES)) for r in rows], T.StructType(fields)).repartition(3)


# --- token counts --------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


@pytest.fixture(scope="module")
def machine():
    return op11.Tokenizer(op11.read_vocabulary(PATH))


def strange_texts(n):
    r = random.Random(7)
    parts = ["a", "b", "e", "s", "t", "'", "'s", "'re", "'ll", " ", "  ", "\n", "\t", "1", "23", "-", "--", "é", "中", "\U0001f600", "A", "ing", " the", "="]
    mixed = ["".join(r.choice(parts) for _ in range(r.randint(0, 60))) for _ in range(n)]
    runs = [r.choice("aeo-= \n'x1é") * r.randint(1, 300) for _ in range(n // 20)]
    points = ["".join(chr(r.choice([r.randrange(1, 0xD800), r.randrange(0x10000, 0x20000)])) for _ in range(60)) for _ in range(n // 20)]
    return mixed + runs + points


def test_transducers_give_the_librarys_counts(library, machine):
    texts = strange_texts(4000)
    want = [len(e.ids) for e in library.encode_batch(texts, add_special_tokens=False)]
    got = machine.maps(texts, [True] * len(texts), [True] * len(texts))
    assert [m.count for m in got] == want and not any(m.head or m.tail for m in got)


def test_maps_of_chunks_compose(library, machine):
    r = random.Random(3)
    for text in strange_texts(600):
        size = r.choice([1, 2, 3, 7, 20])
        cut = [text[i : i + size] for i in range(0, len(text), size)] or [""]
        maps = machine.maps(cut, [i == 0 for i in range(len(cut))], [i == len(cut) - 1 for i in range(len(cut))])
        assert machine.scan(maps)[-1] == ("", len(library.encode(text, add_special_tokens=False).ids), "")
        if len(maps) > 2:
            assert machine.compose(machine.compose(*maps[:2]), maps[2]) == machine.compose(maps[0], machine.compose(*maps[1:3]))


def test_tables_of_states_are_emptied_when_full(library, machine, monkeypatch):
    monkeypatch.setattr(op11, "STATES", 50)
    monkeypatch.setattr(op11, "PIECES", 20)
    small = op11.Tokenizer(op11.read_vocabulary(PATH))
    texts = strange_texts(200)
    assert [m.count for m in small.maps(texts, [True] * len(texts), [True] * len(texts))] == [len(library.encode(t, add_special_tokens=False).ids) for t in texts]
    assert len(small.bytes.states) <= 50 and len(small.known) <= 20


@pytest.mark.parametrize("chunk", [5, op11.CHUNK])
def test_counts_on_spark(spark, library, chunk):
    texts = [t for t in AWKWARD if chunk > 5 or len(t or "") < 10_000] + strange_texts(60)
    docs = table(spark, list(enumerate(texts)), ["doc_id", "text"], [T.LongType(), T.StringType()])
    got = {r["doc_id"]: (r["n_bytes"], r["n_tokens"]) for r in op11.count_tokens(docs, PATH, chunk=chunk).collect()}
    assert got == {i: (len((t or "").encode()), len(library.encode(t or "", add_special_tokens=False).ids)) for i, t in enumerate(texts)}
    assert op11.count_tokens(docs.limit(0), PATH).count() == 0


def test_other_kinds_of_vocabularies_are_refused():
    with pytest.raises(ValueError):
        op11.read_vocabulary(public_tokenizers.path("word_bpe_49k.json"))


# --- whitening -----------------------------------------------------------------------------------------


def vectors(spark, rows):
    return table(spark, rows, ["vec_id", "embedding"], [T.LongType(), T.ArrayType(T.DoubleType())])


def brute_whitening(rows, k=4):
    usable = [(i, [int(np.floor(256 * c)) for c in v]) for i, v in rows if v and all(c is not None and np.isfinite(c) for c in v)]
    fit = sorted({tuple(x) for _, x in usable})
    n, d = len(fit), len(fit[0])
    s = [sum(x[j] for x in fit) for j in range(d)]
    y = [[n * x[j] - s[j] for j in range(d)] for x in fit]
    v = np.array([[float(Fraction(sum(r[a] * r[b] for r in y), n**3)) for b in range(d)] for a in range(d)])
    values, basis = np.linalg.eigh(v)
    values, basis = values[::-1], basis[:, ::-1]
    out = {}
    for i, x in usable:
        whole = [n * x[j] - s[j] for j in range(d)]
        out.setdefault(i, []).append((sum(c * c for c in whole), [float(np.array([c / n for c in whole]) @ basis[:, j] / np.sqrt(values[j])) if values[j] > 1e-13 * values[0] else None for j in range(min(k, d))]))
    return n, values[:k] / np.trace(v), out


def check_whitening(spark, rows, tolerance=1e-9):
    n, explained, want = brute_whitening(rows)
    got = defaultdict(dict)
    report = op12.whitening_report(vectors(spark, rows)).collect()
    for r in report:
        got[r["vec_id"]].setdefault(r["component"], []).append(r)
        assert r["n"] == n and r["explained"] == pytest.approx(explained[r["component"] - 1], rel=1e-9, abs=1e-12)
        assert r["identity_error"] is None or r["identity_error"] < 1e-9
    assert got.keys() == want.keys()
    for i, copies in want.items():
        deviation, whitened = copies[0]
        for at, w in enumerate(whitened):
            assert len(got[i][at + 1]) == len(copies)
            for r in got[i][at + 1]:
                assert r["deviation"] == (deviation if deviation < 2**63 else None)
                assert (r["whitened"] is None) == (w is None) and (w is None or abs(r["whitened"]) == pytest.approx(abs(w), rel=tolerance, abs=tolerance))
    return report


def test_whitening_of_awkward_rows(spark):
    r = np.random.default_rng(5)
    good = [(i, [float(c) for c in r.normal(size=6) * [3, 2, 1.5, 1, 0.5, 0.2]]) for i in range(200)]
    awkward = [(300, None), (301, [None, *[0.0] * 5]), (302, [float("nan")] * 6), (303, [float("inf"), *[0.0] * 5]), (304, []), (305, [0.0] * 6), (306, [-0.0] * 6)]
    copies = [(400, good[0][1])] * 3 + [(401, [c + 1e-9 for c in good[1][1]])]
    check_whitening(spark, good + awkward + copies)
    with_other_lengths = good + [(500, [1.0, 2.0]), (501, [1.0, 3.0])]
    assert len(op12.whitening_report(vectors(spark, with_other_lengths)).collect()) == 4 * len(good)
    assert op12.whitening_report(vectors(spark, [])).count() == 0
    assert op12.whitening_report(vectors(spark, [(1, None)])).count() == 0


def test_whitening_is_exact_for_large_entries_and_small_tables(spark):
    r = np.random.default_rng(6)
    large = [(i, [float(c) for c in r.normal(size=3) * 1e9 + 1e13]) for i in range(50)]
    check_whitening(spark, large, 1e-6)
    few = [(i, [float(c) for c in r.normal(size=5)]) for i in range(3)]
    report = check_whitening(spark, few)
    assert {row["component"] for row in report if row["whitened"] is None} == {3, 4}
    one = op12.whitening_report(vectors(spark, [(1, [1.0, 2.0])])).collect()
    assert [(row["component"], row["n"], row["deviation"], row["whitened"], row["explained"]) for row in sorted(one, key=lambda x: x["component"])] == [(1, 1, 0, None, None), (2, 1, 0, None, None)]


def test_polarisation_is_exact():
    r = np.random.default_rng(8)
    for scale in (10, 2**40, 2**61):
        x = r.integers(-scale, scale, size=(40, 4))
        n, s = len(x), [int(v) for v in x.astype(object).sum(axis=0)]
        pairs = [(i, j) for i in range(4) for j in range(i, 4)]
        got = op12.covariance(n, s, dict(zip(pairs, op12.pair_squares(x))))
        want = [[float(Fraction(n * sum(int(a) * int(b) for a, b in zip(x[:, i], x[:, j])) - s[i] * s[j], n * n)) for j in range(4)] for i in range(4)]
        assert (got == np.array(want)).all()


# --- divergence ----------------------------------------------------------------------------------------

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")


def brute_audit(rows, least=3, top=200):
    rows = [tuple("" if v is None else v for v in r) for r in rows]
    terms = [(lang, source, TERM.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text))) for lang, source, text in rows]
    seen, counts, groups = defaultdict(Counter), defaultdict(Counter), defaultdict(set)
    for lang, source, ts in terms:
        groups[lang].add(source)
        seen[lang].update(set(ts))
        counts[lang, source].update(ts)
    out = []
    for lang, sources in groups.items():
        kept = sorted(t for t, k in seen[lang].items() if k >= least)
        v = len(kept)

        def probabilities(c):
            n = sum(c[t] for t in kept)
            return {t: 1 + 10**9 * (c[t] + 1) // (n + v) for t in kept}

        whole = Counter()
        for source in sources:
            whole.update(counts[lang, source])
        q_lang, p = probabilities(whole), {s: probabilities(counts[lang, s]) for s in sources}
        for s in sources:
            pairs = [(sum((p[s][t] - p[o][t]) ** 2 // p[o][t] for t in kept), o) for o in sources if o != s]
            single = [((p[s][t] - q_lang[t]) ** 2 // q_lang[t], t) for t in kept if counts[lang, s][t] and p[s][t] > q_lang[t]]
            for part, found in (("pair", pairs), ("term", single)):
                found.sort(key=lambda x: (-x[0], x[1].encode()))
                out += [(lang, s, part, item, value, rank) for rank, (value, item) in enumerate(found, 1) if part == "pair" or rank <= top]
    return sorted(out)


def corpus(n, seed=2):
    r = random.Random(seed)
    words = ["Alpha", "beta", "gamma", "ünï", "中文", "naïve", *[f"w{chr(97 + i)}{chr(97 + j)}" for i in range(12) for j in range(12)]]
    rows = [(r.choice(["en", "de", None]), r.choice(["a", "b", "c", None, "dd"]) if r.random() < 0.7 else "hot", " ".join(r.choice(words[: r.choice([8, 60, 150])]) + r.choice(["", "1", "!"]) for _ in range(r.randint(0, 40)))) for _ in range(n)]
    return rows + [("fr", "only", "one two"), ("it", "x", None), ("it", "y", "123 ..."), ("", "", None), ("en", "long", "q" * 200_000), ("de", "void", "")] + [("en", "same", "alpha twice twice")] * 4


def audited(spark, rows, **how):
    docs = table(spark, rows, ["lang", "source", "text"], [T.StringType()] * 3)
    return sorted(tuple(r) for r in op13.audit(docs, **how).collect())


@pytest.mark.parametrize("bits", [64, 4])
def test_audit_and_split_of_colliding_digests(spark, bits):
    rows = corpus(400)
    assert audited(spark, rows, bits=bits, top=20) == brute_audit(rows, top=20)


def test_audit_in_blocks_of_sources(spark, monkeypatch):
    monkeypatch.setattr(op13, "BLOCK", 2)
    monkeypatch.setattr(op13, "SHARD_ROWS", 30)
    monkeypatch.setattr(op13, "HELD", 50)
    rows = corpus(200, seed=4)
    assert audited(spark, rows) == brute_audit(rows)


def test_audit_of_nothing(spark):
    assert audited(spark, []) == []
    assert audited(spark, [("en", "a", "x")]) == []
