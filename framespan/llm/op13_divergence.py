"""Source divergence audit: how far the term frequencies of each source lie from those of its language and of other sources.

Counting, grouping and joining use 64-bit digests of the terms only, so a shuffled row has one width whatever
the term. One aggregation by language and digest finds the terms that enough documents hold; it also takes the smallest and the
largest string of each digest, and where these differ the digest stands for several terms and is split (its terms are
counted under digest and text from there on). Text is joined back to the terms of the report alone.

Tasks count terms by (lang, source) before anything is shuffled and write these partial counts once. A term is kept in a language
with at least ``least_docs`` of its documents. Smoothed probabilities are whole numbers in units of 1e-9, and all sums are
whole numbers.

The sum over all kept terms of f(p, q) for two sources does not visit terms that both lack: with the probabilities a0, b0 that
absent terms have, ``sum f(p,q) = V f(a0,b0) + sum over terms of the first (f(p,b0) - f(a0,b0)) + the same for the second + sum over
shared terms (f(p,q) - f(p,b0) - f(a0,q) + f(a0,b0))``. Terms are dealt to shards of bounded size and sources to blocks; a task sees one
shard of two blocks and adds its part of every pair of sources.

Defined results: null text, lang and source are ''; texts without terms still make their (lang, source) occur; a
language without kept terms has value 0 for all pairs and no term rows; repeated rows are documents of their own; a
language with one source has no pair rows; an empty table gives no rows; other columns are ignored. Terms of any length
are hashed whole.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from framespan.llm.common import block_pairs, remove, stored
from framespan.operators.joins import attach

UNIT = 1_000_000_000
LEAST_DOCS = 3
TOP = 200
#: Partial counts that a task holds before it writes them out.
HELD = 400_000
#: Rows (term and source) of a shard, shards of a language at least, sources of a block.
SHARD_ROWS, SHARDS, BLOCK = 200_000, 16, 256
#: Sub-keys over which the ranking of a group is dealt before its last round.
RANK_SALTS = 64

#: All bytes that are neither ASCII letters nor part of a non-ASCII character become spaces, A-Z become a-z.
_TERM_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
_PARTIAL = pa.schema([("lang", pa.string()), ("source", pa.string()), ("term", pa.string()), ("n", pa.int64()), ("docs", pa.int64())])
KEY = ["digest", "alt"]


def terms_of(text: str) -> list[bytes]:
    """The matches of ``[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+`` with A-Z lower-cased, as UTF-8."""
    return text.encode("utf-8", "surrogatepass").translate(_TERM_BYTES).split()


def partial_counts(docs: DataFrame) -> DataFrame:
    """(lang, source, term, n, docs): the counts of what a task holds at a time."""

    def flush(n: dict, seen: dict) -> Iterator[pa.RecordBatch]:
        for (lang, source), counts in n.items():
            terms = list(counts)
            for part in (terms[at : at + 50_000] for at in range(0, len(terms), 50_000)):
                columns = [[lang] * len(part), [source] * len(part), [t.decode("utf-8", "replace") for t in part], [counts[t] for t in part], [seen[lang, source][t] for t in part]]
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _PARTIAL)], schema=_PARTIAL)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, seen = defaultdict(Counter), defaultdict(Counter)
        for batch in batches:
            for lang, source, text in zip(*(batch.column(i).to_pylist() for i in range(2)), batch.column(2)):
                terms = terms_of(text.as_py())
                n[lang, source].update(terms)
                seen[lang, source].update(set(terms))
            if sum(map(len, n.values())) > HELD:
                yield from flush(n, seen)
                n, seen = defaultdict(Counter), defaultdict(Counter)
        yield from flush(n, seen)

    return docs.mapInArrow(run, "lang string, source string, term string, n long, docs long")


def digest(term: Column, bits: int = 64) -> Column:
    """A 64-bit digest; fewer ``bits`` make collisions, for tests."""
    return F.xxhash64(term) if bits == 64 else F.pmod(F.xxhash64(term), F.lit(2**bits))


def kept_terms(counts: DataFrame, least_docs: int) -> tuple[DataFrame, DataFrame]:
    """The kept terms (lang, digest, alt, c, term) and ``counts`` with ``alt``: '' where a digest has one term, else the term itself."""
    held = [F.sum("docs").alias("docs"), F.sum("n").alias("c"), F.min("term").alias("term")]
    by_digest = counts.groupBy("lang", "digest").agg(*held, F.max("term").alias("high")).where(F.col("docs") >= least_docs)
    by_digest, _ = stored(by_digest, "digests")
    several = by_digest.where("term <> high").select("lang", "digest", F.lit(True).alias("several"))
    n_several = several.count()
    one = by_digest.where("term = high").select("lang", "digest", F.lit("").alias("alt"), "c", "term")
    if not n_several:
        return one, counts.withColumn("alt", F.lit(""))
    marked = attach(counts, several, ["lang", "digest"], n_several, "left")
    marked = marked.withColumn("alt", F.when(F.col("several"), F.col("term")).otherwise("")).drop("several")
    split = marked.where("alt <> ''").groupBy("lang", *KEY).agg(*held).where(F.col("docs") >= least_docs)
    split, _ = stored(split.drop("docs"), "split-digests")
    return one.unionByName(split), marked


def probability(count: Column, total: Column, size: Column) -> Column:
    """``1 + floor(1e9 (count + 1) / (total + size))`` in whole numbers; null where the vocabulary is empty."""
    below = F.nullif(total + size, F.lit(0))
    wide = F.lit(UNIT).cast("decimal(10,0)") * (count.cast("decimal(20,0)") + 1)
    fits = count < 2**63 // UNIT - 1
    return F.lit(1) + F.when(fits, F.call_function("div", F.lit(UNIT) * (count + 1), below)).otherwise(F.call_function("div", wide, below.cast("decimal(20,0)")))


def excess(p: Column, q: Column) -> Column:
    """``floor((p - q)^2 / q)`` for long columns."""
    return F.call_function("div", (p - q) * (p - q), q)


def _f(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) * (p - q) // q


def _shard(table: pa.Table) -> pa.Table:
    """The part of one shard of terms in the sums of all pairs of sources of two blocks, less V f(a0, b0)."""
    lang, i, j = (table.column(c)[0].as_py() for c in ("lang", "_i", "_j"))
    at, block, p, p0, digests = (table.column(c).to_numpy() for c in ("at", "_blk", "p", "p0", "digest"))
    alt = table.column("alt").combine_chunks().dictionary_encode().indices.to_numpy(zero_copy_only=False)
    head = ~table.column("is_term").to_numpy(zero_copy_only=False)
    order = np.argsort(at[head])
    places, zero, home = at[head][order], p0[head][order], block[head][order]
    rows = np.flatnonzero(~head)
    rows = rows[np.lexsort((at[rows], alt[rows], digests[rows]))]
    s, p, block = np.searchsorted(places, at[rows]), p[rows], block[rows]
    out = np.zeros((len(places), len(places)), np.int64)
    # terms of one source against the other source's absent terms, once for each source and count
    each, times = np.unique(np.stack([s, p]), axis=1, return_counts=True)
    for a in range(0, each.shape[1], 4096):
        (g, v), m = each[:, a : a + 4096], times[a : a + 4096, None]
        ground = _f(zero[g][:, None], zero[None, :])
        np.add.at(out, g, m * (_f(v[:, None], zero[None, :]) - ground))
        back = _f(zero[None, :], zero[g][:, None])
        np.add.at(out.T, g, m * (_f(zero[None, :], v[:, None]) - back))
    # shared terms: rows of one term lie side by side, so shifts by 1, 2, ... meet each pair once
    change = np.ones(len(rows), np.int64)
    if len(rows):
        r = rows
        change[1:] = (digests[r][1:] != digests[r][:-1]) | (alt[r][1:] != alt[r][:-1])
    term = np.cumsum(change)
    for shift in range(1, len(rows)):
        same = term[shift:] == term[:-shift]
        if not same.any():
            break
        left = np.flatnonzero(same & (block[shift:] != block[:-shift]) if i != j else same)
        a, b, u, v = s[left], s[left + shift], p[left], p[left + shift]
        za, zb = zero[a], zero[b]
        np.add.at(out, (a, b), _f(u, v) - _f(u, zb) - _f(za, v) + _f(za, zb))
        np.add.at(out, (b, a), _f(v, u) - _f(v, za) - _f(zb, u) + _f(zb, za))
    wanted = (out != 0) & ((home[:, None] != home[None, :]) if i != j else ~np.eye(len(places), dtype=bool))
    g, h = np.nonzero(wanted)
    return pa.table({"lang": pa.array([lang] * len(g), pa.string()), "g": pa.array(places[g], pa.int32()), "h": pa.array(places[h], pa.int32()), "part_value": pa.array(out[g, h], pa.int64())})


def pair_values(rows: DataFrame, groups: DataFrame) -> DataFrame:
    """(lang, source, item, value) for every ordered pair of sources of a language."""
    shard = F.pmod(F.xxhash64(*KEY), F.col("shards")).cast("int")
    none = F.lit(0).cast("long")
    of_terms = rows.select("lang", "at", "sources", shard.alias("shard"), F.lit(True).alias("is_term"), "p", "p0", *KEY)
    of_groups = groups.where("size > 0").withColumn("shard", F.explode(F.sequence(F.lit(0), F.col("shards") - 1)))
    of_groups = of_groups.select("lang", "at", "sources", "shard", F.lit(False).alias("is_term"), none.alias("p"), "p0", none.alias("digest"), F.lit("").alias("alt"))
    dealt = block_pairs(of_terms.unionAll(of_groups), ["lang", "shard"], F.ceil(F.col("sources") / BLOCK), F.col("at"))
    parts = dealt.groupBy("lang", "shard", "_i", "_j").applyInArrow(_shard, "lang string, g int, h int, part_value long")
    sums = parts.groupBy("lang", "g", "h").agg(F.sum("part_value").alias("added"))
    one = groups.select("lang", "source", "size", F.col("at").alias("g"), F.col("p0").alias("a0"))
    other = groups.select("lang", F.col("source").alias("item"), F.col("at").alias("h"), F.col("p0").alias("b0"))
    pairs = one.join(other, "lang").where("g <> h").join(sums, ["lang", "g", "h"], "left")
    ground = F.coalesce(F.col("size") * excess(F.col("a0"), F.col("b0")), F.lit(0))
    return pairs.select("lang", "source", "item", (ground + F.coalesce("added", F.lit(0))).cast("long").alias("value"))


def _top(rows: DataFrame, order: list[Column], k: int) -> DataFrame:
    """The first ``k`` of each (lang, source), ``rank`` from 1: first within sub-keys, then among what these leave."""
    some = Window.partitionBy("lang", "source", "_salt").orderBy(*order)
    whole = Window.partitionBy("lang", "source").orderBy(*order)
    salted = rows.withColumn("_salt", F.pmod(F.xxhash64(*KEY), F.lit(RANK_SALTS)))
    salted = salted.withColumn("rank", F.row_number().over(some)).where(F.col("rank") <= k)
    return salted.withColumn("rank", F.row_number().over(whole)).where(F.col("rank") <= k).drop("_salt")


def term_values(rows: DataFrame, kept: DataFrame, top: int) -> DataFrame:
    """(lang, source, item, value, rank): the terms a source has more often than its language; text joined to candidates only."""
    over = rows.where("p > q").select("lang", "source", *KEY, excess(F.col("p"), F.col("q")).alias("value"))
    last = _top(over, [F.desc("value")], top).where(F.col("rank") == top).select("lang", "source", F.col("value").alias("least"))
    ahead = attach(over, last, ["lang", "source"], how="left").where("least is null or value >= least").drop("least")
    named = ahead.join(kept.select("lang", *KEY, F.col("term").alias("item")), ["lang", *KEY])
    return _top(named, [F.desc("value"), F.asc("item")], top).select("lang", "source", "item", "value", "rank")


def audit(docs: DataFrame, lang_col: str = "lang", source_col: str = "source", text_col: str = "text", least_docs: int = LEAST_DOCS, top: int = TOP, bits: int = 64) -> DataFrame:
    """lang, source, part ('pair', 'term'), item, value, rank."""

    def filled(name: str) -> Column:
        return F.coalesce(F.col(f"`{name}`").cast("string"), F.lit(""))

    plain = docs.select(filled(lang_col).alias("lang"), filled(source_col).alias("source"), filled(text_col).alias("text"))
    counted, counted_path = stored(partial_counts(plain), "term-counts")
    kept, keyed = kept_terms(counted.withColumn("digest", digest(F.col("term"), bits)), least_docs)
    wanted = kept.select("lang", *KEY, "c").hint("shuffle_hash")
    both = keyed.select("lang", "source", *KEY, "n").join(wanted, ["lang", *KEY]).groupBy("lang", *KEY, "source").agg(F.sum("n").alias("n"), F.first("c").alias("c"))
    both, _ = stored(both, "kept-counts")
    remove(docs.sparkSession, counted_path)

    by_source = both.groupBy("lang", "source").agg(F.sum("n").alias("total"), F.count("*").alias("n_rows"))
    by_lang = kept.groupBy("lang").agg(F.count("*").alias("size"), F.sum("c").alias("lang_total"))
    of_lang = Window.partitionBy("lang")
    groups = plain.select("lang", "source").distinct().join(by_source, ["lang", "source"], "left").join(by_lang, "lang", "left")
    groups = groups.na.fill(0, ["total", "lang_total", "size", "n_rows"]).select(
        "lang", "source", "total", "lang_total", "size",
        (F.row_number().over(of_lang.orderBy("source")) - 1).cast("int").alias("at"),
        F.count("*").over(of_lang).alias("sources"),
        F.greatest(F.lit(SHARDS), F.ceil(F.sum("n_rows").over(of_lang) / SHARD_ROWS)).cast("int").alias("shards"),
        probability(F.lit(0), F.col("total"), F.col("size")).alias("p0"),
    )
    groups, _ = stored(groups, "groups")
    rows = attach(both, groups, ["lang", "source"])
    rows = rows.withColumns({"p": probability(F.col("n"), F.col("total"), F.col("size")), "q": probability(F.col("c"), F.col("lang_total"), F.col("size"))})

    by_value = Window.partitionBy("lang", "source").orderBy(F.desc("value"), F.asc("item"))
    pairs = pair_values(rows, groups).withColumn("rank", F.row_number().over(by_value))
    terms = term_values(rows, kept, top)
    columns = ["lang", "source", "part", "item", "value", "rank"]
    return pairs.withColumn("part", F.lit("pair")).select(*columns).unionAll(terms.withColumn("part", F.lit("term")).select(*columns))
