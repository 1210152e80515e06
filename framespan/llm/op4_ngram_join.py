"""N-gram Jaccard join by chosen paths.

A document is the set of its word 5-grams (64-bit hashes). In each of several runs a set chooses, at each
step of a path, every token whose hash under (run, path so far) is below 1 / (threshold · size): about
1 / threshold tokens. Similar sets share tokens and so choose the same ones. Buckets are the documents of
one path. A bucket of more than ``SMALL`` documents is split by the next step, up to ``DEPTH`` steps;
small ones, and what is left large after the last step, are brute-forced on minwise sketches, in blocks
of bounded size. The number of runs follows from the target recall of a pair that just meets the threshold.

Nothing is emitted per pair. A bucket or block yields a spanning forest of its likely links, and connected
likely links form clusters. Each cluster is then compared exactly, set against set, in pairs of
blocks of bounded size; these yield link counts and a spanning forest of true links. Documents with equal sets
are one class all along, so copies cost a row each.

Defined results: texts of one to four words have one shingle of all their words; documents without words
have no set and link with nothing; rows repeated in full count as one document; ids must be whole numbers,
rows with a null id are left out; equal ids with different texts each link, and are reported under the id with
their own row; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from framespan.llm.common import block_pairs, components, cut, mix64, remove, row_key, sorted_groups, stored, words_of

WORDS = 5
THRESHOLD = Fraction(4, 5)
RECALL = 0.9999
DEPTH = 3
SMALL = 64
#: Documents of one block in brute force on sketches, and set tokens of one block in exact comparison.
SKETCH_BLOCK, EXACT_TOKENS, EXACT_DOCS = 1000, 400_000, 400
#: Bits of a sketch; a pair is likely if its estimate is within SLACK standard errors of the threshold.
SKETCH_LOG, SLACK = 7, 5.0
SKETCH_BITS = 1 << SKETCH_LOG

_ODD = np.uint64(0x9E3779B97F4A7C15)


def shingles(text: str | None, words: int = WORDS) -> np.ndarray:
    """Distinct 64-bit hashes of the runs of ``words`` words (of all words if there are fewer)."""
    found = words_of(text)
    if not found:
        return np.empty(0, np.uint64)
    w = np.fromiter(map(xxh64_intdigest, found), np.uint64, len(found))
    size = min(words, len(w))
    out = w[: len(w) - size + 1].copy()
    for k in range(1, size):
        out = out * _ODD + w[k : k + len(out)]
    return np.unique(mix64(out + np.uint64(size)))


def runs_for(recall: float, depth: int) -> int:
    """Runs until a pair at the threshold meets in one of them with probability ``recall``.

    A pair shares a Poisson number of chosen tokens with mean one at each step, so it survives d steps
    with q_d = 1 - exp(-q_(d-1)), q_0 = 1.
    """
    q = 1.0
    for _ in range(depth):
        q = 1 - math.exp(-q)
    return math.ceil(math.log(1 - recall) / math.log(1 - q))


def chosen(tokens: np.ndarray, paths: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Next paths and the index of the path that each extends.

    A token is taken if its product with the path, an odd multiplier, falls below the bound.
    """
    bound = np.uint64(min(2**64 - 1, int(2**64 / (threshold * len(tokens)))))
    nexts, parents = [], []
    rows = max(1, 1_000_000 // len(tokens))
    for lo in range(0, len(paths), rows):
        some = paths[lo : lo + rows]
        parent, token = np.nonzero((some | np.uint64(1))[:, None] * tokens < bound)
        nexts.append(mix64(tokens[token] * _ODD + some[parent]))
        parents.append((parent + lo).astype(np.int32))
    return np.concatenate(nexts) if nexts else np.empty(0, np.uint64), np.concatenate(parents) if parents else np.empty(0, np.int32)


def sketch(tokens: np.ndarray) -> bytes:
    """One bit of each of ``SKETCH_BITS`` minwise hashes: equal with probability (1 + Jaccard) / 2.

    One pass over a set: its tokens are dealt to bins by the top bits of a hash, and each bin keeps its
    least; empty bins draw from further passes of the same kind, and so stay comparable.
    """
    least = np.zeros(SKETCH_BITS, np.uint64)
    open_bins = np.ones(SKETCH_BITS, bool)
    turns, done = 1 + 3 * SKETCH_BITS // len(tokens), 0
    while open_bins.any() and done < 2000:
        turn = np.arange(done + 1, done + turns + 1, dtype=np.uint64)[:, None]
        h = np.sort(tokens * (2 * turn + np.uint64(1)) + turn * _ODD, axis=1)
        place = (h >> np.uint64(64 - SKETCH_LOG)).astype(np.int16)
        first = np.diff(place, axis=1, prepend=np.int16(-1)) != 0
        bins, at = np.unique(place[first], return_index=True)  # the earliest pass that fills a bin counts
        now = open_bins[bins]
        least[bins[now]] = h[first][at[now]]
        open_bins[bins] = False
        done += turns
    return np.packbits((mix64(least) & np.uint64(1)).astype(np.uint8)).tobytes()


_SETS = "_k0 long, _k1 long, _id long, _c0 long, _c1 long, _size int, _sketch binary, _p1 array<long>, _p2 array<long>, _u2 array<int>, _p3 array<long>, _u3 array<int>"


def _paths(words: int, threshold: float, runs: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        roots = mix64(np.arange(1, runs + 1, dtype=np.uint64) * _ODD)
        for batch in batches:
            for lo in range(0, batch.num_rows, 500):
                part = batch.slice(lo, 500)
                rows = []
                for text in part.column(0):
                    tokens = shingles(text.as_py(), words)
                    if not len(tokens):
                        rows.append((None, None, 0, None, None, None, None, None, None))
                        continue
                    c = np.frombuffer(hashlib.md5(tokens.tobytes()).digest(), np.int64)
                    p1, _ = chosen(tokens, roots, threshold)
                    p2, u2 = chosen(tokens, p1, threshold)
                    p3, u3 = chosen(tokens, p2, threshold)
                    rows.append((c[0], c[1], len(tokens), sketch(tokens), p1.view(np.int64), p2.view(np.int64), u2, p3.view(np.int64), u3))
                kinds = [pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.list_(pa.int64()), pa.list_(pa.int32())]
                cols = [pa.array(list(c), k) for c, k in zip(zip(*rows), kinds)]
                yield pa.RecordBatch.from_arrays([*part.columns[1:], *cols], names=[x.split()[0] for x in _SETS.split(", ")])

    return run


def _forest(links: np.ndarray, ids: np.ndarray) -> list[tuple[int, int]]:
    """Edges (root, member) that connect what the symmetric boolean matrix connects."""
    seen = np.zeros(len(ids), bool)
    out = []
    for i in np.flatnonzero(links.any(1)):
        if seen[i]:
            continue
        seen[i] = True
        reach = frontier = links[i] & ~seen
        while frontier.any():
            seen |= frontier
            frontier = links[frontier].any(0) & ~seen
            reach = reach | frontier
        out += [(int(ids[i]), int(ids[j])) for j in np.flatnonzero(reach)]
    return out


def _bits(column: pa.ChunkedArray) -> np.ndarray:
    packed = np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(len(column), -1)
    return np.unpackbits(packed, axis=1).astype(np.float32) * 2 - 1


def _likely(size: np.ndarray, bits: np.ndarray, threshold: float) -> np.ndarray:
    """Pairs whose sizes and sketches allow the threshold."""
    d = bits.shape[1]
    p = (1 + threshold) / 2
    least = 2 * p - 1 - SLACK * 2 * math.sqrt(p * (1 - p) / d)
    links = (bits @ bits.T) / d >= least
    links &= np.minimum.outer(size, size) >= threshold * np.maximum.outer(size, size)
    np.fill_diagonal(links, False)
    return links


def _candidates(threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        edges: list[tuple[int, int]] = []
        for group in sorted_groups(batches, ["_path", "_i", "_j"]):
            if group.num_rows > 1:
                size = group.column("_size").to_numpy().astype(np.int64)
                links = _likely(size, _bits(group.column("_sketch")), threshold)
                if links.any():
                    edges += _forest(links, group.column("_rep").to_numpy())
            if len(edges) > 50_000:
                yield pa.RecordBatch.from_pylist([{"a": a, "b": b} for a, b in set(edges)])
                edges = []
        if edges:
            yield pa.RecordBatch.from_pylist([{"a": a, "b": b} for a, b in set(edges)])

    return run


def _intersections(sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of all intersections: products of the token incidence matrix, in slices of tokens."""
    rows = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    tokens, at, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = count > 1
    number = np.cumsum(shared) - 1
    rows, at = rows[shared[at]], number[at[shared[at]]]
    out = np.zeros((len(sets), len(sets)), np.float32)
    order = np.argsort(at, kind="stable")
    rows, at = rows[order], at[order]
    width = 8192
    for lo in range(0, int(shared.sum()), width):
        a, b = np.searchsorted(at, [lo, lo + width])
        m = np.zeros((len(sets), width), np.float32)
        m[rows[a:b], at[a:b] - lo] = 1
        out += m @ m.T
    return out


def _verify(threshold: Fraction):
    p, q = threshold.numerator, threshold.denominator

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(rows):
            return pa.RecordBatch.from_arrays(
                [pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.int64())], names=["a", "b", "n"]
            )

        rows: list[tuple] = []
        for group in sorted_groups(batches, ["component", "_i", "_j"]):
            if group.num_rows < 2:
                continue
            ids, copies, block = (group.column(c).to_numpy() for c in ("_rep", "_copies", "_blk"))
            sets = [np.frombuffer(s, np.uint64) for s in group.column("_set").to_pylist()]
            size = np.array([len(s) for s in sets], np.int64)
            both = np.rint(_intersections(sets)).astype(np.int64)
            links = (p + q) * both >= p * np.add.outer(size, size)
            np.fill_diagonal(links, False)
            if group.column("_i")[0].as_py() != group.column("_j")[0].as_py():
                links &= np.not_equal.outer(block, block)
            n = links @ copies
            rows += [(int(ids[k]), None, int(n[k])) for k in np.flatnonzero(n)]
            rows += [(a, b, 0) for a, b in _forest(links, ids)]
            if len(rows) > 50_000:
                yield out(rows)
                rows = []
        if rows:
            yield out(rows)

    return run


def _sets_of(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 200):
                part = batch.slice(lo, 200)
                sets = pa.array([shingles(t.as_py(), words).tobytes() for t in part.column(0)], pa.binary())
                yield pa.RecordBatch.from_arrays([*part.columns[1:], sets], names=[*part.schema.names[1:], "_set"])

    return run


def join(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, threshold: Fraction = THRESHOLD, recall: float = RECALL, small: int = SMALL, exact_docs: int = EXACT_DOCS, sketch_block: int = SKETCH_BLOCK) -> DataFrame:
    """(_k0, _k1, id, class_id, n_links, component_id) for each distinct row with an id.

    ``class_id`` is the smallest id with the same shingles, ``n_links`` the number of other documents at
    or above the threshold (equal ones included), ``component_id`` the smallest id reachable by links.
    """
    t, runs = float(threshold), runs_for(recall, DEPTH)
    with_id = docs.where(F.col(id_col).isNotNull())
    keyed = with_id.select(F.col(text_col).cast("string").alias("_t"), *row_key(F.col(id_col), F.coalesce(F.col(text_col), F.lit(""))), F.col(id_col).cast("long").alias("_id"))
    sets, sets_path = stored(keyed.mapInArrow(_paths(words, t, runs), _SETS), "sets")
    narrow = cut(sets.select("_k0", "_k1", "_id", "_c0", "_c1", "_size").distinct())
    # a class is a set; the row with the smallest id (then key) represents it, and a hash numbers it
    who = F.struct("_id", "_k0", "_k1")
    classes = cut(narrow.where("_size > 0").groupBy("_c0", "_c1").agg(F.min(who).alias("_w"), F.count("*").alias("_copies")).select("_c0", "_c1", "_w.*", "_copies"))
    chosen_row = classes.select("_k0", "_k1", "_c0", "_c1", "_copies", F.xxhash64("_c0", "_c1").alias("_rep"))
    wide = ["_k0", "_k1", "_size", "_sketch", "_p1", "_p2", "_u2", "_p3", "_u3"]
    members = sets.where("_size > 0").select(*wide).join(chosen_row.select("_k0", "_k1", "_rep").hint("shuffle_hash"), ["_k0", "_k1"])
    members = cut(members.dropDuplicates(["_k0", "_k1"]).drop("_k0", "_k1"))
    remove(docs.sparkSession, sets_path)

    def next_step(level: int, alive: DataFrame | None) -> DataFrame:
        """(_rep, _path, _at): documents in the paths of a level, for level 2 and 3 only below large buckets."""
        if level == 1:
            return members.select("_rep", F.posexplode("_p1").alias("_at", "_path"))
        below = members.join(alive.groupBy("_rep").agg(F.collect_list("_at").alias("_live")), "_rep")
        pairs = F.filter(
            F.transform(F.col(f"_p{level}"), lambda x, i: F.struct(x.alias("_path"), i.alias("_at"), F.element_at(f"_u{level}", i + 1).alias("_up"))),
            lambda s: F.array_contains("_live", s["_up"]),
        )
        return below.select("_rep", F.inline(pairs)).select("_rep", "_path", "_at")

    leaves = large = None
    for level in range(1, DEPTH + 1):
        rows = cut(next_step(level, large))
        counts = rows.groupBy("_path").agg(F.count("*").alias("_n")).where("_n > 1")
        sized = rows.join(counts, "_path")
        leaf = sized.where(F.col("_n") <= small) if level < DEPTH else sized
        leaf = leaf.select("_rep", "_path", "_n")
        leaves = leaf if leaves is None else leaves.unionAll(leaf)
        if level < DEPTH:
            large = cut(sized.where(F.col("_n") > small).select("_rep", "_at"))
    full = leaves.join(members.select("_rep", "_size", "_sketch"), "_rep")
    dealt = block_pairs(full, ["_path"], F.ceil(F.col("_n") / sketch_block), F.xxhash64("_rep"))
    edges = cut(dealt.mapInArrow(_candidates(t), "a long, b long").distinct())
    cluster = cut(components(edges).withColumnRenamed("node", "_rep"))
    # exact comparison inside clusters; texts of cluster members move once
    sized = cluster.join(members.select("_rep", "_size"), "_rep")
    weight = sized.groupBy("component").agg(F.count("*").alias("_n"), F.sum("_size").alias("_tokens")).where("_n > 1")
    blocks = F.least(F.greatest(F.ceil(F.col("_n") / exact_docs), F.ceil(F.col("_tokens") / EXACT_TOKENS)), F.col("_n"))
    wanted = cluster.join(weight.select("component", blocks.alias("_b")), "component").join(chosen_row.select("_k0", "_k1", "_copies", "_rep"), "_rep")
    texts = keyed.select("_t", "_k0", "_k1").join(wanted.hint("shuffle_hash"), ["_k0", "_k1"]).dropDuplicates(["_k0", "_k1"])
    exact = texts.select("_t", "_rep", "_copies", "component", "_b").mapInArrow(_sets_of(words), "_rep long, _copies long, component long, _b long, _set binary")
    dealt = block_pairs(exact, ["component"], F.col("_b"), F.xxhash64("_rep", F.lit(3)))
    found = cut(dealt.mapInArrow(_verify(threshold), "a long, b long, n long"))
    links = found.where("b is null").groupBy(F.col("a").alias("_rep")).agg(F.sum("n").alias("_others"))
    reached = components(found.where("b is not null").select("a", "b"))
    summary = chosen_row.join(links, "_rep", "left").join(reached.withColumnRenamed("node", "_rep"), "_rep", "left")
    summary = summary.join(classes.select("_c0", "_c1", F.col("_id").alias("class_id")), ["_c0", "_c1"])
    group = F.coalesce("component", "_rep")
    summary = summary.withColumn("_g", group)
    least = summary.groupBy("_g").agg(F.min("class_id").alias("component_id"), F.min(F.struct("class_id", "_c0", "_c1")).alias("_lead"))
    summary = summary.join(least, "_g").select("_c0", "_c1", "class_id", "component_id", "_copies", F.coalesce("_others", F.lit(0).cast("long")).alias("_others"), "_lead")
    lead = classes.select(F.col("_c0").alias("_l0"), F.col("_c1").alias("_l1"), F.col("_k0").alias("_kept0"), F.col("_k1").alias("_kept1"))
    summary = cut(summary.withColumn("_l0", F.col("_lead._c0")).withColumn("_l1", F.col("_lead._c1")).join(lead, ["_l0", "_l1"]).drop("_lead", "_l0", "_l1"))
    both = narrow.join(summary, ["_c0", "_c1"], "left")
    return both.select(
        "_k0",
        "_k1",
        F.col("_id").alias("id"),
        F.coalesce("class_id", "_id").alias("class_id"),
        F.coalesce(F.col("_others") + F.col("_copies") - 1, F.lit(0).cast("long")).alias("n_links"),
        F.coalesce("component_id", "_id").alias("component_id"),
        F.coalesce((F.col("_k0") == F.col("_kept0")) & (F.col("_k1") == F.col("_kept1")), F.lit(True)).alias("kept"),
    )
