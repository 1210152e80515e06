"""Near duplicates among embeddings by randomised-rotation binary codes.

A unit vector is rotated by ``ROTATIONS`` fixed random orthogonal matrices, stacked and scaled to one unit
vector again; its code is the sign of each coordinate, and its correction factor f the inner product of
vector and code. For a rotated query q the estimate (code · q) / f is an unbiased estimate of the inner
product, with an error bound proportional to sqrt((1 - f²) / f² / (D - 1)).

Vectors meet in buckets: ``tables`` independent groups of sign bits of further rotations. Bits per table follow
from the size of the largest label and the number of tables from the target recall of a pair at the threshold. Buckets carry
only codes; pairs whose codes differ in too many bits for the threshold are dropped there, and each block
of a bucket yields a spanning forest of the rest. Connected vectors form clusters, and inside a cluster
blocks of bounded size are compared: estimates and bounds decide which pairs are computed exactly, in double precision.
Equal vectors of one label are one class all along. No stage emits a row per pair.

Defined results: vectors that are null, empty, zero or hold null or non-finite components, rows with a null
label and rows with a null id link with nothing; vectors of different lengths never link; rows repeated in
full count once; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framespan.llm.common import block_pairs, components, cut, row_key, sorted_groups
from framespan.llm.op4_ngram_join import _forest

THRESHOLD = 0.93
RECALL = 0.9999
ROTATIONS = 4
#: Standard errors that a pair may be off before it is left out.
SLACK = 5.0
#: Expected vectors of a bucket, rows of a block in a bucket and in a cluster.
PER_BUCKET, BUCKET_BLOCK, CLUSTER_BLOCK = 16, 1000, 500
MIN_BITS, MAX_BITS = 6, 24


@lru_cache(maxsize=4)
def rotations(dim: int, count: int, seed: int) -> np.ndarray:
    """``count`` random orthogonal matrices stacked to (count·dim, dim)."""
    rng = np.random.default_rng([seed, dim])
    return np.concatenate([np.linalg.qr(rng.standard_normal((dim, dim)))[0] for _ in range(count)]).astype(np.float32)


def tables_for(threshold: float, bits: int, recall: float) -> int:
    """Tables until a pair at the threshold agrees on all bits of one of them with probability ``recall``."""
    p = (1 - math.acos(threshold) / math.pi) ** bits
    return math.ceil(math.log(1 - recall) / math.log(1 - p))


def _codes(bits: int, tables: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 2000):
                part = batch.slice(lo, 2000)
                dims = np.array([len(v) for v in part.column(1)])
                for dim in np.unique(dims):
                    at = np.flatnonzero(dims == dim)
                    picked = part.take(pa.array(at))
                    x = picked.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, dim).astype(np.float64)
                    x /= np.abs(x).max(1, keepdims=True)
                    x = (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)
                    code = np.packbits(x @ rotations(int(dim), ROTATIONS, 1).T > 0, axis=1)
                    more = -(-bits * tables // int(dim))
                    signs = x @ rotations(int(dim), more, 2).T > 0
                    weights = np.int64(1) << np.arange(bits, dtype=np.int64)
                    keys = signs[:, : bits * tables].reshape(len(x), tables, bits) @ weights
                    yield pa.RecordBatch.from_arrays(
                        [picked.column(0), pa.array([c.tobytes() for c in code], pa.binary()), pa.array(list(keys), pa.list_(pa.int64()))], names=["_rep", "_code", "_keys"]
                    )

    return run


def _signs(column: pa.ChunkedArray) -> np.ndarray:
    packed = np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(len(column), -1)
    return np.unpackbits(packed, axis=1).astype(np.float32) * 2 - 1


def _candidates(threshold: float):
    share = math.acos(threshold) / math.pi

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        edges: set[tuple[int, int]] = set()
        for group in sorted_groups(batches, ["_g", "_table", "_key", "_i", "_j"]):
            if group.num_rows > 1:
                signs = _signs(group.column("_code"))
                d = signs.shape[1]
                most = share + SLACK * math.sqrt(share * (1 - share) / d)
                links = (signs @ signs.T) / d >= 1 - 2 * most
                np.fill_diagonal(links, False)
                if links.any():
                    edges.update(_forest(links, group.column("_rep").to_numpy()))
            if len(edges) > 50_000:
                yield pa.RecordBatch.from_pylist([{"a": a, "b": b} for a, b in edges])
                edges = set()
        if edges:
            yield pa.RecordBatch.from_pylist([{"a": a, "b": b} for a, b in edges])

    return run


def exact_links(x: np.ndarray, threshold: float) -> tuple[np.ndarray, int]:
    """Links of unit vectors (double): estimates and their bounds first, exact products where they decide nothing."""
    stack = rotations(x.shape[1], ROTATIONS, 1)
    turned = (x.astype(np.float32) @ stack.T) / np.float32(math.sqrt(ROTATIONS))
    d = turned.shape[1]
    code = np.where(turned > 0, np.float32(1), np.float32(-1)) / np.float32(math.sqrt(d))
    f = (turned * code).sum(1)
    estimate = (code @ turned.T) / f[:, None]
    bound = SLACK * np.sqrt((1 - f * f) / (f * f) / max(1, d - 1))
    links = np.zeros((len(x), len(x)), bool)
    open_pairs = np.triu((estimate + bound[:, None] >= threshold) & (estimate.T + bound[None, :] >= threshold), 1)
    a, b = np.nonzero(open_pairs)
    for lo in range(0, len(a), 100_000):
        i, j = a[lo : lo + 100_000], b[lo : lo + 100_000]
        near = np.einsum("ij,ij->i", x[i], x[j]) >= threshold
        links[i[near], j[near]] = links[j[near], i[near]] = True
    return links, len(a)


def _verify(threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in sorted_groups(batches, ["component", "_i", "_j"]):
            if group.num_rows < 2:
                continue
            ids, copies, block = (group.column(c).to_numpy() for c in ("_rep", "_copies", "_blk"))
            x = np.array(group.column("_x").to_pylist(), np.float64)
            x /= np.abs(x).max(1, keepdims=True)
            x /= np.linalg.norm(x, axis=1, keepdims=True)
            links, _ = exact_links(x, threshold)
            if group.column("_i")[0].as_py() != group.column("_j")[0].as_py():
                links &= np.not_equal.outer(block, block)
            n = links @ copies
            rows = [(int(ids[k]), None, int(n[k])) for k in np.flatnonzero(n)] + [(a, b, 0) for a, b in _forest(links, ids)]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows)], names=["a", "b", "n"])

    return run


def near_duplicates(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", threshold: float = THRESHOLD, recall: float = RECALL, cluster_block: int = CLUSTER_BLOCK) -> DataFrame:
    """(id, n_links, component_id, kept) for each distinct row of ``vectors``."""
    raw = vectors.select(F.col(id_col).cast("long").alias("_id"), F.col(vector_col).cast("array<double>").alias("_x"), F.col(label_col).alias("_l"))
    finite = F.forall("_x", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    usable = F.coalesce((F.size("_x") > 0) & finite & F.exists("_x", lambda v: v != 0), F.lit(False)) & F.col("_id").isNotNull() & F.col("_l").isNotNull()
    group = F.xxhash64(F.col("_l"), F.size("_x"))
    rows = cut(raw.select("_id", "_x", usable.alias("_ok"), F.when(usable, group).alias("_g"), *row_key(F.when(usable, F.col("_l")), F.col("_x"))))
    narrow = cut(rows.select("_id", "_ok", "_g", "_k0", "_k1").distinct())
    classes = narrow.where("_ok").groupBy("_g", "_k0", "_k1").agg(F.count("*").alias("_copies"), F.min("_id").alias("_least"))
    classes = cut(classes.withColumn("_rep", F.xxhash64("_g", "_k0", "_k1")))
    one = rows.where("_ok").groupBy("_k0", "_k1").agg(F.first("_x").alias("_x"))
    members = cut(one.join(classes, ["_k0", "_k1"]).select("_rep", "_g", "_x", "_copies"))
    largest = members.groupBy("_g").count().agg(F.coalesce(F.max("count"), F.lit(0))).first()[0]
    bits = min(MAX_BITS, max(MIN_BITS, math.ceil(math.log2(max(1, largest) / PER_BUCKET))))
    tables = tables_for(threshold, bits, recall)
    codes = cut(members.select("_rep", "_x").mapInArrow(_codes(bits, tables), "_rep long, _code binary, _keys array<long>").join(members.select("_rep", "_g"), "_rep"))
    placed = codes.select("_rep", "_g", "_code", F.posexplode("_keys").alias("_table", "_key"))
    bucket = ["_g", "_table", "_key"]
    counts = placed.groupBy(*bucket).agg(F.count("*").alias("_n")).where("_n > 1")
    dealt = block_pairs(placed.join(counts, bucket).withColumn("_b", F.ceil(F.col("_n") / BUCKET_BLOCK)), bucket, F.col("_b"), F.xxhash64("_rep"))
    edges = cut(dealt.mapInArrow(_candidates(threshold), "a long, b long").distinct())
    cluster = components(edges).withColumnRenamed("node", "_rep")
    shared = cut(members.join(cluster, "_rep"))
    size = shared.groupBy("component").agg(F.count("*").alias("_n")).where("_n > 1")
    dealt = block_pairs(shared.join(size, "component"), ["component"], F.ceil(F.col("_n") / cluster_block), F.xxhash64("_rep", F.lit(3)))
    found = cut(dealt.mapInArrow(_verify(threshold), "a long, b long, n long"))
    links = found.where("b is null").groupBy(F.col("a").alias("_rep")).agg(F.sum("n").alias("_others"))
    reached = components(found.where("b is not null").select("a", "b")).withColumnRenamed("node", "_rep")
    summary = classes.join(links, "_rep", "left").join(reached, "_rep", "left").withColumn("_c", F.coalesce("component", "_rep"))
    least = summary.groupBy("_c").agg(F.min("_least").alias("_component"))
    summary = summary.join(least, "_c").select("_k0", "_k1", "_component", (F.coalesce("_others", F.lit(0)) + F.col("_copies") - 1).alias("_n"))
    joined = narrow.join(summary, ["_k0", "_k1"], "left")
    component = F.when(F.col("_ok"), F.col("_component")).otherwise(F.col("_id"))
    return joined.select(
        F.col("_id").alias(id_col),
        F.when(F.col("_ok"), F.col("_n")).otherwise(0).cast("long").alias("n_links"),
        component.alias("component_id"),
        F.coalesce(F.col("_id") == component, F.lit(True)).alias("kept"),
    )
