"""Helpers the operators share: row keys, words, scratch tables, sorted streams and blocked pair work."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from framespan.session import cut, ensure_checkpoint_dir

__all__ = ["cut", "scratch", "stored", "remove", "row_key", "packed", "unpacked", "words_of", "mix64", "sorted_groups", "components", "block_pairs"]

#: Bytes that separate words become spaces, A-Z become a-z; every byte of a non-ASCII character stays.
_WORD_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def words_of(text: str | None) -> list[bytes]:
    """The words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` of the text with A-Z lower-cased, as UTF-8."""
    return text.encode("utf-8", "surrogatepass").translate(_WORD_BYTES).split() if text else []


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of unsigned 64-bit integers (two multiply-shift rounds)."""
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the folder that driver and executors share."""
    return f"{ensure_checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"


def remove(spark: SparkSession, path: str) -> None:
    """Delete a scratch path that nothing reads any more."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def stored(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """``df`` written as a scratch table and read back, and the path, for a caller that removes it."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def row_key(*columns: Column) -> list[Column]:
    """128 bits that identify a row by the given values: rows repeated in full share the key."""
    return [F.xxhash64(F.lit(seed), *columns).alias(name) for seed, name in ((1, "_k0"), (2, "_k1"))]


def packed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(_t, _rest, _k0, _k1): the text, all other columns as one struct, and the row key.

    Whatever the other columns are called, they cannot clash with names that an operator uses inside.
    """
    rest = [F.col(f"`{c}`") for c in docs.columns if c != text_col] or [F.lit(None).alias("_none")]
    text = F.col(f"`{text_col}`").cast("string")
    return docs.select(text.alias("_t"), F.struct(*rest).alias("_rest"), *row_key(F.col(f"`{id_col}`"), F.coalesce(text, F.lit(""))))


def unpacked(df: DataFrame, columns: list[str], text_col: str, **results: Column) -> DataFrame:
    """Undo ``packed``: the columns in their order, then ``results``, which replace columns of the same name."""
    kept = [c for c in columns if c not in results]
    back = [F.col("_t").alias(c) if c == text_col else F.col("_rest").getField(c).alias(c) for c in kept]
    return df.select(*back, *[value.alias(name) for name, value in results.items()])


def sorted_groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Yield one table per run of equal (non-null, integer) ``keys`` of a partition sorted by them.

    Holds one batch and one group at a time; callers make sure that a group is bounded.
    """
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        cols = [batch.column(batch.schema.get_field_index(k)).to_numpy(zero_copy_only=False) for k in keys]
        change = np.zeros(n, bool)
        for c in cols:
            change[1:] |= c[1:] != c[:-1]
        starts = [0, *np.flatnonzero(change).tolist(), n]
        for a, b in zip(starts, starts[1:]):
            key = tuple(int(c[a]) for c in cols)
            if last is not None and key != last:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(a, b - a))
            last = key
    if held:
        yield pa.Table.from_batches(held)


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of ``edges`` (a, b): component is the smallest node reachable.

    Alternates the large-star and small-star steps, so the number of rounds is logarithmic in the
    longest chain. Each round is written to the checkpoint folder and the round before it is deleted.
    """
    spark = edges.sparkSession

    def smallest(df: DataFrame) -> DataFrame:
        """Attach to each row (u, v) the smallest of u and all its v."""
        least = df.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        return df.join(least, "u")

    work, path = stored(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    before = None
    while True:
        both = work.select(F.col("a").alias("u"), F.col("b").alias("v")).unionAll(work.select(F.col("b").alias("u"), F.col("a").alias("v")))
        large = smallest(both).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        small = smallest(large)
        small = small.select(F.explode(F.array("u", "v")).alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        after, new = stored(small, "edges")
        mark = after.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        remove(spark, path)
        work, path = after, new
        if mark == before:
            break
        before = mark
    roots = work.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return work.select(F.col("a").alias("node"), F.col("b").alias("component")).unionAll(roots)


def block_pairs(rows: DataFrame, group: list[str], blocks: Column, by: Column) -> DataFrame:
    """Deal each group to tasks that each see two blocks of it.

    A group with ``blocks`` blocks gets one task for every unordered pair of blocks, so each pair of
    its rows meets exactly once (rows of one block meet where both numbers are equal). A row is copied
    ``blocks`` times, never once per partner. Adds ``_i``, ``_j`` (the pair) and ``_blk`` (the row's block).
    """
    placed = rows.withColumn("_n", blocks.cast("int")).withColumn("_blk", F.pmod(by, F.col("_n")).cast("int"))
    dealt = placed.withColumn("_o", F.explode(F.sequence(F.lit(0), F.col("_n") - 1)))
    dealt = dealt.withColumn("_i", F.least("_blk", "_o")).withColumn("_j", F.greatest("_blk", "_o")).drop("_o", "_n")
    keys = [*group, "_i", "_j"]
    return dealt.repartition(*keys).sortWithinPartitions(*keys)
