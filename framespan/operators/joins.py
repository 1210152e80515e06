"""Joins that stay balanced when one key holds a large share of the rows."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framespan.session import cut

BROADCAST_ROWS = 200_000
SALTS = 32
#: Rows of one key from which its join is dealt over sub-keys.
HOT_ROWS = 1_000_000


def broadcast_limit(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.framespan.broadcastRows", str(BROADCAST_ROWS)))


def group_count(df: DataFrame, by: Sequence[str]) -> int:
    """Number of groups: decides once whether per-group tables may be broadcast."""
    return df.select(*by).distinct().count()


def same_group(left: DataFrame, right: DataFrame, by: Sequence[str], how: str = "inner") -> DataFrame:
    """Join on group keys under which NULL is a group like any other."""
    by = list(by)
    names = {b: f"_by{i}" for i, b in enumerate(by)}
    other = right.withColumnsRenamed(names)
    if not by:
        return left.join(other, F.lit(True), how)
    match = reduce(and_, [F.col(b).eqNullSafe(F.col(n)) for b, n in names.items()])
    return left.join(other, match, how).drop(*names.values())


def shuffled(df: DataFrame) -> DataFrame:
    """Side of a join that must not be broadcast: its rows were multiplied after the last size that Spark measured, or its files are far smaller than its rows."""
    return df.hint("merge")


def attach(big: DataFrame, small: DataFrame, by: Sequence[str], rows: int | None = None, how: str = "inner", nulls: bool = False) -> DataFrame:
    """Join a table with one (short) row per group to its detail rows.

    ``rows`` is the known size of ``small``; without it the table is counted. Up to the limit it is
    broadcast, so detail rows are not moved at all. Beyond it both sides are shuffled; only keys with more than
    ``HOT_ROWS`` detail rows (counted) spread over ``SALTS`` sub-keys, to each of which their short row is copied, so a hot
    group never lands in one task. With ``nulls`` a NULL key is a group of its own.
    """
    by = list(by)
    rows = small.count() if rows is None else rows
    joined = same_group if nulls else DataFrame.join
    if rows <= broadcast_limit(big):
        return joined(big, F.broadcast(small), by, how)
    limit = int(big.sparkSession.conf.get("spark.framespan.hotRows", str(HOT_ROWS)))
    hot = cut(big.groupBy(*by).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > limit).select(*by, F.lit(True).alias("_hot")))
    if hot.isEmpty():
        return joined(big, shuffled(small), by, how)
    salt = F.when(F.col("_hot"), F.pmod(F.xxhash64(*big.columns), F.lit(SALTS)).cast("int")).otherwise(0)
    salts = F.when(F.col("_hot"), F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))
    salted = same_group(big, F.broadcast(hot), by, "left").withColumn("_salt", salt).drop("_hot")
    copies = same_group(small, F.broadcast(hot), by, "left").withColumn("_salt", F.explode(salts)).drop("_hot")
    return joined(salted, shuffled(copies), [*by, "_salt"], how).drop("_salt")


def spread(df: DataFrame, by: Sequence[str]) -> DataFrame:
    """Distribute rows that several passes will read.

    The passes share this exchange, so the input is computed once; sub-keys keep a hot group from
    filling one partition, and each pass aggregates partially before its own small exchange.
    """
    return df.repartition(*by, F.pmod(F.xxhash64(*df.columns), F.lit(SALTS)))
