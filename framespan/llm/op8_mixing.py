"""Mixing sources to target weights by Pfair scheduling.

The corpus of a source is cut into blocks of ``block_chars`` characters. Sources have whole-number
weights a_s. In the ideal mixture every slot is divided among the sources that still have blocks, in
proportion to their weights; so with n_s blocks source s has had min(a_s·v, n_s) of them at virtual time
v, and the slots passed are T(v), the sum of that over all sources. Block i is released at
floor(T(i/a_s)) and due at ceil(T((i+1)/a_s)). In each slot the released block with the earliest deadline
is taken (ties: by source, then block). The ideal mixture fills every window, so all deadlines are met, no slot
stays empty and after any number of slots each source is less than one block away from its ideal share,
also when others have run out.

All of it is done on tables, for any number of sources. T is a running sum over block edges and ends of
sources ordered by virtual time, in whole numbers. Earliest deadline first is a fixed priority, so it is cut
in halves by deadline: the urgent half takes the first free slot after each release whatever the other half
holds (a running minimum tells which slots it fills), the rest shares what it leaves free. Both halves
are smaller schedules of the same kind, cut again until they have ``leaf`` blocks, which one task orders
with a heap. Positions of documents come from running sums over range partitions, which split a source as
often as its rows need. Only totals (blocks, weights) reach the driver.

Defined results: a null source is a source of its own; a null or empty text takes one character; a source
without a target weight gets ``default_weight``; weights that sum to more than ``SCALE`` are scaled down to it, with
1 at least; rows repeated in full share one place; an empty table gives an empty result; a text longer than a
block uses up the slots of all blocks it fills; other columns pass through, but for those named like a result column.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator, Mapping

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from framespan.llm.common import cut, row_key

BLOCK_CHARS = 64_000
#: Whole-number weights sum to about this at most, so a share is met to a billionth and all sums fit 64 bits.
SCALE = 1_000_000_000
#: Blocks that one task orders with a heap.
LEAF = 1 << 17
#: Block edges that one task writes.
_EDGES = 1 << 22
_RUN = 1 << 16


def whole_weights(sizes: DataFrame, weights: Mapping[str, int] | None = None, default_weight: int = 1, alpha: float = 0.5) -> DataFrame:
    """``sizes`` (_s, chars) with the whole weight ``_a``: the given one, or proportional to chars^alpha (tempered sampling)."""
    if weights:
        if min([default_weight, *weights.values()]) < 1:
            raise ValueError("weights are whole numbers from 1")
        named = sizes.sparkSession.createDataFrame([(f"={k}", int(v)) for k, v in weights.items()], "_s string, _given long")
        goal = sizes.join(named, "_s", "left").withColumn("_x", F.coalesce("_given", F.lit(default_weight)).cast("decimal(28,6)")).drop("_given")
    else:
        goal = sizes.withColumn("_x", F.pow(F.greatest("chars", F.lit(1)).cast("double"), F.lit(float(alpha))).cast("decimal(28,6)"))
    goal = cut(goal)
    total = float(goal.agg(F.sum("_x")).first()[0] or 1)
    if weights and total <= SCALE:
        return goal.select("_s", "chars", F.col("_x").cast("long").alias("_a"))
    share = F.round(F.col("_x").cast("double") * F.lit(SCALE / total)).cast("long")
    return goal.select("_s", "chars", F.greatest(F.lit(1).cast("long"), share).alias("_a"))


def _sliced(df: DataFrame, order: list[str]) -> DataFrame:
    """The rows written in range partitions of ``order``, whose number is ``_part``."""
    return cut(df.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()))


def _running(df: DataFrame, order: list[str], **sums: Column) -> DataFrame:
    """Inclusive running sums over the whole table, by slices and a table of one row per slice."""
    sliced = _sliced(df, order)
    upto = Window.partitionBy("_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    earlier = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    totals = sliced.groupBy("_part").agg(*[F.sum(v).alias(n) for n, v in sums.items()])
    before = totals.select("_part", *[F.coalesce(F.sum(n).over(earlier), F.lit(0)).alias(f"_before_{n}") for n in sums])
    local = sliced.select("*", *[F.sum(v).over(upto).alias(n) for n, v in sums.items()])
    joined = local.join(before, "_part")
    return joined.select(*df.columns, *[(F.col(n) + F.col(f"_before_{n}")).alias(n) for n in sums])


def windows(blocks: DataFrame) -> DataFrame:
    """(_s, block, _r, _d): release and deadline slots of every block of ``blocks`` (_s, _n, _a)."""
    count, weight = blocks.agg(F.sum("_n"), F.sum("_a")).first()
    runs = blocks.withColumn("_run", F.explode(F.expr(f"sequence(0L, _n div {_RUN})"))).repartition(1 + count // _EDGES, "_s", "_run")
    edges = runs.withColumn("_i", F.explode(F.expr(f"sequence(_run * {_RUN}, least(_n, _run * {_RUN} + {_RUN - 1}))")))
    none = F.lit(0).cast("long")
    edges = edges.select("_s", "_n", "_a", "_i", F.lit(1).alias("_kind"), none.alias("_da"), none.alias("_dn"))
    ends = blocks.select("_s", "_n", "_a", F.col("_n").alias("_i"), F.lit(0).alias("_kind"), F.col("_a").alias("_da"), F.col("_n").alias("_dn"))
    # virtual time i/a as its whole part and 18 digits: different times differ for weights up to 10^9
    timed = edges.unionByName(ends).selectExpr("*", "_i div _a AS _q", "_i % _a AS _m").selectExpr("*", "(_m * 1000000000L) div _a AS _f1", "((_m * 1000000000L) % _a * 1000000000L) div _a AS _f2")
    passed = _running(timed, ["_q", "_f1", "_f2", "_kind", "_s", "_i"], _gone=F.col("_da"), _done=F.col("_dn")).where("_kind = 1")
    at = passed.withColumn("_live", F.lit(weight) - F.col("_gone")).withColumn("_whole", F.expr("_live * _q + _done"))
    at = at.selectExpr("_s", "_n", "_i", "_whole + (_live * _m) div _a AS _floor", "_whole + (_live * _m + _a - 1) div _a AS _ceil")
    starts = at.where("_i < _n").selectExpr("_s", "_i AS block", "_floor AS _r", "CAST(NULL AS BIGINT) AS _d")
    dues = at.where("_i > 0").selectExpr("_s", "_i - 1 AS block", "CAST(NULL AS BIGINT) AS _r", "_ceil AS _d")
    return starts.unionAll(dues).groupBy("_s", "block").agg(F.max("_r").alias("_r"), F.max("_d").alias("_d"))


def _halves(items: DataFrame, half: int) -> DataFrame:
    """Cut each node in two by priority: jobs and slots move to the child that owns them, with their place in its own time."""
    columns = ["_node", "_pos", "_kind", "_prio", "_slot"]
    urgent = (F.col("_kind") == 0) & (F.floor(F.col("_prio") / half) % 2 == 0)
    order = ["_pos", "_kind", "_prio"]
    sliced = _sliced(items, ["_node", *order])
    rows = Window.partitionBy("_node", "_part").orderBy(*order)
    upto, before = rows.rowsBetween(Window.unboundedPreceding, 0), rows.rowsBetween(Window.unboundedPreceding, -1)
    local = sliced.withColumn("_came", F.sum(urgent.cast("long")).over(upto))
    # urgent blocks that have come, less the slots passed; its least value so far counts the slots they left free
    local = local.withColumn("_spare", F.when(F.col("_kind") == 1, F.col("_came") - F.col("_pos") - 1))
    parts = local.groupBy("_node", "_part").agg(F.max("_came").alias("_sum"), F.min("_spare").alias("_min"))
    earlier = Window.partitionBy("_node").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.withColumn("_came0", F.coalesce(F.sum("_sum").over(earlier), F.lit(0)))
    parts = parts.withColumn("_spare0", F.least(F.lit(0), F.min(F.col("_min") + F.col("_came0")).over(earlier))).drop("_sum", "_min")
    seen = local.withColumn("_least", F.min("_spare").over(before)).join(parts, ["_node", "_part"])
    filled = F.col("_pos") + F.least("_spare0", F.col("_least") + F.col("_came0"))
    seen = seen.withColumn("_filled", filled).withColumn("_first", F.when(F.col("_kind") == 0, urgent).otherwise(F.col("_came") + F.col("_came0") > F.col("_filled")))
    moved = seen.withColumn("_node", F.col("_node") * 2 + F.when(F.col("_first"), 0).otherwise(1))
    return moved.withColumn("_pos", F.when(F.col("_first"), F.col("_filled")).otherwise(F.col("_pos") - F.col("_filled"))).select(*columns)


def earliest_first(release: np.ndarray, priority: np.ndarray) -> np.ndarray:
    """The slot of each unit job, when the released one of least priority number goes first and no slot stays empty."""
    order = np.lexsort((priority, release)).tolist()
    came, urgency = release.tolist(), priority.tolist()
    out = np.empty(len(order), np.int64)
    ready: list[tuple[int, int]] = []
    at = 0
    for slot in range(len(order)):
        while at < len(order) and came[order[at]] <= slot:
            heapq.heappush(ready, (urgency[order[at]], order[at]))
            at += 1
        out[heapq.heappop(ready)[1]] = slot
    return out


def _leaf(items: pd.DataFrame) -> pd.DataFrame:
    jobs = items[items["_kind"] == 0]
    slots = items[items["_kind"] == 1].sort_values("_pos")["_slot"].to_numpy()
    at = earliest_first(jobs["_pos"].to_numpy(), jobs["_prio"].to_numpy())
    return pd.DataFrame({"_prio": jobs["_prio"].to_numpy().astype("int64"), "slot": slots[at].astype("int64")})


def slots(blocks: DataFrame, leaf: int = LEAF) -> DataFrame:
    """(_s, block, slot) for every block of ``blocks`` (_s, _n, _a): earliest deadline first over all sources."""
    due = _running(windows(blocks), ["_d", "_s", "block"], _rank=F.lit(1))
    jobs = cut(due.select("_s", "block", "_r", "_d", (F.col("_rank") - 1).cast("long").alias("_prio")))
    total = jobs.count()
    none = F.lit(None).cast("long")
    time = blocks.sparkSession.range(total).select(F.lit(0).cast("long").alias("_node"), F.col("id").alias("_pos"), F.lit(1).alias("_kind"), none.alias("_prio"), F.col("id").alias("_slot"))
    items = jobs.select(F.lit(0).cast("long").alias("_node"), F.col("_r").alias("_pos"), F.lit(0).alias("_kind"), "_prio", none.alias("_slot")).unionByName(time)
    size = leaf
    while size < total:
        size *= 2
    while size > leaf:
        size //= 2
        items = _halves(items, size)
    placed = items.groupBy("_node").applyInPandas(_leaf, "_prio long, slot long")
    return jobs.join(placed, "_prio").select("_s", "block", "slot")


_STARTS = "_s string, _k0 long, _k1 long, _n long, _len long, _part int, _local long"


def _local_starts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Stream sorted rows (_s, _k0, _k1, _n, _len, _part): characters of the source before the row in its partition."""
    source_now, at = None, 0
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        source = batch.column(0).to_numpy(zero_copy_only=False)
        length = batch.column(4).to_numpy(zero_copy_only=False)
        start = np.empty(n, np.int64)
        edges = [0, *(np.flatnonzero(source[1:] != source[:-1]) + 1).tolist(), n]
        for a, b in zip(edges, edges[1:]):
            if source[a] != source_now:
                source_now, at = source[a], 0
            runs = np.cumsum(length[a:b])
            start[a:b] = at + runs - length[a:b]
            at += int(runs[-1])
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(start)], names=[*batch.schema.names, "_local"])


def source_and_key(source_col: str, id_col: str, text_col: str) -> list:
    """The source as text (a null source is told from the word) as _s, and the row key."""
    source = F.coalesce(F.concat(F.lit("="), F.col(source_col).cast("string")), F.lit("null"))
    return [source.alias("_s"), *row_key(F.col(id_col), source, F.coalesce(F.col(text_col).cast("string"), F.lit("")))]


def schedule(docs: DataFrame, weights: Mapping[str, int] | None = None, source_col: str = "source", id_col: str = "doc_id", text_col: str = "text", block_chars: int = BLOCK_CHARS, default_weight: int = 1, alpha: float = 0.5, seed: int = 8, leaf: int = LEAF) -> DataFrame:
    """(_k0, _k1, block, slot, offset) for each distinct row: its place in the mixture.

    ``block`` counts within the source, ``slot`` over the whole mixture, ``offset`` is where the document
    starts in its block. A document belongs to the block in which it starts, so long documents use up the
    slots of the blocks that they fill. Without ``weights`` the targets are the sources' sizes to ``alpha``.
    """
    spark = docs.sparkSession
    length = F.greatest(F.lit(1), F.coalesce(F.length(F.col(text_col).cast("string")), F.lit(1))).cast("long")
    units = docs.select(length.alias("_c"), *source_and_key(source_col, id_col, text_col)).groupBy("_s", "_k0", "_k1").agg(F.count("*").alias("_n"), F.sum("_c").alias("_len"))
    units = cut(units.withColumn("_r", F.xxhash64(F.lit(seed), "_k0")))
    order = ["_s", "_r", "_k0", "_k1"]
    dealt = units.repartitionByRange(*order).sortWithinPartitions(*order).select("_s", "_k0", "_k1", "_n", "_len", F.spark_partition_id().alias("_part"))
    local = cut(dealt.mapInArrow(_local_starts, _STARTS))
    parts = local.groupBy("_s", "_part").agg(F.sum("_len").alias("_sum"))
    sizes = whole_weights(parts.groupBy("_s").agg(F.sum("_sum").alias("chars")), weights, default_weight, alpha)
    blocks = cut(sizes.selectExpr("_s", f"(chars + {block_chars - 1}) div {block_chars} AS _n", "_a"))
    if blocks.isEmpty():
        return spark.createDataFrame([], "_k0 long, _k1 long, block long, slot long, offset long")
    earlier = Window.partitionBy("_s").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = parts.select("_s", "_part", F.coalesce(F.sum("_sum").over(earlier), F.lit(0)).alias("_before"))
    start = F.col("_local") + F.col("_before")
    placed = local.join(offsets, ["_s", "_part"]).withColumn("block", F.floor(start / block_chars)).withColumn("offset", start - F.col("block") * block_chars)
    # a block holds the starts of ``block_chars`` documents at most, so no key is hot
    placed = placed.join(slots(blocks, leaf), ["_s", "block"])
    return placed.select("_k0", "_k1", "block", "slot", "offset")


def mix(docs: DataFrame, *args, source_col: str = "source", id_col: str = "doc_id", text_col: str = "text", **more) -> DataFrame:
    """All rows and columns of ``docs`` with ``block``, ``slot`` and ``offset``; sorted by (slot, offset) they are the mixture."""
    places = cut(schedule(docs, *args, source_col=source_col, id_col=id_col, text_col=text_col, **more))
    kept = [c for c in docs.columns if c not in ("block", "slot", "offset")]
    rows = docs.select(F.struct("*").alias("_row"), *source_and_key(source_col, id_col, text_col))
    joined = rows.join(places.hint("shuffle_hash"), ["_k0", "_k1"])
    return joined.select(*[F.col("_row").getField(c).alias(c) for c in kept], "block", "slot", "offset")
