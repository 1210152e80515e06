"""Loop detection on frame pairs: candidates, greedy suppression, chunk ranges."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from framespan.operators.joins import attach
from framespan.operators.ranking import carry_last, smallest_n
from framespan.session import cut

#: Pairs of a group up to which one task selects among them: some ten megabytes.
WHOLE_GROUP = 100_000


def loop_candidates(pairs: DataFrame, threshold: float = 0.7, gap: int = 10, by: Sequence[str] = ("scene",)) -> DataFrame:
    """Unordered pairs i<j with similarity above ``threshold`` and more than ``gap`` frames apart."""
    kept = pairs.where((F.col("sim") > threshold) & (F.abs(F.col("i") - F.col("j")) > gap))
    return kept.groupBy(*by, F.least("i", "j").alias("i"), F.greatest("i", "j").alias("j")).agg(F.max("sim").alias("sim"))


def _sequential(ends: list[str], radius: int):
    """Greedy selection over the pairs of one bounded group, best key first.

    Picked ends are kept in bins of ``radius + 1`` frames, so a pair looks at three bins per end.
    """

    def near(bins: dict[int, list[int]], frame: int) -> bool:
        at = frame // (radius + 1)
        return any(abs(frame - f) <= radius for k in (at - 1, at, at + 1) for f in bins.get(k, ()))

    def run(table: pa.Table) -> pa.Table:
        order = pc.sort_indices(table.select(["_order"]).flatten(), sort_keys=[(f"_order.{f.name}", "ascending") for f in table.schema.field("_order").type])
        frames = [table.column(e).to_pylist() for e in ends]
        bins: dict[int, list[int]] = {}
        kept = []
        for row in order.to_pylist():
            mine = [f[row] for f in frames]
            if not any(near(bins, f) for f in mine):
                kept.append(row)
                for f in mine:
                    bins.setdefault(f // (radius + 1), []).append(f)
        return table.take(pa.array(kept, pa.int64())).drop_columns(["_order"])

    return run


def _greedy(pairs: DataFrame, group: Sequence[str], ends: Sequence[str], radius: int, key: Column) -> DataFrame:
    """Greedy best-first selection where a pick removes every pair with an end near its own ends.

    Pairs without an end are left out. Groups of up to ``WHOLE_GROUP`` pairs are finished in one task each, in one pass whatever the order of their pairs; only
    larger ones are thinned in rounds (``_rounds``). Both give the sequential answer.
    """
    group, whole = list(group), WHOLE_GROUP
    # written once: sizes and selection both read them, and they may come from a costly search
    pairs = cut(pairs.dropna(subset=list(ends)))
    sizes = cut(pairs.groupBy(*group).agg(F.count("*").alias("_size")))
    shape = sizes.agg(F.count("*").alias("groups"), F.max("_size").alias("most")).first()
    if not shape["groups"]:
        return pairs
    sized = attach(pairs, sizes, group, shape["groups"], nulls=True)
    small = sized.where(F.col("_size") <= whole).drop("_size").withColumn("_order", key)
    done = small.groupBy(*group).applyInArrow(_sequential(list(ends), radius), pairs.schema)
    if shape["most"] <= whole:
        return done
    return done.unionByName(_rounds(sized.where(F.col("_size") > whole).drop("_size"), group, ends, radius, key))


def _rounds(pairs: DataFrame, group: Sequence[str], ends: Sequence[str], radius: int, key: Column) -> DataFrame:
    """The same selection for groups too large for a task.

    Round: a live pair is picked when no better live pair has an end within ``radius`` of its ends.
    That test needs only the best key around each frame, so each round costs a few aggregations on
    frames and never joins pairs with pairs. Repeating until nothing is live gives exactly the
    sequential answer.
    """
    group = list(group)
    live = cut(pairs.withColumn("_key", key))
    frames = F.explode(F.array_distinct(F.array(*ends)))
    span = F.explode(F.sequence(F.col("_f") - radius, F.col("_f") + radius))
    found = []
    while not live.isEmpty():
        best = live.select(*group, frames.alias("_f"), "_key").groupBy(*group, "_f").agg(F.min("_key").alias("_key"))
        around = best.select(*group, span.alias("_f"), "_key").groupBy(*group, "_f").agg(F.min("_key").alias("_best"))
        rivals = live
        for end in ends:
            near = around.select(*group, F.col("_f").alias(end), F.col("_best").alias(f"_best_{end}"))
            rivals = rivals.join(near, [*group, end])
        picked = cut(rivals.where(F.col("_key") == F.least(*[F.col(f"_best_{e}") for e in (*ends, ends[0])])).select(*live.columns))
        found.append(picked)
        covered = cut(picked.select(*group, frames.alias("_f")).select(*group, span.alias("_f")).distinct())
        # only pairs that may still be picked are carried into the next round
        for end in ends:
            live = live.join(covered.withColumnRenamed("_f", end), [*group, end], "left_anti")
        live = cut(live)
    return reduce(DataFrame.unionByName, found, pairs.withColumn("_key", key).where(F.lit(False))).drop("_key")


def nms_pairs(pairs: DataFrame, radius: int = 25, by: Sequence[str] = ("scene",)) -> DataFrame:
    """Best-first suppression of loop pairs around both ends; returns i = later, j = earlier frame.

    Pairs are ordered by (similarity descending, i, j). ``radius <= 0`` keeps all pairs.
    """
    if radius > 0:
        key = F.struct((-F.col("sim")).alias("s"), F.col("i").alias("a"), F.col("j").alias("b"))
        pairs = _greedy(pairs.select(*by, "i", "j", "sim"), by, ["i", "j"], radius, key)
    return pairs.select(*by, F.greatest("i", "j").alias("i"), F.least("i", "j").alias("j"), "sim")


def reduce_edges(
    edges: DataFrame, max_edges: int, nms: int, by: Sequence[str] = ("scene",), min_gap: int = 30, max_cost: float = 1000.0
) -> DataFrame:
    """Cheapest-first edges; a pick removes edges to the same j with |Δi| <= ``nms``; first ``max_edges``."""
    by = list(by)
    valid = edges.where((F.col("j") - F.col("i") >= min_gap) & (F.col("cost") < max_cost)).select(*by, "i", "j", "cost")
    key = F.struct(F.col("cost").alias("c"), F.col("i").alias("a"), F.col("j").alias("b"))
    kept = _greedy(valid, [*by, "j"], ["i"], nms, key)
    return smallest_n(kept, by, [F.col("cost"), F.col("i"), F.col("j")], max_edges).select(*by, "i", "j", "cost")


def frame_to_chunk(df: DataFrame, bounds: DataFrame, index: str, by: Sequence[str] = ("scene",), prefix: str = "chunk") -> DataFrame:
    """Attach the last chunk that starts at or before ``index``; NULL where the chunk ends earlier.

    Chunk starts and frame indices are merged in order and the latest chunk is carried forward, so
    the lookup is linear and needs neither a range join nor a broadcast.
    """
    by = list(by)
    wanted = df.select(*by, F.col(index).cast("long").alias("_at")).distinct().withColumn("_chunk", F.lit(None))
    bound = F.struct(F.col("chunk").cast("long").alias("chunk"), F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end"))
    starts = bounds.select(*by, F.col("start").cast("long").alias("_at"), bound.alias("_chunk"))
    merged = starts.unionByName(wanted.withColumn("_chunk", F.lit(None).cast(starts.schema["_chunk"].dataType)))
    order = [F.col("_at"), F.col("_chunk").isNull().cast("int"), F.coalesce(F.col("_chunk.chunk"), F.lit(-1))]
    carried = carry_last(merged, by, order, "_chunk", "_hit").where(F.col("_chunk").isNull())
    inside = F.col("_hit.end") > F.col("_at")
    lookup = carried.select(
        *by,
        F.col("_at"),
        F.when(inside, F.col("_hit.chunk")).alias(prefix),
        F.when(inside, F.col("_hit.start")).alias(f"{prefix}_start"),
        F.when(inside, F.col("_hit.end")).alias(f"{prefix}_end"),
    )
    keyed = df.withColumn("_at", F.col(index).cast("long"))
    return keyed.join(lookup, [*by, "_at"], "left").drop("_at")


def _range(index: Column, begin: Column, end: Column, half: int) -> tuple[Column, Column]:
    """2*half frames around ``index``, shifted to stay inside [begin, end]."""
    low, high = index - half < begin, index + half > end
    start = F.when(low, begin).when(high, F.greatest(begin, end - 2 * half)).otherwise(index - half)
    stop = F.when(low, F.least(end, begin + 2 * half)).when(high, end).otherwise(index + half)
    return start, stop


def loop_ranges(pairs: DataFrame, bounds: DataFrame, half: int = 10, by: Sequence[str] = ("scene",)) -> tuple[DataFrame, DataFrame]:
    """(ranges, rejects): chunk and frame range around both ends of each loop pair."""
    # written once: every lookup reads its rows several times, and the pairs may come from a costly search
    a = cut(frame_to_chunk(cut(pairs), bounds, "i", by, "chunk_a"))
    both = frame_to_chunk(a, bounds, "j", by, "chunk_b")
    found = F.col("chunk_a").isNotNull() & F.col("chunk_b").isNotNull()
    out = both.where(found)
    a0, a1 = _range(F.col("i"), F.col("chunk_a_start"), F.col("chunk_a_end"), half)
    b0, b1 = _range(F.col("j"), F.col("chunk_b_start"), F.col("chunk_b_end"), half)
    ranges = out.select(
        *by, "i", "j", "sim", "chunk_a", a0.alias("start_a"), a1.alias("end_a"), "chunk_b", b0.alias("start_b"), b1.alias("end_b")
    )
    return ranges, both.where(~found).select(*by, "i", "j", "sim")


def dedup_chunk_pairs(ranges: DataFrame, by: Sequence[str] = ("scene",)) -> DataFrame:
    """Best pair per chunk pair; pairs inside one chunk are dropped."""
    by = list(by)
    rest = [c for c in ranges.columns if c not in (*by, "chunk_a", "chunk_b")]
    best = F.struct(F.col("sim"), (-F.col("i")).alias("a"), (-F.col("j")).alias("b"))
    kept = ranges.where(F.col("chunk_a") != F.col("chunk_b")).groupBy(*by, "chunk_a", "chunk_b").agg(
        F.max_by(F.struct(*rest), best).alias("_row")
    )
    return kept.select(*by, "chunk_a", "chunk_b", "_row.*")
