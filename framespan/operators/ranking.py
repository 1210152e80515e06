"""Ordered work inside groups of any size.

A plain ``row_number() OVER (PARTITION BY scene ...)`` puts a whole scene into one task. Here a
large input is first cut into ranges ("slices") of the ordering key, each small enough for one task.
Slice-local windows plus a short per-group table of slice offsets give the same answer without
gathering a group. Slices are the range partitions of a written table, so a recomputed task cuts
exactly like the lost one, any sort direction works and their number has no bound. Groups are matched
null-safe, so a NULL key is one group at every size. Inputs below the size limit, and those whose largest group is below it, use the plain
window: it moves the rows once, and slices only serve groups too large for a task.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from framespan.operators.joins import same_group
from framespan.session import cut

ROWS_PER_SLICE = 2_000_000
#: Range partitions of a table with smaller slices than ``ROWS_PER_SLICE``; beyond that a partition holds several slices.
SMALL_SLICE_PARTS = 200


def rows_per_slice(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.framespan.rowsPerSlice", str(ROWS_PER_SLICE)))


def window_rows(df: DataFrame, by: Sequence[str], rows: int | None = None) -> int:
    """Rows that decide between plain windows and slices: those of the largest group of ``by`` where no group exceeds a slice, else all.

    ``rows`` is a known row count, or a result of this function for the same rows and groups.
    """
    rows = df.count() if rows is None else rows
    if rows <= rows_per_slice(df):
        return rows
    largest = df.groupBy(*by).agg(F.count(F.lit(1)).alias("_n")).agg(F.max("_n")).first()[0]
    return rows if largest > rows_per_slice(df) else largest


def sliced_by(df: DataFrame, by: Sequence[str], order: Sequence[Column], rows: int | None = None) -> DataFrame | None:
    """The rows with their ``_slice`` number in ``order``, or ``None`` when every group of ``by`` fits one slice.

    ``rows`` is as in :func:`window_rows`.
    """
    limit = rows_per_slice(df)
    rows = window_rows(df, by, rows)
    if rows <= limit:
        return None
    slices = max(2, 2 * rows // limit)
    parts = max(2, 2 * rows // max(limit, ROWS_PER_SLICE), min(slices, SMALL_SLICE_PARTS))
    ranged = df.repartitionByRange(parts, *order)
    if parts == slices:
        return cut(ranged.withColumn("_slice", F.spark_partition_id()))
    # a slice is a run of ``limit`` sorted rows of a partition, named by its first row
    placed = ranged.sortWithinPartitions(*order).withColumn("_slice", F.monotonically_increasing_id())
    return cut(placed.withColumn("_slice", F.col("_slice") - F.col("_slice").bitwiseAND(F.lit((1 << 33) - 1)) % limit))


def _per_slice_offsets(sliced: DataFrame, by: Sequence[str], value: Column) -> DataFrame:
    sums = sliced.groupBy(*by, "_slice").agg(F.sum(value).alias("_sum"))
    earlier = Window.partitionBy(*by).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*by)
    return sums.select(
        *by,
        "_slice",
        F.sum("_sum").over(earlier).alias("_offset"),
        F.sum("_sum").over(whole).alias("_whole"),
    )


def running_sum(
    df: DataFrame,
    by: Sequence[str],
    order: Sequence[Column],
    value: Column,
    name: str,
    total_name: str | None = None,
    rows: int | None = None,
) -> DataFrame:
    """Inclusive running sum of ``value`` in ``order`` within ``by`` (order must be a total order)."""
    by = list(by)
    sliced = sliced_by(df, by, order, rows)
    if sliced is None:
        ordered = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
        out = df.withColumn(name, F.sum(value).over(ordered))
        return out.withColumn(total_name, F.sum(value).over(Window.partitionBy(*by))) if total_name else out
    ordered = Window.partitionBy(*by, "_slice").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    local = sliced.withColumn("_local", F.sum(value).over(ordered))
    joined = same_group(local, _per_slice_offsets(sliced, by, value), [*by, "_slice"])
    # NULL only where neither this slice nor an earlier one has a value so far
    out = joined.withColumn(name, F.coalesce(F.col("_local") + F.col("_offset"), "_local", "_offset"))
    if total_name:
        out = out.withColumn(total_name, F.col("_whole"))
    return out.drop("_slice", "_local", "_offset", "_whole")


def ranked(
    df: DataFrame,
    by: Sequence[str],
    order: Sequence[Column],
    name: str = "rn",
    total_name: str | None = None,
    rows: int | None = None,
) -> DataFrame:
    """``row_number()`` from 1 within ``by``; ``total_name`` adds the group size."""
    by = list(by)
    sliced = sliced_by(df, by, order, rows)
    if sliced is None:
        out = df.withColumn(name, F.row_number().over(Window.partitionBy(*by).orderBy(*order)).cast("long"))
        return out.withColumn(total_name, F.count(F.lit(1)).over(Window.partitionBy(*by))) if total_name else out
    local = sliced.withColumn("_local", F.row_number().over(Window.partitionBy(*by, "_slice").orderBy(*order)))
    joined = same_group(local, _per_slice_offsets(sliced, by, F.lit(1)), [*by, "_slice"])
    out = joined.withColumn(name, (F.col("_local") + F.coalesce("_offset", F.lit(0))).cast("long"))
    if total_name:
        out = out.withColumn(total_name, F.col("_whole"))
    return out.drop("_slice", "_local", "_offset", "_whole")


def neighbourhood(
    df: DataFrame,
    by: Sequence[str],
    index: str,
    exprs: dict[str, Callable[[WindowSpec], Column]],
    before: int = 0,
    after: int = 0,
    rows: int | None = None,
) -> DataFrame:
    """Window expressions that look at most ``before``/``after`` rows away.

    ``index`` is the dense position of a row in its group. Large inputs are cut into blocks of
    consecutive positions; rows near a border are copied into the next block, so every window has
    its context and no task holds a whole group.
    """
    by = list(by)
    limit = rows_per_slice(df)
    if window_rows(df, by, rows) <= limit:
        spec = Window.partitionBy(*by).orderBy(index)
        return df.select("*", *[fn(spec).alias(n) for n, fn in exprs.items()])
    block = max(limit // 4, 4 * (before + after + 1))
    own = F.floor(F.col(index) / block)
    place = F.pmod(F.col(index), F.lit(block))
    homes = F.array_compact(
        F.array(
            own,
            F.when(place >= block - before, own + 1) if before else F.lit(None).cast("long"),
            F.when(place < after, own - 1) if after else F.lit(None).cast("long"),
        )
    )
    spread = df.withColumn("_home", own).withColumn("_block", F.explode(homes))
    spec = Window.partitionBy(*by, "_block").orderBy(index)
    out = spread.select("*", *[fn(spec).alias(n) for n, fn in exprs.items()])
    return out.where("_block = _home").drop("_block", "_home")


def carry_last(
    df: DataFrame, by: Sequence[str], order: Sequence[Column], value: str, name: str, rows: int | None = None
) -> DataFrame:
    """Latest non-null ``value`` at or before each row."""
    by = list(by)
    sliced = sliced_by(df, by, order, rows)
    if sliced is None:
        spec = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
        return df.withColumn(name, F.last(value, ignorenulls=True).over(spec))
    spec = Window.partitionBy(*by, "_slice").orderBy(*order)
    local = sliced.withColumn("_local", F.last(value, ignorenulls=True).over(spec.rowsBetween(Window.unboundedPreceding, 0)))
    placed = sliced.select(*by, "_slice", F.col(value).alias("_v"), F.row_number().over(spec).alias("_rn"))
    ends = placed.groupBy(*by, "_slice").agg(F.max_by("_v", F.when(F.col("_v").isNotNull(), F.col("_rn"))).alias("_end"))
    earlier = Window.partitionBy(*by).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    ends = ends.select(*by, "_slice", F.last("_end", ignorenulls=True).over(earlier).alias("_carry"))
    out = same_group(local, ends, [*by, "_slice"]).withColumn(name, F.coalesce("_local", "_carry"))
    return out.drop("_slice", "_local", "_carry")


def quantiles(
    df: DataFrame,
    by: Sequence[str],
    value: Column,
    specs: dict[str, tuple[float, str]],
    rows: int | None = None,
) -> DataFrame:
    """Exact quantiles per group, ``specs = {name: (q, method)}``.

    ``nearest``: element at rank round-half-even((n-1)q). ``lower``: smallest value whose share
    reaches q (q=0.5 is the lower median). ``linear``: linear interpolation. Equal values are
    counted before the shuffle; the ranks come from a sliced running sum.
    """
    by = list(by)
    picked = df.select(*by, value.cast("double").alias("_v")).where(F.col("_v").isNotNull() & ~F.isnan("_v"))
    counted = picked.groupBy(*by, "_v").agg(F.count(F.lit(1)).alias("_n"))
    cum = running_sum(counted, by, [F.col("_v")], F.col("_n"), "_cum", "_tot", rows)

    def pick(rank: Column) -> Column:
        return F.max(F.when((F.col("_cum") - F.col("_n") <= rank) & (rank < F.col("_cum")), F.col("_v")))

    aggs = []
    for name, (q, method) in specs.items():
        place = (F.col("_tot") - 1) * F.lit(float(q))
        if method == "nearest":
            aggs.append(pick(F.bround(place)).alias(name))
        elif method == "lower":
            aggs.append(pick(F.greatest(F.ceil(F.col("_tot") * F.lit(float(q))) - 1, F.lit(0))).alias(name))
        elif method == "linear":
            low, high = pick(F.floor(place)), pick(F.ceil(place))
            aggs.append((low + (high - low) * F.max(place - F.floor(place))).alias(name))
        else:
            raise ValueError(f"unknown quantile method {method!r}")
    return cum.groupBy(*by).agg(F.max("_tot").alias("n_values"), *aggs)


def smallest_n(df: DataFrame, by: Sequence[str], order: Sequence[Column], n: Column | int, rows: int | None = None) -> DataFrame:
    """The first ``n`` rows per group in ``order`` (n may be a column)."""
    limit = F.lit(n) if isinstance(n, int) else n
    return ranked(df, by, order, "_rn", rows=rows).where(F.col("_rn") <= limit).drop("_rn")
