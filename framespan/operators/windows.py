"""Overlapping count windows over frame sequences and rolling series statistics."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from framespan.operators.ranking import neighbourhood, ranked, running_sum, window_rows


def _check(size: int, overlap: int) -> int:
    if not 0 <= overlap < size:
        raise ValueError("window size must be larger than the overlap")
    return size - overlap


def number_frames(df: DataFrame, by: Sequence[str], order: Sequence[Column], name: str = "frame_id") -> DataFrame:
    """Dense position 0..n-1 of each row in its scene."""
    return ranked(df, by, order, "_rn").withColumn(name, F.col("_rn") - 1).drop("_rn")


def assign_windows(frames: DataFrame, size: int, overlap: int, by: Sequence[str] = ("scene",), index: str = "frame_id") -> DataFrame:
    """Give every frame one row per window it belongs to.

    Window k covers positions [k*step, k*step+size); windows after the first exist only while
    more than ``overlap`` frames are left. Needs the dense position ``index``; the only shuffle is
    the count per scene.
    """
    step = _check(size, overlap)
    sizes = frames.groupBy(*by).agg(F.count(F.lit(1)).alias("_n"))
    place = F.col(index)
    first = F.greatest(F.lit(0), F.floor((place - size) / step) + 1)
    last = F.floor(place / step)
    # the largest k with k = 0 or n - k*step > overlap
    limit = F.greatest(F.lit(0), F.ceil((F.col("_n") - overlap) / step) - 1)
    joined = frames.join(sizes, list(by)).withColumn("_last", F.least(last, limit))
    out = joined.where(first <= F.col("_last")).withColumn(
        "window_id", F.explode(F.sequence(first.cast("long"), F.col("_last").cast("long")))
    )
    return out.withColumn("pos", F.col(index) - F.col("window_id") * step).drop("_n", "_last")


def window_bounds(frames: DataFrame, size: int, overlap: int, by: Sequence[str] = ("scene",)) -> DataFrame:
    """(scene, chunk, start, end) with exclusive end; ceil((n-overlap)/step) chunks per scene."""
    step = _check(size, overlap)
    sizes = frames.groupBy(*by).agg(F.count(F.lit(1)).alias("_n"))
    chunks = F.ceil((F.col("_n") - overlap) / step)
    return (
        sizes.where(chunks >= 1)
        .withColumn("chunk", F.explode(F.sequence(F.lit(0).cast("long"), chunks - 1)))
        .select(
            *by,
            "chunk",
            (F.col("chunk") * step).alias("start"),
            F.least(F.col("chunk") * step + size, F.col("_n")).alias("end"),
        )
    )


def merge_windows(df: DataFrame, overlap: int, keep_all: bool = False) -> DataFrame:
    """Undo the overlap: window 0 whole, later windows without their first ``overlap`` rows."""
    return df if keep_all else df.where((F.col("window_id") == 0) | (F.col("pos") >= overlap))


def adjacent_overlap(
    df: DataFrame, size: int, overlap: int, values: Sequence[str], by: Sequence[str] = ("scene",), keys: Sequence[str] = ()
) -> DataFrame:
    """Pair window k with window k+1 on their shared frames.

    ``values`` come out as ``prev_*``/``cur_*``; ``keys`` are further join keys such as a pixel.
    Both sides keep only the rows inside the overlap before the join.
    """
    step = _check(size, overlap)
    join_keys = [*by, "window_id", "frame_id", *keys]
    prev = df.where(F.col("pos") >= step).select(
        *by, (F.col("window_id") + 1).alias("window_id"), "frame_id", *keys, *[F.col(v).alias(f"prev_{v}") for v in values]
    )
    cur = df.where((F.col("window_id") > 0) & (F.col("pos") < overlap)).select(
        *by, "window_id", "frame_id", *keys, "pos", *[F.col(v).alias(f"cur_{v}") for v in values]
    )
    return prev.join(cur, join_keys)


def smoothed(
    df: DataFrame, value: str, by: Sequence[str], order: Sequence[Column], size: int = 20, weight: Column | None = None
) -> DataFrame:
    """Rolling statistics over the last ``size`` values plus the running global average.

    The median is the lower one; the global average weights each value by ``weight`` (default 1).
    """
    weight = F.lit(1) if weight is None else weight
    rows = window_rows(df, by)
    numbered = ranked(df, by, order, "_rn", rows=rows)
    rolled = neighbourhood(
        numbered,
        by,
        "_rn",
        {
            "avg": lambda w: F.avg(value).over(w.rowsBetween(1 - size, 0)),
            "max": lambda w: F.max(value).over(w.rowsBetween(1 - size, 0)),
            "last": lambda w: F.last(value).over(w.rowsBetween(0, 0)),
            "_recent": lambda w: F.array_sort(F.collect_list(value).over(w.rowsBetween(1 - size, 0))),
        },
        before=size - 1,
        rows=rows,
    )
    out = rolled.withColumn("median", F.element_at("_recent", F.ceil(F.size("_recent") / 2).cast("int")))
    place = [F.col("_rn")]
    out = running_sum(out, by, place, F.col(value) * weight, "_total", rows=rows)
    out = running_sum(out, by, place, weight, "_count", rows=rows)
    return out.withColumn("global_avg", F.col("_total") / F.col("_count")).drop("_recent", "_total", "_count", "_rn")


def steady_latency(df: DataFrame, value: str, by: Sequence[str], order: Sequence[Column], warmup: int = 2) -> DataFrame:
    """Mean latency without the first ``warmup`` and the last value; of all when too few."""
    sized = ranked(df, by, order, "_rn", "_n")
    steady = (F.col("_rn") > warmup) & (F.col("_rn") < F.col("_n"))
    return sized.groupBy(*by).agg(
        F.coalesce(F.avg(F.when(steady, F.col(value))), F.avg(value)).alias("mean_latency"),
        F.count_if(steady).alias("n_steady"),
    )


def step_lengths(traj: DataFrame, by: Sequence[str], order: Sequence[Column], axes: Sequence[str] = ("x", "y", "z")) -> DataFrame:
    """Distance from the previous position; NULL for the first row of a sequence."""
    rows = window_rows(traj, by)
    numbered = ranked(traj, by, order, "_rn", rows=rows)
    spec = {f"_d{a}": (lambda w, a=a: F.col(a) - F.lag(a).over(w)) for a in axes}
    moved = neighbourhood(numbered, by, "_rn", spec, before=1, rows=rows)
    square = sum((F.col(f"_d{a}") * F.col(f"_d{a}") for a in axes[1:]), F.col(f"_d{axes[0]}") * F.col(f"_d{axes[0]}"))
    return moved.withColumn("step", F.sqrt(square)).drop(*[f"_d{a}" for a in axes], "_rn")


def path_length(traj: DataFrame, by: Sequence[str], order: Sequence[Column], axes: Sequence[str] = ("x", "y", "z")) -> DataFrame:
    """Total and mean step length per sequence."""
    steps = step_lengths(traj, by, order, axes)
    return steps.groupBy(*by).agg(
        F.coalesce(F.sum("step"), F.lit(0.0)).alias("path_length"),
        F.avg("step").alias("mean_step"),
        F.count("step").alias("n_steps"),
    )
