"""Depth metrics, error maps and dataset roll-ups."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from framespan.functions.columns import clamp, col
from framespan.operators.joins import attach
from framespan.operators.robust import align

DEPTH_METRICS = ["abs_rel", "sq_rel", "rmse", "log_rmse", "d1", "d2", "d3"]


def to_disparity(c: Column | str) -> Column:
    """1/d for positive depth, 0 otherwise."""
    c = col(c)
    return F.when(c > 0, 1.0 / c).otherwise(F.lit(0.0))


def _valid(gt: Column, max_depth: float | None) -> Column:
    """A ground truth that is a number above zero (Spark orders NaN above every number)."""
    ok = (gt > 0) & ~F.isnan(gt)
    return ok & (gt < max_depth) if max_depth is not None else ok


def depth_alignment(
    pairs: DataFrame,
    by: Sequence[str],
    method: str = "scale",
    max_depth: float | None = 80.0,
    pre_clip: tuple[float | None, float | None] = (None, None),
    disparity: bool = False,
) -> DataFrame:
    """Alignment of predictions to ground truth over the valid pixels of each group."""
    valid = pairs.where(_valid(F.col("gt"), max_depth)).select(
        *by,
        clamp(F.col("pred"), *pre_clip).alias("pred"),
        (1.0 / (F.col("gt") + 1e-8) if disparity else F.col("gt")).alias("gt"),
    )
    return align(valid, by, method)


def depth_metrics(
    pairs: DataFrame,
    by: Sequence[str],
    alignment: DataFrame | None = None,
    method: str = "scale",
    max_depth: float | None = 80.0,
    pre_clip: tuple[float | None, float | None] = (None, None),
    post_clip: tuple[float | None, float | None] = (None, None),
    mask: str | None = None,
    disparity: bool = False,
) -> DataFrame:
    """AbsRel, SqRel, RMSE, log RMSE, share of ratios below 1.25^k and the valid pixel count.

    ``pairs`` has ``pred`` and ``gt``. A group without valid pixels gets zeros.
    """
    by = list(by)
    if alignment is None:
        alignment = depth_alignment(pairs, by, method, max_depth, pre_clip, disparity)
    p = F.col("scale") * clamp(F.col("pred"), *pre_clip) + F.col("shift")
    p = clamp(to_disparity(p) if disparity else p, *post_clip)
    used = _valid(F.col("gt"), max_depth)
    if mask is not None:
        used = used & F.col(mask)
    aligned = attach(pairs, alignment, by, how="left", nulls=True).select(
        *by, F.col("gt"), p.alias("p"), F.coalesce(used, F.lit(False)).alias("ok")
    )
    g, p, ok = F.col("gt"), F.col("p"), F.col("ok")
    err = p - g
    lp = F.log(F.greatest(p, F.lit(1e-5))) - F.log(g)
    clamped = F.greatest(p, F.lit(1e-5))
    ratio = F.greatest(clamped / g, g / clamped)

    def mean(c: Column) -> Column:
        return F.coalesce(F.avg(F.when(ok, c)), F.lit(0.0))

    return aligned.groupBy(*by).agg(
        mean(F.abs(err) / g).alias("abs_rel"),
        mean(err * err / g).alias("sq_rel"),
        F.sqrt(mean(err * err)).alias("rmse"),
        F.sqrt(mean(lp * lp)).alias("log_rmse"),
        mean((ratio < 1.25).cast("double")).alias("d1"),
        mean((ratio < 1.25**2).cast("double")).alias("d2"),
        mean((ratio < 1.25**3).cast("double")).alias("d3"),
        F.count_if(ok).alias("valid_pixels"),
    )


def error_map(
    pairs: DataFrame, alignment: DataFrame, by: Sequence[str], max_depth: float | None = 80.0, disparity: bool = False
) -> DataFrame:
    """Relative error per pixel, 0 where the ground truth is not valid."""
    p = F.col("scale") * F.col("pred") + F.col("shift")
    p = to_disparity(p) if disparity else p
    joined = attach(pairs, alignment, by, how="left", nulls=True)
    error = F.when(_valid(F.col("gt"), max_depth), F.abs(p - F.col("gt")) / F.col("gt")).otherwise(F.lit(0.0))
    return joined.withColumn("error", F.coalesce(error, F.lit(0.0))).drop("scale", "shift")


def weighted_rollup(
    metrics: DataFrame, dataset: str = "dataset", seq: str = "seq", names: Sequence[str] = tuple(DEPTH_METRICS), weight: str = "valid_pixels"
) -> DataFrame:
    """Per-sequence, per-dataset and overall means weighted by valid pixels, in one pass."""
    w = F.col(weight)
    return metrics.rollup(dataset, seq).agg(
        *[(F.sum(F.col(m) * w) / F.nullif(F.sum(w), F.lit(0))).alias(m) for m in names], F.sum(w).alias(weight)
    )


def mean_rollup(metrics: DataFrame, by: Sequence[str], names: Sequence[str], sizes: DataFrame | None = None) -> DataFrame:
    """Unweighted means per group, 0.0 for an empty one.

    With ``sizes`` (by, size) the sums are divided by the dataset size instead of by the number of
    evaluated sequences, so missing sequences count as zero.
    """
    by = list(by)
    if sizes is None:
        return metrics.groupBy(*by).agg(
            *[F.coalesce(F.avg(m), F.lit(0.0)).alias(m) for m in names], F.count(F.lit(1)).alias("n")
        )
    sums = metrics.groupBy(*by).agg(*[F.sum(m).alias(m) for m in names], F.count(F.lit(1)).alias("n"))
    joined = sizes.join(sums, by, "left")
    return joined.select(
        *by,
        *[F.coalesce(F.col(m) / F.col("size"), F.lit(0.0)).alias(m) for m in names],
        F.coalesce("n", F.lit(0)).alias("n"),
    )


def pooled_mean(df: DataFrame, by: Sequence[str], value: str, n: str) -> DataFrame:
    """Mean over pooled workers: sum(value*n) / sum(n)."""
    return df.groupBy(*by).agg(
        (F.sum(F.col(value) * F.col(n)) / F.sum(n)).alias("pooled_mean"), F.sum(n).alias("total_count")
    )
