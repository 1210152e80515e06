"""Confidence masks, depth thresholds and other row filters."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from framespan.operators.joins import attach
from framespan.operators.ranking import quantiles
from framespan.session import cut


def _number(name: str) -> Column:
    """The column with NaN turned into NULL: Spark orders NaN above every number."""
    value = F.col(name)
    return F.when(~F.isnan(value), value)


def conf_mask(df: DataFrame, q: float, by: Sequence[str], conf: str = "conf", name: str = "mask", rows: int | None = None) -> DataFrame:
    """Mark rows at or above the nearest q-quantile of their group.

    ``q`` is one minus the share to keep. The threshold table has one row per group. A confidence
    that is NaN or NULL is never marked, and a group without any keeps its rows unmarked.
    """
    bounds = cut(quantiles(df, by, F.col(conf), {"_cut": (q, "nearest")}, rows).drop("n_values"))
    joined = attach(df, bounds, by, how="left", nulls=True)
    return joined.withColumn(name, F.coalesce(_number(conf) >= F.col("_cut"), F.lit(False))).drop("_cut")


def mutual_mask(prev: DataFrame, cur: DataFrame, keys: Sequence[str], mask: str = "mask") -> DataFrame:
    """Rows confident on both sides. Each side drops its unmarked rows before the join."""
    kept = prev.where(mask).drop(mask)
    return kept.join(cur.where(mask).select(*keys), list(keys))


def confident_points(df: DataFrame, percent: float, by: Sequence[str], conf: str = "conf", floor: float = 1e-5) -> DataFrame:
    """Points at or above the linear confidence percentile and above ``floor``; 0 means no cut."""
    kept = df.where(_number(conf) > floor)
    if percent == 0:
        return kept.where(F.col(conf) >= 0)
    bounds = cut(quantiles(df, by, F.col(conf), {"_cut": (percent / 100.0, "linear")}).drop("n_values"))
    return attach(kept, bounds, by, nulls=True).where(F.col(conf) >= F.col("_cut")).drop("_cut")


def filter_background(df: DataFrame, black: bool = False, white: bool = False, frame: int | None = None) -> DataFrame:
    """Drop black (r+g+b < 16) and white (all > 240) points; optionally keep one frame."""
    if frame is not None:
        df = df.where(F.col("frame_id") == frame)
    if black:
        df = df.where(F.col("r").cast("int") + F.col("g") + F.col("b") >= 16)
    if white:
        df = df.where(~((F.col("r") > 240) & (F.col("g") > 240) & (F.col("b") > 240)))
    return df


def apply_mask(df: DataFrame, masks: DataFrame, keys: Sequence[str], value: str = "conf", threshold: float = 0.1) -> DataFrame:
    """Zero ``value`` where the mask is not above ``threshold`` (a missing mask counts as 0)."""
    joined = df.join(masks.select(*keys, F.col("mask").alias("_m")), list(keys), "left")
    keep = F.coalesce(F.col("_m") > threshold, F.lit(False))
    return joined.withColumn(value, F.when(keep, F.col(value)).otherwise(F.lit(0.0))).drop("_m")


def threshold_depth(
    px: DataFrame,
    by: Sequence[str],
    min_percent: float = 1.0,
    max_percent: float = 99.0,
    max_depth: float = -1.0,
    depth: str = "depth",
) -> DataFrame:
    """Zero depths beyond ``max_depth`` or outside the percentile band of their frame.

    Percentiles are linear, ignore NaN/NULL and are taken after the absolute cut; a threshold that
    is not positive is not applied. The upper cut runs before the lower one. NaN and NULL stay.
    """
    d, known = F.col(depth), _number(depth)
    if max_depth > 0:
        px = px.withColumn(depth, F.when(known > max_depth, 0.0).otherwise(d))
    specs = {}
    if max_percent > 0:
        specs["_hi"] = (max_percent / 100.0, "linear")
    if min_percent > 0:
        specs["_lo"] = (min_percent / 100.0, "linear")
    if not specs:
        return px
    bounds = cut(quantiles(px, by, d, specs).drop("n_values"))
    out = attach(px, bounds, by, how="left", nulls=True)
    if "_hi" in specs:
        out = out.withColumn(depth, F.when((F.col("_hi") > 0) & (known > F.col("_hi")), 0.0).otherwise(d))
    if "_lo" in specs:
        out = out.withColumn(depth, F.when((F.col("_lo") > 0) & (known < F.col("_lo")), 0.0).otherwise(d))
    return out.drop(*specs)


def center_crop(px: DataFrame, size: int = 224) -> DataFrame:
    """Centre ``size`` x ``size`` pixels of a raster; needs the frame shape in ``h`` and ``w``."""
    top, left = F.floor(F.col("h") / 2) - size // 2, F.floor(F.col("w") / 2) - size // 2
    inside = (F.col("v") >= top) & (F.col("v") < top + size) & (F.col("u") >= left) & (F.col("u") < left + size)
    return px.where(inside)


def filter_sequences(
    ann: DataFrame, min_images: int, categories: Sequence[str] | None = None, limit: float = 1e5
) -> DataFrame:
    """Annotations of usable sequences: enough images, listed category, no runaway translation.

    One frame with Tx+Ty+Tz above ``limit`` drops its whole sequence.
    """
    if categories is not None:
        ann = ann.where(F.col("category").isin(list(categories)))
    runaway = (F.col("tx") + F.col("ty") + F.col("tz")) > limit
    usable = (
        ann.groupBy("seq")
        .agg(F.count(F.lit(1)).alias("_n"), F.bool_or(runaway).alias("_bad"))
        .where((F.col("_n") >= min_images) & ~F.col("_bad"))
    )
    return ann.join(usable.select("seq"), "seq", "left_semi")


# Fixed cleaning rules per depth source: divisor of the stored value, the stored sentinel for
# "missing", and the valid range after division (a bound of None is not applied).
DEPTH_PROFILES = [
    # name, divisor, sentinel, below_is_missing, above_is_missing
    ("sevenscenes", 1000.0, 65535.0, 1e-3, 10.0),
    ("nrgbd", 1000.0, None, 1e-3, 10.0),
    ("eth3d", 1.0, None, None, None),
    ("kitti", 256.0, 0.0, None, None),
    ("bonn", 5000.0, 0.0, None, None),
    ("sintel", 1.0, None, None, None),
]
PROFILE_SCHEMA = "profile string, divisor double, sentinel double, low double, high double"


def clean_depth(df: DataFrame, depth: str = "raw", profile: str = "profile", name: str = "depth") -> DataFrame:
    """Metric depth with every kind of "missing" turned into NULL, by source profile."""
    rules = df.sparkSession.createDataFrame(DEPTH_PROFILES, PROFILE_SCHEMA)
    rules = rules.withColumnRenamed("profile", profile)
    joined = df.join(F.broadcast(rules), profile, "left")
    raw = F.col(depth).cast("double")
    metric = raw / F.coalesce("divisor", F.lit(1.0))
    missing = (
        raw.isNull()
        | F.isnan(raw)
        | (F.abs(raw) == float("inf"))
        | F.coalesce(raw == F.col("sentinel"), F.lit(False))
        | F.coalesce(metric < F.col("low"), F.lit(False))
        | F.coalesce(metric > F.col("high"), F.lit(False))
    )
    return joined.withColumn(name, F.when(~missing, metric)).drop("divisor", "sentinel", "low", "high")


def scale_to_byte(rasters: DataFrame, depth: str = "depth", name: str = "scaled") -> DataFrame:
    """Min-max scale each raster to 0..255, truncated."""
    low, high = F.array_min(depth), F.array_max(depth)
    scaled = F.transform(
        depth, lambda d: F.when(high > low, ((d - low) / (high - low) * 255.0).cast("int")).otherwise(F.lit(0))
    )
    return rasters.withColumn(name, scaled)

