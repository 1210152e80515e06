"""Point tracks and observation tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framespan.operators.cameras import reproject
from framespan.operators.joins import shuffled
from framespan.operators.ranking import ranked
from framespan.session import cut

SCENE = ("scene",)


def weak_frames(tracks: DataFrame, min_vis: int = 500, threshold: float = 0.1, by: Sequence[str] = SCENE) -> DataFrame:
    """Frames in which fewer than ``min_vis`` tracks are visible."""
    counts = tracks.groupBy(*by, "frame_id").agg(F.count_if(F.col("vis") > threshold).alias("n_visible"))
    return counts.where(F.col("n_visible") < min_vis)


def track_first_seen(
    tracks: DataFrame, width: int, height: int, threshold: float = 0.1, by: Sequence[str] = SCENE
) -> DataFrame:
    """First visible observation of each track and its position key; NULL for tracks never seen."""
    seen = F.when(F.col("vis") > threshold, F.col("frame_id"))
    rows = tracks.groupBy(*by, "track_id").agg(
        F.min_by(F.struct("frame_id", "x", "y"), seen).alias("_first"),
    )
    key = (F.col("x") / max(width - 1, 1) + F.col("y") / max(height - 1, 1)) / 2
    return rows.select(*by, "track_id", "_first.*").withColumn("color_key", key)


def observations(
    tracks: DataFrame,
    points: DataFrame,
    cams: DataFrame,
    max_error: float | None = None,
    min_per_frame: int = 64,
    min_per_track: int = 2,
    max_coord: float = 3000.0,
    by: Sequence[str] = SCENE,
) -> dict[str, DataFrame]:
    """Reconstruction tables from tracks: ``observations``, ``points``, ``rejected`` scenes.

    ``tracks`` is (scene, track_id, frame_id, ox, oy[, mask]). An observation counts when its mask
    holds, its point lies in front of the camera and its reprojection error is below ``max_error``.
    A scene with a frame below ``min_per_frame`` observations is rejected as a whole. Tracks need
    ``min_per_track`` observations; points get ids from 1, observations an index from 0 per image.
    """
    by = list(by)
    obs = reproject(tracks, points, cams, by)
    good = F.lit(True)
    if "mask" in tracks.columns:
        good = good & F.col("mask")
    if max_error is not None:
        good = good & (F.col("zc") > 0) & (F.col("error") < max_error)
    flagged = cut(obs.withColumn("_good", F.coalesce(good, F.lit(False))))
    per_frame = cams.select(*by, "frame_id").join(
        flagged.where("_good").groupBy(*by, "frame_id").agg(F.count(F.lit(1)).alias("_n")), [*by, "frame_id"], "left"
    )
    weakest = per_frame.groupBy(*by).agg(F.min(F.coalesce("_n", F.lit(0))).alias("min_inliers"))
    rejected = weakest.where(F.col("min_inliers") < min_per_frame)
    kept_scenes = weakest.where(F.col("min_inliers") >= min_per_frame).select(*by)
    inliers = cut(flagged.where("_good").join(kept_scenes, by, "left_semi"))
    counts = inliers.groupBy(*by, "track_id").agg(F.count(F.lit(1)).alias("n_inliers")).where(F.col("n_inliers") >= min_per_track)
    numbered = ranked(counts, by, [F.col("track_id")], "point_id")
    out_points = numbered.join(points, [*by, "track_id"])
    near = (F.col("x") < max_coord) & (F.col("y") < max_coord) & (F.col("z") < max_coord)
    used = inliers.select(*by, "track_id", "frame_id", "ox", "oy").join(
        out_points.where(near).select(*by, "track_id", "point_id"), [*by, "track_id"]
    )
    placed = ranked(used, [*by, "frame_id"], [F.col("point_id")], "_rn")
    table = placed.select(*by, (F.col("frame_id") + 1).alias("image_id"), (F.col("_rn") - 1).alias("point2d_idx"), "ox", "oy", "point_id")
    return {"observations": table, "points": out_points, "rejected": rejected}


def observations_direct(points: DataFrame, by: Sequence[str] = SCENE) -> DataFrame:
    """Observation table without tracks: every point is seen once, in its own frame.

    ``points`` is (scene, pid, px, py, frame_id, ...); fractional frame indices are truncated.
    """
    by = list(by)
    numbered = ranked(points, by, [F.col("pid")], "point_id").withColumn("_frame", F.col("frame_id").cast("int"))
    placed = ranked(numbered, [*by, "_frame"], [F.col("point_id")], "_rn")
    return placed.select(
        *by, (F.col("_frame") + 1).alias("image_id"), (F.col("_rn") - 1).alias("point2d_idx"), F.col("px").alias("ox"), F.col("py").alias("oy"), "point_id"
    )


def points_to_rows(points: DataFrame, by: Sequence[str] = SCENE) -> DataFrame:
    """Read-back: one row per id 1..max with zeros where an id is unused."""
    by = list(by)
    ids = points.groupBy(*by).agg(F.max("point_id").alias("_max"))
    dense = ids.select(*by, F.explode(F.sequence(F.lit(1).cast("long"), F.col("_max"))).alias("point_id"))
    joined = shuffled(dense).join(points.select(*by, "point_id", "x", "y", "z"), [*by, "point_id"], "left")
    return joined.select(*by, "point_id", *[F.coalesce(a, F.lit(0.0)).alias(a) for a in ("x", "y", "z")])


def pack_cameras(cams: DataFrame, model: str = "SIMPLE_PINHOLE", shared: bool = False, by: Sequence[str] = SCENE) -> DataFrame:
    """Camera parameters of a model as an array; ``shared`` keeps the first frame's camera."""
    mean = (F.col("fx") + F.col("fy")) / 2
    layouts = {
        "PINHOLE": F.array("fx", "fy", "cx", "cy"),
        "SIMPLE_PINHOLE": F.array(mean, F.col("cx"), F.col("cy")),
    }
    if "dist" in cams.columns:
        layouts["SIMPLE_RADIAL"] = F.array(mean, F.col("cx"), F.col("cy"), F.get("dist", F.lit(0)))
    if model not in layouts:
        raise ValueError(f"unsupported camera model {model!r}")
    packed = cams.select(*by, (F.col("frame_id") + 1).alias("camera_id"), F.lit(model).alias("model"), layouts[model].alias("params"))
    if shared:
        packed = packed.groupBy(*by).agg(F.min_by(F.struct("camera_id", "model", "params"), "camera_id").alias("_c")).select(*by, "_c.*")
    return packed
