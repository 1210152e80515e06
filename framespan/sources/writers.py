"""Sinks: window checkpoints, exports and reports."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from framespan.operators.cameras import convert_poses
from framespan.sources.folders import few_tasks, listing, write_folders


def append_metrics(df: DataFrame, path: str) -> None:
    """Append metric rows; the schema may widen from run to run."""
    df.write.mode("append").parquet(path)


def read_metrics(spark: SparkSession, path: str) -> DataFrame:
    """All appended rows; columns missing in older files are NULL."""
    return spark.read.option("mergeSchema", "true").parquet(path)


def _gathered(df: DataFrame, by: Sequence[str]) -> DataFrame:
    """Rows of a folder in one task, so that a folder has one file; partitions too large are split."""
    return df.hint("rebalance", *[F.col(b) for b in by])


def write_windows(df: DataFrame, path: str) -> None:
    """Registered windows, one folder per (scene, window_id); rewriting a window replaces it only.

    A window is one file, whatever its frames; a long scene is written by many tasks, and so is a window too large for one.
    """
    write_folders(_gathered(df, ["scene", "window_id"]), path, ["scene", "window_id"], dynamic=True)


def read_windows(spark: SparkSession, path: str, scene=None, first: int | None = None, last: int | None = None) -> DataFrame:
    """Stored windows; scene and window range prune folders. Window ids come back as numbers."""
    with listing(spark):
        df = few_tasks(spark.read.parquet(path))
    df = df.withColumn("window_id", F.col("window_id").cast("long"))
    if scene is not None:
        df = df.where(F.col("scene") == scene)
    if first is not None:
        df = df.where(F.col("window_id") >= first)
    if last is not None:
        df = df.where(F.col("window_id") <= last)
    return df


def export_scene(tables: dict[str, DataFrame], path: str, by: Sequence[str] = ("scene",)) -> None:
    """One Parquet table per entity (intrinsics, poses, depth, confidence...), partitioned by scene.

    A ``poses`` table (r, t camera to world) is also written as a text trajectory, one file set per
    scene: ``ts x y z qw qx qy qz``.
    """
    for name, df in tables.items():
        write_folders(_gathered(df, by), f"{path}/{name}", by)
    if "poses" in tables:
        poses = tables["poses"]
        rest = [*by, "frame_id", "r", "t"]
        tum = convert_poses(poses.select(*rest), "matrix", "tum")
        numbers = [F.format_string("%.8f", F.col(c)) for c in ("x", "y", "z", "qw", "qx", "qy", "qz")]
        text = tum.select(*by, "frame_id", F.concat_ws(" ", F.col("frame_id").cast("double").cast("string"), *numbers).alias("value"))
        write_folders(text.repartitionByRange(*by, "frame_id"), f"{path}/trajectory", by, "text", order=["frame_id"])


def report_json(metrics: DataFrame, names: Sequence[str], seq: str = "seq") -> DataFrame:
    """JSON lines: one per sequence (``per_seq_metrics``) and one with the averages (``avg_metrics``).

    ``metrics`` comes from ``weighted_rollup``: rows with a sequence are details, the row without
    dataset and sequence is the total.
    """
    values = F.struct(*names)
    detail = metrics.where(F.col(seq).isNotNull()).select(
        F.to_json(F.struct(F.lit("per_seq_metrics").alias("section"), F.col(seq).cast("string").alias("seq"), values.alias("metrics"))).alias("value")
    )
    total = metrics.where(F.col(seq).isNull() & F.col("dataset").isNull()).select(
        F.to_json(F.struct(F.lit("avg_metrics").alias("section"), values.alias("metrics"))).alias("value")
    )
    return detail.unionByName(total)


def export_report(metrics: DataFrame, names: Sequence[str], path: str, seq: str = "seq") -> None:
    report_json(metrics, names, seq).write.mode("overwrite").text(path)


def loop_lines(pairs: DataFrame, frames: DataFrame) -> DataFrame:
    """Text of a loop result: pairs by descending score, then the frame index listing."""
    a = pairs.select(
        F.lit(0).alias("_part"), (-F.col("sim")).alias("_o1"), F.col("i").cast("long").alias("_o2"), F.format_string("%d, %d, %.4f", "i", "j", "sim").alias("value")
    )
    b = frames.select(
        F.lit(1).alias("_part"), F.lit(0.0).alias("_o1"), F.col("frame_id").cast("long").alias("_o2"), F.format_string("# %d: %s", "frame_id", "path").alias("value")
    )
    return a.unionByName(b).orderBy("_part", "_o1", "_o2").select("value")


def export_loops(pairs: DataFrame, frames: DataFrame, path: str) -> None:
    loop_lines(pairs, frames).write.mode("overwrite").text(path)
