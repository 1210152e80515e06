"""Window registration, loop constraints, assembly, and the entry points for user models."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator, Sequence
from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from framespan.functions import columns as C
from framespan.functions import geometry as G
from framespan.operators import registration as RG
from framespan.operators.cameras import transform_points
from framespan.operators.filters import conf_mask, mutual_mask
from framespan.operators.graph import accumulate_sim3
from framespan.operators.joins import attach, shuffled
from framespan.operators.robust import irls_scale_points
from framespan.operators.windows import merge_windows
from framespan.session import cut, ensure_checkpoint_dir

PIXEL = ("v", "u")
XYZ = ("x", "y", "z")
METHODS = {"poses": RG.register_poses, "views": RG.register_views}


def register_pairs(
    prev_px: DataFrame,
    cur_px: DataFrame,
    prev_poses: DataFrame,
    cur_poses: DataFrame,
    q: float,
    by: Sequence[str],
    method: str | Callable[[DataFrame, list[str], DataFrame], DataFrame] = "poses",
) -> DataFrame:
    """Similarity that maps the current prediction onto the previous one, per group ``by``.

    Both sides share frames: pixels are (by, frame_id, v, u, x, y, z, conf) in camera coordinates,
    poses (by, frame_id, r, t) camera to world. Pixels confident on both sides give the robust
    scale; the poses give rotation and translation for that scale (``method='points'`` registers
    the points instead). A function as ``method`` gets the pose pairs (by, frame_id, src_r, src_t, dst_r, dst_t),
    ``by`` and the scales (by, scale), and returns (by, s, r, t, status).
    """
    by = list(by)
    keys = [*by, "frame_id", *PIXEL]
    prev = conf_mask(prev_px, q, by)
    cur = conf_mask(cur_px, q, by)
    kept = mutual_mask(
        cur.select(*keys, *[F.col(a).alias(f"s{a}") for a in XYZ], "mask"), prev.select(*keys, "mask"), keys
    ).join(prev_px.select(*keys, *[F.col(a).alias(f"d{a}") for a in XYZ]), keys)
    # read by every pass of the scale and by the fit: write the confident overlap once
    kept = cut(kept)
    scales = irls_scale_points(kept, by)
    if method == "points":
        return RG.register_points(kept, by, scales)
    both = cur_poses.select(*by, "frame_id", F.col("r").alias("src_r"), F.col("t").alias("src_t")).join(
        prev_poses.select(*by, "frame_id", F.col("r").alias("dst_r"), F.col("t").alias("dst_t")), [*by, "frame_id"]
    )
    return (method if callable(method) else METHODS[method])(both, by, scales)


def _tail(df: DataFrame, step: int) -> DataFrame:
    """Rows a window shares with its successor, keyed by the successor."""
    return df.where(F.col("pos") >= step).withColumn("window_id", F.col("window_id") + 1).drop("pos")


def _head(df: DataFrame, overlap: int) -> DataFrame:
    return df.where((F.col("window_id") > 0) & (F.col("pos") < overlap)).drop("pos")


def register_windows(
    px: DataFrame, poses: DataFrame, size: int, overlap: int, q: float = 0.7, by: Sequence[str] = ("scene",), method: str | Callable = "poses"
) -> DataFrame:
    """Relative similarity of every window to its predecessor: (scene, window_id, sim3, status).

    All adjacent pairs of all scenes are registered together. Window 0 has the identity; windows
    that cannot be registered keep the identity and a status to filter on.
    """
    by = list(by)
    step = size - overlap
    keys = [*by, "window_id"]
    fits = register_pairs(_tail(px, step), _head(px, overlap), _tail(poses, step), _head(poses, overlap), q, keys, method)
    windows = poses.select(*keys).distinct()
    joined = windows.join(fits.select(*keys, "s", "r", "t", "status"), keys, "left")
    ok = F.coalesce(F.col("status") == "ok", F.lit(False))
    first = F.col("window_id") == 0
    return joined.select(
        *keys,
        F.when(ok, F.struct("s", "r", "t")).otherwise(C.sim3_identity()).alias("sim3"),
        F.when(first, "ok").otherwise(F.coalesce("status", F.lit("no_overlap"))).alias("status"),
    )


def apply_to_poses(poses: DataFrame, transforms: DataFrame, keys: Sequence[str], sim3: str = "sim3") -> DataFrame:
    """Move camera-to-world poses by a similarity: R·R_c and s·R·t_c + t."""
    joined = attach(poses, transforms.select(*keys, F.col(sim3).alias("_g")), keys)
    rest = [c for c in poses.columns if c not in ("r", "t")]
    return joined.select(
        *rest, C.mat_mul("_g.r", "r").alias("r"), F.array(*C.sim3_apply("_g", C.components("t"))).alias("t")
    )


def assemble(
    px: DataFrame, poses: DataFrame, relative: DataFrame, overlap: int, by: Sequence[str] = ("scene",)
) -> tuple[DataFrame, DataFrame]:
    """World points and poses of the whole sequence from windows and their relative transforms.

    Transforms are chained per scene; poses move by the product, local points scale by it, or by
    the previous product times ``scale_mask`` where layer refinement left one. Each frame is taken
    from the window that owns it.
    """
    by = list(by)
    keys = [*by, "window_id"]
    chained = accumulate_sim3(cut(relative.select(*keys, "sim3")), by, "window_id")
    chained = chained.select(*keys, F.col("total").alias("sim3"), (F.col("total.s") / F.col("sim3.s")).alias("_before"))
    placed = apply_to_poses(merge_windows(poses, overlap), chained, keys)
    scaled = attach(merge_windows(px, overlap), chained.select(*keys, F.col("sim3.s").alias("_s"), "_before"), keys)
    factor = F.col("_before") * F.col("scale_mask") if "scale_mask" in px.columns else F.col("_s")
    rest = [c for c in px.columns if c not in (*XYZ, "scale_mask")]
    local = scaled.select(*rest, *[(factor * F.col(a)).alias(a) for a in XYZ])
    posed = placed.select(*keys, "frame_id", C.sim3(F.lit(1.0), "r", "t").alias("sim3"))
    return transform_points(local, posed, [*keys, "frame_id"]), placed


def _by_window(df: DataFrame) -> Callable[[int], DataFrame]:
    """Write ``df`` with one folder per window; the result reads one window back."""
    path = f"{ensure_checkpoint_dir(df.sparkSession)}/{uuid.uuid4().hex}"
    df.withColumn("_w", F.col("window_id")).repartition("_w", "pos").write.partitionBy("_w").parquet(path)
    stored = df.sparkSession.read.schema(StructType([*df.schema, StructField("_w", LongType())])).parquet(path)
    return lambda k: stored.where(F.col("_w") == k).drop("_w")


def register_chain(
    px: DataFrame, poses: DataFrame, size: int, overlap: int, q: float = 0.7, by: Sequence[str] = ("scene",), refine: bool = False
) -> tuple[DataFrame, DataFrame]:
    """Exact sequential registration: window k against the already registered window k-1.

    Step k handles window k of all scenes at once, so the number of steps is the longest scene's
    window count. Each step is written to the checkpoint folder, which also carries the state.
    ``px`` holds x, y, z (camera coordinates), conf, and ``seg`` when ``refine`` is set.
    """
    from framespan.operators.segments import refine_depth

    by = list(by)
    keys = [*by, "window_id"]
    step = size - overlap
    last = poses.agg(F.max("window_id")).first()[0]
    # stored by window once, so each step reads the folder of its own window only
    px_of, poses_of = _by_window(px), _by_window(poses)
    done_px = [cut(px_of(0))]
    done_poses = [cut(poses_of(0))]
    for k in range(1, (last or 0) + 1):
        now_px, now_poses = px_of(k), poses_of(k)
        prev_px, prev_poses = done_px[-1], done_poses[-1]
        fits = register_pairs(_tail(prev_px, step), _head(now_px, overlap), _tail(prev_poses, step), _head(now_poses, overlap), q, keys)
        ok = F.coalesce(F.col("status") == "ok", F.lit(False))
        fits = now_poses.select(*keys).distinct().join(fits, keys, "left")
        moves = cut(fits.select(*keys, F.when(ok, F.struct("s", "r", "t")).otherwise(C.sim3_identity()).alias("sim3")))
        scaled = attach(now_px, moves.select(*keys, F.col("sim3.s").alias("_s")), keys)
        new_px = scaled.withColumns({a: F.col("_s") * F.col(a) for a in XYZ}).drop("_s")
        if refine:
            names = [*by, "window_id", "pos", "frame_id", *PIXEL, "seg"]
            pair = prev_px.select(*names, F.col("z").alias("depth")).unionByName(new_px.select(*names, F.col("z").alias("depth")))
            # number the two windows 0 and 1 for the refinement of the second
            pair = pair.withColumn("window_id", F.col("window_id") - (k - 1))
            mask = refine_depth(pair, size, overlap, by=by).where("window_id = 1")
            mask = mask.select(*by, "frame_id", *PIXEL, "scale_mask")
            new_px = new_px.join(mask, [*by, "frame_id", *PIXEL]).withColumns({a: F.col("scale_mask") * F.col(a) for a in XYZ})
            new_px = new_px.select(*px.columns)
        done_px.append(cut(new_px.select(*px.columns)))
        done_poses.append(cut(apply_to_poses(now_poses, moves, keys).select(*poses.columns)))
    return reduce(DataFrame.unionByName, done_px), reduce(DataFrame.unionByName, done_poses)


def loop_constraints(
    ranges: DataFrame,
    chunk_px: DataFrame,
    chunk_poses: DataFrame,
    loop_px: DataFrame,
    loop_poses: DataFrame,
    q: float = 0.7,
    by: Sequence[str] = ("scene",),
) -> DataFrame:
    """Loop edges (scene, i, j, sim3, status) from joint predictions of two frame ranges.

    ``ranges`` has ``loop_id, chunk_a, start_a, end_a, chunk_b, start_b, end_b``; ``loop_*`` hold the
    joint prediction per (scene, loop_id, side, frame_id) with side ``a`` or ``b``; ``chunk_*`` the
    window predictions. The joint prediction is registered to both chunks; the two results give the
    transform between the chunks.
    """
    by = list(by)
    keys = [*by, "loop_id"]

    def side(name: str) -> DataFrame:
        span = ranges.select(
            *keys, F.col(f"chunk_{name}").alias("window_id"), F.explode(F.sequence(F.col(f"start_{name}"), F.col(f"end_{name}") - 1)).alias("frame_id")
        )

        def chunk(df: DataFrame) -> DataFrame:
            rest = [c for c in df.columns if c not in (*by, "window_id", "frame_id", "pos")]
            return df.join(shuffled(span), [*by, "window_id", "frame_id"]).select(*keys, "frame_id", *rest)

        def joint(df: DataFrame) -> DataFrame:
            return df.where(F.col("side") == name).drop("side")

        fits = register_pairs(chunk(chunk_px), joint(loop_px), chunk(chunk_poses), joint(loop_poses), q, keys)
        return fits.select(*keys, F.struct("s", "r", "t").alias(f"g_{name}"), F.col("status").alias(f"status_{name}"))

    both = ranges.join(side("a"), keys, "left").join(side("b"), keys, "left")
    good = (F.col("status_a") == "ok") & (F.col("status_b") == "ok")
    return both.select(
        *by,
        F.col("chunk_a").alias("i"),
        F.col("chunk_b").alias("j"),
        F.when(good, C.sim3_between("g_a", "g_b")).alias("sim3"),
        F.when(good, "ok").otherwise(F.coalesce("status_a", "status_b", F.lit("no_overlap"))).alias("status"),
    )


# --- user models -----------------------------------------------------------------------------------


def score_windows(df: DataFrame, fn: Callable[[pd.DataFrame], pd.DataFrame], schema: StructType | str, by: Sequence[str] = ("scene", "window_id")) -> DataFrame:
    """Run a model on each window of frames; one group is one window, so its size is fixed.

    The windows are few bytes and much work: a fixed number of partitions keeps Spark from joining them into a few tasks.
    """
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(parts, *by).groupBy(*by).applyInPandas(fn, schema)


def map_frames(df: DataFrame, fn: Callable[[pd.DataFrame], pd.DataFrame], schema: StructType | str) -> DataFrame:
    """Run a per-frame operator on Arrow batches."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield fn(batch)

    return df.mapInPandas(run, schema)


def describe_frames(df: DataFrame, fn: Callable[[list], list], dims: int, content: str = "content", batch: int = 32) -> tuple[DataFrame, DataFrame]:
    """(descriptors, invalid): L2-normalised descriptors of frames, extracted in batches.

    ``fn`` maps a list of frame contents to a list of vectors, with ``None`` for frames it cannot
    read; those are flagged and kept out of the similarity join.
    """
    kinds = dict(df.dtypes)
    schema = f"scene {kinds['scene']}, frame_id {kinds['frame_id']}, embedding array<float>, valid boolean"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for at in range(0, len(pdf), batch):
                part = pdf.iloc[at : at + batch]
                found = fn(part[content].tolist())
                yield pd.DataFrame(
                    {
                        "scene": part["scene"].to_numpy(),
                        "frame_id": part["frame_id"].to_numpy(),
                        "embedding": [[0.0] * dims if v is None else [float(x) for x in v] for v in found],
                        "valid": [v is not None for v in found],
                    }
                )

    # written once: the model runs once per frame, although both results read its rows
    rows = cut(df.select("scene", "frame_id", content).mapInPandas(run, schema))
    size = F.sqrt(C.dot("embedding", "embedding"))
    usable = F.col("valid") & (size > 0)
    unit = rows.where(usable).withColumn("embedding", F.transform("embedding", lambda x: (x / size).cast("float")))
    return unit.select("scene", "frame_id", "embedding"), rows.where(~usable).select("scene", "frame_id")


def world_points(px: DataFrame, poses: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Local points to world points by the pose of their frame."""
    joined = attach(px, poses.select(*keys, "r", "t"), keys)
    moved = G.to_camera("r", "t", [F.col(a) for a in XYZ])
    rest = [c for c in px.columns if c not in XYZ]
    return joined.select(*rest, *[m.alias(a) for m, a in zip(moved, XYZ)])
