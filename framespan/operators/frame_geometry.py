"""Size, crop, pad and rotation bookkeeping of frames and their cameras (no pixels involved)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from framespan.functions import columns as C

PATCH = 14  # sizes are multiples of this
PIXEL_LIMIT = 255_000  # default largest number of pixels per frame
SHRINK_ROUNDS = 64


def target_size(width: Column, height: Column, limit: int = PIXEL_LIMIT) -> Column:
    """struct(w, h): nearest patch multiples whose area stays within ``limit``.

    Starting from the rounded sizes, the side that is too long for the aspect ratio shrinks by one
    patch until the area fits.
    """
    scale = F.when(width * height > 0, F.sqrt(F.lit(float(limit)) / (width * height))).otherwise(F.lit(1.0))
    ratio = (width * scale) / (height * scale)
    start = F.struct(
        F.bround(width * scale / PATCH).cast("long").alias("k"), F.bround(height * scale / PATCH).cast("long").alias("m")
    )

    def shrink(acc: Column, _: Column) -> Column:
        k, m = acc["k"], acc["m"]
        over = k * PATCH * m * PATCH > limit
        wide = F.coalesce(k / F.nullif(m, F.lit(0).cast("long")) > ratio, F.lit(True))
        return F.struct(
            F.when(over & wide, k - 1).otherwise(k).alias("k"), F.when(over & ~wide, m - 1).otherwise(m).alias("m")
        )

    fitted = F.aggregate(F.sequence(F.lit(1), F.lit(SHRINK_ROUNDS)), start, shrink)
    return F.struct(
        (F.greatest(F.lit(1), fitted["k"]) * PATCH).alias("w"), (F.greatest(F.lit(1), fitted["m"]) * PATCH).alias("h")
    )


def fit_to_limit(frames: DataFrame, limit: int = PIXEL_LIMIT) -> DataFrame:
    """Adds ``target_w``/``target_h`` from ``width``/``height``."""
    sized = frames.withColumn("_t", target_size(F.col("width"), F.col("height"), limit))
    return sized.select(*frames.columns, F.col("_t.w").alias("target_w"), F.col("_t.h").alias("target_h"))


def resize_to_width(frames: DataFrame, width: int, pixel_center: bool = True) -> DataFrame:
    """Resize to a fixed width (height a patch multiple) and update fx, fy, cx, cy.

    With ``pixel_center`` the principal point is shifted by half a pixel around the scaling. The
    scale is the larger of the two side ratios.
    """
    tall = F.bround(F.col("height") * (F.lit(float(width)) / F.col("width")) / PATCH).cast("long") * PATCH
    sized = frames.withColumn("target_w", F.lit(width).cast("long")).withColumn("target_h", tall)
    scale = F.greatest(F.col("target_w") / F.col("width"), F.col("target_h") / F.col("height"))
    half = 0.5 if pixel_center else 0.0
    return sized.withColumns(
        {
            "fx": F.col("fx") * scale,
            "fy": F.col("fy") * scale,
            "cx": (F.col("cx") + half) * scale - half,
            "cy": (F.col("cy") + half) * scale - half,
        }
    )


def square_boxes(frames: DataFrame, target: int = 1024) -> DataFrame:
    """Place of the original image after centre padding to a square and resizing to ``target``."""
    side = F.greatest("width", "height")
    left, top = F.floor((side - F.col("width")) / 2), F.floor((side - F.col("height")) / 2)
    scale = F.lit(float(target)) / side
    return frames.withColumns(
        {
            "x1": left * scale,
            "y1": top * scale,
            "x2": (left + F.col("width")) * scale,
            "y2": (top + F.col("height")) * scale,
        }
    )


def crop_to_shape(frames: DataFrame, target_h: int, target_w: int, strict: bool = False) -> DataFrame:
    """Crop window around the principal point and the shifted cx, cy.

    ``row0, col0, rows, cols`` describe the crop; with ``strict`` the size is exact and
    ``pad_rows``/``pad_cols`` say how much is missing. Frames smaller than the target are flagged
    ``too_small`` instead of failing the job.
    """
    h, w = F.col("height"), F.col("width")
    half_v = [F.lit(target_h / 2.0), F.col("cy").cast("double")]
    half_h = [F.lit(target_w / 2.0), F.col("cx").cast("double")]
    if not strict:
        half_v.append((h - F.col("cy")).cast("double"))
        half_h.append((w - F.col("cx")).cast("double"))
    hv, hh = F.floor(F.least(*half_v)), F.floor(F.least(*half_h))
    row0, col0 = F.floor("cy") - hv, F.floor("cx") - hh
    rows = F.lit(target_h).cast("long") if strict else 2 * hv
    cols = F.lit(target_w).cast("long") if strict else 2 * hh
    out = frames.withColumns({"row0": row0, "col0": col0, "_rows": rows, "_cols": cols})
    got_r = F.least(F.col("_rows"), h - F.col("row0"))
    got_c = F.least(F.col("_cols"), w - F.col("col0"))
    return out.withColumns(
        {
            "rows": got_r,
            "cols": got_c,
            "pad_rows": F.col("_rows") - got_r,
            "pad_cols": F.col("_cols") - got_c,
            "cx": F.col("cx") - F.col("col0"),
            "cy": F.col("cy") - F.col("row0"),
            "too_small": (h < target_h) | (w < target_w),
        }
    ).drop("_rows", "_cols")


def target_shape(img_size: int, aspect: Column, patch: int = PATCH) -> Column:
    """struct(h, w): height img_size*aspect cut to a patch multiple, width img_size."""
    short = F.floor(F.lit(img_size) * aspect)
    return F.struct((F.floor(short / patch) * patch).alias("h"), F.lit(img_size).cast("long").alias("w"))


def rotate_90(frames: DataFrame, clockwise: bool = True) -> DataFrame:
    """Camera of a frame turned by 90 degrees: width, height, fx, fy, cx, cy, r, t (w2c)."""
    turn = [0.0, -1.0, 0.0, 1.0, 0.0, 0.0, 0.0, 0.0, 1.0] if clockwise else [0.0, 1.0, 0.0, -1.0, 0.0, 0.0, 0.0, 0.0, 1.0]
    matrix = F.array(*[F.lit(x) for x in turn])
    h, w = F.col("height"), F.col("width")
    cx = h - F.col("cy") if clockwise else F.col("cy")
    cy = F.col("cx") if clockwise else w - F.col("cx")
    kept = [c for c in frames.columns if c not in ("fx", "fy", "cx", "cy", "width", "height", "r", "t")]
    return frames.select(
        *kept,
        h.alias("width"),
        w.alias("height"),
        F.col("fy").alias("fx"),
        F.col("fx").alias("fy"),
        cx.alias("cx"),
        cy.alias("cy"),
        C.mat_mul(matrix, "r").alias("r"),
        F.array(*C.mat_vec(matrix, C.components("t"))).alias("t"),
    )


def rotate_tracks_90(tracks: DataFrame, clockwise: bool = True) -> DataFrame:
    """Track coordinates (ox, oy) of frames turned by 90 degrees; needs width and height."""
    if clockwise:
        x, y = F.col("oy"), F.col("width") - 1 - F.col("ox")
    else:
        x, y = F.col("height") - 1 - F.col("oy"), F.col("ox")
    return tracks.withColumns({"ox": x, "oy": y})


def frame_geometry(frames: DataFrame, mode: str, **options) -> DataFrame:
    """One entry point for the jobs above: ``limit``, ``width``, ``square``, ``crop``, ``rotate``."""
    jobs = {"limit": fit_to_limit, "width": resize_to_width, "square": square_boxes, "crop": crop_to_shape, "rotate": rotate_90}
    if mode not in jobs:
        raise ValueError(f"unknown mode {mode!r}")
    return jobs[mode](frames, **options)
