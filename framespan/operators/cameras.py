"""Geometry jobs on rasters, points and cameras.

Cameras and transforms are tables with one row per frame; every job joins them by key through the
size-checked ``attach``, so pixels stay where they are while the camera table is small.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from framespan.functions import columns as C
from framespan.functions import geometry as G
from framespan.functions import poses as P
from framespan.operators.joins import attach, shuffled
from framespan.operators.ranking import quantiles

FRAME = ("scene", "frame_id")
XYZ = ("x", "y", "z")


def pixels(rasters: DataFrame, values: Sequence[str] = ("depth", "conf")) -> DataFrame:
    """Raster rows to one row per pixel (v = idx div w, u = idx mod w)."""
    first, rest = values[0], values[1:]
    spread = rasters.select(*[c for c in rasters.columns if c not in values], *rest, F.posexplode(first).alias("_i", first))
    out = spread.withColumn("v", F.floor(F.col("_i") / F.col("w")).cast("int")).withColumn("u", (F.col("_i") % F.col("w")).cast("int"))
    for name in rest:
        out = out.withColumn(name, F.get(F.col(name), F.col("_i")))
    return out.drop("_i")


def confident_pixels(rasters: DataFrame, floor: float) -> DataFrame:
    """As :func:`pixels`, but pixels below the confidence floor are dropped before the explode."""
    zipped = F.arrays_zip("depth", "conf")
    indexed = F.transform(zipped, lambda p, i: F.struct(i.alias("i"), p["depth"].alias("depth"), p["conf"].alias("conf")))
    kept = F.filter(indexed, lambda p: p["conf"] >= floor)
    rest = [c for c in rasters.columns if c not in ("depth", "conf")]
    out = rasters.select(*rest, F.explode(kept).alias("_p"))
    return out.select(
        *rest,
        F.floor(F.col("_p.i") / F.col("w")).cast("int").alias("v"),
        (F.col("_p.i") % F.col("w")).cast("int").alias("u"),
        F.col("_p.depth").alias("depth"),
        F.col("_p.conf").alias("conf"),
    )


def unproject(
    px: DataFrame, cams: DataFrame, by: Sequence[str] = FRAME, min_depth: float = 1e-8, z_far: float | None = None, world: bool = False
) -> DataFrame:
    """Pixels with depth to camera points, or to world points when cameras carry a c2w pose (r, t).

    Pixels at or below ``min_depth`` (and beyond ``z_far``), NaN or NULL are invalid and dropped.
    """
    keep = (F.col("depth") > min_depth) & ~F.isnan("depth")
    if z_far is not None and z_far > 0:
        keep = keep & (F.col("depth") < z_far)
    joined = attach(px.where(keep), cams, by)
    x = (F.col("u") - F.col("cx")) * F.col("depth") / F.col("fx")
    y = (F.col("v") - F.col("cy")) * F.col("depth") / F.col("fy")
    point = [x, y, F.col("depth").cast("double")]
    if world:
        point = G.to_camera("r", "t", point)
    return joined.select(*px.columns, *[p.alias(a) for p, a in zip(point, XYZ)])


def transform_points(points: DataFrame, transforms: DataFrame, by: Sequence[str], inverse: bool = False) -> DataFrame:
    """Apply a per-group transform ``sim3`` (pose, similarity or rigid 4x4) to x, y, z."""
    g = C.sim3_inverse("sim3") if inverse else F.col("sim3")
    prepared = transforms.select(*by, g.alias("_g"))
    joined = attach(points, prepared, by)
    moved = C.sim3_apply("_g", [F.col(a) for a in XYZ])
    rest = [c for c in points.columns if c not in XYZ]
    return joined.select(*rest, *[m.alias(a) for m, a in zip(moved, XYZ)])


def project(points: DataFrame, cams: DataFrame, by: Sequence[str], default: float = 0.0) -> DataFrame:
    """World points to pixels (px, py) and camera depth; not-a-number results become ``default``.

    Cameras hold r, t (w2c), fx, fy, cx, cy and optionally ``dist`` with 0, 1, 2 or 4 parameters.
    """
    joined = attach(points, cams, by)
    xc, yc, zc = G.to_camera("r", "t", [F.col(a) for a in XYZ])
    cam = joined.withColumn("_xc", xc).withColumn("_yc", yc).withColumn("zc", zc)
    z = F.nullif(F.col("zc"), F.lit(0.0))
    u, v = F.col("_xc") / z, F.col("_yc") / z
    if "dist" in cams.columns:
        u, v = G.distortion(F.col("dist"), u, v)

    def safe(c: Column) -> Column:
        return F.coalesce(F.nanvl(c, F.lit(default)), F.lit(default))

    return cam.select(
        *points.columns,
        safe(u * F.col("fx") + F.col("cx")).alias("px"),
        safe(v * F.col("fy") + F.col("cy")).alias("py"),
        F.col("zc"),
    )


def reproject(observations: DataFrame, points: DataFrame, cams: DataFrame, scene: Sequence[str] = ("scene",)) -> DataFrame:
    """Reprojection error of each observation (scene, track_id, frame_id, ox, oy).

    Observations join their point and their camera by key; points and cameras are never crossed.
    """
    seen = observations.join(points.select(*scene, "track_id", *XYZ), [*scene, "track_id"])
    shown = project(seen, cams, [*scene, "frame_id"])
    error = F.sqrt(F.pow(F.col("px") - F.col("ox"), 2) + F.pow(F.col("py") - F.col("oy"), 2))
    return shown.withColumn("error", error)


def undistort(tracks: DataFrame, cams: DataFrame, by: Sequence[str], rounds: int = 12) -> DataFrame:
    """Pixel tracks (ox, oy) to undistorted normalised coordinates (nu, nv)."""
    joined = attach(tracks, cams, by)
    u, v = (F.col("ox") - F.col("cx")) / F.col("fx"), (F.col("oy") - F.col("cy")) / F.col("fy")
    if "dist" in cams.columns:
        flat = joined.withColumn("_n", G.undistortion(F.col("dist"), u, v, rounds))
    else:
        flat = joined.withColumn("_n", F.struct(u.alias("u"), v.alias("v")))
    return flat.select(*tracks.columns, F.col("_n.u").alias("nu"), F.col("_n.v").alias("nv"))


def convert_poses(df: DataFrame, source: str, target: str) -> DataFrame:
    """Convert between pose formats: ``matrix`` (r, t), ``tum`` (x..qz) and ``encoding`` (pose_enc)."""
    if source == target:
        return df
    if source == "tum":
        base = df.withColumn("r", P.matrix_from_quat(*[F.col(c) for c in ("qx", "qy", "qz", "qw")])).withColumn("t", C.vec(*XYZ))
        out = base.drop(*XYZ, "qw", "qx", "qy", "qz")
    elif source == "encoding":
        base = df.withColumn("_p", P.decode_pose("pose_enc", F.col("h"), F.col("w")))
        out = base.select(*[c for c in df.columns if c != "pose_enc"], "_p.*")
    else:
        out = df
    if target == "matrix":
        return out
    if target == "tum":
        q = P.quat_from_matrix("r")
        out = out.withColumn("_q", q)
        named = {a: F.col("t")[i] for i, a in enumerate(XYZ)} | {c: F.col("_q")[i] for c, i in (("qw", 3), ("qx", 0), ("qy", 1), ("qz", 2))}
        return out.select(*[c for c in out.columns if c not in ("r", "t", "_q")], *[v.alias(k) for k, v in named.items()])
    enc = P.encode_pose("r", "t", F.col("fx"), F.col("fy"), F.col("h"), F.col("w"))
    return out.withColumn("pose_enc", enc).drop("r", "t", "fx", "fy", "cx", "cy")


def convert_convention(df: DataFrame, source: str, target: str) -> DataFrame:
    """Frame conventions: ``c2w``, ``w2c`` (OpenCV), ``opengl`` (c2w, y and z flipped), ``pytorch3d``."""
    if source == target:
        return df

    def put(frame: DataFrame, r: Column, t: Column) -> DataFrame:
        return frame.withColumns({"r": r, "t": t})

    if source == "opengl":
        out = put(df, P.flip_columns("r", (1, 2)), F.col("t"))
    elif source == "w2c":
        out = put(df, *P.rigid_inverse("r", "t"))
    elif source == "pytorch3d":
        turned = put(
            df,
            C.transpose(P.flip_columns("r", (0, 1))),
            F.array(-F.col("t")[0], -F.col("t")[1], F.col("t")[2]),
        )
        out = put(turned, *P.rigid_inverse("r", "t"))
    else:
        out = df
    if target == "c2w":
        return out
    if target == "w2c":
        return put(out, *P.rigid_inverse("r", "t"))
    if target == "opengl":
        return put(out, P.flip_columns("r", (1, 2)), F.col("t"))
    raise ValueError(f"unknown target convention {target!r}")


def relative_to_first(poses: DataFrame, by: Sequence[str] = ("scene",), order: str = "frame_id") -> DataFrame:
    """Camera-to-world poses expressed in the first frame of their scene."""
    first = poses.groupBy(*by).agg(F.min_by(F.struct("r", "t"), order).alias("_first"))
    joined = attach(poses, first, by)
    back, shift = P.rigid_inverse("_first.r", "_first.t")
    moved = G.to_camera("_back", "_shift", C.components("t"))
    ready = joined.withColumns({"_back": back, "_shift": shift})
    return ready.withColumns({"r": C.mat_mul("_back", "r"), "t": F.array(*moved)}).select(*poses.columns)


def pixel_rays(cams: DataFrame, h: int, w: int, by: Sequence[str] = FRAME) -> DataFrame:
    """Unit viewing rays and Plücker normals (origin x direction) at pixel centres (+0.5)."""
    grid = cams.withColumn("v", F.explode(F.sequence(F.lit(0), F.lit(h - 1)))).withColumn("u", F.explode(F.sequence(F.lit(0), F.lit(w - 1))))
    ray = G.pixel_to_ray(F.col("u") + 0.5, F.col("v") + 0.5, F.col("fx"), F.col("fy"), F.col("cx"), F.col("cy"))
    named = grid.withColumns({f"_d{i}": c for i, c in enumerate(C.mat_vec("r", ray))})
    d = [F.col(f"_d{i}") for i in range(3)]
    size = C.norm(d)
    unit = [c / size for c in d]
    moment = C.cross(C.components("t"), unit)
    return named.select(
        *by, "v", "u", *[c.alias(f"d{a}") for c, a in zip(unit, XYZ)], *[c.alias(f"m{a}") for c, a in zip(moment, XYZ)]
    )


def _warp(px_a: DataFrame, cams: DataFrame, by: Sequence[str], carry: Sequence[str]) -> DataFrame:
    """Positions of the pixels of frame A in frame B: (bx, by_, depth computed in B)."""
    joined = attach(px_a, cams, by)
    d = F.col("depth")
    local = [(F.col("u") + 0.5 - F.col("cx_a")) * d / F.col("fx_a"), (F.col("v") + 0.5 - F.col("cy_a")) * d / F.col("fy_a"), d.cast("double")]
    moved = G.to_camera("r", "t", local)
    out = joined.withColumns({f"_m{i}": c for i, c in enumerate(moved)})
    # projection with the small constant that keeps a zero depth finite
    z = F.col("_m2") + 1e-4
    x = (F.col("fx_b") * F.col("_m0") + F.col("cx_b") * F.col("_m2")) / z
    y = (F.col("fy_b") * F.col("_m1") + F.col("cy_b") * F.col("_m2")) / z
    return out.select(*by, "v", "u", *carry, "h_b", "w_b", F.col("_m2").alias("depth_in_b"), x.alias("bx"), y.alias("b_y"))


def covisible(
    px_a: DataFrame, px_b: DataFrame, cams: DataFrame, by: Sequence[str], mode: str = "bilinear", threshold: float = 0.05
) -> DataFrame:
    """Which pixels of frame A are seen in frame B, and where.

    ``cams`` has one row per frame pair: fx_a.. cy_a, fx_b.. cy_b, r, t (A to B), h_b, w_b. A pixel
    counts when its depth is positive, it lands strictly inside B and the depth found there agrees
    within ``threshold``. ``nearest`` and ``bilinear`` join the hit pixels of B by key;
    ``combined`` fills what bilinear rejects from nearest.
    """
    if mode == "combined":
        bil = covisible(px_a, px_b, cams, by, "bilinear", threshold)
        nea = covisible(px_a, px_b, cams, by, "nearest", threshold).select(*by, "v", "u", F.col("valid").alias("_near"))
        both = bil.join(nea, [*by, "v", "u"])
        return both.withColumn("valid", F.col("valid") | F.col("_near")).drop("_near")
    by = list(by)
    warped = _warp(px_a, cams, by, ["depth"])
    inside = (F.col("bx") > 0) & (F.col("bx") < F.col("w_b") - 1) & (F.col("b_y") > 0) & (F.col("b_y") < F.col("h_b") - 1)
    seen = warped.withColumn("_ok", F.coalesce((F.col("depth") > 0) & inside, F.lit(False)))
    target = px_b.select(*by, F.col("v").alias("_tv"), F.col("u").alias("_tu"), F.col("depth").alias("_found"))
    if mode == "nearest":
        hit = seen.where("_ok").withColumn("_tv", F.floor("b_y").cast("int")).withColumn("_tu", F.floor("bx").cast("int"))
        sampled = hit.join(target, [*by, "_tv", "_tu"]).select(*by, "v", "u", "_found")
    elif mode == "bilinear":
        # pixel centres are at +0.5; corners outside the image count as zero depth
        x, y = F.col("bx") - 0.5, F.col("b_y") - 0.5
        x0, y0 = F.floor(x).cast("int"), F.floor(y).cast("int")
        fx, fy = x - x0, y - y0
        corners = F.array(
            F.struct(y0.alias("tv"), x0.alias("tu"), ((1 - fy) * (1 - fx)).alias("wt")),
            F.struct(y0.alias("tv"), (x0 + 1).alias("tu"), ((1 - fy) * fx).alias("wt")),
            F.struct((y0 + 1).alias("tv"), x0.alias("tu"), (fy * (1 - fx)).alias("wt")),
            F.struct((y0 + 1).alias("tv"), (x0 + 1).alias("tu"), (fy * fx).alias("wt")),
        )
        spread = seen.where("_ok").select(*by, "v", "u", F.explode(corners).alias("c")).select(
            *by, "v", "u", F.col("c.tv").alias("_tv"), F.col("c.tu").alias("_tu"), F.col("c.wt").alias("_wt")
        )
        sampled = (
            shuffled(spread).join(target, [*by, "_tv", "_tu"])
            .groupBy(*by, "v", "u")
            .agg(F.sum(F.col("_wt") * F.col("_found")).alias("_found"))
        )
    else:
        raise ValueError(f"unknown mode {mode!r}")
    out = seen.join(sampled, [*by, "v", "u"], "left")
    error = F.abs((F.col("_found") - F.col("depth_in_b")) / F.nullif(F.col("_found"), F.lit(0.0)))
    return out.select(
        *by, "v", "u", "bx", F.col("b_y").alias("by_px"), F.coalesce(F.col("_ok") & (error < threshold), F.lit(False)).alias("valid")
    )


def zbuffer(points: DataFrame, frames: DataFrame, by: Sequence[str] = FRAME) -> DataFrame:
    """Nearest depth per target pixel, 0 where nothing lands: (by, v, u, depth).

    ``points`` has pixel positions px, py and depth zc; ``frames`` has h, w per target frame.
    Pixel positions round half to even.
    """
    by = list(by)
    hits = points.select(*by, F.bround("py").cast("int").alias("v"), F.bround("px").cast("int").alias("u"), "zc")
    front = hits.where((F.col("v") >= 0) & (F.col("u") >= 0)).groupBy(*by, "v", "u").agg(F.min("zc").alias("depth"))
    grid = frames.select(*by, F.explode(F.sequence(F.lit(0), F.col("h") - 1)).alias("v"), "w")
    grid = grid.select(*by, "v", F.explode(F.sequence(F.lit(0), F.col("w") - 1)).alias("u"))
    joined = shuffled(grid).join(front, [*by, "v", "u"], "left")
    filled = F.when(F.col("depth") > 1e3, F.lit(0.0)).otherwise(F.coalesce("depth", F.lit(0.0)))
    return joined.withColumn("depth", filled)


def register_depth(px: DataFrame, cams: DataFrame, by: Sequence[str] = FRAME) -> DataFrame:
    """Move a depth sensor's pixels into the colour camera: (by, px, py, zc).

    ``cams`` holds the depth focal ``fd`` with size h, w, the sensor-to-sensor transform r, t and
    the colour focal ``fc`` with size ch, cw; both principal points are the image centres.
    """
    joined = attach(px.where((F.col("depth") > 0) & (F.col("depth") < 100)), cams, by)
    d = F.col("depth").cast("double")
    local = [(F.col("u") + 0.5 - F.col("w") / 2) / F.col("fd") * d, (F.col("v") + 0.5 - F.col("h") / 2) / F.col("fd") * d, d]
    out = joined.withColumns({f"_m{i}": c for i, c in enumerate(G.to_camera("r", "t", local))})
    return out.select(
        *by,
        (F.col("_m0") / F.col("_m2") * F.col("fc") + F.col("cw") / 2).alias("px"),
        (F.col("_m1") / F.col("_m2") * F.col("fc") + F.col("ch") / 2).alias("py"),
        F.col("_m2").alias("zc"),
    )


def resample_depth(px: DataFrame, cams: DataFrame, by: Sequence[str] = FRAME, keep: str = "last") -> DataFrame:
    """Sparse depth on an undistorted plane from normalised coordinates (nu, nv).

    ``cams`` holds the new fx, fy, cx, cy and h, w. Several pixels may hit one target: the last in
    source order (v, u) wins, or the nearest with ``keep='min'``. Pixels without a hit are absent.
    """
    by = list(by)
    good = (F.col("depth") > 0) & ~F.isnan("depth") & (F.abs(F.col("depth")) != float("inf"))
    joined = attach(px.where(good), cams, by)
    tu = F.bround(F.col("nu") * F.col("fx") + F.col("cx")).cast("int")
    tv = F.bround(F.col("nv") * F.col("fy") + F.col("cy")).cast("int")
    hits = joined.withColumn("tu", tu).withColumn("tv", tv).where(
        (F.col("tu") >= 0) & (F.col("tu") < F.col("w")) & (F.col("tv") >= 0) & (F.col("tv") < F.col("h"))
    )
    chosen = F.max_by("depth", F.struct("v", "u")) if keep == "last" else F.min("depth")
    return hits.groupBy(*by, "tv", "tu").agg(chosen.alias("depth")).withColumnsRenamed({"tv": "v", "tu": "u"})


def estimate_intrinsics(px: DataFrame, by: Sequence[str] = FRAME, eps: float = 1e-8) -> DataFrame:
    """Focal lengths from camera points (x, y, z at u, v): lower medians; centre is (w/2, h/2)."""
    by = list(by)
    cx, cy = F.col("w") / 2.0, F.col("h") / 2.0
    fx = (F.col("u") - cx) * F.col("z") / (F.col("x") + eps)
    fy = (F.col("v") - cy) * F.col("z") / (F.col("y") + eps)
    med = {"_m": (0.5, "lower")}
    a = quantiles(px, by, fx, med).select(*by, F.col("_m").alias("fx"))
    b = quantiles(px, by, fy, med).select(*by, F.col("_m").alias("fy"))
    shape = px.groupBy(*by).agg(F.max(cx).alias("cx"), F.max(cy).alias("cy"))
    return a.join(b, by).join(shape, by)


def scene_intrinsics(px: DataFrame, by: Sequence[str] = ("scene",)) -> DataFrame:
    """Reference intrinsics of a scene: those of frame 0 of window 0."""
    first = px.where((F.col("window_id") == 0) & (F.col("pos") == 0))
    return estimate_intrinsics(first, by)


def decode_outputs(rasters: DataFrame, kind: str) -> DataFrame:
    """Raw model outputs to local points per raster.

    ``log_depth``: arrays raw_x, raw_y, raw_z with z = exp(raw_z), x = raw_x*z, y = raw_y*z.
    ``depth``: depth and pose_enc already hold the values; the encoding becomes r, t, fx..cy.
    """
    if kind == "log_depth":
        z = F.transform("raw_z", lambda c: F.exp(c))
        out = rasters.withColumn("z", z)
        for a in ("x", "y"):
            out = out.withColumn(a, F.zip_with(F.col(f"raw_{a}"), F.col("z"), lambda p, q: p * q))
        return out.drop("raw_x", "raw_y", "raw_z")
    if kind == "depth":
        return convert_poses(rasters, "encoding", "matrix")
    raise ValueError(f"unknown output kind {kind!r}")


def normalize_scene(poses: DataFrame, points: DataFrame, by: Sequence[str] = ("scene",)) -> tuple[DataFrame, DataFrame, DataFrame]:
    """First-camera coordinates at unit mean distance: (poses, points, scales).

    ``poses`` are w2c (r, t); ``points`` world x, y, z with a ``valid`` flag. The scale is the mean
    distance of the valid points, sum/(count + 1e-3), clamped to [1e-3, 1e3].
    """
    by = list(by)
    first = poses.groupBy(*by).agg(F.min_by(F.struct("r", "t"), "frame_id").alias("_first"))
    moved = attach(points, first, by)
    local = G.to_camera("_first.r", "_first.t", [F.col(a) for a in XYZ])
    rest = [c for c in points.columns if c not in XYZ]
    near = moved.select(*rest, *[c.alias(a) for c, a in zip(local, XYZ)])
    dist = C.norm([F.col(a) for a in XYZ])
    scales = near.groupBy(*by).agg(
        C.clamp(
            F.coalesce(F.sum(F.when(F.col("valid"), dist)), F.lit(0.0)) / (F.count_if(F.col("valid")) + 1e-3), 1e-3, 1e3
        ).alias("scale")
    )
    new_points = attach(near, scales, by).select(*rest, *[(F.col(a) / F.col("scale")).alias(a) for a in XYZ])
    both = attach(attach(poses, first, by), scales, by)
    back, shift = P.rigid_inverse("_first.r", "_first.t")
    ready = both.withColumns({"_back": back, "_shift": shift})
    t = G.to_camera("r", "t", C.components("_shift"))
    new_poses = ready.withColumns({"_r": C.mat_mul("r", "_back"), "_t": F.array(*[c / F.col("scale") for c in t])}).select(
        *[c for c in poses.columns if c not in ("r", "t")], F.col("_r").alias("r"), F.col("_t").alias("t")
    )
    return new_poses, new_points, scales


def pad_to_largest(frames: DataFrame, by: Sequence[str] = ("scene",)) -> DataFrame:
    """Padding that brings every frame of a group to the largest height and width."""
    largest = frames.groupBy(*by).agg(F.max("height").alias("max_h"), F.max("width").alias("max_w"))
    joined = attach(frames, largest, by)
    return joined.withColumns(
        {
            "pad_top": F.floor((F.col("max_h") - F.col("height")) / 2),
            "pad_left": F.floor((F.col("max_w") - F.col("width")) / 2),
        }
    ).withColumns(
        {
            "pad_bottom": F.col("max_h") - F.col("height") - F.col("pad_top"),
            "pad_right": F.col("max_w") - F.col("width") - F.col("pad_left"),
        }
    )
