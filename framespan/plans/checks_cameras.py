"""Queries: cameras, projections, tracks, frame geometry and dataset preparation."""

from __future__ import annotations

from pyspark.sql import functions as F

from framespan.functions import columns as C
from framespan.functions import poses as P
from framespan.operators import cameras as CA
from framespan.operators import datasets as D
from framespan.operators import frame_geometry as FG
from framespan.operators import tracks as TK
from framespan.plans.registry import PIXELS_SQL, pixels, query, table

# --- cameras per frame: focal, centre and a turn about z from the frame number ---------------------


def camera_frames(spark, sf):
    f = pixels(spark, sf).select("scene", "frame_id").distinct()
    a = F.col("frame_id") / 10.0
    c, s, z = F.cos(a), F.sin(a), F.lit(0.0)
    return f.select(
        "scene", "frame_id", (20.0 + F.col("frame_id") % 5).alias("fx"), F.lit(22.0).alias("fy"), F.lit(8.0).alias("cx"), F.lit(6.0).alias("cy"),
        F.array(c, -s, z, s, c, z, z, z, F.lit(1.0)).alias("r"), C.vec(F.col("frame_id") / 4.0, F.lit(-1.0), F.lit(2.0)).alias("t"),
    )


CAM_SQL = f"""{PIXELS_SQL}, cam AS (SELECT DISTINCT scene, frame_id, 20.0 + frame_id % 5 AS fx, 22.0 AS fy, 8.0 AS cx, 6.0 AS cy, cos(frame_id / 10.0) AS c, sin(frame_id / 10.0) AS s, frame_id / 4.0 AS tx, -1.0 AS ty, 2.0 AS tz FROM px)"""
UNPROJ_SQL = f"""{CAM_SQL}, cp AS (SELECT p.frame_id, v, u, (u - cx) * depth / fx AS xc, (v - cy) * depth / fy AS yc, depth AS zc, c, s, tx, ty, tz, fx, fy, cx, cy FROM px p JOIN cam USING (frame_id) WHERE depth > 1e-8 AND depth < 200)"""


def rounded(df, *names, digits=5):
    return df.withColumns({n: F.round(F.col(n), digits) + 0.0 for n in names})


@query(
    "unproject_world",
    f"WITH {UNPROJ_SQL} SELECT frame_id, v, u, round(c*xc - s*yc + tx, 5) + 0.0 AS x, round(s*xc + c*yc + ty, 5) + 0.0 AS y, round(zc + tz, 5) + 0.0 AS z FROM cp",
)
def unproject_world(spark, sf):
    out = CA.unproject(pixels(spark, sf), camera_frames(spark, sf), z_far=200.0, world=True)
    return rounded(out.select("frame_id", "v", "u", "x", "y", "z"), "x", "y", "z")


@query(
    "transform_points_inverse",
    f"WITH {UNPROJ_SQL} SELECT frame_id, v, u, round(c*(xc-tx) + s*(yc-ty), 5) + 0.0 AS x, round(-s*(xc-tx) + c*(yc-ty), 5) + 0.0 AS y, round(zc - tz, 5) + 0.0 AS z FROM cp",
)
def transform_points_inverse(spark, sf):
    cams = camera_frames(spark, sf)
    pts = CA.unproject(pixels(spark, sf), cams, z_far=200.0)
    tf = cams.select("scene", "frame_id", C.sim3(F.lit(1.0), "r", "t").alias("sim3"))
    return rounded(CA.transform_points(pts, tf, ["scene", "frame_id"], inverse=True).select("frame_id", "v", "u", "x", "y", "z"), "x", "y", "z")


@query(
    "project",
    f"""WITH {UNPROJ_SQL}, d AS (SELECT *, (c*xc - s*yc + tx) / (zc + tz) AS a, (s*xc + c*yc + ty) / (zc + tz) AS b FROM cp), e AS (SELECT *, a*a + b*b AS r2 FROM d)
SELECT frame_id, v, u, round((a + a*(0.1*r2 + 0.02*r2*r2) + 2*0.001*a*b - 0.002*(r2 + 2*a*a)) * fx + cx, 4) + 0.0 AS px, round((b + b*(0.1*r2 + 0.02*r2*r2) - 2*0.002*a*b + 0.001*(r2 + 2*b*b)) * fy + cy, 4) + 0.0 AS py FROM e""",
)
def project(spark, sf):
    cams = camera_frames(spark, sf).withColumn("dist", F.array(F.lit(0.1), F.lit(0.02), F.lit(0.001), F.lit(-0.002)))
    pts = CA.unproject(pixels(spark, sf), camera_frames(spark, sf), z_far=200.0)
    out = CA.project(pts, cams, ["scene", "frame_id"])
    return rounded(out.select("frame_id", "v", "u", "px", "py"), "px", "py", digits=4)


@query("undistort_roundtrip", f"WITH {PIXELS_SQL} SELECT frame_id, v, u, round((u - 8) / 40.0, 5) + 0.0 AS nu, round((v - 6) / 40.0, 5) + 0.0 AS nv FROM px")
def undistort_roundtrip(spark, sf):
    """Distorting a point and undistorting the pixel gives back the point."""
    from framespan.functions import geometry as GM

    dist = F.array(F.lit(0.08), F.lit(0.01), F.lit(0.001), F.lit(-0.002))
    px = pixels(spark, sf).select("scene", "frame_id", "v", "u")
    a, b = GM.distortion(dist, (F.col("u") - 8) / 40.0, (F.col("v") - 6) / 40.0)
    tracks = px.withColumn("ox", a * 30 + 8).withColumn("oy", b * 30 + 6)
    cams = camera_frames(spark, sf).select("scene", "frame_id", F.lit(30.0).alias("fx"), F.lit(30.0).alias("fy"), "cx", "cy", dist.alias("dist"))
    out = CA.undistort(tracks, cams, ["scene", "frame_id"])
    return rounded(out.select("frame_id", "v", "u", "nu", "nv"), "nu", "nv")


@query(
    "pose_roundtrip",
    """SELECT event_id, list_transform([cos(value/50), -sin(value/50), 0.0, 0.8 * sin(value/50), 0.8 * cos(value/50), -0.6, 0.6 * sin(value/50), 0.6 * cos(value/50), 0.8], lambda x: round(x, 6) + 0.0) AS r,
 round(16 / (2 * tan(atan(16 / (2 * (100.0 + event_id % 7))))), 5) AS fx FROM events""",
)
def pose_roundtrip(spark, sf):
    """Matrix to encoding to matrix, and matrix to TUM quaternion to matrix, change nothing."""
    a = F.col("value") / 50
    c, s, z = F.cos(a), F.sin(a), F.lit(0.0)
    m = F.array(c, -s, z, 0.8 * s, 0.8 * c, F.lit(-0.6), 0.6 * s, 0.6 * c, F.lit(0.8))
    ev = table(spark, sf, "events").select(
        "event_id", m.alias("r"), C.vec(F.col("value"), F.lit(1.0), F.lit(2.0)).alias("t"), (100.0 + F.col("event_id") % 7).alias("fx"), F.lit(90.0).alias("fy"),
        F.lit(8.0).alias("cx"), F.lit(6.0).alias("cy"), F.lit(12).alias("h"), F.lit(16).alias("w"),
    )
    coded = CA.convert_poses(CA.convert_poses(ev, "matrix", "encoding"), "encoding", "matrix")
    tum = CA.convert_poses(CA.convert_poses(coded, "matrix", "tum"), "tum", "matrix")
    return tum.select("event_id", F.transform("r", lambda x: F.round(x, 6) + 0.0).alias("r"), F.round("fx", 5).alias("fx"))


@query(
    "pose_quaternion",
    """SELECT event_id, CASE WHEN cos(value / 100) < 0 THEN -1 ELSE 1 END * round(sin(value / 100), 6) + 0.0 AS qz, round(abs(cos(value / 100)), 6) AS qw FROM events""",
)
def pose_quaternion(spark, sf):
    a = F.col("value") / 50
    c, s, z = F.cos(a), F.sin(a), F.lit(0.0)
    q = P.quat_from_matrix(F.array(c, -s, z, s, c, z, z, z, F.lit(1.0)))
    ev = table(spark, sf, "events").select("event_id", q.alias("q"))
    return ev.select("event_id", (F.round(F.col("q")[2], 6) + 0.0).alias("qz"), F.round(F.col("q")[3], 6).alias("qw"))


@query(
    "convention_relative",
    f"""WITH {CAM_SQL}, f AS (SELECT scene, c AS c0, s AS s0, tx AS x0 FROM cam QUALIFY row_number() OVER (PARTITION BY scene ORDER BY frame_id) = 1)
SELECT frame_id, round(c0*c + s0*s, 6) + 0.0 AS r0, round(c0*(tx-x0), 6) + 0.0 AS t0, round(-s0*(tx-x0), 6) + 0.0 AS t1 FROM cam JOIN f USING (scene)""",
)
def convention_relative(spark, sf):
    """Round trip through OpenGL and w2c, then poses relative to the first frame."""
    cams = camera_frames(spark, sf)
    back = CA.convert_convention(CA.convert_convention(CA.convert_convention(CA.convert_convention(cams, "c2w", "opengl"), "opengl", "c2w"), "c2w", "w2c"), "w2c", "c2w")
    out = CA.relative_to_first(back)
    return rounded(out.select("frame_id", F.col("r")[0].alias("r0"), F.col("t")[0].alias("t0"), F.col("t")[1].alias("t1")), "r0", "t0", "t1", digits=6)


@query(
    "pixel_rays",
    f"""WITH {CAM_SQL}, g AS (SELECT cam.*, tv AS v, tu AS u, (tu + 0.5 - cx) / fx AS a, (tv + 0.5 - cy) / fy AS b FROM cam, (SELECT unnest(generate_series(0, 5)) AS tv), (SELECT unnest(generate_series(0, 7)) AS tu)),
d AS (SELECT *, (c*a - s*b) / sqrt(a*a + b*b + 1) AS dx, (s*a + c*b) / sqrt(a*a + b*b + 1) AS dy, 1 / sqrt(a*a + b*b + 1) AS dz FROM g)
SELECT frame_id, CAST(v AS INT) AS v, CAST(u AS INT) AS u, round(dx, 6) + 0.0 AS dx, round(dz, 6) + 0.0 AS dz, round(ty*dz - tz*dy, 5) + 0.0 AS mx, round(tx*dy - ty*dx, 5) + 0.0 AS mz FROM d""",
)
def pixel_rays(spark, sf):
    out = CA.pixel_rays(camera_frames(spark, sf), 6, 8)
    return rounded(rounded(out.select("frame_id", "v", "u", "dx", "dz", "mx", "mz"), "dx", "dz", digits=6), "mx", "mz")


def pair_cameras(spark, sf):
    """Frame f and frame f+1 of a scene, joined by a small shift."""
    f = pixels(spark, sf).select("frame_id").distinct()
    return f.select(
        "frame_id", *[F.lit(v).alias(n) for n, v in (("fx_a", 20.0), ("fy_a", 20.0), ("cx_a", 8.0), ("cy_a", 6.0), ("fx_b", 20.0), ("fy_b", 20.0), ("cx_b", 8.0), ("cy_b", 6.0))],
        C.identity_matrix().alias("r"), C.vec(F.lit(3.0), F.lit(-2.0), F.lit(1.0)).alias("t"), F.lit(12).alias("h_b"), F.lit(16).alias("w_b"),
    )


WARP_SQL = f"""{PIXELS_SQL}, wp AS (SELECT frame_id, v, u, depth, (20.0*((u+0.5-8.0)*depth/20.0+3.0) + 8.0*(depth+1.0)) / (depth+1.0+1e-4) AS bx, (20.0*((v+0.5-6.0)*depth/20.0-2.0) + 6.0*(depth+1.0)) / (depth+1.0+1e-4) AS b_y, depth+1.0 AS dz FROM px),
ok AS (SELECT *, depth > 0 AND bx > 0 AND bx < 15 AND b_y > 0 AND b_y < 11 AS inside FROM wp), nx AS (SELECT frame_id - 1 AS frame_id, v, u, depth FROM px)"""


def _covisible(spark, sf, mode):
    px = pixels(spark, sf).select("frame_id", "v", "u", "depth")
    out = CA.covisible(px, px.withColumn("frame_id", F.col("frame_id") - 1), pair_cameras(spark, sf), ["frame_id"], mode, 0.5)
    return out.select("frame_id", "v", "u", "valid")


NEAREST_VALID = """nv AS (SELECT o.frame_id, o.v, o.u, coalesce(inside AND abs((n.depth - dz) / nullif(n.depth, 0)) < 0.5, false) AS valid FROM ok o LEFT JOIN nx n ON n.frame_id = o.frame_id AND n.v = floor(b_y) AND n.u = floor(bx))"""
BILINEAR_VALID = """k AS (SELECT frame_id, v, u, floor(b_y - 0.5) + dv AS cv, floor(bx - 0.5) + du AS cu, (CASE WHEN dv = 1 THEN b_y - 0.5 - floor(b_y - 0.5) ELSE 1 - (b_y - 0.5 - floor(b_y - 0.5)) END) * (CASE WHEN du = 1 THEN bx - 0.5 - floor(bx - 0.5) ELSE 1 - (bx - 0.5 - floor(bx - 0.5)) END) AS wt
  FROM ok, (SELECT unnest([0, 1]) AS dv), (SELECT unnest([0, 1]) AS du) WHERE inside),
bs AS (SELECT k.frame_id, k.v, k.u, sum(wt * n.depth) AS found FROM k JOIN nx n ON n.frame_id = k.frame_id AND n.v = cv AND n.u = cu GROUP BY 1, 2, 3),
bv AS (SELECT o.frame_id, o.v, o.u, coalesce(inside AND abs((found - dz) / nullif(found, 0)) < 0.5, false) AS valid FROM ok o LEFT JOIN bs ON bs.frame_id = o.frame_id AND bs.v = o.v AND bs.u = o.u)"""


@query("covisible_nearest", f"WITH {WARP_SQL}, {NEAREST_VALID} SELECT * FROM nv")
def covisible_nearest(spark, sf):
    return _covisible(spark, sf, "nearest")


@query("covisible_combined", f"WITH {WARP_SQL}, {NEAREST_VALID}, {BILINEAR_VALID} SELECT frame_id, v, u, nv.valid OR bv.valid AS valid FROM nv JOIN bv USING (frame_id, v, u)")
def covisible_combined(spark, sf):
    return _covisible(spark, sf, "combined")


@query(
    "zbuffer",
    f"""WITH {PIXELS_SQL}, h AS (SELECT frame_id, CAST(round_even(v * 0.5 + 0.2, 0) AS INT) AS v, CAST(round_even(u * 0.45 + 0.1, 0) AS INT) AS u, depth FROM px), m AS (SELECT frame_id, v, u, min(depth) AS depth FROM h GROUP BY 1, 2, 3),
f AS (SELECT DISTINCT frame_id FROM px), g AS (SELECT frame_id, CAST(v AS INT) AS v, CAST(u AS INT) AS u FROM f, (SELECT unnest(generate_series(0, 6)) AS v), (SELECT unnest(generate_series(0, 8)) AS u))
SELECT frame_id, v, u, coalesce(depth, 0.0) AS depth FROM g LEFT JOIN m USING (frame_id, v, u)""",
)
def zbuffer(spark, sf):
    px = pixels(spark, sf)
    pts = px.select("scene", "frame_id", (F.col("u") * 0.45 + 0.1).alias("px"), (F.col("v") * 0.5 + 0.2).alias("py"), F.col("depth").alias("zc"))
    grid = px.select("scene", "frame_id").distinct().withColumn("h", F.lit(7)).withColumn("w", F.lit(9))
    return CA.zbuffer(pts, grid).select("frame_id", "v", "u", "depth")


@query(
    "register_depth",
    f"""WITH {PIXELS_SQL}, a AS (SELECT frame_id, (u + 0.5 - 8.0) / 58.5 * depth + 0.1 AS x, (v + 0.5 - 6.0) / 58.5 * depth - 0.05 AS y, depth + 0.2 AS z FROM px WHERE depth > 0 AND depth < 100)
SELECT frame_id, count(*) AS n, round(sum(x / z * 52.5 + 8.0), 3) AS sum_px, round(sum(y / z * 52.5 + 6.0), 3) AS sum_py, round(max(z), 5) AS max_z FROM a GROUP BY 1""",
)
def register_depth(spark, sf):
    cams = camera_frames(spark, sf).select(
        "scene", "frame_id", F.lit(58.5).alias("fd"), F.lit(52.5).alias("fc"), F.lit(12.0).alias("h"), F.lit(16.0).alias("w"), F.lit(12.0).alias("ch"), F.lit(16.0).alias("cw"),
        C.identity_matrix().alias("r"), C.vec(F.lit(0.1), F.lit(-0.05), F.lit(0.2)).alias("t"),
    )
    out = CA.register_depth(pixels(spark, sf), cams)
    return out.groupBy("frame_id").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("px"), 3).alias("sum_px"), F.round(F.sum("py"), 3).alias("sum_py"), F.round(F.max("zc"), 5).alias("max_z"))


@query(
    "resample_depth",
    f"""WITH {PIXELS_SQL}, h AS (SELECT frame_id, CAST(round_even((v - 6) / 20.0 * 12.0 + 4.1, 0) AS INT) AS tv, CAST(round_even((u - 8) / 20.0 * 10.0 + 4.2, 0) AS INT) AS tu, v, u, depth FROM px WHERE depth > 0)
SELECT frame_id, tv AS v, tu AS u, arg_max(depth, v * 100 + u) AS depth FROM h WHERE tv BETWEEN 0 AND 6 AND tu BETWEEN 0 AND 7 GROUP BY 1, 2, 3""",
)
def resample_depth(spark, sf):
    px = pixels(spark, sf).withColumn("nu", (F.col("u") - 8) / 20.0).withColumn("nv", (F.col("v") - 6) / 20.0)
    cams = camera_frames(spark, sf).select("scene", "frame_id", F.lit(10.0).alias("fx"), F.lit(12.0).alias("fy"), F.lit(4.2).alias("cx"), F.lit(4.1).alias("cy"), F.lit(7).alias("h"), F.lit(8).alias("w"))
    return CA.resample_depth(px, cams).select("frame_id", "v", "u", "depth")


@query(
    "estimate_intrinsics",
    f"""WITH {UNPROJ_SQL}, e AS (SELECT frame_id, (u - 8.0) * zc / (xc + conf_shift + 1e-8) AS fx, (v - 6.0) * zc / (yc + conf_shift + 1e-8) AS fy FROM (SELECT *, zc / 500.0 AS conf_shift FROM cp))
SELECT frame_id, round(quantile_disc(fx, 0.5), 5) + 0.0 AS fx, round(quantile_disc(fy, 0.5), 5) + 0.0 AS fy FROM e GROUP BY 1""",
)
def estimate_intrinsics(spark, sf):
    pts = CA.unproject(pixels(spark, sf), camera_frames(spark, sf), z_far=200.0)
    pts = pts.withColumn("h", F.lit(12)).withColumn("w", F.lit(16)).withColumns({"x": F.col("x") + F.col("z") / 500.0, "y": F.col("y") + F.col("z") / 500.0})
    return rounded(CA.estimate_intrinsics(pts).select("frame_id", "fx", "fy"), "fx", "fy")


@query(
    "decode_outputs",
    f"""WITH {PIXELS_SQL} SELECT frame_id, round(sum(exp(depth / 100)), 4) AS sum_z, round(sum((conf / 50 - 1) * exp(depth / 100)), 4) AS sum_x FROM px GROUP BY 1""",
)
def decode_outputs(spark, sf):
    cell = F.struct((F.col("v") * 16 + F.col("u")).alias("i"), "depth", "conf")
    r = pixels(spark, sf).groupBy("frame_id").agg(F.array_sort(F.collect_list(cell)).alias("c"))
    r = r.select("frame_id", F.transform("c", lambda c: c["depth"] / 100).alias("raw_z"), F.transform("c", lambda c: c["conf"] / 50 - 1).alias("raw_x"), F.transform("c", lambda c: c["conf"] * 0).alias("raw_y"))
    out = CA.decode_outputs(r, "log_depth")

    def add(c):
        return F.round(F.aggregate(c, F.lit(0.0), lambda a, x: a + x), 4)

    return out.select("frame_id", add("z").alias("sum_z"), add("x").alias("sum_x"))


@query(
    "normalize_scene",
    f"""WITH {CAM_SQL}, f AS (SELECT scene, c, s, tx, ty, tz FROM cam QUALIFY row_number() OVER (PARTITION BY scene ORDER BY frame_id) = 1),
p AS (SELECT px.scene, frame_id, v, u, conf > 30 AS valid, f.c*u - f.s*v + f.tx AS x, f.s*u + f.c*v + f.ty AS y, depth + f.tz AS z FROM px JOIN f USING (scene)),
sc AS (SELECT scene, least(greatest(coalesce(sum(sqrt(x*x+y*y+z*z)) FILTER (WHERE valid), 0) / (count(*) FILTER (WHERE valid) + 1e-3), 1e-3), 1e3) AS scale FROM p GROUP BY 1)
SELECT frame_id, v, u, round(x / scale, 6) + 0.0 AS x, round(z / scale, 6) + 0.0 AS z FROM p JOIN sc USING (scene)""",
)
def normalize_scene(spark, sf):
    pts = pixels(spark, sf).select("scene", "frame_id", "v", "u", (F.col("conf") > 30).alias("valid"), F.col("u").cast("double").alias("x"), F.col("v").cast("double").alias("y"), F.col("depth").alias("z"))
    out = CA.normalize_scene(camera_frames(spark, sf), pts)[1]
    return rounded(out.select("frame_id", "v", "u", "x", "z"), "x", "z", digits=6)


NORMAL_SQL = f"""{CAM_SQL}, f AS (SELECT scene, c, s, tx, ty, tz FROM cam QUALIFY row_number() OVER (PARTITION BY scene ORDER BY frame_id) = 1),
p AS (SELECT px.scene, conf > 30 AS valid, f.c*u - f.s*v + f.tx AS x, f.s*u + f.c*v + f.ty AS y, depth + f.tz AS z FROM px JOIN f USING (scene)),
sc AS (SELECT scene, least(greatest(coalesce(sum(sqrt(x*x+y*y+z*z)) FILTER (WHERE valid), 0) / (count(*) FILTER (WHERE valid) + 1e-3), 1e-3), 1e3) AS scale FROM p GROUP BY 1)"""


def normalized(spark, sf):
    pts = pixels(spark, sf).select("scene", "frame_id", "v", "u", (F.col("conf") > 30).alias("valid"), F.col("u").cast("double").alias("x"), F.col("v").cast("double").alias("y"), F.col("depth").alias("z"))
    return CA.normalize_scene(camera_frames(spark, sf), pts)


@query("normalize_scene_scales", f"WITH {NORMAL_SQL} SELECT scene, round(scale, 6) AS scale FROM sc")
def normalize_scene_scales(spark, sf):
    return rounded(normalized(spark, sf)[2], "scale", digits=6)


@query(
    "normalize_scene_poses",
    f"""WITH {NORMAL_SQL}, b AS (SELECT scene, c, s, -(c*tx + s*ty) AS x, s*tx - c*ty AS y, -tz AS z FROM f)
SELECT scene, frame_id, round(cam.c*b.c + cam.s*b.s, 6) + 0.0 AS r0, round(cam.s*b.c - cam.c*b.s, 6) + 0.0 AS r3, round((cam.c*b.x - cam.s*b.y + cam.tx) / scale, 6) + 0.0 AS tx,
 round((cam.s*b.x + cam.c*b.y + cam.ty) / scale, 6) + 0.0 AS ty, round((b.z + cam.tz) / scale, 6) + 0.0 AS tz FROM cam JOIN b USING (scene) JOIN sc USING (scene)""",
)
def normalize_scene_poses(spark, sf):
    r, t = F.col("r"), F.col("t")
    cells = {"r0": r[0], "r3": r[3], "tx": t[0], "ty": t[1], "tz": t[2]}
    return normalized(spark, sf)[0].select("scene", "frame_id", *[(F.round(c, 6) + 0.0).alias(n) for n, c in cells.items()])


# --- tracks and observations: line items observed in frames (suppliers) ------------------------------


TRACK_SQL = """tk AS (SELECT l_suppkey % 4 AS scene, l_partkey AS track_id, l_suppkey // 4 AS frame_id, avg(l_quantity) AS x, avg(l_discount) * 1000 AS y, max(l_tax) * 10 AS vis FROM lineitem GROUP BY 1, 2, 3)"""


def tracks(spark, sf):
    return table(spark, sf, "lineitem").groupBy((F.col("l_suppkey") % 4).alias("scene"), F.col("l_partkey").alias("track_id"), F.floor(F.col("l_suppkey") / 4).alias("frame_id")).agg(
        F.avg("l_quantity").alias("x"), (F.avg("l_discount") * 1000).alias("y"), (F.max("l_tax") * 10).alias("vis")
    )


@query("weak_frames", f"WITH {TRACK_SQL} SELECT scene, frame_id, count(*) FILTER (WHERE vis > 0.1) AS n_visible FROM tk GROUP BY 1, 2 HAVING count(*) FILTER (WHERE vis > 0.1) < 500")
def weak_frames(spark, sf):
    return TK.weak_frames(tracks(spark, sf))


@query(
    "track_first_seen",
    f"""WITH {TRACK_SQL}, s AS (SELECT * FROM tk WHERE vis > 0.4 QUALIFY row_number() OVER (PARTITION BY scene, track_id ORDER BY frame_id) = 1), a AS (SELECT DISTINCT scene, track_id FROM tk)
SELECT a.scene, a.track_id, s.frame_id, round(x, 6) AS x, round(y, 6) AS y, round((x / 49.0 + y / 99.0) / 2, 6) AS color_key FROM a LEFT JOIN s USING (scene, track_id)""",
)
def track_first_seen(spark, sf):
    return TK.track_first_seen(tracks(spark, sf), 50, 100, 0.4).select("scene", "track_id", "frame_id", *[F.round(c, 6).alias(c) for c in ("x", "y", "color_key")])


OBS_SQL = f"""{TRACK_SQL}, pt AS (SELECT scene, track_id, track_id % 40 - 20.0 AS x, track_id % 30 - 15.0 AS y, 50.0 + track_id % 11 AS z FROM (SELECT DISTINCT scene, track_id FROM tk)),
cm AS (SELECT DISTINCT scene, frame_id, frame_id * 0.1 AS tx FROM tk),
ob AS (SELECT tk.scene, track_id, frame_id, 100.0 * (pt.x + tx) / (pt.z + 1) + 50 + tk.vis * 8 - 2 AS ox, 100.0 * pt.y / (pt.z + 1) + 40 + (tk.x - 25) / 10 AS oy, 100.0 * (pt.x + tx) / (pt.z + 1) + 50 AS qx, 100.0 * pt.y / (pt.z + 1) + 40 AS qy
  FROM tk JOIN pt USING (scene, track_id) JOIN cm USING (scene, frame_id)),
er AS (SELECT *, sqrt(pow(qx - ox, 2) + pow(qy - oy, 2)) AS error FROM ob)"""


def observation_inputs(spark, sf):
    tk = tracks(spark, sf)
    n = F.col("track_id")
    pts = tk.select("scene", "track_id").distinct().select("scene", "track_id", (n % 40 - 20.0).alias("x"), (n % 30 - 15.0).alias("y"), (50.0 + n % 11).alias("z"))
    cams = tk.select("scene", "frame_id").distinct().select(
        "scene", "frame_id", F.lit(100.0).alias("fx"), F.lit(100.0).alias("fy"), F.lit(50.0).alias("cx"), F.lit(40.0).alias("cy"), C.identity_matrix().alias("r"),
        C.vec(F.col("frame_id") * 0.1, F.lit(0.0), F.lit(1.0)).alias("t"),
    )
    seen = tk.join(pts.withColumnsRenamed({"x": "X", "y": "Y", "z": "Z"}).select("scene", "track_id", F.col("X").alias("p0"), F.col("Y").alias("p1"), F.col("Z").alias("p2")), ["scene", "track_id"])
    obs = seen.select(
        "scene", "track_id", "frame_id", (100.0 * (F.col("p0") + F.col("frame_id") * 0.1) / (F.col("p2") + 1) + 50 + F.col("vis") * 8 - 2).alias("ox"),
        (100.0 * F.col("p1") / (F.col("p2") + 1) + 40 + (F.col("x") - 25) / 10).alias("oy"),
    )
    return obs, pts, cams


@query("reproject", f"WITH {OBS_SQL} SELECT scene, track_id, frame_id, round(error, 5) AS error FROM er")
def reproject(spark, sf):
    out = CA.reproject(*observation_inputs(spark, sf))
    return out.select("scene", "track_id", "frame_id", F.round("error", 5).alias("error"))


@query(
    "observations",
    f"""WITH {OBS_SQL}, il AS (SELECT * FROM er WHERE error < 2.47), fr AS (SELECT cm.scene, cm.frame_id, count(track_id) AS n FROM cm LEFT JOIN il ON il.scene = cm.scene AND il.frame_id = cm.frame_id GROUP BY 1, 2),
ok AS (SELECT scene FROM fr GROUP BY 1 HAVING min(n) >= 20), us AS (SELECT * FROM il WHERE scene IN (SELECT scene FROM ok)),
tr AS (SELECT scene, track_id, row_number() OVER (PARTITION BY scene ORDER BY track_id) AS point_id FROM us GROUP BY 1, 2 HAVING count(*) >= 2)
SELECT us.scene, us.frame_id + 1 AS image_id, row_number() OVER (PARTITION BY us.scene, us.frame_id ORDER BY point_id) - 1 AS point2d_idx, round(ox, 5) AS ox, round(oy, 5) AS oy, point_id FROM us JOIN tr USING (scene, track_id)""",
)
def observations(spark, sf):
    obs, pts, cams = observation_inputs(spark, sf)
    out = TK.observations(obs, pts, cams, max_error=2.47, min_per_frame=20)["observations"]
    return out.select("scene", "image_id", "point2d_idx", F.round("ox", 5).alias("ox"), F.round("oy", 5).alias("oy"), "point_id")


KEPT_SQL = f"""{OBS_SQL}, il AS (SELECT * FROM er WHERE error < 2.47), fr AS (SELECT cm.scene, cm.frame_id, count(track_id) AS n FROM cm LEFT JOIN il ON il.scene = cm.scene AND il.frame_id = cm.frame_id GROUP BY 1, 2),
weak AS (SELECT scene, min(n) AS min_inliers FROM fr GROUP BY 1)"""


@query(
    "observation_points",
    f"""WITH {KEPT_SQL}, us AS (SELECT * FROM il WHERE scene IN (SELECT scene FROM weak WHERE min_inliers >= 20)),
tr AS (SELECT scene, track_id, count(*) AS n_inliers, row_number() OVER (PARTITION BY scene ORDER BY track_id) AS point_id FROM us GROUP BY 1, 2 HAVING count(*) >= 2)
SELECT scene, track_id, point_id, n_inliers, x, y, z FROM tr JOIN pt USING (scene, track_id)""",
)
def observation_points(spark, sf):
    obs, pts, cams = observation_inputs(spark, sf)
    return TK.observations(obs, pts, cams, max_error=2.47, min_per_frame=20)["points"].select("scene", "track_id", "point_id", "n_inliers", "x", "y", "z")


@query("observation_rejects", f"WITH {KEPT_SQL} SELECT scene, min_inliers FROM weak WHERE min_inliers < 1000")
def observation_rejects(spark, sf):
    """Scenes with a frame of fewer inliers than asked for; the bar is set where scenes fail."""
    obs, pts, cams = observation_inputs(spark, sf)
    return TK.observations(obs, pts, cams, max_error=2.47, min_per_frame=1000)["rejected"]


@query(
    "observations_direct",
    """WITH p AS (SELECT event_type AS scene, event_id, value AS px, user_id AS frame_id, row_number() OVER (PARTITION BY event_type ORDER BY event_id) AS point_id FROM events)
SELECT scene, frame_id + 1 AS image_id, row_number() OVER (PARTITION BY scene, frame_id ORDER BY point_id) - 1 AS point2d_idx, px AS ox, point_id FROM p""",
)
def observations_direct(spark, sf):
    ev = table(spark, sf, "events").select(F.col("event_type").alias("scene"), F.col("event_id").alias("pid"), F.col("value").alias("px"), F.lit(0.0).alias("py"), (F.col("user_id") + 0.5).alias("frame_id"))
    return TK.observations_direct(ev).select("scene", F.col("image_id").cast("long").alias("image_id"), "point2d_idx", "ox", "point_id")


@query(
    "pack_cameras",
    f"WITH {CAM_SQL} SELECT scene, frame_id + 1 AS camera_id, [(fx + fy) / 2, cx, cy] AS params FROM cam",
)
def pack_cameras(spark, sf):
    return TK.pack_cameras(camera_frames(spark, sf), "SIMPLE_PINHOLE").select("scene", "camera_id", "params")


# --- frame geometry on parts: sizes from price and size ------------------------------------------------


def sized(spark, sf):
    k = F.col("p_partkey")
    return table(spark, sf, "part").select(
        F.col("p_partkey"), (200 + (k * 37) % 1700).cast("double").alias("width"), (150 + (k * 53) % 1300).cast("double").alias("height"),
        (400.0 + k % 300).alias("fx"), (410.0 + k % 290).alias("fy"), (100.0 + (k * 37) % 850).alias("cx"), (75.0 + (k * 53) % 650).alias("cy"),
    )


SIZED_SQL = """sz AS (SELECT p_partkey, CAST(200 + (p_partkey * 37) % 1700 AS DOUBLE) AS width, CAST(150 + (p_partkey * 53) % 1300 AS DOUBLE) AS height, 400.0 + p_partkey % 300 AS fx, 410.0 + p_partkey % 290 AS fy,
  100.0 + (p_partkey * 37) % 850 AS cx, 75.0 + (p_partkey * 53) % 650 AS cy FROM part)"""


@query(
    "fit_to_limit",
    f"""WITH RECURSIVE {SIZED_SQL}, w AS (SELECT p_partkey, width / height AS ratio, CAST(round_even(width * sqrt(255000.0 / (width * height)) / 14, 0) AS BIGINT) AS k, CAST(round_even(height * sqrt(255000.0 / (width * height)) / 14, 0) AS BIGINT) AS m FROM sz
 UNION ALL SELECT p_partkey, ratio, CASE WHEN k / m > ratio THEN k - 1 ELSE k END, CASE WHEN k / m > ratio THEN m ELSE m - 1 END FROM w WHERE k * 14 * m * 14 > 255000)
SELECT p_partkey, greatest(1, k) * 14 AS target_w, greatest(1, m) * 14 AS target_h FROM w WHERE k * 14 * m * 14 <= 255000""",
)
def fit_to_limit(spark, sf):
    return FG.frame_geometry(sized(spark, sf), "limit").select("p_partkey", "target_w", "target_h")


@query(
    "resize_to_width",
    f"""WITH {SIZED_SQL}, t AS (SELECT *, CAST(round_even(height * (518.0 / width) / 14, 0) AS BIGINT) * 14 AS th FROM sz), k AS (SELECT *, greatest(518 / width, th / height) AS k FROM t)
SELECT p_partkey, CAST(518 AS BIGINT) AS target_w, th AS target_h, round(fx * k, 6) AS fx, round((cx + 0.5) * k - 0.5, 6) AS cx, round((cy + 0.5) * k - 0.5, 6) AS cy FROM k""",
)
def resize_to_width(spark, sf):
    return FG.frame_geometry(sized(spark, sf), "width", width=518).select("p_partkey", "target_w", "target_h", *[F.round(c, 6).alias(c) for c in ("fx", "cx", "cy")])


@query(
    "square_boxes",
    f"""WITH {SIZED_SQL}, m AS (SELECT *, greatest(width, height) AS s FROM sz) SELECT p_partkey, round(floor((s - width) / 2) * 1024 / s, 6) AS x1, round(floor((s - height) / 2) * 1024 / s, 6) AS y1,
 round((floor((s - width) / 2) + width) * 1024 / s, 6) AS x2, round((floor((s - height) / 2) + height) * 1024 / s, 6) AS y2 FROM m""",
)
def square_boxes(spark, sf):
    return FG.frame_geometry(sized(spark, sf), "square").select("p_partkey", *[F.round(c, 6).alias(c) for c in ("x1", "y1", "x2", "y2")])


@query(
    "crop_to_shape",
    f"""WITH {SIZED_SQL}, h AS (SELECT *, CAST(floor(least(140.0, cy, height - cy)) AS BIGINT) AS hv, CAST(floor(least(210.0, cx, width - cx)) AS BIGINT) AS hh FROM sz),
c AS (SELECT *, CAST(floor(cy) AS BIGINT) - hv AS row0, CAST(floor(cx) AS BIGINT) - hh AS col0 FROM h)
SELECT p_partkey, row0, col0, CAST(least(2 * hv, height - row0) AS BIGINT) AS n_rows, CAST(least(2 * hh, width - col0) AS BIGINT) AS n_cols, cx - col0 AS cx, cy - row0 AS cy, height < 280 OR width < 420 AS too_small FROM c""",
)
def crop_to_shape(spark, sf):
    out = FG.frame_geometry(sized(spark, sf), "crop", target_h=280, target_w=420)
    return out.select("p_partkey", "row0", "col0", F.col("rows").cast("long").alias("n_rows"), F.col("cols").cast("long").alias("n_cols"), "cx", "cy", "too_small")


@query(
    "rotate_90",
    f"WITH {SIZED_SQL} SELECT p_partkey, height AS width, width AS height, fy AS fx, fx AS fy, height - cy AS cx, cx AS cy, [0.0, -1.0, 0.0, 1.0, 0.0, 0.0, 0.0, 0.0, 1.0] AS r FROM sz",
)
def rotate_90(spark, sf):
    f = sized(spark, sf).withColumn("r", C.identity_matrix()).withColumn("t", C.vec(F.lit(0.0), F.lit(0.0), F.lit(0.0)))
    out = FG.frame_geometry(f, "rotate")
    return out.select("p_partkey", "width", "height", "fx", "fy", "cx", "cy", F.transform("r", lambda x: x + 0.0).alias("r"))


@query(
    "pad_to_largest",
    """WITH f AS (SELECT p_brand AS scene, p_partkey, 100 + p_size AS width, 90 + p_partkey % 31 AS height FROM part), m AS (SELECT scene, max(height) AS mh, max(width) AS mw FROM f GROUP BY 1)
SELECT p_partkey, (mh - height) // 2 AS pad_top, (mw - width) // 2 AS pad_left, mh - height - (mh - height) // 2 AS pad_bottom, mw - width - (mw - width) // 2 AS pad_right FROM f JOIN m USING (scene)""",
)
def pad_to_largest(spark, sf):
    f = table(spark, sf, "part").select(F.col("p_brand").alias("scene"), "p_partkey", (F.col("p_size") + 100).alias("width"), (F.col("p_partkey") % 31 + 90).alias("height"))
    return CA.pad_to_largest(f).select("p_partkey", "pad_top", "pad_left", "pad_bottom", "pad_right")


# --- dataset preparation ------------------------------------------------------------------------------


@query(
    "pending_sequences",
    """WITH w AS (SELECT DISTINCT o_custkey AS seq FROM orders), p AS (SELECT o_custkey AS seq FROM orders GROUP BY 1 HAVING count(*) > 12), a AS (SELECT c_custkey AS seq FROM customer WHERE c_acctbal > 0)
SELECT w.seq, CASE WHEN w.seq IN (SELECT seq FROM p) THEN 'present' WHEN w.seq IN (SELECT seq FROM a) THEN 'pending' ELSE 'missing' END AS status FROM w""",
)
def pending_sequences(spark, sf):
    wanted = table(spark, sf, "orders").select(F.col("o_custkey").alias("seq"))
    present = wanted.groupBy("seq").count().where("count > 12")
    available = table(spark, sf, "customer").where("c_acctbal > 0").select(F.col("c_custkey").alias("seq"))
    return D.pending_sequences(wanted, present, available)


@query(
    "assemble_frames",
    """WITH q AS (SELECT conv_id AS seq, turn AS frame_id FROM conversations), d AS (SELECT doc_id AS seq, n_chars FROM documents), l AS (SELECT doc_id AS seq, quality FROM labels)
SELECT q.seq, q.frame_id, length(c.text) AS n_text, d.n_chars, l.quality FROM q JOIN conversations c ON c.conv_id = q.seq AND c.turn = q.frame_id JOIN d ON d.seq = q.seq LEFT JOIN l ON l.seq = q.seq WHERE d.n_chars > 500""",
)
def assemble_frames(spark, sf):
    conv = table(spark, sf, "conversations").select(F.col("conv_id").alias("seq"), F.col("turn").alias("frame_id"), F.length("text").alias("n_text"))
    ids = conv.select("seq", "frame_id")
    doc = ids.join(table(spark, sf, "documents").where("n_chars > 500").select(F.col("doc_id").alias("seq"), "n_chars"), "seq")
    lab = ids.join(table(spark, sf, "labels").select(F.col("doc_id").alias("seq"), "quality"), "seq")
    out, _ = D.assemble_frames(ids, {"rgb": conv, "depth": doc, "mask": lab}, ["rgb", "depth"])
    return out.select("seq", "frame_id", F.col("rgb.n_text").alias("n_text"), F.col("depth.n_chars").alias("n_chars"), F.col("mask.quality").alias("quality"))


@query(
    "assemble_rejects",
    """SELECT o_orderkey AS seq, CAST(0 AS BIGINT) AS frame_id, CASE WHEN l.k IS NULL AND c.k IS NULL THEN ['depth', 'pose'] WHEN l.k IS NULL THEN ['depth'] ELSE ['pose'] END AS missing
FROM orders o LEFT JOIN (SELECT DISTINCT l_orderkey AS k FROM lineitem WHERE l_quantity > 40) l ON l.k = o_orderkey LEFT JOIN (SELECT c_custkey AS k FROM customer WHERE c_acctbal > 0) c ON c.k = o_custkey WHERE l.k IS NULL OR c.k IS NULL""",
)
def assemble_rejects(spark, sf):
    orders = table(spark, sf, "orders").select(F.col("o_orderkey").alias("seq"), "o_custkey", F.lit(0).cast("long").alias("frame_id"))
    depth = table(spark, sf, "lineitem").where("l_quantity > 40").groupBy(F.col("l_orderkey").alias("seq")).agg(F.max("l_quantity").alias("q")).withColumn("frame_id", F.lit(0).cast("long"))
    pose = orders.join(table(spark, sf, "customer").where("c_acctbal > 0"), F.col("o_custkey") == F.col("c_custkey")).select("seq", "frame_id", "c_acctbal")
    _, rejects = D.assemble_frames(orders.select("seq", "frame_id"), {"depth": depth, "pose": pose}, ["depth", "pose"])
    return rejects


@query(
    "group_by_video",
    """WITH s AS (SELECT regexp_extract(url, '://([^/]+)/', 1) AS url, page_id AS seq, length(html) AS ts FROM pages), p AS (SELECT url, seq, count(*) AS n, min(ts) AS f FROM s GROUP BY 1, 2)
SELECT url, count(*) AS n_seqs, CAST(sum(n) AS BIGINT) AS n_frames, list_sort(list(seq)) AS seqs FROM p GROUP BY 1""",
)
def group_by_video(spark, sf):
    lists = table(spark, sf, "pages").select(F.regexp_extract("url", "://([^/]+)/", 1).alias("url"), F.col("page_id").alias("seq"), F.length("html").alias("ts"))
    return D.group_by_video(lists).withColumn("seqs", F.transform("seqs", lambda s: s["seq"]))


@query(
    "validate_manifest",
    """WITH f AS (SELECT conv_id AS seq, 'rgb' AS kind, turn AS frame_id FROM conversations UNION ALL SELECT conv_id, 'depth', turn FROM conversations WHERE length(text) > 40 UNION ALL SELECT conv_id, 'pose', turn FROM conversations WHERE role <> 'system'),
t AS (SELECT seq, count(*) FILTER (WHERE kind = 'rgb') AS a, count(*) FILTER (WHERE kind = 'depth') AS b, count(*) FILTER (WHERE kind = 'pose') AS c, min(frame_id) FILTER (WHERE kind = 'rgb') AS fa, min(frame_id) FILTER (WHERE kind = 'depth') AS fb, min(frame_id) FILTER (WHERE kind = 'pose') AS fc,
 max(frame_id) FILTER (WHERE kind = 'rgb') AS la, max(frame_id) FILTER (WHERE kind = 'depth') AS lb, max(frame_id) FILTER (WHERE kind = 'pose') AS lc FROM f GROUP BY 1)
SELECT seq, 'count_mismatch' AS violation FROM t WHERE NOT (a = b AND a = c) UNION ALL SELECT seq, 'first_not_zero' FROM t WHERE NOT (coalesce(fa = 0, false) AND coalesce(fb = 0, false) AND coalesce(fc = 0, false))
UNION ALL SELECT seq, 'last_not_n_minus_1' FROM t WHERE NOT (coalesce(la = a - 1, false) AND coalesce(lb = a - 1, false) AND coalesce(lc = a - 1, false))""",
)
def validate_manifest(spark, sf):
    c = table(spark, sf, "conversations").select(F.col("conv_id").alias("seq"), F.col("turn").alias("frame_id"), "role", F.length("text").alias("n"))
    files = (
        c.select("seq", F.lit("rgb").alias("kind"), "frame_id")
        .unionByName(c.where("n > 40").select("seq", F.lit("depth").alias("kind"), "frame_id"))
        .unionByName(c.where("role <> 'system'").select("seq", F.lit("pose").alias("kind"), "frame_id"))
    )
    return D.validate_manifest(files).select("seq", "violation")


@query(
    "build_annotations",
    """SELECT l_orderkey AS seq, l_linenumber AS idx, l_orderkey || '/images/' || lpad(CAST(l_linenumber AS VARCHAR), 4, '0') || '.png' AS filepath, round(640 * l_discount, 6) AS k00, round(480 * l_tax, 6) AS k11, CAST(count(*) AS BIGINT) AS n
FROM lineitem GROUP BY ALL""",
)
def build_annotations(spark, sf):
    li = table(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("seq"), F.col("l_linenumber").alias("idx"), F.col("l_discount").alias("fx"), F.col("l_tax").alias("fy"), F.lit(0.5).alias("cx"), F.lit(0.5).alias("cy"),
        F.array(*[F.lit(float(i)) for i in range(12)]).alias("p"),
    )
    sizes = table(spark, sf, "orders").select(F.col("o_orderkey").alias("seq"), F.lit(640).alias("width"), F.lit(480).alias("height"))
    out = D.build_annotations(li, sizes)
    flat = out.select("seq", "idx", "filepath", F.round(F.col("intrinsics")[0][0], 6).alias("k00"), F.round(F.col("intrinsics")[1][1], 6).alias("k11"))
    return flat.groupBy("seq", "idx", "filepath", "k00", "k11").agg(F.count(F.lit(1)).alias("n"))


@query(
    "split_members",
    """SELECT l_partkey, 's' || l_suppkey || '/seq-' || CASE WHEN l_linenumber < 10 THEN '0' ELSE '' END || l_linenumber AS seq, count(*) AS n FROM lineitem GROUP BY ALL""",
)
def split_members(spark, sf):
    li = table(spark, sf, "lineitem").select("l_partkey", F.concat(F.lit("s"), F.col("l_suppkey").cast("string")).alias("scene"), F.concat(F.lit("sequence"), F.col("l_linenumber").cast("string")).alias("line"))
    return D.split_members(li).groupBy("l_partkey", "seq").agg(F.count(F.lit(1)).alias("n"))


@query(
    "clock_text",
    """SELECT event_id, lpad(CAST(us // 3600000000 AS VARCHAR), CAST(greatest(2, length(CAST(us // 3600000000 AS VARCHAR))) AS INT), '0') || ':' || lpad(CAST(us // 60000000 % 60 AS VARCHAR), 2, '0') || ':' || lpad(CAST(us // 1000000 % 60 AS VARCHAR), 2, '0') || '.' || lpad(CAST(us // 1000 % 1000 AS VARCHAR), 3, '0') AS clock
FROM (SELECT event_id, epoch_us(ts) - 1704067200000000 AS us FROM events)""",
)
def clock_text(spark, sf):
    return table(spark, sf, "events").select("event_id", D.clock_text(C.epoch_micros("ts") - 1704067200000000).alias("clock"))


@query(
    "resolve_sequences",
    """WITH s AS (SELECT DISTINCT CASE user_id % 3 WHEN 0 THEN 'scannet' WHEN 1 THEN 'tum' ELSE 'kitti_odometry' END AS dataset, lpad(CAST(user_id AS VARCHAR), CAST(greatest(2, length(CAST(user_id AS VARCHAR))) AS INT), '0') AS seq FROM events),
k AS (SELECT * FROM s WHERE dataset <> 'kitti_odometry' OR seq IN ('00', '01', '02', '03', '04', '05', '06', '07', '08', '09', '10'))
SELECT dataset, seq, CASE dataset WHEN 'scannet' THEN 'data/scannetv2/' || seq || '/color_90' WHEN 'tum' THEN 'data/tum/' || seq || '/rgb_90' ELSE 'data/KITTI_Odometry/dataset/sequences/' || seq || '/image_2' END AS frame_dir FROM k""",
)
def resolve_sequences(spark, sf):
    u = F.col("user_id")
    name = F.when(F.length(u.cast("string")) < 2, F.lpad(u.cast("string"), 2, "0")).otherwise(u.cast("string"))
    listing = table(spark, sf, "events").select(F.when(u % 3 == 0, "scannet").when(u % 3 == 1, "tum").otherwise("kitti_odometry").alias("dataset"), name.alias("seq"))
    return D.resolve_sequences(D.dataset_registry(spark), listing).select("dataset", "seq", "frame_dir")


@query(
    "quarantine",
    """SELECT l_orderkey AS seq, count(*) AS n FROM lineitem GROUP BY 1 HAVING count(*) < 3""",
)
def quarantine(spark, sf):
    """Orders with one or two line items cannot be fitted: they land in the log, nothing fails."""
    from framespan.operators import registration as RG

    li = table(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("seq"), F.col("l_quantity").alias("sx"), (F.col("l_discount") * 100).alias("sy"), (F.col("l_extendedprice") / 1000).alias("sz"),
        (F.col("l_extendedprice") / 700).alias("dx"), (F.col("l_partkey") / 100).alias("dy"), (F.col("l_suppkey") + F.col("l_linenumber") * 0.37).alias("dz"),
    )
    return RG.quarantine(RG.umeyama(li, ["seq"]))[1].select("seq", "n")
