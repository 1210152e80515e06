"""Queries: pixel grids, segments, components, layer-wise scale."""

from __future__ import annotations

from pyspark.sql import functions as F

from framespan.operators import graph as G
from framespan.operators import grids as GR
from framespan.operators import segments as SG
from framespan.plans.checks_depth import irls_sql
from framespan.plans.registry import PIXELS_SQL, pixels, query, table

# 3 x 4 blocks as segments; the second labeling shifts by a row and sends bright pixels to one label
BLOCK_SQL = f"{PIXELS_SQL}, sg AS (SELECT *, (v // 3) * 4 + u // 4 AS seg, CASE WHEN conf > 80 THEN 99 ELSE ((v + 1) // 3) * 4 + u // 4 END AS seg2 FROM px)"


def labelled(spark, sf):
    px = pixels(spark, sf)
    block = (F.floor(F.col("v") / 3) * 4 + F.floor(F.col("u") / 4)).alias("seg")
    second = F.when(F.col("conf") > 80, F.lit(99)).otherwise(F.floor((F.col("v") + 1) / 3) * 4 + F.floor(F.col("u") / 4)).alias("seg2")
    return px.select("scene", "frame_id", "v", "u", "depth", "conf", block, second)


EDGE_SQL = """max(depth) OVER (PARTITION BY frame_id, v ORDER BY u RANGE BETWEEN 1 PRECEDING AND 1 FOLLOWING)"""


@query(
    "depth_edge",
    f"""WITH {PIXELS_SQL}, a AS (SELECT *, max(depth) OVER r AS mx, min(depth) OVER r AS mn FROM px WINDOW r AS (PARTITION BY frame_id, v ORDER BY u RANGE BETWEEN 1 PRECEDING AND 1 FOLLOWING)),
b AS (SELECT *, max(mx) OVER c - min(mn) OVER c AS span FROM a WINDOW c AS (PARTITION BY frame_id, u ORDER BY v RANGE BETWEEN 1 PRECEDING AND 1 FOLLOWING))
SELECT frame_id, v, u, span > 90 OR span / depth > 12 AS edge FROM b""",
)
def depth_edge(spark, sf):
    return GR.depth_edge(pixels(spark, sf), ["frame_id"], atol=90.0, rtol=12.0).select("frame_id", "v", "u", "edge")


@query(
    "erode",
    f"""WITH {PIXELS_SQL}, a AS (SELECT *, min(CASE WHEN conf > 10 THEN 1 ELSE 0 END) OVER (PARTITION BY frame_id, v ORDER BY u RANGE BETWEEN 2 PRECEDING AND 1 FOLLOWING) AS mn FROM px)
SELECT frame_id, v, u, min(mn) OVER (PARTITION BY frame_id, u ORDER BY v RANGE BETWEEN 2 PRECEDING AND 1 FOLLOWING) = 1 AS eroded FROM a""",
)
def erode(spark, sf):
    return GR.erode(pixels(spark, sf).withColumn("mask", F.col("conf") > 10), ["frame_id"], 4).select("frame_id", "v", "u", "eroded")


RAMP_SQL = f"""{PIXELS_SQL}, rp AS (SELECT p.*, coalesce(abs(e.depth - w.depth) > 40, false) OR coalesce(abs(s.depth - n.depth) > 40, false) AS ramp FROM px p
  LEFT JOIN px e ON e.frame_id = p.frame_id AND e.v = p.v AND e.u = p.u + 1 LEFT JOIN px w ON w.frame_id = p.frame_id AND w.v = p.v AND w.u = p.u - 1
  LEFT JOIN px s ON s.frame_id = p.frame_id AND s.u = p.u AND s.v = p.v + 1 LEFT JOIN px n ON n.frame_id = p.frame_id AND n.u = p.u AND n.v = p.v - 1)"""


@query("ramp_pixels", f"WITH {RAMP_SQL} SELECT frame_id, v, u, ramp FROM rp")
def ramp_pixels(spark, sf):
    return GR.ramp_pixels(pixels(spark, sf), ["frame_id"], 40.0).select("frame_id", "v", "u", "ramp")


@query(
    "segment_pixels",
    f"""WITH RECURSIVE {RAMP_SQL}, e0 AS (
  SELECT a.frame_id, a.v * 16 + a.u AS a, b.v * 16 + b.u AS b FROM rp a JOIN rp b ON a.frame_id = b.frame_id AND ((b.v = a.v AND b.u = a.u + 1) OR (b.u = a.u AND b.v = a.v + 1))
  WHERE NOT a.ramp AND NOT b.ramp AND abs(a.depth - b.depth) <= 40),
e AS (SELECT * FROM e0 UNION ALL SELECT frame_id, b, a FROM e0),
reach(frame_id, node, lab) AS (SELECT frame_id, v * 16 + u, v * 16 + u FROM rp UNION SELECT e.frame_id, e.b, r.lab FROM reach r JOIN e ON e.frame_id = r.frame_id AND e.a = r.node WHERE r.lab < e.b),
root AS (SELECT frame_id, node, min(lab) AS root FROM reach GROUP BY 1, 2),
lab AS (SELECT *, dense_rank() OVER (PARTITION BY frame_id ORDER BY root) - 1 AS label FROM root)
SELECT rp.frame_id, rp.v, rp.u, CAST(CASE WHEN ramp THEN -1 ELSE label END AS INT) AS seg FROM rp JOIN lab ON lab.frame_id = rp.frame_id AND lab.node = rp.v * 16 + rp.u""",
)
def segment_pixels(spark, sf):
    return SG.segment_pixels(pixels(spark, sf), 40.0, ["frame_id"]).select("frame_id", "v", "u", "seg")


@query(
    "segment_overlap",
    f"""WITH {BLOCK_SQL}, i AS (SELECT frame_id, seg AS seg_a, seg2 AS seg_b, count(*) AS inter FROM sg GROUP BY 1, 2, 3),
a AS (SELECT frame_id, seg AS seg_a, count(*) AS na FROM sg GROUP BY 1, 2), b AS (SELECT frame_id, seg2 AS seg_b, count(*) AS nb FROM sg GROUP BY 1, 2)
SELECT frame_id, seg_a, seg_b, inter, round(inter / (na + nb - inter), 6) AS iou, round(least(inter / na, inter / nb), 6) AS min_rel, round(greatest(inter / na, inter / nb), 6) AS max_rel
FROM i JOIN a USING (frame_id, seg_a) JOIN b USING (frame_id, seg_b)""",
)
def segment_overlap(spark, sf):
    px = labelled(spark, sf)
    out = SG.segment_overlap(px, px.withColumn("seg", F.col("seg2")), ["frame_id"])
    return out.select("frame_id", "seg_a", "seg_b", "inter", *[F.round(c, 6).alias(c) for c in ("iou", "min_rel", "max_rel")])


TEMPORAL_SQL = """ti AS (SELECT a.scene, a.frame_id, a.seg2 AS sa, b.seg2 AS sb, count(*) AS inter FROM sg a JOIN sg b ON a.scene = b.scene AND b.frame_id = a.frame_id + 1 AND a.v = b.v AND a.u = b.u GROUP BY 1, 2, 3, 4),
ar AS (SELECT frame_id, seg2 AS s, count(*) AS n FROM sg GROUP BY 1, 2),
te AS (SELECT ti.scene, ti.frame_id AS src_frame, sa AS src_seg, ti.frame_id + 1 AS dst_frame, sb AS dst_seg, inter / (x.n + y.n - inter) AS iou
  FROM ti JOIN ar x ON x.frame_id = ti.frame_id AND x.s = sa JOIN ar y ON y.frame_id = ti.frame_id + 1 AND y.s = sb WHERE inter / (x.n + y.n - inter) >= 0.3)"""


@query("temporal_segment_graph", f"WITH {BLOCK_SQL}, {TEMPORAL_SQL} SELECT scene, src_frame, src_seg, dst_frame, dst_seg, round(iou, 6) AS iou FROM te")
def temporal_segment_graph(spark, sf):
    px = labelled(spark, sf).withColumn("seg", F.col("seg2"))
    out = SG.temporal_edges(px, 0.3)
    return out.select("scene", "src_frame", "src_seg", "dst_frame", "dst_seg", F.round("iou", 6).alias("iou"))


@query(
    "merge_regions",
    f"""WITH RECURSIVE {BLOCK_SQL}, m AS (SELECT frame_id, seg, avg(depth) AS m FROM sg GROUP BY 1, 2),
rk AS (SELECT frame_id, depth, conf, row_number() OVER (PARTITION BY frame_id ORDER BY conf) AS rn, count(*) OVER (PARTITION BY frame_id) AS n FROM sg),
ct AS (SELECT frame_id, conf AS cut FROM rk WHERE rn = CAST(round_even((n - 1) * 0.5, 0) AS BIGINT) + 1),
th AS (SELECT frame_id, 0.1 * (max(depth) - min(depth)) AS th FROM sg JOIN ct USING (frame_id) WHERE conf >= cut GROUP BY 1),
ad AS (SELECT DISTINCT a.frame_id, a.seg AS a, b.seg AS b FROM sg a JOIN sg b ON a.frame_id = b.frame_id AND ((b.v = a.v AND b.u = a.u + 1) OR (b.u = a.u AND b.v = a.v + 1)) AND a.seg <> b.seg AND a.seg <> 0 AND b.seg <> 0),
e0 AS (SELECT ad.frame_id, a, b FROM ad JOIN m x ON x.frame_id = ad.frame_id AND x.seg = a JOIN m y ON y.frame_id = ad.frame_id AND y.seg = b JOIN th ON th.frame_id = ad.frame_id WHERE abs(x.m - y.m) < th),
e AS (SELECT * FROM e0 UNION SELECT frame_id, b, a FROM e0),
reach(frame_id, node, lab) AS (SELECT frame_id, seg, seg FROM m UNION SELECT e.frame_id, e.b, r.lab FROM reach r JOIN e ON e.frame_id = r.frame_id AND e.a = r.node WHERE r.lab < e.b)
SELECT frame_id, node AS seg, min(lab) AS merged FROM reach GROUP BY 1, 2""",
)
def merge_regions(spark, sf):
    px = labelled(spark, sf)
    thresholds = SG.depth_span(px, ["frame_id"], 0.1, 0.5)
    return SG.merge_regions(px, thresholds, ["frame_id"])


@query(
    "components",
    """WITH e AS (SELECT c_custkey AS node, c_nationkey AS k FROM customer UNION ALL SELECT 1000000000 + s_suppkey, s_nationkey FROM supplier UNION ALL SELECT 2000000000 + n_nationkey, n_nationkey FROM nation)
SELECT node, min(node) OVER (PARTITION BY k) AS component FROM e""",
)
def components(spark, sf):
    """Customers and suppliers linked through their nation: few components with hub nodes."""
    hub = (F.lit(2_000_000_000).cast("long") + F.col("k")).alias("b")
    c = table(spark, sf, "customer").select(F.col("c_custkey").alias("a"), F.col("c_nationkey").alias("k")).select("a", hub)
    s = table(spark, sf, "supplier").select((F.lit(1_000_000_000) + F.col("s_suppkey")).alias("a"), F.col("s_nationkey").alias("k")).select("a", hub)
    nodes = table(spark, sf, "nation").select((F.lit(2_000_000_000).cast("long") + F.col("n_nationkey")).alias("node"))
    return G.components(c.unionByName(s), nodes)


# adjacent windows: window k holds frames 4k..4k+5 of a scene (8 frames, size 6, overlap 2)
SHARED_SQL = f"""{BLOCK_SQL}, sh AS (SELECT scene, CAST(1 AS BIGINT) AS window_id, frame_id, v, u, seg AS prev_seg, seg2 AS cur_seg, depth AS prev_depth, depth * (1.2 + seg2 / 100.0) + conf / 50.0 AS cur_depth
  FROM sg WHERE frame_id - scene * 8 BETWEEN 4 AND 5),
xi AS (SELECT scene, window_id, frame_id, prev_seg AS seg_a, cur_seg AS seg_b, count(*) AS inter FROM sh GROUP BY 1, 2, 3, 4, 5),
xa AS (SELECT frame_id, prev_seg AS seg_a, count(*) AS na FROM sh GROUP BY 1, 2), xb AS (SELECT frame_id, cur_seg AS seg_b, count(*) AS nb FROM sh GROUP BY 1, 2),
xe AS (SELECT scene, window_id, frame_id, seg_a, seg_b, inter / (na + nb - inter) AS iou FROM xi JOIN xa USING (frame_id, seg_a) JOIN xb USING (frame_id, seg_b) WHERE inter / (na + nb - inter) >= 0.4),
sp AS (SELECT scene, window_id, frame_id, prev_seg AS seg_a, cur_seg AS seg_b, frame_id * 10000 + prev_seg * 100 + cur_seg AS k, cur_depth AS pred, prev_depth AS gt FROM sh),
sq AS (SELECT sp.* FROM sp JOIN xe USING (scene, window_id, frame_id, seg_a, seg_b)),
{irls_sql('sq', 'k', 'gt / pred', 'abs({s} * pred - gt)', 'pred * gt', 'pred * pred', tol=0.05, low=1e-6)},
sd AS (SELECT scene, window_id, frame_id, seg_a, seg_b, iou, s AS scale FROM xe JOIN s10 ON k = frame_id * 10000 + seg_a * 100 + seg_b)"""


def shared_windows(spark, sf):
    px = labelled(spark, sf).where("frame_id - scene * 8 BETWEEN 4 AND 5")
    return px.select(
        "scene", F.lit(1).cast("long").alias("window_id"), "frame_id", "v", "u", F.col("seg").alias("prev_seg"), F.col("seg2").alias("cur_seg"),
        F.col("depth").alias("prev_depth"), (F.col("depth") * (1.2 + F.col("seg2") / 100.0) + F.col("conf") / 50.0).alias("cur_depth"),
    )


def seeds(spark, sf):
    shared = shared_windows(spark, sf)
    cross = SG.cross_window_edges(shared, 0.4)
    matched = cross.select("scene", "window_id", F.col("src_frame").alias("frame_id"), F.col("src_seg").alias("seg_a"), F.col("dst_seg").alias("seg_b"), "iou")
    return SG.segment_scale(shared, matched)


@query("segment_scale", f"WITH {SHARED_SQL} SELECT scene, frame_id, seg_a, seg_b, round(iou, 6) AS iou, round(scale, 4) AS scale FROM sd")
def segment_scale(spark, sf):
    return seeds(spark, sf).select("scene", "frame_id", "seg_a", "seg_b", F.round("iou", 6).alias("iou"), F.round("scale", 4).alias("scale"))


def _layers(first: int, last: int) -> str:
    """Propagation layer by layer: contributions of a frame, their weighted mean, the next frame."""
    out = [f"c{first} AS (SELECT scene, seg_b AS seg, iou AS w, scale AS s FROM sd WHERE frame_id - scene * 8 = {first})"]
    for k in range(first, last + 1):
        out.append(f"v{k} AS (SELECT scene, seg, sum(w * s) / sum(w) AS s FROM c{k} GROUP BY 1, 2)")
        seeded = f"UNION ALL SELECT scene, seg_b, iou, scale FROM sd WHERE frame_id - scene * 8 = {k + 1}" if k + 1 <= first + 1 else ""
        out.append(
            f"c{k + 1} AS (SELECT te.scene, te.dst_seg AS seg, te.iou AS w, v.s AS s FROM te JOIN v{k} v ON v.scene = te.scene AND v.seg = te.src_seg WHERE te.src_frame - te.scene * 8 = {k} {seeded})"
        )
    return ",\n".join(out)


PROP_SQL = f"""{SHARED_SQL}, {TEMPORAL_SQL}, {_layers(4, 7)},
vs AS ({' UNION ALL '.join(f'SELECT scene, scene * 8 + {k} AS frame_id, seg, s FROM v{k}' for k in range(4, 8))}),
nd AS (SELECT DISTINCT scene, frame_id, seg2 AS seg FROM sg WHERE frame_id - scene * 8 >= 4),
pr AS (SELECT nd.scene, nd.frame_id, nd.seg, coalesce(vs.s, 1.0) AS scale FROM nd LEFT JOIN vs USING (scene, frame_id, seg))"""


def propagated(spark, sf):
    px = labelled(spark, sf).withColumn("seg", F.col("seg2")).withColumn("window_id", F.lit(1).cast("long")).where("frame_id - scene * 8 >= 4")
    edges = SG.temporal_edges(px, 0.3, ["scene", "window_id"])
    nodes = px.select("scene", "window_id", "frame_id", "seg").distinct()
    return px, SG.propagate_scale(nodes, edges, seeds(spark, sf))


@query("propagate_scale", f"WITH {PROP_SQL} SELECT scene, frame_id, seg, round(scale, 4) AS scale FROM pr")
def propagate_scale(spark, sf):
    return propagated(spark, sf)[1].select("scene", "frame_id", "seg", F.round("scale", 4).alias("scale"))


def windowed_pixels(spark, sf):
    """Two windows per scene: frames 0..5 and 4..7, the second with differently scaled depth."""
    px = labelled(spark, sf).withColumn("at", F.col("frame_id") - F.col("scene") * 8)
    first = px.where("at <= 5").select("scene", F.lit(0).cast("long").alias("window_id"), F.col("at").alias("pos"), "frame_id", "v", "u", "depth", "seg")
    second = px.where("at >= 4").select(
        "scene", F.lit(1).cast("long").alias("window_id"), (F.col("at") - 4).alias("pos"), "frame_id", "v", "u",
        (F.col("depth") * (1.2 + F.col("seg2") / 100.0) + F.col("conf") / 50.0).alias("depth"), F.col("seg2").cast("long").alias("seg"),
    )
    return first.unionByName(second)


@query(
    "refine_depth",
    f"""WITH {PROP_SQL} SELECT scene, CAST(0 AS BIGINT) AS window_id, frame_id, v, u, round(depth, 3) AS depth FROM sg WHERE frame_id - scene * 8 <= 5
UNION ALL SELECT sg.scene, 1, sg.frame_id, v, u, round((depth * (1.2 + seg2 / 100.0) + conf / 50.0) * scale, 3) AS depth
FROM sg JOIN pr ON pr.scene = sg.scene AND pr.frame_id = sg.frame_id AND pr.seg = sg.seg2""",
)
def refine_depth(spark, sf):
    out = SG.refine_depth(windowed_pixels(spark, sf), 6, 2)
    return out.select("scene", "window_id", "frame_id", "v", "u", F.round("depth", 3).alias("depth"))


@query(
    "resample_bilinear",
    f"""WITH {PIXELS_SQL}, sz AS (SELECT frame_id, max(v) + 1 AS h, max(u) + 1 AS w FROM px GROUP BY 1),
t AS (SELECT frame_id, h, w, tv, tu, greatest(0.0, (tv + 0.5) * h / 9.0 - 0.5) AS y, greatest(0.0, (tu + 0.5) * w / 10.0 - 0.5) AS x
  FROM sz, (SELECT unnest(generate_series(0, 8)) AS tv), (SELECT unnest(generate_series(0, 9)) AS tu)),
c AS (SELECT *, least(CAST(floor(y) AS BIGINT), h - 1) AS y0, least(CAST(floor(x) AS BIGINT), w - 1) AS x0, least(CAST(floor(y) AS BIGINT) + 1, h - 1) AS y1, least(CAST(floor(x) AS BIGINT) + 1, w - 1) AS x1, y - floor(y) AS fy, x - floor(x) AS fx FROM t),
k AS (SELECT frame_id, tv, tu, y0 AS v, x0 AS u, (1-fy)*(1-fx) AS wt FROM c UNION ALL SELECT frame_id, tv, tu, y0, x1, (1-fy)*fx FROM c UNION ALL SELECT frame_id, tv, tu, y1, x0, fy*(1-fx) FROM c UNION ALL SELECT frame_id, tv, tu, y1, x1, fy*fx FROM c)
SELECT k.frame_id, CAST(tv AS INT) AS v, CAST(tu AS INT) AS u, round(sum(wt * depth), 5) AS depth FROM k JOIN px ON px.frame_id = k.frame_id AND px.v = k.v AND px.u = k.u GROUP BY ALL""",
)
def resample_bilinear(spark, sf):
    return GR.resample_bilinear(pixels(spark, sf), ["frame_id"], 9, 10).withColumn("depth", F.round("depth", 5))


@query(
    "resample_nearest",
    f"""WITH {PIXELS_SQL}, sz AS (SELECT frame_id, max(v) + 1 AS h, max(u) + 1 AS w FROM px GROUP BY 1),
t AS (SELECT frame_id, tv, tu, CAST(floor((tv + 0.5) * h / 5.0) AS BIGINT) AS v, CAST(floor((tu + 0.5) * w / 7.0) AS BIGINT) AS u FROM sz, (SELECT unnest(generate_series(0, 4)) AS tv), (SELECT unnest(generate_series(0, 6)) AS tu))
SELECT t.frame_id, CAST(tv AS INT) AS v, CAST(tu AS INT) AS u, depth FROM t JOIN px ON px.frame_id = t.frame_id AND px.v = t.v AND px.u = t.u""",
)
def resample_nearest(spark, sf):
    return GR.resample_nearest(pixels(spark, sf), ["frame_id"], 5, 7, ["depth"])
