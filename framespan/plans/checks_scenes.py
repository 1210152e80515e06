"""Queries: window registration, assembly, pose graph, and text sources written from the tables."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from framespan.functions import columns as C
from framespan.operators import assembly as A
from framespan.operators import windows as W
from framespan.operators.posegraph import graph_cost, optimize_pose_graph
from framespan.plans.checks_registration import steps
from framespan.plans.registry import PIXELS_SQL, pixels, query, table
from framespan.session import cut, ensure_checkpoint_dir
from framespan.sources import readers, writers
from framespan.sources.folders import few_tasks, listing, write_folders

# Scenes of 8 frames seen through two windows (frames 0..5 and 4..7). The second window is the first
# one's world divided by 1.25 and turned by 0.4 about z, so registering it must give that back.
COS, SIN = 0.9210609940028851, 0.3894183423086505


def window_pixels(spark, sf):
    px = pixels(spark, sf).withColumn("at", F.col("frame_id") - F.col("scene") * 8)
    xyz = [((F.col("u") - 8) * F.col("depth") / 20).alias("x"), ((F.col("v") - 6) * F.col("depth") / 20).alias("y"), F.col("depth").alias("z")]
    base = px.select("scene", "frame_id", "at", "v", "u", "conf", *xyz)
    names = ["scene", "window_id", "pos", "frame_id", "v", "u", "x", "y", "z", "conf"]
    first = base.where("at <= 5").withColumn("window_id", F.lit(0).cast("long")).withColumn("pos", F.col("at"))
    second = base.where("at >= 4").withColumn("window_id", F.lit(1).cast("long")).withColumn("pos", F.col("at") - 4)
    second = second.withColumns({a: F.col(a) / 1.25 for a in ("x", "y", "z")})
    return first.select(*names).unionByName(second.select(*names))


def window_poses(spark, sf):
    frames = pixels(spark, sf).groupBy("scene", "frame_id").agg(F.max("depth").alias("m"))
    at = F.col("frame_id") - F.col("scene") * 8
    a = F.col("m") / 100
    c, s, z = F.cos(a), F.sin(a), F.lit(0.0)
    # turn about x, position on a curve
    base = frames.select(
        "scene", "frame_id", at.alias("at"), F.array(F.lit(1.0), z, z, z, c, -s, z, s, c).alias("r"), C.vec(at * 2.0, F.col("m") / 10, at * at * 0.5).alias("t")
    )
    first = base.where("at <= 5").select("scene", F.lit(0).cast("long").alias("window_id"), F.col("at").alias("pos"), "frame_id", "r", "t")
    back = C.sim3_inverse(C.sim3(F.lit(1.25), F.array(*[F.lit(v) for v in (COS, -SIN, 0.0, SIN, COS, 0.0, 0.0, 0.0, 1.0)]), C.vec(F.lit(3.0), F.lit(-1.0), F.lit(0.5))))
    moved = base.where("at >= 4").withColumn("_g", back)
    second = moved.select(
        "scene", F.lit(1).cast("long").alias("window_id"), (F.col("at") - 4).alias("pos"), "frame_id", C.mat_mul("_g.r", "r").alias("r"), F.array(*C.sim3_apply("_g", C.components("t"))).alias("t")
    )
    return first.unionByName(second)


@query(
    "register_windows",
    f"""WITH {PIXELS_SQL}, f AS (SELECT DISTINCT scene, frame_id - scene * 8 AS fp FROM px), s AS (SELECT scene, max(fp) AS last FROM f GROUP BY 1)
SELECT scene, CAST(0 AS BIGINT) AS window_id, 1.0 AS s, 1.0 AS r0, 0.0 AS t0 FROM s UNION ALL SELECT scene, 1, 1.25, round({COS}, 5), 3.0 FROM s WHERE last >= 4""",
)
def register_windows(spark, sf):
    out = A.register_windows(window_pixels(spark, sf), window_poses(spark, sf), 6, 2, 0.5)
    g = F.col("sim3")
    return out.select("scene", "window_id", F.round(g["s"], 5).alias("s"), F.round(g["r"][0], 5).alias("r0"), (F.round(g["t"][0], 4) + 0.0).alias("t0"))


@query(
    "assemble_scene",
    f"""WITH {PIXELS_SQL}, m AS (SELECT scene, frame_id, frame_id - scene * 8 AS fp, max(depth) AS m FROM px GROUP BY ALL),
p AS (SELECT px.frame_id, v, u, (u - 8) * depth / 20 AS x, (v - 6) * depth / 20 AS y, depth AS z, m / 100 AS a, fp, m FROM px JOIN m USING (frame_id))
SELECT frame_id, v, u, round(x + fp * 2.0, 4) + 0.0 AS x, round(cos(a) * y - sin(a) * z + m / 10, 4) + 0.0 AS y, round(sin(a) * y + cos(a) * z + fp * fp * 0.5, 4) + 0.0 AS z FROM p""",
)
def assemble_scene(spark, sf):
    """Registered, chained and merged windows give the world points of every frame once."""
    px, poses = window_pixels(spark, sf), window_poses(spark, sf)
    rel = A.register_windows(px, poses, 6, 2, 0.5)
    points, _ = A.assemble(px, poses, rel, 2)
    return points.select("frame_id", "v", "u", *[(F.round(a, 4) + 0.0).alias(a) for a in ("x", "y", "z")])


@query(
    "register_chain",
    f"""WITH {PIXELS_SQL}, m AS (SELECT scene, frame_id, frame_id - scene * 8 AS fp, max(depth) AS m FROM px GROUP BY ALL),
w AS (SELECT *, CAST(0 AS BIGINT) AS window_id FROM m WHERE fp <= 5 UNION ALL SELECT *, 1 FROM m WHERE fp >= 4)
SELECT scene, window_id, frame_id, round(fp * 2.0, 4) + 0.0 AS tx, round(m / 10, 4) AS ty FROM w""",
)
def register_chain(spark, sf):
    _, poses = A.register_chain(window_pixels(spark, sf), window_poses(spark, sf), 6, 2, 0.5)
    return poses.select("scene", "window_id", "frame_id", (F.round(F.col("t")[0], 4) + 0.0).alias("tx"), F.round(F.col("t")[1], 4).alias("ty"))


@query(
    "optimize_pose_graph",
    """SELECT user_id AS scene, CAST(count(*) AS BIGINT) AS n_steps, true AS finite, true AS not_worse FROM events GROUP BY user_id""",
)
def pose_graph(spark, sf):
    """Every user's chain gets one loop from its last to its first window, and up to 30 rounds.

    SQL knows what must hold: every step is still there, all numbers are finite and no scene's cost is above
    its start; the optimum itself is compared in ``optimize_pose_graph_turns`` and, in the tests, with a dense solver.
    """
    chain = cut(steps(spark, sf))
    ends = chain.groupBy("scene").agg((F.max("node") + 1).alias("i"))
    loop = ends.select("scene", "i", F.lit(0).cast("long").alias("j"), C.sim3(F.lit(1.0), C.identity_matrix(), C.vec(F.lit(0.5), F.lit(0.0), F.lit(0.0))).alias("sim3"))
    out = cut(optimize_pose_graph(chain, loop))
    after, before = (graph_cost(x, chain, loop).select("scene", F.col("cost").alias(n)) for x, n in ((out, "after"), (chain, "before")))
    numbers = F.concat(F.array("sim3.s"), F.col("sim3.r"), F.col("sim3.t"))
    finite = F.forall(numbers, lambda x: ~F.isnan(x) & (F.abs(x) < float("inf")))
    counts = out.groupBy("scene").agg(F.count("*").alias("n_steps"), F.bool_and(finite).alias("finite"))
    better = F.col("after") <= F.col("before") * (1 + 1e-9)
    return counts.join(after, "scene").join(before, "scene").select("scene", "n_steps", "finite", better.alias("not_worse"))


#: Chains of turns about z and scales, without shifts: all commute, so the optimum deals the gap of each loop evenly over its edges.
TURNS_SQL = """WITH e AS (SELECT user_id AS scene, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS node, (event_id % 7 - 3) / 200 AS a, (event_id % 5 - 2) / 100 AS l FROM events),
n AS (SELECT scene, count(*) AS m, count(*) // 2 AS half FROM e GROUP BY scene),
cyc AS (SELECT e.*, CASE WHEN node < half THEN 0 ELSE 1 END AS part FROM e JOIN n USING (scene)),
gap AS (SELECT scene, part, count(*) AS len, sum(a) + (part * 0.0507317 - 0.0013579) AS ga, sum(l) - 0.1013579 AS gl FROM cyc GROUP BY scene, part)
SELECT cyc.scene, cyc.node, round(a - ga / (len + 1), 5) + 0.0 AS angle, round(l - gl / (len + 1), 5) + 0.0 AS log_scale
FROM cyc JOIN gap USING (scene, part)"""


@query("optimize_pose_graph_turns", TURNS_SQL)
def pose_graph_turns(spark, sf):
    """Two loops per user, one over each half of the chain: the optimum is known, and every step is compared."""
    ev = table(spark, sf, "events").select(F.col("user_id").alias("scene"), "ts", "event_id")
    numbered = W.number_frames(ev, ["scene"], [F.col("ts"), F.col("event_id")], "node")
    zero = F.lit(0.0)

    def turn(a, log_scale):
        c, s = F.cos(a), F.sin(a)
        return C.sim3(F.exp(log_scale), F.array(c, -s, zero, s, c, zero, zero, zero, F.lit(1.0)), C.vec(zero, zero, zero))

    chain = cut(numbered.select("scene", "node", turn((F.col("event_id") % 7 - 3) / 200, (F.col("event_id") % 5 - 2) / 100).alias("sim3")))
    sizes = chain.groupBy("scene").agg(F.count("*").alias("m")).withColumn("half", F.floor(F.col("m") / 2))
    upper = sizes.select("scene", F.col("m").alias("i"), F.col("half").alias("j"), turn(F.lit(0.0013579 - 0.0507317), F.lit(0.1013579)).alias("sim3"))
    lower = sizes.where("half > 0").select("scene", F.col("half").alias("i"), F.lit(0).cast("long").alias("j"), turn(F.lit(0.0013579), F.lit(0.1013579)).alias("sim3"))
    out = optimize_pose_graph(chain, upper.unionByName(lower))
    angle, log_scale = F.atan2(F.col("sim3.r")[3], F.col("sim3.r")[0]), F.log("sim3.s")
    return out.select("scene", "node", (F.round(angle, 5) + 0.0).alias("angle"), (F.round(log_scale, 5) + 0.0).alias("log_scale"))


# --- text sources: written from the tables into the shared folder, then scanned -------------------------


#: Line items whose suppliers share annotation files, one for each line number.
FRAMES_PER_GROUP = 100_000


def _folder(spark) -> str:
    return f"{ensure_checkpoint_dir(spark)}/text-{uuid.uuid4().hex}"


@query(
    "export_and_scan_trajectories",
    """WITH e AS (SELECT user_id, value, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS k FROM events)
SELECT 'scene=' || user_id AS seq, CAST(k AS DOUBLE) AS ts, round(value, 6) AS tx, round(cos(value / 100), 4) + 0.0 AS r0 FROM e""",
)
def export_and_scan_trajectories(spark, sf):
    from framespan.plans.registry import frames

    a = F.col("value") / 100
    c, s, z = F.cos(a), F.sin(a), F.lit(0.0)
    poses = frames(spark, sf).select("scene", "frame_id", F.array(c, -s, z, s, c, z, z, z, F.lit(1.0)).alias("r"), C.vec(F.col("value"), F.lit(1.0), F.lit(2.0)).alias("t"))
    path = _folder(spark)
    writers.export_scene({"poses": poses}, path)
    out = readers.scan_trajectories(spark, f"{path}/trajectory", "scalar_first")
    return out.select("seq", "ts", F.round(F.col("t")[0], 6).alias("tx"), (F.round(F.col("r")[0], 4) + 0.0).alias("r0"))


@query(
    "write_and_read_windows",
    """WITH e AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS k, value FROM events)
SELECT user_id AS scene, k // 40 AS window_id, k AS frame_id, value FROM e""",
)
def write_and_read_windows(spark, sf):
    from framespan.plans.registry import frames

    rows = frames(spark, sf).select("scene", F.floor(F.col("frame_id") / 40).alias("window_id"), "frame_id", "value")
    path = _folder(spark)
    writers.write_windows(rows, path)
    back = writers.read_windows(spark, path)
    return back.select(F.col("scene").cast("long").alias("scene"), "window_id", "frame_id", "value")


@query(
    "scan_annotations",
    """SELECT 'c' || l_suppkey AS seq, count(*) AS n, round(sum(l_quantity), 3) AS tx, round(max(l_extendedprice), 2) AS focal FROM lineitem GROUP BY 1""",
)
def scan_annotations(spark, sf):
    """Line items as JSON annotation files, read back frame by frame; a file holds some suppliers of one line number, each as a sequence."""

    def frame(x):
        return F.struct(
            F.concat(x["l_orderkey"].cast("string"), F.lit(".jpg")).alias("filepath"), F.array(C.vec(F.lit(1.0), F.lit(0.0), F.lit(0.0))).alias("R"),
            C.vec(x["l_quantity"], x["l_tax"], x["l_discount"]).alias("T"), C.vec(x["l_extendedprice"]).alias("focal_length"), C.vec(F.lit(0.0)).alias("principal_point"),
        )

    lines = table(spark, sf, "lineitem")
    groups = max(1, -(-lines.count() // FRAMES_PER_GROUP))
    items = F.collect_list(F.struct("l_orderkey", "l_quantity", "l_tax", "l_discount", "l_extendedprice"))
    li = lines.groupBy("l_suppkey", "l_linenumber").agg(items.alias("rows"))
    seq = F.struct(F.concat(F.lit("c"), F.col("l_suppkey").cast("string")), "rows")
    files = li.groupBy("l_linenumber", F.pmod(F.xxhash64("l_suppkey"), F.lit(groups)).alias("_file")).agg(F.collect_list(seq).alias("seqs"))
    frames = F.transform_values(F.map_from_entries("seqs"), lambda _, rows: F.transform(rows, frame))
    path = _folder(spark)
    files.select(F.to_json(frames).alias("value")).write.option("maxRecordsPerFile", 1).option("compression", "gzip").text(path)
    out = readers.scan_annotations(spark, path)
    return out.groupBy("seq").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum(F.col("T")[0]), 3).alias("tx"), F.round(F.max(F.col("focal_length")[0]), 2).alias("focal"))


@query(
    "scan_metric_reports",
    """SELECT 's' || user_id AS seq, round(max(value), 4) AS ate, round(min(value), 4) AS rpe_trans, 0.0 AS rpe_rot FROM events GROUP BY user_id""",
)
def scan_metric_reports(spark, sf):
    per_user = table(spark, sf, "events").groupBy("user_id").agg(F.max("value").alias("a"), F.min("value").alias("b"))
    text = F.concat(
        F.lit("Seq: x \n\nAPE w.r.t. translation part (m)\n      max\t1\n     rmse\t"), F.format_string("%.4f", "a"),
        F.lit("\nRPE w.r.t. translation part (m)\n     rmse\t"), F.format_string("%.4f", "b"), F.lit("\n"),
    )
    path = _folder(spark)
    reports = per_user.select(F.concat(F.lit("s"), F.col("user_id").cast("string")).alias("seq"), text.alias("value"))
    # one folder per sequence; the report of a sequence is whatever text lies in its folder
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))  # few bytes, but many files
    write_folders(reports.repartition(parts, "seq"), path, ["seq"], "text")
    with listing(spark):
        whole = few_tasks(spark.read.text(path, wholetext=True)).select("seq", "value")
    return readers.parse_metric_reports(whole)


@query(
    "export_report",
    """WITH m AS (SELECT event_type AS dataset, user_id AS seq, avg(value) AS abs_rel, count(*) AS valid_pixels FROM events GROUP BY 1, 2)
SELECT 'per_seq_metrics' AS section, CAST(seq AS VARCHAR) AS seq, round(abs_rel, 6) AS abs_rel FROM m UNION ALL SELECT 'avg_metrics', NULL, round(sum(abs_rel * valid_pixels) / sum(valid_pixels), 6) FROM m""",
)
def export_report(spark, sf):
    from framespan.operators.metrics import weighted_rollup

    m = table(spark, sf, "events").groupBy(F.col("event_type").alias("dataset"), F.col("user_id").alias("seq")).agg(F.avg("value").alias("abs_rel"), F.count(F.lit(1)).alias("valid_pixels"))
    path = _folder(spark)
    writers.export_report(weighted_rollup(m, names=["abs_rel"]), ["abs_rel"], path)
    lines = spark.read.schema("section string, seq string, metrics struct<abs_rel:double>").json(path)
    return lines.select("section", "seq", F.round("metrics.abs_rel", 6).alias("abs_rel"))


@query(
    "loop_lines",
    """SELECT format('{:d}, {:d}, {:.4f}', o_orderkey, o_custkey, o_totalprice) AS value FROM orders UNION ALL SELECT '# ' || c_custkey || ': ' || c_name FROM customer""",
)
def loop_lines(spark, sf):
    pairs = table(spark, sf, "orders").select(F.col("o_orderkey").alias("i"), F.col("o_custkey").alias("j"), F.col("o_totalprice").alias("sim"))
    frames = table(spark, sf, "customer").select(F.col("c_custkey").alias("frame_id"), F.col("c_name").alias("path"))
    return writers.loop_lines(pairs, frames)
