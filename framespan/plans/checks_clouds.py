"""Queries: point clouds."""

from __future__ import annotations

from pyspark.sql import functions as F

from framespan.functions import columns as C
from framespan.operators import clouds as CL
from framespan.plans.registry import query, table


def cloud(spark, sf, first: int):
    """Three consecutive embedding dimensions of every vector as a point, clouds by label."""
    e = F.col("embedding")
    return table(spark, sf, "embeddings").select(
        F.col("label").alias("cloud"), F.col("vec_id").alias("pid"),
        *[e[first + i].cast("double").alias(a) for i, a in enumerate("xyz")],
        *[e[first + 6 + i].cast("double").alias(f"n{a}") for i, a in enumerate("xyz")],
    )


def cloud_sql(name: str, first: int) -> str:
    p = [f"embedding[{first + i + 1}]::DOUBLE AS {a}" for i, a in enumerate("xyz")]
    n = [f"embedding[{first + 6 + i + 1}]::DOUBLE AS n{a}" for i, a in enumerate("xyz")]
    return f"{name} AS (SELECT label AS cloud, vec_id AS pid, {', '.join(p + n)} FROM embeddings)"


def nearest_sql(name: str, q: str, r: str) -> str:
    return f"""{name} AS (SELECT q.cloud, q.pid, r.pid AS ref_pid, sqrt(pow(q.x-r.x,2)+pow(q.y-r.y,2)+pow(q.z-r.z,2)) AS distance, abs(q.nx*r.nx+q.ny*r.ny+q.nz*r.nz) AS dot
  FROM {q} q JOIN {r} r ON q.cloud = r.cloud QUALIFY row_number() OVER (PARTITION BY q.cloud, q.pid ORDER BY pow(q.x-r.x,2)+pow(q.y-r.y,2)+pow(q.z-r.z,2), r.pid) = 1)"""


BOTH_SQL = f"{cloud_sql('a', 0)}, {cloud_sql('b', 3)}, {nearest_sql('ab', 'a', 'b')}, {nearest_sql('ba', 'b', 'a')}"


@query("nearest", f"WITH {BOTH_SQL} SELECT cloud, pid, ref_pid, round(distance, 8) AS distance FROM ab")
def nearest(spark, sf):
    out = CL.knn(cloud(spark, sf, 0), cloud(spark, sf, 3), 1, ["cloud"], leaf=8)
    return out.select("cloud", "pid", "ref_pid", F.round("distance", 8).alias("distance"))


FAR_SQL = """far AS (SELECT cloud, pid, CASE WHEN pid % 97 = 5 THEN x * 1e9 WHEN pid % 3 = 1 THEN 0.25 ELSE x END AS x,
  CASE WHEN pid % 97 <> 5 AND pid % 3 = 1 THEN 0.5 ELSE y END AS y, CASE WHEN pid % 97 <> 5 AND pid % 3 = 1 THEN 0.125 ELSE z END AS z, nx, ny, nz FROM b)"""


@query(
    "nearest_outliers",
    f"WITH {cloud_sql('a', 0)}, {cloud_sql('b', 3)}, {FAR_SQL}, {nearest_sql('af', 'a', 'far')} SELECT cloud, pid, ref_pid, round(distance, 8) AS distance FROM af",
)
def nearest_outliers(spark, sf):
    """A few reference points lie a billion times farther out than the rest, and a third are copies of one position."""
    out, copy = F.col("pid") % 97 == 5, (F.col("pid") % 97 != 5) & (F.col("pid") % 3 == 1)
    far = cloud(spark, sf, 3).withColumns(
        {"x": F.when(out, F.col("x") * 1e9).when(copy, 0.25).otherwise(F.col("x")), "y": F.when(copy, 0.5).otherwise(F.col("y")), "z": F.when(copy, 0.125).otherwise(F.col("z"))}
    )
    found = CL.knn(cloud(spark, sf, 0), far, 1, ["cloud"], leaf=8)
    return found.select("cloud", "pid", "ref_pid", F.round("distance", 8).alias("distance"))


@query(
    "knn",
    f"""WITH {cloud_sql('a', 0)}, {cloud_sql('b', 3)} SELECT q.pid, r.pid AS ref_pid, row_number() OVER (PARTITION BY q.pid ORDER BY pow(q.x-r.x,2)+pow(q.y-r.y,2)+pow(q.z-r.z,2), r.pid) AS rank
FROM a q JOIN b r ON true QUALIFY rank <= 4""",
)
def knn(spark, sf):
    return CL.knn(cloud(spark, sf, 0), cloud(spark, sf, 3), 4, leaf=16).select("pid", "ref_pid", "rank")


@query(
    "nearest_line_items",
    """WITH a AS (SELECT l_orderkey * 100 + row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS pid, l_quantity AS x, l_discount * 500 AS y, l_tax * 600 AS z FROM lineitem),
b AS (SELECT DISTINCT l_quantity AS x, l_discount * 500 AS y, l_tax * 600 AS z FROM lineitem)
SELECT pid, 0.0 AS distance FROM a""",
)
def nearest_line_items(spark, sf):
    """Every line item finds its own position among heavily repeated points."""
    from pyspark.sql import Window

    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey")
    li = table(spark, sf, "lineitem").select(
        (F.col("l_orderkey") * 100 + F.row_number().over(w)).alias("pid"), F.col("l_quantity").alias("x"), (F.col("l_discount") * 500).alias("y"), (F.col("l_tax") * 600).alias("z")
    )
    return CL.nearest(li, li).select("pid", "distance")


@query(
    "cloud_metrics",
    f"""WITH {BOTH_SQL}, s AS (SELECT cloud, avg(distance) AS acc, median(distance) AS acc_median FROM ab GROUP BY 1),
t AS (SELECT cloud, avg(distance) AS comp, median(distance) AS comp_median, avg(CASE WHEN distance < 0.05 THEN 1.0 ELSE 0.0 END) AS comp_ratio FROM ba GROUP BY 1)
SELECT cloud, round(acc, 7) AS acc, round(acc_median, 7) AS acc_median, round(comp, 7) AS comp, round(comp_median, 7) AS comp_median, round(comp_ratio, 7) AS comp_ratio, round((acc + comp) / 2, 7) AS chamfer FROM s JOIN t USING (cloud)""",
)
def cloud_metrics(spark, sf):
    out = CL.cloud_metrics(cloud(spark, sf, 0), cloud(spark, sf, 3), ["cloud"])
    return out.select("cloud", *[F.round(c, 7).alias(c) for c in ("acc", "acc_median", "comp", "comp_median", "comp_ratio", "chamfer")])


@query(
    "normal_consistency",
    f"""WITH {BOTH_SQL}, s AS (SELECT cloud, avg(dot) AS nc1, median(dot) AS m1 FROM ab GROUP BY 1), t AS (SELECT cloud, avg(dot) AS nc2, median(dot) AS m2 FROM ba GROUP BY 1)
SELECT cloud, round(nc1, 7) AS nc1, round(m1, 7) AS nc1_median, round(nc2, 7) AS nc2, round(m2, 7) AS nc2_median FROM s JOIN t USING (cloud)""",
)
def normal_consistency(spark, sf):
    out = CL.normal_consistency(cloud(spark, sf, 0), cloud(spark, sf, 3), ["cloud"])
    return out.select("cloud", *[F.round(c, 7).alias(c) for c in ("nc1", "nc1_median", "nc2", "nc2_median")])


@query(
    "estimate_normals",
    """SELECT label AS cloud, vec_id AS pid, round(label / 10.0 / sqrt(1.09 + label * label / 100.0), 5) AS nx,
round(0.3 / sqrt(1.09 + label * label / 100.0), 5) AS ny, round(1.0 / sqrt(1.09 + label * label / 100.0), 5) AS nz FROM embeddings""",
)
def estimate_normals(spark, sf):
    """Clouds flattened onto one plane each, whose normal SQL knows; tests compare free clouds with brute force."""
    points = cloud(spark, sf, 0).drop("nx", "ny", "nz").withColumn("z", F.col("x") * F.col("cloud") / 10.0 + F.col("y") * 0.3)
    out = CL.estimate_normals(points, 10, ["cloud"])
    return out.select("cloud", "pid", *[F.abs(F.round(c, 5)).alias(c) for c in ("nx", "ny", "nz")])


@query(
    "icp",
    """SELECT label AS cloud, count(*) AS n, round(0.0, 4) AS rmse, 1.0 AS fitness FROM embeddings GROUP BY label""",
)
def icp(spark, sf):
    """A slightly turned and shifted copy comes back onto its original."""
    gt = cloud(spark, sf, 0).drop("nx", "ny", "nz")
    c, s = 0.9999875000260416, 0.004999979166692708  # 0.005 rad about z
    pred = gt.select(
        "cloud", "pid", (F.col("x") * c - F.col("y") * s + 0.002).alias("x"), (F.col("x") * s + F.col("y") * c - 0.001).alias("y"), (F.col("z") + 0.0015).alias("z")
    )
    out = CL.icp(pred, gt, 0.1, ["cloud"])
    sizes = gt.groupBy("cloud").agg(F.count(F.lit(1)).alias("n"))
    return out.join(sizes, "cloud").select("cloud", "n", F.round("rmse", 4).alias("rmse"), "fitness")


@query(
    "voxel_iou",
    f"""WITH {cloud_sql('a', 0)}, {cloud_sql('b', 3)}, va AS (SELECT DISTINCT cloud, floor(x / 0.1) AS i, floor(y / 0.1) AS j, floor(z / 0.1) AS k FROM a),
vb AS (SELECT DISTINCT cloud, floor(x / 0.1) AS i, floor(y / 0.1) AS j, floor(z / 0.1) AS k FROM b),
n AS (SELECT cloud, count(*) AS n FROM (SELECT * FROM va INTERSECT SELECT * FROM vb) GROUP BY 1), u AS (SELECT cloud, count(*) AS n FROM (SELECT * FROM va UNION SELECT * FROM vb) GROUP BY 1)
SELECT u.cloud, coalesce(n.n, 0) AS intersection, u.n AS "union", round(coalesce(n.n, 0) / u.n, 8) AS iou FROM u LEFT JOIN n USING (cloud)""",
)
def voxel_iou(spark, sf):
    return CL.voxel_iou(cloud(spark, sf, 0), cloud(spark, sf, 3), 0.1, ["cloud"]).withColumn("iou", F.round("iou", 8))


@query(
    "scene_scale",
    """SELECT l_suppkey AS scene, round(sqrt(pow(quantile_cont(l_quantity, 0.95) - quantile_cont(l_quantity, 0.05), 2) + pow(quantile_cont(l_extendedprice / 1000, 0.95) - quantile_cont(l_extendedprice / 1000, 0.05), 2)
 + pow(quantile_cont(l_tax * 100, 0.95) - quantile_cont(l_tax * 100, 0.05), 2)), 6) AS scene_scale FROM lineitem GROUP BY 1""",
)
def scene_scale(spark, sf):
    li = table(spark, sf, "lineitem").select(F.col("l_suppkey").alias("scene"), F.col("l_quantity").alias("x"), (F.col("l_extendedprice") / 1000).alias("y"), (F.col("l_tax") * 100).alias("z"))
    return CL.scene_scale(li, ["scene"]).withColumn("scene_scale", F.round("scene_scale", 6))


@query(
    "scene_scale_empty",
    """WITH p AS (SELECT l_suppkey AS scene, l_quantity AS x, l_extendedprice / 1000 AS y, l_tax * 100 AS z FROM lineitem WHERE l_quantity > 48 AND l_discount = 0.1 AND l_tax < 0.02),
s AS (SELECT scene, round(sqrt(pow(quantile_cont(x, 0.95) - quantile_cont(x, 0.05), 2) + pow(quantile_cont(y, 0.95) - quantile_cont(y, 0.05), 2) + pow(quantile_cont(z, 0.95) - quantile_cont(z, 0.05), 2)), 6) AS scene_scale FROM p GROUP BY 1)
SELECT s_suppkey AS scene, coalesce(scene_scale, 1) AS scene_scale FROM supplier LEFT JOIN s ON scene = s_suppkey""",
)
def scene_scale_empty(spark, sf):
    """A strict filter leaves most suppliers without points: these have scale 1."""
    li = table(spark, sf, "lineitem").where("l_quantity > 48 AND l_discount = 0.1 AND l_tax < 0.02")
    li = li.select(F.col("l_suppkey").alias("scene"), F.col("l_quantity").alias("x"), (F.col("l_extendedprice") / 1000).alias("y"), (F.col("l_tax") * 100).alias("z"))
    every = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("scene"))
    return CL.scene_scale(li, ["scene"], every).withColumn("scene_scale", F.round("scene_scale", 6))


@query(
    "merge_clouds",
    """WITH m AS (SELECT 'items' AS cloud, l_extendedprice AS conf FROM lineitem UNION ALL SELECT 'orders', o_totalprice FROM orders UNION ALL SELECT 'events', value FROM events),
c AS (SELECT cloud, quantile_cont(conf, 0.4) AS cut FROM m GROUP BY 1)
SELECT cloud, count(*) AS n_points FROM m JOIN c USING (cloud) WHERE conf >= cut AND conf > 1e-5 GROUP BY ROLLUP (cloud)""",
)
def merge_clouds(spark, sf):
    a = table(spark, sf, "lineitem").select(F.lit("items").alias("cloud"), F.col("l_extendedprice").alias("conf"), F.col("l_quantity").alias("x"))
    b = table(spark, sf, "orders").select(F.lit("orders").alias("cloud"), F.col("o_totalprice").alias("conf"))
    c = table(spark, sf, "events").select(F.lit("events").alias("cloud"), F.col("value").alias("conf"))
    return CL.merge_clouds([a, b, c], 40.0)[1]


@query(
    "transform_cloud",
    """SELECT l_orderkey, l_linenumber, l_partkey, round(1.5 * (l_quantity * cos(l_suppkey / 10.0) - l_discount * 100 * sin(l_suppkey / 10.0)) + l_suppkey, 5) + 0.0 AS x,
 round(1.5 * (l_quantity * sin(l_suppkey / 10.0) + l_discount * 100 * cos(l_suppkey / 10.0)) - 1, 5) + 0.0 AS y FROM lineitem""",
)
def transform_cloud(spark, sf):
    li = table(spark, sf, "lineitem")
    pts = li.select("l_orderkey", "l_linenumber", "l_partkey", F.col("l_suppkey").alias("cloud"), F.col("l_quantity").alias("x"), (F.col("l_discount") * 100).alias("y"), F.col("l_tax").alias("z"))
    a = F.col("cloud") / 10.0
    c, s, z = F.cos(a), F.sin(a), F.lit(0.0)
    fits = pts.select("cloud").distinct().select(
        "cloud", F.lit(1.5).alias("s"), F.array(c, -s, z, s, c, z, z, z, F.lit(1.0)).alias("r"), C.vec(F.col("cloud"), F.lit(-1.0), F.lit(0.0)).alias("t")
    )
    out = CL.transform_cloud(pts, fits, ["cloud"])
    return out.select("l_orderkey", "l_linenumber", "l_partkey", *[(F.round(c, 5) + 0.0).alias(c) for c in ("x", "y")])
