"""Queries: similarity fits, transform chains, trajectories."""

from __future__ import annotations

from pyspark.sql import functions as F

from framespan.functions import columns as C
from framespan.operators import graph as G
from framespan.operators import ranking as K
from framespan.operators import registration as RG
from framespan.operators import trajectory as TR
from framespan.operators import windows as W
from framespan.plans.registry import query, table

# Planted transform of a supplier: scale 1.5 + s/100, rotation about z by 0.3 + s/50 then x by 0.7.
ANGLE = "(0.3 + (seq % 40) / 50.0)"
SCALE = "(1.5 + (seq % 100) / 100.0)"
CX, SX = 0.7648421872844885, 0.644217687237691  # cos and sin of 0.7


def planted(seq):
    a = F.lit(0.3) + (seq % 40) / 50.0
    c, s = F.cos(a), F.sin(a)
    z = F.lit(0.0)
    rz = F.array(c, -s, z, s, c, z, z, z, F.lit(1.0))
    rx = F.array(F.lit(1.0), z, z, z, F.lit(CX), F.lit(-SX), z, F.lit(SX), F.lit(CX))
    scale = F.lit(1.5) + (seq % 100) / 100.0
    return C.sim3(scale, C.mat_mul(rx, rz), C.vec(seq * 1.0, F.lit(-2.0), seq % 7 + 0.5))


R_SQL = f"""[cos({ANGLE}), -sin({ANGLE}), 0.0, {CX} * sin({ANGLE}), {CX} * cos({ANGLE}), -{SX}, {SX} * sin({ANGLE}), {SX} * cos({ANGLE}), {CX}]"""
T_SQL = "[seq * 1.0, -2.0, seq % 7 + 0.5]"


def point_pairs(spark, sf, noise=None):
    """Line items as 3-D points per supplier and their images under the planted transform."""
    li = table(spark, sf, "lineitem").select("l_suppkey", "l_orderkey", "l_linenumber", "l_quantity", "l_discount", "l_tax", "l_extendedprice")
    src = li.select(
        F.col("l_suppkey").alias("seq"), "l_orderkey", "l_linenumber",
        (F.col("l_quantity") / 10).alias("sx"), (F.col("l_discount") * 50).alias("sy"), (F.col("l_extendedprice") / 20000).alias("sz"), "l_tax",
    )
    moved = C.sim3_apply("g", [F.col(c) for c in ("sx", "sy", "sz")])
    out = src.withColumn("g", planted(F.col("seq")))
    shift = F.lit(0.0) if noise is None else noise
    return out.select(
        "seq", "l_orderkey", "l_linenumber", "l_tax", "sx", "sy", "sz", (moved[0] + shift).alias("dx"), moved[1].alias("dy"), (moved[2] - shift).alias("dz")
    )


# 4x4 quaternion form of the same least-squares rotation: the eigenvector of the largest eigenvalue,
# found by squaring the (shifted) matrix. Works on centred cross moments hxx..hzz.
def horn_sql(src: str, by: str) -> str:
    """CTEs ``rot(by, r)`` from ``src(by, h DOUBLE[9])`` with h = sum of src_i * dst_j, row-major."""
    n4 = """[[h[1]+h[5]+h[9], h[6]-h[8], h[7]-h[3], h[2]-h[4]],
 [h[6]-h[8], h[1]-h[5]-h[9], h[2]+h[4], h[7]+h[3]],
 [h[7]-h[3], h[2]+h[4], h[5]-h[1]-h[9], h[6]+h[8]],
 [h[2]-h[4], h[7]+h[3], h[6]+h[8], h[9]-h[1]-h[5]]]"""
    mul = "list_transform([1,2,3,4], lambda i: list_transform([1,2,3,4], lambda j: m[i][1]*m[1][j] + m[i][2]*m[2][j] + m[i][3]*m[3][j] + m[i][4]*m[4][j]))"
    steps = [f"q0 AS (SELECT {by}, {n4} AS m, sqrt(list_sum(list_transform(h, lambda x: x*x))) * 2.0 AS sh FROM {src})"]
    steps.append(
        f"q1 AS (SELECT {by}, list_transform([1,2,3,4], lambda i: list_transform([1,2,3,4], lambda j: (m[i][j] + CASE WHEN i = j THEN sh ELSE 0.0 END) / (4.0 * sh))) AS m FROM q0)"
    )
    rounds = 24
    for k in range(2, 2 + rounds):
        steps.append(
            f"""q{k} AS (SELECT {by}, list_transform(p, lambda row: list_transform(row, lambda x: x / tr)) AS m
 FROM (SELECT {by}, p, p[1][1] + p[2][2] + p[3][3] + p[4][4] AS tr FROM (SELECT {by}, {mul} AS p FROM q{k - 1})))"""
        )
    last = f"q{1 + rounds}"
    steps.append(
        f"""qv AS (SELECT {by}, CASE WHEN m[1][1] >= greatest(m[2][2], m[3][3], m[4][4]) THEN m[1] WHEN m[2][2] >= greatest(m[3][3], m[4][4]) THEN m[2]
 WHEN m[3][3] >= m[4][4] THEN m[3] ELSE m[4] END AS v FROM {last}),
qn AS (SELECT {by}, v[1]/n AS w, v[2]/n AS x, v[3]/n AS y, v[4]/n AS z FROM (SELECT *, sqrt(v[1]*v[1]+v[2]*v[2]+v[3]*v[3]+v[4]*v[4]) AS n FROM qv)),
rot AS (SELECT {by}, [1-2*(y*y+z*z), 2*(x*y-w*z), 2*(x*z+w*y), 2*(x*y+w*z), 1-2*(x*x+z*z), 2*(y*z-w*x), 2*(x*z-w*y), 2*(y*z+w*x), 1-2*(x*x+y*y)] AS r FROM qn)"""
    )
    return ",\n".join(steps)


def _cells(f: str) -> str:
    return "[" + ", ".join(f.format(a=a, b=b) for a in ("sx", "sy", "sz") for b in ("dx", "dy", "dz")) + "]"


# noise of the noisy pairs: depends on the line number and tax
NOISE_SQL = "((l_linenumber % 5 - 2) * 0.05 + l_tax)"
POINTS_SQL = f"""p0 AS (SELECT l_suppkey AS seq, l_orderkey, l_linenumber, l_tax, l_quantity / 10 AS sx, l_discount * 50 AS sy, l_extendedprice / 20000 AS sz FROM lineitem),
p1 AS (SELECT *, {SCALE} AS ps, {R_SQL} AS pr, {T_SQL} AS pt FROM p0),
exact AS (SELECT seq, l_orderkey, l_linenumber, l_tax, sx, sy, sz,
  ps * (pr[1]*sx + pr[2]*sy + pr[3]*sz) + pt[1] AS dx, ps * (pr[4]*sx + pr[5]*sy + pr[6]*sz) + pt[2] AS dy, ps * (pr[7]*sx + pr[8]*sy + pr[9]*sz) + pt[3] AS dz FROM p1),
noisy AS (SELECT seq, l_orderkey, l_linenumber, l_tax, sx, sy, sz, dx + {NOISE_SQL} AS dx, dy, dz - {NOISE_SQL} AS dz FROM exact)"""
MOM_SQL = f"""mom AS (SELECT seq, [avg(sx), avg(sy), avg(sz)] AS ms, [avg(dx), avg(dy), avg(dz)] AS md, var_pop(sx)+var_pop(sy)+var_pop(sz) AS vs,
  var_pop(dx)+var_pop(dy)+var_pop(dz) AS vd, {_cells('covar_pop({a}, {b})')} AS h, count(*) AS n FROM {{src}} GROUP BY seq)"""
TRACE = "list_sum(list_transform(range(0, 9), lambda k: h[k + 1] * r[(k % 3) * 3 + k // 3 + 1]))"
FIT_OUT = """seq, round(s, 6) AS s, list_transform(r, lambda x: round(x, 6) + 0.0) AS r,
 [round(md[1] - s*(r[1]*ms[1]+r[2]*ms[2]+r[3]*ms[3]), 5) + 0.0, round(md[2] - s*(r[4]*ms[1]+r[5]*ms[2]+r[6]*ms[3]), 5) + 0.0, round(md[3] - s*(r[7]*ms[1]+r[8]*ms[2]+r[9]*ms[3]), 5) + 0.0] AS t, n"""


def noise():
    return (F.col("l_linenumber") % 5 - 2) * 0.05 + F.col("l_tax")


def fit_rounded(fits, *keys):
    def clean(c, d):
        return F.transform(c, lambda x: F.round(x, d) + 0.0)

    return fits.select(*keys, F.round("s", 6).alias("s"), clean(F.col("r"), 6).alias("r"), clean(F.col("t"), 5).alias("t"), "n")


@query(
    "umeyama_planted",
    f"""WITH {POINTS_SQL} SELECT seq, round(max(ps), 5) AS s, list_transform(max(pr), lambda x: round(x, 5) + 0.0) AS r,
 list_transform(max(pt), lambda x: round(x, 4) + 0.0) AS t, count(*) AS n FROM p1 GROUP BY seq""",
)
def umeyama_planted(spark, sf):
    fits = RG.umeyama(point_pairs(spark, sf), ["seq"])

    def clean(c, d):
        return F.transform(c, lambda x: F.round(x, d) + 0.0)

    return fits.select("seq", F.round("s", 5).alias("s"), clean(F.col("r"), 5).alias("r"), clean(F.col("t"), 4).alias("t"), "n")


@query(
    "umeyama",
    f"WITH {POINTS_SQL}, {MOM_SQL.format(src='noisy')}, {horn_sql('mom', 'seq')}, f AS (SELECT *, {TRACE} / vs AS s FROM mom JOIN rot USING (seq)) SELECT {FIT_OUT} FROM f",
)
def umeyama(spark, sf):
    return fit_rounded(RG.umeyama(point_pairs(spark, sf, noise()), ["seq"]), "seq")


@query(
    "estimate_sim3",
    f"WITH {POINTS_SQL}, {MOM_SQL.format(src='noisy')}, {horn_sql('mom', 'seq')}, f AS (SELECT *, sqrt(vd / vs) AS s FROM mom JOIN rot USING (seq)) SELECT {FIT_OUT} FROM f",
)
def estimate_sim3(spark, sf):
    return fit_rounded(RG.estimate_sim3(point_pairs(spark, sf, noise()), ["seq"]), "seq")


@query(
    "register_points",
    f"WITH {POINTS_SQL}, {MOM_SQL.format(src='noisy')}, {horn_sql('mom', 'seq')}, f AS (SELECT *, {SCALE} AS s FROM mom JOIN rot USING (seq)) SELECT {FIT_OUT} FROM f",
)
def register_points(spark, sf):
    pairs = point_pairs(spark, sf, noise())
    scales = pairs.select("seq").distinct().withColumn("scale", F.lit(1.5) + (F.col("seq") % 100) / 100.0)
    return fit_rounded(RG.register_points(pairs, ["seq"], scales), "seq")


def _weighted(src: str) -> str:
    w = "(1.0 + l_linenumber % 4)"
    return f"""wm AS (SELECT seq, sum({w}) AS w, [sum({w}*sx)/sum({w}), sum({w}*sy)/sum({w}), sum({w}*sz)/sum({w})] AS ms,
  [sum({w}*dx)/sum({w}), sum({w}*dy)/sum({w}), sum({w}*dz)/sum({w})] AS md FROM {src} GROUP BY seq),
mom AS (SELECT seq, any_value(ms) AS ms, any_value(md) AS md,
  [{', '.join(f'sum({w}*(s{a}-ms[{i + 1}])*(d{b}-md[{j + 1}]))/any_value(w)' for i, a in enumerate('xyz') for j, b in enumerate('xyz'))}] AS h,
  sum({w}*(pow(sx-ms[1],2)+pow(sy-ms[2],2)+pow(sz-ms[3],2)))/any_value(w) AS vs, sum({w}*(pow(dx-md[1],2)+pow(dy-md[2],2)+pow(dz-md[3],2)))/any_value(w) AS vd,
  count(*) AS n FROM {src} JOIN wm USING (seq) GROUP BY seq)"""


@query(
    "weighted_sim3",
    f"WITH {POINTS_SQL}, {_weighted('noisy')}, {horn_sql('mom', 'seq')}, f AS (SELECT *, sqrt(vd / vs) AS s FROM mom JOIN rot USING (seq)) SELECT {FIT_OUT} FROM f",
)
def weighted_sim3(spark, sf):
    pairs = point_pairs(spark, sf, noise()).withColumn("w", 1.0 + F.col("l_linenumber") % 4)
    return fit_rounded(RG.weighted_sim3(pairs, ["seq"], "w"), "seq")


@query(
    "weighted_rigid",
    f"WITH {POINTS_SQL}, {_weighted('noisy')}, {horn_sql('mom', 'seq')}, f AS (SELECT *, 1.0 AS s FROM mom JOIN rot USING (seq)) SELECT {FIT_OUT} FROM f",
)
def weighted_rigid(spark, sf):
    pairs = point_pairs(spark, sf, noise()).withColumn("w", 1.0 + F.col("l_linenumber") % 4)
    return fit_rounded(RG.weighted_sim3(pairs, ["seq"], "w", scale=False), "seq")


@query(
    "robust_sim3_planted",
    f"""WITH {POINTS_SQL} SELECT seq, round(max(ps), 4) AS s, list_transform(max(pr), lambda x: round(x, 4) + 0.0) AS r, count(*) AS n FROM p1 GROUP BY seq""",
)
def robust_sim3_planted(spark, sf):
    """Without noise every reweighting round must stay at the planted transform."""
    pairs = point_pairs(spark, sf).withColumn("w", 1.0 + F.col("l_linenumber") % 4)
    fits = RG.robust_sim3(pairs, ["seq"], "w")
    return fits.select("seq", F.round("s", 4).alias("s"), F.transform("r", lambda x: F.round(x, 4) + 0.0).alias("r"), "n")


@query("robust_sim3_outliers")
def robust_sim3_outliers(spark, sf):
    """Every seventh pair is far off; checked against brute force in the tests."""
    off = F.when(F.col("l_orderkey") % 7 == 0, F.lit(3.0)).otherwise(F.lit(0.0))
    pairs = point_pairs(spark, sf, off).withColumn("w", 1.0 + F.col("l_linenumber") % 4)
    return RG.robust_sim3(pairs, ["seq"], "w").select("seq", F.round("s", 3).alias("s"), "n", "status")


@query(
    "alignment_error",
    f"""WITH {POINTS_SQL}, {MOM_SQL.format(src='noisy')}, {horn_sql('mom', 'seq')}, f AS (SELECT *, {TRACE} / vs AS s FROM mom JOIN rot USING (seq)),
e AS (SELECT seq, sqrt(pow(dx - md[1] - s*(r[1]*(sx-ms[1])+r[2]*(sy-ms[2])+r[3]*(sz-ms[3])), 2) + pow(dy - md[2] - s*(r[4]*(sx-ms[1])+r[5]*(sy-ms[2])+r[6]*(sz-ms[3])), 2)
 + pow(dz - md[3] - s*(r[7]*(sx-ms[1])+r[8]*(sy-ms[2])+r[9]*(sz-ms[3])), 2)) AS e FROM noisy JOIN f USING (seq))
SELECT seq, round(avg(e), 5) AS mean_error, round(stddev_pop(e), 5) AS std_error, round(median(e), 5) AS median_error, round(max(e), 5) AS max_error, count(*) AS n_pairs FROM e GROUP BY seq""",
)
def alignment_error(spark, sf):
    pairs = point_pairs(spark, sf, noise())
    out = RG.alignment_error(pairs, RG.umeyama(pairs, ["seq"]), ["seq"])
    return out.withColumns({c: F.round(c, 5) for c in ("mean_error", "std_error", "median_error", "max_error")})


@query(
    "align_point_maps",
    f"""WITH {POINTS_SQL}, c AS (SELECT *, (l_orderkey % 10) / 10.0 AS ca, (l_orderkey % 7) / 7.0 AS cb FROM noisy WHERE (l_orderkey % 10) / 10.0 > 0.3 AND (l_orderkey % 7) / 7.0 > 0.3),
u AS (SELECT * FROM c QUALIFY count(*) OVER (PARTITION BY seq, l_orderkey, l_linenumber) = 1),
{MOM_SQL.format(src='u')}, {horn_sql('mom', 'seq')}, f AS (SELECT *, sqrt(vd / vs) AS s FROM mom JOIN rot USING (seq)) SELECT {FIT_OUT} FROM f""",
)
def align_point_maps(spark, sf):
    from pyspark.sql import Window

    pairs = point_pairs(spark, sf, noise())
    one = F.count(F.lit(1)).over(Window.partitionBy("seq", "l_orderkey", "l_linenumber")) == 1
    pairs = pairs.withColumn("_one", one).where("_one")
    keys = ["l_orderkey", "l_linenumber"]
    a = pairs.select("seq", *keys, F.col("dx").alias("x"), F.col("dy").alias("y"), F.col("dz").alias("z"), ((F.col("l_orderkey") % 10) / 10.0).alias("conf"))
    b = pairs.select("seq", *keys, F.col("sx").alias("x"), F.col("sy").alias("y"), F.col("sz").alias("z"), ((F.col("l_orderkey") % 7) / 7.0).alias("conf"))
    fits, _ = RG.align_point_maps(a, b, 0.3, ["seq"], keys, robust=False)
    return fit_rounded(fits, "seq")


@query("align_point_maps_robust")
def align_point_maps_robust(spark, sf):
    """The default robust fit on all rows: repeated keys become pixels by their position within the key; checked against brute force in the tests."""
    keys = ["l_orderkey", "l_linenumber", "nth"]
    order = [F.col(c) for c in ("sx", "sy", "sz", "dx", "dy", "dz")]
    pairs = K.ranked(point_pairs(spark, sf, noise()), ["seq", *keys[:2]], order, "nth")
    a = pairs.select("seq", *keys, F.col("dx").alias("x"), F.col("dy").alias("y"), F.col("dz").alias("z"), ((F.col("l_orderkey") % 10) / 10.0).alias("conf"))
    b = pairs.select("seq", *keys, F.col("sx").alias("x"), F.col("sy").alias("y"), F.col("sz").alias("z"), ((F.col("l_orderkey") % 7) / 7.0).alias("conf"))
    fits, _ = RG.align_point_maps(a, b, 0.3, ["seq"], keys)
    return fit_rounded(fits, "seq")


@query(
    "ransac_sim3",
    f"""WITH {POINTS_SQL}, i AS (SELECT * FROM exact WHERE l_orderkey % 5 > 0)
SELECT seq, round(max({SCALE}), 4) AS s, count(*) AS inliers FROM i GROUP BY seq""",
)
def ransac_sim3(spark, sf):
    """Every fifth order is an outlier; the winning model keeps exactly the others."""
    off = F.when(F.col("l_orderkey") % 5 == 0, 5.0 + F.col("l_orderkey") % 11 + F.col("l_linenumber")).otherwise(F.lit(0.0))
    out = RG.ransac_sim3(point_pairs(spark, sf, off), ["seq"], ["l_orderkey", "l_linenumber", "sz"], n=32)
    return out.select("seq", F.round("s", 4).alias("s"), "inliers")


# --- poses: rotation about z and x per line item, planted rigid motion per supplier -----------------


def pose_pairs(spark, sf, tilt: bool = False):
    """Poses about z; with ``tilt`` also about x, so that viewing directions spread."""
    li = table(spark, sf, "lineitem").select("l_suppkey", "l_orderkey", "l_linenumber", "l_quantity", "l_discount", "l_extendedprice")
    a = F.col("l_quantity") / 10
    c, s, z = F.cos(a), F.sin(a), F.lit(0.0)
    base = li.select(
        F.col("l_suppkey").alias("seq"), "l_orderkey", "l_linenumber",
        F.array(c, -s, z, s, c, z, z, z, F.lit(1.0)).alias("src_r"),
        C.vec(F.col("l_quantity") / 10, F.col("l_discount") * 50, F.col("l_extendedprice") / 20000).alias("src_t"),
    ).withColumn("g", planted(F.col("seq")))
    if tilt:
        b = F.col("l_linenumber") * 0.4 + F.col("l_orderkey") % 7 / 10
        about_x = F.array(F.lit(1.0), z, z, z, F.cos(b), -F.sin(b), z, F.sin(b), F.cos(b))
        base = base.withColumn("src_r", C.mat_mul("src_r", about_x))
    return base.select(
        "seq", "src_r", "src_t", C.mat_mul("g.r", "src_r").alias("dst_r"), F.array(*C.sim3_apply("g", C.components("src_t"))).alias("dst_t")
    )


PLANTED_SQL = f"""SELECT seq, list_transform({R_SQL}, lambda x: round(x, 5) + 0.0) AS r, list_transform({T_SQL}, lambda x: round(x, 4) + 0.0) AS t, n
FROM (SELECT l_suppkey AS seq, count(*) AS n FROM lineitem GROUP BY 1)"""


def _pose_out(fits):
    return fits.select(
        "seq", F.transform("r", lambda x: F.round(x, 5) + 0.0).alias("r"), F.transform("t", lambda x: F.round(x, 4) + 0.0).alias("t"), "n"
    )


def _scales(pairs):
    return pairs.select("seq").distinct().withColumn("scale", F.lit(1.5) + (F.col("seq") % 100) / 100.0)


@query("register_poses", PLANTED_SQL)
def register_poses(spark, sf):
    pairs = pose_pairs(spark, sf)
    return _pose_out(RG.register_poses(pairs, ["seq"], _scales(pairs)))


@query("register_views", PLANTED_SQL)
def register_views(spark, sf):
    pairs = pose_pairs(spark, sf, tilt=True)
    return _pose_out(RG.register_views(pairs, ["seq"], _scales(pairs)))


# --- transform chains -------------------------------------------------------------------------------


def steps(spark, sf):
    ev = table(spark, sf, "events").select(F.col("user_id").alias("scene"), "ts", "event_id", "value")
    numbered = W.number_frames(ev, ["scene"], [F.col("ts"), F.col("event_id")], "node")
    a = F.col("value") / 100
    c, s, z = F.cos(a), F.sin(a), F.lit(0.0)
    g = C.sim3(1.0 + (F.col("event_id") % 5 - 2) / 100.0, F.array(c, -s, z, s, c, z, z, z, F.lit(1.0)), C.vec(F.col("value") / 50, (F.col("event_id") % 3).cast("double"), F.lit(0.5)))
    return numbered.select("scene", "node", g.alias("sim3"))


# rotations about z add up and scales multiply, so the chain has a closed form per component
CHAIN_SQL = """st AS (SELECT user_id AS scene, row_number() OVER w - 1 AS node, value / 100 AS a, ln(1.0 + (event_id % 5 - 2) / 100.0) AS ls,
  value / 50 AS tx, CAST(event_id % 3 AS DOUBLE) AS ty FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
pre AS (SELECT *, coalesce(sum(a) OVER p, 0) AS pa, coalesce(sum(ls) OVER p, 0) AS pl FROM st WINDOW p AS (PARTITION BY scene ORDER BY node ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
tot AS (SELECT scene, node, exp(pl + ls) AS s, pa + a AS ang,
  sum(exp(pl) * (cos(pa) * tx - sin(pa) * ty)) OVER c AS x, sum(exp(pl) * (sin(pa) * tx + cos(pa) * ty)) OVER c AS y, sum(exp(pl) * 0.5) OVER c AS z
  FROM pre WINDOW c AS (PARTITION BY scene ORDER BY node))"""


@query(
    "accumulate_sim3",
    f"WITH {CHAIN_SQL} SELECT scene, node, round(s, 6) AS s, round(cos(ang), 6) + 0.0 AS r0, round(x, 5) + 0.0 AS x, round(y, 5) + 0.0 AS y, round(z, 5) + 0.0 AS z FROM tot",
)
def accumulate_sim3(spark, sf):
    out = G.accumulate_sim3(steps(spark, sf), ["scene"], "node", block=16)
    t = F.col("total")
    return out.select(
        "scene", "node", F.round(t["s"], 6).alias("s"), (F.round(t["r"][0], 6) + 0.0).alias("r0"),
        *[(F.round(t["t"][i], 5) + 0.0).alias(a) for i, a in enumerate("xyz")],
    )


@query(
    "to_relative",
    f"WITH {CHAIN_SQL} SELECT scene, node, round(exp(ls), 6) AS s, round(tx, 5) + 0.0 AS x, round(ty, 5) + 0.0 AS y FROM st",
)
def to_relative(spark, sf):
    """Relative steps of the absolute poses give back the steps they came from."""
    out = G.to_relative(G.to_absolute(steps(spark, sf), ["scene"], "node"), ["scene"], "node")
    g = F.col("sim3")
    return out.select("scene", "node", F.round(g["s"], 6).alias("s"), (F.round(g["t"][0], 5) + 0.0).alias("x"), (F.round(g["t"][1], 5) + 0.0).alias("y"))


@query(
    "sim3_between",
    f"WITH {CHAIN_SQL} SELECT scene, node, round(exp(ls) / 2.0, 6) AS s, round(tx - exp(ls) / 2.0 * (cos(a) * 1.0 - sin(a) * 2.0), 5) + 0.0 AS x FROM st",
)
def sim3_between(spark, sf):
    one = C.sim3(F.lit(2.0), C.identity_matrix(), C.vec(F.lit(1.0), F.lit(2.0), F.lit(3.0)))
    out = steps(spark, sf).withColumn("b", C.sim3_between(one, "sim3"))
    return out.select("scene", "node", F.round("b.s", 6).alias("s"), (F.round(F.col("b.t")[0], 5) + 0.0).alias("x"))


# --- trajectories -----------------------------------------------------------------------------------


def trajectories(spark, sf):
    """Events as two trajectories: the estimate is a rotated, scaled and perturbed copy."""
    ev = table(spark, sf, "events").select(F.col("user_id").alias("seq"), "ts", "event_id", "value")
    n = F.col("event_id")
    t = C.epoch_micros("ts") / 1e6
    half = (F.col("value") / 200) / 2
    ref = ev.select(
        "seq", "event_id", t.alias("ts"), (F.col("value") / 10).alias("x"), (n % 17).cast("double").alias("y"), (n % 5 * 0.5).alias("z"),
        F.cos(half).alias("qw"), F.lit(0.0).alias("qx"), F.lit(0.0).alias("qy"), F.sin(half).alias("qz"),
    )
    # estimate: (x, y, z) -> 2 * Rz(90°) + noise, orientation turned by 90° plus a small wobble
    turn = half + 0.7853981633974483 + (n % 3) * 0.005
    est = ev.select(
        "seq", "event_id", (t + 0.2).alias("ts"), (-(n % 17) * 2.0 + (n % 4) * 0.1).alias("x"), (F.col("value") / 10 * 2).alias("y"), (n % 5 * 1.0 + 3).alias("z"),
        F.cos(turn).alias("qw"), F.lit(0.0).alias("qx"), F.lit(0.0).alias("qy"), F.sin(turn).alias("qz"),
    )
    return ref, est


@query(
    "associate",
    """WITH r AS (SELECT user_id AS seq, epoch_us(ts) / 1e6 AS ts FROM events),
e AS (SELECT user_id AS seq, epoch_us(ts) / 1e6 + 5000 AS ts FROM events),
a AS (SELECT e.seq, e.ts AS est_ts, r.ts AS ref_ts FROM e ASOF JOIN r ON e.seq = r.seq AND e.ts >= r.ts),
b AS (SELECT e.seq, e.ts AS est_ts, r.ts AS ref_ts FROM e ASOF JOIN r ON e.seq = r.seq AND e.ts <= r.ts),
u AS (SELECT seq, est_ts, ref_ts, row_number() OVER (PARTITION BY seq, est_ts ORDER BY abs(est_ts - ref_ts), ref_ts) AS rn FROM (SELECT * FROM a UNION ALL SELECT * FROM b))
SELECT seq, round(est_ts, 5) AS est_ts, round(ref_ts, 5) AS ref_ts FROM u WHERE rn = 1 AND abs(est_ts - ref_ts) <= 4000""",
)
def associate(spark, sf):
    ev = table(spark, sf, "events").select(F.col("user_id").alias("seq"), "event_id", (C.epoch_micros("ts") / 1e6).alias("ts"))
    out = TR.associate(ev, ev.withColumn("ts", F.col("ts") + 5000), 4000.0)
    return out.select("seq", F.round("est_ts", 5).alias("est_ts"), F.round("ref_ts", 5).alias("ref_ts"))


TRAJ_SQL = f"""noisy AS (SELECT user_id AS seq, ts, event_id, -(event_id % 17) * 2.0 + (event_id % 4) * 0.1 AS sx, value / 10 * 2 AS sy, event_id % 5 * 1.0 + 3 AS sz,
  value / 10 AS dx, CAST(event_id % 17 AS DOUBLE) AS dy, event_id % 5 * 0.5 AS dz, value / 200 AS yaw, (event_id % 3) * 0.01 AS wob FROM events),
{MOM_SQL.format(src='noisy')}, {horn_sql('mom', 'seq')}, f AS (SELECT *, {TRACE} / vs AS s FROM mom JOIN rot USING (seq))"""


def _paired(spark, sf):
    ref, est = trajectories(spark, sf)
    return TR.associate_by_position(ref, est, ["seq"], [F.col("ts"), F.col("event_id")], list(TR.POSE))


@query(
    "ate",
    f"""WITH {TRAJ_SQL} SELECT seq, round(sqrt(avg(pow(dx - md[1] - s*(r[1]*(sx-ms[1])+r[2]*(sy-ms[2])+r[3]*(sz-ms[3])), 2) + pow(dy - md[2] - s*(r[4]*(sx-ms[1])+r[5]*(sy-ms[2])+r[6]*(sz-ms[3])), 2)
 + pow(dz - md[3] - s*(r[7]*(sx-ms[1])+r[8]*(sy-ms[2])+r[9]*(sz-ms[3])), 2))), 5) AS ate, count(*) AS n_poses FROM noisy JOIN f USING (seq) GROUP BY seq""",
)
def ate(spark, sf):
    return TR.ate(_paired(spark, sf), ["seq"]).withColumn("ate", F.round("ate", 5))


@query(
    "rpe",
    f"""WITH {TRAJ_SQL}, w AS (SELECT n.*, f.s AS sc, lead(sx) OVER o - sx AS ex, lead(sy) OVER o - sy AS ey, lead(sz) OVER o - sz AS ez,
  lead(dx) OVER o - dx AS rx, lead(dy) OVER o - dy AS ry, lead(dz) OVER o - dz AS rz, lead(wob) OVER o - wob AS dw, yaw + 1.5707963267948966 + wob AS ey0
  FROM noisy n JOIN f USING (seq) WINDOW o AS (PARTITION BY seq ORDER BY ts, event_id)),
d AS (SELECT seq, dw, sc * (cos(ey0)*ex + sin(ey0)*ey) - (cos(yaw)*rx + sin(yaw)*ry) AS a, sc * (-sin(ey0)*ex + cos(ey0)*ey) - (-sin(yaw)*rx + cos(yaw)*ry) AS b, sc * ez - rz AS c FROM w WHERE dw IS NOT NULL)
SELECT seq, round(sqrt(avg(a*a + b*b + c*c)), 5) AS rpe_trans, round(sqrt(avg(pow(degrees(dw), 2))), 5) AS rpe_rot, count(*) AS n_pairs FROM d GROUP BY seq""",
)
def rpe(spark, sf):
    out = TR.rpe(_paired(spark, sf), ["seq"], "pos")
    return out.withColumns({"rpe_trans": F.round("rpe_trans", 5), "rpe_rot": F.round("rpe_rot", 5)})
