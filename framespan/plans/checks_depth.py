"""Queries: robust scale, alignment, depth metrics and roll-ups."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framespan.operators import datasets as D
from framespan.operators import metrics as M
from framespan.operators import robust as RB
from framespan.plans.registry import PAIRS_SQL, depth_pairs, query, table

MAX_DEPTH = 60000.0


def rounded(df: DataFrame, names, digits: int = 4) -> DataFrame:
    # Reweighting divides by residuals near zero, so summation order shows in the last digits.
    coarse = {"sq_rel", "rmse", "shift"}  # in millimetres
    return df.withColumns({n: F.round(F.col(n), 0 if n in coarse else digits) for n in names})


def valid_pairs(spark, sf):
    return depth_pairs(spark, sf).where((F.col("gt") > 0) & (F.col("gt") < MAX_DEPTH))


VALID_SQL = f"{PAIRS_SQL}, vp AS (SELECT * FROM pairs WHERE gt > 0 AND gt < {MAX_DEPTH})"


def power_sql(size: str) -> str:
    """A power of two above the largest value of a group."""
    return f"pow(2.0, ceil(log2(greatest(max({size}), 1e-30) * 1.3)))"


def exact_terms(terms: dict[str, tuple[str, str]]) -> str:
    """Columns of the limbs of each term (value, bound), as the engine cuts them."""
    out = []
    for name, (value, bound) in terms.items():
        out.append(f"{value} AS {name}_v0")
        for k in range(3):
            unit = f"({bound} / {2.0 ** (31 * (k + 1))!r})"
            out.append(f"CAST(floor({name}_v{k} / {unit}) AS BIGINT) AS {name}_q{k}")
            out.append(f"{name}_v{k} - CAST({name}_q{k} AS DOUBLE) * {unit} AS {name}_v{k + 1}")
    return ", ".join(out)


def exact_sum(name: str, bound: str) -> str:
    """The sum of a term from its limbs, the same in any order of the rows."""
    parts = [f"CAST(CAST(sum({name}_q{k}) AS BIGINT) AS DOUBLE) * (max({bound}) / {2.0 ** (31 * (k + 1))!r})" for k in range(3)]
    return f"(({parts[0]} + {parts[1]}) + {parts[2]})"


def irls_sql(src: str, by: str, start: str, residual: str, cross: str, square: str, iters: int = 10, tol: float | None = None, low: float | None = None, size: str = "greatest(abs(gt), abs(pred))", wide: float = 1.0) -> str:
    """The unrolled passes as CTEs; ``{s}`` in ``residual`` is the current scale, ``start`` is "top / low" and in means where ``wide`` is 1."""

    def clamp(x: str) -> str:
        return x if low is None else f"greatest({x}, {low})"

    over, under = start.split(" / ")
    bound = "k.top" if wide == 1.0 else f"k.top * k.top * {wide!r}"
    terms = {"p": (over, bound), "q": (under, bound)}
    count = "/ count(*)" if wide == 1.0 else ""
    top = bound.replace("k.top", "top")
    out = [
        f"z0 AS (SELECT {by}, {power_sql(size)} AS top FROM {src} GROUP BY {by})",
        f"y0 AS (SELECT {by}, k.top, {exact_terms(terms)} FROM {src} JOIN z0 k USING ({by}))",
        f"s0 AS (SELECT {by}, {clamp(f'({exact_sum("p", top)} {count}) / ({exact_sum("q", top)} {count})')} AS s, false AS done, max(top) AS top FROM y0 GROUP BY {by})",
    ]
    for i in range(1, iters + 1):
        w = f"(1.0 / ({residual.format(s='k.s')} + 1e-8))"
        bound = f"(top * top * {2.0**27!r})"
        terms = {"p": (f"{w} * {cross}", bound.replace("top", "k.top")), "q": (f"{w} * {square}", bound.replace("top", "k.top"))}
        fresh = clamp(f"{exact_sum('p', bound)} / {exact_sum('q', bound)}")
        stop = "false" if tol is None else f"abs({fresh} - max(s)) < {tol}"
        out.append(f"y{i} AS (SELECT {by}, k.s, k.done, k.top, {exact_terms(terms)} FROM {src} JOIN s{i - 1} k USING ({by}))")
        out.append(
            f"s{i} AS (SELECT {by}, CASE WHEN bool_or(done) THEN max(s) ELSE {fresh} END AS s, bool_or(done) OR {stop} AS done, max(top) AS top "
            f"FROM y{i} GROUP BY {by})"
        )
    return ",\n".join(out)


EVAL_SQL = irls_sql("vp", "seq", "gt / pred", "abs({s} * pred - gt)", "pred * gt", "pred * pred")


@query("irls_scale_eval", f"WITH {VALID_SQL}, {EVAL_SQL} SELECT seq, round(greatest(s, 1e-3), 3) AS scale FROM s10")
def irls_scale_eval(spark, sf):
    return rounded(RB.irls_scale_eval(valid_pairs(spark, sf), ["seq"]), ["scale"], 3)


@query(
    "irls_scale_depth",
    f"""WITH {VALID_SQL}, {irls_sql('vp', 'seq', 'gt / pred', 'abs({s} * pred - gt)', 'pred * gt', 'pred * pred', tol=0.05, low=1e-6)}
SELECT seq, round(s, 4) AS scale, done AS converged FROM s10""",
)
def irls_scale_depth(spark, sf):
    return rounded(RB.irls_scale_depth(valid_pairs(spark, sf), ["seq"]), ["scale"])


@query(
    "irls_scale_points",
    f"""WITH {VALID_SQL}, pp AS (SELECT seq, pred AS sx, idx * 2000.0 AS sy, pred * 0.5 AS sz, gt AS dx, idx * 3000.0 AS dy, gt * 0.5 AS dz FROM vp),
{irls_sql('pp', 'seq', '(sx*dx + sy*dy + sz*dz) / (sx*sx + sy*sy + sz*sz)', 'sqrt(({s}*sx - dx) * ({s}*sx - dx) + ({s}*sy - dy) * ({s}*sy - dy) + ({s}*sz - dz) * ({s}*sz - dz))', '(sx*dx + sy*dy + sz*dz)', '(sx*sx + sy*sy + sz*sz)', tol=0.05, low=1e-6,
size='greatest(abs(sx), abs(sy), abs(sz), abs(dx), abs(dy), abs(dz))', wide=4.0)}
SELECT seq, round(s, 4) AS scale, done AS converged FROM s10""",
)
def irls_scale_points(spark, sf):
    p = valid_pairs(spark, sf)
    pts = p.select(
        "seq", F.col("pred").alias("sx"), (F.col("idx") * 2000.0).alias("sy"), (F.col("pred") * 0.5).alias("sz"),
        F.col("gt").alias("dx"), (F.col("idx") * 3000.0).alias("dy"), (F.col("gt") * 0.5).alias("dz"),
    )
    return rounded(RB.irls_scale_points(pts, ["seq"]), ["scale"])


@query(
    "align_lstsq",
    f"WITH {VALID_SQL} SELECT seq, round(regr_slope(gt, pred), 4) AS scale, round(regr_intercept(gt, pred), 0) AS shift FROM vp GROUP BY seq",
)
def align_lstsq(spark, sf):
    return rounded(RB.align(valid_pairs(spark, sf), ["seq"], "lstsq"), ["scale", "shift"])


@query(
    "align_median",
    f"""WITH {VALID_SQL}, r AS (SELECT seq, gt, pred, row_number() OVER (PARTITION BY seq ORDER BY gt) AS a, row_number() OVER (PARTITION BY seq ORDER BY pred) AS b,
 count(*) OVER (PARTITION BY seq) AS n FROM vp)
SELECT seq, round(max(gt) FILTER (WHERE a = (n + 1) // 2) / max(pred) FILTER (WHERE b = (n + 1) // 2), 8) AS scale, CAST(0 AS DOUBLE) AS shift FROM r GROUP BY seq""",
)
def align_median(spark, sf):
    return rounded(RB.align(valid_pairs(spark, sf), ["seq"], "median"), ["scale"], 8)


def _lad_sql(iters: int = 10) -> str:
    out = [
        """r AS (SELECT seq, gt, pred, row_number() OVER (PARTITION BY seq ORDER BY gt) AS a, row_number() OVER (PARTITION BY seq ORDER BY pred) AS b,
 count(*) OVER (PARTITION BY seq) AS n FROM vp)""",
        "l0 AS (SELECT seq, max(gt) FILTER (WHERE a = (n + 1) // 2) / max(pred) FILTER (WHERE b = (n + 1) // 2) AS s, 0.0 AS t FROM r GROUP BY seq)",
    ]
    out.append(f"h AS (SELECT seq, {power_sql('greatest(abs(gt), abs(pred))')} AS top FROM vp GROUP BY seq)")
    first = f"{2.0**27!r}"
    terms = {"w": ("wt", first), "a": ("wt*pred", f"({first} * top)"), "b": ("wt*gt", f"({first} * top)"), "aa": ("wt*pred*pred", f"({first} * top * top)"), "ab": ("wt*pred*gt", f"({first} * top * top)")}
    sums = ", ".join(f"{exact_sum(name, bound)} AS {name}" for name, (_, bound) in terms.items())
    for i in range(1, iters + 1):
        out.append(f"n{i} AS (SELECT vp.seq, pred, gt, h.top AS top, 1.0 / (abs(k.s * pred + k.t - gt) + 1e-8) AS wt FROM vp JOIN l{i - 1} k ON vp.seq = k.seq JOIN h ON vp.seq = h.seq)")
        out.append(f"o{i} AS (SELECT seq, top, {exact_terms(terms)} FROM n{i})")
        out.append(f"m{i} AS (SELECT seq, {sums} FROM o{i} GROUP BY seq)")
        out.append(f"l{i} AS (SELECT seq, (w*ab - a*b) / (w*aa - a*a) AS s, (aa*b - a*ab) / (w*aa - a*a) AS t FROM m{i})")
    return ",\n".join(out)


@query("align_l1_scale_shift", f"WITH {VALID_SQL}, {_lad_sql()} SELECT seq, round(s, 4) AS scale, round(t, 0) AS shift FROM l10")
def align_l1_scale_shift(spark, sf):
    return rounded(RB.l1_scale_shift(valid_pairs(spark, sf), ["seq"]), ["scale", "shift"])


METRIC_SQL = """abs(p - gt) / gt AS e1, (p - gt) * (p - gt) / gt AS e2, (p - gt) * (p - gt) AS e3,
 pow(ln(greatest(p, 1e-5)) - ln(gt), 2) AS e4, greatest(greatest(p, 1e-5) / gt, gt / greatest(p, 1e-5)) AS ratio"""
METRIC_AGG = """round(coalesce(avg(e1), 0), 4) AS abs_rel, round(coalesce(avg(e2), 0), 0) AS sq_rel, round(coalesce(sqrt(avg(e3)), 0), 0) AS rmse,
 round(coalesce(sqrt(avg(e4)), 0), 4) AS log_rmse, round(coalesce(avg(CASE WHEN ratio < 1.25 THEN 1.0 ELSE 0.0 END), 0), 4) AS d1,
 round(coalesce(avg(CASE WHEN ratio < 1.5625 THEN 1.0 ELSE 0.0 END), 0), 4) AS d2, round(coalesce(avg(CASE WHEN ratio < 1.953125 THEN 1.0 ELSE 0.0 END), 0), 4) AS d3"""
SCALE_SQL = irls_sql("vp", "seq", "gt / pred", "abs({s} * pred - gt)", "pred * gt", "pred * pred")


def alignment(spark, sf):
    return RB.irls_scale_eval(valid_pairs(spark, sf), ["seq"]).withColumn("shift", F.lit(0.0))


SCALED_SQL = f"""{VALID_SQL}, {SCALE_SQL},
al AS (SELECT dataset, seq, gt, greatest(s, 1e-3) * pred AS p FROM vp JOIN s10 USING (seq)), er AS (SELECT dataset, seq, gt, p, {METRIC_SQL} FROM al)"""


@query("depth_metrics", f"WITH {SCALED_SQL} SELECT dataset, seq, {METRIC_AGG}, count(*) AS valid_pixels FROM er GROUP BY dataset, seq")
def depth_metrics(spark, sf):
    pairs = depth_pairs(spark, sf)
    fit = alignment(spark, sf).withColumn("dataset", F.col("seq") % 5)
    out = M.depth_metrics(pairs, ["dataset", "seq"], fit, max_depth=MAX_DEPTH)
    return rounded(out, M.DEPTH_METRICS)


@query(
    "depth_metrics_masked",
    f"""WITH {VALID_SQL}, r AS (SELECT seq, gt, pred, row_number() OVER (PARTITION BY seq ORDER BY gt) AS a, row_number() OVER (PARTITION BY seq ORDER BY least(greatest(pred, 5000), 50000)) AS b,
 count(*) OVER (PARTITION BY seq) AS n FROM vp),
k AS (SELECT seq, max(gt) FILTER (WHERE a = (n + 1) // 2) / max(least(greatest(pred, 5000), 50000)) FILTER (WHERE b = (n + 1) // 2) AS s FROM r GROUP BY seq),
al AS (SELECT seq, gt, least(greatest(s * least(greatest(pred, 5000), 50000), 1000.0), 45000.0) AS p FROM vp JOIN k USING (seq) WHERE idx % 3 > 0 AND seq % 7 > 0),
er AS (SELECT seq, gt, p, {METRIC_SQL} FROM al), al2 AS (SELECT DISTINCT seq FROM pairs)
SELECT al2.seq, {METRIC_AGG}, count(p) AS valid_pixels FROM al2 LEFT JOIN er USING (seq) GROUP BY al2.seq""",
)
def depth_metrics_masked(spark, sf):
    pairs = depth_pairs(spark, sf).withColumn("keep", (F.col("idx") % 3 > 0) & (F.col("seq") % 7 > 0))
    out = M.depth_metrics(pairs, ["seq"], method="median", max_depth=MAX_DEPTH, pre_clip=(5000.0, 50000.0), post_clip=(1000.0, 45000.0), mask="keep")
    return rounded(out, M.DEPTH_METRICS)


DISP_EVAL = irls_sql("dp", "seq", "g / pred", "abs({s} * pred - g)", "pred * g", "pred * pred", size="greatest(abs(g), abs(pred))")


@query(
    "depth_metrics_disparity",
    f"""WITH {VALID_SQL}, dp AS (SELECT seq, gt, pred, 1.0 / (gt + 1e-8) AS g FROM vp), {DISP_EVAL},
al AS (SELECT seq, gt, CASE WHEN greatest(s, 1e-3) * pred > 0 THEN 1.0 / (greatest(s, 1e-3) * pred) ELSE 0.0 END AS p FROM dp JOIN s10 USING (seq)),
er AS (SELECT seq, gt, p, {METRIC_SQL} FROM al) SELECT seq, {METRIC_AGG}, count(*) AS valid_pixels FROM er GROUP BY seq""",
)
def depth_metrics_disparity(spark, sf):
    out = M.depth_metrics(depth_pairs(spark, sf), ["seq"], max_depth=MAX_DEPTH, disparity=True)
    return rounded(out, M.DEPTH_METRICS)


@query(
    "error_map",
    f"""WITH {VALID_SQL}, k AS (SELECT seq, regr_slope(gt, pred) AS a, regr_intercept(gt, pred) AS b FROM vp GROUP BY seq)
SELECT seq, frame_id, idx, round(CASE WHEN gt > 0 AND gt < {MAX_DEPTH} THEN abs(a * pred + b - gt) / gt ELSE 0.0 END, 4) AS error
FROM pairs JOIN k USING (seq)""",
)
def error_map(spark, sf):
    pairs = depth_pairs(spark, sf)
    fit = M.depth_alignment(pairs, ["seq"], "lstsq", MAX_DEPTH)
    out = M.error_map(pairs, fit, ["seq"], MAX_DEPTH)
    return rounded(out, ["error"]).select("seq", "frame_id", "idx", "error")


@query(
    "weighted_rollup",
    f"""WITH {SCALED_SQL}, m AS (SELECT dataset, seq, avg(e1) AS abs_rel, sqrt(avg(e3)) AS rmse, count(*) AS valid_pixels FROM er GROUP BY dataset, seq)
SELECT dataset, seq, round(sum(abs_rel * valid_pixels) / sum(valid_pixels), 4) AS abs_rel, round(sum(rmse * valid_pixels) / sum(valid_pixels), 0) AS rmse,
 CAST(sum(valid_pixels) AS BIGINT) AS valid_pixels FROM m GROUP BY ROLLUP (dataset, seq)""",
)
def weighted_rollup(spark, sf):
    fit = alignment(spark, sf).withColumn("dataset", F.col("seq") % 5)
    metrics = M.depth_metrics(depth_pairs(spark, sf), ["dataset", "seq"], fit, max_depth=MAX_DEPTH)
    return rounded(M.weighted_rollup(metrics, names=["abs_rel", "rmse"]), ["abs_rel", "rmse"])


@query(
    "mean_rollup",
    """WITH m AS (SELECT user_id AS seq, event_type AS dataset, avg(value) AS ate, max(value) AS rpe FROM events GROUP BY 1, 2)
SELECT dataset, round(coalesce(avg(ate), 0), 4) AS ate, round(coalesce(avg(rpe), 0), 4) AS rpe, count(*) AS n FROM m GROUP BY dataset""",
)
def mean_rollup(spark, sf):
    m = table(spark, sf, "events").groupBy(F.col("user_id").alias("seq"), F.col("event_type").alias("dataset")).agg(
        F.avg("value").alias("ate"), F.max("value").alias("rpe")
    )
    return rounded(M.mean_rollup(m, ["dataset"], ["ate", "rpe"]), ["ate", "rpe"])


@query(
    "mean_rollup_by_size",
    """WITH s AS (SELECT event_type AS dataset, count(DISTINCT user_id) AS size FROM events GROUP BY 1),
m AS (SELECT user_id AS seq, event_type AS dataset, avg(value) AS acc, min(value) AS comp FROM events WHERE value > 15 GROUP BY 1, 2)
SELECT s.dataset, round(coalesce(sum(acc) / max(size), 0), 4) AS acc, round(coalesce(sum((acc + comp) / 2) / max(size), 0), 4) AS nc, count(acc) AS n
FROM s LEFT JOIN m USING (dataset) GROUP BY s.dataset""",
)
def mean_rollup_by_size(spark, sf):
    ev = table(spark, sf, "events").withColumnRenamed("event_type", "dataset")
    sizes = ev.groupBy("dataset").agg(F.countDistinct("user_id").alias("size"))
    m = ev.where("value > 15").groupBy(F.col("user_id").alias("seq"), "dataset").agg(
        F.avg("value").alias("acc"), F.min("value").alias("comp")
    )
    m = m.withColumn("nc", (F.col("acc") + F.col("comp")) / 2)
    return rounded(M.mean_rollup(m, ["dataset"], ["acc", "nc"], sizes), ["acc", "nc"])


@query(
    "pooled_mean",
    """WITH w AS (SELECT user_id, event_type, avg(value) AS v, count(*) AS n FROM events GROUP BY 1, 2)
SELECT event_type, round(sum(v * n) / sum(n), 4) AS pooled_mean, CAST(sum(n) AS BIGINT) AS total_count FROM w GROUP BY event_type""",
)
def pooled_mean(spark, sf):
    w = table(spark, sf, "events").groupBy("user_id", "event_type").agg(F.avg("value").alias("v"), F.count(F.lit(1)).alias("n"))
    return rounded(M.pooled_mean(w, ["event_type"], "v", "n"), ["pooled_mean"])


@query(
    "pair_by_sequence",
    """WITH p AS (SELECT 'seq' || source AS seq, 'out/seq' || source || '/frame_' || lpad(CAST(doc_id AS VARCHAR), 8, '0') || '.npy' AS path FROM documents),
g AS (SELECT 'seq' || source AS seq, 'gt/seq' || source || '_depth/d' || lpad(CAST(doc_id * 3 AS VARCHAR), 8, '0') || '.png' AS path FROM documents WHERE n_chars < 2000),
pr AS (SELECT seq, path, row_number() OVER (PARTITION BY seq ORDER BY path) AS pos FROM p), gr AS (SELECT seq, path, row_number() OVER (PARTITION BY seq ORDER BY path) AS pos FROM g)
SELECT seq, pos, pr.path AS pred_path, gr.path AS gt_path FROM pr JOIN gr USING (seq, pos)""",
)
def pair_by_sequence(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "source", "n_chars")

    def name(c):
        return F.lpad(c.cast("string"), 8, "0")

    pred = docs.select(F.concat(F.lit("out/seq"), "source", F.lit("/frame_"), name(F.col("doc_id")), F.lit(".npy")).alias("path"))
    gt = docs.where("n_chars < 2000").select(F.concat(F.lit("gt/seq"), "source", F.lit("_depth/d"), name(F.col("doc_id") * 3), F.lit(".png")).alias("path"))
    return D.pair_by_sequence(pred, gt, strip="_depth$")
