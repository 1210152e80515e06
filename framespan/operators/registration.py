"""Similarity and rigid fits: moments by Spark aggregation, a 3x3 step per group.

Fits return one row per group: ``s``, ``r`` (row-major), ``t``, ``n`` and ``status``. Groups that
cannot be fitted keep their row with NULLs and a status other than ``ok``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from framespan.functions import columns as C
from framespan.functions.rotations import best_rotation
from framespan.operators.joins import attach, group_count
from framespan.operators.ranking import quantiles, smallest_n
from framespan.session import cut

SRC = ("sx", "sy", "sz")
DST = ("dx", "dy", "dz")


def _means(prefix: str, axes: Sequence[str]) -> list[Column]:
    return [F.avg(a).alias(f"_{prefix}{i}") for i, a in enumerate(axes)]


def pair_moments(pairs: DataFrame, by: Sequence[str], src: Sequence[str] = SRC, dst: Sequence[str] = DST) -> DataFrame:
    """Means, variances and centred cross moments; stable one-pass aggregates."""
    cross = F.array(*[F.covar_pop(a, b) for a in src for b in dst])
    return pairs.groupBy(*by).agg(
        F.array(*[F.avg(a) for a in src]).alias("mu_s"),
        F.array(*[F.avg(b) for b in dst]).alias("mu_d"),
        C.total([F.var_pop(a) for a in src]).alias("var_s"),
        C.total([F.var_pop(b) for b in dst]).alias("var_d"),
        cross.alias("h"),
        F.count(F.lit(1)).alias("n"),
    )


def _finish(rows: DataFrame, by: Sequence[str], scale: Column, usable: Column, status: Column | None = None) -> DataFrame:
    """From means, rotation and scale to (s, r, t); NULL for unusable groups."""
    scaled = rows.withColumn("_s", scale)
    rotated = C.mat_vec(F.col("rot.r"), C.components("mu_s"))
    t = F.array(*[F.col("mu_d")[i] - F.col("_s") * rotated[i] for i in range(3)])
    state = F.when(usable, F.lit("ok")).otherwise(F.lit("degenerate") if status is None else status)
    ok = F.col("status") == "ok"
    out = scaled.withColumn("status", state)
    return out.select(
        *by,
        F.when(ok, F.col("_s")).alias("s"),
        F.when(ok, F.col("rot.r")).alias("r"),
        F.when(ok, t).alias("t"),
        "n",
        "status",
    )


def umeyama(pairs: DataFrame, by: Sequence[str], src: Sequence[str] = SRC, dst: Sequence[str] = DST) -> DataFrame:
    """Least-squares similarity dst ~ s·R·src + t; rank below 2 is degenerate."""
    rows = pair_moments(pairs, by, src, dst).withColumn("rot", best_rotation("h"))
    usable = (F.col("rot.rank") >= 2) & (F.col("var_s") > 0)
    return _finish(rows, by, F.col("rot.trace") / F.col("var_s"), usable)


def estimate_sim3(pairs: DataFrame, by: Sequence[str], src: Sequence[str] = SRC, dst: Sequence[str] = DST) -> DataFrame:
    """Similarity whose scale is the ratio of RMS distances from the centroids."""
    rows = pair_moments(pairs, by, src, dst).withColumn("rot", best_rotation("h"))
    usable = (F.col("rot.rank") >= 2) & (F.col("var_s") > 0)
    return _finish(rows, by, F.sqrt(F.col("var_d") / F.col("var_s")), usable)


def register_points(
    pairs: DataFrame, by: Sequence[str], scales: DataFrame | float = 1.0, src: Sequence[str] = SRC, dst: Sequence[str] = DST
) -> DataFrame:
    """Rotation and translation for a given scale (a number, or a (by, scale) table)."""
    rows = pair_moments(pairs, by, src, dst).withColumn("rot", best_rotation("h"))
    if isinstance(scales, DataFrame):
        rows = rows.join(scales.select(*by, "scale"), list(by))
        return _finish(rows, by, F.col("scale"), F.col("rot.rank") >= 2)
    return _finish(rows, by, F.lit(float(scales)), F.col("rot.rank") >= 2)


# --- weighted and robust fits ----------------------------------------------------------------


def _origins(pairs: DataFrame, by: Sequence[str], src: Sequence[str], dst: Sequence[str]) -> DataFrame:
    return pairs.groupBy(*by).agg(
        F.array(*[F.avg(a) for a in src]).alias("o_s"), F.array(*[F.avg(b) for b in dst]).alias("o_d")
    )


def _weighted_aggs(w: Column, src: Sequence[str], dst: Sequence[str]) -> list[Column]:
    x = [F.col(a) - F.col("o_s")[i] for i, a in enumerate(src)]
    y = [F.col(b) - F.col("o_d")[i] for i, b in enumerate(dst)]
    return [
        F.sum(w).alias("w"),
        F.array(*[F.sum(w * c) for c in x]).alias("wx"),
        F.array(*[F.sum(w * c) for c in y]).alias("wy"),
        F.array(*[F.sum(w * a * b) for a in x for b in y]).alias("wxy"),
        F.sum(w * C.total([c * c for c in x])).alias("wxx"),
        F.sum(w * C.total([c * c for c in y])).alias("wyy"),
        # one value per group; a largest number fits a hash aggregate, a first array would sort all rows
        *[F.array(*[F.max(F.col(o)[i]) for i in range(3)]).alias(o) for o in ("o_s", "o_d")],
        F.count(F.lit(1)).alias("n"),
    ]


def _solve_weighted(sums: DataFrame, by: Sequence[str], with_scale: bool, extra: Sequence[str] = ()) -> DataFrame:
    w = F.col("w")
    mx = [F.col("wx")[i] / w for i in range(3)]
    my = [F.col("wy")[i] / w for i in range(3)]
    h = F.array(*[F.col("wxy")[3 * i + j] / w - mx[i] * my[j] for i in range(3) for j in range(3)])
    var_s = F.col("wxx") / w - C.total([m * m for m in mx])
    var_d = F.col("wyy") / w - C.total([m * m for m in my])
    rows = sums.select(
        *by,
        *extra,
        "n",
        "w",
        F.array(*[F.col("o_s")[i] + mx[i] for i in range(3)]).alias("mu_s"),
        F.array(*[F.col("o_d")[i] + my[i] for i in range(3)]).alias("mu_d"),
        var_s.alias("var_s"),
        var_d.alias("var_d"),
        best_rotation(h).alias("rot"),
    )
    heavy = F.col("w") >= 1e-6
    scale = F.sqrt(F.col("var_d") / F.col("var_s")) if with_scale else F.lit(1.0)
    usable = heavy & (F.col("rot.rank") >= 2) & (F.col("var_s") > 0)
    status = F.when(~heavy, F.lit("no_weight")).otherwise(F.lit("degenerate"))
    return _finish(rows, [*by, *extra], scale, usable, status)


def weighted_sim3(
    pairs: DataFrame,
    by: Sequence[str],
    weight: str,
    scale: bool = True,
    src: Sequence[str] = SRC,
    dst: Sequence[str] = DST,
    groups: int | None = None,
) -> DataFrame:
    """Weighted similarity (or rigid fit); total weight below 1e-6 is rejected.

    Sums are taken around the plain centroid of each group, which keeps them accurate far from the
    coordinate origin.
    """
    centred = attach(pairs, _origins(pairs, by, src, dst), by, groups)
    return _solve_weighted(centred.groupBy(*by).agg(*_weighted_aggs(F.col(weight), src, dst)), by, scale)


def _residual(src: Sequence[str], dst: Sequence[str]) -> Column:
    moved = C.mat_vec("r", [F.col(a) for a in src])
    return F.sqrt(C.total([F.pow(F.col(b) - F.col("s") * moved[i] - F.col("t")[i], 2) for i, b in enumerate(dst)]))


def robust_sim3(
    pairs: DataFrame,
    by: Sequence[str],
    weight: str,
    delta: float = 0.1,
    max_iters: int = 20,
    tol: float = 1e-9,
    scale: bool = True,
    src: Sequence[str] = SRC,
    dst: Sequence[str] = DST,
) -> DataFrame:
    """Huber-reweighted similarity.

    The pairs are written once; every round is one aggregation over those of the groups still moving. The state is one row
    per group, written to the checkpoint folder each round; the driver only sees how many groups are
    live. A group stops when its parameters or its robust error settle and keeps the fit before the
    stopping round.
    """
    by = list(by)
    pairs = cut(pairs.select(*by, weight, *src, *dst))
    rows = group_count(pairs, by)
    origins = cut(_origins(pairs, by, src, dst))
    state = weighted_sim3(pairs, by, weight, scale, src, dst, rows)
    state = state.withColumn("_err", F.lit(float("inf"))).withColumn("_done", F.col("status") != "ok")
    state = cut(state)
    for _ in range(max_iters):
        live = state.where(~F.col("_done"))
        if live.isEmpty():
            break
        current = live.select(*by, "s", "r", "t").join(origins, by)
        res = attach(pairs, current, by, rows).withColumn("_res", _residual(src, dst))
        base = F.col(weight)
        huber = F.when(F.col("_res") <= delta, 0.5 * F.col("_res") * F.col("_res")).otherwise(
            delta * (F.col("_res") - 0.5 * delta)
        )
        down = base * F.when(F.col("_res") > delta, delta / F.col("_res")).otherwise(F.lit(1.0))
        sums = res.groupBy(*by).agg(*_weighted_aggs(down, src, dst), F.sum(huber * base).alias("_now"))
        # weights are normalised before the fit, so only their ratio matters
        fresh = _solve_weighted(sums, by, scale, ["_now"]).select(
            *by,
            F.col("s").alias("_s1"),
            F.col("r").alias("_r1"),
            F.col("t").alias("_t1"),
            "_now",
            F.col("status").alias("_st1"),
        )
        joined = state.join(fresh, by, "left")
        shift = F.abs(F.col("_s1") - F.col("s")) + C.norm([F.col("_t1")[i] - F.col("t")[i] for i in range(3)])
        trace = C.total([F.col("_r1")[3 * i + k] * F.col("r")[3 * i + k] for i in range(3) for k in range(3)])
        angle = F.acos(F.least(F.lit(1.0), F.greatest(F.lit(-1.0), (trace - 1) / 2)))
        settled = ((shift < tol) & (angle < F.radians(F.lit(0.1)))) | (
            F.abs(F.col("_err") - F.col("_now")) < tol * F.col("_err")
        )
        stop = F.col("_done") | (F.col("_st1") != "ok") | F.coalesce(settled, F.lit(True))
        step = joined.withColumn("_stop", stop)
        keep = F.col("_stop")
        state = cut(
            step.select(
                *by,
                F.when(keep, F.col("s")).otherwise(F.col("_s1")).alias("s"),
                F.when(keep, F.col("r")).otherwise(F.col("_r1")).alias("r"),
                F.when(keep, F.col("t")).otherwise(F.col("_t1")).alias("t"),
                "n",
                "status",
                F.when(keep, F.col("_err")).otherwise(F.col("_now")).alias("_err"),
                F.col("_stop").alias("_done"),
            )
        )
    return state.drop("_err", "_done")


def alignment_error(
    pairs: DataFrame, fits: DataFrame, by: Sequence[str], src: Sequence[str] = SRC, dst: Sequence[str] = DST, rows: int | None = None
) -> DataFrame:
    """Mean, standard deviation (population), median and maximum of the residual distance."""
    by = list(by)
    res = attach(pairs, fits.where("status = 'ok'").select(*by, "s", "r", "t"), by, rows)
    res = cut(res.select(*by, _residual(src, dst).alias("_e")))
    stats = res.groupBy(*by).agg(
        F.avg("_e").alias("mean_error"),
        F.stddev_pop("_e").alias("std_error"),
        F.max("_e").alias("max_error"),
        F.count(F.lit(1)).alias("n_pairs"),
    )
    return stats.join(quantiles(res, by, F.col("_e"), {"median_error": (0.5, "linear")}).drop("n_values"), by)


def align_point_maps(
    a: DataFrame,
    b: DataFrame,
    threshold: float,
    by: Sequence[str],
    keys: Sequence[str],
    robust: bool = True,
    **options,
) -> tuple[DataFrame, DataFrame]:
    """Fit map b onto map a from pixels confident in both; returns (fits, error report).

    Maps hold ``x, y, z, conf``. Weights are sqrt(conf_a * conf_b).
    """
    left = a.where(F.col("conf") > threshold).select(*by, *keys, *[F.col(c).alias(d) for c, d in zip("xyz", DST)], F.col("conf").alias("_ca"))
    right = b.where(F.col("conf") > threshold).select(*by, *keys, *[F.col(c).alias(d) for c, d in zip("xyz", SRC)], F.col("conf").alias("_cb"))
    weight = F.sqrt(F.col("_ca") * F.col("_cb")).alias("weight")
    # the fit and its error read the joined maps many times
    pairs = cut(left.join(right, [*by, *keys]).select(*by, weight, *SRC, *DST))
    fits = robust_sim3(pairs, by, "weight", **options) if robust else estimate_sim3(pairs, by)
    return fits, alignment_error(pairs, fits, by)


# --- camera poses ------------------------------------------------------------------------------


def _directions(r: str) -> tuple[list[Column], list[Column]]:
    """Unit viewing (-z) and up (+y) directions of a pose."""

    def unit(v: list[Column]) -> list[Column]:
        length = C.norm(v)
        return [c / length for c in v]

    view = unit([-C.at(r, 2), -C.at(r, 5), -C.at(r, 8)])
    up = unit([C.at(r, 1), C.at(r, 4), C.at(r, 7)])
    return view, up


def register_poses(pairs: DataFrame, by: Sequence[str], scales: DataFrame | float = 1.0) -> DataFrame:
    """Rigid fit of camera poses for a given scale.

    ``pairs`` has ``src_r, src_t, dst_r, dst_t``. Each camera contributes its position and the tips
    of its unit view and up vectors; centroids come from positions only. The anchor sums split into
    a part linear in the scale and a constant part, so one aggregation serves any scale.
    """
    by = list(by)
    v, u = _directions("src_r")
    w, x = _directions("dst_r")
    named = {}
    for i in range(3):
        named[f"p{i}"] = C.at("src_t", i)
        named[f"q{i}"] = C.at("dst_t", i)
        named[f"v{i}"], named[f"u{i}"], named[f"w{i}"], named[f"x{i}"] = v[i], u[i], w[i], x[i]
    flat = pairs.select(*by, *[c.alias(k) for k, c in named.items()])
    cells = [(i, j) for i in range(3) for j in range(3)]

    def linear(i: int, j: int) -> Column:
        tips = F.col(f"w{j}") + F.col(f"x{j}")
        return F.count(F.lit(1)) * (3 * F.covar_pop(f"p{i}", f"q{j}") + F.covar_pop(F.col(f"p{i}"), tips))

    def constant(i: int, j: int) -> Column:
        tips = F.col(f"v{i}") + F.col(f"u{i}")
        own = F.sum(F.col(f"v{i}") * F.col(f"w{j}") + F.col(f"u{i}") * F.col(f"x{j}"))
        return F.count(F.lit(1)) * F.covar_pop(tips, F.col(f"q{j}")) + own

    sums = flat.groupBy(*by).agg(
        F.array(*[linear(i, j) for i, j in cells]).alias("h1"),
        F.array(*[constant(i, j) for i, j in cells]).alias("h0"),
        F.array(*[F.avg(f"p{i}") for i in range(3)]).alias("mu_s"),
        F.array(*[F.avg(f"q{i}") for i in range(3)]).alias("mu_d"),
        F.count(F.lit(1)).alias("n"),
    )
    if isinstance(scales, DataFrame):
        sums = sums.join(scales.select(*by, "scale"), by)
    else:
        sums = sums.withColumn("scale", F.lit(float(scales)))
    h = F.zip_with("h1", "h0", lambda a, b: a * F.col("scale") + b)
    rows = sums.withColumn("rot", best_rotation(h))
    return _finish(rows, by, F.col("scale"), F.col("rot.rank") >= 2)


def register_views(pairs: DataFrame, by: Sequence[str], scales: DataFrame | float = 1.0) -> DataFrame:
    """As :func:`register_poses`, but the rotation comes from viewing directions alone."""
    by = list(by)
    v, _ = _directions("src_r")
    w, _ = _directions("dst_r")
    sums = pairs.groupBy(*by).agg(
        F.array(*[F.sum(v[i] * w[j]) for i in range(3) for j in range(3)]).alias("h"),
        F.array(*[F.avg(C.at("src_t", i)) for i in range(3)]).alias("mu_s"),
        F.array(*[F.avg(C.at("dst_t", i)) for i in range(3)]).alias("mu_d"),
        F.count(F.lit(1)).alias("n"),
    )
    if isinstance(scales, DataFrame):
        sums = sums.join(scales.select(*by, "scale"), by)
    else:
        sums = sums.withColumn("scale", F.lit(float(scales)))
    rows = sums.withColumn("rot", best_rotation("h"))
    return _finish(rows, by, F.col("scale"), F.col("rot.rank") >= 2)


# --- RANSAC --------------------------------------------------------------------------------------


def ransac_sim3(
    pairs: DataFrame,
    by: Sequence[str],
    ids: Sequence[str],
    n: int = 32,
    threshold: float = 0.1,
    seed: int = 0,
    src: Sequence[str] = SRC,
    dst: Sequence[str] = DST,
) -> DataFrame:
    """Similarity from the best of ``n`` random triples, refitted on its inliers.

    3n rows per group are drawn by hash; each consecutive triple is one hypothesis. The n models of
    a group travel as one array row, and inliers are counted per model with partial aggregation.
    """
    by = list(by)
    keyed = pairs.withColumn("_hash", C.hash52(seed, *by, *ids))
    drawn = smallest_n(keyed, by, [F.col("_hash"), *[F.col(i) for i in ids]], 3 * n)
    order = F.struct(*dict.fromkeys(["_hash", *ids, *src, *dst]))
    packed = drawn.groupBy(*by).agg(F.array_sort(F.collect_list(order)).alias("_rows"))
    triples = (
        packed.where(F.size("_rows") >= 3)
        .withColumn("hyp", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
        .withColumn("slot", F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))))
        .withColumn("_pick", F.col("_rows")[F.pmod(3 * F.col("hyp") + F.col("slot"), F.size("_rows"))])
        .select(*by, "hyp", *[F.col(f"_pick.{c}").alias(c) for c in (*src, *dst)])
    )
    models = umeyama(triples, [*by, "hyp"], src, dst).where("status = 'ok'")
    packed_models = models.groupBy(*by).agg(
        F.array_sort(F.collect_list(F.struct("hyp", "s", "r", "t"))).alias("_models")
    )
    groups = group_count(pairs, by)
    point = [F.col(a) for a in src]

    def inlier(m: Column) -> Column:
        moved = C.mat_vec(m["r"], point)
        return C.total([F.pow(F.col(b) - m["s"] * moved[i] - m["t"][i], 2) for i, b in enumerate(dst)]) < threshold**2

    votes = (
        attach(pairs, packed_models, by, groups * n)  # a row holds n models, so it counts as n
        .select(*by, F.explode("_models").alias("m"), *src, *dst)
        .where(inlier(F.col("m")))
        .groupBy(*by, F.col("m.hyp").alias("hyp"))
        .agg(F.count(F.lit(1)).alias("inliers"))
    )
    best = votes.groupBy(*by).agg(
        F.max_by("hyp", F.struct("inliers", -F.col("hyp"))).alias("hyp"), F.max("inliers").alias("inliers")
    )
    winner = best.join(models.select(*by, "hyp", F.struct("s", "r", "t").alias("m")), [*by, "hyp"])
    kept = attach(pairs, winner.select(*by, "m"), by, groups).where(inlier(F.col("m")))
    return umeyama(kept, by, src, dst).join(best.select(*by, "inliers"), by)


def quarantine(fits: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Split fits into usable rows and a log of the failed groups."""
    ok = F.col("status") == "ok"
    return fits.where(ok), fits.where(~ok)
