"""Trajectory association and errors."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from framespan.functions import columns as C
from framespan.operators.joins import attach, group_count
from framespan.operators.ranking import carry_last, neighbourhood, ranked, window_rows
from framespan.operators.registration import umeyama
from framespan.session import cut

POSE = ("x", "y", "z", "qw", "qx", "qy", "qz")


def associate(
    ref: DataFrame, est: DataFrame, max_diff: float, by: Sequence[str] = ("seq",), ts: str = "ts", values: Sequence[str] = ()
) -> DataFrame:
    """Nearest reference timestamp for each estimate within ``max_diff`` (ties go to the earlier).

    Both streams are merged in time order and the latest reference is carried forward and backward:
    linear work, no pairs of rows and no range join.
    """
    by = list(by)
    names = list(dict.fromkeys([ts, *values]))
    empty_ref = F.lit(None).cast(ref.select(F.struct(*names).alias("v")).schema[0].dataType)
    empty_est = F.lit(None).cast(est.select(F.struct(*names).alias("v")).schema[0].dataType)
    merged = ref.select(*by, F.col(ts).alias("_t"), F.struct(*names).alias("_ref"), empty_est.alias("_est")).unionByName(
        est.select(*by, F.col(ts).alias("_t"), empty_ref.alias("_ref"), F.struct(*names).alias("_est"))
    )
    mine = F.col("_ref").isNull().cast("int")
    rows = merged.count()
    forward = carry_last(merged, by, [F.col("_t"), mine], "_ref", "_before", rows)
    both = carry_last(forward, by, [-F.col("_t"), mine], "_ref", "_after", rows)
    before, after = F.col("_t") - F.col("_before")[ts], F.col("_after")[ts] - F.col("_t")
    take_before = F.col("_after").isNull() | (F.col("_before").isNotNull() & (before <= after))
    chosen = both.where(F.col("_est").isNotNull()).withColumn(
        "_hit", F.when(take_before, F.col("_before")).otherwise(F.col("_after"))
    )
    gap = F.abs(F.col("_hit")[ts] - F.col("_t"))
    return chosen.where(gap <= max_diff).select(
        *by,
        *[F.col("_hit")[n].alias(f"ref_{n}") for n in names],
        *[F.col("_est")[n].alias(f"est_{n}") for n in names],
        gap.alias("gap"),
    )


def associate_by_position(ref: DataFrame, est: DataFrame, by: Sequence[str], order: Sequence[Column], values: Sequence[str]) -> DataFrame:
    """Pair two sequences of equal length row by row."""
    by = list(by)
    left = ranked(ref, by, order, "_rn").select(*by, "_rn", *[F.col(v).alias(f"ref_{v}") for v in values])
    right = ranked(est, by, order, "_rn").select(*by, "_rn", *[F.col(v).alias(f"est_{v}") for v in values])
    return left.join(right, [*by, "_rn"]).withColumnRenamed("_rn", "pos")


def _positions(pairs: DataFrame, by: Sequence[str]) -> DataFrame:
    return pairs.select(
        *by,
        *[F.col(f"est_{a}").alias(f"s{a}") for a in "xyz"],
        *[F.col(f"ref_{a}").alias(f"d{a}") for a in "xyz"],
    )


def ate(pairs: DataFrame, by: Sequence[str]) -> DataFrame:
    """RMSE of positions after the similarity alignment of the estimate to the reference."""
    pts = _positions(pairs, by)
    rows = group_count(pts, by)
    fits = umeyama(pts, by)
    joined = attach(pts, fits, by, rows)
    moved = C.mat_vec("r", [F.col("sx"), F.col("sy"), F.col("sz")])
    square = C.total([F.pow(F.col(d) - F.col("s") * moved[i] - F.col("t")[i], 2) for i, d in enumerate(("dx", "dy", "dz"))])
    return joined.groupBy(*by).agg(F.sqrt(F.avg(square)).alias("ate"), F.count(F.lit(1)).alias("n_poses"))


def _quat(prefix: str, at: str = "") -> list[Column]:
    return [F.col(f"{at}{prefix}_{c}") for c in ("qw", "qx", "qy", "qz")]


def quat_mul(a: Sequence[Column], b: Sequence[Column]) -> list[Column]:
    return [
        a[0] * b[0] - a[1] * b[1] - a[2] * b[2] - a[3] * b[3],
        a[0] * b[1] + a[1] * b[0] + a[2] * b[3] - a[3] * b[2],
        a[0] * b[2] - a[1] * b[3] + a[2] * b[0] + a[3] * b[1],
        a[0] * b[3] + a[1] * b[2] - a[2] * b[1] + a[3] * b[0],
    ]


def quat_conj(a: Sequence[Column]) -> list[Column]:
    return [a[0], -a[1], -a[2], -a[3]]


def quat_rotate(q: Sequence[Column], v: Sequence[Column]) -> list[Column]:
    """q·v·q* for a unit quaternion."""
    t = [2 * c for c in C.cross(q[1:], v)]
    back = C.cross(q[1:], t)
    return [v[i] + q[0] * t[i] + back[i] for i in range(3)]


def rpe(pairs: DataFrame, by: Sequence[str], order: str, delta: int = 1) -> DataFrame:
    """RMSE of relative translation and rotation (degrees) over all pairs ``delta`` rows apart.

    The estimate is aligned by a similarity first; that leaves relative rotations unchanged and
    scales relative translations, so only the scale is needed here.
    """
    by = list(by)
    cols = [f"{p}_{c}" for p in ("ref", "est") for c in POSE]
    pairs = cut(pairs.select(*by, order, *cols))  # read by the fit and by the steps
    scale = umeyama(_positions(pairs, by), by).select(*by, F.col("s").alias("_scale"))
    rows = window_rows(pairs, by)
    numbered = ranked(pairs, by, [F.col(order)], "_rn", rows=rows)
    ahead = {f"n_{c}": (lambda w, c=c: F.lead(c, delta).over(w)) for c in cols}
    steps = neighbourhood(numbered, by, "_rn", ahead, after=delta, rows=rows).where(F.col("n_ref_x").isNotNull())

    def unit(q: list[Column]) -> list[Column]:
        length = C.norm(q)
        return [c / length for c in q]

    def relative(p: str) -> tuple[list[Column], list[Column]]:
        q0, q1 = unit(_quat(p)), unit(_quat(p, "n_"))
        move = [F.col(f"n_{p}_{a}") - F.col(f"{p}_{a}") for a in "xyz"]
        return quat_mul(quat_conj(q0), q1), quat_rotate(quat_conj(q0), move)

    qr, tr = relative("ref")
    qe, te = relative("est")
    rel = steps.select(
        *by,
        *[c.alias(f"_qr{i}") for i, c in enumerate(qr)],
        *[c.alias(f"_qe{i}") for i, c in enumerate(qe)],
        *[c.alias(f"_tr{i}") for i, c in enumerate(tr)],
        *[c.alias(f"_te{i}") for i, c in enumerate(te)],
    )
    diff = quat_mul(quat_conj([F.col(f"_qr{i}") for i in range(4)]), [F.col(f"_qe{i}") for i in range(4)])
    angle = F.degrees(2 * F.atan2(C.norm(diff[1:]), F.abs(diff[0])))
    joined = attach(rel, scale, by)
    shift = C.total([F.pow(F.col("_scale") * F.col(f"_te{i}") - F.col(f"_tr{i}"), 2) for i in range(3)])
    return joined.groupBy(*by).agg(
        F.sqrt(F.avg(shift)).alias("rpe_trans"),
        F.sqrt(F.avg(F.pow(angle, 2))).alias("rpe_rot"),
        F.count(F.lit(1)).alias("n_pairs"),
    )
