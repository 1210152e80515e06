"""Robust scale estimation by iteratively reweighted least squares, for all groups at once.

The pairs are written once; each pass scans them where they lie, joined with the current per-group
scale, and moves one partial sum per group and task. The three forms differ on purpose (start value,
stop rule, clamp). A few passes are unrolled into one plan; then the state (one row per group) goes to
the checkpoint folder, and the loop ends early once every group has settled.

Weights divide by residuals, so passes amplify the last bits of their sums. Sums are therefore exact: each
term is cut into whole multiples of three powers of two below a bound known per group (``limbs``), whole numbers add up to
the same in any order, and a fit has one answer whatever the number of tasks.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from framespan.functions.columns import clamp, total
from framespan.operators.joins import attach, group_count
from framespan.operators.ranking import quantiles
from framespan.session import cut

EPS = 1e-8
PASSES_PER_JOB = 3
#: A power of two above every weight 1 / (residual + EPS).
TOP_WEIGHT = 2.0**27
#: Terms become multiples of their bound over 2^31, 2^62 and 2^93: 2^32 rows of a group still add up in 64 bits.
LIMBS, LIMB = 3, 2.0**31


def power_above(size: Column) -> Column:
    """A power of two above ``size``; the factor keeps powers of two themselves away from the rounding of the logarithm."""
    power = F.pow(F.lit(2.0), F.ceil(F.log2(F.greatest(size, F.lit(1e-30)) * 1.3)).cast("double"))
    return F.when(F.isnan(size) | (size == float("inf")), F.lit(float("nan"))).otherwise(power)


def limbs(value: Column, bound: Column) -> list[Column]:
    """``value`` as whole multiples of ever smaller units, exact but for what lies under the last one."""
    out, unit = [], bound
    for _ in range(LIMBS):
        unit = unit / LIMB
        whole = F.floor(value / unit)
        out.append(whole)
        value = value - whole.cast("double") * unit
    return out


def exact_sums(rows: DataFrame, by: Sequence[str], terms: dict[str, tuple[Column, Column]], *others: Column) -> DataFrame:
    """Sums of ``terms`` (value, bound) per group that do not depend on the order of the rows, next to ``others``.

    A bound is the same for all rows of a group. A bound that is not a number makes its sum so.
    """
    parts = [F.sum(limb).alias(f"_{name}{k}") for name, (value, bound) in terms.items() for k, limb in enumerate(limbs(value, bound))]
    bounds = [F.max(bound).alias(f"_{name}_top") for name, (_, bound) in terms.items()]
    sums = rows.groupBy(*by).agg(*parts, *bounds, *others)
    added = {}
    for name in terms:
        unit, total_ = F.col(f"_{name}_top"), None
        for k in range(LIMBS):
            unit = unit / LIMB
            part = F.col(f"_{name}{k}").cast("double") * unit
            total_ = part if total_ is None else total_ + part
        added[name] = total_
    return sums.withColumns(added).drop(*[f"_{name}{k}" for name in terms for k in range(LIMBS)], *[f"_{name}_top" for name in terms])


def _sized(pairs: DataFrame, by: Sequence[str], columns: Sequence[str], rows: int) -> DataFrame:
    """``pairs`` with ``_top``, a power of two above every value of the group in ``columns``."""
    largest = F.max(F.greatest(*[F.abs(F.col(c)) for c in columns]))
    return attach(pairs, cut(pairs.groupBy(*by).agg(power_above(largest).alias("_top"))), by, rows)


def _irls(
    pairs: DataFrame,
    by: Sequence[str],
    start: DataFrame,
    residual: Callable[[Column], Column],
    cross: Column,
    square: Column,
    iters: int,
    stop_tol: float | None,
    clamp_min: float | None,
    rows: int,
) -> DataFrame:
    by = list(by)
    state = start
    for done in range(1, iters + 1):
        weight = 1.0 / (residual(F.col("_s")) + EPS)
        bound = F.col("_top") * F.col("_top") * TOP_WEIGHT
        terms = {"_num": (weight * cross, bound), "_den": (weight * square, bound)}
        sums = exact_sums(attach(pairs, state, by, rows), by, terms, F.max("_s").alias("_old"), F.max("_done").alias("_frozen"), F.max("_top").alias("_top"))
        fresh = clamp(F.try_divide("_num", "_den"), clamp_min)
        stop = F.lit(False) if stop_tol is None else F.abs(fresh - F.col("_old")) < stop_tol
        state = sums.select(
            *by,
            F.when(F.col("_frozen"), F.col("_old")).otherwise(fresh).alias("_s"),
            (F.col("_frozen") | stop).alias("_done"),
            "_top",
        )
        if done % PASSES_PER_JOB == 0 and done < iters:
            state = cut(state)
            if stop_tol is not None and state.where(~F.col("_done")).isEmpty():
                break
    return state


def _ratio(pairs: DataFrame, by: Sequence[str], top: tuple[Column, Column], low: tuple[Column, Column], means: bool) -> DataFrame:
    """(by, _top, _r): the ratio of two sums, or of two means."""
    counts = [F.count(top[0]).alias("_n"), F.count(low[0]).alias("_m")]
    sums = exact_sums(pairs, by, {"_a": top, "_b": low}, F.max("_top").alias("_top"), *counts)
    a, b = (F.col("_a") / F.col("_n"), F.col("_b") / F.col("_m")) if means else (F.col("_a"), F.col("_b"))
    return sums.select(*by, "_top", F.try_divide(a, b).alias("_r"))


def irls_scale_points(
    pairs: DataFrame,
    by: Sequence[str],
    src: Sequence[str] = ("sx", "sy", "sz"),
    dst: Sequence[str] = ("dx", "dy", "dz"),
    iters: int = 10,
    stop_tol: float = 0.05,
    clamp_min: float = 1e-6,
    groups: int | None = None,
) -> DataFrame:
    """Scale s minimising sum |s*src - dst|; starts from the least-squares scale."""
    pairs = cut(pairs.select(*by, *src, *dst))
    rows = group_count(pairs, by) if groups is None else groups
    cross = total([F.col(a) * F.col(b) for a, b in zip(src, dst)])
    square = total([F.col(a) * F.col(a) for a in src])
    # the bound holds for sums over the coordinates: each term is at most a square per coordinate
    bound = F.col("_top") * F.col("_top") * power_above(F.lit(float(len(src))))
    start = _ratio(_sized(pairs, by, [*src, *dst], rows), by, (cross, bound), (square, bound), False)
    start = start.select(*by, clamp(F.col("_r"), clamp_min).alias("_s"), F.lit(False).alias("_done"), "_top")

    def residual(s: Column) -> Column:
        gaps = [s * F.col(a) - F.col(b) for a, b in zip(src, dst)]
        return F.sqrt(total([gap * gap for gap in gaps]))

    out = _irls(pairs, by, start, residual, cross, square, iters, stop_tol, clamp_min, rows)
    return out.select(*by, F.col("_s").alias("scale"), F.col("_done").alias("converged"))


def irls_scale_depth(
    pairs: DataFrame,
    by: Sequence[str],
    src: str = "pred",
    dst: str = "gt",
    iters: int = 10,
    stop_tol: float = 0.05,
    clamp_min: float = 1e-6,
    groups: int | None = None,
) -> DataFrame:
    """Same for depths; starts from the ratio of the means."""
    a, b = F.col(src), F.col(dst)
    pairs = cut(pairs.select(*by, src, dst))
    rows = group_count(pairs, by) if groups is None else groups
    start = _ratio(_sized(pairs, by, [src, dst], rows), by, (b, F.col("_top")), (a, F.col("_top")), True)
    start = start.select(*by, clamp(F.col("_r"), clamp_min).alias("_s"), F.lit(False).alias("_done"), "_top")
    out = _irls(pairs, by, start, lambda s: F.abs(s * a - b), a * b, a * a, iters, stop_tol, clamp_min, rows)
    return out.select(*by, F.col("_s").alias("scale"), F.col("_done").alias("converged"))


def irls_scale_eval(
    pairs: DataFrame,
    by: Sequence[str],
    src: str = "pred",
    dst: str = "gt",
    iters: int = 10,
    final_min: float = 1e-3,
    groups: int | None = None,
) -> DataFrame:
    """Evaluation form: always ``iters`` passes, one clamp at the end."""
    a, b = F.col(src), F.col(dst)
    pairs = cut(pairs.select(*by, src, dst))
    rows = group_count(pairs, by) if groups is None else groups
    start = _ratio(_sized(pairs, by, [src, dst], rows), by, (b, F.col("_top")), (a, F.col("_top")), True)
    start = start.select(*by, F.col("_r").alias("_s"), F.lit(False).alias("_done"), "_top")
    out = _irls(pairs, by, start, lambda s: F.abs(s * a - b), a * b, a * a, iters, None, None, rows)
    return out.select(*by, clamp(F.col("_s"), final_min).alias("scale"))


def median_ratio(pairs: DataFrame, by: Sequence[str], src: str = "pred", dst: str = "gt") -> DataFrame:
    """Ratio of the lower medians."""
    med = {"_m": (0.5, "lower")}
    top = quantiles(pairs, by, F.col(dst), med).select(*by, F.col("_m").alias("_top"))
    low = quantiles(pairs, by, F.col(src), med).select(*by, F.col("_m").alias("_low"))
    return top.join(low, list(by)).select(*by, (F.col("_top") / F.col("_low")).alias("scale"))


def l1_scale_shift(
    pairs: DataFrame, by: Sequence[str], src: str = "pred", dst: str = "gt", iters: int = 10, groups: int | None = None
) -> DataFrame:
    """Scale and shift minimising sum |s*src + t - dst|, reweighted 2x2 normal equations.

    Starts from the median ratio with shift 0.
    """
    by = list(by)
    a, b = F.col(src), F.col(dst)
    pairs = cut(pairs.select(*by, src, dst))
    rows = group_count(pairs, by) if groups is None else groups
    sizes = pairs.groupBy(*by).agg(power_above(F.max(F.greatest(F.abs(a), F.abs(b)))).alias("_top"))
    state = median_ratio(pairs, by, src, dst).join(sizes, by).select(*by, F.col("scale").alias("_s"), F.lit(0.0).alias("_t"), "_top")
    top, first = F.col("_top"), F.lit(TOP_WEIGHT)
    for done in range(1, iters + 1):
        w = 1.0 / (F.abs(F.col("_s") * a + F.col("_t") - b) + EPS)
        terms = {
            "_w": (w, first),
            "_a": (w * a, first * top),
            "_b": (w * b, first * top),
            "_aa": (w * a * a, first * top * top),
            "_ab": (w * a * b, first * top * top),
        }
        olds = [F.max("_s").alias("_olds"), F.max("_t").alias("_oldt"), F.max("_top").alias("_top")]
        sums = exact_sums(attach(pairs, state, by, rows), by, terms, *olds)
        det = F.col("_w") * F.col("_aa") - F.col("_a") * F.col("_a")
        flat = F.abs(det) <= 1e-12 * F.col("_w") * F.col("_aa")
        s = (F.col("_w") * F.col("_ab") - F.col("_a") * F.col("_b")) / det
        t = (F.col("_aa") * F.col("_b") - F.col("_a") * F.col("_ab")) / det
        state = sums.select(
            *by,
            F.when(flat, F.col("_olds")).otherwise(s).alias("_s"),
            F.when(flat, F.col("_oldt")).otherwise(t).alias("_t"),
            "_top",
        )
        if done % PASSES_PER_JOB == 0 and done < iters:
            state = cut(state)
    return state.select(*by, F.col("_s").alias("scale"), F.col("_t").alias("shift"))


def align(pairs: DataFrame, by: Sequence[str], method: str = "scale", src: str = "pred", dst: str = "gt") -> DataFrame:
    """(by, scale, shift) for ``scale``, ``lstsq``, ``lad`` or ``median`` alignment."""
    if method == "scale":
        return irls_scale_eval(pairs, by, src, dst).withColumn("shift", F.lit(0.0))
    if method == "lstsq":
        return pairs.groupBy(*by).agg(
            F.regr_slope(dst, src).alias("scale"), F.regr_intercept(dst, src).alias("shift")
        )
    if method == "lad":
        return l1_scale_shift(pairs, by, src, dst)
    if method == "median":
        return median_ratio(pairs, by, src, dst).withColumn("shift", F.lit(0.0))
    raise ValueError(f"unknown alignment {method!r}")
