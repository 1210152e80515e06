"""Camera formulas as column expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from framespan.functions import columns as C


def distortion(params: Column, u: Column, v: Column) -> tuple[Column, Column]:
    """Distort normalised coordinates; the number of parameters (0, 1, 2 or 4) picks the model."""
    n = F.coalesce(F.size(params), F.lit(0))

    def p(i: int) -> Column:
        return F.when(n > i, F.get(params, F.lit(i))).otherwise(F.lit(0.0))

    r2 = u * u + v * v
    k2 = F.when(n >= 2, p(1)).otherwise(F.lit(0.0))
    p1 = F.when(n == 4, p(2)).otherwise(F.lit(0.0))
    p2 = F.when(n == 4, p(3)).otherwise(F.lit(0.0))
    radial = p(0) * r2 + k2 * r2 * r2
    du = u * radial + 2 * p1 * u * v + p2 * (r2 + 2 * u * u)
    dv = v * radial + 2 * p2 * u * v + p1 * (r2 + 2 * v * v)
    return u + du, v + dv


def _slopes(params: Column, u: Column, v: Column) -> list[Column]:
    """Partial derivatives of the distorted point: du'/du, du'/dv, dv'/du, dv'/dv."""
    n = F.coalesce(F.size(params), F.lit(0))

    def p(i: int, models: Column) -> Column:
        return F.when(models, F.get(params, F.lit(i))).otherwise(F.lit(0.0))

    k1, k2, p1, p2 = p(0, n >= 1), p(1, n >= 2), p(2, n == 4), p(3, n == 4)
    r2 = u * u + v * v
    radial = k1 * r2 + k2 * r2 * r2
    bend = 2 * (k1 + 2 * k2 * r2)
    mixed = u * v * bend + 2 * p1 * u + 2 * p2 * v
    return [1 + radial + u * u * bend + 2 * p1 * v + 6 * p2 * u, mixed, mixed, 1 + radial + v * v * bend + 2 * p2 * u + 6 * p1 * v]


def undistortion(params: Column, u: Column, v: Column, rounds: int = 12) -> Column:
    """struct(u, v) whose distortion is the given point: a fixed number of Newton rounds.

    Uses exact derivatives, so the default rounds reach machine precision for usual lenses, well
    inside the 1e-5 step at which an iterative solver would stop.
    """
    start = F.struct(u.alias("u"), v.alias("v"))

    def step(acc: Column, _: Column) -> Column:
        a, b = acc["u"], acc["v"]
        du, dv = distortion(params, a, b)
        ex, ey = u - du, v - dv
        j00, j01, j10, j11 = _slopes(params, a, b)
        det = F.nullif(j00 * j11 - j01 * j10, F.lit(0.0))
        return F.struct(
            F.coalesce(a + (j11 * ex - j01 * ey) / det, a).alias("u"), F.coalesce(b + (j00 * ey - j10 * ex) / det, b).alias("v")
        )

    return F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), start, step)


def to_camera(r: Column | str, t: Column | str, point: Sequence[Column]) -> list[Column]:
    """R·X + t (world to camera)."""
    rotated = C.mat_vec(r, point)
    return [rotated[i] + C.at(t, i) for i in range(3)]


def pixel_to_ray(u: Column, v: Column, fx: Column, fy: Column, cx: Column, cy: Column) -> list[Column]:
    return [(u - cx) / fx, (v - cy) / fy, F.lit(1.0)]
