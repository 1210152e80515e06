"""Point clouds: exact nearest neighbours, cloud metrics, normals, ICP, voxels."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from framespan.functions import columns as C
from framespan.functions.rotations import smallest_eigenvector
from framespan.operators.joins import attach, broadcast_limit, group_count, same_group
from framespan.operators.ranking import quantiles, smallest_n
from framespan.session import cut

AXES = ("x", "y", "z")
LEAF = 32
FAN = 4  # each cell splits into FAN^3 children
FINEST = 24  # FAN^24 parts of the cube: beyond that doubles hold no further position


def _cell(level: int, origin: str = "_o", edge: str = "_e") -> list[Column]:
    """Integer cell coordinates at a level of the cube subdivision."""
    parts = FAN**level
    return [
        F.least(F.lit(parts - 1), F.greatest(F.lit(0), F.floor((F.col(a) - F.col(origin)[i]) / F.col(edge) * parts))).cast("long")
        for i, a in enumerate(AXES)
    ]


def _cubes(ref: DataFrame, by: list[str]) -> DataFrame:
    """Bounding cube of the reference points of each group."""
    box = ref.groupBy(*by).agg(
        *[F.min(a).alias(f"_lo_{a}") for a in AXES], *[F.max(a).alias(f"_hi_{a}") for a in AXES]
    )
    edge = F.greatest(*[F.col(f"_hi_{a}") - F.col(f"_lo_{a}") for a in AXES])
    return box.select(*by, F.array(*[F.col(f"_lo_{a}") for a in AXES]).alias("_o"), F.greatest(edge * 1.0000001, F.lit(1e-12)).alias("_e"))


def _box_distance(level: int) -> tuple[Column, Column]:
    """Least and greatest squared distance from the query to candidate cell (cx, cy, cz)."""
    low, high = [], []
    for i, a in enumerate(AXES):
        width = F.col("_e") / FAN**level
        start = F.col("_o")[i] + F.col(f"c{a}") * width
        end = start + width
        slack = F.col("_e") * 4e-15  # rounding of a position in the cube
        q = F.col(f"q{a}")
        outside = F.greatest(start - slack - q, q - end - slack, F.lit(0.0))
        far = F.greatest(F.abs(q - start), F.abs(q - end)) + slack
        low.append(outside * outside)
        high.append(far * far)
    return C.total(low), C.total(high)


@dataclass
class PointIndex:
    """Reference points stored once, the cube of each group, and the non-empty cells of the levels at which cells split."""

    by: list[str]
    k: int
    payload: list[str]
    placed: DataFrame
    cubes: DataFrame
    groups: int
    levels: list[int]
    cells: dict[int, DataFrame]
    counts: dict[int, int]
    points: int

    def children(self, level: int, above: int) -> DataFrame:
        """Non-empty cells of a level with their point counts and their parent cell of the level ``above``."""
        return self.cells[level].withColumns({f"pc{a}": F.floor(F.col(f"c{a}") / FAN ** (level - above)) for a in AXES})


def point_index(ref: DataFrame, k: int = 1, by: Sequence[str] = (), payload: Sequence[str] = (), leaf: int = LEAF) -> PointIndex:
    """Index of ``ref`` (pid, x, y, z, payload) for searches of up to ``k`` neighbours.

    The cube of each group is subdivided until a cell holds at most ``leaf`` distinct points. Levels that
    split nothing are skipped, so a far outlier costs no search step and no number of levels is too deep.
    Of coincident reference points the k smallest ids are kept, which is all the answer can use.
    """
    by, payload = list(by), list(payload)
    if k == 1:
        ref = ref.groupBy(*by, *AXES).agg(F.min_by(F.struct("pid", *payload), "pid").alias("_r")).select(*by, *AXES, "_r.*")
    else:
        # of coincident points only the k smallest ids can ever be among k neighbours
        ref = smallest_n(ref, [*by, *AXES], [F.col("pid")], k)
    ref = cut(ref.select(*by, "pid", *AXES, *payload))
    cubes = cut(_cubes(ref, by))
    groups = cubes.count()
    placed = cut(attach(ref, cubes, by, groups))

    levels, kept, counts = [], {}, {}
    points = size = placed.count()
    for level in range(FINEST + 1):
        # the first look, at the cubes themselves, finds the largest cloud
        cells = cut(placed.groupBy(*by, *[c.alias(f"c{a}") for c, a in zip(_cell(level), AXES)]).agg(F.count(F.lit(1)).alias("_n")))
        now, count = cells.agg(F.max("_n"), F.count(F.lit(1))).first()
        if level and now < 0.9 * size:
            levels.append(level)
            kept[level], counts[level] = cells, count
        if not level or level in kept:
            size = now or 0
        if size <= leaf:
            break
    return PointIndex(by, k, payload, placed, cubes, groups, levels, kept, counts, points)


def knn(
    query: DataFrame,
    ref: DataFrame | PointIndex,
    k: int = 1,
    by: Sequence[str] = (),
    payload: Sequence[str] = (),
    radius: float | None = None,
    leaf: int = LEAF,
) -> DataFrame:
    """Exact k nearest reference points of every query point.

    Returns (by, pid, rank, ref_pid, distance, ref_x/y/z, ref payload). ``query``/``ref`` hold
    ``pid, x, y, z``; ``ref`` may be a ``point_index`` of the same ``by``, which is then not built again.

    A query carries the cells that can still hold one of its k nearest points; each level joins
    those cells with their non-empty children and drops every child farther away than a bound that
    k points are known to meet. Dense regions therefore just split deeper: no cell is scanned
    whole, no radius is guessed, and nothing is dropped that could be a neighbour.
    """
    by = list(by)
    # a constant group keeps one code path for clouds without groups
    if not by:
        return knn(query.withColumn("_g", F.lit(0)), ref.withColumn("_g", F.lit(0)), k, ["_g"], payload, radius, leaf).drop("_g")
    index = ref if isinstance(ref, PointIndex) else point_index(ref, k, by, payload, leaf)
    if index.by != by or index.k < k:
        raise ValueError("the index was built for other groups or fewer neighbours")
    placed, cubes, groups, payload = index.placed, index.cubes, index.groups, index.payload
    cells = [f"c{a}" for a in AXES]
    limit = F.lit(float("inf")) if radius is None else F.lit(float(radius) ** 2)
    # coincident query points are searched once and share the answer
    reps = query.groupBy(*by, *AXES).agg(F.min("pid").alias("_rep"))
    points = reps.select(*by, F.col("_rep").alias("pid"), *[F.col(a).alias(f"q{a}") for a in AXES])
    points = attach(points, cubes, by, groups).withColumn("_bound", limit)
    root = F.array(F.struct(*[F.lit(0).cast("long").alias(c) for c in cells]))
    front, few = points.withColumn("_cells", root), broadcast_limit(query)
    carried = [*by, "pid", "qx", "qy", "qz", "_o", "_e"]
    for above, level in zip([0, *index.levels], index.levels):
        children = index.children(level, above)
        opened = front.select(*carried, "_bound", F.explode("_cells").alias("_c")).select(
            *carried, "_bound", *[F.col(f"_c.{n}").alias(f"p{n}") for n in cells]
        )
        # cells are counted: while they are few, candidates stay with their query and are not moved from level to level
        kids = F.broadcast(children) if index.counts[level] <= few else children
        near, far = _box_distance(level)
        joined = opened.join(kids, [*by, *[f"p{n}" for n in cells]]).withColumn("_near", near).withColumn("_far", far)
        kept = joined.where(F.col("_near") <= F.col("_bound"))
        found = kept.groupBy(*by, "pid").agg(
            F.first(F.struct("qx", "qy", "qz", "_o", "_e")).alias("_q"),
            F.least(F.first("_bound"), F.coalesce(F.min(F.when(F.col("_n") >= k, F.col("_far"))), F.first("_bound"))).alias("_bound"),
            F.collect_list(F.struct(*cells, "_near")).alias("_cells"),
        )
        alive = F.filter("_cells", lambda c: c["_near"] <= F.col("_bound"))
        front = found.select(
            *by, "pid", "_q.*", "_bound", F.transform(alive, lambda c: F.struct(*[c[n].alias(n) for n in cells])).alias("_cells")
        )
    leaves = placed.select(
        *by, *[c.alias(n) for c, n in zip(_cell(index.levels[-1] if index.levels else 0), cells)], F.col("pid").alias("ref_pid"),
        *[F.col(a).alias(f"ref_{a}") for a in AXES], *[F.col(p).alias(f"ref_{p}") for p in payload],
    )
    final = front.select(*by, "pid", "qx", "qy", "qz", "_bound", F.explode("_cells").alias("_c")).select(
        *by, "pid", "qx", "qy", "qz", "_bound", *[F.col(f"_c.{n}").alias(n) for n in cells]
    )
    d2 = C.total([F.pow(F.col(f"q{a}") - F.col(f"ref_{a}"), 2) for a in AXES])
    hits = final.join(F.broadcast(leaves) if index.points <= few else leaves, [*by, *cells]).withColumn("_d2", d2)
    if radius is not None:
        hits = hits.where(F.col("_d2") <= float(radius) ** 2)
    hit = F.struct("_d2", "ref_pid", *[f"ref_{a}" for a in AXES], *[f"ref_{p}" for p in payload])
    if k == 1:
        best = hits.groupBy(*by, "pid").agg(F.min(hit).alias("_h")).withColumn("rank", F.lit(1))
    else:
        gathered = hits.groupBy(*by, "pid").agg(F.slice(F.array_sort(F.collect_list(hit)), 1, k).alias("_hs"))
        best = gathered.select(*by, "pid", F.posexplode("_hs").alias("_at", "_h")).withColumn("rank", F.col("_at") + 1)
    answer = best.select(
        *by, F.col("pid").alias("_rep"), "rank", F.col("_h.ref_pid").alias("ref_pid"), F.sqrt("_h._d2").alias("distance"),
        *[F.col(f"_h.ref_{a}").alias(f"ref_{a}") for a in AXES], *[F.col(f"_h.ref_{p}").alias(f"ref_{p}") for p in payload],
    )
    members = query.select(*by, "pid", *AXES).join(reps, [*by, *AXES]).select(*by, "pid", "_rep")
    return members.join(answer, [*by, "_rep"]).drop("_rep")


def nearest(query: DataFrame, ref: DataFrame | PointIndex, by: Sequence[str] = (), payload: Sequence[str] = (), radius: float | None = None) -> DataFrame:
    """Nearest reference point of each query point (ties go to the smaller id)."""
    return knn(query, ref, 1, by, payload, radius).drop("rank")


def cloud_metrics(pred: DataFrame, gt: DataFrame, by: Sequence[str], threshold: float = 0.05) -> DataFrame:
    """Accuracy, completion (mean, median), completion ratio and Chamfer distance."""
    by = list(by)

    def side(q: DataFrame, r: DataFrame, name: str) -> DataFrame:
        found = cut(nearest(q, r, by).select(*by, "distance"))
        stats = found.groupBy(*by).agg(
            F.avg("distance").alias(name), F.avg((F.col("distance") < threshold).cast("double")).alias(f"{name}_ratio")
        )
        med = quantiles(found, by, F.col("distance"), {f"{name}_median": (0.5, "linear")}).drop("n_values")
        return stats.join(med, by)

    acc, comp = side(pred, gt, "acc"), side(gt, pred, "comp")
    return acc.join(comp, by).select(
        *by, "acc", "acc_median", "comp", "comp_median", F.col("comp_ratio"), ((F.col("acc") + F.col("comp")) / 2).alias("chamfer")
    )


NORMAL = ("nx", "ny", "nz")


def normal_consistency(pred: DataFrame, gt: DataFrame, by: Sequence[str]) -> DataFrame:
    """Mean and median of |n·n'| between nearest points, in both directions."""
    by = list(by)

    def side(q: DataFrame, r: DataFrame, name: str) -> DataFrame:
        found = nearest(q, r, by, NORMAL).join(q.select(*by, "pid", *NORMAL), [*by, "pid"])
        value = F.abs(C.total([F.col(c) * F.col(f"ref_{c}") for c in NORMAL]))
        dots = cut(found.select(*by, value.alias("_dot")))
        med = quantiles(dots, by, F.col("_dot"), {f"{name}_median": (0.5, "linear")}).drop("n_values")
        return dots.groupBy(*by).agg(F.avg("_dot").alias(name)).join(med, by)

    return side(pred, gt, "nc1").join(side(gt, pred, "nc2"), by)


def estimate_normals(points: DataFrame, k: int = 30, by: Sequence[str] = ()) -> DataFrame:
    """Unit normal of each point: direction of least spread of its k nearest points (itself included)."""
    by = list(by)
    near = knn(points, points, k, by)
    cov = F.array(*[F.covar_pop(f"ref_{a}", f"ref_{b}") for a in AXES for b in AXES])
    rows = near.groupBy(*by, "pid").agg(cov.alias("_cov")).withColumn("_n", smallest_eigenvector("_cov"))
    normals = rows.select(*by, "pid", *[F.col("_n")[i].alias(c) for i, c in enumerate(NORMAL)])
    return points.join(normals, [*by, "pid"])


def voxels(points: DataFrame, size: float, by: Sequence[str] = ()) -> DataFrame:
    return points.select(*by, *[F.floor(F.col(a) / size).alias(f"v{a}") for a in AXES]).distinct()


def voxel_iou(a: DataFrame, b: DataFrame, size: float, by: Sequence[str]) -> DataFrame:
    """Intersection over union of the occupied voxels, in one aggregation over tagged voxels."""
    by = list(by)
    tagged = voxels(a, size, by).withColumn("_in", F.lit(1)).unionByName(voxels(b, size, by).withColumn("_in", F.lit(2)))
    merged = tagged.groupBy(*by, "vx", "vy", "vz").agg(F.bit_or("_in").alias("_in"))
    return merged.groupBy(*by).agg(
        F.count_if(F.col("_in") == 3).alias("intersection"),
        F.count(F.lit(1)).alias("union"),
        (F.count_if(F.col("_in") == 3) / F.count(F.lit(1))).alias("iou"),
    )


def scene_scale(points: DataFrame, by: Sequence[str], clouds: DataFrame | None = None) -> DataFrame:
    """Diagonal of the 5-95 percentile box of each cloud; 1 where there are no points.

    ``clouds`` names all clouds; without it only those appear that have a row in ``points``.
    """
    by = list(by)
    tall = points.select(*by, F.posexplode(F.array(*AXES)).alias("_axis", "_value"))
    band = quantiles(tall, [*by, "_axis"], F.col("_value"), {"_lo": (0.05, "linear"), "_hi": (0.95, "linear")})
    sized = band.groupBy(*by).agg(F.sqrt(F.sum(F.pow(F.col("_hi") - F.col("_lo"), 2))).alias("scene_scale"))
    named = (points if clouds is None else clouds).select(*by).distinct()
    return same_group(named, sized, by, "left").withColumn("scene_scale", F.coalesce("scene_scale", F.lit(1.0)))


def merge_clouds(clouds: Sequence[DataFrame], percent: float = 0.0) -> tuple[DataFrame, DataFrame]:
    """Union of clouds (confident points only) and the point count per cloud and in total."""
    from framespan.operators.filters import confident_points

    merged = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), clouds)
    kept = confident_points(merged, percent, ["cloud"])
    return kept, kept.rollup("cloud").agg(F.count(F.lit(1)).alias("n_points"))


def transform_cloud(points: DataFrame, fits: DataFrame, by: Sequence[str], rows: int | None = None) -> DataFrame:
    """Apply the (s, r, t) of each group to its points; groups without a fit stay as they are."""
    by = list(by)
    joined = attach(points, fits.select(*by, F.struct("s", "r", "t").alias("_g")), by, rows, "left")
    moved = C.sim3_apply("_g", [F.col(a) for a in AXES])
    ready = F.col("_g.s").isNotNull()
    rest = [c for c in points.columns if c not in AXES]
    return joined.select(*rest, *[F.when(ready, m).otherwise(F.col(a)).alias(a) for a, m in zip(AXES, moved)])


def icp(
    pred: DataFrame, gt: DataFrame, radius: float, by: Sequence[str], max_iters: int = 30, tol: float = 1e-6
) -> DataFrame:
    """Point-to-point ICP from the identity: (by, s=1, r, t, rmse, fitness, converged).

    Each round matches all clouds by exact nearest neighbours within ``radius`` and refits. A cloud
    stops when its rmse and inlier share change by less than ``tol``; only the count of moving
    clouds reaches the driver, and the transforms (one row per cloud) are checkpointed.
    """
    from framespan.operators.registration import register_points

    by = list(by)
    groups = group_count(pred, by)
    index = point_index(gt, 1, by)
    sizes = pred.groupBy(*by).agg(F.count(F.lit(1)).alias("_size"))
    start = C.sim3_identity()
    state = cut(
        sizes.select(*by, "_size", start["s"].alias("s"), start["r"].alias("r"), start["t"].alias("t"))
        .withColumn("rmse", F.lit(0.0)).withColumn("fitness", F.lit(0.0)).withColumn("_done", F.lit(False))
    )
    for _ in range(max_iters):
        live = state.where(~F.col("_done"))
        if live.isEmpty():
            break
        cloud = attach(pred, live.select(*by), by, groups, "left_semi")
        moved = cut(transform_cloud(cloud, live, by, groups))
        found = nearest(moved, index, by, radius=radius)
        pairs = found.join(moved.select(*by, "pid", *AXES), [*by, "pid"]).select(
            *by, "distance", *[F.col(a).alias(f"s{a}") for a in AXES], *[F.col(f"ref_{a}").alias(f"d{a}") for a in AXES]
        )
        pairs = cut(pairs)
        step = register_points(pairs, by, 1.0).where("status = 'ok'").select(*by, F.struct("s", "r", "t").alias("_step"))
        stats = pairs.groupBy(*by).agg(F.sqrt(F.avg(F.col("distance") * F.col("distance"))).alias("_rmse"), F.count(F.lit(1)).alias("_n"))
        joined = state.join(step, by, "left").join(stats, by, "left")
        ready = ~F.col("_done") & F.col("_step").isNotNull()
        fit = F.col("_n") / F.col("_size")
        settled = (F.abs(F.col("_rmse") - F.col("rmse")) < tol) & (F.abs(fit - F.col("fitness")) < tol)
        nxt = C.sim3_compose("_step", F.struct("s", "r", "t"))
        state = cut(
            joined.withColumn("_next", nxt).select(
                *by,
                "_size",
                *[F.when(ready, F.col("_next")[c]).otherwise(F.col(c)).alias(c) for c in ("s", "r", "t")],
                F.when(ready, F.col("_rmse")).otherwise(F.col("rmse")).alias("rmse"),
                F.when(ready, fit).otherwise(F.col("fitness")).alias("fitness"),
                (F.col("_done") | F.col("_step").isNull() | F.coalesce(settled, F.lit(False))).alias("_done"),
            )
        )
    return state.withColumnRenamed("_done", "converged").drop("_size")
