"""Descriptor similarity: exact top-k, representative frames, diverse frames."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from framespan.functions.columns import dot
from framespan.operators.joins import attach, group_count

#: Smallest and largest block of frames; the largest keeps the copies few, some ten megabytes a task.
BLOCK_ROWS = (2048, 16384)
#: Rows of one side of a matrix product.
TILE_ROWS = 2048


def _merge(best: tuple, found: tuple, limit: np.ndarray, k: int) -> tuple:
    """The best ``k`` of both per row, by similarity and then by id, so equal scores are cut the same way everywhere.

    ``best`` and ``found`` are (row, partner, similarity); ``limit`` takes the k-th similarity of every row that has k.
    """
    rows, partners, values = (np.concatenate(x) for x in zip(best, found))
    order = np.lexsort((partners, -values, rows))
    rows, partners, values = rows[order], partners[order], values[order]
    place = np.arange(len(rows)) - np.searchsorted(rows, rows)
    limit[rows[place == k - 1]] = values[place == k - 1]
    return rows[place < k], partners[place < k], values[place < k]


def _reaching(sims: np.ndarray, limit: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Places that may be among the best ``k`` of their row: none below the k-th so far, found by selection where many are left."""
    hit = sims >= limit[:, None]
    if k < sims.shape[1] and np.count_nonzero(hit) > 4 * k * len(sims):
        at = sims.shape[1] - k
        hit &= sims >= np.partition(sims, at, axis=1)[:, at, None]
    return np.nonzero(hit)


def _block_topk(k: int, by: list[str]):
    """Best k partners within one unordered pair of blocks, for the rows of both; each product of two tiles serves both."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        low, high = rows["_a"].iloc[0], rows["_b"].iloc[0]
        vectors = np.stack(rows["embedding"].to_numpy()).astype(np.float64)
        ids, home = rows["frame_id"].to_numpy(), rows["_home"].to_numpy()
        limit = np.full(len(ids), -np.inf)
        best = (np.zeros(0, np.int64), ids[:0], np.zeros(0))
        tiles = [[where[at : at + TILE_ROWS] for at in range(0, len(where), TILE_ROWS)] for where in (np.flatnonzero(home == low), np.flatnonzero(home == high))]
        for s, left in enumerate(tiles[0]):
            for t, right in enumerate(tiles[1]):
                if low == high and t < s:
                    continue
                sims = vectors[left] @ vectors[right].T
                sims[np.isnan(sims)] = -np.inf
                if low == high:
                    sims[ids[left][:, None] == ids[right][None, :]] = -np.inf
                sides = [(sims, left, right), (sims.T, right, left)]
                for scores, mine, others in sides[:1] if low == high and s == t else sides:
                    r, c = _reaching(scores, limit[mine], k)
                    best = _merge(best, (mine[r], ids[others[c]], scores[r, c]), limit, k)
        real = np.isfinite(best[2])
        out = pd.DataFrame({"i": ids[best[0][real]], "j": best[1][real], "sim": best[2][real]})
        for c in by:
            out[c] = rows[c].iloc[0]
        return out[[*by, "i", "j", "sim"]]

    return run


def topk_similar(desc: DataFrame, k: int, by: Sequence[str] = ("scene",), block: int | None = None) -> DataFrame:
    """Exact top-k neighbours by inner product inside each scene: (scene, i, j, sim, rank).

    Frames are hashed into blocks of about ``block`` rows; by default a sixteenth of the scene within ``BLOCK_ROWS``. The product is
    symmetric, so each unordered pair of blocks is one task of small matrix products that emits k rows per frame of either block:
    a frame is copied once per block, a long scene spreads over many tasks and no
    list of all pairs ever exists. Self pairs are excluded by id (rows of one id share a block); ties go to the smaller id.
    """
    by = list(by)
    n = F.count(F.lit(1))
    size = F.lit(block) if block else F.least(F.greatest(n / 16, F.lit(BLOCK_ROWS[0])), F.lit(BLOCK_ROWS[1]))
    sizes = desc.groupBy(*by).agg(F.ceil(n / size).cast("int").alias("_nb"))
    rows = attach(desc.select(*by, "frame_id", "embedding"), sizes, by)
    rows = rows.withColumn("_home", F.pmod(F.xxhash64("frame_id"), F.col("_nb")).cast("int"))
    dealt = rows.withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("_nb") - 1)))
    dealt = dealt.select(*by, "frame_id", "embedding", "_home", F.least("_home", "_other").alias("_a"), F.greatest("_home", "_other").alias("_b"))
    kinds = dict(desc.dtypes)
    schema = ", ".join([f"{c} {kinds[c]}" for c in by] + [f"i {kinds['frame_id']}", f"j {kinds['frame_id']}", "sim double"])
    partial = dealt.groupBy(*by, "_a", "_b").applyInPandas(_block_topk(k, by), schema)
    best = Window.partitionBy(*by, "i").orderBy(F.desc("sim"), "j")
    return partial.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)


def normalised(desc: DataFrame) -> DataFrame:
    size = F.sqrt(dot("embedding", "embedding"))
    return desc.withColumn("embedding", F.transform("embedding", lambda x: x.cast("double") / F.nullif(size, F.lit(0.0))))


def similarity_sums(desc: DataFrame, by: Sequence[str] = ("scene",)) -> DataFrame:
    """Sum of similarities of each frame to all other frames of its scene.

    The inner product is linear, so the sum over all partners is the product with the sum vector:
    one aggregation instead of a pairwise matrix.
    """
    by = list(by)
    unit = normalised(desc)
    parts = unit.select(*by, F.posexplode("embedding").alias("_p", "_x")).groupBy(*by, "_p").agg(F.sum("_x").alias("_x"))
    pooled = parts.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("_p", "_x"))).alias("_sum"))
    pooled = pooled.withColumn("_sum", F.transform("_sum", lambda s: s["_x"]))
    joined = attach(unit, pooled, by)
    return joined.select(*by, "frame_id", (dot("embedding", "_sum") - dot("embedding", "embedding")).alias("sim_sum"))


def most_representative(desc: DataFrame, by: Sequence[str] = ("scene",)) -> DataFrame:
    """Frame with the largest similarity sum per scene; ties go to the smaller id."""
    return (
        similarity_sums(desc, by)
        .groupBy(*by)
        .agg(
            F.max_by("frame_id", F.struct(F.col("sim_sum"), -F.col("frame_id"))).alias("frame_id"),
            F.max("sim_sum").alias("sim_sum"),
        )
    )


def select_diverse(
    desc: DataFrame, k: int, seeds: DataFrame | None = None, mode: str = "last", by: Sequence[str] = ("scene",)
) -> DataFrame:
    """Farthest-point selection of k frames per scene: (scene, pos, frame_id).

    ``mode='last'`` measures the distance to the latest pick, ``'set'`` to the nearest pick. Each
    round is one aggregation over all scenes; the state is one row per scene with at most k picks.
    """
    if mode not in ("last", "set"):
        raise ValueError(f"unknown mode {mode!r}")
    by = list(by)
    unit = normalised(desc).select(*by, "frame_id", "embedding")
    seeds = most_representative(desc, by) if seeds is None else seeds
    rows = group_count(desc, by)
    first = attach(unit, seeds.select(*by, F.col("frame_id").alias("_seed")), by, rows).where(F.col("frame_id") == F.col("_seed"))
    state = first.select(*by, F.array("frame_id").alias("_picks"), F.array("embedding").alias("_vecs"))
    for _ in range(1, k):
        joined = attach(unit, state, by, rows)
        if mode == "last":
            distance = 100.0 - dot("embedding", F.element_at("_vecs", -1))
        else:
            distance = F.array_min(F.transform("_vecs", lambda v: 100.0 - dot("embedding", v)))
        # picked frames get a NULL order and lose; a scene without frames left keeps its picks
        open_ = ~F.array_contains("_picks", F.col("frame_id"))
        place = F.when(open_, F.struct(distance.alias("d"), (-F.col("frame_id")).alias("id")))
        far = joined.groupBy(*by).agg(
            F.first("_picks").alias("_picks"),
            F.first("_vecs").alias("_vecs"),
            F.max_by(F.struct("frame_id", "embedding"), place).alias("_far"),
        )
        grown = F.col("_far").isNotNull()
        state = far.select(
            *by,
            F.when(grown, F.concat("_picks", F.array("_far.frame_id"))).otherwise(F.col("_picks")).alias("_picks"),
            F.when(grown, F.concat("_vecs", F.array("_far.embedding"))).otherwise(F.col("_vecs")).alias("_vecs"),
        )
    return state.select(*by, F.posexplode("_picks").alias("pos", "frame_id"))
