"""Segments of depth frames: labelling, matching by overlap, layer-wise scale."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from framespan.operators.grids import grid_edges
from framespan.operators.joins import attach
from framespan.operators.ranking import quantiles
from framespan.operators.robust import irls_scale_depth

FRAME = ("scene", "frame_id")


def segment_overlap(a: DataFrame, b: DataFrame, by: Sequence[str], pixel: Sequence[str] = ("v", "u")) -> DataFrame:
    """Overlap of every touching segment pair of two labelings.

    ``a`` and ``b`` are (by, pixel, seg). Pixels join one to one; counts per pair are aggregated
    before the small area tables are joined. Adds IoU and the smaller/larger relative intersection.
    """
    by = list(by)
    left = a.select(*by, *pixel, F.col("seg").alias("seg_a"))
    right = b.select(*by, *pixel, F.col("seg").alias("seg_b"))
    inter = left.join(right, [*by, *pixel]).groupBy(*by, "seg_a", "seg_b").agg(F.count(F.lit(1)).alias("inter"))
    area_a = left.groupBy(*by, "seg_a").agg(F.count(F.lit(1)).alias("area_a"))
    area_b = right.groupBy(*by, "seg_b").agg(F.count(F.lit(1)).alias("area_b"))
    joined = inter.join(area_a, [*by, "seg_a"]).join(area_b, [*by, "seg_b"])
    ratio_a = F.col("inter") / F.greatest(F.col("area_a"), F.lit(1))
    ratio_b = F.col("inter") / F.greatest(F.col("area_b"), F.lit(1))
    union = F.col("area_a") + F.col("area_b") - F.col("inter")
    return joined.select(
        *by,
        "seg_a",
        "seg_b",
        "inter",
        "area_a",
        "area_b",
        (F.col("inter") / F.greatest(union, F.lit(1))).alias("iou"),
        F.least(ratio_a, ratio_b).alias("min_rel"),
        F.greatest(ratio_a, ratio_b).alias("max_rel"),
    )


def segment_iou(a: DataFrame, b: DataFrame, threshold: float, by: Sequence[str], pixel: Sequence[str] = ("v", "u")) -> DataFrame:
    """Segment pairs with IoU >= ``threshold`` (many to many)."""
    pairs = segment_overlap(a, b, by, pixel).where(F.col("iou") >= threshold)
    return pairs.select(*by, "seg_a", "seg_b", "inter", "iou")


def temporal_edges(labels: DataFrame, threshold: float = 0.3, by: Sequence[str] = ("scene",), pixel: Sequence[str] = ("v", "u")) -> DataFrame:
    """Edges between segments of consecutive frames of a sequence."""
    by = list(by)
    earlier = labels.select(*by, "frame_id", *pixel, "seg")
    later = labels.select(*by, (F.col("frame_id") - 1).alias("frame_id"), *pixel, "seg")
    matched = segment_iou(earlier, later, threshold, [*by, "frame_id"], pixel)
    return matched.select(
        *by,
        F.col("frame_id").alias("src_frame"),
        F.col("seg_a").alias("src_seg"),
        (F.col("frame_id") + 1).alias("dst_frame"),
        F.col("seg_b").alias("dst_seg"),
        "iou",
        F.lit("temporal").alias("kind"),
    )


def cross_window_edges(
    overlap_labels: DataFrame, threshold: float = 0.4, by: Sequence[str] = ("scene", "window_id"), pixel: Sequence[str] = ("v", "u")
) -> DataFrame:
    """Edges between the previous and the current window's segments of a shared frame.

    ``overlap_labels`` has ``prev_seg`` and ``cur_seg`` per shared pixel.
    """
    keys = [*by, "frame_id"]
    prev = overlap_labels.select(*keys, *pixel, F.col("prev_seg").alias("seg"))
    cur = overlap_labels.select(*keys, *pixel, F.col("cur_seg").alias("seg"))
    matched = segment_iou(prev, cur, threshold, keys, pixel)
    return matched.select(
        *by,
        F.col("frame_id").alias("src_frame"),
        F.col("seg_a").alias("src_seg"),
        F.col("frame_id").alias("dst_frame"),
        F.col("seg_b").alias("dst_seg"),
        "iou",
        F.lit("window").alias("kind"),
    )


def depth_span(px: DataFrame, by: Sequence[str], share: float = 0.1, q: float | None = None) -> DataFrame:
    """Merge threshold per frame: ``share`` of the depth range of the confident pixels."""
    by = list(by)
    used = px
    if q is not None:
        cut = quantiles(px, by, F.col("conf"), {"_cut": (q, "nearest")}).drop("n_values")
        used = attach(px, cut, by).where(F.col("conf") >= F.col("_cut"))
    return used.groupBy(*by).agg((share * (F.max("depth") - F.min("depth"))).alias("threshold"))


def merge_regions(px: DataFrame, thresholds: DataFrame | float, by: Sequence[str] = FRAME) -> DataFrame:
    """Merge touching segments whose mean depths differ by less than the frame's threshold.

    Only right and bottom neighbours are compared and label 0 never takes part. Returns
    (by, seg, merged) where ``merged`` is the smallest label of the merged region.
    """
    by = list(by)
    means = px.groupBy(*by, "seg").agg(F.avg("depth").alias("_mean"))
    touching = (
        grid_edges(px, by, ["seg"])
        .where((F.col("a_seg") != F.col("b_seg")) & (F.col("a_seg") != 0) & (F.col("b_seg") != 0))
        .select(*by, F.least("a_seg", "b_seg").alias("_a"), F.greatest("a_seg", "b_seg").alias("_b"))
        .distinct()
    )
    mean_a = means.select(*by, F.col("seg").alias("_a"), F.col("_mean").alias("_ma"))
    mean_b = means.select(*by, F.col("seg").alias("_b"), F.col("_mean").alias("_mb"))
    gaps = touching.join(mean_a, [*by, "_a"]).join(mean_b, [*by, "_b"])
    if isinstance(thresholds, DataFrame):
        gaps = attach(gaps, thresholds, by)
    else:
        gaps = gaps.withColumn("threshold", F.lit(float(thresholds)))
    close = gaps.where(F.abs(F.col("_ma") - F.col("_mb")) < F.col("threshold"))
    kind = px.schema["seg"].dataType.simpleString()
    rows = means.select(*by, F.col("seg").alias("_a"), F.col("seg").alias("_b")).unionByName(close.select(*by, "_a", "_b"))
    keys = ", ".join(f"`{c}` {px.schema[c].dataType.simpleString()}" for c in by)
    return rows.groupBy(*by).applyInPandas(_merge_frame(by), f"{keys}, seg {kind}, merged {kind}")


def _joined(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest index that edges (a, b) connect to each of ``n`` nodes: hooking and pointer jumping."""
    root = np.arange(n)
    while len(a):
        low, high = np.minimum(root[a], root[b]), np.maximum(root[a], root[b])
        np.minimum.at(root, high, low)
        while True:
            up = root[root]
            if (up == root).all():
                break
            root = up
        live = root[a] != root[b]
        a, b = a[live], b[live]
    return root


def _merge_frame(by: list[str]):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        """Segments of one frame; a row with equal ends only names a segment."""
        segs = np.unique(np.concatenate([pdf["_a"].to_numpy(), pdf["_b"].to_numpy()]))
        root = _joined(len(segs), np.searchsorted(segs, pdf["_a"].to_numpy()), np.searchsorted(segs, pdf["_b"].to_numpy()))
        keys = {c: [pdf[c].iloc[0]] * len(segs) for c in by}
        return pd.DataFrame({**keys, "seg": segs, "merged": segs[root]})

    return run


def _segment_frame(threshold: float, values: list[str]):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        """All pixels of one frame: a frame is bounded by the size of an image."""
        pdf = pdf.sort_values(["v", "u"], kind="stable").reset_index(drop=True)
        v, u = pdf["v"].to_numpy(np.int64), pdf["u"].to_numpy(np.int64)
        x = pdf[values].to_numpy(float)
        width = (u.max() - u.min() if len(u) else 0) + 2
        place = (v - v.min()) * width + (u - u.min())

        def beside(step: int) -> np.ndarray:
            """Row number of the pixel ``step`` places on, or -1."""
            at = np.minimum(np.searchsorted(place, place + step), len(place) - 1)
            return np.where(place[at] == place + step, at, -1)

        steep = np.zeros(len(pdf), bool)
        for step in (1, width):
            ahead, behind = beside(step), beside(-step)
            both = (ahead >= 0) & (behind >= 0)
            square = ((x[ahead] - x[behind]) ** 2).sum(axis=1)
            steep |= both & ~(square <= threshold * threshold)
        ends = []
        for step in (1, width):
            ahead = beside(step)
            alike = ((x - x[ahead]) ** 2).sum(axis=1) <= threshold * threshold
            here = np.flatnonzero((ahead >= 0) & ~steep & ~steep[ahead] & alike)
            ends.append((here, ahead[here]))
        root = _joined(len(pdf), *(np.concatenate(e) for e in zip(*ends)))
        label = np.cumsum(root == np.arange(len(root)))[root] - 1
        return pdf.assign(seg=np.where(steep, -1, label).astype(np.int32))

    return run


def segment_pixels(px: DataFrame, threshold: float, by: Sequence[str] = FRAME, values: Sequence[str] = ("depth",)) -> DataFrame:
    """Segment a frame by joining similar 4-neighbours; steep pixels get label -1.

    Two neighbours join when neither is steep and their distance is at most ``threshold``. Labels
    are dense from 0 in the order of the first pixel of each segment (steep pixels use up numbers).
    """
    by = list(by)
    px = px.select(*by, "v", "u", *values)
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in px.schema.fields)
    return px.groupBy(*by).applyInPandas(_segment_frame(threshold, list(values)), f"{fields}, seg int")


# --- layer-wise scale ------------------------------------------------------------------------


def segment_scale(overlap: DataFrame, edges: DataFrame, by: Sequence[str] = ("scene", "window_id", "frame_id")) -> DataFrame:
    """Robust depth scale of every matched segment pair on the pixels they share.

    ``overlap`` has ``prev_seg, cur_seg, prev_depth, cur_depth`` per shared pixel; ``edges`` is
    (by, seg_a, seg_b, iou). The scale maps the current depth to the previous one.
    """
    by = list(by)
    keys = [*by, "seg_a", "seg_b"]
    px = overlap.select(
        *by, F.col("prev_seg").alias("seg_a"), F.col("cur_seg").alias("seg_b"), F.col("cur_depth").alias("pred"), F.col("prev_depth").alias("gt")
    )
    pairs = px.join(edges.select(*keys, "iou"), keys)
    scales = irls_scale_depth(pairs, keys)
    return edges.select(*keys, "iou").join(scales.select(*keys, "scale"), keys)


def _propagate_window(by: list[str]):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        """Layer-order propagation inside one window (a bounded number of segments)."""
        weight: dict = {}
        value: dict = {}

        def give(node, w, s):
            weight[node] = weight.get(node, 0.0) + w
            value[node] = value.get(node, 0.0) + w * s

        seeds = pdf[pdf["kind"] == "seed"].sort_values(["dst_frame", "dst_seg", "src_seg"])
        for row in seeds.itertuples(index=False):
            give((row.dst_frame, row.dst_seg), row.iou, row.scale)
        edges = pdf[pdf["kind"] == "edge"].sort_values(["src_frame", "src_seg", "dst_seg"])
        for row in edges.itertuples(index=False):
            parent = (row.src_frame, row.src_seg)
            if weight.get(parent, 0.0) > 0:
                give((row.dst_frame, row.dst_seg), row.iou, value[parent] / weight[parent])
        nodes = pdf[pdf["kind"] == "node"]
        keys = list(zip(nodes["dst_frame"], nodes["dst_seg"]))
        out = nodes[by].copy()
        out["frame_id"], out["seg"] = nodes["dst_frame"].to_numpy(), nodes["dst_seg"].to_numpy()
        out["scale"] = np.array([value[k] / weight[k] if weight.get(k, 0.0) > 0 else 1.0 for k in keys], dtype=float)
        return out

    return run


def propagate_scale(
    nodes: DataFrame, edges: DataFrame, seeds: DataFrame, by: Sequence[str] = ("scene", "window_id")
) -> DataFrame:
    """Scale of every segment of a window: (by, frame_id, seg, scale).

    Seeds sit on the overlap frames; each segment passes its weighted mean scale to its successors
    in the next frame with the edge IoU as weight. Segments nothing reaches keep 1.0. One group is
    one window, whose frame count is the window size, so groups stay small in any scene.
    """
    by = list(by)
    none = F.lit(None)
    rows = (
        nodes.select(
            *by, F.lit("node").alias("kind"), none.cast("long").alias("src_frame"), none.cast("long").alias("src_seg"),
            F.col("frame_id").cast("long").alias("dst_frame"), F.col("seg").cast("long").alias("dst_seg"),
            F.lit(0.0).alias("iou"), F.lit(1.0).alias("scale"),
        )
        .unionByName(
            edges.select(
                *by, F.lit("edge").alias("kind"), F.col("src_frame").cast("long").alias("src_frame"), F.col("src_seg").cast("long").alias("src_seg"),
                F.col("dst_frame").cast("long").alias("dst_frame"), F.col("dst_seg").cast("long").alias("dst_seg"),
                F.col("iou").cast("double").alias("iou"), F.lit(1.0).alias("scale"),
            )
        )
        .unionByName(
            seeds.select(
                *by, F.lit("seed").alias("kind"), none.cast("long").alias("src_frame"), F.col("seg_a").cast("long").alias("src_seg"),
                F.col("frame_id").cast("long").alias("dst_frame"), F.col("seg_b").cast("long").alias("dst_seg"),
                F.col("iou").cast("double").alias("iou"), F.col("scale").cast("double").alias("scale"),
            )
        )
    )
    kinds = dict(rows.dtypes)
    schema = ", ".join(f"{c} {kinds[c]}" for c in by) + ", frame_id long, seg long, scale double"
    return rows.groupBy(*by).applyInPandas(_propagate_window(by), schema)


def refine_depth(
    px: DataFrame, size: int, overlap: int, corr_iou: float = 0.4, temporal_iou: float = 0.3, by: Sequence[str] = ("scene",)
) -> DataFrame:
    """Layer-wise refinement of labelled windows.

    ``px`` is (by, window_id, pos, frame_id, v, u, depth, seg). Segments of adjacent windows are
    matched on the shared frames, their scales estimated, propagated through the window and
    multiplied into the depth (``scale_mask`` keeps the factor). Window 0 keeps factor 1.
    """
    from framespan.operators.windows import adjacent_overlap

    by = list(by)
    keys = [*by, "window_id"]
    shared = adjacent_overlap(px, size, overlap, ["depth", "seg"], by, ["v", "u"])
    cross = cross_window_edges(shared, corr_iou, keys)
    matched = cross.select(*keys, F.col("src_frame").alias("frame_id"), F.col("src_seg").alias("seg_a"), F.col("dst_seg").alias("seg_b"), "iou")
    seeds = segment_scale(shared, matched, [*keys, "frame_id"])
    later = px.where("window_id > 0")
    edges = temporal_edges(later, temporal_iou, keys)
    nodes = later.select(*keys, "frame_id", "seg").distinct()
    scales = propagate_scale(nodes, edges, seeds, keys)
    joined = px.join(scales.withColumnRenamed("scale", "_mask"), [*keys, "frame_id", "seg"], "left")
    mask: Column = F.coalesce("_mask", F.lit(1.0))
    return joined.withColumn("scale_mask", mask).withColumn("depth", F.col("depth") * mask).drop("_mask")
