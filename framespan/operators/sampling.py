"""Frame selection: fixed steps, strategies, neighbours, exact-n and proportional samples."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from framespan.functions.columns import hash52
from framespan.operators.joins import attach
from framespan.operators.ranking import ranked, smallest_n


def sample_every(df: DataFrame, k: int, by: Sequence[str], order: Sequence[Column], skip: int = 0) -> DataFrame:
    """Every k-th row after ordering, starting with row ``skip``."""
    out = ranked(df, by, order, "_rn")
    place = F.col("_rn") - 1 - skip
    return out.where((place >= 0) & (place % k == 0)).drop("_rn")


def slice_rows(
    df: DataFrame, by: Sequence[str], order: Sequence[Column], skip: int = 0, stride: int = 1, n: int | None = None
) -> DataFrame:
    """Rows skip, skip+stride, ... of each group, at most ``n`` of them."""
    out = ranked(df, by, order, "_rn")
    place = F.col("_rn") - 1 - skip
    keep = (place >= 0) & (place % stride == 0)
    if n is not None:
        keep = keep & (place < n * stride)
    return out.where(keep).drop("_rn")


def sampling_map(
    frames: DataFrame, strategy: str, num_frames: int = 0, kf_every: int = 1, seed: int = 0
) -> DataFrame:
    """(seq, frame_id, pos): the chosen frames of each sequence.

    The long form grows with the frames; ``as_map`` folds it to one array per sequence. Input
    ``frames`` is ``(seq, frame_id)`` with frame ids 0..n-1.
    """
    if strategy == "all":
        chosen = frames.select("seq", "frame_id", F.col("frame_id").cast("long").alias("_order"))
    elif strategy == "stride":
        chosen = frames.where(F.col("frame_id") % kf_every == 0).select(
            "seq", "frame_id", F.col("frame_id").cast("long").alias("_order")
        )
    elif strategy == "stride-half":
        sizes = frames.groupBy("seq").agg(F.count(F.lit(1)).alias("_n"))
        chosen = (
            frames.join(sizes, "seq")
            .where((F.col("frame_id") < F.floor(F.col("_n") / 2)) & (F.col("frame_id") % kf_every == 0))
            .select("seq", "frame_id", F.col("frame_id").cast("long").alias("_order"))
        )
    elif strategy == "random_order":
        keyed = frames.withColumn("_order", hash52(seed, "seq", "frame_id"))
        order = [F.col("_order"), F.col("frame_id")]
        sized = ranked(keyed, ["seq"], order, "_rn", "_n")
        return sized.where((F.col("_n") >= num_frames) & (F.col("_rn") <= num_frames)).select(
            "seq", "frame_id", (F.col("_rn") - 1).alias("pos")
        )
    else:
        raise ValueError(f"unknown sampling strategy {strategy!r}")
    return ranked(chosen, ["seq"], [F.col("_order")], "_rn").select("seq", "frame_id", (F.col("_rn") - 1).alias("pos"))


def as_map(chosen: DataFrame) -> DataFrame:
    """One row per sequence with its id array, for JSON export of sampling maps."""
    pairs = F.array_sort(F.collect_list(F.struct("pos", "frame_id")))
    return chosen.groupBy("seq").agg(F.transform(pairs, lambda p: p["frame_id"]).alias("ids"))


def query_first(chosen: DataFrame, query: DataFrame) -> DataFrame:
    """(seq, frame_id, pos) with the query frame of each sequence at position 0 and the former first one in its place.

    ``query`` has one (seq, index) per sequence. Sequences without one, or whose index names no
    position, keep their order.
    """
    last = chosen.groupBy("seq").agg(F.max("pos").alias("_last")).join(query.select("seq", F.col("index").alias("_index")), "seq")
    swaps = last.where(F.col("_index").between(0, F.col("_last"))).select("seq", "_index")
    pos = F.when(F.col("pos") == F.col("_index"), 0).when(F.col("pos") == 0, F.col("_index")).otherwise(F.col("pos"))
    return attach(chosen, swaps, ["seq"], how="left").select("seq", "frame_id", F.coalesce(F.when(F.col("_index").isNotNull(), pos), "pos").cast("long").alias("pos"))


def select_frames(frames: DataFrame, chosen: DataFrame) -> DataFrame:
    """Frames named by a sampling map (long form, or with an ``ids`` array)."""
    if "ids" in chosen.columns:
        chosen = chosen.select("seq", F.explode("ids").alias("frame_id"))
    return frames.join(chosen.select("seq", "frame_id").distinct(), ["seq", "frame_id"], "left_semi")


def nearby_ids(
    anchors: DataFrame, n: int, expand_range: int | None = None, expand_ratio: float = 2.0, seed: int = 0
) -> DataFrame:
    """``n`` ids around each anchor, drawn with replacement; the anchor itself comes first.

    ``anchors`` is (seq, anchor, num_frames). Draws fall in [anchor-r, anchor+r) clipped to the
    sequence, with r = ``expand_range`` or int(n * expand_ratio).
    """
    reach = expand_range if expand_range is not None else int(n * expand_ratio)
    low = F.greatest(F.lit(0), F.col("anchor") - reach)
    high = F.least(F.col("num_frames"), F.col("anchor") + reach)
    spread = anchors.withColumn("pos", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    drawn = low + F.pmod(hash52(seed, "seq", "anchor", "pos"), high - low)
    return spread.select(
        "seq", "anchor", "pos", F.when(F.col("pos") == 0, F.col("anchor")).otherwise(drawn).cast("long").alias("frame_id")
    )


def sample_n(df: DataFrame, n: int, by: Sequence[str], ids: Sequence[str], seed: int = 0) -> DataFrame:
    """Exactly ``n`` uniform rows per group (all rows of smaller groups)."""
    keyed = df.withColumn("_hash", hash52(seed, *by, *ids))
    return smallest_n(keyed, by, [F.col("_hash"), *[F.col(i) for i in ids]], n).drop("_hash")


def sample_fraction_exact(df: DataFrame, ratio: float, by: Sequence[str], ids: Sequence[str], seed: int = 0) -> DataFrame:
    """Exactly int(n * ratio) uniform rows per group, without holding a reservoir."""
    keyed = df.withColumn("_hash", hash52(seed, *by, *ids))
    order = [F.col("_hash"), *[F.col(i) for i in ids]]
    sized = ranked(keyed, by, order, "_rn", "_n")
    return sized.where(F.col("_rn") <= F.floor(F.col("_n") * F.lit(ratio))).drop("_rn", "_n", "_hash")


def cap_mask(df: DataFrame, mask: str, n: int, by: Sequence[str], ids: Sequence[str], seed: int = 0) -> DataFrame:
    """Keep at most ``n`` true mask entries per group; the rest become false.

    The n-th smallest hash among the true entries is the cut, so rows are never gathered.
    """
    keyed = df.withColumn("_hash", hash52(seed, *by, *ids))
    order = [F.col("_hash"), *[F.col(i) for i in ids]]
    kept = smallest_n(keyed.where(mask), by, order, n).select(*by, *ids, F.lit(True).alias("_keep"))
    out = keyed.join(kept, [*by, *ids], "left")
    return out.withColumn(mask, F.coalesce("_keep", F.lit(False))).drop("_keep", "_hash")


__all__ = [
    "as_map",
    "cap_mask",
    "nearby_ids",
    "sample_every",
    "sample_fraction_exact",
    "sample_n",
    "sampling_map",
    "select_frames",
    "slice_rows",
]
