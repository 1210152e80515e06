"""Dataset preparation on file listings and annotations."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from framespan.functions.columns import basename, col
from framespan.operators.joins import attach


def directory_name(path: Column | str, level: int = -1) -> Column:
    """Name of a directory on the path; -1 is the directory of the file."""
    return F.element_at(F.split(col(path), "/"), level - 1)


def pair_by_sequence(pred: DataFrame, gt: DataFrame, level: int = -1, strip: str | None = None) -> DataFrame:
    """Pair predictions and ground truth by directory name and position of the file in it.

    ``strip`` is a pattern removed from the ground-truth directory name (prefix or suffix rules).
    Both inputs have ``path``; files pair in name order within a sequence.
    """
    from framespan.operators.ranking import ranked

    def keyed(df: DataFrame, name: str, pattern: str | None) -> DataFrame:
        seq = directory_name("path", level)
        if pattern:
            seq = F.regexp_replace(seq, pattern, "")
        rows = df.select(seq.alias("seq"), F.col("path").alias(name))
        return ranked(rows, ["seq"], [F.col(name)], "pos")

    return keyed(pred, "pred_path", None).join(keyed(gt, "gt_path", strip), ["seq", "pos"])


def pending_sequences(wanted: DataFrame, present: DataFrame, available: DataFrame, key: str = "seq") -> DataFrame:
    """Status of each wanted sequence: ``present``, ``pending`` or ``missing``."""
    have = present.select(key).distinct().withColumn("_have", F.lit(True))
    known = available.select(key).distinct().withColumn("_known", F.lit(True))
    joined = wanted.select(key).distinct().join(have, key, "left").join(known, key, "left")
    status = F.when(F.col("_have"), "present").when(F.col("_known"), "pending").otherwise("missing")
    return joined.select(key, status.alias("status"))


def assemble_frames(
    requested: DataFrame, parts: dict[str, DataFrame], required: Sequence[str], keys: Sequence[str] = ("seq", "frame_id")
) -> tuple[DataFrame, DataFrame]:
    """Join rgb, depth, pose, camera, mask... of the requested frames into one record each.

    ``parts`` maps a name to a table on ``keys``; its other columns become the struct ``name``.
    Frames that lack a required part go to the reject table with the list of what is missing.
    """
    keys = list(keys)
    out = requested
    for name, table in parts.items():
        rest = [c for c in table.columns if c not in keys]
        out = out.join(table.select(*keys, F.struct(*rest).alias(name)), keys, "left")
    gaps = F.array_compact(F.array(*[F.when(F.col(n).isNull(), F.lit(n)) for n in required]))
    checked = out.withColumn("_gaps", gaps)
    rejects = checked.where(F.size("_gaps") > 0).select(*requested.columns, F.col("_gaps").alias("missing"))
    return checked.where(F.size("_gaps") == 0).drop("_gaps"), rejects


def group_by_video(lists: DataFrame) -> DataFrame:
    """Sequences of each source video: (url, n_seqs, n_frames, seqs)."""
    per_seq = lists.groupBy("url", "seq").agg(F.count(F.lit(1)).alias("n"), F.min("ts").alias("first_ts"))
    return per_seq.groupBy("url").agg(
        F.count(F.lit(1)).alias("n_seqs"),
        F.sum("n").alias("n_frames"),
        F.array_sort(F.collect_list(F.struct("seq", "n", "first_ts"))).alias("seqs"),
    )


def clock_text(micros: Column | str) -> Column:
    """Microseconds to HH:MM:SS.mmm (hours are not wrapped at a day)."""
    ms = F.floor(col(micros) / 1000)
    hours = F.floor(ms / 3_600_000)

    def two(c: Column) -> Column:
        return F.when(c < 10, F.lpad(c.cast("string"), 2, "0")).otherwise(c.cast("string"))

    return F.concat(
        two(hours), F.lit(":"), two(F.floor(ms % 3_600_000 / 60_000)), F.lit(":"), two(F.floor(ms % 60_000 / 1000)),
        F.lit("."), F.lpad((ms % 1000).cast("string"), 3, "0"),
    )


def validate_manifest(files: DataFrame, kinds: Sequence[str] = ("rgb", "depth", "pose")) -> DataFrame:
    """Violations per sequence: unequal counts, first index not 0, last index not n-1."""
    aggs = []
    for k in kinds:
        here = F.col("kind") == k
        index = F.when(here, F.col("frame_id"))
        aggs += [F.count_if(here).alias(f"n_{k}"), F.min(index).alias(f"first_{k}"), F.max(index).alias(f"last_{k}")]
    table = files.groupBy("seq").agg(*aggs)
    n0 = F.col(f"n_{kinds[0]}")
    same = [F.col(f"n_{k}") == n0 for k in kinds]
    starts = [F.coalesce(F.col(f"first_{k}") == 0, F.lit(False)) for k in kinds]
    ends = [F.coalesce(F.col(f"last_{k}") == n0 - 1, F.lit(False)) for k in kinds]

    def every(conds: list[Column]) -> Column:
        out = conds[0]
        for c in conds[1:]:
            out = out & c
        return out

    problem = F.array_compact(
        F.array(
            F.when(~every(same), "count_mismatch"), F.when(~every(starts), "first_not_zero"), F.when(~every(ends), "last_not_n_minus_1")
        )
    )
    return table.withColumn("violation", F.explode(problem)).select("seq", "violation", *[f"n_{k}" for k in kinds])


def build_annotations(lists: DataFrame, sizes: DataFrame) -> DataFrame:
    """Frame annotations from normalised intrinsics: pixel K, homogeneous extrinsics, id, path.

    ``lists`` is (seq, idx, fx, fy, cx, cy, p array<double>[12]); ``sizes`` is (seq, width, height).
    """
    joined = attach(lists, sizes, ["seq"])
    zero, one = F.lit(0.0), F.lit(1.0)
    k = F.array(
        F.array(F.col("width") * F.col("fx"), zero, F.col("width") * F.col("cx")),
        F.array(zero, F.col("height") * F.col("fy"), F.col("height") * F.col("cy")),
        F.array(zero, zero, one),
    )
    e = F.array(*[F.slice("p", 4 * i + 1, 4) for i in range(3)], F.array(zero, zero, zero, one))
    path = F.concat_ws("/", F.col("seq"), F.lit("images"), F.concat(F.lpad(F.col("idx").cast("string"), 4, "0"), F.lit(".png")))
    return joined.select("seq", "idx", path.alias("filepath"), k.alias("intrinsics"), e.alias("extrinsics"))


# Fixed evaluation registry: folder templates ({seq} is the sequence name), trajectory file
# template, trajectory format, fixed sequence list (NULL: all folders), skip sequences already done.
REGISTRY = [
    ("davis", "data/davis/DAVIS/JPEGImages/480p/{seq}", None, None, None, False),
    ("kitti", "data/kitti/depth_selection/val_selection_cropped/image_gathered/{seq}", None, None, None, False),
    ("nyu", "data/nyu-v2/val/nyu_images", None, None, None, False),
    (
        "bonn", "data/bonn/rgbd_bonn_dataset/rgbd_bonn_{seq}/rgb_110", "data/bonn/rgbd_bonn_dataset/rgbd_bonn_{seq}/groundtruth_110.txt",
        "tum", ["balloon2", "crowd2", "crowd3", "person_tracking2", "synchronous"], False,
    ),
    ("scannet", "data/scannetv2/{seq}/color_90", "data/scannetv2/{seq}/pose_90.txt", "replica", None, True),
    ("tum", "data/tum/{seq}/rgb_90", "data/tum/{seq}/groundtruth_90.txt", "tum", None, False),
    (
        "sintel", "data/sintel/training/final/{seq}", "data/sintel/training/camdata_left/{seq}", None,
        [
            "alley_2", "ambush_4", "ambush_5", "ambush_6", "cave_2", "cave_4", "market_2", "market_5", "market_6",
            "shaman_3", "sleeping_1", "sleeping_2", "temple_2", "temple_3",
        ],
        False,
    ),
    (
        "kitti_odometry", "data/KITTI_Odometry/dataset/sequences/{seq}/image_2", "data/KITTI_Odometry/dataset/poses/{seq}.txt",
        "replica", ["00", "01", "02", "03", "04", "05", "06", "07", "08", "09", "10"], False,
    ),
    (
        "waymo", "data/waymo_processed/segment-{seq}_with_camera_labels.tfrecord", None, None,
        [
            "16345319168590318167_1420_000_1440_000", "183829460855609442_430_000_450_000",
            "3156155872654629090_2474_780_2494_780", "3461811179177118163_1161_000_1181_000",
            "3711598698808133144_2060_000_2080_000", "4058410353286511411_3980_000_4000_000",
            "4604173119409817302_2820_000_2840_000", "5200186706748209867_80_000_100_000",
            "6104545334635651714_2780_000_2800_000",
        ],
        False,
    ),
    (
        "vbr", "data/vbr/{seq}/rgb", "data/vbr/{seq}/camera_pose.txt", "tum",
        [
            "campus_train0_processed_aligned", "campus_train1_processed_aligned", "ciampino_train1_processed_aligned",
            "colosseo_train0_processed_aligned", "diag_train0_processed_aligned", "pincio_train0_processed_aligned",
            "spagna_train0_processed_aligned",
        ],
        False,
    ),
]
REGISTRY_SCHEMA = "dataset string, frame_dir string, traj_file string, traj_format string, seqs array<string>, skip_done boolean"


def dataset_registry(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(REGISTRY, REGISTRY_SCHEMA)


def resolve_sequences(registry: DataFrame, listing: DataFrame, done: DataFrame | None = None) -> DataFrame:
    """Sequences to process with their folders, from the registry and a (dataset, seq) listing."""
    joined = listing.select("dataset", "seq").distinct().join(F.broadcast(registry), "dataset")
    chosen = joined.where(F.col("seqs").isNull() | F.array_contains("seqs", F.col("seq")))
    if done is not None:
        finished = done.select("dataset", "seq").distinct().withColumn("_done", F.lit(True))
        chosen = chosen.join(finished, ["dataset", "seq"], "left").where(~(F.col("skip_done") & F.coalesce("_done", F.lit(False)))).drop("_done")

    def fill(c: str) -> Column:
        return F.replace(F.col(c), F.lit("{seq}"), F.col("seq"))

    return chosen.select("dataset", "seq", fill("frame_dir").alias("frame_dir"), fill("traj_file").alias("traj_file"), "traj_format")


def unknown_sequences(registry: DataFrame, listing: DataFrame) -> DataFrame:
    """(dataset, seq, reason): the listed sequences that ``resolve_sequences`` leaves out for want of a rule."""
    listed = listing.select("dataset", "seq").distinct().join(F.broadcast(registry.select("dataset", "seqs", F.lit(True).alias("_known"))), "dataset", "left")
    reason = F.when(F.col("_known").isNull(), "unknown_dataset").when(~F.array_contains("seqs", F.col("seq")), "not_in_list")
    return listed.select("dataset", "seq", reason.alias("reason")).where(F.col("reason").isNotNull())


def split_members(df: DataFrame, scene: str = "scene", line: str = "line") -> DataFrame:
    """``sequenceX`` lines of a split file to ``scene/seq-0X``."""
    number = F.regexp_extract(F.trim(col(line)), r"^sequence(\d+)$", 1).cast("int").cast("string")
    padded = F.when(F.length(number) < 2, F.lpad(number, 2, "0")).otherwise(number)
    return df.withColumn("seq", F.concat(F.col(scene), F.lit("/seq-"), padded))


def frame_files(listing: DataFrame, path: str = "path") -> DataFrame:
    """Kind and frame number of files named ``frame-000123.<suffix>``."""
    name = basename(path)
    kind = (
        F.when(name.endswith(".color.png"), "rgb").when(name.endswith(".depth.proj.png"), "depth").when(name.endswith(".pose.txt"), "pose")
    )
    number = F.regexp_extract(name, r"-(\d+)\.", 1).cast("int")
    return listing.select(directory_name(path).alias("seq"), kind.alias("kind"), number.alias("frame_id"), F.col(path).alias("path")).where(
        F.col("kind").isNotNull()
    )
