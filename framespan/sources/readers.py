"""Readers: files to tables. Listings and text stay on the executors; nothing is collected."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from framespan.functions.columns import basename, natural_key
from framespan.functions.poses import matrix_from_quat, rigid_inverse
from framespan.operators.datasets import directory_name
from framespan.operators.ranking import ranked
from framespan.schemas import ANNOTATION
from framespan.sources.folders import few_tasks, listing

IMAGE_PATTERN = r"(?i)\.(png|jpg|jpeg)$"
DPT_TAG = 202021.25  # first float of a headered depth file


def scan_frames(spark: SparkSession, path: str, recursive: bool = True) -> DataFrame:
    """(scene, frame_id, path, length): image files in natural order per directory.

    Only path and size are read; file contents are pruned from the scan.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower()).load(path).select("path", "length")
    images = files.where(F.col("path").rlike(IMAGE_PATTERN)).withColumn("scene", directory_name("path"))
    numbered = ranked(images, ["scene"], [natural_key("path"), F.col("path")], "_rn")
    return numbered.select("scene", (F.col("_rn") - 1).alias("frame_id"), "path", "length")


def scan_images(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(images, unreadable): decoded RGB images, and the listed image files that failed to decode."""
    decoded = spark.read.format("image").option("dropInvalid", True).option("recursiveFileLookup", "true").load(path)
    images = decoded.select(
        F.col("image.origin").alias("path"),
        F.col("image.width").alias("width"),
        F.col("image.height").alias("height"),
        F.col("image.nChannels").alias("channels"),
        F.col("image.data").alias("data"),
    )
    listed = scan_frames(spark, path).select("scene", "frame_id", "path")
    # the two sources print local paths differently (file:/x and file:///x)
    plain = F.regexp_replace("path", r"^file:/+", "/")
    keyed = listed.withColumn("_key", plain)
    missing = keyed.join(images.select(plain.alias("_key")), "_key", "left_anti").drop("_key")
    return images, missing


RASTER_SCHEMA = T.StructType(
    [
        T.StructField("path", T.StringType()),
        T.StructField("h", T.IntegerType()),
        T.StructField("w", T.IntegerType()),
        T.StructField("depth", T.ArrayType(T.FloatType())),
        T.StructField("problem", T.StringType()),
    ]
)


def _npy_values(blob: bytes) -> tuple[np.ndarray, int, int]:
    import io

    grid = np.load(io.BytesIO(blob), allow_pickle=False)
    grid = grid.reshape(1, -1) if grid.ndim == 1 else grid
    return grid.astype(np.float32).reshape(-1), grid.shape[-2], grid.shape[-1]


def _decode(fmt: str, blob: bytes, h, w) -> tuple[np.ndarray, int, int]:
    if fmt == "dpt":
        if np.frombuffer(blob, "<f4", 1)[0] != np.float32(DPT_TAG):
            raise ValueError("wrong tag")
        w, h = (int(x) for x in np.frombuffer(blob, "<i4", 2, offset=4))
        return np.frombuffer(blob, "<f4", offset=12), h, w
    if fmt == "npy":
        return _npy_values(blob)
    values = np.frombuffer(blob, "<f4")
    if h is None or w is None or pd.isna(h) or pd.isna(w):
        raise ValueError("size unknown")
    return values, int(h), int(w)


def scan_rasters(spark: SparkSession, path: str, fmt: str = "dpt", sizes: DataFrame | None = None) -> DataFrame:
    """(path, h, w, depth, problem): float32 rasters of ``dpt``, ``npy`` or headerless ``raw`` files.

    Headerless files take their size from ``sizes`` (name, h, w). Files that do not decode keep a
    row with ``problem`` set.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "content")
    if sizes is not None:
        files = files.withColumn("name", basename("path")).join(sizes.select("name", "h", "w"), "name", "left").drop("name")
    else:
        files = files.withColumn("h", F.lit(None).cast("int")).withColumn("w", F.lit(None).cast("int"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for row in batch.itertuples(index=False):
                try:
                    values, h, w = _decode(fmt, bytes(row.content), row.h, row.w)
                    if h <= 0 or w <= 0 or values.size != h * w:
                        raise ValueError(f"{values.size} values for {h} x {w}")
                    rows.append((row.path, h, w, values, None))
                except Exception as error:  # noqa: BLE001 - a bad file becomes a row, not a failed job
                    rows.append((row.path, None, None, None, str(error)))
            yield pd.DataFrame(rows, columns=[f.name for f in RASTER_SCHEMA])

    return files.mapInPandas(run, RASTER_SCHEMA)


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """(path, line_no, line) of small text files; the order of lines is kept per file."""
    with listing(spark):
        whole = few_tasks(spark.read.option("recursiveFileLookup", "true").text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), "value"))
    spread = whole.select("path", F.posexplode(F.split("value", "\r?\n")).alias("line_no", "line"))
    return spread.where(F.length(F.trim("line")) > 0)


def _numbers(line: Column) -> Column:
    return F.transform(F.split(F.trim(line), r"[\s,]+"), lambda x: x.cast("double"))


def scan_trajectories(spark: SparkSession, path: str, fmt: str = "tum") -> DataFrame:
    """(seq, pos, ts, r, t): camera-to-world poses of trajectory text files.

    ``tum``: ``t x y z qx qy qz qw`` per line; ``scalar_first``: ``t x y z qw qx qy qz``, as
    ``writers.export_scene`` writes it. ``kitti``: 12 numbers per line; ``replica``: 16 per
    line. ``blocks``: 4 x 4 matrices, one row per line. The sequence is the file's directory.
    """
    rows = _lines(spark, path).where(~F.ltrim(F.col("line")).startswith("#")).withColumn("n", _numbers(F.col("line")))
    seq = directory_name("path").alias("seq")
    n = F.col("n")
    if fmt == "blocks":
        placed = ranked(rows.select("path", "line_no", "n"), ["path"], [F.col("line_no")], "_rn")
        block = F.floor((F.col("_rn") - 1) / 4)
        rows4 = placed.groupBy("path", block.alias("pos")).agg(F.array_sort(F.collect_list(F.struct("line_no", "n"))).alias("m"))
        m = F.flatten(F.transform("m", lambda x: x["n"]))
        ready = rows4.select("path", "pos", F.col("pos").cast("double").alias("ts"), m.alias("n"))
        fmt = "replica"
    else:
        placed = ranked(rows.select("path", "line_no", "n"), ["path"], [F.col("line_no")], "_rn")
        ready = placed.select("path", (F.col("_rn") - 1).alias("pos"), (F.col("_rn") - 1).cast("double").alias("ts"), "n")
    if fmt in ("tum", "scalar_first"):
        quaternion = [n[i] for i in ((4, 5, 6, 7) if fmt == "tum" else (5, 6, 7, 4))]
        return ready.select(seq, "pos", n[0].alias("ts"), matrix_from_quat(*quaternion).alias("r"), F.array(n[1], n[2], n[3]).alias("t"))
    if fmt not in ("kitti", "replica"):
        raise ValueError(f"unknown trajectory format {fmt!r}")
    r = F.array(*[n[4 * i + j] for i in range(3) for j in range(3)])
    return ready.select(seq, "pos", "ts", r.alias("r"), F.array(n[3], n[7], n[11]).alias("t"))


def scan_timestamps(spark: SparkSession, path: str) -> DataFrame:
    """(path, ts): first number of every line that is not a comment."""
    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("path"), F.trim("value").alias("line"))
    kept = lines.where((F.length("line") > 0) & ~F.col("line").startswith("#"))
    return kept.select("path", F.split("line", r"\s+")[0].cast("double").alias("ts"))


def scan_annotations(spark: SparkSession, path: str) -> DataFrame:
    """(category, seq, pos, filepath, R, T, focal_length, principal_point) of JSON files, gzip allowed."""
    whole = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), "value")
    kind = T.MapType(T.StringType(), T.ArrayType(ANNOTATION))
    parsed = whole.select("path", F.explode(F.from_json("value", kind)).alias("seq", "frames"))
    category = F.regexp_replace(basename("path"), r"_[^_]*$", "")
    return parsed.select(category.alias("category"), "seq", F.posexplode("frames").alias("pos", "f")).select("category", "seq", "pos", "f.*")


def scan_colmap(spark: SparkSession, cameras_path: str, images_path: str) -> tuple[DataFrame, DataFrame]:
    """(cameras, images) of COLMAP text files.

    Images hold two lines per entry; only the first (pose, camera, name) is kept. Poses are
    world-to-camera. Unsupported camera models are dropped.
    """
    cam_lines = _lines(spark, cameras_path).where(~F.col("line").startswith("#"))
    p = F.split(F.trim("line"), r"\s+")
    params = F.transform(F.slice(p, 5, 100), lambda x: x.cast("double"))
    parts = cam_lines.select(p[0].cast("long").alias("camera_id"), p[1].alias("model"), p[2].cast("int").alias("width"), p[3].cast("int").alias("height"), params.alias("p"))
    simple = F.col("model") == "SIMPLE_PINHOLE"
    known = F.col("model").isin("SIMPLE_PINHOLE", "PINHOLE", "THIN_PRISM_FISHEYE")
    q = F.col("p")
    cameras = parts.where(known).select(
        "camera_id", "model", "width", "height", q[0].alias("fx"), F.when(simple, q[0]).otherwise(q[1]).alias("fy"),
        F.when(simple, q[1]).otherwise(q[2]).alias("cx"), F.when(simple, q[2]).otherwise(F.get("p", F.lit(3))).alias("cy"),
        F.when(F.col("model") == "THIN_PRISM_FISHEYE", F.slice("p", 5, 8)).alias("dist"),
    )
    whole = spark.read.text(images_path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), "value")
    # observation lines may be empty, so entries are told apart by position, not by content
    lines = whole.select("path", F.posexplode(F.filter(F.split("value", "\r?\n"), lambda x: ~x.startswith("#"))).alias("k", "line"))
    w = F.split(F.trim("line"), r"\s+")
    heads = lines.where((F.col("k") % 2 == 0) & (F.length(F.trim("line")) > 0)).select(w.alias("w"))
    v = F.col("w")

    def num(i: int) -> Column:
        return v[i].cast("double")

    images = heads.select(
        v[0].cast("long").alias("image_id"), matrix_from_quat(num(2), num(3), num(4), num(1)).alias("r"), F.array(num(5), num(6), num(7)).alias("t"),
        v[8].cast("long").alias("camera_id"), v[9].alias("name"),
    )
    return cameras, images


def scan_camera_lists(spark: SparkSession, path: str) -> DataFrame:
    """(seq, url, idx, ts, fx, fy, cx, cy, p[12]) of per-video camera lists; line 0 is the URL."""
    whole = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), "value")
    parts = whole.select(F.regexp_replace(basename("path"), r"\.[^.]*$", "").alias("seq"), F.split("value", "\r?\n").alias("lines"))
    rows = parts.select("seq", F.trim(F.col("lines")[0]).alias("url"), F.posexplode(F.slice("lines", 2, 2**31 - 2)).alias("idx", "line"))
    n = _numbers(F.col("line"))
    good = rows.where(F.length(F.trim("line")) > 0).withColumn("n", n)
    return good.select(
        "seq", "url", "idx", F.split(F.trim("line"), r"\s+")[0].cast("long").alias("ts"), *[F.col("n")[i + 1].alias(c) for i, c in enumerate(("fx", "fy", "cx", "cy"))],
        F.slice("n", 8, 12).alias("p"),
    )


def scan_mvs_cameras(spark: SparkSession, path: str, interval_scale: float = 1.0) -> DataFrame:
    """(path, r, t, k, depth_min, depth_interval, depth_num, depth_max) of MVS camera text files.

    The depth line has 2, 3 or 4 numbers; without it the depth range is zero. Poses are w2c.
    """
    whole = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.split(F.regexp_replace("value", r"^\s+|\s+$", ""), r"\s+").alias("w"))
    size = F.size("w")

    def num(i: int) -> Column:
        return F.get("w", F.lit(i)).cast("double")

    known = size.isin(29, 30, 31)
    low = F.when(known, num(27)).otherwise(0.0)
    step = F.when(known, num(28) * interval_scale).otherwise(0.0)
    count = F.when(size == 29, 192.0).when(size.isin(30, 31), num(29)).otherwise(0.0)
    high = F.when(size.isin(29, 30), low + step * count).when(size == 31, num(30)).otherwise(0.0)
    return whole.select(
        "path",
        F.array(*[num(1 + 4 * i + j) for i in range(3) for j in range(3)]).alias("r"),
        F.array(num(4), num(8), num(12)).alias("t"),
        F.array(*[num(18 + k) for k in range(9)]).alias("k"),
        low.alias("depth_min"), step.alias("depth_interval"), count.alias("depth_num"), high.alias("depth_max"),
    )


# Fixed headings of the report sections the metrics are taken from.
REPORT_SECTIONS = {
    "ate": r"APE w\.r\.t\. translation part \(m\)",
    "rpe_trans": r"RPE w\.r\.t\. translation part \(m\)",
    "rpe_rot": r"RPE w\.r\.t\. rotation angle in degrees \(deg\)",
}


def scan_metric_reports(spark: SparkSession, path: str) -> DataFrame:
    """(seq, ate, rpe_trans, rpe_rot) of ``*_metric.txt`` reports; a missing section counts as 0."""
    with listing(spark):
        whole = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "*_metric.txt").text(path, wholetext=True)
    whole = few_tasks(whole.select(F.regexp_replace(basename(F.col("_metadata.file_path")), "_eval_metric.txt$", "").alias("seq"), "value"))
    return parse_metric_reports(whole)


def parse_metric_reports(whole: DataFrame) -> DataFrame:
    """Metrics from report texts (seq, value)."""

    def value(section: str) -> Column:
        found = F.regexp_extract("value", rf"(?s){section}.*?rmse\s+([0-9.]+)", 1)
        return F.coalesce(F.nullif(found, F.lit("")).cast("double"), F.lit(0.0))

    return whole.select("seq", *[value(p).alias(n) for n, p in REPORT_SECTIONS.items()])


def _csv_fields(line: Column) -> Column:
    """Fields of a CSV line; quoted ones may hold commas and doubled quotes."""
    fields = F.regexp_extract_all(F.concat(F.lit(","), line), F.lit(r',(\s*"(?:[^"]|"")*"\s*|[^,]*)'), F.lit(1))

    def plain(field: Column) -> Column:
        field = F.trim(field)
        inner = F.replace(F.substr(field, F.lit(2), F.length(field) - 2), F.lit('""'), F.lit('"'))
        return F.when(field.startswith('"') & (F.length(field) >= 2), inner).otherwise(field)

    return F.transform(fields, plain)


def gather_csv(spark: SparkSession, path: str) -> DataFrame:
    """Last row of every CSV file, columns united by name; ``file`` names the source.

    Each file is one text row, so header and last line stay together whatever the file order. A file
    with a header only has one row whose name and value are NULL.
    """
    whole = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "*.csv").text(path, wholetext=True)
    lines = F.filter(F.split("value", "\r?\n"), lambda x: F.length(F.trim(x)) > 0)
    parts = whole.select(basename(F.col("_metadata.file_path")).alias("file"), lines.alias("lines"))
    names = _csv_fields(F.get("lines", F.lit(0)))
    last = F.when(F.size("lines") >= 2, _csv_fields(F.element_at("lines", -1)))
    pairs = parts.select("file", F.explode_outer(F.when(last.isNotNull(), F.arrays_zip(names.alias("name"), last.alias("value")))).alias("c"))
    return pairs.select("file", F.col("c.name").alias("name"), F.col("c.value").alias("value"))


def gather_csv_table(spark: SparkSession, path: str) -> DataFrame:
    """``gather_csv`` as a table: one row per file, one column for each name that any file has."""
    cells = gather_csv(spark, path)
    names = [r.name for r in cells.where("name IS NOT NULL").select("name").distinct().orderBy("name").collect()]
    return cells.groupBy("file").pivot("name", names).agg(F.first("value")) if names else cells.select("file").distinct()


def world_to_camera(df: DataFrame) -> DataFrame:
    """Swap the direction of the poses of a trajectory table."""
    return df.withColumns(dict(zip(("r", "t"), rigid_inverse("r", "t"))))
