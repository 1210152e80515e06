"""Round trips of text sources: files written from the tables into the shared folder, then scanned."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from framespan.plans.registry import query, table
from framespan.session import ensure_checkpoint_dir
from framespan.sources import readers, writers


def _folder(spark) -> str:
    return f"{ensure_checkpoint_dir(spark)}/text-{uuid.uuid4().hex}"


def _text(*parts):
    return F.concat(*[p.cast("string") if not isinstance(p, str) else F.lit(p) for p in parts])


@query("scan_timestamps", "SELECT round(event_id / 8, 3) AS ts FROM events WHERE event_id % 5 > 0")
def scan_timestamps(spark, sf):
    ev = table(spark, sf, "events").select("event_id", "user_id")
    line = F.when(F.col("event_id") % 5 == 0, _text("# comment ", F.col("event_id"))).otherwise(_text(F.col("event_id") / 8, " rgb/", F.col("user_id"), ".png"))
    path = _folder(spark)
    ev.select(line.alias("value")).write.text(path)
    return readers.scan_timestamps(spark, path).select(F.round("ts", 3).alias("ts"))


@query(
    "gather_csv",
    """WITH l AS (SELECT event_type, max(event_id) AS id, max_by(round(value, 4), event_id) AS v FROM events GROUP BY event_type)
SELECT 'id' AS name, CAST(id AS VARCHAR) AS value FROM l UNION ALL SELECT 'note, quoted', event_type || ', "' || id || '"' FROM l""",
)
def gather_csv(spark, sf):
    """One CSV file per event type, with commas and quotes inside fields; its last row is found again."""
    ev = table(spark, sf, "events").select("event_type", F.col("event_id").alias("id"))
    rows = ev.withColumn("note, quoted", _text(F.col("event_type"), ', "', F.col("id"), '"'))
    path = _folder(spark)
    last = rows.repartition("event_type").sortWithinPartitions("event_type", "id")
    last.write.partitionBy("event_type").option("header", True).option("escape", '"').csv(path)
    return readers.gather_csv(spark, path).select("name", "value")


@query(
    "scan_colmap",
    """SELECT 'camera' AS kind, CAST(p_partkey AS BIGINT) AS id, round(p_retailprice, 2) AS a, CAST(p_size AS DOUBLE) AS b, NULL AS name FROM part
UNION ALL SELECT 'image', CAST(c_custkey AS BIGINT), round(c_acctbal, 2), CAST(c_nationkey AS DOUBLE), c_name FROM customer""",
)
def scan_colmap(spark, sf):
    part, customer = table(spark, sf, "part"), table(spark, sf, "customer")
    cameras, images = _folder(spark), _folder(spark)
    price = F.format_string("%.2f", "p_retailprice")
    part.select(_text(F.col("p_partkey"), " PINHOLE 640 480 ", price, " ", price, " ", F.col("p_size"), " 240").alias("value")).write.text(cameras)
    entry = _text(F.col("c_custkey"), " 1 0 0 0 ", F.format_string("%.2f", "c_acctbal"), " 0 0 ", F.col("c_nationkey"), " ", F.col("c_name"), "\n1.0 2.0 3")
    customer.select(entry.alias("value")).write.text(images)
    cams, imgs = readers.scan_colmap(spark, cameras, images)
    a = cams.select(F.lit("camera").alias("kind"), F.col("camera_id").alias("id"), F.round("fx", 2).alias("a"), F.col("cx").alias("b"), F.lit(None).cast("string").alias("name"))
    b = imgs.select(F.lit("image").alias("kind"), F.col("image_id").alias("id"), F.round(F.col("t")[0], 2).alias("a"), F.col("camera_id").cast("double").alias("b"), "name")
    return a.unionByName(b)


@query(
    "scan_mvs_cameras",
    """SELECT CAST(s_suppkey AS DOUBLE) AS tx, round(s_acctbal, 2) AS fx, 425.0 AS depth_min, 2.5 * 0.5 AS depth_interval,
CASE WHEN s_suppkey % 2 = 0 THEN 192.0 ELSE 64.0 END AS depth_num, 425.0 + 1.25 * CASE WHEN s_suppkey % 2 = 0 THEN 192.0 ELSE 64.0 END AS depth_max FROM supplier""",
)
def scan_mvs_cameras(spark, sf):
    """A camera file per supplier, half of them with a depth count."""
    fx = F.format_string("%.2f", "s_acctbal")
    count = F.when(F.col("s_suppkey") % 2 == 0, "").otherwise(" 64")
    body = _text("extrinsic\n1 0 0 ", F.col("s_suppkey"), "\n0 1 0 2\n0 0 1 3\n0 0 0 1\n\nintrinsic\n", fx, " 0 320\n0 ", fx, " 240\n0 0 1\n\n425.0 2.5", count)
    path = _folder(spark)
    table(spark, sf, "supplier").select(F.col("s_suppkey").alias("k"), body.alias("value")).repartition("k").write.partitionBy("k").text(path)
    out = readers.scan_mvs_cameras(spark, path, 0.5)
    return out.select(F.col("t")[0].alias("tx"), F.round(F.col("k")[0], 2).alias("fx"), "depth_min", "depth_interval", "depth_num", "depth_max")


@query(
    "scan_camera_lists",
    """SELECT 'http://v/' || user_id AS url, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS idx, CAST(event_id AS BIGINT) AS ts,
round(value, 2) AS fx, 0.25 AS cy, CAST(event_id % 9 AS DOUBLE) AS tx FROM events""",
)
def scan_camera_lists(spark, sf):
    """A camera list per user: the address of the video, then a line per frame."""
    ev = table(spark, sf, "events").select("event_id", "user_id", "value")
    line = _text(F.col("event_id"), " ", F.format_string("%.2f", "value"), " 0.5 0.5 0.25 0 0 1 0 0 ", F.col("event_id") % 9, " 0 1 0 0 0 0 1 0")
    heads = ev.select(F.col("user_id").alias("k"), F.lit(-1).cast("long").alias("at")).distinct().withColumn("value", _text("http://v/", F.col("k")))
    rows = ev.select(F.col("user_id").alias("k"), F.col("event_id").cast("long").alias("at"), line.alias("value")).unionByName(heads)
    path = _folder(spark)
    rows.repartition("k").sortWithinPartitions("k", "at").select("k", "value").write.partitionBy("k").text(path)
    out = readers.scan_camera_lists(spark, path)
    return out.select("url", F.col("idx").cast("long").alias("idx"), "ts", F.round("fx", 2).alias("fx"), "cy", F.col("p")[3].alias("tx"))


@query(
    "append_metrics",
    "SELECT s_name AS name, s_acctbal AS score, CASE WHEN s_nationkey % 2 = 1 THEN CAST(s_nationkey AS BIGINT) END AS nation FROM supplier",
)
def append_metrics(spark, sf):
    """Two runs append to one table, the second with a column more."""
    rows = table(spark, sf, "supplier").select(F.col("s_name").alias("name"), F.col("s_acctbal").alias("score"), F.col("s_nationkey").cast("long").alias("nation"))
    path = _folder(spark)
    writers.append_metrics(rows.where("nation % 2 = 0").drop("nation"), path)
    writers.append_metrics(rows.where("nation % 2 = 1"), path)
    return writers.read_metrics(spark, path).select("name", "score", "nation")
