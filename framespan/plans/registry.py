"""Registry of the queries that exercise each operator on the given tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query and, where SQL can say it, the equivalent SQL text."""

    def add(fn: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"query {name!r} registered twice")
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return add


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


# --- shared inputs: the same derivation in Spark and in SQL --------------------------------------


def frames(spark: SparkSession, sf: str) -> DataFrame:
    """Events as frames: one scene per user, frame number in time order."""
    from framespan.operators.windows import number_frames

    ev = table(spark, sf, "events").select(F.col("user_id").alias("scene"), "ts", "event_id", "value")
    return number_frames(ev, ["scene"], [F.col("ts"), F.col("event_id")])


FRAMES_SQL = """frames AS (
  SELECT user_id AS scene, ts, event_id, value,
         row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS frame_id
  FROM events)"""


def window_rows(spark: SparkSession, sf: str, size: int = 20, overlap: int = 5) -> DataFrame:
    from framespan.operators.windows import assign_windows

    return assign_windows(frames(spark, sf), size, overlap)


def windows_sql(size: int = 20, overlap: int = 5) -> str:
    step = size - overlap
    return f"""{FRAMES_SQL},
sizes AS (SELECT scene, count(*) AS n FROM frames GROUP BY scene),
win AS (
  SELECT f.scene, f.frame_id, f.event_id, f.value, k.k AS window_id, f.frame_id - k.k * {step} AS pos
  FROM frames f JOIN sizes s ON f.scene = s.scene
  JOIN (SELECT unnest(generate_series(0, (SELECT max(n) FROM sizes))) AS k) k
    ON k.k * {step} <= f.frame_id AND f.frame_id < k.k * {step} + {size}
   AND (k.k = 0 OR s.n - k.k * {step} > {overlap}))"""


PX_H, PX_W = 12, 16


def pixels(spark: SparkSession, sf: str) -> DataFrame:
    """Events as pixels: 192 consecutive events are one 12 x 16 frame, 8 frames are one scene."""
    ev = table(spark, sf, "events").select("event_id", "value", "props")
    frame = F.floor(F.col("event_id") / (PX_H * PX_W))
    idx = F.col("event_id") % (PX_H * PX_W)
    return ev.select(
        F.floor(frame / 8).alias("scene"),
        frame.alias("frame_id"),
        F.floor(idx / PX_W).alias("v"),
        (idx % PX_W).alias("u"),
        F.col("value").alias("depth"),
        F.get_json_object("props", "$.k").cast("double").alias("conf"),
    )


PIXELS_SQL = f"""px AS (
  SELECT event_id // {PX_H * PX_W * 8} AS scene, event_id // {PX_H * PX_W} AS frame_id,
         (event_id % {PX_H * PX_W}) // {PX_W} AS v, event_id % {PX_W} AS u,
         value AS depth, CAST(json_extract_string(props, '$.k') AS DOUBLE) AS conf
  FROM events)"""


def depth_pairs(spark: SparkSession, sf: str) -> DataFrame:
    """Line items as depth pairs in millimetres: prediction and ground truth per supplier."""
    li = table(spark, sf, "lineitem").select("l_partkey", "l_suppkey", "l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice")
    part = table(spark, sf, "part").select("p_partkey", "p_retailprice")
    joined = li.join(part, li.l_partkey == part.p_partkey)
    return joined.select(
        (F.col("l_suppkey") % 5).alias("dataset"),
        F.col("l_suppkey").alias("seq"),
        F.col("l_orderkey").alias("frame_id"),
        F.col("l_linenumber").alias("idx"),
        F.col("l_extendedprice").alias("pred"),
        (F.col("p_retailprice") * (F.col("l_quantity") - 2)).alias("gt"),
    )


PAIRS_SQL = """pairs AS (
  SELECT l_suppkey % 5 AS dataset, l_suppkey AS seq, l_orderkey AS frame_id, l_linenumber AS idx,
         l_extendedprice AS pred, p_retailprice * (l_quantity - 2) AS gt
  FROM lineitem JOIN part ON l_partkey = p_partkey)"""


def descriptors(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "embeddings").select(
        F.lit(0).alias("scene"), F.col("vec_id").alias("frame_id"), F.col("embedding")
    )
