"""Queries over rows with NaN, NULL and NULL group keys planted by row number."""

from __future__ import annotations

from pyspark.sql import functions as F

from framespan.operators import cameras as CM
from framespan.operators import filters as FL
from framespan.operators import metrics as M
from framespan.operators import ranking as RK
from framespan.plans.registry import query, table

NAN = float("nan")
#: Every 13th value is NaN, every 11th NULL; every tenth group has no value at all and every ninth no key.
PLANTED_SQL = """e AS (SELECT event_id, CASE WHEN event_id // 100 % 9 <> 4 THEN event_id // 100 END AS g,
  CASE WHEN event_id // 100 % 10 = 3 OR event_id % 11 = 0 THEN NULL WHEN event_id % 13 = 0 THEN 'nan'::DOUBLE ELSE value END AS x FROM events),
n AS (SELECT *, CASE WHEN NOT isnan(x) THEN x END AS y FROM e)"""


def planted(spark, sf):
    key = F.floor(F.col("event_id") / 100)
    x = F.when((key % 10 == 3) | (F.col("event_id") % 11 == 0), None).when(F.col("event_id") % 13 == 0, NAN).otherwise(F.col("value"))
    return table(spark, sf, "events").select("event_id", F.when(key % 9 != 4, key).alias("g"), x.alias("x"))


@query(
    "conf_mask_missing",
    f"""WITH {PLANTED_SQL}, r AS (SELECT g, y, row_number() OVER (PARTITION BY g ORDER BY y) - 1 AS k, count(*) OVER (PARTITION BY g) AS n FROM n WHERE y IS NOT NULL),
c AS (SELECT g, max(y) AS cut FROM r WHERE k = CAST(round_even((n - 1) * 0.7, 0) AS BIGINT) GROUP BY g)
SELECT event_id, coalesce(y >= cut, false) AS mask FROM n LEFT JOIN c ON n.g IS NOT DISTINCT FROM c.g""",
)
def conf_mask_missing(spark, sf):
    return FL.conf_mask(planted(spark, sf), 0.7, ["g"], "x").select("event_id", "mask")


@query(
    "confident_points_missing",
    f"""WITH {PLANTED_SQL}, c AS (SELECT g, quantile_cont(y, 0.65) AS cut FROM n WHERE y > 1e-5 GROUP BY g)
SELECT event_id, y AS x FROM n JOIN c ON n.g IS NOT DISTINCT FROM c.g WHERE y > 1e-5 AND y >= cut""",
)
def confident_points_missing(spark, sf):
    return FL.confident_points(planted(spark, sf), 65, ["g"], "x").select("event_id", "x")


@query(
    "threshold_depth_missing",
    f"""WITH {PLANTED_SQL}, a AS (SELECT event_id, g, x, CASE WHEN y > 150 THEN 0.0 ELSE y END AS d FROM n),
q AS (SELECT g, quantile_cont(d, 0.98) AS hi, quantile_cont(d, 0.05) AS lo FROM a GROUP BY g),
t AS (SELECT event_id, x, lo, CASE WHEN hi > 0 AND d > hi THEN 0.0 ELSE d END AS d FROM a JOIN q ON a.g IS NOT DISTINCT FROM q.g)
SELECT event_id, CASE WHEN isnan(x) THEN -1 WHEN lo > 0 AND d < lo THEN 0.0 ELSE d END AS depth FROM t""",
)
def threshold_depth_missing(spark, sf):
    out = FL.threshold_depth(planted(spark, sf), ["g"], 5, 98, 150.0, depth="x")
    return out.select("event_id", F.when(F.isnan("x"), -1.0).otherwise(F.col("x")).alias("depth"))


@query(
    "ranked_missing",
    f"""WITH {PLANTED_SQL} SELECT event_id, row_number() OVER (PARTITION BY g ORDER BY y DESC NULLS LAST, event_id) AS rn,
count(*) OVER (PARTITION BY g) AS n FROM n""",
)
def ranked_missing(spark, sf):
    """Descending, with NULL keys and NULL order values, and slices of 500 rows whatever the size."""
    known = planted(spark, sf).select("event_id", "g", F.when(~F.isnan("x"), F.col("x")).alias("y"))
    before = spark.conf.get("spark.framespan.rowsPerSlice", None)
    spark.conf.set("spark.framespan.rowsPerSlice", "500")
    try:
        return RK.ranked(known, ["g"], [F.col("y").desc_nulls_last(), F.col("event_id")], "rn", "n").select("event_id", "rn", "n")
    finally:
        spark.conf.unset("spark.framespan.rowsPerSlice") if before is None else spark.conf.set("spark.framespan.rowsPerSlice", before)


MISSING_PAIRS_SQL = """p AS (SELECT l_suppkey AS seq, l_extendedprice AS pred,
  CASE WHEN l_orderkey % 13 = 0 THEN 'nan'::DOUBLE WHEN l_orderkey % 11 = 0 THEN NULL ELSE l_quantity * 1000 - 2000 END AS gt, l_orderkey, l_linenumber FROM lineitem),
ok AS (SELECT *, gt > 0 AND NOT isnan(gt) AS ok FROM p)"""


def missing_pairs(spark, sf):
    li = table(spark, sf, "lineitem")
    gt = F.when(F.col("l_orderkey") % 13 == 0, NAN).when(F.col("l_orderkey") % 11 == 0, None).otherwise(F.col("l_quantity") * 1000 - 2000)
    return li.select(F.col("l_suppkey").alias("seq"), F.col("l_extendedprice").alias("pred"), gt.alias("gt"), "l_orderkey", "l_linenumber")


def _as_it_is(pairs):
    return pairs.select("seq").distinct().select("seq", F.lit(1.0).alias("scale"), F.lit(0.0).alias("shift"))


@query(
    "depth_metrics_missing",
    f"""WITH {MISSING_PAIRS_SQL} SELECT seq, round(coalesce(avg(abs(pred - gt) / gt) FILTER (WHERE ok), 0), 6) AS abs_rel,
round(coalesce(sqrt(avg((pred - gt) * (pred - gt)) FILTER (WHERE ok)), 0), 3) AS rmse, count(*) FILTER (WHERE ok) AS valid_pixels FROM ok GROUP BY seq""",
)
def depth_metrics_missing(spark, sf):
    pairs = missing_pairs(spark, sf)
    out = M.depth_metrics(pairs, ["seq"], _as_it_is(pairs), max_depth=None)
    return out.select("seq", F.round("abs_rel", 6).alias("abs_rel"), F.round("rmse", 3).alias("rmse"), "valid_pixels")


@query(
    "error_map_missing",
    f"""WITH {MISSING_PAIRS_SQL} SELECT seq, count(*) AS n, round(sum(CASE WHEN ok THEN abs(pred - gt) / gt ELSE 0 END), 4) AS total FROM ok GROUP BY seq""",
)
def error_map_missing(spark, sf):
    pairs = missing_pairs(spark, sf)
    out = M.error_map(pairs, _as_it_is(pairs), ["seq"], max_depth=None)
    return out.groupBy("seq").agg(F.count("*").alias("n"), F.round(F.sum("error"), 4).alias("total"))


@query(
    "unproject_missing",
    f"""WITH {PLANTED_SQL} SELECT event_id, round((event_id % 10 - 4.5) * y / 50, 6) + 0.0 AS x, y AS z FROM n WHERE y > 1e-8 AND g IS NOT NULL""",
)
def unproject_missing(spark, sf):
    px = planted(spark, sf).where("g is not null")
    px = px.select("event_id", F.col("g").alias("frame_id"), F.lit(0).alias("scene"), (F.col("event_id") % 10).alias("u"), F.lit(0).alias("v"), F.col("x").alias("depth"))
    cams = px.select("scene", "frame_id").distinct().select("scene", "frame_id", F.lit(50.0).alias("fx"), F.lit(50.0).alias("fy"), F.lit(4.5).alias("cx"), F.lit(0.0).alias("cy"))
    out = CM.unproject(px, cams, ["scene", "frame_id"])
    return out.select("event_id", (F.round("x", 6) + 0.0).alias("x"), "z")


@query(
    "unknown_sequences",
    """SELECT DISTINCT CASE WHEN user_id % 3 = 0 THEN 'tum' WHEN user_id % 3 = 1 THEN 'nosuchset' ELSE 'bonn' END AS dataset, 's' || user_id AS seq,
CASE WHEN user_id % 3 = 1 THEN 'unknown_dataset' ELSE 'not_in_list' END AS reason FROM events WHERE user_id % 3 > 0""",
)
def unknown_sequences(spark, sf):
    from framespan.operators import datasets as D

    kind = F.when(F.col("user_id") % 3 == 0, "tum").when(F.col("user_id") % 3 == 1, "nosuchset").otherwise("bonn")
    listing = table(spark, sf, "events").select(kind.alias("dataset"), F.concat(F.lit("s"), F.col("user_id").cast("string")).alias("seq"))
    return D.unknown_sequences(D.dataset_registry(spark), listing)
