"""Queries: sampling, windows, masks and filters."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framespan.functions.columns import natural_key
from framespan.operators import filters as FL
from framespan.operators import ranking as R
from framespan.operators import sampling as S
from framespan.operators import windows as W
from framespan.plans.registry import (
    FRAMES_SQL,
    PIXELS_SQL,
    frames,
    pixels,
    query,
    table,
    window_rows,
    windows_sql,
)


def rounded(df: DataFrame, *names: str, digits: int = 6) -> DataFrame:
    return df.withColumns({n: F.round(F.col(n), digits) for n in names})


NEAREST_MASK_SQL = """ranked AS (
  SELECT *, row_number() OVER (PARTITION BY {by} ORDER BY {conf}) AS rn, count(*) OVER (PARTITION BY {by}) AS n FROM {src}),
cut AS (SELECT {by}, {conf} AS cut FROM ranked WHERE rn = CAST(round_even((n - 1) * {q}, 0) AS BIGINT) + 1)"""


@query(
    "scene_window_summary",
    f"""WITH {windows_sql()},
{NEAREST_MASK_SQL.format(by='scene, window_id', conf='value', src='win', q=0.5)},
kept AS (SELECT w.* FROM win w JOIN cut USING (scene, window_id) WHERE w.value >= cut.cut AND (window_id = 0 OR pos >= 5))
SELECT scene, count(*) AS n_kept, round(sum(value), 4) AS sum_value, max(window_id) AS last_window FROM kept GROUP BY scene""",
)
def scene_window_summary(spark, sf):
    """Windows, per-window confidence mask, overlap removal and a roll-up per scene."""
    masked = FL.conf_mask(window_rows(spark, sf), 0.5, ["scene", "window_id"], "value")
    merged = W.merge_windows(masked.where("mask"), 5)
    out = merged.groupBy("scene").agg(
        F.count(F.lit(1)).alias("n_kept"), F.sum("value").alias("sum_value"), F.max("window_id").alias("last_window")
    )
    return rounded(out, "sum_value", digits=4)


@query(
    "natural_sort",
    """SELECT c_custkey, c_name, row_number() OVER (
  ORDER BY regexp_extract(lower(c_name), '^(\\D*)', 1), CAST(regexp_extract(c_name, '(\\d+)$', 1) AS BIGINT), c_custkey) AS place
FROM (SELECT c_custkey, 'im' || c_custkey AS c_name FROM customer)""",
)
def natural_sort(spark, sf):
    names = table(spark, sf, "customer").select("c_custkey", F.concat(F.lit("im"), F.col("c_custkey").cast("string")).alias("c_name"))
    return R.ranked(names, [], [natural_key("c_name"), F.col("c_custkey")], "place")


@query(
    "sample_every",
    f"WITH {FRAMES_SQL} SELECT scene, frame_id, event_id FROM frames WHERE frame_id >= 2 AND (frame_id - 2) % 7 = 0",
)
def sample_every(spark, sf):
    ev = table(spark, sf, "events").select(F.col("user_id").alias("scene"), "ts", "event_id")
    picked = S.sample_every(ev, 7, ["scene"], [F.col("ts"), F.col("event_id")], skip=2)
    return W.number_frames(ev, ["scene"], [F.col("ts"), F.col("event_id")]).join(picked.select("event_id"), "event_id", "left_semi").select(
        "scene", "frame_id", "event_id"
    )


@query(
    "slice_rows",
    f"WITH {FRAMES_SQL} SELECT scene, event_id FROM frames WHERE frame_id >= 3 AND (frame_id - 3) % 4 = 0 AND (frame_id - 3) // 4 < 6",
)
def slice_rows(spark, sf):
    ev = table(spark, sf, "events").select(F.col("user_id").alias("scene"), "ts", "event_id")
    return S.slice_rows(ev, ["scene"], [F.col("ts"), F.col("event_id")], 3, 4, 6).select("scene", "event_id")


def _seq_frames(spark, sf):
    return frames(spark, sf).select(F.col("scene").alias("seq"), "frame_id")


@query(
    "sampling_map_stride_half",
    f"""WITH {FRAMES_SQL}, s AS (SELECT scene, count(*) AS n FROM frames GROUP BY scene)
SELECT f.scene AS seq, frame_id, frame_id // 5 AS pos FROM frames f JOIN s USING (scene) WHERE frame_id < n // 2 AND frame_id % 5 = 0""",
)
def sampling_map_stride_half(spark, sf):
    return S.sampling_map(_seq_frames(spark, sf), "stride-half", kf_every=5)


@query(
    "query_first",
    f"""WITH {FRAMES_SQL}, n AS (SELECT scene, scene % 40 AS i, max(frame_id) AS last FROM frames GROUP BY scene)
SELECT scene AS seq, frame_id, CASE WHEN scene % 3 = 0 OR i > last THEN frame_id WHEN frame_id = i THEN 0 WHEN frame_id = 0 THEN i ELSE frame_id END AS pos FROM frames JOIN n USING (scene)""",
)
def query_first(spark, sf):
    """All frames, with a query frame first in two of three sequences."""
    chosen = S.sampling_map(_seq_frames(spark, sf), "all")
    index = chosen.select("seq").distinct().where("seq % 3 > 0").withColumn("index", (F.col("seq") % 40).cast("long"))
    return S.query_first(chosen, index)


@query(
    "sampling_map_random",
    f"""WITH {FRAMES_SQL}, h AS (
  SELECT scene, frame_id, count(*) OVER (PARTITION BY scene) AS n,
         row_number() OVER (PARTITION BY scene ORDER BY substr(md5('7|' || scene || '|' || frame_id), 1, 13), frame_id) AS rn FROM frames)
SELECT scene AS seq, frame_id, rn - 1 AS pos FROM h WHERE n >= 60 AND rn <= 60""",
)
def sampling_map_random(spark, sf):
    return S.sampling_map(_seq_frames(spark, sf), "random_order", num_frames=60, seed=7)


@query(
    "select_frames",
    f"WITH {FRAMES_SQL} SELECT scene AS seq, frame_id, event_id FROM frames WHERE frame_id % 9 = 0",
)
def select_frames(spark, sf):
    numbered = frames(spark, sf).select(F.col("scene").alias("seq"), "frame_id", "event_id")
    chosen = S.as_map(S.sampling_map(numbered.select("seq", "frame_id"), "stride", kf_every=9))
    return S.select_frames(numbered, chosen)


@query(
    "nearby_ids",
    f"""WITH {FRAMES_SQL}, a AS (
  SELECT scene AS seq, frame_id AS anchor, count(*) OVER (PARTITION BY scene) AS num_frames FROM frames QUALIFY frame_id % 11 = 0),
p AS (SELECT *, unnest(generate_series(0, 4)) AS pos FROM a),
b AS (SELECT *, greatest(0, anchor - 10) AS lo, least(num_frames, anchor + 10) AS hi FROM p)
SELECT seq, anchor, pos, CASE WHEN pos = 0 THEN anchor ELSE
  lo + CAST('0x' || substr(md5('3|' || seq || '|' || anchor || '|' || pos), 1, 13) AS BIGINT) % (hi - lo) END AS frame_id FROM b""",
)
def nearby_ids(spark, sf):
    numbered = frames(spark, sf)
    sizes = numbered.groupBy("scene").agg(F.count(F.lit(1)).alias("num_frames"))
    anchors = numbered.where("frame_id % 11 = 0").join(sizes, "scene").select(F.col("scene").alias("seq"), F.col("frame_id").alias("anchor"), "num_frames")
    return S.nearby_ids(anchors, 5, expand_ratio=2.0, seed=3)


@query(
    "sample_n",
    """SELECT l_suppkey, l_orderkey, l_linenumber FROM (
  SELECT DISTINCT l_suppkey, l_orderkey, l_linenumber FROM lineitem)
QUALIFY row_number() OVER (PARTITION BY l_suppkey ORDER BY substr(md5('5|' || l_suppkey || '|' || l_orderkey || '|' || l_linenumber), 1, 13), l_orderkey, l_linenumber) <= 20""",
)
def sample_n(spark, sf):
    rows = table(spark, sf, "lineitem").select("l_suppkey", "l_orderkey", "l_linenumber").distinct()
    return S.sample_n(rows, 20, ["l_suppkey"], ["l_orderkey", "l_linenumber"], seed=5)


@query(
    "sample_fraction_exact",
    """SELECT user_id, event_id FROM events
QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY substr(md5('9|' || user_id || '|' || event_id), 1, 13), event_id)
  <= floor(count(*) OVER (PARTITION BY user_id) * 0.3)""",
)
def sample_fraction_exact(spark, sf):
    return S.sample_fraction_exact(table(spark, sf, "events").select("user_id", "event_id"), 0.3, ["user_id"], ["event_id"], seed=9)


@query(
    "cap_mask",
    """WITH e AS (SELECT event_type, event_id, value > 20 AS mask FROM events), r AS (
  SELECT event_type, event_id, row_number() OVER (PARTITION BY event_type ORDER BY substr(md5('2|' || event_type || '|' || event_id), 1, 13), event_id) AS rn
  FROM e WHERE mask)
SELECT e.event_type, e.event_id, coalesce(rn <= 100, false) AS mask FROM e LEFT JOIN r USING (event_type, event_id)""",
)
def cap_mask(spark, sf):
    ev = table(spark, sf, "events").select("event_type", "event_id", (F.col("value") > 20).alias("mask"))
    return S.cap_mask(ev, "mask", 100, ["event_type"], ["event_id"], seed=2)


@query("assign_windows", f"WITH {windows_sql()} SELECT scene, window_id, pos, frame_id, event_id FROM win")
def assign_windows(spark, sf):
    return window_rows(spark, sf).select("scene", "window_id", "pos", "frame_id", "event_id")


@query(
    "window_bounds",
    f"""WITH {FRAMES_SQL}, s AS (SELECT scene, count(*) AS n FROM frames GROUP BY scene),
c AS (SELECT scene, n, unnest(generate_series(0, CAST(ceil((n - 5) / 15.0) AS BIGINT) - 1)) AS chunk FROM s)
SELECT scene, chunk, chunk * 15 AS start, least(chunk * 15 + 20, n) AS "end" FROM c""",
)
def window_bounds(spark, sf):
    return W.window_bounds(frames(spark, sf), 20, 5)


@query("merge_windows", f"WITH {FRAMES_SQL} SELECT scene, frame_id, event_id FROM frames")
def merge_windows(spark, sf):
    """Assigning windows and removing the overlap gives back every frame once."""
    return W.merge_windows(window_rows(spark, sf), 5).select("scene", "frame_id", "event_id")


@query(
    "adjacent_overlap",
    f"""WITH {windows_sql()}
SELECT b.scene, b.window_id, b.frame_id, b.pos, a.value AS prev_value, b.value AS cur_value
FROM win a JOIN win b ON a.scene = b.scene AND b.window_id = a.window_id + 1 AND a.frame_id = b.frame_id
WHERE a.pos >= 15 AND b.pos < 5""",
)
def adjacent_overlap(spark, sf):
    return W.adjacent_overlap(window_rows(spark, sf), 20, 5, ["value"])


@query(
    "smoothed_series",
    """SELECT user_id, event_id,
  round(avg(value) OVER w, 6) AS avg, max(value) OVER w AS max, value AS last,
  round(list_sort(list(value) OVER w)[CAST(ceil(count(*) OVER w / 2.0) AS BIGINT)], 6) AS median,
  round(avg(value) OVER (PARTITION BY user_id ORDER BY ts, event_id) + 1e-9, 6) AS global_avg
FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)""",
)
def smoothed_series(spark, sf):
    ev = table(spark, sf, "events").select("user_id", "ts", "event_id", "value")
    out = W.smoothed(ev, "value", ["user_id"], [F.col("ts"), F.col("event_id")])
    # the tiny shift keeps exact decimal ties (averages over powers of two) from rounding apart
    out = out.withColumn("global_avg", F.col("global_avg") + 1e-9)
    return rounded(out, "avg", "median", "global_avg").select("user_id", "event_id", "avg", "max", "last", "median", "global_avg")


@query(
    "steady_latency",
    """WITH r AS (SELECT user_id, value, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn,
  count(*) OVER (PARTITION BY user_id) AS n FROM events)
SELECT user_id, round(coalesce(avg(value) FILTER (WHERE rn > 2 AND rn < n), avg(value)), 6) AS mean_latency,
  count(*) FILTER (WHERE rn > 2 AND rn < n) AS n_steady FROM r GROUP BY user_id""",
)
def steady_latency(spark, sf):
    ev = table(spark, sf, "events").select("user_id", "ts", "event_id", "value")
    return rounded(W.steady_latency(ev, "value", ["user_id"], [F.col("ts"), F.col("event_id")]), "mean_latency")


@query(
    "path_length",
    """WITH t AS (SELECT user_id AS seq, ts, event_id, value AS x, value * 0.5 + event_id % 7 AS y, CAST(event_id % 11 AS DOUBLE) AS z FROM events),
d AS (SELECT seq, sqrt(pow(x - lag(x) OVER w, 2) + pow(y - lag(y) OVER w, 2) + pow(z - lag(z) OVER w, 2)) AS step
  FROM t WINDOW w AS (PARTITION BY seq ORDER BY ts, event_id))
SELECT seq, round(coalesce(sum(step), 0), 5) AS path_length, round(avg(step), 5) AS mean_step, count(step) AS n_steps FROM d GROUP BY seq""",
)
def path_length(spark, sf):
    ev = table(spark, sf, "events").select(
        F.col("user_id").alias("seq"), "ts", "event_id", F.col("value").alias("x"),
        (F.col("value") * 0.5 + F.col("event_id") % 7).alias("y"), (F.col("event_id") % 11).cast("double").alias("z"),
    )
    return rounded(W.path_length(ev, ["seq"], [F.col("ts"), F.col("event_id")]), "path_length", "mean_step", digits=5)


# --- masks and filters ------------------------------------------------------------------------------


@query(
    "conf_mask",
    f"""WITH {PIXELS_SQL}, {NEAREST_MASK_SQL.format(by='frame_id', conf='conf', src='px', q=0.7)}
SELECT p.frame_id, p.v, p.u, p.conf >= cut.cut AS mask FROM px p JOIN (SELECT DISTINCT frame_id, cut FROM cut) cut USING (frame_id)""",
)
def conf_mask(spark, sf):
    return FL.conf_mask(pixels(spark, sf), 0.7, ["frame_id"]).select("frame_id", "v", "u", "mask")


@query(
    "mutual_mask",
    f"""WITH {PIXELS_SQL}, a AS (SELECT * FROM px),
b AS (SELECT scene, frame_id - 1 AS frame_id, v, u, depth, conf FROM px),
{NEAREST_MASK_SQL.format(by='frame_id', conf='conf', src='a', q=0.5).replace('ranked', 'ra').replace('cut AS (', 'ca AS (')},
{NEAREST_MASK_SQL.format(by='frame_id', conf='conf', src='b', q=0.5).replace('ranked', 'rb').replace('cut AS (', 'cb AS (')}
SELECT a.frame_id, a.v, a.u, a.depth FROM a JOIN (SELECT DISTINCT frame_id, cut FROM ca) ca ON a.frame_id = ca.frame_id AND a.conf >= ca.cut
JOIN b ON a.frame_id = b.frame_id AND a.v = b.v AND a.u = b.u JOIN (SELECT DISTINCT frame_id, cut FROM cb) cb ON b.frame_id = cb.frame_id AND b.conf >= cb.cut""",
)
def mutual_mask(spark, sf):
    px = pixels(spark, sf)
    a = FL.conf_mask(px, 0.5, ["frame_id"])
    b = FL.conf_mask(px.withColumn("frame_id", F.col("frame_id") - 1), 0.5, ["frame_id"])
    return FL.mutual_mask(a, b, ["frame_id", "v", "u"]).select("frame_id", "v", "u", "depth")


@query(
    "confident_points",
    """WITH c AS (SELECT event_type, quantile_cont(value, 0.65) AS cut FROM events GROUP BY 1)
SELECT event_type, event_id, value FROM events JOIN c USING (event_type) WHERE value > 1e-5 AND value >= cut""",
)
def confident_points(spark, sf):
    ev = table(spark, sf, "events").select("event_type", "event_id", "value")
    return FL.confident_points(ev, 65, ["event_type"], "value")


@query(
    "filter_background",
    """WITH p AS (SELECT l_orderkey, l_linenumber, CAST(l_quantity AS INT) * 5 AS r, (l_linenumber - 1) * 42 AS g,
  CASE WHEN l_linenumber > 1 THEN 240 ELSE 0 END + CAST(round(l_discount * 100) AS INT) AS b FROM lineitem)
SELECT * FROM p WHERE r + g + b >= 16 AND NOT (r > 240 AND g > 240 AND b > 240)""",
)
def filter_background(spark, sf):
    """First lines are dark, last lines of large orders bright: both rules drop rows."""
    blue = F.when(F.col("l_linenumber") > 1, 240).otherwise(0) + F.round(F.col("l_discount") * 100).cast("int")
    li = table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", (F.col("l_quantity").cast("int") * 5).alias("r"), ((F.col("l_linenumber") - 1) * 42).alias("g"), blue.alias("b")
    )
    return FL.filter_background(li, black=True, white=True)


@query(
    "apply_mask",
    """SELECT e.event_id, CASE WHEN coalesce(m.mask > 0.1, false) THEN e.value ELSE 0.0 END AS conf
FROM events e LEFT JOIN (SELECT event_id + 5 AS event_id, (event_id % 13) / 20.0 AS mask FROM events) m USING (event_id)""",
)
def apply_mask(spark, sf):
    ev = table(spark, sf, "events")
    masks = ev.select((F.col("event_id") + 5).alias("event_id"), ((F.col("event_id") % 13) / 20.0).alias("mask"))
    return FL.apply_mask(ev.select("event_id", F.col("value").alias("conf")), masks, ["event_id"])


@query(
    "threshold_depth",
    f"""WITH {PIXELS_SQL}, a AS (SELECT frame_id, v, u, CASE WHEN depth > 150 THEN 0.0 ELSE depth END AS d FROM px),
q AS (SELECT frame_id, quantile_cont(d, 0.98) AS hi, quantile_cont(d, 0.05) AS lo FROM a GROUP BY 1)
SELECT frame_id, v, u, CASE WHEN lo > 0 AND (CASE WHEN hi > 0 AND d > hi THEN 0.0 ELSE d END) < lo THEN 0.0
  WHEN hi > 0 AND d > hi THEN 0.0 ELSE d END AS depth FROM a JOIN q USING (frame_id)""",
)
def threshold_depth(spark, sf):
    return FL.threshold_depth(pixels(spark, sf), ["frame_id"], 5, 98, 150.0).select("frame_id", "v", "u", "depth")


@query(
    "center_crop",
    f"WITH {PIXELS_SQL} SELECT frame_id, v, u, depth FROM px WHERE v BETWEEN 2 AND 9 AND u BETWEEN 4 AND 11",
)
def center_crop(spark, sf):
    px = pixels(spark, sf).withColumn("h", F.lit(12)).withColumn("w", F.lit(16))
    return FL.center_crop(px, 8).select("frame_id", "v", "u", "depth")


@query(
    "filter_sequences",
    """WITH a AS (SELECT o_custkey AS seq, o_orderkey, o_orderpriority AS category, o_totalprice AS tx, o_totalprice * 0.1 AS ty, 0.0 AS tz FROM orders),
c AS (SELECT * FROM a WHERE category <> '5-LOW'),
u AS (SELECT seq FROM c GROUP BY seq HAVING count(*) >= 5 AND NOT bool_or(tx + ty + tz > 400000.0))
SELECT seq, o_orderkey, category FROM c WHERE seq IN (SELECT seq FROM u)""",
)
def filter_sequences(spark, sf):
    o = table(spark, sf, "orders").select(
        F.col("o_custkey").alias("seq"), "o_orderkey", F.col("o_orderpriority").alias("category"),
        F.col("o_totalprice").alias("tx"), (F.col("o_totalprice") * 0.1).alias("ty"), F.lit(0.0).alias("tz"),
    )
    kinds = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED"]
    return FL.filter_sequences(o, 5, kinds, limit=400000.0).select("seq", "o_orderkey", "category")


@query(
    "clean_depth",
    """WITH s AS (SELECT event_id, CASE event_id % 4 WHEN 0 THEN 'sevenscenes' WHEN 1 THEN 'kitti' WHEN 2 THEN 'bonn' ELSE 'eth3d' END AS profile,
  CASE WHEN event_id % 17 = 0 THEN 65535.0 WHEN event_id % 19 = 0 THEN 0.0 ELSE value * 100 END AS raw FROM events)
SELECT event_id, profile, CASE profile
  WHEN 'sevenscenes' THEN CASE WHEN raw = 65535.0 OR raw / 1000.0 < 1e-3 OR raw / 1000.0 > 10 THEN NULL ELSE raw / 1000.0 END
  WHEN 'kitti' THEN CASE WHEN raw = 0 THEN NULL ELSE raw / 256.0 END
  WHEN 'bonn' THEN CASE WHEN raw = 0 THEN NULL ELSE raw / 5000.0 END ELSE raw END AS depth FROM s""",
)
def clean_depth(spark, sf):
    kind = F.col("event_id") % 4
    ev = table(spark, sf, "events").select(
        "event_id",
        F.when(kind == 0, "sevenscenes").when(kind == 1, "kitti").when(kind == 2, "bonn").otherwise("eth3d").alias("profile"),
        F.when(F.col("event_id") % 17 == 0, 65535.0).when(F.col("event_id") % 19 == 0, 0.0).otherwise(F.col("value") * 100).alias("raw"),
    )
    return FL.clean_depth(ev).select("event_id", "profile", "depth")


@query(
    "scale_to_byte",
    f"""WITH {PIXELS_SQL}, f AS (SELECT frame_id, v, u, CASE WHEN frame_id % 7 = 3 THEN 1.5 ELSE depth END AS depth FROM px),
m AS (SELECT frame_id, min(depth) AS lo, max(depth) AS hi FROM f GROUP BY 1)
SELECT frame_id, v, u, CASE WHEN hi > lo THEN CAST(trunc((depth - lo) / (hi - lo) * 255.0) AS INT) ELSE 0 END AS scaled FROM f JOIN m USING (frame_id)""",
)
def scale_to_byte(spark, sf):
    """Every seventh frame is flat."""
    depth = F.when(F.col("frame_id") % 7 == 3, 1.5).otherwise(F.col("depth"))
    cell = F.struct((F.col("v") * 16 + F.col("u")).alias("i"), depth.alias("depth"))
    rasters = pixels(spark, sf).groupBy("frame_id").agg(F.array_sort(F.collect_list(cell)).alias("cells"))
    rasters = rasters.select("frame_id", F.transform("cells", lambda c: c["i"]).alias("at"), F.transform("cells", lambda c: c["depth"]).alias("depth"))
    out = FL.scale_to_byte(rasters)
    flat = out.select("frame_id", F.explode(F.arrays_zip("at", "scaled")).alias("p"))
    return flat.select("frame_id", F.floor(F.col("p.at") / 16).alias("v"), (F.col("p.at") % 16).alias("u"), F.col("p.scaled").alias("scaled"))
