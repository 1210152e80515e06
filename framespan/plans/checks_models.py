"""Queries: user functions on windows, frames, descriptors and registration, with stand-ins for models whose answers SQL knows."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F

from framespan.functions import columns as C
from framespan.operators import assembly as A
from framespan.plans.checks_scenes import COS, window_pixels, window_poses
from framespan.plans.registry import PIXELS_SQL, query, table, window_rows, windows_sql


@query(
    "score_windows",
    f"""WITH {windows_sql()} SELECT scene, window_id, CAST(count(*) AS BIGINT) AS n, max(value) - min(value) AS spread,
max_by(frame_id, struct_pack(v := value, f := -frame_id)) AS peak FROM win GROUP BY scene, window_id""",
)
def score_windows(spark, sf):
    """A model sees one window at a time, whole and in frame order whatever the order of arrival."""

    def model(window: pd.DataFrame) -> pd.DataFrame:
        order = window["pos"].to_numpy().argsort()
        value = window["value"].to_numpy()[order]
        peak = window["frame_id"].to_numpy()[order[value.argmax()]]
        head = {c: window[c].to_numpy()[:1] for c in ("scene", "window_id")}
        return pd.DataFrame(head | {"n": [len(window)], "spread": [value.max() - value.min()], "peak": [peak]})

    # numbered once, and the model is sent only what it reads
    rows = window_rows(spark, sf).select("scene", "window_id", "pos", "frame_id", "value")
    kinds = dict(rows.dtypes)
    schema = f"scene {kinds['scene']}, window_id {kinds['window_id']}, n long, spread double, peak {kinds['frame_id']}"
    return A.score_windows(rows, model, schema)


@query("map_frames", "SELECT event_id, value * 2 + 1 AS score, length(event_type) AS size FROM events")
def map_frames(spark, sf):
    ev = table(spark, sf, "events").select("event_id", "value", "event_type")

    def model(batch: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"event_id": batch["event_id"], "score": batch["value"] * 2 + 1, "size": batch["event_type"].str.len().astype("int64")})

    return A.map_frames(ev, model, f"event_id {dict(ev.dtypes)['event_id']}, score double, size long")


@query(
    "describe_frames",
    """WITH d AS (SELECT user_id AS scene, event_id AS frame_id, event_type = 'error' AS bad, length(event_type) AS a, length(event_type) - length(replace(event_type, 'e', '')) AS b FROM events)
SELECT scene, frame_id, CASE WHEN NOT bad THEN round(a / sqrt(a * a + b * b + 1), 4) END AS e0, CASE WHEN NOT bad THEN round(b / sqrt(a * a + b * b + 1), 4) END AS e1, NOT bad AS valid FROM d""",
)
def describe_frames(spark, sf):
    """Descriptors of unit length in batches of 32; frames the model cannot read are reported, not described."""
    frames = table(spark, sf, "events").select(F.col("user_id").alias("scene"), F.col("event_id").alias("frame_id"), F.col("event_type").alias("content"))

    def model(contents: list) -> list:
        return [None if x == "error" else [float(len(x)), float(x.count("e")), 1.0] for x in contents]

    good, bad = A.describe_frames(frames, model, 3)
    entry = [F.round(F.col("embedding")[i].cast("double"), 4).alias(f"e{i}") for i in range(2)]
    none = F.lit(None).cast("double")
    described = good.select("scene", "frame_id", *entry, F.lit(True).alias("valid"))
    return described.unionByName(bad.select("scene", "frame_id", none.alias("e0"), none.alias("e1"), F.lit(False).alias("valid")))


def _one_frame(pairs, by, scales):
    """A registration of a user's own: the pose of the first shared frame alone tells where the window lies."""
    frame = pairs.groupBy(*by).agg(F.min_by(F.struct("src_r", "src_t", "dst_r", "dst_t"), "frame_id").alias("f")).join(scales.select(*by, "scale"), list(by))
    zero = F.lit(0.0)
    target = C.sim3_compose(C.sim3(F.lit(1.0), "f.dst_r", "f.dst_t"), C.sim3("scale", C.identity_matrix(), C.vec(zero, zero, zero)))
    moved = frame.withColumn("g", C.sim3_compose(target, C.sim3_inverse(C.sim3(F.lit(1.0), "f.src_r", "f.src_t"))))
    return moved.select(*by, "g.s", "g.r", "g.t", F.lit("ok").alias("status"))


@query(
    "register_windows_own",
    f"""WITH {PIXELS_SQL}, f AS (SELECT DISTINCT scene, frame_id - scene * 8 AS fp FROM px), s AS (SELECT scene, max(fp) AS last FROM f GROUP BY 1)
SELECT scene, CAST(0 AS BIGINT) AS window_id, 1.0 AS s, 1.0 AS r0, 0.0 AS t0 FROM s UNION ALL SELECT scene, 1, 1.25, round({COS}, 5), 3.0 FROM s WHERE last >= 4""",
)
def register_windows_own(spark, sf):
    out = A.register_windows(window_pixels(spark, sf), window_poses(spark, sf), 6, 2, 0.5, method=_one_frame)
    g = F.col("sim3")
    return out.select("scene", "window_id", F.round(g["s"], 5).alias("s"), F.round(g["r"][0], 5).alias("r0"), (F.round(g["t"][0], 4) + 0.0).alias("t0"))


@query(
    "assemble_scene_masked",
    f"""WITH {PIXELS_SQL}, m AS (SELECT scene, frame_id, frame_id - scene * 8 AS fp, max(depth) AS m FROM px GROUP BY ALL),
p AS (SELECT px.frame_id, v, u, (1 + u) * (u - 8) * depth / 20 AS x, (1 + u) * (v - 6) * depth / 20 AS y, (1 + u) * depth AS z, m / 100 AS a, fp, m FROM px JOIN m USING (frame_id))
SELECT frame_id, v, u, round(x + fp * 2.0, 4) + 0.0 AS x, round(cos(a) * y - sin(a) * z + m / 10, 4) + 0.0 AS y, round(sin(a) * y + cos(a) * z + fp * fp * 0.5, 4) + 0.0 AS z FROM p""",
)
def assemble_scene_masked(spark, sf):
    """Layer refinement left a factor per pixel, which takes the place of the window's own scale."""
    px, poses = window_pixels(spark, sf), window_poses(spark, sf)
    rel = A.register_windows(px, poses, 6, 2, 0.5)
    own = F.when(F.col("window_id") == 1, F.lit(1.25)).otherwise(F.lit(1.0))
    points, _ = A.assemble(px.withColumn("scale_mask", own * (1 + F.col("u"))), poses, rel, 2)
    return points.select("frame_id", "v", "u", *[(F.round(a, 4) + 0.0).alias(a) for a in ("x", "y", "z")])
