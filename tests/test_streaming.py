from __future__ import annotations

import datetime as dt

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from framespan.operators import assembly, windows
from framespan.streaming import windows as ST

T0 = dt.datetime(2024, 1, 1)


def test_streamed_windows_equal_batch_windows(spark, tmp_path):
    rng = np.random.default_rng(1)
    lengths = {"a": 23, "b": 5, "c": 2, "d": 8}
    rows = [(s, k, T0 + dt.timedelta(seconds=k), False) for s, n in lengths.items() for k in range(n)]
    rows.sort(key=lambda r: (r[2], rng.random()))
    rows.insert(9, rows[5])  # a repeated frame
    rows[3], rows[6] = rows[6], rows[3]  # out of order inside the watermark delay
    ends = [(s, None, T0 + dt.timedelta(seconds=40), True) for s in lengths]
    for k in range(0, len(rows), 10):
        spark.createDataFrame(rows[k : k + 10], ST.FRAME_STREAM).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    spark.createDataFrame(ends, ST.FRAME_STREAM).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = ST.drop_repeats(ST.frame_stream(spark, str(tmp_path / "in")), "10 seconds")
    out = ST.assemble_windows(stream, 5, 2)
    ST.run_available(out, str(tmp_path / "cp"), lambda b, i: b.write.mode("append").parquet(str(tmp_path / "out")))
    got = sorted(tuple(r) for r in spark.read.parquet(str(tmp_path / "out")).select("scene", "window_id", "pos", "frame_id").collect())
    frames = spark.createDataFrame([(s, k) for s, n in lengths.items() for k in range(n)], "scene string, frame_id long")
    want = windows.assign_windows(frames, 5, 2).select("scene", "window_id", "pos", "frame_id")
    assert got == sorted(tuple(r) for r in want.collect())


def test_numbers_go_on_after_the_end_and_late_frames_are_kept(spark, tmp_path):
    def at(sec):
        return T0 + dt.timedelta(seconds=sec)

    batches = [
        [("a", k, at(k), False) for k in range(4)] + [("a", None, at(5), True)],
        [("a", 10 + k, at(100 + k), False) for k in range(3)],
        [("a", 13, at(110), False)],
        [("a", 99, at(1), False), ("a", 20, at(200), False), ("a", -1, at(201), True)],
    ]
    for k, rows in enumerate(batches):
        spark.createDataFrame(rows, ST.FRAME_STREAM).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    raw = ST.frame_stream(spark, str(tmp_path / "in"))
    out = ST.assemble_windows(ST.drop_repeats(raw, "10 seconds"), 3, 1)
    ST.run_available(out, str(tmp_path / "cp"), lambda b, i: b.write.mode("append").parquet(str(tmp_path / "out")))
    got = sorted((r.window_id, r.pos, r.frame_id) for r in spark.read.parquet(str(tmp_path / "out")).collect())
    assert got == [(0, 0, 0), (0, 1, 1), (0, 2, 2), (1, 0, 2), (1, 1, 3), (2, 0, 10), (2, 1, 11), (2, 2, 12), (3, 0, 12), (3, 1, 13), (3, 2, 20)]
    sink = ST.late_frames(spark, str(tmp_path / "rejects"), "10 seconds")
    ST.run_available(raw, str(tmp_path / "cp2"), sink)
    late = spark.read.parquet(str(tmp_path / "rejects" / "late")).collect()
    assert [(r.frame_id, r.reason) for r in late] == [(99, "late")]


def test_windows_without_overlap_get_a_status(spark, tmp_path):
    eye = np.eye(3).reshape(-1).tolist()
    nan = float("nan")

    def frame(window, pos, frame_id, conf=(1.0, 2.0)):
        return ("s", window, 2, pos, frame_id, [1.0, 2.0], [0.0, 1.0], [1.0, 1.0], list(conf), eye, [float(frame_id), 0.0, 0.0])

    rows = [frame(0, 0, 0), frame(0, 1, 1), frame(1, 0, 7), frame(1, 1, 8), frame(2, 0, 8, (nan, nan)), frame(2, 1, 9)]
    spark.createDataFrame(rows, ST.SCORED).coalesce(1).write.parquet(str(tmp_path / "in"))
    for overlap, want in ((1, ["ok", "no_overlap", "no_points"]), (0, ["ok", "no_overlap", "no_overlap"])):
        stream = spark.readStream.schema(ST.SCORED).parquet(str(tmp_path / "in"))
        ST.run_available(ST.register_stream(stream, overlap, 0.3), str(tmp_path / f"cp{overlap}"), lambda b, i, o=overlap: b.write.mode("append").parquet(str(tmp_path / f"out{o}")))
        got = sorted((r.window_id, r.status) for r in spark.read.parquet(str(tmp_path / f"out{overlap}")).collect())
        assert [s for _, s in got] == want


def _scene(n=10, size=4, overlap=2, h=3, w=4):
    """Known world, windows with their own similarity: poses, points and the planted relative transforms."""
    rng = np.random.default_rng(8)
    frames, world = [], []
    for k in range(n):
        a = 0.2 * k
        r = np.array([[np.cos(a), -np.sin(a), 0], [np.sin(a), np.cos(a), 0], [0, 0, 1]]) @ np.array([[1, 0, 0], [0, np.cos(0.1 * k), -np.sin(0.1 * k)], [0, np.sin(0.1 * k), np.cos(0.1 * k)]])
        frames.append((r, np.array([0.5 * k, np.sin(k), 0.1 * k])))
        world.append(rng.uniform(0.5, 2, (h * w, 3)))
    steps = [(1.0, np.eye(3), np.zeros(3))]
    starts = [s for s in range(0, n, size - overlap) if s == 0 or n - s > overlap]
    for k in range(1, len(starts)):
        b = 0.3 * k
        steps.append((1.0 + 0.1 * k, np.array([[np.cos(b), 0, np.sin(b)], [0, 1, 0], [-np.sin(b), 0, np.cos(b)]]), np.array([k, -0.5, 0.25])))
    px, poses = [], []
    total = (1.0, np.eye(3), np.zeros(3))
    for k, start in enumerate(starts):
        s, r, t = steps[k]
        total = (total[0] * s, total[1] @ r, total[0] * total[1] @ t + total[2])
        for pos in range(min(size, n - start)):
            f = start + pos
            rc, tc = frames[f]
            # the window sees the world through the inverse of its accumulated transform
            poses.append(("s", k, pos, f, (total[1].T @ rc).reshape(-1).tolist(), (total[1].T @ (tc - total[2]) / total[0]).tolist()))
            for i, p in enumerate(world[f] / total[0]):
                px.append(("s", k, pos, f, i // w, i % w, *map(float, p), float((i * 7 + f) % 11)))
    return frames, world, steps, px, poses


PX = "scene string, window_id long, pos long, frame_id long, v int, u int, x double, y double, z double, conf double"
POSES = "scene string, window_id long, pos long, frame_id long, r array<double>, t array<double>"


def test_registration_recovers_the_planted_chain(spark, tmp_path):
    frames, world, steps, px, poses = _scene()
    dpx, dposes = spark.createDataFrame(px, PX), spark.createDataFrame(poses, POSES)
    rel = assembly.register_windows(dpx, dposes, 4, 2, 0.3).persist()
    got = {r.window_id: r for r in rel.collect()}
    assert all(r.status == "ok" for r in got.values())
    for k, (s, r, t) in enumerate(steps):
        assert np.isclose(got[k].sim3.s, s, atol=1e-6) and np.allclose(got[k].sim3.r, r.reshape(-1), atol=1e-6) and np.allclose(got[k].sim3.t, t, atol=1e-5)
    points, placed = assembly.assemble(dpx, dposes, rel, 2)
    found = {(r.frame_id, r.v, r.u): (r.x, r.y, r.z) for r in points.collect()}
    assert len(found) == 10 * 12
    for f, (rc, tc) in enumerate(frames):
        assert np.allclose(found[f, 1, 2], rc @ world[f][6] + tc, atol=1e-4)
    # streamed registration gives the same transforms
    rows = pd.DataFrame(px, columns=[c.split()[0] for c in PX.split(", ")])
    pose = {(p[1], p[3]): p for p in poses}
    out = []
    for (k, f), g in rows.groupby(["window_id", "frame_id"]):
        p = pose[k, f]
        n = sum(1 for q in poses if q[1] == k)
        out.append(("s", int(k), n, int(p[2]), int(f), g.x.tolist(), g.y.tolist(), g.z.tolist(), g.conf.tolist(), p[4], p[5]))
    for k in range(0, len(out), 3):
        spark.createDataFrame(out[k : k + 3], ST.SCORED).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(ST.SCORED).option("maxFilesPerTrigger", 2).parquet(str(tmp_path / "in"))
    ST.run_available(ST.register_stream(stream, 2, 0.3), str(tmp_path / "cp"), lambda b, i: b.write.mode("append").parquet(str(tmp_path / "out")))
    streamed = {r.window_id: r for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert set(streamed) == set(got)
    for k, r in streamed.items():
        assert np.isclose(r.s, got[k].sim3.s, atol=1e-6) and np.allclose(r.r, got[k].sim3.r, atol=1e-6) and np.allclose(r.t, got[k].sim3.t, atol=1e-5)


def test_exact_chain_agrees_with_parallel_registration(spark):
    frames, world, _, px, poses = _scene(6)
    dpx, dposes = spark.createDataFrame(px, PX), spark.createDataFrame(poses, POSES)
    _, placed = assembly.register_chain(dpx, dposes, 4, 2, 0.3)
    for r in placed.collect():
        assert np.allclose(r.t, frames[r.frame_id][1], atol=1e-4)


def test_loop_constraints_recover_the_transform_between_chunks(spark):
    _, _, steps, px, poses = _scene()
    total = [steps[0]]
    for s, r, t in steps[1:]:
        a = total[-1]
        total.append((a[0] * s, a[1] @ r, a[0] * a[1] @ t + a[2]))
    # the joint prediction is taken in the frame of window 1
    one = total[1]
    chunk = spark.createDataFrame(px, PX), spark.createDataFrame(poses, POSES)
    lp, lpose = [], []
    for side, win, span in (("a", 0, (0, 3)), ("b", 3, (6, 9))):
        g = total[win]
        for p in poses:
            if p[1] == win and span[0] <= p[3] < span[1]:
                r = np.array(p[4]).reshape(3, 3)
                world_r, world_t = g[1] @ r, g[0] * g[1] @ p[5] + g[2]
                lpose.append(("s", 0, side, p[3], (one[1].T @ world_r).reshape(-1).tolist(), (one[1].T @ (world_t - one[2]) / one[0]).tolist()))
        for p in px:
            if p[1] == win and span[0] <= p[3] < span[1]:
                lp.append(("s", 0, side, p[3], p[4], p[5], *[c * g[0] / one[0] for c in p[6:9]], p[9]))
    loop_px = spark.createDataFrame(lp, "scene string, loop_id long, side string, frame_id long, v int, u int, x double, y double, z double, conf double")
    loop_poses = spark.createDataFrame(lpose, "scene string, loop_id long, side string, frame_id long, r array<double>, t array<double>")
    ranges = spark.createDataFrame([("s", 0, 0, 0, 3, 3, 6, 9)], "scene string, loop_id long, chunk_a long, start_a long, end_a long, chunk_b long, start_b long, end_b long")
    row = assembly.loop_constraints(ranges, *chunk, loop_px, loop_poses, 0.3).first()
    assert row.status == "ok" and (row.i, row.j) == (0, 3)
    assert np.isclose(row.sim3.s, total[0][0] / total[3][0], atol=1e-5)


def test_user_models(spark):
    frames = spark.range(10).select(F.lit("s").alias("scene"), F.col("id").alias("frame_id"), F.lit(b"x").alias("content"))
    win = windows.assign_windows(frames, 4, 2)
    out = assembly.score_windows(win, lambda p: p[["scene", "window_id"]].head(1).assign(n=len(p)), "scene string, window_id long, n long")
    assert {r.window_id: r.n for r in out.collect()} == {0: 4, 1: 4, 2: 4, 3: 4}
    assert assembly.map_frames(frames, lambda p: p[["frame_id"]] * 2, "frame_id long").agg(F.sum("frame_id")).first()[0] == 90
    good, bad = assembly.describe_frames(frames, lambda xs: [None if i == 0 else [3.0, 4.0] for i, _ in enumerate(xs)], 2, batch=5)
    assert np.allclose(good.first().embedding, [0.6, 0.8]) and bad.count() >= 1


def test_idempotent_latency_totals(spark, tmp_path):
    rows = spark.createDataFrame([("a", 1.0), ("a", 3.0), ("b", 5.0)], "scene string, ms double")
    sink = ST.latency_totals(spark, str(tmp_path / "lat"))
    sink(rows, 0)
    sink(rows, 0)
    sink(rows.where("scene = 'a'"), 1)
    got = {r.scene: (r.n, r.mean_ms, r.max_ms) for r in ST.latency_summary(spark, str(tmp_path / "lat")).collect()}
    assert got == {"a": (4, 2.0, 3.0), "b": (1, 5.0, 5.0)}
