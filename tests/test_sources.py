from __future__ import annotations

import gzip
import json

import numpy as np
from pyspark.sql import functions as F

from framespan.sources import readers, writers


def _write(path, text):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(text)


def test_frame_listing(spark, tmp_path):
    for name in ("frame10.jpg", "Frame2.PNG", "frame1.jpeg", "notes.txt"):
        _write(tmp_path / "s1" / name, "x")
    out = readers.scan_frames(spark, str(tmp_path))
    got = [(r.scene, r.frame_id, r.path.split("/")[-1]) for r in out.orderBy("frame_id").collect()]
    assert got == [("s1", 0, "frame1.jpeg"), ("s1", 1, "Frame2.PNG"), ("s1", 2, "frame10.jpg")]
    images, unreadable = readers.scan_images(spark, str(tmp_path))
    assert images.count() == 0 and unreadable.count() == 3


def test_rasters(spark, tmp_path):
    values = np.arange(6, dtype="<f4")
    (tmp_path / "a.dpt").write_bytes(np.float32(202021.25).tobytes() + np.array([3, 2], "<i4").tobytes() + values.tobytes())
    (tmp_path / "b.dpt").write_bytes(b"12345678")
    rows = {r.path.split("/")[-1]: r for r in readers.scan_rasters(spark, str(tmp_path), "dpt").collect()}
    assert (rows["a.dpt"].h, rows["a.dpt"].w, rows["a.dpt"].depth) == (2, 3, [0.0, 1.0, 2.0, 3.0, 4.0, 5.0])
    assert rows["b.dpt"].problem and rows["b.dpt"].depth is None
    (tmp_path / "raw").mkdir()
    (tmp_path / "raw" / "c.bin").write_bytes(values.tobytes())
    sizes = spark.createDataFrame([("c.bin", 3, 2)], "name string, h int, w int")
    raw = readers.scan_rasters(spark, str(tmp_path / "raw"), "raw", sizes).first()
    assert (raw.h, raw.w, len(raw.depth)) == (3, 2, 6)
    (tmp_path / "npy").mkdir()
    np.save(tmp_path / "npy" / "d.npy", np.ones((4, 5), np.float32))
    npy = readers.scan_rasters(spark, str(tmp_path / "npy"), "npy").first()
    assert (npy.h, npy.w) == (4, 5)


def test_trajectories(spark, tmp_path):
    _write(tmp_path / "tum" / "s" / "groundtruth.txt", "# t x y z q\n1.5 1 2 3 0 0 0 1\n2.5 4 5 6 0 0 0.7071068 0.7071068\n")
    out = readers.scan_trajectories(spark, str(tmp_path / "tum"), "tum").orderBy("pos").collect()
    assert [r.ts for r in out] == [1.5, 2.5] and out[0].t == [1.0, 2.0, 3.0] and out[0].seq == "s"
    assert np.allclose(out[1].r, [0, -1, 0, 1, 0, 0, 0, 0, 1], atol=1e-6)
    _write(tmp_path / "rep" / "s" / "poses.txt", "1 0 0 7 0 1 0 8 0 0 1 9 0 0 0 1\n")
    assert readers.scan_trajectories(spark, str(tmp_path / "rep"), "replica").first().t == [7.0, 8.0, 9.0]
    block = "1 0 0 {0}\n0 1 0 2\n0 0 1 3\n0 0 0 1\n"
    _write(tmp_path / "blk" / "s" / "poses.txt", block.format(5) + block.format(6))
    rows = readers.scan_trajectories(spark, str(tmp_path / "blk"), "blocks").orderBy("pos").collect()
    assert [r.t for r in rows] == [[5.0, 2.0, 3.0], [6.0, 2.0, 3.0]]
    _write(tmp_path / "ts" / "a.txt", "# c\n1.25 rgb/1.png\n2.5 rgb/2.png\n")
    assert sorted(r.ts for r in readers.scan_timestamps(spark, str(tmp_path / "ts")).collect()) == [1.25, 2.5]


def test_annotations_and_reports(spark, tmp_path):
    entry = {"filepath": "a.jpg", "R": [[1, 0, 0], [0, 1, 0], [0, 0, 1]], "T": [1, 2, 3], "focal_length": [2, 2], "principal_point": [0, 0], "bbox": [1]}
    with gzip.open(tmp_path / "apple_test.json.gz", "wt") as f:
        json.dump({"seq1": [entry, entry], "seq2": [entry]}, f)
    out = readers.scan_annotations(spark, str(tmp_path)).orderBy("seq", "pos").collect()
    assert [(r.category, r.seq, r.pos) for r in out] == [("apple", "seq1", 0), ("apple", "seq1", 1), ("apple", "seq2", 0)]
    assert out[0].T == [1.0, 2.0, 3.0]
    text = "APE w.r.t. translation part (m)\n(with Sim(3))\n  max 1\n  rmse\t0.125\nRPE w.r.t. rotation angle in degrees (deg)\n rmse 2.5\n"
    _write(tmp_path / "r" / "s1_eval_metric.txt", text)
    row = readers.scan_metric_reports(spark, str(tmp_path / "r")).first()
    assert (row.seq, row.ate, row.rpe_trans, row.rpe_rot) == ("s1", 0.125, 0.0, 2.5)
    _write(tmp_path / "c" / "x.csv", "seq,acc\na,1\nb,2\n")
    _write(tmp_path / "c" / "y.csv", "seq,comp\nc,3\n")
    got = {(r.file, r.name): r.value for r in readers.gather_csv(spark, str(tmp_path / "c")).collect()}
    assert got == {("x.csv", "seq"): "b", ("x.csv", "acc"): "2", ("y.csv", "seq"): "c", ("y.csv", "comp"): "3"}


def test_camera_files(spark, tmp_path):
    _write(tmp_path / "cameras.txt", "# c\n1 PINHOLE 640 480 500 510 320 240\n2 SIMPLE_PINHOLE 10 20 7 5 10\n3 OTHER 1 1 1\n4 THIN_PRISM_FISHEYE 9 9 1 2 3 4 .1 .2 .3 .4 .5 .6 .7 .8\n")
    _write(tmp_path / "images.txt", "# i\n1 1 0 0 0 1 2 3 1 a.png\n\n2 1 0 0 0 4 5 6 2 b.png\n1 2 3\n")
    cams, images = readers.scan_colmap(spark, str(tmp_path / "cameras.txt"), str(tmp_path / "images.txt"))
    c = {r.camera_id: r for r in cams.collect()}
    assert set(c) == {1, 2, 4} and (c[2].fx, c[2].fy, c[2].cx, c[2].cy) == (7, 7, 5, 10) and len(c[4].dist) == 8
    assert {r.image_id: (r.t, r.name) for r in images.collect()} == {1: ([1, 2, 3], "a.png"), 2: ([4, 5, 6], "b.png")}
    _write(tmp_path / "lists" / "v.txt", "https://video\n1000 .5 .6 .1 .2 0 0 " + " ".join(map(str, range(12))) + "\n")
    row = readers.scan_camera_lists(spark, str(tmp_path / "lists")).first()
    assert (row.seq, row.url, row.ts, row.fx, row.p[11]) == ("v", "https://video", 1000, 0.5, 11.0)
    body = "extrinsic\n" + " ".join(map(str, range(16))) + "\nintrinsic\n" + " ".join(map(str, range(9))) + "\n"
    for k, tail in enumerate(("2 0.5", "2 0.5 10", "2 0.5 10 9")):
        _write(tmp_path / "mvs" / f"{k}.txt", body + tail)
    high = {r.path[-5]: (r.depth_num, r.depth_max, r.t) for r in readers.scan_mvs_cameras(spark, str(tmp_path / "mvs")).collect()}
    assert high == {"0": (192.0, 98.0, [3, 7, 11]), "1": (10.0, 7.0, [3, 7, 11]), "2": (10.0, 9.0, [3, 7, 11])}


def test_sinks(spark, tmp_path):
    base = str(tmp_path)
    rows = spark.range(60).select(F.lit("s").alias("scene"), (F.col("id") / 5).cast("long").alias("window_id"), F.col("id").alias("frame_id"))
    writers.write_windows(rows, base + "/w")
    writers.write_windows(rows.where("window_id = 10").withColumn("frame_id", F.col("frame_id") + 1000), base + "/w")
    back = writers.read_windows(spark, base + "/w", "s", first=9).orderBy("window_id", "frame_id").collect()
    assert [r.window_id for r in back] == [9] * 5 + [10] * 5 + [11] * 5 and back[5].frame_id == 1050
    writers.append_metrics(spark.createDataFrame([("a", 1.0)], "seq string, acc double"), base + "/m")
    writers.append_metrics(spark.createDataFrame([("b", 1.0, 2.0)], "seq string, acc double, comp double"), base + "/m")
    assert {(r.seq, r.comp) for r in writers.read_metrics(spark, base + "/m").collect()} == {("a", None), ("b", 2.0)}
    m = spark.createDataFrame([("d", "a", 0.5), ("d", None, 0.5), (None, None, 0.25)], "dataset string, seq string, abs_rel double")
    writers.export_report(m, ["abs_rel"], base + "/rep")
    lines = [json.loads(r.value) for r in spark.read.text(base + "/rep").collect()]
    assert {x["section"] for x in lines} == {"per_seq_metrics", "avg_metrics"}
    pairs = spark.createDataFrame([(30, 2, 0.8), (50, 4, 0.91234)], "i long, j long, sim double")
    frames = spark.createDataFrame([(0, "a.png")], "frame_id long, path string")
    assert [r.value for r in writers.loop_lines(pairs, frames).collect()] == ["50, 4, 0.9123", "30, 2, 0.8000", "# 0: a.png"]
    poses = spark.createDataFrame([("s", 0, [1.0, 0.0, 0.0, 0.0, 1.0, 0.0, 0.0, 0.0, 1.0], [1.0, 2.0, 3.0])], "scene string, frame_id long, r array<double>, t array<double>")
    writers.export_scene({"poses": poses}, base + "/out")
    text = spark.read.text(base + "/out/trajectory").first().value
    assert text.startswith("0.0 1.00000000 2.00000000 3.00000000 1.00000000")
