from __future__ import annotations

from contextlib import contextmanager

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from framespan.operators import grids as GR
from framespan.operators import assembly, loops, registration, similarity
from framespan.operators.joins import attach
from framespan.sources import writers


@contextmanager
def conf(spark, **values):
    names = {k.replace("__", "."): str(v) for k, v in values.items()}
    for name, value in names.items():
        spark.conf.set(name, value)
    try:
        yield
    finally:
        for name in names:
            spark.conf.unset(name)


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_attach_broadcasts_no_copies(spark):
    big = spark.createDataFrame([(1, i) for i in range(40)] + [(2, 0), (None, 1), (3, 5)], "k long, x long")
    small = spark.createDataFrame([(1, "a"), (2, "b"), (None, "n")], "k long, name string")
    want = {how: sorted(map(str, attach(big, small, ["k"], how=how, nulls=True).collect())) for how in ("inner", "left")}
    with conf(spark, spark__framespan__broadcastRows=1):
        # no key is hot: nothing is copied and nothing is broadcast
        for how, rows in want.items():
            plain = attach(big, small, ["k"], how=how, nulls=True)
            assert "Broadcast" not in plan(plain) and "Generate" not in plan(plain)
            assert sorted(map(str, plain.collect())) == rows
        with conf(spark, spark__framespan__hotRows=10):
            for how, rows in want.items():
                dealt = attach(big, small, ["k"], how=how, nulls=True)
                # the short list of hot keys is broadcast, the copies are not
                assert "SortMergeJoin" in plan(dealt) and "Generate" in plan(dealt)
                assert sorted(map(str, dealt.collect())) == rows


def test_resampling_broadcasts_no_targets(spark):
    px = spark.range(12).select(F.lit(0).alias("frame_id"), F.floor(F.col("id") / 4).cast("int").alias("v"), (F.col("id") % 4).cast("int").alias("u"), F.col("id").cast("double").alias("depth"))
    for out in (GR.resample_bilinear(px, ["frame_id"], 5, 6), GR.resample_nearest(px, ["frame_id"], 5, 6, ["depth"])):
        assert "SortMergeJoin" in plan(out) and "Broadcast" not in plan(out)
        assert out.count() == 30


def test_topk_over_tiles_equals_brute_force(spark, monkeypatch):
    rng = np.random.default_rng(3)
    vectors = np.round(rng.normal(size=(90, 3)) * 2) / 2  # many equal similarities
    ids = np.r_[np.arange(88), 5, 5]  # an id that repeats
    rows = [(0, int(i), [float(x) for x in v]) for i, v in zip(ids, vectors)]
    got = {}
    for tile in (7, 2048):
        monkeypatch.setattr(similarity, "TILE_ROWS", tile)
        pdf = pd.DataFrame({"scene": 0, "frame_id": ids, "embedding": list(vectors), "_home": ids % 2, "_a": 0, "_b": 0})
        pdf["_home"] = 0
        got[tile] = similarity._block_topk(4, ["scene"])(pdf)
    want = []
    for n, i in enumerate(ids):
        best = sorted((-float(vectors[n] @ vectors[m]), int(j)) for m, j in enumerate(ids) if j != i)[:4]
        want += [(int(i), j, -s) for s, j in best]
    for out in got.values():
        assert sorted((int(i), int(j), round(s, 9)) for i, j, s in zip(out["i"], out["j"], out["sim"])) == sorted((i, j, round(s, 9)) for i, j, s in want)
    # a tile needs no full sort: the product of two tiles is searched by selection
    desc = spark.createDataFrame(rows, "scene int, frame_id long, embedding array<double>")
    whole, cut_up = (similarity.topk_similar(desc, 4, block=b).select("i", "j", "rank").collect() for b in (None, 20))
    assert sorted(whole) == sorted(cut_up)


def test_loop_searches_read_their_pairs_once(spark):
    seen = spark.sparkContext.accumulator(0)

    def searched(batches):
        for pdf in batches:
            seen.add(len(pdf))
            yield pdf

    plain = spark.createDataFrame([(0, 10 * k, 10 * k + 40, k / 9.0) for k in range(9)], "scene int, i long, j long, sim double")
    pairs = plain.mapInPandas(searched, plain.schema)
    bounds = spark.createDataFrame([(0, k, 20 * k, 20 * k + 30) for k in range(8)], "scene int, chunk long, start long, end long")
    assert loops.loop_ranges(pairs, bounds, 8)[0].count() == 9 and seen.value == 9
    assert loops.nms_pairs(pairs, 8).count() > 0 and seen.value == 18


def test_a_window_is_one_file(spark, tmp_path):
    rows = spark.range(400).repartition(8).select(F.lit("s").alias("scene"), F.floor(F.col("id") / 40).alias("window_id"), F.col("id").alias("frame_id"))
    writers.write_windows(rows, str(tmp_path / "w"))
    assert len(list((tmp_path / "w").glob("*/*/*.parquet"))) == 10
    assert writers.read_windows(spark, str(tmp_path / "w")).count() == 400
    flat = rows.withColumn("scene", F.col("window_id") % 3).drop("window_id")
    writers.export_scene({"frames": flat}, str(tmp_path / "e"))
    assert len(list((tmp_path / "e" / "frames").glob("*/*.parquet"))) == 3


def test_models_run_once_and_in_many_tasks(spark):
    rows = spark.range(40).select(F.lit(0).alias("scene"), F.floor(F.col("id") / 4).alias("window_id"), F.col("id").alias("frame_id"))

    def count(window):
        return window[["scene", "window_id"]].head(1).assign(n=len(window))

    scored = assembly.score_windows(rows, count, "scene int, window_id long, n long")
    assert scored.rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert sorted(r.n for r in scored.collect()) == [4] * 10
    calls = spark.sparkContext.accumulator(0)

    def model(contents):
        calls.add(len(contents))
        return [None if x % 4 == 0 else [float(x), 1.0] for x in contents]

    good, bad = assembly.describe_frames(rows.withColumn("content", F.col("frame_id")), model, 2)
    assert (good.count(), bad.count()) == (30, 10) and calls.value == 40


def test_models_of_a_group_count_as_many_rows(spark, monkeypatch):
    rows = [(s, i, float(i % 5), float(i % 7), float(i % 3 + s)) for s in range(3) for i in range(12)]
    pairs = spark.createDataFrame(rows, "seq long, id long, sx double, sy double, sz double").withColumns({f"d{a}": 2 * F.col(f"s{a}") + 1 for a in "xyz"})
    told = []
    monkeypatch.setattr(registration, "attach", lambda big, small, by, rows=None, **more: told.append(rows) or attach(big, small, by, rows, **more))
    out = registration.ransac_sim3(pairs, ["seq"], ["id"], n=8, src=["sx", "sy", "sz"], dst=["dx", "dy", "dz"])
    assert out.count() == 3 and 3 * 8 in told
