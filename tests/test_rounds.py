"""Loops read what they work on from one written table, and small groups need no slices."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from framespan.functions import columns as C
from framespan.operators import clouds, graph, posegraph, ranking, registration, windows
from tests.test_growth import conf, plan


def test_robust_fits_evaluate_their_pairs_once(spark):
    rng = np.random.default_rng(6)
    x = rng.normal(size=(40, 3))
    y = 1.3 * x + rng.normal(size=(40, 3)) * 0.3
    seen = spark.sparkContext.accumulator(0)

    @F.udf("double")
    def weight(i):
        seen.add(1)
        return 1.0 + i % 3

    rows = [(i % 2, i, *map(float, (*a, *b))) for i, (a, b) in enumerate(zip(x, y))]
    df = spark.createDataFrame(rows, "g long, i long, sx double, sy double, sz double, dx double, dy double, dz double")
    out = registration.robust_sim3(df.withColumn("w", weight("i")), ["g"], "w", max_iters=2).collect()
    assert {r.status for r in out} == {"ok"} and seen.value == 40


def test_small_scenes_take_no_rounds_of_jobs(spark, monkeypatch):
    """Their rounds are done within tasks, and settled scenes leave the batch without touching the others."""
    monkeypatch.setattr(posegraph, "_by_rounds", None)
    turn = C.sim3(F.exp((F.col("node") % 3 - 1) / 50), C.identity_matrix(), C.vec(F.lit(0.0), F.lit(0.0), F.lit(0.0)))
    scenes = spark.range(9).select(F.col("id").alias("scene"), F.explode(F.sequence(F.lit(0), 2 + F.col("id") * 9)).alias("node"))
    ends = scenes.groupBy("scene").agg((F.max("node") + 1).alias("i")).withColumn("j", F.lit(0))
    loops = ends.withColumn("sim3", C.sim3(F.exp(F.col("scene") / 100.0), C.identity_matrix(), C.vec(F.lit(0.0), F.lit(0.0), F.lit(0.0))))
    out = posegraph.optimize_pose_graph(scenes.withColumn("sim3", turn), loops).toPandas()
    assert out.converged.all() and len(out) == scenes.count()
    for scene, rows in out.groupby("scene"):
        n = len(rows)
        steps = np.array([(k % 3 - 1) / 50 for k in sorted(rows.node)])
        gap = steps.sum() - scene / 100  # dealt evenly over all edges
        got = np.log([x["s"] for x in rows.sort_values("node").sim3])
        assert np.allclose(got, steps - gap / (n + 1), atol=1e-6)


def test_groups_that_fit_a_slice_take_the_plain_window(spark):
    rng = np.random.default_rng(2)
    rows = [(int(g), int(i), float(v)) for i, (g, v) in enumerate(zip(rng.integers(0, 40, 300), rng.normal(size=300)))] + [(None, 900, 1.0)]
    df = spark.createDataFrame(rows, "g long, i long, v double")
    whole = {tuple(r) for r in windows.smoothed(df, "v", ["g"], [F.col("i")], 4).collect()}
    with conf(spark, spark__framespan__rowsPerSlice=60):
        out = windows.smoothed(df, "v", ["g"], [F.col("i")], 4)
        assert "_slice" not in plan(out) and "_block" not in plan(out)
        assert {tuple(r) for r in out.collect()} == whole


def test_small_slices_share_partitions(spark, monkeypatch):
    """A large group in slices of 5 rows does not become a file per slice."""
    monkeypatch.setattr(ranking, "SMALL_SLICE_PARTS", 3)
    df = spark.range(400).select(F.when(F.col("id") % 4 > 0, F.lit(1)).alias("g"), (F.col("id") * 37 % 400).alias("v"))
    want = sorted(map(str, ranking.ranked(df, ["g"], [F.col("v").desc()], "rn", "n").collect()))
    with conf(spark, spark__framespan__rowsPerSlice=5):
        sliced = ranking.sliced_by(df, ["g"], [F.col("v").desc()])
        assert sliced.rdd.getNumPartitions() <= 3 and sliced.groupBy("_slice").count().agg(F.max("count")).first()[0] <= 5
        assert sorted(map(str, ranking.ranked(df, ["g"], [F.col("v").desc()], "rn", "n").collect())) == want


def test_chains_are_not_joined_back(spark):
    """A block carries its rows along; rows without a key have no chain."""
    g = C.sim3(F.lit(1.1), C.identity_matrix(), C.vec(F.lit(1.0), F.lit(0.0), F.lit(0.0)))
    df = spark.range(30).select(F.when(F.col("id") != 4, F.lit("s")).alias("scene"), F.col("id").alias("node"), g.alias("sim3"), (F.col("id") * 2).alias("twice"))
    out = graph.accumulate_sim3(df, ["scene"], "node", block=64)
    assert out.columns == ["scene", "node", "sim3", "twice", "total"] and "Join" not in plan(out)
    rows = out.orderBy("node").collect()
    assert len(rows) == 29 and all(r.twice == 2 * r.node and np.isclose(r.total["s"], 1.1 ** (k + 1)) for k, r in enumerate(rows))


def test_cells_of_a_search_are_counted_before_they_are_broadcast(spark):
    rng = np.random.default_rng(8)
    df = spark.createDataFrame([(i, *map(float, p)) for i, p in enumerate(rng.normal(size=(300, 3)))], "pid long, x double, y double, z double").withColumn("g", F.lit(1))
    out = clouds.knn(df, df, 2, ["g"], leaf=2)
    found = sorted(map(str, out.collect()))
    assert "SortMergeJoin" not in plan(out).split("Initial Plan")[0].split("_rep")[0] and len(found) == 600
    with conf(spark, spark__framespan__broadcastRows=1):
        assert sorted(map(str, clouds.knn(df, df, 2, ["g"], leaf=2).collect())) == found
