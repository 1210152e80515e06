from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from framespan.functions import columns as C
from framespan.functions.columns import natural_key
from framespan.operators import clouds, graph, loops, ranking, registration, sampling, similarity, windows


@pytest.fixture
def sliced(spark):
    """Force the paths for large inputs."""
    spark.conf.set("spark.framespan.rowsPerSlice", "40")
    spark.conf.set("spark.framespan.broadcastRows", "0")
    yield
    spark.conf.unset("spark.framespan.rowsPerSlice")
    spark.conf.unset("spark.framespan.broadcastRows")


def test_natural_sort(spark):
    df = spark.createDataFrame([("a/frame10.jpg",), ("a/Frame2.jpg",), ("a/frame1.jpg",)], "path string")
    assert [r[0] for r in df.orderBy(natural_key("path")).collect()] == ["a/frame1.jpg", "a/Frame2.jpg", "a/frame10.jpg"]


def test_filter_sort_sample(spark):
    names = ["frame10.jpg", "frame2.PNG", "frame1.jpeg", "notes.txt", "frame3.jpg"]
    df = spark.createDataFrame([(n,) for n in names], "path string").where(F.col("path").rlike(r"(?i)\.(png|jpg|jpeg)$"))
    out = sampling.sample_every(df, 2, [], [natural_key("path")])
    assert sorted(r[0] for r in out.collect()) == ["frame1.jpeg", "frame3.jpg"]


@pytest.mark.parametrize("n", [1, 2, 3, 5, 6, 8, 9, 23])
def test_window_rule_at_the_edges(spark, n):
    size, overlap = 5, 2
    want, start = [], 0
    while start == 0 or n - start > overlap:
        want += [(start // 3, p, start + p) for p in range(min(size, n - start))]
        start += 3
    frames = spark.range(n).select(F.lit("s").alias("scene"), F.col("id").alias("frame_id"))
    got = windows.assign_windows(frames, size, overlap)
    assert sorted((r.window_id, r.pos, r.frame_id) for r in got.collect()) == want
    back = windows.merge_windows(got, overlap)
    assert sorted(r.frame_id for r in back.collect()) == list(range(n))


def test_window_size_must_exceed_overlap(spark):
    with pytest.raises(ValueError):
        windows.assign_windows(spark.range(3).withColumn("scene", F.lit(1)), 4, 4)


def _skewed(spark, n=600):
    rng = np.random.default_rng(3)
    rows = [("hot" if k % 3 else f"g{k % 7}", k, float(rng.integers(0, 40))) for k in range(n)]
    return spark.createDataFrame(rows, "g string, id long, v double"), rows


def test_sliced_ranks_equal_plain_ranks(spark, sliced):
    df, rows = _skewed(spark)
    out = ranking.ranked(df, ["g"], [F.col("v"), F.col("id")], "rn", "n").collect()
    groups: dict = {}
    for g, k, v in rows:
        groups.setdefault(g, []).append((v, k))
    want = {(g, k): (i + 1, len(items)) for g, items in groups.items() for i, (v, k) in enumerate(sorted(items))}
    assert {(r.g, r.id): (r.rn, r.n) for r in out} == want


def test_sliced_carry_and_neighbourhood(spark, sliced):
    df, rows = _skewed(spark)
    df = df.withColumn("seen", F.when(F.col("id") % 9 == 0, F.col("v")))
    out = {r.id: r.last for r in ranking.carry_last(df, ["g"], [F.col("id")], "seen", "last").collect()}
    near = ranking.ranked(df, ["g"], [F.col("id")], "rn")
    sums = {r.id: r.s for r in ranking.neighbourhood(near, ["g"], "rn", {"s": lambda w: F.sum("v").over(w.rowsBetween(-4, 2))}, 4, 2).collect()}
    groups: dict = {}
    for g, k, v in rows:
        groups.setdefault(g, []).append((k, v))
    for items in groups.values():
        last = None
        for i, (k, v) in enumerate(items):
            last = v if k % 9 == 0 else last
            assert out[k] == last
            assert np.isclose(sums[k], sum(x for _, x in items[max(0, i - 4) : i + 3]))


def test_sliced_quantiles(spark, sliced):
    df, rows = _skewed(spark)
    specs = {"near": (0.3, "nearest"), "low": (0.5, "lower"), "lin": (0.9, "linear")}
    for r in ranking.quantiles(df, ["g"], F.col("v"), specs).collect():
        v = np.array([x for g, _, x in rows if g == r.g])
        assert r.near == np.quantile(v, 0.3, method="nearest")
        assert r.low == np.quantile(v, 0.5, method="inverted_cdf")
        assert np.isclose(r.lin, np.quantile(v, 0.9))


def test_salted_join_keeps_every_row(spark, sliced):
    from framespan.operators.joins import attach

    df, rows = _skewed(spark)
    small = df.groupBy("g").agg(F.count(F.lit(1)).alias("n"))
    out = attach(df, small, ["g"], rows=10)
    assert out.count() == len(rows)


def test_suppression_of_a_falling_chain_takes_one_pass(spark):
    # each pair is the rival of the next: taken in rounds, every round would pick one
    rows = [("a", k * 6, 10_000 + k * 6, 1.0 - k / 1000) for k in range(200)] + [("a", None, 3, 0.9), (None, 1, 50, 0.5)]
    df = spark.createDataFrame(rows, "scene string, i long, j long, sim double")
    got = sorted((r["scene"], r["j"]) for r in loops.nms_pairs(df, 8).where("scene is not null").collect())
    assert got == [("a", k * 6) for k in range(0, 200, 2)]
    assert [tuple(r) for r in loops.nms_pairs(df, 8).where("scene is null").collect()] == [(None, 50, 1, 0.5)]


@pytest.mark.parametrize("whole", [loops.WHOLE_GROUP, 48])
def test_suppression_equals_sequential_greedy(spark, whole, monkeypatch):
    monkeypatch.setattr(loops, "WHOLE_GROUP", whole)
    rng = np.random.default_rng(5)
    pairs, want = [], {}
    for scene in range(3):
        seen, live = {}, []
        for _ in range(60):
            i, j = sorted(int(x) for x in rng.integers(0, 120, 2))
            if j - i > 10:
                seen[(i, j)] = float(rng.integers(0, 6)) / 10 + 0.4
        for (i, j), sim in seen.items():
            pairs.append((scene, i, j, sim))
        picked = []
        for (i, j), sim in sorted(seen.items(), key=lambda x: (-x[1], x[0])):
            if all(abs(a - b) > 8 for p in picked for a in p for b in (i, j)):
                picked.append((i, j))
        want[scene] = {(j, i) for i, j in picked}
    df = spark.createDataFrame(pairs, "scene int, i long, j long, sim double")
    got: dict = {}
    for r in loops.nms_pairs(df, 8).collect():
        got.setdefault(r.scene, set()).add((r.i, r.j))
    assert got == want


def test_components_of_random_graphs(spark):
    rng = np.random.default_rng(7)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 300, (220, 2))] + [(k, k + 1) for k in range(400, 460)]
    parent = list(range(500))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    out = graph.components(spark.createDataFrame(edges, "a long, b long"), spark.range(500).withColumnRenamed("id", "node"))
    assert {r.node: r.component for r in out.collect()} == {k: find(k) for k in range(500)}


def test_knn_is_exact_with_clusters_and_copies(spark):
    rng = np.random.default_rng(11)
    ref = np.concatenate([rng.normal(size=(150, 3)) * 0.01, rng.normal(size=(60, 3)) * 5, np.tile([[1.0, 1.0, 1.0]], (80, 1))])
    query = np.concatenate([rng.normal(size=(40, 3)) * 3, ref[200:215], np.array([[50.0, -40.0, 3.0]])])
    r = spark.createDataFrame([(k, *map(float, p)) for k, p in enumerate(ref)], "pid long, x double, y double, z double")
    q = spark.createDataFrame([(k, *map(float, p)) for k, p in enumerate(query)], "pid long, x double, y double, z double")
    d = np.linalg.norm(query[:, None] - ref[None], axis=2)
    got: dict = {}
    for row in clouds.knn(q, r, 5, leaf=8).collect():
        got.setdefault(row.pid, {})[row.rank] = (row.ref_pid, row.distance)
    for k in range(len(query)):
        order = sorted(range(len(ref)), key=lambda m: (((query[k] - ref[m]) ** 2).sum(), m))[:5]
        assert np.allclose([got[k][i + 1][1] for i in range(5)], d[k][order])
    near = {row.pid: row.distance for row in clouds.nearest(q, r, radius=1.0).collect()}
    assert set(near) == {k for k in range(len(query)) if d[k].min() <= 1.0}


def test_normals_match_brute_force(spark):
    rng = np.random.default_rng(2)
    pts = rng.normal(size=(60, 3)) * np.array([1, 1, 0.05])
    df = spark.createDataFrame([(k, *map(float, p)) for k, p in enumerate(pts)], "pid long, x double, y double, z double")
    d = np.linalg.norm(pts[:, None] - pts[None], axis=2)
    for row in clouds.estimate_normals(df, 8).collect():
        near = pts[np.argsort(d[row.pid], kind="stable")[:8]]
        _, vec = np.linalg.eigh(np.cov(near.T, bias=True))
        assert np.isclose(abs(vec[:, 0] @ [row.nx, row.ny, row.nz]), 1, atol=1e-6)


def _weighted_fit(x, y, w):
    w = w / w.sum()
    mx, my = w @ x, w @ y
    a, b = x - mx, y - my
    s = np.sqrt((w * (b**2).sum(1)).sum() / (w * (a**2).sum(1)).sum())
    u, _, vt = np.linalg.svd((w[:, None] * a).T @ b)
    r = vt.T @ np.diag([1, 1, np.sign(np.linalg.det(u) * np.linalg.det(vt))]) @ u.T
    return s, r, my - s * r @ mx


def test_robust_fit_matches_the_sequential_rule(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(80, 3))
    r, _ = np.linalg.qr(rng.normal(size=(3, 3)))
    r *= np.sign(np.linalg.det(r))
    y = 1.7 * x @ r.T + [1, 2, 3] + rng.normal(size=x.shape) * 0.01
    y[:10] += rng.normal(size=(10, 3)) * 4
    w = rng.uniform(0.2, 1, 80)
    fit, err = _weighted_fit(x, y, w), np.inf
    for _ in range(6):
        res = np.linalg.norm(y - fit[0] * x @ fit[1].T - fit[2], axis=1)
        new = _weighted_fit(x, y, w * np.where(res > 0.1, 0.1 / res, 1.0))
        now = (np.where(res <= 0.1, 0.5 * res**2, 0.1 * (res - 0.05)) * w).sum()
        change = abs(new[0] - fit[0]) + np.linalg.norm(new[2] - fit[2])
        if change < 1e-9 or abs(err - now) < 1e-9 * err:
            break
        fit, err = new, now
    rows = [("g", *map(float, (*a, *b)), float(c)) for a, b, c in zip(x, y, w)]
    df = spark.createDataFrame(rows, "g string, sx double, sy double, sz double, dx double, dy double, dz double, w double")
    out = registration.robust_sim3(df, ["g"], "w", max_iters=6).first()
    assert np.isclose(out.s, fit[0]) and np.allclose(out.r, fit[1].reshape(-1)) and np.allclose(out.t, fit[2])


def test_align_point_maps_robust_keeps_every_row(spark):
    from framespan.plans.checks_registration import align_point_maps_robust, noise, point_pairs

    rows = point_pairs(spark, "/root/testdata/sf0.01", noise()).toPandas().query("seq <= 5")
    ca, cb = rows.l_orderkey % 10 / 10.0, rows.l_orderkey % 7 / 7.0
    rows = rows.assign(w=np.sqrt(ca * cb))[(ca > 0.3) & (cb > 0.3)]
    got = {g.seq: g for g in align_point_maps_robust(spark, "/root/testdata/sf0.01").where("seq <= 5").collect()}
    assert set(got) == set(rows.seq)
    for seq, part in rows.groupby("seq"):
        x, y, w = part[["sx", "sy", "sz"]].to_numpy(float), part[["dx", "dy", "dz"]].to_numpy(float), part.w.to_numpy(float)
        fit, err = _weighted_fit(x, y, w), np.inf
        for _ in range(20):
            res = np.linalg.norm(y - fit[0] * x @ fit[1].T - fit[2], axis=1)
            new = _weighted_fit(x, y, w * np.where(res > 0.1, 0.1 / res, 1.0))
            now = (np.where(res <= 0.1, 0.5 * res**2, 0.1 * (res - 0.05)) * w).sum()
            change = abs(new[0] - fit[0]) + np.linalg.norm(new[2] - fit[2])
            if change < 1e-9 or abs(err - now) < 1e-9 * err:
                break
            fit, err = new, now
        assert got[seq].n == len(part)
        assert np.allclose(got[seq].s, fit[0], atol=1e-5) and np.allclose(got[seq].r, fit[1].reshape(-1), atol=1e-5) and np.allclose(got[seq].t, fit[2], atol=1e-4)


def test_inverse_and_chain(spark):
    r = [0.0, -1.0, 0.0, 1.0, 0.0, 0.0, 0.0, 0.0, 1.0]
    df = spark.range(40).select(F.lit("s").alias("scene"), F.col("id").alias("node"), C.sim3(F.lit(1.01), F.array(*[F.lit(v) for v in r]), C.vec(F.col("id") * 1.0, F.lit(1.0), F.lit(0.0))).alias("sim3"))
    one = df.select(C.sim3_compose("sim3", C.sim3_inverse("sim3")).alias("g")).first().g
    assert np.isclose(one.s, 1) and np.allclose(one.t, 0, atol=1e-12)
    flat = graph.accumulate_sim3(df, ["scene"], "node", block=1000).orderBy("node").collect()
    deep = graph.accumulate_sim3(df, ["scene"], "node", block=3).orderBy("node").collect()
    assert np.allclose([a.total.t for a in flat], [b.total.t for b in deep])


def test_hubs_are_dealt_over_tasks(spark):
    r = random.Random(3)
    star = [(0, i) for i in range(1, 3000)]
    chain = [(5000 + i, 5001 + i) for i in range(40)]
    more = [(r.randint(6000, 6300), r.randint(6000, 6300)) for _ in range(200)]
    edges = spark.createDataFrame(star + chain + more + [(9, 9), (3, 0)], "a long, b long")
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in star + chain + more + [(9, 9)]:
        low, high = sorted((find(a), find(b)))
        parent[high] = low
    want = {n: find(n) for n in list(parent)}
    for limit in (100, 10**6):
        got = {x.node: x.component for x in graph.components(edges, hub_edges=limit).collect()}
        assert got == want
    rows = edges.select(F.col("a").alias("u"), F.col("b").alias("v"))
    least = rows.groupBy("u").agg(F.min("v").alias("_m"), F.count(F.lit(1)).alias("_n"))
    dealt, copies = graph._deal_hubs(rows, least, 100)
    assert dealt.count() == rows.count() and dealt.groupBy("u", "_salt").count().agg(F.max("count")).first()[0] <= 200
    assert dealt.join(copies, ["u", "_salt"]).count() == rows.count()


def test_topk_pairs_of_blocks(spark):
    rng = np.random.default_rng(5)
    vectors = np.round(rng.normal(size=(300, 8)), 1)
    vectors[40:60] = vectors[0]
    rows = [(s, i, vectors[i].tolist()) for s, n in ((0, 300), (1, 30), (2, 1)) for i in range(n)]
    desc = spark.createDataFrame(rows, "scene int, frame_id long, embedding array<double>")
    got = {(x.scene, x.i, x["rank"]): (x.j, x.sim) for x in similarity.topk_similar(desc, 4, block=37).collect()}
    want = {}
    for scene, n in ((0, 300), (1, 30), (2, 1)):
        sims = vectors[:n] @ vectors[:n].T
        for i in range(n):
            for place, j in enumerate(sorted((j for j in range(n) if j != i), key=lambda j: (-round(sims[i, j], 9), j))[:4]):
                want[(scene, i, place + 1)] = (j, sims[i, j])
    assert got.keys() == want.keys()
    assert all(abs(got[x][1] - want[x][1]) < 1e-9 for x in want)
