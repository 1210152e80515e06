from __future__ import annotations

import numpy as np
import pytest

from framespan.functions import sim3_lie as lie
from framespan.operators import posegraph
from framespan.operators.posegraph import graph_cost, optimize_pose_graph, solve_blocks
from framespan.session import cut

SCHEMA = "scene string, node long, sim3 struct<s:double,r:array<double>,t:array<double>>"
LOOPS = "scene string, i long, j long, sim3 struct<s:double,r:array<double>,t:array<double>>"


def _sim3(s, r, t):
    return (float(s), [float(x) for x in np.asarray(r).reshape(-1)], [float(x) for x in t])


def test_exp_and_log_are_inverse():
    rng = np.random.default_rng(0)
    g = rng.normal(size=(50, 7)) * np.array([2, 2, 2, 0.9, 0.9, 0.9, 0.4])
    assert np.allclose(lie.log(*lie.exp(g)), g, atol=1e-9)
    one = lie.compose(lie.exp(g), lie.inverse(lie.exp(g)))
    assert np.allclose(one[0], 1) and np.allclose(one[1], np.eye(3)) and np.allclose(one[2], 0, atol=1e-12)


def test_derivatives_are_those_of_the_residual():
    rng = np.random.default_rng(5)
    scale = np.array([3, 3, 3, 0.8, 0.8, 0.8, 0.3])
    gi, gj, e = (rng.normal(size=(40, 7)) * scale for _ in range(3))
    gi[0], gj[1], e[2] = 0, 0, 0
    s, r, t = lie.exp(e)
    c = np.concatenate([s[:, None], r.reshape(-1, 9), t], axis=1)
    res, ji, jj = lie.linearise(c, gi, gj)
    # where the joint turn is near half a circle the logarithm itself jumps
    calm = np.linalg.norm(res[:, 3:6], axis=1) < 2.8
    assert calm.sum() > 20 and np.allclose(res, lie.residual(c, gi, gj))
    for k in range(7):
        d = np.zeros(7)
        d[k] = 1e-6
        for got, up, down in ((ji, lie.residual(c, gi + d, gj), lie.residual(c, gi - d, gj)), (jj, lie.residual(c, gi, gj + d), lie.residual(c, gi, gj - d))):
            assert np.allclose(got[calm, :, k], ((up - down) / 2e-6)[calm], atol=1e-5, rtol=1e-5)


def _ring(n, rng, scene):
    """Noisy steps around a circle that should close after n steps."""
    rows, a = [], 2 * np.pi / n
    for k in range(n):
        g = np.zeros((1, 7))
        g[0, 5] = a + rng.normal() * 0.01
        g[0, :3] = [0.9 + rng.normal() * 0.03, rng.normal() * 0.03, rng.normal() * 0.03]
        g[0, 6] = rng.normal() * 0.01
        s, r, t = lie.exp(g)
        rows.append((scene, k, _sim3(s[0], r[0], t[0])))
    return rows


def _dense(steps, loops, rounds=7, lam=1e-6):
    """The same damping loop on one dense matrix."""
    pose = (np.ones(1), np.eye(3)[None], np.zeros((1, 3)))
    poses = [pose]
    consts = [(np.array([s[2][0]]), np.array(s[2][1]).reshape(1, 3, 3), np.array([s[2][2]])) for s in steps]
    for c in consts:
        pose = lie.compose(pose, c)
        poses.append(pose)
    g = np.concatenate([lie.log(*lie.inverse(p)) for p in poses])
    ii = [k + 1 for k in range(len(steps))] + [l[1] for l in loops]
    jj = list(range(len(steps))) + [l[2] for l in loops]
    c = np.array([np.r_[s[2][0], s[2][1], s[2][2]] for s in steps] + [np.r_[l[3][0], l[3][1], l[3][2]] for l in loops])
    history = []
    for it in range(rounds):
        r, ji, jjac = lie.linearise(c, g[ii], g[jj])
        cost = (r**2).mean()
        history.append(cost)
        big = np.zeros((r.size, g.size))
        for e in range(len(ii)):
            big[7 * e : 7 * e + 7, 7 * ii[e] : 7 * ii[e] + 7] += ji[e]
            big[7 * e : 7 * e + 7, 7 * jj[e] : 7 * jj[e] + 7] += jjac[e]
        h = big.T @ big
        h[np.arange(g.size), np.arange(g.size)] *= 1 + lam
        d = np.linalg.lstsq(h, -big.T @ r.reshape(-1), rcond=None)[0].reshape(-1, 7)
        new = (lie.residual(c, (g + d)[ii], (g + d)[jj]) ** 2).mean()
        if new < cost:
            g, lam = g + d, lam / 2
        else:
            lam *= 2
        if cost < 1e-5 and it >= 4 and history[-5] / history[-1] < 1.5:
            break
    return (lie.residual(c, g[ii], g[jj]) ** 2).mean()


@pytest.mark.parametrize("segment", [2, 32])
def test_ring_closes_and_matches_a_dense_solver(spark, segment):
    rng = np.random.default_rng(1)
    a, b = _ring(20, rng, "a"), _ring(14, rng, "b")
    free = _ring(5, rng, "free")
    identity = _sim3(1.0, np.eye(3), [0, 0, 0])
    loops = [("a", 20, 0, identity), ("b", 14, 0, identity), ("b", 9, 2, _sim3(1.0, np.eye(3), [0.1, 0, 0]))]
    # the second loop of b contradicts its chain a little, so the optimum is a compromise
    c = [x for x in b if 2 <= x[1] < 9]
    pose = (np.ones(1), np.eye(3)[None], np.zeros((1, 3)))
    for x in c:
        pose = lie.compose(pose, (np.array([x[2][0]]), np.array(x[2][1]).reshape(1, 3, 3), np.array([x[2][2]])))
    loops[2] = ("b", 9, 2, _sim3(pose[0][0] * 1.02, pose[1][0], pose[2][0] + 0.05))
    seq = spark.createDataFrame(a + b + free, SCHEMA)
    closing = spark.createDataFrame(loops, LOOPS)
    out = optimize_pose_graph(seq, closing, max_iterations=7, segment=segment).persist()
    got = {(r["scene"], r["node"]): r["sim3"] for r in out.collect()}
    assert len(got) == 39
    assert all(got["free", k]["t"] == free[k][2][2] for k in range(5))
    cost = {r["scene"]: r["cost"] for r in graph_cost(out.where("scene <> 'free'"), seq.where("scene <> 'free'"), closing).collect()}
    for name, steps in (("a", a), ("b", b)):
        want = _dense(steps, [x for x in loops if x[0] == name])
        assert np.isclose(cost[name], want, rtol=1e-3), (name, cost[name], want)
    start = {r["scene"]: r["cost"] for r in graph_cost(seq.where("scene <> 'free'"), seq.where("scene <> 'free'"), closing).collect()}
    assert all(cost[s] < start[s] / 3 for s in cost)


def test_sparse_elimination_is_exact_and_linear_in_a_chain_with_loops():
    rng = np.random.default_rng(4)

    def system(n, loops):
        a = np.r_[np.arange(n - 1), rng.integers(0, n - 5, loops)]
        b = np.r_[np.arange(1, n), a[n - 1 :] + rng.integers(2, 5, loops)]
        j = rng.normal(size=(len(a), 9, 14))
        h = np.einsum("nki,nkj->nij", j, j)
        return a, b, h, rng.normal(size=(len(a), 14)), np.einsum("nii->ni", h)

    a, b, h, rhs, diag = system(30, 12)
    dense, right = np.zeros((210, 210)), np.zeros(210)
    for e in range(len(a)):
        at = np.r_[7 * a[e] : 7 * a[e] + 7, 7 * b[e] : 7 * b[e] + 7]
        dense[np.ix_(at, at)] += h[e]
        dense[at, at] += 1e-3 * diag[e]
        right[at] += rhs[e]
    assert np.allclose(solve_blocks(30, a, b, h, rhs, diag, 1e-3).reshape(-1), np.linalg.solve(dense, right), rtol=1e-8)
    # every window of a long chain has a loop: the elimination must not fill up
    n = 6000
    a, b, h, rhs, diag = system(n, n)
    x = solve_blocks(n, a, b, h, rhs, diag, 1e-3)
    both = np.concatenate([x[a], x[b]], axis=1)
    back = np.zeros((n, 7))
    part = np.einsum("nij,nj->ni", h, both) + 1e-3 * diag * both - rhs
    np.add.at(back, a, part[:, :7])
    np.add.at(back, b, part[:, 7:])
    assert np.abs(back).max() < 1e-6


def test_tables_of_edges_are_never_broadcast(spark, monkeypatch):
    """Files of chains of few different steps are tiny, so Spark takes millions of edges for a table to broadcast."""
    plans = []

    def noted(df):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return cut(df)

    monkeypatch.setattr(posegraph, "cut", noted)
    one = _sim3(1.0, np.eye(3), [1, 0, 0])
    seq = spark.createDataFrame([(s, k, one) for s in "ab" for k in range(40)], SCHEMA)
    closing = spark.createDataFrame([(s, 40, 0, one) for s in "ab"], LOOPS)
    spark.conf.set("spark.framespan.broadcastRows", "0")
    try:
        out = optimize_pose_graph(seq, closing, max_iterations=2)
        cost = graph_cost(out, seq, closing)
    finally:
        spark.conf.unset("spark.framespan.broadcastRows")
    plans += [x._jdf.queryExecution().executedPlan().toString() for x in (out, cost)]
    joins = [line for x in plans for line in x.splitlines() if "BroadcastHashJoin" in line]
    # scenes without loops are told apart by scene ids alone
    assert all("LeftSemi" in x or "LeftAnti" in x for x in joins), joins
    assert out.count() == 80 and cost.count() == 2


def test_many_scenes_at_once_are_solved_as_one_by_one():
    rng = np.random.default_rng(8)

    def scene(name, n, loops):
        c = np.array([np.r_[s, r, t] for _, _, (s, r, t) in _ring(n, rng, name)])
        pose = [(np.ones(1), np.eye(3)[None], np.zeros((1, 3)))]
        for x in c:
            pose.append(lie.compose(pose[-1], lie.unpack(x[None])))
        g = np.concatenate([lie.log(*lie.inverse(p)) for p in pose])
        cuts = sorted({0, n, *(x for p in loops for x in p), *range(0, n, 5)})
        runs = [{"a": a, "b": b, "g": g[a : b + 1].reshape(-1), "c": c[a:b].reshape(-1)} for a, b in zip(cuts, cuts[1:])]
        still = np.r_[1.0, np.eye(3).reshape(-1), 0, 0, 0]
        return {"scene": name, "edges": n + len(loops), "runs": runs, "loops": [{"i": i, "j": j, "c": still} for i, j in loops]}

    # few and many nodes left, so by one matrix and by elimination; some scenes settle before others
    rows = [scene("a", 12, [(12, 0)]), scene("b", 9, [(9, 0), (7, 2)]), scene("c", 12, [(12, 0)]), scene("d", 90, [(90, 0)]), scene("e", 3, [(3, 0), (0, 3)])]
    together = posegraph._rounds(rows, 12, 1e-6)

    def steps(g):
        return np.concatenate([np.concatenate([x.reshape(len(g) - 1, -1) for x in (s[:, None], r, t)], axis=1) for s, r, t in [lie.compose(lie.inverse(lie.inverse(tuple(x[:-1] for x in lie.exp(g)))), lie.inverse(tuple(x[1:] for x in lie.exp(g))))]])

    for row, (g, done) in zip(rows, together):
        (alone, ended), = posegraph._rounds([row], 12, 1e-6)
        assert np.allclose(steps(g), steps(alone), atol=1e-7) and done == ended
        posegraph_limit = posegraph.ENDS_ALIKE
        posegraph.ENDS_ALIKE = 0
        try:
            (sparse, _), = posegraph._rounds([row], 12, 1e-6)
        finally:
            posegraph.ENDS_ALIKE = posegraph_limit
        assert np.allclose(steps(g), steps(sparse), atol=1e-6)


def test_jacobian_is_the_series_of_the_bracket():
    rng = np.random.default_rng(9)
    for scale in ([3, 3, 3, 0.8, 0.8, 0.8, 0.3], [90, 90, 90, 1.5, 1.5, 0.5, 1.5], [1, 1, 1, 1e-5, 1e-6, 1e-4, 1e-7], [1, 1, 1, 0, 0, 0, 0.2], [0, 0, 0, 0, 0, 0, 0]):
        g = rng.normal(size=(60, 7)) * scale
        g = g[np.linalg.norm(g[:, 3:6], axis=1) < np.pi]
        x = np.zeros((len(g), 7, 7))
        skew = lie._skew
        x[:, :3, :3], x[:, :3, 3:6], x[:, :3, 6], x[:, 3:6, 3:6] = skew(g[:, 3:6]) + g[:, 6, None, None] * np.eye(3), skew(g[:, :3]), -g[:, :3], skew(g[:, 3:6])
        want = np.broadcast_to(np.eye(7), x.shape).copy()
        term = want.copy()
        for k in range(1, 70):
            term = term @ x / (k + 1)
            want += term
        ours = lie._Jacobian(g)
        size = 1 + np.abs(want).max()
        right = rng.normal(size=(len(g), 7, 7))
        assert np.allclose(ours.dense(), want, atol=1e-13 * size, rtol=1e-12)
        assert np.allclose(want @ ours.solve(right), right, atol=1e-11 * size)
