"""Pose-graph optimisation over similarity transforms.

A scene is a chain of windows plus loop edges. The chain is cut into runs of at most ``SEGMENT`` edges
between anchors (loop ends and every ``SEGMENT``-th window), stored one row each. A round eliminates the inner nodes of each
run, then merges up to ``SEGMENT`` neighbouring runs at a time, level by level, wherever they meet at a window without a loop.
What is left of a scene, its loop ends and little more, is solved exactly by sparse elimination in one task, and the steps are
substituted back down the levels: an exact solve of the damped normal equations by one method at every size. No task sees
a chain; the last one sees rows in proportion to the loops of one scene.
"""

from __future__ import annotations

import heapq
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from framespan.functions import columns as C
from framespan.functions import sim3_lie as lie
from framespan.operators.graph import to_absolute, to_relative
from framespan.operators.joins import attach, broadcast_limit, shuffled
from framespan.operators.ranking import running_sum
from framespan.schemas import SIM3, VEC
from framespan.session import cut

SEGMENT = 32
#: Runs of edges that one task works on in a round.
RUNS_PER_TASK = 32
#: Relative change of the cost under which more rounds only repeat it.
STILL = 1e-9
#: Edges of small scenes that one task solves in all, and those it works on at once.
EDGES_PER_TASK, EDGES_AT_ONCE = 16_384, 4_096
#: Most nodes of a scene, once its runs are eliminated, that are solved as one matrix together with those of other scenes.
ENDS_ALIKE = 12


@F.pandas_udf(VEC)
def _tangent(s: pd.Series, r: pd.Series, t: pd.Series) -> pd.Series:
    if not len(s):
        return pd.Series([], dtype=object)
    rot = np.stack(r.to_numpy()).astype(float).reshape(-1, 3, 3)
    return pd.Series(list(lie.log(s.to_numpy(dtype=float), rot, np.stack(t.to_numpy()).astype(float))))


@F.pandas_udf(SIM3)
def _transform(g: pd.Series) -> pd.DataFrame:
    if not len(g):
        return pd.DataFrame({"s": [], "r": [], "t": []})
    s, r, t = lie.exp(np.stack(g.to_numpy()).astype(float))
    return pd.DataFrame({"s": s, "r": list(r.reshape(-1, 9)), "t": list(t)})


def _flat(sim3: Column) -> Column:
    return F.concat(F.array(sim3["s"]), sim3["r"], sim3["t"])


def _stack(series: pd.Series) -> np.ndarray:
    return np.stack(series.to_numpy()).astype(float)


def _linear(c: np.ndarray, g: np.ndarray, g_prev: np.ndarray, known: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Residuals and the blocks (before, after) of the normal equations, edge by edge."""
    r, j_after, j_before = lie.linearise(c, g, g_prev, known)
    j = np.concatenate([j_before, j_after], axis=2)
    across = np.swapaxes(j, 1, 2)
    return r, across @ j, -(across @ r[:, :, None])[:, :, 0]


def _system(h: np.ndarray, rhs: np.ndarray, diag: np.ndarray, lam: float):
    """Matrix, right side and undamped diagonal of a run of edges between neighbours; inner nodes are damped."""
    m = len(h)
    big, b, d = np.zeros((7 * (m + 1), 7 * (m + 1))), np.zeros(7 * (m + 1)), np.zeros(7 * (m + 1))
    for e in range(m):
        at = slice(7 * e, 7 * e + 14)
        big[at, at] += h[e]
        b[at] += rhs[e]
        d[at] += diag[e]
    inner = np.arange(7, 7 * m)
    big[inner, inner] += lam * d[inner]
    return big, b, d, np.r_[0:7, 7 * m : 7 * m + 7], inner


def _eliminated(h, rhs, diag, lam):
    """A run of edges as one edge between its two ends."""
    big, b, d, outer, inner = _system(h, rhs, diag, lam)
    hoo, bo = big[np.ix_(outer, outer)], b[outer]
    if len(inner):
        x = np.linalg.solve(big[np.ix_(inner, inner)], np.column_stack([big[np.ix_(inner, outer)], b[inner]]))
        hoo = hoo - big[np.ix_(outer, inner)] @ x[:, :-1]
        bo = bo - big[np.ix_(outer, inner)] @ x[:, -1]
    return hoo, bo, d[outer]


def _substituted(h, rhs, diag, lam, ends: np.ndarray) -> np.ndarray:
    """Steps of all nodes of a run of edges, given those of its two ends."""
    big, b, _, outer, inner = _system(h, rhs, diag, lam)
    delta = np.zeros(len(b))
    delta[outer] = ends
    if len(inner):
        delta[inner] = np.linalg.solve(big[np.ix_(inner, inner)], b[inner] - big[np.ix_(inner, outer)] @ ends)
    return delta.reshape(-1, 7)


def _run_of(g: list, c: list) -> tuple[np.ndarray, np.ndarray]:
    return np.asarray(g, float).reshape(-1, 7), np.asarray(c, float).reshape(-1, 13)


def _edge_rows(keys: list[str]):
    """Stored runs of chain edges (one row each) as reduced edges."""

    def run(batches):
        for pdf in batches:
            out = []
            for row in pdf.to_dict("records"):
                g, c = _run_of(row["g"], row["c"])
                r, h, rhs = _linear(c, g[1:], g[:-1])
                hoo, bo, d = _eliminated(h, rhs, np.einsum("nii->ni", h), row["lam"])
                out.append((*[row[k] for k in keys], row["a"], row["b"], hoo.reshape(-1), bo, d, g[0], g[-1], row["lam"]))
            if out:
                yield pd.DataFrame(out, columns=[*keys, "a", "b", "h", "rhs", "diag", "ga", "gb", "lam"])

    return run


EDGE = "a long, b long, h array<double>, rhs array<double>, diag array<double>, ga array<double>, gb array<double>, lam double"


def _reduce(keys: list[str]):
    """A run of reduced edges of the level below as one edge."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("a")
        first, last = pdf.iloc[0], pdf.iloc[-1]
        hoo, bo, d = _eliminated(_stack(pdf["h"]).reshape(-1, 14, 14), _stack(pdf["rhs"]), _stack(pdf["diag"]), first["lam"])
        row = (*[first[k] for k in keys], first["a"], last["b"], hoo.reshape(-1), bo, d, first["ga"], last["gb"], first["lam"])
        return pd.DataFrame([row], columns=[*keys, "a", "b", "h", "rhs", "diag", "ga", "gb", "lam"])

    return run


def _descend(low: str):
    """Steps of the ends of every edge of a run, from those of the run's ends."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("a")
        ends = np.concatenate([pdf["da"].iloc[0], pdf["db"].iloc[0]]).astype(float)
        delta = _substituted(_stack(pdf["h"]).reshape(-1, 14, 14), _stack(pdf["rhs"]), _stack(pdf["diag"]), pdf["lam"].iloc[0], ends)
        first = np.zeros(len(pdf))
        first[0] = 1
        out = {"scene": pdf["scene"].to_numpy(), low: pdf[low].to_numpy(), "da": list(delta[:-1]), "db": list(delta[1:])}
        return pd.DataFrame(out | {c: pdf[c].to_numpy() * first for c in ("loop_now", "loop_new", "loop_n")})

    return run


def solve_blocks(n: int, a: np.ndarray, b: np.ndarray, h: np.ndarray, rhs: np.ndarray, diag: np.ndarray, lam: float) -> np.ndarray:
    """Exact solution of a sparse system of 7x7 blocks: nodes are eliminated by least degree, then substituted back.

    The work is linear in the nodes for chains and for loops that leave few neighbours.
    """
    near: list[dict[int, np.ndarray]] = [{} for _ in range(n)]
    right, own, damp = np.zeros((n, 7)), np.zeros((n, 7, 7)), np.zeros((n, 7))
    for at, part in ((a, slice(0, 7)), (b, slice(7, 14))):
        np.add.at(right, at, rhs[:, part])
        np.add.at(damp, at, diag[:, part])
        np.add.at(own, at, h[:, part, part])
    for e, (u, v) in enumerate(zip(a.tolist(), b.tolist())):
        near[u][v] = near[u].get(v, 0) + h[e, :7, 7:]
        near[v][u] = near[v].get(u, 0) + h[e, 7:, :7]
    own[:, np.arange(7), np.arange(7)] += lam * damp
    queue = [(len(near[v]), v) for v in range(n)]
    heapq.heapify(queue)
    gone, order = np.zeros(n, bool), []
    while queue:
        degree, v = heapq.heappop(queue)
        if gone[v] or degree != len(near[v]):
            continue
        others = list(near[v])
        wide = np.concatenate([*[near[v][u] for u in others], right[v][:, None]], axis=1)
        x = np.linalg.solve(own[v], wide)
        update = wide[:, :-1].T @ x
        for p, u in enumerate(others):
            del near[u][v]
            block = update[7 * p : 7 * p + 7]
            own[u] -= block[:, 7 * p : 7 * p + 7]
            right[u] -= block[:, -1]
            for q, w in enumerate(others):
                if q != p:
                    near[u][w] = near[u].get(w, 0) - block[:, 7 * q : 7 * q + 7]
        for u in others:
            heapq.heappush(queue, (len(near[u]), u))
        gone[v] = True
        order.append((v, others, x))
    delta = np.zeros((n, 7))
    for v, others, x in reversed(order):
        delta[v] = x[:, -1] - (x[:, :-1] @ delta[others].reshape(-1) if others else 0)
    return delta


def _solve_alike(n: int, scene: np.ndarray, a: np.ndarray, b: np.ndarray, h: np.ndarray, rhs: np.ndarray, diag: np.ndarray, lam: np.ndarray) -> np.ndarray:
    """Solutions (k, n, 7) of k systems of ``n`` nodes each, few enough to be solved as whole matrices."""
    k = len(lam)
    big, right, damp = np.zeros((k, n, n, 7, 7)), np.zeros((k, n, 7)), np.zeros((k, n, 7))
    for at, part in ((a, slice(0, 7)), (b, slice(7, 14))):
        np.add.at(right, (scene, at), rhs[:, part])
        np.add.at(damp, (scene, at), diag[:, part])
        np.add.at(big, (scene, at, at), h[:, part, part])
    np.add.at(big, (scene, a, b), h[:, :7, 7:])
    np.add.at(big, (scene, b, a), h[:, 7:, :7])
    whole = big.transpose(0, 1, 3, 2, 4).reshape(k, 7 * n, 7 * n)
    whole[:, np.arange(7 * n), np.arange(7 * n)] += lam[:, None] * damp.reshape(k, -1)
    return np.linalg.solve(whole, right.reshape(k, -1, 1)).reshape(k, n, 7)


def _solve(top: str):
    """Steps of what the levels leave of a scene: loop ends, and the ends of its last runs of edges."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        chain, bent = pdf[pdf["c"].isna()].sort_values("a"), pdf[pdf["c"].notna()]
        a, b, lam = chain["a"].to_numpy(), chain["b"].to_numpy(), float(chain["lam"].iloc[0])
        ids = np.append(a, b[-1])
        g = np.concatenate([_stack(chain["ga"]), _stack(chain["gb"])[-1:]])
        i, j = np.searchsorted(ids, bent["a"].to_numpy()), np.searchsorted(ids, bent["b"].to_numpy())
        c = _stack(bent["c"])
        r, h, rhs = _linear(c, g[i], g[j])
        edges = [np.concatenate(x) for x in (
            (np.searchsorted(ids, a), j), (np.searchsorted(ids, b), i), (_stack(chain["h"]).reshape(-1, 14, 14), h),
            (_stack(chain["rhs"]), rhs), (_stack(chain["diag"]), np.einsum("nii->ni", h)),
        )]
        delta = solve_blocks(len(ids), *edges, lam)
        moved = g + delta
        new = lie.residual(c, moved[i], moved[j])
        out = {"scene": chain["scene"].to_numpy(), top: chain[top].to_numpy(), "da": list(delta[:-1]), "db": list(delta[1:])}
        first = np.zeros(len(chain))
        first[0] = 1
        return pd.DataFrame(out | {"loop_now": first * (r**2).sum(), "loop_new": first * (new**2).sum(), "loop_n": first * r.size})

    return run


def _swept(h: np.ndarray, rhs: np.ndarray, diag: np.ndarray, lam: np.ndarray, first: np.ndarray, length: np.ndarray):
    """Many runs of edges, longest first, each as one edge between its ends, and what substitution needs.

    Run k holds the edges ``first[k]`` to ``first[k] + length[k] - 1``; inner nodes go in order, those of all runs together.
    """
    hoo, b, d, solved = h[first].copy(), rhs[first].copy(), diag[first].copy(), []
    for step in range(1, int(length[0])):
        n = int(np.searchsorted(-length, -step))  # runs with more than ``step`` edges
        e = first[:n] + step
        own = hoo[:n, 7:, 7:] + h[e, :7, :7]
        own[:, np.arange(7), np.arange(7)] += lam[:n, None] * (d[:n, 7:] + diag[e, :7])
        right = np.concatenate([hoo[:n, 7:, :7], h[e, :7, 7:], (b[:n, 7:] + rhs[e, :7])[:, :, None]], axis=2)
        x = np.linalg.solve(own, right)
        up, down = hoo[:n, :7, 7:] @ x, h[e, 7:, :7] @ x
        hoo[:n, :7, :7] -= up[:, :, :7]
        hoo[:n, :7, 7:] = -up[:, :, 7:14]
        hoo[:n, 7:, :7] = -down[:, :, :7]
        hoo[:n, 7:, 7:] = h[e, 7:, 7:] - down[:, :, 7:14]
        b[:n, :7] -= up[:, :, 14]
        b[:n, 7:] = rhs[e, 7:] - down[:, :, 14]
        d[:n, 7:] = diag[e, 7:]
        solved.append(x)
    return hoo, b, d, solved


class _Scenes:
    """Small scenes side by side: nodes ``g``, chain edges ``c`` into nodes ``to``, runs of edges, and loops."""

    def __init__(self, rows: list[dict]):
        self.g, self.c, self.to, self.runs, self.loops, self.nodes = [], [], [], [], [], [0]
        for k, row in enumerate(rows):
            base, at = self.nodes[-1], len(self.c)
            for run in row["runs"]:
                g, c = _run_of(run["g"], run["c"])
                self.g.extend(g if not run["a"] else g[1:])
                self.runs.append((k, base + run["a"], base + run["b"], at + run["a"]))
                self.c.extend(c)
            self.to.extend(range(base + 1, base + len(self.c) - at + 1))
            self.loops.extend((k, base + l["i"], base + l["j"], *l["c"]) for l in row["loops"])
            self.nodes.append(len(self.g))
        runs = np.array(self.runs, dtype=np.int64)
        self.runs = runs[np.argsort(runs[:, 1] - runs[:, 2], kind="stable")]
        self.g, self.c, self.to, self.nodes = np.array(self.g), np.array(self.c), np.array(self.to), np.array(self.nodes)
        loops = np.array(self.loops, float)
        self.of, self.i, self.j, self.bent = loops[:, 0].astype(int), loops[:, 1].astype(int), loops[:, 2].astype(int), loops[:, 3:]
        self.edge_of = np.searchsorted(self.nodes, self.to, side="right") - 1
        # nodes that the last step solves, their number within the scene, and their edges by scene
        self.ends = np.unique(np.concatenate([self.runs[:, 1], self.runs[:, 2]]))
        self.starts = np.searchsorted(self.ends, self.nodes)
        self.run_order, self.loop_order = (np.argsort(x, kind="stable") for x in (self.runs[:, 0], self.of))
        scenes = np.arange(len(rows) + 1)
        self.run_cut = np.searchsorted(self.runs[self.run_order, 0], scenes)
        self.loop_cut = np.searchsorted(self.of[self.loop_order], scenes)

    def cost(self, chain: np.ndarray, loops: np.ndarray) -> np.ndarray:
        """Mean squared residual per scene."""
        n = len(self.nodes) - 1
        total = np.bincount(self.edge_of, (chain**2).sum(axis=1), n) + np.bincount(self.of, (loops**2).sum(axis=1), n)
        return total / (7 * (np.bincount(self.edge_of, minlength=n) + np.bincount(self.of, minlength=n)))

    def residuals(self, g: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of the chain's edges and of the loops."""
        return lie.residual(self.c, g[self.to], g[self.to - 1]), lie.residual(self.bent, g[self.i], g[self.j])

    def tried(self, g: np.ndarray, known: tuple[np.ndarray, np.ndarray], lam: np.ndarray, live: np.ndarray) -> tuple[np.ndarray, tuple[np.ndarray, np.ndarray]]:
        """Moved nodes of the live scenes and the residuals there; ``known`` are those at ``g``."""
        _, h, rhs = _linear(self.c, g[self.to], g[self.to - 1], known[0])
        _, lh, lrhs = _linear(self.bent, g[self.i], g[self.j], known[1])
        diag, ldiag = np.einsum("nii->ni", h), np.einsum("nii->ni", lh)
        scene, a, b, first = self.runs.T
        hoo, bo, d, solved = _swept(h, rhs, diag, lam[scene], first, b - a)
        delta = np.zeros_like(g)
        at_a, at_b, at_i, at_j = (np.searchsorted(self.ends, x) for x in (a, b, self.i, self.j))
        sizes = np.diff(self.starts)
        for n in np.unique(sizes[live & (sizes <= ENDS_ALIKE)]):
            alike = live & (sizes == n)
            own, bent = alike[scene], alike[self.of]
            number = np.cumsum(alike) - 1
            edges = [np.concatenate(x) for x in (
                (number[scene[own]], number[self.of[bent]]), (at_a[own] - self.starts[scene[own]], at_j[bent] - self.starts[self.of[bent]]),
                (at_b[own] - self.starts[scene[own]], at_i[bent] - self.starts[self.of[bent]]), (hoo[own], lh[bent]), (bo[own], lrhs[bent]), (d[own], ldiag[bent]),
            )]
            delta[self.ends[np.repeat(alike, sizes)]] = _solve_alike(int(n), *edges, lam[alike]).reshape(-1, 7)
        for k in np.flatnonzero(live & (sizes > ENDS_ALIKE)):
            own, bent = self.run_order[self.run_cut[k] : self.run_cut[k + 1]], self.loop_order[self.loop_cut[k] : self.loop_cut[k + 1]]
            start, stop = self.starts[k], self.starts[k + 1]
            edges = [np.concatenate(x) for x in (
                (at_a[own] - start, at_j[bent] - start), (at_b[own] - start, at_i[bent] - start), (hoo[own], lh[bent]), (bo[own], lrhs[bent]), (d[own], ldiag[bent])
            )]
            delta[self.ends[start:stop]] = solve_blocks(stop - start, *edges, lam[k])
        for step in range(len(solved), 0, -1):
            x = solved[step - 1]
            inner = a[: len(x)] + step
            delta[inner] = x[:, :, 14] - (x[:, :, :7] @ delta[a[: len(x)], :, None] + x[:, :, 7:14] @ delta[inner + 1, :, None])[:, :, 0]
        moved = g + delta
        return moved, self.residuals(moved)


def _settled(history: list[float], new: float) -> bool:
    """Whether a scene that goes from the last cost of ``history`` to ``new`` has converged; NaN counts as the largest number."""
    now = history[-1]
    slow = len(history) < 5 or now == 0 or history[-5] / now < 1.5
    return (len(history) >= 5 and now < 1e-5 and slow) or bool(np.isnan(now)) or abs(new - now) <= STILL * now


def _rounds(rows: list[dict], max_iterations: int, lambda_init: float) -> list[tuple[np.ndarray, bool]]:
    """Nodes and ``converged`` of small scenes after all their rounds."""
    out: list = [None] * len(rows)
    ids = np.arange(len(rows))
    work, lam, history = _Scenes(rows), np.full(len(rows), lambda_init), [[] for _ in rows]
    g, live = work.g, np.ones(len(rows), bool)
    known = work.residuals(g)
    for _ in range(max_iterations):
        moved, after = work.tried(g, known, lam, live)
        now, new = work.cost(*known), work.cost(*after)
        accepted = live & ((new < now) | (np.isnan(now) & ~np.isnan(new)))
        g = np.where(np.repeat(accepted, np.diff(work.nodes))[:, None], moved, g)
        known = tuple(np.where(accepted[of][:, None], x, y) for of, x, y in zip((work.edge_of, work.of), after, known))
        lam = np.where(accepted, lam / 2, lam * 2)
        for k in np.flatnonzero(live):
            history[ids[k]].append(float(now[k]))
            if _settled(history[ids[k]], float(new[k])):
                live[k] = False
                out[ids[k]] = (g[work.nodes[k] : work.nodes[k + 1]], True)
        if not live.any():
            break
        if live.sum() * 4 <= len(live) * 3:  # settled scenes leave the arrays once they are a quarter of them
            at = np.concatenate([np.arange(work.nodes[k], work.nodes[k + 1]) for k in np.flatnonzero(live)])
            ids, lam, g = ids[live], lam[live], g[at]
            work, live = _Scenes([rows[k] for k in ids]), np.ones(len(ids), bool)
            known = work.residuals(g)
    for k in np.flatnonzero(live):
        out[ids[k]] = (g[work.nodes[k] : work.nodes[k + 1]], False)
    return out


def _whole(max_iterations: int, lambda_init: float):
    """All rounds of small scenes, a bounded number of edges at once."""

    def solved(rows):
        done = _rounds(rows, max_iterations, lambda_init)
        return pd.DataFrame([(row["scene"], 0, len(g) - 1, g.reshape(-1), end) for row, (g, end) in zip(rows, done)], columns=["scene", "a", "b", "g", "converged"])

    def run(batches):
        rows, size = [], 0
        for pdf in batches:
            for row in pdf.to_dict("records"):
                rows.append(row)
                size += row["edges"]
                if size >= EDGES_AT_ONCE:
                    yield solved(rows)
                    rows, size = [], 0
        if rows:
            yield solved(rows)

    return run


def _move(keys: list[str]):
    """Tried positions of stored runs of edges and their squared residuals before and after; rows without steps stay as they are."""

    def run(batches):
        for pdf in batches:
            out = []
            for row in pdf.to_dict("records"):
                tried, now, new, n = None, 0.0, 0.0, 0
                if row["da"] is not None:
                    g, c = _run_of(row["g"], row["c"])
                    r, h, rhs = _linear(c, g[1:], g[:-1])
                    moved = g + _substituted(h, rhs, np.einsum("nii->ni", h), row["lam"], np.concatenate([row["da"], row["db"]]).astype(float))
                    res = lie.residual(c, moved[1:], moved[:-1])
                    tried, n = moved.reshape(-1), r.size + int(row["loop_n"])
                    now, new = float((r**2).sum()) + row["loop_now"], float((res**2).sum()) + row["loop_new"]
                out.append((*[row[k] for k in keys], row["a"], row["b"], row["g"], row["c"], tried, now, new, n))
            if out:
                yield pd.DataFrame(out, columns=[*keys, "a", "b", "g", "c", "tried", "now", "new", "n"])

    return run


@F.pandas_udf(VEC.elementType)
def _loop_cost(c: pd.Series, gi: pd.Series, gj: pd.Series) -> pd.Series:
    if not len(c):
        return pd.Series([], dtype=float)
    return pd.Series((lie.residual(_stack(c), _stack(gi), _stack(gj)) ** 2).sum(axis=1))


def _runs(chain: DataFrame, loops: DataFrame, segment: int, merged: bool = True) -> tuple[DataFrame, int]:
    """The chain as runs of at most ``segment`` edges between anchors, one row each, with the run of runs (up1, up2, ...) it lies in.

    Anchors are loop ends, every ``segment``-th node and the last. A level merges up to ``segment`` runs whose common ends are no
    loop ends, until a scene has no more than ``segment`` runs or nothing is left to merge; without ``merged`` there are no levels.
    """
    absolute = to_absolute(chain)
    nodes = absolute.withColumn("_g", C.sim3_inverse("sim3")).select("scene", "node", _tangent("_g.s", "_g.r", "_g.t").alias("g"))
    ends = loops.select("scene", F.explode(F.array("i", "j")).alias("node")).distinct().withColumn("_end", F.lit(1))
    last = absolute.groupBy("scene").agg(F.max("node").alias("_last"))
    marked = attach(nodes.join(shuffled(ends), ["scene", "node"], "left"), last, ["scene"])
    fixed = F.coalesce((F.col("_end") == 1) | (F.col("node") == F.col("_last")), F.lit(False))
    marked = marked.withColumn("fixed", fixed).withColumn("anchor", (fixed | (F.col("node") % segment == 0)).cast("long"))
    numbered = running_sum(marked, ["scene"], [F.col("node")], F.col("anchor"), "_count")
    # the edge into a node lies in the run opened by the last anchor before the node
    steps = chain.select("scene", (F.col("node") + 1).alias("node"), _flat(F.col("sim3")).alias("c"))
    before = nodes.select("scene", (F.col("node") + 1).alias("node"), F.col("g").alias("g0"))
    placed = numbered.select("scene", "node", "g", "fixed", (F.col("_count") - F.col("anchor")).alias("seg"))
    placed = placed.join(shuffled(steps), ["scene", "node"]).join(shuffled(before), ["scene", "node"])
    items = F.array_sort(F.collect_list(F.struct("node", "g0", "g", "c", "fixed")))
    packed = placed.groupBy("scene", "seg").agg(items.alias("_e"))
    runs = packed.select(
        "scene", "seg",
        (F.col("_e")[0]["node"] - 1).alias("a"),
        F.element_at("_e", -1)["node"].alias("b"),
        F.element_at("_e", -1)["fixed"].alias("fixed"),
        F.concat(F.col("_e")[0]["g0"], F.flatten(F.col("_e.g"))).alias("g"),
        F.flatten(F.col("_e.c")).alias("c"),
    )
    runs, levels, low = cut(runs), 0, "seg"
    while merged and runs.groupBy("scene").agg(F.count_distinct(low).alias("_n")).where(F.col("_n") > segment).limit(1).count():
        level = runs.groupBy("scene", F.col(low).alias("_low")).agg(F.max_by("fixed", "b").alias("_fixed"), F.max("b").alias("_b"))
        stops = (F.col("_fixed") | (F.col("_low") % segment == 0)).cast("long")
        summed = running_sum(level.withColumn("_stop", stops), ["scene"], [F.col("_low")], F.col("_stop"), "_sum")
        grouped = cut(summed.select("scene", F.col("_low").alias(low), (F.col("_sum") - F.col("_stop") + 1).alias(f"up{levels + 1}")))
        if grouped.count() == grouped.select("scene", f"up{levels + 1}").distinct().count():
            break
        levels += 1
        runs, low = cut(runs.join(grouped, ["scene", low])), f"up{levels}"
    return runs, levels


def _by_rounds(chain: DataFrame, loops: DataFrame, max_iterations: int, lambda_init: float, segment: int) -> DataFrame:
    """Runs (scene, a, b, g, converged) of scenes of any size after all rounds, each one job."""
    kind = dict(chain.dtypes)["scene"]
    runs, levels = _runs(chain, loops, segment)
    n_runs = runs.count()
    keys = ["scene", "seg", *[f"up{k + 1}" for k in range(levels)]]
    types = {"scene": kind} | {k: "long" for k in keys[1:]}

    def schema(names: list[str], rest: str) -> str:
        return ", ".join(f"{k} {types[k]}" for k in names) + ", " + rest

    steps = "da array<double>, db array<double>, loop_now double, loop_new double, loop_n double"
    state = runs.drop("fixed").withColumn("tried", F.lit(None).cast("array<double>"))
    parts = max(1, -(-n_runs // RUNS_PER_TASK))
    state = cut(state.repartition(parts, "scene", "seg"))
    looped = loops.select("scene").distinct()
    scenes = cut(
        looped.select(
            "scene", F.lit(float(lambda_init)).alias("lam"), F.array().cast("array<double>").alias("history"),
            F.lit(False).alias("done"), F.lit(False).alias("converged"), F.lit(False).alias("accepted"),
        )
    )
    n_scenes = scenes.count()
    few = n_runs <= broadcast_limit(runs)  # steps of all runs, one short row each
    bent = loops.select("scene", F.col("j").alias("b"), F.col("i").alias("a"), "c")
    for round_no in range(max_iterations):
        known = attach(state, scenes.select("scene", "lam", "done", "accepted"), ["scene"], n_scenes)
        current = known.withColumn("g", F.when(F.col("accepted"), F.col("tried")).otherwise(F.col("g")))
        live = current.where("not done").select(*keys, "a", "b", "g", "c", "lam")
        rows = [live.mapInPandas(_edge_rows(keys), schema(keys, EDGE))]
        for k in range(levels):
            above = ["scene", *keys[k + 2 :]]
            rows.append(rows[-1].groupBy("scene", keys[k + 2]).applyInPandas(_reduce(above), schema(above, EDGE)))
        top = keys[levels + 1]
        here = rows[-1].select("scene", top, "a", "b", "h", "rhs", "diag", "ga", "gb", "lam", F.lit(None).cast("array<double>").alias("c"))
        there = attach(bent, scenes.where("not done").select("scene"), ["scene"], n_scenes)
        solved = here.unionByName(there, allowMissingColumns=True).repartition(parts, "scene").groupBy("scene").applyInPandas(_solve(top), schema(["scene", top], steps))
        for k in reversed(range(levels)):
            known_ends = rows[k].join(solved, ["scene", keys[k + 2]])
            solved = known_ends.groupBy("scene", keys[k + 2]).applyInPandas(_descend(keys[k + 1]), schema(["scene", keys[k + 1]], steps))
        state = cut(current.join(F.broadcast(solved) if few else shuffled(solved), ["scene", "seg"], "left").mapInPandas(
            _move(keys), schema(keys, "a long, b long, g array<double>, c array<double>, tried array<double>, now double, new double, n long")
        ))
        costs = state.where("n > 0").groupBy("scene").agg((F.sum("now") / F.sum("n")).alias("_now"), (F.sum("new") / F.sum("n")).alias("_new"))
        judged = scenes.join(costs, "scene", "left")
        running = F.col("_now").isNotNull()
        judged = judged.withColumn("accepted", running & F.coalesce(F.col("_new") < F.col("_now"), F.lit(False)))
        judged = judged.withColumn("history", F.when(running, F.concat("history", F.array("_now"))).otherwise(F.col("history")))
        slow = F.try_divide(F.element_at(F.slice("history", -5, 1), 1), F.element_at("history", -1)) < 1.5
        settled = F.coalesce(running & (F.col("_now") < 1e-5) & F.coalesce(slow, F.lit(True)), F.lit(False)) if round_no >= 4 else F.lit(False)
        still = F.coalesce(running & (F.abs(F.col("_new") - F.col("_now")) <= STILL * F.col("_now")), F.lit(False))
        settled = settled | still
        scenes = cut(
            judged.select(
                "scene",
                F.when(~running, F.col("lam")).when(F.col("accepted"), F.col("lam") / 2).otherwise(F.col("lam") * 2).alias("lam"),
                "history",
                (F.col("done") | ~running | settled).alias("done"),
                (F.col("converged") | settled).alias("converged"),
                "accepted",
            )
        )
        state = state.drop("now", "new", "n")
        if scenes.where("not done").isEmpty():
            break
    final = attach(state, scenes.select("scene", "accepted", "converged"), ["scene"], n_scenes)
    final = final.withColumn("g", F.when(F.col("accepted"), F.col("tried")).otherwise(F.col("g")))
    return final.select("scene", "a", "b", "g", "converged")


def optimize_pose_graph(
    seq_edges: DataFrame,
    loop_edges: DataFrame,
    max_iterations: int = 30,
    lambda_init: float = 1e-6,
    segment: int = SEGMENT,
) -> DataFrame:
    """Optimised steps (scene, node, sim3, converged) of scenes with loop edges; other scenes stay unchanged, ``converged`` null.

    ``seq_edges`` is (scene, node, sim3): the step from window ``node`` to ``node + 1``, numbered from
    0 without gaps. ``loop_edges`` is (scene, i, j, sim3) with i <> j; loops to windows that do not exist are left out. Levenberg-Marquardt
    per scene: damping halves on success and doubles on failure; a scene has converged once its cost is below 1e-5, at
    least five rounds are done and the last five rounds improved it by less than half, or once a round moves its cost by
    less than ``STILL`` of it. Scenes of at most ``segment`` * ``segment`` edges and loops are solved whole, many in a task; of the others a round is one job over
    stored runs of edges. The driver sees only whether scenes are live.
    """
    loops = loop_edges.where("i <> j").select("scene", F.col("i").cast("long").alias("i"), F.col("j").cast("long").alias("j"), _flat(F.col("sim3")).alias("c"))
    size = seq_edges.groupBy("scene").agg((F.max("node") + 1).alias("_last"))
    loops = cut(loops.join(shuffled(size), "scene").where("least(i, j) >= 0 and greatest(i, j) <= _last").drop("_last"))
    looped = loops.select("scene").distinct()
    plain = seq_edges.join(looped, "scene", "left_anti")
    chain = cut(seq_edges.select("scene", F.col("node").cast("long").alias("node"), "sim3").join(looped, "scene", "left_semi"))
    edges = chain.groupBy("scene").agg(F.count(F.lit(1)).alias("_m")).join(shuffled(loops.groupBy("scene").agg(F.count(F.lit(1)).alias("_l"))), "scene")
    sized = cut(edges.select("scene", (F.col("_m") + F.col("_l")).alias("edges")))
    n_scenes, small_edges = sized.agg(F.count(F.lit(1)), F.sum(F.when(F.col("edges") <= segment * segment, F.col("edges")))).first()
    finals = []
    if small_edges:
        small = sized.where(F.col("edges") <= segment * segment)
        own_chain, own_loops = (attach(x, small.select("scene"), ["scene"], n_scenes, "left_semi") for x in (chain, loops))
        runs, _ = _runs(own_chain, own_loops, segment, False)
        items = runs.groupBy("scene").agg(F.array_sort(F.collect_list(F.struct("a", "b", "g", "c"))).alias("runs"))
        bent = own_loops.groupBy("scene").agg(F.array_sort(F.collect_list(F.struct("i", "j", "c"))).alias("loops"))
        packed = small.join(shuffled(items), "scene").join(shuffled(bent), "scene").repartition(-(-small_edges // EDGES_PER_TASK), "scene")
        whole = packed.mapInPandas(_whole(max_iterations, float(lambda_init)), f"scene {dict(chain.dtypes)['scene']}, a long, b long, g array<double>, converged boolean")
        finals.append(cut(whole))
    large = sized.where(F.col("edges") > segment * segment).select("scene")
    if not large.isEmpty():
        finals.append(_by_rounds(*(attach(x, large, ["scene"], n_scenes, "left_semi") for x in (chain, loops)), max_iterations, lambda_init, segment))
    plain = plain.select("scene", F.col("node").cast("long").alias("node"), "sim3", F.lit(None).cast("boolean").alias("converged"))
    if not finals:
        return plain
    final = reduce(DataFrame.unionByName, finals)
    tangents = F.transform(F.sequence(F.lit(0), F.col("b") - F.col("a")), lambda k: F.slice(F.col("g"), (k * 7 + 1).cast("int"), 7))
    spread = final.select("scene", "a", "converged", F.posexplode(tangents).alias("_at", "_g")).where("_at > 0 or a = 0")
    placed = spread.select("scene", (F.col("a") + F.col("_at")).alias("node"), _transform("_g").alias("_x"))
    optimised = to_relative(placed.select("scene", "node", C.sim3_inverse("_x").alias("sim3")))
    optimised = attach(optimised, final.where("a = 0").select("scene", "converged"), ["scene"], n_scenes)
    return optimised.unionByName(plain)


def graph_cost(steps: DataFrame, seq_edges: DataFrame, loop_edges: DataFrame) -> DataFrame:
    """Mean squared residual of a solution, per scene with loops."""
    g = C.sim3_inverse("sim3")
    nodes = to_absolute(steps).withColumn("_g", g).select("scene", "node", _tangent("_g.s", "_g.r", "_g.t").alias("g"))
    chain = seq_edges.select("scene", (F.col("node") + 1).cast("long").alias("i"), F.col("node").cast("long").alias("j"), _flat(F.col("sim3")).alias("c"))
    both = chain.unionByName(loop_edges.select("scene", F.col("i").cast("long").alias("i"), F.col("j").cast("long").alias("j"), _flat(F.col("sim3")).alias("c")))
    gi = nodes.select("scene", F.col("node").alias("i"), F.col("g").alias("g_i"))
    gj = nodes.select("scene", F.col("node").alias("j"), F.col("g").alias("g_j"))
    rows = both.join(shuffled(gi), ["scene", "i"]).join(shuffled(gj), ["scene", "j"]).withColumn("_c", _loop_cost("c", "g_i", "g_j"))
    return rows.groupBy("scene").agg((F.sum("_c") / (7 * F.count(F.lit(1)))).alias("cost"))
