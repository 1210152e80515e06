"""Batched exponential and logarithm of similarity transforms, for small blocks inside tasks.

Tangent vectors are (tau, phi, sigma): translation part, rotation vector, log scale.
"""

from __future__ import annotations


import numpy as np

_NODES, _WEIGHTS = (x / 2 for x in np.polynomial.legendre.leggauss(12))
_NODES = _NODES + 0.5
#: Angles below count as this one: all quotients have reached their limits there.
_TINY = 1e-30


def _skew(w: np.ndarray) -> np.ndarray:
    out = np.zeros((len(w), 3, 3))
    out[:, 0, 1], out[:, 0, 2] = -w[:, 2], w[:, 1]
    out[:, 1, 0], out[:, 1, 2] = w[:, 2], -w[:, 0]
    out[:, 2, 0], out[:, 2, 1] = -w[:, 1], w[:, 0]
    return out


def _waves(angle: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(n, 12) of sin(u·angle) / angle and (1 - cos(u·angle)) / angle² at the nodes u."""
    safe = np.maximum(angle, _TINY)[:, None]
    half = np.sin(safe * (_NODES / 2)) / safe
    return np.sin(safe * _NODES) / safe, 2 * half * half


def _mean_exp(phi: np.ndarray, sigma: np.ndarray) -> np.ndarray:
    """W = integral over [0, 1] of exp(u·(sigma·I + [phi])) du.

    Rodrigues' formula leaves three scalar integrals, taken by Gauss-Legendre quadrature: without
    the cancellation of closed forms near zero, and exact to rounding for turns and scales that occur.
    """
    turn, square = _waves(np.linalg.norm(phi, axis=1))
    e = np.exp(sigma[:, None] * _NODES) * _WEIGHTS
    return _matrix(phi, e.sum(axis=1), np.einsum("nk,nk->n", e, turn), np.einsum("nk,nk->n", e, square))


def _rotation(phi: np.ndarray) -> np.ndarray:
    angle = np.linalg.norm(phi, axis=1)
    small = angle < 1e-8
    safe = np.where(small, 1.0, angle)
    k = _skew(phi)
    a = np.where(small, 1.0 - angle**2 / 6, np.sin(safe) / safe)
    b = np.where(small, 0.5 - angle**2 / 24, (1 - np.cos(safe)) / safe**2)
    return np.eye(3) + a[:, None, None] * k + b[:, None, None] * (k @ k)


def exp(g: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(n, 7) tangents to (s, R, t)."""
    tau, phi, sigma = g[:, :3], g[:, 3:6], g[:, 6]
    return np.exp(sigma), _rotation(phi), np.einsum("nij,nj->ni", _mean_exp(phi, sigma), tau)


def _rotation_vector(r: np.ndarray) -> np.ndarray:
    axis = np.stack([r[:, 2, 1] - r[:, 1, 2], r[:, 0, 2] - r[:, 2, 0], r[:, 1, 0] - r[:, 0, 1]], axis=1) / 2
    sin, cos = np.linalg.norm(axis, axis=1), (np.trace(r, axis1=1, axis2=2) - 1) / 2
    angle = np.arctan2(sin, cos)
    scale = np.where(sin > 1e-8, angle / np.where(sin > 1e-8, sin, 1.0), 1.0)
    out = axis * scale[:, None]
    for i in np.nonzero(cos < -0.99)[0]:
        # near half a turn the axis comes from the symmetric part
        sym = (r[i] + r[i].T) / 2 - np.eye(3) * cos[i]
        col = sym[:, int(np.argmax(np.diag(sym)))]
        unit = col / np.linalg.norm(col)
        out[i] = unit * angle[i] * (1.0 if unit @ axis[i] >= 0 else -1.0)
    return out


def log(s: np.ndarray, r: np.ndarray, t: np.ndarray) -> np.ndarray:
    """(s, R, t) to (n, 7) tangents."""
    phi, sigma = _rotation_vector(r), np.log(s)
    tau = np.linalg.solve(_mean_exp(phi, sigma), t[:, :, None])[:, :, 0]
    return np.concatenate([tau, phi, sigma[:, None]], axis=1)


def compose(a, b):
    return a[0] * b[0], a[1] @ b[1], a[0][:, None] * np.einsum("nij,nj->ni", a[1], b[2]) + a[2]


def inverse(a):
    back = np.swapaxes(a[1], 1, 2)
    return 1 / a[0], back, -np.einsum("nij,nj->ni", back, a[2]) / a[0][:, None]


def unpack(c: np.ndarray):
    """(n, 13) rows s, R, t."""
    return c[:, 0], c[:, 1:10].reshape(-1, 3, 3), c[:, 10:13]


def residual(c: np.ndarray, gi: np.ndarray, gj: np.ndarray) -> np.ndarray:
    """log(C · exp(G_i) · exp(G_j)^-1) per edge."""
    return log(*compose(compose(unpack(c), exp(gi)), inverse(exp(gj))))


def _matrix(phi: np.ndarray, one: np.ndarray, turn: np.ndarray, square: np.ndarray) -> np.ndarray:
    """one·I + turn·[phi] + square·[phi]²."""
    scaled = square[:, None] * phi
    out = scaled[:, :, None] * phi[:, None, :] + turn[:, None, None] * _skew(phi)
    out[:, np.arange(3), np.arange(3)] += (one - np.einsum("ni,ni->n", scaled, phi))[:, None]
    return out


def _inverse_of(angle: np.ndarray, one: np.ndarray, turn: np.ndarray, square: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The inverse of one·I + turn·[phi] + square·[phi]² in the same form."""
    re = one - square * angle**2
    size = re**2 + (turn * angle) ** 2
    return 1 / one, -turn / size, (turn**2 - square * re) / (one * size)


class _Jacobian:
    """J with exp(g + d) = exp(J d) exp(g) to first order, for many g: the integral over [0, 1] of exp(u·x) for the matrix x of the bracket with g.

    x has the blocks [sigma·I + [phi], [tau], -tau], [0, [phi], 0] and a row of zeros, so J has the blocks [a, b, c], [0, d, 0] and
    [0, 0, 1]. a and d are polynomials in [phi]; b is the integral of exp(v·(sigma·I + [phi])) [tau] exp(w·[phi]) over
    v, w >= 0 with v + w <= 1, in which Rodrigues' formula leaves nine scalar integrals over v; those over w are closed.
    """

    def __init__(self, g: np.ndarray, waves: tuple | None = None):
        tau, phi, sigma = g[:, :3], g[:, 3:6], g[:, 6]
        self.angle = angle = np.linalg.norm(phi, axis=1)
        self.waves = waves = waves or (*_waves(angle), _rest(angle))
        turn, square, rest = waves
        e = np.exp(sigma[:, None] * _NODES) * _WEIGHTS
        left = e, e * turn, e * square
        # the nodes lie evenly about 1/2, so 1 - v is the node from the other end
        right = 1 - _NODES, square[:, ::-1], rest[:, ::-1]
        w = [[x @ right[0], *(np.einsum("nk,nk->n", x, y) for y in right[1:])] for x in left]
        self.of_a = e.sum(axis=1), left[1].sum(axis=1), left[2].sum(axis=1)
        self.of_d = np.ones(len(g)), turn @ _WEIGHTS, square @ _WEIGHTS
        self.phi = phi
        dot = np.einsum("ni,ni->n", phi, tau)
        side = np.cross(phi, tau)
        self.c = -(w[0][0][:, None] * tau + w[1][0][:, None] * side + w[2][0][:, None] * np.cross(phi, side))
        # [phi][tau] = tau phi' - (phi·tau) I, [tau][phi] = phi tau' - (phi·tau) I, [phi]²[tau] = side phi' - (phi·tau) [phi], [tau][phi]² = -phi side' - (phi·tau) [phi]
        linear = dot * (angle**2 * w[2][2] - w[1][1] - w[2][0] - w[0][2])
        self.b = _matrix(phi, -dot * (w[1][0] + w[0][1]), linear, -dot * (w[2][1] + w[1][2])) + w[0][0][:, None, None] * _skew(tau)
        self.b += (w[1][0][:, None] * tau + w[2][0][:, None] * side)[:, :, None] * phi[:, None, :]
        self.b += phi[:, :, None] * (w[0][1][:, None] * tau - w[0][2][:, None] * side)[:, None, :]

    def dense(self) -> np.ndarray:
        out = np.zeros((len(self.c), 7, 7))
        out[:, :3, :3], out[:, :3, 3:6], out[:, :3, 6] = _matrix(self.phi, *self.of_a), self.b, self.c
        out[:, 3:6, 3:6], out[:, 6, 6] = _matrix(self.phi, *self.of_d), 1
        return out

    def solve(self, x: np.ndarray) -> np.ndarray:
        """The inverse of J times (n, 7, k)."""
        out = np.empty_like(x)
        out[:, 6:] = x[:, 6:]
        out[:, 3:6] = _matrix(self.phi, *_inverse_of(self.angle, *self.of_d)) @ x[:, 3:6]
        out[:, :3] = _matrix(self.phi, *_inverse_of(self.angle, *self.of_a)) @ (x[:, :3] - self.b @ out[:, 3:6] - self.c[:, :, None] * x[:, 6:])
        return out


def _rest(angle: np.ndarray) -> np.ndarray:
    """(n, 12) of (u - sin(u·angle) / angle) / angle² at the nodes u."""
    safe = np.maximum(angle, _TINY)[:, None]
    x = safe * _NODES
    y = x * x
    series = _NODES**3 * (1 / 6 - y * (1 / 120 - y * (1 / 5040 - y * (1 / 362880 - y / 39916800))))
    return np.where(x < 0.3, series, (_NODES - np.sin(x) / safe) / safe**2)


def _adjoint(c: np.ndarray) -> np.ndarray:
    """Matrices (n, 7, 7) that carry a tangent from the right to the left of C."""
    s, r, t = unpack(c)
    out = np.zeros((len(c), 7, 7))
    out[:, :3, :3] = s[:, None, None] * r
    out[:, :3, 3:6] = _skew(t) @ r
    out[:, :3, 6] = -t
    out[:, 3:6, 3:6] = r
    out[:, 6, 6] = 1
    return out


def linearise(c: np.ndarray, gi: np.ndarray, gj: np.ndarray, r: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Residuals (n, 7), unless known as ``r``, and their derivatives by G_i and G_j (n, 7, 7)."""
    r = residual(c, gi, gj) if r is None else r
    left = _Jacobian(r)
    right = _Jacobian(-r, left.waves)
    ji = left.solve(_adjoint(c) @ _Jacobian(gi).dense())
    return r, ji, -right.solve(_Jacobian(gj).dense())
