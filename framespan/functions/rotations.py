"""Batched 3x3 factorisations on rows that already hold summed moments (one row per group)."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

VECTOR = T.ArrayType(T.DoubleType())
ROTATION_TYPE = T.StructType(
    [T.StructField("r", VECTOR), T.StructField("trace", T.DoubleType()), T.StructField("rank", T.IntegerType())]
)


def best_rotations(mats: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For stacked moments H = sum src·dst^T: the rotations R maximising tr(R·H), those maxima, and ranks.

    ``rank`` counts singular values that are not numerically zero.
    """
    u, s, vt = np.linalg.svd(mats)
    signs = np.ones((len(mats), 3))
    signs[:, 2] = np.where(np.linalg.det(u) * np.linalg.det(vt) < 0, -1.0, 1.0)
    rot = np.einsum("nji,nj,nkj->nik", vt, signs, u)
    top = np.maximum(s[:, :1], np.finfo(float).tiny)
    return rot, (signs * s).sum(axis=1), (s > 1e-12 * top).sum(axis=1)


def rotation_of(moments: np.ndarray) -> tuple[np.ndarray, int]:
    """Best rotation and rank of one 3x3 moment matrix."""
    rot, _, rank = best_rotations(moments[None])
    return rot[0], int(rank[0])


@F.pandas_udf(ROTATION_TYPE)
def best_rotation(h: pd.Series) -> pd.DataFrame:
    """``best_rotations`` on a column; rows without moments get rank 0 instead of an error."""
    n = len(h)
    mats = np.zeros((n, 3, 3))
    good = np.zeros(n, dtype=bool)
    for i, row in enumerate(h):
        if row is not None:
            values = np.asarray(row, dtype=float)
            if values.size == 9 and np.isfinite(values).all():
                mats[i], good[i] = values.reshape(3, 3), True
    rot, trace, rank = best_rotations(mats)
    return pd.DataFrame({"r": [m.reshape(-1).tolist() for m in rot], "trace": trace, "rank": np.where(good, rank, 0).astype("int32")})


@F.pandas_udf(VECTOR)
def smallest_eigenvector(c: pd.Series) -> pd.Series:
    """Unit eigenvector of the smallest eigenvalue of symmetric 3x3 matrices (row-major)."""
    mats = np.stack([np.zeros((3, 3)) if m is None else np.asarray(m, dtype=float).reshape(3, 3) for m in c])
    _, vecs = np.linalg.eigh(mats)
    return pd.Series([v[:, 0].tolist() for v in vecs])
