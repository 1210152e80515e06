"""Same answers at every size, with NULL keys, NULL and descending order keys and ties; random rotations; CSV fields."""

from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from framespan.functions.poses import matrix_from_quat, quat_from_matrix
from framespan.operators import ranking as RK
from framespan.sources import readers


@pytest.fixture(scope="module")
def rows(spark):
    r = random.Random(4)
    data = [(k, r.choice(["a", "b", None]), r.choice([None, float(r.randint(0, 30))]), r.choice([None, k])) for k in range(300)]
    return spark.createDataFrame(data, "id long, g string, x double, v long").repartition(3)


ORDERS = {
    "up": lambda: [F.col("x"), F.col("id")],
    "down": lambda: [F.col("x").desc(), F.col("id")],
    "nulls first": lambda: [F.col("x").desc_nulls_first(), F.col("id").desc()],
}


@pytest.mark.parametrize("name", ORDERS)
def test_slices_change_nothing(spark, rows, name):
    order = ORDERS[name]()

    def everything():
        return (
            sorted(map(tuple, RK.ranked(rows, ["g"], order, "rn", "n").collect()), key=repr),
            sorted(map(tuple, RK.running_sum(rows, ["g"], order, F.col("x"), "cum", "tot").collect()), key=repr),
            sorted(map(tuple, RK.carry_last(rows, ["g"], order, "v", "last").collect()), key=repr),
            sorted(map(tuple, RK.quantiles(rows, ["g"], F.col("x"), {"a": (0.3, "nearest"), "b": (0.5, "lower"), "c": (0.7, "linear")}).collect()), key=repr),
            sorted(map(tuple, RK.smallest_n(rows, ["g"], order, 7).collect()), key=repr),
        )

    plain = everything()
    spark.conf.set("spark.framespan.rowsPerSlice", "20")
    try:
        assert everything() == plain
    finally:
        spark.conf.unset("spark.framespan.rowsPerSlice")


def test_random_rotations(spark):
    rng = np.random.default_rng(5)
    q = rng.standard_normal((300, 4))
    q[:40] *= rng.choice([0.0, 1.0], (40, 4)) + 1e-9
    q /= np.linalg.norm(q, axis=1, keepdims=True)
    q[q[:, 3] < 0] *= -1
    df = spark.createDataFrame([(k, *map(float, v)) for k, v in enumerate(q)], "k long, x double, y double, z double, w double")
    got = df.select("k", matrix_from_quat(*[F.col(c) for c in "xyzw"]).alias("r")).select("k", "r", quat_from_matrix("r").alias("q")).orderBy("k").collect()
    for g, (x, y, z, w) in zip(got, q):
        m = np.array(g.r).reshape(3, 3)
        assert np.allclose(m @ m.T, np.eye(3), atol=1e-12) and np.isclose(np.linalg.det(m), 1)
        assert np.allclose(m, [[1 - 2 * (y * y + z * z), 2 * (x * y - z * w), 2 * (x * z + y * w)], [2 * (x * y + z * w), 1 - 2 * (x * x + z * z), 2 * (y * z - x * w)], [2 * (x * z - y * w), 2 * (y * z + x * w), 1 - 2 * (x * x + y * y)]], atol=1e-12)
        assert np.isclose(abs(np.dot(g.q, (x, y, z, w))), 1, atol=1e-9) and g.q[3] >= 0


def test_csv_fields_and_empty_files(spark, tmp_path):
    (tmp_path / "a.csv").write_text('n,"b, c",d\n1,2,3\n4,"x, ""y""",\n')
    (tmp_path / "b.csv").write_text("n,e\n")
    got = {(r.file, r.name): r.value for r in readers.gather_csv(spark, str(tmp_path)).collect()}
    assert got == {("a.csv", "n"): "4", ("a.csv", "b, c"): 'x, "y"', ("a.csv", "d"): "", ("b.csv", None): None}
    table = {r.file: r.asDict() for r in readers.gather_csv_table(spark, str(tmp_path)).collect()}
    assert table["a.csv"]["n"] == "4" and table["b.csv"]["n"] is None
