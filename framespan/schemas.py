"""Declared schemas of the tables the engine reads and writes."""

from __future__ import annotations

from pyspark.sql import types as T

L, I, D, F32, S, B = T.LongType(), T.IntegerType(), T.DoubleType(), T.FloatType(), T.StringType(), T.BooleanType()


def _table(*fields: tuple) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in fields])


VEC = T.ArrayType(D)
SIM3 = _table(("s", D), ("r", VEC), ("t", VEC))
FRAMES = _table(("scene", S), ("frame_id", L), ("path", S), ("ts", T.TimestampType()), ("width", I), ("height", I))
WINDOW_FRAMES = _table(("scene", S), ("window_id", L), ("pos", L), ("frame_id", L))
RASTERS = _table(
    ("scene", S), ("window_id", L), ("pos", L), ("frame_id", L), ("h", I), ("w", I), ("depth", T.ArrayType(F32)), ("conf", T.ArrayType(F32))
)
POSES = _table(("scene", S), ("window_id", L), ("frame_id", L), ("r", VEC), ("t", VEC), ("convention", S))
TRAJECTORY = _table(("seq", S), ("ts", D), ("x", D), ("y", D), ("z", D), ("qw", D), ("qx", D), ("qy", D), ("qz", D))
DESCRIPTORS = _table(("scene", S), ("frame_id", L), ("embedding", T.ArrayType(F32)))
LOOP_PAIRS = _table(("scene", S), ("i", L), ("j", L), ("sim", D))
LOOP_EDGES = _table(("scene", S), ("i", L), ("j", L), ("sim3", SIM3))
POINTS = _table(("cloud", S), ("pid", L), ("x", D), ("y", D), ("z", D), ("r", T.ShortType()), ("g", T.ShortType()), ("b", T.ShortType()), ("conf", F32))
TRACKS = _table(("scene", S), ("track_id", L), ("frame_id", L), ("x", D), ("y", D), ("vis", D), ("conf", D))
METRICS = _table(("dataset", S), ("seq", S), ("metric", S), ("value", D), ("weight", L))
ANNOTATION = _table(
    ("filepath", S), ("R", T.ArrayType(VEC)), ("T", VEC), ("focal_length", VEC), ("principal_point", VEC)
)
