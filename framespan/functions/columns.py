"""Column expressions shared by the operators. Everything here stays in the JVM."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

ColumnLike = Column | str


def col(c: ColumnLike) -> Column:
    return F.col(c) if isinstance(c, str) else c


def basename(path: ColumnLike) -> Column:
    return F.element_at(F.split(col(path), "/"), -1)


def natural_key(path: ColumnLike) -> Column:
    """Sort key under which digit runs compare as numbers; case and folder are ignored.

    Each run becomes (is_text, digits, text): numbers sort by length after stripping leading
    zeros and then by digits, so runs of any length work without overflow.
    """
    runs = F.regexp_extract_all(F.lower(basename(path)), F.lit(r"(\d+|\D+)"), F.lit(1))

    def entry(run: Column) -> Column:
        number = run.rlike(r"^\d")
        stripped = F.regexp_replace(run, r"^0+(?=\d)", "")
        return F.struct(
            F.when(number, F.lit(0)).otherwise(F.lit(1)).alias("is_text"),
            F.when(number, F.length(stripped)).otherwise(F.lit(0)).alias("digits"),
            F.when(number, stripped).otherwise(run).alias("text"),
        )

    return F.transform(runs, entry)


def dot(a: ColumnLike, b: ColumnLike) -> Column:
    """Inner product of two numeric arrays, in double precision."""
    products = F.zip_with(col(a), col(b), lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda acc, x: acc + x)


def total(cols: Sequence[Column]) -> Column:
    return reduce(lambda a, b: a + b, cols)


def hash52(seed: object, *cols: ColumnLike) -> Column:
    """Reproducible pseudo-random integer in [0, 2^52) from a seed and the given ids."""
    text = F.concat_ws("|", F.lit(str(seed)), *[col(c).cast("string") for c in cols])
    return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("long")


def unit_range(hashed: Column) -> Column:
    return hashed.cast("double") / F.lit(float(2**52))


def clamp(c: Column, low: float | None = None, high: float | None = None) -> Column:
    if low is not None:
        c = F.greatest(c, F.lit(low))
    if high is not None:
        c = F.least(c, F.lit(high))
    return c


def epoch_micros(ts: ColumnLike) -> Column:
    """Microseconds since 1970 of the wall clock, for timestamps with or without time zone."""
    return F.unix_micros(F.from_utc_timestamp(col(ts).cast("timestamp"), F.current_timezone()))


# --- 3-vectors and 3x3 matrices as arrays (row-major) -------------------------------------


def vec(*parts: ColumnLike) -> Column:
    return F.array(*[col(p).cast("double") for p in parts])


def at(m: ColumnLike, i: int) -> Column:
    return col(m)[i]


def mat_vec(m: ColumnLike, v: Sequence[Column]) -> list[Column]:
    """The three components of M·v for a row-major 9-array and a component list."""
    return [total([at(m, 3 * i + k) * v[k] for k in range(3)]) for i in range(3)]


def mat_mul(a: ColumnLike, b: ColumnLike) -> Column:
    return F.array(
        *[total([at(a, 3 * i + k) * at(b, 3 * k + j) for k in range(3)]) for i in range(3) for j in range(3)]
    )


def transpose(m: ColumnLike) -> Column:
    return F.array(*[at(m, 3 * j + i) for i in range(3) for j in range(3)])


def components(v: ColumnLike, n: int = 3) -> list[Column]:
    return [at(v, i) for i in range(n)]


def cross(a: Sequence[Column], b: Sequence[Column]) -> list[Column]:
    return [a[1] * b[2] - a[2] * b[1], a[2] * b[0] - a[0] * b[2], a[0] * b[1] - a[1] * b[0]]


def norm(v: Sequence[Column]) -> Column:
    return F.sqrt(total([c * c for c in v]))


IDENTITY3 = [1.0, 0.0, 0.0, 0.0, 1.0, 0.0, 0.0, 0.0, 1.0]


def identity_matrix() -> Column:
    return F.array(*[F.lit(x) for x in IDENTITY3])


# --- similarity transforms as struct(s, r, t) ----------------------------------------------


def sim3(s: ColumnLike, r: ColumnLike, t: ColumnLike) -> Column:
    return F.struct(col(s).cast("double").alias("s"), col(r).alias("r"), col(t).alias("t"))


def sim3_identity() -> Column:
    return sim3(F.lit(1.0), identity_matrix(), vec(F.lit(0.0), F.lit(0.0), F.lit(0.0)))


def sim3_apply(g: ColumnLike, v: Sequence[Column]) -> list[Column]:
    """s·R·v + t."""
    g = col(g)
    rotated = mat_vec(g["r"], v)
    return [g["s"] * rotated[i] + g["t"][i] for i in range(3)]


def sim3_compose(a: ColumnLike, b: ColumnLike) -> Column:
    """The transform "first b, then a"."""
    a, b = col(a), col(b)
    return sim3(a["s"] * b["s"], mat_mul(a["r"], b["r"]), F.array(*sim3_apply(a, components(b["t"]))))


def sim3_inverse(g: ColumnLike) -> Column:
    g = col(g)
    back = transpose(g["r"])
    moved = mat_vec(back, components(g["t"]))
    return sim3(F.lit(1.0) / g["s"], back, F.array(*[-m / g["s"] for m in moved]))


def sim3_between(a: ColumnLike, b: ColumnLike) -> Column:
    """Transform between two registrations of one joint prediction: b composed with inverse a."""
    a, b = col(a), col(b)
    s = b["s"] / a["s"]
    r = mat_mul(b["r"], transpose(a["r"]))
    moved = mat_vec(r, components(a["t"]))
    return sim3(s, r, F.array(*[b["t"][i] - s * moved[i] for i in range(3)]))
