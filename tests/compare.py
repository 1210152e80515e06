"""Run a registered query and its SQL side by side: python -m tests.compare [names...]"""

from __future__ import annotations

import math
import os
import sys
import time

import duckdb
import pandas as pd

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf: str):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf}/{name}.parquet'")
    return con


def _plain(value):
    if value is None or value is pd.NaT or value is pd.NA:
        return None
    if hasattr(value, "tolist"):
        value = value.tolist()
    if isinstance(value, dict):
        return tuple((k, _plain(v)) for k, v in sorted(value.items()))
    if isinstance(value, (list, tuple)):
        return tuple(_plain(v) for v in value)
    if isinstance(value, bool):
        return value
    if isinstance(value, (int, float)):
        number = float(value)
        return None if math.isnan(number) else round(number, 9) + 0.0
    if hasattr(value, "isoformat"):
        return pd.Timestamp(value).isoformat()
    try:
        return round(float(value), 9) if type(value).__name__ == "Decimal" else str(value)
    except ValueError:
        return str(value)


def rows(pdf: pd.DataFrame) -> list[tuple]:
    names = sorted(pdf.columns)
    out = [tuple(_plain(v) for v in row) for row in pdf[names].itertuples(index=False, name=None)]
    return sorted(out, key=repr)


def compare(spark, con, sf: str, fn, sql: str) -> tuple[bool, str]:
    got = fn(spark, sf).toPandas()
    want = con.execute(sql).df()
    if sorted(got.columns) != sorted(want.columns):
        return False, f"columns {sorted(got.columns)} vs {sorted(want.columns)}"
    a, b = rows(got), rows(want)
    if len(a) != len(b):
        return False, f"rows {len(a)} vs {len(b)}"
    bad = [(x, y) for x, y in zip(a, b) if x != y]
    if bad:
        return False, f"{len(bad)} of {len(a)} rows differ, first: {bad[0][0]} vs {bad[0][1]}"
    return True, f"{len(a)} rows"


def main(names: list[str]) -> int:
    from framespan.plans import checks
    from framespan.session import local_session

    sf = os.environ.get("SF_DIR", "/root/testdata/sf0.001")
    spark, con = local_session(), connect(sf)
    failed = 0
    for name, fn in checks.QUERIES.items():
        if names and not any(n in name for n in names):
            continue
        start = time.time()
        try:
            if name in checks.ORACLES:
                ok, note = compare(spark, con, sf, fn, checks.ORACLES[name])
            else:
                ok, note = True, f"{len(fn(spark, sf).toPandas())} rows, no SQL"
        except Exception as error:  # noqa: BLE001
            ok, note = False, f"{type(error).__name__}: {str(error)[:1500]}"
        failed += not ok
        print(f"{'ok  ' if ok else 'FAIL'} {name:32s} {time.time() - start:6.2f}s {note}", flush=True)
    print(f"{failed} failed")
    return failed


if __name__ == "__main__":
    sys.exit(1 if main(sys.argv[1:]) else 0)
