from __future__ import annotations

import datetime as dt
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from framespan.plans import checks_scenes
from framespan.plans.registry import QUERIES
from framespan.sources import folders, readers, writers
from tests.test_growth import conf

ODD = ["a b", "x/y=1%", "ü:*?[{", "", None, "q'\"\\#"]


def _tree(path, pattern):
    return sorted(str(p.relative_to(path).parent) for p in path.glob(pattern) if not p.name.startswith("."))


@pytest.fixture
def odd(spark):
    rows = [(s, k % 2, k, Decimal("1.25") * k, dt.datetime(1500 + k, 1, 2, 3), dt.date(1400 + k, 1, 1), [k, None], {"a": k}, b"\x00", None if k == 2 else "t") for k, s in enumerate(ODD * 2)]
    return spark.createDataFrame(rows, "scene string, window_id long, k long, d decimal(10,2), ts timestamp, day date, l array<int>, m map<string,int>, b binary, t string")


def test_folders_are_those_of_spark(spark, odd, tmp_path):
    odd.repartition(3).write.partitionBy("scene", "window_id").parquet(str(tmp_path / "spark"))
    folders.write_folders(odd.repartition(1), str(tmp_path / "own"), ["scene", "window_id"])
    assert _tree(tmp_path / "own", "*/*/*.parquet") == sorted(set(_tree(tmp_path / "spark", "*/*/*.parquet")))
    assert not list(tmp_path.rglob("*.crc")) or not list((tmp_path / "own").rglob("*.crc"))
    back, want = (spark.read.parquet(str(tmp_path / p)) for p in ("own", "spark"))
    assert back.schema == want.schema
    assert sorted(map(str, back.collect())) == sorted(map(str, want.collect()))


def test_windows_replace_their_own_folders_only(spark, odd, tmp_path):
    path = str(tmp_path / "w")
    odd.write.partitionBy("scene", "window_id").parquet(path)
    writers.write_windows(odd.where("k = 1").withColumn("k", F.lit(100)), path)
    assert sorted(r.k for r in writers.read_windows(spark, path).collect()) == [0, *range(2, 7), *range(8, 12), 100]
    assert [p.name for p in tmp_path.iterdir()] == ["w"]
    folders.write_folders(odd.where("k < 2"), path, ["scene"])
    assert sorted(r.k for r in spark.read.parquet(path).collect()) == [0, 1]


def test_a_failed_write_leaves_the_target(spark, odd, tmp_path):
    path = str(tmp_path / "w")
    writers.write_windows(odd, path)
    with pytest.raises(Exception, match="stop"):
        writers.write_windows(odd.withColumn("k", F.when(F.col("k") == 5, F.raise_error(F.lit("stop")).cast("long")).otherwise(0)), path)
    assert sorted(r.k for r in writers.read_windows(spark, path).collect()) == list(range(12))
    assert [p.name for p in tmp_path.iterdir()] == ["w"]


def test_a_folder_is_written_in_pieces_and_in_order(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(folders, "ROWS_AT_ONCE", 7)
    rows = spark.range(100).select((F.col("id") % 3).alias("scene"), (-F.col("id")).alias("frame_id"), F.when(F.col("id") != 9, F.col("id").cast("string")).alias("value"))
    folders.write_folders(rows.repartition(1), str(tmp_path / "t"), ["scene"], "text", order=["frame_id"])
    text = [p.read_text() for p in (tmp_path / "t" / "scene=0").iterdir()]
    assert text == ["".join(f"{'' if k == 9 else k}\n" for k in range(99, -1, -3))]


def test_many_small_files_take_few_tasks(spark, tmp_path):
    rows = spark.range(100).select(F.lit("s").alias("scene"), F.col("id").alias("window_id"), F.col("id").alias("frame_id"))
    writers.write_windows(rows, str(tmp_path / "w"))
    folders.write_folders(rows.select("window_id", F.lit("1 0 0 7 0 1 0 8 0 0 1 9 0 0 0 1").alias("value")), str(tmp_path / "t"), ["window_id"], "text")
    with conf(spark, spark__sql__files__maxPartitionBytes="4m"):
        before = spark.conf.get("spark.sql.sources.parallelPartitionDiscovery.parallelism")
        back = writers.read_windows(spark, str(tmp_path / "w"))
        assert back.rdd.getNumPartitions() <= 32 and back.count() == 100
        assert readers._lines(spark, str(tmp_path / "t")).rdd.getNumPartitions() <= 32
        assert readers.scan_trajectories(spark, str(tmp_path / "t"), "replica").count() == 100
        assert spark.conf.get("spark.sql.sources.parallelPartitionDiscovery.parallelism") == before


def test_annotation_files_hold_many_sequences(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(checks_scenes, "_folder", lambda _: str(tmp_path / "a"))
    rows = [(k, 1 + k % 2, k % 40, 2.0, 0.5, 0.25, float(k)) for k in range(400)]
    names = "l_orderkey long, l_linenumber int, l_suppkey long, l_quantity double, l_tax double, l_discount double, l_extendedprice double"
    spark.createDataFrame(rows, names).write.parquet(str(tmp_path / "lineitem.parquet"))
    out = {r.seq: (r.n, r.tx, r.focal) for r in QUERIES["scan_annotations"](spark, str(tmp_path)).collect()}
    assert out == {f"c{s}": (10, 20.0, 360.0 + s) for s in range(40)}
    assert len([p for p in (tmp_path / "a").rglob("part-*")]) == 2
    read = readers.scan_annotations(spark, str(tmp_path / "a"))
    assert sorted(r.filepath for r in read.collect()) == sorted(f"{k}.jpg" for k in range(400))
    assert {r.pos for r in read.collect()} == set(range(10))


def test_reports_are_written_without_spark_files(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(checks_scenes, "_folder", lambda _: str(tmp_path / "r"))
    spark.createDataFrame([(k % 50, float(k)) for k in range(100)], "user_id long, value double").write.parquet(str(tmp_path / "events.parquet"))
    out = {(r.seq, r.ate, r.rpe_trans, r.rpe_rot) for r in QUERIES["scan_metric_reports"](spark, str(tmp_path)).collect()}
    assert out == {(f"s{k}", 50.0 + k, float(k), 0.0) for k in range(50)}
    assert len(list((tmp_path / "r").glob("seq=*/part-*.txt"))) == 50 and not list((tmp_path / "r").rglob("*.crc"))


def test_other_stores_are_written_by_spark(spark, odd, tmp_path, monkeypatch):
    monkeypatch.setattr(folders, "mounted", lambda *_: None)
    path = str(tmp_path / "w")
    writers.write_windows(odd, path)
    writers.write_windows(odd.where("k = 1").withColumn("k", F.lit(100)), path)
    assert sorted(r.k for r in writers.read_windows(spark, path).collect()) == [0, *range(2, 7), *range(8, 12), 100]
    rows = spark.range(9).select((F.col("id") % 3).alias("scene"), (-F.col("id")).alias("frame_id"), F.col("id").cast("string").alias("value"))
    folders.write_folders(rows.repartition(1), str(tmp_path / "t"), ["scene"], "text", order=["frame_id"])
    assert [p.read_text() for p in (tmp_path / "t" / "scene=0").glob("part-*")] == ["6\n3\n0\n"]
