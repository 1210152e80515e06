from __future__ import annotations

from pyspark.sql import functions as F

from framespan.sources import readers, writers


def test_scenes_are_exported_without_spark_files_and_read_back(spark, tmp_path):
    turn = F.array(*[F.lit(float(x)) for x in (1, 0, 0, 0, 1, 0, 0, 0, 1)])
    rows = spark.range(300).select((F.col("id") % 60).alias("scene"), (300 - F.col("id")).alias("frame_id"), turn.alias("r"), F.array(F.col("id").cast("double"), F.lit(1.0), F.lit(2.0)).alias("t"))
    writers.export_scene({"poses": rows, "old": rows.limit(3)}, str(tmp_path / "e"))
    writers.export_scene({"poses": rows}, str(tmp_path / "e"))  # a second export replaces the first
    assert sorted(p.name for p in (tmp_path / "e").iterdir()) == ["old", "poses", "trajectory"]
    assert not list((tmp_path / "e").rglob("*.crc"))
    assert spark.read.parquet(str(tmp_path / "e" / "poses")).count() == 300
    back = readers.scan_trajectories(spark, str(tmp_path / "e" / "trajectory"), "scalar_first")
    got = sorted((r.seq, r.ts, r.t[0]) for r in back.collect())
    assert got == sorted((f"scene={k % 60}", 300.0 - k, float(k)) for k in range(300))
    per_file = {(r.seq, r.pos): r.ts for r in back.collect()}
    assert all(per_file[s, p] > per_file[s, p - 1] for s, p in per_file if p and (s, p - 1) in per_file)
