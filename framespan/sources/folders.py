"""Tables as many small files: a folder per key, written by the tasks themselves.

Spark's writers pay for every file twice: processes that set its permissions, and moves that the driver makes one by one.
On a mounted file system the tasks write the same layout (``key=value`` folders, one file per task and folder) into a hidden
folder beside the target; a new target is then one rename, and the folders of one that exists are moved by tasks. Stores
that only Spark reaches are written by Spark.
"""

from __future__ import annotations

import os
import shutil
import uuid
from collections.abc import Sequence
from contextlib import contextmanager
from itertools import groupby

from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from framespan.session import cut

#: Rows of a folder that are written at once.
ROWS_AT_ONCE = 100_000
#: Bytes of small files that one task reads.
BYTES_PER_TASK = 64 << 20
NO_VALUE = "__HIVE_DEFAULT_PARTITION__"
_ESCAPED = {c: f"%{ord(c):02X}" for c in [*map(chr, range(1, 32)), *"\"#%'*/:=?\\\x7f{[]^"]}


def mounted(spark: SparkSession, path: str) -> str | None:
    """The path for ordinary file access, ``None`` in a store that only Spark reaches."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    uri = place.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).makeQualified(place).toUri()
    return uri.getPath().rstrip("/") if uri.getScheme() == "file" else None


def folder_name(by: Sequence[str], key: Sequence[str]) -> str:
    """``a=1/b=2`` with the characters escaped that Spark escapes."""
    return "/".join(f"{b.translate(str.maketrans(_ESCAPED))}={k.translate(str.maketrans(_ESCAPED))}" for b, k in zip(by, key))


class _Sink:
    """One file of a folder; it has its name only when it is whole."""

    def __init__(self, folder: str, name: str, fmt: str, schema):
        os.makedirs(folder, exist_ok=True)
        self.path, self.part = f"{folder}/{name}", f"{folder}/.{name}-{uuid.uuid4().hex}"
        self.fmt, self.schema, self.held, self.rows, self.out = fmt, schema, [], 0, None

    def add(self, batch) -> None:
        self.held.append(batch)
        self.rows += batch.num_rows
        if self.rows >= ROWS_AT_ONCE:
            self.flush()

    def flush(self) -> None:
        if self.fmt == "text":
            self.out = self.out or open(self.part, "w", encoding="utf-8", newline="")
            self.out.writelines(f"{x or ''}\n" for batch in self.held for x in batch.column(0).to_pylist())
        else:
            import pyarrow as pa
            import pyarrow.parquet as pq

            self.out = self.out or pq.ParquetWriter(self.part, self.schema, compression="snappy", store_schema=False)
            self.out.write_table(pa.Table.from_batches(self.held).cast(self.schema))
        self.held, self.rows = [], 0

    def close(self) -> None:
        if self.held:
            self.flush()
        self.out.close()
        os.replace(self.part, self.path)


def _written(stage: str, by: list[str], fmt: str, job: str, metadata: dict):
    """Rows sorted by folder into files; yields the folders."""

    def run(batches):
        import pyarrow as pa

        name = f"part-{TaskContext.get().partitionId():05d}-{job}.{'txt' if fmt == 'text' else 'snappy.parquet'}"
        sink, last, folders = None, None, []
        for batch in batches:
            n = len(by)
            rows = pa.RecordBatch.from_arrays(batch.columns[n:], schema=pa.schema(list(batch.schema)[n:]))
            at = 0
            for key, same in groupby(zip(*[batch.column(k).to_pylist() for k in range(n)])):
                size = sum(1 for _ in same)
                if key != last:
                    if sink:
                        sink.close()
                    folders.append(folder_name(by, key))
                    sink, last = _Sink(f"{stage}/{folders[-1]}", name, fmt, rows.schema.with_metadata(metadata)), key
                sink.add(rows.slice(at, size))
                at += size
        if sink:
            sink.close()
        yield pa.RecordBatch.from_pydict({"folder": pa.array(folders, pa.string())})

    return run


def _moved(stage: str, target: str, job: str):
    """Folders of the stage in the place of those of the target."""

    def run(batches):
        for batch in batches:
            for folder in batch.column(0).to_pylist():
                old, new = f"{target}/{folder}", f"{stage}/{folder}"
                os.makedirs(old, exist_ok=True)
                for x in os.scandir(old):
                    if job not in x.name:
                        shutil.rmtree(x.path) if x.is_dir(follow_symlinks=False) else os.unlink(x.path)
                for x in os.listdir(new):
                    os.replace(f"{new}/{x}", f"{old}/{x}")
            yield batch

    return run


def write_folders(df: DataFrame, path: str, by: Sequence[str], fmt: str = "parquet", dynamic: bool = False, order: Sequence[str] = ()) -> None:
    """The rows in one folder per value of ``by``, those of a folder and task in one file, in ``order`` (columns that are not written).

    What the path held is replaced: all of it, or with ``dynamic`` the folders that get rows.
    """
    by, spark = list(by), df.sparkSession
    target = mounted(spark, path)
    if target is None:
        sorted_rows = df.sortWithinPartitions(*by, *order).drop(*order) if order else df
        writer = sorted_rows.write.mode("overwrite").partitionBy(*by)
        writer = writer.option("partitionOverwriteMode", "dynamic" if dynamic else "static")
        writer.format(fmt).save(path)
        return
    rest = df.drop(*by, *order)
    keys = {f"_key{i}": F.coalesce(F.nullif(F.col(b).cast("string"), F.lit("")), F.lit(NO_VALUE)) for i, b in enumerate(by)}
    placed = df.withColumns(keys).sortWithinPartitions(*keys, *order).select(*keys, *rest.columns)
    job = uuid.uuid4().hex
    stage = f"{os.path.dirname(target)}/.{os.path.basename(target)}-{job}"
    os.makedirs(stage)
    metadata = {"org.apache.spark.version": spark.version, "org.apache.spark.sql.parquet.row.metadata": rest.schema.json()}
    folders = placed.mapInArrow(_written(stage, by, fmt, job, metadata), "folder string")
    try:
        if dynamic and os.path.exists(target):
            cut(folders).distinct().mapInArrow(_moved(stage, target, job), "folder string").write.format("noop").mode("overwrite").save()
        else:
            folders.write.format("noop").mode("overwrite").save()
            if os.path.exists(target):
                os.rename(target, old := f"{stage}-old")
                os.rename(stage, target)
                shutil.rmtree(old)
            else:
                os.rename(stage, target)
    finally:
        shutil.rmtree(stage, ignore_errors=True)
    open(f"{target}/_SUCCESS", "w").close()
    spark.catalog.refreshByPath(path)


def _least_tasks(spark: SparkSession) -> int:
    return max(4 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))


@contextmanager
def listing(spark: SparkSession):
    """Within, Spark lists folders in as many tasks as there is work for; else every folder is a task of its own, up to 10,000."""
    name = "spark.sql.sources.parallelPartitionDiscovery.parallelism"
    before = spark.conf.get(name)
    spark.conf.set(name, str(min(int(before), _least_tasks(spark))))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def few_tasks(df: DataFrame) -> DataFrame:
    """A scan of many small files in fewer tasks, as its bytes and the cores ask for; Spark counts 4 MB for each file."""
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return df.coalesce(max(_least_tasks(df.sparkSession), -(-size // BYTES_PER_TASK)))
