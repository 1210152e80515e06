"""Structured Streaming: window assembly, registration and sinks."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from framespan.functions.rotations import rotation_of
from framespan.schemas import VEC

FRAME_STREAM = "scene string, frame_id long, ts timestamp, end boolean"
WINDOWS = "scene string, window_id long, pos long, frame_id long"


def frame_stream(spark: SparkSession, path: str, schema: str = FRAME_STREAM, files_per_batch: int = 1) -> DataFrame:
    """Frames arriving as Parquet files. A row with ``end`` set closes its scene."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def drop_repeats(frames: DataFrame, delay: str = "10 minutes") -> DataFrame:
    """Watermark the stream and drop frames that arrive twice inside it; later rows are dropped by
    Spark; ``late_frames`` keeps them."""
    return frames.withWatermark("ts", delay).dropDuplicatesWithinWatermark(["scene", "frame_id", "end"])


def _release(pending: list, until: float | None) -> tuple[list, list]:
    """Frames whose order is settled (at or before the watermark), and the rest."""
    ordered = sorted(pending)
    if until is None:
        return ordered, []
    cut = [p for p in ordered if p[0] <= until]
    return cut, ordered[len(cut) :]


def _window_step(size: int, overlap: int) -> Callable:
    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        """Per scene: frames waiting for the watermark, the open window, its number and whether it starts anew.

        At most one window plus the frames inside the watermark delay are kept; after an end row or a
        time-out only the number is, so that later frames never reuse the number of a stored window.
        """
        times, ids, buffer, number, fresh = state.get if state.exists else ([], [], [], 0, True)
        pending = list(zip(times, ids))
        buffer, ended, out = list(buffer), False, []

        def emit() -> None:
            nonlocal number, buffer, fresh
            out.extend((key[0], number, pos, frame) for pos, frame in enumerate(buffer[:size]))
            number, fresh = number + 1, False
            buffer = buffer[size - overlap :]

        if state.hasTimedOut:
            ended = True
        else:
            for pdf in batches:
                ended = ended or bool(pdf["end"].fillna(False).any())
                rows = pdf[~pdf["end"].fillna(False).astype(bool)]
                micros = rows["ts"].astype("datetime64[us]").astype("int64").tolist()
                pending += [(int(t), int(i)) for t, i in zip(micros, rows["frame_id"])]
        ready, rest = _release(pending, None if ended else state.getCurrentWatermarkMs() * 1000.0)
        for _, frame in ready:
            buffer.append(frame)
            if len(buffer) == size:
                emit()
        if ended:
            if buffer and (fresh or len(buffer) > overlap):
                emit()
            state.update(([], [], [], number, True))
        else:
            state.update(([int(t) for t, _ in rest], [i for _, i in rest], buffer, number, fresh))
            # an idle scene flushes once the watermark has passed its newest frame
            newest = max([t for t, _ in rest], default=None)
            mark = max(state.getCurrentWatermarkMs() + 1, (newest or 0) // 1000 + 1)
            state.setTimeoutTimestamp(mark + idle_ms)
        yield pd.DataFrame(out, columns=["scene", "window_id", "pos", "frame_id"])

    idle_ms = 24 * 3600 * 1000
    return run


def assemble_windows(frames: DataFrame, size: int, overlap: int) -> DataFrame:
    """Streaming form of ``assign_windows``: (scene, window_id, pos, frame_id).

    Needs a watermark on ``ts``. Frames are ordered by time inside the watermark delay; a full
    window is emitted and its last ``overlap`` frames are kept. The tail window appears when the
    scene's end row arrives, or after a day of event time without frames. Frames that come after that
    start a new run of windows, whose numbers go on from the last.
    """
    if not 0 <= overlap < size:
        raise ValueError("window size must be larger than the overlap")
    kept = T.StructType(
        [
            T.StructField("times", T.ArrayType(T.LongType())),
            T.StructField("ids", T.ArrayType(T.LongType())),
            T.StructField("buffer", T.ArrayType(T.LongType())),
            T.StructField("number", T.LongType()),
            T.StructField("fresh", T.BooleanType()),
        ]
    )
    return frames.groupBy("scene").applyInPandasWithState(
        _window_step(size, overlap), WINDOWS, kept, "append", GroupStateTimeout.EventTimeTimeout
    )


# --- registration of scored windows ----------------------------------------------------------------

SCORED = "scene string, window_id long, size long, pos long, frame_id long, x array<double>, y array<double>, z array<double>, conf array<double>, r array<double>, t array<double>"
RELATIVE = T.StructType(
    [
        T.StructField("scene", T.StringType()),
        T.StructField("window_id", T.LongType()),
        T.StructField("s", T.DoubleType()),
        T.StructField("r", VEC),
        T.StructField("t", VEC),
        T.StructField("status", T.StringType()),
    ]
)


def _nearest_cut(conf: np.ndarray, q: float) -> float:
    """Element at the rank nearest to the q-quantile."""
    rank = int(np.rint((conf.size - 1) * q))
    return float(np.partition(conf, rank)[rank])


def _scale_of_products(aa: np.ndarray, ab: np.ndarray, bb: np.ndarray, passes: int = 10, settled: float = 0.05) -> float:
    """Robust scale from three products per point pair: ⟨a,a⟩, ⟨a,b⟩, ⟨b,b⟩.

    The residual of a pair at scale s is sqrt(s²·aa − 2s·ab + bb), so the points themselves are not needed.
    """
    scale = max(ab.sum() / aa.sum(), 1e-6)
    for _ in range(passes):
        weight = 1.0 / (np.sqrt(np.maximum(scale * scale * aa - 2 * scale * ab + bb, 0.0)) + 1e-8)
        before, scale = scale, max((weight @ ab) / (weight @ aa), 1e-6)
        if abs(scale - before) < settled:
            break
    return float(scale)


def _pose_moments(src: pd.DataFrame, dst: pd.DataFrame, scale: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Cross moments of camera positions and of the tips of their up and backward axes, and both centroids.

    With centred positions P, Q and axis differences D = up − view, the tips add up to
    3·PᵀQ + PᵀD' + DᵀQ + viewᵀview' + upᵀup'.
    """
    (p, up, view), (q, up2, view2) = (
        (np.stack(d["t"].to_numpy()), *(np.stack(d["r"].to_numpy()).reshape(-1, 3, 3)[:, :, k] for k in (1, 2))) for d in (src, dst)
    )
    p = scale * p
    mean_p, mean_q = p.mean(axis=0), q.mean(axis=0)
    p, q = p - mean_p, q - mean_q
    moments = 3 * p.T @ q + p.T @ (up2 - view2) + (up - view).T @ q + view.T @ view2 + up.T @ up2
    return moments, mean_p, mean_q


def _packed(rows: pd.DataFrame) -> bytes:
    """Arrow stream of the rows: the state keeps exact doubles without text."""
    table = pa.Table.from_pandas(rows, preserve_index=False)
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema) as writer:
        writer.write_table(table)
    return sink.getvalue().to_pybytes()


def _unpacked(blob: bytes) -> pd.DataFrame:
    return pa.ipc.open_stream(blob).read_pandas()


def _registration_step(overlap: int, q: float) -> Callable:
    fields = ["frame_id", "x", "y", "z", "conf", "r", "t"]
    no_fit = (None, None, None)

    def register(prev: pd.DataFrame, cur: pd.DataFrame) -> tuple:
        """(s, r, t, status) of a window against its predecessor; degenerate overlaps get a status, not an error."""
        both = prev.merge(cur, on="frame_id", suffixes=("_p", "_c")).sort_values("frame_id")
        if both.empty:
            return *no_fit, "no_overlap"

        def grid(c: str) -> np.ndarray:
            return np.concatenate([np.asarray(v, dtype=float) for v in both[c]])

        cp, cc = grid("conf_p"), grid("conf_c")
        known_p, known_c = cp[~np.isnan(cp)], cc[~np.isnan(cc)]
        if not (known_p.size and known_c.size):
            return *no_fit, "no_points"
        keep = (cp >= _nearest_cut(known_p, q)) & (cc >= _nearest_cut(known_c, q))
        a, b = (np.stack([grid(f"{axis}_{side}") for axis in "xyz"], axis=1)[keep] for side in "cp")
        products = [np.einsum("ij,ij->i", x, y) for x, y in ((a, a), (a, b), (b, b))]
        if not products[0].sum() > 0:
            return *no_fit, "no_points"
        scale = _scale_of_products(*products)
        ends = [both.rename(columns={f"r_{k}": "r", f"t_{k}": "t"})[["r", "t"]] for k in "cp"]
        moments, mean_c, mean_p = _pose_moments(*ends, scale)
        rotation, rank = rotation_of(moments)
        if rank < 2:
            return *no_fit, "degenerate"
        return scale, rotation.reshape(-1).tolist(), (mean_p - rotation @ mean_c).tolist(), "ok"

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        """State per scene: rows of windows not complete yet, and the overlap of the last window done."""
        nxt, tail, waiting = state.get if state.exists else (0, b"", b"")
        early = [_unpacked(waiting)] if waiting else []
        rows = pd.concat([*early, *batches])
        out = []
        while True:
            window = rows[rows["window_id"] == nxt]
            if window.empty or len(window) < int(window["size"].iloc[0]):
                break
            window = window.sort_values("pos")
            if nxt == 0:
                fit = 1.0, np.eye(3).reshape(-1).tolist(), [0.0, 0.0, 0.0], "ok"
            else:
                fit = register(_unpacked(tail), window[window["pos"] < overlap][fields])
            out.append((key[0], int(nxt), *fit))
            tail = _packed(window.iloc[len(window) - min(overlap, len(window)) :][fields])
            rows = rows[rows["window_id"] != nxt]
            nxt += 1
        state.update((int(nxt), tail, _packed(rows) if len(rows) else b""))
        yield pd.DataFrame(out, columns=[f.name for f in RELATIVE])

    return run


def register_stream(scored: DataFrame, overlap: int, q: float = 0.7) -> DataFrame:
    """Relative similarity of each scored window to its predecessor, as windows arrive.

    Input rows are frames of scored windows (``SCORED``; ``size`` is the frame count of the window).
    The state holds only the overlap of the last window and windows that came early. Windows that
    cannot be registered keep a row with NULLs and a ``status`` other than ``ok``.
    """
    kept = T.StructType(
        [T.StructField("nxt", T.LongType()), T.StructField("tail", T.BinaryType()), T.StructField("waiting", T.BinaryType())]
    )
    return scored.groupBy("scene").applyInPandasWithState(_registration_step(overlap, q), RELATIVE, kept, "append", GroupStateTimeout.NoTimeout)


# --- sinks -------------------------------------------------------------------------------------------


def latency_totals(spark: SparkSession, path: str) -> Callable[[DataFrame, int], None]:
    """``foreachBatch`` function keeping count, sum and maximum latency per scene and batch.

    Rewriting a batch replaces its own folder, so a retried batch is not counted twice.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        sums = batch.groupBy("scene").agg(F.count(F.lit(1)).alias("n"), F.sum("ms").alias("total_ms"), F.max("ms").alias("max_ms"))
        sums.withColumn("batch_id", F.lit(batch_id)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch_id").parquet(path)

    return write


def latency_summary(spark: SparkSession, path: str) -> DataFrame:
    rows = spark.read.parquet(path)
    return rows.groupBy("scene").agg(F.sum("n").alias("n"), (F.sum("total_ms") / F.sum("n")).alias("mean_ms"), F.max("max_ms").alias("max_ms"))


def late_frames(spark: SparkSession, path: str, delay: str = "10 minutes") -> Callable[[DataFrame, int], None]:
    """``foreachBatch`` function that keeps the frames which a watermark of ``delay`` discards, with a reason.

    Spark judges lateness in a batch by the watermark of the batch before it: the latest time of all batches
    but the last two, less the delay. Latest times are kept
    under ``path``/marks, one file set per batch, so a retried batch gives the same rows; the rejected frames
    are under ``path``/late.
    """
    marks, late = f"{path}/marks", f"{path}/late"

    def write(batch: DataFrame, batch_id: int) -> None:
        where = spark._jvm.org.apache.hadoop.fs.Path(marks)
        known = where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where)
        newest = spark.read.parquet(marks).where(F.col("batch_id") < batch_id - 1).agg(F.max("ts")).first()[0] if known else None
        seen = batch.agg(F.max("ts").alias("ts")).withColumn("batch_id", F.lit(batch_id))
        overwrite = {"partitionOverwriteMode": "dynamic"}
        if newest is not None:
            behind = batch.where(F.col("ts") <= F.lit(newest) - F.expr(f"INTERVAL {delay}")).withColumn("reason", F.lit("late"))
            behind.withColumn("batch_id", F.lit(batch_id)).write.mode("overwrite").options(**overwrite).partitionBy("batch_id").parquet(late)
        seen.write.mode("overwrite").options(**overwrite).partitionBy("batch_id").parquet(marks)

    return write


def window_sink(path: str) -> Callable[[DataFrame, int], None]:
    """``foreachBatch`` function that replaces the (scene, window_id) folders of the batch only."""
    from framespan.sources.writers import write_windows

    def write(batch: DataFrame, batch_id: int) -> None:
        write_windows(batch, path)

    return write


def run_available(df: DataFrame, checkpoint: str, sink: Callable[[DataFrame, int], None]) -> None:
    """Process everything that is available, then stop (end of a bounded stream)."""
    query = df.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
