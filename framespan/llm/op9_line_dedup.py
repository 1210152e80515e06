"""Line deduplication by range-partitioned hashes, streamed in order, with keep bitmaps as the result.

Lines are hashed to 128 bits, range-partitioned by (hash, document) and sorted by (hash, document,
position). One pass over each sorted partition counts the documents of every hash. A hash that ends
or starts at the edge of a batch may go on elsewhere: its rows are passed on undecided with their
share of the count, and a small join settles them. So a line that a third of all documents hold is
spread over as many partitions as its rows need, and no task ever holds a whole hash.

Only positions leave this stage: each document that loses lines gets a zlib-compressed bitmap of the
lines it keeps. Text is touched again only where a caller applies the bitmaps.

Defined results: a null or empty text is one empty line; lines whose key is empty always stay; a row
repeated in full is one document; equal ids with different texts are different documents; a null id is
a document like any other; an empty table gives an empty result; further columns pass
through, but for those named like a result column.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from framespan.llm.common import cut, packed, row_key, unpacked

MIN_DOCS = 10
MIN_CHARS = 1
SALTS = 32
#: The white space that a key loses at both ends.
BLANK = b"\x20\x09\x0a\x0b\x0c\x0d"

_LINES = "_h0 long, _h1 long, _k0 long, _k1 long, _pos int"
_FOUND = _LINES + ", _starts int, _settled boolean"


def _key_lines(min_chars: int):
    schema = pa.schema([("_h0", pa.int64()), ("_h1", pa.int64()), ("_k0", pa.int64()), ("_k1", pa.int64()), ("_pos", pa.int32())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            digests, rows, places = [], [], []

            def flush() -> pa.RecordBatch:
                h = np.frombuffer(b"".join(digests), dtype="<i8").reshape(-1, 2)
                at = np.array(rows, dtype=np.int64)
                k0, k1 = (batch.column(i).to_numpy(zero_copy_only=False)[at] for i in (1, 2))
                return pa.RecordBatch.from_arrays([pa.array(h[:, 0]), pa.array(h[:, 1]), pa.array(k0), pa.array(k1), pa.array(places, pa.int32())], schema=schema)

            for row, text in enumerate(batch.column(0)):
                text = text.as_py()
                for pos, line in enumerate((text or "").encode("utf-8", "surrogatepass").split(b"\n")):
                    key = line.strip(BLANK).lower()
                    if not key or (min_chars > 1 and len(key.decode("utf-8", "surrogatepass")) < min_chars):
                        continue
                    digests.append(hashlib.md5(key).digest())
                    rows.append(row)
                    places.append(pos)
                if len(rows) > 200_000:
                    yield flush()
                    digests, rows, places = [], [], []
            if rows:
                yield flush()

    return run


def _settle(min_docs: int):
    """Stream a sorted partition: rows of frequent lines, and undecided rows at the edges of a batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            h0, h1, k0, k1 = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(4))
            line = np.ones(n, bool)
            line[1:] = (h0[1:] != h0[:-1]) | (h1[1:] != h1[:-1])
            doc = line.copy()
            doc[1:] |= (k0[1:] != k0[:-1]) | (k1[1:] != k1[:-1])
            doc[0] = last != (h0[0], h1[0], k0[0], k1[0])
            last = (h0[-1], h1[-1], k0[-1], k1[-1])
            run_of = np.cumsum(line) - 1
            docs = np.bincount(run_of, weights=doc).astype(np.int64)
            edge = np.zeros(len(docs), bool)
            edge[[0, -1]] = True
            keep = np.flatnonzero(edge[run_of] | (docs >= min_docs)[run_of])
            if len(keep):
                picked = batch.take(pa.array(keep))
                yield pa.RecordBatch.from_arrays(
                    [*picked.columns, pa.array(doc[keep].astype(np.int32)), pa.array(~edge[run_of[keep]])],
                    names=["_h0", "_h1", "_k0", "_k1", "_pos", "_starts", "_settled"],
                )

    return run


def _to_bitmaps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        packed = []
        for places in batch.column(2):
            places = np.asarray(places.as_py(), dtype=np.int64)
            bits = np.ones(-(-(int(places.max()) + 1) // 8) * 8, np.uint8)
            bits[places] = 0
            packed.append(zlib.compress(np.packbits(bits).tobytes(), 6))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(packed, pa.binary())], names=["_k0", "_k1", "keep"])


def keep_bitmaps(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_docs: int = MIN_DOCS, min_chars: int = MIN_CHARS) -> DataFrame:
    """(_k0, _k1, keep) for each document that loses lines.

    ``keep`` is a zlib-compressed bit per line (first line = highest bit of the first byte), up to the
    byte of the last line lost; 0 marks a lost line and lines after the end stay.
    """
    keyed = docs.select(F.col(text_col).cast("string").alias("_t"), *row_key(F.col(id_col), F.coalesce(F.col(text_col), F.lit(""))))
    lines = cut(keyed.mapInArrow(_key_lines(min_chars), _LINES))
    order = ["_h0", "_h1", "_k0", "_k1"]
    found = cut(lines.repartitionByRange(*order).sortWithinPartitions(*order, "_pos").mapInArrow(_settle(min_docs), _FOUND))
    open_rows = found.where("not _settled")
    frequent = open_rows.groupBy("_h0", "_h1").agg(F.sum("_starts").alias("_n")).where(F.col("_n") >= min_docs).select("_h0", "_h1")
    # a line that very many documents hold has most of its rows here: both sides of the join are salted
    frequent = frequent.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    salted = open_rows.withColumn("_salt", F.pmod(F.col("_k0"), F.lit(SALTS)).cast("int"))
    late = salted.join(frequent, ["_h0", "_h1", "_salt"], "left_semi")
    lost = found.where("_settled").select("_k0", "_k1", "_pos").unionAll(late.select("_k0", "_k1", "_pos"))
    places = lost.groupBy("_k0", "_k1").agg(F.collect_set("_pos").alias("_places"))
    return places.mapInArrow(_to_bitmaps, "_k0 long, _k1 long, keep binary")


def _apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts, n_lines, n_dropped = [], [], []
        for text, packed_bits in zip(batch.column(0), batch.column(2)):
            text, packed_bits = text.as_py(), packed_bits.as_py()
            lines = (text or "").split("\n")
            n_lines.append(len(lines))
            if packed_bits is None:
                texts.append(text)
                n_dropped.append(0)
                continue
            bits = np.unpackbits(np.frombuffer(zlib.decompress(packed_bits), np.uint8))
            kept = [line for i, line in enumerate(lines) if i >= len(bits) or bits[i]]
            texts.append("\n".join(kept))
            n_dropped.append(len(lines) - len(kept))
        columns = [pa.array(texts, pa.string()), batch.column(1), pa.array(n_lines, pa.int64()), pa.array(n_dropped, pa.int64())]
        yield pa.RecordBatch.from_arrays(columns, names=["_t", "_rest", "_lines", "_dropped"])


def drop_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_docs: int = MIN_DOCS, min_chars: int = MIN_CHARS) -> DataFrame:
    """The documents without frequent lines: all columns, the text cut, and ``n_lines``, ``n_dropped``.

    The bitmaps are joined by row key, so a text moves once and no text is compared with another.
    """
    bitmaps = cut(keep_bitmaps(docs, id_col, text_col, min_docs, min_chars))
    joined = packed(docs, id_col, text_col).join(bitmaps.hint("shuffle_hash"), ["_k0", "_k1"], "left").select("_t", "_rest", "keep")
    schema = T.StructType([*joined.select("_t", "_rest").schema, T.StructField("_lines", T.LongType()), T.StructField("_dropped", T.LongType())])
    return unpacked(joined.mapInArrow(_apply, schema), docs.columns, text_col, n_lines=F.col("_lines"), n_dropped=F.col("_dropped"))


def line_report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_docs: int = MIN_DOCS, min_chars: int = MIN_CHARS) -> DataFrame:
    """Per document: lines, lines lost, and the SHA-256 of what stays."""
    narrow = docs.select(F.col(id_col), F.col(text_col))
    cleaned = drop_lines(narrow, id_col, text_col, min_docs, min_chars)
    return cleaned.select(
        id_col,
        "n_lines",
        "n_dropped",
        F.sha2(F.coalesce(F.col(text_col), F.lit("")), 256).alias("kept_sha256"),
    )
