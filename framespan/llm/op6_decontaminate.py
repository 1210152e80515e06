"""Benchmark decontamination with a positional inverted index that is partitioned by document.

Index: documents are packed into segments. A segment lists, for each test term it holds, the sorted
positions of that term (its postings) in the token stream of the segment; documents are set apart by a
gap, so no phrase crosses them. Segments are rows of a table in the shared folder. All postings of a
document lie in one segment, as in any document-partitioned search index, so lists are intersected
without a shuffle.

Phrase search: for each window of a test item, the posting lists are shifted by the term's offset and
intersected from the rarest list in the segment to the most frequent; windows with an absent term cost
nothing. Proximity search starts from the rarest list as well and asks each other term for a position
near by. Test items are handled in blocks of bounded size; each block gets its own broadcast and index.

Defined results: a null text has no words; an item without words matches nothing; rows repeated in full
get equal results; equal items are reported each under its own id; an empty table on either side gives no
matches; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framespan.llm.common import cut, remove, row_key, scratch, words_of

WINDOW = 13
#: Words of test items that one broadcast may hold; more items mean more blocks, not larger ones.
BLOCK_WORDS = 200_000
#: A segment is closed once it has this many words; a longer document is a segment of its own.
SEGMENT_WORDS = 1_000_000

_SEGMENT = pa.schema(
    [("k0", pa.binary()), ("k1", pa.binary()), ("first", pa.binary()), ("n_words", pa.binary()), ("terms", pa.binary()), ("starts", pa.binary()), ("postings", pa.binary())]
)
_SEGMENT_SQL = "k0 binary, k1 binary, first binary, n_words binary, terms binary, starts binary, postings binary"


def build_index(docs: DataFrame, id_col: str, text_col: str, vocabulary, gap: int, segment_words: int = SEGMENT_WORDS) -> DataFrame:
    """Segments (one row each) with the postings of the terms in the broadcast ``vocabulary``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = vocabulary.value
        ids, places, k0, k1, first, n_words, at = [], [], [], [], [], [], 0

        def flush() -> pa.RecordBatch:
            term = np.concatenate(ids) if ids else np.empty(0, np.int32)
            place = np.concatenate(places) if places else np.empty(0, np.int32)
            order = np.argsort(term, kind="stable")
            names, starts = np.unique(term[order], return_index=True)
            cols = [np.array(k0, np.int64), np.array(k1, np.int64), np.array(first, np.int32), np.array(n_words, np.int32), names.astype(np.int32), starts.astype(np.int32), place[order]]
            return pa.RecordBatch.from_arrays([pa.array([c.tobytes()], pa.binary()) for c in cols], schema=_SEGMENT)

        for batch in batches:
            key0, key1 = (batch.column(i).to_numpy(zero_copy_only=False) for i in (1, 2))
            for row, text in enumerate(batch.column(0)):
                words = words_of(text.as_py())
                found = np.fromiter(map(number.get, words, [-1] * len(words)), np.int32, len(words))
                hit = np.flatnonzero(found >= 0).astype(np.int32)
                if first and at + len(words) > segment_words:
                    yield flush()
                    ids, places, k0, k1, first, n_words, at = [], [], [], [], [], [], 0
                k0.append(key0[row])
                k1.append(key1[row])
                first.append(at)
                n_words.append(len(words))
                ids.append(found[hit])
                places.append(hit + np.int32(at))
                at += len(words) + gap
        if first:
            yield flush()

    keyed = docs.select(F.col(text_col).cast("string").alias("_t"), *row_key(F.col(id_col), F.coalesce(F.col(text_col), F.lit(""))))
    return keyed.mapInArrow(run, _SEGMENT_SQL)


class _Segment:
    """The arrays of one segment row."""

    def __init__(self, row: dict):
        self.k0, self.k1 = (np.frombuffer(row[c], np.int64) for c in ("k0", "k1"))
        self.first, self.n_words = (np.frombuffer(row[c], np.int32) for c in ("first", "n_words"))
        self.terms, self.starts = (np.frombuffer(row[c], np.int32) for c in ("terms", "starts"))
        self.postings = np.frombuffer(row["postings"], np.int32)
        self.ends = np.append(self.starts[1:], len(self.postings))

    def sizes(self, n_terms: int) -> np.ndarray:
        out = np.zeros(n_terms, np.int64)
        out[self.terms] = self.ends - self.starts
        return out

    def list_of(self, term: int) -> np.ndarray:
        i = np.searchsorted(self.terms, term)
        return self.postings[self.starts[i] : self.ends[i]]


def _phrase(segment: _Segment, terms: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Start positions of an exact phrase: shifted lists are intersected from the rarest on."""
    order = np.argsort(sizes[terms], kind="stable")
    starts = segment.list_of(terms[order[0]]) - order[0]
    for offset in order[1:]:
        other = segment.list_of(terms[offset])
        at = np.searchsorted(other, starts + offset)
        at[at == len(other)] = 0
        starts = starts[other[at] == starts + offset]
        if not len(starts):
            break
    return starts


def _near(segment: _Segment, terms: np.ndarray, sizes: np.ndarray, slop: int) -> np.ndarray:
    """(start, end) of every stretch of at most ``len(terms) + slop`` words that starts at one of the terms
    and holds all of them, each stretch cut at its last needed word; search starts from the rarest list."""
    distinct = np.unique(terms)
    distinct = distinct[np.argsort(sizes[distinct], kind="stable")]
    reach = len(terms) + slop
    starts = np.unique(segment.list_of(distinct[0])[:, None] - np.arange(reach))
    low = np.full(len(starts), np.iinfo(np.int64).max)
    high = np.zeros(len(starts), np.int64)
    for term in distinct:
        other = segment.list_of(term)
        at = np.searchsorted(other, starts)
        nearest = other[np.minimum(at, len(other) - 1)]
        ok = (at < len(other)) & (nearest - starts < reach)
        starts, low, high = starts[ok], np.minimum(low[ok], nearest[ok]), np.maximum(high[ok], nearest[ok])
    ok = low == starts
    return np.stack([starts[ok], high[ok] + 1], 1)


def _windows(items: list[tuple], number: dict[bytes, int], window: int) -> list[tuple]:
    """(item_id, [term ids of one window, ...]) for the items that have words."""
    out = []
    for item, text in items:
        ids = np.array([number[w] for w in words_of(text)], np.int32)
        if len(ids):
            size = min(window, len(ids))
            out.append((item, np.lib.stride_tricks.sliding_window_view(ids, size)))
    return out


_MATCH_SQL = "_k0 long, _k1 long, item_id long, start int, end int"


def _search(query, n_terms: int, slop: int | None):
    schema = pa.schema([("_k0", pa.int64()), ("_k1", pa.int64()), ("item_id", pa.int64()), ("start", pa.int32()), ("end", pa.int32())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                segment = _Segment({name: batch.column(i)[row].as_py() for i, name in enumerate(_SEGMENT.names)})
                sizes = segment.sizes(n_terms)
                doc_at, item_of, begin, stop = [], [], [], []
                for item, windows in query.value:
                    alive = np.flatnonzero(sizes[windows].min(1) > 0)
                    spans = []
                    for w in alive:
                        if slop is None:
                            s = _phrase(segment, windows[w], sizes)
                            spans.append(np.stack([s, s + windows.shape[1]], 1))
                        else:
                            spans.append(_near(segment, windows[w], sizes, slop))
                    found = np.concatenate(spans) if spans else np.empty((0, 2), np.int64)
                    if not len(found):
                        continue
                    found = found[np.lexsort((found[:, 1], found[:, 0]))]
                    reach = np.maximum.accumulate(found[:, 1])
                    new = np.append(True, found[1:, 0] > reach[:-1])
                    a = found[new, 0]
                    b = reach[np.append(np.flatnonzero(new)[1:] - 1, len(found) - 1)]
                    d = np.searchsorted(segment.first, a, side="right") - 1
                    doc_at.append(d)
                    begin.append(a - segment.first[d])
                    stop.append(b - segment.first[d])
                    item_of.append(np.full(len(a), item, np.int64))
                if doc_at:
                    d = np.concatenate(doc_at)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(segment.k0[d]), pa.array(segment.k1[d]), pa.array(np.concatenate(item_of)), pa.array(np.concatenate(begin).astype(np.int32)), pa.array(np.concatenate(stop).astype(np.int32))],
                        schema=schema,
                    )

    return run


def _doc_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in range(batch.num_rows):
            k0, k1 = (np.frombuffer(batch.column(i)[row].as_py(), np.int64) for i in (0, 1))
            n = np.frombuffer(batch.column(2)[row].as_py(), np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(k0), pa.array(k1), pa.array(n.astype(np.int64))], names=["_k0", "_k1", "n_words"])


def matches(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", window: int = WINDOW, slop: int | None = None, block_words: int = BLOCK_WORDS) -> tuple[DataFrame, DataFrame]:
    """(matches, words): the spans of documents that windows of the items cover, and words per document.

    ``matches``: _k0, _k1 (document), item_id, start, end (word positions, end exclusive), overlapping spans
    of one item merged. ``slop`` None means exact phrases; a number asks for all terms of the window within
    that many extra positions. ``words``: _k0, _k1, n_words for every row of ``docs``.
    """
    spark = docs.sparkSession
    test = items.select(F.col(item_col).cast("long").alias("item"), F.col(item_text).cast("string").alias("text")).where("text is not null and item is not null")
    size = test.agg(F.coalesce(F.sum(F.length("text") / 2 + 1), F.lit(0))).first()[0]
    n_blocks = max(1, int(-(-size // block_words)))
    found = counts = None
    for block in range(n_blocks):
        rows = [(r.item, r.text) for r in test.where(F.pmod(F.xxhash64("item", "text"), F.lit(n_blocks)) == block).collect()]
        number = {w: i for i, w in enumerate(sorted({w for _, text in rows for w in words_of(text)}))}
        query = _windows(rows, number, window)
        vocabulary, windows = spark.sparkContext.broadcast(number), spark.sparkContext.broadcast(query)
        path = scratch(spark, "postings")
        build_index(docs, id_col, text_col, vocabulary, window + (slop or 0)).write.parquet(path)
        index = spark.read.schema(_SEGMENT_SQL).parquet(path)
        part = cut(index.mapInArrow(_search(windows, max(1, len(number)), slop), _MATCH_SQL))
        found = part if found is None else found.unionAll(part)
        if counts is None:
            counts = cut(index.select("k0", "k1", "n_words").mapInArrow(_doc_words, "_k0 long, _k1 long, n_words long"))
        remove(spark, path)
    return found, counts


def contamination(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", window: int = WINDOW, one_in: int = 20) -> DataFrame:
    """One row per document row: id, _k0, _k1, n_words, n_hit, n_items, items_sha256, contaminated.

    A document is contaminated when at least one word in ``one_in`` lies inside an exact window.
    """
    found, counts = matches(docs, items, id_col, text_col, item_col, item_text, window)
    spans = F.array_sort(F.collect_set(F.struct("start", "end")))
    covered = F.aggregate(
        spans,
        F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).alias("to")),
        lambda a, s: F.struct(
            (a["n"] + F.greatest(F.lit(0), s["end"] - F.greatest(s["start"], a["to"]))).cast("long").alias("n"), F.greatest(a["to"], s["end"]).alias("to")
        ),
    )
    per_doc = found.groupBy("_k0", "_k1").agg(covered["n"].alias("n_hit"), F.sort_array(F.collect_set(F.col("item_id").cast("string"))).alias("_items"))
    ids = docs.select(F.col(id_col), *row_key(F.col(id_col), F.coalesce(F.col(text_col), F.lit(""))))
    joined = ids.join(counts.distinct(), ["_k0", "_k1"], "left").join(per_doc, ["_k0", "_k1"], "left")
    n_hit, n_words = F.coalesce("n_hit", F.lit(0).cast("long")), F.coalesce("n_words", F.lit(0).cast("long"))
    listed = F.coalesce("_items", F.array().cast("array<string>"))
    return joined.select(
        id_col,
        "_k0",
        "_k1",
        n_words.alias("n_words"),
        n_hit.alias("n_hit"),
        F.size(listed).cast("long").alias("n_items"),
        F.sha2(F.array_join(listed, ","), 256).alias("items_sha256"),
        ((n_hit > 0) & (one_in * n_hit >= n_words)).alias("contaminated"),
    )
