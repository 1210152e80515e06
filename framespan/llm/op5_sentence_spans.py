"""Substring deduplication with sliding spans of sentences.

Texts are cut into sentences (after . ! ? … and white space, and at line ends). A run of consecutive sentences
counts from ``SENTENCES`` of them and ``SPAN_WORDS`` words on, from two and ``PAIR_WORDS``, or from ``LONG_WORDS``.
The first occurrence (by document, then position) of each such run stays, and every sentence that another
occurrence covers is removed, with the white space after it.

Hashed are the shortest run that starts at each sentence and the shortest run that ends at each. They settle
all longer runs: take a sentence s of a run from i to j. If the sentences from i to s count, so does the
shortest run that ends at s, and it starts at i or later; if not, the shortest run from i reaches beyond s and ends
at j or earlier. So s lies in a hashed part of the run, which repeats where the run does. Runs are equal when
their words are; where the same words are broken into sentences elsewhere, hashed runs must begin and end alike.

Words are compared as ``words_of`` gives them, so case and punctuation do not matter. Hash counts combine
before they move; only hashes that repeat are joined back, and a passage that a third of all documents
hold is met by salting both sides. What goes back to a document is a list of sentence numbers.

Defined results: a null or empty text has no sentence and stays as it is; texts too short for a span are never
touched; rows repeated in full are one document; documents with equal ids are told apart by their text; a null
id comes first; an empty table gives an empty result; other columns pass through, but for those named like a
result column.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from framespan.llm.common import cut, packed, row_key, unpacked, words_of

SENTENCES = 3
SPAN_WORDS = 16
#: A run of two sentences, or a single one, is a span from so many words on.
PAIR_WORDS, LONG_WORDS = 30, 45
SALTS = 16

_BREAK = re.compile(r"(?<=[.!?…。])\s+|\s*\n\s*")


def sentences(text: str | None) -> list[tuple[int, int, int]]:
    """(start, end, next) of each sentence that has a word; ``next`` is where the following one starts."""
    if not text:
        return []
    out, at = [], 0
    for gap in _BREAK.finditer(text):
        out.append((at, gap.start(), gap.end()))
        at = gap.end()
    out.append((at, len(text), len(text)))
    return [s for s in out if s[1] > s[0]]


def spans(words: list[list[bytes]]) -> list[tuple[int, int]]:
    """(first, after last) sentence of the shortest span that starts, and that ends, at each sentence, where there is one."""
    upto = [0, *accumulate(len(w) for w in words)]

    def counts(i: int, j: int) -> bool:
        many, total = j - i, upto[j] - upto[i]
        return (many >= SENTENCES and total >= SPAN_WORDS) or (many >= 2 and total >= PAIR_WORDS) or total >= LONG_WORDS

    found, i, j = set(), 0, 0
    for first in range(len(words)):
        while j <= len(words) and not counts(first, j):
            j += 1
        if j > len(words):
            break
        found.add((first, j))
    for after in range(1, len(words) + 1):
        while counts(i + 1, after):
            i += 1
        if counts(i, after):
            found.add((i, after))
    return sorted(found)


#: ``_skip``: sentences without a word at the start of the span; with them or not, it is the same occurrence.
_SPANS = "_k0 long, _k1 long, _id long, _h0 long, _h1 long, _first int, _after int, _skip int"


def _hash_spans(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [x.split()[0] for x in _SPANS.split(", ")]
    for batch in batches:
        digests, rows, first, after, skip = [], [], [], [], []

        def flush() -> pa.RecordBatch:
            h = np.frombuffer(b"".join(digests), np.int64).reshape(-1, 2)
            at = pa.array(rows, pa.int64())
            return pa.RecordBatch.from_arrays([*[c.take(at) for c in batch.columns[1:]], pa.array(h[:, 0]), pa.array(h[:, 1]), pa.array(first, pa.int32()), pa.array(after, pa.int32()), pa.array(skip, pa.int32())], names=names)

        for row, text in enumerate(batch.column(0)):
            text = text.as_py()
            words = [words_of(text[a:b]) for a, b, _ in sentences(text)]
            at = [k for k, w in enumerate(words) if w]
            joined = [b" ".join(words[k]) for k in at]
            before = [0, *accumulate(bool(w) for w in words)]
            for i, j in spans(words):
                digests.append(hashlib.md5(b" ".join(joined[before[i] : before[j]])).digest())
                rows.append(row)
                first.append(i)
                after.append(j)
                skip.append(at[before[i]] - i)
            if len(rows) > 200_000:
                yield flush()
                digests, rows, first, after, skip = [], [], [], [], []
        if rows:
            yield flush()


def repeated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(_k0, _k1, lost): sentence numbers that a non-first occurrence of a span covers, per document."""
    keyed = docs.select(F.col(text_col).cast("string").alias("_t"), *row_key(F.col(id_col), F.coalesce(F.col(text_col), F.lit(""))), F.col(id_col).cast("long").alias("_id"))
    found = cut(keyed.mapInArrow(_hash_spans, _SPANS))
    place = F.struct("_id", "_k0", (F.col("_first") + F.col("_skip")).alias("_word"))
    many = cut(found.groupBy("_h0", "_h1").agg(F.min(place).alias("_at"), F.max(place).alias("_to")).where("_at <> _to").select("_h0", "_h1", "_at"))
    salted = found.withColumn("_salt", F.pmod(F.xxhash64("_k0", "_first"), F.lit(SALTS)).cast("int"))
    copies = many.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    again = salted.join(copies, ["_h0", "_h1", "_salt"]).where(place != F.col("_at"))
    numbers = again.select("_k0", "_k1", F.explode(F.sequence(F.col("_first"), F.col("_after") - 1)).alias("_s"))
    return numbers.groupBy("_k0", "_k1").agg(F.collect_set("_s").alias("lost"))


def _remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts, total, removed = [], [], []
        for text, lost in zip(batch.column(0), batch.column(2)):
            text, lost = text.as_py(), set(lost.as_py() or ())
            found = sentences(text)
            total.append(len(found))
            removed.append(len(lost))
            if lost:
                text = (text[: found[0][0]] + "".join(text[a:after] for k, (a, _, after) in enumerate(found) if k not in lost)).rstrip()
            texts.append(text)
        columns = [pa.array(texts, pa.string()), batch.column(1), pa.array(total, pa.int64()), pa.array(removed, pa.int64())]
        yield pa.RecordBatch.from_arrays(columns, names=["_t", "_rest", "_total", "_removed"])


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """All columns of ``docs`` with the text cut, and ``n_sentences``, ``n_removed``."""
    lost = cut(repeated(docs, id_col, text_col))
    joined = packed(docs, id_col, text_col).join(lost.hint("shuffle_hash"), ["_k0", "_k1"], "left").select("_t", "_rest", "lost")
    schema = T.StructType([*joined.select("_t", "_rest").schema, T.StructField("_total", T.LongType()), T.StructField("_removed", T.LongType())])
    return unpacked(joined.mapInArrow(_remove, schema), docs.columns, text_col, n_sentences=F.col("_total"), n_removed=F.col("_removed"))
