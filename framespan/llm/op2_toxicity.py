"""Toxicity by FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Features are the distinct single words, word pairs and pairs that skip one word, hashed to 2^22
coordinates. FTRL-proximal keeps a learning rate per coordinate and an L1 threshold, so most weights are
exactly zero; what is broadcast is the list of the others.

Training streams a bounded sample of labelled documents (``MAX_LABELLED``) through one task, batch by
batch: the learner is sequential by nature and its state is two fixed arrays. Features of the sample are
hashed before, in parallel. Scoring covers every document and needs no shuffle.

Defined results: a null or empty text has no features and gets the score of the bias; labels that are
null or not 0/1, and labelled ids without a document, teach nothing; without any usable label the score
is 0 for every document; rows repeated in full get equal scores; other columns pass through unread, but for
one named ``score``; an empty table gives an empty result.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from framespan.llm.common import cut, mix64, packed, unpacked, words_of

BITS = 22
#: Bound of the training sample, in documents.
MAX_LABELLED = 30_000
PASSES = 5
#: Files of the stored sample.
PARTS = 8
ALPHA, BETA, L1, L2 = 3.0, 1.0, 4.0, 0.01
#: A pair or skip counts as this much of a word.
PAIR_VALUE = 0.3
THRESHOLD = 0.7

_PAIR = np.uint64(0x9E3779B97F4A7C15)
_SKIP = np.uint64(0xC2B2AE3D27D4EB4F)


def hashed(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Coordinates of all words, and of all adjacent pairs and one-word skips, with repetitions."""
    words = words_of(text)
    if not words:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    w = mix64(np.fromiter(map(zlib.crc32, words), np.uint64, len(words)))
    pairs = mix64(w[:-1] * _PAIR + w[1:])
    skips = mix64(w[:-2] * _SKIP + w[2:])
    at = (np.concatenate([w, pairs, skips]) >> np.uint64(64 - BITS)).astype(np.int64)
    return at[: len(w)], at[len(w) :]


def distinct(words: np.ndarray, pairs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct coordinates and their values; a coordinate that is both counts as a word."""
    words = np.unique(words)
    pairs = np.setdiff1d(pairs, words)
    return np.concatenate([words, pairs]), np.repeat([1.0, PAIR_VALUE], [len(words), len(pairs)])


class Ftrl:
    """FTRL-proximal for logistic loss on sparse features; coordinate 2^BITS is the bias (not shrunk)."""

    def __init__(self, size: int = (1 << BITS) + 1, alpha: float = ALPHA, beta: float = BETA, l1: float = L1, l2: float = L2):
        self.z, self.n = np.zeros(size), np.zeros(size)
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2
        self.bias = size - 1

    def weights(self, at: np.ndarray) -> np.ndarray:
        z = self.z[at]
        shrink = np.where(at == self.bias, 0.0, self.l1)
        w = -(z - np.sign(z) * shrink) / ((self.beta + np.sqrt(self.n[at])) / self.alpha + self.l2)
        return np.where(np.abs(z) <= shrink, 0.0, w)

    def learn(self, at: np.ndarray, value: np.ndarray, label: int) -> None:
        w = self.weights(at)
        error = 1 / (1 + np.exp(-np.clip((w * value).sum(), -35, 35))) - label
        g = error * value
        n = self.n[at]
        self.z[at] += g - (np.sqrt(n + g * g) - np.sqrt(n)) / self.alpha * w
        self.n[at] = n + g * g


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        words, pairs = [], []
        for text in batch.column(0):
            w, p = hashed(text.as_py())
            words.append(np.unique(w).astype(np.int32).tobytes())
            pairs.append(np.unique(p).astype(np.int32).tobytes())
        yield pa.RecordBatch.from_arrays([pa.array(words, pa.binary()), pa.array(pairs, pa.binary()), batch.column(1), batch.column(2)], names=["words", "pairs", "label", "place"])


def _train(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    model, seen = Ftrl(), 0
    for batch in batches:
        for words, pairs, label in zip(*batch.columns):
            at, value = distinct(np.frombuffer(words.as_py(), np.int32), np.frombuffer(pairs.as_py(), np.int32))
            model.learn(np.append(at, model.bias), np.append(value, 1.0), label.as_py())
            seen += 1
    if seen:
        at = np.append(np.flatnonzero(np.abs(model.z[:-1]) > model.l1), model.bias)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(model.weights(at), pa.float64())], names=["at", "weight"])


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", learn_from: Column | None = None, max_labelled: int = MAX_LABELLED, passes: int = PASSES) -> DataFrame:
    """(at, weight): the coordinates whose weight is not zero, and the bias at 2^BITS.

    ``learn_from``: a condition on the id column (named ``_id``) that labelled rows must meet. Above
    ``max_labelled`` rows a uniform sample by hash of the id is taken.
    """
    usable = labels.select(F.col(id_col).alias("_id"), F.col(label_col).cast("int").alias("label")).where("label in (0, 1) and _id is not null")
    usable = usable.groupBy("_id").agg(F.max("label").alias("label"))
    if learn_from is not None:
        usable = usable.where(learn_from)
    share = F.pmod(F.xxhash64(F.lit(11), "_id"), F.lit(1_000_000))
    n = usable.count()
    if n > max_labelled:
        usable = usable.where(share < int(1_000_000 * max_labelled / n))
    # about max_labelled narrow rows at most, so this broadcast is bounded and no text moves but the sample's
    usable = F.broadcast(cut(usable))
    texts = docs.select(F.col(id_col).alias("_id"), F.col(text_col).cast("string").alias("_t"))
    joined = texts.join(usable, "_id").select("_t", "label", F.xxhash64(F.lit(12), "_id").alias("place"))
    features = joined.mapInArrow(_features, "words binary, pairs binary, label int, place long")
    stored = cut(features.repartition(PARTS, "place").sortWithinPartitions("place").select("words", "pairs", "label"))
    # one task reads the stored features once for each pass
    repeated = reduce(DataFrame.unionAll, [stored] * passes).coalesce(1)
    return cut(repeated.mapInArrow(_train, "at long, weight double"))


def _score(model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, weight = model.value
        dense = np.zeros((1 << BITS) + 1, np.float32)
        dense[at] = weight
        bias = float(dense[-1])
        for batch in batches:
            scores = []
            for text in batch.column(0):
                words, pairs = hashed(text.as_py())
                found, value = distinct(words[dense[words] != 0], pairs[dense[pairs] != 0])
                total = float((dense[found] * value).sum()) + bias
                scores.append(1 / (1 + np.exp(-np.clip(total, -35, 35))) if len(at) else 0.0)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(scores, pa.float64())], names=["_t", "_rest", "_score"])

    return run


def score(docs: DataFrame, weights: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """All columns of ``docs`` and ``score``. At most 2^22 weights exist, so their broadcast is bounded."""
    rows = weights.toPandas()
    model = docs.sparkSession.sparkContext.broadcast((rows["at"].to_numpy(np.int64), rows["weight"].to_numpy(np.float32)))
    plain = packed(docs, id_col, text_col).select("_t", "_rest")
    schema = T.StructType([*plain.schema, T.StructField("_score", T.DoubleType())])
    return unpacked(plain.mapInArrow(_score(model), schema), docs.columns, text_col, score=F.col("_score"))


def held_out(id_column: Column) -> Column:
    """Rows that never teach: crc32 of the id as text leaves 1 when divided by 3."""
    return F.coalesce(F.crc32(id_column.cast("string")) % 3 == 1, F.lit(False))


def toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD, **training) -> DataFrame:
    """Per document: id, held_out, score, predicted."""
    weights = train(docs, labels, id_col, text_col, learn_from=~held_out(F.col("_id")), **training)
    scored = score(docs.select(id_col, text_col), weights, id_col, text_col)
    return scored.select(
        id_col,
        held_out(F.col(id_col)).alias("held_out"),
        "score",
        (F.col("score") >= threshold).cast("int").alias("predicted"),
    )
