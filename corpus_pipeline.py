"""The corpus pipeline: five stages from raw documents to a mixed corpus.

Each stage takes (spark, docs, sf_dir), works on everything its predecessor kept, and returns the columns
of ``documents``; the last adds each document's place in the mixture.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from framespan.llm import op2_toxicity, op4_ngram_join, op6_decontaminate, op8_mixing, op9_line_dedup
from framespan.llm.common import row_key
from framespan.session import ensure_checkpoint_dir


def _without(docs: DataFrame, lost: DataFrame, once: bool = False) -> DataFrame:
    """The documents whose row key is not among ``lost``; ``once`` keeps one of rows repeated in full."""
    keyed = docs.select(F.struct("*").alias("row"), *row_key(F.col("doc_id"), F.coalesce(F.col("text"), F.lit(""))))
    kept = keyed.join(lost.select("_k0", "_k1").hint("shuffle_hash"), ["_k0", "_k1"], "left_anti")
    return (kept.dropDuplicates(["_k0", "_k1"]) if once else kept).select("row.*")


def _narrow(docs: DataFrame) -> DataFrame:
    """doc_id, text and, as one struct ``row``, all columns but the text: none can clash with what an operator adds."""
    return docs.select("doc_id", "text", F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != "text"]).alias("row"))


def _columns(narrow: DataFrame, columns: list[str]) -> DataFrame:
    """Undo ``_narrow``: exactly the given columns, in their order, with the text as it is now."""
    return narrow.select(*[F.col("text") if c == "text" else F.col("row").getField(c).alias(c) for c in columns])


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop the documents scored as toxic; the model learns from labelled rows that are not held out."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    weights = op2_toxicity.train(docs, labels, learn_from=~op2_toxicity.held_out(F.col("_id")))
    scored = op2_toxicity.score(_narrow(docs), weights)
    return _columns(scored.where(F.col("score") < op2_toxicity.THRESHOLD), docs.columns)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cut lines that ten documents or more share; a document stays, with the length of what is left in ``n_chars`` if there is one."""
    cleaned = _columns(op9_line_dedup.drop_lines(_narrow(docs)), docs.columns)
    return cleaned.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else cleaned


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each group of near duplicates: the one with the smallest id."""
    return _without(docs, op4_ngram_join.join(docs).where("not kept"), once=True)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop the documents that the benchmark contaminates."""
    found = op6_decontaminate.contamination(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return _without(docs, found.where("contaminated"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Place every document in the mixture: columns of documents, and block, slot and offset."""
    return op8_mixing.mix(docs)


STAGES = [
    ("toxicity", toxicity),
    ("line_dedup", line_dedup),
    ("near_duplicates", near_duplicates),
    ("decontaminate", decontaminate),
    ("mix", mix),
]

#: No SQL: the first stage is a trained model. The tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to ``documents``; each result is written as Parquet and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    base = f"{ensure_checkpoint_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{base}/{name}")
        docs = spark.read.parquet(f"{base}/{name}")
    return docs
