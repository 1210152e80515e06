"""The pipeline: each stage on awkward rows and against brute force on the smallest tables."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

import corpus_pipeline
from framespan.llm import op2_toxicity
from tests.llm.test_text_operators import AWKWARD, brute_links, component, table

SF = "/root/testdata/sf0.001"


def test_stages_in_order(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, before = docs.columns, docs
    left = {}
    for name, stage in corpus_pipeline.STAGES:
        after = stage(spark, before, SF)
        assert after.columns[: len(columns)] == columns
        path = f"{spark.sparkContext.getCheckpointDir()}/stage-{name}-test"
        after.write.mode("overwrite").parquet(path)
        after = spark.read.parquet(path)
        left[name] = {r.doc_id: r.text for r in after.collect()}
        before = after
    assert len(left["toxicity"]) >= len(left["near_duplicates"]) >= len(left["decontaminate"]) == len(left["mix"]) > 0
    lines = list(left["line_dedup"].items())
    links = brute_links(lines)
    assert set(left["near_duplicates"]) == {component(links, d) for d in links}
    key = lambda x: re.sub(r"[\t-\r ]+$|^[\t-\r ]+", "", x).lower()
    counts = {}
    for d, t in left["toxicity"].items():
        for k in {key(x) for x in t.split("\n")} - {""}:
            counts[k] = counts.get(k, 0) + 1
    for d, t in left["toxicity"].items():
        assert left["line_dedup"][d] == "\n".join(x for x in t.split("\n") if counts.get(key(x), 0) < 10)


def test_pipeline_rows(spark):
    rows = corpus_pipeline.run(spark, SF).collect()
    assert len({r.doc_id for r in rows}) == len(rows) > 0
    assert len({(r.source, r.block) for r in rows}) == len({r.slot for r in rows})


def test_stages_on_awkward_rows(spark):
    docs = table(spark, AWKWARD)
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SF)
        assert out.count() in (len(AWKWARD), len(AWKWARD) - 1), name
        assert stage(spark, docs.limit(0), SF).count() == 0


def test_stages_keep_columns_of_any_name(spark):
    added = ["score", "n_lines", "n_dropped", "row", "_rest", "kept", "a.b"]
    docs = spark.read.parquet(f"{SF}/documents.parquet").drop("n_chars")
    docs = docs.select(*[F.concat(F.lit(f"{c} "), "doc_id").alias(c) for c in added], *docs.columns)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns, name
        rows = out.collect()
        assert rows and all(r[c] == f"{c} {r.doc_id}" for r in rows for c in added), name


def test_held_out_rows_do_not_teach(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    held = [r.doc_id for r in labels.where(op2_toxicity.held_out(labels.doc_id)).collect()]
    flipped = labels.withColumn("toxic", (labels.toxic + labels.doc_id.isin(held).cast("int")) % 2)
    a, b = ({r.doc_id: r.score for r in op2_toxicity.toxicity(docs, x).collect()} for x in (labels, flipped))
    assert held and a == b
