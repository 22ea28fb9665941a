"""Operators and the whole pipeline on ids that are no numbers."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from quantloom.llm import exact_dedup, token_files
from quantloom.llm.scratch import Scratch

KINDS = {"string": lambda c: F.format_string("d%05d", c), "date": lambda c: F.date_add(F.lit("2020-01-01").cast("date"), c.cast("int"))}


def _documents(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")


@pytest.mark.parametrize("kind", list(KINDS))
def test_exact_dedup_and_token_files_by_type(spark, sf, kind):
    docs = _documents(spark, sf).select("doc_id", "text")
    docs = docs.unionByName(docs.where("doc_id < 40").withColumn("doc_id", F.col("doc_id") + 1000))
    named = docs.withColumn("doc_id", KINDS[kind](F.col("doc_id")))
    names = {r[0]: r[1] for r in docs.select("doc_id", KINDS[kind](F.col("doc_id"))).collect()}
    want = {(names[r["doc_id"]], names[r["keep_id"]], r["group_size"], r["kept"]) for r in exact_dedup.exact_duplicates(docs).collect()}
    assert {(r["doc_id"], r["keep_id"], r["group_size"], r["kept"]) for r in exact_dedup.exact_duplicates(named).collect()} == want
    assert {r["doc_id"] for r in exact_dedup.keep_winners(named).collect()} == {k for _, k, _, _ in want}
    found = []
    for rows in (docs, named.unionByName(named.limit(1).withColumn("doc_id", F.lit(None).cast(kind)))):
        path = Scratch(spark, "t").path("files")
        token_files.write_token_files(rows, path, end_id=0)
        found.append([(r["doc_id"], r["start"], bytes(r["ids"])) for r in token_files.read_token_files(spark, path).orderBy("start").collect()])
    assert found[1][0][0] is None and [d for d, *_ in found[1][1:]] == sorted(names.values())
    assert [(names[d], ids) for d, _, ids in found[0]] == [(d, ids) for d, _, ids in found[1][1:]]
    ends = np.cumsum([len(ids) // 4 for *_, ids in found[1]])
    assert [s for _, s, _ in found[1]] == [0, *ends[:-1].tolist()]


def test_pipeline_with_string_ids(spark, sf):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    docs = _documents(spark, sf)
    named, numbered = docs.withColumn("doc_id", F.format_string("d%05d", "doc_id")), docs
    scratch = Scratch(spark, "t")
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES[:3]):
        named, numbered = scratch.save(stage(spark, named, sf), f"named{k}"), scratch.save(stage(spark, numbered, sf), f"numbered{k}")
        assert sorted(r[0] for r in named.select("doc_id").collect()) == sorted("d%05d" % r[0] for r in numbered.select("doc_id").collect())
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES[3:]):
        named = scratch.save(stage(spark, named, sf), f"late{k}")
    assert named.select("length").agg(F.max("length")).first()[0] <= 1024 and named.where("doc_id is null").count() == 0
