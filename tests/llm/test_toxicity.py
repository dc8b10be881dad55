"""Toxicity on the generated tables: what the cut at 0.5 finds in the held-out fold, and which rows are sampled."""

import os

import pytest
from pyspark.sql import functions as F

from quillgraph.llm import toxicity

SF = "/root/testdata/sf0.1"


def test_held_out_recall(spark):
    if not os.path.exists(SF):
        pytest.skip("no generated tables")
    docs, labels = (spark.read.parquet(f"{SF}/{n}.parquet") for n in ("documents", "labels"))
    got = toxicity.score(docs, labels).where("held_out").join(labels.where("toxic is not null").select("doc_id", "toxic"), "doc_id")
    n = {(r.toxic, r.predicted): r["count"] for r in got.groupBy("toxic", "predicted").count().collect()}
    print(n)
    hit, missed, wrong, right = (n.get(k, 0) for k in ((1, 1), (1, 0), (0, 1), (0, 0)))
    assert hit >= 0.6 * (hit + missed) and wrong <= 0.05 * (wrong + right)


def test_sample_is_of_least_hashes(spark):
    docs = spark.range(9000).selectExpr("id doc_id", "concat('w', id) text")
    want = [r.text for r in docs.orderBy(F.xxhash64("doc_id"), "doc_id").limit(70).collect()]
    assert [c.tolist() for _, c in toxicity._sampled(docs, 70)] == [toxicity.features(t).tolist() for t in want]
