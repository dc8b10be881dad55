"""The likelihood rule on the generated tables: verdicts of texts that were left out of the target, at two sizes."""

import os

import pytest
from pyspark.sql import functions as F

from quillgraph.llm import quality

DATA = "/root/testdata"


def test_ratio_by_hand(spark):
    """Own counts are taken out; with few words per cell the sums can be done by hand."""
    from collections import Counter
    from math import log

    texts = {1: "a b a", 2: "a b", 3: "c", 4: "", 5: "a c b"}
    cells = lambda t: Counter([*(w := t.split()), *zip(w, w[1:], strict=False)])
    raw = sum((cells(t) for t in texts.values()), Counter())
    target = cells(texts[1]) + cells(texts[2])
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = {r.doc_id: r.llr for r in quality.judge(docs, spark.createDataFrame([(1,), (2,)], "doc_id long")).collect()}
    for i, t in texts.items():
        own = cells(t)
        k, size, inside = quality.SMOOTHING, sum(own.values()), i in (1, 2)
        m, n = target.total() - size * inside, raw.total() - size
        s = sum(c * log((target[g] - c * inside + k) / ((raw[g] - c) * m / n + k)) for g, c in own.items())
        assert got[i] == pytest.approx(s / size if size else 0.0, abs=1e-8)


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_held_out_texts_are_kept(spark, sf):
    if not os.path.exists(f"{DATA}/{sf}"):
        pytest.skip("no generated tables")
    docs, labels = (spark.read.parquet(f"{DATA}/{sf}/{n}.parquet") for n in ("documents", "labels"))
    good = labels.where("quality = 1").select("doc_id")
    out = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(5)) == 0
    got = quality.judge(docs, good.where(~out))
    held = got.join(good.where(out), "doc_id", "left_semi").where("not base_failed")
    assert held.count() >= 10 and held.where("not kept").count() == 0
    bad = got.join(labels.where("quality = 0").select("doc_id"), "doc_id", "left_semi").where("not base_failed")
    assert 2 * bad.where("not kept").count() > bad.count()
