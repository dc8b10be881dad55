"""Every stage of the pipeline against a plain version, on rows with nulls, repeats and copies, and on empty tables."""

import collections
import functools
import hashlib
import random

import brute
import pytest

import corpus_pipeline
from quillgraph.llm import bpe, neardup, quality
from quillgraph.llm.common import written

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, row int, hash_ string, no_ long"


def rows():
    rng = random.Random(9)
    words = [f"{a}{b}{c}" for a in "bdfg" for b in "aeiou" for c in "klmnprst"]
    prose = lambda n: " ".join(rng.choice(words) for _ in range(n))
    item, shared, base = prose(14), prose(30), prose(160)
    out = [(i, prose(rng.randint(55, 120))) for i in range(24)]
    out += [(30, base), (31, base), (32, base + " " + prose(3)), (33, prose(70) + " " + item.upper() + "! " + prose(5)), (34, shared + " " + prose(60)), (35, prose(60) + " " + shared)]
    out += [(36, "one two three " * 40), (37, ""), (38, None), (None, prose(80)), (None, prose(80)), (None, None), (5, prose(90)), (5, prose(90)), (6, out[6][1]), (40, "!? " * 60), (41, "\n".join(["same line of words"] * 30)), (42, prose(1500))]
    return [(i, t, "en", None if (i or 0) % 3 else "s", len(t or ""), 1, "h", 2) for i, t in out], [("b1", item), ("b2", prose(12)), (None, prose(11)), ("b3", None), ("b4", "")], [(i, int(i % 2 == 0), 0) for i in range(0, 24)]


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    docs, items, labels = rows()
    folder = str(tmp_path_factory.mktemp("tables"))
    spark.createDataFrame(docs, SCHEMA).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(items, "item_id string, text string").write.parquet(f"{folder}/benchmark.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return folder


def of(df):
    return sorted(((r.doc_id, r.text) for r in df.collect()), key=repr)


def test_stages(spark, tables):
    _, items, labels = rows()
    docs = spark.read.parquet(f"{tables}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["quality_rules", "near_dedup", "suffix_dedup", "decontamination", "byte_bpe"]

    before, good = of(docs), {i for i, q, _ in labels if q == 1}
    docs = written(stages["quality_rules"](spark, docs, tables), "stage")
    kept = brute.quality_kept([t for _, t in before], [i in good for i, _ in before], quality.SMOOTHING, quality.THRESHOLD)
    want = [r for r, k in zip(before, kept, strict=True) if k]
    assert docs.columns == list(corpus_pipeline.COLUMNS) and of(docs) == want and len(want) > 20

    before = of(docs)
    docs = written(stages["near_dedup"](spark, docs, tables), "stage")
    classes, _ = brute.near_classes([t for _, t in before], neardup.FREQUENT)
    groups = collections.defaultdict(list)
    for r, c in zip(before, classes, strict=True):
        groups[c].append(r)
    want = sorted((min(g, key=lambda r: (r[0] is None, r[0] or 0, hashlib.md5((r[1] or "").encode()).hexdigest())) for g in groups.values()), key=repr)
    assert of(docs) == want and len(want) < len(before)

    before = sorted(of(docs), key=lambda r: (r[0] is not None, r[0] or 0, hashlib.md5((r[1] or "").encode()).hexdigest()))
    docs = written(stages["suffix_dedup"](spark, docs, tables), "stage")
    cut = brute.without_repeats([t for _, t in before])
    want = sorted(((i, kept.decode("utf-8", "ignore")) for (i, _), (kept, _, _) in zip(before, cut, strict=True) if kept), key=repr)
    assert of(docs) == want and sum(n for _, n, _ in cut) > 100
    assert all(r.n_chars == len(r.text) for r in docs.collect())

    before = of(docs)
    docs = written(stages["decontamination"](spark, docs, tables), "stage")
    found = brute.contamination([t for _, t in before], items)
    want = [r for r, f in zip(before, found, strict=True) if not f[1]]
    assert of(docs) == want and len(want) < len(before)

    out = sorted(((r.doc_id, r.n_tokens, r.decoded_sha256) for r in stages["byte_bpe"](spark, docs, tables).collect()), key=repr)
    tool = bpe.encoder(bpe.VOCABULARY)
    assert out == sorted(((i, len(tool.encode(t)) // 4, hashlib.sha256(t.encode()).hexdigest()) for i, t in want), key=repr)
    assert sorted(((r.doc_id, r.n_tokens, r.decoded_sha256) for r in corpus_pipeline.run(spark, tables).collect()), key=repr) == out


def test_empty_tables(spark, tables):
    docs = spark.read.parquet(f"{tables}/documents.parquet").where("false")
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, tables).count() == 0


def test_near_dedup_weighs_rare_shingles_by_their_own_frequencies(spark, tables, monkeypatch):
    """shingles that are too rare to be broadcast have exact document frequencies too, so no near copy is lost."""
    rng = random.Random(12)
    some = lambda n: " ".join(f"w{rng.randrange(10**9)}" for _ in range(n))
    often = some(24), some(24)
    texts = [f"{own} {passage}" for own in [some(140) for _ in range(20)] for passage in often]  # near copies but for a passage that many have
    exact, _ = brute.near_classes(texts, 1 << 60)
    assert len(set(exact)) == 20 and len(set(brute.near_classes(texts, 10)[0])) == 40
    monkeypatch.setattr(neardup, "classes", functools.partial(neardup.classes, frequent=10))
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    kept = dict(corpus_pipeline.STAGES)["near_dedup"](spark, docs, tables)
    assert sorted(r.doc_id for r in kept.collect()) == sorted(set(exact))


def test_document_frequencies_are_exact(spark):
    """of all shingles, frequent or not, in whatever groups and turns."""
    rng = random.Random(13)
    words = [f"w{i}" for i in range(6)]
    docs = spark.createDataFrame([(i, " ".join(rng.choice(words) for _ in range(rng.randint(1, 40))) + " the end of many such texts is this" * (i % 2)) for i in range(700)] + [(700, "")], "doc_id long, text string")
    table = neardup.shingled(docs).repartition(2)
    weights = spark.sparkContext.broadcast(neardup.frequencies(table, 100, exact=True))
    rows = neardup.shelved(table, (weights, neardup.others(table, weights))).collect()
    want = collections.Counter(h for r in rows for h in r.h)
    assert len(rows) == table.count() > 600 and len(weights.value.hashes) > 1 and len(set(want.values())) > 5
    assert all(r.df == [want[h] for h in r.h] for r in rows)
