"""Operators 1, 4, 5, 6, 9 and 10 on nulls in any column, repeated ids, very long texts, clashing columns and empty tables; pruning of stored ids."""

import hashlib
import random
import zlib

import numpy as np
import pytest

from quillgraph.llm import bpe, quality, sharding, tokens, toxicity, urlfilter

EXTRA = "row int, words string, part string, cell int, label string, key string, n long"


@pytest.fixture(scope="module")
def odd(spark):
    rng = random.Random(1)
    long = " ".join(rng.choice(["Déjà", "vu", "don't", "x" * 70, "12345", "\n\n", "ﬁn"]) for _ in range(60_000))
    texts = [(None, None, None), (None, "a b", "s"), (1, "", None), (1, "one", "s"), (1, "one", "s"), (2, long, "t"), (3, "x" * 300_000, "t"), (4, "plain words here " * 20, None)]
    rows = [(i, t, None, s, None, 1, "w", "p", 2, "l", "k", 3) for i, t, s in texts]
    return texts, spark.createDataFrame(rows, f"doc_id long, text string, lang string, source string, n_chars long, {EXTRA}").cache()


def test_long_texts_are_encoded_like_the_library(odd):
    import base64

    import public_tokenizers as p
    import tiktoken

    texts, docs = odd
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(p.path(bpe.VOCABULARY), "rb"))}
    theirs = tiktoken.Encoding("own", pat_str=p.PATTERN, mergeable_ranks=ranks, special_tokens={})
    want = sorted(hashlib.sha256(np.array(theirs.encode_ordinary(t or ""), "<u4").tobytes()).hexdigest() for _, t, _ in texts if len(t or "") < 250_000 or " " in t)
    got = bpe.round_trip(docs).collect()
    assert len(got) == len(texts) and all(r.round_trips for r in got)
    assert set(want) <= {r.ids_sha256 for r in got}


def test_tiny_leaves_give_the_same_ids(monkeypatch):
    rng = random.Random(3)
    tool = bpe.encoder(bpe.VOCABULARY)
    texts = ["".join(rng.choice(["a", "É", " ", "\n", "'s", "'", "9", "中", "x" * 20, "."]) for _ in range(200)) for _ in range(40)]
    want = [tool.encode(t) for t in texts]
    for name, leaf in (("LEAF_CHARS", 5), ("LEAF_BYTES", 3), ("LEAF_IDS", 4)):
        monkeypatch.setattr(bpe, name, leaf)
    tool.memo, tool.older = {}, {}
    assert [tool.encode(t) for t in texts] == want and [tool.decode(x) for x in want] == [t.encode() for t in texts]
    tool.memo, tool.older = {}, {}


def test_stored_ids_of_odd_rows(odd):
    import public_tokenizers as p
    from tokenizers import Tokenizer

    texts, docs = odd
    theirs, at = Tokenizer.from_file(p.path(tokens.VOCABULARY)), 0
    got = sorted(tokens.round_trip(docs).collect(), key=lambda r: r.start)
    order = sorted(texts, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, (r[1] or "").encode()))
    for (i, t, _), r in zip(order, got, strict=True):
        ids = [*theirs.encode(t or "", add_special_tokens=False).ids, 2]
        assert (r.doc_id, r.start, r.n_tokens, r.ids_crc32) == (i, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        at += len(ids)


def test_an_id_prunes_row_groups(spark, tmp_path):
    """One file of 40,000 rows: a condition on doc_id lets one row group (10,000 rows) of it reach Spark, and an id that is not there none."""
    path, before = str(tmp_path / "ids"), spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    try:
        tokens.write(spark.range(40_000).selectExpr("2 * id doc_id", "concat('word ', id) text"), path)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)

    def read(condition):
        plan = tokens.stored(spark, path).where(condition)._jdf.queryExecution().executedPlan()
        found = len(plan.executeCollect())
        return found, plan.collectLeaves().head().metrics().apply("numOutputRows").value()

    assert read("doc_id >= 0") == (40_000, 40_000)
    assert read("doc_id = 31234") == (1, 10_000)
    assert read("doc_id = 31235") == (0, 0)  # within the range of a row group; the Bloom filter rules it out


def test_scores_of_odd_rows(spark, odd):
    texts, docs = odd
    labels = spark.createDataFrame([(1, None, 1), (2, 1, 0), (None, 0, 1), (3, None, None), (4, 0, 0), (4, 0, 0)], "doc_id long, quality int, toxic int")
    got = toxicity.score(docs, labels).collect()
    assert len(got) == len(texts) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got)
    assert len({r.score for r in got if r.doc_id == 1}) <= 2  # equal texts have equal scores
    assert toxicity.score(docs.where("false"), labels).count() == 0
    assert {r.score for r in toxicity.score(docs, labels.where("false")).collect()} <= {r.score for r in toxicity.score(docs, labels.where("toxic = 0")).collect()}


def test_shards_of_odd_rows(odd):
    texts, docs = odd
    got = sharding.kd_shards(docs, 3).collect()
    assert sorted((r["size"], r.text_crc32) for r in got) == sorted((len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for _, t, _ in texts)
    for s in range(3):
        assert sorted(r.slot for r in got if r.shard == s) == list(range(sum(r.shard == s for r in got)))


def test_urls_of_odd_rows(spark):
    pages = spark.createDataFrame([(1, None, 0, "b"), (None, "http://A.com/en/1", 0, "b"), (1, "no host", 0, "b"), (1, "http://a.com/en/" + "y" * 100_000, 0, "b")], "page_id long, url string, row int, block string")
    rules = spark.createDataFrame([("com", "/en/", "block"), ("com", "/en/", "allow"), (None, "/x", "block"), ("a.com", None, "block")], "host string, path string, verdict string")
    got = sorted((str(r.page_id), r.host, r.rule, r.verdict) for r in urlfilter.judge(pages, rules).fillna("-", ["rule"]).collect())
    assert got == [("1", "", "-", "allow"), ("1", "", "-", "allow"), ("1", "a.com", "com/en/", "block"), ("None", "a.com", "com/en/", "block")]
    assert urlfilter.judge(pages.where("false"), rules).count() == 0
    assert {r.verdict for r in urlfilter.judge(pages, rules.where("false")).collect()} == {"allow"}


def test_rules_on_odd_rows(spark, odd):
    texts, docs = odd
    trusted = spark.createDataFrame([(4,), (None,), (4,)], "doc_id long")
    got = quality.judge(docs, trusted).collect()
    assert len(got) == len(texts) and all(r.base_failed or r.n_words >= 50 for r in got)
    assert quality.judge(docs.where("false"), trusted).count() == 0
    assert all(r.llr == 0 for r in quality.judge(docs, trusted.where("false")).collect())
