"""Near-duplicate classes and repeated strings against brute force: odd rows, ties, long texts, and the generated tables."""

import collections
import hashlib
import os
import random

import brute
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quillgraph.llm import neardup, suffixes
from quillgraph.llm.common import text_hash

DATA = "/root/testdata"
WORDS = [f"w{i}" for i in range(400)]


def prose(rng, n):
    return " ".join(rng.choice(WORDS) for _ in range(n))


def edited(rng, text, share):
    w = text.split()
    for i in rng.sample(range(len(w)), int(share * len(w))):
        w[i] = rng.choice(WORDS)
    return " ".join(w)


@pytest.fixture(scope="module")
def odd():
    rng = random.Random(7)
    base, passage = prose(rng, 300), prose(rng, 40)
    near = [edited(rng, base, 0.01) for _ in range(12)]
    texts = [None, "", " \n ", "one", "one", base, base, *near, passage + " " + prose(rng, 50), prose(rng, 60) + " " + passage, "ab" * 200, "x" * 500, "one two three four", prose(rng, 200)]
    ids = list(range(len(texts)))
    ids[9] = ids[8]  # one id, two texts
    ids[3] = ids[11] = None
    return list(zip(ids, texts, strict=True))


def test_classes_of_odd_rows(spark, odd):
    docs = spark.createDataFrame([(i, t, 1, "n") for i, t in odd], "doc_id long, text string, h int, bucket string")
    want, _ = brute.near_classes([t for _, t in odd], neardup.FREQUENT)
    got = neardup.classes(docs).collect()
    assert len(got) == len(odd)
    key = {(r.doc_id, r.text_hash): r for r in got}
    hashes = [r[0] for r in docs.select(text_hash()).collect()]
    mine = [key[i, h].class_key for (i, _), h in zip(odd, hashes, strict=True)]
    groups = lambda labels: {frozenset(i for i, x in enumerate(labels) if x == y) for y in labels}
    assert groups(mine) == groups(want)
    for group in groups(want):
        rows = [key[odd[i][0], hashes[i]] for i in group]
        known = [r.doc_id for r in rows if r.doc_id is not None]
        assert {r.class_id for r in rows} == {min(known) if known else None}
        assert len({(r.doc_id, r.text_hash) for r in rows if r.is_first}) == 1


def test_classes_of_generated_texts(spark):
    """No class is wider than brute force's, and at least 0.9 (here all) of its similar pairs are in one class."""
    if not os.path.exists(f"{DATA}/sf0.01"):
        pytest.skip("no generated tables")
    docs = spark.read.parquet(f"{DATA}/sf0.01/documents.parquet").select("doc_id", "text")
    rows = docs.orderBy("doc_id").collect()
    want, pairs = brute.near_classes([r.text for r in rows], neardup.FREQUENT)
    got = {r.doc_id: r.class_key for r in neardup.classes(docs).collect()}
    mine = [got[r.doc_id] for r in rows]
    inside = {}
    for a, b in zip(mine, want, strict=True):
        assert inside.setdefault(a, b) == b
    found = sum(mine[i] == mine[j] for i, j in pairs)
    print(f"recall {found} of {len(pairs)} similar pairs of different texts")
    assert pairs and found >= 0.98 * len(pairs)


def test_a_large_group_of_near_copies(spark, monkeypatch):
    monkeypatch.setattr(neardup, "SHARE", 16)  # the leader's pairs are dealt to many tasks
    rng = random.Random(2)
    base = prose(rng, 200)
    texts = [edited(rng, base, 0.01) for _ in range(300)] + [prose(rng, 150) for _ in range(50)]
    want, pairs = brute.near_classes(texts, neardup.FREQUENT)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.class_id for r in neardup.classes(docs).collect()}
    assert sum(got[i] == got[j] for i, j in pairs) >= 0.98 * len(pairs)
    assert all(want[i] == want[got[i]] for i in got)


def test_all_texts_of_a_bucket_are_compared(spark, monkeypatch):
    """a bucket of many classes, each of a few near copies, loses no link, whether a task has it whole or in blocks."""
    rng = random.Random(11)
    for block in (1 << 19, 4000):
        monkeypatch.setattr(neardup, "BLOCK", block, raising=False)
        monkeypatch.setattr(neardup, "sketched", lambda table, weights: table.where("size(h) > 0").select("no", F.size("h").cast("long").alias("size"), F.array(F.lit(1).cast("long"), F.lit(2).cast("long"), F.pmod("no", F.lit(7)) + 10).alias("buckets"), F.array(*[F.xxhash64("no", F.lit(i)) for i in range(18)]).alias("more")))
        texts = [" ".join([*[f"c{c}x{i}" for i in range(100)], *[f"r{c}k{k}" for _ in range(1 + k % 3)]]) for c in range(40) for k in range(4)]
        rng.shuffle(texts)
        want, pairs = brute.near_classes(texts, neardup.FREQUENT)
        docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
        got = {r.doc_id: r.class_id for r in neardup.classes(docs).collect()}
        assert len(pairs) >= 200 and all(got[i] == got[j] for i, j in pairs)
        assert all(want[i] == want[got[i]] for i in got)


def test_forest_is_that_of_all_pairs():
    rng = np.random.default_rng(5)
    for trial in range(60):
        m, base = int(rng.integers(2, 40)), np.sort(rng.choice(1000, 30, replace=False))
        bags = [np.unique(np.concatenate([base[rng.random(30) > rng.choice([0.03, 0.1, 0.3])], rng.choice(1000, int(rng.integers(1, 5)))])).astype(np.uint64) for _ in range(m)]
        sets = [(b, (b % np.uint64(7) + np.uint64(1)).astype(float)) for b in bags]
        label, side = (np.arange(m) if trial % 2 else rng.integers(0, m, m)), (np.zeros(m, np.int64) if trial % 3 else rng.integers(0, 2, m))
        name = list(label)

        def root(x, name=name):
            return x if name[x] == x else root(name[x])

        name[:] = range(m)
        name[:] = [min(j for j in range(m) if label[j] == label[i]) for i in range(m)]
        for i in range(m):
            for j in range(i):
                if (side[i] != side[j] or len(set(side)) == 1) and neardup.similarity(sets[i], sets[j]) >= 0.8:
                    x, y = sorted((root(i), root(j)))
                    name[y] = x
        want = [root(i) for i in range(m)]
        starts = np.cumsum([0, *[len(b) for b in bags]])
        found = list(neardup.forest(np.concatenate(bags), np.concatenate([w for _, w in sets]), starts, label, side, 0.8))
        assert all(neardup.similarity(sets[i], sets[j]) >= 0.8 for i, j, _ in found) and len(found) < m
        name[:] = [min(j for j in range(m) if label[j] == label[i]) for i in range(m)]
        for i, j, first in found:
            assert want[i] == want[j] == want[first]
            x, y = sorted((root(i), root(first)))
            name[y] = x
        assert [root(i) for i in range(m)] == want


def test_frequencies_do_not_depend_on_tasks(spark, monkeypatch):
    rng = random.Random(3)
    docs = spark.createDataFrame([(i, prose(rng, 30) + " the end of every such text is this") for i in range(200)], "doc_id long, text string")
    monkeypatch.setattr(neardup, "TASK", 500)
    table = neardup.shingled(docs)
    one, many = (neardup.frequencies(table.repartition(n), 500) for n in (1, 9))
    assert (one.hashes == many.hashes).all() and (one.idf == many.idf).all() and one.rare == many.rare
    assert 0 < len(one.hashes) - 1 <= 500


@pytest.mark.parametrize("group", [1000, 2])
def test_suffixes_of_odd_rows(spark, odd, monkeypatch, group):
    """Also with every anchor taken as a very frequent one."""
    monkeypatch.setattr(suffixes, "GROUP", group)
    docs = spark.createDataFrame([(i, t, 1) for i, t in odd], "doc_id long, text string, no_ int")
    order = sorted(odd, key=lambda r: (r[0] is not None, r[0] or 0, hashlib.md5((r[1] or "").encode()).hexdigest()))
    want = sorted((i if i is not None else -1, len((t or "").encode()), n, runs, hashlib.sha256(kept).hexdigest()) for (i, t), (kept, n, runs) in zip(order, brute.without_repeats([t for _, t in order]), strict=True))
    got = sorted((-1 if r.doc_id is None else r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffixes.digest(docs.drop("no_")).collect())
    assert got == want


def test_repeated_rows_lose_all_but_one(spark):
    docs = spark.createDataFrame([(5, "k" * 30 + "l" * 120)] * 3, "doc_id long, text string")
    assert sorted(r.n_removed for r in suffixes.digest(docs).collect()) == [119, 150, 150]


def test_a_very_long_text(spark):
    rng = random.Random(4)
    part = "".join(rng.choice("abcdefghij ") for _ in range(1 << 20))
    long = part + part[5000:9000] + "".join(rng.choice("xyz") for _ in range(1000))
    docs = spark.createDataFrame([(1, part[777:1777]), (2, long), (3, None)], "doc_id long, text string")
    got = {r.doc_id: (r.n_removed, r.n_spans) for r in suffixes.digest(docs).collect()}
    assert got == {1: (0, 0), 2: (5000, 2), 3: (0, 0)}


def test_suffixes_of_generated_texts(spark):
    if not os.path.exists(f"{DATA}/sf0.001"):
        pytest.skip("no generated tables")
    docs = spark.read.parquet(f"{DATA}/sf0.001/documents.parquet").select("doc_id", "text")
    rows = docs.orderBy("doc_id").collect()
    want = {r.doc_id: (n, runs, hashlib.sha256(kept).hexdigest()) for r, (kept, n, runs) in zip(rows, brute.without_repeats([r.text for r in rows]), strict=True)}
    got = {r.doc_id: (r.n_removed, r.n_spans, r.kept_sha256) for r in suffixes.digest(docs).collect()}
    assert got == want


def test_equal_hashes_are_told_apart_by_bytes(monkeypatch):
    """With a hash that is always equal, every hit is a collision until the bytes are compared."""
    monkeypatch.setattr(suffixes.Hashes, "of", lambda self, i, j: np.zeros(len(i), np.uint64))
    a, b = b"a" * 40 + b"K" * 32 + b"b" * 68, b"c" * 40 + b"K" * 32 + b"d" * 68
    text, p = suffixes.repeats(np.array([1, 1, 1]), np.array([40, 40, 40], np.int32), [a, b, a], np.array([1, 2, 3]), np.array([40, 40, 40]))
    assert text.tolist() == [3] * 41 and sorted(p.tolist()) == list(range(41))


def test_contexts_of_a_frequent_anchor_are_not_listed_by_windows(spark, monkeypatch):
    """every step makes two rows of a context at most, and the result is exact."""
    monkeypatch.setattr(suffixes, "GROUP", 20)
    rng = random.Random(6)
    letters = lambda n: "".join(rng.choice("abcdefghijklmnop") for _ in range(n))
    core, lefts, rights = letters(60), [letters(60) for _ in range(4)], [letters(60) for _ in range(4)]
    texts = [rng.choice([letters(40), rng.choice(lefts)[rng.randrange(60) :]]) + core + rng.choice([letters(50), rng.choice(rights)[: rng.randrange(60)]]) for _ in range(300)]
    seen, real = [], suffixes.per_batch
    monkeypatch.setattr(suffixes, "per_batch", lambda df, columns, work, schema: seen.append(schema) or real(df, columns, work, schema))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: (r.n_removed, r.n_spans, r.kept_sha256) for r in suffixes.digest(docs).collect()}
    assert got == {i: (n, runs, hashlib.sha256(kept).hexdigest()) for i, (kept, n, runs) in enumerate(brute.without_repeats(texts))}
    assert not any("bytes" in s.split(",")[0] for s in seen)
    kinds = spark.createDataFrame([(1, 68, t[:168].encode() * 2, i, 5000 << 14 | 68 << 7 | 68, 0, 68) for i, t in enumerate(texts)], "h long, rel int, context binary, no_ long, spot long, near int, far int")
    assert suffixes._halved(kinds, 100).count() == 2 * len(texts)


def test_empty_tables(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert neardup.classes(docs).count() == 0 and suffixes.digest(docs).count() == 0


def test_shingles_of_many_texts_and_no_arrays_to_move(spark):
    """words are hashed once for many texts, and Spark moves shingles as bytes; both give the shingles that words in turn give."""
    rng = random.Random(8)
    texts = ["", " ", "a", " a  b\n", "a b c d", "a b c d e", "a a a a a a a", "\x1cé\xa0日　x y z w v", *(" ".join(rng.choice("abc") for _ in range(rng.randint(0, 30))) for _ in range(40))]
    h, n, ends = neardup.shingles(pa.array(texts))
    for text, a, b in zip(texts, ends, ends[1:], strict=False):
        words = text.split()
        size = min(5, len(words))
        want = collections.Counter(tuple(words[i : i + size]) for i in range(len(words) - size + 1) if size)
        assert sorted(n[a:b]) == sorted(want.values()) and (np.diff(h[a:b].astype(object)) > 0).all()
    assert (neardup.shingles(pa.array(["x y", "a a a a a a a"]))[0][1:] == h[ends[6] : ends[7]]).all()
    table = neardup.shingled(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    assert {r.id: (r.h, r.n) for r in table.collect()} == {i: (h[a:b].view(np.int64).tolist(), n[a:b].tolist()) for i, (a, b) in enumerate(zip(ends, ends[1:], strict=False)) if texts.index(texts[i]) == i}
    known = spark.sparkContext.broadcast(neardup.frequencies(table, 10, exact=True))
    rows = neardup.others(table, known)
    plan = rows._jdf.queryExecution().executedPlan().toString() + table.select("hs", "ns")._jdf.queryExecution().executedPlan().toString()
    assert rows.schema["h"].dataType.simpleString() == "binary" and "ArrowEvalPython" not in plan


def test_python_gets_small_batches(spark, monkeypatch, tmp_path):
    """an executor has each batch outside its heap and in its worker, so a batch has a bounded number of rows and bytes; the session's own limits hold again afterwards."""
    plain, limits = neardup.mapped, [f"spark.sql.execution.arrow.{x}PerBatch" for x in ("maxRecords", "maxBytes")]

    def mapped(df, work, schema):
        def run(batches):
            def seen():
                for batch in batches:
                    (tmp_path / f"{batch.num_rows}-{batch.nbytes}-{os.urandom(8).hex()}").touch()
                    yield batch

            yield from work(seen())

        return plain(df, run, schema)

    monkeypatch.setattr(neardup, "mapped", mapped)
    monkeypatch.setattr(neardup, "BYTES", 1 << 18)
    before = [spark.conf.get(x) for x in limits]
    rng = random.Random(4)
    texts = [f"{i} a b c d e" for i in range(6000)] + [prose(rng, 2000) for _ in range(300)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)
    assert neardup.classes(docs, exact=True).count() == len(texts)
    rows, size = (max(int(p.name.split("-")[i]) for p in tmp_path.iterdir()) for i in (0, 1))
    assert rows <= neardup.TEXTS and size <= 2 * neardup.BYTES
    assert [spark.conf.get(x) for x in limits] == before
