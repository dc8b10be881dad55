"""Exact and proximity matches against brute force, blocks of windows, and odd tables."""

import random

import brute
import pytest

from quillgraph.llm import decontaminate

WORDS = ["alpha", "beta", "gamma", "delta", "eps", "zeta", "eta", "theta", "iota", "kappa", "lam", "mu"]


@pytest.fixture(scope="module")
def tables(spark):
    rng = random.Random(5)
    prose = lambda n: " ".join(rng.choice(WORDS) for _ in range(n))
    items = [("i1", prose(12)), ("i2", "mu lam"), ("i3", " ".join(WORDS[:10])), ("i3", "gone words only"), (None, prose(10)), ("i4", None), ("i5", "..."), ("i6", prose(3))]
    texts = [None, "", "  !", *(prose(rng.randint(1, 60)) for _ in range(40)), "x " + items[0][1].upper() + " y", " ".join(WORDS[9::-1]), "déjà " + " - ".join(WORDS[:10]), " ".join(WORDS[:5]) + " a b c " + " ".join(WORDS[5:10])]
    rows = [(i % 40, t) for i, t in enumerate(texts)] + [(None, items[0][1]), (3, texts[3])]
    docs = spark.createDataFrame([(i, t, 7, "w") for i, t in rows], "doc_id long, text string, row int, words string").cache()
    return rows, items, docs, spark.createDataFrame([(*x, "c") for x in items], "item_id string, text string, wid string")


@pytest.mark.parametrize("block", [decontaminate.BLOCK, 3000])
def test_exact_and_near(tables, monkeypatch, block):
    monkeypatch.setattr(decontaminate, "BLOCK", block)
    rows, items, docs, bench = tables
    got = sorted(((r.doc_id, r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated, r.n_near) for r in decontaminate.judge(docs, bench, span=decontaminate.SPAN).collect()), key=repr)
    exact = brute.contamination([t for _, t in rows], items)
    want = []
    for (i, t), e in zip(rows, exact, strict=True):
        near = set()
        for name, text in items:
            x = brute.bench_words(text)
            if name is not None and any(brute.proximity(t, x[s : s + 10], decontaminate.SPAN) for s in range(max(len(x) - 9, 1) if x else 0)):
                near.add(name)
        want.append((i, *e, e[1] > 0, len(near)))
    assert got == sorted(want, key=repr) and any(w[-1] > w[3] for w in want)


def test_matches(tables):
    _, _, docs, bench = tables
    found = decontaminate.matches(docs, bench).collect()
    assert any(r.exact for r in found) and any(not r.exact for r in found)
    assert all(r.start >= 0 for r in found if r.exact)


def test_empty_tables(spark, tables):
    _, _, docs, bench = tables
    assert decontaminate.judge(docs.where("false"), bench).count() == 0
    clean = decontaminate.judge(docs, bench.where("false"), span=decontaminate.SPAN)
    assert clean.count() == docs.count() and clean.where("contaminated or n_hit > 0 or n_near > 0").count() == 0
    assert decontaminate.matches(docs, bench.where("false")).count() == 0
