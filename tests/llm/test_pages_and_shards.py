"""Page differencing and k-d shards against plain versions."""

import random

import pytest

from quillgraph.llm import html, sharding

random.seed(11)
ARTICLE = '<html><body><main><article><header><h1>Title</h1></header><p>text <span class="share-price">5</span></p><div class="article-header">kept</div><div class="share">gone</div></article><div class="thread"><article class="user-post">reader</article></div></main></body></html>'


def length(a, b):
    d = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            d[i + 1][j + 1] = d[i][j] + 1 if x == y else max(d[i][j + 1], d[i + 1][j])
    return d[-1][-1]


@pytest.mark.parametrize("bits", [1 << 24, 8, 64])
def test_common_lines_are_a_longest_common_subsequence(monkeypatch, bits):
    monkeypatch.setattr(html, "TABLE_BITS", bits)
    for _ in range(1000):
        a, b = ([random.randint(0, 5) for _ in range(random.randint(0, 14))] for _ in range(2))
        got = html.common_lines(a, b)
        rest = iter(b)
        assert got == sorted(set(got)) and len(got) == length(a, b) and all(any(a[i] == y for y in rest) for i in got)


def test_article_parts():
    assert html.extract(html.blocks(ARTICLE), []) == "Title\n\ntext 5\n\nkept"


def page(*lines):
    return "<html><body>" + "".join(f"<div>{x}</div>" for x in lines) + "</body></html>"


PAGES = [
    (1, "http://a.org/x/1", page("Home", "News", "first story", "Imprint")),
    (2, "http://A.org/x/2?q", page("Home", "News", "second story", "more of it", "Imprint")),
    (3, "http://a.org/y/3", page("Home", "third story")),
    (4, "http://b.org/1", page("Home", "alone")),
    (5, "http://a.org/x/1", page("Home", "News", "first story", "Imprint")),
    (6, None, None),
    (7, "no url", page("Home")),
    (8, "http://c.org/1", ARTICLE),
    (9, "http://c.org/2", ARTICLE.replace("Title", "Other")),
    (6, None, ""),
]


@pytest.mark.parametrize("parts", [1, 4, 50])
def test_differencing_does_not_depend_on_tasks(spark, parts):
    rows = spark.createDataFrame([(i, u, h, 0, "c") for i, u, h in PAGES], "page_id long, url string, html string, rank int, host string").drop("host").repartition(parts)
    spark.conf.set("spark.sql.shuffle.partitions", str(parts))
    try:
        got = sorted((r.page_id, r.text) for r in html.main_text(rows).collect())
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    both = "\n\ntext 5\n\nkept"
    assert got == [(1, "first story"), (2, "second story\n\nmore of it"), (3, "third story"), (4, "Home\n\nalone"), (5, "first story"), (6, ""), (6, ""), (7, "Home"), (8, "Title" + both), (9, "Other" + both)]


def test_no_pages(spark):
    assert html.main_text(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def rows_of(spark, n):
    out = [(i, random.choice(["s", "t", None]), "w " * random.choice([0, 3, 40, 900]) + str(i % (n // 2))) for i in range(n)]
    return spark.createDataFrame([*out, (0, "s", None), (None, None, "x")], "doc_id long, source string, text string")


def by_hand(rows, shards):
    """Leaves (lists of sizes) of the tree: cut along the widest scaled dimension, then the tie-break."""
    lo, hi = ([f(r["x"][i] for r in rows) for i in range(3)] for f in (min, max))
    for r in rows:
        r["x"] = [int((r["x"][i] - lo[i]) / ((hi[i] - lo[i]) or 1.0) * float((1 << 36) - 1)) for i in range(3)]

    def cut(part, k):
        if k == 1:
            return [part]
        if not part:
            return [[]] * k
        dim = max(range(3), key=lambda i: (max(r["x"][i] for r in part) - min(r["x"][i] for r in part), i))
        part = sorted(part, key=lambda r: (r["x"][dim], r["t"]))
        want, below, at = sum(r["size"] for r in part) * (k // 2) / k, 0, 0
        while at < len(part) - 1 and below + part[at]["size"] < want:
            below += part[at]["size"]
            at += 1
        at += want - below > part[at]["size"] / 2
        return cut(part[:at], k // 2) + cut(part[at:], k - k // 2)

    return cut(rows, shards)


def test_tree_by_hand(spark):
    docs = rows_of(spark, 500).coalesce(1)
    rows = [{"size": r["size"], "t": r["t"], "x": [r["x_size"], r["x_source"], r["x_id"]]} for r in sharding.metadata(docs).collect()]
    want = [sum(r["size"] for r in leaf) for leaf in by_hand(rows, 24)]
    got = sharding.kd_shards(docs).collect()
    sizes = [sum(r["size"] for r in got if r.shard == s) for s in range(24)]
    assert sizes == want and max(sizes) - min(sizes) <= 2 * max(r["size"] for r in got)
    for s in range(24):
        assert sorted(r.slot for r in got if r.shard == s) == list(range(sum(r.shard == s for r in got)))


def test_two_thousand_leaves_by_target_bytes(spark):
    docs = spark.range(20_000).selectExpr("id doc_id", "concat('s', id % 7) source", "repeat('x', cast(id % 50 as int)) text")
    total = docs.selectExpr("sum(length(text) + 8)").first()[0]
    sizes = [r.w for r in sharding.kd_shards(docs, target_bytes=-(-total // 2000)).groupBy("shard").agg({"size": "sum"}).toDF("shard", "w").collect()]
    assert len(sizes) == 2000 and max(sizes) - min(sizes) <= 2 * 58
