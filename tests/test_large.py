"""What lets graph queries run on larger tables: wedges are counted where they are made, and unions by kinds of members."""

import collections
import itertools
import math
import random
import re

import pytest

from quillgraph.functions.tables import materialised
from quillgraph.operators import graph, sampler
from quillgraph.plans import queries


def lists(seed):
    """Left vertices 0 to 59 with right ones; the first has all 30, right vertex 29 is in all lists."""
    rng = random.Random(seed)
    return {0: set(range(30))} | {x: set(rng.sample(range(30), rng.randrange(6))) | {29} for x in range(1, 60)}


def most_rows_out_of_a_join(df):
    """Of an executed plan, by the joins' own counts."""

    def joins(plan):
        if plan.getClass().getSimpleName() == "AdaptiveSparkPlanExec":
            plan = plan.executedPlan()
        own = [plan.metrics().apply("numOutputRows").value()] if "Join" in plan.nodeName() and plan.metrics().contains("numOutputRows") else []
        below = [plan.plan()] if plan.getClass().getSimpleName().endswith("QueryStageExec") else [plan.children().apply(i) for i in range(plan.children().size())]
        return own + [n for x in below for n in joins(x)]

    found = joins(df._jdf.queryExecution().executedPlan())
    assert found
    return max(found)


@pytest.mark.parametrize("block", [1, 7, 100, 1 << 23])
def test_blocks_give_the_cosines_of_all_pairs(spark, monkeypatch, block):
    monkeypatch.setattr(graph, "BLOCK", block)
    rows = lists(2)
    degree, common = collections.Counter(r for rs in rows.values() for r in rs), collections.Counter(p for rs in rows.values() for p in itertools.permutations(rs, 2))
    bip = spark.createDataFrame([(x, r) for x, rs in rows.items() for r in rs], "l long, r long")
    got = [(r.src, r.dst, r.w) for r in graph.project_right(bip).collect()]
    assert len(got) == len(common) and {(a, b): w for a, b, w in got} == {(a, b): n / math.sqrt(degree[a] * degree[b]) for (a, b), n in common.items()}


def test_wedges_are_not_shuffled(spark):
    bip = spark.createDataFrame([(x, r) for x, rs in lists(3).items() for r in rs], "l long, r long")
    plan = graph.top_k_edges(graph.project_right(bip), 5)._jdf.queryExecution().executedPlan().toString()
    assert not re.search(r"hashpartitioning\(r#\d+L?, r2#", plan)


def test_no_left_vertices(spark):
    assert graph.project_right(spark.createDataFrame([], "l long, r long")).count() == 0


def test_sets_are_weighed_by_kinds_of_members(spark):
    rng = random.Random(4)
    pairs = {tuple(sorted(rng.sample(range(40), 2))) for _ in range(150)}
    w = {p: rng.random() for a, b in pairs for p in ((a, b), (b, a))}
    w = {p: w[min(p), max(p)] for p in w}
    rows = {i: rng.sample(range(8), rng.randrange(4)) for i in range(40)}
    asked = [(i, sorted(rng.sample(range(9), n))) for i in range(40) for n in range(6)]
    e, v = spark.createDataFrame([(a, b, x) for (a, b), x in w.items()], "src long, dst long, w double"), spark.range(41)
    z = spark.createDataFrame([(i, c) for i, cs in rows.items() for c in cs] + [(None, 1), (3, None)], "vertex long, cluster long")
    sets = spark.createDataFrame(asked, "vertex long, row array<long>")
    want = {}
    for i, row in asked:
        size, near = sum(bool(set(row) & set(cs)) for cs in rows.values()), {b: x for (a, b), x in w.items() if a == i}
        hits = [x for b, x in near.items() if set(row) & set(rows[b])]
        want[i, tuple(row)] = 5.0 * sum(hits) + (41 - size - (len(near) - len(hits))) * sum(near.values()) / len(near) if near else None
    df = sampler.set_likelihoods(e, graph.vertex_degrees(e, v), z, sets)
    got = {(r.vertex, tuple(r.row)): r.ll for r in df.collect()}
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k]) for k in want)


def test_a_union_s_members_are_not_listed(spark):
    """4,000 members in two kinds, 400 sets: joins pass on kinds, not 800,000 members."""
    z = spark.range(4000).selectExpr("id vertex", "explode(array(id % 2, 2 + id % 2)) cluster")
    e, v = graph.graph_from_edges(spark.range(4000).selectExpr("id a", "(id + 1) % 4000 b"), "a", "b"), spark.range(4000)
    sets = spark.range(400).selectExpr("id vertex", "array(id % 2, 3 + id) row")
    df = sampler.set_likelihoods(e, graph.vertex_degrees(e, v), z, sets)
    df.collect()
    assert most_rows_out_of_a_join(df) <= 20_000


def test_lists_are_made_with_one_shuffle(spark):
    rows = [(x, r) for x, rs in lists(5).items() for r in rs]
    table = spark.createDataFrame(2 * rows + [(None, 1), (1, None)], "l_partkey int, l_suppkey int")
    df = graph.lists_from_edges(table, "l_partkey", "l_suppkey")
    assert sorted((x.l, r) for x in df.collect() for r in x.rs) == sorted(rows)
    assert df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0].count("Exchange hashpartitioning") == 1


def test_the_registered_graph_is_written_with_little_shuffled(spark, tmp_path, monkeypatch):
    """Lists, not wedges or pairs: the wedges are 20 times the rows here, and the graph's tables hold each row once."""
    rng = random.Random(6)
    rows = [(x, r) for x in range(300) for r in rng.sample(range(60), 40)]
    spark.createDataFrame(rows, "l_partkey long, l_suppkey long").write.parquet(f"{tmp_path}/lineitem.parquet")
    written = []
    monkeypatch.setattr(queries, "materialised", lambda df, name: written.append((name, df)) or materialised(df, name))
    edges, vertices = queries._graph(spark, str(tmp_path))
    assert [n for n, _ in written] == ["lists", "projection", "vertices"] and written[0][1].count() == 300
    plan = written[1][1]._jdf.queryExecution().executedPlan().toString()
    assert not re.search(r"hashpartitioning\((l#\d+L?, i#|r#\d+L?, r2#)", plan)
    assert vertices.count() == 60 and edges.count() >= 300
