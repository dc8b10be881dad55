"""Fixed small graphs: two 4-cliques with a bridge, bipartite goldens, and empty inputs."""

import itertools
import math

import pytest

from quillgraph.operators import components, embeddings, graph, membership, sampler

SIDES = [range(4), range(4, 8)]
G8 = [(a, b) for s in SIDES for a, b in itertools.combinations(s, 2)] + [(0, 4)]


@pytest.fixture(scope="module")
def g8(spark):
    edges = graph.graph_from_edges(spark.createDataFrame(G8, "a long, b long"), "a", "b").cache()
    return edges, spark.range(8)


def test_conductance(g8, spark):
    got = {r.id: r.conductance for r in graph.neighborhood_conductance(*g8).collect()}
    assert got[1] == pytest.approx(1 / 13)
    assert got[4] == pytest.approx(3 / 9)
    alone = graph.neighborhood_conductance(g8[0], spark.range(9)).where("id = 8").first()
    assert alone.conductance == 1.0


def test_weak_links_and_components(g8):
    edges, v = g8
    assert graph.without_weak_links(edges).count() == 24
    assert {r.component for r in components.connected_components(edges, v).collect()} == {0}
    kept = components.connected_components(graph.without_weak_links(edges), v).collect()
    assert {r.id: r.component for r in kept} == {i: i // 4 * 4 for i in range(8)}


def test_best_prefix(g8, spark):
    edges, v = g8
    lists = spark.createDataFrame([(1, i, i + 1) for i in range(7)] + [(2, i, i + 1) for i in range(3)], "seed long, id long, rank int")
    assert {r.seed: r.n for r in graph.best_prefixes(lists, edges, v).collect()} == {1: 4, 2: 3}


def test_affiliations(g8, spark):
    edges, v = g8
    z = spark.createDataFrame([(i, i // 4) for i in range(8)], "vertex long, cluster long")
    got = {r.vertex: r.score for r in membership.affiliations(edges, v, z).collect()}
    assert got == pytest.approx({i: 0.75 if i in (0, 4) else 1.0 for i in range(8)})
    assert membership.orphans(edges, z).count() == 0


def test_fit_finds_the_cliques(g8):
    z = sampler.fit(*g8, sampler.Settings(clusters=8, max_epochs=6, scale=1.0, seed=3))
    groups = {}
    for r in z.collect():
        groups.setdefault(r.cluster, set()).add(r.vertex)
    assert sorted(map(sorted, groups.values())) == [[0, 1, 2, 3], [4, 5, 6, 7]]


def test_bottom_neighborhoods_match_the_sequential_rule(g8):
    edges, v = g8
    cost = graph.neighborhood_conductance(edges, v).withColumnRenamed("conductance", "cost")
    seen, want = set(), {}
    near = {i: {b for a, b in G8 if a == i} | {a for a, b in G8 if b == i} for i in range(8)}
    for i in [r.id for r in cost.orderBy("cost", "id").collect()]:
        if i not in seen:
            for x in ({i} | near[i]) - seen:
                want[x] = i
            seen |= {i} | near[i]
    assert {r.vertex: r.cluster for r in sampler.bottom_neighborhoods(edges, cost, 8).collect()} == want


def test_projection_and_embeddings(spark):
    bip = graph.bipartite_from_edges(spark.createDataFrame([(0, 0), (0, 1), (1, 0), (1, 1), (2, 1), (2, None)], "l long, r long"), "l", "r")
    got = graph.project_right(bip).collect()
    assert {(r.src, r.dst) for r in got} == {(0, 1), (1, 0)}
    assert got[0].w == pytest.approx(2 / math.sqrt(6))
    m = spark.createDataFrame([(0, 0, 3.0), (0, 1, 4.0), (1, 0, 0.0)], "row long, col long, value double")
    assert {(r.row, r.col): r.value for r in embeddings.normalized(m, "row").collect()} == pytest.approx({(0, 0): 0.6, (0, 1): 0.8, (1, 0): 0.0})


def test_empty_graph(spark):
    edges = spark.createDataFrame([], "src long, dst long, w double")
    row = graph.graph_stats(edges, spark.range(0)).first()
    assert (row.n, row.m, row.density, row.sd_w) == (0, 0, 0.0, 0.0)
    assert components.connected_components(edges, spark.range(2)).count() == 2
