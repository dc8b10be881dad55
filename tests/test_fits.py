"""Goldens of small graphs, planted graphs, overlapping memberships, and the bipartite pipeline."""

import itertools
import math

import pytest

from quillgraph.operators import embeddings, generator, graph, membership, sampler

B7X4 = {0: [0, 3], 1: [0, 2, 3], 2: [0, 1, 3], 3: [2], 4: [0, 2, 3], 5: [2, 3, 1], 6: [2, 3, 1]}


def edges_of(spark, rows):
    return graph.graph_from_edges(spark.createDataFrame(rows, "a long, b long, w double"), "a", "b", "w")


def test_imputed_precision_by_listing_pairs(spark):
    rows = [(0, 1, 0.5), (0, 2, 2.0), (1, 2, 1.0), (2, 3, 0.25), (4, 5, 3.0)]
    e, v = edges_of(spark, rows), spark.range(7)
    z = spark.createDataFrame([(0, 0), (1, 0), (2, 0), (3, 0), (3, 1), (4, 1), (0, 1), (6, 2)], "vertex long, cluster long")
    w = {(a, b): x for a, b, x in rows} | {(b, a): x for a, b, x in rows}
    deg = {i: sum(a == i for a, _ in w) for i in range(7)}
    wdeg = {i: sum(x for (a, _), x in w.items() if a == i) for i in range(7)}
    mean = lambda i, j: (wdeg[i] + wdeg[j]) / (deg[i] + deg[j]) if deg[i] + deg[j] else 0.0
    members = {0: [0, 1, 2, 3], 1: [0, 3, 4], 2: [6]}
    want = {}
    for c, m in members.items():
        pairs = list(itertools.combinations(m, 2))
        hit, all_ = sum(w.get(p, 0) for p in pairs), sum(w.get(p) or mean(*p) for p in pairs)
        want[c] = hit / all_ if all_ else 0.0
    assert {r.cluster: r.precision for r in membership.cluster_precision(e, v, z).collect()} == pytest.approx(want)
    pairs = {p for m in members.values() for p in itertools.combinations(m, 2)}
    s = membership.prediction_stats(e, v, z).first()
    assert (s.predicted, s.actual, s.true_positive, s.true_negative) == (len(pairs), 5, 4, 21 - len(pairs) - 1)
    assert s.weighted_precision == pytest.approx(sum(w.get(p, 0) for p in pairs) / sum(mean(*p) for p in pairs))
    assert s.orphan_rate == pytest.approx(1 / 7)
    some = {r.cluster: r for r in membership.sampled_precision(e, v, z, 4000).collect()}
    assert some[0].true_positive / some[0].predicted == pytest.approx(4 / 6, abs=0.05) and 2 not in some


def test_projections(spark):
    bip = spark.createDataFrame([(x, y) for x, ys in B7X4.items() for y in ys], "l long, r long")
    assert graph.bipartite_density(bip).first().density == pytest.approx(18 / 28)
    w = {(r.src, r.dst): r.w for r in graph.project_right(bip).collect()}
    degree = {r: sum(r in ys for ys in B7X4.values()) for r in range(4)}
    for a, b in itertools.combinations(range(4), 2):
        shared = sum(a in ys and b in ys for ys in B7X4.values())
        assert w.get((a, b), 0.0) == pytest.approx(shared / math.sqrt(degree[a] * degree[b]))


def test_a_hub_is_dealt_into_blocks(spark, monkeypatch):
    monkeypatch.setattr(graph, "BLOCK", 3)
    bip = spark.createDataFrame([(x, y) for x, ys in B7X4.items() for y in ys] + [(7, y) for y in range(20)], "l long, r long")
    got = {(r.src, r.dst): r.w for r in graph.project_right(bip).collect()}
    monkeypatch.setattr(graph, "BLOCK", 1000)
    assert got == pytest.approx({(r.src, r.dst): r.w for r in graph.project_right(bip).collect()}) and len(got) == 380


def test_top_two_of_both_ends(spark):
    e = edges_of(spark, [(0, 1, 0.25), (0, 2, 0.3), (1, 2, 0.001), (1, 3, 0.25), (2, 3, 0.25), (0, 3, 0.001)])
    got = {(r.src, r.dst) for r in graph.top_k_edges(e, 1).collect()}
    assert got == {(0, 2), (2, 0), (1, 0), (0, 1), (3, 1), (1, 3)}


def test_contributors(spark):
    e = edges_of(spark, [(0, 1, 0.1), (0, 4, 1.0), (1, 2, 1.0), (2, 3, 1.0), (3, 4, 1.0)])
    z = spark.createDataFrame([(0, 0), (1, 1), (1, 4), (2, 2), (3, 3), (4, 4)], "vertex long, cluster long")
    got = {r.cluster: (r.n, round(r.w, 6), r.contributors) for r in membership.sum_rows(e, z, True).where("vertex = 0").collect()}
    assert got == {1: (1, 0.1, "1"), 4: (2, 1.1, "1,4")}


def test_plans_are_checked():
    with pytest.raises(ValueError, match="sizes"):
        generator.Plan(3, 0.1, 0.4, 0.7, 20, 20)
    with pytest.raises(ValueError, match="probabilities"):
        generator.Plan(3, 0.1, 0.8, 0.7, 20, 30)
    with pytest.raises(ValueError, match="strategy"):
        sampler.Settings(strategy="none")


@pytest.fixture(scope="module")
def planted(spark):
    plan = generator.Plan(clusters=5, noise=0.2, least_p=0.5, most_p=0.7, least_size=30, most_size=60, high=0.2, low=0.05, high_share=0.15, seed=3)
    made = generator.disjoint_clusters(spark, plan)
    return plan, generator.Planted(made.edges.cache(), made.vertices, made.z.cache())


def test_planted_sizes(planted):
    plan, made = planted
    n, m = made.vertices.count(), made.edges.count() / 2
    assert 5 * 30 <= n < 5 * 60 and made.z.count() == n
    inside = membership.shared_edges(made.edges, made.z).count() / 2
    sizes = [r["size"] for r in membership.cluster_sizes(made.z).collect()]
    mean = sum(plan.inside_p(s) * s * (s - 1) / 2 for s in sizes)
    assert abs(inside - mean) < 6 * math.sqrt(mean) + 40 and 0.05 < (m - inside) / m < 0.4
    w = made.edges.selectExpr("min(w)", "max(w)").first()
    assert w[0] > 0 and made.edges.where("src = dst").count() == 0 and w[1] < 1


def test_fit_finds_planted_clusters(planted):
    _, made = planted
    history = []
    z = sampler.fit(made.edges, made.vertices, sampler.Settings(clusters=8, max_epochs=8, seed=2), history=history)
    truth, got = (membership.prediction_stats(made.edges, made.vertices, x).first() for x in (made.z, z))
    assert got.f1 > 0.5 * truth.f1 and got.weighted_f1 > 0.5 * truth.weighted_f1
    assert [h.epoch for h in history] == list(range(len(history))) and history[-1].moved < history[0].moved
    assert len(sampler.metric_lines(history)) == len(history) + 1


def test_overlapping_clusters_with_many_memberships(spark):
    plan = generator.Plan(clusters=6, noise=0.1, least_p=0.4, most_p=0.7, least_size=20, most_size=40, high=0.2, low=0.05, high_share=0.15, seed=4)
    made = generator.overlapping_clusters(spark, plan, 1.5, 2)
    edges = made.edges.cache()
    rows = sampler.rows_of(made.z).selectExpr("max(size(row))", "avg(size(row))").first()
    assert rows[0] == 2 and 1.3 < rows[1] <= 1.6
    settings = sampler.Settings(clusters=10, max_epochs=3, seed=1, strategy="multiple", most_memberships=3, start="best_neighborhood")
    z = sampler.fit(edges, made.vertices, settings, sampler.start_from(edges, made.vertices, settings))
    truth, got = (membership.prediction_stats(edges, made.vertices, x).first() for x in (made.z, z))
    assert got.f1 > 0.5 * truth.f1 and got.weighted_f1 > 0.5 * truth.weighted_f1


def test_set_steps_against_a_plain_likelihood(spark):
    e = edges_of(spark, [(0, 1, 1.0), (0, 2, 2.0), (0, 3, 0.5), (1, 2, 1.0)]).cache()
    v = graph.vertex_degrees(e, spark.range(4)).cache()
    z = spark.createDataFrame([(1, 0), (2, 0), (2, 1), (3, 1), (0, 2)], "vertex long, cluster long")
    sets = spark.createDataFrame([(0, [0, 1]), (0, [0]), (0, [2]), (0, [])], "vertex long, row array<bigint>")
    got = {tuple(r.row): r.ll for r in sampler.set_likelihoods(e, v, z, sets, 5.0).collect()}
    mean = 3.5 / 3
    assert got == pytest.approx({(0, 1): 5 * 3.5 + (4 - 3 - 0) * mean, (0,): 5 * 3.0 + (4 - 2 - 1) * mean, (2,): (4 - 1 - 3) * mean, (): (4 - 0 - 3) * mean})
    for strategy in sampler.STRATEGIES[1:]:
        steps = sampler.set_steps(e, v, z, sampler.Settings(clusters=3, strategy=strategy)).collect()
        assert {r.vertex for r in steps} <= {0, 1, 2, 3} and all(r.proposal == sorted(set(r.proposal)) for r in steps)


def test_starts(spark):
    e = edges_of(spark, [(0, 1, 1.0), (0, 2, 2.0), (3, 4, 0.5), (1, 2, 1.0)]).cache()
    for start in sampler.STARTS:
        z = sampler.start_from(e, spark.range(8), sampler.Settings(clusters=6, start=start))
        assert 1 <= z.select("cluster").distinct().count() <= 6
    full = sampler.start_from(e, spark.range(8), sampler.Settings(clusters=6))
    assert full.select("cluster").distinct().count() == 6  # padded with single vertices
    assert sampler.k_sample(spark.range(100), 5).collect() == sampler.k_sample(spark.range(100).repartition(7), 5).collect()


def test_bipartite_pipeline(spark):
    """Three groups of five left and three right vertices; a right vertex of each is shared with the next group's last left one."""
    rows = [(5 * g + i, 3 * g + r) for g in range(3) for i in range(4) for r in range(3)]
    rows += [(5 * g + 4, 3 * ((g + k) % 3)) for g in range(3) for k in range(2)]
    bip = spark.createDataFrame(rows, "l long, r long").cache()
    start = spark.createDataFrame([(r, r // 3) for r in range(9)], "vertex long, cluster long")
    settings = sampler.Settings(clusters=3, max_epochs=3, scale=1.0, seed=1)
    left, right = sampler.bipartite_communities(bip, settings, start=start, least_edges=1)
    value = {(r.row, r.col): r.value for r in left.collect()}
    assert len(value) == 18 and sorted({round(x, 6) for x in value.values()}) == [0.830479, 2.830479]
    assert sorted({round(r.value, 6) for r in right.collect()}) == [0.058642, 0.916757, 0.979149]
    few, _ = sampler.bipartite_communities(bip, settings, start=start, least_edges=2)
    assert few.count() == 12
    _, plain = sampler.bipartite_communities(bip, settings, start=start, step_four=False, normalize_right=True, squared=True)
    assert {round(r.norm, 6) for r in embeddings.norms(plain, "col").collect()} == {1.0}
