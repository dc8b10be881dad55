"""The registered graph at every size, colours, uncovered sub-neighbourhoods, exact samples, inclusion and exclusion."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from quillgraph.functions.tables import least_by, materialised, uniform, with_running
from quillgraph.operators import graph, membership, sampler
from quillgraph.plans import queries


def u(*parts):
    return (int(hashlib.md5("|".join(map(str, parts)).encode()).hexdigest()[:8], 16) + 0.5) / 2**32


@pytest.mark.parametrize("size", ["sf0.001", "sf0.01", "sf0.1"])
def test_registered_graph_has_edges_and_is_not_complete(spark, size):
    edges, vertices = queries._graph(spark, f"/root/testdata/{size}")
    m, n = edges.count(), vertices.count()
    assert 2 * n <= m < n * (n - 1) and m <= 2 * queries.NEAREST * n


@pytest.fixture(scope="module")
def some(spark):
    rng = random.Random(5)
    pairs = {tuple(sorted(rng.sample(range(40), 2))) for _ in range(120)} | {(0, i) for i in range(1, 30)}
    rows = [(a, b, rng.choice([0.5, 1.0, rng.random()])) for a, b in pairs]
    w = {(a, b): x for a, b, x in rows} | {(b, a): x for a, b, x in rows}
    e = graph.graph_from_edges(spark.createDataFrame(rows, "a long, b long, w double"), "a", "b", "w").cache()
    return w, e, spark.range(42)


def test_colours_are_those_of_one_after_another(some):
    w, e, v = some
    want = {}
    for i in sorted(range(42), key=lambda i: (u("colour", 3, i), i)):
        taken = {want[b] for a, b in w if a == i and b in want}
        want[i] = next(c for c in range(42) if c not in taken)
    assert {r.id: r.colour for r in sampler.colours(e, v, 3).collect()} == want


def test_uncovered_are_those_of_one_after_another(some):
    w, e, v = some
    wdeg = {i: sum(x for (a, _), x in w.items() if a == i) for i in range(42)}
    total, covered, want = sum(wdeg.values()), set(), []
    for seed in sorted(range(42), key=lambda i: (u("uncovered", 3, i), i)):
        if seed in covered or len({c for c, _ in want}) == 4:
            continue
        ns = sorted((b for a, b in w if a == seed and b not in covered), key=lambda b: (-w[seed, b], b))
        best = None
        for n in range(1, len(ns) + 1):
            s = ns[:n]
            vol, inside = sum(wdeg[i] for i in s), sum(w.get((i, j), 0) for i in s for j in s)
            q = 1.0 if n == 1 else None if min(vol, total - vol) < 1e-9 else round((vol - inside) / min(vol, total - vol), 9)
            if q is not None and (best is None or q < best[0]):
                best = (q, n)
        if best:
            want += [(seed, i) for i in ns[: best[1]]]
            covered |= set(ns[: best[1]])
    assert sorted((r.cluster, r.vertex) for r in sampler.uncovered_subneighborhoods(e, v, 4, 3).collect()) == sorted(want)


def test_pairs_by_subsets_and_by_kinds(spark, some):
    w, e, v = some
    rng = random.Random(1)
    z = spark.createDataFrame(sorted({(i, rng.randrange(6)) for i in range(42) for _ in range(rng.randrange(5))}), "vertex long, cluster long").cache()
    d = graph.vertex_degrees(e, v)
    a, b = membership._by_subsets(z, d).first(), membership._by_kinds(z, d).first()
    assert a.predicted == b.predicted and a.weight_predicted == pytest.approx(b.weight_predicted)
    every, whole = membership.vertex_sampled_stats(e, v, z, 1.0).first(), membership.prediction_stats(e, v, z).first()
    assert every.predicted == 2 * whole.predicted and every.true_negative == 2 * whole.true_negative
    assert every.weighted_f1 == pytest.approx(whole.weighted_f1) and every.orphan_rate == whole.orphan_rate


def test_least_by_is_exact(spark):
    want = sorted(range(5000), key=lambda i: (u("x", i), i))
    for k in (0, 1, 777, 5000, 6000):
        assert {r.id for r in least_by(spark.range(5000), k, uniform("x", F.col("id"))).collect()} == set(want[:k])


def test_running_sums_over_ranges(spark):
    rng = random.Random(7)
    rows = [(0 if i % 3 == 0 else rng.randrange(50), i, rng.randrange(9)) for i in range(3000)]
    seen, want = {}, {}
    for g, i, x in rows:
        n, s = seen.get(g, (0, 0))
        seen[g] = want[i] = (n + 1, s + x)
    table = materialised(spark.createDataFrame(rows, "g long, i long, x long"), "rows")
    assert {r.i: (r.place, r.total_x) for r in with_running(table, ["g"], ["i"], ("x",)).collect()} == want


def test_a_fit_starts_as_its_settings_say(spark, some, monkeypatch):
    _, e, v = some
    monkeypatch.setattr(sampler, "start_from", lambda edges, vertices, settings: vertices.selectExpr("id vertex", f"cast({len(settings.start)} as long) cluster"))
    z = sampler.fit(e, v, sampler.Settings(clusters=3, max_epochs=0, start="uncovered", divide=False))
    assert {r.cluster for r in z.collect()} == {0} and z.count() == 42
    single = spark.createDataFrame([(0, 0), (1, 0), (2, 5)], "vertex long, cluster long")
    assert {r.vertex for r in sampler.fit(e, v, sampler.Settings(clusters=3, max_epochs=0, divide=False), single).collect()} == {0, 1}


def test_colour_batches_accept_no_two_neighbours_at_once(some):
    w, e, v = some
    z = sampler.fit(e, v, sampler.Settings(clusters=4, max_epochs=1, colours=True, start="random"))
    assert z.count() > 0
    coloured = {r.id: r.colour for r in sampler.colours(e, v, 1).collect()}
    assert all(coloured[a] != coloured[b] for a, b in w)
