"""Queries over the given tables, one or more for each operator, with the SQL that gives the same rows."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillgraph.functions.tables import materialised, shared_dir
from quillgraph.operators import components, embeddings, generator, graph, membership, sampler
from quillgraph.sources import lines, memberships, metis

#: The supplier graph: cosines of suppliers by shared parts, the edges that are among so many heaviest of either end. It has edges, and
#: is not complete, at every size: suppliers have NEAREST neighbours or more, of as many as there are.
NEAREST = 5
WEIGHT, SEED = 5.0, 1
STATS = ("precision", "recall", "f1", "weighted_precision", "weighted_recall", "weighted_f1", "orphan_rate")


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _ps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.bipartite_from_edges(_table(spark, sf_dir, "lineitem"), "l_partkey", "l_suppkey")


def _graph(spark: SparkSession, sf_dir: str, kind: str = "nearest") -> tuple[DataFrame, DataFrame]:
    """The supplier graph's edges and vertices, written once: of kind "nearest", "all" (the whole projection), or "mean" (cosines over the mean)."""
    lists = materialised(graph.lists_from_edges(_table(spark, sf_dir, "lineitem"), "l_partkey", "l_suppkey"), "lists")
    edges = graph.project_lists(lists)
    if kind == "nearest":
        edges = graph.top_k_edges(edges, NEAREST)
    elif kind == "mean":
        edges = graph.project_lists(lists, membership.average_weight(edges).first()[0])
    return materialised(edges, "projection"), materialised(graph.right_vertices(lists.select("l", F.explode("rs").alias("r"))), "vertices")


def _z(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each supplier's nation as its cluster."""
    return _table(spark, sf_dir, "supplier").select(F.col("s_suppkey").cast("long").alias("vertex"), F.col("s_nationkey").cast("long").alias("cluster"))


def _right(spark: SparkSession, sf_dir: str) -> DataFrame:
    e, v = _graph(spark, sf_dir)
    return membership.affiliations(e, v, _z(spark, sf_dir)).select(F.col("vertex").alias("row"), F.col("cluster").alias("col"), F.col("score").alias("value")).where("value > 0")


def _rounded(df: DataFrame, *columns: str) -> DataFrame:
    return df.select(*[F.round(c, 6).alias(c) if c in columns else F.col(c).cast("long").alias(c) if dict(df.dtypes)[c] in ("int", "bigint") else F.col(c) for c in df.columns])


def _ratio(*columns: str, of: Callable) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: _rounded(of(spark, sf_dir), *columns)


def _on_graph(work: Callable, *columns: str, kind: str = "nearest") -> Callable[[SparkSession, str], DataFrame]:
    """A query of (edges, vertices, memberships) of the supplier graph."""
    return lambda spark, sf_dir: _rounded(work(*_graph(spark, sf_dir, kind), _z(spark, sf_dir)), *columns)


def _steps(e: DataFrame, v: DataFrame, z: DataFrame) -> DataFrame:
    return sampler.propose(e, graph.vertex_degrees(e, v), z, sampler.Settings(seed=SEED, weight=WEIGHT))


def _communities(spark: SparkSession, sf_dir: str) -> generator.Planted:
    """A graph planted on the suppliers, 40 to a community by key, a tenth of the edges between any two."""
    z = _table(spark, sf_dir, "supplier").select((F.col("s_suppkey") - 1).cast("long").alias("vertex"), F.floor((F.col("s_suppkey") - 1) / 40).cast("long").alias("cluster"))
    plan = generator.Plan(clusters=1, noise=0.1, least_p=0.4, most_p=0.6, least_size=3, most_size=60, high=0.2, low=0.05, high_share=0.15, seed=SEED)
    made = generator.planted_on(plan, materialised(z, "communities"), z.count())
    return generator.Planted(materialised(made.edges, "planted"), materialised(made.vertices, "vertices"), made.z)


def _settings(made: generator.Planted, **more) -> sampler.Settings:
    """20 epochs at most, or until under a twentieth of the vertices move; a community for each 30 vertices to begin with."""
    return sampler.Settings(clusters=max(2, made.vertices.count() // 30), max_epochs=20, least_moves=0.05, seed=SEED, **{"batches": 2} | more)


def _community_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = _communities(spark, sf_dir)
    return sampler.fit(made.edges, made.vertices, _settings(made))


def _bipartite_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each planted edge is a left vertex that has two suppliers at its right; their projection is the planted graph again."""
    made = _communities(spark, sf_dir)
    pairs = made.edges.where("src < dst").select(F.xxhash64("src", "dst").alias("l"), F.array("src", "dst").alias("r"))
    bip = materialised(pairs.select("l", F.explode("r").alias("r")), "bipartite")
    return sampler.bipartite_communities(bip, _settings(made, batches=1))[1]


def _colour_steps(e: DataFrame, v: DataFrame, z: DataFrame) -> DataFrame:
    """The steps of the second colour class."""
    coloured = graph.vertex_degrees(e, v).join(sampler.colours(e, v, SEED), "id")
    return sampler.propose(e, coloured, z, sampler.Settings(seed=SEED, weight=WEIGHT), batch=1)


def _again(write: Callable, read: Callable) -> Callable[[DataFrame, DataFrame, DataFrame], DataFrame]:
    """What is read from the text files that were written."""

    def work(e: DataFrame, v: DataFrame, z: DataFrame) -> DataFrame:
        path = f"{shared_dir(e.sparkSession)}/lines-{uuid.uuid4().hex}"
        write(e, v, z, path)
        return read(e.sparkSession, path)

    return work


def _clusters(z: DataFrame) -> DataFrame:
    return z.select(F.col("cluster").alias("id")).distinct()


def _lefts_and_rights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A bipartite text file of customers' nations and the suppliers' nations that they order from, written and read again."""
    pairs = _table(spark, sf_dir, "orders").join(_table(spark, sf_dir, "lineitem"), F.col("o_orderkey") == F.col("l_orderkey"))
    pairs = pairs.join(_table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey")).join(_table(spark, sf_dir, "supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
    bip = pairs.select(F.col("c_nationkey").cast("long").alias("l"), F.col("s_nationkey").cast("long").alias("r")).distinct()
    side = lambda a, b, at: bip.groupBy(a).agg(F.array_sort(F.collect_list(b)).alias("xs")).select((F.col(a) + at).alias("line"), "xs")
    nations = _table(spark, sf_dir, "nation").count()
    body = spark.range(1, 2 * nations + 1).withColumnRenamed("id", "line").join(side("l", "r", 1).unionByName(side("r", "l", nations + 1)), "line", "left")
    body = body.select("line", F.coalesce(F.array_join(F.transform("xs", lambda x: (x + 1).cast("string")), " "), F.lit("")).alias("value"))
    head = bip.agg(F.count(F.lit(1)).alias("m")).select(F.lit(0).cast("long").alias("line"), F.concat_ws(" ", F.lit(str(nations)), F.lit(str(nations)), F.col("m").cast("string")).alias("value"))
    path = f"{shared_dir(spark)}/lines-{uuid.uuid4().hex}"
    lines.write_lines(head.unionByName(body), path)
    return metis.read_bipartite_metis(spark, path).edges


def _two_rows(z: DataFrame) -> DataFrame:
    """Each supplier in its nation's cluster and in that of the next nation's number."""
    return z.unionByName(z.select("vertex", ((F.col("cluster") + 1) % 25).alias("cluster")))


def _planted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges planted in the suppliers' nations, and how well the nations predict them."""
    z = _z(spark, sf_dir)
    plan = generator.Plan(clusters=25, noise=0.2, least_p=0.5, most_p=0.7, least_size=3, most_size=60, high=0.2, low=0.05, high_share=0.15, seed=SEED)
    made = generator.planted_on(plan, z, z.count())
    return membership.prediction_stats(made.edges, made.vertices, z)


def _embedding(work: Callable) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: _rounded(work(_ps(spark, sf_dir), _right(spark, sf_dir)), "value")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "bipartite_edges": lambda s, d: _ps(s, d),
    "bipartite_transpose": lambda s, d: graph.transpose(_ps(s, d)),
    "bipartite_degrees": lambda s, d: graph.bipartite_degrees(_ps(s, d)),
    "bipartite_density": _ratio("density", of=lambda s, d: graph.bipartite_density(_ps(s, d))),
    "project_right_cosine": _on_graph(lambda e, v, z: e, "w", kind="all"),
    "project_right_threshold": _on_graph(lambda e, v, z: e, "w", kind="mean"),
    "project_left_cosine": _ratio("w", of=lambda s, d: graph.project_left(graph.transpose(graph.bipartite_from_edges(_table(s, d, "lineitem"), "l_orderkey", "l_partkey")))),
    "graph_stats": _on_graph(lambda e, v, z: graph.graph_stats(e, v), "density", "avg_w", "global_w", "sd_w"),
    "vertex_degrees": _on_graph(lambda e, v, z: graph.vertex_degrees(e, v), "wdeg"),
    "square_weights": _on_graph(lambda e, v, z: graph.square_weights(e), "w"),
    "neighbors_sorted": _on_graph(lambda e, v, z: graph.neighbors_sorted(e), "w"),
    "topk_edges": _on_graph(lambda e, v, z: graph.top_k_edges(e, 3), "w", kind="all"),
    "edge_weight_lookup": lambda s, d: _rounded(graph.edge_weights(_graph(s, d)[0], _table(s, d, "supplier").select(F.col("s_suppkey").cast("long").alias("src"), (F.col("s_suppkey") + 1).cast("long").alias("dst"))), "w"),
    "vertex_to_set_weight": _on_graph(lambda e, v, z: graph.weight_to_sets(e, z), "w"),
    "induced_subgraph": _on_graph(lambda e, v, z: graph.induced_subgraph(e, z.where("cluster < 10").select(F.col("vertex").alias("id"))), "w"),
    "weak_links": _on_graph(lambda e, v, z: graph.without_weak_links(e), "w"),
    "neighborhood_conductance": _on_graph(lambda e, v, z: graph.neighborhood_conductance(e, v), "conductance"),
    "neighborhood_conductance_unweighted": _on_graph(lambda e, v, z: graph.neighborhood_conductance(e, v, False), "conductance"),
    "best_subneighborhoods": _on_graph(lambda e, v, z: graph.best_subneighborhoods(e, v), "conductance"),
    "bottomk_neighborhoods": _on_graph(lambda e, v, z: sampler.bottom_neighborhoods(e, graph.neighborhood_conductance(e, v).withColumnRenamed("conductance", "cost"), 10)),
    "matrix_stats": _on_graph(lambda e, v, z: membership.matrix_stats(z, v, 30), "nnz_per_row", "empty_row_share", "empty_col_share"),
    "column_union_size": _on_graph(lambda e, v, z: membership.column_union_size(z, [1, 2, 3])),
    "small_cluster_filter": _on_graph(lambda e, v, z: membership.remove_small_clusters(z, 4)),
    "sum_rows": _on_graph(lambda e, v, z: membership.sum_rows(e, z), "w"),
    "sum_rows_contributors": _on_graph(lambda e, v, z: membership.sum_rows(e, z, True), "w"),
    "affiliation_scores": _on_graph(membership.affiliations, "score"),
    "cluster_precision_exact": _on_graph(lambda e, v, z: membership.cluster_precision(e, v, z), "precision"),
    "orphans": _on_graph(lambda e, v, z: membership.orphans(e, z)),
    "prediction_stats": _on_graph(membership.prediction_stats, *STATS),
    "connected_components": _on_graph(lambda e, v, z: components.connected_components(e, v)),
    "components_in_clusters": _on_graph(lambda e, v, z: components.divided_clusters(e, z)),
    "left_embeddings": _embedding(embeddings.left_embeddings),
    "left_embeddings_threshold": _embedding(lambda b, r: embeddings.left_embeddings(b, r, 2)),
    "right_embeddings_cosine": _embedding(lambda b, r: embeddings.right_embeddings(b, embeddings.left_embeddings(b, r))),
    "normalize_columns": _embedding(lambda b, r: embeddings.normalized(r, "col")),
    "normalize_rows": _embedding(lambda b, r: embeddings.normalized(embeddings.left_embeddings(b, r), "row")),
    "log_transform": _embedding(lambda b, r: embeddings.log_transformed(embeddings.left_embeddings(b, r))),
    "log_likelihood": _on_graph(lambda e, v, z: sampler.candidate_likelihoods(e, graph.vertex_degrees(e, v), z, WEIGHT), "ll"),
    "mh_single_batch": _on_graph(_steps),
    "mh_fraction_neighbors_batch": _on_graph(lambda e, v, z: sampler.fraction_proposals(e, graph.vertex_degrees(e, v), z, SEED)),
    "mh_fraction_cluster_batch": _on_graph(lambda e, v, z: sampler.fraction_proposals(e, graph.vertex_degrees(e, v), z, SEED, with_size=True)),
    "metis_lines": _on_graph(lambda e, v, z: metis.metis_lines(e, v)),
    "metis_lines_weighted": _on_graph(lambda e, v, z: metis.metis_lines(e, v, "%.3f")),
    "metis_round_trip": _on_graph(_again(lambda e, v, z, path: metis.write_metis(e, v, path), lambda spark, path: metis.read_metis(spark, path).edges), "w"),
    "bipartite_round_trip": _lefts_and_rights,
    "membership_row_lines": _on_graph(lambda e, v, z: memberships.row_lines(z, v)),
    "membership_column_lines": _on_graph(lambda e, v, z: memberships.column_lines(z, _clusters(z))),
    "membership_round_trip": _on_graph(_again(lambda e, v, z, path: memberships.write(memberships.row_lines(z, v), path), memberships.read_rows)),
    "scored_lines": _on_graph(lambda e, v, z: memberships.scored_lines(membership.affiliations(e, v, z).select(F.col("vertex").alias("row"), F.col("cluster").alias("col"), F.col("score").alias("value")), v, 25)),
    "precision_lines": _on_graph(lambda e, v, z: memberships.precision_lines(membership.cluster_precision(e, v, z))),
    "graph_violations": _on_graph(lambda e, v, z: metis.violations(e.where("(src + dst) % 7 <> 0 or src < dst").withColumn("w", F.when((F.col("src") + F.col("dst")) % 5 == 0, F.col("w") + F.col("src")).otherwise(F.col("w"))))),
    "degree_distribution": _on_graph(lambda e, v, z: membership.degree_distribution(e, v), "p"),
    "k_sample": _on_graph(lambda e, v, z: sampler.k_sample(v, 10, SEED)),
    "seeded_subneighborhoods": _on_graph(lambda e, v, z: sampler.seeded_subneighborhoods(e, v, 20, SEED)),
    "sampled_stats": _on_graph(lambda e, v, z: membership.sampled_stats(e, v, z, seed=SEED), "precision", "recall", "weighted_precision", "weighted_recall", "orphan_rate"),
    "prediction_stats_overlapping": _on_graph(lambda e, v, z: membership.prediction_stats(e, v, _two_rows(z)), *STATS),
    "set_likelihoods": _on_graph(lambda e, v, z: sampler.set_likelihoods(e, graph.vertex_degrees(e, v), z, sampler.rows_of(_two_rows(z)), WEIGHT).select("vertex", F.array_join(F.transform("row", lambda c: c.cast("string")), " ").alias("row"), "ll"), "ll"),
    "log_likelihood_unweighted": _on_graph(lambda e, v, z: sampler.candidate_likelihoods(e.withColumn("w", F.lit(1.0)), graph.vertex_degrees(e.withColumn("w", F.lit(1.0)), v), z, WEIGHT), "ll"),
    "cover_clusters": _on_graph(lambda e, v, z: sampler.cover_clusters(e, z, 2)),
    "mh_pure_random_batch": _on_graph(lambda e, v, z: sampler.pure_random_proposals(v, 25, SEED)),
    "mh_multi_membership": _on_graph(lambda e, v, z: sampler.set_steps(e, graph.vertex_degrees(e, v), _two_rows(z), sampler.Settings(seed=SEED, strategy="multiple")).select("vertex", *[F.array_join(F.transform(c, lambda x: x.cast("string")), " ").alias(c) for c in ("current", "proposal")], "accepted")),
    "planted_partition": _ratio(*STATS, of=_planted),
    "community_fit": _ratio(of=_community_fit),
    "bipartite_communities": _ratio("value", of=_bipartite_fit),
    "uncovered_subneighborhoods": _on_graph(lambda e, v, z: sampler.uncovered_subneighborhoods(e, v, 20, SEED)),
    "vertex_colours": _on_graph(lambda e, v, z: sampler.colours(e, v, SEED)),
    "mh_colour_batch": _on_graph(_colour_steps),
    "vertex_sampled_stats": _on_graph(lambda e, v, z: membership.vertex_sampled_stats(e, v, _two_rows(z), 0.3, SEED), *STATS),
}


_EDGES = {
    "all": "SELECT i AS src, j AS dst, w FROM both_",
    "mean": "SELECT i AS src, j AS dst, w FROM both_ WHERE w - (SELECT avg(w) FROM both_) > 1e-5",
    "nearest": "SELECT i AS src, j AS dst, w FROM top_ UNION SELECT j, i, w FROM top_",
}


def _sql(select: str, kind: str = "nearest") -> str:
    """The supplier graph's tables before a query: ps, e, v, z, c, t, sets, m."""
    return f"""
WITH RECURSIVE ps AS (SELECT DISTINCT l_partkey AS l, l_suppkey AS r FROM lineitem WHERE l_partkey IS NOT NULL AND l_suppkey IS NOT NULL),
rd AS (SELECT r, count(*) AS d FROM ps GROUP BY r),
pairs AS (SELECT a.r AS i, b.r AS j, count(*) AS n FROM ps a JOIN ps b ON a.l = b.l AND a.r < b.r GROUP BY 1, 2),
half AS (SELECT i, j, n / sqrt(CAST(x.d AS DOUBLE) * y.d) AS w FROM pairs JOIN rd x ON i = x.r JOIN rd y ON j = y.r),
both_ AS (SELECT CAST(i AS BIGINT) AS i, CAST(j AS BIGINT) AS j, w FROM half WHERE w > 1e-5 UNION ALL SELECT j, i, w FROM half WHERE w > 1e-5),
top_ AS (SELECT i, j, w FROM (SELECT *, row_number() OVER (PARTITION BY i ORDER BY w DESC, j) AS k FROM both_) WHERE k <= {NEAREST}),
e AS ({_EDGES[kind]}),
v AS (SELECT CAST(r AS BIGINT) AS id, count(w) AS deg, coalesce(sum(w), 0) AS wdeg FROM rd LEFT JOIN e ON r = src GROUP BY 1),
z AS (SELECT CAST(s_suppkey AS BIGINT) AS vertex, CAST(s_nationkey AS BIGINT) AS cluster FROM supplier),
c AS (SELECT cluster, count(*) AS size FROM z GROUP BY 1),
t AS (SELECT coalesce(sum(w), 0) AS total, coalesce(avg(w), 1) AS avg_w, count(*) AS k, (SELECT count(*) FROM v) AS n FROM e),
sets AS (SELECT src AS vertex, cluster, count(*) AS n, sum(w) AS w, string_agg(CAST(dst AS VARCHAR), ',' ORDER BY dst) AS contributors FROM e JOIN z ON dst = z.vertex GROUP BY 1, 2),
den AS (SELECT z.vertex, z.cluster, size, coalesce(w, 0) AS w, wdeg + avg_w * (size - 1 - coalesce(sets.n, 0)) AS den FROM z JOIN v ON z.vertex = id JOIN c ON z.cluster = c.cluster LEFT JOIN sets ON z.vertex = sets.vertex AND z.cluster = sets.cluster, t),
aff AS (SELECT vertex, cluster, CASE WHEN size = 1 THEN 1.0 WHEN den <= 0 THEN 0.0 ELSE w / den END AS score FROM den),
m AS (SELECT vertex AS row_, cluster AS col, score AS value FROM aff WHERE score > 0),
lefts AS (SELECT l, col, sum(value) AS value, count(*) AS n FROM ps JOIN m ON r = row_ GROUP BY 1, 2),
cand AS (SELECT vertex, sets.cluster, sets.n, w, size FROM sets JOIN c ON sets.cluster = c.cluster UNION ALL SELECT id, -1, 0, 0.0, 0 FROM v WHERE deg > 0),
ll AS (SELECT vertex, cluster, {WEIGHT} * w + (t.n - size - (deg - cand.n)) * (wdeg / deg) AS ll FROM cand JOIN v ON vertex = id, t)
{select}"""


def _u(*parts: str) -> str:
    return f"((CAST('0x' || substr(md5(concat_ws('|', {', '.join(parts)})), 1, 8) AS BIGINT) + 0.5::DOUBLE) / 4294967296.0::DOUBLE)"


def _conductance(w: str, wdeg: str, total: str) -> str:
    return f""", hood AS (SELECT id AS i, id AS j FROM v UNION ALL SELECT src, dst FROM e),
vol AS (SELECT i, sum({wdeg}) AS vol FROM hood JOIN v ON j = id GROUP BY 1),
cut AS (SELECT h.i, sum({w}) AS cut FROM hood h JOIN e ON h.j = e.src WHERE NOT EXISTS (SELECT 1 FROM hood g WHERE g.i = h.i AND g.j = e.dst) GROUP BY 1)
SELECT id, round(CASE WHEN deg < 2 THEN 1.0 WHEN least(vol, {total} - vol) < 1e-9 THEN 0.0 ELSE coalesce(cut, 0) / least(vol, {total} - vol) END, 6) AS conductance
FROM v JOIN vol ON v.id = vol.i LEFT JOIN cut ON v.id = cut.i, t"""


_BEST = """, li AS (SELECT src AS seed, dst AS id, row_number() OVER (PARTITION BY src ORDER BY w DESC, dst) AS rank FROM e),
inn AS (SELECT a.seed, a.rank, sum(w) AS inn FROM li a JOIN e ON a.id = e.src JOIN li b ON b.seed = a.seed AND b.id = e.dst WHERE b.rank < a.rank GROUP BY 1, 2),
run AS (SELECT li.seed, li.rank, sum(wdeg - 2 * coalesce(inn, 0)) OVER o AS cut, sum(wdeg) OVER o AS vol FROM li JOIN v ON li.id = v.id LEFT JOIN inn ON li.seed = inn.seed AND li.rank = inn.rank WINDOW o AS (PARTITION BY li.seed ORDER BY li.rank ROWS UNBOUNDED PRECEDING)),
con AS (SELECT seed, rank, round(CASE WHEN rank = 1 THEN 1.0 WHEN vol < 1e-9 OR total - vol < 1e-9 THEN NULL ELSE cut / least(vol, total - vol) END, 9) AS q FROM run, t),
best AS (SELECT seed, rank, q FROM (SELECT *, row_number() OVER (PARTITION BY seed ORDER BY q, rank) AS k FROM con WHERE q IS NOT NULL) WHERE k = 1)"""

_PRECISION = """, pr AS (SELECT a.cluster, sum(coalesce(e.w, 0)) AS w, sum(CASE WHEN e.w > 0 THEN e.w WHEN va.deg + vb.deg > 0 THEN (va.wdeg + vb.wdeg) / (va.deg + vb.deg) ELSE 0 END) AS den
FROM z a JOIN z b ON a.cluster = b.cluster AND a.vertex < b.vertex JOIN v va ON a.vertex = va.id JOIN v vb ON b.vertex = vb.id LEFT JOIN e ON src = a.vertex AND dst = b.vertex GROUP BY 1),
q AS (SELECT c.cluster, coalesce(w, 0) AS w, coalesce(den, 0) AS den FROM c LEFT JOIN pr ON c.cluster = pr.cluster) """

_TWO = ", z2 AS (SELECT vertex, cluster FROM z UNION ALL SELECT vertex, (cluster + 1) % 25 FROM z)"


def _stats(z: str) -> str:
    """The prediction statistics of memberships ``z``, by listing all pairs."""
    return f""", pp AS (SELECT DISTINCT a.vertex AS i, b.vertex AS j FROM {z} a JOIN {z} b ON a.cluster = b.cluster AND a.vertex < b.vertex),
s AS (SELECT (SELECT count(*) FROM pp) AS predicted, (SELECT coalesce(sum(CASE WHEN a.deg + b.deg > 0 THEN (a.wdeg + b.wdeg) / (a.deg + b.deg) ELSE 0 END), 0) FROM pp JOIN v a ON i = a.id JOIN v b ON j = b.id) AS wpred,
count(*) AS actual, coalesce(sum(w), 0) AS wact, count(pp.i) AS tp, coalesce(sum(CASE WHEN pp.i IS NOT NULL THEN w END), 0) AS wtp FROM (SELECT * FROM e WHERE src < dst) h LEFT JOIN pp ON h.src = pp.i AND h.dst = pp.j),
r AS (SELECT s.*, coalesce(tp / nullif(predicted, 0), 0) AS p, coalesce(tp / nullif(actual, 0), 0) AS r, coalesce(wtp / nullif(wpred, 0), 0) AS wp, coalesce(wtp / nullif(wact, 0), 0) AS wr FROM s)
SELECT actual, predicted, tp AS true_positive, CAST(t.n * (t.n - 1) / 2 AS BIGINT) - actual - predicted + tp AS true_negative, round(p, 6) AS precision, round(r, 6) AS recall, round(coalesce(2 * p * r / nullif(p + r, 0), 0), 6) AS f1,
round(wp, 6) AS weighted_precision, round(wr, 6) AS weighted_recall, round(coalesce(2 * wp * wr / nullif(wp + wr, 0), 0), 6) AS weighted_f1, round((SELECT avg(CASE WHEN deg = 0 THEN 1.0 ELSE 0.0 END) FROM v), 6) AS orphan_rate FROM r, t"""


_MH = f""", cur AS (SELECT ll.*, coalesce(z.cluster, -1) AS current FROM ll LEFT JOIN z ON ll.vertex = z.vertex),
g AS (SELECT *, ll - ln(-ln({_u("'gumbel'", f"'{SEED}'", "'0'", "vertex", "cluster")})) AS g FROM cur),
best AS (SELECT *, row_number() OVER (PARTITION BY vertex ORDER BY g DESC, cluster DESC) AS k FROM g WHERE cluster <> current OR current = -1),
old AS (SELECT vertex, ll AS old FROM cur WHERE cluster = current)
SELECT best.vertex, current, best.cluster AS proposal, best.cluster <> current AND ln({_u("'accept'", f"'{SEED}'", "'0'", "best.vertex")}) < 0.5 * (ll - coalesce(old, (t.n - coalesce(size, 0) - deg) * (wdeg / deg))) AS accepted
FROM best JOIN v ON best.vertex = v.id LEFT JOIN c ON c.cluster = current LEFT JOIN old ON old.vertex = best.vertex, t WHERE best.k = 1"""

#: One vertex after another in the order of its draw; the state is the colours so far.
_COLOURS = f""", ord AS (SELECT id, row_number() OVER (ORDER BY {_u(chr(39) + 'colour' + chr(39), chr(39) + str(SEED) + chr(39), 'id')}, id) AS ix FROM v),
earlier AS (SELECT a.ix, any_value(a.id) AS id, list(b.ix) FILTER (WHERE b.ix < a.ix) AS before FROM ord a LEFT JOIN e ON a.id = e.src LEFT JOIN ord b ON e.dst = b.id GROUP BY a.ix),
sweep(ix, cs) AS (SELECT 0::BIGINT, []::BIGINT[] UNION ALL
  SELECT sweep.ix + 1, list_append(cs, list_min(list_filter(range(0, len(cs) + 1), lambda c: NOT list_contains(list_transform(coalesce(before, []), lambda p: cs[p]), c)))) FROM sweep JOIN earlier ON earlier.ix = sweep.ix + 1),
coloured AS (SELECT id, cs[ix] AS colour FROM ord, (SELECT cs FROM sweep ORDER BY ix DESC LIMIT 1))"""

#: One vertex after another takes the best prefix of its uncovered neighbours, unless it is covered; the state is what is covered.
_UNCOVERED = f""", ord AS (SELECT id, row_number() OVER (ORDER BY {_u(chr(39) + 'uncovered' + chr(39), chr(39) + str(SEED) + chr(39), 'id')}, id) AS ix FROM v),
ranked AS (SELECT src, dst, wdeg, row_number() OVER (PARTITION BY src ORDER BY w DESC, dst) AS rank FROM e JOIN v ON dst = id),
near AS (SELECT src, list({{'d': dst, 'g': wdeg}} ORDER BY rank) AS ns FROM ranked GROUP BY src),
ws AS (SELECT src, map_from_entries(list((dst, w))) AS m FROM e GROUP BY src),
all_ws AS (SELECT map_from_entries(list((src, m))) AS mm FROM ws),
sweep(ix, covered, seed, got) AS (SELECT 0::BIGINT, []::BIGINT[], NULL::BIGINT, []::BIGINT[] UNION ALL
  SELECT ix, list_concat(covered, got), seed, got FROM (SELECT ix, covered, seed, CASE WHEN len(ns) = 0 THEN []::BIGINT[] ELSE list_transform(ns[1 : best], lambda x: x.d) END AS got FROM
    (SELECT ix, covered, seed, ns, list_position(qs, list_min(qs)) AS best FROM
      (SELECT ix, covered, seed, ns, list_transform(range(1, len(ns) + 1), lambda r: CASE WHEN r = 1 THEN 1.0::DOUBLE WHEN vols[r] < 1e-9 OR total - vols[r] < 1e-9 THEN NULL ELSE round(cuts[r] / least(vols[r], total - vols[r]), 9) END) AS qs FROM
        (SELECT ix, covered, seed, ns, total, list_transform(range(1, len(ns) + 1), lambda r: list_sum(list_transform(ns[1 : r], lambda x: x.g))) AS vols,
           list_transform(range(1, len(ns) + 1), lambda r: list_sum(list_transform(ns[1 : r], lambda x: x.g - coalesce(list_sum(list_transform(ns[1 : r], lambda y: coalesce(mm[x.d][y.d], 0))), 0)))) AS cuts FROM
          (SELECT sweep.ix + 1 AS ix, covered, ord.id AS seed, total, mm, CASE WHEN list_contains(covered, ord.id) THEN [] ELSE list_filter(coalesce(ns, []), lambda x: NOT list_contains(covered, x.d)) END AS ns
           FROM sweep JOIN ord ON ord.ix = sweep.ix + 1 LEFT JOIN near ON ord.id = near.src, t, all_ws))))))
SELECT unnest(got) AS vertex, seed AS cluster FROM (SELECT got, seed FROM sweep WHERE len(got) > 0 ORDER BY ix LIMIT 20)"""

_LL = "SELECT vertex, cluster, round(ll, 6) AS ll FROM ll"

ORACLE_SQL: dict[str, str] = {
    "bipartite_edges": _sql("SELECT CAST(l AS BIGINT) AS l, CAST(r AS BIGINT) AS r FROM ps"),
    "bipartite_transpose": _sql("SELECT CAST(r AS BIGINT) AS l, CAST(l AS BIGINT) AS r FROM ps"),
    "bipartite_degrees": _sql("SELECT 'l' AS side, CAST(l AS BIGINT) AS id, count(*) AS degree FROM ps GROUP BY l UNION ALL SELECT 'r', CAST(r AS BIGINT), count(*) FROM ps GROUP BY r"),
    "bipartite_density": _sql("SELECT count(*) AS n_edges, count(DISTINCT l) AS n_left, count(DISTINCT r) AS n_right, round(count(*) / (CAST(count(DISTINCT l) AS DOUBLE) * count(DISTINCT r)), 6) AS density FROM ps"),
    "project_right_cosine": _sql("SELECT src, dst, round(w, 6) AS w FROM e", "all"),
    "project_right_threshold": _sql("SELECT src, dst, round(w, 6) AS w FROM e", "mean"),
    "project_left_cosine": """
WITH b AS (SELECT DISTINCT l_orderkey AS l, l_partkey AS r FROM lineitem WHERE l_orderkey IS NOT NULL AND l_partkey IS NOT NULL),
d AS (SELECT r, count(*) AS d FROM b GROUP BY r),
p AS (SELECT x.r AS i, y.r AS j, count(*) AS n FROM b x JOIN b y ON x.l = y.l AND x.r < y.r GROUP BY 1, 2),
h AS (SELECT i, j, n / sqrt(CAST(x.d AS DOUBLE) * y.d) AS w FROM p JOIN d x ON i = x.r JOIN d y ON j = y.r)
SELECT CAST(i AS BIGINT) AS src, CAST(j AS BIGINT) AS dst, round(w, 6) AS w FROM h WHERE w > 1e-5 UNION ALL SELECT j, i, round(w, 6) FROM h WHERE w > 1e-5""",
    "graph_stats": _sql("SELECT t.n, CAST(k / 2 AS BIGINT) AS m, round(k / (t.n * (t.n - 1.0)), 6) AS density, round(CASE WHEN k > 0 THEN avg_w ELSE 0 END, 6) AS avg_w, round(total, 6) AS global_w, round(CASE WHEN k > 2 THEN sqrt((SELECT sum((w - t2.avg_w) * (w - t2.avg_w)) FROM e, t t2) / (k / 2 - 1)) ELSE 0 END, 6) AS sd_w FROM t"),
    "vertex_degrees": _sql("SELECT id, deg, round(wdeg, 6) AS wdeg FROM v"),
    "square_weights": _sql("SELECT src, dst, round(w * w, 6) AS w FROM e"),
    "neighbors_sorted": _sql("SELECT src, dst, round(w, 6) AS w, row_number() OVER (PARTITION BY src ORDER BY w DESC, dst) AS rank FROM e"),
    "topk_edges": _sql(", b AS (SELECT src, dst, w FROM (SELECT *, row_number() OVER (PARTITION BY src ORDER BY w DESC, dst) AS k FROM e) WHERE k <= 3) SELECT src, dst, round(w, 6) AS w FROM (SELECT src, dst, w FROM b UNION SELECT dst, src, w FROM b)", "all"),
    "edge_weight_lookup": _sql("SELECT CAST(s_suppkey AS BIGINT) AS src, CAST(s_suppkey + 1 AS BIGINT) AS dst, round(coalesce(w, 0), 6) AS w FROM supplier LEFT JOIN e ON src = s_suppkey AND dst = s_suppkey + 1"),
    "vertex_to_set_weight": _sql("SELECT vertex, cluster, n, round(w, 6) AS w FROM sets"),
    "induced_subgraph": _sql("SELECT src, dst, round(w, 6) AS w FROM e WHERE src IN (SELECT vertex FROM z WHERE cluster < 10) AND dst IN (SELECT vertex FROM z WHERE cluster < 10)"),
    "weak_links": _sql("SELECT src, dst, round(w, 6) AS w FROM e WHERE EXISTS (SELECT 1 FROM e a JOIN e b ON a.dst = b.dst WHERE a.src = e.src AND b.src = e.dst)"),
    "neighborhood_conductance": _sql(_conductance("w", "wdeg", "total")),
    "neighborhood_conductance_unweighted": _sql(_conductance("1.0::DOUBLE", "deg::DOUBLE", "k")),
    "best_subneighborhoods": _sql(_BEST + " SELECT seed, rank AS n, round(q, 6) AS conductance FROM best"),
    "matrix_stats": _sql("SELECT round((SELECT count(*) FROM z) / (SELECT count(*) FROM v), 6) AS nnz_per_row, round(((SELECT count(*) FROM v) - (SELECT count(DISTINCT vertex) FROM z)) / (SELECT count(*) FROM v), 6) AS empty_row_share, round((30 - count(*)) / 30, 6) AS empty_col_share, min(size) AS min_size, max(size) AS max_size FROM c"),
    "column_union_size": _sql("SELECT count(DISTINCT vertex) AS n FROM z WHERE cluster IN (1, 2, 3)"),
    "small_cluster_filter": _sql("SELECT vertex, fresh AS cluster FROM z JOIN (SELECT cluster, row_number() OVER (ORDER BY cluster) - 1 AS fresh FROM c WHERE size >= 4) k ON z.cluster = k.cluster"),
    "sum_rows": _sql("SELECT vertex, cluster, n, round(w, 6) AS w FROM sets"),
    "sum_rows_contributors": _sql("SELECT vertex, cluster, n, round(w, 6) AS w, contributors FROM sets"),
    "affiliation_scores": _sql("SELECT vertex, cluster, round(score, 6) AS score FROM aff"),
    "cluster_precision_exact": _sql(_PRECISION + "SELECT cluster, round(CASE WHEN den > 0 THEN w / den ELSE 0 END, 6) AS precision FROM q"),
    "precision_lines": _sql(_PRECISION + "SELECT row_number() OVER (ORDER BY cluster) AS line, printf('%.2f', CASE WHEN den > 0 THEN w / den ELSE 0 END) AS value FROM q"),
    "orphans": _sql("SELECT DISTINCT vertex FROM z WHERE NOT EXISTS (SELECT 1 FROM e JOIN z b ON dst = b.vertex WHERE src = z.vertex AND b.cluster = z.cluster)"),
    "prediction_stats": _sql(_stats("z")),
    "prediction_stats_overlapping": _sql(_TWO + _stats("z2")),
    "metis_lines": _sql("SELECT 0::BIGINT AS line, CAST((SELECT count(*) FROM v) AS VARCHAR) || ' ' || CAST((SELECT count(*) // 2 FROM e) AS VARCHAR) AS value UNION ALL SELECT id + 1, coalesce(string_agg(CAST(dst + 1 AS VARCHAR), ' ' ORDER BY dst), '') FROM v LEFT JOIN e ON id = src GROUP BY id"),
    "metis_lines_weighted": _sql("SELECT 0::BIGINT AS line, CAST((SELECT count(*) FROM v) AS VARCHAR) || ' ' || CAST((SELECT count(*) // 2 FROM e) AS VARCHAR) || ' 1' AS value UNION ALL SELECT id + 1, coalesce(string_agg(CAST(dst + 1 AS VARCHAR) || ' ' || printf('%.3f', w), ' ' ORDER BY dst), '') FROM v LEFT JOIN e ON id = src GROUP BY id"),
    "metis_round_trip": _sql("SELECT src, dst, 1.0::DOUBLE AS w FROM e"),
    "bipartite_round_trip": "SELECT DISTINCT CAST(c_nationkey AS BIGINT) AS l, CAST(s_nationkey AS BIGINT) AS r FROM orders JOIN lineitem ON o_orderkey = l_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey",
    "membership_row_lines": _sql("SELECT id + 1 AS line, coalesce(string_agg(CAST(cluster + 1 AS VARCHAR), ' ' ORDER BY cluster), '') AS value FROM v LEFT JOIN z ON id = vertex GROUP BY id"),
    "membership_column_lines": _sql("SELECT cluster + 1 AS line, string_agg(CAST(vertex + 1 AS VARCHAR), ' ' ORDER BY vertex) AS value FROM z GROUP BY cluster"),
    "membership_round_trip": _sql("SELECT vertex, cluster FROM z JOIN v ON vertex = id"),
    "scored_lines": _sql("SELECT 0::BIGINT AS line, CAST((SELECT count(*) FROM v) AS VARCHAR) || ' 25' AS value UNION ALL SELECT id + 1, coalesce(string_agg(CAST(cluster + 1 AS VARCHAR) || ':' || CASE WHEN score = 0 THEN '0.0' ELSE printf('%.*f', CAST(1 - floor(log10(round(score, CAST(1 - floor(log10(score)) AS INT)))) AS INT), score) END, ' ' ORDER BY cluster), '') FROM v LEFT JOIN aff ON id = vertex GROUP BY id"),
    "graph_violations": _sql(", x AS (SELECT src, dst, CASE WHEN (src + dst) % 5 = 0 THEN w + src ELSE w END AS w FROM e WHERE (src + dst) % 7 <> 0 OR src < dst) SELECT CASE WHEN y.w IS NULL THEN 'one-sided' ELSE 'weights differ' END AS kind, x.src, x.dst FROM x LEFT JOIN x y ON x.src = y.dst AND x.dst = y.src WHERE y.w IS NULL OR abs(x.w - y.w) > 1e-5"),
    "degree_distribution": _sql("SELECT id, round(deg / CAST(k AS DOUBLE), 6) AS p FROM v, t"),
    "k_sample": _sql(f"SELECT id FROM v ORDER BY {_u(chr(39) + 'sample' + chr(39), chr(39) + str(SEED) + chr(39), 'id')}, id LIMIT 10"),
    "seeded_subneighborhoods": _sql(f""", seeds AS (SELECT id AS seed FROM v ORDER BY {_u(chr(39) + 'seeds' + chr(39), chr(39) + str(SEED) + chr(39), 'id')}, id LIMIT 20)""" + _BEST + """, li2 AS (SELECT * FROM li WHERE seed IN (SELECT seed FROM seeds))
SELECT li2.id AS vertex, li2.seed AS cluster FROM li2 JOIN best ON li2.seed = best.seed WHERE li2.rank <= best.rank"""),
    "set_likelihoods": _sql(_TWO + f""", hit AS (SELECT src AS vertex, count(*) AS n, sum(w) AS w FROM e WHERE EXISTS (SELECT 1 FROM z2 JOIN z ON z2.cluster = z.cluster WHERE z2.vertex = e.src AND z.vertex = e.dst) GROUP BY 1),
un AS (SELECT z2.vertex, count(DISTINCT z.vertex) AS size FROM z2 JOIN z ON z2.cluster = z.cluster GROUP BY 1),
names AS (SELECT vertex, string_agg(CAST(cluster AS VARCHAR), ' ' ORDER BY cluster) AS "row" FROM z2 GROUP BY 1)
SELECT id AS vertex, "row", round({WEIGHT} * coalesce(hit.w, 0) + (t.n - coalesce(size, 0) - (deg - coalesce(hit.n, 0))) * (wdeg / nullif(deg, 0)), 6) AS ll FROM names JOIN v ON names.vertex = id LEFT JOIN hit ON id = hit.vertex LEFT JOIN un ON id = un.vertex, t"""),
    "log_likelihood_unweighted": _sql(f"SELECT cand.vertex, cand.cluster, round({WEIGHT} * cand.n + (t.n - size - (deg - cand.n)), 6) AS ll FROM cand JOIN v ON vertex = id, t"),
    "cover_clusters": _sql(""", own AS (SELECT src, dst, cluster, w FROM e JOIN z ON dst = z.vertex),
s1 AS (SELECT src, cluster FROM (SELECT src, cluster, row_number() OVER (PARTITION BY src ORDER BY round(sum(w), 9) DESC, cluster) AS k FROM own GROUP BY src, cluster) WHERE k = 1),
rest AS (SELECT own.* FROM own WHERE NOT EXISTS (SELECT 1 FROM own o JOIN s1 ON o.src = s1.src AND o.cluster = s1.cluster WHERE o.src = own.src AND o.dst = own.dst)),
s2 AS (SELECT src, cluster FROM (SELECT src, cluster, row_number() OVER (PARTITION BY src ORDER BY round(sum(w), 9) DESC, cluster) AS k FROM rest GROUP BY src, cluster) WHERE k = 1)
SELECT src AS vertex, 0::BIGINT AS step, cluster FROM s1 UNION ALL SELECT src, 1, cluster FROM s2"""),
    "mh_pure_random_batch": _sql(f"SELECT id AS vertex, CAST(k.cluster AS BIGINT) AS cluster FROM v, range(25) k(cluster) WHERE {_u(chr(39) + 'coin' + chr(39), chr(39) + str(SEED) + chr(39), chr(39) + '0' + chr(39), 'id', 'k.cluster')} < 0.5"),
    "components_in_clusters": _sql(""", inner_ AS (SELECT a.cluster, src, dst FROM e JOIN z a ON src = a.vertex JOIN z b ON dst = b.vertex AND a.cluster = b.cluster),
strong AS (SELECT * FROM inner_ i WHERE EXISTS (SELECT 1 FROM inner_ a JOIN inner_ b ON a.dst = b.dst AND a.cluster = b.cluster WHERE a.cluster = i.cluster AND a.src = i.src AND b.src = i.dst)),
lab AS (WITH RECURSIVE w(cluster, a, b) AS (SELECT z.cluster, vertex, vertex FROM z JOIN c ON z.cluster = c.cluster WHERE size > 1 UNION SELECT w.cluster, w.a, strong.dst FROM w JOIN strong ON w.b = strong.src AND w.cluster = strong.cluster) SELECT cluster, a AS id, min(b) AS component FROM w GROUP BY 1, 2)
SELECT id AS vertex, dense_rank() OVER (ORDER BY cluster, component) - 1 AS cluster FROM lab"""),
    "connected_components": _sql(", reach AS (SELECT id AS a, id AS b FROM v) SELECT id, component FROM (WITH RECURSIVE w(a, b) AS (SELECT id, id FROM v UNION SELECT w.a, e.dst FROM w JOIN e ON w.b = e.src) SELECT a AS id, min(b) AS component FROM w GROUP BY a)"),
    "left_embeddings": _sql('SELECT CAST(l AS BIGINT) AS "row", col, round(value, 6) AS value FROM lefts'),
    "left_embeddings_threshold": _sql('SELECT CAST(l AS BIGINT) AS "row", col, round(value, 6) AS value FROM lefts WHERE n >= 2'),
    "right_embeddings_cosine": _sql(', ln AS (SELECT col, sqrt(sum(value * value)) AS norm FROM lefts GROUP BY 1), s AS (SELECT r, col, sum(value) AS s FROM ps JOIN lefts ON ps.l = lefts.l GROUP BY 1, 2) SELECT CAST(s.r AS BIGINT) AS "row", s.col, round(s / (norm * sqrt(CAST(d AS DOUBLE))), 6) AS value FROM s JOIN ln ON s.col = ln.col JOIN rd ON s.r = rd.r WHERE norm > 0 AND s / (norm * sqrt(CAST(d AS DOUBLE))) > 1e-5'),
    "normalize_columns": _sql('SELECT row_ AS "row", col, round(value / sqrt(sum(value * value) OVER (PARTITION BY col)), 6) AS value FROM m'),
    "normalize_rows": _sql('SELECT CAST(l AS BIGINT) AS "row", col, round(value / sqrt(sum(value * value) OVER (PARTITION BY l)), 6) AS value FROM lefts'),
    "log_transform": _sql('SELECT CAST(l AS BIGINT) AS "row", col, round(log10(1 + value), 6) AS value FROM lefts'),
    "log_likelihood": _sql(_LL),
    "mh_single_batch": _sql(_MH),
    "mh_colour_batch": _sql(_COLOURS + _MH + " AND best.vertex IN (SELECT id FROM coloured WHERE colour = 1)"),
    "mh_fraction_neighbors_batch": _sql(f"SELECT sets.vertex, sets.cluster FROM sets JOIN v ON sets.vertex = id WHERE {_u(chr(39) + 'fraction' + chr(39), f'{chr(39)}{SEED}{chr(39)}', chr(39) + '0' + chr(39), 'sets.vertex', 'sets.cluster')} < w / wdeg"),
    "mh_fraction_cluster_batch": _sql(f"SELECT sets.vertex, sets.cluster FROM sets JOIN v ON sets.vertex = id JOIN c ON sets.cluster = c.cluster WHERE {_u(chr(39) + 'fraction' + chr(39), f'{chr(39)}{SEED}{chr(39)}', chr(39) + '0' + chr(39), 'sets.vertex', 'sets.cluster')} < w / (wdeg + w / n * (size - n))"),
    "vertex_colours": _sql(_COLOURS + " SELECT id, colour FROM coloured"),
    "uncovered_subneighborhoods": _sql(_UNCOVERED),
    "vertex_sampled_stats": _sql(_TWO + f""", sm AS (SELECT * FROM v ORDER BY {_u("'evaluated'", f"'{SEED}'", "id")}, id LIMIT (SELECT CAST(floor(count(*) * 0.3) AS BIGINT) FROM v)),
pp AS (SELECT DISTINCT a.vertex AS i, b.vertex AS j FROM z2 a JOIN z2 b ON a.cluster = b.cluster AND a.vertex <> b.vertex WHERE a.vertex IN (SELECT id FROM sm)),
s AS (SELECT (SELECT count(*) FROM pp) AS predicted, (SELECT coalesce(sum(CASE WHEN a.deg + b.deg > 0 THEN (a.wdeg + b.wdeg) / (a.deg + b.deg) ELSE 0 END), 0) FROM pp JOIN v a ON i = a.id JOIN v b ON j = b.id) AS wpred,
count(*) AS actual, coalesce(sum(w), 0) AS wact, count(pp.i) AS tp, coalesce(sum(CASE WHEN pp.i IS NOT NULL THEN w END), 0) AS wtp FROM (SELECT * FROM e WHERE src IN (SELECT id FROM sm)) h LEFT JOIN pp ON h.src = pp.i AND h.dst = pp.j),
r AS (SELECT s.*, coalesce(tp / nullif(predicted, 0), 0) AS p, coalesce(tp / nullif(actual, 0), 0) AS r, coalesce(wtp / nullif(wpred, 0), 0) AS wp, coalesce(wtp / nullif(wact, 0), 0) AS wr FROM s)
SELECT actual, predicted, tp AS true_positive, CAST((SELECT count(*) FROM sm) * (t.n - 1) AS BIGINT) - actual - predicted + tp AS true_negative, round(p, 6) AS precision, round(r, 6) AS recall, round(coalesce(2 * p * r / nullif(p + r, 0), 0), 6) AS f1,
round(wp, 6) AS weighted_precision, round(wr, 6) AS weighted_recall, round(coalesce(2 * wp * wr / nullif(wp + wr, 0), 0), 6) AS weighted_f1, round((SELECT avg(CASE WHEN deg = 0 THEN 1.0 ELSE 0.0 END) FROM sm), 6) AS orphan_rate FROM r, t"""),
    "sampled_stats": _sql(f""", no AS (SELECT src, dst, w, row_number() OVER (ORDER BY src, dst) - 1 AS no FROM e),
hit AS (SELECT w, EXISTS (SELECT 1 FROM z a JOIN z b ON a.cluster = b.cluster WHERE a.vertex = src AND b.vertex = dst) AS hit FROM (SELECT CAST(floor({_u("'recall'", f"'{SEED}'", "draw")} * k) AS BIGINT) AS no FROM range(1000000) d(draw), t) x JOIN no ON x.no = no.no),
rec AS (SELECT avg(CASE WHEN hit THEN 1.0 ELSE 0.0 END) AS recall, sum(CASE WHEN hit THEN w ELSE 0 END) / sum(w) AS weighted_recall FROM hit),
place AS (SELECT cluster, vertex, deg, wdeg, row_number() OVER (PARTITION BY cluster ORDER BY vertex) - 1 AS ix FROM z JOIN v ON vertex = id),
own AS (SELECT cluster, size, CAST(size AS DOUBLE) * (size - 1) AS own FROM c WHERE size > 1),
draws AS (SELECT cluster, size, unnest(range(1, CAST(ceil(own / (SELECT sum(own) FROM own) * 100000) AS BIGINT) + 1)) AS draw FROM own),
ij AS (SELECT cluster, CAST(floor({_u("'pair-a'", f"'{SEED}'", "cluster", "draw")} * size) AS BIGINT) AS i, CAST(floor({_u("'pair-b'", f"'{SEED}'", "cluster", "draw")} * (size - 1)) AS BIGINT) AS j FROM draws),
pairs_ AS (SELECT w, CASE WHEN a.deg + b.deg > 0 THEN (a.wdeg + b.wdeg) / (a.deg + b.deg) ELSE 0 END AS mean FROM ij JOIN place a ON ij.cluster = a.cluster AND ij.i = a.ix JOIN place b ON ij.cluster = b.cluster AND b.ix = CASE WHEN ij.j >= ij.i THEN ij.j + 1 ELSE ij.j END LEFT JOIN e ON e.src = a.vertex AND e.dst = b.vertex),
prec AS (SELECT avg(CASE WHEN w > 0 THEN 1.0 ELSE 0.0 END) AS precision, sum(coalesce(w, 0)) / sum(CASE WHEN w > 0 THEN w ELSE mean END) AS weighted_precision FROM pairs_),
numbered AS (SELECT id, row_number() OVER (ORDER BY id) - 1 AS no FROM v),
alone AS (SELECT coalesce(avg(CASE WHEN EXISTS (SELECT 1 FROM z a JOIN e ON e.src = a.vertex JOIN z b ON b.vertex = e.dst AND a.cluster = b.cluster WHERE a.vertex = numbered.id) THEN 0.0 ELSE 1.0 END), 0) AS orphan_rate FROM (SELECT CAST(floor({_u("'orphans'", f"'{SEED}'", "draw")} * t.n) AS BIGINT) AS no FROM range(5000) d(draw), t) x JOIN numbered ON x.no = numbered.no WHERE numbered.id IN (SELECT vertex FROM z))
SELECT round(precision, 6) AS precision, round(recall, 6) AS recall, round(weighted_precision, 6) AS weighted_precision, round(weighted_recall, 6) AS weighted_recall, round(orphan_rate, 6) AS orphan_rate FROM prec, rec, alone"""),
}
