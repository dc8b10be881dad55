"""Memberships z(vertex, cluster): counts, scores and evaluation against a graph."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillgraph.functions.tables import least_by, materialised, uniform, with_running
from quillgraph.operators.graph import vertex_degrees, weight_to_sets

#: Rows of memberships are taken apart into their subsets up to so many clusters.
MOST_TAKEN_APART = 10


def cluster_sizes(z: DataFrame) -> DataFrame:
    return z.groupBy("cluster").agg(F.count(F.lit(1)).alias("size"))


def matrix_stats(z: DataFrame, vertices: DataFrame, n_clusters: int) -> DataFrame:
    """nnz_per_row, empty_row_share, empty_col_share, min_size, max_size. ``n_clusters`` counts empty columns too."""
    sizes = cluster_sizes(z).agg(F.count(F.lit(1)).alias("c"), F.coalesce(F.sum("size"), F.lit(0)).alias("nnz"), F.coalesce(F.min("size"), F.lit(0)).alias("min_size"), F.coalesce(F.max("size"), F.lit(0)).alias("max_size"))
    rows = vertices.agg(F.count(F.lit(1)).alias("n")).crossJoin(z.agg(F.count_distinct("vertex").alias("rows"))).crossJoin(sizes)  # one row each
    n = F.when(F.col("n") > 0, F.col("n"))
    return rows.select((F.col("nnz") / n).alias("nnz_per_row"), ((F.col("n") - F.col("rows")) / n).alias("empty_row_share"), ((n_clusters - F.col("c")) / F.lit(max(n_clusters, 1))).alias("empty_col_share"), "min_size", "max_size")


def column_union_size(z: DataFrame, clusters: list[int]) -> DataFrame:
    return z.where(F.col("cluster").isin(clusters)).agg(F.count_distinct("vertex").alias("n"))


def remove_small_clusters(z: DataFrame, least: int) -> DataFrame:
    """Clusters of at least so many, renumbered from 0 by rising id (one row per cluster is ranked)."""
    kept = cluster_sizes(z).where(F.col("size") >= least).select("cluster", (F.row_number().over(Window.orderBy("cluster")) - 1).cast("long").alias("fresh"))
    return z.join(kept, "cluster").select("vertex", F.col("fresh").alias("cluster"))


def sum_rows(edges: DataFrame, z: DataFrame, contributors: bool = False) -> DataFrame:
    """vertex, cluster, n, w over a vertex' neighbours' rows; with the neighbours' sorted ids if asked for."""
    if not contributors:
        return weight_to_sets(edges, z)
    got = edges.join(z.select(F.col("vertex").alias("dst"), "cluster"), "dst")
    return got.groupBy(F.col("src").alias("vertex"), "cluster").agg(F.count(F.lit(1)).alias("n"), F.sum("w").alias("w"), F.array_join(F.array_sort(F.collect_set("dst")), ",").alias("contributors"))


def average_weight(edges: DataFrame) -> DataFrame:
    return edges.agg(F.coalesce(F.avg("w"), F.lit(1.0)).alias("avg_w"))


def affiliations(edges: DataFrame, vertices: DataFrame, z: DataFrame, figures: DataFrame | None = None) -> DataFrame:
    """vertex, cluster, score of every membership: weight inside over weight at the vertex plus average weight for absent edges.

    ``figures``: edges whose degrees and average weight are taken instead of the edges' own."""
    figures = edges if figures is None else figures
    v = vertex_degrees(figures, vertices).withColumnRenamed("id", "vertex")
    got = z.join(v, "vertex").join(cluster_sizes(z), "cluster").join(weight_to_sets(edges, z), ["vertex", "cluster"], "left").crossJoin(F.broadcast(average_weight(figures)))  # one row
    n, w = F.coalesce("n", F.lit(0)), F.coalesce("w", F.lit(0.0))
    den = F.col("wdeg") + F.col("avg_w") * (F.col("size") - 1 - n)
    return got.select("vertex", "cluster", F.when(F.col("size") == 1, 1.0).when(den <= 0, 0.0).otherwise(w / F.when(den > 0, den)).alias("score"))


def shared_edges(edges: DataFrame, z: DataFrame) -> DataFrame:
    """src, dst, w of the directed edges whose ends share a cluster."""
    a, b = z.select(F.col("vertex").alias("src"), "cluster"), z.select(F.col("vertex").alias("dst"), "cluster")
    return edges.join(a, "src").join(b, ["dst", "cluster"]).select("src", "dst", "w").distinct()


def _ratio(a, b):
    return F.when(b > 0, a / F.when(b > 0, b)).otherwise(0.0)


def imputed_pairs(groups: DataFrame, v: DataFrame, by: str) -> DataFrame:
    """``by``, pairs, weight: the number of vertex pairs in each group of groups(``by``, vertex), and the sum of their mean weights per edge.

    A pair's mean is (wdeg + wdeg) / (deg + deg), so vertices of one degree count as one class and classes are paired, not vertices."""
    d = groups.join(v.select(F.col("id").alias("vertex"), "deg", "wdeg"), "vertex").groupBy(by, "deg").agg(F.count(F.lit(1)).alias("n"), F.sum("wdeg").alias("s"))
    n, s = F.col("n").cast("double"), F.col("s")
    own = d.select(by, (n * (n - 1) / 2).alias("pairs"), _ratio((n - 1) * s, 2.0 * F.col("deg")).alias("weight"))
    other = d.select(by, F.col("deg").alias("deg2"), F.col("n").alias("n2"), F.col("s").alias("s2"))
    cross = d.join(other, by).where("deg < deg2").select(by, (n * F.col("n2")).alias("pairs"), ((s * F.col("n2") + F.col("s2") * n) / (F.col("deg") + F.col("deg2"))).alias("weight"))
    return own.unionByName(cross).groupBy(by).agg(F.sum("pairs").cast("long").alias("pairs"), F.sum("weight").alias("weight"))


def _with_means(edges: DataFrame, v: DataFrame) -> DataFrame:
    """Edges with ``mean``, what an absent edge between the two ends would weigh."""
    ends = edges.join(v.select(F.col("id").alias("src"), F.col("deg").alias("da"), F.col("wdeg").alias("wa")), "src").join(v.select(F.col("id").alias("dst"), F.col("deg").alias("db"), F.col("wdeg").alias("wb")), "dst")
    return ends.select("src", "dst", "w", ((F.col("wa") + F.col("wb")) / (F.col("da") + F.col("db"))).alias("mean"))


def cluster_precision(edges: DataFrame, vertices: DataFrame, z: DataFrame) -> DataFrame:
    """cluster, precision: weight inside over itself plus what absent pairs would weigh. Absent pairs are summed by classes, not listed."""
    v = vertex_degrees(edges, vertices)
    a, b = z.select(F.col("vertex").alias("src"), "cluster"), z.select(F.col("vertex").alias("dst"), "cluster")
    inner = _with_means(edges.where("src < dst"), v).join(a, "src").join(b, ["dst", "cluster"]).groupBy("cluster").agg(F.sum("w").alias("w"), F.sum("mean").alias("mean"))
    got = cluster_sizes(z).join(imputed_pairs(z, v, "cluster"), "cluster", "left").join(inner, "cluster", "left")
    zero = F.lit(0.0)
    w = F.coalesce("w", zero)
    return got.select("cluster", _ratio(w, w + F.coalesce("weight", zero) - F.coalesce("mean", zero)).alias("precision"))


def member_places(z: DataFrame) -> DataFrame:
    """vertex, cluster, place (0, 1, ... in each cluster by vertex), numbered in ranges, so a huge cluster spreads."""
    return with_running(materialised(z.select("vertex", "cluster"), "members"), ["cluster"], ["vertex"]).select("vertex", "cluster", (F.col("place") - 1).alias("place"))


def sampled_precision(edges: DataFrame, vertices: DataFrame, z: DataFrame, samples: int, seed: int = 1) -> DataFrame:
    """cluster, predicted, true_positive, weight_predicted, weight_true: of ordered pairs drawn in each cluster of two or more, in
    proportion to its pairs (rounded up), ``samples`` in all. Absent edges weigh the ends' mean."""
    v = vertex_degrees(edges, vertices)
    sizes = cluster_sizes(z).where("size > 1").withColumn("own", F.col("size").cast("double") * (F.col("size") - 1))
    total = sizes.agg(F.sum("own").alias("total"))
    draws = sizes.crossJoin(F.broadcast(total)).select("cluster", "size", F.explode(F.sequence(F.lit(1), F.ceil(F.col("own") / F.col("total") * samples).cast("int"))).alias("draw"))  # one row
    i = F.floor(uniform("pair-a", seed, F.col("cluster"), F.col("draw")) * F.col("size"))
    j = F.floor(uniform("pair-b", seed, F.col("cluster"), F.col("draw")) * (F.col("size") - 1))
    draws = draws.select("cluster", "draw", i.alias("i"), (j + F.when(j >= i, 1).otherwise(0)).alias("j"))
    places = member_places(z).join(v.withColumnRenamed("id", "vertex"), "vertex")
    side = lambda at, x: places.select("cluster", F.col("place").alias(at), F.col("vertex").alias(x), F.col("deg").alias(f"deg_{x}"), F.col("wdeg").alias(f"wdeg_{x}"))
    rows = draws.join(side("i", "src"), ["cluster", "i"]).join(side("j", "dst"), ["cluster", "j"]).join(edges, ["src", "dst"], "left")
    mean = _ratio(F.col("wdeg_src") + F.col("wdeg_dst"), F.col("deg_src") + F.col("deg_dst"))
    hit = F.coalesce(F.col("w") > 0, F.lit(False))
    return rows.groupBy("cluster").agg(F.count(F.lit(1)).alias("predicted"), F.sum(hit.cast("long")).alias("true_positive"), F.sum(F.when(hit, F.col("w")).otherwise(mean)).alias("weight_predicted"), F.sum(F.when(hit, F.col("w")).otherwise(0.0)).alias("weight_true"))


def drawn_edges(edges: DataFrame, samples: int, seed: int = 1) -> DataFrame:
    """draw, src, dst, w: directed edges drawn evenly with replacement, which is a vertex by its share of the degrees and a neighbour of it.

    Edges are numbered by (src, dst) in ranges and met by number, so neither edges nor draws are sorted in one task."""
    numbered = with_running(materialised(edges.select("src", "dst", "w"), "to-number"), [], ["src", "dst"]).withColumn("no", F.col("place") - 1)
    n = edges.count()
    draws = edges.sparkSession.range(samples if n else 0).select(F.col("id").alias("draw"), F.floor(uniform("recall", seed, F.col("id")) * n).cast("long").alias("no"))
    return draws.join(numbered, "no").select("draw", "src", "dst", "w")


def sampled_stats(edges: DataFrame, vertices: DataFrame, z: DataFrame, recall_samples: int = 1_000_000, precision_samples: int = 100_000, vertex_samples: int = 5_000, seed: int = 1) -> DataFrame:
    """One row: precision, recall, weighted_precision, weighted_recall, orphan_rate from pairs drawn in clusters, directed edges and
    vertices, all drawn with replacement; drawn vertices without a cluster don't count."""
    hit = drawn_edges(edges, recall_samples, seed).join(shared_edges(edges, z).select("src", "dst", F.lit(True).alias("hit")), ["src", "dst"], "left").select("w", F.coalesce("hit", F.lit(False)).alias("hit"))
    recall = hit.agg(F.count(F.lit(1)).alias("n"), F.sum("w").alias("w"), F.sum(F.col("hit").cast("long")).alias("h"), F.sum(F.when(F.col("hit"), F.col("w"))).alias("hw"))
    recall = recall.select(_ratio(F.coalesce("h", F.lit(0)), F.col("n")).alias("recall"), _ratio(F.coalesce("hw", F.lit(0.0)), F.col("w")).alias("weighted_recall"))
    sums = sampled_precision(edges, vertices, z, precision_samples, seed).agg(*[F.sum(c).alias(c) for c in ("predicted", "true_positive", "weight_predicted", "weight_true")])
    precision = sums.select(_ratio(F.col("true_positive"), F.col("predicted")).alias("precision"), _ratio(F.col("weight_true"), F.col("weight_predicted")).alias("weighted_precision"))
    n = vertices.count()
    numbered = with_running(materialised(vertices.select("id"), "to-number"), [], ["id"]).select(F.col("id").alias("vertex"), (F.col("place") - 1).alias("no"))
    some = vertices.sparkSession.range(vertex_samples if n else 0).select(F.floor(uniform("orphans", seed, F.col("id")) * n).cast("long").alias("no")).join(numbered, "no")
    some = some.join(z.select("vertex").distinct(), "vertex", "left_semi")
    alone = some.join(orphans(edges, z).withColumn("alone", F.lit(1)), "vertex", "left").agg(F.coalesce(F.avg(F.coalesce("alone", F.lit(0))), F.lit(0.0)).alias("orphan_rate"))
    return precision.crossJoin(recall).crossJoin(alone)  # one row each


def degree_distribution(edges: DataFrame, vertices: DataFrame) -> DataFrame:
    """id, p: each vertex' share of the edge ends."""
    total = edges.agg(F.count(F.lit(1)).alias("total"))
    return vertex_degrees(edges, vertices).crossJoin(F.broadcast(total)).select("id", _ratio(F.col("deg").cast("double"), F.col("total")).alias("p"))  # one row


def orphans(edges: DataFrame, z: DataFrame) -> DataFrame:
    """Assigned vertices that share no cluster with a neighbour."""
    return z.select("vertex").distinct().join(shared_edges(edges, z).select(F.col("src").alias("vertex")), "vertex", "left_anti")


def subset_members(z: DataFrame) -> DataFrame:
    """vertex, subset (a text), sign: every non-empty subset of each vertex' clusters, +1 for odd and -1 for even ones."""
    rows = z.groupBy("vertex").agg(F.array_sort(F.collect_set("cluster")).alias("row"))
    masks = rows.select("vertex", "row", F.explode(F.sequence(F.lit(1), F.expr("cast(shiftleft(1, size(row)) as int) - 1"))).alias("mask"))
    own = F.filter("row", lambda c, i: F.call_function("shiftright", F.col("mask"), i).bitwiseAND(1) == 1)
    return masks.select("vertex", F.array_join(F.transform(own, lambda c: c.cast("string")), " ").alias("subset"), (2 * (F.bit_count("mask") % 2) - 1).alias("sign"))


def _by_subsets(z: DataFrame, v: DataFrame) -> DataFrame:
    """predicted, weight_predicted: pairs that share a cluster, by inclusion and exclusion: the pairs inside each set of clusters that
    some vertex has in full, added for one cluster, taken off for two, and so on. No two kinds of vertices are compared."""
    members = materialised(subset_members(z), "subsets")
    signs = members.groupBy("subset").agg(F.max("sign").alias("sign"))
    sums = imputed_pairs(members.select("subset", "vertex"), v, "subset").join(signs, "subset")
    zero = F.lit(0.0)
    return sums.agg(F.coalesce(F.sum(F.col("sign") * F.col("pairs")), F.lit(0)).cast("long").alias("predicted"), F.coalesce(F.sum(F.col("sign") * F.col("weight")), zero).alias("weight_predicted"))


def _by_kinds(z: DataFrame, v: DataFrame) -> DataFrame:
    """The same for vertices in any number of clusters: those with the same clusters and degree are one kind, and kinds that share a
    cluster are paired."""
    rows = z.groupBy("vertex").agg(F.array_sort(F.collect_set("cluster")).alias("row")).join(v.withColumnRenamed("id", "vertex"), "vertex")
    kinds = rows.groupBy("row", "deg").agg(F.count(F.lit(1)).alias("n"), F.sum("wdeg").alias("s")).withColumn("kind", F.concat_ws(",", F.array_join(F.transform("row", lambda c: c.cast("string")), " "), F.col("deg").cast("string")))
    n, s, deg = F.col("n").cast("double"), F.col("s"), F.col("deg")
    own = kinds.select((n * (n - 1) / 2).alias("pairs"), _ratio((n - 1) * s, 2.0 * deg).alias("weight"))
    a = kinds.select("kind", "n", "s", "deg", F.explode("row").alias("cluster"))
    b = a.select("cluster", F.col("kind").alias("kind2"), F.col("n").alias("n2"), F.col("s").alias("s2"), F.col("deg").alias("deg2"))
    met = a.join(b, "cluster").where("kind < kind2").drop("cluster").distinct()
    cross = met.select((n * F.col("n2")).alias("pairs"), _ratio(s * F.col("n2") + F.col("s2") * n, deg + F.col("deg2")).alias("weight"))
    zero = F.lit(0.0)
    return own.unionByName(cross).agg(F.coalesce(F.sum("pairs"), zero).cast("long").alias("predicted"), F.coalesce(F.sum("weight"), zero).alias("weight_predicted"))


def _most_memberships(z: DataFrame) -> int:
    return z.groupBy("vertex").agg(F.count_distinct("cluster").alias("n")).agg(F.coalesce(F.max("n"), F.lit(0))).first()[0]


def _measures(got: DataFrame, pairs) -> DataFrame:
    p, r = _ratio(F.col("true_positive"), F.col("predicted")), _ratio(F.col("true_positive"), F.col("actual"))
    wp, wr = _ratio(F.col("weight_true"), F.col("weight_predicted")), _ratio(F.col("weight_true"), F.col("weight_actual"))
    absent = pairs - F.col("actual") - F.col("predicted") + F.col("true_positive")
    return got.select("actual", "predicted", "true_positive", absent.alias("true_negative"), p.alias("precision"), r.alias("recall"), _ratio(2 * p * r, p + r).alias("f1"), wp.alias("weighted_precision"), wr.alias("weighted_recall"), _ratio(2 * wp * wr, wp + wr).alias("weighted_f1"), "orphan_rate")


def prediction_stats(edges: DataFrame, vertices: DataFrame, z: DataFrame) -> DataFrame:
    """One row over unordered pairs: actual, predicted, true_positive, true_negative, their precision, recall, f1 and the weighted ones, orphan_rate.

    A pair is predicted if the two share a cluster, once, however many they share. Pairs are counted, never listed: by inclusion and
    exclusion where no vertex has over ``MOST_TAKEN_APART`` clusters, else by kinds of vertices. A predicted pair weighs its ends'
    mean, edge or not. orphan_rate is the share of vertices without an edge."""
    v = vertex_degrees(edges, vertices)
    predicted = (_by_subsets if _most_memberships(z) <= MOST_TAKEN_APART else _by_kinds)(z, v)
    zero = F.lit(0.0)
    actual = edges.agg((F.count(F.lit(1)) / 2).cast("long").alias("actual"), (F.coalesce(F.sum("w"), zero) / 2).alias("weight_actual"))
    hit = shared_edges(edges, z).agg((F.count(F.lit(1)) / 2).cast("long").alias("true_positive"), (F.coalesce(F.sum("w"), zero) / 2).alias("weight_true"))
    alone = v.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.avg((F.col("deg") == 0).cast("double")), zero).alias("orphan_rate"))
    got = actual.crossJoin(predicted).crossJoin(hit).crossJoin(alone)  # one row each
    return _measures(got, (F.col("n") * (F.col("n") - 1) / 2).cast("long"))


def vertex_sampled_stats(edges: DataFrame, vertices: DataFrame, z: DataFrame, ratio: float, seed: int = 1) -> DataFrame:
    """``prediction_stats`` over the ordered pairs whose first vertex is in a sample of floor(ratio * vertices), exact for those; with all
    vertices the counts are twice those of unordered pairs and the ratios are the same.

    A sampled vertex' partners are counted by inclusion and exclusion over the subsets of its clusters, from sums over each subset's
    members by degree; members are not listed for each sampled vertex. A vertex may have ``MOST_TAKEN_APART`` clusters at most."""
    if _most_memberships(z) > MOST_TAKEN_APART:
        raise ValueError(f"a vertex is in over {MOST_TAKEN_APART} clusters; use prediction_stats")
    v = vertex_degrees(edges, vertices)
    n = vertices.count()
    some = materialised(v.join(least_by(vertices, int(n * ratio), uniform("evaluated", seed, F.col("id"))), "id"), "evaluated").withColumnRenamed("id", "vertex")
    members = materialised(subset_members(z), "subsets")
    held = members.join(v.withColumnRenamed("id", "vertex"), "vertex").groupBy("subset", F.col("deg").alias("deg2")).agg(F.count(F.lit(1)).alias("n2"), F.sum("wdeg").alias("s2"))
    mine = members.join(some, "vertex").groupBy("subset", "sign", "deg").agg(F.count(F.lit(1)).alias("n"), F.sum("wdeg").alias("s"))
    # all members of a subset, less the vertex itself
    met = mine.join(held, "subset").select("sign", (F.col("n") * F.col("n2")).alias("pairs"), _ratio(F.col("s") * F.col("n2") + F.col("s2") * F.col("n"), F.col("deg") + F.col("deg2")).alias("weight"))
    self_ = mine.select("sign", (-F.col("n")).alias("pairs"), (-_ratio(F.col("s"), F.col("deg"))).alias("weight"))
    zero = F.lit(0.0)
    predicted = met.unionByName(self_).agg(F.coalesce(F.sum(F.col("sign") * F.col("pairs")), F.lit(0)).cast("long").alias("predicted"), F.coalesce(F.sum(F.col("sign") * F.col("weight")), zero).alias("weight_predicted"))
    ids = some.select(F.col("vertex").alias("src"))
    actual = edges.join(ids, "src", "left_semi").agg(F.count(F.lit(1)).alias("actual"), F.coalesce(F.sum("w"), zero).alias("weight_actual"))
    hit = shared_edges(edges.join(ids, "src", "left_semi"), z).agg(F.count(F.lit(1)).alias("true_positive"), F.coalesce(F.sum("w"), zero).alias("weight_true"))
    alone = some.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.avg((F.col("deg") == 0).cast("double")), zero).alias("orphan_rate"))
    return _measures(actual.crossJoin(predicted).crossJoin(hit).crossJoin(alone), F.col("n") * F.lit(max(n - 1, 0)))  # one row each
