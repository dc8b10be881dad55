"""Graphs as DataFrames: edges(src, dst, w) hold both directions; bipartite edges are bip(l, r)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillgraph.functions.tables import discarded, materialised, with_running

TOLERANCE = 1e-5
#: Wedges of a block of right vertices, about, at most; and so many at most however small the graph is.
BLOCK, LEAST_BLOCK = 1 << 23, 1 << 18


def bipartite_from_edges(df: DataFrame, left: str, right: str) -> DataFrame:
    return df.select(F.col(left).cast("long").alias("l"), F.col(right).cast("long").alias("r")).where("l is not null and r is not null").distinct()


def lists_from_edges(df: DataFrame, left: str, right: str) -> DataFrame:
    """The rows of ``bipartite_from_edges`` as l, rs (its right vertices, in no order), with one shuffle."""
    rows = df.select(F.col(left).cast("long").alias("l"), F.col(right).cast("long").alias("r")).where("l is not null and r is not null")
    return rows.repartition("l").groupBy("l").agg(F.collect_set("r").alias("rs"))


def graph_from_edges(df: DataFrame, src: str, dst: str, w: str | None = None) -> DataFrame:
    """Both directions of every edge once; self-loops go; of parallel edges the heaviest stays."""
    weight = F.col(w).cast("double") if w else F.lit(1.0)
    one = df.select(F.col(src).cast("long").alias("src"), F.col(dst).cast("long").alias("dst"), weight.alias("w")).where("src <> dst")
    return both_directions(one).groupBy("src", "dst").agg(F.max("w").alias("w"))


def both_directions(half: DataFrame) -> DataFrame:
    """Each row of half(src, dst, w) both ways, in one pass over it."""
    ends = lambda a, b: F.struct(F.col(a).alias("src"), F.col(b).alias("dst"))
    return half.select(F.explode(F.array(ends("src", "dst"), ends("dst", "src"))).alias("x"), "w").select("x.src", "x.dst", "w")


def transpose(bip: DataFrame) -> DataFrame:
    return bip.select(F.col("r").alias("l"), F.col("l").alias("r"))


def right_vertices(bip: DataFrame) -> DataFrame:
    return bip.select(F.col("r").alias("id")).distinct()


def bipartite_degrees(bip: DataFrame) -> DataFrame:
    """side, id, degree of both sides."""
    sides = [bip.groupBy(F.col(c).alias("id")).agg(F.count(F.lit(1)).alias("degree")).select(F.lit(c).alias("side"), "id", "degree") for c in ("l", "r")]
    return sides[0].unionByName(sides[1])


def bipartite_density(bip: DataFrame) -> DataFrame:
    got = bip.agg(F.count(F.lit(1)).alias("n_edges"), F.count_distinct("l").alias("n_left"), F.count_distinct("r").alias("n_right"))
    cells = F.col("n_left").cast("double") * F.col("n_right")
    return got.withColumn("density", F.when(cells > 0, F.col("n_edges") / cells).otherwise(0.0))


def _ends(lists: DataFrame) -> tuple[DataFrame, int, bool]:
    """(r, d, block, parts of each right vertex; the number of blocks; whether a vertex has several parts).

    A block is a range of right vertices with about ``BLOCK`` wedges at most (fewer in a small graph, for the sake of the cores). A vertex
    with more is a block of its own, with an odd number, in several parts."""
    sums = lists.select(F.explode("rs").alias("r"), (F.size("rs") - 1).cast("long").alias("met")).groupBy("r").agg(F.count(F.lit(1)).alias("d"), F.sum("met").alias("met"))
    sums = materialised(sums, "degrees")
    size = min(BLOCK, max(LEAST_BLOCK, (sums.agg(F.sum("met")).first()[0] or 0) // 64))
    parts = F.greatest(F.ceil(F.col("met") / size), F.lit(1)).cast("long")
    room = materialised(sums.select("r", "d", parts.alias("parts"), F.when(parts > 1, parts * size).otherwise(F.col("met")).alias("room")), "room")
    start = F.floor((F.col("total_room") - F.col("room")) / size).cast("long")  # vertices around one of several parts are never in one block
    ends = materialised(with_running(room, [], ["r"], ("room",)).select("r", "d", "parts", (2 * start + (F.col("parts") > 1).cast("long")).alias("block")), "ends")
    discarded(sums, room)
    last = ends.agg(F.coalesce(F.max("block"), F.lit(0)).alias("block"), F.coalesce(F.max("parts"), F.lit(1)).alias("parts")).first()
    return ends, last["block"] // 2 + last["parts"], last["parts"] > 1


def project_right(bip: DataFrame, threshold: float = 0.0) -> DataFrame:
    """Edges between right vertices: shared left vertices / sqrt(degree * degree), where that exceeds the threshold."""
    return project_lists(materialised(bip.groupBy("l").agg(F.collect_list("r").alias("rs")), "lists"), threshold)


def project_lists(written: DataFrame, threshold: float = 0.0) -> DataFrame:
    """``project_right`` of a written table (l, rs: its right vertices).

    Wedges are never shuffled: a left vertex' sorted list goes to each block of right vertices that it has some of, from the first of them
    on, and the block's task pairs those with what follows, and counts. So a hub's wedges spread over the blocks. Only a vertex of several
    parts has its counts, not its wedges, added up over tasks."""
    ends, blocks, split = _ends(written)
    lists = written.where(F.size("rs") > 1).select("l", F.explode("rs").alias("r")).join(ends, "r").groupBy("l").agg(F.sort_array(F.collect_list(F.struct("r", "d", "block", "parts"))).alias("es"))
    lists = lists.select("l", F.col("es.r").alias("rs"), F.col("es.d").alias("ds"), F.col("es.block").alias("bs"), F.col("es.parts").alias("ps"))
    at = F.col("at")
    firsts = lists.select("*", F.posexplode("bs").alias("at", "block")).where(~F.get("bs", at - 1).eqNullSafe(F.col("block")))
    own = F.size("bs") - F.array_position(F.reverse("bs"), F.col("block")) + 1 - at  # the block's vertices in the list lie together
    rest = lambda c: F.slice(c, at + 1, F.size(c))
    sent = firsts.select("block", F.pmod(F.xxhash64("l"), F.get("ps", at)).alias("part"), own.cast("int").alias("own"), rest("rs").alias("rs"), rest("ds").alias("ds")).repartition(blocks, "block", "part")
    one = sent.select("block", "part", "rs", "ds", F.posexplode(F.slice("rs", 1, F.col("own"))).alias("i", "r")).where(F.col("i") + 1 < F.size("rs"))
    met = one.select("block", "part", "r", F.get("ds", F.col("i")).alias("d"), "rs", "ds", F.explode(F.sequence(F.col("i") + 1, F.size("rs") - 1)).alias("j"))
    met = met.select("block", "part", "r", "d", F.get("rs", F.col("j")).alias("r2"), F.get("ds", F.col("j")).alias("d2"))
    pairs = met.groupBy("block", "part", "r", "r2").agg(F.count(F.lit(1)).alias("common"), F.max("d").alias("d"), F.max("d2").alias("d2"))
    if split:
        whole, torn = pairs.where("block % 2 = 0"), pairs.where("block % 2 = 1")
        torn = torn.groupBy("r", "r2").agg(F.sum("common").alias("common"), F.max("d").alias("d"), F.max("d2").alias("d2"))
        pairs = whole.select("r", "r2", "common", "d", "d2").unionByName(torn)
    w = F.col("common") / F.sqrt(F.col("d").cast("double") * F.col("d2"))
    half = pairs.select(F.col("r").alias("src"), F.col("r2").alias("dst"), w.alias("w"))
    return both_directions(half.where(F.col("w") - threshold > TOLERANCE))


def project_left(bip: DataFrame, threshold: float = 0.0) -> DataFrame:
    return project_right(transpose(bip), threshold)


def vertex_degrees(edges: DataFrame, vertices: DataFrame) -> DataFrame:
    """id, deg, wdeg of every vertex, isolated ones with zeros."""
    got = edges.groupBy(F.col("src").alias("id")).agg(F.count(F.lit(1)).alias("deg"), F.sum("w").alias("wdeg"))
    return vertices.select("id").join(got, "id", "left").select("id", F.coalesce("deg", F.lit(0)).cast("long").alias("deg"), F.coalesce("wdeg", F.lit(0.0)).alias("wdeg"))


def graph_stats(edges: DataFrame, vertices: DataFrame) -> DataFrame:
    """n, m, density, avg_w, global_w, sd_w. The deviation sums both directions over m - 1."""
    sums = edges.agg(F.count(F.lit(1)).alias("k"), F.coalesce(F.sum("w"), F.lit(0.0)).alias("global_w"), F.coalesce(F.sum(F.col("w") * F.col("w")), F.lit(0.0)).alias("sq"))
    got = vertices.agg(F.count(F.lit(1)).alias("n")).crossJoin(sums)  # one row each
    m, n = (F.col("k") / 2).cast("long"), F.col("n")
    avg = F.when(F.col("k") > 0, F.col("global_w") / F.col("k")).otherwise(0.0)
    sd = F.when(m > 1, F.sqrt(F.greatest(F.col("sq") - avg * F.col("global_w"), F.lit(0.0)) / F.when(m > 1, m - 1))).otherwise(0.0)
    density = F.when(n > 1, 2.0 * m / F.when(n > 1, n * (n - 1))).otherwise(0.0)
    return got.select("n", m.alias("m"), density.alias("density"), avg.alias("avg_w"), "global_w", sd.alias("sd_w"))


def square_weights(edges: DataFrame) -> DataFrame:
    return edges.withColumn("w", F.col("w") * F.col("w"))


def neighbors_sorted(edges: DataFrame) -> DataFrame:
    """Edges with rank 1, 2, ... from each src by falling weight, then dst."""
    return edges.withColumn("rank", F.row_number().over(Window.partitionBy("src").orderBy(F.desc("w"), "dst")).cast("long"))


def top_k_edges(edges: DataFrame, k: int) -> DataFrame:
    """Edges that are among the k heaviest of either end. Spark limits each group's rows before and after the shuffle by the rank filter."""
    best = neighbors_sorted(edges).where(F.col("rank") <= k)
    return both_directions(best).distinct()


def edge_weights(edges: DataFrame, pairs: DataFrame) -> DataFrame:
    """pairs(src, dst) with w, 0 where there is no edge."""
    return pairs.join(edges, ["src", "dst"], "left").withColumn("w", F.coalesce("w", F.lit(0.0)))


def weight_to_sets(edges: DataFrame, z: DataFrame) -> DataFrame:
    """vertex, cluster, n, w: each vertex's edges into each cluster of z(vertex, cluster) that it touches."""
    got = edges.join(z.select(F.col("vertex").alias("dst"), "cluster"), "dst")
    return got.groupBy(F.col("src").alias("vertex"), "cluster").agg(F.count(F.lit(1)).alias("n"), F.sum("w").alias("w"))


def induced_subgraph(edges: DataFrame, ids: DataFrame) -> DataFrame:
    """Edges with both ends in ids(id)."""
    return edges.join(ids.select(F.col("id").alias("src")), "src", "left_semi").join(ids.select(F.col("id").alias("dst")), "dst", "left_semi").select("src", "dst", "w")


def triangles(edges: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """a, b, c, w_ab, w_ac, w_bc of every triangle once (within equal ``by`` columns).

    Edges point from the end of lower degree, so a hub's neighbourhood is never paired with itself."""
    degree = edges.groupBy(*by, F.col("src").alias("id")).agg(F.count(F.lit(1)).alias("d"))
    ends = edges.join(degree.withColumnRenamed("id", "src").withColumnRenamed("d", "ds"), [*by, "src"])
    ends = ends.join(degree.withColumnRenamed("id", "dst").withColumnRenamed("d", "dd"), [*by, "dst"])
    up = ends.where("ds < dd or (ds = dd and src < dst)").select(*by, "src", "dst", "w", F.struct("dd", "dst").alias("o"))
    ab = up.select(*by, F.col("src").alias("a"), F.col("dst").alias("b"), F.col("w").alias("w_ab"), F.col("o").alias("ob"))
    ac = up.select(*by, F.col("src").alias("a"), F.col("dst").alias("c"), F.col("w").alias("w_ac"), F.col("o").alias("oc"))
    bc = up.select(*by, F.col("src").alias("b"), F.col("dst").alias("c"), F.col("w").alias("w_bc"))
    return ab.join(ac, [*by, "a"]).where("ob < oc").join(bc, [*by, "b", "c"]).select(*by, "a", "b", "c", "w_ab", "w_ac", "w_bc")


def without_weak_links(edges: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Edges whose ends share a neighbour (within equal ``by`` columns)."""
    t = triangles(edges, by)
    half = [t.select(*by, F.col(x).alias("src"), F.col(y).alias("dst"), F.col(f"w_{x}{y}").alias("w")) for x, y in (("a", "b"), ("a", "c"), ("b", "c"))]
    kept = half[0].unionByName(half[1]).unionByName(half[2]).distinct()
    return kept.unionByName(kept.select(*by, F.col("dst").alias("src"), F.col("src").alias("dst"), "w"))


def neighborhood_conductance(edges: DataFrame, vertices: DataFrame, weighted: bool = True) -> DataFrame:
    """id, conductance of every closed neighbourhood; 1 for fewer than two neighbours, 0 where a side has no volume.

    cut = volume - inside, and inside = 2 * wdeg plus the opposite edges of the vertex' triangles, so no two-hop table is made."""
    e = edges if weighted else edges.withColumn("w", F.lit(1.0))
    v = vertex_degrees(e, vertices)
    total = e.agg(F.coalesce(F.sum("w"), F.lit(0.0)).alias("total"))
    around = e.join(v.select(F.col("id").alias("dst"), "wdeg"), "dst").groupBy(F.col("src").alias("id")).agg(F.sum("wdeg").alias("around"))
    t = triangles(e)
    corners = t.select(F.explode(F.array(F.struct(F.col("a").alias("id"), F.col("w_bc").alias("x")), F.struct(F.col("b").alias("id"), F.col("w_ac").alias("x")), F.struct(F.col("c").alias("id"), F.col("w_ab").alias("x")))).alias("k")).select("k.*")
    inner = corners.groupBy("id").agg(F.sum("x").alias("opposite"))
    got = v.join(around, "id", "left").join(inner, "id", "left").crossJoin(F.broadcast(total))  # one row
    vol = F.coalesce("around", F.lit(0.0)) + F.col("wdeg")
    cut = vol - 2 * F.col("wdeg") - 2 * F.coalesce("opposite", F.lit(0.0))
    least = F.least(vol, F.col("total") - vol)
    value = F.when(F.col("deg") < 2, 1.0).when(least < 1e-9, 0.0).otherwise(cut / F.when(least >= 1e-9, least))
    return got.select("id", value.alias("conductance"))


def prefix_conductance(lists: DataFrame, edges: DataFrame, vertices: DataFrame, inner: DataFrame | None = None) -> DataFrame:
    """lists(seed, id, rank) with the conductance of each prefix of a seed's list; the first has 1.

    ``inner``: seed, rank, inner (weight between the vertex of that rank and those before it), where it is known already."""
    v = vertex_degrees(edges, vertices)
    total = edges.agg(F.coalesce(F.sum("w"), F.lit(0.0)).alias("total"))
    if inner is None:
        a = lists.select("seed", F.col("id").alias("src"), F.col("rank").alias("ra"))
        b = lists.select("seed", F.col("id").alias("dst"), F.col("rank").alias("rb"))
        inner = a.join(edges, "src").join(b, ["seed", "dst"]).where("rb < ra").groupBy("seed", F.col("ra").alias("rank")).agg(F.sum("w").alias("inner"))
    rows = lists.join(v, "id").join(inner, ["seed", "rank"], "left")
    so_far = Window.partitionBy("seed").orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("cut", F.sum(F.col("wdeg") - 2 * F.coalesce("inner", F.lit(0.0))).over(so_far)).withColumn("vol", F.sum("wdeg").over(so_far)).crossJoin(F.broadcast(total))
    rest = F.col("total") - F.col("vol")
    value = F.when(F.col("rank") == 1, 1.0).when((F.col("vol") < 1e-9) | (rest < 1e-9), F.lit(None).cast("double")).otherwise(F.col("cut") / F.when(F.least("vol", rest) >= 1e-9, F.least("vol", rest)))
    return rows.select("seed", "id", "rank", value.alias("conductance"))


def best_prefixes(lists: DataFrame, edges: DataFrame, vertices: DataFrame, inner: DataFrame | None = None) -> DataFrame:
    """seed, n, conductance: the earliest prefix of least conductance (rounded to 9 places) of each seed's list."""
    rows = prefix_conductance(lists, edges, vertices, inner).where("conductance is not null")
    best = rows.groupBy("seed").agg(F.min(F.struct(F.round("conductance", 9).alias("c"), F.col("rank").alias("n"))).alias("x"))
    return best.select("seed", F.col("x.n").cast("long").alias("n"), F.col("x.c").alias("conductance"))


def best_subneighborhoods(edges: DataFrame, vertices: DataFrame) -> DataFrame:
    """The best prefix of each vertex' neighbours by falling weight; the seed itself is not in the list.

    Edges between two neighbours are the far sides of the seed's triangles, so no table of two steps is made."""
    lists = neighbors_sorted(edges).select(F.col("src").alias("seed"), F.col("dst").alias("id"), "rank")
    corner = lambda a, b, c: F.struct(F.col(a).alias("seed"), F.col(b).alias("x"), F.col(c).alias("y"), F.col(f"w_{b}{c}").alias("w"))
    corners = triangles(edges).select(F.explode(F.array(corner("a", "b", "c"), corner("b", "a", "c"), corner("c", "a", "b"))).alias("k")).select("k.*")
    side = lambda x: lists.select("seed", F.col("id").alias(x), F.col("rank").alias(f"rank_{x}"))
    inner = corners.join(side("x"), ["seed", "x"]).join(side("y"), ["seed", "y"]).groupBy("seed", F.greatest("rank_x", "rank_y").alias("rank")).agg(F.sum("w").alias("inner"))
    return best_prefixes(lists, edges, vertices, inner)
