"""Metropolis-Hastings over memberships in hash-dealt batches: each batch is one DataFrame job on a snapshot.

Every random choice is a function of (seed, epoch, vertex, candidate), so a lost task repeats itself exactly."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillgraph.functions.tables import discarded, least_by, materialised, uniform
from quillgraph.operators.components import divided_clusters
from quillgraph.operators.graph import best_prefixes, neighborhood_conductance, neighbors_sorted, project_right, right_vertices, square_weights, top_k_edges, vertex_degrees, weight_to_sets
from quillgraph.operators.embeddings import left_embeddings, log_transformed, normalized, norms, right_embeddings
from quillgraph.operators.membership import affiliations, cluster_sizes, matrix_stats, prediction_stats, remove_small_clusters, sampled_stats, vertex_sampled_stats


STRATEGIES = ("single", "multiple", "neighbors", "neighbors_and_cluster", "random")
STARTS = ("random_neighborhood", "best_neighborhood", "seeds", "uncovered", "random")


@dataclass(frozen=True)
class Settings:
    clusters: int = 100
    max_epochs: int = 500
    least_moves: float = 0.01
    weight: float = 5.0
    scale: float = 0.5
    batches: int = 4
    colours: bool = False  # batches are the classes of a colouring instead, so that no two neighbours move on one snapshot
    seed: int = 1
    temperature: float | None = None  # of the first epoch; None: the fixed scale
    cooling: float = 0.95
    divide: bool = True
    remove_weak_links: bool = True
    least_size: int = 2
    strategy: str = "single"  # or multiple, neighbors, neighbors_and_cluster, random
    most_memberships: int = 5
    start: str = "random_neighborhood"  # or best_neighborhood, seeds, uncovered, random
    all_epochs: bool = False
    metrics_every: int = 1
    evaluated: float = 1.0  # share of the vertices that the metrics of a small graph are of

    def __post_init__(self):
        if self.strategy not in STRATEGIES:
            raise ValueError(f"strategy must be one of {', '.join(STRATEGIES)}")
        if self.start not in STARTS:
            raise ValueError(f"start must be one of {', '.join(STARTS)}")
        if self.clusters < 1 or self.batches < 1 or self.most_memberships < 1 or self.metrics_every < 1:
            raise ValueError("clusters, batches, most_memberships and metrics_every must be at least 1")
        if not 0 < self.evaluated <= 1:
            raise ValueError("the evaluated share must be over 0 and at most 1")

    def multiplier(self, epoch: int) -> float:
        return self.scale if self.temperature is None else 1.0 / (self.cooling**epoch * self.temperature)


def log_likelihood(n_vertices: Column, weight: float, n: Column, w: Column, size: Column, deg: Column, wdeg: Column) -> Column:
    """weight * w + (vertices - size - (deg - n)) * wdeg / deg; for deg > 0."""
    return weight * w + (n_vertices - size - (deg - n)) * (wdeg / F.when(deg > 0, deg))


def candidate_likelihoods(edges: DataFrame, v: DataFrame, z: DataFrame, weight: float = 5.0) -> DataFrame:
    """vertex, cluster, ll of each neighbouring cluster and of none (cluster -1). v: id, deg, wdeg; isolated vertices have no candidates."""
    total = v.agg(F.count(F.lit(1)).cast("double").alias("n_vertices"))
    some = weight_to_sets(edges, z).join(cluster_sizes(z), "cluster").select("vertex", "cluster", "n", "w", "size")
    none = v.where("deg > 0").select(F.col("id").alias("vertex"), F.lit(-1).cast("long").alias("cluster"), F.lit(0).cast("long").alias("n"), F.lit(0.0).alias("w"), F.lit(0).cast("long").alias("size"))
    rows = some.unionByName(none).join(v.withColumnRenamed("id", "vertex"), "vertex").crossJoin(F.broadcast(total))  # one row
    return rows.select("vertex", "cluster", log_likelihood(F.col("n_vertices"), weight, F.col("n"), F.col("w"), F.col("size"), F.col("deg"), F.col("wdeg")).alias("ll"))


def _dealt(v: DataFrame, settings: Settings, epoch: int, batch: int) -> DataFrame:
    """The vertices of a batch: a colour class where ``v`` has colours, else those that the epoch's hash deals to it."""
    return v.where(F.col("colour") == batch) if "colour" in v.columns else v.where(F.floor(uniform("deal", settings.seed, epoch, F.col("id")) * settings.batches) == batch)


def propose(edges: DataFrame, v: DataFrame, z: DataFrame, settings: Settings, epoch: int = 0, batch: int | None = None) -> DataFrame:
    """vertex, current, proposal (-1: none), accepted, for the vertices of a batch, or all. z gives each vertex one cluster at most.

    The proposal is the largest likelihood plus Gumbel noise; the current cluster is never proposed again."""
    seed = settings.seed
    if batch is not None:
        ids = _dealt(v, settings, epoch, batch).select(F.col("id").alias("src"))
        own = edges.join(ids, "src", "left_semi")
    else:
        ids, own = v.select(F.col("id").alias("src")), edges
    ll = candidate_likelihoods(own, v, z, settings.weight).join(ids.withColumnRenamed("src", "vertex"), "vertex", "left_semi")
    v_all = v.withColumnRenamed("id", "vertex").crossJoin(F.broadcast(v.agg(F.count(F.lit(1)).cast("double").alias("n_vertices"))))  # one row
    now = z.select("vertex", F.col("cluster").alias("current")).join(cluster_sizes(z).withColumnRenamed("cluster", "current"), "current")
    rows = ll.join(now, "vertex", "left").withColumn("current", F.coalesce("current", F.lit(-1).cast("long")))
    noise = -F.log(-F.log(uniform("gumbel", seed, epoch, F.col("vertex"), F.col("cluster"))))
    best = rows.groupBy("vertex", "current").agg(
        F.max(F.when((F.col("cluster") != F.col("current")) | (F.col("current") == -1), F.struct((F.col("ll") + noise).alias("g"), F.col("cluster"), F.col("ll")))).alias("x"),
        F.max(F.when(F.col("cluster") == F.col("current"), F.col("ll"))).alias("old"),
        F.max("size").alias("size"),
    ).join(v_all, "vertex")
    # a current cluster without a neighbour in it is not among the candidates
    alone = log_likelihood(F.col("n_vertices"), settings.weight, F.lit(0), F.lit(0.0), F.coalesce("size", F.lit(0)), F.col("deg"), F.col("wdeg"))
    step = settings.multiplier(epoch) * (F.col("x.ll") - F.coalesce("old", alone))
    moved = (F.col("x.cluster") != F.col("current")) & (F.log(uniform("accept", seed, epoch, F.col("vertex"))) < step)
    return best.where("x is not null").select("vertex", "current", F.col("x.cluster").alias("proposal"), moved.alias("accepted"))


def fraction_proposals(edges: DataFrame, v: DataFrame, z: DataFrame, seed: int = 1, epoch: int = 0, with_size: bool = False) -> DataFrame:
    """vertex, cluster: each neighbouring cluster is drawn for itself with its share of the vertex' weight; ``with_size``, the cluster's
    other members count too, each with the mean weight of the edges into it."""
    rows = weight_to_sets(edges, z).join(v.withColumnRenamed("id", "vertex"), "vertex").join(cluster_sizes(z), "cluster")
    den = F.col("wdeg") + F.col("w") / F.col("n") * (F.col("size") - F.col("n")) if with_size else F.col("wdeg")
    p = F.when(den > 0, F.col("w") / F.when(den > 0, den)).otherwise(0.0)
    return rows.where(uniform("fraction", seed, epoch, F.col("vertex"), F.col("cluster")) < p).select("vertex", "cluster")


def pure_random_proposals(v: DataFrame, clusters: int, seed: int = 1, epoch: int = 0) -> DataFrame:
    """vertex, cluster: each of the clusters with probability 1/2, drawn in the vertex' row."""
    return v.select(F.col("id").alias("vertex"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(clusters - 1).cast("long"))).alias("cluster")).where(uniform("coin", seed, epoch, F.col("vertex"), F.col("cluster")) < 0.5)


def set_likelihoods(edges: DataFrame, v: DataFrame, z: DataFrame, sets: DataFrame, weight: float = 5.0) -> DataFrame:
    """vertex, row, ll of sets(vertex, row: array of clusters): neighbours in any of them count once, and so do their members.

    Members with the same clusters are one kind. A kind counts in a union at the least cluster that the two share, so neither members nor
    neighbours are listed for each set."""
    total = v.agg(F.count(F.lit(1)).cast("double").alias("n_vertices"))
    key = F.array_join(F.transform("row", lambda c: c.cast("string")), " ")
    sets = sets.select("vertex", "row", key.alias("key"))
    members = rows_of(z.where("vertex is not null")).withColumnRenamed("row", "kind")
    near = edges.join(members.withColumnRenamed("vertex", "dst"), "dst").groupBy("src", "kind").agg(F.count(F.lit(1)).alias("n"), F.sum("w").alias("w"))
    hits = sets.distinct().join(near.withColumnRenamed("src", "vertex"), "vertex").where(F.arrays_overlap("row", "kind"))
    hits = hits.groupBy("vertex", "key").agg(F.sum("n").alias("n"), F.sum("w").alias("w"))
    kinds = members.groupBy("kind").agg(F.count(F.lit(1)).alias("n")).select("kind", "n", F.explode("kind").alias("cluster"))
    asked = sets.select("key", "row").distinct().select("key", "row", F.explode("row").alias("cluster"))
    union = asked.join(kinds, "cluster").where(F.col("cluster") == F.array_min(F.array_intersect("row", "kind"))).groupBy("key").agg(F.sum("n").alias("size"))
    rows = sets.join(hits, ["vertex", "key"], "left").join(union, "key", "left").join(v.withColumnRenamed("id", "vertex"), "vertex").crossJoin(F.broadcast(total))  # one row
    zero = F.lit(0)
    return rows.select("vertex", "row", log_likelihood(F.col("n_vertices"), weight, F.coalesce("n", zero), F.coalesce("w", F.lit(0.0)), F.coalesce("size", zero), F.col("deg"), F.col("wdeg")).alias("ll"))


def rows_of(z: DataFrame) -> DataFrame:
    """vertex, row: its clusters in order."""
    return z.groupBy("vertex").agg(F.array_sort(F.collect_set("cluster")).alias("row"))


def cover_clusters(edges: DataFrame, z: DataFrame, most: int) -> DataFrame:
    """vertex, step, cluster: up to ``most`` clusters that each add most weight of neighbours not yet covered, the lesser id among equals.

    A step is a few joins over all vertices; covered neighbours leave, so a hub's edges are never gathered in one row."""
    open_ = materialised(edges.join(z.select(F.col("vertex").alias("dst"), "cluster"), "dst").select("src", "dst", "cluster", "w"), "uncovered")
    chosen = None
    for step in range(most):
        sums = open_.groupBy("src", "cluster").agg(F.sum("w").alias("w")).where("w > 0")
        best = sums.groupBy("src").agg(F.max(F.struct(F.round("w", 9).alias("w"), (-F.col("cluster")).alias("c"))).alias("x")).select("src", (-F.col("x.c")).alias("cluster"))
        best = materialised(best, "cover")
        own = best.select(F.col("src").alias("vertex"), F.lit(step).alias("step"), "cluster")
        chosen = own if chosen is None else chosen.unionByName(own)
        if step + 1 == most or best.isEmpty():
            break
        covered = open_.join(best, ["src", "cluster"], "left_semi").select("src", "dst")
        open_ = materialised(open_.join(covered, ["src", "dst"], "left_anti"), "uncovered")
    return chosen


def cover_subsets(chosen: DataFrame) -> DataFrame:
    """vertex, row: every subset of two or more of a vertex' chosen clusters."""
    lists = chosen.groupBy("vertex").agg(F.array_sort(F.collect_list("cluster")).alias("all")).where(F.size("all") > 1)
    masks = lists.select("vertex", "all", F.explode(F.sequence(F.lit(3), F.expr("cast(shiftleft(1, size(all)) as int) - 1"))).alias("mask")).where(F.bit_count("mask") > 1)
    return masks.select("vertex", F.filter("all", lambda c, i: F.call_function("shiftright", F.col("mask"), i).bitwiseAND(1) == 1).alias("row"))


def set_proposals(edges: DataFrame, v: DataFrame, z: DataFrame, settings: Settings, epoch: int = 0) -> DataFrame:
    """vertex, row: what each vertex of ``v`` with a neighbour proposes, by the settings' strategy; an empty row is a proposal."""
    seed, some = settings.seed, v.where("deg > 0")
    empty = F.array().cast("array<bigint>")
    if settings.strategy in ("neighbors", "neighbors_and_cluster"):
        drawn = fraction_proposals(edges, v, z, seed, epoch, settings.strategy == "neighbors_and_cluster")
    elif settings.strategy == "random":
        drawn = pure_random_proposals(some, settings.clusters, seed, epoch)
    else:
        singles = candidate_likelihoods(edges, v, z, settings.weight).select("vertex", F.when(F.col("cluster") < 0, empty).otherwise(F.array("cluster")).alias("row"), "ll")
        if settings.strategy == "multiple":
            sets = materialised(cover_subsets(cover_clusters(edges, z, settings.most_memberships)), "subsets")
            singles = singles.unionByName(set_likelihoods(edges, v, z, sets, settings.weight))
        now = rows_of(z).withColumnRenamed("row", "now")
        rows = singles.join(now, "vertex", "left").where((F.size("row") == 0) | F.col("now").isNull() | (F.col("row") != F.col("now")))
        key = F.array_join(F.transform("row", lambda c: c.cast("string")), " ")
        noise = -F.log(-F.log(uniform("gumbel", seed, epoch, F.col("vertex"), key)))
        return rows.groupBy("vertex").agg(F.max(F.struct((F.col("ll") + noise).alias("g"), "row")).alias("x")).select("vertex", F.col("x.row").alias("row"))
    return some.select(F.col("id").alias("vertex")).join(rows_of(drawn), "vertex", "left").select("vertex", F.coalesce("row", empty).alias("row"))


def set_steps(edges: DataFrame, v: DataFrame, z: DataFrame, settings: Settings, epoch: int = 0, batch: int | None = None) -> DataFrame:
    """vertex, current, proposal (arrays of clusters), accepted, for vertices in any number of clusters."""
    mine = v.where("deg > 0")
    if batch is not None:
        mine = _dealt(mine, settings, epoch, batch)
    own = edges.join(mine.select(F.col("id").alias("src")), "src", "left_semi")
    empty = F.array().cast("array<bigint>")
    proposed = set_proposals(own, v, z, settings, epoch).join(mine.select(F.col("id").alias("vertex")), "vertex", "left_semi")
    now = rows_of(z).select("vertex", F.col("row").alias("current"))
    both = materialised(proposed.join(now, "vertex", "left").select("vertex", F.coalesce("current", empty).alias("current"), F.col("row").alias("proposal")), "proposals")
    ll = lambda c, name: set_likelihoods(own, v, z, both.select("vertex", F.col(c).alias("row")), settings.weight).select("vertex", F.col("ll").alias(name))
    rows = both.join(ll("current", "old"), "vertex").join(ll("proposal", "new"), "vertex")
    step = settings.multiplier(epoch) * (F.col("new") - F.col("old"))
    moved = (F.col("proposal") != F.col("current")) & (F.log(uniform("accept", settings.seed, epoch, F.col("vertex"))) < step)
    return rows.select("vertex", "current", "proposal", moved.alias("accepted"))


def random_memberships(vertices: DataFrame, clusters: int, seed: int = 1) -> DataFrame:
    return vertices.select(F.col("id").alias("vertex"), F.floor(uniform("start", seed, F.col("id")) * clusters).cast("long").alias("cluster"))


def applied(z: DataFrame, steps: DataFrame) -> DataFrame:
    """z with the accepted proposals instead of those vertices' rows; proposals are clusters (-1: none) or arrays of them."""
    moved = steps.where("accepted")
    stay = z.join(moved.select("vertex"), "vertex", "left_anti").select("vertex", "cluster")
    if dict(steps.dtypes)["proposal"].startswith("array"):
        return stay.unionByName(moved.select("vertex", F.explode("proposal").alias("cluster")))
    return stay.unionByName(moved.where("proposal >= 0").select("vertex", F.col("proposal").alias("cluster")))


def epoch_metrics(edges: DataFrame, vertices: DataFrame, z: DataFrame, clusters: int, epoch: int, moved: int, exact_edges: int = 5_000, evaluated: float = 1.0) -> DataFrame:
    """One row for an epoch: what moved, the memberships' statistics, and how well they predict edges: exactly (for the ``evaluated`` share
    of the vertices, if below 1), or by samples of pairs in a graph of ``exact_edges`` or more."""
    wanted = ["precision", "recall", "weighted_precision", "weighted_recall", "orphan_rate"]
    small = edges.limit(2 * exact_edges).count() < 2 * exact_edges
    found = (prediction_stats(edges, vertices, z) if evaluated >= 1 else vertex_sampled_stats(edges, vertices, z, evaluated)) if small else sampled_stats(edges, vertices, z)
    return found.select(*wanted).crossJoin(matrix_stats(z, vertices, clusters)).select(F.lit(epoch).alias("epoch"), F.lit(moved).alias("moved"), *wanted, "nnz_per_row", "empty_row_share", "empty_col_share", "min_size", "max_size")  # one row each


def metric_lines(rows: list) -> list[str]:
    """A header and a line of fixed width for each row of ``epoch_metrics``."""
    if not rows:
        return []
    names = rows[0].__fields__
    return ["  ".join(f"{n:>18}" for n in names)] + ["  ".join(f"{'-' if x is None else x:>18.4f}" if isinstance(x, float) else f"{'-' if x is None else x:>18}" for x in r) for r in rows]


def fit(edges: DataFrame, vertices: DataFrame, settings: Settings, start: DataFrame | None = None, history: list | None = None) -> DataFrame:
    """Memberships after epochs of batches until few vertices move, then divided into components and rid of clusters below ``least_size``.

    They start from ``start``, or by ``settings.start``. With ``settings.colours`` the batches are the classes of ``colours``, all in turn.
    ``history`` gets a row of ``epoch_metrics`` for every ``settings.metrics_every`` epochs. A batch writes its steps and the
    memberships; tables that nothing reads any more are deleted."""
    edges, v = materialised(edges, "graph"), materialised(vertex_degrees(edges, vertices), "degrees")
    n = v.count()
    batches = settings.batches
    if settings.colours:
        v = materialised(v.join(colours(edges, vertices, settings.seed), "id"), "coloured")
        batches = (v.agg(F.max("colour")).first()[0] or 0) + 1
    z = materialised(start if start is not None else start_from(edges, vertices, settings), "memberships")
    step = propose if settings.strategy == "single" else set_steps
    for epoch in range(settings.max_epochs):
        done = []
        for batch in range(batches):
            done.append(materialised(step(edges, v, z, settings, epoch, batch), "steps"))
            old, z = z, materialised(applied(z, done[-1]), "memberships")
            discarded(old)
        moves = reduce(DataFrame.unionByName, [d.select("accepted") for d in done]).where("accepted").count()
        discarded(*done)
        if history is not None and epoch % settings.metrics_every == 0:
            history.append(epoch_metrics(edges, vertices, z, settings.clusters, epoch, moves, evaluated=settings.evaluated).first())
        if moves < settings.least_moves * max(n, 1) and not settings.all_epochs:
            break
    if settings.divide:
        old, z = z, materialised(divided_clusters(edges, z, settings.remove_weak_links), "memberships")
        discarded(old)
    least = settings.least_size
    return remove_small_clusters(z, least) if least > (2 if settings.divide else 1) else z  # components have two members at least


def k_sample(ids: DataFrame, k: int, seed: int = 1, tag: str = "sample") -> DataFrame:
    """k of ids(id), the same for the same seed, in the order of their draws (a sort in ranges)."""
    return least_by(ids, k, uniform(tag, seed, F.col("id"))).orderBy(uniform(tag, seed, F.col("id")), "id")


def seeded_subneighborhoods(edges: DataFrame, vertices: DataFrame, k: int, seed: int = 1) -> DataFrame:
    """vertex, cluster (its seed): the best prefix of the sorted neighbours of k seeds drawn at random; sets may overlap."""
    seeds = k_sample(vertices, k, seed, "seeds").withColumnRenamed("id", "seed")
    lists = neighbors_sorted(edges).select(F.col("src").alias("seed"), F.col("dst").alias("id"), "rank").join(F.broadcast(seeds), "seed", "left_semi")
    best = best_prefixes(lists, edges, vertices)
    return lists.join(best, "seed").where("rank <= n").select(F.col("id").alias("vertex"), F.col("seed").alias("cluster"))


def uncovered_subneighborhoods(edges: DataFrame, vertices: DataFrame, k: int, seed: int = 1) -> DataFrame:
    """vertex, cluster (its seed): sub-neighbourhoods that don't overlap. Vertices come in a random order; one that nothing covers yet takes
    the best prefix of its uncovered neighbours by falling weight, which are covered then; the first k that take one count.

    A seed's choice depends on vertices within two steps only, so in a round all open vertices choose that come before every other
    open one within two steps; the result is that of one after another. Chosen and covered vertices are no longer open."""
    lists = materialised(neighbors_sorted(edges), "lists")
    open_ = materialised(vertices.select("id", F.struct(uniform("uncovered", seed, F.col("id")).alias("u"), F.col("id").alias("tie")).alias("p")), "open")
    free, taken = materialised(vertices.select("id"), "free"), []  # free: not covered, whether they have had their turn or not
    while not open_.isEmpty():
        near = lambda best: best.unionByName(lists.select(F.col("src").alias("id"), "dst").join(best.withColumnRenamed("id", "dst"), "dst").select("id", "p")).groupBy("id").agg(F.min("p").alias("p"))
        turn = materialised(open_.join(near(near(open_)).withColumnRenamed("p", "least"), "id").where("p = least").select("id", "p"), "turn")
        left = lists.join(turn.select(F.col("id").alias("src")), "src", "left_semi").join(free.withColumnRenamed("id", "dst"), "dst", "left_semi")
        mine = materialised(left.select(F.col("src").alias("seed"), F.col("dst").alias("id"), F.row_number().over(Window.partitionBy("src").orderBy("rank")).cast("long").alias("rank")), "uncovered")
        best = best_prefixes(mine, edges, vertices)
        took = mine.join(best, "seed").where("rank <= n").select(F.col("id").alias("vertex"), F.col("seed").alias("cluster"))
        taken.append(materialised(took.join(turn.withColumnRenamed("id", "cluster"), "cluster"), "taken"))
        covered = taken[-1].select(F.col("vertex").alias("id"))
        now_free = materialised(free.join(covered, "id", "left_anti"), "free")
        now_open = materialised(open_.join(turn.select("id"), "id", "left_anti").join(covered, "id", "left_anti"), "open")
        discarded(open_, free, mine, turn)
        open_, free = now_open, now_free
        seeds = reduce(DataFrame.unionByName, taken).select("cluster", "p").distinct()
        first = open_.agg(F.min("p").alias("first"))  # no open vertex comes before these seeds any more
        if seeds.crossJoin(F.broadcast(first)).where("first is null or p < first").limit(k).count() == k:  # one row
            break
    discarded(open_, free)
    every = reduce(DataFrame.unionByName, taken) if taken else None
    if every is None:
        return vertices.select(F.col("id").alias("vertex"), F.col("id").alias("cluster"))
    keys = every.select("cluster", F.col("p.u").alias("u")).distinct()
    counted = least_by(keys.select(F.col("cluster").alias("id")), k, uniform("uncovered", seed, F.col("id")))
    return every.join(counted.withColumnRenamed("id", "cluster"), "cluster", "left_semi").select("vertex", "cluster")


def colours(edges: DataFrame, vertices: DataFrame, seed: int = 1) -> DataFrame:
    """id, colour (0, 1, ...): no edge has two ends of one colour. Vertices come in a random order, each takes the least colour that no
    earlier neighbour has; in a round all choose whose earlier neighbours have chosen, so the result is that of one after another."""
    order = materialised(vertices.select("id", F.struct(uniform("colour", seed, F.col("id")).alias("u"), F.col("id").alias("tie")).alias("p")), "order")
    arcs = edges.select("src", "dst").join(order.select(F.col("id").alias("src"), F.col("p").alias("ps")), "src").join(order.select(F.col("id").alias("dst"), F.col("p").alias("pd")), "dst").where("pd < ps")
    waits = materialised(arcs.select(F.col("src").alias("id"), "dst"), "waits")  # id waits for dst
    open_ = materialised(order.select("id"), "open")
    done: list[DataFrame] = []
    used = None  # id, colour: colours of each open vertex' earlier neighbours
    while not open_.isEmpty():
        blocked = waits.join(open_.withColumnRenamed("id", "dst"), "dst", "left_semi").select("id").distinct()
        ready = open_.join(blocked, "id", "left_anti")
        if used is None:
            chosen = ready.select("id", F.lit(0).cast("long").alias("colour"))
        else:  # the first place where the sorted colours leave a gap
            ranked = used.join(ready, "id", "left_semi").withColumn("at", (F.row_number().over(Window.partitionBy("id").orderBy("colour")) - 1).cast("long"))
            gap = ranked.groupBy("id").agg(F.coalesce(F.min(F.when(F.col("colour") != F.col("at"), F.col("at"))), F.count(F.lit(1))).alias("colour"))
            chosen = ready.join(gap, "id", "left").select("id", F.coalesce("colour", F.lit(0)).cast("long").alias("colour"))
        done.append(materialised(chosen, "chosen"))
        rest = materialised(open_.join(done[-1].select("id"), "id", "left_anti"), "open")
        told = waits.join(done[-1].withColumnRenamed("id", "dst"), "dst").select("id", "colour")
        kept = told if used is None else told.unionByName(used)
        kept = materialised(kept.join(rest, "id", "left_semi").distinct(), "used")
        if used is not None:
            discarded(used)
        discarded(open_)
        open_, used = rest, kept
    return reduce(DataFrame.unionByName, done) if done else vertices.select("id", F.lit(0).cast("long").alias("colour"))


def padded(z: DataFrame, vertices: DataFrame, k: int, seed: int = 1) -> DataFrame:
    """z with clusters of one random vertex each until there are k clusters; their ids follow the largest."""
    have = z.agg(F.count_distinct("cluster").alias("n"), F.coalesce(F.max("cluster"), F.lit(-1)).alias("top")).first()
    if have["n"] >= k:
        return z
    more = k_sample(vertices, k - have["n"], seed, "padding").select(F.col("id").alias("vertex"), (F.row_number().over(Window.orderBy("id")) + have["top"]).cast("long").alias("cluster"))
    return z.select("vertex", "cluster").unionByName(more)


def start_from(edges: DataFrame, vertices: DataFrame, settings: Settings) -> DataFrame:
    """Starting memberships by ``settings.start``: neighborhoods of random cost, of least conductance, best sub-neighborhoods of random
    seeds, those among uncovered vertices, or a random cluster for each vertex."""
    k, seed = settings.clusters, settings.seed
    if settings.start == "random":
        return random_memberships(vertices, k, seed)
    if settings.start == "seeds":
        return seeded_subneighborhoods(edges, vertices, k, seed)
    if settings.start == "uncovered":
        return uncovered_subneighborhoods(edges, vertices, k, seed)
    if settings.start == "best_neighborhood":
        costs = neighborhood_conductance(edges, vertices).withColumnRenamed("conductance", "cost")
    else:
        costs = vertices.select("id", uniform("cost", seed, F.col("id")).alias("cost"))
    z = bottom_neighborhoods(edges, costs, k, settings.strategy == "multiple")
    return padded(z, vertices, k, seed)


def bottom_neighborhoods(edges: DataFrame, costs: DataFrame, k: int, overlap: bool = False) -> DataFrame:
    """vertex, cluster (its centre): closed neighbourhoods of the k cheapest centres, each taken unless an earlier one covers it.

    Centres are the first independent set by (cost, id), found in parallel rounds; costs(id, cost), rounded to 9 places."""
    ranked = costs.select("id", F.struct(F.round("cost", 9).alias("cost"), F.col("id").alias("tie")).alias("p"))
    open_, centres = materialised(ranked, "open"), None
    while not open_.isEmpty():
        near = edges.select("src", "dst").join(open_.select(F.col("id").alias("dst"), F.col("p").alias("q")), "dst").groupBy(F.col("src").alias("id")).agg(F.min("q").alias("q"))
        won = materialised(open_.join(near, "id", "left").where("q is null or p < q").select("id", "p"), "centres")
        centres = won if centres is None else centres.unionByName(won)
        covered = edges.join(won.select(F.col("id").alias("src")), "src", "left_semi").select(F.col("dst").alias("id")).union(won.select("id")).distinct()
        open_ = materialised(open_.join(covered, "id", "left_anti"), "open")
    if centres is None:
        return costs.select(F.col("id").alias("vertex"), F.col("id").alias("cluster"))
    first = centres.orderBy("p").limit(k)
    all_ = first.select("id", "p", F.col("id").alias("vertex")).unionByName(edges.select(F.col("src").alias("id"), F.col("dst").alias("vertex")).join(first, "id"))
    if overlap:
        return all_.select("vertex", F.col("id").alias("cluster")).distinct()
    return all_.groupBy("vertex").agg(F.min("p").alias("p")).select("vertex", F.col("p.tie").alias("cluster"))


def bipartite_communities(bip: DataFrame, settings: Settings, threshold: float = 0.0, top_k: int | None = None, squared: bool = False, least_edges: int = 0, step_four: bool = True, log_values: bool = False, normalize_left: bool = False, right_threshold: float = 0.0, normalize_right: bool = False, compatible: bool = True, start: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(left, right) embeddings: projection, communities, affiliation scores, then both sides' sparse products.

    Communities start from ``start`` or by ``settings.start``. ``compatible`` (the default) keeps three habits of the original: left rows
    are normalised by columns; step four divides by the norms before values changed; after squaring, scores use the degrees and mean of the
    weights as they were, unless a top-k follows. Without it, rows are normalised by rows and all figures are fresh."""
    if "w" in bip.columns:
        raise ValueError("weighted bipartite graphs are not supported")
    if top_k is not None and top_k < 1:
        raise ValueError("top_k must be at least 1")
    plain = project_right(bip, threshold)
    edges = square_weights(plain) if squared else plain
    edges = materialised(top_k_edges(edges, top_k) if top_k else edges, "projection")
    vertices = right_vertices(bip)
    figures = plain if compatible and squared and not top_k else edges
    z = materialised(fit(edges, vertices, settings, start if start is not None else start_from(edges, vertices, settings)), "communities")
    right = affiliations(edges, vertices, z, figures).select(F.col("vertex").alias("row"), F.col("cluster").alias("col"), F.col("score").alias("value")).where("value > 0")
    right = normalized(right, "col") if normalize_right else right
    left = materialised(left_embeddings(bip, right, least_edges), "left")
    before = norms(left, "col")
    left = log_transformed(left) if log_values else left
    left = normalized(left, "col" if compatible else "row") if normalize_left else left
    return left, right_embeddings(bip, left, before if compatible else None, right_threshold) if step_four else right
