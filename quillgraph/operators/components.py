"""Connected components by alternating stars, and clusters divided into theirs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillgraph.functions.tables import discarded, materialised
from quillgraph.operators.graph import without_weak_links


def connected_components(edges: DataFrame, vertices: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """``by``, id, component (its least id) of vertices(``by``, id). Each round is a table; rounds grow with the log of the diameter."""
    links = materialised(edges.select(*by, F.col("src").alias("a"), F.col("dst").alias("b")).where("a > b").distinct(), "links")
    mark = lambda d: d.agg(F.count(F.lit(1)), F.sum(F.xxhash64(*by, "a", "b").cast("decimal(38)"))).first()
    before = mark(links)
    flip = lambda d: d.select(*by, F.col("b").alias("a"), F.col("a").alias("b"))
    while True:
        least = links.unionByName(flip(links)).groupBy(*by, "a").agg(F.least(F.col("a"), F.min("b")).alias("m"))
        large = links.unionByName(flip(links)).where("b > a").join(least, [*by, "a"]).select(*by, F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        low = large.groupBy(*by, "a").agg(F.min("b").alias("m"))
        small = large.join(low, [*by, "a"]).select(*by, F.col("b").alias("a"), F.col("m").alias("b")).unionByName(low.select(*by, "a", F.col("m").alias("b"))).where("a <> b").distinct()
        fresh = materialised(small, "links")
        now = mark(fresh)
        if now == before:
            break
        discarded(links)
        links, before = fresh, now
    label = links.groupBy(*by, F.col("a").alias("id")).agg(F.min("b").alias("label"))
    return vertices.select(*by, "id").join(label, [*by, "id"], "left").select(*by, "id", F.coalesce("label", "id").alias("component"))


def divided_clusters(edges: DataFrame, z: DataFrame, remove_weak_links: bool = True) -> DataFrame:
    """Every cluster of more than one vertex split into components, all in one loop; ids from 0 by (cluster, least vertex)."""
    a, b = z.select(F.col("vertex").alias("src"), "cluster"), z.select(F.col("vertex").alias("dst"), "cluster")
    inner = edges.join(a, "src").join(b, ["dst", "cluster"]).select("cluster", "src", "dst", "w")
    inner = without_weak_links(inner, ("cluster",)) if remove_weak_links else inner
    wide = z.groupBy("cluster").agg(F.count(F.lit(1)).alias("size")).where("size > 1").select("cluster")
    found = connected_components(inner, z.join(wide, "cluster", "left_semi").select("cluster", F.col("vertex").alias("id")), ("cluster",))
    found = materialised(found, "divided")
    # the new ids: counts of sorted ranges, then a rank within each, so that no task sees all names
    names = found.select("cluster", "component").distinct().repartitionByRange("cluster", "component").sortWithinPartitions("cluster", "component")
    names = materialised(names.select("*", F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("at")), "names")
    parts = names.groupBy("part").agg(F.min("at").alias("first"), F.count(F.lit(1)).alias("n"))
    parts = parts.select("part", "first", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before"))  # a row for each task
    names = names.join(F.broadcast(parts), "part").select("cluster", "component", (F.col("at") - F.col("first") + F.col("before")).cast("long").alias("fresh"))
    return found.join(names, ["cluster", "component"]).select(F.col("id").alias("vertex"), F.col("fresh").alias("cluster"))
