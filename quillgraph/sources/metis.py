"""Graphs in Metis text form: a header, then a line of neighbours for each vertex. Ids are from 1 in files and from 0 in tables."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillgraph.operators.graph import TOLERANCE, vertex_degrees
from quillgraph.sources.lines import numbered_lines, tokens, write_lines


@dataclass(frozen=True)
class MetisGraph:
    """``edges``: src, dst, w in both directions; ``vertices``: id; the counts are the header's; ``warnings``: where the lines differ from it."""

    edges: DataFrame
    vertices: DataFrame
    n_vertices: int
    n_edges: int
    weighted: bool
    warnings: tuple[str, ...] = ()


def _header(lines: DataFrame, least: int) -> list[str]:
    first = lines.where("line = 0").first()
    parts = first["value"].split() if first else []
    if len(parts) < least or not all(p.isdigit() for p in parts[:least]):
        raise ValueError("the first line must have the numbers of vertices and edges")
    return parts


def _raise_if_any(rows: DataFrame, what: str) -> None:
    found = rows.limit(3).collect()
    if found:
        raise ValueError(f"{what}: {', '.join(str(tuple(r)) for r in found)}")


def violations(edges: DataFrame) -> DataFrame:
    """kind, src, dst of every edge that is listed twice, lacks its opposite, or weighs otherwise there (by more than the tolerance)."""
    grouped = edges.groupBy("src", "dst").agg(F.count(F.lit(1)).alias("n"), F.first("w").alias("w"))
    opposite = grouped.select(F.col("src").alias("dst"), F.col("dst").alias("src"), F.col("w").alias("w2"))
    joined = grouped.join(opposite, ["src", "dst"], "left")
    kind = F.when(F.col("n") > 1, "repeated").when(F.col("w2").isNull(), "one-sided").when(F.isnan("w") | (F.abs(F.col("w") - F.col("w2")) > TOLERANCE), "weights differ")
    return joined.select(kind.alias("kind"), "src", "dst").where("kind is not null")


def read_metis(spark: SparkSession, path: str, check: bool = True) -> MetisGraph:
    """A weighted graph if the header's third word is 1: then words alternate between neighbour and weight.

    ValueError for ids below 1, an odd number of directed edges (unweighted), edges that are repeated, one-sided or of two weights."""
    lines = numbered_lines(spark, path)
    header = _header(lines, 2)
    n, m, weighted = int(header[0]), int(header[1]), len(header) > 2 and header[2] == "1"
    rows = lines.where((F.col("line") > 0) & (F.col("line") <= n)).select((F.col("line") - 1).alias("src"), tokens().alias("t"))
    if weighted:
        pairs = F.transform(F.sequence(F.lit(0), F.floor(F.size("t") / 2) - 1), lambda i: F.struct(F.get("t", 2 * i).alias("id"), F.get("t", 2 * i + 1).alias("w")))
        pair = F.explode(F.when(F.size("t") > 1, pairs))
        edges = rows.select("src", pair.alias("p")).select("src", (F.col("p.id").cast("long") - 1).alias("dst"), F.col("p.w").cast("double").alias("w"))
    else:
        edges = rows.select("src", F.explode("t").alias("id")).select("src", (F.col("id").cast("long") - 1).alias("dst"), F.lit(1.0).alias("w"))
    notes = []
    if check:
        _raise_if_any(edges.where("dst < 0").select("src", "dst"), "ids must be from 1")
        got = edges.count()
        if got % 2 and not weighted:
            raise ValueError(f"{got} directed edges; every edge must be there in both directions")
        if got != 2 * m:
            notes.append(f"the header has {m} edges, the lines {got / 2:g}")
        _raise_if_any(violations(edges), "edges")
    return MetisGraph(edges, spark.range(n), n, m, weighted, tuple(notes))


def metis_lines(edges: DataFrame, vertices: DataFrame, weight_format: str | None = None) -> DataFrame:
    """line, value of the Metis form: the header in line 0, vertices by rising id. ``weight_format``: a printf form of weights; without it, none are written."""
    item = F.concat_ws(" ", (F.col("x.dst") + 1).cast("string"), F.format_string(weight_format, F.col("x.w"))) if weight_format else (F.col("x.dst") + 1).cast("string")
    own = edges.select("src", F.struct("dst", "w").alias("x")).select("src", F.struct(F.col("x.dst"), item.alias("s")).alias("y")).groupBy("src").agg(F.array_sort(F.collect_list("y")).alias("ys"))
    rows = vertices.select("id").join(own, F.col("id") == F.col("src"), "left")
    body = rows.select((F.col("id") + 1).alias("line"), F.coalesce(F.array_join(F.col("ys.s"), " "), F.lit("")).alias("value"))
    counts = vertices.agg(F.count(F.lit(1)).alias("n")).crossJoin(edges.agg((F.count(F.lit(1)) / 2).cast("long").alias("m")))  # one row each
    head = counts.select(F.lit(0).cast("long").alias("line"), F.concat_ws(" ", F.col("n").cast("string"), F.col("m").cast("string"), *([F.lit("1")] if weight_format else [])).alias("value"))
    return head.unionByName(body)


def write_metis(edges: DataFrame, vertices: DataFrame, path: str, weight_format: str | None = None) -> None:
    write_lines(metis_lines(edges, vertices, weight_format), path)


@dataclass(frozen=True)
class BipartiteGraph:
    """``edges``: l, r; ids of each side from 0."""

    edges: DataFrame
    n_left: int
    n_right: int
    n_edges: int


def read_bipartite_metis(spark: SparkSession, path: str) -> BipartiteGraph:
    """Header "left right edges", then a line of right neighbours for each left vertex, then of left ones for each right vertex.

    ValueError if there are more or fewer lines, ids out of range, repeated neighbours, directions that differ, or another number of edges."""
    lines = numbered_lines(spark, path)
    n_left, n_right, m = (int(x) for x in _header(lines, 3)[:3])
    got = lines.agg(F.count(F.lit(1))).first()[0] - 1
    if got != n_left + n_right:
        raise ValueError(f"{n_left + n_right} lines after the header were due, {got} are there")
    rows = lines.where("line > 0").select((F.col("line") - 1).alias("i"), F.explode(tokens()).alias("t")).select("i", (F.col("t").cast("long") - 1).alias("j"))
    left = rows.where(F.col("i") < n_left).select(F.col("i").alias("l"), F.col("j").alias("r"))
    right = rows.where(F.col("i") >= n_left).select(F.col("j").alias("l"), (F.col("i") - n_left).alias("r"))
    outside = (F.col("l") < 0) | (F.col("l") >= n_left) | (F.col("r") < 0) | (F.col("r") >= n_right) | F.col("l").isNull() | F.col("r").isNull()
    _raise_if_any(left.unionByName(right).where(outside), "ids out of range (from 0)")
    both = left.withColumn("s", F.lit(1)).unionByName(right.withColumn("s", F.lit(2))).groupBy("l", "r").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("s").alias("sides"))
    _raise_if_any(both.where("n <> 2 or sides <> 2").select("l", "r"), "edges (from 0) that are repeated or in one direction only")
    count = left.count()
    if count != m:
        raise ValueError(f"the header has {m} edges, the lines {count}")
    return BipartiteGraph(left, n_left, n_right, m)
