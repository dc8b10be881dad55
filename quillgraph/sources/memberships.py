"""Memberships z(vertex, cluster) and scored rows as text: a line for each vertex or each cluster, ids from 1 in files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillgraph.sources.lines import numbered_lines, tokens, write_lines


def _lists(spark: SparkSession, path: str, line: str, item: str) -> DataFrame:
    rows = numbered_lines(spark, path, None).select(F.col("line").alias(line), F.explode(tokens()).alias("t")).select(line, (F.col("t").cast("long") - 1).alias(item)).distinct()
    bad = rows.where(F.col(item).isNull() | (F.col(item) < 0)).first()
    if bad:
        raise ValueError(f"ids must be numbers from 1, unlike one of line {bad[line] + 1}")
    return rows


def read_rows(spark: SparkSession, path: str, n_vertices: int | None = None) -> DataFrame:
    """z from a line of clusters for each vertex; a blank line is a vertex without. ValueError if there are not ``n_vertices`` lines."""
    if n_vertices is not None and (got := numbered_lines(spark, path, None).count()) != n_vertices:
        raise ValueError(f"{n_vertices} lines were due, {got} are there")
    return _lists(spark, path, "vertex", "cluster")


def read_columns(spark: SparkSession, path: str) -> DataFrame:
    """z from a line of vertices for each cluster."""
    return _lists(spark, path, "cluster", "vertex").select("vertex", "cluster")


def from_sets(sets: DataFrame) -> DataFrame:
    """z from sets(cluster, members array)."""
    return sets.select(F.explode("members").alias("vertex"), "cluster").distinct()


def _joined(items: DataFrame, by: str, ids: DataFrame, value) -> DataFrame:
    """line (from 1), value: the items' strings by rising id, for each of ids(id), empty ones too."""
    own = items.groupBy(F.col(by).alias("id")).agg(F.array_sort(F.collect_list("x")).alias("xs"))
    return ids.select("id").join(own, "id", "left").select((F.col("id") + 1).alias("line"), F.coalesce(F.array_join(F.transform("xs", value), " "), F.lit("")).alias("value"))


def row_lines(z: DataFrame, vertices: DataFrame) -> DataFrame:
    """A line of rising cluster ids for each vertex."""
    return _joined(z.select("vertex", F.col("cluster").alias("x")), "vertex", vertices, lambda x: (x + 1).cast("string"))


def column_lines(z: DataFrame, clusters: DataFrame) -> DataFrame:
    """A line of rising vertex ids for each of clusters(id)."""
    return _joined(z.select("cluster", F.col("vertex").alias("x")), "cluster", clusters, lambda x: (x + 1).cast("string"))


def scored_lines(m: DataFrame, rows: DataFrame, n_columns: int | None = None) -> DataFrame:
    """A line of ``id:score`` by rising column for each of rows(id), scores in two digits; with ``n_columns``, a header "rows columns" in line 0."""
    out = _joined(m.select("row", F.struct("col", "value").alias("x")), "row", rows, lambda x: F.format_string("%d:%.2g", x["col"] + 1, x["value"]))
    if n_columns is None:
        return out
    head = rows.agg(F.concat_ws(" ", F.count(F.lit(1)).cast("string"), F.lit(str(n_columns))).alias("value")).select(F.lit(0).cast("long").alias("line"), "value")
    return head.unionByName(out)


def precision_lines(precision: DataFrame) -> DataFrame:
    """A line of two decimals for each of precision(cluster, precision), by rising cluster (a row a cluster is ranked)."""
    return precision.select(F.row_number().over(Window.orderBy("cluster")).cast("long").alias("line"), F.format_string("%.2f", "precision").alias("value"))


def write(lines: DataFrame, path: str) -> None:
    write_lines(lines, path)
