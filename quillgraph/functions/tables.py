"""Lineage cuts, seeded uniforms, running sums and samples that the operators share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Parts of (0, 1) whose rows are counted to find a sample's threshold.
PARTS = 1 << 16


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; a temporary folder only in local mode without one, where there is one machine."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local") or "cluster" in spark.sparkContext.master:
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    made = getattr(spark.sparkContext, "_quillgraph_tables", None) or tempfile.mkdtemp(prefix="spark-")
    spark.sparkContext._quillgraph_tables = made
    return made


def materialised(df: DataFrame, name: str) -> DataFrame:
    """The rows as a Parquet table in the shared folder: a lineage cut that outlives lost executors."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._quillgraph_path = path
    return out


def discarded(*tables: DataFrame) -> None:
    """Deletes tables of ``materialised`` that nothing reads any more."""
    for table in tables:
        path = getattr(table, "_quillgraph_path", None)
        if path:
            at = table.sparkSession._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(table.sparkSession._jsc.hadoopConfiguration()).delete(at, True)


def uniform(*parts: str | int | Column) -> Column:
    """A number in (0, 1) that is a function of the parts alone."""
    columns = [p if isinstance(p, Column) else F.lit(str(p)) for p in parts]
    head = F.substring(F.md5(F.concat_ws("|", *[c.cast("string") for c in columns]).cast("binary")), 1, 8)
    return (F.conv(head, 16, 10).cast("bigint") + F.lit(0.5)) / F.lit(4294967296.0)


def with_running(rows: DataFrame, by: list[str], order: list[str], sums: tuple[str, ...] = ()) -> DataFrame:
    """Adds place (1, 2, ... among equal ``by``, by ``order``, which tells rows apart) and total_x, the running sum, for each x of ``sums``.

    ``rows`` is a written table. They are sorted into ranges of (``by``, ``order``) and counted in each; a range is told what the ranges
    before it hold of its group. So no task holds more than a range, however large a group is, or if there is but one."""
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = materialised(rows.repartitionByRange(n, *by, *order).withColumn("range", F.spark_partition_id()), "ranged")
    counts = ranged.groupBy("range", *by).agg(F.count(F.lit(1)).alias("before"), *[F.sum(x).alias(f"before_{x}") for x in sums])
    earlier = Window.partitionBy(*by).orderBy("range").rowsBetween(Window.unboundedPreceding, -1)  # a row for each range that a group lies in
    counts = counts.select("range", *by, *[F.coalesce(F.sum(c).over(earlier), F.lit(0)).alias(c) for c in ("before", *(f"before_{x}" for x in sums))])
    local = Window.partitionBy("range", *by).orderBy(*order)
    mine = ranged.select("*", F.row_number().over(local).alias("local"), *[F.sum(x).over(local.rowsBetween(Window.unboundedPreceding, 0)).alias(f"local_{x}") for x in sums])
    got = mine.join(counts, ["range", *by])
    return got.select(*rows.columns, (F.col("before") + F.col("local")).cast("long").alias("place"), *[(F.col(f"before_{x}") + F.col(f"local_{x}")).alias(f"total_{x}") for x in sums])


def least_by(ids: DataFrame, k: int, u: Column) -> DataFrame:
    """The k of ids(id) with the least ``u`` (in (0, 1)), then id. Rows are counted by ``PARTS`` parts of (0, 1); only those of the part in
    which the k-th lies are sorted, so no task merges k rows."""
    rows = ids.select("id", u.alias("u")).withColumn("part", F.floor(F.col("u") * PARTS).cast("int"))
    left = k
    for part, n in sorted(tuple(r) for r in rows.groupBy("part").agg(F.count(F.lit(1)).alias("n")).collect()):  # PARTS rows at most
        if n >= left:
            return rows.where(F.col("part") < part).select("id").unionByName(rows.where(F.col("part") == part).orderBy("u", "id").limit(left).select("id"))
        left -= n
    return rows.select("id")
