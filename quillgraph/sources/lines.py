"""Text files whose lines count: a line's number is its meaning, so lines are numbered in parallel, without one task for all."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

COMMENT = "%"


def numbered_lines(spark: SparkSession, path: str, comment: str | None = COMMENT) -> DataFrame:
    """line (from 0, without comments, over files by name), value. Each split's first number is the sum of the counts before it, one row a split."""
    rows = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"))
    if comment:
        rows = rows.where(~F.col("value").startswith(comment))
    rows = rows.select("*", F.monotonically_increasing_id().alias("id"))
    splits = rows.groupBy("file", "block").agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("n"))
    before = F.sum("n").over(Window.orderBy("file", "block")) - F.col("n")
    return rows.join(F.broadcast(splits.select("file", "block", "first", before.alias("before"))), ["file", "block"]).select((F.col("before") + F.col("id") - F.col("first")).alias("line"), "value")


def tokens(value: str = "value"):
    """The words of a line."""
    return F.filter(F.split(F.trim(F.col(value)), r"\s+"), lambda x: x != "")


def write_lines(rows: DataFrame, path: str) -> None:
    """Text files of rows(line, value) in the order of ``line``: part files by name, each a range of lines. Refuses a path that is there."""
    rows.orderBy("line").select("value").write.mode("errorifexists").text(path)
