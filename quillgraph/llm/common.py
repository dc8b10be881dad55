"""Helpers that the training-data operators share."""

from __future__ import annotations

import contextlib
import gc
import tempfile
import time
import uuid
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A side of at most this many short rows (a key and a few numbers) may be broadcast.
BROADCAST_ROWS = 1_000_000
#: A key of over a HOT-th of all rows is hot; so there are fewer than HOT hot keys.
HOT = 1000


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``; a temporary one only in local mode, where there is one machine."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local") or "cluster" in spark.sparkContext.master:
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    made = getattr(spark.sparkContext, "_quillgraph_shared", None) or tempfile.mkdtemp(prefix="spark-")
    spark.sparkContext._quillgraph_shared = made
    return made


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """Cuts the lineage: the rows as a Parquet table in the shared folder, which outlives lost executors."""
    path = fresh_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._quillgraph_path = path
    return out


def written_in_turn(parts: Iterable[DataFrame], name: str) -> DataFrame:
    """The rows of all parts (one at least) as one such table; a part's shuffles are gone before the next one begins."""
    path = None
    for part in parts:
        path = path or fresh_path(part.sparkSession, name)
        part.write.mode("append").option("compression", "zstd").parquet(path)
        dropped()
    out = part.sparkSession.read.schema(part.schema).parquet(path)
    out._quillgraph_path = path
    return out


def dropped(*tables: DataFrame | None) -> None:
    """Deletes written tables that nothing reads any more, and lets the driver forget finished shuffles, whose files Spark then removes."""
    for table in tables:
        path = getattr(table, "_quillgraph_path", None)
        if path:
            jvm, spark = table.sparkSession._jvm, table.sparkSession
            at = jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
    for _ in range(2):  # Python's proxies go first, by a thread of their own, then what they held
        gc.collect()
        time.sleep(0.2)
        SparkSession.active().sparkContext._jvm.System.gc()


def with_bounded_side(side: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """The side with a broadcast hint if a count proves it small; otherwise as it is, for a shuffled join."""
    return F.broadcast(side) if side.limit(rows + 1).count() <= rows else side


def hot_join(rows: DataFrame, side: DataFrame, on: list[str], weight: str, total: int, how: str = "inner") -> DataFrame:
    """``rows`` joined (inner or left) to ``side``, a written table with one row a key whose ``weight`` is the number of rows that have it, of ``total``.

    Keys of over a ``HOT``-th of the rows, fewer than ``HOT`` of them, are broadcast, so no task gets such a key's rows; the rest is shuffled."""
    hot = F.broadcast(side.where(F.col(weight) * HOT > total))
    keys = F.broadcast(side.where(F.col(weight) * HOT > total).select(*on))
    return rows.join(hot, on).unionByName(rows.join(keys, on, "left_anti").join(side.where(F.col(weight) * HOT <= total), on, how))


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def text_key(text: str | Column = "text") -> Column:
    """128 bits that stand for a whole text; null and empty texts have the same."""
    return F.md5(F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit("")).cast("binary"))


def text_hash(text: str | Column = "text") -> Column:
    """64 bits that tell the texts of one doc_id apart; null and empty texts have the same."""
    return F.xxhash64(F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit("")))


def arrow_schema(spark: SparkSession, schema: str) -> pa.Schema:
    return pa.schema([(f.name, _arrow(f.dataType)) for f in spark.createDataFrame([], schema).schema])


def mapped(df: DataFrame, work: Callable[[Iterator[pa.RecordBatch]], Iterator[dict]], schema: str) -> DataFrame:
    """``work`` turns a task's Arrow batches into dicts of equally long lists or arrays by the schema's names."""
    kinds = arrow_schema(df.sparkSession, schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for got in work(batches):
            yield pa.RecordBatch.from_arrays([v if isinstance(v := got[f.name], pa.Array) else pa.array(v, type=f.type) for f in kinds], schema=kinds)

    return df.mapInArrow(run, schema)


@contextlib.contextmanager
def small_batches(spark: SparkSession, rows: int, size: int) -> Iterator[None]:
    """What is run meanwhile hands Python Arrow batches of ``rows`` rows at most, and of few more than ``size`` bytes unless a row has them. An
    executor has a batch twice, outside its heap and in the worker."""
    limits = {"spark.sql.execution.arrow.maxRecordsPerBatch": rows, "spark.sql.execution.arrow.maxBytesPerBatch": size}
    before = {k: spark.conf.get(k) for k in limits}
    try:
        for k, v in limits.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def per_batch(df: DataFrame, columns: list, work: Callable[..., dict], schema: str) -> DataFrame:
    """``work(*lists)`` over every Arrow batch of ``columns``; it returns a dict of equally long lists or arrays by the schema's names."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for batch in batches:
            if batch.num_rows:
                yield work(*(c.to_pylist() for c in batch.columns))

    return mapped(df.select(*columns), run, schema)


def _arrow(kind) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(kind)
