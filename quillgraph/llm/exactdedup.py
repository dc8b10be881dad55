"""Exact dedup against a persistent index of digests, bucketed and sorted by digest. DataFrame functions only.

The index is a Parquet table at a path: a row for each different text, in buckets of the digest's hash, each file sorted by digest.
A load's rows are brought down to one leader a digest, in each task before the shuffle; leaders meet the index in a sort-merge
anti-join that leaves the index where it lies, and those that it doesn't know are appended. A load is taken in by falling length
(``ROUNDS``), so that of equal texts the first to come is the longest: the one that stays.

Texts are equal when they are identical without the characters of ``SPACE``; SHA-256 of that form stands for a text. Of a load's
equal texts the row with the most code points in the original text stays, then that of the least doc_id (null last), then one of
the rows that are equal in both. Where the index knows a text from an earlier load, none of the new rows stays.

Defined results: a null text is empty, and empty texts are equal to each other and to those of white space alone; repeated rows are
rows of one group, of which one stays; doc_id may be null and comes back as null; other columns don't matter; an empty table gives
no rows. group_size counts the load's rows. A group is never gathered: ``hot_join`` sends large
groups' one row to the rows by broadcast and the others' by a shuffle.
"""

from __future__ import annotations

import hashlib
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillgraph.functions.tables import discarded, materialised, shared_dir
from quillgraph.llm.common import hot_join

SPACE = r"[\x20\x09-\x0D]"
#: A load is taken in by texts of at least so many code points, one round after another.
ROUNDS = (4000, 1000, 0)
SCHEMA = "digest BINARY, doc_id BIGINT, row BIGINT, load STRING"


def text_digest(text: Column) -> Column:
    """SHA-256 of the text without white space, 32 bytes."""
    return F.unhex(F.sha2(F.regexp_replace(F.coalesce(text, F.lit("")), SPACE, "").cast("binary"), 256))


def digest_rows(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, digest and a number of each row; written, so that the text is read once and the numbers stay."""
    text = F.coalesce(F.col("text"), F.lit(""))
    return materialised(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.char_length(text).cast("long").alias("n_chars"), text_digest(text).alias("digest"), F.monotonically_increasing_id().alias("row")), "digests")


def open_index(spark: SparkSession, path: str, buckets: int | None = None) -> str:
    """The table's name in the session. The number of buckets is part of the path and is kept: an existing index is opened as it is."""
    root = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = root.getFileSystem(spark._jsc.hadoopConfiguration())
    found = [s.getPath().getName() for s in files.listStatus(root)] if files.exists(root) else []
    n = next((int(name.removeprefix("buckets-")) for name in found if name.startswith("buckets-")), buckets or int(spark.conf.get("spark.sql.shuffle.partitions")))
    at = f"{path}/buckets-{n}"
    files.mkdirs(spark._jvm.org.apache.hadoop.fs.Path(at))
    name = f"digest_index_{hashlib.md5(path.encode()).hexdigest()[:16]}"
    spark.sql(f"CREATE TABLE IF NOT EXISTS {name} ({SCHEMA}) USING parquet CLUSTERED BY (digest) SORTED BY (digest) INTO {n} BUCKETS LOCATION '{at}'")
    return name


def forget_index(spark: SparkSession, path: str) -> None:
    """Deletes the index and its name."""
    spark.sql(f"DROP TABLE IF EXISTS digest_index_{hashlib.md5(path.encode()).hexdigest()[:16]}")
    root = spark._jvm.org.apache.hadoop.fs.Path(path)
    root.getFileSystem(spark._jsc.hadoopConfiguration()).delete(root, True)


def leaders(rows: DataFrame) -> DataFrame:
    """digest, doc_id, row: of each digest's rows the longest, then of the least doc_id, nulls last."""
    first = F.min(F.struct((-F.col("n_chars")).alias("less"), F.col("doc_id").isNull().alias("none"), "doc_id", "row")).alias("x")
    return rows.groupBy("digest").agg(first).select("digest", "x.doc_id", "x.row")


def unknown(spark: SparkSession, index: str, found: DataFrame) -> DataFrame:
    """Those of found(digest, ...) that the index doesn't hold; the index is read bucket by bucket and not shuffled."""
    return found.join(spark.table(index).select("digest").hint("merge"), "digest", "left_anti")


def append(spark: SparkSession, index: str, found: DataFrame, load: str) -> None:
    """Adds the leaders that the index doesn't hold; a bucket gets one more sorted file."""
    unknown(spark, index, found).select("digest", "doc_id", "row", F.lit(load).alias("load")).write.insertInto(index)


def compacted(spark: SparkSession, path: str, into: str) -> str:
    """The index written anew at ``into`` with one file a bucket, after many loads."""
    old = open_index(spark, path)
    buckets = spark.sql(f"DESCRIBE EXTENDED {old}").where("col_name = 'Num Buckets'").first()["data_type"]
    new = open_index(spark, into, int(buckets))
    spark.table(old).repartition(int(buckets), "digest").write.insertInto(new)
    return new


def deduplicated(docs: DataFrame, path: str | None = None, buckets: int | None = None) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 of every row, after the load has been added to the index at ``path`` (None: to a
    fresh one, deleted at the end)."""
    spark, load = docs.sparkSession, uuid.uuid4().hex
    own = path or f"{shared_dir(spark)}/digest-index-{load}"
    rows, index = digest_rows(docs), open_index(spark, own, buckets)
    for at, least in enumerate(ROUNDS):
        some = F.col("n_chars") >= least
        append(spark, index, leaders(rows.where(some if at == 0 else some & (F.col("n_chars") < ROUNDS[at - 1]))), load)
    sizes = rows.groupBy("digest").agg(F.count(F.lit(1)).alias("group_size"))
    held = spark.table(index).select("digest", F.col("doc_id").alias("keep_id"), F.when(F.col("load") == load, F.col("row")).alias("keep_row"))
    groups = materialised(sizes.join(held.hint("merge"), "digest"), "groups")
    kept = F.coalesce(F.col("keep_row") == F.col("row"), F.lit(False))
    out = materialised(hot_join(rows, groups, ["digest"], "group_size", rows.count()).select("doc_id", "keep_id", "group_size", kept.alias("kept"), F.lower(F.hex("digest")).alias("text_sha256")), "exact")
    discarded(rows, groups)
    if path is None:
        forget_index(spark, own)
    return out
