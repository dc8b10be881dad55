"""URL filters: a blocked Bloom filter of listed canonical URLs passes possible hits to an exact hash join.

A listed URL is a host and the beginning of a path, with a verdict. A URL's candidates are all suffixes of its host, at a
dot, with each beginning of its path whose length some listed path has; they stand for the same canonical strings as the
list. A candidate whose block lacks one of its bits is listed nowhere and is dropped; the others meet the list itself in an
equi-join, which removes false positives. Of the entries that fit, the longest wins (the greater string if two are as long).

Defined results: a null URL, or one without ``://``, has an empty host and path, no entry and the default verdict, as has
every URL that no entry fits. Repeated rows and ids are judged row by row; other columns are left out; an empty list gives
every row the default. Nulls in the list are dropped; of repeated entries ``block`` wins.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillgraph.llm.common import BROADCAST_ROWS, with_bounded_side

#: A block is so many 64-bit words, and a key sets one bit in each.
LANES = 4
#: Bits of the filter for each key; with four bits set a key, about one stray candidate in 500 passes.
BITS_PER_KEY = 24
DEFAULT = "allow"


def host_of(url: Column) -> Column:
    return F.when(F.instr(url, "://") > 0, _ascii_lower(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1))).otherwise(F.lit(""))


def path_of(url: Column) -> Column:
    return F.when(F.instr(url, "://") > 0, F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1)).otherwise(F.lit(""))


def _ascii_lower(c: Column) -> Column:
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def _block(key: str, blocks: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(blocks)).alias("block")


def _bits(key: str) -> list[Column]:
    """In each lane one of 64 bits, by a hash of its own."""
    return [F.expr(f"shiftleft(1L, cast(pmod(xxhash64(`{key}`, {lane}), 64) as int))") for lane in range(LANES)]


def bloom(keys: DataFrame, n_keys: int) -> tuple[DataFrame, int]:
    """(block, lane_0 ...) of the blocks with bits, and the number of blocks. Bits are combined in each task before the shuffle."""
    blocks = max(1, -(-n_keys * BITS_PER_KEY // (64 * LANES)))
    rows = keys.select(_block("key", blocks), *[b.alias(f"lane_{i}") for i, b in enumerate(_bits("key"))])
    return rows.groupBy("block").agg(*[F.bit_or(f"lane_{i}").alias(f"lane_{i}") for i in range(LANES)]), blocks


def judge(pages: DataFrame, listed: DataFrame, default: str = DEFAULT, id_column: str = "page_id", url_column: str = "url", max_lengths: int = 1000) -> DataFrame:
    """page_id, host, path, rule, verdict for every row. ``listed``: host, path, verdict, with hosts in lower case.

    ``max_lengths`` bounds the distinct path lengths of the list, which the driver holds; beyond it a ValueError is raised."""
    rules = listed.select("host", F.coalesce("path", F.lit("/")).alias("path"), "verdict").where("host is not null and verdict is not null")
    rules = rules.groupBy(F.concat("host", "path").alias("key")).agg(F.max("verdict").alias("verdict"), F.first(F.length("path")).alias("n"))
    lengths = sorted(r[0] for r in rules.select("n").distinct().limit(max_lengths + 1).collect())
    if len(lengths) > max_lengths:
        raise ValueError(f"the listed paths have over {max_lengths} different lengths")
    rules = rules.select("key", "verdict")
    n_keys = rules.count()
    filter_, blocks = bloom(rules, n_keys)
    filter_ = F.broadcast(filter_) if blocks <= BROADCAST_ROWS else filter_
    rules = with_bounded_side(rules)

    url = F.col(url_column)
    rows = pages.select(F.col(id_column).alias("page_id"), host_of(url).alias("host"), path_of(url).alias("path"))
    rows = rows.select(F.monotonically_increasing_id().alias("row"), "page_id", F.coalesce("host", F.lit("")).alias("host"), F.coalesce("path", F.lit("")).alias("path"))
    labels = F.split("host", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.greatest(F.size(labels), F.lit(1))), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    starts = F.array(*[F.when(F.length("path") >= n, F.substring("path", 1, n)) for n in lengths]) if lengths else F.array().cast("array<string>")
    keys = F.flatten(F.transform(suffixes, lambda s: F.transform(F.array_compact(starts), lambda p: F.concat(s, p))))
    rows = rows.select("*", F.explode_outer(F.when(F.col("host") != "", F.array_distinct(keys))).alias("candidate"))
    rows = rows.withColumn("block", F.pmod(F.xxhash64("candidate"), F.lit(blocks))).join(filter_, "block", "left")
    passes = F.lit(True)
    for i, bit in enumerate(_bits("candidate")):
        passes = passes & (F.col(f"lane_{i}").bitwiseAND(bit) == bit)
    # what doesn't pass gets a key of its own, which no entry has: nulls would all meet in one task of a shuffled join
    rows = rows.withColumn("key", F.when(passes, F.col("candidate")).otherwise(F.concat(F.lit("\x00"), F.col("row").cast("string"))))
    rows = rows.join(rules, "key", "left")
    fits = F.when(F.col("verdict").isNotNull(), F.struct(F.length("key").alias("n"), F.col("key").alias("key"), F.col("verdict").alias("verdict")))
    out = rows.groupBy("row").agg(F.first("page_id").alias("page_id"), F.first("host").alias("host"), F.first("path").alias("path"), F.max(fits).alias("best"))
    return out.select("page_id", "host", "path", F.col("best.key").alias("rule"), F.coalesce("best.verdict", F.lit(default)).alias("verdict"))
