"""The corpus pipeline: quality rules, near-dedup, suffix dedup, decontamination, byte-level BPE, each over what the last one kept.

A document is known by its doc_id and text: rows that are equal in both get one verdict. A null doc_id is a value like others.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillgraph.llm import bpe, decontaminate, neardup, quality, suffixes
from quillgraph.llm.common import text_hash, written

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def _those(docs: DataFrame, verdicts: DataFrame) -> DataFrame:
    """The documents with a row in ``verdicts`` (doc_id, text_hash)."""
    rows, few = docs.select(*COLUMNS, text_hash().alias("hash_")), verdicts.select(F.col("doc_id").alias("id_"), F.col("text_hash").alias("verdict_"))
    return rows.join(few, rows["doc_id"].eqNullSafe(few["id_"]) & (rows["hash_"] == few["verdict_"]), "left_semi")


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules keep."""
    trusted = spark.read.parquet(f"{sf_dir}/labels.parquet").where("quality = 1").select("doc_id")
    return _those(docs, quality.judge(docs, trusted).where("kept")).select(*COLUMNS)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first document of each class of near copies: the least doc_id (nulls last), then the least text key; one row of it."""
    return _those(docs, neardup.classes(docs, exact=True).where("is_first")).dropDuplicates(["doc_id", "hash_"]).select(*COLUMNS)


def suffix_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document without its repeated passages; one of which nothing remains is dropped."""
    out = suffixes.kept_texts(docs.select(*COLUMNS)).where("text <> ''")
    return out.withColumn("n_chars", F.char_length("text").cast("long")).select(*COLUMNS)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark passage."""
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return _those(docs, decontaminate.judge(docs, items).where("not contaminated")).select(*COLUMNS)


def byte_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Digests of each text's ids and of what they decode to."""
    return bpe.round_trip(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_rules", quality_rules),
    ("near_dedup", near_dedup),
    ("suffix_dedup", suffix_dedup),
    ("decontamination", decontamination),
    ("byte_bpe", byte_bpe),
]

#: Consistent weighted sampling and rolling hashes can't be said in SQL; tests/llm/test_pipeline.py holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name)
    return docs
