"""Token ids in ORC: stripes with run-length coded integers, row indexes, and a Bloom filter on the document ids.

Documents are dealt out by ranges of doc_id and sorted in each range before they are encoded, so the files hold them in
ascending order and a reader can prune files, stripes and row groups by doc_id. Reading is parallel by stripe.

Defined results: a null text is empty and has the end id only; rows with equal ids follow one another, ordered by text;
null ids come first; other columns are ignored.
"""

from __future__ import annotations

import functools
import os
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillgraph.llm.common import fresh_path, mapped, partitions

VOCABULARY, END = "word_bpe_49k.json", 2
#: Chunks of text whose ids a worker remembers, in two generations of at most so many each.
MEMO = 500_000
#: A chunk of its own between others, whose id shows where they end.
MARK = "\x01"
#: Rows of one Arrow batch of ids.
ROWS = 1000
SCHEMA = "doc_id long, part int, row long, n_tokens int, ids array<int>"


class _Memo:
    """Packed ids (little-endian, 32 bits) of chunks between ASCII white space. The vocabulary's words never cross white space, so the chunks' ids make the text's."""

    def __init__(self, vocabulary: str):
        import public_tokenizers
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        self.tokenizer = Tokenizer.from_file(vocabulary if "/" in vocabulary else public_tokenizers.path(vocabulary))
        self.mark = self.tokenizer.encode(MARK, add_special_tokens=False).ids
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def together(self, chunks: list[str]) -> list[bytes]:
        """The packed ids of chunks that are encoded as one text, without offsets; one by one if a chunk has the mark."""
        text = f" {MARK} ".join(chunks)
        if len(self.mark) == 1 and text.count(MARK) == len(chunks) - 1:
            ids = np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, "<u4")
            marks = 4 * np.flatnonzero(ids == self.mark[0])
            if len(marks) == len(chunks) - 1:
                return _cut(ids.tobytes(), [0, *(marks + 4).tolist()], [*marks.tolist(), 4 * len(ids)])
        got = self.tokenizer.encode(chunks, is_pretokenized=True, add_special_tokens=False)
        ends = (4 * np.cumsum(np.bincount(np.array(got.word_ids, np.int64), minlength=len(chunks)))).tolist()
        return _cut(np.array(got.ids, "<u4").tobytes(), [0, *ends[:-1]], ends)

    def ids(self, chunks: list[str]) -> list[bytes]:
        """Of each chunk. Unknown ones are encoded many at a call."""
        out = list(map(self.known.get, chunks))
        missing = []
        for i, got in enumerate(out):
            if got is None:
                out[i] = self.older.get(chunks[i])
                if out[i] is None:
                    missing.append(i)
        for at in range(0, len(missing), 4096):
            part = missing[at : at + 4096]
            for i, packed in zip(part, self.together([chunks[i] for i in part]), strict=True):
                out[i] = packed
        if missing:
            if len(self.known) >= MEMO:
                self.known, self.older = {}, self.known
            self.known.update((chunks[i], out[i]) for i in missing if len(chunks[i]) <= 64)
        return out


def _cut(raw: bytes, starts: list[int], ends: list[int]) -> list[bytes]:
    return [raw[a:b] for a, b in zip(starts, ends, strict=True)]


@functools.lru_cache(2)
def _memo(vocabulary: str) -> _Memo:
    return _Memo(vocabulary)


def encode_texts(texts: pa.Array, vocabulary: str = VOCABULARY, end: int = END) -> pa.ListArray:
    """The ids of each text, with the end id. A batch's words are made different first, so each is looked up once."""
    words = pc.ascii_split_whitespace(texts.fill_null(""))
    ends = words.offsets.to_numpy()
    flat = words.values.slice(ends[0], ends[-1] - ends[0]).dictionary_encode()
    packed = _memo(vocabulary).ids(flat.dictionary.to_numpy(zero_copy_only=False).tolist()) + [np.array([end], "<u4").tobytes()]
    sizes = np.array([len(p) for p in packed]) // 4
    table, starts = np.frombuffer(b"".join(packed), "<i4"), np.cumsum(sizes) - sizes
    ends = ends - ends[0]
    word = np.insert(flat.indices.to_numpy(), ends[1:], len(packed) - 1)  # the end id after each text's last word
    many = sizes[word]
    after = np.cumsum(many)
    ids = table[np.repeat(starts[word] - (after - many), many) + np.arange(after[-1] if len(after) else 0)]
    last = after[ends[1:] + np.arange(len(texts))]
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], last]).astype(np.int32)), pa.array(ids))


def write(docs: DataFrame, path: str, vocabulary: str = VOCABULARY, end: int = END) -> None:
    """Files of doc_id, part, row, n_tokens, ids in ascending doc_id order."""
    spark = docs.sparkSession
    rows = docs.select("doc_id", "text").repartitionByRange(partitions(spark), "doc_id").sortWithinPartitions("doc_id", "text")
    rows = rows.select("doc_id", F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("row"), "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                piece = batch.slice(at, ROWS)
                ids = encode_texts(piece.column(3), vocabulary, end)
                yield {"doc_id": piece.column(0), "part": piece.column(1), "row": piece.column(2), "n_tokens": np.diff(ids.offsets.to_numpy()), "ids": ids}

    out = mapped(rows, run, SCHEMA)
    out.write.option("orc.bloom.filter.columns", "doc_id").option("orc.create.index", "true").option("compression", "zstd").orc(path)


def stored(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, part, row, n_tokens, ids; a condition on doc_id reads only the files' stripes and row groups that may hold it."""
    return spark.read.schema(SCHEMA).orc(path)


def read(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 from the files."""
    table = stored(spark, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for batch in batches:
            lists = batch.column(3)
            ends = lists.offsets.to_numpy()
            ids, ends = memoryview(lists.values.to_numpy().astype("<i4", copy=False)).cast("B"), (ends * 4).tolist()
            yield {"doc_id": batch.column(0), "part": batch.column(1), "row": batch.column(2), "n_tokens": np.diff(ends) // 4, "ids_crc32": [zlib.crc32(ids[a:b]) for a, b in zip(ends, ends[1:], strict=False)]}

    rows = mapped(table.select("doc_id", "part", "row", "ids"), run, "doc_id long, part int, row long, n_tokens long, ids_crc32 long")
    sizes = table.groupBy("part").agg(F.sum(F.col("n_tokens").cast("long")).alias("n"))
    before = sizes.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before"))  # a row for each file
    inside = F.sum("n_tokens").over(Window.partitionBy("part").orderBy("row")) - F.col("n_tokens")
    return rows.withColumn("inside", inside).join(F.broadcast(before), "part").select("doc_id", (F.col("before") + F.col("inside")).alias("start"), "n_tokens", "ids_crc32")


def round_trip(docs: DataFrame) -> DataFrame:
    path = fresh_path(docs.sparkSession, "token-ids")
    write(docs, path)
    return read(docs.sparkSession, path)
