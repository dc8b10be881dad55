"""Source divergence audit: how far each source of a language is from its other sources, and which terms mark it out.

Late string materialization: tasks count terms and write partial counts beside the terms' text; only fixed-width digests of terms are
shuffled to count documents and occurrences. Text is read again for the digests that stay, as the least and the greatest string of
each: where they differ the digest stands for several terms and is split by its text, counted anew. Names are joined to the kept
output alone. Figures are whole numbers and exact; tasks turn counts to shares by long division in base 1000.

A term is a match of ``TERM`` with only A-Z lower-cased. Of each language the V terms stay that are in at least ``LEAST_DOCS`` of its
rows. p = 1 + floor(SCALE * (count + 2) / (N + 2 V)), N the sum of a group's counts over the kept terms; two shares' distance is
floor((p - q)^2 / (p + q)).

Defined results: null text, lang and source are ''; every (lang, source) that occurs is a group, with or without terms; repeated
rows count each for itself; a language without kept terms has pairs of value 0 and no term rows; a language of one source has no
pairs; ties are ordered by the item's bytes; other columns don't matter; an empty table gives no rows. Whole texts are read, and all
rows counted.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillgraph.functions.tables import discarded, materialised
from quillgraph.llm.common import mapped, with_bounded_side

#: Letters A-Z, a-z and all bytes of characters beyond ASCII, of the UTF-8 bytes.
TERM = re.compile(rb"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
LEAST_DOCS = 10
SCALE = 1_000_000_000
TOP = 10
#: Bits of a term's digest.
BITS = 64
#: A task hands on its counts when it has so many different (group, term).
HELD = 250_000
#: Shares of one step of the pairs' arithmetic: terms x sources.
CELLS = 1 << 19


def partial_counts(docs: DataFrame, bits: int = BITS) -> DataFrame:
    """lang, source, term, digest, n, docs: a task's counts of its own rows; a (lang, source, term) may come in several rows. A group
    without terms comes with a null term."""

    def rows(held: dict) -> dict:
        sizes = [max(1, len(n)) for n, _ in held.values()]
        names = [pa.array([key[i] for key in held], pa.string()).take(np.repeat(np.arange(len(held)), sizes)) for i in (0, 1)]
        terms = [t for n, _ in held.values() for t in n or [None]]
        digests = np.fromiter((0 if t is None else xxhash.xxh64_intdigest(t) for t in terms), np.uint64, len(terms))
        ns = [c for n, _ in held.values() for c in n.values() or [0]]
        ds = [seen.get(t, 0) for n, seen in held.values() for t in n or [None]]
        return {"lang": names[0], "source": names[1], "term": pa.array(terms, pa.binary()).cast(pa.string()), "digest": (digests >> np.uint64(64 - bits)).view(np.int64), "n": ns, "docs": ds}

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        held: dict = {}
        for batch in batches:
            for text, lang, source in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                n, seen = held.setdefault((lang, source), (Counter(), Counter()))
                found = TERM.findall(text.encode().lower())
                n.update(found)
                seen.update(set(found))
            if sum(len(n) for n, _ in held.values()) > HELD:
                yield rows(held)
                held = {}
        if held:
            yield rows(held)

    plain = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("text", "lang", "source")])
    return mapped(plain, work, "lang string, source string, term string, digest long, n long, docs long")


def _p(count: str, total: str, v: str) -> Column:
    """A share, exactly."""
    return F.expr(f"CAST(1 + (CAST({SCALE} AS DECIMAL(10,0)) * CAST({count} + 2 AS DECIMAL(20,0))) div CAST({total} + 2 * {v} AS DECIMAL(20,0)) AS BIGINT)")


def shares(counts: np.ndarray, totals: np.ndarray) -> np.ndarray:
    """1 + floor(SCALE * counts / totals) of whole numbers with counts <= totals < 2^53."""
    out, left = np.zeros_like(counts), counts % totals
    out += counts // totals
    for _ in range(3):
        left = left * 1000
        out = out * 1000 + left // totals
        left = left % totals
    return out + 1


def _pair_sums(vectors: DataFrame) -> DataFrame:
    """lang_no, a, b (places of sources in their language, a < b), value: sums over the terms of a batch, to be summed further."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for batch in batches:
            langs, lists, totals, vs = (batch.column(i) for i in range(4))
            no = langs.to_numpy()
            for lang in np.unique(no):
                at = np.flatnonzero(no == lang)
                n_all = np.asarray(totals[int(at[0])].as_py(), np.int64)
                size, v = len(n_all), vs[int(at[0])].as_py()
                step = max(1, CELLS // size)
                for lo in range(0, len(at), step):
                    some = at[lo : lo + step]
                    counts = np.zeros((len(some), size), np.int64)
                    for k, i in enumerate(some):
                        for x in lists[int(i)].as_py():
                            counts[k, x["place"]] = x["n"]
                    p = shares(counts + 2, np.broadcast_to(n_all + 2 * v, counts.shape))
                    for a in range(size - 1):
                        d, s = p[:, a, None] - p[:, a + 1 :], p[:, a, None] + p[:, a + 1 :]
                        yield {"lang_no": np.full(size - 1 - a, lang), "a": np.full(size - 1 - a, a), "b": np.arange(a + 1, size), "value": (d * d // s).sum(0)}

    return mapped(vectors.select("lang_no", "vec", "totals", "v"), work, "lang_no long, a long, b long, value long")


def kept_terms(partial: DataFrame, groups: DataFrame, least_docs: int = LEAST_DOCS) -> tuple[DataFrame, DataFrame]:
    """(vectors, names): lang_no, digest, part (the text where a digest was split, else null) and vec, the (place, n) of a kept term's
    sources; and the text of each digest that wasn't split."""
    rows = partial.where("term is not null").join(with_bounded_side(groups.select("lang", "source", "lang_no", "place")), ["lang", "source"])
    plain = rows.select("lang_no", "place", "digest", "n", "docs")
    counts = plain.groupBy("lang_no", "digest", "place").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    by_term = lambda counts, *key: counts.groupBy("lang_no", *key).agg(F.collect_list(F.struct("place", "n")).alias("vec"), F.sum("docs").alias("docs")).where(F.col("docs") >= least_docs).drop("docs")
    found = materialised(by_term(counts, "digest"), "vectors")
    some = found.select("lang_no", "digest")
    texts = rows.select("lang_no", "digest", "place", "n", "docs", "term").join(with_bounded_side(some), ["lang_no", "digest"], "left_semi")
    named = texts.select("lang_no", "digest", "term").distinct()  # hashed, where least and greatest strings need a sort
    names = materialised(named.groupBy("lang_no", "digest").agg(F.min("term").alias("lo"), F.max("term").alias("hi")), "names")
    clashes = with_bounded_side(names.where("lo <> hi").select("lang_no", "digest"))
    parts = texts.join(clashes, ["lang_no", "digest"], "left_semi").groupBy("lang_no", "digest", "term", "place").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    split = by_term(parts, "digest", "term").select("lang_no", "digest", F.col("term").alias("part"), "vec")
    whole = found.join(clashes, ["lang_no", "digest"], "left_anti").select("lang_no", "digest", F.lit(None).cast("string").alias("part"), "vec")
    vectors = materialised(whole.unionByName(split), "kept")
    discarded(found)
    return vectors, names


def audit(docs: DataFrame, least_docs: int = LEAST_DOCS, top: int = TOP, bits: int = BITS) -> DataFrame:
    """lang, source, part ('pair' or 'term'), item, value, rank of every group."""
    partial = materialised(partial_counts(docs, bits), "partial")
    found = partial.select("lang", "source").distinct()
    langs = found.select("lang").distinct().select("lang", (F.row_number().over(Window.orderBy("lang")) - 1).cast("long").alias("lang_no"))  # a row a language
    places = found.join(F.broadcast(langs) if langs.limit(10_001).count() <= 10_000 else langs, "lang")
    groups = materialised(places.withColumn("place", (F.row_number().over(Window.partitionBy("lang").orderBy("source")) - 1).cast("long")), "groups")  # a row a source
    vectors, names = kept_terms(partial, groups, least_docs)
    counted = vectors.select("lang_no", F.explode("vec").alias("x")).groupBy("lang_no", "x.place").agg(F.sum("x.n").alias("total"))
    kept = vectors.groupBy("lang_no").agg(F.count(F.lit(1)).alias("v"))
    sums = groups.join(counted, ["lang_no", "place"], "left").join(kept, "lang_no", "left")
    sums = materialised(sums.select("lang_no", "place", "lang", "source", F.coalesce("total", F.lit(0)).alias("total"), F.coalesce("v", F.lit(0)).alias("v")), "totals")
    by_lang = sums.groupBy("lang_no", "v").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "total"))), lambda x: x["total"]).alias("totals"), F.sum("total").alias("lang_total"))

    pairs = _pair_sums(vectors.join(with_bounded_side(by_lang.drop("lang_total")), "lang_no")).groupBy("lang_no", "a", "b").agg(F.sum("value").alias("value"))
    empty = sums.where("v = 0").select("lang_no", F.col("place").alias("a")).join(sums.where("v = 0").select("lang_no", F.col("place").alias("b")), "lang_no").where("a < b").select("lang_no", "a", "b", F.lit(0).cast("long").alias("value"))
    half = pairs.unionByName(empty)
    both = half.select("lang_no", F.explode(F.array(F.struct(F.col("a").alias("place"), F.col("b").alias("other")), F.struct(F.col("b").alias("place"), F.col("a").alias("other")))).alias("x"), "value").select("lang_no", "x.place", "x.other", "value")
    other = sums.select("lang_no", F.col("place").alias("other"), F.col("source").alias("item"))
    pair = both.join(other, ["lang_no", "other"]).select("lang_no", "place", F.lit("pair").alias("part"), "item", "value")

    cells = vectors.withColumn("lang_n", F.aggregate("vec", F.lit(0).cast("long"), lambda a, x: a + x["n"])).select("lang_no", "digest", F.col("part").alias("text"), "lang_n", F.explode("vec").alias("x")).select("lang_no", "digest", "text", "lang_n", "x.place", "x.n")
    cells = cells.join(with_bounded_side(sums.select("lang_no", "place", "total", "v")), ["lang_no", "place"]).join(with_bounded_side(by_lang.select("lang_no", "lang_total")), "lang_no")
    cells = cells.where("n > 0").withColumn("p", _p("n", "total", "v")).withColumn("q", _p("lang_n", "lang_total", "v")).where("p > q")
    scored = cells.select("lang_no", "place", "digest", "text", F.expr("((p - q) * (p - q)) div (p + q)").alias("value"))
    best = scored.withColumn("k", F.rank().over(Window.partitionBy("lang_no", "place").orderBy(F.desc("value")))).where(F.col("k") <= top)  # with the ties of the last
    term = best.join(names.select("lang_no", "digest", "lo"), ["lang_no", "digest"], "left").select("lang_no", "place", F.lit("term").alias("part"), F.coalesce("text", "lo").alias("item"), "value")

    order = Window.partitionBy("lang_no", "place", "part").orderBy(F.desc("value"), "item")
    ranked = pair.withColumn("rank", F.row_number().over(order)).unionByName(term.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top))
    out = materialised(ranked.join(sums.select("lang_no", "place", "lang", "source"), ["lang_no", "place"]).select("lang", "source", "part", "item", "value", F.col("rank").cast("int").alias("rank")), "audit")
    discarded(partial, groups, vectors, names, sums)
    return out
