"""Quality rules: counts of words, symbols and repeats, and a log-likelihood ratio of hashed word 1- and 2-grams between a
trusted target and the raw corpus, both as smoothed multinomials over a fixed number of cells. DataFrame functions only.

A text is scored with the counts of all other rows: its own n-grams are taken out of the raw counts and, if it is trusted, out
of the target's. Both multinomials are smoothed at the target's scale: ratio = ln((T + SMOOTHING) / (E + SMOOTHING)), T the
target's count of the cell and E its raw share times the target's size. So a cell with little evidence has a ratio near 0
whatever the corpus' size, and with more text the ratio goes to that of the shares.

Defined results: a null text has no words; an empty or wordless text fails the base rules; repeated rows are judged each for
itself with equal results; a doc_id of null is kept as null; other columns of the input don't matter. With no trusted
document every ratio is 0 and nothing falls below the threshold. All documents are counted and all are judged; there is no
sample.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillgraph.llm.common import text_hash, with_bounded_side, written

#: Java's form of one or more of x20, x09 to x0D.
SPACE = r"[\x20\x09-\x0D]+"
SYMBOLS = r"[#*$%&|<>]"
CELLS = 1 << 16
#: Added to the target's count of every cell and to the count that the raw shares let expect there.
SMOOTHING = 5.0
#: A text goes if its mean log ratio per n-gram (nats) is below.
THRESHOLD = -0.2


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACE), "")


def _with_repeats(rows: DataFrame) -> DataFrame:
    """Adds n_repeat_words, the words inside 3-word windows that the text has twice or more; in steps, so that each array is made once.
    Windows of one text are compared by 64-bit hashes."""
    m, less = F.greatest(F.size("words") - 2, F.lit(0)), F.greatest(F.size("windows") - 1, F.lit(0))
    pairs = F.arrays_zip(F.slice("words", 1, m).alias("a"), F.slice("words", 2, m).alias("b"))
    rows = rows.withColumn("windows", F.zip_with(pairs, F.slice("words", 3, m), lambda p, c: F.xxhash64(p["a"], p["b"], c)))
    rows = rows.withColumn("ordered", F.when(F.size(F.array_distinct("windows")) < F.size("windows"), F.sort_array(F.arrays_zip("windows", F.sequence(F.lit(0), less).alias("i")))))
    twice = F.zip_with(F.slice("ordered", 1, less), F.slice("ordered", 2, less), lambda a, b: F.when(a["windows"] == b["windows"], F.array(a["i"], b["i"])))
    rows = rows.withColumn("twice", F.array_distinct(F.flatten(F.array_compact(twice))))
    inside = F.size(F.array_distinct(F.flatten(F.array("twice", F.transform("twice", lambda i: i + 1), F.transform("twice", lambda i: i + 2)))))
    return rows.withColumn("n_repeat_words", F.when(F.col("ordered").isNull(), 0).otherwise(inside).cast("long")).drop("windows", "ordered", "twice")


def base_counts(docs: DataFrame) -> DataFrame:
    """doc_id, text_hash, words, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed of every row."""
    text = F.coalesce(F.col("text"), F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    rows = docs.select("doc_id", text_hash().alias("text_hash"), text.alias("text"), words_of(F.col("text")).alias("words"), lines.alias("lines"))
    rows = rows.select(
        "doc_id",
        "text_hash",
        "words",
        F.size("words").cast("long").alias("n_words"),
        F.char_length(F.array_join("words", "")).cast("long").alias("word_chars"),
        (F.char_length("text") - F.char_length(F.regexp_replace("text", SYMBOLS, ""))).cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
    )
    return _with_repeats(rows).withColumn("base_failed", (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words")))


def grams(rows: DataFrame, cells: int = CELLS) -> DataFrame:
    """A row for each word: ``one``, the word's cell, and ``two``, that of it and the next word (null for the last); one row of nulls where there are no words."""
    pairs = F.arrays_zip(F.col("words").alias("a"), F.slice("words", 2, F.greatest(F.size("words") - 1, F.lit(1))).alias("b"))
    rest = [c for c in rows.columns if c != "words"]
    one = F.when(F.col("p.a").isNotNull(), F.pmod(F.xxhash64("p.a"), F.lit(cells)).cast("int"))
    two = F.when(F.col("p.b").isNotNull(), F.pmod(F.xxhash64("p.a", "p.b"), F.lit(cells)).cast("int"))
    return rows.select(*rest, F.explode_outer(pairs).alias("p")).select(*rest, one.alias("one"), two.alias("two"))


def with_runs(rows: DataFrame, cells: int = CELLS) -> DataFrame:
    """Adds n_grams and runs, an array of (cell, own: how often the row has it); in steps, so that each array is made once."""
    less = F.greatest(F.size("words") - 1, F.lit(0))
    cell = lambda *parts: F.pmod(F.xxhash64(*parts), F.lit(cells)).cast("int")
    two = F.zip_with(F.slice("words", 1, less), F.slice("words", 2, less), lambda a, b: cell(a, b))
    rows = rows.withColumn("all", F.sort_array(F.concat(F.transform("words", lambda w: cell(w)), two))).withColumn("n_grams", F.size("all").cast("long"))
    numbered = F.arrays_zip(F.col("all").alias("cell"), F.sequence(F.lit(1), F.greatest(F.size("all"), F.lit(1))).alias("i"))
    following = F.concat(F.slice("all", 2, F.greatest(F.size("all") - 1, F.lit(0))), F.array(F.lit(-1)))
    rows = rows.withColumn("ends", F.array_compact(F.zip_with(numbered, following, lambda x, y: F.when(x["cell"] != y, x))))
    before = F.concat(F.array(F.lit(0)), F.slice(F.col("ends.i"), 1, F.greatest(F.size("ends") - 1, F.lit(0))))
    runs = F.zip_with("ends", before, lambda e, i: F.struct(e["cell"].alias("cell"), (e["i"] - i).cast("long").alias("own")))
    return rows.withColumn("runs", runs).drop("all", "ends")


def gram_counts(docs: DataFrame, ids: DataFrame, cells: int = CELLS) -> DataFrame:
    """cell, raw, target: how often all documents and those of ``ids`` (trusted_id) have each cell.

    Counts are combined in each task before the shuffle; at most ``cells`` rows come out, whatever the corpus."""
    rows = docs.select("doc_id", words_of(F.col("text")).alias("words")).join(ids, F.col("doc_id") == F.col("trusted_id"), "left")
    rows = rows.select(F.col("trusted_id").isNotNull().cast("long").alias("t"), "words")
    counts = grams(rows, cells).select("t", F.explode(F.array("one", "two")).alias("cell")).where("cell is not null").groupBy("cell").agg(F.count(F.lit(1)).alias("raw"), F.sum("t").alias("target"))
    return written(counts, "gram-counts")


def judge(docs: DataFrame, trusted: DataFrame, threshold: float = THRESHOLD, cells: int = CELLS, smoothing: float = SMOOTHING) -> DataFrame:
    """doc_id, the base columns, kept, llr (mean log ratio per n-gram, 0 without words) and text_hash for every row.

    Each row's cells are scored against the broadcast counts (at most ``cells`` rows) and summed per row within its task, as a
    trusted row's and as another's; which of the sums holds is joined to the short rows that come out."""
    ids = with_bounded_side(trusted.select(F.col("doc_id").alias("trusted_id")).where("trusted_id is not null").distinct())
    counts = gram_counts(docs, ids, cells)
    total = counts.agg(F.sum("raw").alias("n"), F.sum("target").alias("m")).first()
    n, m = total["n"] or 0, total["m"] or 0
    keep = ["row", "doc_id", "text_hash", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "n_grams"]
    rows = with_runs(base_counts(docs), cells).withColumn("row", F.monotonically_increasing_id())
    cell = rows.select(*keep, F.explode_outer("runs").alias("x")).select(*keep, F.col("x.cell").alias("cell"), F.col("x.own").alias("own"))
    cell = cell.join(F.broadcast(counts), "cell", "left")
    others = (F.col("raw") - F.col("own")) / F.greatest(F.lit(n) - F.col("n_grams"), F.lit(1))
    ratio = lambda count, size: F.col("own") * F.log((count + F.lit(smoothing)) / (others * size + F.lit(smoothing)))
    foreign = ratio(F.col("target"), F.lit(m))
    member = ratio(F.greatest(F.col("target") - F.col("own"), F.lit(0)), F.greatest(F.lit(m) - F.col("n_grams"), F.lit(0)))
    rest = [F.first(c).alias(c) for c in keep[1:]]
    sums = cell.groupBy("row").agg(*rest, F.sum(foreign).alias("foreign"), F.sum(member).alias("member"))
    sums = sums.join(ids, F.col("doc_id") == F.col("trusted_id"), "left")
    of = F.coalesce(F.when(F.col("trusted_id").isNotNull(), F.col("member")).otherwise(F.col("foreign")), F.lit(0.0))
    sums = sums.withColumn("llr", F.round(F.when(F.col("n_grams") > 0, of / F.col("n_grams")).otherwise(F.lit(0.0)), 9))
    return sums.select("doc_id", *keep[3:-1], (~F.col("base_failed") & (F.col("llr") >= threshold)).alias("kept"), "llr", "text_hash")
