"""Benchmark decontamination by a distributed positional inverted index. DataFrame functions only.

Every item is cut into windows of ``window`` words. The index holds the postings (term, row, position) of every word that any item
has (no other can be in a match): a table written once, in ranges of term and row, so a frequent term's list is spread over many
files and tasks. The lists' lengths tell each window's terms from the rarest on. The rarest term's postings are the candidates; they
are intersected with the lists of the next rarest terms, at positions near enough to belong to a match, then with those of all
terms of the window. What is shuffled are numbers, and a candidate meets twice its reach of postings at most; texts stay in place.

Exact matches: the words of a window in a row. Proximity matches: all words of a window, each as often as it has it, within
``span`` words in any order, around a posting of the rarest term.

Terms and windows go to the postings in blocks of at most ``BLOCK`` bytes, each block broadcast, so an item table of any size
works with bounded memory and no term's list meets in one task.

Defined results: a null or wordless text has no words and no hits; items without words have no windows; items with a null
item_id are left out; rows are judged each for itself, so repeated rows and ids get equal results; other columns are
ignored; an empty benchmark leaves every document clean.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillgraph.llm.common import dropped, text_hash, with_bounded_side, written

WINDOW = 10
#: Words that a proximity match may span.
SPAN = 15
#: Bytes of terms or windows that are broadcast at once, and what a row of them takes.
BLOCK, ROW = 32_000_000, 400


def words_of(text: Column) -> Column:
    low = F.translate(F.coalesce(text, F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.array_remove(F.split(low, r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"), "")


def numbered(docs: DataFrame) -> DataFrame:
    """row, doc_id, text_hash, words of every row, written once, so that a row's number stays."""
    return written(docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", text_hash().alias("text_hash"), words_of(F.col("text")).alias("words")), "rows")


def windows_of(items: DataFrame, window: int = WINDOW) -> DataFrame:
    """item_id, wid (hash of the words), phrase of every different window of an item."""
    rows = items.select("item_id", words_of(F.col("text")).alias("words")).where((F.size("words") > 0) & F.col("item_id").isNotNull())
    starts = F.sequence(F.lit(1), F.greatest(F.size("words") - (window - 1), F.lit(1)))
    rows = rows.select("item_id", F.explode(F.transform(starts, lambda i: F.slice("words", i, window))).alias("phrase"))
    return rows.select("item_id", F.md5(F.array_join("phrase", " ").cast("binary")).alias("wid"), "phrase").distinct()


def _blocks(table: DataFrame, key: str, extra: Column | None = None) -> list[DataFrame]:
    """A written table in blocks of about ``BLOCK`` bytes at most, one at least; ``extra``: a row's bytes beside ``ROW``."""
    size = table.agg(F.sum(F.lit(ROW) + (F.lit(0) if extra is None else extra))).first()[0] or 0
    n = max(1, -(-size // BLOCK))
    return [table.where(F.pmod(F.xxhash64(key), F.lit(n)) == i) for i in range(n)]


def _all(tables: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.union, tables)


def vocabulary_of(owned: DataFrame) -> DataFrame:
    """term, tid: every word of a window and its number, written."""
    return written(owned.select(F.explode("phrase").alias("term")).distinct().select("term", F.monotonically_increasing_id().alias("tid")), "vocabulary")


def postings_of(rows: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """tid, row, pos (from 0) of every word of ``rows`` that is in the vocabulary; written in the order of the lists, in ranges."""
    words = rows.select("row", F.posexplode("words").alias("pos", "term"))
    found = _all([words.join(F.broadcast(block), "term").select("tid", "row", "pos") for block in _blocks(vocabulary, "tid", F.octet_length("term"))])
    return written(found.repartitionByRange("tid", "row").sortWithinPartitions("tid", "row", "pos"), "postings")


def ranked_windows(postings: DataFrame, owned: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """w, wid, tids (of its words in order), off and t1 (first place and number of its rarest term), t2, t3 (of the next rarest; t1 if
    there is none) of every window whose words all occur; written."""
    counts = postings.groupBy("tid").agg(F.count(F.lit(1)).alias("n"))
    terms = owned.select("wid", "phrase").dropDuplicates(["wid"]).select("wid", F.posexplode("phrase").alias("offset", "term"))
    terms = terms.join(vocabulary, "term").join(counts, "tid", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    lists = terms.groupBy("wid").agg(  # a window has at most ``window`` terms
        F.sort_array(F.collect_list(F.struct("offset", "tid"))).alias("seq"),
        F.sort_array(F.collect_list(F.struct("n", "offset", "tid"))).alias("rare"),
    ).where(F.col("rare")[0]["n"] > 0)
    other = F.array_distinct(F.transform("rare", lambda x: x["tid"]))
    t1 = F.col("rare")[0]["tid"]
    return written(lists.select(
        F.monotonically_increasing_id().alias("w"), "wid", F.transform("seq", lambda x: x["tid"]).alias("tids"), F.col("rare")[0]["offset"].alias("off"),
        t1.alias("t1"), *[F.coalesce(F.get(other, F.lit(i)), t1).alias(f"t{i + 1}") for i in (1, 2)],
    ), "ranked-windows")


def _around(found: DataFrame, width: int) -> DataFrame:
    """Candidates once for each of the three stretches of ``width`` positions that hold all positions nearer than ``width``."""
    return found.withColumn("stretch", F.explode(F.array(*[F.floor(F.col("p") / width) + i for i in (-1, 0, 1)])))


def _intersected(found: DataFrame, postings: DataFrame, block: DataFrame, term: str, width: int) -> DataFrame:
    """The candidates with a posting of their ``term`` nearer than ``width``."""
    own = F.broadcast(block.select(F.col(term).alias("tid")).distinct())
    other = postings.join(own, "tid", "left_semi").select("tid", F.col("row").alias("in_row"), "pos", F.floor(F.col("pos") / width).alias("part"))
    on = (F.col("row") == F.col("in_row")) & (F.col(term) == F.col("tid")) & (F.col("stretch") == F.col("part")) & (F.abs(F.col("pos") - F.col("p")) < width)
    return _around(found, width).join(other, on, "left_semi").drop("stretch").dropDuplicates(["row", "w", "p"])


def occurrences(postings: DataFrame, windows: DataFrame, window: int = WINDOW, span: int | None = SPAN) -> DataFrame:
    """row, w, start (from 0), len, exact of the postings of a window's rarest term around which all of the window's words, each as often as
    it has them, are among ``span`` words in a row; ``exact`` where they are the window itself, beginning at ``start``. Without a ``span``, exact ones only."""
    width = max(window, span or 0)
    placed = postings.select(F.col("row").alias("in_row"), "tid", "pos", F.floor(F.col("pos") / width).alias("part"))
    out = []
    for block in _blocks(windows, "w"):
        found = postings.join(F.broadcast(block.select("w", "t1", "t2", "t3")), F.col("tid") == F.col("t1")).select("row", "w", F.col("pos").alias("p"), "t2", "t3")
        for term in ("t2", "t3"):
            found = _intersected(found, postings, block, term, width)
        whole = F.broadcast(block.select("w", "tids", "off"))
        met = _around(found.select("row", "w", "p"), width).join(whole, "w")
        met = met.join(placed, (F.col("row") == F.col("in_row")) & (F.col("stretch") == F.col("part")) & (F.abs(F.col("pos") - F.col("p")) < width) & F.array_contains("tids", F.col("tid")))
        met = met.groupBy("row", "w", "p").agg(F.collect_list(F.struct("pos", "tid")).alias("met")).join(whole, "w")  # fewer than 2 * width of them
        start = F.col("p") - F.col("off")
        wanted = F.transform("tids", lambda t, i: F.struct((start + i).alias("pos"), t.alias("tid")))
        exact = F.size(F.array_except(wanted, F.col("met"))) == 0
        inside = lambda x, t: F.size(F.filter("met", lambda y: (y["tid"] == t) & (y["pos"] >= x["pos"]) & (y["pos"] < x["pos"] + F.lit(span))))
        often = lambda t: F.size(F.filter("tids", lambda u: u == t))
        # the first word of a match is one of the window's, and p is in it
        begins = lambda x: (x["pos"] <= F.col("p")) & (x["pos"] > F.col("p") - F.lit(span)) & F.forall(F.array_distinct("tids"), lambda t: inside(x, t) >= often(t))
        close = F.lit(False) if span is None else F.exists("met", begins)
        got = met.select("row", "w", start.alias("start"), F.size("tids").alias("len"), exact.alias("exact"), close.alias("close"))
        out.append(got.where("exact or close").drop("close"))
    return _all(out)


def _found(docs: DataFrame, items: DataFrame, window: int, span: int | None) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """The written rows, windows with their items, ranked windows and matches; the index is deleted."""
    rows, owned = numbered(docs), written(windows_of(items, window), "windows")
    vocabulary = vocabulary_of(owned)
    postings = postings_of(rows, vocabulary)
    windows = ranked_windows(postings, owned, vocabulary)
    found = written(occurrences(postings, windows, window, span), "occurrences")
    dropped(postings, vocabulary)
    return rows, owned, windows, found


def judge(docs: DataFrame, items: DataFrame, window: int = WINDOW, span: int | None = None) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated, n_near, text_hash of every row.

    n_near counts items with a match within ``span`` words, exact or not; without a span, exact ones."""
    rows, owned, windows, found = _found(docs, items, window, span)
    names = windows.select("w", "wid").join(owned.select("wid", F.col("item_id").cast("string").alias("item_id")), "wid").select("w", "item_id")
    named = found.groupBy("row", "w").agg(F.max("exact").alias("exact")).join(with_bounded_side(names), "w")
    named = named.groupBy("row").agg(F.sort_array(F.collect_set(F.when(F.col("exact"), F.col("item_id")))).alias("ids"), F.count_distinct("item_id").alias("n_near"))
    hit = found.where("exact").select("row", F.explode(F.sequence("start", F.col("start") + F.col("len") - 1)).alias("p")).distinct()
    hit = hit.groupBy("row").agg(F.count(F.lit(1)).alias("n_hit"))
    zero = F.lit(0).cast("long")
    out = rows.select("row", "doc_id", "text_hash", F.size("words").cast("long").alias("n_words")).join(named.join(hit, "row", "left"), "row", "left")
    ids, n_hit = F.coalesce("ids", F.array().cast("array<string>")), F.coalesce("n_hit", zero)
    return out.select("doc_id", "n_words", n_hit.alias("n_hit"), F.size(ids).cast("long").alias("n_items"), F.sha2(F.array_join(ids, ",").cast("binary"), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"), F.coalesce("n_near", zero).alias("n_near"), "text_hash")


def matches(docs: DataFrame, items: DataFrame, window: int = WINDOW, span: int = SPAN) -> DataFrame:
    """row, doc_id, item_id, phrase, start, exact: every match of a document's row, exact or by proximity."""
    rows, owned, windows, found = _found(docs, items, window, span)
    named = with_bounded_side(windows.select("w", "wid").join(owned, "wid"))
    return found.join(named, "w").join(rows.select("row", "doc_id"), "row").select("row", "doc_id", "item_id", "phrase", "start", "exact")
