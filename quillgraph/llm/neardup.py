"""Near-duplicate classes by improved consistent weighted sampling (Ioffe, 2010) over TF-IDF word shingles.

Equal texts are collapsed. A shingle of five words weighs its count in the text times ln(1 + texts / df). The queries take the
exact document frequency of every shingle; without ``exact``, one below the ``FREQUENT``-th part of all shingles of all texts
counts as that much. Shingles of at least that part are at most ``FREQUENT``, whatever the corpus, and are broadcast: such a
shingle has its share in some task at least, so only shingles that reach it in one are counted over all texts. All others are
counted in ranges of their hashes, to which each group of texts sends its different ones, and a group gets those back that two
texts or more have. Ranges and groups take turns, so only a part of the shingles is on disk twice at a time.

``BANDS`` x ``ROWS`` consistent weighted samples make the bands' buckets. All texts that share a bucket are compared by exact
weighted Jaccard similarity, unless they are one class already: a task has a bucket's shingles and searches it breadth first,
each text against those that no link has reached. Two bounds skip comparisons that can't succeed: a text's weight against the
other's, and the weight of the shingles that it shares with any other against what a similar pair must have in common. Buckets
of equal members are searched once. A bucket of more than ``BLOCK`` shingles first has ``LEADS`` leaders (those that have most
company in all of their buckets, the likely origins of groups of copies), each compared with all others; if that doesn't make it
one class, it is dealt into blocks, and every two blocks meet in a task. A bucket gives one link less than it has texts at most,
so no pair list grows with its square. Classes are connected components of the links.

Defined results: null and empty texts are equal texts; texts of fewer than five words are one shingle; wordless texts have
no near copies; rows with equal texts share their class, rows with equal ids and different texts need not; other columns are
ignored. class_id is the least doc_id of the class (null if it has none), class_key a number of its own for each class, even
where ids repeat. is_first marks the rows of the least doc_id (nulls last), of the least text key if two have it.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillgraph.llm.common import arrow_schema, dropped, hot_join, mapped, partitions, small_batches, text_hash, text_key, with_bounded_side, written, written_in_turn

WORDS, THRESHOLD = 5, 0.8
BANDS, ROWS = 8, 3
#: Shingles of a bucket that a task compares with one another, and leaders of a bucket of more.
BLOCK, LEADS = 1 << 19, 2
#: What a text counts besides its shingles, so a block of very short texts is not of too many.
LEAST = 50
FREQUENT = 1 << 18
#: Bits of a text's number within its group, of hashes that tell their range, and of both that tell whose turn it is.
WITHIN, RANGE, TURN = 8, 10, 2
#: Document frequencies up to this have their costs in tables.
LOW = 8
#: Pairs of one leader that may meet in a task; a leader of more is copied to as many tasks as it takes.
SHARE = 512
#: Shingles that a task counts, and candidates that are counted at once.
TASK = 1 << 22
FREQUENT_BLOCK = 1 << 20
TABLE = 1 << 16
_SEED = np.random.default_rng(20)
GAMMA = _SEED.gamma(2.0, 1.0, TABLE)
LOG_C = np.log(_SEED.gamma(2.0, 1.0, TABLE))
BETA = _SEED.random(TABLE)
ODD = _SEED.integers(1, 1 << 63, BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
FACTOR = np.uint64(0x9E3779B97F4A7C15)
#: Texts, and bytes of more than one text, that a task cuts at once; of any rows, those of an Arrow batch.
TEXTS, BYTES = 1 << 10, 1 << 24
#: Shingles that a task samples at once.
CHUNK = 1 << 19


def shingles(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each text's different shingles' hashes in order, their counts, and where each text's begin (and the last ends). Every different word is hashed once."""
    import xxhash

    split = pc.utf8_split_whitespace(texts)
    ends = split.offsets.to_numpy()
    words = split.values.slice(ends[0], ends[-1] - ends[0]).dictionary_encode()
    names, at = words.dictionary.cast(pa.binary()).to_numpy(zero_copy_only=False).tolist(), words.indices.to_numpy()
    hashed = np.frombuffer(b"".join(map(xxhash.xxh64_digest, names)), ">u8").astype(np.uint64)
    word = at != pc.index(words.dictionary, "").as_py()  # space at a text's ends gives empty ones
    ends = np.append(0, np.cumsum(word))[ends - ends[0]]
    w, starts, many = hashed[at[word]], ends[:-1], np.diff(ends)
    h = np.zeros(len(w), np.uint64)
    for i in range(min(WORDS, len(w))):
        some = len(w) - WORDS + 1
        h[: max(some, 0)] = h[: max(some, 0)] * FACTOR + w[i : i + max(some, 0)]
    for n in range(1, WORDS):
        short = starts[many == n]
        h[short] = 0
        for i in range(n):
            h[short] = h[short] * FACTOR + w[short + i]
    sizes = np.where(many, np.maximum(many - WORDS + 1, 1), 0)
    ends = np.append(0, np.cumsum(sizes))
    h = h[np.repeat(starts - ends[:-1], sizes) + np.arange(ends[-1])]
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(32)
    for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True):
        h[a:b].sort()
    last = np.ones(len(h), bool)
    last[:-1] = h[1:] != h[:-1]
    last[ends[1:][sizes > 0] - 1] = True
    kept = np.flatnonzero(last)
    return h[kept], np.diff(kept, prepend=-1), np.append(0, np.cumsum(last))[ends]


class Weights:
    """Inverse document frequencies of ``texts``, where one below ``least`` counts as that much; ``hashes`` (in order) and ``df`` of the frequent shingles."""

    def __init__(self, hashes: np.ndarray, df: np.ndarray, texts: int, least: float):
        order = np.argsort(hashes)
        self.hashes = np.append(hashes[order], ~np.uint64(0))
        self.df, self.texts, self.least = np.append(df[order], 0), max(texts, 1), least
        self.rare = float(self.of(1, 1))
        low = np.log(self.of(1, np.arange(1, LOW + 1)))
        self.packed = np.concatenate([_ordered(_costs(np.full(TABLE, x), np.arange(TABLE))[0]) for x in low])

    @property
    def idf(self) -> np.ndarray:
        return np.append(self.of(1, self.df[:-1]), 0.0)

    def frequent(self, h: np.ndarray) -> np.ndarray:
        """Document frequencies, 0 of those that are not frequent."""
        at = np.searchsorted(self.hashes[:-1], h)
        return np.where(self.hashes[at] == h, self.df[at], 0)

    def of(self, n: np.ndarray, df: np.ndarray) -> np.ndarray:
        """Weights of shingles that a text has ``n`` times."""
        return np.log1p(self.texts / np.maximum(df, self.least)) * n


def _costs(log_w: np.ndarray, i: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """ln a and t of the elements whose random numbers have index i."""
    r, b = GAMMA[i], BETA[i]
    t = np.floor(log_w / r + b)
    return LOG_C[i] - r * (t - b + 1), t


def _ordered(cost: np.ndarray) -> np.ndarray:
    """Numbers with 32 bits in front that sort like the costs, and 32 zeros."""
    u = cost.astype(np.float32).view(np.uint32)
    return (u ^ np.where(u >> np.uint32(31), np.uint32(0xFFFFFFFF), np.uint32(0x80000000))).astype(np.uint64) << np.uint64(32)


def samples(h: np.ndarray, n: np.ndarray, df: np.ndarray, starts: np.ndarray, weights: Weights) -> np.ndarray:
    """A row for each text (its shingles begin at ``starts``, none is without), a 64-bit value for each sample: the shingle and its step that were drawn."""
    special, row = np.flatnonzero((n > 1) | (df > LOW)), (np.minimum(df, LOW).astype(np.int64) - 1) * TABLE
    log_w = np.log(weights.of(n[special], df[special]))
    place = np.arange(len(h), dtype=np.uint64)
    out = np.empty((len(starts), len(ODD)), np.uint64)
    for j, odd in enumerate(ODD):
        i = ((h * odd) >> np.uint64(48)).astype(np.int64)
        packed = weights.packed[row + i]
        packed[special] = _ordered(_costs(log_w, i[special])[0])
        drawn = (np.minimum.reduceat(packed | place, starts) & np.uint64(0xFFFFFFFF)).astype(np.int64)
        t = _costs(np.log(weights.of(n[drawn], df[drawn])), i[drawn])[1]
        out[:, j] = h[drawn] * FACTOR + t.astype(np.int64).view(np.uint64)
    return out


def similarity(a: tuple, b: tuple) -> float:
    """Weighted Jaccard similarity of two (hashes in order, weights)."""
    if not len(a[0]) or not len(b[0]):
        return 0.0
    at = np.minimum(np.searchsorted(a[0], b[0]), len(a[0]) - 1)
    hit = a[0][at] == b[0]
    both = np.minimum(a[1][at[hit]], b[1][hit]).sum()
    return float(both / (a[1].sum() + b[1].sum() - both))


def forest(h: np.ndarray, w: np.ndarray, starts: np.ndarray, label: np.ndarray, side: np.ndarray, threshold: float) -> Iterator[tuple[int, int, int]]:
    """(text, other, root) for every text that a similar ``other`` connects to the ``root`` of a search, in which texts of one
    ``label`` are connected already. Texts of one ``side`` are not compared, unless all are of one. ``starts``: where each text's
    shingles begin, and the last one's end."""
    of = lambda i: (h[starts[i] : starts[i + 1]], w[starts[i] : starts[i + 1]])
    m, one_side = len(label), (side == side[0]).all()
    if m == 2:
        if label[0] != label[1] and similarity(of(0), of(1)) >= threshold:
            yield 1, 0, 0
        return
    total = np.add.reduceat(w, starts[:-1])
    _, column, times = np.unique(h, return_inverse=True, return_counts=True)
    shared = times[column] > 1  # other shingles are in no intersection
    row = np.repeat(np.arange(m), np.diff(starts))[shared]
    column, weight = column[shared], w[shared]
    common = np.bincount(row, weight, m)
    ends = np.searchsorted(row, np.arange(m + 1))
    dense = np.zeros(len(times))
    least, slack = threshold / (1 + threshold), 1 - 1e-9  # similar texts have that part of their summed weights in common
    mates: dict[int, list[int]] = {}
    for i, x in enumerate(label.tolist()):
        mates.setdefault(x, []).append(i)
    unreached, hopeful = np.ones(m, bool), common >= threshold * slack * total

    def gathered(texts: np.ndarray) -> tuple[np.ndarray, ...]:
        sizes = ends[texts + 1] - ends[texts]
        heads = np.cumsum(sizes) - sizes
        at = np.repeat(ends[texts] - heads, sizes) + np.arange(sizes.sum())
        return texts, column[at], weight[at], heads

    pool = None
    for first in range(m):
        if not unreached[first]:
            continue
        queue = mates[int(label[first])]
        unreached[queue] = False
        queue = list(queue)
        while queue:
            i = queue.pop()
            lower = least * slack * (total + total[i])
            may = unreached & hopeful & (common >= lower) & (common[i] >= lower)
            if not one_side:
                may &= side != side[i]
            if not may.any():
                continue
            if pool is None or 2 * unreached[pool[0]].sum() < len(pool[0]):
                pool = gathered(np.flatnonzero(unreached & hopeful))
            some = pool if 4 * may.sum() > len(pool[0]) else gathered(np.flatnonzero(may))
            own = slice(ends[i], ends[i + 1])
            dense[column[own]] = weight[own]
            both = np.add.reduceat(np.minimum(dense[some[1]], some[2]), some[3])
            dense[column[own]] = 0
            for j in some[0][may[some[0]] & (both >= lower[some[0]])].tolist():
                if unreached[j] and similarity(of(i), of(j)) >= threshold:
                    yield j, i, first
                    fresh = mates[int(label[j])]
                    unreached[fresh] = False
                    queue += fresh


def shingled(docs: DataFrame) -> DataFrame:
    """no, key, id (least doc_id), size (different shingles), hs, ns, h, n of every different text; written once. Copies are combined in each task before the shuffle.

    hs and ns are the bytes of the shingles' hashes (64 bits) and counts (32 bits), which Spark moves as they are; arrays it would
    copy number by number. h and n are the arrays, made only where they are read."""
    rows = docs.select(text_key().alias("key"), F.col("doc_id").alias("id"), F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.groupBy("key").agg(F.min("id").alias("id"), F.first("text").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for batch in batches:
            before = np.append(0, np.cumsum(pc.binary_length(batch.column(2)).to_numpy().astype(np.int64)))
            at = 0
            while at < batch.num_rows:
                many = max(1, min(TEXTS, int(np.searchsorted(before, before[at] + BYTES, "right")) - 1 - at))
                piece = batch.slice(at, many)
                h, n, ends = shingles(piece.column(2))
                yield {"key": piece.column(0), "id": piece.column(1), "size": np.diff(ends), "hs": _packed(ends, h), "ns": _packed(ends, n.astype(np.int32))}
                at += many

    kind = docs.schema["doc_id"].dataType.simpleString()
    out = mapped(rows, run, f"key string, id {kind}, size long, hs binary, ns binary")
    table = written(out.withColumn("no", F.monotonically_increasing_id()), "shingles")
    named = table.withColumns({"h": _array("long", np.int64)("hs"), "n": _array("int", np.int32)("ns")})
    named._quillgraph_path = table._quillgraph_path
    return named


def _packed(ends: np.ndarray, values: np.ndarray) -> pa.Array:
    """The bytes of the values between every two ends."""
    ends = ends * values.itemsize
    if ends[-1] >= 1 << 31:
        raise ValueError("over 2 GB of shingles at once")
    return pa.Array.from_buffers(pa.binary(), len(ends) - 1, [None, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(values))])


def _unpacked(raw: pa.Array, kind: type) -> tuple[np.ndarray, np.ndarray]:
    """All values of such an array, and where each row's begin (and the last's end)."""
    ends = np.frombuffer(raw.buffers()[1], np.int32)[raw.offset : raw.offset + len(raw) + 1] if len(raw) else np.zeros(1, np.int32)
    data = memoryview(raw.buffers()[2])[ends[0] : ends[-1]] if ends[-1] > ends[0] else b""
    return np.frombuffer(data, kind), (ends - ends[0]).astype(np.int64) // np.dtype(kind).itemsize


def _array(name: str, kind: type) -> Callable[[str], Column]:
    """Makes such bytes an array."""

    def run(raw: pa.Array) -> pa.Array:
        values, ends = _unpacked(raw, kind)
        return _lists(ends, values)

    return F.arrow_udf(run, f"array<{name}>")


def _whole(table: pa.Table) -> pa.RecordBatch:
    """All rows of a table in one batch."""
    batches = table.combine_chunks().to_batches()
    if len(batches) != 1:
        raise ValueError("over 2 GB of shingles at once")
    return batches[0]


def _flat(lists: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All values of an array of lists, and where each list begins (and the last ends)."""
    ends = lists.offsets.to_numpy()
    return lists.values.to_numpy()[ends[0] : ends[-1]], (ends - ends[0]).astype(np.int64)


def _counted(table: DataFrame, some: DataFrame, least: float) -> pd.DataFrame:
    """s, df of those of a bounded number of shingles that ``least`` texts have; each task counts its own texts."""
    block = table.sparkSession.sparkContext.broadcast(np.sort(some.toPandas()["s"].to_numpy(np.int64)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        df = np.zeros(len(block.value), np.int64)
        for batch in batches:
            all_ = _unpacked(batch.column(0), np.int64)[0]
            for at in range(0, len(all_), FREQUENT_BLOCK):
                own = np.sort(all_[at : at + FREQUENT_BLOCK])
                df += np.searchsorted(own, block.value, "right") - np.searchsorted(own, block.value)
        yield {"s": block.value[df > 0], "df": df[df > 0]}

    sums = mapped(table.select("hs"), run, "s long, df long").groupBy("s").agg(F.sum("df").alias("df"))
    return sums.where(F.col("df") >= least).toPandas()


def frequencies(table: DataFrame, frequent: int = FREQUENT, exact: bool = False) -> Weights:
    """The weights of the corpus with its frequent shingles; the driver gets ``frequent`` rows at most."""
    total = table.agg(F.sum("size").alias("n"), F.count(F.lit(1)).alias("texts")).first()
    least = (total["n"] or 0) / frequent

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        parts = [_unpacked(b.column(0), np.int64)[0] for b in batches]
        all_ = np.concatenate(parts) if parts else np.zeros(0, np.int64)
        parts.clear()
        all_.sort()
        many = max(1, -(-len(all_) // frequent))  # a shingle of fewer is rare in this task
        some = all_[many - 1 :][all_[many - 1 :] == all_[: max(0, len(all_) - many + 1)]]
        yield {"s": some[np.append(True, some[1:] != some[:-1])] if len(some) else some}

    # tasks of so many shingles that few are frequent in one; all of them in small corpora
    table = table.select("hs").coalesce(max(1, (total["n"] or 0) // TASK))
    some = written(mapped(table, run, "s long").distinct(), "candidates")
    blocks = max(1, -(-some.count() // FREQUENT_BLOCK))
    got = [_counted(table, some.where(F.pmod("s", F.lit(blocks)) == i), least) for i in range(blocks)]
    dropped(some)
    got = pd.concat(got)
    return Weights(got["s"].to_numpy(np.int64).view(np.uint64), got["df"].to_numpy(np.int64), total["texts"] or 0, 0.0 if exact else least)


def _pieces(values: np.ndarray) -> list[tuple[int, int]]:
    """From where to where equal values follow one another."""
    cuts = (np.flatnonzero(values[1:] != values[:-1]) + 1).tolist()
    return list(zip([0, *cuts], [*cuts, len(values)], strict=True)) if len(values) else []


def _lists(ends: np.ndarray, values: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(values))


def _group() -> Column:
    return F.shiftright("no", WITHIN).alias("group")


def others(table: DataFrame, weights) -> DataFrame:
    """group, h, df: for each group of texts (in any number of rows) those of its shingles that are not frequent and that two texts or more have; none if rare ones count as one. Written."""
    schema = "group long, h binary, df binary"
    if weights.value.least > 0:
        return table.sparkSession.createDataFrame([], schema)

    def dealt(turn: int) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
            for batch in batches:
                group = batch.column(0).to_numpy()
                for a, b in _pieces(group):
                    h = _unpacked(batch.column(1).slice(a, b - a), np.uint64)[0]
                    h = np.sort(h[h >> np.uint64(64 - TURN) == turn])
                    ends = np.flatnonzero(np.append(h[1:] != h[:-1], True)) if len(h) else np.zeros(0, np.int64)
                    h, n = h[ends], np.diff(ends, prepend=-1)
                    rare = weights.value.frequent(h) == 0
                    h, n = h[rare], n[rare].astype(np.int32)
                    range_ = (h >> np.uint64(64 - RANGE)).astype(np.int32)
                    heads = np.array([a for a, _ in _pieces(range_)], np.int64)
                    ends = np.append(heads, len(h))
                    yield {"range": range_[heads], "group": np.full(len(heads), group[a]), "h": _packed(ends, h), "n": _packed(ends, n)}

        rows = mapped(table.select(_group(), "hs"), run, "range int, group long, h binary, n binary")
        return mapped(rows.repartition(partitions(rows.sparkSession), "range").sortWithinPartitions("range"), counted, schema)

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            for a, b in _pieces(batch.column(0).to_numpy()):
                if held and held[0].column(0)[0] != batch.column(0)[a]:
                    yield solve(held)
                    held = []
                held.append(batch.slice(a, b - a))
        if held:
            yield solve(held)

    def solve(held: list[pa.RecordBatch]) -> dict:
        rows = _whole(pa.Table.from_batches(held))
        h, ends = _unpacked(rows.column(2), np.uint64)
        order = np.argsort(h)
        in_order = h[order]
        heads = np.flatnonzero(np.append(True, in_order[1:] != in_order[:-1]))
        df = np.empty(len(h), np.int32)
        df[order] = np.repeat(np.add.reduceat(_unpacked(rows.column(3), np.int32)[0][order], heads), np.diff(np.append(heads, len(h))))
        shared = df > 1
        ends = np.append(0, np.cumsum(shared))[ends]
        return {"group": rows.column(1), "h": _packed(ends, h[shared]), "df": _packed(ends, df[shared])}

    return written_in_turn((dealt(turn).where("length(h) > 0") for turn in range(1 << TURN)), "frequencies")


def _with_frequencies(table: DataFrame, known: tuple, work: Callable[..., Iterator[dict]], schema: str, name: str) -> DataFrame:
    """``work`` turns no, h, n, df of a group of texts, and where each text's begin (and the last's end), into dicts of equally long lists or arrays. Written. ``known``: weights and ``others``."""
    (weights, rest), kinds = known, arrow_schema(table.sparkSession, schema)

    def run(texts: pa.Table, some: pa.Table) -> pa.Table:
        if not texts.num_rows:
            return kinds.empty_table()
        texts = _whole(texts)
        h, ends = _unpacked(texts.column(2), np.uint64)
        df = np.maximum(weights.value.frequent(h), 1).astype(np.int32)
        if some.num_rows:
            some = _whole(some)
            s, of_s = _unpacked(some.column(1), np.uint64)[0], _unpacked(some.column(2), np.int32)[0]
            order = np.argsort(s)
            s, of_s = s[order], of_s[order]
            at = np.minimum(np.searchsorted(s, h), len(s) - 1)
            hit = s[at] == h
            df[hit] = of_s[at[hit]]
        got = work(texts.column(1), h, _unpacked(texts.column(3), np.int32)[0], df, ends)
        return pa.Table.from_batches([pa.RecordBatch.from_arrays([v if isinstance(v := g[f.name], pa.Array) else pa.array(v, type=f.type) for f in kinds], schema=kinds) for g in got], schema=kinds)

    def part(turn: int) -> DataFrame:
        mine = lambda d: d.where(F.pmod(F.xxhash64("group"), F.lit(1 << TURN)) == turn).groupBy("group")
        return mine(table.select(_group(), "no", "hs", "ns")).cogroup(mine(rest.select("group", "h", "df"))).applyInArrow(run, schema)

    return written_in_turn((part(turn) for turn in range(1 << TURN)), name)


def sketched(table: DataFrame, known: tuple) -> DataFrame:
    """no, size (shingles), buckets of every text with words; written."""
    weights = known[0]

    def work(no: pa.Array, h: np.ndarray, n: np.ndarray, df: np.ndarray, ends: np.ndarray) -> Iterator[dict]:
        sizes = np.diff(ends)
        for a, b in _pieces(np.cumsum(sizes) // CHUNK):
            keep = a + np.flatnonzero(sizes[a:b])
            if not len(keep):
                continue
            of = slice(ends[a], ends[b])
            got = samples(h[of], n[of], df[of], ends[keep] - ends[a], weights.value)
            key = np.tile(np.arange(BANDS, dtype=np.uint64), (len(keep), 1))
            for k in range(ROWS):
                key = (key ^ got[:, k * BANDS : (k + 1) * BANDS]) * FACTOR
                key ^= key >> np.uint64(32)
            yield {"no": no.to_numpy()[keep], "size": sizes[keep], "buckets": list(key.view(np.int64))}

    return _with_frequencies(table, known, work, "no long, size long, buckets array<long>", "sketches")


def shelved(table: DataFrame, known: tuple) -> DataFrame:
    """no, h, n, df of the texts; written."""

    def work(no: pa.Array, h: np.ndarray, n: np.ndarray, df: np.ndarray, ends: np.ndarray) -> Iterator[dict]:
        yield {"no": no, "h": _lists(ends, h.view(np.int64)), "n": _lists(ends, n), "df": _lists(ends, df)}

    return _with_frequencies(table, known, work, "no long, h array<long>, n array<int>, df array<int>", "open-texts")


def components(edges: DataFrame) -> DataFrame:
    """node, label (least node of its component) by alternating large and small stars; edges: a, b. Each round is written."""
    mark = lambda d: d.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38)"))).first()
    edges = written(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct(), "edges")
    before = mark(edges)
    while True:
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).union(low.select("a", F.col("m").alias("b")))
        fresh = written(small.distinct(), "edges")
        now = mark(fresh)
        if now == before:
            return fresh.groupBy("a").agg(F.min("b").alias("label")).select(F.col("a").alias("node"), "label")
        dropped(edges)
        edges, before = fresh, now


def _shared(pairs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The written pairs with the share of the leader's pairs that they are in, and a, shares of all leaders of more than one."""
    counts = written(pairs.groupBy("a").agg(F.count(F.lit(1)).alias("n_pairs")).where(F.col("n_pairs") > SHARE), "leaders")
    many = counts.withColumn("shares", F.ceil(F.col("n_pairs") / SHARE))
    dealt = hot_join(pairs, many, ["a"], "n_pairs", pairs.count(), "left")
    share = F.coalesce(F.pmod(F.xxhash64("b"), F.col("shares")), F.lit(0).cast("long"))
    return dealt.select("a", "b", share.alias("share")), with_bounded_side(many.select("a", "shares"))


def _verified(pairs: DataFrame, table: DataFrame, weights, threshold: float) -> DataFrame:
    """Those pairs (a, b) that are similar. A task has the larger text's shingles once for each of its pairs, a batch at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for batch in batches:
            keep, last = [], {}
            a = batch.column(0).to_pylist()
            for i, x in enumerate(a):
                sides = []
                for side in (2, 5):
                    if side == 2 and last.get("id") == x:
                        sides.append(last["of"])
                        continue
                    h = batch.column(side)[i].values.to_numpy().view(np.uint64)
                    sides.append((h, weights.value.of(batch.column(side + 1)[i].values.to_numpy(), batch.column(side + 2)[i].values.to_numpy())))
                    if side == 2:
                        last = {"id": x, "of": sides[0]}
                if similarity(*sides) >= threshold:
                    keep.append(i)
            yield {"a": batch.column(0).take(pa.array(keep, pa.int32())), "b": batch.column(1).take(pa.array(keep, pa.int32()))}

    side = lambda x: table.select(F.col("no").alias(x), F.col("h").alias(f"h_{x}"), F.col("n").alias(f"n_{x}"), F.col("df").alias(f"df_{x}"))
    dealt, many = _shared(pairs)
    leaders = side("a").join(many, "a", "left").withColumn("share", F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce(F.col("shares"), F.lit(1).cast("long")) - 1)))
    return mapped(dealt.join(side("b"), "b").join(leaders, ["a", "share"]).select("a", "b", "h_a", "n_a", "df_a", "h_b", "n_b", "df_b"), run, "a long, b long")


def _led(members: DataFrame, shelf: DataFrame, weights, threshold: float) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Members of buckets that their leaders' links don't make one class, with the class that they are in by then (label), without the
    leaders; the links a, b; edges x, y with their components. ``members``: no, bucket, rank, blocks, label."""
    found = stars = None
    for _ in range(LEADS):
        # a bucket is open while it has members of different classes
        heads = members.groupBy("bucket").agg(F.min("label").alias("lo"), F.max("label").alias("hi"), F.min(F.struct("rank", "no", "label")).alias("x")).where("lo < hi")
        rows = members.join(heads.select("bucket", F.col("x.no").alias("a"), F.col("x.label").alias("own")), "bucket").where("no <> a")
        rows = written(rows, "open-buckets")
        dropped(members)
        opened = rows
        pairs = written(rows.where("label <> own").select("a", F.col("no").alias("b")).distinct(), "pairs")
        fresh = written(_verified(pairs, shelf, weights, threshold), "links")
        found = fresh if found is None else found.union(fresh)
        edges = fresh.select(F.col("a").alias("x"), F.col("b").alias("y"))
        name = written(components(edges.toDF("a", "b") if stars is None else edges.union(stars).toDF("a", "b")), "class-names")
        stars = name.select(F.col("node").alias("x"), F.col("label").alias("y"))
        name = name.select(F.col("node").alias("no"), F.col("label").alias("known"))
        rows = rows.join(name, "no", "left").select("no", "bucket", "rank", "blocks", F.coalesce("known", "no").alias("label"))
        members = written(rows, "members")
        dropped(pairs, opened)
    split = members.groupBy("bucket").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo < hi").select("bucket")
    return members.join(split, "bucket", "left_semi"), found, stars


def _searched(members: DataFrame, shelf: DataFrame, weights, threshold: float) -> DataFrame:
    """Links a, b of the searches in buckets, and x, y, the labels that each connects to its search's root. ``members``: no, bucket, blocks, label."""

    def solve(held: list[pa.RecordBatch]) -> list[np.ndarray] | None:
        table = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
        no, side, label = (table.column(i).to_numpy() for i in (3, 4, 5))
        if (label == label[0]).all() or len(no) < 2:
            return None
        h, ends = _flat(table.column(6))
        got = list(forest(h.view(np.uint64), weights.value.of(_flat(table.column(7))[0], _flat(table.column(8))[0]), ends, label, side, threshold))
        if not got:
            return None
        child, parent, root = np.array(got).T
        return [no[parent], no[child], label[root], label[child]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        held: list[pa.RecordBatch] = []
        last = None
        for batch in batches:
            if not batch.num_rows:
                continue
            key = np.stack([batch.column(i).to_numpy() for i in range(3)])
            cuts = (np.flatnonzero((key[:, 1:] != key[:, :-1]).any(axis=0)) + 1).tolist()
            found = []
            for lo, hi in zip([0, *cuts], [*cuts, batch.num_rows], strict=True):
                if held and (lo or (key[:, 0] != last).any()):
                    found.append(solve(held))
                    held = []
                held.append(batch.slice(lo, hi - lo))
            last = key[:, -1]
            yield from together(found)
        if held:
            yield from together([solve(held)])

    def together(found: list) -> Iterator[dict]:
        found = [f for f in found if f is not None]
        if found:
            yield dict(zip("abxy", (np.concatenate(c) for c in zip(*found, strict=True)), strict=True))

    side, other = F.pmod(F.xxhash64("no"), F.col("blocks")), F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))
    rows = members.select("no", "bucket", "label", side.alias("side"), other.alias("other"))
    rows = rows.select("bucket", F.least("side", "other").alias("i"), F.greatest("side", "other").alias("j"), "no", "side", "label")
    rows = rows.join(shelf, "no").select("bucket", "i", "j", "no", "side", "label", "h", "n", "df")
    rows = rows.repartition(partitions(rows.sparkSession), "bucket", "i", "j").sortWithinPartitions("bucket", "i", "j")
    return mapped(rows, run, "a long, b long, x long, y long")


def links(table: DataFrame, threshold: float = THRESHOLD, frequent: int = FREQUENT, exact: bool = False) -> tuple[DataFrame, DataFrame]:
    """a, b: links that connect every class of different texts, and edges with the same components; both written. ``table``: of ``shingled``; it is deleted."""
    weights = table.sparkSession.sparkContext.broadcast(frequencies(table, frequent, exact))
    known = weights, others(table, weights)
    sketch = sketched(table, known)
    buckets = sketch.select("no", "size", F.explode("buckets").alias("bucket"))
    # two hashes of 64 bits stand for a bucket's members
    sets = buckets.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("size") + LEAST).alias("total"), F.bit_xor(F.xxhash64("no")).alias("u"), F.bit_xor(F.xxhash64("no", F.lit(1))).alias("v")).where("n > 1")
    sets = sets.groupBy("n", "u", "v").agg(F.min(F.struct("bucket", "total")).alias("x")).select("x.bucket", "n", F.ceil(F.col("x.total") / BLOCK).alias("blocks"))
    full = written(buckets.join(sets, "bucket").select("no", "bucket", "n", "blocks"), "full-buckets")
    dropped(sketch)
    ids = written(full.select("no").distinct(), "open-ids")
    shelf = shelved(table.join(with_bounded_side(ids), "no", "left_semi"), known)
    dropped(table, ids, known[1])
    members = full.where("blocks = 1").select("no", "bucket", "blocks", F.col("no").alias("label"))
    found = stars = None
    if not full.where("blocks > 1").isEmpty():
        company = full.groupBy("no").agg((-F.sum("n")).alias("rank"))
        hot = full.where("blocks > 1").join(company, "no").select("no", "bucket", "rank", "blocks", F.col("no").alias("label"))
        rest, found, stars = _led(hot, shelf, weights, threshold)
        members = members.union(rest.select(members.columns))
    seen = written(_searched(members, shelf, weights, threshold), "links")
    dropped(full, shelf)
    pairs, edges = seen.select("a", "b"), seen.select(F.col("x").alias("a"), F.col("y").alias("b"))
    if found is not None:
        pairs, edges = pairs.union(found), edges.union(stars)
    return written(pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "links"), edges


def classes(docs: DataFrame, threshold: float = THRESHOLD, frequent: int = FREQUENT, exact: bool = False) -> DataFrame:
    """doc_id, class_id, class_key, n_links (of its text's), is_first, text_hash for every row."""
    with small_batches(docs.sparkSession, TEXTS, BYTES):
        table = shingled(docs)
        names = written(table.select("no", "key", "id"), "names")
        found, edges = links(table, threshold, frequent, exact)
    label = components(edges).withColumnRenamed("node", "no")
    degree = found.select(F.explode(F.array("a", "b")).alias("no")).groupBy("no").agg(F.count(F.lit(1)).alias("n_links"))
    named = names.join(label, "no", "left").join(degree, "no", "left")
    named = written(named.select("key", "id", F.coalesce("label", "no").alias("class_key"), F.coalesce("n_links", F.lit(0)).alias("n_links")), "classes")
    dropped(names)
    heads = named.groupBy("class_key").agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id", "key")).alias("x")).select("class_key", F.col("x.id").alias("class_id"), F.col("x.key").alias("first_key"))
    of_text = named.select("key", "class_key", "n_links").join(heads, "class_key")
    out = docs.select("doc_id", text_key().alias("key"), text_hash().alias("text_hash")).join(of_text, "key")
    is_first = (F.col("key") == F.col("first_key")) & F.col("doc_id").eqNullSafe(F.col("class_id"))
    return out.select("doc_id", "class_id", "class_key", "n_links", is_first.alias("is_first"), F.col("text_hash"))
