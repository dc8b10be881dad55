"""Removal of repeated byte strings of at least ``length`` bytes, exact over the whole corpus, by a suffix sort of sampled suffixes.

The minimum of ``K``-byte rolling hashes over every ``length``-byte window, at its leftmost place, is the window's anchor; equal
windows have equal anchors at equal offsets, so only suffixes at anchors need sorting, and an anchor whose hash occurs once
settles all of its windows. What is left goes with its context, the bytes of the windows that it serves, to the tasks that
sort. Equal contexts are grouped by their bytes: all but the first go whole. Different contexts of one anchor are sorted, in
both directions from the anchor, by a mergesort that compares two suffixes by binary search over prefix polynomial hashes.
Neighbours in these orders tell how far a context agrees with any other, and so which of its windows may repeat; those are
classed by hash, and every hit is compared with the first of its class byte by byte. An anchor of more than ``GROUP`` different
contexts is not sorted in one task: its windows are halved by their offsets to it. All windows of a half have a longer core
around the anchor in common if they are equal, so contexts are grouped by that core and compared by the half's bytes alone, equal
ones as one; a group that is still too large is halved again, until its core is a window. So a context is two rows a step, and
only as long as its group is large.

Defined results: a null text is empty; texts shorter than ``length`` stay whole; rows are documents of their own, ordered by
doc_id (nulls first), the text's key and, if both are equal, in any order, so of repeated rows one is the first and the others
lose what it has; other columns are ignored.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillgraph.llm.common import dropped, mapped, partitions, per_batch, text_key, with_bounded_side, written

LENGTH, K = 100, 32
#: Different contexts of one anchor, or of one longer core, that a task sorts; those of a more frequent one are grouped by longer cores.
GROUP = 1000
#: Bytes of contexts that are sorted at once, and windows of a text that are anchored at once.
CHUNK, PIECE = 1 << 19, 1 << 20
BASE = 0x9E3779B97F4A7C15 | 1
INVERSE = pow(BASE, -1, 1 << 64)
#: Low bits of a packed minimum that hold its place in a piece, and of a spot that hold each of two offsets below ``length``.
PLACE, OFFSET = 21, 7
WHOLE = (1 << 31) - 1


@functools.lru_cache(2)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    out = []
    for b in (BASE, INVERSE):
        p = np.full(n, b, np.uint64)
        p[0] = 1
        out.append(np.multiply.accumulate(p))
    return out[0], out[1]


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    return x ^ (x >> np.uint64(33))


class Hashes:
    """Hash of data[i:j] for arrays of i and j, from prefix sums of a polynomial."""

    def __init__(self, data: np.ndarray):
        n = len(data)
        up, self.down = _powers(1 << max(21, n.bit_length()))
        self.data, self.sums = data, np.zeros(n + 1, np.uint64)
        np.cumsum((data + np.uint64(1)) * up[:n], out=self.sums[1:])

    def of(self, i, j) -> np.ndarray:
        return (self.sums[j] - self.sums[i]) * self.down[i]

    def extension(self, i: np.ndarray, j: np.ndarray, most: np.ndarray) -> np.ndarray:
        """How many bytes from i and j on are equal, up to ``most``: by binary search."""
        lo, hi = np.zeros_like(most), most.copy()
        while (lo < hi).any():
            mid = (lo + hi + 1) >> 1
            same = self.of(i, i + mid) == self.of(j, j + mid)
            lo, hi = np.where(same, mid, lo), np.where(same, hi, mid - 1)
        return lo


def anchors(raw: bytes, length: int = LENGTH, k: int = K) -> Iterator[tuple[np.ndarray, ...]]:
    """(hash, place, lo, hi) of the anchors and of the first and last window that each serves, in pieces of a text."""
    w = length - k + 1
    for base in range(0, len(raw) - length + 1, PIECE):
        part = np.frombuffer(raw, np.uint8)[base : base + PIECE + length - 1]
        h = Hashes(part)
        n, m = len(part) - length + 1, len(part) - k + 1
        grams = _mix((h.sums[k:] - h.sums[:m]) * h.down[:m])
        packed = np.full(-(-m // w) * w, ~np.uint64(0))
        packed[:m] = (grams >> np.uint64(PLACE) << np.uint64(PLACE)) | np.arange(m, dtype=np.uint64)  # equal hashes rank by place
        full = packed.reshape(-1, w)
        left = np.minimum.accumulate(full[:, ::-1], axis=1)[:, ::-1].ravel()
        right = np.minimum.accumulate(full, axis=1).ravel()
        least = np.minimum(left[:n], right[w - 1 : w - 1 + n])
        cut = np.flatnonzero(least[1:] != least[:-1]) + 1
        lo, hi = np.concatenate([[0], cut]), np.concatenate([cut - 1, [n - 1]])
        at = (least[lo] & np.uint64((1 << PLACE) - 1)).astype(np.int64)
        yield grams[at].view(np.int64), at + base, lo + base, hi + base


def suffix_order(h: Hashes, start: np.ndarray, most: np.ndarray, first: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The suffixes at ``start``, of ``most`` bytes, sorted in each group, and how far each agrees with any other of its group.

    A group's suffixes lie together: ``first`` is the place of its first one and ``size`` their number, for each suffix. Runs of
    doubling width are merged; a suffix' place in a merged run is found by binary search in the other run."""
    order, n = np.arange(len(start)), len(start)
    width = 1
    while width < size.max(initial=0):
        at = np.flatnonzero(size > width)
        e, head = order[at], first[at]
        run, within = np.divmod(at - head, width)
        sibling = head + (run ^ 1) * width
        lo, hi = np.zeros_like(at), np.clip(head + size[at] - sibling, 0, width)
        later = run & 1  # of equal ones the left run's comes first
        while (lo < hi).any():
            mid = np.minimum((lo + hi) >> 1, n - 1)
            f = order[np.clip(sibling + mid, 0, n - 1)]
            both = np.minimum(most[f], most[e])
            same = h.extension(start[f], start[e], both)
            inside = same < both
            a, b = h.data[np.where(inside, start[f] + same, 0)].astype(np.int64), h.data[np.where(inside, start[e] + same, 0)].astype(np.int64)
            before = np.where(inside, a - b, most[f] - most[e]) < later
            open_ = lo < hi
            lo, hi = np.where(open_ & before, mid + 1, lo), np.where(open_ & ~before, mid, hi)
        fresh = order.copy()
        fresh[head + (run & ~1) * width + within + lo] = e
        order, width = fresh, width * 2
    agree = np.zeros(n, np.int64)
    if n > 1:
        a, b = order[:-1], order[1:]
        shared = np.where(first[:-1] == first[1:], h.extension(start[a], start[b], np.where(first[:-1] == first[1:], np.minimum(most[a], most[b]), 0)), 0)
        np.maximum.at(agree, a, shared)
        np.maximum.at(agree, b, shared)
    return order, agree


def repeats(group: np.ndarray, rel: np.ndarray, contexts: list[bytes], no: np.ndarray, place: np.ndarray, length: int = LENGTH) -> tuple[np.ndarray, np.ndarray]:
    """(text, window start) of every window in the contexts that is not the first of its bytes. ``group``: ascending, one value for
    an anchor's contexts; ``rel``: the anchor's place in its context; ``no``, ``place``: its text and place there."""
    data = np.frombuffer(b"".join(contexts), np.uint8)
    sizes = np.array([len(c) for c in contexts])
    at = np.cumsum(sizes) - sizes + rel
    heads = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
    numbers = np.diff(np.append(heads, len(group)))
    first, size = np.repeat(heads, numbers), np.repeat(numbers, numbers)
    h = Hashes(data)
    ahead = suffix_order(h, at, np.minimum(sizes - rel, length), first, size)[1]
    back = suffix_order(Hashes(data[::-1].copy()), len(data) - at, rel.astype(np.int64), first, size)[1]
    low = np.maximum(length - ahead, 0)  # the window that begins d bytes before the anchor may repeat if low <= d <= back
    many = np.maximum(np.minimum(back, rel) - low + 1, 0)
    which = np.repeat(np.arange(len(rel)), many)
    d = np.arange(len(which)) - np.repeat(np.cumsum(many) - many, many) + low[which]
    s, text, p, own = at[which] - d, no[which], place[which] - d, first[which]
    value = h.of(s, s + length)
    rest, found = np.lexsort((p, text, value, own)), []
    span = np.arange(length)
    while len(rest):
        new = np.concatenate([[True], (value[rest][1:] != value[rest][:-1]) | (own[rest][1:] != own[rest][:-1])])
        heads_ = rest[np.flatnonzero(new)][np.cumsum(new) - 1]
        equal = np.concatenate([(data[s[rest[i : i + 65536], None] + span] == data[s[heads_[i : i + 65536], None] + span]).all(axis=1) for i in range(0, len(rest), 65536)])
        found.append(rest[equal & (rest != heads_)])
        rest = rest[~equal]  # equal hashes of different bytes: they are classed anew
    all_ = np.concatenate(found) if found else np.zeros(0, np.int64)
    return text[all_], p[all_]


def _runs(no: np.ndarray, p: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """no, lo, hi of the bytes of these windows, those that follow one another as one."""
    order = np.lexsort((p, no))
    no, p = no[order], p[order]
    new = np.flatnonzero(np.concatenate([[True], (no[1:] != no[:-1]) | (p[1:] > p[:-1] + 1)])) if len(no) else np.zeros(0, np.int64)
    last = np.append(new[1:] - 1, len(no) - 1) if len(no) else new
    return no[new], p[new].astype(np.int32), (p[last] + length).astype(np.int32)


def numbered(docs: DataFrame) -> DataFrame:
    """The rows with ``no``, which ascends with doc_id and key; written once. A null text is empty."""
    text = F.coalesce("text", F.lit(""))
    rows = docs.select(*[text.alias("text") if c == "text" else c for c in docs.columns], text_key(text).alias("key_"))
    rows = rows.repartitionByRange(partitions(docs.sparkSession), "doc_id", "key_").sortWithinPartitions("doc_id", "key_")
    return written(rows.withColumn("no_", F.monotonically_increasing_id()), "numbered-texts")


def _met_twice(texts: DataFrame, length: int) -> DataFrame:
    """h of the anchors that occur twice or more; combined in each batch and task before the shuffle."""

    def work(all_: list) -> dict:
        got = [x[0] for t in all_ for x in anchors(t.encode(), length)]
        h, n = np.unique(np.concatenate(got), return_counts=True) if got else (np.zeros(0, np.int64),) * 2
        return {"h": h, "n": n}

    return per_batch(texts, ["text"], work, "h long, n long").groupBy("h").agg(F.sum("n").alias("n")).where("n > 1").select("h")


def _spots(texts: DataFrame, known: DataFrame, length: int) -> DataFrame:
    """no_, spots: place << 14 | (place - lo) << 7 | (hi - lo) of a text's anchors that are ``known``."""

    def work(no: list, all_: list) -> dict:
        out: dict = {"h": [], "no_": [], "spot": []}
        for i, t in zip(no, all_, strict=True):
            for h, at, lo, hi in anchors(t.encode(), length):
                out["h"].append(h)
                out["no_"].append(np.full(len(h), i))
                out["spot"].append(at << 2 * OFFSET | (at - lo) << OFFSET | (hi - lo))
        return {k: np.concatenate(v) if v else [] for k, v in out.items()}

    rows = per_batch(texts, ["no_", "text"], work, "h long, no_ long, spot long")
    return rows.join(known.hint("shuffle_hash"), "h", "left_semi").groupBy("no_").agg(F.collect_list("spot").alias("spots"))


def _contexts(texts: DataFrame, spots: DataFrame, length: int) -> DataFrame:
    """h, rel, context, no_, spot of every spot."""
    mask = (1 << OFFSET) - 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for batch in batches:
            for i in range(batch.num_rows):
                raw = batch.column(1)[i].as_py().encode()
                spot = batch.column(2)[i].values.to_numpy()
                at, rel = spot >> 2 * OFFSET, spot >> OFFSET & mask
                lo, end = at - rel, at - rel + (spot & mask) + length
                grams = np.concatenate([Hashes(np.frombuffer(raw, np.uint8)[b : b + PIECE + K - 1]).of(x := at[(at >= b) & (at < b + PIECE)] - b, x + K) for b in range(0, len(raw), PIECE)])
                yield {"h": _mix(grams).view(np.int64), "rel": rel.astype(np.int32), "context": [raw[x:y] for x, y in zip(lo.tolist(), end.tolist(), strict=True)], "no_": np.full(len(spot), batch.column(0)[i].as_py()), "spot": spot}

    rows = texts.select("no_", "text").join(spots, "no_").select("no_", "text", F.array_sort("spots").alias("spots"))
    return mapped(rows, _joined(run), "h long, rel int, context binary, no_ long, spot long")


def _joined(run, rows: int = 20_000):
    """Pieces of a few rows together as one."""

    def all_(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        parts: list[dict] = []
        for piece in run(batches):
            parts.append(piece)
            if sum(len(p["no_"]) for p in parts[-1:]) and sum(len(p["no_"]) for p in parts) >= rows:
                yield _together(parts)
                parts = []
        if parts:
            yield _together(parts)

    return all_


def _together(parts: list[dict]) -> dict:
    return {k: [x for p in parts for x in p[k]] if isinstance(parts[0][k], list) else np.concatenate([p[k] for p in parts]) for k in parts[0]}


def _sorted_repeats(kinds: DataFrame, length: int) -> DataFrame:
    """no_, lo, hi of repeated windows in contexts that lie with all others of their anchor in one task, sorted by anchor."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            held.append(batch)
            if sum(b.column(2).nbytes for b in held) >= CHUNK:
                table = pa.Table.from_batches(held).combine_chunks()
                h = table.column(0).to_numpy()
                whole = int(np.searchsorted(h, h[-1]))  # the last anchor may go on
                yield solve(table.slice(0, whole))
                held = table.slice(whole).combine_chunks().to_batches()
        if held:
            yield solve(pa.Table.from_batches(held))

    def solve(table: pa.Table) -> dict:
        h = table.column(0).to_numpy()
        alone = np.ones(len(h), bool)
        if len(h):
            same = h[1:] == h[:-1]
            alone[1:] &= ~same
            alone[:-1] &= ~same
        keep = np.flatnonzero(~alone)
        if not len(keep):
            return {"no_": [], "lo": [], "hi": []}
        table = table.take(keep)
        columns = [table.column(i).to_numpy() for i in (0, 1, 3, 4)]
        found = repeats(columns[0], columns[1], table.column(2).to_pylist(), columns[2], columns[3] >> 2 * OFFSET, length)
        no, lo, hi = _runs(*found, length)
        return {"no_": no, "lo": lo, "hi": hi}

    rows = kinds.repartition(partitions(kinds.sparkSession), "h").sortWithinPartitions("h", "no_", "spot")
    return mapped(rows.select("h", "rel", "context", "no_", "spot"), run, "no_ long, lo int, hi int")


def _halved(kinds: DataFrame, length: int) -> DataFrame:
    """Every context's part for either half of the offsets ``near`` .. ``far`` of windows to their anchor; h: of the anchor's h and the core that all windows of the half contain."""
    mask = (1 << OFFSET) - 1
    middle = F.shiftright(F.col("near") + F.col("far"), 1)
    rows = kinds.withColumn("half", F.explode(F.array(F.struct(F.col("near").alias("x"), middle.alias("y")), F.struct((middle + 1).alias("x"), F.col("far").alias("y")))))
    a, b = F.greatest(F.col("rel") - F.col("spot").bitwiseAND(mask).cast("int"), F.col("half.x")), F.least("rel", F.col("half.y"))
    rows = rows.withColumn("a", a).withColumn("b", b).where("a <= b")
    core = F.substring("context", F.col("rel") - F.col("half.x") + 1, F.lit(length) - F.col("half.y") + F.col("half.x"))
    part = F.substring("context", F.col("rel") - F.col("b") + 1, F.col("b") - F.col("a") + length)
    spot = F.shiftleft(F.shiftright("spot", 2 * OFFSET), 2 * OFFSET) + F.shiftleft(F.col("b").cast("long"), OFFSET) + (F.col("b") - F.col("a"))
    return rows.select(F.xxhash64("h", "half.x", core).alias("h"), F.col("half.x").alias("near"), F.col("half.y").alias("far"), F.col("b").alias("rel"), part.alias("context"), "no_", spot.alias("spot"))


def _often(kinds: DataFrame) -> DataFrame:
    return with_bounded_side(written(kinds.groupBy("h").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > GROUP).select("h"), "frequent-anchors"))


def _lo(spot: Column) -> Column:
    return F.shiftright(spot, 2 * OFFSET) - F.shiftright(spot, OFFSET).bitwiseAND((1 << OFFSET) - 1)


def _end(spot: Column, length: int) -> Column:
    return _lo(spot) + spot.bitwiseAND((1 << OFFSET) - 1) + length


def _frequent_repeats(kinds: DataFrame, length: int) -> DataFrame:
    """The same for contexts of very frequent anchors, by longer cores."""
    rows, found = kinds.withColumn("near", F.lit(0)).withColumn("far", F.lit(length - K)), None
    while True:
        halves = _halved(rows, length)
        fresh = halves.groupBy("h", "near", "far", "rel", "context").agg(F.min(F.struct("no_", "spot")).alias("x")).select("h", "near", "far", "rel", "context", "x.*")
        fresh = written(fresh, "finer-contexts")
        later = halves.select("no_", "spot").join(fresh.select("no_", "spot"), ["no_", "spot"], "left_anti")
        later = later.select("no_", _lo(F.col("spot")).cast("int").alias("lo"), _end(F.col("spot"), length).cast("int").alias("hi"))
        frequent = _often(fresh.where("near < far"))  # else the core is the window
        some = written(later.union(_sorted_repeats(fresh.join(frequent, "h", "left_anti"), length)), "repeats")
        found = some if found is None else found.union(some)
        dropped(rows)
        if frequent.isEmpty():
            dropped(fresh)
            return found
        rows = written(fresh.join(frequent, "h", "left_semi"), "finer-contexts")
        dropped(fresh)


def spans_of(texts: DataFrame, length: int = LENGTH) -> DataFrame:
    """no_, spans (lo, hi; they may overlap) of the texts that lose bytes; of a later copy of a whole text 0 .. ``WHOLE``. Written."""
    if not K <= length < K + (1 << OFFSET):
        raise ValueError(f"length must be from {K} to {K + (1 << OFFSET) - 1}")
    firsts = texts.groupBy("key_").agg(F.min("no_").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1")
    copies = written(texts.select("no_", "key_", F.octet_length("text").alias("size")).join(firsts, "key_").where((F.col("no_") > F.col("first")) & (F.col("size") >= length)).select("no_"), "copies")
    known = written(_met_twice(texts, length), "anchors-met-twice")
    dropped()
    spots = written(_spots(texts, known, length).join(copies, "no_", "left_anti"), "spots")
    dropped(known)
    kinds = _contexts(texts, spots, length).groupBy("h", "rel", "context").agg(F.min(F.struct("no_", "spot")).alias("x")).select("h", "rel", "context", "x.*")
    kinds = written(kinds, "contexts")
    dropped()
    frequent = _often(kinds)
    single = _sorted_repeats(kinds.join(frequent, "h", "left_anti"), length)
    if not frequent.isEmpty():
        single = single.union(_frequent_repeats(kinds.join(frequent, "h", "left_semi"), length))
    single = single.groupBy("no_").agg(F.collect_list(F.struct("lo", "hi")).alias("parts"))
    firsts = kinds.groupBy("no_").agg(F.collect_list("spot").alias("own"))
    span = lambda s: F.struct(_lo(s).cast("int").alias("lo"), _end(s, length).cast("int").alias("hi"))
    none = F.array().cast("array<struct<lo:int,hi:int>>")
    later = F.array_except("spots", F.coalesce("own", F.array().cast("array<bigint>")))
    cuts = spots.join(firsts, "no_", "left").join(single, "no_", "left").select("no_", F.concat(F.transform(later, span), F.coalesce("parts", none)).alias("spans"))
    whole = copies.select("no_", F.array(F.struct(F.lit(0).alias("lo"), F.lit(WHOLE).alias("hi"))).alias("spans"))
    cuts = written(cuts.where(F.size("spans") > 0).union(whole), "cuts")
    dropped(spots, kinds, copies)
    return cuts


def cut(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """Every row, its text not null, with spans (null if nothing goes)."""
    texts = numbered(docs)
    return texts.join(spans_of(texts, length), "no_", "left")


def kept_bytes(raw: bytes, spans: list | None) -> tuple[bytes, int, int]:
    """What remains, bytes removed, maximal runs removed."""
    if not spans:
        return raw, 0, 0
    parts, at, removed, runs, end = [], 0, 0, 0, -1
    for lo, hi in sorted((s["lo"], min(s["hi"], len(raw))) for s in spans):
        if lo > end:
            parts.append(raw[at:lo])
            runs += 1
            end = lo
        if hi > end:
            removed += hi - end
            at = end = hi
    return b"".join([*parts, raw[at:]]), removed, runs


def digest(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256."""

    def work(keys: list, texts: list, spans: list) -> dict:
        raws = [t.encode() for t in texts]
        got = [kept_bytes(r, s) for r, s in zip(raws, spans, strict=True)]
        return {"doc_id": keys, "n_bytes": [len(r) for r in raws], "n_removed": [g[1] for g in got], "n_spans": [g[2] for g in got], "kept_sha256": [hashlib.sha256(g[0]).hexdigest() for g in got]}

    return per_batch(cut(docs.select("doc_id", "text"), length), ["doc_id", "text", "spans"], work, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def kept_texts(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """The rows, each with what remains of its text; bytes of a character that was cut apart are dropped."""
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    places = {c: i for i, c in enumerate(docs.columns)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for batch in batches:
            texts = [kept_bytes(t.encode(), s)[0].decode("utf-8", "ignore") for t, s in zip(batch.column(places["text"]).to_pylist(), batch.column(len(places)).to_pylist(), strict=True)]
            yield {c: texts if c == "text" else batch.column(i) for c, i in places.items()}

    return mapped(cut(docs, length).select(*docs.columns, "spans"), run, kinds)
