"""Conversation prefix trie: conversations rebuilt from shared openings, a node for each different opening, and sums over subtrees by
centroid decomposition of the parent-edge forest.

A node is named by (its smallest member, its depth), so every conversation owns one stretch of a path, and only numbers are shuffled:
texts become digests and lengths in the first pass. Openings are told apart by 128 bits: running sums of four 32-bit parts of
MD5(place, turn).

The rollup splits components at centroids. Of a component of n nodes those with n/2 or more below them are the path from its top to
its centroid, the last of them; what lies below the centroid falls into components of its own, of at most n/2 nodes, and so does the
rest. The centroid's sum is the total of what it cuts off, which is added to all nodes on the path above it. All components are split
at once, level by level, until one has at most ``limit`` nodes and a task finishes it alone, by the same rule; so a chain takes
log2(n / limit) levels. Sizes follow the splits: only a path's sizes change, by what was cut off.

Defined results: null role and text are ''; turns are ordered by turn (null first), then role, then text; rows without a conv_id belong
to no conversation and make no node; a conversation whose rebuilt form has no turn is a member of the root alone; repeated rows are
turns like others; other columns don't matter; an empty table gives no rows. No conversation, node or group is gathered: places and
running sums are made in ranges of a conversation, hot keys (over a ``HOT``-th of the rows) reach the rows by broadcast, and the ids
that end at a node pass through its hash as sorted pieces, never all in memory.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillgraph.functions.tables import discarded, materialised, with_running
from quillgraph.llm.common import HOT, hot_join, mapped, partitions

#: A turn of the opening goes to other conversations up to this place.
LONGEST_OPENING = 8
LIMIT = 5000
#: Bytes of one piece of a node's list of ids.
PIECE = 1 << 16
LANES = ("a", "b", "c", "d")


def turns(conversations: DataFrame) -> DataFrame:
    """conv, place, turn (a digest of role and text), bytes (of the text)."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    rows = conversations.where("conv_id is not null").select(
        F.col("conv_id").cast("long").alias("conv"),
        "turn",
        # the order of equal turns: role, text
        role.alias("role"),
        text.alias("text"),
    )
    twice = rows.groupBy("conv", "turn").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("conv", "turn")
    digest = F.md5(F.concat(F.octet_length("role").cast("string"), F.lit(":"), "role", "text").cast("binary"))
    plain = materialised(rows.select("conv", "turn", digest.alias("digest"), F.octet_length("text").cast("long").alias("bytes"), F.monotonically_increasing_id().alias("row")), "turns")
    tied = rows.join(twice, (rows["conv"] == twice["conv"]) & rows["turn"].eqNullSafe(twice["turn"]), "left_semi") if not twice.isEmpty() else None
    if tied is None:
        ranked = plain.withColumn("tie", F.lit(0).cast("long"))
    else:  # text is needed only where turns are equal: different (role, text) of tied turns, ranked
        kinds = tied.select("role", "text").distinct().select(digest.alias("digest"), "role", "text")
        order = with_running(materialised(kinds, "tied"), [], ["role", "text"]).select("digest", F.col("place").alias("tie"))
        ranked = plain.join(order, "digest", "left").withColumn("tie", F.coalesce("tie", F.lit(0).cast("long")))
    got = with_running(materialised(ranked, "ordered"), ["conv"], ["turn", "tie", "row"])
    return materialised(got.select("conv", "place", F.col("digest").alias("turn"), "bytes"), "places")


def rebuilt(found: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows, convs) of ``turns``: conv, depth, turn, bytes of the rebuilt conversations; conv, n (its original turns)."""
    convs = materialised(found.groupBy("conv").agg(F.count(F.lit(1)).alias("n")), "convs")
    h = F.crc32(F.col("conv").cast("string").cast("binary")) % 9
    base = F.col("conv") - F.col("conv") % 5
    shift = convs.select(F.col("conv"), h.alias("h"), base.alias("base"), "n").join(convs.select(F.col("conv").alias("base"), F.col("n").alias("n_base")), "base", "left")
    shift = materialised(shift.select("conv", "base", "h", F.least("h", F.coalesce("n_base", F.lit(0))).alias("opening"), "n"), "openings")
    opening = found.where(F.col("place") <= LONGEST_OPENING).withColumnRenamed("conv", "base").join(shift.select("conv", "base", "h"), "base").where("place <= h")
    own = hot_join(found.where(F.col("place") > h), shift.select("conv", "h", "opening", "n"), ["conv"], "n", found.count())
    rows = opening.select("conv", F.col("place").alias("depth"), "turn", "bytes").unionByName(own.select("conv", (F.col("place") - F.col("h") + F.col("opening")).cast("long").alias("depth"), "turn", "bytes"))
    lane = lambda i: F.conv(F.substring("salted", 1 + 8 * i, 8), 16, 10).cast("long").alias(LANES[i])
    rows = rows.withColumn("salted", F.md5(F.concat_ws("|", F.col("depth").cast("string"), "turn").cast("binary"))).select("conv", "depth", "bytes", *[lane(i) for i in range(4)])
    return materialised(rows, "rebuilt"), convs


def tree_of(rows: DataFrame, convs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(paths, tree): the owner of every conversation's node at every depth; and the nodes: conv, depth, parent, n_convs, n_children,
    leaves and saved (its own), size (nodes in its subtree)."""
    n_rows = rows.count() + convs.count()
    first = convs.agg(F.min("conv")).first()[0]
    key = lambda depth, sums: F.unhex(F.md5(F.concat_ws("|", depth, *sums).cast("binary")))
    keyed = with_running(rows, ["conv"], ["depth"], LANES)
    keyed = materialised(keyed.select("conv", "depth", "bytes", key(F.col("depth"), [F.col(f"total_{x}") for x in LANES]).alias("key")), "keyed")
    nodes = materialised(keyed.groupBy("key").agg(F.min("conv").alias("owner"), F.max("depth").alias("depth"), F.max("bytes").alias("bytes"), F.count(F.lit(1)).alias("n_convs")), "nodes")
    root = convs.select("conv", F.lit(0).cast("long").alias("depth"), F.lit(first).cast("long").alias("owner"))
    paths = materialised(hot_join(keyed.select("conv", "depth", "key"), nodes.select("key", "owner", "n_convs"), ["key"], "n_convs", n_rows).select("conv", "depth", "owner").unionByName(root), "paths")
    spans = materialised(paths.groupBy("conv").agg(F.max("depth").alias("last"), F.min(F.when(F.col("owner") == F.col("conv"), F.col("depth"))).alias("own"), F.count(F.lit(1)).alias("n")), "spans")
    heads = spans.where("own > 0").select("conv", (F.col("own") - 1).alias("depth")).join(paths, ["conv", "depth"]).select("conv", (F.col("depth") + 1).alias("depth"), F.col("owner").alias("parent"))
    below = F.when(F.col("own").isNotNull(), F.col("last") - F.greatest("own", "depth") + 1).otherwise(0)
    sizes = hot_join(paths, spans, ["conv"], "n", n_rows).groupBy(F.col("owner").alias("conv"), "depth").agg(F.sum(below).cast("long").alias("size"))
    base = nodes.select(F.col("owner").alias("conv"), "depth", "bytes", "n_convs")
    base = base.unionByName(convs.agg(F.min("conv").alias("conv"), F.count(F.lit(1)).alias("n_convs")).select("conv", F.lit(0).cast("long").alias("depth"), F.lit(0).cast("long").alias("bytes"), "n_convs"))
    linked = base.join(heads, ["conv", "depth"], "left").withColumn("parent", F.when(F.col("depth") > 0, F.coalesce("parent", "conv")))
    linked = materialised(linked.join(sizes, ["conv", "depth"]), "linked")
    kids = linked.where("parent is not null").groupBy(F.col("parent").alias("conv"), (F.col("depth") - 1).alias("depth")).agg(F.count(F.lit(1)).alias("n_children"))
    tree = linked.join(kids, ["conv", "depth"], "left").withColumn("n_children", F.coalesce("n_children", F.lit(0).cast("long")))
    tree = tree.select("conv", "depth", "parent", "n_convs", "n_children", (F.col("n_children") == 0).cast("long").alias("leaves"), ((F.col("n_convs") - 1) * F.col("bytes")).alias("saved"), "size")
    tree = materialised(tree, "tree")
    discarded(keyed, nodes, spans, linked)
    return paths, tree


def component_sums(parents: list[int], values: list[tuple[int, int]]) -> list[list[int]]:
    """The sums over subtrees of one component whose nodes come parents first (-1: the parent is not in it), by its centroids."""
    n = len(parents)
    out, size, where = [[0, 0] for _ in range(n)], [0] * n, [0] * n
    todo, fresh = [list(range(n))], 0
    while todo:
        nodes = todo.pop()
        mine = where[nodes[0]]
        for i in nodes:
            size[i] = 1
        for i in reversed(nodes):
            p = parents[i]
            if p >= 0 and where[p] == mine:
                size[p] += size[i]
        centroid = min((i for i in nodes if 2 * size[i] >= len(nodes)), key=lambda i: size[i])
        split: dict[int, list[int]] = {}
        total = list(values[centroid])
        above = []
        for i in nodes:  # a parent's new component is known before its children's
            p = parents[i]
            if i == centroid:
                fresh += 1
                where[i] = -fresh
            elif p >= 0 and where[p] == where[centroid] != mine:
                fresh += 1
                where[i] = fresh
                split[fresh] = [i]
            elif p >= 0 and where[p] in split:
                where[i] = where[p]
                split[where[p]].append(i)
            else:
                above.append(i)
        for part in split.values():
            for i in part:
                total[0] += values[i][0]
                total[1] += values[i][1]
        at = centroid
        while at >= 0 and (at == centroid or where[at] == mine):
            out[at][0] += total[0]
            out[at][1] += total[1]
            at = parents[at]
        todo.extend(split.values())
        if above:
            todo.append(above)
    return out


def small_sums(nodes: DataFrame) -> DataFrame:
    """conv, depth, leaves, saved summed over subtrees inside the components (top, top_depth), each finished in one task."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        held: list[tuple] = []

        def done(rows: list[tuple]) -> dict:
            at = {(r[2], r[3]): i for i, r in enumerate(rows)}
            sums = component_sums([at.get((r[4], r[3] - 1), -1) for r in rows], [(r[5], r[6]) for r in rows])
            return {"conv": [r[2] for r in rows], "depth": [r[3] for r in rows], "leaves": [s[0] for s in sums], "saved": [s[1] for s in sums]}

        ready: dict[str, list] = {"conv": [], "depth": [], "leaves": [], "saved": []}
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if held and held[0][:2] != row[:2]:
                    for k, v in done(held).items():
                        ready[k] += v
                    held = []
                held.append(row)
            if len(ready["conv"]) > LIMIT:
                yield ready
                ready = {k: [] for k in ready}
        if held:
            for k, v in done(held).items():
                ready[k] += v
        yield ready

    dealt = nodes.repartition(partitions(nodes.sparkSession), "top", "top_depth").sortWithinPartitions("top", "top_depth", "depth")
    return mapped(dealt.select("top", "top_depth", "conv", "depth", "parent", "leaves", "saved"), work, "conv long, depth long, leaves long, saved long")


def subtree_sums(tree: DataFrame, paths: DataFrame, limit: int = LIMIT) -> DataFrame:
    """conv, depth, leaves, saved: each node's sums over its subtree."""
    top = ["top", "top_depth"]
    root = tree.where("depth = 0").select(F.col("conv").alias("top"), F.lit(1).alias("one"))
    open_ = materialised(tree.select("conv", "depth", "parent", "leaves", "saved", "size").crossJoin(F.broadcast(root)).select("*", F.lit(0).cast("long").alias("top_depth")).drop("one"), "component")  # one row
    parts, small, written = [], [], []
    while True:
        sizes = materialised(open_.groupBy(*top).agg(F.count(F.lit(1)).alias("total")), "sizes")
        n = sizes.agg(F.coalesce(F.sum("total"), F.lit(0))).first()[0]
        sized = hot_join(open_, sizes, top, "total", n)
        small.append(materialised(sized.where(F.col("total") <= limit), "small"))
        large = sizes.where(F.col("total") > limit)
        if large.isEmpty():
            discarded(open_, sizes)
            break
        sized = hot_join(open_, large, top, "total", n).withColumn("on_path", 2 * F.col("size") >= F.col("total"))
        centroid = sized.where("on_path").groupBy(*top, "total").agg(F.min(F.struct("size", "conv", "depth")).alias("g"))
        centroid = materialised(centroid.select(*top, "total", F.col("g.size").alias("cut"), F.col("g.conv").alias("at"), F.col("g.depth").alias("at_depth")), "centroids")
        marked = materialised(hot_join(sized.drop("total"), centroid, top, "total", n), "marked")
        # a conversation's stretch of a component lies below a centroid of another conversation as a whole, or not at all
        stretch = marked.where("not on_path and depth > at_depth and conv <> at").groupBy("conv", *top, "at", "at_depth").agg(F.count(F.lit(1)).alias("n"))
        step = lambda name, by: paths.select("conv", (F.col("depth") - by).alias("at_depth"), F.col("owner").alias(name))
        below = stretch.join(step("met", 0), ["conv", "at_depth"]).where("met = at").join(step("under", 1), ["conv", "at_depth"])
        below = materialised(below.select("conv", *top, "under", "n"), "below")
        moved = hot_join(marked, below, ["conv", *top], "n", n, "left")
        own = (F.col("conv") == F.col("at")) & (F.col("depth") > F.col("at_depth"))
        under = F.coalesce(F.when(own, F.col("at")), F.col("under"))
        moved = moved.withColumn("under", under).withColumn("is_centroid", (F.col("conv") == F.col("at")) & (F.col("depth") == F.col("at_depth")))
        moved = materialised(moved.select("conv", "depth", "parent", "leaves", "saved", "size", *top, "total", "on_path", "under", "at_depth", "is_centroid", "cut"), "moved")
        cut_off = moved.where("under is not null or is_centroid").groupBy(*top, "total").agg(F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved"))
        cut_off = materialised(cut_off, "cut-off")
        parts.append(materialised(hot_join(moved.where("on_path").select("conv", "depth", *top), cut_off, top, "total", n).select("conv", "depth", "leaves", "saved"), "path"))
        lower = F.col("under").isNotNull()
        fresh = moved.where("not is_centroid").select("conv", "depth", "parent", "leaves", "saved", F.when(F.col("on_path"), F.col("size") - F.col("cut")).otherwise(F.col("size")).alias("size"), F.when(lower, F.col("under")).otherwise(F.col("top")).alias("top"), F.when(lower, F.col("at_depth") + 1).otherwise(F.col("top_depth")).alias("top_depth"))
        fresh = materialised(fresh, "component")
        discarded(open_, sizes, centroid, marked, below, moved, cut_off)
        open_ = fresh
    parts.append(small_sums(reduce(DataFrame.unionByName, small)))
    out = materialised(reduce(DataFrame.unionByName, parts).groupBy("conv", "depth").agg(F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved")), "sums")
    discarded(*small, *parts[:-1])
    return out


def ends(paths: DataFrame, convs: DataFrame) -> DataFrame:
    """conv, depth, sha256: of the ids of the conversations that end at the node, ascending, comma-joined. Pieces of a list are made in
    ranges of it; a hash takes them one after another."""
    last = paths.groupBy("conv").agg(F.max("depth").alias("depth")).join(paths, ["conv", "depth"]).select(F.col("owner"), "depth", F.col("conv").alias("id"))
    n = partitions(paths.sparkSession)

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for batch in batches:
            rows: list[list] = []
            for owner, depth, i in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if rows and rows[-1][:2] == [owner, depth] and rows[-1][4] < PIECE:
                    rows[-1][3].append(str(i))
                else:
                    rows.append([owner, depth, i, [str(i)], 0])
                rows[-1][4] += len(rows[-1][3][-1]) + 1
            yield {"owner": [r[0] for r in rows], "depth": [r[1] for r in rows], "first": [r[2] for r in rows], "ids": [",".join(r[3]) for r in rows]}

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        at, state = None, None
        for batch in batches:
            out: dict[str, list] = {"conv": [], "depth": [], "sha256": []}
            for owner, depth, ids in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if at == (owner, depth):
                    state.update(b"," + ids.encode())
                    continue
                if at is not None:
                    for k, v in zip(out, (*at, state.hexdigest()), strict=True):
                        out[k].append(v)
                at, state = (owner, depth), hashlib.sha256(ids.encode())
            yield out
        if at is not None:
            yield {"conv": [at[0]], "depth": [at[1]], "sha256": [state.hexdigest()]}

    cut = mapped(materialised(last, "ends").repartitionByRange(n, "owner", "depth", "id").sortWithinPartitions("owner", "depth", "id"), pieces, "owner long, depth long, first long, ids string")
    return mapped(cut.repartition(n, "owner", "depth").sortWithinPartitions("owner", "depth", "first").select("owner", "depth", "ids"), hashed, "conv long, depth long, sha256 string")


def prefix_trie(conversations: DataFrame, limit: int = LIMIT) -> DataFrame:
    """conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256 of every node."""
    found = turns(conversations)
    rows, convs = rebuilt(found)
    paths, tree = tree_of(rows, convs)
    sums = subtree_sums(tree, paths, limit)
    named = tree.drop("leaves", "saved").join(sums, ["conv", "depth"]).join(ends(paths, convs), ["conv", "depth"], "left")
    out = named.select(F.col("conv").alias("conv_id"), "depth", F.col("parent").alias("parent_conv_id"), "n_convs", "n_children", F.col("leaves").alias("n_leaves"), F.col("saved").alias("saved_tokens"), F.coalesce("sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("ends_sha256"))
    out = materialised(out, "trie")
    discarded(found, rows, convs, paths, tree, sums)
    return out
