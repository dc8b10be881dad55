"""Sharding by k-d tree: each node is cut at a distributed weighted quantile along its widest metadata dimension until the
leaves are the shards (or reach the target bytes).

The tree works on one short row per document, written once to the shared folder: size, dimensions scaled to 0 .. 2^36 - 1
(logarithm of the size, the source by its first six bytes, doc_id), and a tie-break that differs for every row. All nodes of a
level are cut together: a table of a row per node meets the rows, and histograms (``FINE`` cells a node and round) are refined
over the dimension and then over the tie-break, so rows that are equal in a dimension can be cut apart; the driver sees a row
for each node and round. A node that holds k shards is cut k // 2 : k - k // 2 by bytes, to within half of the document at the
cut, so shards' sizes differ by about the largest document at most. Rows of equal text lie next to each other in the tie-break
only: copies that differ in doc_id or source are rows of their own places and often lie in several shards.

Defined results: a null text has 8 bytes and the checksum of no bytes; null dimensions count as 0; repeated rows are rows of
their own; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillgraph.llm.common import BROADCAST_ROWS, dropped, partitions, written

#: Bytes that a row takes beside its text.
ROW_BYTES = 8
SCALE_BITS = 36
#: Bits of a key that one round of histograms resolves.
FINE_BITS = 12
FINE = 1 << FINE_BITS
TIE_BITS = 60
DIMENSIONS = ("x_size", "x_source", "x_id")


def metadata(docs: DataFrame) -> DataFrame:
    """One short row per document: doc_id, size, text_crc32, the raw dimensions and the tie-break ``t``."""
    raw = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    source = F.rpad(F.hex(F.substring(F.coalesce("source", F.lit("")).cast("binary"), 1, 6)), 12, "0")
    rows = docs.select(F.col("doc_id"), (F.octet_length(raw) + ROW_BYTES).cast("long").alias("size"), F.crc32(raw).alias("text_crc32"), F.conv(source, 16, 10).cast("double").alias("x_source"), F.coalesce(F.col("doc_id").cast("double"), F.lit(0.0)).alias("x_id"))
    rows = rows.withColumn("x_size", F.log2(F.col("size").cast("double")))
    # 32 bits of the text, then 28 that spread its copies; the row's number decides between rows that are alike in both
    spread = F.pmod(F.xxhash64("doc_id", F.monotonically_increasing_id()), F.lit(1 << 28))
    return rows.withColumn("t", F.shiftleft(F.col("text_crc32"), 28) + spread)


def _table(like: DataFrame, rows: list[tuple], schema: str) -> DataFrame:
    """A row for each node; broadcast within the bound."""
    out = like.sparkSession.createDataFrame(rows, schema)
    return F.broadcast(out) if len(rows) <= BROADCAST_ROWS else out


def kd_shards(docs: DataFrame, shards: int = 24, target_bytes: int | None = None) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard; ``target_bytes`` sets the number of shards from the total instead."""
    spark = docs.sparkSession
    raw = written(metadata(docs), "shard-metadata")
    bounds = raw.agg(F.sum("size").alias("total"), *[f(d).alias(f"{n}_{d}") for d in DIMENSIONS for n, f in (("lo", F.min), ("hi", F.max))]).first()
    if target_bytes:
        shards = max(1, -(-(bounds["total"] or 0) // target_bytes))
    scaled = []
    for d in DIMENSIONS:
        lo, hi = bounds[f"lo_{d}"] or 0.0, bounds[f"hi_{d}"] or 0.0
        scaled.append(F.floor((F.col(d) - F.lit(lo)) / F.lit((hi - lo) or 1.0) * float((1 << SCALE_BITS) - 1)).cast("long"))
    rows = written(raw.select("doc_id", "size", "text_crc32", "t", F.array(*scaled).alias("x"), F.lit(0).alias("node")), "shard-nodes")
    dropped(raw)
    leaves, fresh = {0: (0, shards)}, 1  # node -> first shard, number of shards
    while any(n > 1 for _, n in leaves.values()):
        open_ = {k: v for k, v in leaves.items() if v[1] > 1}
        now = rows.join(_table(rows, [(k,) for k in open_], "node int"), "node", "left_semi")
        spans = now.groupBy("node").agg(F.sum("size").alias("w"), *[(F.max(F.get("x", F.lit(i))) - F.min(F.get("x", F.lit(i)))).alias(d) for i, d in enumerate(DIMENSIONS)]).collect()
        cuts = []
        for s in spans:
            k = open_[s["node"]][1]
            cuts.append({"node": s["node"], "dim": max(range(len(DIMENSIONS)), key=lambda i: (s[DIMENSIONS[i]], i)), "want": s["w"] * (k // 2) / k, "below": 0, "prefix": 0, "value": 0})
        sides = []
        for cut in _refine(now, cuts):
            first, k = leaves.pop(cut["node"])
            leaves[fresh], leaves[fresh + 1] = (first, k // 2), (first + k // 2, k - k // 2)
            sides.append((cut["node"], cut["dim"], cut["value"], cut["prefix"], cut["shift"], cut["inside"], fresh, fresh + 1))
            fresh += 2
        for k in [k for k in leaves if k in open_]:  # a node without rows: its shards stay empty
            leaves[k] = (leaves[k][0], 1)
        table = _table(rows, sides, "node int, dim int, value long, prefix long, shift int, inside boolean, left int, right int")
        node = F.when(F.col("dim").isNull(), F.col("node")).when(_before(), F.col("left")).otherwise(F.col("right"))
        old, rows = rows, written(rows.join(table, "node", "left").select("doc_id", "size", "text_crc32", "t", "x", node.alias("node")), "shard-nodes")
        dropped(old)
    names = _table(rows, [(k, first) for k, (first, _) in leaves.items()], "node int, shard int")
    placed = rows.join(names, "node").select("doc_id", "size", "text_crc32", "shard", F.pmod(F.xxhash64("t", "doc_id"), F.lit(partitions(spark))).cast("int").alias("part"))
    return _slots(placed)


def _before() -> Column:
    """Whether a row lies before its node's cut: by the bits that were resolved."""
    x, at = F.get("x", F.col("dim")), F.col("prefix")
    reach = lambda v: (v < at) | ((v == at) & F.col("inside"))
    by_tie = (x < F.col("value")) | ((x == F.col("value")) & reach(F.call_function("shiftright", F.col("t"), F.col("shift"))))
    return F.when(F.col("shift") < TIE_BITS, by_tie).otherwise(reach(F.call_function("shiftright", x, F.greatest(F.col("shift") - TIE_BITS, F.lit(0)))))


def _refine(now: DataFrame, cuts: list[dict]) -> list[dict]:
    """Narrows every cut to the row whose bytes reach the wanted share: by the dimension's bits, then by the tie-break's, until each cell at a cut holds one row."""
    shift = SCALE_BITS + TIE_BITS
    while cuts and shift > 0 and not (shift < SCALE_BITS + TIE_BITS and all(cut["rows"] == 1 for cut in cuts)):
        step = min(FINE_BITS, shift - TIE_BITS if shift > TIE_BITS else shift)
        if shift == TIE_BITS:
            for cut in cuts:
                cut["value"], cut["prefix"] = cut["prefix"], 0
        shift -= step
        table = _table(now, [(c["node"], c["dim"], c["value"], c["prefix"], float(c["want"] - c["below"])) for c in cuts], "node int, dim int, value long, prefix long, due double")
        x = F.get("x", F.col("dim"))
        high = F.shiftright(x, shift - TIE_BITS) if shift >= TIE_BITS else F.shiftright("t", shift)
        inside = F.shiftright(high, step) == F.col("prefix")
        inside = inside if shift >= TIE_BITS else inside & (x == F.col("value"))
        cells = now.join(table, "node").where(inside).groupBy("node", "due", high.bitwiseAND((1 << step) - 1).alias("cell")).agg(F.sum("size").alias("w"), F.count(F.lit(1)).alias("n"))
        order = Window.partitionBy("node").orderBy("cell")  # FINE rows a node at most
        cells = cells.select("*", F.sum("w").over(order).alias("upto"), F.max("cell").over(Window.partitionBy("node")).alias("last"))
        hit = cells.where((F.col("upto") >= F.col("due")) | (F.col("cell") == F.col("last"))).groupBy("node").agg(F.min(F.struct("cell", "w", "n", "upto")).alias("x")).select("node", "x.*").collect()
        at = {r["node"]: r for r in hit}
        for cut in cuts:
            r = at[cut["node"]]
            cut |= {"at": r["w"], "rows": r["n"], "prefix": (cut["prefix"] << step) | r["cell"], "shift": shift, "below": cut["below"] + r["upto"] - r["w"]}
    for cut in cuts:
        cut["inside"] = cut["want"] - cut["below"] > cut["at"] / 2  # the row at the cut goes to the nearer side
    return cuts


def _slots(placed: DataFrame) -> DataFrame:
    """Numbers each shard's rows from 0: within small parts first, then by the parts' counts (shards x parts rows)."""
    by = Window.partitionBy("shard", "part")
    counts = placed.groupBy("shard", "part").agg(F.count(F.lit(1)).alias("n"))
    counts = counts.select("shard", "part", (F.sum("n").over(Window.partitionBy("shard").orderBy("part")) - F.col("n")).alias("before"))
    ranked = placed.withColumn("rank", F.row_number().over(by.orderBy("doc_id", "text_crc32", "size")))
    out = ranked.join(counts, ["shard", "part"])
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("rank") - 1 + F.col("before")).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
