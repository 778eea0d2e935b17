"""K-d tree sharding: splits at distributed weighted medians along the widest metadata dimension.

All open nodes split together. A cut is found by histograms of bytes, narrowed round by round; the driver sees bins per
node, never rows. Rows with equal coordinates are ordered by a hash of their text, then of their id, so equal texts lie side
by side and are parted only where a cut falls among them.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from netloom.llm.common import prepare, read, stored

COORD_BITS = 30
#: Bytes of a row beside its text.
ROW_BYTES = 16


def hashed(column: str) -> Column:
    """Coordinate of a name: equal names share it, and null has its own."""
    return F.pmod(F.xxhash64(F.coalesce(F.col(column).cast("string"), F.lit("\0"))), F.lit(1 << COORD_BITS))


def magnitude(column: Column) -> Column:
    """Coordinate of a size: its logarithm."""
    return F.least(F.floor(F.log2(F.greatest(column, F.lit(1)).cast("double")) * (1 << 24)), F.lit((1 << COORD_BITS) - 1)).cast("long")


@dataclass
class Cut:
    """A node being split: the part of the order in which the cut lies, and the bytes below that part."""

    node: int
    shards: int
    dim: int
    goal: float
    total: int
    lo: int
    hi: int
    fine: bool = False  # among rows of equal coordinate and text hash prefix
    major: int = 0
    below: int = 0
    done: bool = False

    @property
    def minor(self) -> int:
        return self.lo if self.fine else 0

    @property
    def at(self) -> int:
        return self.major if self.fine else self.lo


def _major() -> Column:
    return F.shiftleft(F.element_at("coords", F.col("dim") + 1), 32) + F.shiftrightunsigned("text_hash", 32)


def _minor() -> Column:
    return F.shiftleft(F.col("text_hash").bitwiseAND(F.lit(0x7FFFFFFF)), 31) + F.col("id_hash").bitwiseAND(F.lit(0x7FFFFFFF))


def _narrow(rows: DataFrame, cuts: list[Cut], bins: int, slack: float) -> None:
    """One round: a histogram over the undecided part of each node picks the bin that holds its goal."""
    spark = rows.sparkSession
    open_cuts = {c.node: c for c in cuts if not c.done}
    table = [(c.node, c.dim, c.fine, c.major, c.lo, max(1, -(-(c.hi - c.lo) // bins)), c.hi) for c in open_cuts.values()]
    state = F.broadcast(spark.createDataFrame(table, "node long, dim int, fine boolean, major long, lo long, width long, hi long"))  # a row for each node
    key = F.when(F.col("fine"), _minor()).otherwise(_major())
    inside = rows.join(state, "node").filter(~F.col("fine") | (_major() == F.col("major"))).select("node", "size", "lo", "width", "hi", key.alias("k")).filter("k >= lo and k < hi")
    found = inside.groupBy("node", F.expr("(k - lo) div width").alias("bin")).agg(F.sum("size").alias("w"), F.count("*").alias("n")).collect()
    by_node: dict[int, list] = {}
    for r in found:
        by_node.setdefault(r.node, []).append(r)
    for node, c in open_cuts.items():
        width = max(1, -(-(c.hi - c.lo) // bins))
        for r in sorted(by_node.get(node, []), key=lambda r: r.bin):
            if c.below + r.w < c.goal:
                c.below += r.w
                continue
            a = c.lo + r.bin * width
            b = min(c.hi, a + width)
            if r.n == 1 or r.w <= slack or (width == 1 and c.fine):  # the nearer side of what can't or needn't be parted
                c.lo, c.done = (b if c.goal - c.below > r.w / 2 else a), True
            elif width == 1:
                c.major, c.fine, c.lo, c.hi = a, True, 0, 1 << 62
            else:
                c.lo, c.hi = a, b
            break
        else:
            c.lo, c.done = c.hi, True


def assign(rows: DataFrame, shards: int, dims: int, slack: float = 0.001) -> DataFrame:
    """`rows` (size, coords, text_hash, id_hash) with `shard`, 0 to shards - 1, of nearly equal bytes.

    A node of k shards splits into k // 2 and the rest in that proportion of bytes, until it has one. Cuts within `slack`
    of a shard's bytes are near enough. Rows that are equal in id and text can't be parted.
    """
    rows = rows.withColumn("node", F.lit(0).cast("long"))
    spans = [f(F.col("coords")[d]).alias(f"{n}{d}") for d in range(dims) for n, f in (("lo", F.min), ("hi", F.max))]
    first = rows.agg(*spans).first()
    scale = [max(1, (first[f"hi{d}"] or 0) - (first[f"lo{d}"] or 0)) for d in range(dims)]
    open_nodes = {0: (0, shards)}  # node -> first shard, number of shards
    leaves: dict[int, int] = {}
    while open_nodes:
        for node in [n for n, (_, k) in open_nodes.items() if k == 1]:
            leaves[node] = open_nodes.pop(node)[0]
        if not open_nodes:
            break
        stats = {r.node: r for r in rows.groupBy("node").agg(F.sum("size").alias("w"), *spans).collect()}
        cuts = []
        for node, (_, k) in open_nodes.items():
            r = stats.get(node)
            if r is None:  # no rows: its shards stay empty
                continue
            dim = max(range(dims), key=lambda d: ((r[f"hi{d}"] - r[f"lo{d}"]) / scale[d], -d))
            cuts.append(Cut(node, k, dim, r.w * (k // 2) / k, r.w, r[f"lo{dim}"] << 32, (r[f"hi{dim}"] + 1) << 32))
        bins = min(1024, max(16, (1 << 17) // max(1, len(cuts))))
        while any(not c.done for c in cuts):
            _narrow(rows, cuts, bins, slack * min(c.total / c.shards for c in cuts))
        after: dict[int, tuple[int, int]] = {}
        table = []
        for c in cuts:
            start, k = open_nodes[c.node]
            after[2 * c.node + 1], after[2 * c.node + 2] = (start, k // 2), (start + k // 2, k - k // 2)
            table.append((c.node, c.dim, c.at, c.minor, c.fine))
        state = F.broadcast(rows.sparkSession.createDataFrame(table, "node long, dim int, at long, minor long, fine boolean"))
        right = (_major() > F.col("at")) | ((_major() == F.col("at")) & (~F.col("fine") | (_minor() >= F.col("minor"))))
        moved = F.when(F.col("dim").isNull(), F.col("node")).when(right, 2 * F.col("node") + 2).otherwise(2 * F.col("node") + 1)
        kept = [c for c in rows.columns if c != "node"]
        rows = stored(rows.join(state, "node", "left").select(*kept, moved.alias("node")), "kd-level")
        open_nodes = after
    table = F.broadcast(rows.sparkSession.createDataFrame(sorted(leaves.items()), "node long, shard int"))  # a row for each shard
    return rows.join(table, "node").drop("node")


def slots(rows: DataFrame, group: str, order: list[str], chunk_rows: int = 100_000) -> DataFrame:
    """`rows` with `slot`: 0, 1, ... within each group, numbered in hashed chunks so that no task holds a whole group."""
    most = rows.groupBy(group).count().agg(F.max("count")).first()[0] or 0
    chunks = max(1, -(-most // chunk_rows))
    rows = rows.withColumn("__chunk", F.pmod(F.xxhash64(*order), F.lit(chunks)))
    counts = rows.groupBy(group, "__chunk").agg(F.count("*").alias("__n"))
    before = counts.withColumn("__before", F.sum("__n").over(Window.partitionBy(group).orderBy("__chunk")) - F.col("__n")).drop("__n")
    numbered = rows.withColumn("__at", F.row_number().over(Window.partitionBy(group, "__chunk").orderBy(*order)))
    return numbered.join(before, [group, "__chunk"]).withColumn("slot", F.col("__before") + F.col("__at") - 1).drop("__chunk", "__before", "__at")


def shard(docs: DataFrame, shards: int | None = None, target_bytes: int = 1 << 30) -> DataFrame:
    """doc_id, size, text_crc32, shard and slot of every row; `shards`, or as many as leaves of `target_bytes` need.

    Metadata dimensions: source, language, size. Null names have a coordinate of their own, a null text is empty, null ids
    and repeated rows are dealt like others. An empty table gives an empty one; shards may be empty where rows are fewer.
    Only doc_id, text, lang and source are read.
    """
    prepare(docs.sparkSession)
    text = F.coalesce("text", F.lit(""))
    size = F.octet_length(text).cast("long") + ROW_BYTES
    meta = docs.select("doc_id", size.alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), F.array(hashed("source"), hashed("lang"), magnitude(size)).alias("coords"), F.xxhash64(text).alias("text_hash"), F.xxhash64("doc_id", text).alias("id_hash"))
    meta = stored(meta, "kd-rows")
    if shards is None:
        shards = max(1, -(-(meta.agg(F.sum("size")).first()[0] or 0) // target_bytes))
    dealt = assign(meta, shards, 3)
    return slots(dealt, "shard", ["id_hash", "doc_id"]).select("doc_id", "size", "text_crc32", "shard", "slot")


def op3(spark, sf_dir: str) -> DataFrame:
    """All documents in 40 shards of nearly equal bytes."""
    out = shard(read(spark, sf_dir, "documents"), 40)
    return out.withColumns({"law": F.lit("bytes"), "slot": F.col("slot").cast("long"), "grown_shard": F.lit(None).cast("int")})
