"""SimHash near duplicates by segment popcounts.

A fingerprint of 64 bits is embedded as the bit counts of its 32 two-bit segments. The Manhattan distance of two such
points is at most the Hamming distance of the fingerprints, so points farther apart than the threshold never link. If
two points are within `bits`, one of the halves of 16 segments is within floor(bits / 2). The grid has a cell for every
point of a half; each fingerprint enters the cells within half that distance of its own, so two points in reach of each
other meet in a cell between them. Fingerprints of a cell are then compared exactly.

Equal fingerprints are one node throughout. A cell emits the links of few fingerprints, or a forest that joins what the
links of many join, so no group of near copies becomes all its pairs. A cell of more than `block` fingerprints is dealt
in pairs of blocks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from netloom.llm.common import batches, prepare, read, stored, texts
from netloom.llm.ngram_join import components

WORDS, SEED, BITS = 4, 42, 4
_LOW = np.uint64(0x5555555555555555)
#: Fingerprints of a cell whose links are emitted as they are; of more, a forest of them is.
FEW = 16


def simhash(text: str, words: int = WORDS, seed: int = SEED, part: int = 16384) -> int:
    """The majority bits of the XXH64 values of a text's word shingles, repeats included; zero without words.

    Words are runs between ASCII white space, with A-Z in lower case, and a shingle is its words with one space between
    them. A text of fewer words is one shingle. A bit set in exactly half of the values is 0.
    """
    parts = text.encode("utf-8", "surrogatepass").lower().split()
    if not parts:
        return 0
    joined = b" ".join(parts)
    ends = np.cumsum([len(p) + 1 for p in parts]) - 1
    k = min(words, len(parts))
    last = ends[k - 1 :].tolist()
    first = [0, *(ends[: len(parts) - k] + 1).tolist()]
    digest, total = xxhash.xxh64_intdigest, np.zeros(64, np.int64)
    for at in range(0, len(last), part):
        h = np.array([digest(joined[a:b], seed) for a, b in zip(first[at : at + part], last[at : at + part], strict=True)], dtype="<u8")
        total += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * total > len(last), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, words: int = WORDS, seed: int = SEED) -> DataFrame:
    """(doc_id, fp) of every row; fp holds the 64 bits of the fingerprint as a signed long."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches(parts):
            fp = np.array([simhash(t, words, seed) for t in texts(batch)], dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(fp)], names=["doc_id", "fp"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, fp long")


def segment_counts(fp: np.ndarray) -> np.ndarray:
    """Bit counts of the 32 two-bit segments, each in the two bits of its segment."""
    return fp - ((fp >> np.uint64(1)) & _LOW)


def cells_near(counts: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, cell): the grid points within Manhattan distance `radius` of points of 16 counts from 0 to 2."""
    rows, cells = np.arange(len(counts)), counts
    for _ in range(radius):
        more_rows, more = [rows], [cells]
        for j in range(16):
            one = np.uint64(1 << (2 * j))
            field = (cells >> np.uint64(2 * j)) & np.uint64(3)
            up, down = field < 2, field > 0
            more_rows += [rows[up], rows[down]]
            more += [cells[up] + one, cells[down] - one]
        rows, cells = np.concatenate(more_rows), np.concatenate(more)
        if radius > 1:
            both = np.unique(np.stack([rows.astype(np.uint64), cells]), axis=1)
            rows, cells = both[0].astype(np.int64), both[1]
    return rows, cells


def grid(nodes: DataFrame, bits: int) -> DataFrame:
    """(cell, fp): every cell a fingerprint enters, for both halves."""
    radius = -(-(bits // 2) // 2)

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts:
            whole = batch.column("fp").to_numpy()
            for at in range(0, len(whole), 2048):
                fp = whole[at : at + 2048]
                counts = segment_counts(fp.view(np.uint64))
                for half in (0, 1):
                    rows, cells = cells_near((counts >> np.uint64(32 * half)) & np.uint64(0xFFFFFFFF), radius)
                    yield pa.RecordBatch.from_arrays([pa.array((cells | np.uint64(half << 32)).view(np.int64)), pa.array(fp[rows])], names=["cell", "fp"])

    return nodes.select("fp").mapInArrow(run, "cell long, fp long")


def near(a: np.ndarray, b: np.ndarray, bits: int) -> np.ndarray:
    """Which pairs that met in the grid link: the exact check."""
    return np.bitwise_count(a ^ b) <= bits


def forest(left: np.ndarray, right: np.ndarray | None, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Links that join what all links join: among `left`, or between `left` and `right`."""
    every = left if right is None else np.concatenate([left, right])
    free = np.ones(len(every), bool)
    a, b = [], []
    for root in range(len(every)):
        stack = [root] if free[root] else []
        free[root] = False
        while stack:
            x = stack.pop()
            rest = np.flatnonzero(free)
            if right is not None:
                rest = rest[(rest >= len(left)) == (x < len(left))]
            met = rest[near(every[x], every[rest], bits)]
            free[met] = False
            a += [every[x]] * len(met)
            b += every[met].tolist()
            stack += met.tolist()
    return np.array(a, np.uint64), np.array(b, np.uint64)


def _edges(a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
    none = pa.nulls(len(a), pa.int64())
    return pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64)), none, none], names=["a", "b", "cell", "n"])


def compare_cells(rows: DataFrame, bits: int, block: int) -> DataFrame:
    """Rows (cell, fp, n), those of a cell side by side: links (a, b) of cells of up to `block`; rows (a, cell, n) of the others as they are."""

    def runs(cell: np.ndarray, fp: np.ndarray, n: np.ndarray) -> Iterator[pa.RecordBatch]:
        large = n > block
        if large.any():
            none = pa.nulls(int(large.sum()), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(fp[large].view(np.int64)), none, pa.array(cell[large]), pa.array(n[large])], names=["a", "b", "cell", "n"])
        few = np.flatnonzero(n <= FEW)
        at, ahead = few, 1
        while len(at):
            at = at[at + ahead < len(cell)]
            at = at[cell[at] == cell[at + ahead]]
            hit = at[near(fp[at], fp[at + ahead], bits)]
            if len(hit):
                yield _edges(fp[hit], fp[hit + ahead])
            ahead += 1
        many = np.flatnonzero((n > FEW) & ~large)
        if len(many):
            for part in np.split(many, np.flatnonzero(np.diff(cell[many])) + 1):
                a, b = forest(fp[part], None, bits)
                if len(a):
                    yield _edges(a, b)

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.int64)]
        for batch in parts:
            fresh = [batch.column("cell").to_numpy(), batch.column("fp").to_numpy().view(np.uint64), batch.column("n").to_numpy()]
            held = [np.concatenate(pair) for pair in zip(held, fresh, strict=True)]
            cell = held[0]
            if not len(cell):
                continue
            cut = len(cell) if cell[-1] == cell[0] and held[2][0] > block else int(np.searchsorted(cell, cell[-1]))
            yield from runs(*(x[:cut] for x in held))
            held = [x[cut:] for x in held]
        yield from runs(*held)

    return rows.mapInArrow(run, "a long, b long, cell long, n long")


def compare_blocks(rows: DataFrame, bits: int, block: int) -> DataFrame:
    """Links (a, b) of cells of more than `block` fingerprints, a task for each pair of blocks."""

    def run(table: pa.Table) -> pa.Table:
        fp, own = table.column("fp").to_numpy().view(np.uint64), table.column("own").to_numpy()
        lo, hi = table.column("lo")[0].as_py(), table.column("hi")[0].as_py()
        a, b = forest(fp, None, bits) if lo == hi else forest(fp[own == lo], fp[own == hi], bits)
        return pa.table({"a": pa.array(a.view(np.int64)), "b": pa.array(b.view(np.int64))})

    blocks = F.ceil(F.col("n") / block)
    dealt = rows.select("cell", F.col("a").alias("fp"), blocks.alias("blocks")).withColumn("own", F.pmod(F.xxhash64("fp"), "blocks"))
    dealt = dealt.withColumn("to", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    dealt = dealt.select("cell", "fp", "own", F.least("own", "to").alias("lo"), F.greatest("own", "to").alias("hi"))
    return dealt.groupBy("cell", "lo", "hi").applyInArrow(run, "a long, b long")


def links(nodes: DataFrame, bits: int = BITS, block: int = 4096) -> DataFrame:
    """Links (a, b) between distinct fingerprints at most `bits` apart: all that are needed to join what all links join."""
    entered = grid(nodes, bits).withColumn("n", F.count("*").over(Window.partitionBy("cell"))).filter("n > 1")
    met = stored(compare_cells(entered, bits, block), "simhash-links")
    return met.filter("cell is null").select("a", "b").unionByName(compare_blocks(met.filter("cell is not null"), bits, block))


def near_duplicates(docs: DataFrame, words: int = WORDS, bits: int = BITS, block: int = 4096) -> DataFrame:
    """One row per row of `docs`: doc_id, fingerprint (16 lowercase hex digits), component_id.

    Rows link at `bits` or fewer differing bits (at most 5); `component_id` is the least doc_id that links reach, null
    if all ids there are null. A null, empty or blank text has the fingerprint zero and links like any other. Repeated
    rows stay, each with its row. An empty table gives no rows. Only doc_id and text are read.
    """
    if not 0 <= bits <= 5:
        raise ValueError("the grid is made for up to 5 differing bits")
    prepare(docs.sparkSession)
    rows = stored(fingerprints(docs, words), "simhash-rows")
    nodes = stored(rows.groupBy("fp").agg(F.min("doc_id").alias("first_id")), "simhash-nodes")
    roots = components(links(nodes, bits, block))
    placed = nodes.join(roots, F.col("fp") == F.col("node"), "left").select("fp", F.coalesce("root", "fp").alias("part"), "first_id")
    least = placed.groupBy("part").agg(F.min("first_id").alias("component_id"))
    named = placed.select(F.col("fp").alias("key"), "part").join(least, "part")
    out = rows.join(named, F.col("fp") == F.col("key"))
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op12(spark, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every document."""
    return near_duplicates(read(spark, sf_dir, "documents"))
