"""N-gram Jaccard join: chosen-path recursion over word shingles.

Texts with equal shingle sets are one node. Each node's set is sampled by min-hashes, so two sets share a sampled
token with a probability equal to their Jaccard similarity. A run starts with all nodes in one bucket; a bucket splits
by `branches` sampled tokens of its own into the nodes that share each of them, and so on until it is small, or until
splitting would keep most pairs together anyway because its nodes are alike: that is measured on one sampled token before
any split. Of last buckets with the same nodes one stays. They are compared by brute force, in blocks, on whole sets.
Runs repeat until a pair at the threshold is met with the target probability at every depth.

A pair is counted only in the lowest of the buckets that both nodes reached, so degrees need no table of pairs.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from netloom.llm.common import batches, prepare, read, stored, texts

#: Sampled tokens kept of each set.
SAMPLES = 96
_SEEDS = np.random.default_rng(7)
_FLIP = _SEEDS.integers(0, 1 << 63, SAMPLES, dtype=np.uint64)
_ODD = _SEEDS.integers(0, 1 << 63, SAMPLES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


@dataclass(frozen=True)
class Settings:
    words: int = 5
    similarity: float = 0.8
    recall: float = 0.9999  # of pairs at the threshold
    branches: int = 3  # sampled tokens by which a bucket splits
    small: int = 256  # nodes of a bucket that is compared rather than split
    alike: float = 1 / 3  # part of its pairs that stay together in a split, from which a bucket is compared rather than split
    block: int = 1024  # nodes of one side of a comparison task

    levels: int = 8  # buckets of the last level are compared, whatever their size

    @property
    def options(self) -> int:
        """Samples among which each of the branches of a bucket chooses; those of another branch or level are others."""
        return SAMPLES // (self.levels * self.branches)

    @property
    def runs(self) -> int:
        """Runs after which a pair at the threshold is met with probability `recall` at any depth.

        Buckets choose samples on their own, so the buckets that hold a pair are a branching process. A run loses the pair
        at some depth with the probability that the process dies out, the least root of q = (1 - s + s q) ** branches.
        """
        lost = 0.0
        for _ in range(200):
            lost = (1 - self.similarity + self.similarity * lost) ** self.branches
        needed = math.ceil(math.log(1 - self.recall) / math.log(lost)) if 0 < lost < 1 else 1
        if needed > self.options:
            raise ValueError("too few samples for this recall")
        return needed

    def column(self, level: int, branch: int) -> F.Column:
        """Which sample a bucket splits by: that of the run at first, then one chosen by the bucket."""
        option = F.col("parent") if level == 0 else F.pmod(F.xxhash64("parent", F.lit(branch)), F.lit(self.options))
        return option + F.lit((level * self.branches + branch) * self.options)

    @property
    def agreeing(self) -> int:
        """Samples that two sets must share to be compared: 5.5 standard deviations below the mean at the threshold."""
        t = self.similarity
        return max(1, math.floor(SAMPLES * t - 5.5 * math.sqrt(SAMPLES * t * (1 - t))))


class Shingler:
    """Sorted distinct hashes of the word n-grams of texts; remembers word hashes."""

    def __init__(self, words: int, most: int = 500_000):
        self.words, self.most, self.known = words, most, {}

    def __call__(self, text: str) -> np.ndarray:
        """Words are split at white space, in lower case; a shorter text is one shingle of all its words."""
        words = text.lower().split()
        if not words:
            return np.zeros(0, np.uint64)
        if len(self.known) > self.most:
            self.known.clear()
        for w in set(words).difference(self.known):
            self.known[w] = xxhash.xxh3_64_intdigest(w.encode("utf-8", "surrogatepass"))
        h = np.fromiter(map(self.known.__getitem__, words), np.uint64, len(words))
        k = min(self.words, len(h))
        out = np.zeros(len(h) - k + 1, np.uint64)
        with np.errstate(over="ignore"):
            for j in range(k):
                out = (out ^ h[j : len(h) - k + 1 + j]) * np.uint64(0x9E3779B97F4A7C15)
                out ^= out >> np.uint64(32)
        return np.unique(out)


def samples(shingles: np.ndarray) -> np.ndarray:
    """The high half of the least value of the set under each of the sampling hashes."""
    low = np.full(SAMPLES, np.iinfo(np.uint64).max, np.uint64)
    with np.errstate(over="ignore"):
        for at in range(0, len(shingles), 2048):
            low = np.minimum(low, ((shingles[at : at + 2048, None] ^ _FLIP) * _ODD).min(axis=0))
    return (low >> np.uint64(32)).astype("<u4")


def digest(shingles: np.ndarray) -> str | None:
    return hashlib.blake2b(shingles.tobytes(), digest_size=16).hexdigest() if len(shingles) else None


def _row_key() -> F.Column:
    return F.xxhash64("doc_id", "text")


def sketches(docs: DataFrame, settings: Settings) -> DataFrame:
    """doc_id, row key, digest of the shingle set (null for no words), samples."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler(settings.words)
        for batch in batches(parts):
            sets = [shingler(t) for t in texts(batch)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("jk"), pa.array([digest(s) for s in sets], pa.string()), pa.array([samples(s).tobytes() for s in sets], pa.binary())], names=["doc_id", "jk", "rep", "sig"]
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text", _row_key().alias("jk")).mapInArrow(run, f"doc_id {kind}, jk long, rep string, sig binary")


def leaf_buckets(reps: DataFrame, settings: Settings) -> DataFrame:
    """(rep, bucket, n): the buckets of two nodes or more in which the recursion ends."""
    total = reps.count()
    roots = F.explode(F.array(*[F.lit(r).cast("long") for r in range(settings.runs)]))
    opened = reps.select("rep", "sig", roots.alias("parent")).withColumn("size", F.lit(total).cast("long"))
    found: list[DataFrame] = []
    for level in range(settings.levels):
        sampled = [F.substring("sig", (4 * settings.column(level, j) + 1).cast("int"), F.lit(4)).alias(f"t{j}") for j in range(settings.branches)]
        opened = stored(opened.select("rep", "parent", "size", *sampled), "ngram-opened")
        if level:  # the root is all nodes: it is split in any case
            shares = opened.groupBy("parent", "size", "t0").agg(F.count("*").cast("double").alias("m"))
            kept = shares.groupBy("parent", "size").agg(F.sum(F.col("m") * F.col("m")).alias("pairs"))
            ended = stored(kept.filter(F.col("pairs") >= settings.alike * F.col("size") * F.col("size")).select("parent"), "ngram-ended")
            found.append(opened.join(ended, "parent", "left_semi").select("rep", F.col("parent").alias("bucket"), F.col("size").alias("n")))
            opened = opened.join(ended, "parent", "left_anti")
        split = F.array(*(F.xxhash64("parent", F.lit(j), f"t{j}") for j in range(settings.branches)))
        kids = stored(opened.select("rep", F.explode(split).alias("bucket")), "ngram-split")
        shared = kids.groupBy("bucket").agg(F.count("*").alias("n")).filter("n > 1")
        rows = stored(kids.join(shared, "bucket"), "ngram-shared")
        last = level == settings.levels - 1
        leaf = F.lit(True) if last else F.col("n") <= settings.small
        found.append(rows.filter(leaf).select("rep", "bucket", "n"))
        if last or rows.filter(~leaf).isEmpty():
            break
        opened = rows.filter(~leaf).select("rep", F.col("bucket").alias("parent"), F.col("n").alias("size")).join(reps.select("rep", "sig"), "rep")
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return _without_twins(stored(out, "ngram-leaves"))


def _without_twins(leaves: DataFrame) -> DataFrame:
    """The buckets without those that hold the same nodes as another."""
    members = [F.bit_xor(F.xxhash64("rep", F.lit(k))).alias(f"x{k}") for k in (0, 1)]
    buckets = leaves.groupBy("bucket").agg(F.max("n").alias("n"), *members)
    return leaves.join(buckets.groupBy("n", "x0", "x1").agg(F.min("bucket").alias("bucket")).select("bucket"), "bucket", "left_semi")


def _tasks(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """The rows of each comparison task; they arrive side by side."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in parts:
        keys = np.stack([batch.column(c).to_numpy() for c in ("bucket", "lo", "hi")], axis=1)
        cuts = [0, *(np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1).tolist(), len(keys)]
        for a, b in zip(cuts, cuts[1:], strict=False):
            if a == b:
                continue
            key = tuple(keys[a])
            if held and key != last:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(a, b - a))
            last = key
    if held:
        yield pa.Table.from_batches(held)


def _products(sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of all intersections, as a product of 0/1 matrices over the elements that two sets share at least."""
    n = len(sets)
    sizes = [len(s) for s in sets]
    values, inverse, counts = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    number = np.cumsum(counts > 1) - 1
    shared = (counts > 1)[inverse]
    rows, cols = np.repeat(np.arange(n), sizes)[shared], number[inverse][shared]
    order = np.argsort(cols, kind="stable")
    rows, cols = rows[order], cols[order]
    out = np.zeros((n, n), np.float32)
    width = 2048
    for at in range(0, int(cols[-1]) + 1 if len(cols) else 0, width):
        a, b = np.searchsorted(cols, [at, at + width])
        x = np.zeros((n, width if n > 64 else min(width, int(cols[b - 1]) - at + 1)), np.float32)
        x[rows[a:b], cols[a:b] - at] = 1
        out += x @ x.T
    return out


def _pairs_here(table: pa.Table) -> np.ndarray:
    """Which pairs belong to this task: of two different blocks (or any, within one block), and of no lower common bucket."""
    own = table.column("own").to_numpy()
    bucket, lo, hi = (table.column(c)[0].as_py() for c in ("bucket", "lo", "hi"))
    here = own[:, None] != own[None, :] if lo != hi else ~np.eye(len(own), dtype=bool)
    lower = [np.unique(b[b < bucket]) for b in (np.array(x, dtype=np.int64) for x in table.column("buckets").to_pylist())]
    return here & (_products(lower) == 0) if any(map(len, lower)) else here


def candidates(tasks: DataFrame, settings: Settings) -> DataFrame:
    """The rows of tasks that have a pair of enough equal samples there."""
    kept = [f.name for f in tasks.schema.fields if f.name != "sig"]

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _tasks(parts):
            sig = np.frombuffer(b"".join(table.column("sig").to_pylist()), "<u4").reshape(-1, SAMPLES)
            equal = np.concatenate([(sig[a : a + 32, None, :] == sig[None, :, :]).sum(axis=2) for a in range(0, len(sig), 32)])
            mask = equal >= settings.agreeing
            np.fill_diagonal(mask, False)
            if mask.any():
                mask &= _pairs_here(table)
                rows = np.flatnonzero(mask.any(axis=1))
                if len(rows):
                    yield from table.select(kept).take(pa.array(rows)).combine_chunks().to_batches()

    return tasks.mapInArrow(run, ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in tasks.schema.fields if f.name != "sig"))


def _forest(links: np.ndarray) -> list[tuple[int, int]]:
    """Edges that join what the links join."""
    left, edges = np.ones(len(links), bool), []
    for root in range(len(links)):
        stack = [root] if left[root] else []
        left[root] = False
        while stack:
            a = stack.pop()
            new = np.flatnonzero(links[a] & left)
            left[new] = False
            edges += [(a, int(b)) for b in new]
            stack += new.tolist()
    return edges


def compare(tasks: DataFrame, settings: Settings) -> DataFrame:
    """(rep, other, links): exact links of each task, as weighted degrees (other null) and as edges that span them."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _tasks(parts):
            sets = [np.frombuffer(x, np.uint64) for x in table.column("shingles").to_pylist()]
            size = np.array([len(s) for s in sets], dtype=np.float64)
            common = _products(sets).astype(np.float64)
            links = (common >= settings.similarity * (size[:, None] + size[None, :] - common) - 1e-6) & _pairs_here(table)
            np.fill_diagonal(links, False)
            reps = table.column("rep").to_pylist()
            degree = links @ table.column("copies").to_numpy().astype(np.float64)
            rows = np.flatnonzero(degree)
            edges = _forest(links) if len(rows) else []
            if len(rows):
                yield pa.RecordBatch.from_pydict(
                    {
                        "rep": pa.array([*(reps[i] for i in rows), *(reps[a] for a, _ in edges)], pa.string()),
                        "other": pa.array([*(None for _ in rows), *(reps[b] for _, b in edges)], pa.string()),
                        "links": pa.array([*(int(degree[i]) for i in rows), *(0 for _ in edges)], pa.int64()),
                    }
                )

    return tasks.mapInArrow(run, "rep string, other string, links long")


def _side_by_side(rows: DataFrame) -> DataFrame:
    return rows.repartition("bucket", "lo", "hi").sortWithinPartitions("bucket", "lo", "hi", "rep")


def components(edges: DataFrame) -> DataFrame:
    """(node, root): the least node of each node's component, by alternating large and small stars."""
    edges = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct()
    edges, before = stored(edges, "ngram-edges"), None
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.join(least, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a")
        small = small.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b"))).filter("a <> b").distinct()
        edges = stored(small, "ngram-edges")
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == before:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
        before = now


def join(docs: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """One row per row of `docs`: doc_id, row key, class_key, class_id, n_links.

    `n_links` counts the other rows with similarity of at least the threshold. A class holds what links connect,
    directly or over others; `class_id` is its lowest doc_id. Rows without words (null, empty, blank) have no
    similarity: each is a class of its own with no links and a null class_key. Rows with null ids take part; a class
    of such rows only has a null class_id. Repeated rows link with each other. Only doc_id and text are read.
    """
    prepare(docs.sparkSession)
    rows = stored(sketches(docs, settings), "ngram-sketches")
    reps = stored(rows.filter("rep is not null").groupBy("rep").agg(F.count("*").alias("copies"), F.min("doc_id").alias("first_id"), F.min("jk").alias("jk"), F.first("sig").alias("sig")), "ngram-reps")
    leaves = leaf_buckets(reps, settings)
    lists = leaves.groupBy("rep").agg(F.collect_list(F.struct("bucket", "n")).alias("leaves"))
    members = lists.join(reps.select("rep", "copies", "sig", "jk"), "rep").select("rep", "copies", "sig", "jk", F.col("leaves.bucket").alias("buckets"), F.explode("leaves").alias("leaf"))
    members = members.select("rep", "copies", "sig", "jk", "buckets", "leaf.bucket", F.ceil(F.col("leaf.n") / settings.block).alias("blocks"))
    members = members.withColumn("own", F.pmod(F.xxhash64("rep"), "blocks")).withColumn("to", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    members = members.select("bucket", F.least("own", "to").alias("lo"), F.greatest("own", "to").alias("hi"), "own", "rep", "copies", "jk", "buckets", "sig")
    met = stored(candidates(_side_by_side(members), settings), "ngram-candidates")

    def shingle(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler(settings.words)
        for batch in batches(parts):
            sets = [shingler(t) for t in texts(batch)]
            same = np.array([digest(s) == r for s, r in zip(sets, batch.column("rep").to_pylist(), strict=True)], dtype=bool)
            out = pa.RecordBatch.from_arrays([batch.column("rep"), pa.array([s.tobytes() for s in sets], pa.binary())], names=["rep", "shingles"])
            yield out.filter(pa.array(same))

    # both sides are dealt by key at every size: the nodes wanted grow with the input
    wanted = met.select("jk", "rep").distinct().hint("shuffle_hash")
    whole = docs.select(_row_key().alias("jk"), "text").join(wanted, "jk").select("rep", "text").mapInArrow(shingle, "rep string, shingles binary").dropDuplicates(["rep"])
    tasks = met.drop("jk").join(whole, "rep").select("bucket", "lo", "hi", "own", "rep", "copies", "buckets", "shingles")
    results = stored(compare(_side_by_side(tasks), settings), "ngram-links")
    degrees = results.filter("other is null").groupBy("rep").agg(F.sum("links").alias("links"))
    roots = components(results.filter("other is not null").select(F.col("rep").alias("a"), F.col("other").alias("b")))
    nodes = reps.select("rep", "copies", "first_id").join(degrees, "rep", "left").join(roots, F.col("rep") == F.col("node"), "left")
    nodes = nodes.select("rep", F.coalesce("root", "rep").alias("class_key"), (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), "first_id")
    classes = nodes.groupBy("class_key").agg(F.min("first_id").alias("class_id"))
    nodes = nodes.select("rep", "class_key", "n_links").join(classes, "class_key")
    out = rows.select("doc_id", "jk", "rep").join(nodes, "rep", "left")
    return out.select("doc_id", "jk", "class_key", F.when(F.col("rep").isNull(), F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"), F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"))


def keep_first(docs: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """One row of each class, that with the lowest id; all rows without words stay. Of equal (doc_id, text) rows one stays."""
    found = stored(join(docs, settings), "ngram-classes")
    first = found.filter("class_key is not null").groupBy("class_key").agg(F.min(F.struct("doc_id", "jk")).alias("k")).select("k.jk")
    blank = found.filter("class_key is null").select("jk").distinct()
    key, copy, every = "__row_key", "__copy", "__every"
    keys = first.select(F.col("jk").alias(key), F.lit(False).alias(every)).unionByName(blank.select(F.col("jk").alias(key), F.lit(True).alias(every)))
    order = [F.col(c) for c in docs.columns if docs.schema[c].dataType.typeName() not in ("map", "variant")]
    rows = docs.withColumn(key, _row_key()).join(keys, key).withColumn(copy, F.row_number().over(Window.partitionBy(key).orderBy(*order)))
    return rows.filter(f"{every} or {copy} = 1").select(*docs.columns)


def op2(spark, sf_dir: str) -> DataFrame:
    """Class and number of near duplicates of every document."""
    return join(read(spark, sf_dir, "documents")).select("doc_id", "class_id", "n_links")
