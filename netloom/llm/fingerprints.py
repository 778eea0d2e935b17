"""Document fingerprints: invertible Bloom lookup sketches of passages.

A text is cut into passages at line ends, sentence ends, some content-chosen words and after twelve words, so an edit changes only passages
that it touches. Each passage's digest enters three cells of a small table of sums. Two tables subtract cell by cell; peeling
cells with one digest left recovers the digests in which the texts differ. Where peeling stops early, tables of
twice the size are built. A digest carries its passage's length, so likeness counts characters.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from netloom.llm.common import batches, prepare, read, stored, texts

#: Cells of one of the three parts of a stored fingerprint.
CELLS = 8
_U = np.uint64
_LENGTH = _U(0xFFFF)


def _mix(x: np.ndarray, salt: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (x ^ _U(salt * 0x9E3779B97F4A7C15 % (1 << 64))) * _U(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> _U(31))) * _U(0x94D049BB133111EB)
        return x ^ (x >> _U(29))


class Passages:
    """Distinct digests of a text's passages; a passage that occurs again gets a digest by its number."""

    def __init__(self, often: int = 8, longest: int = 12, most: int = 500_000):
        self.often, self.longest, self.most, self.known = often, longest, most, {}
        self.powers = np.array([pow(0xD6E8FEB86659FD93, k, 1 << 64) for k in range(longest)], dtype=_U)

    def _hash(self, word: str) -> int:
        """Hash of a word; its last bit says whether a passage ends after it."""
        h = xxhash.xxh3_64_intdigest(word.encode("utf-8", "surrogatepass"))
        return h | 1 if word[-1] in ".!?" or (h >> 8) % self.often == 0 else h & ~1

    def __call__(self, text: str) -> np.ndarray:
        lines = [line.split() for line in text.split("\n")]
        words = [w for line in lines for w in line]
        if not words:
            return np.zeros(0, _U)
        if len(self.known) > self.most:
            self.known.clear()
        self.known.update((w, self._hash(w)) for w in set(words).difference(self.known))
        h = np.fromiter(map(self.known.__getitem__, words), _U, len(words))
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        last = (h & _U(1)).astype(bool)
        last[np.cumsum([len(line) for line in lines if line]) - 1] = True
        last[[k for k in (0, 1, 3) if k < len(h)]] = True  # short texts have passages to share as well
        begins = np.concatenate([[0], np.flatnonzero(last[:-1]) + 1])
        place = np.arange(len(h)) - np.repeat(begins, np.diff(np.append(begins, len(h))))
        begins = np.flatnonzero(place % self.longest == 0)
        place = np.arange(len(h)) - np.repeat(begins, np.diff(np.append(begins, len(h))))
        with np.errstate(over="ignore"):
            keys = _mix(np.add.reduceat(h * self.powers[place], begins), 1)
        keys = (keys & ~_LENGTH) | np.minimum(np.add.reduceat(sizes + 1, begins), 0xFFFF).astype(_U)
        keys.sort()
        first = np.concatenate([[True], keys[1:] != keys[:-1]])
        if not first.all():
            at = np.flatnonzero(first)
            number = np.arange(len(keys)) - np.repeat(at, np.diff(np.append(at, len(keys))))
            keys = np.where(number > 0, (_mix(keys + number.astype(_U), 2) & ~_LENGTH) | (keys & _LENGTH), keys)
        return keys


def _cells(owner: np.ndarray, keys: np.ndarray, part: int, salt: int) -> np.ndarray:
    """The three cells of each digest in its owner's table."""
    return np.stack([(owner * 3 + j) * part + (_mix(keys, 10 * salt + j + 3) % _U(part)).astype(np.int64) for j in range(3)])


def sketch(sets: list[np.ndarray], part: int, salt: int = 0) -> np.ndarray:
    """Tables of all sets: rows of 3 x `part` cells, each of a count, a sum of digests and a sum of their checks."""
    table = np.zeros((3, len(sets) * 3 * part), _U)
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    if len(owner):
        keys = np.concatenate(sets)
        _add(table, _cells(owner, keys, part, salt), keys, np.ones(len(keys), _U))
    return table.reshape(3, len(sets), 3 * part)


def _add(table: np.ndarray, cells: np.ndarray, keys: np.ndarray, sign: np.ndarray) -> None:
    with np.errstate(over="ignore"):
        check = _mix(keys, 99) * sign
        for at in cells:
            np.add.at(table[0], at, sign)
            np.add.at(table[1], at, keys * sign)
            np.add.at(table[2], at, check)


def peel(table: np.ndarray, part: int, salt: int) -> tuple[np.ndarray, np.ndarray]:
    """Characters only in the first and only in the second text of each subtracted table; and which tables came out empty."""
    n = table.shape[1]
    flat = table.reshape(3, -1).copy()
    own = np.zeros((2, n), np.int64)
    watch = np.arange(flat.shape[1])
    while len(watch):
        count = flat[0, watch].view(np.int64)
        at = watch[np.abs(count) == 1]
        with np.errstate(over="ignore"):
            sign = flat[0, at]
            keys = flat[1, at] * sign
            pure = _mix(keys, 99) * sign == flat[2, at]
        at, sign, keys = at[pure], sign[pure], keys[pure]
        if not len(at):
            break
        owner = at // (3 * part)
        order = np.lexsort((keys, owner))
        fresh = np.concatenate([[True], (np.diff(owner[order]) != 0) | (keys[order][1:] != keys[order][:-1])])
        pick = order[fresh]
        owner, sign, keys = owner[pick], sign[pick], keys[pick]
        side = (sign != _U(1)).astype(np.int64)
        np.add.at(own, (side, owner), (keys & _LENGTH).astype(np.int64))
        cells = _cells(owner, keys, part, salt)
        with np.errstate(over="ignore"):
            _add(flat, cells, keys, _U(0) - sign)
        watch = np.unique(cells)
    return own, ~flat.reshape(3, n, -1).any(axis=(0, 2))


def likeness(a: list[np.ndarray], b: list[np.ndarray], base: int = CELLS) -> np.ndarray:
    """Share of characters in passages that both texts of a pair have; 1 for two texts without words."""
    weight = [np.array([int((s & _LENGTH).sum()) for s in sets], dtype=np.float64) for sets in (a, b)]
    lost = np.zeros((2, len(a)))
    # the difference has at least so many digests: smaller tables can't give them
    need = np.array([abs(len(x) - len(y)) for x, y in zip(a, b, strict=True)])
    part = base
    todo = np.arange(len(a))
    while len(todo):
        ready = todo[need[todo] <= 3 * part]
        done = np.zeros(0, np.int64)
        step = max(1, (1 << 21) // (3 * part))  # tables of one step share a bounded array
        for at in range(0, len(ready), step):
            rows = ready[at : at + step]
            with np.errstate(over="ignore"):
                own, empty = peel(sketch([a[i] for i in rows], part, part) - sketch([b[i] for i in rows], part, part), part, part)
            lost[:, rows[empty]] = own[:, empty]
            done = np.concatenate([done, rows[empty]])
        todo = np.setdiff1d(todo, done)
        part *= 2
    shared = np.maximum(0.0, weight[0] - lost[0])
    union = shared + lost[0] + lost[1]
    return np.where(union > 0, shared / np.where(union > 0, union, 1), 1.0)


def fingerprint(sets: list[np.ndarray]) -> list[str]:
    """The stored form: the base table's cells, as base64."""
    table = sketch(sets, CELLS)
    out = []
    for k in range(len(sets)):
        count, keys, check = table[:, k]
        out.append(base64.b64encode(count.astype("<u2").tobytes() + keys.astype("<u8").tobytes() + (check >> _U(32)).astype("<u4").tobytes()).decode())
    return out


def with_next(docs: DataFrame, bucket_rows: int = 2048) -> DataFrame:
    """(doc_id, text, next_text): the text of the next row by ascending doc_id, and after the last row the first's.

    Ids are cut at quantiles, and between two of them into ranges of equal width, all in doubles; null ids, which come first,
    are cut by a hash of their text. Each range also gets the first row of the next one. Equal ids go by that hash.
    """
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    x = F.col("doc_id").cast("double")
    span = rows.agg(F.count("doc_id").alias("n"), F.count("*").alias("all"), F.min(x).alias("lo"), F.max(x).alias("hi")).first()
    wanted = max(1, -(-span["n"] // bucket_rows))
    ranges = min(wanted, 128)
    inner = rows.select(x.alias("x")).filter("x is not null").stat.approxQuantile("x", [k / ranges for k in range(1, ranges)], 0.2 / ranges) if ranges > 1 else []
    lows = sorted({span["lo"] or 0.0, *inner})
    ends = [*lows[1:], span["hi"] or 0.0]
    each = -(-wanted // len(lows))
    place = F.size(F.filter(F.array(*map(F.lit, lows)), lambda low: low <= x))
    low, end = F.element_at(F.array(*map(F.lit, lows)), place), F.element_at(F.array(*map(F.lit, ends)), place)
    share = F.when(end > low, F.least((x / 2 - low / 2) / (end / 2 - low / 2), F.lit(1.0))).otherwise(F.lit(0.0))
    within = F.least(F.floor(share * each), F.lit(each - 1))
    nulls = max(1, -(-(span["all"] - span["n"]) // bucket_rows))
    by_text = F.floor((F.xxhash64("text").cast("double") / float(1 << 64) + 0.5) * nulls)
    bucket = F.when(x.isNull(), F.greatest(F.least(by_text, F.lit(nulls - 1)), F.lit(0)) - nulls).otherwise((place - 1) * each + within).cast("long")
    keyed = rows.select("doc_id", "text", bucket.alias("bucket"), F.xxhash64("text").alias("h"))
    heads = stored(keyed.groupBy("bucket").agg(F.min(F.struct("doc_id", "h")).alias("k")).withColumn("far", F.expr("bucket div 4096")), "finger-heads")
    near = F.lead("k").over(Window.partitionBy("far").orderBy("bucket"))
    groups = heads.groupBy("far").agg(F.min(F.struct("bucket", "k")).alias("head"))
    ends = Window.orderBy("far")  # one row for each 4096 ranges
    first = F.first("head.k").over(ends.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    groups = groups.select("far", F.coalesce(F.lead("head.k").over(ends), first).alias("beyond"))
    after = heads.withColumn("near", near).join(groups, "far").select("bucket", F.coalesce("near", "beyond").alias("k")).select("bucket", "k.doc_id", "k.h")
    after = stored(after, "finger-after")
    found = after.select(F.col("bucket").alias("of"), F.col("doc_id").alias("id"), F.col("h").alias("hash"))
    guests = keyed.join(found, F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("h") == F.col("hash"))).select("doc_id", "text", F.col("of").alias("bucket"), "h").dropDuplicates(["bucket"])
    all_rows = keyed.withColumn("guest", F.lit(False)).unionByName(guests.withColumn("guest", F.lit(True)))
    order = Window.partitionBy("bucket").orderBy("guest", F.col("doc_id").asc_nulls_first(), "h")
    return all_rows.withColumn("next_text", F.lead("text").over(order)).filter("not guest").select("doc_id", "text", "next_text")


def compare_versions(pairs: DataFrame) -> DataFrame:
    """The columns of op6 from (doc_id, text, next_text). Null and empty texts have the fingerprint of no passages."""
    prepare(pairs.sparkSession)
    kind = pairs.schema["doc_id"].dataType.simpleString()

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        passages = Passages()
        last: tuple[str, np.ndarray] = ("", np.zeros(0, _U))
        for batch in batches(parts, 6 << 20):
            mine, following, edited = [], [], []
            own, after = texts(batch), texts(batch, "next_text")
            changed = [t[: len(t) - len(t) // 2] + n[: len(t) // 2] for t, n in zip(own, after, strict=True)]
            for t, n, e in zip(own, after, changed, strict=True):
                mine.append(last[1] if t == last[0] else passages(t))  # mostly the next text of the row before
                last = (n, passages(n))
                following.append(last[1])
                edited.append(passages(e))
            columns = [
                batch.column("doc_id"), pa.array([len(t) for t in own], pa.int64()), pa.array([hashlib.sha256(e.encode("utf-8", "surrogatepass")).hexdigest() for e in changed], pa.string()),
                pa.array(fingerprint(mine), pa.string()), pa.array(fingerprint(edited), pa.string()), pa.array(likeness(mine, edited), pa.float64()), pa.array(likeness(mine, following), pa.float64()),
            ]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"])

    return pairs.mapInArrow(run, f"doc_id {kind}, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")


def op6(spark, sf_dir: str) -> DataFrame:
    """Fingerprints of every document and of its edited text."""
    prepare(spark)
    return compare_versions(with_next(read(spark, sf_dir, "documents")))
