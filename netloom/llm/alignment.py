"""Cross-tokenizer alignment with corpus-wide counts of linked id pairs, by minimal perfect hashing.

Pass one encodes every text with both tokenizers, aligns the tokens by the bytes they end at, and keeps each batch of
documents beside the distinct linked pairs of that batch with their counts. Pairs are dealt to shards by their
second id. In each shard the distinct pairs are gathered in a tree of unions, and a minimal perfect hash of them is
built: levels of bit arrays, in each of which the pairs without a collision get their bit, whose rank is the pair's
index. Every group of batches then adds up a dense vector of counts, indexed by hash, and the vectors are summed in a
tree. Keys stored in the order of their index verify each lookup.

Pass two brings each batch the counts of its own pairs, aligns its documents again, and looks the counts up. Ids kept
from pass one would take more room than the texts, so it keeps where tokens end, a bit for each byte and tokenizer: the
bytes between two ends name the id. Nothing that grows with the corpus is
broadcast or collected: a shard holds at most the pairs that the vocabularies allow, divided by the number of shards, and
a batch holds `batch_bytes` of text or one longer text.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netloom.llm.common import batches, prepare, read, stored, texts
from netloom.llm.packing import Encoder, byte_signs

COUNTS = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum")
NO_TOKENS = np.zeros(0, np.uint32)


class ByteLevel:
    """Ids of space + text by a byte-level vocabulary, special strings being plain text, and the bytes of each id."""

    def __init__(self, path: str):
        self.encoder = Encoder(path, 0)
        encoding = self.encoder.encoding
        self.bytes = [b""] * encoding.n_vocab
        for token in encoding.token_byte_values():
            self.bytes[encoding.encode_single_token(token)] = token
        signs = byte_signs()
        for name in self.encoder.special:
            self.bytes[encoding.encode_single_token(name)] = bytes(map(signs.__getitem__, name))

    def __call__(self, text: str) -> np.ndarray:
        encode = self.encoder.encoding.encode_to_numpy
        parts = [encode(part, disallowed_special=()) for part in self.encoder._parts(" " + text)]
        return parts[0] if len(parts) == 1 else np.concatenate(parts)


class Pieces:
    """Ids of a text by a sentence-piece vocabulary, which puts a space before it, and the bytes of each id."""

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        names = [self.model.id_to_piece(k) for k in range(self.model.get_piece_size())]
        byte = [self.model.is_byte(k) for k in range(len(names))]
        self.bytes = [bytes([int(n[3:5], 16)]) if b else n.replace("▁", " ").encode() for n, b in zip(names, byte, strict=True)]

    def __call__(self, text: str) -> list[int]:
        return self.model.encode(text)


def _lengths(table: list[bytes]) -> np.ndarray:
    return np.array([len(t) for t in table], np.int64)


class Aligner:
    """Ids of both tokenizers that spell the same bytes, and the places where tokens of both end together."""

    def __init__(self, a_path: str, b_path: str):
        self.a, self.b = ByteLevel(a_path), Pieces(b_path)
        self.named = [Named(t.bytes) for t in (self.a, self.b)]

    def encode(self, text: str | None, spelled: bool = False) -> tuple[np.ndarray, np.ndarray]:
        """Ids of both; none for an empty text or one that either spells otherwise (`spelled`: known not to be one)."""
        if not text:
            return NO_TOKENS, NO_TOKENS
        a, b = self.a(text), self.b(text)
        if not spelled:
            whole = b" " + text.encode("utf-8", "surrogatepass")
            if b"".join(map(self.b.bytes.__getitem__, b)) != whole or b"".join(map(self.a.bytes.__getitem__, a.tolist())) != whole:
                return NO_TOKENS, NO_TOKENS
        return a, np.array(b, np.uint32)

    def marks(self, ids: tuple[np.ndarray, np.ndarray], lengths: tuple[np.ndarray, np.ndarray]) -> bytes | None:
        """Where tokens of both end, a bit for each byte of space + text; null if the bytes of a token name another id, or nothing."""
        if not all(len(i) and named.sure[i].all() for i, named in zip(ids, self.named, strict=True)):
            return None
        ends = [np.cumsum(n[i]) for i, n in zip(ids, lengths, strict=True)]
        bits = np.zeros((2, int(ends[0][-1])), bool)
        for row, at in zip(bits, ends, strict=True):
            row[at - 1] = True
        return np.packbits(bits, axis=1).tobytes()

    def marked(self, text: str | None, marks: bytes | None) -> tuple[np.ndarray, np.ndarray]:
        """The ids of `encode` for a text that both spell, read from its marks; encoded again if it has none."""
        if not text or marks is None:
            return self.encode(text, spelled=True)
        whole = b" " + text.encode("utf-8", "surrogatepass")
        bits = np.unpackbits(np.frombuffer(marks, np.uint8).reshape(2, -1), axis=1, count=len(whole))
        windows = np.ndarray((len(whole),), "<u8", whole + bytes(8), strides=(1,))
        return tuple(named(whole, windows, np.flatnonzero(row) + 1) for row, named in zip(bits, self.named, strict=True))


class Named:
    """The id of the bytes of a token. Up to seven bytes are one number, looked up in a table of hashes; the rest in a dictionary."""

    BITS, FACTOR = 20, np.uint64(0x9E3779B97F4A7C15)
    MASKS = np.array([(1 << 8 * n) - 1 for n in range(8)], np.uint64)

    def __init__(self, table: list[bytes]):
        self.ids = {t: k for k, t in enumerate(table)}
        #: whether the bytes of a token name that token
        self.sure = np.array([bool(t) and self.ids[t] == k for k, t in enumerate(table)])
        self.keys = np.array([int.from_bytes(t, "little") | len(t) << 56 if len(t) < 8 else 0 for t in table], np.uint64)
        self.places = np.zeros(1 << self.BITS, np.int64)
        short = np.flatnonzero(self.sure & (self.keys > 0))
        self.places[self._hash(self.keys[short])] = short

    def _hash(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * self.FACTOR) >> np.uint64(64 - self.BITS)).astype(np.int64)

    def __call__(self, text: bytes, windows: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Ids of the tokens of `text` that end there; `windows` are the eight bytes from each place on, as a number."""
        starts = np.concatenate([[0], ends[:-1]])
        lengths = ends - starts
        short = np.minimum(lengths, 7)
        keys = (windows[starts] & self.MASKS[short]) | (short.astype(np.uint64) << np.uint64(56))
        out = self.places[self._hash(keys)]
        rest = np.flatnonzero((self.keys[out] != keys) | (lengths > 7))
        out[rest] = [self.ids[text[i:j]] for i, j in zip(starts[rest].tolist(), ends[rest].tolist(), strict=True)]
        return out.astype(np.uint32)


def common_ends(a: np.ndarray, b: np.ndarray, a_lengths: np.ndarray, b_lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions in both of the tokens that end together: their links, in order."""
    ends_a, ends_b = np.cumsum(a_lengths[a]), np.cumsum(b_lengths[b])
    here = np.zeros(int(ends_a[-1]) + 1 if len(a) else 1, bool)
    here[ends_a] = True
    at_b = np.flatnonzero(here[ends_b])
    here[ends_a] = False
    here[ends_b] = True
    return np.flatnonzero(here[ends_a]), at_b


def pair_keys(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return (b.astype(np.int64) << 32) | a.astype(np.int64)


class GroupText:
    """The digest of `a1,a2|b1;a3|b2,b3`: ids of each group in decimal, from tables of each id with what follows it."""

    def __init__(self, ids: int):
        self.table = [b"%d%s" % (k, sign) for sign in (b",", b"|", b";", b"") for k in range(ids)]
        self.ids = ids

    def digest(self, a: np.ndarray, b: np.ndarray, at_a: np.ndarray, at_b: np.ndarray) -> str:
        if not len(a):
            return ""
        sign_a, sign_b = np.zeros(len(a), np.int64), np.zeros(len(b), np.int64)
        sign_a[at_a], sign_b[at_b] = 1, 2
        sign_b[-1] = 3
        codes = np.empty(len(a) + len(b), np.int64)
        # ids of a group stand after all ids of earlier groups of both sides
        group_a = np.searchsorted(at_a, np.arange(len(a)))
        group_b = np.searchsorted(at_b, np.arange(len(b)))
        before_b = np.concatenate([[0], at_b + 1])
        codes[np.arange(len(a)) + before_b[group_a]] = a + self.ids * sign_a
        codes[np.arange(len(b)) + at_a[group_b] + 1] = b + self.ids * sign_b
        h = hashlib.sha256()
        for at in range(0, len(codes), 1 << 20):
            h.update(b"".join(map(self.table.__getitem__, codes[at : at + (1 << 20)].tolist())))
        return h.hexdigest()


def _mix(keys: np.ndarray, level: int) -> np.ndarray:
    """64 well-mixed bits of keys, different on each level."""
    with np.errstate(over="ignore"):
        x = keys.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15) * np.uint64(2 * level + 1)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


class PerfectHash:
    """A minimal perfect hash of distinct keys: indices 0 to n - 1, with the keys in that order to verify lookups."""

    LEVELS = 64

    def __init__(self, keys: np.ndarray, room: float = 1.5):
        self.bits: list[np.ndarray] = []
        left = keys
        while len(left):
            if len(self.bits) == self.LEVELS:
                raise ValueError("repeated keys")
            size = max(8, int(room * len(left)))
            at = (_mix(left, len(self.bits)) % np.uint64(size)).astype(np.int64)
            alone = np.bincount(at, minlength=size) == 1
            self.bits.append(alone)
            left = left[~alone[at]]
        self._rank()
        self.keys = np.empty(len(keys), np.int64)
        self.keys[self._index(keys)] = keys

    def _rank(self) -> None:
        totals = [int(b.sum()) for b in self.bits]
        before = np.concatenate([[0], np.cumsum(totals)]).astype(np.int64)
        self.ranks = [before[k] + np.cumsum(b) - b for k, b in enumerate(self.bits)]

    def _index(self, keys: np.ndarray) -> np.ndarray:
        out, left = np.full(len(keys), -1, np.int64), np.arange(len(keys))
        for level, (bits, ranks) in enumerate(zip(self.bits, self.ranks, strict=True)):
            at = (_mix(keys[left], level) % np.uint64(len(bits))).astype(np.int64)
            hit = bits[at]
            out[left[hit]] = ranks[at[hit]]
            left = left[~hit]
        return out

    def lookup(self, keys: np.ndarray) -> np.ndarray:
        """The index of each key; -1 for a key that is not in the set."""
        index = self._index(keys)
        if len(self.keys):
            index[self.keys[index] != keys] = -1
        return index

    def to_row(self) -> dict:
        return {"bits": [np.packbits(b).tobytes() for b in self.bits], "sizes": [len(b) for b in self.bits], "keys": self.keys.tobytes()}

    @classmethod
    def from_row(cls, row: dict) -> PerfectHash:
        self = cls.__new__(cls)
        self.bits = [np.unpackbits(np.frombuffer(b, np.uint8), count=n).astype(bool) for b, n in zip(row["bits"], row["sizes"], strict=True)]
        self.keys = np.frombuffer(row["keys"], np.int64)
        self._rank()
        return self


HASH = "bits array<binary>, sizes array<long>, keys binary"


def encode(docs: DataFrame, a_path: str, b_path: str, shards: int, batch_bytes: int) -> DataFrame:
    """Pass one: rows (batch, doc_id, text, marks) of documents, the text null if it has no tokens, and rows (batch, shard, keys, counts) of the pairs of a batch."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        aligner, lengths, _ = _tables(a_path, b_path)
        number = (TaskContext.get().partitionId() << 32) - 1
        for batch in batches(parts, batch_bytes):
            number += 1
            keys, kept, marks = [], [], []
            for text in texts(batch):
                a, b = aligner.encode(text)
                kept.append(text if len(a) else None)
                marks.append(aligner.marks((a, b), lengths))
                at_a, at_b = common_ends(a, b, *lengths)
                keys.append(pair_keys(a[at_a], b[at_b]))
            found, counts = np.unique(np.concatenate(keys) if keys else np.zeros(0, np.int64), return_counts=True)
            n, none = batch.num_rows, pa.nulls
            yield pa.RecordBatch.from_arrays(
                [pa.array([number] * n, pa.int64()), batch.column("doc_id"), pa.array(kept, pa.string()), pa.array(marks, pa.binary()), none(n, pa.int64()), none(n, pa.binary()), none(n, pa.binary())], names=names
            )
            shard = (_mix(found >> 32, 99) % np.uint64(shards)).astype(np.int64)
            order = np.argsort(shard, kind="stable")
            cuts = np.flatnonzero(np.diff(shard[order])) + 1
            held = [p for p in np.split(order, cuts) if len(p)]
            m = len(held)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([number] * m, pa.int64()),
                    none(m, batch.column("doc_id").type),
                    none(m, pa.string()),
                    none(m, pa.binary()),
                    pa.array([int(shard[p[0]]) for p in held], pa.int64()),
                    pa.array([found[p].tobytes() for p in held], pa.binary()),
                    pa.array([counts[p].astype(np.int64).tobytes() for p in held], pa.binary()),
                ],
                names=names,
            )

    names = ["batch", "doc_id", "text", "marks", "shard", "keys", "counts"]
    return docs.select("doc_id", "text").mapInArrow(run, f"batch long, doc_id {kind}, text string, marks binary, shard long, keys binary, counts binary")


def longs(column: pa.ChunkedArray) -> list[np.ndarray]:
    return [np.frombuffer(x, np.int64) for x in column.to_pylist()]


def union_tree(pairs: DataFrame, parts: int, fan: int) -> DataFrame:
    """(shard, keys): the distinct keys of each shard, united in groups of `fan` level by level."""

    def run(table: pa.Table) -> pa.Table:
        keys = np.unique(np.concatenate(longs(table.column("keys"))))
        return pa.table({"shard": table.column("shard")[:1], "part": table.column("part")[:1], "keys": pa.array([keys.tobytes()], pa.binary())})

    level = pairs.select("shard", "part", "keys")
    while True:
        level = level.groupBy("shard", "part").applyInArrow(run, "shard long, part long, keys binary")
        if parts == 1:
            return level.select("shard", "keys")
        parts = -(-parts // fan)
        level = level.withColumn("part", F.expr(f"part div {fan}"))


def build(keys: DataFrame) -> DataFrame:
    """(shard, hash): a minimal perfect hash for each shard."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts:
            for shard, blob in zip(batch.column("shard").to_pylist(), batch.column("keys").to_pylist(), strict=True):
                row = {"shard": shard} | PerfectHash(np.frombuffer(blob, np.int64)).to_row()
                yield pa.RecordBatch.from_pylist([row], schema=pa.schema([("shard", pa.int64()), ("bits", pa.list_(pa.binary())), ("sizes", pa.list_(pa.int64())), ("keys", pa.binary())]))

    return keys.mapInArrow(run, f"shard long, {HASH}")


def dense_counts(pairs: DataFrame, hashes: DataFrame, parts: int, fan: int) -> DataFrame:
    """(shard, vector): counts of all pairs of a shard, indexed by hash, as vectors of groups of batches summed in a tree."""

    def count(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows:
            return pa.table({"shard": pa.array([], pa.int64()), "part": pa.array([], pa.int64()), "vector": pa.array([], pa.binary())})
        perfect = PerfectHash.from_row(right.slice(0, 1).to_pylist()[0])
        vector = np.zeros(len(perfect.keys), np.int64)
        for keys, counts in zip(longs(left.column("keys")), longs(left.column("counts")), strict=True):
            at = perfect.lookup(keys)
            if (at < 0).any():
                raise ValueError("a pair is missing from the hash of its shard")
            vector[at] += counts
        return pa.table({"shard": left.column("shard")[:1], "part": left.column("part")[:1], "vector": pa.array([vector.tobytes()], pa.binary())})

    def add(table: pa.Table) -> pa.Table:
        total = np.sum(longs(table.column("vector")), axis=0)
        return pa.table({"shard": table.column("shard")[:1], "part": table.column("part")[:1], "vector": pa.array([total.tobytes()], pa.binary())})

    everywhere = hashes.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(parts - 1).cast("long"))))
    level = pairs.select("shard", "part", "keys", "counts").groupBy("shard", "part").cogroup(everywhere.groupBy("shard", "part")).applyInArrow(count, "shard long, part long, vector binary")
    while parts > 1:
        parts = -(-parts // fan)
        level = level.withColumn("part", F.expr(f"part div {fan}")).groupBy("shard", "part").applyInArrow(add, "shard long, part long, vector binary")
    return level.select("shard", "vector")


def counted(hashes: DataFrame, vectors: DataFrame) -> DataFrame:
    """(shard, hash, vector, best): with the highest count that the second id of each key has; all pairs of an id are in one shard."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts:
            best = []
            for keys, vector in zip(longs(batch.column("keys")), longs(batch.column("vector")), strict=True):
                ids, place = np.unique(keys >> 32, return_inverse=True)
                top = np.zeros(len(ids), np.int64)
                np.maximum.at(top, place, vector)
                best.append(top[place].tobytes())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(best, pa.binary())], names=[*batch.schema.names, "best"])

    return hashes.join(vectors, "shard").select("shard", "bits", "sizes", "keys", "vector").mapInArrow(run, f"shard long, {HASH}, vector binary, best binary")


def deliver(pairs: DataFrame, table: DataFrame, parts: int) -> DataFrame:
    """(batch, keys, counts, best): the corpus-wide counts of each batch's own pairs, looked up by hash."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        counts, best = [], []
        if left.num_rows:
            row = right.slice(0, 1).to_pylist()[0]
            perfect, vector, top = PerfectHash.from_row(row), np.frombuffer(row["vector"], np.int64), np.frombuffer(row["best"], np.int64)
            for keys in longs(left.column("keys")):
                at = perfect.lookup(keys)
                counts.append(vector[at].tobytes())
                best.append(top[at].tobytes())
        return pa.table({"batch": left.column("batch"), "keys": left.column("keys"), "counts": pa.array(counts, pa.binary()), "best": pa.array(best, pa.binary())})

    everywhere = table.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(parts - 1).cast("long"))))
    return pairs.select("shard", "part", "batch", "keys").groupBy("shard", "part").cogroup(everywhere.groupBy("shard", "part")).applyInArrow(run, "batch long, keys binary, counts binary, best binary")


def align(docs: DataFrame, a_path: str, b_path: str, batch_bytes: int = 4 << 20, fan: int = 16) -> DataFrame:
    """One row per row of `docs`: doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256.

    Tokens of `a_path` (byte-level, of space + text) and `b_path` (pieces) that end at the same byte are linked, and these
    places cut the tokens into groups. `count_sum` adds, over a text's links, how often the corpus links that pair of
    ids; `n_best` counts the links whose pair is the one linked most often for its second id, or as often. A text that is
    null or empty, or that a tokenizer does not spell back, has no tokens: zeros, and an empty digest. Repeated rows
    count as often as they occur. An empty table gives no rows. Only doc_id and text are read.
    """
    spark = prepare(docs.sparkSession)
    kind = docs.schema["doc_id"].dataType
    size = int(docs.agg(F.sum(F.octet_length("text") + 4)).first()[0] or 0)
    shards = min(4096, max(1, -(-size // (32 << 20))))
    first = stored(encode(docs.select("doc_id", "text"), a_path, b_path, shards, batch_bytes), "align-encoded")
    pairs = first.filter("keys is not null")
    most = pairs.agg(F.count_distinct("batch")).first()[0]
    parts = max(1, -(-most // fan))
    pairs = pairs.select("batch", "shard", F.pmod(F.xxhash64("batch"), F.lit(parts)).cast("long").alias("part"), "keys", "counts")
    hashes = stored(build(union_tree(pairs, parts, fan)), "align-hashes")
    vectors = stored(dense_counts(pairs, hashes, parts, fan), "align-vectors")
    delivered = deliver(pairs, stored(counted(hashes, vectors), "align-counts"), parts)
    schema = pa.schema([("doc_id", _arrow(spark, docs)), *((c, pa.int64()) for c in COUNTS), ("groups_sha256", pa.string())])

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        aligner, lengths, writer = _tables(a_path, b_path)
        keys, counts, best = (np.concatenate(longs(right.column(c))) if right.num_rows else np.zeros(0, np.int64) for c in ("keys", "counts", "best"))
        order = np.argsort(keys)
        keys, counts, best = keys[order], counts[order], best[order]
        columns: dict[str, list] = {c: [] for c in (*COUNTS, "groups_sha256")}
        for text, marks in zip(left.column("text").to_pylist(), left.column("marks").to_pylist(), strict=True):
            a, b = aligner.marked(text, marks)
            at_a, at_b = common_ends(a, b, *lengths)
            at = np.searchsorted(keys, pair_keys(a[at_a], b[at_b]))
            values = (len(a), len(b), len(at_a), len(at_a), int((counts[at] == best[at]).sum()), int(counts[at].sum()), writer.digest(a, b, at_a, at_b))
            for column, value in zip(columns.values(), values, strict=True):
                column.append(value)
        return pa.Table.from_arrays([left.column("doc_id").combine_chunks() if left.num_rows else pa.array([], schema.field("doc_id").type), *(pa.array(v, schema.field(c).type) for c, v in columns.items())], schema=schema)

    texts_of = first.filter("keys is null").select("batch", "doc_id", "text", "marks")
    return texts_of.groupBy("batch").cogroup(delivered.groupBy("batch")).applyInArrow(run, f"doc_id {kind.simpleString()}, {', '.join(f'{c} long' for c in COUNTS)}, groups_sha256 string")


def _arrow(spark, docs: DataFrame) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(docs.schema["doc_id"].dataType)


_held: dict[tuple[str, str], tuple] = {}


def _tables(a_path: str, b_path: str) -> tuple[Aligner, tuple[np.ndarray, np.ndarray], GroupText]:
    """The aligner, byte lengths of the ids of both vocabularies and the table of decimal ids, once per worker."""
    if (a_path, b_path) not in _held:
        aligner = Aligner(a_path, b_path)
        _held[a_path, b_path] = aligner, (_lengths(aligner.a.bytes), _lengths(aligner.b.bytes)), GroupText(max(len(aligner.a.bytes), len(aligner.b.bytes)))
    return _held[a_path, b_path]


def op11(spark, sf_dir: str) -> DataFrame:
    """Alignment of the tokens of every document."""
    import public_tokenizers as public

    return align(read(spark, sf_dir, "documents"), public.path("byte_bpe_50k.json"), public.path("piece_bpe_32k.model"))
