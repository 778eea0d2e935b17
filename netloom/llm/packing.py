"""Sequence packing: first-fit decreasing over a tournament tree of bin capacities, in randomised groups.

Whole sequences of a document fill bins of their own. What is left of each document is packed by first-fit decreasing.
Last, the emptiest bins are dissolved: their pieces are cut to fill the gaps of the others, so a group ends with one
partly filled bin and gaps shorter than `min_cut`.
"""

from __future__ import annotations

import json
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netloom.llm.common import batches, prepare, read, texts

PIECES = "start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


#: Fixed value: how byte-level vocabularies split a text before merging.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def byte_signs() -> dict[str, int]:
    """The sign that stands for each byte in a byte-level vocabulary: itself if it prints, else the next of those from 256 on."""
    prints = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in prints]
    return {chr(b): b for b in prints} | {chr(256 + k): b for k, b in enumerate(rest)}


class Encoder:
    """Token ids of texts: those of the tokenizer file, by a faster encoder over its vocabulary.

    A very long text is encoded in parts. No token goes on past the start of a run of white space, so a text can be cut before
    a space that has no white space beside it.
    """

    def __init__(self, path: str, end: int, part: int = 1 << 20):
        import tiktoken

        with open(path, encoding="utf-8") as f:
            given = json.load(f)
        model, split = given["model"], given["pre_tokenizer"]
        merged = [model["vocab"]["".join(m.split(" ") if isinstance(m, str) else m)] for m in model["merges"]]
        if model["type"] != "BPE" or split["type"] != "ByteLevel" or split["add_prefix_space"] or given["normalizer"] or merged != sorted(merged):
            raise ValueError("a byte-level BPE vocabulary whose ids follow the order of merges is needed")
        signs = byte_signs()
        ranks = {bytes(map(signs.__getitem__, token)): k for token, k in model["vocab"].items()}
        special = {t["content"]: t["id"] for t in given["added_tokens"]}
        for name in special:
            ranks.pop(name.encode(), None)
        self.encoding = tiktoken.Encoding("vocabulary", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens=special)
        self.special = tuple(special)
        self.dtype = np.dtype("<u2" if self.encoding.n_vocab <= 1 << 16 else "<u4")
        self.code = "H" if self.dtype.itemsize == 2 else "I"
        self.end, self.part = end, part

    def _parts(self, text: str) -> Iterator[str]:
        """The text in parts of bounded length, each but the first beginning with a space where a cut is safe."""
        at = 0
        while len(text) - at > self.part:
            cut = text.find(" ", at + self.part)
            while cut > 0 and (text[cut - 1].isspace() or text[cut + 1 : cut + 2].isspace()):
                cut = text.find(" ", cut + 1)
            if cut < 0:
                break
            yield text[at:cut]
            at = cut
        yield text[at:]

    def __call__(self, text: str) -> np.ndarray:
        ids = array(self.code)
        for part in self._parts(text):
            if any(name in part for name in self.special):
                ids.extend(self.encoding.encode(part, allowed_special="all"))
            else:
                ids.extend(self.encoding.encode_ordinary(part))
        ids.append(self.end)
        return np.frombuffer(ids, self.dtype)


class Tournament:
    """Free room of bins in a complete binary tree whose inner nodes hold the larger of two children."""

    def __init__(self, bins: int, room: int):
        self.leaves = 1 << max(0, bins - 1).bit_length()
        self.best = [room] * (2 * self.leaves)

    def first(self, length: int) -> int:
        """The first bin with that much room, which it then lacks."""
        best, at = self.best, 1
        while at < self.leaves:
            at *= 2
            if best[at] < length:
                at += 1
        found = at - self.leaves
        best[at] -= length
        at //= 2
        while at:
            most = max(best[2 * at], best[2 * at + 1])
            if best[at] == most:
                break
            best[at] = most
            at //= 2
        return found


def pack_lengths(lengths: list[int], width: int, min_cut: int = 16) -> list[list[tuple[int, int, int]]]:
    """Bins of (item, first, length): items in falling order of length, each first where it fits; then gaps filled by cutting."""
    tree = Tournament(len(lengths), width)
    bins: list[list[tuple[int, int, int]]] = []
    for item, length in enumerate(lengths):
        at = tree.first(length)
        if at == len(bins):
            bins.append([])
        bins[at].append((item, 0, length))
    used = [sum(p[2] for p in b) for b in bins]
    order = sorted(range(len(bins)), key=lambda i: (used[i], i))
    low, high = 0, len(order) - 1
    while low < high:
        giver, taker = order[low], order[high]
        room = width - used[taker]
        if room < min_cut:
            high -= 1
            continue
        item, first, length = bins[giver].pop()
        moved = min(room, length)
        bins[taker].append((item, first, moved))
        used[taker] += moved
        used[giver] -= moved
        if moved < length:
            bins[giver].append((item, first + moved, length - moved))
        if not bins[giver]:
            low += 1
    return [b for b in bins if b]


def pack(docs: DataFrame, tokenizer: str, width: int = 1024, end: int = 0, group_bytes: int = 8 << 20, min_cut: int = 16, seed: int = 11, keep_ids: bool = True) -> DataFrame:
    """Pieces of every text: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset (and `ids`, little-endian).

    `group_bytes` is the text of one group on average: pieces are dealt to groups by a hash of (doc_id, start, ids), so a
    very long text spreads over many. A null or empty text is its end id alone. Repeated rows are packed as often as
    they occur; equal pieces of equal ids share a group. Within a group, ties go by doc_id, start and ids. Only doc_id
    and text are read. An empty table gives no pieces.
    """
    prepare(docs.sparkSession)
    doc_id = docs.schema["doc_id"].dataType.simpleString()
    size = docs.agg(F.sum(F.octet_length("text") + 4)).first()[0] or 0
    groups = max(1, -(-int(size) // group_bytes))

    def tokens(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(tokenizer, end)
        for batch in batches(parts, 4 << 20):
            ids = [encoder(t) for t in texts(batch)]
            cuts = [(k, a) for k, x in enumerate(ids) for a in range(0, len(x), width)]
            rows = pa.array([k for k, _ in cuts], pa.int64())
            pieces = [ids[k][a : a + width] for k, a in cuts]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").take(rows), pa.array([a for _, a in cuts], pa.int64()), pa.array([len(ids[k]) for k, _ in cuts], pa.int64()), pa.array([p.tobytes() for p in pieces], pa.binary())],
                names=["doc_id", "start", "doc_tokens", "piece"],
            )

    wide = Encoder(tokenizer, end).dtype

    def fill(table: pa.Table) -> pa.Table:
        group = table.column("group")[0].as_py()
        table = table.sort_by([("length", "descending"), ("doc_id", "ascending"), ("start", "ascending"), ("piece", "ascending")])
        pieces = [np.frombuffer(p, wide) for p in table.column("piece").to_pylist()]
        starts = table.column("start").to_pylist()
        rows, start, length, crc, sequence, offset, ids = [], [], [], [], [], [], []
        for k, held in enumerate(pack_lengths([len(p) for p in pieces], width, min_cut)):
            at = 0
            for item, first, n in held:
                cut = pieces[item][first : first + n].astype("<u4").tobytes()
                rows.append(item)
                start.append(starts[item] + first)
                length.append(n)
                crc.append(zlib.crc32(cut))
                sequence.append((group << 32) + k)
                offset.append(at)
                ids.append(cut if keep_ids else None)
                at += n
        taken = table.take(pa.array(rows, pa.int64()))
        columns = {"doc_id": taken.column("doc_id"), "start": pa.array(start, pa.int64()), "length": pa.array(length, pa.int64()), "ids_crc32": pa.array(crc, pa.int64()), "doc_tokens": taken.column("doc_tokens")}
        columns |= {"sequence_id": pa.array(sequence, pa.int64()), "offset": pa.array(offset, pa.int64())}
        return pa.table(columns | ({"ids": pa.array(ids, pa.binary())} if keep_ids else {}))

    cut = docs.select("doc_id", "text").mapInArrow(tokens, f"doc_id {doc_id}, start long, doc_tokens long, piece binary")
    dealt = cut.withColumn("length", F.octet_length("piece")).withColumn("group", F.pmod(F.xxhash64("doc_id", "start", "piece", F.lit(seed)), F.lit(groups).cast("long")))
    return dealt.groupBy("group").applyInArrow(fill, f"doc_id {doc_id}, {PIECES}" + (", ids binary" if keep_ids else ""))


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op1(spark, sf_dir: str) -> DataFrame:
    """All documents in sequences of at most 1024 tokens."""
    return pack(read(spark, sf_dir, "documents"), tokenizer_path(), keep_ids=False)
