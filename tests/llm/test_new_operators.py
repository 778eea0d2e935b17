"""Token alignment, SimHash near duplicates and conversation repair against brute force; mended cases of earlier operators."""

import base64
import hashlib
import heapq
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from netloom.llm import alignment, exact_topk, fingerprints, ngram_join, queries, repair, reply_trees, simhash, stages
from netloom.llm.common import prepare

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, fp string, a string, key string, cell int, batch int, `score` string"


def paths():
    import public_tokenizers as public

    return public.path("byte_bpe_50k.json"), public.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def docs(spark):
    """Null ids and texts, empty, blank and long texts, repeated rows, near copies, control strings, and clashing names."""
    prepare(spark)
    r = random.Random(5)
    base = ["".join(r.choice("abcdefgh") for _ in range(r.randint(2, 6))) for _ in range(300)]
    rows = [(k, " ".join(base[k % 7 : 200 + k % 5] + [f"end{k % 11}"])) for k in range(60)] + [(7, " ".join(base[:40]))] * 3
    rows += [(100, None), (101, ""), (102, " \n\t "), (None, "null id one"), (None, "null id one"), (103, "one"), (104, "ONE"), (105, " ".join(base * 40)), (106, "a ▁ b"), (107, "ends in a space "), (108, "<|endoftext|> <s> <0x0A>\x00é漢😀"), (1 << 60, "far id")]
    return spark.createDataFrame([(*x, "mine", "b", "c", 1, 2, "own") for x in rows], SCHEMA)


def tokens(text, tok, pieces, signs):
    if not text:
        return [], [], [], []
    e = tok.encode(" " + text, add_special_tokens=False)
    spelled_a, ids_b = [bytes(signs[c] for c in t) for t in e.tokens], pieces.encode(text)
    spelled_b = []
    for i in ids_b:
        p = pieces.id_to_piece(i)
        m = re.fullmatch("<0x([0-9A-F]{2})>", p)
        spelled_b.append(bytes([int(m[1], 16)]) if m else p.replace("▁", " ").encode())
    whole = (" " + text).encode()
    if b"".join(spelled_a) != whole or b"".join(spelled_b) != whole:
        return [], [], [], []
    return e.ids, ids_b, np.cumsum([len(x) for x in spelled_a]).tolist(), np.cumsum([len(x) for x in spelled_b]).tolist()


def aligned(rows):
    """Rows of the alignment by the tokenizers themselves and dictionaries."""
    import sentencepiece
    from tokenizers import Tokenizer

    from netloom.llm.packing import byte_signs

    a_path, b_path = paths()
    tok = Tokenizer.from_file(a_path)
    tok.encode_special_tokens = True
    pieces, signs = sentencepiece.SentencePieceProcessor(model_file=b_path), byte_signs()
    encoded, counts, best, out = [(i, tokens(t, tok, pieces, signs)) for i, t in rows], Counter(), Counter(), []
    cuts = []
    for _, (_a, _b, ends_a, ends_b) in encoded:
        at = {e: k for k, e in enumerate(ends_a)}
        cuts.append([(at[e], k) for k, e in enumerate(ends_b) if e in at])
    for (_, (a, b, *_rest)), linked in zip(encoded, cuts, strict=True):
        counts.update((a[x], b[y]) for x, y in linked)
    for (_, y), n in counts.items():
        best[y] = max(best[y], n)
    for (i, (a, b, *_rest)), linked in zip(encoded, cuts, strict=True):
        groups, last = [], (0, 0)
        for x, y in linked:
            groups.append(",".join(map(str, a[last[0] : x + 1])) + "|" + ",".join(map(str, b[last[1] : y + 1])))
            last = (x + 1, y + 1)
        pairs = [(a[x], b[y]) for x, y in linked]
        out.append((i, len(a), len(b), len(linked), len(linked), sum(counts[p] == best[p[1]] for p in pairs), sum(counts[p] for p in pairs), hashlib.sha256(";".join(groups).encode()).hexdigest() if a else ""))
    return out


def by_text(rows):
    return sorted(map(tuple, rows), key=repr)


def test_alignment_equals_brute_force(spark, docs):
    given = [(r.doc_id, r.text) for r in docs.collect()]
    for options in ({}, {"batch_bytes": 3000, "fan": 2}):  # one batch of each partition; many batches in trees of several levels
        got = alignment.align(docs.repartition(3), *paths(), **options).collect()
        assert by_text(got) == by_text(aligned(given))
    assert alignment.align(docs.limit(0), *paths()).count() == 0


def test_registered_alignment(spark):
    rows = queries.REGISTRY["op11_alignment"](spark, SF)
    assert rows.columns == ["doc_id", *alignment.COUNTS, "groups_sha256"]
    given = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    assert by_text(rows.collect()) == by_text(aligned(given))


def test_encoders_spell_as_the_tokenizers(spark):
    import sentencepiece
    from tokenizers import Tokenizer

    from netloom.llm.packing import byte_signs

    a_path, b_path = paths()
    aligner, r = alignment.Aligner(a_path, b_path), random.Random(2)
    tok = Tokenizer.from_file(a_path)
    tok.encode_special_tokens = True
    pieces, signs = sentencepiece.SentencePieceProcessor(model_file=b_path), byte_signs()
    signs_of = ["a", "B", "the", " ", "  ", "\n", "\t", " ", "é", "漢", "😀", "▁", "<|endoftext|>", "<s>", "<unk>", "<0x0A>", "'s", "12", "\x00", "​", "ﬁ", "!?", "\r\n"]
    for _ in range(1500):
        text = "".join(r.choice(signs_of) for _ in range(r.randint(0, 30)))
        a, b = aligner.encode(text)
        want = tokens(text, tok, pieces, signs)
        assert a.tolist() == want[0] and b.tolist() == want[1], repr(text)


def test_ids_are_read_from_the_ends_of_tokens():
    """The second pass takes ids from the bytes between token ends, also where bytes name two ids (`a`, `<0x61>`), and else encodes."""
    aligner, r = alignment.Aligner(*paths()), random.Random(3)
    lengths = tuple(np.array([len(t) for t in side.bytes], np.int64) for side in (aligner.a, aligner.b))
    signs_of = ["a", "B", "the", " ", "\n", "é", "漢", "😀", "<|endoftext|>", "<0x0A>", "12", "\x00", "internationalization", "!?", "\r\n", "\x01\x02"]
    texts, kept = ["".join(r.choice(signs_of) for _ in range(r.randint(1, 40))) for _ in range(500)], 0
    for text in texts:
        a, b = aligner.encode(text)
        marks = aligner.marks((a, b), lengths)
        kept += marks is not None
        if len(a):
            got = aligner.marked(text, marks)
            assert got[0].tolist() == a.tolist() and got[1].tolist() == b.tolist(), repr(text)
    assert kept > 300
    marks = aligner.marks(aligner.encode("the end"), lengths)
    aligner.a = aligner.b = None  # nothing is encoded again
    assert len(aligner.marked("the end", marks)[0]) == 2
    assert aligner.marks((np.zeros(0, np.uint32), np.zeros(0, np.uint32)), lengths) is None


def test_perfect_hash():
    keys = np.unique(np.random.default_rng(0).integers(-(1 << 62), 1 << 62, 5000))
    made = alignment.PerfectHash(keys)
    again = alignment.PerfectHash.from_row(made.to_row())
    assert sorted(again.lookup(keys).tolist()) == list(range(len(keys)))
    assert (again.lookup(keys + 1)[~np.isin(keys + 1, keys)] == -1).all()
    assert alignment.PerfectHash(np.zeros(0, np.int64)).lookup(keys).max() == -1


def plain_simhash(text):
    words = [w for w in re.split("[\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) if w]
    shingles = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << j for j in range(64) if 2 * sum(h >> j & 1 for h in hashes) > len(hashes))


def components_of(prints, ids, bits):
    parent = list(range(len(prints)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(prints)):
        for j in np.flatnonzero(np.bitwise_count(prints[i] ^ prints[i + 1 :]) <= bits) + i + 1:
            a, b = find(i), find(int(j))
            parent[max(a, b)] = min(a, b)
    least = {}
    for k, i in enumerate(ids):
        if i is not None:
            least[find(k)] = min(i, least.get(find(k), i))
    return [least.get(find(k)) for k in range(len(prints))]


def test_simhash_equals_brute_force(spark, docs):
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    prints = np.array([plain_simhash(t) for _, t in rows], np.uint64)
    want = sorted(((i, f"{int(p):016x}", c) for (i, _), p, c in zip(rows, prints, components_of(prints, [i for i, _ in rows], 4), strict=True)), key=repr)
    for block in (4096, 2):  # one task for a cell; pairs of blocks
        assert by_text(simhash.near_duplicates(docs, block=block).collect()) == want
    assert simhash.near_duplicates(docs.limit(0)).count() == 0
    assert simhash.simhash("x y " * 20_000) == plain_simhash("x y " * 20_000)


def test_registered_simhash(spark):
    got = queries.REGISTRY["op12_simhash"](spark, SF)
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    prints = np.array([plain_simhash(t) for _, t in rows], np.uint64)
    assert by_text(got.collect()) == sorted(((i, f"{int(p):016x}", c) for (i, _), p, c in zip(rows, prints, components_of(prints, [i for i, _ in rows], 4), strict=True)), key=repr)


@pytest.mark.parametrize("bits", [0, 1, 3, 4, 5])
def test_grid_misses_no_link(spark, bits):
    rng = np.random.default_rng(bits)
    base = rng.integers(0, 1 << 64, 40, dtype=np.uint64)
    prints = list(base)
    for p in base:  # chains that move by a few bits at a time
        for _ in range(25):
            for j in rng.choice(64, rng.integers(1, bits + 2), replace=False):
                p ^= np.uint64(1) << np.uint64(j)
            prints.append(p)
    prints = np.unique(np.array(prints, np.uint64))
    nodes = spark.createDataFrame([(int(p),) for p in prints.view(np.int64)], "fp long")
    for block in (4096, 4):
        roots = {r.node: r.root for r in ngram_join.components(simhash.links(nodes, bits, block)).collect()}
        got = [roots.get(int(p), int(p)) for p in prints.view(np.int64)]
        want = components_of(prints, range(len(prints)), bits)
        assert len(set(zip(got, want, strict=True))) == len(set(got)) == len(set(want))


def damaged(rows):
    out = []
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if kind:
            text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
            out += [(conv, turn, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
    return out


def repaired(rows):
    """Report and rows of one conversation, by a best-first search over single edits."""
    seen, faults = set(), []
    for _, _, role, text in rows:
        core = text.strip(" \t\n\x0b\x0c\r")
        faults.append("blank" if not core else "duplicate" if (role, text) in seen else "truncated" if core[-1] not in ".!?" else None)
        seen.add((role, text))
    turns = [t for _, t, _, _ in rows if t is not None]
    initials = [r[:1] for _, _, r, _ in rows]
    steps, names = {0: {"s": 1, "u": 2}, 1: {"u": 2}, 2: {"a": 3}, 3: {"u": 2}}, {"u": "user", "a": "assistant"}
    heap, done = [(0, "", 0, 0, ())], set()
    while True:
        cost, audit, i, at, out = heapq.heappop(heap)
        if i == len(rows) and at in (0, 3):
            break
        if (i, at) in done:
            continue
        done.add((i, at))
        for to, then in steps[at].items():
            if to in names:
                heapq.heappush(heap, (cost + 2, audit + "I", i, then, (*out, (names[to], ""))))
        if i < len(rows):
            heapq.heappush(heap, (cost + 3, audit + "D", i + 1, at, out))
            more = int(faults[i] == "truncated")
            for to, then in steps[at].items() if faults[i] not in ("blank", "duplicate") else ():
                if to == initials[i]:
                    heapq.heappush(heap, (cost + more, audit + "K", i + 1, then, (*out, rows[i][2:])))
                if to in names:
                    heapq.heappush(heap, (cost + more + 2, audit + "R", i + 1, then, (*out, (names[to], rows[i][3]))))
    text = "\n".join(f"{r}:{t}" for r, t in out)
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:], strict=False))
    return (gaps, *(faults.count(f) for f in ("blank", "duplicate", "truncated")), illegal, cost, audit, hashlib.sha256(text.encode()).hexdigest())


def in_order(rows):
    return sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[2], r[3]))


def test_repair_equals_best_first_search(spark):
    prepare(spark)
    r = random.Random(6)
    rows = []
    for conv in [*range(80), None]:
        for turn in range(r.randint(1, 9)):
            for _ in range(r.choice([1, 1, 1, 2])):
                rows.append((conv, r.choice([turn, turn + r.randint(0, 3), None]), r.choice(["user", "assistant", "system", "tool", "", None]), r.choice(["Hi.", "Hi", "", " \n", "no end", "End! ", "é?\n", None])))
    rows += [(999, k // 2, "user" if k % 3 else "assistant", f"t{k % 50}" + "." * (k % 2)) for k in range(700)]
    table = spark.createDataFrame([(*x, "mine", 1) for x in rows], "conv_id long, turn long, role string, text string, key string, piece int")
    plain = [(c, t, " " if o is None else o, " " if x is None else x) for c, t, o, x in rows]
    want = {("null" if c is None else f"={c}"): repaired(in_order([x for x in plain if x[0] == c])) for c in {x[0] for x in rows}}
    for options in ({}, {"piece": 3, "fan": 2}):  # whole conversations; pieces of three rows in trees of several levels
        reports, made = repair.repair(table.repartition(4), **options)
        assert {x.key: tuple(x)[1:] for x in reports.collect()} == want
        lengths = {x.key: x.n for x in made.groupBy("key").agg(F.count("*").alias("n")).collect()}
        assert all(lengths.get(k, 0) == len(w[6]) - w[6].count("D") for k, w in want.items())
    reports, made = repair.repair(table.limit(0))
    assert reports.count() == 0 and made.count() == 0


def test_registered_repair(spark):
    given = [tuple(r) for r in spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    after = damaged(given)
    want = {c: repaired(in_order([x for x in after if x[0] == c])) for c in {x[0] for x in given}}
    got = queries.REGISTRY["op13_repair"](spark, SF)
    assert got.columns == ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    assert {x.conv_id: tuple(x)[1:] for x in got.collect()} == want


def test_damage_of_nulls(spark):
    rows = [(c, t, o, x) for c in (1, None) for t in (0, 5, None) for o in ("user", None) for x in ("a.b?", None)] + [(k, 0, "assistant", "x!") for k in range(60)]
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    assert by_text(repair.damaged(table).collect()) == by_text(damaged(rows))


def test_full_triangle_gives_the_same_cell():
    """All splits of all intervals, as plain CYK parsing takes them, against one split of each."""
    r = random.Random(9)
    for _ in range(200):
        rows = [repair.row_cell(r.choice("suat"), r.choice([None, None, "blank", "truncated"])) for _ in range(r.randint(1, 7))]
        cells = {(k, k + 1): c for k, c in enumerate(rows)}
        for width in range(2, len(rows) + 1):
            for at in range(len(rows) - width + 1):
                options = [repair.combine(cells[at, m], cells[m, at + width]) for m in range(at + 1, at + width)]
                cells[at, at + width] = {s: min(o[s] for o in options if s in o) for s in repair.SYMBOLS if any(s in o for o in options)}
        assert cells[0, len(rows)] == repair.parse(rows)


def test_top_k_of_large_values_and_repeated_ids(spark):
    prepare(spark)
    r = random.Random(3)
    rows = [(k % 30, [r.choice([1e9, -3.5, 1e300, 0.25]) for _ in range(4)]) for k in range(90)] + [(3, None), (4, [float("nan")] * 4), (None, [1.0] * 4)]
    table = spark.createDataFrame(rows, "vec_id long, e array<double>").select("vec_id", exact_topk.scaled("e").alias("v"))
    kept = [(i, [int(max(-(2.0**62), min(2.0**62, x * 64)) // 1) for x in v]) for i, v in rows if i is not None and v and v[0] == v[0]]
    want = []
    for a, (i, v) in enumerate(kept):
        if i % 20 == 0:
            scored = sorted((-max(-(1 << 62), min(1 << 62, sum(x * y for x, y in zip(v, w, strict=True)))), j) for b, (j, w) in enumerate(kept) if b != a)
            want += [(i, k + 1, j, -s) for k, (s, j) in enumerate(scored[:5])]
    got = exact_topk.top_k(table, F.col("vec_id") % 20 == 0, 5, block=16, query_block=2)
    assert by_text(got.collect()) == by_text(want)


def test_repeated_and_clashing_nodes(spark):
    rows = [("t", 1, None, 1.0, "user", "a", 7, 8)] * 3 + [("t", 2, 1, 1.0, "assistant", "b", 7, 8), ("t", 2, 1, 1.0, "assistant", "b", 7, 8), ("t", None, 1, 9.0, "user", "x", 7, 8)]
    messages = spark.createDataFrame(rows, "tree string, node long, parent long, score double, role string, text string, leaf int, step int")
    paths_made = reply_trees.choose_paths(messages)
    assert {"leaf_", "step_"} <= set(paths_made.columns)
    assert [r.n_turns for r in reply_trees.read_back(reply_trees.format_paths(paths_made)).collect()] == [2]


def test_next_texts_of_spread_ids(spark):
    prepare(spark)
    r = random.Random(1)
    ids = [-(1 << 62), (1 << 62) + (1 << 61), 1, 5, 1 << 60, *(r.randint(-(1 << 63), (1 << 63) - 1) for _ in range(400)), *range(300)]
    rows = [(i, f"t{k}") for k, i in enumerate(dict.fromkeys(ids))] + [(None, f"n{k}") for k in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {x.text: x.next_text for x in fingerprints.with_next(docs, 16).collect()}
    known = sorted(x for x in rows if x[0] is not None)
    assert len(got) == len(rows) and all(got[a[1]] == b[1] for a, b in zip(known, known[1:], strict=False))
    seen, at = [], got[known[-1][1]]  # the first row follows the last: all null ids, then the least id
    while at != known[0][1]:
        seen.append(at)
        at = got[at]
    assert sorted(seen) == sorted(t for i, t in rows if i is None)


def test_stages_keep_foreign_columns(spark):
    prepare(spark)
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for k, name in enumerate(("score", "rate", "lang_pred", "predicted", "copies", "class_id", "held_out", "jk", "rank")):
        docs = docs.withColumn(name, F.concat(F.lit(f"own{k}-"), F.col("doc_id").cast("string")))
    for stage in (stages.keep_known_languages, stages.keep_good_quality, stages.keep_one_of_each_class, stages.mix_to_targets):
        out = stage(spark, docs, SF)
        assert out.schema == docs.schema
        assert out.filter("score <> concat('own0-', doc_id) or rate <> concat('own1-', doc_id) or rank <> concat('own8-', doc_id)").count() == 0


def test_texts_in_several_languages_stay(spark):
    prepare(spark)
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    by_lang = {r.lang: r.text for r in docs.filter("length(text) > 200 and lang is not null").groupBy("lang").agg(F.min_by("text", "doc_id").alias("text")).collect()}
    mixed = " ".join(t[:200] for t in by_lang.values())
    extra = spark.createDataFrame([(10_000_000, mixed, None, "web", len(mixed)), (10_000_001, "123 --", None, "web", 6)], docs.schema)
    kept = {r.doc_id for r in stages.keep_known_languages(spark, docs.unionByName(extra), SF).collect()}
    assert 10_000_000 in kept and 10_000_001 not in kept


def test_fingerprint_strings_are_base64(spark):
    row = fingerprints.compare_versions(spark.createDataFrame([(1, "a b c d. " * 30, "x")], "doc_id long, text string, next_text string")).first()
    assert base64.b64decode(row.fingerprint) and row.near_edited <= 1
