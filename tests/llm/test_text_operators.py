"""Language ID, quality, n-gram join, mixing, packing and fingerprints on small tables."""

import hashlib
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from netloom.llm import boosted, fingerprints, language_id, mixing, ngram_join, packing, quality
from netloom.llm.common import prepare

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score string, `rank` int"


def words(seed, n, letters="abcdefgh"):
    r = random.Random(seed)
    return ["".join(r.choice(letters) for _ in range(r.randint(2, 6))) for _ in range(n)]


@pytest.fixture(scope="module")
def docs(spark):
    """Nulls in any column, empty, blank and letterless texts, repeated rows, a long text, and columns whose names clash."""
    prepare(spark)
    base = words(1, 200)
    near = [*base[:100], "changed", *base[101:]]
    rows = [
        (1, " ".join(base), "aa", "s", 1), (2, " ".join(base), None, "s", 1), (3, " ".join(near), "aa", None, 1), (4, None, "aa", "s", None), (5, "", "bb", "s", 0), (6, " \n\t", None, None, 3),
        (7, "12 34 !!", "bb", "s", 7), (8, "one two", "aa", "s", 7), (8, "one two", "aa", "s", 7), (None, " ".join(words(2, 50)), "bb", "s", 1), (9, " ".join(words(3, 30_000, "xyzuvw")), "bb", "s", 1),
        (10, "a  b   c\n \n d<|endoftext|>e ", "aa", "s", 1), (11, "ONE two", None, "s", 1),
    ]
    return spark.createDataFrame([(*r, "kept", 7) for r in rows], SCHEMA)


@pytest.fixture(scope="module")
def empty(spark, docs):
    return docs.limit(0)


def test_language_model_labels_spans(spark):
    prepare(spark)
    rows = [(k, " ".join(words(k, 80, "abcde" if k % 2 else "vwxyz")), "aa" if k % 2 else "vv") for k in range(60)]
    model = language_id.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    mixed = " ".join(words(77, 40, "abcde")) + " -- " + " ".join(words(78, 60, "vwxyz"))
    lang, score, spans = language_id.label_texts(model, [mixed])[0]
    assert (lang, [s["lang"] for s in spans]) == ("vv", ["aa", "vv"]) and 0.5 < score < 0.7
    assert spans[0]["end"] == spans[1]["start"] and spans[1]["end"] == len(mixed) and mixed[spans[1]["start"] :].split()[0] in words(78, 60, "vwxyz")


def test_every_language_is_learnt_from_whole_texts(spark):
    """A language of two rows beside thousands of another, one whose rows are all alike, and a second script late in a long text."""
    prepare(spark)
    rows = [(k, " ".join(words(k, 8, "abcde")), "aa") for k in range(3000)] + [(5000 + k, " ".join(words(5000 + k, 60, "vwxyz")), "vv") for k in range(2)]
    rows += [(None, " ".join(words(7, 60, "klmno")), "kk")] * 100 + [(6000, " ".join([*words(8, 6000, "fghij"), "привет мир"]), "ff")]
    rows += [(7000 + k, "only", f"l{k:03}") for k in range(150)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    picked = {r.lang: r["count"] for r in language_id.fit_sample(docs, fit_rows=50).groupBy("lang").count().collect()}
    assert 20 < picked["aa"] < 90 and (picked["vv"], picked["kk"], picked["ff"]) == (2, 100, 1) and len(picked) == 154
    model = language_id.fit(docs, fit_rows=50)
    assert model.langs == sorted(picked)
    tests = [" ".join(words(99, 40, letters)) for letters in ("vwxyz", "klmno", "abcde")]
    assert [g[0] for g in language_id.label_texts(model, tests)] == ["vv", "kk", "aa"]
    late = language_id.fit(docs.filter("lang = 'ff'").withColumn("text", F.concat(F.substring("text", 1, 20_500), F.lit(" привет" * 200))))
    assert late.scripts == {"latin": [0], "cyrillic": [0]}
    some = language_id.fit(docs.filter("doc_id >= 5000"), max_chunks=10)
    assert (some.log_p == language_id.fit(docs.filter("doc_id >= 5000")).log_p).all()


def test_viterbi_equals_brute_force():
    r = np.random.default_rng(3)
    scores = [r.normal(size=(n, 3)).astype(np.float32) for n in (1, 4, 6, 0, 5)]
    got = language_id.viterbi(scores, 0.7)
    for s, path in zip(scores, got, strict=True):
        value = lambda p, s=s: sum(s[i, k] for i, k in enumerate(p)) - 0.7 * sum(a != b for a, b in zip(p, p[1:], strict=False))
        best = max((value(p) for p in np.ndindex(*[3] * len(s))), default=0)
        assert value(tuple(path)) == pytest.approx(best, abs=1e-4)


def test_scripts_narrow_candidates():
    model = language_id.LanguageModel(["latin1", "cyr"], np.zeros((16, 2), np.float32), {"latin": [0], "cyrillic": [1]}, 1.0)
    assert [g[0] for g in language_id.label_texts(model, ["привет мир", "hello", "123", ""])] == ["cyr", "latin1", "und", "und"]


def test_language_edges(spark, docs, empty):
    model = language_id.fit(docs)
    got = {(r.doc_id, r.text): r for r in language_id.identify(docs, model).collect()}
    assert len(language_id.identify(docs, model).collect()) == docs.count()
    for key in ((4, None), (5, ""), (6, " \n\t"), (7, "12 34 !!")):
        assert (got[key].lang_pred, got[key].score, got[key].spans) == ("und", 0.0, [])
    assert all(r.lang_pred in ("aa", "bb") for k, r in got.items() if k[0] not in (4, 5, 6, 7)) and got[8, "one two"].rank == 7
    assert language_id.identify(empty, language_id.fit(empty)).count() == 0
    assert {r.lang_pred for r in language_id.identify(docs, language_id.fit(empty)).collect()} == {"und"}


def test_held_out_accuracy(spark):
    got = language_id.op9(spark, "/root/testdata/sf0.01").join(spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang"), "doc_id")
    assert got.filter("held_out").agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("double"))).first()[0] > 0.97
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    scored = quality.op7(spark, "/root/testdata/sf0.01").join(labels, "doc_id").filter("held_out")
    assert scored.agg(F.avg((F.col("predicted") == F.col("quality")).cast("double"))).first()[0] > 0.95


def test_boosted_trees_learn_and_walk_flat_arrays():
    r = np.random.default_rng(1)
    x = r.normal(size=(2000, 5))
    y = ((x[:, 0] > 0.3) ^ (x[:, 3] > 0)).astype(float)
    f = boosted.fit(x[:1500], y[:1500])
    assert ((f.scores(x[1500:]) > 0.5) == y[1500:]).mean() > 0.95
    margin = np.full(20, f.base)
    for i in range(20):
        for root in f.roots:
            node = root
            while f.left[node] != node:
                node = f.left[node] + int(x[i, f.feature[node]] > f.threshold[node])
            margin[i] += f.value[node]
    assert np.allclose(margin, f.margins(x[:20]))
    assert boosted.fit(x[:0], y[:0]).scores(x[:2]).min() > 0.99 and boosted.fit(x, y * 0).scores(x[:2]).max() < 0.01


def test_quality_edges(spark, docs, empty):
    labels = spark.createDataFrame([(1, 1, 0), (1, 0, 0), (8, 1, 0), (None, 1, 0), (4, None, 0)], "doc_id long, quality int, toxic int")
    x, y = quality.training_rows(docs, labels)
    assert sorted(y.tolist()) == [0.0, 1.0, 1.0]  # id 1 counts as its lowest label, the repeated row 8 twice
    got = quality.score(docs, boosted.fit(x, y)).collect()
    assert len(got) == docs.count() and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in got)
    assert quality.score(empty, boosted.fit(*quality.training_rows(empty, labels))).count() == 0


def brute_links(rows, similarity=0.8):
    shingler = ngram_join.Shingler(5)
    sets = [set(shingler(t or "").tolist()) for t in rows]
    return {(i, j) for i in range(len(sets)) for j in range(i) if sets[i] and sets[j] and len(sets[i] & sets[j]) >= similarity * len(sets[i] | sets[j])}


def test_join_edges(spark, docs, empty):
    got = ngram_join.join(docs).collect()
    assert len(got) == docs.count()
    by_id = {}
    for r in got:
        by_id.setdefault(r.doc_id, []).append((r.class_id, r.n_links))
    assert by_id[1] == by_id[2] == by_id[3] == [(1, 2)] and by_id[8] == [(8, 2), (8, 2)] and by_id[11] == [(8, 2)]  # case does not count
    assert by_id[4] == [(4, 0)] and by_id[5] == [(5, 0)] and by_id[6] == [(6, 0)] and by_id[None] == [(None, 0)]
    assert ngram_join.join(empty).count() == 0
    kept = sorted((r.doc_id or 0, r.text or "") for r in ngram_join.keep_first(docs).collect())
    assert [k for k, _ in kept] == [0, 1, 4, 5, 6, 7, 8, 9, 10]
    assert ngram_join.keep_first(docs).columns == docs.columns


@pytest.mark.parametrize("settings", [ngram_join.Settings(), ngram_join.Settings(small=4, block=3), ngram_join.Settings(small=4, alike=2.0)])
def test_join_equals_brute_force(spark, settings):
    """Near copies, a shared passage in all texts, and chains; with small buckets and blocks the recursion and the blocks run."""
    prepare(spark)
    r, passage = random.Random(5), words(9, 30)
    rows = []
    for family in range(12):
        base = [*passage, *words(100 + family, 120)]
        for _ in range(r.randint(1, 6)):
            text = list(base)
            for _ in range(r.randint(0, 5)):
                text[r.randrange(len(text))] = f"w{r.random()}"
            rows.append(" ".join(text))
            base = text if r.random() < 0.5 else base
    rows += rows[:3]
    links = brute_links(rows)
    got = {x.doc_id: x for x in ngram_join.join(spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string"), settings).collect()}
    degree = [sum(i in p for p in links) for i in range(len(rows))]
    root = list(range(len(rows)))
    for _ in rows:
        for i, j in links:
            root[i] = root[j] = min(root[i], root[j])
    assert [got[i].n_links for i in range(len(rows))] == degree and [got[i].class_id for i in range(len(rows))] == root


def test_recall_holds_at_every_depth():
    """Pairs at the threshold whose buckets never get small: met at a depth if some bucket of it holds both, each bucket choosing its samples."""
    r, settings, n = np.random.default_rng(11), ngram_join.Settings(), 20_000
    sets = r.integers(0, 1 << 63, (n, 40), dtype=np.uint64)
    agree = np.stack([ngram_join.samples(s[:36]) == ngram_join.samples(s[4:]) for s in sets])  # 32 of 40 shared
    lost = [0] * settings.levels
    for pair in agree:
        buckets = list(range(settings.runs))
        for level in range(settings.levels):
            children = []
            for bucket in buckets[:64]:
                for j in range(settings.branches):
                    option = bucket if level == 0 else hash((bucket, j, "option")) % settings.options
                    if pair[(level * settings.branches + j) * settings.options + option]:
                        children.append(hash((bucket, j)))
            buckets = children
            if not buckets:
                lost[level:] = [x + 1 for x in lost[level:]]
                break
    assert settings.runs == 2 and max(lost) <= 8  # 0.9999 of 20 000, and chance


def test_mixing_meets_targets(spark, docs, empty):
    rows = [(k, " ".join([*words(k, 20), "good" if k % 4 else "bad"])) for k in range(400)]
    table = spark.createDataFrame(rows, "doc_id long, text string")
    labelled = spark.createDataFrame([(k, "clean" if k % 4 else "toxic") for k in range(200)], "doc_id long, domain string")
    m = mixing.fit_membership(table, labelled, ["clean", "junk", "toxic"])
    got = mixing.mix(table, m, {"clean": 0.9, "toxic": 0.1}).toPandas()
    p = np.stack(got.posterior.to_list())
    tokens = p.T @ (got.n_tokens * got.rate)
    assert m.domains == ["clean", "toxic"] and tokens[1] / tokens.sum() == pytest.approx(0.1, abs=1e-3) and (got.rate >= 0).all() and (abs(got.copies - got.rate) < 1).all()
    capped = mixing.mix(table, m, {"clean": 0.2, "toxic": 0.8}, max_rate=1.0).toPandas()
    assert capped.rate.max() <= 1.0
    one = mixing.fit_membership(docs, mixing.label_domains(spark.createDataFrame([(1, 1, 0), (None, 0, 0), (8, None, 1)], "doc_id long, quality int, toxic int")), list(mixing.TARGETS))
    assert {(r.rate, r.copies) for r in mixing.mix(docs, one, mixing.TARGETS).collect()} == {(1.0, 1)}
    assert mixing.mix(empty, one, mixing.TARGETS).count() == 0


def test_packing_equals_tokenizer(spark, docs, empty):
    tokenizer = Tokenizer.from_file(packing.tokenizer_path())
    got = packing.pack(docs, packing.tokenizer_path(), group_bytes=20_000).toPandas()
    want = {}
    for r in docs.collect():
        ids = np.array([*tokenizer.encode(r.text or "", add_special_tokens=False).ids, 0], "<u4")
        want.setdefault(r.doc_id, []).append(ids)
    covered = {}
    for r in got.itertuples():
        key = None if np.isnan(r.doc_id) else int(r.doc_id)
        ids = want[key][0]
        cut = ids[r.start : r.start + r.length].tobytes()
        assert (zlib.crc32(cut), cut, len(ids)) == (r.ids_crc32, r.ids, r.doc_tokens)
        covered[key] = covered.get(key, 0) + r.length
    assert covered == {k: sum(map(len, v)) for k, v in want.items()}
    for _, s in got.sort_values("offset").groupby("sequence_id"):
        assert s.offset.tolist() == [0, *np.cumsum(s.length)[:-1]] and s.length.sum() <= 1024
    assert packing.pack(empty, packing.tokenizer_path()).count() == 0


def test_encoder_cuts_at_spaces_only_where_safe():
    encoder = packing.Encoder(packing.tokenizer_path(), 0, part=7)
    texts = ["", " ", "  a", "a \n b", "a\n \nb", "don't  stop ,now \t x", "a\n\nb\n\n\nc \n", "\n a\tb\u2003 c, d.\x1c e", "é  ü\u00a0 \u00a0z", "x" * 40 + " y z  w", "<|endoftext|> a <|endoftext|>"]
    tokenizer = Tokenizer.from_file(packing.tokenizer_path())
    plain = [[*e.ids, 0] for e in tokenizer.encode_batch(texts, add_special_tokens=False)]
    assert [encoder(t).tolist() for t in texts] == plain


def test_first_fit_decreasing():
    r = random.Random(2)
    lengths = sorted((r.randint(1, 100) for _ in range(300)), reverse=True)
    slow = []
    for n in lengths:
        for b in slow:
            if sum(b) + n <= 100:
                b.append(n)
                break
        else:
            slow.append([n])
    assert [[p[2] for p in b] for b in packing.pack_lengths(lengths, 100, min_cut=101)] == slow
    full = packing.pack_lengths(lengths, 100, min_cut=1)
    assert sum(sum(p[2] for p in b) for b in full) == sum(lengths) and sum(sum(p[2] for p in b) < 100 for b in full) <= 1 and packing.pack_lengths([], 100) == []


def test_sketches_recover_differences():
    passages = fingerprints.Passages()
    texts = [" ".join(words(k, n)) + ".\n" for k, n in ((1, 5), (2, 60), (3, 400), (4, 3000))]
    texts += ["", "same line\n" * 50, texts[2] + texts[1]]
    sets = [passages(t) for t in texts]
    pairs = [(i, j) for i in range(len(sets)) for j in range(len(sets))]
    got = fingerprints.likeness([sets[i] for i, _ in pairs], [sets[j] for _, j in pairs])
    for (i, j), value in zip(pairs, got, strict=True):
        a, b = ({int(x): int(x) & 0xFFFF for x in sets[k]} for k in (i, j))
        union = sum((a | b).values())
        assert value == pytest.approx(sum(v for k, v in a.items() if k in b) / union if union else 1.0)
    assert fingerprints.fingerprint(sets) == fingerprints.fingerprint([passages(t) for t in texts])


def test_next_rows_and_fingerprint_edges(spark, docs, empty):
    for bucket in (1, 3, 2048):
        got = fingerprints.with_next(docs, bucket).collect()
        pairs = sorted((r.doc_id or 0, r.text, r.next_text) for r in got)
        plain = sorted({(r.doc_id or 0, r.text or "") for r in docs.collect()})
        assert len(got) == docs.count() and {t for *_, t in pairs} == {t for _, t in plain}
        for (_, _, after), (_, text) in zip(pairs[:8], plain[1:9], strict=True):
            assert after == text
        assert pairs[-1][2] == plain[0][1]
    rows = fingerprints.compare_versions(fingerprints.with_next(docs)).collect()
    by_id = {r.doc_id: r for r in rows}
    assert by_id[1].fingerprint == by_id[2].fingerprint and by_id[4].fingerprint == by_id[5].fingerprint and by_id[1].near_next == 1.0 and by_id[4].near_next == 1.0
    assert by_id[5].edited_sha256 == hashlib.sha256(b"").hexdigest() and by_id[9].near_edited > 0.3
    assert fingerprints.with_next(empty).count() == 0
