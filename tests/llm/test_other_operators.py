"""Shards, chats, URL filters, top-k search and the pipeline."""

import hashlib
import random

import duckdb
import numpy as np
import pandas as pd
from pyspark.sql import functions as F

import corpus_pipeline
from netloom.llm import exact_topk, kd_shards, queries, reply_trees, url_filter
from netloom.llm.common import prepare

SF = "/root/testdata/sf0.001"


def test_shards_are_near_equal(spark):
    prepare(spark)
    r = random.Random(4)
    rows = [(k, "x" * r.randint(0, 400), r.choice(["en", "fr", None]), "hot" if k % 3 else f"s{k % 7}") for k in range(3000)]
    rows += [(5000 + k, "copy " * 40, "en", "hot") for k in range(1500)] + [(None, None, None, None)] * 3
    docs = spark.createDataFrame([(*x, "clash", 1) for x in rows], "doc_id long, text string, lang string, source string, shard string, slot int")
    got = kd_shards.shard(docs, 7).toPandas()
    sums = got.groupby("shard")["size"].sum()
    assert len(got) == len(rows) and sorted(sums.index) == list(range(7)) and sums.max() / sums.mean() < 1.02 and sums.min() / sums.mean() > 0.98
    assert all(sorted(g) == list(range(len(g))) for _, g in got.groupby("shard")["slot"])
    assert got[got.doc_id.isna()]["size"].tolist() == [16] * 3 and set(got[got.doc_id.isna()].text_crc32) == {0}
    assert kd_shards.shard(docs.limit(0), 7).count() == 0
    assert kd_shards.shard(docs, target_bytes=1 << 30).select("shard").distinct().count() == 1
    assert sorted(r.slot for r in kd_shards.slots(docs.select("doc_id", F.lit(1).alias("g")), "g", ["doc_id"], 100).collect()) == list(range(len(rows)))


def test_few_large_rows_shard(spark):
    docs = spark.createDataFrame([(k, "x" * 10_000 * (k + 1), "en", "s") for k in range(3)], "doc_id long, text string, lang string, source string")
    assert kd_shards.shard(docs, 8).count() == 3


def test_escapes_are_reversible():
    for text in ("", "\\", "\\n", "<|im_end|>\n<|im_start|>", "<\\|", "a<", "\\<|\\", "x\r\n"):
        for turns in ([("user", text)], [("a\nb", text), ("assistant", text), ("", "<")]):
            formatted, spans = reply_trees.format_turns(turns)
            assert reply_trees.parse_turns(formatted) == turns
            assert [reply_trees.unescape(formatted[a:b]) for a, b in spans] == [t for r, t in turns if r == "assistant"]


def test_paths_equal_brute_force(spark):
    prepare(spark)
    r = random.Random(8)
    rows = []
    for tree in range(6):
        for node in range(1, 60):
            rows.append((f"t{tree}", node, r.randint(max(0, node - 5), node - 1) if node > 2 else 0, r.random(), "user", f"m{node}"))
    rows += [("cycle", 1, 2, 1.0, "user", "a"), ("cycle", 2, 1, 1.0, "user", "b"), ("self", 1, 1, None, None, None), ("orphan", 5, 4, 0.5, "user", "c")]
    messages = spark.createDataFrame(rows, "tree string, node long, parent long, score double, role string, text string")
    got = {}
    for x in reply_trees.choose_paths(messages, 2).collect():
        got.setdefault((x.tree, x.leaf), {})[x.step] = x.node
    want = {}
    for tree in {x[0] for x in rows}:
        up = {x[1]: x[2] for x in rows if x[0] == tree}
        score = {x[1]: x[3] or 0.0 for x in rows if x[0] == tree}
        paths = []
        for leaf in set(up) - {p for n, p in up.items() if p != n}:
            path = [leaf]
            while up[path[-1]] in up and up[path[-1]] != path[-1]:
                path.append(up[path[-1]])
            paths.append((-sum(score[n] for n in path) / len(path), -len(path), leaf, path[::-1]))
        for *_, leaf, path in sorted(paths)[:2]:
            want[tree, leaf] = dict(enumerate(path))
    assert got == want and ("cycle", 1) not in got


def test_conversations_edges(spark):
    prepare(spark)
    rows = [(1, k, "assistant" if k % 2 else "user", f"t{k}") for k in range(300)] + [(2, 0, "user", None), (2, 0, "user", None), (3, 1, None, ""), (None, 0, "assistant", "x"), (None, None, "user", "y")]
    table = spark.createDataFrame([(*x, 1) for x in rows], "conv_id long, turn long, role string, text string, leaf int")
    got = {r.tree: r for r in reply_trees.read_back(reply_trees.format_paths(reply_trees.choose_paths(reply_trees.as_trees(table)))).collect()}
    assert {k: r.n_turns for k, r in got.items()} == {"1": 300, "2": 2, "3": 1, "null": 2}
    assert got["1"].turns_sha256 == hashlib.sha256("".join(f"{r}\n{t}\n" for c, _, r, t in rows if c == 1).encode()).hexdigest()
    assert got["1"].loss_sha256 == hashlib.sha256("".join(t for c, _, r, t in rows if c == 1 and r == "assistant").encode()).hexdigest()
    assert reply_trees.format_paths(reply_trees.choose_paths(reply_trees.as_trees(table.limit(0)))).count() == 0


def test_url_rules_equal_sql(spark):
    prepare(spark)
    urls = [
        None, "", "no scheme", "http://", "https://Example.COM/en/x?y", "http://www.example.com/en/1", "http://www.example.com/EN/1", "http://a.b.net/es/", "http://net/fr/q#f", "http://net", "http://com?x", "https://x.com:80/en/",
        "ftp://x.org/a", "http://x.org/login", "http://x.org/logins", "http://x.org/a?sessionid=4", "http://ads.x.org/", "http://xads.org/", "a://b://c.com/", "http://notexample.com/en/", "http://x.ORG/cgi-bin/a", "http://é.net/fr/ü",
    ]
    pages = spark.createDataFrame([(k % 5 or None, u, "clash", "h") for k, u in enumerate(urls + urls[4:7])], "page_id long, url string, verdict string, html string")
    rules = [*(url_filter.list_rule(*r) for r in url_filter.LIST), *url_filter.PATTERNS]
    con = duckdb.connect()
    con.register("pages", pages.toPandas())
    con.execute("create view p as select cast(page_id as bigint) as page_id, url from pages")
    want = con.execute(url_filter.SQL.replace("from pages", "from p")).df()
    for limit in (100_000, 0):
        got = url_filter.judge(pages, rules, broadcast_rules=limit).select("page_id", "host", "path", "rule", "verdict").toPandas()
        key = lambda d: sorted(tuple("-" if pd.isna(x) else x if isinstance(x, str) else str(int(x)) for x in r) for r in d[["page_id", "host", "path", "rule", "verdict"]].itertuples(index=False))
        assert key(got) == key(want)
    free = url_filter.judge(pages, [url_filter.Rule("[0-9]$", (), "block")]).filter("verdict = 'block'").select("url").distinct().collect()
    assert {r.url for r in free} == {u for u in urls if u and u[-1].isdigit()}
    assert url_filter.judge(pages.limit(0), rules).count() == 0 and url_filter.judge(pages, []).filter("verdict = 'allow'").count() == pages.count()


def test_top_k_equals_brute_force(spark):
    prepare(spark)
    r = np.random.default_rng(6)
    x = r.normal(size=(700, 12)) * r.gamma(1, 1, size=(700, 1))
    x[5:60] = x[4]  # ties
    rows = [(k, v.tolist()) for k, v in enumerate(x)]
    bad = [(700, None), (701, [1.0, None]), (702, [float("nan")] * 12), (703, [float("inf")] * 12), (None, [1.0] * 12), (704, [2.0, 2.0]), (705, [0.0] * 12), (706, [])]
    table = spark.createDataFrame([(*y, 1) for y in rows + bad], "vec_id long, embedding array<double>, score int")
    v = np.floor(64 * np.vstack([x, np.zeros((7, 12))])).astype(np.int64)
    v[704, :2] = 128
    ids = np.array([*range(700), 704, 705, 706])
    vectors = table.select("vec_id", exact_topk.scaled("embedding").alias("v"))
    for options in ({}, {"block": 64, "query_block": 5, "head": 3}):
        got = {}
        for row in exact_topk.top_k(vectors, F.col("vec_id") % 20 == 0, 10, **options).collect():
            got.setdefault(row.query_id, {})[row.rank] = (row.vec_id, row.score)
        assert set(got) == {k for k in ids.tolist() if k % 20 == 0}
        for q, found in got.items():
            scores = v[ids] @ v[q]
            best = [k for k in np.lexsort((ids, -scores)) if ids[k] != q][:10]
            assert found == {n + 1: (ids[k], scores[k]) for n, k in enumerate(best)}
    assert exact_topk.top_k(vectors.limit(0), F.lit(True)).count() == 0
    assert exact_topk.top_k(vectors.filter("vec_id = 20"), F.lit(True)).count() == 0


def test_pipeline_stages_run_on_each_other(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    kept = {r.doc_id for r in docs.collect()}
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, SF)
        if k < len(corpus_pipeline.STAGES) - 1:
            assert out.columns == docs.columns
            docs = spark.createDataFrame(out.collect(), docs.schema)
            now = [r.doc_id for r in docs.collect()]
            assert set(now) <= kept and len(now) == len(set(now)) > 50
            kept = set(now)
    assert {r.doc_id for r in out.collect()} == kept


def test_pipeline_on_an_empty_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SF)
        assert out.count() == 0


def test_registered_names():
    assert len(queries.REGISTRY) == 13 and set(queries.SQL) <= set(queries.REGISTRY) and 4 <= len(corpus_pipeline.STAGES) <= 5
