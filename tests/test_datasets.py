import csv
import json
import os

import pytest
from pyspark.errors import StreamingQueryException
from pyspark.sql import functions as F

from netloom.operators import dataset as ds
from netloom.operators import evaluate as ev
from netloom.operators import ml
from netloom.schema import FEATURES, LABEL, PREPARED_FILES, RAW_TO_FEATURE
from netloom.sources import flows, sinks
from netloom.streaming import queries as st

LABELS = ["Benign", "DDOS attack-HOIC", "FTP-BruteForce", "Bot"]


def raw_file(path, n=20, drop=None, repeat=0, **extra):
    names = [c for c in RAW_TO_FEATURE if c != drop]
    rows = [["x", *[str(i + r + 1) for i, _ in enumerate(names)], LABELS[r % 4]] for r in range(n)]
    rows += rows[:repeat]
    with open(path, "w", newline="") as f:
        w = csv.writer(f)
        w.writerow(["Flow ID", *[f" {c} " for c in names], "Label"])
        w.writerows(rows)


def test_write_dataset(spark, scratch):
    os.mkdir(f"{scratch}/raw")
    raw_file(f"{scratch}/raw/a.csv", 20, repeat=1)
    meta = sinks.write_dataset(spark, f"{scratch}/raw", f"{scratch}/out", 0.25)
    assert (meta["cleaned_rows"], meta["train_rows"], meta["test_rows"]) == (20, 15, 5)
    assert meta["label_distribution"] == {"Bots": 5, "Brute Force": 5, "DDoS": 5, "Normal Traffic": 5}
    assert meta["source_files"][0]["rows"] == 21 and len(meta["source_files"][0]["sha256"]) == 64
    stored = json.loads(spark.read.text(f"{scratch}/out/metadata").first()[0])
    assert stored["feature_columns"] == FEATURES
    with pytest.raises(FileExistsError):
        sinks.write_dataset(spark, f"{scratch}/raw", f"{scratch}/out", 0.25)
    again = sinks.write_dataset(spark, f"{scratch}/raw", f"{scratch}/out", 0.25, force=True)
    assert again["test_label_distribution"] == meta["test_label_distribution"]
    durations = spark.read.option("header", True).csv(f"{scratch}/out/cleaned").select(F.max(F.col("flow_duration").cast("double"))).first()[0]
    assert durations == 22 / 1e6


def test_bad_sources_write_nothing(spark, scratch):
    raw_file(f"{scratch}/a.csv", drop="Protocol")
    with pytest.raises(ValueError, match="protocol"):
        sinks.write_dataset(spark, f"{scratch}/a.csv", f"{scratch}/out")
    assert not os.path.exists(f"{scratch}/out")
    with pytest.raises(FileNotFoundError):
        flows.csv_files(spark, f"{scratch}/none")
    open(f"{scratch}/a.txt", "w").close()
    with pytest.raises(ValueError):
        flows.csv_files(spark, f"{scratch}/a.txt")
    with pytest.raises(ValueError):
        sinks.write_dataset(spark, f"{scratch}/a.csv", f"{scratch}/out", test_size=1.0)


def test_prepared_files(spark, scratch):
    dirty = {"dst_port": "70000", "protocol": "255", "flow_duration": "inf", "packet_len_mean": "-5", "flow_iat_mean": "NaN"}
    for k, name in enumerate(PREPARED_FILES):
        with open(f"{scratch}/{name}", "w", newline="") as f:
            w = csv.writer(f)
            w.writerow([*FEATURES, LABEL])
            w.writerow([*[str(i + 2) for i in range(len(FEATURES))], "DDoS"])
            w.writerow([*[dirty.get(c, "2.5") for c in FEATURES], f"L{k}"])
            w.writerow([*["6"] * len(FEATURES), " "])
            w.writerow([*["6"] * len(FEATURES), " Bots "])
    rows = ds.clean_prepared(flows.read_prepared_flows(spark, scratch))
    assert rows.count() == 30
    assert {r["feature"]: r["invalid_rows"] for r in ds.invalid_feature_counts(rows).collect() if r["invalid_rows"]} == {}
    bad = rows.filter(F.col(f"`{LABEL}`") == "L0").first()
    assert (bad["dst_port"], bad["protocol"], bad["flow_duration"], bad["packet_len_mean"], bad["flow_iat_mean"]) == (0, 0, 0.0, 0.0, 0.0)
    assert bad["fin_flag_count"] == 2 and bad["flow_iat_max"] == 2.5
    os.rename(f"{scratch}/{PREPARED_FILES[0]}", f"{scratch}/other.csv")
    with pytest.raises(FileNotFoundError):
        flows.read_prepared_flows(spark, scratch)
    with pytest.raises(ValueError, match="other.csv"):
        flows.read_prepared_flows(spark, files=[f"{scratch}/{n}" for n in [*PREPARED_FILES, "other.csv"]])


def test_strict_validation_names_columns(spark):
    df = spark.createDataFrame([tuple(["1"] * 36 + ["NaN"])], ", ".join(f"{f} string" for f in FEATURES))
    with pytest.raises(ValueError, match=FEATURES[-1]):
        ds.require_valid_features(df)


def test_targets_round_half_even_and_leave_one(spark):
    df = spark.createDataFrame([("a", 10), ("b", 30), ("c", 1), ("d", 2)], "label string, rows long")
    got = {r["label"]: r["test_rows"] for r in ds.test_targets(df, 0.25).collect()}
    assert got == {"a": 2, "b": 8, "c": 0, "d": 0}
    assert {r["label"]: r["test_rows"] for r in ds.test_targets(df, 0.9).collect()}["d"] == 1


def test_split_is_exact_and_repeatable(spark):
    df = spark.range(5000).select(F.col("id").cast("string").alias("v"), F.when(F.col("id") % 10 == 0, "rare").otherwise("common").alias(LABEL))
    one = ds.stratified_split(df, test_size=0.2, buckets=7)
    got = {(r[LABEL], r["is_test"]): r["count"] for r in one.groupBy(LABEL, "is_test").count().collect()}
    assert got == {("rare", True): 100, ("rare", False): 400, ("common", True): 900, ("common", False): 3600}
    two = ds.stratified_split(df.repartition(3), test_size=0.2, buckets=7)
    picks = [{r["v"] for r in s.filter("is_test").collect()} for s in (one, two)]
    assert picks[0] == picks[1]
    other = {r["v"] for r in ds.stratified_split(df, test_size=0.2, seed=1, buckets=7).filter("is_test").collect()}
    assert other != picks[0]


def _training(spark):
    rows = [tuple(float((i % 3) * 10 + j % 2) for j in range(37)) + (["A", "B", "C"][i % 3],) for i in range(90)]
    return spark.createDataFrame(rows, ", ".join(f"{f} double" for f in FEATURES) + ", label string")


@pytest.mark.parametrize("kind", ["rf", "dt", "gbt"])
def test_models_learn_and_score(spark, kind):
    data = _training(spark)
    model = ml.train(data, kind, trees=3, depth=3, balanced=True)
    out = ml.score(data.withColumnRenamed("label", "actual"), model, model)
    row = out.first()
    assert out.filter("actual = label").count() == 90
    assert abs(sum(row["model_outputs"]["primary"]["probabilities"]) - 1) < 1e-9 and 0 < row["confidence"] <= 1
    assert ml.score(data.drop("label"), None).first()["label"] is None


def test_unknown_label_is_refused(spark):
    rows = spark.createDataFrame([("Z",)], "label string")
    with pytest.raises(Exception):
        ml.label_indexer("label", ["A", "B"]).transform(rows).collect()


def test_model_guard(spark, scratch):
    model = ml.train(_training(spark), "dt", depth=2)
    ml.save_model(model, f"{scratch}/m")
    assert len(ml.load_model(f"{scratch}/m").stages) == 4
    victim = next(os.path.join(d, f) for d, _, fs in os.walk(f"{scratch}/m/model") for f in fs if f.startswith("part-") and "metadata" in d)
    with open(victim, "a") as f:
        f.write("\n")
    os.remove(os.path.join(os.path.dirname(victim), "." + os.path.basename(victim) + ".crc"))
    with pytest.raises(ValueError, match="digests"):
        ml.load_model(f"{scratch}/m")


def test_evaluation(spark):
    pairs = spark.createDataFrame([("N", "N")] * 8 + [("A", "N")] * 2 + [("A", "A")] * 6 + [("X", "A")], "actual string, predicted string")
    known = spark.createDataFrame([("N",), ("A",), ("B",)], "label string")
    conf = ev.confusion(pairs, known)
    assert conf.count() == 9
    m = {r["label"]: r for r in ev.class_metrics(conf).collect()}
    assert (m["A"]["precision"], m["A"]["recall"], m["B"]["f1"]) == (1.0, 0.75, 0.0)
    assert ev.normal_fpr(conf, "N").first()["normal_traffic_fpr"] == 0.25
    assert ev.unknown_labels(pairs, known).first()["label"] == "X"
    rep = ev.report(conf)
    assert json.loads(rep["json"])["overall"]["accuracy"] == 14 / 16 and "| A |" in rep["markdown"]


def test_upsert_policies_and_bounded_log(spark, scratch):
    a = spark.createDataFrame([("k1", 1, "old"), ("k2", 1, "old")], "event_id string, ts_us long, v string")
    b = spark.createDataFrame([("k1", 2, "new"), ("k3", 2, "new"), ("k3", 3, "newest")], a.schema)
    for table, policy, want in (("x", "first", {"k1": "old", "k2": "old", "k3": "new"}), ("y", "last", {"k1": "new", "k2": "old", "k3": "newest"})):
        for batch in (a, b, b):
            sinks.upsert(batch, f"{scratch}/{table}", "event_id", policy)
        assert {r["event_id"]: r["v"] for r in sinks.read_table(spark, f"{scratch}/{table}").collect()} == want
    # a job that dies before its pointer is complete leaves the table whole, and the next write goes on from it
    os.makedirs(f"{scratch}/y/current-000000000099")
    assert {r["event_id"] for r in sinks.read_table(spark, f"{scratch}/y").collect()} == {"k1", "k2", "k3"}
    sinks.upsert(spark.createDataFrame([("k4", 1, "x")], a.schema), f"{scratch}/y", "event_id", "last")
    assert sinks.read_table(spark, f"{scratch}/y").count() == 4
    with pytest.raises(ValueError, match="keeps the last"):
        sinks.upsert(a, f"{scratch}/y", "event_id", "first")
    for number in (0, 1, 1):
        sinks.fan_out(a, f"{scratch}/fan", {"ids-events": lambda rows: rows, "alerts": lambda rows: rows.filter("v = 'none'")}, number)
    assert spark.read.parquet(f"{scratch}/fan/ids-events").count() == 4 and spark.read.parquet(f"{scratch}/fan/alerts").count() == 0
    log = spark.createDataFrame([(f"10.0.0.{i}", i) for i in range(5)], "ip string, last_detected_us long")
    for _ in range(2):
        sinks.append_activity_jsonl(log, f"{scratch}/log", keep=3)
    assert sorted(r["last_detected_us"] for r in sinks.read_activity_jsonl(spark, f"{scratch}/log", log.schema).collect()) == [3, 4, 4]


def run_folders(path):
    return {f"{g}/{b}" for g in os.listdir(path) if g.startswith("gen-") for b in os.listdir(f"{path}/{g}") if b.startswith("_bucket=")}


def test_upsert_writes_only_touched_buckets(spark, scratch):
    path = f"{scratch}/t"
    whole = spark.range(4000).select(F.col("id").cast("string").alias("k"), F.lit(0).cast("bigint").alias("ts_us"), F.sha2(F.col("id").cast("string"), 256).alias("v"))
    sinks.upsert(whole, path, "k", buckets=8)
    before = run_folders(path)
    assert len(before) == 8
    for n in range(1, 8):
        one = spark.createDataFrame([("7", n, f"v{n}")], whole.schema)
        sinks.upsert(one, path, "k", keep=100)
        after = run_folders(path)
        # one run of one bucket, and at times a merge of small runs: never the large first one
        assert before <= after and len(after - before) <= 2 and len({f.split("/")[1] for f in after - before}) == 1
        before = after
        assert sinks.read_table(spark, path).filter("k = '7'").collect() == one.collect()
    assert sinks.read_table(spark, path).count() == 4000
    sinks.upsert(spark.createDataFrame([("7", 9, "v9")], whole.schema), path, "k", keep=2)
    assert len(run_folders(path)) <= 8 + 8, "runs that no pointer names are gone"
    os.makedirs(f"{path}/gen-dead/_bucket=1")
    wider = whole.limit(1).withColumn("more", F.lit(1))
    sinks.upsert(wider, path, "k")
    assert not os.path.exists(f"{path}/gen-dead") and sinks.read_table(spark, path).filter("more = 1").count() == 1
    with pytest.raises(ValueError, match="column v"):
        sinks.upsert(whole.withColumn("v", F.lit(1)), path, "k")
    sinks.upsert(whole.limit(0), f"{scratch}/empty", "k")
    assert sinks.read_table(spark, f"{scratch}/empty").schema.names == ["k", "ts_us", "v"] and sinks.read_table(spark, f"{scratch}/empty").isEmpty()


@pytest.mark.parametrize("policy", ["first", "last"])
def test_upsert_equals_a_dictionary(spark, scratch, policy):
    schema, want = "k string, ts_us long, v long", {}
    for n in range(12):
        batch = [(None if i == 3 else f"k{(i * 7 + n) % 9}", (i * 5 + n) % 4, 100 * n + i) for i in range(n % 5)]
        sinks.upsert(spark.createDataFrame(batch, schema), f"{scratch}/t", "k", policy, buckets=2)
        for k in {r[0] for r in batch}:
            mine = [r for r in batch if r[0] == k]
            if policy == "last" or k not in want:
                times = [r[1] for r in mine]
                want[k] = {r[2] for r in mine if r[1] == (min(times) if policy == "first" else max(times))}
        got = {r["k"]: r["v"] for r in sinks.read_table(spark, f"{scratch}/t").collect()}
        assert got.keys() == want.keys() and all(got[k] in want[k] for k in got)


def test_fan_out_restarts_between_two_tables(spark, scratch):
    rows = spark.range(40).select("id", F.when(F.col("id") % 2 == 0, "even").otherwise("odd").alias("kind"))
    rows.repartition(4).write.parquet(f"{scratch}/in")
    calls = []

    def odd(batch):
        calls.append(1)
        if len(calls) == 2:
            raise RuntimeError("lost between two tables")
        return batch.filter("kind = 'odd'")

    def start():
        stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(f"{scratch}/in")
        return st.start_fan_out(stream, f"{scratch}/out", f"{scratch}/check", {"even": lambda b: b.filter("kind = 'even'"), "odd": odd})

    with pytest.raises(StreamingQueryException):
        start().awaitTermination()
    start().awaitTermination()
    for kind in ("even", "odd"):
        got = sorted(r["id"] for r in spark.read.parquet(f"{scratch}/out/{kind}").collect())
        assert got == list(range(kind == "odd", 40, 2))
    assert len(calls) == 5, "four batches, one of them twice"


def test_models_find_their_labels(spark):
    """Held-out recall of every label that the training part has enough rows of."""
    from netloom.catalog import ml_metrics

    rows = ml_metrics(spark, "/root/testdata/sf0.01").collect()
    assert {r["model"] for r in rows} == {"primary", "alternative", "secondary"}
    for r in rows:
        assert r["tp"] <= r["support"]
        if r["support"] >= 20:
            assert r["recall"] >= 0.6 and r["precision"] >= 0.6, r
