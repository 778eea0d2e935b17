"""Sinks: data sets with metadata, keyed tables, fan-out and bounded logs."""

import json
import uuid
from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from netloom.operators.dataset import label_counts, prepare, proportional_targets, stratified_split
from netloom.schema import FEATURES, LABEL, RAW_LABEL
from netloom.session import stored
from netloom.sources.flows import _fs, _join, csv_files, read_raw_flows

# Key column and policy of each stored table.
TABLE_POLICY = {
    "ids_events": ("event_id", "first"),
    "engine_commands": ("command_id", "first"),
    "sql_injection_events": ("request_id", "first"),
    "network_sessions": ("session_id", "last"),
    "alerts": ("dedup_key", "last"),
    "block_events": ("event_id", "last"),
}


def _exists(spark: SparkSession, path: str) -> bool:
    fs, p = _fs(spark, path)
    return fs.exists(p)


def _row_hash(df: DataFrame):
    """Tells rows apart that are equal in time."""
    return F.xxhash64(*[f.name for f in df.schema.fields if f.dataType.typeName() not in ("map", "variant")])


def merged(rows: DataFrame, key: str, policy: str, order: str) -> DataFrame:
    """One row per key of writes numbered by `_gen`: the first or the last by `_gen` and `order`; equal times go by a hash of the row.

    Copies of a key reduce by partial aggregation, so a key that repeats without end
    never gathers in one task. Merging a run of adjacent writes first changes no result.
    """
    rank = F.struct("_gen", order, _row_hash(rows.drop("_gen")))
    pick = F.min_by if policy == "first" else F.max_by
    return rows.groupBy(F.col(key).alias("_key")).agg(pick(F.struct(*rows.columns), rank).alias("_v")).select("_v.*")


def _pointers(spark: SparkSession, path: str) -> list[str]:
    """Complete pointer files of a table, the newest last."""
    fs, p = _fs(spark, path)
    if not fs.exists(p):
        return []
    names = sorted(s.getPath().getName() for s in fs.listStatus(p) if s.getPath().getName().startswith("current-"))
    return [n for n in names if _exists(spark, _join(_join(path, n), "_SUCCESS"))]


def _current(spark: SparkSession, path: str) -> str | None:
    names = _pointers(spark, path)
    return spark.read.text(_join(path, names[-1])).first()[0] if names else None


def _advance(spark: SparkSession, path: str, value: str, keep: int) -> tuple[list[str], list[str]]:
    """Point to `value`, and give the values of the pointers that stay and of those that went.

    Pointers are numbered and never overwritten; readers take the highest complete one. A job that dies before its
    pointer is complete leaves the table as it was.
    """
    names = _pointers(spark, path)
    fs, _ = _fs(spark, path)
    number = int(names[-1].rpartition("-")[2]) + 1 if names else 0
    pointer = f"current-{number:012d}"
    spark.createDataFrame([(value,)], "value string").coalesce(1).write.mode("overwrite").text(_join(path, pointer))
    values = {n: spark.read.text(_join(path, n)).first()[0] for n in names} | {pointer: value}
    gone = list(values)[:-keep]
    for name in gone:
        fs.delete(_fs(spark, _join(path, name))[1], True)
    return [v for n, v in values.items() if n not in gone], [values[n] for n in gone]


def publish(spark: SparkSession, path: str, generation: str, keep: int = 2) -> None:
    """Make a written generation current. Generations beyond the last `keep` go."""
    fs, _ = _fs(spark, path)
    for stale in _advance(spark, path, generation, keep)[1]:
        fs.delete(_fs(spark, stale)[1], True)


def _tail(sizes: list[int], fan_in: int) -> int:
    """How many of the newest runs of a bucket to merge: as many as each are no larger than all newer ones together, or none below `fan_in`."""
    take, total = 1, sizes[-1]
    while take < len(sizes) and sizes[-take - 1] <= total:
        total += sizes[-take - 1]
        take += 1
    return take if take >= fan_in else 0


def _write_run(rows: DataFrame, path: str, key: str, buckets: int) -> dict[str, list]:
    """Write rows by bucket of their key to a new folder: [folder, bytes] of each bucket that has rows."""
    spark = rows.sparkSession
    folder = _join(path, f"gen-{uuid.uuid4().hex}")
    # Adaptive execution brings a bucket into few files and splits a large one.
    bucketed = rows.withColumn("_bucket", F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")).hint("rebalance", "_bucket")
    bucketed.write.partitionBy("_bucket").parquet(folder)
    fs, p = _fs(spark, folder)
    found = {}
    for status in fs.listStatus(p):
        name = status.getPath().getName()
        if name.startswith("_bucket="):
            found[name.partition("=")[2]] = [_join(folder, name), fs.getContentSummary(status.getPath()).getLength()]
    return found


def _with_new(old: StructType, new: StructType) -> StructType:
    """The old columns, then the new ones; a column never changes its type."""
    known = {f.name: f.dataType for f in old.fields}
    for field in new.fields:
        if known.setdefault(field.name, field.dataType) != field.dataType:
            raise ValueError(f"column {field.name} is {known[field.name].simpleString()} in the table, not {field.dataType.simpleString()}")
    return StructType([StructField(n, t) for n, t in known.items()])


def _run_rows(spark: SparkSession, table: dict, folders: list[str]) -> DataFrame:
    schema = StructType.fromJson(table["schema"]).add("_gen", "long")
    return spark.read.schema(schema).parquet(*folders)


def upsert(
    incoming: DataFrame, path: str, key: str, policy: str = "last", order: str = "ts_us", buckets: int = 16, fan_in: int = 4, keep: int = 2
) -> None:
    """Idempotent keyed write to a table of hash buckets; what is written follows the batch, not the table.

    A batch is reduced to one row per key and added to its buckets as a new run. The newest runs of a touched bucket are
    merged once `fan_in` of them are each no larger than all newer ones together, so a row is rewritten a number of times
    that grows with the logarithm of the table. Buckets without new rows are never touched. The list of runs is published
    as one pointer: a lost executor or a retried batch leaves the table whole. Runs that none of the last `keep` pointers
    name go. One writer at a time. `buckets` counts for a new table only; take one for about 1 GB of final rows. Columns
    that come later are null in earlier rows. The names `_gen`, `_bucket`, `_key` and `_v` are reserved.
    """
    spark = incoming.sparkSession
    table = _manifest(spark, path) or {"key": key, "policy": policy, "order": order, "buckets": buckets, "number": 0, "schema": {"type": "struct", "fields": []}, "runs": {}}
    if (table["key"], table["policy"], table["order"]) != (key, policy, order):
        raise ValueError(f"the table keeps the {table['policy']} row of {table['key']} by {table['order']}")
    table["schema"] = _with_new(StructType.fromJson(table["schema"]), incoming.schema).jsonValue()
    table["number"] += 1
    added = _write_run(merged(incoming.withColumn("_gen", F.lit(table["number"]).cast("bigint")), key, policy, order), path, key, table["buckets"])
    runs = table["runs"]
    for bucket, run in added.items():
        runs.setdefault(bucket, []).append(run)
    due = {b: n for b in added if (n := _tail([size for _, size in runs[b]], fan_in))}
    if due:
        old = [folder for b, n in due.items() for folder, _ in runs[b][-n:]]
        compact = _write_run(merged(_run_rows(spark, table, old), key, policy, order), path, key, table["buckets"])
        for b, n in due.items():
            runs[b][-n:] = [compact[b]]
    kept, _ = _advance(spark, path, json.dumps(table), keep)
    _drop_unnamed(spark, path, {folder for value in kept for named in json.loads(value)["runs"].values() for folder, _ in named})


def _drop_unnamed(spark: SparkSession, path: str, named: set[str]) -> None:
    """Delete runs that no pointer names, also those a dead writer left."""
    fs, p = _fs(spark, path)
    for status in fs.listStatus(p):
        generation = status.getPath().getName()
        if not generation.startswith("gen-"):
            continue
        folder = _join(path, generation)
        inside = [_join(folder, s.getPath().getName()) for s in fs.listStatus(status.getPath()) if s.getPath().getName().startswith("_bucket=")]
        stale = [f for f in inside if f not in named]
        for target in [folder] if len(stale) == len(inside) else stale:
            fs.delete(_fs(spark, target)[1], True)


def _manifest(spark: SparkSession, path: str) -> dict | None:
    value = _current(spark, path)
    return None if value is None else json.loads(value)


def read_table(spark: SparkSession, path: str) -> DataFrame | None:
    """The current rows of a keyed table. Buckets of one run are read as they are, only others are merged."""
    table = _manifest(spark, path)
    if table is None:
        return None
    single = [named[0][0] for named in table["runs"].values() if len(named) == 1]
    several = [folder for named in table["runs"].values() if len(named) > 1 for folder, _ in named]
    parts = []
    if single:
        parts.append(_run_rows(spark, table, single))
    if several:
        parts.append(merged(_run_rows(spark, table, several), table["key"], table["policy"], table["order"]))
    if not parts:
        return spark.createDataFrame([], StructType.fromJson(table["schema"]))
    return reduce(DataFrame.unionByName, parts).drop("_gen")


def upsert_table(incoming: DataFrame, root: str, table: str, order: str = "ts_us") -> None:
    key, policy = TABLE_POLICY[table]
    upsert(incoming, _join(root, table), key, policy, order)


def fan_out(batch: DataFrame, root: str, tables: dict[str, Callable[[DataFrame], DataFrame]], batch_id: int) -> None:
    """Write every table that a (micro-)batch feeds: a name, and what takes its rows from the batch.

    The batch is cached, so that its source is read once. Each table takes a batch id once: written again, it replaces
    its rows. A writer that dies between two tables therefore writes the same rows when the batch comes again.
    """
    batch.persist()
    try:
        for name, rows_of in tables.items():
            rows_of(batch).write.mode("overwrite").parquet(_join(_join(root, name), f"batch={batch_id}"))
    finally:
        batch.unpersist()


def append_activity_jsonl(activity: DataFrame, path: str, keep: int = 50_000, t: str = "last_detected_us") -> None:
    """Append records as JSON lines and keep the newest `keep`; of equal times the lowest addresses and their highest counts."""
    spark = activity.sparkSession
    rows = activity
    generation = _join(path, f"gen-{uuid.uuid4().hex}")
    current = _current(spark, path)
    if current is not None:
        rows = spark.read.schema(activity.schema).json(current).unionByName(rows)
    counts = [F.desc(c) for c in rows.columns if c == "total_attack_attempts"]
    rows.orderBy(F.desc(t), "ip", *counts, _row_hash(rows)).limit(keep).select(*activity.columns).write.json(generation)
    publish(spark, path, generation)


def read_activity_jsonl(spark: SparkSession, path: str, schema) -> DataFrame:
    return spark.read.schema(schema).json(_current(spark, path))


def file_digests(spark: SparkSession, path: str) -> DataFrame:
    """SHA-256 of every data file under a path."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    return files.select("path", "length", F.sha2("content", 256).alias("sha256"))


def write_dataset(
    spark: SparkSession, source: str, out: str, test_size: float = 0.2, seed: int = 42, force: bool = False
) -> dict:
    """Prepare raw flows and write cleaned, train and test tables with their metadata.

    Existing outputs are refused unless `force`. Sources are checked before anything is
    written; the cleaned table is written once and the split is read from it.
    """
    if not 0 < test_size < 1:
        raise ValueError("test_size must lie between 0 and 1")
    paths = {k: _join(out, k) for k in ("cleaned", "train", "test", "metadata")}
    present = [p for p in paths.values() if _exists(spark, p)]
    if present and not force:
        raise FileExistsError("outputs exist already: " + ", ".join(present))
    files = csv_files(spark, source)
    raw = read_raw_flows(spark, source)
    prepared = stored(prepare(raw), "prepared")
    if prepared.isEmpty():
        raise ValueError("no valid rows remain")
    prepared.write.mode("overwrite").option("header", True).csv(paths["cleaned"])
    schema = prepared.schema
    cleaned = spark.read.schema(schema).option("header", True).csv(paths["cleaned"])
    split = stratified_split(cleaned, LABEL, test_size, seed, targets=proportional_targets)
    for name, part in (("train", split.filter(~F.col("is_test"))), ("test", split.filter("is_test"))):
        part.drop("is_test").write.mode("overwrite").option("header", True).csv(paths[name])

    def distribution(path: str) -> dict:
        rows = label_counts(spark.read.schema(schema).option("header", True).csv(path)).orderBy("label").collect()
        return {r["label"]: r["rows"] for r in rows}

    dist = {k: distribution(paths[k]) for k in ("cleaned", "train", "test")}
    source_rows = {r["source_file"]: r["count"] for r in raw.groupBy("source_file").count().collect()}
    meta = {
        "source_files": [
            {"path": f, "rows": next((v for k, v in source_rows.items() if k.endswith(f)), 0), "sha256": file_digests(spark, f).first()["sha256"]}
            for f in files
        ],
        "feature_columns": FEATURES,
        "label_column": LABEL,
        "raw_label_column": RAW_LABEL,
        "test_size": test_size,
        "random_seed": seed,
        "label_distribution": dist["cleaned"],
        "train_label_distribution": dist["train"],
        "test_label_distribution": dist["test"],
        **{f"{k}_rows": sum(v.values()) for k, v in dist.items()},
        "outputs": {
            k: {r["path"].rsplit("/", 1)[-1]: r["sha256"] for r in file_digests(spark, paths[k]).orderBy("path").collect()}
            for k in ("cleaned", "train", "test")
        },
    }
    spark.createDataFrame([(json.dumps(meta, sort_keys=True),)], "value string").coalesce(1).write.mode("overwrite").text(
        paths["metadata"]
    )
    return meta


def newest(df: DataFrame, n: int = 1000, t: str = "t_us", tie: str = "packet_id") -> DataFrame:
    """Ring buffer: the last n rows."""
    return df.orderBy(F.desc(t), F.desc(tie)).limit(n)


