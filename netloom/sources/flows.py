"""Labelled flow files: raw CSV files and prepared daily files."""

import csv
import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from netloom.schema import FEATURES, LABEL, PREPARED_FILES, RAW_LABEL, RAW_TO_FEATURE


def _fs(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    hadoop_path = jvm.org.apache.hadoop.fs.Path(path)
    return hadoop_path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), hadoop_path


def _join(folder: str, name: str) -> str:
    return folder.rstrip("/") + "/" + name


def csv_files(spark: SparkSession, path: str) -> list[str]:
    """A CSV file, or all `*.csv` of a folder in name order, on any Hadoop file system."""
    fs, p = _fs(spark, path)
    if not fs.exists(p):
        raise FileNotFoundError(f"no such source: {path}")
    if not fs.getFileStatus(p).isDirectory():
        if not path.lower().endswith(".csv"):
            raise ValueError(f"not a CSV file: {path}")
        return [path]
    names = sorted(s.getPath().getName() for s in fs.listStatus(p) if s.getPath().getName().endswith(".csv"))
    if not names:
        raise FileNotFoundError(f"no CSV files in {path}")
    return [_join(path, n) for n in names]


def header(spark: SparkSession, file: str) -> list[str]:
    """Trimmed column names; reads the first line only."""
    line = spark.read.text(file).first()
    return [n.strip() for n in next(csv.reader([line[0]]))] if line else []


def missing_features(columns: list[str]) -> list[str]:
    """Features present neither under their raw nor under their own name."""
    have = {RAW_TO_FEATURE.get(c.strip(), c.strip()) for c in columns}
    return [f for f in FEATURES if f not in have]


def _read_csv(spark: SparkSession, file: str, names: list[str]) -> DataFrame:
    schema = T.StructType([T.StructField(n, T.StringType()) for n in names])
    return spark.read.schema(schema).option("header", True).option("enforceSchema", True).csv(file)


def read_raw_flows(spark: SparkSession, path: str, label: str = RAW_LABEL) -> DataFrame:
    """All source files as text columns with their `source_file`.

    Headers of all files are checked before any row is read. Files with equal headers
    are read by one scan.
    """
    groups: dict[tuple, list[str]] = {}
    for file in csv_files(spark, path):
        names = header(spark, file)
        if label not in names:
            raise ValueError(f"label column '{label}' not found in {file}")
        missing = missing_features(names)
        if missing:
            raise ValueError(f"missing feature columns in {file}: " + ", ".join(missing))
        groups.setdefault(tuple(names), []).append(file)
    out = None
    for names, files in groups.items():
        part = _read_csv(spark, files, list(names)).withColumn("source_file", F.input_file_name())
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    return out


def read_prepared_flows(spark: SparkSession, folder: str | None = None, files: list[str] | None = None) -> DataFrame:
    """The ten prepared daily files, in a fixed order; a missing or foreign file is an error."""
    if files is None:
        if folder is None:
            raise ValueError("either a folder or files must be given")
        fs, p = _fs(spark, folder)
        if not fs.exists(p) or not fs.getFileStatus(p).isDirectory():
            raise FileNotFoundError(f"no such folder: {folder}")
        files = [_join(folder, n) for n in PREPARED_FILES]
    by_name = {os.path.basename(f): f for f in files}
    absent = [n for n in PREPARED_FILES if n not in by_name]
    if absent:
        raise FileNotFoundError("missing prepared files: " + ", ".join(absent))
    foreign = sorted(set(by_name) - set(PREPARED_FILES))
    if foreign:
        raise ValueError("unexpected prepared files: " + ", ".join(foreign))
    parts = []
    for n in PREPARED_FILES:
        fs, p = _fs(spark, by_name[n])
        if not fs.exists(p):
            raise FileNotFoundError(f"no such prepared file: {by_name[n]}")
        names = header(spark, by_name[n])
        lacking = [c for c in [*FEATURES, LABEL] if c not in names]
        if lacking:
            raise ValueError(f"missing columns in {n}: " + ", ".join(lacking))
        parts.append(_read_csv(spark, by_name[n], names).select(*FEATURES, LABEL))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out
