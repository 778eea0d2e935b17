"""Spark session settings used by the tests, the benchmark and local runs."""

import functools
import os
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(cpus: str = "8", app: str = "netloom") -> SparkSession:
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", cpus if cpus.isdigit() else "8")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.checkpoint.dir", tempfile.mkdtemp(prefix="spark-", dir="/tmp"))
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return tuned(spark)


@functools.cache
def _package() -> str:
    """This package as a zip file; the driver serves it to the executors."""
    here = os.path.dirname(os.path.abspath(__file__))
    target = os.path.join(tempfile.mkdtemp(prefix="spark-", dir="/tmp"), "netloom")
    return shutil.make_archive(target, "zip", os.path.dirname(here), os.path.basename(here))


_shipped: set[str] = set()


def _ship(spark: SparkSession) -> None:
    """Make the package importable in Python workers, once per application."""
    app = spark.sparkContext.applicationId
    if app not in _shipped:
        spark.sparkContext.addPyFile(_package())
        _shipped.add(app)


def tuned(spark: SparkSession) -> SparkSession:
    """Settings the operators rely on, for any session.

    Times without zone are UTC. The JVM never compiles methods beyond 8000 bytes of
    bytecode; with 37 features a fused stage can exceed that, and then runs several times
    slower than the same operators unfused.
    """
    _ship(spark)
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    spark.conf.set("spark.sql.codegen.hugeMethodLimit", "8000")
    return spark


@functools.cache
def _local_dir() -> str:
    return tempfile.mkdtemp(prefix="spark-", dir="/tmp")


def shared_dir(spark: SparkSession) -> str:
    """The folder the cluster names for shared files; without one, a folder of this machine, which only a session whose tasks
    all run in this process can use."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if where:
        return where
    if not spark.sparkContext._jsc.sc().isLocal():
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    return _local_dir()


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh folder below the shared checkpoint folder."""
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """The same rows, written once to the shared folder and read back.

    For results with several consumers: it cuts the lineage, so that nothing upstream is
    computed twice and a lost executor costs a re-read.
    """
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
