"""Session set-up and tables that outlive a lost executor."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def build_session(master: str = "local[*]", **conf: str) -> SparkSession:
    """A session with the settings the engine expects; every setting can be overridden."""
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.ui.enabled": "false",
    } | conf
    return SparkSession.builder.master(master).config(map=settings).getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: ``spark.checkpoint.dir`` of the session.

    Where it is unset, a local session (as in tests) gets a folder of its own; a cluster session is refused, as a
    machine-local folder would be lost with its executor.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base:
        return base
    sc = spark.sparkContext
    known = sc.getCheckpointDir()
    if known:
        return known
    if not sc.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    sc.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="recordloom-"))
    return sc.getCheckpointDir()


def file_system(spark: SparkSession, path: str):
    """The Hadoop file system of a path, and the path for it."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), target


def _session_dir(spark: SparkSession) -> str:
    """The folder of this application's tables in the shared folder, which the driver's JVM removes when it ends."""
    path = f"{shared_dir(spark).rstrip('/')}/recordloom-{spark.sparkContext.applicationId}"
    fs, target = file_system(spark, path)
    if not fs.exists(target):
        fs.mkdirs(target)
        fs.deleteOnExit(target)
    return path


def release_tables(spark: SparkSession) -> None:
    """Remove the tables of all queries so far; their results must have been read."""
    fs, target = file_system(spark, _session_dir(spark))
    for entry in fs.listStatus(target):
        fs.delete(entry.getPath(), True)


def new_table_path(spark: SparkSession, label: str) -> str:
    """A fresh path in the shared folder, removed at the end of the application or by ``release_tables``."""
    return f"{_session_dir(spark)}/{label}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back: cuts lineage, and survives lost executors."""
    spark = df.sparkSession
    path = new_table_path(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def read_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """Table ``name`` of a data folder."""
    return spark.read.parquet(f"{folder}/{name}.parquet")
