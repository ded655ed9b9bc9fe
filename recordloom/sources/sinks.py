"""Outputs that are written once, with what proves them."""

from __future__ import annotations

import gzip
import hashlib
import json
import os
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from recordloom.operators.ordering import shard, with_position
from recordloom.session import materialize
from recordloom.sources.jsonl import exists


def _rename(spark: SparkSession, source: str, target: str) -> bool:
    jvm = spark.sparkContext._jvm
    a, b = jvm.org.apache.hadoop.fs.Path(source), jvm.org.apache.hadoop.fs.Path(target)
    return a.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).rename(a, b)


def _delete(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    a = jvm.org.apache.hadoop.fs.Path(path)
    a.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(a, True)


def digest(rows: DataFrame) -> tuple[int, str]:
    """Number of rows and a hash of them that does not depend on their order.

    Sums of two independent 64-bit hashes of each row's JSON, so each task sends one row.
    """
    line = F.to_json(F.struct(*sorted(rows.columns)), {"ignoreNullFields": "false"})
    r = rows.select(line.alias("l")).agg(
        F.count("*").alias("n"),
        F.sum(F.xxhash64("l").cast("decimal(38,0)")).alias("a"),
        F.sum(F.xxhash64(F.concat(F.lit("#"), F.col("l"))).cast("decimal(38,0)")).alias("b"),
    ).first()
    return r.n, hashlib.sha256(f"{r.n},{r.a},{r.b}".encode()).hexdigest()


def publish_once(rows: DataFrame, path: str, fmt: str = "json") -> str:
    """Write rows to a new folder: ``published``; the same rows again: ``unchanged``; other rows: an error.

    Written beside the target and renamed, so a reader never sees a part of it.
    """
    spark = rows.sparkSession
    if exists(spark, path):
        there = spark.read.schema(rows.schema).format(fmt).load(path)
        if digest(there) == digest(rows):
            return "unchanged"
        raise FileExistsError(f"{path} holds other rows")
    beside = f"{path.rstrip('/')}.part"
    rows.write.mode("overwrite").format(fmt).save(beside)
    if not _rename(spark, beside, path):
        raise OSError(f"{beside} could not be renamed")
    return "published"


def publish_together(outputs: dict[str, DataFrame], folder: str) -> None:
    """Several tables that appear together or not at all: one rename of the folder that holds them."""
    spark = next(iter(outputs.values())).sparkSession
    if exists(spark, folder):
        raise FileExistsError(folder)
    beside = f"{folder.rstrip('/')}.part"
    _delete(spark, beside)
    for name, rows in outputs.items():
        rows.write.parquet(f"{beside}/{name}")
    if not _rename(spark, beside, folder):
        raise OSError(f"{beside} could not be renamed")


def publish_report(report: dict, path: str) -> str:
    """One small JSON object, written once."""
    text = json.dumps(report, sort_keys=True, ensure_ascii=False, indent=1) + "\n"
    if os.path.exists(path):
        with open(path, encoding="utf-8") as f:
            if f.read() == text:
                return "unchanged"
        raise FileExistsError(f"{path} holds another report")
    with open(path + ".part", "w", encoding="utf-8") as f:
        f.write(text)
        f.flush()
        os.fsync(f.fileno())
    os.replace(path + ".part", path)
    return "published"


def publish_split(rows: DataFrame, parts: dict[str, str], folder: str) -> dict[str, int]:
    """Rows written to several tables by conditions, from one evaluation of the rows; returns the counts."""
    once = materialize(rows, "split")
    tables = {name: once.filter(condition) for name, condition in parts.items()}
    publish_together(tables, folder)
    spark = rows.sparkSession
    return {name: spark.read.parquet(f"{folder}/{name}").count() for name in parts}


def gzip_shards(rows: DataFrame, order: list[str], folder: str, per_shard: int, split: str = "train") -> DataFrame:
    """JSON lines in gzip shards of ``per_shard`` rows in an order, named ``train-00000-of-00003.jsonl.gz``.

    Equal rows give equal bytes: no file name and time stand in the header. Each shard is written by one task, which
    holds one row at a time. Returns ``name, rows, bytes, sha256``. The folder must be one that all executors share.
    """
    columns = list(rows.columns)
    numbered = with_position(rows, order)
    shards = max(1, -(-numbered.count() // per_shard))
    lines = numbered.select(shard(F.col("position"), per_shard).alias("shard"), "position", F.to_json(F.struct(*columns)).alias("line"))
    os.makedirs(folder, exist_ok=True)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, count, raw, out = None, 0, None, None
        done: list[tuple] = []

        def close() -> None:
            out.close()
            raw.close()
            os.replace(f"{folder}/{name}.part", f"{folder}/{name}")
            with open(f"{folder}/{name}", "rb") as f:
                done.append((name, count, os.path.getsize(f"{folder}/{name}"), hashlib.file_digest(f, "sha256").hexdigest()))

        for batch in batches:
            for k, line in zip(batch.column("shard").to_pylist(), batch.column("line").to_pylist()):
                here = f"{split}-{k:05d}-of-{shards:05d}.jsonl.gz"
                if here != name:
                    if name:
                        close()
                    name, count = here, 0
                    raw = open(f"{folder}/{name}.part", "wb")
                    out = gzip.GzipFile(filename="", mode="wb", fileobj=raw, compresslevel=9, mtime=0)
                out.write((line + "\n").encode())
                count += 1
        if name:
            close()
        columns = list(zip(*done)) or [()] * 4
        types = (pa.string(), pa.int64(), pa.int64(), pa.string())
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=["name", "rows", "bytes", "sha256"])

    dealt = lines.repartition("shard").sortWithinPartitions("shard", "position").select("shard", "line")
    return materialize(dealt.mapInArrow(write, "name string, rows long, bytes long, sha256 string"), "shards")


def audit_shards(spark: SparkSession, folder: str, manifest: DataFrame) -> DataFrame:
    """Shards that differ from a manifest ``name, rows, bytes, sha256``: missing, extra or changed ones."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(folder)
    there = files.select(F.element_at(F.split("path", "/"), -1).alias("name"), F.col("length").alias("_bytes"), F.sha2("content", 256).alias("_sha"))
    joined = manifest.join(there, "name", "full")
    same = (F.col("bytes") == F.col("_bytes")) & (F.col("sha256") == F.col("_sha"))
    return joined.filter(~F.coalesce(same, F.lit(False))).select("name")


def file_digests(spark: SparkSession, path: str) -> DataFrame:
    """``name, bytes, sha256`` of files."""
    files = spark.read.format("binaryFile").load(path)
    return files.select(F.element_at(F.split("path", "/"), -1).alias("name"), F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))


def seal(rows: DataFrame, path: str) -> dict:
    """Archive of rows (Parquet, zstd), read again and compared before it counts as sealed."""
    spark = rows.sparkSession
    before = digest(rows)
    rows.write.option("compression", "zstd").parquet(path)
    after = digest(spark.read.schema(rows.schema).parquet(path))
    if before != after:
        _delete(spark, path)
        raise ValueError("the archive does not hold what was written")
    return {"rows": before[0], "sha256": before[1]}


def markdown_table(report: DataFrame, limit: int = 100) -> str:
    """A small report as a table of text; of a longer one the first rows, and how many are left out."""
    rows = report.limit(limit + 1).collect()
    head = [f"| {' | '.join(report.columns)} |", f"|{'---|' * len(report.columns)}"]
    body = [f"| {' | '.join('' if v is None else str(v) for v in r)} |" for r in rows[:limit]]
    return "\n".join(head + body + (["", "More rows are left out."] if len(rows) > limit else [])) + "\n"
