"""Scans of files with one JSON object per line."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition


def exists(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    return bool(target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(target))


def scan(spark: SparkSession, path: str, schema: T.StructType | str, strict: bool = True) -> DataFrame:
    """Objects of the file or folder; blank lines are skipped.

    A strict scan fails on a line that is no object of the schema. Otherwise such lines come with column
    ``_corrupt_record``, the text of the line. Only the columns of the schema are parsed.
    """
    kind = T._parse_datatype_string(schema) if isinstance(schema, str) else schema
    if strict:
        return spark.read.schema(kind).option("mode", "FAILFAST").json(path)
    kept = T.StructType([*kind.fields, T.StructField("_corrupt_record", T.StringType())])
    return spark.read.schema(kept).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt_record").json(path)


def optional_scan(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """As ``scan``; a path that is not there is an empty table."""
    return scan(spark, path, schema) if exists(spark, path) else spark.createDataFrame([], schema)


def count(spark: SparkSession, path: str) -> int:
    """Non-blank lines, without parsing them."""
    return spark.read.text(path).filter(F.trim("value") != "").count()


def torn_tails(spark: SparkSession, path: str) -> DataFrame:
    """Files whose last line has no end: ``path``. Only the last byte is looked at."""
    files = spark.read.format("binaryFile").load(path)
    return files.filter((F.col("length") > 0) & (F.right(F.hex(F.substring("content", -1, 1)), F.lit(2)) != "0A")).select("path")


def dispatched(spark: SparkSession, path: str, schemas: dict[str, T.StructType | str]) -> dict[str | None, DataFrame]:
    """Rows by ``schema_version``, each read with its own schema; under None ``line, version`` of what no schema fits."""
    lines = spark.read.text(path).filter(F.trim("value") != "")
    versioned = lines.withColumn("version", F.get_json_object("value", "$.schema_version"))
    out: dict[str | None, DataFrame] = {}
    for version, schema in schemas.items():
        text = schema if isinstance(schema, str) else schema.simpleString().removeprefix("struct<").removesuffix(">")
        out[version] = versioned.filter(F.col("version") == version).select(F.from_json("value", text).alias("r")).select("r.*")
    known = F.coalesce(F.col("version").isin(*schemas), F.lit(False))
    out[None] = versioned.filter(~known).select(F.col("value").alias("line"), "version")
    return out


class _Range(InputPartition):
    def __init__(self, start: int, end: int):
        self.start, self.end = start, end


class _OffsetReader(DataSourceReader):
    def __init__(self, path: str, split: int):
        self.path, self.split = path, split

    def partitions(self) -> list[InputPartition]:
        import os

        size = os.path.getsize(self.path)
        return [_Range(a, min(size, a + self.split)) for a in range(0, size, self.split)]

    def read(self, partition: _Range) -> Iterator[tuple]:
        with open(self.path, "rb") as f:
            at = partition.start
            if at:
                f.seek(at - 1)
                f.readline()  # the line that began before belongs to the range before
                at = f.tell()
            while at < partition.end and (line := f.readline()):
                if line.strip():
                    yield at, len(line), line.decode().rstrip("\r\n")
                at += len(line)


class OffsetLines(DataSource):
    """Format ``jsonl_offsets``: lines of one file with the byte at which each starts; ranges are read in parallel."""

    @classmethod
    def name(cls) -> str:
        return "jsonl_offsets"

    def schema(self) -> str:
        return "offset long, bytes int, line string"

    def reader(self, schema: T.StructType) -> DataSourceReader:
        return _OffsetReader(self.options["path"], int(self.options.get("split", str(16 << 20))))


def with_offsets(spark: SparkSession, path: str, split: int = 16 << 20) -> DataFrame:
    spark.dataSource.register(OffsetLines)
    return spark.read.format("jsonl_offsets").option("split", split).load(path)


def record_at(path: str, offset: int) -> dict:
    """The object that starts at a byte of the file."""
    with open(path, "rb") as f:
        f.seek(offset)
        return json.loads(f.readline())


#: Readers of further formats by name, as (session, path) -> rows.
READERS: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "parquet": lambda s, p: s.read.parquet(p),
    "orc": lambda s, p: s.read.orc(p),
    "csv": lambda s, p: s.read.option("header", True).csv(p),
    "json": lambda s, p: s.read.json(p),
    "text": lambda s, p: s.read.text(p),
}


def arrow_files(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Arrow files, each read batch by batch in one task, with the number of the file in column ``shard``."""
    import pyarrow as pa

    def reader(path: str):
        source = pa.memory_map(path)
        try:
            file = pa.ipc.open_file(source)
            return file.schema, (file.get_batch(i) for i in range(file.num_record_batches))
        except pa.ArrowInvalid:
            stream = pa.ipc.open_stream(source)
            return stream.schema, stream

    from pyspark.sql.pandas.types import from_arrow_schema

    schema = from_arrow_schema(reader(paths[0])[0]).add("shard", T.IntegerType())

    def work(batches):
        for batch in batches:
            for shard, path in zip(batch.column("shard").to_pylist(), batch.column("path").to_pylist()):
                for part in reader(path)[1]:
                    yield pa.RecordBatch.from_arrays([*part.columns, pa.array([shard] * part.num_rows, pa.int32())], names=schema.names)

    listed = spark.createDataFrame(list(enumerate(paths)), "shard int, path string").repartition(len(paths), "shard")
    return listed.mapInArrow(work, schema)


def log_events(spark: SparkSession, path: str, marker: str, schema: str) -> DataFrame:
    """JSON objects that follow a marker in the lines of a log."""
    found = F.regexp_extract("value", rf"{marker}\s*(\{{.*\}})\s*$", 1)
    return spark.read.text(path).select(F.from_json(F.nullif(found, F.lit("")), schema).alias("r")).filter("r is not null").select("r.*")
