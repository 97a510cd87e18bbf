"""A table that a stream adds to exactly once: a Python data source with a commit log by batch.

Tasks write a batch's rows as Parquet files under ``data``; the driver then puts
one entry into ``log``, named by the batch, that lists them. An entry is made by
one step that fails if it is there, so a batch that is run again (Spark repeats
the last one after a crash) adds nothing: its new files are deleted. Files of a
batch that died between writing and commit are in no entry and never read;
``vacuum`` deletes them. A batch touches its own files and one entry, however large
the table is.

A table is fed by one stream: ``owner.json`` names it, and another one is an error,
since its batches have the same numbers.
"""

from __future__ import annotations

import json
import os
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamArrowWriter, WriterCommitMessage
from pyspark.sql.streaming import DataStreamWriter
from pyspark.sql.types import StructType


def file_system(path: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a path and the path within it; ``file:`` and plain paths are local."""
    if path.startswith("file:"):
        path = "/" + path.removeprefix("file:").lstrip("/")
    return (pafs.LocalFileSystem(), path) if path.startswith("/") else pafs.FileSystem.from_uri(path)


def put_new(fs: pafs.FileSystem, path: str, content: bytes) -> bool:
    """Makes a file of ``content``, whole or not at all; False if it was there.

    Locally by a link, which fails if the name is taken. Elsewhere by a move
    after a look: a stream has one driver, so nobody else makes its entries.
    """
    fs.create_dir(os.path.dirname(path), recursive=True)
    if fs.get_file_info(path).type != pafs.FileType.NotFound:
        return False
    beside = f"{os.path.dirname(path)}/.{os.path.basename(path)}.{uuid.uuid4().hex}"
    with fs.open_output_stream(beside) as f:
        f.write(content)
    if not isinstance(fs, pafs.LocalFileSystem):
        fs.move(beside, path)
        return True
    with open(beside, "rb") as f:
        os.fsync(f.fileno())
    try:
        os.link(beside, path)
    except FileExistsError:
        return False
    finally:
        os.unlink(beside)
    return True


@dataclass
class Written(WriterCommitMessage):
    name: str | None
    rows: int


class BatchWriter(DataSourceStreamArrowWriter):
    def __init__(self, path: str):
        self.path = path

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        fs, path = file_system(self.path)
        name, writer, rows = f"{uuid.uuid4().hex}.parquet", None, 0
        for batch in iterator:
            if batch.num_rows:
                if writer is None:
                    fs.create_dir(f"{path}/data", recursive=True)
                    out = fs.open_output_stream(f"{path}/data/{name}")
                    writer = pq.ParquetWriter(out, batch.schema, compression="zstd")
                writer.write_batch(batch)
                rows += batch.num_rows
        if writer is None:
            return Written(None, 0)
        writer.close()
        out.close()
        return Written(name, rows)

    def commit(self, messages: list[Written | None], batchId: int) -> None:
        fs, path = file_system(self.path)
        files = [{"name": m.name, "rows": m.rows} for m in messages if m and m.name]
        if not put_new(fs, f"{path}/log/{batchId}.json", json.dumps({"batch": batchId, "files": files}).encode()):
            self.abort(messages, batchId)

    def abort(self, messages: list[Written | None], batchId: int) -> None:
        fs, path = file_system(self.path)
        for m in messages:
            if m and m.name and fs.get_file_info(f"{path}/data/{m.name}").type != pafs.FileType.NotFound:
                fs.delete_file(f"{path}/data/{m.name}")


class CommittedTable(DataSource):
    """Options: ``path``, and ``stream``, the name of the stream that feeds the table."""

    @classmethod
    def name(cls) -> str:
        return "ferrule_committed"

    def streamWriter(self, schema: StructType, overwrite: bool) -> BatchWriter:
        fs, path = file_system(self.options["path"])
        own = {"stream": self.options["stream"], "schema": schema.json()}
        if not put_new(fs, f"{path}/owner.json", json.dumps(own).encode()):
            with fs.open_input_stream(f"{path}/owner.json") as f:
                owner = json.loads(f.read())
            if owner != own:
                raise ValueError(f"{path} is fed by stream {owner['stream']}, or has other columns")
        return BatchWriter(self.options["path"])


def written(stream: DataFrame, path: str, checkpoint: str) -> DataStreamWriter:
    """A writer of ``stream`` to the table at ``path``; the checkpoint names the stream, so both belong together."""
    stream.sparkSession.dataSource.register(CommittedTable)
    return stream.writeStream.format(CommittedTable.name()).option("path", path).option("stream", checkpoint.rstrip("/")).option("checkpointLocation", checkpoint).outputMode("append")


def committed(spark: SparkSession, path: str) -> DataFrame:
    """The rows of committed batches; an error if no stream has been started for the table."""
    fs, local = file_system(path)
    with fs.open_input_stream(f"{local}/owner.json") as f:
        schema = StructType.fromJson(json.loads(json.loads(f.read())["schema"]))
    found = fs.get_file_info([f"{local}/data", f"{local}/log"])
    if any(x.type == pafs.FileType.NotFound for x in found):
        return spark.createDataFrame([], schema)
    log = spark.read.schema("batch long, files array<struct<name: string, rows: long>>").json(f"{path}/log/*.json")
    names = log.select(F.explode("files.name").alias("_name"))
    rows = spark.read.schema(schema).parquet(f"{path}/data").withColumn("_file", F.col("_metadata.file_name"))
    return rows.join(names, rows["_file"] == names["_name"], "left_semi").drop("_file")


def vacuum(spark: SparkSession, path: str) -> int:
    """Deletes files that are in no entry, left by batches that died; returns how many. No stream may be running."""
    fs, local = file_system(path)
    if fs.get_file_info(f"{local}/data").type == pafs.FileType.NotFound:
        return 0
    log = spark.read.schema("files array<struct<name: string>>").json(f"{path}/log/*.json").select(F.explode("files.name").alias("name"))
    there = spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").load(f"{path}/data").select(F.element_at(F.split("path", "/"), -1).alias("name"))
    gone = 0
    for r in there.join(log, "name", "left_anti").toLocalIterator():
        fs.delete_file(f"{local}/data/{r['name']}")
        gone += 1
    return gone
