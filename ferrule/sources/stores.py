"""Tables that grow: resumable indexes, durable appends, publications, reports."""

from __future__ import annotations

import io
import json
import os
import time
import tomllib
import uuid
import zipfile
from collections.abc import Callable
from dataclasses import fields

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ferrule.sources import zips

BUCKETS = 64


def _bucket(key: str):
    return F.pmod(F.xxhash64(key), F.lit(BUCKETS)).cast("int")


def exists(spark: SparkSession, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def rename(spark: SparkSession, source: str, target: str) -> bool:
    """Renames unless the target exists."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    fs = path(source).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return not fs.exists(path(target)) and fs.rename(path(source), path(target))


def digest(df: DataFrame) -> str:
    """A digest of a table's rows, whatever their order."""
    row = F.xxhash64(*[F.col(f"`{c}`").cast("string") for c in df.columns])
    sums = df.agg(F.count("*").alias("n"), F.bit_xor(row).alias("x"), F.sum(F.pmod(row, F.lit(1 << 31))).alias("s")).first()
    return f"{sums['n']}-{sums['x']}-{sums['s']}"


def build_index(documents: DataFrame, key: str, encode: Callable[[DataFrame], DataFrame], path: str) -> DataFrame:
    """Adds to the index at ``path`` the rows that ``encode`` makes of documents that its ledger lacks; returns what was left to do.

    Rows are written by bucket of the key, then the ledger (key and digest of
    the document), so that a run that dies repeats its documents; the reader
    drops rows without a ledger entry of the same run. A document whose content
    differs from the ledger's is an error.
    """
    spark, run = documents.sparkSession, uuid.uuid4().hex
    marked = documents.withColumn("_digest", F.sha2(F.to_json(F.struct(*documents.columns)), 256))
    if exists(spark, f"{path}/ledger"):
        done = spark.read.parquet(f"{path}/ledger").select(F.col(key).alias("_key"), F.col("digest").alias("_known"))
        seen = marked.join(done, F.col(key) == F.col("_key"), "left")
        changed = F.col("_known").isNotNull() & (F.col("_known") != F.col("_digest"))
        marked = seen.withColumn("_digest", F.when(changed, F.raise_error(F.lit("a document of the index has changed")).cast("string")).otherwise(F.col("_digest"))).where("_known is null or _known <> _digest").drop("_key", "_known")
    todo = marked.select(*documents.columns)
    rows = encode(todo).withColumn("_run", F.lit(run)).withColumn("_bucket", _bucket(key))
    rows.write.mode("append").partitionBy("_bucket").parquet(f"{path}/rows")
    marked.select(key, F.col("_digest").alias("digest"), F.lit(run).alias("run")).write.mode("append").parquet(f"{path}/ledger")
    return todo


def read_index(spark: SparkSession, path: str, key: str, only: list | None = None) -> DataFrame:
    """The index's rows with a ledger entry; with ``only``, those keys, read from their buckets alone."""
    rows = spark.read.parquet(f"{path}/rows")
    if only is not None:
        keys = [r["b"] for r in spark.createDataFrame([(k,) for k in only], rows.select(key).schema).select(_bucket(key).alias("b")).distinct().collect()]
        rows = rows.where(F.col("_bucket").isin(keys) & F.col(key).isin(only))
    ledger = spark.read.parquet(f"{path}/ledger").select(key, F.col("run").alias("_run"))
    return rows.join(ledger, [key, "_run"], "left_semi").drop("_run", "_bucket")


def append(df: DataFrame, path: str, key: str, resume: bool) -> DataFrame:
    """Appends rows whose key the store lacks as JSON lines; without ``resume`` an existing store is an error. Returns the rows added."""
    spark = df.sparkSession
    there = exists(spark, path)
    if there and not resume:
        raise FileExistsError(path)
    new = df.join(spark.read.json(path).select(F.col(key).cast(df.schema[key].dataType).alias(key)), key, "left_anti") if there else df
    new = new.select(*df.columns)
    new.write.mode("append").json(path)
    return new


def publish(df: DataFrame, path: str) -> str:
    """Writes a table beside its place and renames it there: "published"; "identical" if one of the same rows is there; another one is an error."""
    spark, beside = df.sparkSession, f"{path}.{uuid.uuid4().hex}.tmp"
    df.write.parquet(beside)
    if rename(spark, beside, path):
        return "published"
    if digest(spark.read.parquet(path)) == digest(spark.read.parquet(beside)):
        return "identical"
    raise FileExistsError(f"{path} holds other rows")


class SingleWriter:
    """A lock: a file that only one writer can create, taken away at the end.

    A writer that dies leaves its file. It is good for ``lease`` seconds after
    it was last renewed, by the file system's clock as far as the machines' clocks agree; then another writer may take over. A writer that
    works longer calls ``renew`` in time, which fails if the lock was lost.
    """

    def __init__(self, spark: SparkSession, path: str, lease: float = 600.0):
        self.spark, self.path, self.lease, self.token = spark, f"{path}.lock", lease, uuid.uuid4().hex
        self._path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        self.fs = self._path(self.path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _stale(self, path: str) -> bool:
        return time.time() * 1000 - self.fs.getFileStatus(self._path(path)).getModificationTime() > 1000 * self.lease

    def _create(self) -> bool:
        """Writes the token beside and renames it, which fails if the lock is there."""
        beside = f"{self.path}.{self.token}"
        out = self.fs.create(self._path(beside), True)
        out.write(self.token.encode())
        out.close()
        if not self.fs.exists(self._path(self.path)) and self.fs.rename(self._path(beside), self._path(self.path)) and self._holder() == self.token:
            return True
        self.fs.delete(self._path(beside), False)
        return False

    def _holder(self) -> str:
        stream = self.fs.open(self._path(self.path))
        try:
            return bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()

    def __enter__(self) -> SingleWriter:
        if self._create():
            return self
        # Of those who find it stale one gets to move it away.
        aside = f"{self.path}.{self.token}.stale"
        if self._stale(self.path) and self.fs.rename(self._path(self.path), self._path(aside)):
            if not self._stale(aside):  # somebody took over in between: give it back
                self.fs.rename(self._path(aside), self._path(self.path))
            else:
                self.fs.delete(self._path(aside), False)
                if self._create():
                    return self
        raise RuntimeError(f"{self.path} is held by another writer")

    def renew(self) -> None:
        if not self.fs.exists(self._path(self.path)) or self._holder() != self.token:
            raise RuntimeError(f"{self.path} was lost to another writer")
        self.fs.setTimes(self._path(self.path), int(time.time() * 1000), -1)

    def __exit__(self, *_) -> None:
        if self.fs.exists(self._path(self.path)) and self._holder() == self.token:
            self.fs.delete(self._path(self.path), False)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.option("header", True).csv(path)


def markdown(df: DataFrame, title: str, most: int = 1_000) -> str:
    """A report table in Markdown, of at most ``most`` rows: reports are read by people."""
    rows = df.limit(most).collect()
    cell = lambda x: "" if x is None else f"{x:.4f}" if isinstance(x, float) else str(x).replace("|", "\\|")
    lines = [f"# {title}", "", f"| {' | '.join(df.columns)} |", f"|{'---|' * len(df.columns)}", *[f"| {' | '.join(map(cell, r))} |" for r in rows]]
    return "\n".join(lines) + "\n"


def zip_members(spark: SparkSession, path: str, pattern: str = ".*") -> DataFrame:
    """(archive, name, size, content) of the members of ZIP archives whose name matches, read by ranges (``zips``)."""
    return zips.members(spark, path, pattern)


def ranged_member(read: Callable[[int, int], bytes], size: int, name: str) -> bytes:
    """One member of a ZIP archive through range reads (offset, length): the directory at the end, then the member's own bytes."""

    class Ranges(io.RawIOBase):
        at = 0

        def seekable(self) -> bool:
            return True

        def readable(self) -> bool:
            return True

        def tell(self) -> int:
            return self.at

        def seek(self, offset: int, whence: int = 0) -> int:
            self.at = offset + (0, self.at, size)[whence]
            return self.at

        def readinto(self, into) -> int:
            data = read(self.at, min(len(into), size - self.at)) if self.at < size else b""
            into[: len(data)] = data
            self.at += len(data)
            return len(data)

    with zipfile.ZipFile(io.BufferedReader(Ranges(), 1 << 16)) as z:
        return z.read(name)


def typed_config(kind: type, path: str | None = None, prefix: str | None = None):
    """A dataclass from a TOML or JSON file and then from the environment (PREFIX_FIELD); unknown and missing fields are errors."""
    values: dict = {}
    if path:
        with open(path, "rb") as f:
            values = tomllib.load(f) if path.endswith(".toml") else json.load(f)
    known = {f.name: f for f in fields(kind)}
    if set(values) - set(known):
        raise ValueError(f"unknown fields {sorted(set(values) - set(known))}")
    for name, f in known.items():
        text = os.environ.get(f"{prefix}_{name.upper()}") if prefix else None
        if text is not None:
            kinds = {"int": int, "float": float, "bool": lambda x: x.lower() in ("1", "true", "yes"), "str": str}
            values[name] = kinds[f.type if isinstance(f.type, str) else f.type.__name__](text)
    return kind(**values)


def page_fixture(hits: DataFrame, pages: DataFrame, key: str, count: int = 4) -> DataFrame:
    """(key, rank, document, page, sha256): each key's ``count`` ordered pages with their content's digest; keys with fewer, or pages without content, are errors."""
    j = hits.join(pages.select("document", "page", F.sha2("content", 256).alias("sha256")), ["document", "page"], "left")
    n = j.groupBy(key).agg(F.count("sha256").alias("_n"))
    bad = F.raise_error(F.concat(F.lit("not all pages of "), F.col(key).cast("string"))).cast("string")
    return j.join(n, key).select(key, "rank", "document", "page", F.when(F.col("_n") != count, bad).otherwise(F.col("sha256")).alias("sha256"))
