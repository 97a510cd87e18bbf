"""Shared pieces of the training-data operators.

* ``stage`` writes a table to the shared folder of the cluster and reads it
  back: lineage is cut by files that outlive any executor.
* ``connected_components`` is a distributed min-label search with pointer
  jumping; links never reach the driver.
* ``complete_groups`` turns sorted Arrow batches into blocks of whole groups.
* ``WordBlocks`` splits UTF-8 bytes into words and hashes them in bulk.
"""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_LOCAL_DIRS: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """Folder that the driver and all executors see.

    ``spark.checkpoint.dir`` names it. Where it is unset, a local session
    (tests) gets a temporary folder; a cluster is refused, since a machine's
    own folder is invisible to the other machines.
    """
    where = spark.conf.get("spark.checkpoint.dir", None)
    if where:
        return where.rstrip("/")
    master = spark.conf.get("spark.master", "local")
    if not (master == "local" or master.startswith("local[")):
        raise RuntimeError("spark.checkpoint.dir must name a folder shared by the cluster")
    app = spark.sparkContext.applicationId
    if app not in _LOCAL_DIRS:
        _LOCAL_DIRS[app] = tempfile.mkdtemp(prefix="ferrule-")
    return _LOCAL_DIRS[app]


#: Paths handed out by this driver, in order.
_PATHS: list[str] = []


def new_path(spark: SparkSession, name: str) -> str:
    _PATHS.append(f"{shared_dir(spark)}/ferrule/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}")
    return _PATHS[-1]


@contextmanager
def staged_files(spark: SparkSession) -> Iterator[None]:
    """Deletes at its end what was staged within it; tables made of that can't be read afterwards."""
    mark = len(_PATHS)
    yield
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    for p in _PATHS[mark:]:
        path(p).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path(p), True)
    del _PATHS[mark:]


def stage(df: DataFrame, name: str, compression: str = "zstd") -> DataFrame:
    """Write ``df`` to the shared folder and return the written table. Not as lz4_raw, which the reader at times can't decompress (MalformedInputException on 1 GB of texts)."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.option("compression", compression).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def stage_buckets(df: DataFrame, name: str, key: str, compression: str = "zstd", level: int = 9) -> DataFrame:
    """Write ``df`` in buckets by ``key`` to the shared folder: later groups by ``key`` need no shuffle of it.

    Its entry in the catalogue is dropped at once; the files stay.
    """
    spark = df.sparkSession
    table = f"ferrule_{uuid.uuid4().hex}"
    buckets = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    path = new_path(spark, name)
    df.write.bucketBy(buckets, key).option("path", path).option("compression", compression).option("parquet.compression.codec.zstd.level", str(level)).saveAsTable(table)
    staged = spark.table(table)
    spark.sql(f"drop table {table}")
    return staged


#: A table of at most this many bytes (rows times the width of its columns) is broadcast; an id with more links than this is joined apart.
BROADCAST_BYTES, HOT_LINKS = 64 << 20, 1_000_000


def small_enough(df: DataFrame) -> bool:
    """Whether a table of numbers is small enough to be broadcast, by its rows and the width of its columns."""
    return df.count() * sum(8 + 8 for _ in df.columns) <= BROADCAST_BYTES


def without(docs: DataFrame, ids: DataFrame, id_column: str) -> DataFrame:
    """``docs`` without the rows whose id is among ``ids`` (one column); rows with a null id stay.

    The ids are written once, and broadcast if they are few enough; else both
    sides are shuffled by id. Column names may clash.
    """
    gone = stage(ids.toDF("_gone").where("_gone is not null").distinct(), "gone")
    gone = F.broadcast(gone) if small_enough(gone) else gone
    whole = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("doc"))
    return whole.join(gone, whole["doc"][id_column] == gone["_gone"], "left_anti").select("doc.*")


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(id, component) of every id in ``edges``; component is the least id reachable.

    Each round takes the least label among neighbours (partial aggregation on
    the map side) and then follows labels of labels once. Rounds end when no
    label changes. The links of a hub, an id with over HOT_LINKS of them, get its
    label by a broadcast of the hubs' labels, which are fewer than the links by
    that factor; other links by a shuffle. Null ends are ignored.
    """
    e = edges.select(F.col(a).cast("long").alias("a"), F.col(b).cast("long").alias("b"))
    e = e.where("a is not null and b is not null and a <> b")
    e = stage(e.select("a", "b").union(e.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "cc-edges")
    hubs = stage(e.groupBy(F.col("b").alias("hub")).count().where(F.col("count") > HOT_LINKS).select("hub"), "cc-hubs")
    hot = not hubs.isEmpty()
    plain = e.join(F.broadcast(hubs), e.b == hubs.hub, "left_anti") if hot else e
    labels = stage(e.groupBy(F.col("a").alias("id")).agg(F.least(F.min("b"), F.min("a")).alias("label")), "cc-labels")
    while True:
        seen = plain.join(labels, plain.b == labels.id).select("a", "label")
        if hot:
            known = labels.join(F.broadcast(hubs), labels.id == hubs.hub, "left_semi")
            seen = seen.union(e.join(F.broadcast(known), e.b == known.id).select("a", "label"))
        near = seen.groupBy(F.col("a").alias("id")).agg(F.min("label").alias("near"))
        step = labels.join(near, "id").select("id", F.least("label", "near").alias("l1"), F.col("label").alias("old"))
        jump = labels.select(F.col("id").alias("l1"), F.col("label").alias("l2"))
        new = stage(
            step.join(jump, "l1", "left").select("id", F.least("l1", "l2").alias("label"), "old"), "cc-labels"
        )
        if new.where("label <> old").limit(1).count() == 0:
            return new.select("id", F.col("label").alias("component"))
        labels = new.select("id", "label")


def tidied(run: Callable) -> Callable:
    """A function of batches that gives freed memory back when it ends: workers are used again, and would hold it."""

    def tidy_run(batches):
        try:
            yield from run(batches)
        finally:
            tidy()

    return tidy_run


def tidy() -> None:
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def complete_groups(batches: Iterable[pa.RecordBatch], keys: list[str]) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Blocks of whole groups from batches that are sorted by ``keys``.

    Yields the block and the offsets of its groups. Only the group that may
    go on in the next batch is held back.
    """
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if batch.num_rows == 0:
            continue
        held.append(batch)
        table = pa.Table.from_batches(held).combine_chunks()
        starts = _group_starts(table, keys)
        cut = int(starts[-1])
        if cut:
            yield table.slice(0, cut), starts
        rest = table.slice(cut)
        held = pa.Table.from_batches(rest.to_batches()).combine_chunks().to_batches()
    if held:
        table = pa.Table.from_batches(held).combine_chunks()
        yield table, np.append(_group_starts(table, keys), table.num_rows)


def _group_starts(table: pa.Table, keys: list[str]) -> np.ndarray:
    change = np.zeros(table.num_rows, bool)
    change[0] = True
    for k in keys:
        v = table.column(k).to_numpy()
        change[1:] |= v[1:] != v[:-1]
    return np.flatnonzero(change)


def fixed_bytes(column, width: int) -> np.ndarray:
    """Rows of a binary column whose values all have ``width`` bytes, as uint8."""
    data, offsets = flat_bytes(column)
    return data[offsets[0] : offsets[-1]].reshape(-1, width)


def flat_bytes(column) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and offsets of a string or binary column; nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)
    column = column.cast(pa.large_binary())
    if column.null_count:
        column = column.fill_null(b"")
    _, off, data = column.buffers()
    offsets = np.frombuffer(off, np.int64)[column.offset : column.offset + len(column) + 1]
    return (np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)), offsets


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser on uint64 (shift-multiply rounds)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_LOWER = np.arange(256, dtype=np.uint64) + np.uint64(1)
_LOWER[65:91] += np.uint64(32)
_BASE = np.uint64(0x9E3779B97F4A7C15)
_BASE_INV = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_POWERS = {"p": np.ones(1, np.uint64), "q": np.ones(1, np.uint64)}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POWERS["p"]) < n:
        size = 1 << int(n - 1).bit_length()
        for k, base in (("p", _BASE), ("q", _BASE_INV)):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            _POWERS[k] = np.cumprod(steps)
    return _POWERS["p"], _POWERS["q"]


class WordBlock:
    """Words of some rows: byte spans, 64-bit hashes, and offsets by row.

    A word is a run of bytes other than space and \\x09-\\x0D; A-Z are lowered.
    """

    def __init__(self, data: np.ndarray, offsets: np.ndarray, first: int):
        self.first, self.base = first, int(offsets[0])
        d = data[offsets[0] : offsets[-1]]
        o = offsets - offsets[0]
        self.data, self.rows = d, len(o) - 1
        word = ~_SPACE[d]
        edge = np.zeros(len(d) + 1, bool)
        edge[o] = True
        before = np.zeros(len(d), bool)
        before[1:] = word[:-1]
        self.start = np.flatnonzero(word & (~before | edge[:-1]))
        after = np.zeros(len(d), bool)
        after[:-1] = word[1:]
        self.end = np.flatnonzero(word & (~after | edge[1:])) + 1
        p, q = _powers(len(d) + 1)
        sums = np.zeros(len(d) + 1, np.uint64)
        np.cumsum(_LOWER[d] * p[: len(d)], out=sums[1:])
        h = (sums[self.end] - sums[self.start]) * q[self.start]
        self.hash = mix64(h ^ (self.end - self.start).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
        self.offset = np.searchsorted(self.start, o)
        self.row_start = o

    def grams(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of k consecutive words and their offsets by row.

        A row with fewer words has one gram of all its words; one without
        words has none.
        """
        n = np.diff(self.offset)
        count = np.where(n >= k, n - k + 1, np.minimum(n, 1))
        off = np.concatenate(([0], np.cumsum(count)))
        m = len(self.hash)
        out = np.zeros(int(off[-1]), np.uint64)
        if m >= k:
            g = np.zeros(m - k + 1, np.uint64)
            for j in range(k):
                g += self.hash[j : m - k + 1 + j] * _multiplier(j)
            g = mix64(g + np.uint64(k))
            full = np.flatnonzero(n >= k)
            if len(full):
                c = count[full]
                at = np.arange(c.sum()) - np.repeat(np.cumsum(c) - c, c)
                out[np.repeat(off[full], c) + at] = g[np.repeat(self.offset[full], c) + at]
        for r in np.flatnonzero((n < k) & (n > 0)):
            h = self.hash[self.offset[r] : self.offset[r + 1]]
            v = np.uint64(0)
            for j, x in enumerate(h):
                v = v + x * _multiplier(j)
            out[off[r]] = mix64(np.array([v + np.uint64(len(h))]))[0]
        return out, off


def _multiplier(j: int) -> np.uint64:
    return np.uint64(((2 * j + 1) * 0xA0761D6478BD642F | 1) & 0xFFFFFFFFFFFFFFFF)


def word_blocks(column, most_bytes: int = (1 << 20) - 1) -> Iterator[WordBlock]:
    """Word blocks of a text column in pieces of about ``most_bytes``; a longer row is a piece of its own."""
    np.seterr(over="ignore")
    data, offsets = flat_bytes(column)
    n, i = len(offsets) - 1, 0
    while i < n:
        j = int(np.searchsorted(offsets, offsets[i] + most_bytes, side="right")) - 1
        j = min(max(j, i + 1), n)
        yield WordBlock(data, offsets[i : j + 1], i)
        i = j


#: Rows of an Arrow batch: rows here are texts, so a batch of Spark's own 10,000 takes tens of MB, several times over.
BATCH_ROWS = 2_000


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the folder. Arrow batches of the session are made no larger than BATCH_ROWS."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= BATCH_ROWS:
        spark.conf.set(key, str(BATCH_ROWS))
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
