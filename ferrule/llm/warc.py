"""WARC archives and the merge of their capture runs.

Writing: payload digests are grouped (partial aggregation first, so one payload
in a third of the pages costs a row a task), records that repeat a payload
become revisits of the smallest page id, and every task sorts its records by
URL key and time before it appends them to its archives. An archive is thus a
locally sorted run. Each record is a gzip member of its own, so that it can be
read from its offset alone. Members are written by Spark's own text writer, so
any store Spark can write to will do: the last byte of a member, the top byte of
its length, is 0 for a record under 16 MB, and is what the writer puts at a
line's end; longer records take several members. Archives are cut by a number
of records that depends on the records' size class, and so by bytes.

Reading: archives are parsed member by member, and the runs' entries are
dealt out by ranges of (URL key, time, page id). Each range merges its runs
with a loser tree, which gives the capture history in global order.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ferrule.llm._common import new_path, stage

#: Fixed values of the formats: the base-32 alphabet, and what ends a WARC record.
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
RECORD_END = b"\r\n\r\n"
#: Payloads up to so many bytes go to archives of so many records: at most about 256 MB each, or one record.
CLASSES = ((1 << 16, 4_000), (1 << 22, 64), (1 << 62, 1))
#: Bytes of a record in one gzip member; capture times without a column repeat after so many seconds, so that years have four digits.
MEMBER, SECONDS = (1 << 24) - 1, 250_000_000_000


def base32_sha1(payload: Column) -> Column:
    """Upper-case base-32 SHA-1 of a string's UTF-8 bytes, by bit fields of the hex digest."""
    digest = F.sha1(payload.cast("binary"))
    out = []
    for g in range(8):
        bits = F.conv(F.substring(digest, 5 * g + 1, 5), 16, 10).cast("int")
        out += [F.substring(F.lit(BASE32), F.shiftright(bits, 15 - 5 * j).bitwiseAND(31) + 1, F.lit(1)) for j in range(4)]
    return F.concat(*out)


def url_key(url: Column) -> Column:
    """Host labels reversed by commas, then ``)`` and the rest, in lower case; scheme, ``www`` and default ports go.

    A null URL has the empty key.
    """
    u = F.lower(F.coalesce(url, F.lit("")))
    u = F.regexp_replace(u, r"^[a-z][a-z0-9+.-]*://(?:[^/@]*@)?", "")
    host = F.regexp_extract(u, r"^([^/?#:]*)", 1)
    rest = F.regexp_replace(u, r"^[^/?#:]*(?::(?:80|443)(?![0-9]))?", "")
    rest = F.regexp_replace(rest, r"#.*$", "")
    labels = F.array_join(F.reverse(F.split(F.regexp_replace(host, r"^www\d*\.", ""), r"\.")), ",")
    return F.concat(labels, F.lit(")"), F.when(rest == "", "/").otherwise(rest))


def write(pages: DataFrame, path: str, id_column: str = "page_id", url_column: str = "url", payload_column: str = "html", time_column: str | None = None, min_payload: int = 0) -> None:
    """Write a record per row to archives under ``path``.

    Null payloads are empty; a null URL is an empty target. Of equal payloads of
    at least ``min_payload`` bytes the smallest id is the response (a null id
    comes last), others are revisits without payload. Rows that repeat an id
    with one payload are one response each if the id is the smallest. Without a
    time column, the capture time counts seconds from 2000 by id, modulo SECONDS,
    so any long is an id. Long payloads are whole. An empty table gives an empty
    folder; other columns don't matter.
    """
    seconds = F.pmod(F.coalesce(F.col(id_column), F.lit(0)).cast("long"), F.lit(SECONDS))
    when = F.col(time_column).cast("timestamp") if time_column else F.timestamp_seconds(F.lit(946684800) + seconds)
    rows = pages.select(
        F.col(id_column).cast("long").alias("id"), F.coalesce(F.col(url_column), F.lit("")).alias("url"),
        F.coalesce(F.col(payload_column), F.lit("")).alias("payload"), when.alias("at"),
    ).withColumns({"size": F.octet_length("payload").cast("long"), "digest": base32_sha1(F.col("payload"))})
    copies = (
        rows.where(F.col("size") >= min_payload).groupBy(F.col("digest").alias("d"), F.col("size").alias("s"))
        .agg(F.min("id").alias("first"), F.count("*").alias("n")).where("n > 1")
    )
    joined = rows.join(copies, (F.col("digest") == F.col("d")) & (F.col("size") == F.col("s")), "left")
    revisit = F.col("first").isNotNull() & (F.col("id").isNull() | (F.col("id") != F.col("first")))
    clean = F.regexp_replace("url", r"[\r\n]", " ")
    body = F.when(revisit, F.lit("")).otherwise(F.col("payload"))
    lines = [
        F.lit("WARC/1.1"),
        F.concat(F.lit("WARC-Type: "), F.when(revisit, "revisit").otherwise("response")),
        F.concat(F.lit("WARC-Record-ID: <urn:page:"), F.coalesce(F.col("id").cast("string"), F.lit("")), F.lit(">")),
        F.concat(F.lit("WARC-Target-URI: "), clean),
        F.concat(F.lit("WARC-Date: "), F.date_format(F.to_utc_timestamp("at", F.expr("current_timezone()")), "yyyy-MM-dd'T'HH:mm:ss'Z'")),
        F.concat(F.lit("WARC-Payload-Digest: sha1:"), F.col("digest")),
        F.concat(F.lit("WARC-Payload-Length: "), F.col("size").cast("string")),
        F.when(revisit, F.concat(F.lit("WARC-Refers-To: <urn:page:"), F.col("first").cast("string"), F.lit(">"))),
        F.concat(F.lit("Content-Length: "), F.octet_length(body).cast("string")),
    ]
    record = F.encode(F.concat(F.concat_ws("\r\n", *lines), F.lit("\r\n\r\n"), body), "utf-8")
    sorted_by = ["key", "at", "id"]
    sizes = rows.agg(*[F.count_if(F.col("size") > most).alias(str(k)) for k, (most, _) in enumerate(CLASSES)]).first()
    low = -1
    for k, (most, count) in enumerate(CLASSES):
        if k == 0 or sizes[str(k - 1)]:
            mine = joined.where((F.col("size") > low) & (F.col("size") <= most)).select(url_key(F.col("url")).alias("key"), "at", "id", record.alias("value"))
            pressed = mine.sortWithinPartitions(*sorted_by).select("value").mapInArrow(_members, "value binary")
            pressed.select(F.col("value").cast("string")).write.option("lineSep", "\0").option("maxRecordsPerFile", count).mode("append").text(path)
        low = most


def _members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Records as gzip members without their last byte, which is 0."""
    for batch in batches:
        out = []
        for value in batch.column(0):
            data = value.as_py() + RECORD_END
            parts = [gzip.compress(data[a : a + MEMBER], 6, mtime=0) for a in range(0, len(data), MEMBER)]
            out.append(b"".join(parts)[:-1])
        yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["value"])


def records(data: memoryview) -> Iterator[tuple[dict[str, str], int, bytes]]:
    """(header, offset of the record's first member, payload) of each record of an archive, one in memory at a time."""
    at, end = 0, len(data)
    while at < end:
        start, record = at, b""
        while True:
            member = zlib.decompressobj(31)
            while not member.eof:
                if at >= end:
                    raise ValueError(f"broken gzip member at byte {start}")
                record += member.decompress(data[at : at + (1 << 14)])
                at = min(end, at + (1 << 14))
            at -= len(member.unused_data)
            stop = record.find(b"\r\n\r\n")
            if not record.startswith(b"WARC/") or (stop < 0 and at >= end):
                raise ValueError(f"no WARC record at byte {start}")
            fields = dict(line.split(": ", 1) if ": " in line else (line.rstrip(":"), "") for line in record[:stop].decode("utf-8", "replace").split("\r\n")[1:])
            whole = stop + 4 + int(fields["Content-Length"])
            if stop >= 0 and len(record) >= whole + 4:
                break
        yield fields, start, record[stop + 4 : whole]


def _page(urn: str) -> int | None:
    text = urn.removeprefix("<urn:page:").removesuffix(">")
    return int(text) if text else None


_ENTRY = "run string, file_offset long, url_key string, captured string, page_id long, url string, record_type string, payload_digest string, payload_bytes long, refers_to long, content_length long"


def read_entries(spark: SparkSession, path: str) -> DataFrame:
    """An entry per record of the archives under ``path``, in each run's own order; stored digests are recomputed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, data in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                out = []
                for head, start, payload in records(memoryview(data.as_buffer())):
                    stored = head["WARC-Payload-Digest"].removeprefix("sha1:")
                    kind = head["WARC-Type"]
                    if kind == "response" and base64.b32encode(hashlib.sha1(payload).digest()).decode() != stored:
                        raise ValueError(f"damaged record at byte {start} of {name}")
                    out.append((name, start, None, head["WARC-Date"], _page(head["WARC-Record-ID"]), head["WARC-Target-URI"], kind, stored,
                                int(head["WARC-Payload-Length"]), _page(head["WARC-Refers-To"]) if "WARC-Refers-To" in head else None, len(payload)))
                if out:
                    kinds = [pa.string() if k == "string" else pa.int64() for k in (f.split()[1] for f in _ENTRY.split(", "))]
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names=[f.split()[0] for f in _ENTRY.split(", ")])

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInArrow(run, _ENTRY).withColumn("url_key", url_key(F.col("url")))


class LoserTree:
    """Merges sorted runs: the winner's path is replayed against the losers kept at the inner nodes. Only the runs' heads are held."""

    def __init__(self, runs: list[Iterable[tuple]]):
        self.runs = [iter(r) for r in runs]
        self.k = max(1, len(runs))
        self.head = [(0, x, leaf) if (x := next(r, None)) is not None else (1, (), leaf) for leaf, r in enumerate(self.runs)]
        self.loser = [-1] * self.k
        for leaf in range(len(runs)):
            self._enter(leaf)

    def _enter(self, leaf: int) -> None:
        node, winner = (leaf + self.k) // 2, leaf
        while node > 0:
            other = self.loser[node]
            if other == -1:
                self.loser[node] = winner
                return
            if self.head[other] < self.head[winner]:
                self.loser[node], winner = winner, other
            node //= 2
        self.loser[0] = winner

    def __iter__(self) -> Iterator[tuple]:
        while self.runs:
            winner = self.loser[0]
            over, item, _ = self.head[winner]
            if over:
                return
            yield item
            item = next(self.runs[winner], None)
            self.head[winner] = (0, item, winner) if item is not None else (1, (), winner)
            node = (winner + self.k) // 2
            while node > 0:
                if self.head[self.loser[node]] < self.head[winner]:
                    self.loser[node], winner = winner, self.loser[node]
                node //= 2
            self.loser[0] = winner


def merge_runs(entries: DataFrame) -> DataFrame:
    """``entries`` in the global order of (URL key, time, page id), partition after partition.

    Ranges are cut on all three, so the captures of one host, or of one URL, are
    split among tasks. A range holds index entries only, never payloads, in
    columns; keys are made for a few entries of each run at a time.
    """
    names = entries.columns
    order = ["url_key", "captured", "page_id", "run", "file_offset"]
    schema = entries.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = [b for b in batches if b.num_rows]
        if not table:
            return
        table = pa.Table.from_batches(table).combine_chunks()
        which = table.column("run").to_numpy(zero_copy_only=False)
        cuts = [0, *(np.flatnonzero(which[1:] != which[:-1]) + 1).tolist(), table.num_rows]

        def entries_of(first: int, last: int) -> Iterator[tuple]:
            for at in range(first, last, 1024):
                piece = table.slice(at, min(1024, last - at))
                columns = ([(v is not None, v) if v is not None else (False, 0) for v in piece.column(c).to_pylist()] for c in order)
                yield from zip(*columns, range(at, at + piece.num_rows), strict=True)

        runs = [entries_of(a, b) for a, b in zip(cuts[:-1], cuts[1:], strict=True) if b > a]
        merged = np.fromiter((x[-1] for x in LoserTree(runs)), np.int64, table.num_rows)
        yield from table.take(pa.array(merged)).to_batches(max_chunksize=10_000)

    ranged = entries.repartitionByRange("url_key", "captured", "page_id")
    return ranged.sortWithinPartitions("run", *order[:3], "file_offset").mapInArrow(run, schema).select(*names)


def capture_history(pages: DataFrame, **options) -> DataFrame:
    """Write ``pages`` to archives in the shared folder, read them back and merge their runs."""
    spark = pages.sparkSession
    path = new_path(spark, "warc")
    write(pages, path, **options)
    return merge_runs(stage(read_entries(spark, path), "warc-entries"))
