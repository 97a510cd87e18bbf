"""ZIP archives as a data source that reads ranges: an archive's directory, and then the members asked for, each on its own.

The driver reads the directories (a few ranges at each archive's end) and makes
partitions of members, of about ``partition_bytes`` of compressed bytes; a larger member is
one by itself. Filters on ``archive`` and ``name`` (equality, IN, prefix) and the option
``pattern`` choose members before anything of them is read. A member is two
ranges, its header and its bytes, and is held to its size and checksum.
"""

from __future__ import annotations

import re
import zipfile
import zlib
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition, StringStartsWith

from ferrule.streaming.committed import file_system

SCHEMA = "archive string, name string, size long, content binary"
#: Fixed value: length of a member's local header before its name.
HEADER = 30


@dataclass
class Member:
    archive: str
    name: str
    offset: int
    packed: int
    size: int
    method: int
    crc: int


@dataclass
class Members(InputPartition):
    members: list[Member]


class ZipReader(DataSourceReader):
    def __init__(self, path: str, pattern: str, partition_bytes: int):
        self.path, self.pattern, self.partition_bytes = path, pattern, partition_bytes
        self.allowed: list[tuple[str, str, tuple]] = []

    def open(self, path: str):
        """A seekable file of the archive; ranges of it are read."""
        fs, local = file_system(path)
        return fs.open_input_file(local)

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            column = f.attribute[0] if len(getattr(f, "attribute", ())) == 1 else None
            if column not in ("archive", "name") or not isinstance(f, EqualTo | In | StringStartsWith):
                yield f
            elif isinstance(f, StringStartsWith):
                self.allowed.append((column, "prefix", (f.value,)))
            else:
                self.allowed.append((column, "among", tuple(f.value) if isinstance(f, In) else (f.value,)))

    def _wanted(self, column: str, value: str) -> bool:
        return all(value in values if how == "among" else value.startswith(values) for c, how, values in self.allowed if c == column)

    def archives(self) -> list[str]:
        fs, local = file_system(self.path)
        info = fs.get_file_info(local)
        if info.type == pafs.FileType.NotFound:
            raise FileNotFoundError(self.path)
        found = [local] if info.is_file else [x.path for x in fs.get_file_info(pafs.FileSelector(local)) if x.is_file and x.path.endswith(".zip")]
        # Paths go out as they came in: with what the file system's name took off before them.
        head = self.path.removesuffix(local) if self.path.endswith(local) else ""
        return sorted(p for p in (f"{head}{x}" for x in found) if self._wanted("archive", p))

    def partitions(self) -> Sequence[Members]:
        pattern, out, held = re.compile(self.pattern), [], 0
        for archive in self.archives():
            with self.open(archive) as f, zipfile.ZipFile(f) as z:
                for m in z.infolist():
                    if m.is_dir() or not pattern.fullmatch(m.filename) or not self._wanted("name", m.filename):
                        continue
                    if not out or held + m.compress_size > self.partition_bytes:
                        out.append(Members([]))
                        held = 0
                    out[-1].members.append(Member(archive, m.filename, m.header_offset, m.compress_size, m.file_size, m.compress_type, m.CRC))
                    held += m.compress_size
        return out or [Members([])]

    def read(self, partition: Members) -> Iterator[pa.RecordBatch]:
        opened = {}
        try:
            for m in partition.members:
                if m.archive not in opened:
                    for f in opened.values():
                        f.close()
                    opened = {m.archive: self.open(m.archive)}
                content = self._member(opened[m.archive], m)
                yield pa.RecordBatch.from_arrays([pa.array([m.archive]), pa.array([m.name]), pa.array([m.size], pa.int64()), pa.array([content], pa.binary())], names=["archive", "name", "size", "content"])
        finally:
            for f in opened.values():
                f.close()

    def _member(self, f, m: Member) -> bytes:
        f.seek(m.offset)
        head = f.read(HEADER)
        # The local header's own name and extra field may be longer than the directory's.
        f.seek(m.offset + HEADER + int.from_bytes(head[26:28], "little") + int.from_bytes(head[28:30], "little"))
        packed = f.read(m.packed)
        if m.method not in (zipfile.ZIP_STORED, zipfile.ZIP_DEFLATED):
            raise ValueError(f"{m.archive}: {m.name} is packed by method {m.method}")
        content = packed if m.method == zipfile.ZIP_STORED else zlib.decompress(packed, -15)
        if len(content) != m.size or zlib.crc32(content) != m.crc:
            raise ValueError(f"{m.archive}: {m.name} is damaged")
        return content


class ZipMembers(DataSource):
    """Options: ``path`` of an archive or of a folder of ``.zip`` files, ``pattern`` that names match whole, ``partition_bytes``."""

    @classmethod
    def name(cls) -> str:
        return "ferrule_zip"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> ZipReader:
        return ZipReader(self.options["path"], self.options.get("pattern", "(?s:.*)"), int(self.options.get("partition_bytes", 32 << 20)))


def members(spark: SparkSession, path: str, pattern: str = "(?s:.*)", partition_bytes: int = 32 << 20) -> DataFrame:
    """(archive, name, size, content) of members of the archives at ``path``; the session is set to push filters into Python sources."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(ZipMembers)
    return spark.read.format(ZipMembers.name()).option("pattern", pattern).option("partition_bytes", str(partition_bytes)).load(path)


def write_archives(df: DataFrame, path: str, archive: str, name: str, content: str) -> None:
    """Writes a ZIP file for each value of ``archive`` with a member for each of its rows (``name``, binary ``content``), by one task, member after member."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, local = file_system(path)
        fs.create_dir(local, recursive=True)
        z = out = at = None
        n = 0
        for batch in batches:
            for a, m, c in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                if a != at:
                    if z:
                        z.close()
                        out.close()
                    at, out = a, fs.open_output_stream(f"{local}/{a}.zip")
                    z = zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED)
                z.writestr(m, c)
                n += 1
        if z:
            z.close()
            out.close()
        yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64())], names=["n"])

    rows = df.select(archive, name, content).repartition(archive).sortWithinPartitions(archive, name)
    rows.mapInArrow(write, "n long").write.format("noop").mode("overwrite").save()
