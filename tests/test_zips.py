"""ZIP members by ranges: what is read, what is skipped, what is refused."""

import io
import os
import zipfile

import pytest
from ferrule.sources import zips
from pyspark.sql import functions as F


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    path = tmp_path_factory.mktemp("zips")
    for a in range(3):
        with zipfile.ZipFile(path / f"{a}.zip", "w", zipfile.ZIP_DEFLATED) as z:
            z.writestr("dir/", b"")
            for k in range(40):
                z.writestr(zipfile.ZipInfo(f"{'xy'[k % 2]}/{k}"), os.urandom(5000), zipfile.ZIP_STORED if k % 3 else zipfile.ZIP_DEFLATED)
            z.writestr("é empty", b"")
    (path / "notes.txt").write_text("no archive")
    return str(path)


def members(folder):
    out = {}
    for a in range(3):
        with zipfile.ZipFile(f"{folder}/{a}.zip") as z:
            out |= {(f"{folder}/{a}.zip", m.filename): z.read(m) for m in z.infolist() if not m.is_dir()}
    return out


class Counted(zips.ZipReader):
    """Counts the bytes that are read of all archives."""

    read_bytes = 0

    def open(self, path):
        reader = self

        class File(io.FileIO):
            def read(self, n=-1):
                data = super().read(n)
                reader.read_bytes += len(data)
                return data

        return File(path)


def test_all_members(spark, folder):
    rows = zips.members(spark, folder, partition_bytes=30_000)
    assert {(r.archive, r.name): bytes(r.content) for r in rows.collect()} == members(folder)
    assert rows.rdd.getNumPartitions() > 15
    assert zips.members(spark, f"{folder}/1.zip").where("size = 0").select("name").collect()[0][0] == "é empty"


def test_bytes_read_are_those_of_the_members(folder):
    reader = Counted(folder, "(?s:.*)", 1 << 20)
    left = list(reader.pushFilters([zips.In(("name",), ("x/2", "x/4")), zips.EqualTo(("archive",), f"{folder}/1.zip"), other := zips.EqualTo(("size",), 5000)]))
    assert left == [other]
    parts = reader.partitions()
    directory = reader.read_bytes
    assert directory < 10_000  # of 600,000
    got = [r for p in parts for b in reader.read(p) for r in b.to_pylist()]
    packed = sum(m.packed for p in parts for m in p.members)
    assert [r["name"] for r in got] == ["x/2", "x/4"] and reader.read_bytes - directory == packed + 2 * zips.HEADER


def test_filters_reach_the_reader(spark, folder):
    m = zips.members(spark, folder)
    want = members(folder)
    assert m.where(F.col("name").startswith("y/") & (F.col("size") > 0)).count() == sum(n.startswith("y/") for _, n in want)
    plan = m.where("name in ('x/2', 'y/1')")._jdf.queryExecution().toString()
    assert "ferrule_zip" in plan and m.where("name in ('x/2', 'y/1')").count() == 6
    assert zips.members(spark, folder, pattern="x/1.").count() == 3 * 5 and m.where("name = 'nothing'").count() == 0


def test_damage_is_an_error(folder, tmp_path):
    raw = bytearray(open(f"{folder}/0.zip", "rb").read())
    with zipfile.ZipFile(f"{folder}/0.zip") as z:
        at = z.getinfo("y/1").header_offset + 100
    raw[at] ^= 1
    (tmp_path / "bad.zip").write_bytes(raw)
    reader = zips.ZipReader(str(tmp_path / "bad.zip"), "y/1", 1 << 20)
    with pytest.raises(ValueError, match="damaged"):
        [*map(list, map(reader.read, reader.partitions()))]
    with pytest.raises(FileNotFoundError):
        zips.ZipReader(str(tmp_path / "none"), ".*", 1).partitions()


def test_archives_written_and_read_back(spark, tmp_path):
    rows = [(k % 4, f"m{k}", bytes([k]) * k) for k in range(50)]
    zips.write_archives(spark.createDataFrame(rows, "a int, n string, c binary"), str(tmp_path / "z"), "a", "n", "c")
    got = {(os.path.basename(r.archive), r.name, bytes(r.content)) for r in zips.members(spark, str(tmp_path / "z")).collect()}
    assert got == {(f"{a}.zip", n, c) for a, n, c in rows}
