"""Sources, stores and streams on small files."""

import io
import zipfile
from dataclasses import dataclass

import pytest
from pyspark.sql import functions as F

from ferrule.operators import graph, settle
from ferrule.sources import jsonl, stores


def write(path, text):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(text)
    return str(path)


def test_strict_and_lenient(spark, tmp_path):
    good = write(tmp_path / "a.jsonl", '{"a": 1, "b": "x"}\n{"a": 2}\n')
    assert [tuple(r) for r in jsonl.strict(spark, good, "a int, b string").collect()] == [(1, "x"), (2, None)]
    for k, bad in enumerate(('{"a": 1}\n\n{"a": 2}\n', "[1]\n", '{"a": \n')):
        path = write(tmp_path / f"bad{k}.jsonl", bad)
        with pytest.raises(Exception):
            jsonl.strict(spark, path, "a int").collect()
    assert [r.a for r in jsonl.lenient(spark, str(tmp_path / "bad0.jsonl"), "a int").collect()] == [1, 2]
    assert {(r.kind, r.n) for r in jsonl.violations(spark, str(tmp_path / "bad0.jsonl")).collect()} == {("blank", 1)}


def test_keyed_rows(spark):
    docs = ['{"q1": {"v": 1}, "q2": {"v": 2}}', '[{"qid": "q3", "v": 3}, {"question_id": "q4", "v": 4}]', '{"qid": "q5", "v": 5}']
    df = spark.createDataFrame([(d,) for d in docs], "t string")
    assert sorted((r.qid, r.row.v) for r in jsonl.keyed_rows(df, "t", "v int").collect()) == [(f"q{k}", k) for k in range(1, 6)]
    with pytest.raises(Exception, match="without qid"):
        jsonl.keyed_rows(spark.createDataFrame([('[{"v": 1}]',)], "t string"), "t", "v int").collect()
    with pytest.raises(ValueError):
        jsonl.allowed(df, ["t"], ["t"])


def test_files_against_a_list(spark, tmp_path):
    for name in ("a.pdf", "c.pdf", "note.txt"):
        write(tmp_path / "f" / name, "x")
    listed = spark.createDataFrame([("a",), ("b",)], "doc string")
    assert {tuple(r) for r in jsonl.reconciled(listed, "doc", spark, str(tmp_path / "f"), ".pdf").collect()} == {("missing file", "b"), ("unlisted file", "c")}


def test_index_resumes_and_refuses_changes(spark, tmp_path):
    path, rows = str(tmp_path / "index"), [(k, f"t{k}") for k in range(20)]
    df = spark.createDataFrame(rows, "k long, t string")
    stores.build_index(df.where("k < 7"), "k", lambda x: x, path)
    left = stores.build_index(df, "k", lambda x: x.withColumn("t", F.upper("t")), path)
    out = {r.k: r.t for r in stores.read_index(spark, path, "k").collect()}
    assert out == {k: t if k < 7 else t.upper() for k, t in rows} and {r.k for r in stores.read_index(spark, path, "k", [3, 9]).collect()} == {3, 9}
    assert left.columns == ["k", "t"]
    with pytest.raises(Exception, match="has changed"):
        stores.build_index(df.withColumn("t", F.lit("other")), "k", lambda x: x, path)


def test_appends_publications_and_locks(spark, tmp_path):
    df = spark.createDataFrame([(1, "a"), (2, "b")], "k long, v string")
    path = str(tmp_path / "results")
    assert stores.append(df.where("k = 1"), path, "k", False) is not None
    with pytest.raises(FileExistsError):
        stores.append(df, path, "k", False)
    stores.append(df, path, "k", True)
    assert sorted(r.k for r in spark.read.json(path).collect()) == [1, 2]
    place = str(tmp_path / "table")
    assert stores.publish(df, place) == "published" and stores.publish(df, place) == "identical"
    with pytest.raises(FileExistsError):
        stores.publish(df.where("k = 1"), place)
    with stores.SingleWriter(spark, place):
        with pytest.raises(RuntimeError):
            stores.SingleWriter(spark, place).__enter__()
    with stores.SingleWriter(spark, place):
        pass


def test_zip_members_and_ranges(spark, tmp_path):
    data = io.BytesIO()
    with zipfile.ZipFile(data, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("images/a.png", b"abc" * 1000)
        z.writestr("readme.txt", b"no")
    (tmp_path / "x.zip").write_bytes(data.getvalue())
    out = stores.zip_members(spark, str(tmp_path / "x.zip"), r"images/.*").collect()
    assert [(r.name, r.size, bytes(r.content)) for r in out] == [("images/a.png", 3000, b"abc" * 1000)]
    raw = data.getvalue()
    assert stores.ranged_member(lambda at, n: raw[at : at + n], len(raw), "readme.txt") == b"no"


@dataclass
class Settings:
    name: str
    size: int = 3
    loud: bool = False


def test_config(tmp_path, monkeypatch):
    path = write(tmp_path / "c.toml", 'name = "x"\nsize = 4\n')
    monkeypatch.setenv("APP_LOUD", "true")
    assert stores.typed_config(Settings, path, "APP") == Settings("x", 4, True)
    with pytest.raises(ValueError):
        stores.typed_config(Settings, write(tmp_path / "d.json", '{"name": "x", "other": 1}'))


def test_numbers_of_a_global_order(spark):
    rows = [((k * 7919) % 1000, k % 3) for k in range(1000)]
    df = spark.createDataFrame(rows, "k int, v int").repartition(5)
    out = {r.k: r.place for r in settle.numbered(df, "k").collect()}
    assert out == {k: k for k, _ in rows}
    sums = {r.k: r.before for r in settle.summed_before(df, ["k"], {"v": "before"}).collect()}
    total = 0
    for k, v in sorted(rows):
        assert sums[k] == total
        total += v


def test_hubs_are_joined_apart(spark, monkeypatch):
    monkeypatch.setattr(graph, "HOT_LINKS", 5)
    edges = [(0, k) for k in range(1, 30)] + [(40, 41), (41, 42), (29, 50)]
    out = {r.id: r.component for r in graph.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert out == {**{k: 0 for k in [*range(30), 50]}, 40: 40, 41: 40, 42: 40}
    members = graph.shared_by(spark.createDataFrame([(1, "x"), (2, "x"), (3, None), (4, "y"), (2, "y")], "q long, d string"), "q", "d")
    assert {(r.id, r.component) for r in members.collect()} == {(1, 1), (2, 1), (4, 1), (3, 3)}
