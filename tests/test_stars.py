"""A task's edges give way to stars before they are shuffled."""

import random

import pyarrow as pa
from ferrule.operators import graph


def grouped(edges):
    label = {x: x for e in edges for x in e}
    for a, b in edges:
        low, high = sorted((label[a], label[b]))
        label = {x: low if v == high else v for x, v in label.items()}
    return label


def stars(edges, kind, batch=40):
    table = pa.table({"a": pa.array([a for a, _ in edges], kind), "b": pa.array([b for _, b in edges], kind)})
    return [(r["a"], r["b"]) for out in graph._stars(iter(table.to_batches(max_chunksize=batch))) for r in out.to_pylist()]


def test_stars_connect_the_same_by_fewer_edges(monkeypatch):
    draw = random.Random(2)
    for n, m in ((30, 600), (200, 150), (300, 300)):
        edges = [(draw.randrange(n), draw.randrange(n)) for _ in range(m)] + [(n, n), (n, n), (n + 1, n + 1), (n + 1, 0)]
        out = stars(edges, pa.int64())
        assert grouped(out) == grouped(edges) and len(out) < len(label := grouped(edges)) and len(out) == len({a for a, _ in out})
        assert [e for e in out if e[0] == e[1]] == [(x, x) for x in label if [*label.values()].count(label[x]) == 1]
    named = [(f"v{a}", f"v{b}") for a, b in edges]
    assert grouped(stars(named, pa.string())) == grouped(named)
    monkeypatch.setattr(graph, "EDGES_TOGETHER", 100)
    assert grouped(stars(edges, pa.int64())) == grouped(edges) and stars([], pa.int64()) == []


def test_components_of_long_chains_loops_and_text(spark):
    draw, ids = random.Random(4), [*range(2000)]
    draw.shuffle(ids)
    edges = [(str(a), str(b)) for k, (a, b) in enumerate(zip(ids, ids[1:], strict=False)) if k % 700] + [("x", "x"), ("x", "x"), ("5", "5"), ("y", None)]
    draw.shuffle(edges)
    out = graph.components(spark.createDataFrame(edges, "a string, b string").repartition(5)).collect()
    assert len(out) == len({r.id for r in out}) and {r.id: r.component for r in out} == grouped([e for e in edges if e[1]])
