"""Connected components by contraction of edges."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ferrule.operators.settle import Rounds

#: Rows of one key beyond which that key's rows are joined by a broadcast of such keys' values, which are fewer than the rows by that factor.
HOT_LINKS = 1_000_000
#: Edges of a task that are put in the place of each other together: some 100 MB.
EDGES_TOGETHER = 1 << 20


def _roots(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """The root of each of ``n`` vertices: one of those that the edges connect it with, the same for all of them."""
    up = np.arange(n)
    while len(a):
        np.minimum.at(up, np.maximum(a, b), np.minimum(a, b))  # edges are between roots
        while not np.array_equal(up, further := up[up]):
            up = further
        a, b = up[a], up[b]
        a, b = a[a != b], b[a != b]
    return up


def _stars(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(a, b) of edges (a, b): stretch by stretch each vertex once as a, with the root b of those that the stretch connects it with; of roots only those without others.

    A stretch's vertices are connected as before, by no more edges, and by fewer than there are vertices.
    """

    def star(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        table = pa.Table.from_batches(held)
        ends = pa.chunked_array(table["a"].chunks + table["b"].chunks).combine_chunks().dictionary_encode()
        places, ids = ends.indices.to_numpy(), ends.dictionary
        a, b = places[: len(table)], places[len(table) :]
        up = _roots(a[a != b], b[a != b], len(ids))
        own = np.arange(len(ids))
        kept = np.flatnonzero((up != own) | (np.bincount(up, minlength=len(ids)) == 1))
        return pa.RecordBatch.from_arrays([ids.take(pa.array(kept)), ids.take(pa.array(up[kept]))], ["a", "b"])

    held, rows = [], 0
    for batch in batches:
        held.append(batch)
        rows += batch.num_rows
        if rows >= EDGES_TOGETHER:
            yield star(held)
            held, rows = [], 0
    if rows:
        yield star(held)


def _fewer(edges: DataFrame) -> DataFrame:
    """``edges`` (a, b) by stars of stretches of tasks, with (a, a) for vertices that have loops only."""
    edges = edges.select("a", "b")
    return edges.mapInArrow(_stars, edges.schema)


def _looked_up(rows: DataFrame, table: DataFrame, key: str, settled: Rounds, how: str = "inner", many: DataFrame | None = None) -> DataFrame:
    """``rows`` with what ``table``, one row a key, has for them; hot keys apart. ``many`` is a written table with as many rows, if ``rows`` isn't one."""
    if (rows if many is None else many).count() > HOT_LINKS:
        hot = settled(rows.groupBy(key).count().where(F.col("count") > HOT_LINKS).select(key))
        if not hot.isEmpty():
            some, few = rows.join(F.broadcast(hot), key, "left_anti"), table.join(F.broadcast(hot), key, "left_semi")
            return some.join(table, key, how).unionByName(rows.join(F.broadcast(hot), key, "left_semi").join(F.broadcast(few), key, how))
    return rows.join(table, key, how)


def components(edges: DataFrame) -> DataFrame:
    """(id, component) for edges (a, b): the least id reachable.

    In each round every vertex points to the least of itself and its
    neighbours in an order drawn by hash for that round, so that chains of pointers are
    short whatever the ids; an edge thus matters to its higher end only, and vertices that point to themselves are in no table.
    Pointers are followed two steps, vertices become what
    they point to, and edges within one vertex go. Edges and vertices shrink by a factor each round, and a
    round's pointers are kept, of vertices that were still there; in the end they are
    put together from the last round back. Rows with a null end are ignored, loops make
    their vertex a component. Hubs and large components are hot keys on one side of
    joins only (HOT_LINKS); least values are aggregated on the map side.
    Before they are shuffled, a task's edges give way to stars that connect the same vertices, which are fewer
    than the task's vertices, so that many edges between few vertices aren't moved about.
    """
    settled = Rounds(edges.sparkSession, "components")
    links = settled(_fewer(edges.where("a is not null and b is not null")))
    left = links.where("a <> b")
    pointers: list[DataFrame] = []
    while not left.isEmpty():
        # 16 bits of hash, since all of a hash would be shuffled; equal ones are told apart by the ids.
        place = lambda c: F.struct(F.pmod(F.xxhash64(c, F.lit(len(pointers))), F.lit(1 << 16)).cast("int").alias("h"), F.col(c).alias("id"))  # noqa: B023, E731
        near = left.select(F.greatest(place("a"), place("b"))["id"].alias("id"), F.least(place("a"), place("b")).alias("m"))
        up = settled(near.groupBy("id").agg(F.min("m")["id"].alias("up")))
        further = _looked_up(up, up.select(F.col("id").alias("up"), F.col("up").alias("_next")), "up", settled, "left")
        up = settled(further.select("id", F.coalesce("_next", "up").alias("up")))
        pointers.append(up)
        moved = left
        for end in "ab":
            moved = _looked_up(moved, up.select(F.col("id").alias(end), F.col("up").alias(f"_{end}")), end, settled, "left", many=left)
        moved = moved.select(F.coalesce("_a", "a").alias("a"), F.coalesce("_b", "b").alias("b")).where("a <> b")
        left = settled(_fewer(moved).where("a <> b").distinct())
    rooted = links.select(F.col("a").alias("id"), F.col("b").alias("up")).limit(0)
    for up in reversed(pointers):
        # A vertex two steps along a longer chain is there again in the next round, with the same root in the end.
        last = rooted.distinct().select(F.col("id").alias("up"), F.col("up").alias("_last"))
        rooted = rooted.union(settled(_looked_up(up, last, "up", settled, "left").select("id", F.coalesce("_last", "up").alias("up"))))
    whole = settled(rooted.union(rooted.select(F.col("up").alias("id"), "up")).distinct())
    loops = settled(links.where("a = b").select(F.col("a").alias("id"), F.col("a").alias("up")).distinct())
    if not loops.isEmpty():
        whole = settled(whole.union(loops.join(whole, "id", "left_anti")))
    least = whole.groupBy("up").agg(F.min("id").alias("component"))
    named = settled(_looked_up(whole, least, "up", settled).select("id", "component"))
    settled.drop(but=named)
    return named


def named_components(members: DataFrame) -> DataFrame:
    """(component, name, size) of components of (id, component): the name is the SHA-256 of the members' ids, sorted as text and joined by line feeds.

    A component's ids are gathered for its name, so this is for components of
    bounded size, such as the questions that share documents.
    """
    ids = F.array_sort(F.collect_list(F.col("id").cast("string")))
    return members.groupBy("component").agg(F.sha2(F.array_join(ids, "\n"), 256).alias("name"), F.count("*").alias("size"))


def shared_by(df: DataFrame, item: str, document: str | Column) -> DataFrame:
    """(id, component) of every item, alone or linked through shared documents: items link to the least item of each document."""
    rows = df.select(F.col(item).alias("id"), (F.col(document) if isinstance(document, str) else document).alias("doc"))
    least = rows.where("doc is not null").groupBy("doc").agg(F.min("id").alias("b"))
    edges = rows.join(least, "doc").select(F.col("id").alias("a"), "b")
    alone = rows.select(F.col("id").alias("a"), F.col("id").alias("b"))
    return components(edges.union(alone).distinct())
