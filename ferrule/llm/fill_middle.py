"""Fill-in-the-middle documents by a parallel automaton scan.

A text's units are ``[A-Za-z]+|[^A-Za-z]``: runs of letters and single other
characters. An automaton of four states (_STEP) reads characters: whether the
last one was a letter, and how much of a mark ``<P>``, ``<S>`` or ``<M>`` it
has seen. A chunk of text is a function of the state it is entered in: the
state it ends in, how many units begin in it, and whether a mark ends in it.
Functions of a document's chunks are composed in order; the composition tells the
state each chunk is entered in and the units before it, and so how many units
the document has, and in which chunk its cuts lie.

Texts of up to CHUNK characters are one chunk: scanned, cut and put together by the
task that reads them. Longer ones are dealt out in chunks over all tasks; only
the chunks' functions come back, and then, in parallel again, each cut's chunk is searched
for its place. A text is looked at whole again only to be put together.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ferrule.llm._common import flat_bytes, small_enough, stage, tidied

#: Characters of a chunk.
CHUNK = 32_768
MARKS = ("<P>", "<S>", "<M>")
#: Percent of documents that stay as they are, and of the others that have the suffix first.
PLAIN, SUFFIX_FIRST = 10, 20

#: Kinds of characters: other, "<", ">", letters, the letters P, S and M.
_KIND = np.zeros(128, np.int8)
_KIND[[*range(65, 91), *range(97, 123)]] = 3
_KIND[[80, 83, 77]] = 4
_KIND[[60, 62]] = 1, 2
#: States: 0 after another character, 1 after a letter, 2 after "<", 3 after "<" and a letter of a mark. State by state and kind.
_STEP = np.array([[0, 2, 0, 1, 1], [0, 2, 0, 1, 1], [0, 2, 0, 1, 3], [0, 2, 0, 1, 1]])
STATES = len(_STEP)


def functions(points: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each chunk (``ends`` in ``points``) and each state it may be entered in: the state after it, units begun, marks ended.

    Within a chunk a state depends on the two characters before at most, so it is
    read off for all places at once; the entry state matters for the first two.
    """
    begins = np.append(0, ends[:-1])
    kind = _KIND[np.where(points < 128, points, 0)]
    letter = kind >= 3
    first = np.zeros(len(points) + 1, bool)
    first[begins] = True
    first = first[:-1]
    inner = np.zeros(len(points), bool)
    inner[1:] = letter[:-1]
    inner &= ~first
    starts = ~letter | ~inner
    mark = np.zeros(len(points), bool)
    mark[2:] = (kind[2:] == 2) & (kind[1:-1] == 4) & (kind[:-2] == 1)
    second = np.zeros(len(points), bool)
    second[1:] = first[:-1]
    mark &= ~first & ~second
    counts, marks = (np.append(0, np.cumsum(x))[ends] - np.append(0, np.cumsum(x))[begins] for x in (starts, mark))
    after, units, found = (np.zeros((len(ends), STATES), np.int64) for _ in range(3))
    size = ends - begins
    for state in range(STATES):
        full = size > 0
        at = begins[full]
        one = kind[at]
        end = _STEP[state, one]
        hit = (state == 3) & (one == 2)
        more = size[full] > 1
        two = kind[np.where(more, at + 1, at)]
        hit = hit | (more & (end == 3) & (two == 2))
        last, before = kind[ends[full] - 1], kind[np.maximum(ends[full] - 2, at)]
        far = np.where((last == 4) & (before == 1), 3, np.where(last >= 3, 1, np.where(last == 1, 2, 0)))
        after[full, state] = np.where(more, np.where(size[full] == 2, _STEP[end, two], far), end)
        after[~full, state] = state
        units[full, state] = counts[full] - ((state in (1, 3)) & letter[at])
        found[full, state] = marks[full] + hit
    return after, units, found


def _points(column) -> tuple[np.ndarray, np.ndarray]:
    """Code points of a text column end to end, and where each row ends."""
    data, offsets = flat_bytes(column)
    lead = (data[offsets[0] : offsets[-1]] & 0xC0) != 0x80
    points = np.frombuffer(data[offsets[0] : offsets[-1]].tobytes().decode().encode("utf-32-le"), np.uint32)
    return points, np.append(0, np.cumsum(lead))[offsets - offsets[0]][1:]


def unit_starts(points: np.ndarray, entered: int) -> np.ndarray:
    """Where the units of a chunk begin."""
    letter = _KIND[np.where(points < 128, points, 0)] >= 3
    before = np.append(entered in (1, 3), letter[:-1])[: len(points)]
    return np.flatnonzero(~letter | ~before)


def _draw(id_column: str, n: Column) -> dict[str, Column]:
    """The form, and after how many units the prefix and the middle end, by the digest of the id."""
    digest = F.sha2(F.concat(F.lit("1:"), F.col(id_column).cast("string")), 256)
    h = [F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("long") for k in range(4)]
    a, b = h[0] % (n + 1), h[1] % (n + 1)
    form = F.when(digest.isNull() | (h[2] % 100 >= 100 - PLAIN), "plain").when(h[3] % 100 < SUFFIX_FIRST, "spm").otherwise("psm")
    return {"first": F.least(a, b), "last": F.greatest(a, b), "drawn": form}


FIELDS = "n long, form string, prefix_chars long, middle_chars long, output string"


def transform(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", chunk: int = CHUNK) -> DataFrame:
    """(id, n, form, prefix_chars, middle_chars, output) of every row of ``docs``.

    n counts units. h1 to h4 are the first four groups of 8 hexadecimal digits of
    the sha256 of "1:" and the id: the prefix ends after the smaller of h1 % (n + 1) and h2 % (n + 1) units, the middle after
    the larger. Form "plain" (output: the text, no lengths): the text is empty, contains a
    mark, or h3 % 100 >= 90; else "spm" if h4 % 100 < 20: ``<S>`` suffix ``<P>`` prefix ``<M>`` middle; else "psm":
    ``<P>`` prefix ``<S>`` suffix ``<M>`` middle.

    Null texts are empty; a null id draws nothing, so its row is plain. Rows that repeat are transformed
    each, alike if ids and texts are; other columns are ignored, whatever their names; an empty table gives an empty
    one. A text of any length is cut whole.
    """
    rows = docs.select(F.col(f"`{id_column}`").alias("id"), F.coalesce(F.col(f"`{text_column}`").cast("string"), F.lit("")).alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    short = rows.where(F.char_length("text") <= chunk).mapInArrow(_scanned, f"id {kind}, text string, n long, marks long")
    long = rows.where(F.char_length("text") > chunk)
    # The place of a cut in a short text is its unit number's; a task finds it when it puts the text together.
    short = short.select("id", "text", "n", "marks", *[c.alias(k) for k, c in _draw("id", F.col("n")).items()]).withColumn("cuts", F.lit(None).cast("array<long>"))
    done = short.union(_giants(long, kind, chunk).select(short.columns))
    plain = (F.col("text") == "") | (F.col("marks") > 0)
    done = done.select("id", "text", "n", F.when(plain, "plain").otherwise(F.col("drawn")).alias("form"), "first", "last", "cuts")
    return done.mapInArrow(tidied(_put_together), f"id {kind}, {FIELDS}").withColumnRenamed("id", id_column)


def _scanned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Units and marks of texts of one chunk, entered in state 0."""
    for batch in batches:
        _, units, found = functions(*_points(batch.column(1)))
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(units[:, 0]), pa.array(found[:, 0])], names=["id", "text", "n", "marks"])


def _giants(long: DataFrame, kind: str, chunk: int) -> DataFrame:
    """(id, text, n, marks, first, last, drawn, cuts) of texts of many chunks; equal rows share their work."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for key, text_key, text in zip(batch.column(0), batch.column(1), batch.column(2), strict=True):
                whole = text.as_py()
                for k, a in enumerate(range(0, len(whole), chunk)):
                    yield pa.RecordBatch.from_arrays([pa.array([key.as_py()], batch.schema.field(0).type), pa.array([text_key.as_py()]), pa.array([k], pa.int64()), pa.array([whole[a : a + chunk]], pa.string())], names=["id", "digest", "part", "piece"])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            after, units, found = functions(*_points(batch.column(3)))
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], *(pa.array(x.tolist(), pa.list_(pa.int64())) for x in (after, units, found))], names=["id", "digest", "part", "after", "units", "found"])

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            places = [int(unit_starts(np.frombuffer(p.encode("utf-32-le"), np.uint32), s)[u]) for p, s, u in zip(*(batch.column(c).to_pylist() for c in (4, 5, 6)), strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array([c + x for c, x in zip(batch.column(3).to_pylist(), places, strict=True)], pa.int64())], names=["id", "digest", "which", "place"])

    marked = long.withColumn("digest", F.sha2("text", 256))
    distinct = marked.dropDuplicates(["id", "digest"])
    pieces = stage(distinct.select("id", "digest", "text").mapInArrow(cut, f"id {kind}, digest string, part long, piece string").repartition("digest", "part"), "fim-chunks", "zstd")
    made = pieces.mapInArrow(tidied(scan), f"id {kind}, digest string, part long, after array<long>, units array<long>, found array<long>")
    ordered = made.groupBy("id", "digest").agg(F.array_sort(F.collect_list(F.struct("part", "after", "units", "found"))).alias("parts"))
    start = F.struct(F.lit(0).cast("long").alias("state"), F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("marks"), F.array().cast("array<struct<part:long,state:long,before:long,units:long>>").alias("entered"))

    def step(s: Column, p: Column) -> Column:
        at = s["state"].cast("int")
        own = F.struct(p["part"].alias("part"), s["state"].alias("state"), s["n"].alias("before"), p["units"][at].alias("units"))
        return F.struct(p["after"][at].alias("state"), (s["n"] + p["units"][at]).alias("n"), (s["marks"] + p["found"][at]).alias("marks"), F.concat(s["entered"], F.array(own)).alias("entered"))

    told = ordered.select("id", "digest", F.aggregate("parts", start, step).alias("f")).select("id", "digest", "f.n", "f.marks", "f.entered")
    told = told.select("*", *[c.alias(k) for k, c in _draw("id", F.col("n")).items()])
    told = stage(told, "fim-functions")
    # A cut lies where its unit begins, in the chunk where that unit is; behind the last unit, at the end.
    cuts = told.select("id", "digest", F.posexplode(F.array("first", "last")).alias("which", "unit"), F.explode("entered").alias("e")).where("unit >= e.before and unit < e.before + e.units")
    cuts = cuts.select(F.col("id").alias("_id"), F.col("digest").alias("_digest"), F.col("e.part").alias("_part"), "which", F.col("e.state").alias("state"), (F.col("unit") - F.col("e.before")).alias("at"))
    same = lambda a, b: a["id"].eqNullSafe(b["_id"]) & (a["digest"] == b["_digest"])
    there = pieces.join(cuts, same(pieces, cuts) & (pieces["part"] == cuts["_part"]))
    there = there.select("id", "digest", "which", (F.col("part") * chunk).alias("chars"), "piece", "state", "at")
    places = there.mapInArrow(find, f"id {kind}, digest string, which int, place long")
    ends = told.join(places.groupBy(F.col("id").alias("_id"), F.col("digest").alias("_digest")).agg(*[F.max(F.when(F.col("which") == k, F.col("place"))).alias(f"c{k}") for k in (0, 1)]).alias("p"), F.col("id").eqNullSafe(F.col("_id")) & (F.col("digest") == F.col("_digest")), "left")
    ends = stage(ends.select(F.col("id").alias("_id"), F.col("digest").alias("_digest"), "n", "marks", "first", "last", "drawn", "c0", "c1"), "fim-cuts")
    ends = F.broadcast(ends) if small_enough(ends) else ends
    size = F.char_length("text").cast("long")
    return marked.join(ends, same(marked, ends)).select("id", "text", "n", "marks", "first", "last", "drawn", F.array(F.coalesce("c0", size), F.coalesce("c1", size)).alias("cuts"))


def _put_together(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        columns = [batch.column(c).to_pylist() for c in range(1, 7)]
        out = []
        for text, n, form, first, last, cuts in zip(*columns, strict=True):
            if form == "plain":
                out.append((n, form, None, None, text))
                continue
            if cuts is None:
                starts = unit_starts(np.frombuffer(text.encode("utf-32-le"), np.uint32), 0)
                cuts = [int(starts[k]) if k < n else len(text) for k in (first, last)]
            a, b = cuts
            prefix, middle, suffix = text[:a], text[a:b], text[b:]
            parts = ("<S>", suffix, "<P>", prefix) if form == "spm" else ("<P>", prefix, "<S>", suffix)
            out.append((n, form, a, b - a, "".join([*parts, "<M>", middle])))
        types = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string())
        columns = zip(*out, strict=True) if out else [[]] * len(types)
        yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, t) for c, t in zip(columns, types, strict=True))], names=["id", "n", "form", "prefix_chars", "middle_chars", "output"])


def restored(output: Column, form: Column) -> Column:
    """The text that an output of a form was made of; marks are only between its parts."""
    parts = F.split(output, "<[PSM]>", -1)
    return F.when(form == "plain", output).when(form == "psm", F.concat(parts[1], parts[3], parts[2])).otherwise(F.concat(parts[2], parts[3], parts[1]))


def digests(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(id, n, form, prefix_chars, middle_chars, output_sha256, restored_sha256) of every row."""
    done = transform(docs, id_column, text_column)
    return done.select(id_column, "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(restored(F.col("output"), F.col("form")), 256).alias("restored_sha256"))
