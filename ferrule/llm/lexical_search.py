"""Ranked lexical search over document shards in compressed sparse rows, with integer impacts.

* A task turns the documents it reads into shards: of a term that some item asks
  for, the documents of the shard that hold it and how often, term after term
  (CSR), and of every document its length. Shards are written to the shared folder.
* Lengths and document frequencies are added up over all shards: the collection's
  counts cover every document.
* A task then takes shard after shard, computes each posting's impact once, and
  goes through the items term at a time: impacts times the term's weight are
  added to a dense accumulator of the shard's documents. The best k are taken by
  ``argpartition``, equal scores at the border by the smaller doc_id. A task
  keeps the best k of each item over its shards; the tasks' lists are merged by a
  window, an item a group.

Items come in blocks of at most MOST_ITEM_BYTES of text, so what is broadcast and
collected, a block's distinct terms, is bounded; documents are read once a block.

Terms are maximal runs of A-Z, a-z, 0-9 and characters from U+0080, with A-Z
lower-cased; in UTF-8 these are runs of those letters, digits and bytes from 0x80.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ferrule.llm._common import stage, tidied

#: Documents and postings after which a shard is closed.
SHARD_DOCUMENTS, SHARD_POSTINGS = 16_384, 500_000
#: Bytes of a text whose terms are listed together.
TEXT_BYTES = 1 << 20
#: Bytes of item texts in a block of items.
MOST_ITEM_BYTES = 8 << 20

_TERM = re.compile(rb"[0-9a-z\x80-\xff]+")
_LAST = re.compile(rb"[^0-9a-z\x80-\xff]")


def terms(text: str | None) -> Iterator[list[bytes]]:
    """The terms of a text in order, a stretch of it at a time."""
    data = (text or "").encode().lower()
    a = 0
    while a < len(data):
        b = a + TEXT_BYTES
        if b < len(data):  # a stretch ends before a byte that is in no term
            end = _LAST.search(data, b)
            b = end.start() if end else len(data)
        yield _TERM.findall(data, a, b)
        a = b


def _shards(vocabulary: dict[bytes, int]):
    """Rows (documents, lengths, term, held, document, times) of binary arrays, one a shard."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, lengths, numbers, at, times = [], [], [], [], []

        def close():
            term, doc = np.array(numbers, np.int32), np.repeat(np.arange(len(ids), dtype=np.int32), at)
            order = np.argsort(term, kind="stable")
            distinct, held = np.unique(term, return_counts=True)
            arrays = [np.array([(i is not None, i or 0) for i in ids], np.int64).reshape(-1, 2), np.array(lengths, np.int64), distinct, held.astype(np.int32), doc[order], np.array(times, np.int32)[order]]
            for x in (ids, lengths, numbers, at, times):
                x.clear()
            return pa.RecordBatch.from_arrays([pa.array([x.tobytes()], pa.binary()) for x in arrays], names=["documents", "lengths", "term", "held", "document", "times"])

        find = vocabulary.get
        for batch in batches:
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                n, counted = 0, Counter()
                for some in terms(text.as_py()):
                    n += len(some)
                    counted.update(map(find, some))
                counted.pop(None, None)
                if not n:
                    continue
                ids.append(key)
                lengths.append(n)
                at.append(len(counted))
                numbers.extend(counted.keys())
                times.extend(counted.values())
                if len(ids) >= SHARD_DOCUMENTS or len(numbers) >= SHARD_POSTINGS:
                    yield close()
        if ids:
            yield close()

    return tidied(run)


def best(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k highest positive scores, highest first; equal scores by the smaller id, whatever their places."""
    if len(scores) > k:
        least = scores[np.argpartition(scores, len(scores) - k)[len(scores) - k]]
        at = np.flatnonzero(scores >= max(least, 1))
    else:
        at = np.flatnonzero(scores > 0)
    return at[np.lexsort((ids[at], -scores[at]))][:k]


#: Rows without an id come after all ids.
NO_ID = np.int64(np.iinfo(np.int64).max)


def _scores(items: list[list[tuple[int, int]]], documents: int, words: int, weights: list[int], k: int):
    """Rows (item, doc_id, score) of a task's best k of each item."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        top: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for batch in batches:
            for row in zip(*(batch.column(c) for c in range(6)), strict=True):
                raw = [x.as_py() for x in row]
                named, ids = np.frombuffer(raw[0], np.int64).reshape(-1, 2).T
                ids = np.where(named == 1, ids, NO_ID)
                # Python integers: 75 * n * N may be over 63 bits.
                m = np.array([25 + 75 * n * documents // words for n in np.frombuffer(raw[1], np.int64).tolist()], np.int64)
                term, held, document = (np.frombuffer(x, np.int32) for x in raw[2:5])
                times = np.frombuffer(raw[5], np.int32).astype(np.int64)
                impact = (1_000_000_000 * times) // (1000 * times + 8 * m[document])
                ends = np.cumsum(held.astype(np.int64))
                where = {t: (e - h, e) for t, h, e in zip(term.tolist(), held.tolist(), ends.tolist(), strict=True)}
                total = np.zeros(len(ids), np.int64)
                for item, asked in enumerate(items):
                    total[:] = 0
                    for t, n in asked:
                        if t in where:
                            a, b = where[t]
                            total[document[a:b]] += n * weights[t] * impact[a:b]
                    at = best(total, ids, k)
                    if len(at):
                        old = top.get(item, (np.zeros(0, np.int64),) * 2)
                        found = np.concatenate([old[0], ids[at]]), np.concatenate([old[1], total[at]])
                        keep = best(found[1], found[0], k)
                        top[item] = found[0][keep], found[1][keep]
        if top:
            which = np.repeat(list(top), [len(x) for x, _ in top.values()])
            ids, scores = (np.concatenate(x) for x in zip(*top.values(), strict=True))
            yield pa.RecordBatch.from_arrays([pa.array(which, pa.int64()), pa.array(ids, pa.int64(), mask=ids == NO_ID), pa.array(scores, pa.int64())], names=["item", "doc_id", "score"])

    return tidied(run)


def _blocks(items: DataFrame, id_column: str, text_column: str) -> Iterator[list[tuple]]:
    """Items in blocks of at most MOST_ITEM_BYTES of text, a longer item alone; the driver holds one block at a time."""
    rows, size = [], 0
    asked = items.select(F.col(f"`{id_column}`").alias("item"), F.col(f"`{text_column}`").cast("string").alias("text")).where("text is not null").distinct()
    for row in asked.toLocalIterator():
        if rows and size + len(row["text"]) > MOST_ITEM_BYTES:
            yield rows
            rows, size = [], 0
        rows.append((row["item"], row["text"]))
        size += len(row["text"])
    if rows:
        yield rows


def search(docs: DataFrame, items: DataFrame, k: int = 10, id_column: str = "doc_id", text_column: str = "text", item_column: str = "item_id", item_text: str = "text") -> DataFrame:
    """(item_id, rank, doc_id, score): of each item the k documents with the highest scores above 0, equal scores by ascending doc_id.

    The score of a document with n terms, of N documents with terms that have L terms in
    all, sums over the item's terms, repeats included, w * (10^9 tf div (1000 tf + 8 m)),
    where w = floor(1000 ln((2 N + 2) / (2 df + 1))) and m = 25 + 75 n N div L.

    Null and empty texts have no terms: such documents aren't counted, such
    items have no rows. Every row of ``docs`` is a document: rows that repeat an id are counted
    and ranked each, rows with a null id come behind equal scores. Equal rows of ``items`` are one item;
    a term in more than half of the documents may weigh 0 or less, as
    the formula says. Either table empty: no rows. Other columns are ignored, whatever their names.
    """
    spark = docs.sparkSession
    kind = items.schema[item_column].dataType
    texts = docs.select(F.col(f"`{id_column}`").cast("long").alias("id"), F.col(f"`{text_column}`").cast("string").alias("text"))
    out = None
    for block in _blocks(items, item_column, item_text):
        vocabulary: dict[bytes, int] = {}
        asked = []
        for _, text in block:
            counted = Counter(t for some in terms(text) for t in some)
            asked.append([(vocabulary.setdefault(t, len(vocabulary)), n) for t, n in counted.items()])
        shards = stage(texts.mapInArrow(_shards(vocabulary), "documents binary, lengths binary, term binary, held binary, document binary, times binary"), "search-shards", "zstd")
        documents, words, held = _collection(shards, len(vocabulary))
        weights = [math.floor(1000 * math.log((2 * documents + 2) / (2 * df + 1))) for df in held]
        found = shards.mapInArrow(_scores(asked, documents, words, weights, k), "item long, doc_id long, score long") if documents else spark.createDataFrame([], "item long, doc_id long, score long")
        w = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
        ranked = found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
        names = spark.createDataFrame(list(zip(range(len(block)), [i for i, _ in block], strict=True)), f"item long, `{item_column}` {kind.simpleString()}")
        rows = ranked.join(F.broadcast(names), "item").select(item_column, "rank", F.col("doc_id").alias(id_column), "score")
        out = rows if out is None else out.union(rows)
    return spark.createDataFrame([], f"`{item_column}` {kind.simpleString()}, rank int, `{id_column}` long, score long") if out is None else out


def _collection(shards: DataFrame, size: int) -> tuple[int, int, list[int]]:
    """Documents, their terms with repeats, and the documents that hold each term of the vocabulary."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        documents, words, held = 0, 0, np.zeros(size, np.int64)
        for batch in batches:
            for lengths, term, n in zip(*(batch.column(c) for c in range(3)), strict=True):
                own = np.frombuffer(lengths.as_py(), np.int64)
                documents, words = documents + len(own), words + int(own.sum())
                held[np.frombuffer(term.as_py(), np.int32)] += np.frombuffer(n.as_py(), np.int32)
        at = np.flatnonzero(held)
        yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in ([-2, -1, *at.tolist()], [documents, words, *held[at].tolist()])], names=["what", "n"])

    sums = {r["what"]: r["n"] for r in shards.select("lengths", "term", "held").mapInArrow(run, "what long, n long").groupBy("what").agg(F.sum("n").alias("n")).collect()}
    return sums.get(-2, 0), sums.get(-1, 0), [sums.get(t, 0) for t in range(size)]
