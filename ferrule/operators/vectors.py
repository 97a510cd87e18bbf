"""Exact retrieval over embedding tables: a stated query set against all rows, in blocks.

A block of at most QUERY_BLOCK query tokens is brought to the driver and sent to
the tasks as one matrix; each batch of rows is one matrix product. Tasks keep
their own best rows, so only k rows for each query token and task are shuffled.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Query tokens of one block; with 128 dimensions 4 MB.
QUERY_BLOCK = 4_096
#: Scores of a block of query tokens and a stretch of rows that a task holds at once: 8 MB of them, a few times over.
MOST_SCORES = 1 << 20


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """Cosine; 0 where either vector is zero."""
    norms = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norms == 0, 0.0).otherwise(dot(a, b) / norms)


def _matrix(column) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 0)


def _exact(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Row by row products, summed in order of the dimensions."""
    return np.cumsum(a * b, axis=1)[:, -1]


def _stretches(tokens: int, rows: int) -> Iterator[slice]:
    """Stretches of rows whose scores with ``tokens`` query tokens are held at once."""
    step = max(1, MOST_SCORES // max(1, tokens))
    return (slice(a, min(a + step, rows)) for a in range(0, rows, step))


def _blocks(queries: DataFrame) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(q, t, matrix) of the query tokens, QUERY_BLOCK at a time, split by a hash of the token."""
    parts = max(1, -(-queries.count() // QUERY_BLOCK))
    for p in range(parts):
        block = queries if parts == 1 else queries.where(F.pmod(F.xxhash64("q", "t"), F.lit(parts)) == p)
        table = block.select(F.col("q").cast("long"), F.col("t").cast("long"), "qv").toArrow().combine_chunks()
        if table.num_rows:
            yield table.column(0).to_numpy(), table.column(1).to_numpy(), _matrix(table.column(2).chunk(0))


def _union(parts: list[DataFrame], empty: Callable[[], DataFrame]) -> DataFrame:
    return reduce(DataFrame.union, parts) if parts else empty()


def knn(queries: DataFrame, rows: DataFrame, k: int) -> DataFrame:
    """The k rows of largest inner product for each query token (q, t, qv) among (id, page, v), ties by id."""
    schema = "q long, t long, id long, page long, score double"

    def nearest(q: np.ndarray, t: np.ndarray, m: np.ndarray) -> Callable:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            best = [np.zeros(0, np.int64)] * 3 + [np.zeros(0)]  # query, id, page, score
            least = np.full(len(m), -np.inf)  # of a query's k best so far
            for batch in batches:
                if not batch.num_rows:
                    continue
                ids, pages, rows = batch.column(0).to_numpy(), batch.column(1).to_numpy(), _matrix(batch.column(2))
                for part in _stretches(len(m), len(rows)):
                    v = rows[part]
                    scores, n = m @ v.T, min(k, len(v))
                    bar = np.maximum(np.partition(scores, len(v) - n, axis=1)[:, -n] if n == k else -np.inf, least)
                    a, b = np.nonzero(scores >= bar[:, None] - 1e-9 * (1 + np.abs(bar[:, None])))
                    found = a, ids[part][b], pages[part][b], _exact(m[a], v[b])
                    best = [np.concatenate(x) for x in zip(best, found, strict=True)]
                    order = np.lexsort((best[1], -best[3], best[0]))
                    best = [x[order] for x in best]
                    place = np.arange(len(order)) - np.searchsorted(best[0], best[0])
                    least[best[0][place == k - 1]] = best[3][place == k - 1]
                    best = [x[place < k] for x in best]
            if len(best[0]):
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (q[best[0]], t[best[0]], *best[1:])], names=["q", "t", "id", "page", "score"])

        return run

    plain = rows.select(F.col("id").cast("long"), F.col("page").cast("long"), "v")
    found = _union([plain.mapInArrow(nearest(*b), schema) for b in _blocks(queries)], lambda: rows.sparkSession.createDataFrame([], schema))
    return found.withColumn("rank", F.row_number().over(Window.partitionBy("q", "t").orderBy(F.desc("score"), "id"))).where(F.col("rank") <= k)


def indexed_maxsim(hits: DataFrame) -> DataFrame:
    """Page scores from k-NN hits: the best of a page for each query token, summed over tokens."""
    return hits.groupBy("q", "t", "page").agg(F.max("score").alias("s")).groupBy("q", "page").agg(F.sum("s").alias("score"))


def top_pages(scores: DataFrame, k: int, strict: bool = True) -> DataFrame:
    """The k best pages of each query; fewer than k are an error, or (not strict) passed on."""
    w = Window.partitionBy("q")
    ranked = scores.withColumn("page_rank", F.row_number().over(w.orderBy(F.desc("score"), "page")) - 1).withColumn("_n", F.count("*").over(w))
    place = F.when(F.col("_n") < k, F.raise_error(F.concat(F.lit("too few pages for query "), F.col("q").cast("string"))).cast("int")).otherwise(F.col("page_rank")) if strict else F.col("page_rank")
    return ranked.withColumn("page_rank", place).where(F.col("page_rank") < k).drop("_n")


def full_maxsim(queries: DataFrame, rows: DataFrame, where: Column | None = None) -> DataFrame:
    """Page scores over all rows of a page (or those ``where`` keeps, as image tokens): the best for each query token, summed.

    Rows are dealt out by page, so that a page's maxima and sums are made in one task.
    """
    schema = "q long, page long, score double"

    def pages(q: np.ndarray, t: np.ndarray, m: np.ndarray) -> Callable:
        order = np.argsort(q, kind="stable")
        q, m = q[order], m[order]
        qs, nth = np.unique(q, return_inverse=True)

        def scored(page: np.ndarray, v: np.ndarray) -> Iterator[pa.RecordBatch]:
            cuts = np.append(np.flatnonzero(np.diff(page, prepend=page[0] - 1)), len(page))
            for part in _stretches(len(qs), len(cuts) - 1):
                first, end = cuts[:-1][part], cuts[part.stop]
                rows, sums = v[first[0] : end], np.zeros((len(qs), len(first)))
                for some in _stretches(len(rows), len(m)):
                    heads = np.flatnonzero(np.diff(nth[some], prepend=-1))
                    sums[nth[some][heads]] += np.add.reduceat(np.maximum.reduceat(m[some] @ rows.T, first - first[0], axis=1), heads, axis=0)
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(qs, len(first))), pa.array(np.tile(page[first], len(qs))), pa.array(sums.ravel())], names=["q", "page", "score"])

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held: tuple | None = None
            for batch in batches:
                if not batch.num_rows:
                    continue
                page, v = batch.column(0).to_numpy(), _matrix(batch.column(1))
                if held is not None:
                    page, v = np.concatenate((held[0], page)), np.concatenate((held[1], v))
                cut = int(np.searchsorted(page, page[-1]))
                if cut:
                    yield from scored(page[:cut], v[:cut])
                held = page[cut:], v[cut:]
            if held is not None:
                yield from scored(*held)

        return run

    dealt = (rows if where is None else rows.where(where)).select(F.col("page").cast("long").alias("page"), "v").repartition("page").sortWithinPartitions("page")
    found = [dealt.mapInArrow(pages(*b), schema) for b in _blocks(queries)]
    return _union(found, lambda: rows.sparkSession.createDataFrame([], schema)).groupBy("q", "page").agg(F.sum("score").alias("score"))


def cosine_relevance(queries: DataFrame, rows: DataFrame) -> DataFrame:
    """(id, relevance): the sum of each row's cosines with all query tokens, which is its unit vector's product with the sum of theirs; 0 for zero vectors."""
    unit = lambda c: F.transform(c, lambda x: x.cast("double") / F.when(dot(F.col(c), F.col(c)) == 0, 1.0).otherwise(F.sqrt(dot(F.col(c), F.col(c)))))
    parts = queries.select(F.posexplode(unit("qv")).alias("i", "x")).groupBy("i").agg(F.sum("x").alias("x"))
    total = parts.agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda s: s["x"]).alias("total"))
    norm = F.sqrt(dot(F.col("v"), F.col("v")))
    return rows.join(F.broadcast(total)).select("id", F.when(norm == 0, 0.0).otherwise(dot(F.col("v"), F.col("total")) / norm).alias("relevance"))


def unique_pages(hits: DataFrame, group: list[str], page: str, order: str) -> DataFrame:
    """Each page once, in the order of its first hit."""
    first = hits.groupBy(*group, page).agg(F.min(order).alias("_first"))
    return first.withColumn("place", F.row_number().over(Window.partitionBy(*group).orderBy("_first", page)) - 1).drop("_first")


def priorities(profiles: DataFrame) -> DataFrame:
    """By (page, region) from (page, region, q, kind, score, cost): MaxSim over all, lexical, augmentation and focus tokens, mean, mean of the top three, per cost, and what the best token has over other regions."""
    of = lambda k: F.coalesce(F.sum(F.when(F.col("kind") == k, F.col("score"))), F.lit(0.0))
    rank = F.row_number().over(Window.partitionBy("page", "region").orderBy(F.desc("score"), "q"))
    best = Window.partitionBy("page", "q").orderBy(F.desc("score"), "region")
    j = profiles.withColumn("_n", rank).withColumn("_lead", F.when(F.row_number().over(best) == 1, F.col("score") - F.coalesce(F.lead("score").over(best), F.lit(0.0))).otherwise(0.0))
    return j.groupBy("page", "region").agg(
        F.sum("score").alias("all"), of("lexical").alias("lexical"), of("augmentation").alias("augmentation"), of("focus").alias("focus"), F.avg("score").alias("mean"),
        F.avg(F.when(F.col("_n") <= 3, F.col("score"))).alias("top_three"), (F.sum("score") / F.max("cost")).alias("per_cost"), F.sum("_lead").alias("exclusive"),
    )


def mask_coverage(profiles: DataFrame, masks: DataFrame) -> DataFrame:
    """(page, mask, coverage): mean over query tokens of the greatest score among the kept regions; a token without any counts 0."""
    kept = masks.where("kept").join(profiles, ["page", "region"]).groupBy("page", "mask", "q").agg(F.max("score").alias("s"))
    tokens = profiles.groupBy("page").agg(F.count_distinct("q").alias("n"))
    sums = kept.groupBy("page", "mask").agg(F.sum("s").alias("s"))
    return masks.select("page", "mask").distinct().join(sums, ["page", "mask"], "left").join(tokens, "page").select("page", "mask", (F.coalesce("s", F.lit(0.0)) / F.col("n")).alias("coverage"))


def parity(a: DataFrame, b: DataFrame, key: str, vector: str) -> DataFrame:
    """Greatest and mean absolute difference, least and mean cosine of rows of two tables, and how many rows only one has."""
    j = a.select(key, F.col(vector).alias("_a")).join(b.select(key, F.col(vector).alias("_b")), key, "full")
    gaps = F.zip_with("_a", "_b", lambda x, y: F.abs(x.cast("double") - y.cast("double")))
    rows = j.select(F.array_max(gaps).alias("m"), F.aggregate(gaps, F.lit(0.0), lambda s, x: s + x).alias("s"), F.size(gaps).alias("n"), cosine(F.col("_a"), F.col("_b")).alias("c"), (F.col("_a").isNull() | F.col("_b").isNull()).alias("alone"))
    both = F.when(~F.col("alone"), F.lit(1))
    return rows.agg(F.max("m").alias("most"), (F.sum(both * F.col("s")) / F.sum(both * F.col("n"))).alias("mean"), F.min(both * F.col("c")).alias("least_cosine"), F.avg(both * F.col("c")).alias("mean_cosine"), F.count_if("alone").alias("unmatched"))
