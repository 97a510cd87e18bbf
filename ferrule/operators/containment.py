"""Passages found in windows of consecutive pages, by an index of the pages' text.

Every stretch of 24 characters has a representative: of its 13 runs of 12
characters the one with the least hash, the first of equals. A page lists the representatives
of the stretches that begin on it (about one for seven characters), and so does a passage.
A stretch has the same representative wherever it stands, so a passage can stand only
where its rarest one does. Of these places, at most as many as the document's text is
long, each is compared with the passage itself.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

RUN, STRETCH = 12, 24


def _representatives(text: str, begins: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and places of the representatives of the stretches that begin before ``begins``, each place once."""
    points = np.frombuffer(text.encode("utf-32-le"), np.uint32).astype(np.uint64)
    n = min(begins, len(points) - STRETCH + 1)
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    points = points[: n + STRETCH - 1]
    runs = len(points) - RUN + 1
    hashed = np.zeros(runs, np.uint64)
    for k in range(RUN):
        hashed = hashed * np.uint64(0x9E3779B97F4A7C15) + points[k : k + runs]
    hashed = (hashed ^ (hashed >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    hashed ^= hashed >> np.uint64(32)
    width = STRETCH - RUN + 1
    at = np.unique(np.arange(n) + np.argmin(np.lib.stride_tricks.sliding_window_view(hashed, width)[:n], axis=1))
    return hashed[at].view(np.int64), at


def _listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key columns, gram, at) of (key columns, text, begins) rows."""
    for batch in batches:
        keys, texts, begins = batch.columns[:-2], batch.column(batch.num_columns - 2), batch.column(batch.num_columns - 1)
        grams, places, row = [], [], []
        for k, (text, n) in enumerate(zip(texts, begins.to_pylist(), strict=True)):
            gram, at = _representatives(text.as_py() or "", n or 0)
            grams.append(gram)
            places.append(at)
            row.append(np.full(len(at), k))
        if row:
            take = pa.array(np.concatenate(row), pa.int64())
            yield pa.RecordBatch.from_arrays([*(c.take(take) for c in keys), pa.array(np.concatenate(grams), pa.int64()), pa.array(np.concatenate(places), pa.int64())], names=[*batch.schema.names[:-2], "gram", "at"])


def _index(rows: DataFrame, keys: list[str]) -> DataFrame:
    kinds = ", ".join(f"{k} {rows.schema[k].dataType.simpleString()}" for k in keys)
    return rows.select(*keys, "text", "begins").mapInArrow(_listed, f"{kinds}, gram long, at long")


def candidates(pages: DataFrame, passages: DataFrame, widest: int = 3, between: str = " ") -> DataFrame:
    """(doc, passage, page, start): where passages may begin, counted from the start of the page, by the rarest representative of each."""
    wide = _wide(pages, widest)
    # A stretch that begins on a page, or between it and the next, ends at most STRETCH characters on.
    ahead = F.concat_ws(between, *[F.coalesce(F.left(f"s{k}", F.lit(STRETCH)), F.lit("")) if k == widest - 1 else F.coalesce(f"s{k}", F.lit("")) for k in range(1, widest)]) if widest > 1 else F.lit("")
    text = F.concat("s0", F.left(F.concat(F.lit(between), ahead), F.lit(STRETCH + len(between))))
    listed = _index(wide.select("doc", "page", text.alias("text"), (F.length("s0") + len(between)).alias("begins")), ["doc", "page"])
    wanted = _index(passages.select("doc", "passage", F.col("needle").alias("text"), F.length("needle").alias("begins")), ["doc", "passage"])
    # A representative without places weighs nothing, and then there is no place at all.
    often = listed.groupBy("doc", "gram").agg(F.count("*").alias("n"))
    rarest = wanted.join(often, ["doc", "gram"], "left").groupBy("doc", "passage").agg(F.min_by(F.struct("gram", "at"), F.struct(F.coalesce("n", F.lit(0)), "at")).alias("r"))
    rarest = rarest.select("doc", "passage", F.col("r.gram").alias("gram"), F.col("r.at").alias("within"))
    return listed.join(rarest, ["doc", "gram"]).select("doc", "passage", "page", (F.col("at") - F.col("within")).alias("start"), "within")


def _wide(pages: DataFrame, widest: int) -> DataFrame:
    w = Window.partitionBy("doc").orderBy("page")
    text = F.coalesce("text", F.lit(""))
    return pages.withColumn("_t", text).select("doc", "page", F.col("_t").alias("s0"), *[F.lead("_t", k).over(w).alias(f"s{k}") for k in range(1, widest)], *[F.lead("page", k).over(w).alias(f"p{k}") for k in range(1, widest)])


def minimal_windows(pages: DataFrame, passages: DataFrame, least: int = 24, widest: int = 3, between: str = " ") -> DataFrame:
    """(doc, passage, first, last): windows of up to ``widest`` pages that hold the passage and hold no smaller such window.

    ``pages`` has doc, page and text, a page of a document once; ``passages`` has doc, passage and needle.
    Both are normalised by the caller; passages under ``least`` characters
    (24 at least) match nothing, null texts are empty pages. Pages stand together with ``between`` between them.
    """
    if least < STRETCH:
        raise ValueError(f"passages under {STRETCH} characters can't be looked up")
    needles = passages.where(F.length("needle") >= least).select("doc", "passage", "needle").distinct()
    found = candidates(pages, needles, widest, between)
    # A representative further on in the passage may lie on a later page than the passage's first: steps back are made page by page.
    base = _wide(pages, widest)
    back = Window.partitionBy("doc").orderBy("page")
    sizes = pages.select("doc", "page", F.length(F.coalesce("text", F.lit(""))).alias("_n"))
    before = [F.lag("_n", k).over(back) + len(between) for k in range(1, widest)]
    steps = sizes.select("doc", "page", *[F.lag("page", k).over(back).alias(f"b{k}") for k in range(1, widest)], *[b.alias(f"l{k}") for k, b in enumerate(before, 1)])
    begun = found.join(steps, ["doc", "page"])
    options, shift = [F.struct(F.col("page").alias("first"), F.col("start").alias("start"))], F.lit(0)
    for k in range(1, widest):
        shift = shift + F.col(f"l{k}")
        options.append(F.struct(F.col(f"b{k}").alias("first"), (F.col("start") + shift).alias("start")))
    begun = begun.select("doc", "passage", F.explode(F.array(*options)).alias("o")).select("doc", "passage", F.col("o.first").alias("page"), F.col("o.start").alias("start")).where("page is not null and start >= 0").distinct()
    placed = begun.join(base, ["doc", "page"]).where(F.col("start") < F.length("s0") + len(between)).join(needles, ["doc", "passage"])
    # The window ends with the first page that reaches the passage's last character.
    end, reach, last = F.col("start") + F.length("needle"), F.length("s0"), F.when(F.col("start") + F.length("needle") <= F.length("s0"), F.col("page"))
    for k in range(1, widest):
        reach = reach + len(between) + F.length(f"s{k}")
        last = last.when(end <= reach, F.col(f"p{k}"))
    whole = F.concat_ws(between, *[f"s{k}" for k in range(widest)])
    same = F.substring(whole, (F.col("start") + 1).cast("int"), F.length("needle")) == F.col("needle")
    hits = placed.withColumn("last", last).where(F.col("last").isNotNull() & same).groupBy("doc", "passage", F.col("page").alias("first")).agg(F.min("last").alias("last"))
    later = Window.partitionBy("doc", "passage").orderBy("first").rowsBetween(1, Window.unboundedFollowing)
    return hits.withColumn("_next", F.min("last").over(later)).where("_next is null or _next > last").drop("_next")
