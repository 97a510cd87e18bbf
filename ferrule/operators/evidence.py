"""Evidence on pages: passages located in texts, pictures told to be the same."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ferrule.functions.text import letters_only
from ferrule.operators import containment


def located(passages: DataFrame, pages: DataFrame, retrieved: DataFrame) -> DataFrame:
    """(question, document, status, found, missing) of (question, document, title, text) passages in (document, page, text) pages.

    A passage counts where its letters stand on one to three consecutive pages
    and its title on the document's first page; of several places the one with
    the fewest pages that weren't retrieved (question, document, page) is taken,
    then the shortest, then the first. Without a place it stays unresolved.
    """
    plain = pages.select("document", "page", letters_only(F.col("text")).alias("text"))
    wanted = passages.select("question", "document", letters_only(F.col("title")).alias("title"), letters_only(F.col("text")).alias("needle")).withColumn("passage", F.xxhash64("question", "document", "needle"))
    hits = containment.minimal_windows(plain.withColumnRenamed("document", "doc"), wanted.select(F.col("document").alias("doc"), "passage", "needle"), between="").withColumnRenamed("doc", "document")
    first = plain.where("page = 0").select("document", F.col("text").alias("_first"))
    titled = wanted.join(first, "document").where(F.contains("_first", "title")).select("question", "document", "passage")
    placed = hits.join(titled, ["document", "passage"]).withColumn("page", F.explode(F.array_union(F.sequence("first", "last"), F.array(F.lit(0)))))
    known = retrieved.select("question", "document", "page", F.lit(True).alias("_there")).distinct()
    there = placed.join(known, ["question", "document", "page"], "left")
    keys = ["question", "document", "passage", "first", "last"]
    options = there.groupBy(*keys).agg(F.array_sort(F.collect_set("page")).alias("found"), F.array_sort(F.collect_set(F.when(F.col("_there").isNull(), F.col("page")))).alias("missing"))
    w = Window.partitionBy("question", "document", "passage").orderBy(F.size("missing"), F.col("last") - F.col("first"), "first")
    best = options.withColumn("_n", F.row_number().over(w)).where("_n = 1").select("question", "document", "passage", "found", "missing")
    out = wanted.select("question", "document", "passage").distinct().join(best, ["question", "document", "passage"], "left")
    status = F.when(F.col("found").isNull(), "unresolved").when(F.size("missing") == 0, "present").otherwise("missing")
    return out.select("question", "document", status.alias("status"), "found", "missing")


@lru_cache(maxsize=64)
def _area_weights(n: int, size: int) -> np.ndarray:
    edges = np.linspace(0, n, size + 1)
    at = np.arange(n)
    w = np.clip(np.minimum(edges[1:, None], at + 1) - np.maximum(edges[:-1, None], at), 0, None)
    return w / w.sum(1, keepdims=True)


def _shrunk(pixels: np.ndarray, size: int = 64) -> np.ndarray:
    """A picture (height, width, 3) as size x size means of areas, in 0 to 1."""
    narrow = np.tensordot(_area_weights(pixels.shape[0], size), pixels / 255.0, 1)
    return np.matmul(_area_weights(pixels.shape[1], size), narrow)


def matched_pictures(pairs: DataFrame, aspect: float = 0.03, mean: float = 0.01, tail: float = 0.08) -> DataFrame:
    """(source, candidate, rotation, mean_error, tail_error, status) of (source, candidate, and height, width and rgb bytes of each as s_... and c_...).

    All four rotations of an aspect within the tolerance are compared as small
    means; "exact" is equality pixel by pixel, "near" a mean error and a 99 %
    quantile below their bounds, else "none"; the best rotation is returned,
    null if the aspects differ.
    """

    def compare(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for r in frame.itertuples():
                s = np.frombuffer(r.s_rgb, np.uint8).reshape(r.s_height, r.s_width, 3)
                c = np.frombuffer(r.c_rgb, np.uint8).reshape(r.c_height, r.c_width, 3)
                small, best = _shrunk(s), (None, None, None, "none")
                for turn in range(4):
                    view = np.rot90(c, turn)
                    if abs((view.shape[1] / view.shape[0]) / (r.s_width / r.s_height) - 1) > aspect:
                        continue
                    gap = np.abs(_shrunk(view) - small)
                    errors = float(gap.mean()), float(np.quantile(gap, 0.99))
                    status = "exact" if view.shape == s.shape and np.array_equal(view, s) else "near" if errors[0] <= mean and errors[1] <= tail else "none"
                    if best[1] is None or (status != "exact", errors[0]) < (best[3] != "exact", best[1]):
                        best = (90 * turn, *errors, status)
                out.append((r.source, r.candidate, *best))
            yield pd.DataFrame(out, columns=["source", "candidate", "rotation", "mean_error", "tail_error", "status"]).astype({"rotation": "Int32", "mean_error": float, "tail_error": float})

    return pairs.mapInPandas(compare, "source long, candidate long, rotation int, mean_error double, tail_error double, status string")


#: Widths of a signature's cells: for the logarithm of the aspect, and for signed sums in tolerances; MEAN_CELL bounds the tolerance.
ASPECT_CELL, SIGN_CELL, MEAN_CELL = 0.25, 4, 0.08
#: A picture's blocks along an axis, and so its bands: diagonals of blocks, of which each has one of every row and column.
BANDS = 8


def _signs(n: int = BANDS) -> np.ndarray:
    """n orthogonal patterns of signs."""
    return np.kron([[1, 1], [1, -1]], _signs(n // 2)) if n > 1 else np.ones((1, 1), int)


def _rings(size: int = 64) -> np.ndarray:
    """The ring of each pixel: squares about the middle with about equal areas between them."""
    away = np.abs(np.arange(size) - (size - 1) / 2)
    return np.digitize(np.maximum(away[:, None], away[None, :]), [size * x / 2 for x in (0.5, 0.72, 0.875)])


def _mixed(h: np.ndarray, cell: np.ndarray) -> np.ndarray:
    h = (h ^ cell.astype(np.int64).view(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
    return h ^ (h >> np.uint64(29))


def _cells(low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """A number for every cell between ``low`` and ``high``, which are the same or neighbours in every column; the first column tells the band."""
    row, h = np.arange(len(low)), np.zeros(len(low), np.uint64)
    for a, b in zip(low.T, high.T, strict=True):
        two = a[row] != b[row]
        h = np.concatenate((_mixed(h, a[row]), _mixed(h[two], b[row[two]])))
        row = np.concatenate((row, row[two]))
    return np.unique(h).view(np.int64)


def _signatures(probes: bool, aspect: float, mean: float):
    """Rows (picture, means, cells): means of rings, which stay when a picture is turned, and the cell of each band, or with ``probes`` every cell that a match's may be in, whatever way the picture is turned."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ring, signs, at = _rings(), _signs(), np.arange(BANDS)
        bands = at[None, :], (at[:, None] + at[None, :]) % BANDS
        room = np.array([-np.log(1 - aspect), *[mean / BANDS] * BANDS]) + 1e-9
        width = np.array([ASPECT_CELL, *room[1:] * SIGN_CELL])
        for frame in frames:
            out = []
            for r in frame.itertuples():
                small = _shrunk(np.frombuffer(r.rgb, np.uint8).reshape(r.height, r.width, 3))
                # Of a ring and channel the sum over its pixels, as a share of all pixels.
                sums = np.stack([np.bincount(ring.ravel(), small[..., c].ravel(), 4) for c in range(3)], 1) / small.size
                step = len(small) // BANDS
                blocks = small.sum(2).reshape(BANDS, step, BANDS, step).sum((1, 3)) / small.size
                low, high = [], []
                for turn in range(4 if probes else 1):
                    shape = np.full((BANDS, 1), np.log(r.width / r.height) * (-1) ** turn)
                    points = np.hstack((shape, np.rot90(blocks, turn)[bands] @ signs))
                    for side, x in ((low, -room), (high, room)) if probes else ((low, 0), (high, 0)):
                        side.append(np.hstack((at[:, None], np.floor((points + x) / width).astype(int))))
                out.append((r.picture, sums.ravel(), _cells(np.concatenate(low), np.concatenate(high))))
            yield pd.DataFrame(out, columns=["picture", "means", "cells"])

    if -np.log(1 - aspect) * 2 >= ASPECT_CELL or mean * 2 >= MEAN_CELL:
        raise ValueError("tolerances are wider than the cells")
    return run


def same_pictures(pictures: DataFrame) -> DataFrame:
    """(picture, first): pictures equal pixel by pixel, by size and digest, and the least of them; rows of (picture, height, width, rgb)."""
    keyed = pictures.select("picture", "height", "width", F.sha2("rgb", 256).alias("_d"))
    first = keyed.groupBy("height", "width", "_d").agg(F.min("picture").alias("first"))
    return keyed.join(first, ["height", "width", "_d"]).select("picture", "first")


def picture_pairs(sources: DataFrame, candidates: DataFrame, aspect: float = 0.03, mean: float = 0.01, tail: float = 0.08) -> DataFrame:
    """(source, candidate, rotation, mean_error, tail_error, status) of all pictures that are "exact" or "near", by ``matched_pictures``.

    Rows of both tables are (picture, height, width, rgb). Equal pictures are
    looked at once: pairs are of the least of each (``same_pictures`` tells the
    others). The absolute differences of a match add up to the mean error, so one
    at least of ``BANDS`` bands of a picture has at most its share of the tolerance, and
    in that band every signed sum of blocks differs by no more: a match lies in the cell of
    a source's band or beside it, of one of the four ways the source can be turned, and nothing is lost. As a
    band has little room and many signs, cells of unlike pictures are seldom the same. Pairs of a cell must also be close ring by ring before their pixels are
    fetched. Pictures that are null or have no pixels match nothing.
    """
    whole = F.col("rgb").isNotNull() & (F.length("rgb") == F.col("height") * F.col("width") * 3) & (F.length("rgb") > 0)
    kept = [p.where(whole).groupBy("height", "width", F.sha2("rgb", 256).alias("_d")).agg(F.min("picture").alias("picture"), F.first("rgb").alias("rgb")).select("picture", "height", "width", "rgb") for p in (sources, candidates)]
    # A picture costs much and its cells are many, which no estimate of a table's size tells: pictures are dealt over all tasks, and cells are never broadcast.
    tasks = int(candidates.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    s, c = (p.repartition(tasks, "picture").mapInPandas(_signatures(probes, aspect, mean), "picture long, means array<double>, cells array<long>").select(F.col("picture").alias(name), F.col("means").alias(f"{name}_means"), F.explode("cells").alias("cell")) for p, name, probes in zip(kept, ("source", "candidate"), (True, False), strict=True))
    gap = F.aggregate(F.zip_with("source_means", "candidate_means", lambda a, b: F.abs(a - b)), F.lit(0.0), lambda x, y: x + y)
    close = s.hint("merge").join(c, "cell").where(gap <= mean + 1e-9).select("source", "candidate").distinct()
    s, c = (p.select(F.col("picture").alias(name), *[F.col(x).alias(f"{name[0]}_{x}") for x in ("height", "width", "rgb")]) for p, name in zip(kept, ("source", "candidate"), strict=True))
    return matched_pictures(close.join(s, "source").join(c, "candidate"), aspect, mean, tail).where("status <> 'none'")


def modal_sizes(pages: DataFrame) -> DataFrame:
    """(document, height, width): the commonest page size of a document, the first seen of equals."""
    n = pages.groupBy("document", "height", "width").agg(F.count("*").alias("n"), F.min("page").alias("first"))
    return n.groupBy("document").agg(F.max_by(F.struct("height", "width"), F.struct("n", -F.col("first"))).alias("s")).select("document", "s.*")
