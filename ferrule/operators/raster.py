"""Rasters as rows (page, y, x, v): scatter, resize, smoothing, backgrounds, group decisions.

Resizing and smoothing are products of a matrix for each axis with a page's
array: cells are shuffled once, by page, and a page is one array there. Other steps
are grouped aggregates. Pages are dealt over all tasks; a page's size is its raster's.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ferrule.operators.settle import summed_before


def grid(pages: DataFrame, height: int, width: int) -> DataFrame:
    """(page, y, x) of every cell of every page."""
    axis = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    return pages.select("page").distinct().withColumn("y", axis(height)).withColumn("x", axis(width))


def scattered(tokens: DataFrame, height: int, width: int) -> DataFrame:
    """(page, y, x, v) of all cells from (page, place, v); cells without a token have null. Repeated or outlying places are told by ``scatter_violations``."""
    cells = tokens.select("page", F.floor(F.col("place") / width).cast("int").alias("y"), (F.col("place") % width).cast("int").alias("x"), "v")
    return grid(tokens, height, width).join(cells, ["page", "y", "x"], "left")


def scatter_violations(tokens: DataFrame, height: int, width: int) -> DataFrame:
    """(kind, page, place): places outside the raster, and those that occur more than once on a page."""
    outside = tokens.where((F.col("place") < 0) | (F.col("place") >= height * width)).select(F.lit("outside").alias("kind"), "page", "place")
    return outside.union(tokens.groupBy("page", "place").count().where("count > 1").select(F.lit("repeated"), "page", "place"))


def resize_weights(n: int, m: int) -> np.ndarray:
    """(m, n): what each of m cells takes of n by linear interpolation, cell centres at halves."""
    at = np.maximum((np.arange(m) + 0.5) * (n / m) - 0.5, 0.0)
    low = np.minimum(np.floor(at), n - 1).astype(int)
    out = np.zeros((m, n))
    np.add.at(out, (np.arange(m), low), 1 - (at - low))
    np.add.at(out, (np.arange(m), np.minimum(low + 1, n - 1)), at - low)
    return out


def smooth_weights(n: int, sigma: float, truncate: float = 3.0) -> np.ndarray:
    """(n, n): a Gaussian along an axis, border cells repeated."""
    taps = np.arange(-(radius := max(1, math.ceil(truncate * sigma))), radius + 1)
    w = np.exp(-(taps * taps) / (2 * sigma * sigma))
    out = np.zeros((n, n))
    np.add.at(out, (np.repeat(np.arange(n), len(taps)), np.clip(np.arange(n)[:, None] + taps, 0, n - 1).ravel()), np.tile(w / w.sum(), n))
    return out


def nearest_cells(n: int, m: int) -> np.ndarray:
    return np.floor(np.arange(m) * (n / m)).astype(int)


def _summed(w: np.ndarray, v: np.ndarray) -> np.ndarray:
    """``w @ v`` over the values that are there: NaN where no cell with a weight has one; infinite ones stay so."""
    there, endless = ~np.isnan(v), np.isinf(v)
    out = w @ np.where(there & ~endless, v, 0.0)
    if endless.any():
        for sign in (np.inf, -np.inf):
            out = np.where((w > 0).astype(float) @ (v == sign) > 0, out + sign, out)
    return np.where((w > 0).astype(float) @ there > 0, out, np.nan)


def _paged(raster: DataFrame, shape: tuple[int, int], step: Callable[[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]) -> DataFrame:
    """(page, y, x, v) after ``step``, which makes of a page's values (NaN: none) and of whether its cells are there new ones."""
    kind = raster.schema["page"].dataType.simpleString()

    def run(rows: pa.Table) -> pa.Table:
        v, there = np.full(shape, np.nan), np.zeros(shape, bool)
        at = rows.column("y").to_numpy(), rows.column("x").to_numpy()
        v[at], there[at] = rows.column("v").cast(pa.float64()).to_numpy(), True
        out, kept = step(v, there)
        y, x = np.nonzero(kept)
        page = rows.column("page").slice(0, 1).combine_chunks().take(pa.array(np.zeros(len(y), np.int64)))
        values = out[y, x]
        return pa.table({"page": page, "y": pa.array(y, pa.int32()), "x": pa.array(x, pa.int32()), "v": pa.array(values, pa.float64(), mask=np.isnan(values))})

    return raster.select("page", F.col("y").cast("int").alias("y"), F.col("x").cast("int").alias("x"), F.col("v").cast("double").alias("v")).groupBy("page").applyInArrow(run, f"page {kind}, y int, x int, v double")


def resized(raster: DataFrame, source: tuple[int, int], target: tuple[int, int]) -> DataFrame:
    """Bilinear resize with pixel centres at halves, over the values that are there; a cell none of whose neighbours is a row is no row."""
    y, x = (resize_weights(n, m) for n, m in zip(source, target, strict=True))

    def step(v: np.ndarray, there: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        near = (y > 0).astype(float) @ there @ (x > 0).astype(float).T > 0
        endless = np.isinf(v)
        value = y @ np.where(np.isnan(v) | endless, 0.0, v) @ x.T
        for sign in (np.inf, -np.inf):
            value = np.where((y > 0).astype(float) @ (v == sign) @ (x > 0).astype(float).T > 0, value + sign, value)
        some = (y > 0).astype(float) @ ~np.isnan(v) @ (x > 0).astype(float).T > 0
        return np.where(some, value, np.nan), near

    return _paged(raster, source, step)


def nearest(raster: DataFrame, source: tuple[int, int], target: tuple[int, int]) -> DataFrame:
    """Resize by the nearest lower cell."""
    at = lambda name, n, m: F.floor(F.col(name) * (n / m)).cast("int")
    wanted = grid(raster, *target).withColumn("y0", at("y", source[0], target[0])).withColumn("x0", at("x", source[1], target[1]))
    return wanted.join(raster.select("page", F.col("y").alias("y0"), F.col("x").alias("x0"), "v"), ["page", "y0", "x0"]).select("page", "y", "x", "v")


def smoothed(raster: DataFrame, height: int, width: int, sigma: float, truncate: float = 3.0) -> DataFrame:
    """Gaussian smoothing with repeated borders, one axis after the other, as the kernel is a product; over the values that are there, for the cells that are rows."""
    y, x = (smooth_weights(n, sigma, truncate) for n in (height, width))

    def step(v: np.ndarray, there: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        first = np.where(there, _summed(y, v), np.nan)
        return _summed(x, first.T).T, there

    return _paged(raster, (height, width), step)


def backgrounds(pixels: DataFrame, patch: int, tolerance: float) -> DataFrame:
    """(page, y, x, v): by patch, the share of pixels within ``tolerance`` (strictly) of the page's commonest gray, the least of equals.

    ``pixels`` has (page, y, x, gray); counts by gray are added up before the mode is taken.
    """
    counts = pixels.groupBy("page", "gray").agg(F.count("*").alias("n"))
    modes = counts.groupBy("page").agg(F.max_by("gray", F.struct("n", -F.col("gray"))).alias("mode"))
    j = pixels.join(modes, "page")
    return j.groupBy("page", F.floor(F.col("y") / patch).cast("int").alias("y"), F.floor(F.col("x") / patch).cast("int").alias("x")).agg(F.avg((F.abs(F.col("gray") - F.col("mode")) < tolerance).cast("double")).alias("v"))


def group_keep(cells: DataFrame, keep: Column, retention: str, mean_keep: Column | None = None, merge: int = 2) -> DataFrame:
    """(page, gy, gx, keep): a decision for each square of ``merge`` x ``merge`` cells: any, all, or the mean's."""
    groups = cells.groupBy("page", F.floor(F.col("y") / merge).cast("int").alias("gy"), F.floor(F.col("x") / merge).cast("int").alias("gx"))
    if retention == "mean":
        return groups.agg(F.avg("v").alias("v")).select("page", "gy", "gx", mean_keep.alias("keep"))
    if retention not in ("any", "all"):
        raise ValueError("retention must be any, all or mean")
    return groups.agg((F.bool_or if retention == "any" else F.bool_and)(keep).alias("keep"))


def relevant_groups(tokens: DataFrame, source: tuple[int, int], target: tuple[int, int], threshold: float, sigma: float, retention: str = "any", merge: int = 2) -> DataFrame:
    """(page, gy, gx, keep): scatter, resize, smooth and threshold relevance; a group also needs that all its cells had a token nearest to them.

    The whole chain is one pass over a page's tokens (page, place, v); tokens without a place on the raster are
    passed over, without a value count as 0.
    """
    if retention not in ("any", "all", "mean"):
        raise ValueError("retention must be any, all or mean")
    kind = tokens.schema["page"].dataType.simpleString()
    spread = [smooth_weights(m, sigma) @ resize_weights(n, m) for n, m in zip(source, target, strict=True)]
    near = np.ix_(*[nearest_cells(n, m) for n, m in zip(source, target, strict=True)])
    edges = [np.arange(0, m, merge) for m in target]
    over = lambda f, a: f.reduceat(f.reduceat(a, edges[0], axis=0), edges[1], axis=1)

    def run(rows: pa.Table) -> pa.Table:
        place, v = rows.column("place").to_numpy(), rows.column("v").to_numpy()
        inside = (place >= 0) & (place < source[0] * source[1])
        dense, there = np.zeros(source[0] * source[1]), np.zeros(source[0] * source[1], bool)
        dense[place[inside]], there[place[inside]] = np.nan_to_num(v[inside], nan=0.0), ~np.isnan(v[inside])
        smooth = spread[0] @ dense.reshape(source) @ spread[1].T
        valid = over(np.logical_and, there.reshape(source)[near])
        if retention == "mean":
            keep = over(np.add, smooth) / over(np.add, np.ones(target)) >= threshold
        else:
            keep = over(np.logical_or if retention == "any" else np.logical_and, smooth >= threshold)
        y, x = np.indices(keep.shape)
        page = rows.column("page").slice(0, 1).combine_chunks().take(pa.array(np.zeros(keep.size, np.int64)))
        return pa.table({"page": page, "gy": pa.array(y.ravel(), pa.int32()), "gx": pa.array(x.ravel(), pa.int32()), "keep": pa.array((keep & valid).ravel())})

    rows = tokens.select("page", F.col("place").cast("long").alias("place"), F.col("v").cast("double").alias("v")).where("place is not null")
    return rows.groupBy("page").applyInArrow(run, f"page {kind}, gy int, gx int, keep boolean")


def kept_pages(background: DataFrame, relevant: DataFrame) -> DataFrame:
    """(page, gy, gx, background, relevant, keep): both decisions of a page's groups and what both keep."""
    j = background.withColumnRenamed("keep", "background").join(relevant.withColumnRenamed("keep", "relevant"), ["page", "gy", "gx"])
    return j.withColumn("keep", F.col("background") & F.col("relevant"))


def geometry(groups: DataFrame) -> DataFrame:
    """Kept groups with their place among all kept ones of the page, in raster order, and their index in the full raster."""
    w = Window.partitionBy("page").orderBy("gy", "gx")
    numbered = groups.withColumn("full", F.row_number().over(w) - 1)
    return numbered.where("keep").withColumn("place", F.row_number().over(w) - 1).select("page", "gy", "gx", "full", "place")


def offsets(grids: DataFrame, merge: int = 2) -> DataFrame:
    """(page, fine, groups, fine_offset, group_offset) of pages in order, from (page, height, width)."""
    sized = grids.select("page", (F.col("height") * F.col("width")).cast("long").alias("fine"), (F.ceil(F.col("height") / merge) * F.ceil(F.col("width") / merge)).cast("long").alias("groups"))
    return summed_before(sized, ["page"], {"fine": "fine_offset", "groups": "group_offset"})


def attention(heads: DataFrame, key: list[str], literal: bool) -> DataFrame:
    """Attention of each token over heads: softmax of the mean logit, or (literal) the mean of the heads' softmaxes, times the number of tokens.

    ``heads`` has (group key..., token, head, logit).
    """
    if literal:
        w = Window.partitionBy(*key, "head")
        shares = heads.withColumn("_e", F.exp(F.col("logit") - F.max("logit").over(w)))
        out = shares.withColumn("_p", F.col("_e") / F.sum("_e").over(w)).groupBy(*key, "token").agg(F.avg("_p").alias("_p"))
    else:
        w = Window.partitionBy(*key)
        means = heads.groupBy(*key, "token").agg(F.avg("logit").alias("_m")).withColumn("_e", F.exp(F.col("_m") - F.max("_m").over(w)))
        out = means.select(*key, "token", (F.col("_e") / F.sum("_e").over(w)).alias("_p"))
    return out.select(*key, "token", (F.col("_p") * F.count("*").over(Window.partitionBy(*key))).alias("score"))
