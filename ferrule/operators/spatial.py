"""Rectangle overlaps by page and cells of a hierarchy of grids, and ownership of tokens by regions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ferrule.functions.numbers import grid_cell

#: Tasks that the tokens of one class are dealt to.
SHARES = 16


def level(p: str, cell: float) -> Column:
    """The least level whose cells, of side cell * 2^level, are as long as the box is: it lies in two of them at most, either way."""
    longest = F.greatest(F.col(f"{p}x1") - F.col(f"{p}x0"), F.col(f"{p}y1") - F.col(f"{p}y0"))
    return F.greatest(F.lit(0), F.ceil(F.log2(F.greatest(longest / cell, F.lit(1.0))))).cast("int")


def in_cells(df: DataFrame, p: str, cell: float, at: str) -> DataFrame:
    """Each box in its cells (cx, cy) of the grid of level ``at``."""
    side = F.lit(float(cell)) * F.pow(F.lit(2.0), F.col(at))
    span = lambda x: F.sequence(F.floor(F.col(f"{p}{x}0") / side), F.floor(F.col(f"{p}{x}1") / side))
    return df.withColumn("cx", F.explode(span("x"))).withColumn("cy", F.explode(span("y")))


def overlap_join(tokens: DataFrame, regions: DataFrame, cell: float = 16) -> DataFrame:
    """Pairs on one page with a positive intersection area.

    Boxes (x0, y0, x1, y1; tokens' columns start with t, regions' with r) lie in a
    hierarchy of grids, each on the level of its own size, in at most four
    cells. A pair meets on the level of the larger box, where the smaller one is looked up, and is made in the cell
    of its intersection's corner only. Boxes with a null corner meet nothing.
    """
    x0, y0 = F.greatest("tx0", "rx0"), F.greatest("ty0", "ry0")
    w, h = F.least("tx1", "rx1") - x0, F.least("ty1", "ry1") - y0
    side = F.lit(float(cell)) * F.pow(F.lit(2.0), F.col("_level"))
    corner = (F.col("cx") == F.floor(x0 / side)) & (F.col("cy") == F.floor(y0 / side))

    def leveled(df: DataFrame, p: str) -> DataFrame:
        return df.where(" and ".join(f"{p}{c} is not null" for c in ("x0", "y0", "x1", "y1"))).withColumn("_own", level(p, cell))

    t, r = leveled(tokens, "t"), leveled(regions, "r")

    def met(small: DataFrame, p: str, large: DataFrame, q: str, strictly: bool) -> DataFrame:
        # The levels of the larger side are one row, a few dozen numbers at most.
        there = F.broadcast(large.agg(F.collect_set("_own").alias("_levels")))
        up = F.filter("_levels", lambda x: (x > F.col("_own")) if strictly else (x >= F.col("_own")))
        probes = small.crossJoin(there).withColumn("_level", F.explode(up)).drop("_own", "_levels")
        least = F.broadcast(small.agg(F.min("_own").alias("_least")))
        held = large.crossJoin(least).where((F.col("_own") > F.col("_least")) if strictly else F.col("_own") >= F.col("_least")).drop("_least").withColumnRenamed("_own", "_level")
        return in_cells(probes, p, cell, "_level").join(in_cells(held, q, cell, "_level"), ["page", "_level", "cx", "cy"])

    pairs = met(t, "t", r, "r", False).unionByName(met(r, "r", t, "t", True))
    return pairs.where((w > 0) & (h > 0) & corner).withColumn("area", w * h).drop("cx", "cy", "_level")


def boxes(p: str) -> list[str]:
    return ["page", *(f"{p}{c}" for c in ("x0", "y0", "x1", "y1"))]


def met_boxes(tokens: DataFrame, regions: DataFrame, cell: float = 16) -> DataFrame:
    """(page, t..., r..., area): ``overlap_join`` of the distinct boxes, whatever number of tokens and regions has each."""
    return overlap_join(tokens.select(*boxes("t")).distinct(), regions.select(*boxes("r")).distinct(), cell)


def expanded(pairs: DataFrame, tokens: DataFrame, regions: DataFrame, of_tokens: list[str], of_regions: list[str]) -> DataFrame:
    """Pairs of classes (of boxes, say) as pairs of their tokens and regions. A class's tokens are dealt to SHARES tasks, so that none makes all its pairs."""
    t = tokens.join(pairs, of_tokens).withColumn("_share", F.pmod(F.xxhash64(*tokens.columns), F.lit(SHARES)))
    r = regions.withColumn("_share", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SHARES - 1).cast("long"))))
    # A number of partitions that is asked for stays: the few bytes before the join would be put together in one task.
    keys, parts = [*of_regions, "_share"], max(SHARES, int(tokens.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return t.repartition(parts, *keys).join(r.repartition(parts, *keys), keys).drop("_share")


def owners(tokens: DataFrame, regions: DataFrame, token: str = "token", order: list[str] | None = None, cell: float = 16) -> DataFrame:
    """(page, token, region, area): each token's region of largest overlap, ties by ``order``; null where none overlaps.

    Of regions with one box only the first by ``order`` can own, and tokens with
    one box have one owner: it is found for the distinct boxes.
    """
    order, t_box, r_box = order or ["region"], boxes("t"), boxes("r")
    first = regions.groupBy(*r_box).agg(F.min(F.struct(*[F.col(c).alias(f"_{k}") for k, c in enumerate([*order, "region"])])).alias("_first"))
    rank = lambda *keys: F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("area"), "_first"))
    by_box = met_boxes(tokens, regions, cell).join(first, r_box).withColumn("_n", rank(*t_box)).where("_n = 1").select(*t_box, "area", "_first")
    best = tokens.select(token, *t_box).join(by_box, t_box).withColumn("_n", rank("page", token)).where("_n = 1")
    return tokens.select("page", token).join(best.select("page", token, F.col("_first")[f"_{len(order)}"].alias("region"), "area"), ["page", token], "left")


def owners_or_tiles(tokens: DataFrame, regions: DataFrame, height: Column, width: Column, order: list[str] | None = None) -> DataFrame:
    """(page, token, source): the owner as "region:id", or, where none overlaps, the residual tile of a 4 x 4 page grid as "tile:row,column"."""
    found = owners(tokens, regions, order=order).join(tokens.select("page", "token", "tx0", "ty0", "tx1", "ty1"), ["page", "token"])
    middle = lambda a, b: (F.col(a) + F.col(b)) / 2 - 0.5
    tile = F.concat(F.lit("tile:"), grid_cell(middle("ty0", "ty1"), height).cast("string"), F.lit(","), grid_cell(middle("tx0", "tx1"), width).cast("string"))
    return found.select("page", "token", F.when(F.col("region").isNotNull(), F.concat(F.lit("region:"), F.col("region").cast("string"))).otherwise(tile).alias("source"))


def first_owners(tokens: DataFrame, regions: DataFrame, priority: str, most: int) -> DataFrame:
    """(page, token, owner): the overlapping region of the least priority; tokens without one are dealt to buckets of ``most`` in order of token, from -1 downwards."""
    t_box, r_box = boxes("t"), boxes("r")
    by_box = met_boxes(tokens, regions).join(regions.groupBy(*r_box).agg(F.min(priority).alias("_p")), r_box).groupBy(*t_box).agg(F.min("_p").alias("_p"))
    first = tokens.select("token", *t_box).join(by_box, t_box).groupBy("page", "token").agg(F.min("_p").alias("_p"))
    j = tokens.select("page", "token").join(first, ["page", "token"], "left")
    place = F.row_number().over(Window.partitionBy("page", F.col("_p").isNull()).orderBy("token")) - 1
    return j.withColumn("_n", place).select("page", "token", F.coalesce(F.col("_p"), -1 - F.floor(F.col("_n") / most)).cast("long").alias("owner"))


def mapped_grid(fine: DataFrame, coarse: DataFrame, cell: float = 16) -> DataFrame:
    """(page, token, owner, area): the owner of a new grid's cells by the summed overlap with the old grid's cells of each owner; ties by owner.

    ``fine`` has the new cells (t...), ``coarse`` the old ones (r...) with their ``owner``.
    """
    sums = overlap_join(fine, coarse, cell).groupBy("page", "token", "owner").agg(F.sum("area").alias("area"))
    w = Window.partitionBy("page", "token").orderBy(F.desc("area"), "owner")
    return sums.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def lost_owners(mapped: DataFrame, coarse: DataFrame) -> DataFrame:
    """Owners that have no cell after a re-mapping, as violation rows."""
    return coarse.select("page", "owner").distinct().join(mapped.select("page", "owner").distinct(), ["page", "owner"], "left_anti")


def owned_fractions(tokens: DataFrame, regions: DataFrame, cell: float = 16, digits: int | None = None) -> DataFrame:
    """(page, token, region, fraction): the share of each token's box that each region covers, rounded to ``digits`` if given.

    Shares are added up for the distinct sets of boxes of a token and of a region, then expanded; the pairs are as many as the result has rows.
    """

    def sets(df: DataFrame, key: str, p: str) -> DataFrame:
        corners = boxes(p)[1:]
        return df.dropna(subset=corners).groupBy("page", key).agg(F.sort_array(F.collect_list(F.struct(*corners))).alias(f"_{p}"))

    t, r = sets(tokens, "token", "t"), sets(regions, "region", "r")
    flat = lambda df, p: df.select("page", f"_{p}").distinct().select("page", f"_{p}", F.explode(f"_{p}").alias("_box")).select("page", f"_{p}", "_box.*")
    box = (F.col("tx1") - F.col("tx0")) * (F.col("ty1") - F.col("ty0"))
    pairs = overlap_join(flat(t, "t"), flat(r, "r"), cell).groupBy("page", "_t", "_r").agg(F.sum(F.col("area") / box).alias("fraction"))
    pairs = pairs if digits is None else pairs.withColumn("fraction", F.round("fraction", digits))
    return expanded(pairs, t, r, ["page", "_t"], ["page", "_r"]).select("page", "token", "region", "fraction")


def profiles(members: DataFrame, scores: DataFrame, regions: DataFrame) -> DataFrame:
    """(page, region, q, score, valid): each region's greatest score by query token over its patches; without any the score is null.

    ``members`` has (page, region, patch), ``scores`` (page, patch, q, s).
    """
    best = members.join(scores, ["page", "patch"]).groupBy("page", "region", "q").agg(F.max("s").alias("score"))
    queries = scores.select("page", "q").distinct()
    return regions.select("page", "region").distinct().join(queries, "page").join(best, ["page", "region", "q"], "left").withColumn("valid", F.col("score").isNotNull())


def similar_boxes(a: DataFrame, b: DataFrame, least: float = 0.85, cell: float = 16) -> DataFrame:
    """Pairs of boxes on one page whose intersection by union is above ``least``."""
    j = met_boxes(a, b, cell)
    size = lambda p: (F.col(f"{p}x1") - F.col(f"{p}x0")) * (F.col(f"{p}y1") - F.col(f"{p}y0"))
    like = j.withColumn("iou", F.col("area") / (size("t") + size("r") - F.col("area"))).where(F.col("iou") > least)
    return expanded(like, a, b, boxes("t"), boxes("r"))


def audit(owned: DataFrame, limit: int) -> DataFrame:
    """By page: tokens, share owned and share left over, the largest region, and how many regions exceed ``limit`` tokens."""
    sizes = owned.groupBy("page", "region").agg(F.count("*").alias("n"))
    own = F.col("region").isNotNull()
    return sizes.groupBy("page").agg(
        F.sum("n").alias("tokens"), (F.coalesce(F.sum(F.when(own, F.col("n"))), F.lit(0)) / F.sum("n")).alias("covered"), (F.coalesce(F.sum(F.when(~own, F.col("n"))), F.lit(0)) / F.sum("n")).alias("left_over"),
        F.coalesce(F.max(F.when(own, F.col("n"))), F.lit(0)).alias("largest"), F.count_if(own & (F.col("n") > limit)).alias("oversized"),
    )


def coverage(tokens: DataFrame, kept: Column, reference: Column) -> DataFrame:
    """By page: kept tokens, occupied cells of the 4 x 4 grid, centre, spread, and the Jaccard index with a reference selection (1 for two empty ones).

    ``tokens`` has (page, row, column, height, width); pages without kept tokens stay, without centre.
    """
    y, x = (F.col("row") + 0.5) / F.col("height"), (F.col("column") + 0.5) / F.col("width")
    cell = grid_cell(F.col("row"), F.col("height")) * 4 + grid_cell(F.col("column"), F.col("width"))
    of = lambda v: F.when(kept, v)
    sums = tokens.groupBy("page").agg(
        F.count_if(kept).alias("kept"), F.count_distinct(of(cell)).alias("cells"), F.avg(of(y)).alias("center_y"), F.avg(of(x)).alias("center_x"),
        F.var_pop(of(y)).alias("_vy"), F.var_pop(of(x)).alias("_vx"), F.count_if(kept & reference).alias("_both"), F.count_if(kept | reference).alias("_any"),
    )
    return sums.select("page", "kept", "cells", "center_y", "center_x", F.sqrt(F.col("_vy") + F.col("_vx")).alias("spread"), F.when(F.col("_any") == 0, 1.0).otherwise(F.try_divide(F.col("_both"), F.col("_any"))).alias("overlap"))
