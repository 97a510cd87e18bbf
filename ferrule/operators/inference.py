"""Pair mining, paired summaries, Monte-Carlo errors and hash-drawn bootstraps.

Bootstraps draw n of n units, by ``resampling``: a pass of weighted sums, without
a join of draws and rows.
"""

from __future__ import annotations

import math

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ferrule.operators import resampling


def preference(a: Column, b: Column, threshold: float, margin: float, closed: bool) -> Column:
    """1, -1 or 0: which of two scores is preferred; one inside the band about the threshold decides nothing.

    The band is open (difference < margin) or, with ``closed``, <= margin.
    """

    def banded(x: Column) -> Column:
        gap = F.abs(x - threshold)
        return (gap <= margin) if closed else (gap < margin)

    pa, pb = a >= threshold, b >= threshold
    return F.when(pa == pb, 0).when(banded(a) | banded(b), 0).when(pa, 1).otherwise(-1)


def direction(delta: Column, margin: float) -> Column:
    return F.when(delta > margin, 1).when(delta < -margin, -1).otherwise(0)


def supervised_preference(a: tuple[Column, Column], b: tuple[Column, Column], reference_g: Column, baseline_correct: Column, mode: str, tolerance: float, margin: float, preserve: str = "g") -> Column:
    """Which of two outcomes (G, S) is preferred, by mode: "g_only", "pure_contrast" or "gold_aware".

    Where the baseline is correct, G decides, or S if S is what is to be
    preserved. Gold-aware: an admissible outcome beats one that isn't, unless one of
    them is within the closed band about the threshold; two admissible ones are
    compared by G - S, others by G.
    """
    if mode not in ("g_only", "pure_contrast", "gold_aware") or preserve not in ("g", "s"):
        raise ValueError("unknown mode or channel")
    by_g, contrast = direction(a[0] - b[0], margin), direction((a[0] - a[1]) - (b[0] - b[1]), margin)
    bar = reference_g - tolerance
    ok_a, ok_b = a[0] >= bar, b[0] >= bar
    near = F.least(F.abs(a[0] - bar), F.abs(b[0] - bar)) <= margin
    aware = F.when((ok_a != ok_b) & near, 0).when(ok_a & ~ok_b, 1).when(ok_b & ~ok_a, -1).when(ok_a, contrast).otherwise(by_g)
    wrong = {"g_only": by_g, "pure_contrast": contrast, "gold_aware": aware}[mode]
    kept = by_g if preserve == "g" else direction(a[1] - b[1], margin)
    return F.when(baseline_correct, kept).otherwise(wrong)


def pairs_in_group(df: DataFrame, group: str, item: str, value: str) -> DataFrame:
    """Unordered pairs (i > j) within groups; for groups bounded by the data model, as the masks of one question."""
    a, b = (df.select(F.col(group).alias("g"), F.col(item).alias(f"{s}_item"), F.col(value).alias(f"{s}_value")) for s in "ij")
    return a.join(b, "g").where(F.col("i_item") > F.col("j_item"))


def outcome_summary(df: DataFrame, by: list[str], before: Column, after: Column) -> DataFrame:
    """Counts, accuracies, net change, rescue and damage rates (null without a denominator)."""
    b, a = before.cast("int"), after.cast("int")
    return df.groupBy(*by).agg(
        F.count("*").alias("n"), F.avg(b).alias("before"), F.avg(a).alias("after"), F.sum(a - b).alias("net"),
        F.avg(F.when(~before, a)).alias("rescue_rate"), F.avg(F.when(before, 1 - a)).alias("damage_rate"),
    )


def contrast(df: DataFrame, by: list[str], first: str, second: str) -> DataFrame:
    """Means of two arms with wins, ties and losses of the second, and rescues and harms at 0."""
    x, y = F.col(first), F.col(second)
    return df.groupBy(*by).agg(
        F.count("*").alias("n"), F.avg(x).alias("mean_first"), F.avg(y).alias("mean_second"), F.count_if(y > x).alias("wins"), F.count_if(y == x).alias("ties"),
        F.count_if(y < x).alias("losses"), F.count_if((x == 0) & (y > 0)).alias("rescues"), F.count_if((x > 0) & (y == 0)).alias("harms"),
    )


def recombined(strata: DataFrame, weights: DataFrame, stratum: str, value: str, weight: str) -> DataFrame:
    """Means of strata put together by given weights."""
    j = strata.join(F.broadcast(weights.select(stratum, weight)), stratum)
    return j.agg((F.sum(F.col(value) * F.col(weight)) / F.sum(weight)).alias("value"))


def mcse(df: DataFrame, unit: list[str], value: str) -> DataFrame:
    """sqrt(sum of the units' sample variances by their counts) by the number of units."""
    per = df.groupBy(*unit).agg((F.var_samp(value) / F.count(value)).alias("v"))
    return per.agg((F.sqrt(F.sum("v")) / F.count("*")).alias("mcse"), F.count("*").alias("n"))


def repetitions(mcse_value: Column, threshold: float = 0.25) -> Column:
    """20 repetitions if the error is above the threshold, 10 if not."""
    return F.when(mcse_value > threshold, 20).otherwise(10)


def estimand(df: DataFrame, unit: str, value: str, repeated: str) -> DataFrame:
    """Mean over units of the value less the mean of its repetitions (an array)."""
    mean = F.aggregate(repeated, F.lit(0.0), lambda s, x: s + x) / F.size(repeated)
    return df.agg(F.avg(F.col(value) - mean).alias("estimand"), F.count(unit).alias("units"))


def bootstrap(df: DataFrame, unit: Column, value: Column, draws: int, seed: str, size: Column | None = None) -> DataFrame:
    """(draw, estimate): means over n units drawn from n, or of as many clusters with their value sums and sizes."""
    rows = df.select(unit.alias("_u"), value.cast("double").alias("_v"), (size if size is not None else F.lit(1)).cast("long").alias("_n"))
    sums = resampling.resampled(rows, ["_u", "_v", "_n"], ["_v", "_n"], draws, seed)
    return sums.select("draw", F.try_divide("_v", "_n").alias("estimate"))


def interval(draws: DataFrame, low: float, high: float) -> DataFrame:
    """Linear quantiles of the draws."""
    q = lambda p: F.percentile("estimate", F.lit(p))
    return draws.agg(F.count("estimate").alias("draws"), q(low).alias("low"), q(high).alias("high"))


def paired_bootstrap(df: DataFrame, unit: str, delta: str, draws: int, seed: str) -> DataFrame:
    """(draws, low, high, lower): the 95 % interval of the mean of paired deltas, and its one-sided bound."""
    q = lambda p: F.percentile("estimate", F.lit(p))
    b = bootstrap(df, F.col(unit), F.col(delta), draws, seed)
    return b.agg(F.count("estimate").alias("draws"), q(0.025).alias("low"), q(0.975).alias("high"), q(0.05).alias("lower"))


def clustered(df: DataFrame, cluster: str, value: str) -> DataFrame:
    """(cluster, total, size): what a bootstrap of clusters draws from."""
    return df.groupBy(cluster).agg(F.sum(value).alias("total"), F.count(value).alias("size"))


def nested_bootstrap(df: DataFrame, unit: str, cluster: str, value: str, repeated: str, draws: int, seed: str) -> DataFrame:
    """(draw, estimate): clusters are drawn, n of n, and within each unit its repetitions, all of all; a unit without repetitions isn't there."""
    rows = df.select(F.col(unit).alias("_u"), F.col(cluster).alias("_c"), F.col(value).cast("double").alias("_v"), F.col(repeated).cast("array<double>").alias("_r"))
    drawn = resampling.own_means(rows, "_u", "_r", draws, f"{seed}|inner").where("means is not null and _v is not null")
    each = drawn.select("_c", F.posexplode(F.transform("means", lambda m: F.col("_v") - m)).alias("_d", "_x")).groupBy("_c", "_d").agg(F.sum("_x").alias("_x"), F.count("*").alias("_k"))
    clusters = each.groupBy("_c").agg(F.transform(F.array_sort(F.collect_list(F.struct("_d", "_x"))), lambda p: p["_x"]).alias("_x"), F.max("_k").alias("_k"))
    sums = resampling.resampled(clusters, ["_c"], ["_x", "_k"], draws, f"{seed}|outer")
    return sums.select("draw", F.try_divide("_x", "_k").alias("estimate"))


def stratified_bootstrap(df: DataFrame, unit: str, stratum: str, value: str, weights: dict[str, float], draws: int, seed: str) -> DataFrame:
    """(draw, estimate): means of strata, n of n drawn within each, put together by weights."""
    share = F.create_map(*[F.lit(x) for pair in weights.items() for x in pair])
    rows = df.select(F.col(stratum).alias("_s"), F.col(unit).alias("_u"), F.col(value).cast("double").alias("_v"), F.lit(1).cast("long").alias("_n"))
    sums = resampling.resampled(rows, ["_u", "_v"], ["_v", "_n"], draws, seed, stratum="_s")
    means = sums.select("draw", (F.col("_v") / F.col("_n")).alias("_m"), share[F.col("_s")].alias("_w"))
    return means.groupBy("draw").agg((F.sum(F.col("_m") * F.col("_w")) / F.sum("_w")).alias("estimate"))


def simultaneous_bounds(df: DataFrame, cluster: str, boundaries: list[str], draws: int, seed: str, level: float = 0.95) -> DataFrame:
    """(boundary, place, estimate, lower): lower bounds that hold together, by the greatest excess of each draw of clusters."""
    per = df.groupBy(cluster).agg(F.count("*").alias("_n"), *[F.sum(b).cast("double").alias(b) for b in boundaries])
    points = per.agg(*[(F.sum(b) / F.sum("_n")).alias(f"p_{b}") for b in boundaries])
    drawn = resampling.resampled(per, [cluster], ["_n", *boundaries], draws, seed).select("draw", *[F.try_divide(F.col(b), F.col("_n")).alias(b) for b in boundaries])
    excess = drawn.join(F.broadcast(points)).select(F.greatest(*[F.col(b) - F.col(f"p_{b}") for b in boundaries]).alias("excess"))
    critical = excess.agg(F.percentile("excess", F.lit(level)).alias("critical"))
    rows = F.explode(F.array(*[F.struct(F.lit(b).alias("boundary"), F.lit(i).alias("place"), F.col(f"p_{b}").alias("estimate")) for i, b in enumerate(boundaries)])).alias("x")
    return points.join(F.broadcast(critical)).select("critical", rows).select("x.*", (F.col("x.estimate") - F.col("critical")).alias("lower"))


def pair_families(distance: Column) -> Column:
    """The family of a pair by Hamming distance: one, two or more."""
    return F.when(distance == 1, "one").when(distance == 2, "two").otherwise("more")


def balanced(df: DataFrame, levels: list[list[str]], value: str, name: str = "value") -> DataFrame:
    """Means of means: over rows within the first level's groups, then within each coarser level, and at last over all."""
    out = df
    for by in levels:
        out = out.groupBy(*by).agg(F.avg(value).alias(value))
    return out.agg(F.avg(value).alias(name), F.count(value).alias("groups"))


def rmse(df: DataFrame, by: list[str], predicted: str, actual: str) -> DataFrame:
    """Root mean square errors of the prediction and of the constant mean, by group."""
    mean = F.avg(actual).over(Window.partitionBy(*by))
    rows = df.select(*by, (F.col(predicted) - F.col(actual)).alias("_e"), (mean - F.col(actual)).alias("_c"))
    return rows.groupBy(*by).agg(F.sqrt(F.avg(F.col("_e") * F.col("_e"))).alias("rmse"), F.sqrt(F.avg(F.col("_c") * F.col("_c"))).alias("constant_rmse"))


def equivalence_size(spread: float, margin: float, true_difference: float = 0.0, alpha: float = 0.05, power: float = 0.8, most: int = 1_000_000) -> int | None:
    """The least number of units at which two one-sided tests have the power, by the normal approximation; None beyond ``most``."""
    from statistics import NormalDist

    normal = NormalDist()
    z = normal.inv_cdf(1 - alpha)

    def reached(n: int) -> bool:
        error = spread / math.sqrt(n)
        return normal.cdf((margin - true_difference) / error - z) + normal.cdf((margin + true_difference) / error - z) - 1 >= power

    low, high = 1, 1
    while high < most and not reached(high):
        low, high = high, min(most, 2 * high)
    if not reached(high):
        return None
    while low < high:
        middle = (low + high) // 2
        low, high = (low, middle) if reached(middle) else (middle + 1, high)
    return high


def equivalence_sizes(spread: Column, margin: float, true_difference: float = 0.0, alpha: float = 0.05, power: float = 0.8, most: int = 1_000_000) -> Column:
    """``equivalence_size`` of each row's spread; null for a null or zero spread."""

    def sizes(spreads: pa.Array) -> pa.Array:
        return pa.array([equivalence_size(s, margin, true_difference, alpha, power, most) if s else None for s in spreads.to_pylist()], pa.int64())

    return F.arrow_udf(sizes, "long")(spread)
