"""Top-k, ranks, shards, prefixes and multiplicity by window functions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ferrule.operators.settle import dealt


def top_m(df: DataFrame, group: list[str], score: str, tie: list[str], m: int) -> DataFrame:
    """The m best rows of each group by (-score, tie); adds ``page_rank`` from 0."""
    w = Window.partitionBy(*group).orderBy(F.desc(score), *tie)
    return df.withColumn("page_rank", F.row_number().over(w) - 1).where(F.col("page_rank") < m)


def average_rank(value: Column | str, group: list[str], start: int = 1) -> Column:
    """Rank within the group, ties sharing their mean rank."""
    least = F.rank().over(Window.partitionBy(*group).orderBy(value))
    ties = F.count("*").over(Window.partitionBy(*group, value))
    return least + (ties - 1) / 2 - (1 - start)


def spearman(df: DataFrame, group: list[str], x: str, y: str) -> DataFrame:
    """Rank correlation by group, ties averaged; null without variance, within [-1, 1]."""
    r = dealt(df.select(*dict.fromkeys([*group, x, y])), *group).withColumn("_x", average_rank(x, group)).withColumn("_y", average_rank(y, group))
    out = r.groupBy(*group).agg(F.corr("_x", "_y").alias("rho"), F.stddev_pop("_x").alias("_sx"), F.stddev_pop("_y").alias("_sy"))
    rho = F.when((F.col("_sx") > 0) & (F.col("_sy") > 0), F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.col("rho"))))
    return out.select(*group, rho.alias("rho"))


def hash_key(prefix: str, id_column: str) -> Column:
    """Sort key of the hash order: SHA-256 in hex of prefix and id."""
    return F.sha2(F.concat(F.lit(prefix), F.col(id_column).cast("string")), 256)


def hash_sample(df: DataFrame, strata: list[str], id_column: str, n: int, prefix: str) -> DataFrame:
    """The first n rows of each stratum in hash order, with their place."""
    w = Window.partitionBy(*strata).orderBy(hash_key(prefix, id_column), id_column)
    return df.withColumn("place", F.row_number().over(w)).where(F.col("place") <= n)


def largest_remainder(counts: DataFrame, name: str, weight: str, seats: int) -> DataFrame:
    """Seats by weight: floors first, the rest to the largest remainders (ties by name). For tables of strata."""
    total = Window.partitionBy(F.lit(0))
    exact = counts.withColumn("_q", F.lit(seats) * F.col(weight) / F.sum(weight).over(total)).withColumn("_f", F.floor("_q"))
    rest = F.lit(seats) - F.sum("_f").over(total)
    order = F.row_number().over(total.orderBy(F.desc(F.round(F.col("_q") - F.col("_f"), 9)), name))
    return exact.withColumn("seats", F.col("_f") + (order <= rest).cast("long")).drop("_q", "_f")


def holm(df: DataFrame, group: list[str], p: str, label: str) -> DataFrame:
    """Adds ``adjusted``: step-down p-values, the running maximum of min(1, (m - rank) p)."""
    w = Window.partitionBy(*group).orderBy(p, label)
    step = F.least(F.lit(1.0), (F.count("*").over(Window.partitionBy(*group)) - F.row_number().over(w) + 1) * F.col(p))
    return df.withColumn("_s", step).withColumn("adjusted", F.max("_s").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_s")


def runs(df: DataFrame, group: list[str], order: str, key: str) -> DataFrame:
    """Contiguous runs of equal keys: (group, run, key, start, end, n)."""
    w = Window.partitionBy(*group).orderBy(order)
    new = F.coalesce((F.lag(key).over(w) != F.col(key)).cast("int"), F.lit(1))
    numbered = df.withColumn("_new", new).withColumn("run", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return numbered.groupBy(*group, "run", key).agg(F.min(order).alias("start"), F.max(order).alias("end"), F.count("*").alias("n"))


def greedy_prefix(items: Column, budget: Column | int) -> Column:
    """Ids taken from structs (id, cost) in order: an item that still fits is taken, one that doesn't is passed over."""
    start = F.struct(F.lit(0).cast("long").alias("used"), F.array().cast("array<bigint>").alias("ids"))

    def step(acc: Column, x: Column) -> Column:
        fits = acc["used"] + x["cost"] <= budget
        return F.struct(F.when(fits, acc["used"] + x["cost"]).otherwise(acc["used"]).alias("used"), F.when(fits, F.concat(acc["ids"], F.array(x["id"]))).otherwise(acc["ids"]).alias("ids"))

    return F.aggregate(items, start, step)["ids"]
