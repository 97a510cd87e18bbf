"""Cohorts, shard plans and splits by hash order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ferrule.operators.ranking import hash_key, largest_remainder
from ferrule.operators.settle import numbered


def first_rows(df: DataFrame, order: list, n: int) -> DataFrame:
    """The first n rows of an order with their ``place`` from 1; only n rows of each task meet."""
    few = df.orderBy(*order).limit(n)
    return few.withColumn("place", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(*order)).cast("long"))


def shard_plan(df: DataFrame, key: str, stratum: str, order: list, checkpoint: int, size: int, label: str) -> DataFrame:
    """Every row with its place in the order of execution, its shard, and whether the shard belongs to the checkpoint.

    The checkpoint is allotted to the strata by largest remainders and chosen
    within them by the hash of (label, stratum, key); it comes first, in source
    order, then the rest in source order.
    """
    if checkpoint % size:
        raise ValueError("the checkpoint must be made of whole shards")
    counts = df.groupBy(stratum).agg(F.count("*").alias("_n"))
    seats = largest_remainder(counts, stratum, "_n", checkpoint).select(stratum, "seats")
    hashed = F.sha2(F.concat_ws("\x01", F.lit(label), F.col(stratum), F.col(key).cast("string")), 256)
    ranked = df.withColumn("_h", F.row_number().over(Window.partitionBy(stratum).orderBy(hashed, key))).join(F.broadcast(seats), stratum)
    chosen = ranked.withColumn("checkpoint_row", F.col("_h") <= F.col("seats")).drop("_h", "seats").withColumn("_late", (~F.col("checkpoint_row")).cast("int"))
    placed = numbered(chosen, "_late", *order).drop("_late").withColumn("shard", F.floor(F.col("place") / size))
    return placed.withColumn("checkpoint", F.col("shard") < checkpoint // size)


def one_each_first(df: DataFrame, key: str, component: str, n: int, prefix: str) -> DataFrame:
    """n rows in hash order, of which those that are first of their component come before others."""
    w = Window.partitionBy(component).orderBy(hash_key(prefix, key), key)
    ranked = df.withColumn("_late", (F.row_number().over(w) > 1).cast("int"))
    return first_rows(ranked, ["_late", hash_key(prefix, key), key], n).drop("_late")


def weighted(df: DataFrame, strata: list[str], key: str, n: int, prefix: str) -> DataFrame:
    """The first n rows of each stratum by hash, with the stratum's share of all rows as ``weight``."""
    w = Window.partitionBy(*strata).orderBy(hash_key(prefix, key), key)
    rows = df.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= n).drop("_n")
    shares = df.groupBy(*strata).agg(F.count("*").alias("_c")).join(F.broadcast(df.agg(F.count("*").alias("_t")))).select(*strata, (F.col("_c") / F.col("_t")).alias("weight"))
    return rows.join(F.broadcast(shares), strata)


def batches(df: DataFrame, key: str, size: int) -> DataFrame:
    """(key, task, first, size): the batch of an array of tasks that a numbered row is in, its place there, and the batch's size."""
    k, n = F.col(key), df.agg(F.count("*").alias("_n"))
    task = F.floor(k / size)
    return df.join(F.broadcast(n)).select(key, task.alias("task"), (k % size).alias("first"), F.least(F.lit(size).cast("long"), F.col("_n") - task * size).alias("size"))


def sealed(df: DataFrame, seen: DataFrame, key: str, component: str, n: int, prefix: str) -> DataFrame:
    """The first n rows by hash among those not seen. Fewer than n rows, or than two components, are an error."""
    free = df.join(seen.select(key).distinct(), key, "left_anti")
    out = first_rows(free, [hash_key(prefix, key), key], n)
    enough = out.agg(F.count("*").alias("_rows"), F.count_distinct(component).alias("_components"))
    bad = (F.col("_rows") < n) | (F.col("_components") < 2)
    return out.join(F.broadcast(enough)).withColumn("place", F.when(bad, F.raise_error(F.lit("too few rows or components for the holdout")).cast("long")).otherwise(F.col("place"))).drop("_rows", "_components")


def disjoint_splits(df: DataFrame, component: str, stratum: str, shares: dict[str, int], prefix: str) -> DataFrame:
    """(component, kind, n, split): whole components go to splits by shares of the rows, in hash order, within those of one stratum (pure) and of several (mixed)."""
    c = df.groupBy(component).agg(F.count("*").alias("n"), F.count_distinct(stratum).alias("_m")).withColumn("kind", F.when(F.col("_m") == 1, "pure").otherwise("mixed"))
    w = Window.partitionBy("kind").orderBy(hash_key(prefix, component), component)
    c = c.withColumn("_before", F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, 0)) - F.col("n")).withColumn("_all", F.sum("n").over(Window.partitionBy("kind")))
    whole, upto, split = sum(shares.values()), 0, None
    for name, share in list(shares.items())[:-1]:
        upto += share
        split = (F if split is None else split).when(F.col("_before") * whole < upto * F.col("_all"), name)
    last = list(shares)[-1]
    return c.select(component, "kind", "n", (F.lit(last) if split is None else split.otherwise(last)).alias("split"))


def quota_pool(df: DataFrame, key: str, kind: str, family: str, total: int, prefix: str) -> DataFrame:
    """(key, kind, family, pass): rows by largest-remainder quotas of kinds; first those that are the first of their family in hash order, then others to fill up."""
    seats = largest_remainder(df.groupBy(kind).agg(F.count("*").alias("_n")), kind, "_n", total).select(kind, "seats")
    h = hash_key(prefix, key)
    fresh = df.withColumn("pass", F.when(F.row_number().over(Window.partitionBy(family).orderBy(h, key)) == 1, 1).otherwise(2))
    ranked = fresh.withColumn("_n", F.row_number().over(Window.partitionBy(kind).orderBy("pass", h, key)))
    return ranked.join(F.broadcast(seats), kind).where(F.col("_n") <= F.col("seats")).select(key, kind, family, "pass")


def balanced_split(df: DataFrame, key: str, strata: list[str], contexts: str, text: str, each: int, prefix: str) -> DataFrame:
    """(key, strata): ``each`` rows of every stratum, the fewest contexts first and then by hash, no normalised text twice."""
    h: list[Column | str] = [contexts, hash_key(prefix, key), key]
    plain = F.lower(F.trim(F.regexp_replace(text, r"(?U)\s+", " ")))
    distinct = df.withColumn("_t", plain).withColumn("_d", F.row_number().over(Window.partitionBy("_t").orderBy(*h))).where("_d = 1")
    return distinct.withColumn("_n", F.row_number().over(Window.partitionBy(*strata).orderBy(*h))).where(F.col("_n") <= each).select(key, *strata)
