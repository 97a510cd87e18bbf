"""Orders, chunks, ranks and comparisons of rankings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ferrule.operators.settle import numbered


def shards(df: DataFrame, order: list, size: int, name: str = "shard") -> DataFrame:
    """Consecutive shards of ``size`` rows in the global order."""
    return numbered(df, *order).withColumn(name, F.floor(F.col("place") / size))


def strided(df: DataFrame, order: list, count: int, name: str = "shard") -> DataFrame:
    """``count`` shards that take every ``count``-th row of the global order."""
    return numbered(df, *order).withColumn(name, F.col("place") % count)


def best_of(df: DataFrame, group: list[str], order: list) -> DataFrame:
    """The first row of each group."""
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*group).orderBy(*order))).where("_n = 1").drop("_n")


def falls(df: DataFrame, group: list[str], order: str, value: str) -> DataFrame:
    """Adjacent pairs of the order in which the value falls: (earlier, later, change)."""
    w = Window.partitionBy(*group).orderBy(order)
    pairs = df.select(*group, F.lag(order).over(w).alias("earlier"), F.col(order).alias("later"), (F.col(value) - F.lag(value).over(w)).alias("change"))
    return pairs.where("change < 0")


def first_lasting(df: DataFrame, group: list[str], order: str, holds: Column) -> DataFrame:
    """The first place from which the predicate holds to the end; null if it doesn't hold at the end."""
    later = F.min(holds.cast("int")).over(Window.partitionBy(*group).orderBy(order).rowsBetween(0, Window.unboundedFollowing))
    return df.withColumn("_ok", later).groupBy(*group).agg(F.min(F.when(F.col("_ok") == 1, F.col(order))).alias("first"))


def peaks(df: DataFrame, row: str, column: str, value: str) -> DataFrame:
    """The greatest z-score of each row, where scores are standardised within columns (no spread: by 1)."""
    w = Window.partitionBy(column)
    spread = F.stddev_pop(value).over(w)
    z = (F.col(value) - F.avg(value).over(w)) / F.when(spread == 0, 1.0).otherwise(spread)
    return df.withColumn("_z", z).groupBy(row).agg(F.max("_z").alias("peak"))


def loss_without(df: DataFrame, row: str, column: str, value: str) -> DataFrame:
    """What the mean over columns of the greatest value loses without each row."""
    w = Window.partitionBy(column).orderBy(F.desc(value), row)
    top = df.select(row, column, value, F.row_number().over(w).alias("_n"), F.lead(value).over(w).alias("_next")).where("_n = 1")
    columns = df.agg(F.count_distinct(column).alias("_columns"))
    lost = top.groupBy(row).agg(F.sum(F.col(value) - F.coalesce("_next", F.lit(0.0))).alias("_lost"))
    rows = df.select(row).distinct().join(lost, row, "left").join(F.broadcast(columns))
    return rows.select(row, (F.coalesce("_lost", F.lit(0.0)) / F.col("_columns")).alias("loss"))


def top_mean(df: DataFrame, row: list[str], value: str, k: int = 3) -> DataFrame:
    """Mean of each row's k greatest values."""
    w = Window.partitionBy(*row).orderBy(F.desc(value))
    return df.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= k).groupBy(*row).agg(F.avg(value).alias("top_mean"))


def prefix_violations(done: DataFrame, source: DataFrame, key: str, place: str) -> DataFrame:
    """Rows done (key, place) that aren't the source's row at that place, so that the work isn't a prefix of the source; gaps show as well."""
    wanted = source.select(F.col(place).alias("_place"), F.col(key).alias("_key"))
    size = done.agg(F.count("*").alias("_size"))
    j = done.join(wanted, F.col(place) == F.col("_place"), "left").join(F.broadcast(size))
    return j.where((F.col(place) >= F.col("_size")) | F.col("_key").isNull() | (F.col("_key") != F.col(key))).select(key, place)


def filled(df: DataFrame, group: str, order: list, each: int, total: int) -> DataFrame:
    """``each`` first rows of every group, then others in order up to ``total``."""
    w = F.row_number().over(Window.partitionBy(group).orderBy(*order))
    ranked = df.withColumn("_late", (w > each).cast("int"))
    return ranked.orderBy("_late", *order).limit(total).drop("_late")


def nearest_quantile(values: Column, q: float) -> Column:
    """The element of a list at place round((n - 1) q), halves to even."""
    return F.element_at(F.array_sort(values), F.bround((F.size(values) - 1) * F.lit(q), 0).cast("int") + 1)


def floor_quantile(values: Column, q: float) -> Column:
    """The element of a list at place floor((n - 1) q)."""
    return F.element_at(F.array_sort(values), F.floor((F.size(values) - 1) * F.lit(q)).cast("int") + 1)


def compared_rankings(df: DataFrame, group: list[str], item: str, a: str, b: str, tops: tuple[int, ...] = (1, 3, 5)) -> DataFrame:
    """By group: how many items the two rankings' tops share, and how many pairs they order the other way round.

    Pairs are counted within groups, which the data model bounds (pages of one question).
    """
    rank = lambda c: F.row_number().over(Window.partitionBy(*group).orderBy(F.desc(c), item))
    ranked = df.select(*group, item, F.col(a).alias("_a"), F.col(b).alias("_b"), rank(a).alias("_ra"), rank(b).alias("_rb"))
    shared = ranked.groupBy(*group).agg(*[F.count_if((F.col("_ra") <= k) & (F.col("_rb") <= k)).alias(f"shared_{k}") for k in tops])
    other = ranked.select(*group, F.col(item).alias("_item"), F.col("_a").alias("_a2"), F.col("_b").alias("_b2"))
    pairs = ranked.join(other, group).where(F.col(item) < F.col("_item"))
    turned = pairs.groupBy(*group).agg(F.count_if((F.col("_a") - F.col("_a2")) * (F.col("_b") - F.col("_b2")) < 0).alias("reversals"))
    return shared.join(turned, group, "left").fillna({"reversals": 0})
