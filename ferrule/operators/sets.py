"""Set operations on keys and on arrays of ids."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def partition_violations(source: DataFrame, shards: DataFrame, key: str) -> DataFrame:
    """(kind, key): source keys that no shard has, shard keys that the source lacks, and keys in shards more than once."""
    missing = source.select(key).join(shards.select(key), key, "left_anti").select(F.lit("missing").alias("kind"), key)
    unknown = shards.select(key).distinct().join(source.select(key), key, "left_anti").select(F.lit("unknown"), key)
    twice = shards.groupBy(key).count().where("count > 1").select(F.lit("repeated"), key)
    return missing.union(unknown).union(twice)


def merged(parts: list[DataFrame], source: DataFrame, key: str, place: str, drop: list[str] | None = None) -> DataFrame:
    """The union of shards with each row's place in the source, sorted by it."""
    return reduce(DataFrame.unionByName, parts).drop(*(drop or [])).join(source.select(key, place), key).orderBy(place)


def relations(members: DataFrame, label: str, key: str) -> DataFrame:
    """(a, b, both, relation) of every two labels (a < b): equal, subset, superset, overlap or disjoint.

    Pairs of labels come from each key's own set of labels; there are few labels.
    """
    rows = members.select(F.col(label).alias("label"), F.col(key).alias("k")).distinct()
    sizes = rows.groupBy("label").agg(F.count("*").alias("n"))
    held = rows.groupBy("k").agg(F.array_sort(F.collect_set("label")).alias("held"))
    combinations = held.groupBy("held").agg(F.count("*").alias("n"))
    pairs = combinations.select("n", F.explode("held").alias("a"), "held").select("n", "a", F.explode("held").alias("b")).where("a < b")
    both = pairs.groupBy("a", "b").agg(F.sum("n").alias("both"))
    every = sizes.select(F.col("label").alias("a"), F.col("n").alias("na")).join(F.broadcast(sizes.select(F.col("label").alias("b"), F.col("n").alias("nb"))), F.col("a") < F.col("b"))
    found = every.join(both, ["a", "b"], "left").withColumn("both", F.coalesce("both", F.lit(0)).cast("long"))
    kind = F.when((F.col("both") == F.col("na")) & (F.col("both") == F.col("nb")), "equal").when(F.col("both") == F.col("na"), "subset").when(F.col("both") == F.col("nb"), "superset")
    return found.select("a", "b", "both", kind.when(F.col("both") == 0, "disjoint").otherwise("overlap").alias("relation"))


def symmetric_difference(a: Column, b: Column) -> Column:
    return F.array_sort(F.concat(F.array_except(a, b), F.array_except(b, a)))


def jaccard(a: Column, b: Column) -> Column:
    """Shared elements by all elements; 1 for two empty sets."""
    every = F.size(F.array_union(a, b))
    return F.when(every == 0, 1.0).otherwise(F.try_divide(F.size(F.array_intersect(a, b)).cast("double"), every))


def weighted_jaccard(a: Column, b: Column, weights: Column | None = None) -> Column:
    """Weight of shared elements by that of all; the weight of an element is its entry in a map, or itself."""
    weight = lambda x: (F.coalesce(F.try_element_at(weights, x), F.lit(0.0)) if weights is not None else x).cast("double")
    total = lambda s: F.aggregate(s, F.lit(0.0), lambda acc, x: acc + weight(x))
    every = total(F.array_union(a, b))
    return F.when(every == 0, 1.0).otherwise(F.try_divide(total(F.array_intersect(a, b)), every))


def same_multiset(a: Column, b: Column) -> Column:
    return F.array_sort(a) == F.array_sort(b)


def harvested(df: DataFrame, key: str, json: str, known: DataFrame, id_column: str) -> DataFrame:
    """(key, ids): known ids that stand anywhere in a JSON text, sorted; rows without any have an empty array."""
    words = df.select(key, F.explode(F.array_distinct(F.regexp_extract_all(json, F.lit("([A-Za-z0-9]+)"), 1))).alias("_id"))
    found = words.join(known.select(F.col(id_column).alias("_id")).distinct(), "_id").groupBy(key).agg(F.array_sort(F.collect_set("_id")).alias("ids"))
    return df.select(key).join(found, key, "left").withColumn("ids", F.coalesce("ids", F.array().cast("array<string>")))
