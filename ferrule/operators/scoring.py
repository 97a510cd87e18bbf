"""Answer scores of predictions and their slices."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ferrule.functions import answers


def scored(df: DataFrame, predicted: str, gold: str) -> DataFrame:
    """Adds ``em`` and ``f1`` of single answers; each distinct pair of texts is scored once."""
    told, right = F.col(predicted).cast("string"), F.col(gold).cast("string")
    pairs = df.select(told.alias("_p"), right.alias("_g")).distinct().select("_p", "_g", answers.text_scores(F.col("_p"), F.col("_g")).alias("_s"))
    return df.join(pairs, told.eqNullSafe(F.col("_p")) & right.eqNullSafe(F.col("_g")), "left").select(*[F.col(f"`{c}`") for c in df.columns], "_s.em", "_s.f1")


def sliced_report(df: DataFrame, slices: list[str]) -> DataFrame:
    """Mean scores x 100 overall and by each slice alone, one row a value; slices of one row may overlap."""
    sets = [[F.col(s)] for s in slices] + [[]]
    return df.groupingSets(sets, *[F.col(s) for s in slices]).agg(F.count("*").alias("n"), (F.avg("em") * 100).alias("em"), (F.avg("f1") * 100).alias("f1"))


def overlapping_report(df: DataFrame, slices: dict[str, Column]) -> DataFrame:
    """Mean scores x 100 by named predicates that may hold together: each row is exploded to the slices that it is in."""
    named = F.array_compact(F.array(*[F.when(holds, F.lit(name)) for name, holds in slices.items()]))
    return df.withColumn("slice", F.explode(named)).groupBy("slice").agg(F.count("*").alias("n"), (F.avg("em") * 100).alias("em"), (F.avg("f1") * 100).alias("f1"))


def recall_at(retrieved: Column, relevant: Column, k: int) -> Column:
    """Share of the relevant documents among the distinct ones of the first k; 0 if none is relevant."""
    found = F.size(F.array_intersect(F.slice(retrieved, 1, k), relevant)).cast("double")
    return F.when(F.size(relevant) == 0, 0.0).otherwise(F.try_divide(found, F.size(relevant)))


def retrieval_depth(df: DataFrame, retrieved: str) -> DataFrame:
    """(depth): the most that was retrieved for any row; null lists are empty, and 0 without rows."""
    return df.agg(F.coalesce(F.max(F.size(F.coalesce(retrieved, F.array()))), F.lit(0)).alias("depth"))


def with_predictions(source: DataFrame, predictions: DataFrame, key: str, value: str) -> DataFrame:
    """Every source row with its prediction, "" where there is none. Unknown and repeated keys are errors, told by ``prediction_violations``."""
    one = predictions.select(key, F.coalesce(F.col(value), F.lit("")).alias(value))
    return source.join(one, key, "left").fillna({value: ""})


def prediction_violations(source: DataFrame, predictions: DataFrame, key: str) -> DataFrame:
    """(kind, key): predictions without a source row, and keys that occur more than once on either side."""
    twice = lambda df, kind: df.groupBy(key).count().where("count > 1").select(F.lit(kind).alias("kind"), key)
    unknown = predictions.select(key).distinct().join(source.select(key), key, "left_anti").select(F.lit("unknown prediction").alias("kind"), key)
    return reduce(DataFrame.union, [unknown, twice(predictions, "repeated prediction"), twice(source, "repeated source")])
