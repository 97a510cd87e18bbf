"""Folds of labelled rows and the bounded sample that a model is fitted on."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A model is fitted on this many labelled rows at most, spread over the ids by a hash.
MOST_LABELLED = 20_000


def fold(id_column: str, folds: int) -> Column:
    """crc32 of the id as text, modulo ``folds``; a null id is in fold 0 of the empty text."""
    return F.pmod(F.crc32(F.coalesce(F.col(id_column).cast("string"), F.lit("")).cast("binary")), F.lit(folds)).cast("int")


def sample(labels: DataFrame, label: str, folds: int, held_out: int, most: int = MOST_LABELLED, id_column: str = "doc_id") -> DataFrame:
    """(id, y): at most about ``most`` labelled rows outside the held-out fold.

    Null labels and ids are left out; an id with several labels takes the
    largest. Rows are chosen by a hash of the id, so the choice is repeatable.
    """
    rows = labels.where(F.col(label).isin(0, 1) & F.col(id_column).isNotNull() & (fold(id_column, folds) != held_out))
    rows = rows.groupBy(F.col(id_column).cast("long").alias("id")).agg(F.max(label).cast("int").alias("y"))
    share = most / max(1, rows.count())
    if share < 1:
        rows = rows.where(F.pmod(F.xxhash64("id", F.lit(11)), F.lit(1_000_000)) < int(share * 1_000_000))
    return rows.limit(most + most // 10)
