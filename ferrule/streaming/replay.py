"""Observation logs as streams: idempotent resumption, probes from history, warm-up rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ferrule.streaming.committed import written


def resumed(stream: DataFrame, path: str, checkpoint: str, key: str) -> StreamingQuery:
    """Runs a stream of rows to the table at ``path`` (read by ``committed``), each key once.

    Keys seen before are told by the stream's state, and a batch that is
    repeated after a crash by the table's log; neither reads the table, so a batch costs what its own rows cost.
    """
    return written(stream.dropDuplicates([key]), path, checkpoint).trigger(availableNow=True).start()


#: Observations of each phase of a case's schedule: seeds, controls, a broad and a focussed round.
SCHEDULE = (("seed", 22), ("control", 2), ("broad", 4), ("focus", 4))


def next_probes(history: DataFrame, case: str, item: str, score: str) -> DataFrame:
    """(case, phase, left, around): what a case is to observe next, from its history alone.

    The phase follows from how many observations there are; a focussed phase
    looks around the best item so far, ties by the smaller one.
    """
    seen = history.groupBy(case).agg(F.count_distinct(item).alias("n"), F.max_by(item, F.struct(F.col(score), -F.col(item))).alias("best"))
    phase, left, upto = None, None, 0
    for name, n in SCHEDULE:
        upto += n
        phase = (F if phase is None else phase).when(F.col("n") < upto, name)
        left = (F if left is None else left).when(F.col("n") < upto, F.lit(upto) - F.col("n"))
    return seen.select(case, phase.otherwise("done").alias("phase"), left.otherwise(0).alias("left"), F.when(phase.otherwise("done") == "focus", F.col("best")).alias("around"))


def measured(df: DataFrame, group: str, order: str, warm_up: int = 1) -> DataFrame:
    """Rows without the first ``warm_up`` of each group, which aren't measurements."""
    from pyspark.sql import Window

    place = F.row_number().over(Window.partitionBy(group).orderBy(order))
    return df.withColumn("_n", place).where(F.col("_n") > warm_up).drop("_n")
