"""Tables that are computed once and read again: reliable checkpoints in the folder that the cluster shares."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def checkpoint_dir(spark: SparkSession) -> None:
    """Takes the folder that spark.checkpoint.dir names; sets one for tests where none is, and refuses a cluster that names none."""
    if spark.sparkContext.getCheckpointDir():
        return
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        spark.sparkContext.setCheckpointDir(named)
        return
    master = spark.conf.get("spark.master", "local")
    if not (master == "local" or master.startswith("local[")):
        raise RuntimeError("spark.checkpoint.dir must name a folder shared by the cluster")
    spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="ferrule-"))


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the folder that the cluster shares."""
    checkpoint_dir(spark)
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def settled(df: DataFrame) -> DataFrame:
    """``df`` written out, so that later plans read the same rows in the same partitions."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint()


class Rounds:
    """Tables of an iteration, written to the shared folder and read back: a plan starts anew at each, and ``drop`` deletes those that nothing reads any more."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.name, self.paths = spark, name, []

    def __call__(self, df: DataFrame) -> DataFrame:
        path = scratch(self.spark, self.name)
        self.paths.append(path)
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, but: DataFrame | None = None) -> None:
        """Deletes all tables but the one given."""
        kept = {f.rsplit("/", 1)[0] for f in but.inputFiles()} if but is not None else set()
        for p in self.paths:
            if not any(k.endswith(p.rsplit("/", 1)[1]) for k in kept):
                path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(p)
                path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
        self.paths = []


#: Rows of a task of ``dealt``.
TASK_ROWS = 500_000


def dealt(df: DataFrame, *keys: str, rows: int | None = None) -> DataFrame:
    """``df`` dealt by ``keys`` to tasks of about TASK_ROWS rows, so that what a task sorts doesn't grow with the table; no fewer tasks than the session has. ``rows`` is how many there are, or will be."""
    least = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(max(least, -(-(df.count() if rows is None else rows) // TASK_ROWS)), *keys)


def numbered(df: DataFrame, *order, name: str = "place") -> DataFrame:
    """Adds the 0-based place of each row in the global order, which should have no ties.

    Rows are dealt out by ranges and numbered within them; the ranges' sizes,
    one row each, are added up and broadcast. No task sees all rows.
    """
    parts = settled(df.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()))
    sizes = parts.groupBy("_part").agg(F.count("*").alias("_n"))
    before = sizes.withColumn("_before", F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("_n")).drop("_n")
    inner = F.row_number().over(Window.partitionBy("_part").orderBy(*order)) - 1
    return parts.join(F.broadcast(before), "_part").withColumn(name, (F.col("_before") + inner).cast("long")).drop("_part", "_before")


def summed_before(df: DataFrame, order: list, columns: dict[str, str]) -> DataFrame:
    """Adds the sum of each column over all rows before in the global order, by ranges as in ``numbered``."""
    parts = settled(df.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    totals = parts.groupBy("_part").agg(*[F.sum(c).alias(f"_t_{c}") for c in columns])
    totals = totals.select("_part", *[F.coalesce(F.sum(f"_t_{c}").over(before), F.lit(0)).alias(f"_b_{c}") for c in columns])
    inner = Window.partitionBy("_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    j = parts.join(F.broadcast(totals), "_part")
    return j.select(*df.columns, *[(F.col(f"_b_{c}") + F.coalesce(F.sum(c).over(inner), F.lit(0))).alias(name) for c, name in columns.items()])
