"""Tables written to the shared folder and read back."""

from pyspark.sql import functions as F

from ferrule.llm import _common


def test_no_table_is_staged_as_lz4_raw(spark):
    df = spark.range(10).select("id", F.sequence(F.lit(0), F.col("id")).alias("x"))
    for staged in (_common.stage(df, "plain"), _common.stage_buckets(df, "buckets", "id")):
        assert staged.count() == 10
        assert all(".zstd." in f for f in staged.inputFiles())


def test_large_pages_are_read_back(spark):
    # A few large rows of numbers and bytes, as the n-gram join has them of long texts.
    long = F.transform(F.sequence(F.lit(1), F.lit(60_000)), lambda i: F.xxhash64(i, F.col("id")))
    df = spark.range(40).coalesce(1).select("id", F.when(F.col("id") % 3 > 0, long).otherwise(F.array(F.lit(7).cast("long"))).alias("first"), F.sha2(F.col("id").cast("string"), 256).cast("binary").alias("b"))
    staged = _common.stage(df, "pages")
    assert staged.select(F.sum(F.size("first"))).first()[0] == df.select(F.sum(F.size("first"))).first()[0]
    assert staged.select(F.sum(F.xxhash64("first", "b").cast("decimal(38,0)"))).first()[0] == df.select(F.sum(F.xxhash64("first", "b").cast("decimal(38,0)"))).first()[0]
