"""Stage metrics, cost ledgers, deltas of nested summaries and comparisons of runs."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ferrule.sources import jsonl

STAGES = ("post_btp", "post_qtp", "post_ctp")
TIMES = ("retrieval_seconds", "page_load_seconds", "qa_seconds", "encoder_seconds", "decoder_seconds", "total_seconds")


#: Columns of a result row that stage metrics are made of.
RESULT = "original double, " + ", ".join(f"{s} double" for s in (*STAGES, *TIMES)) + ", peak_bytes double, warmup_excluded boolean, profiler_enabled boolean, flops double"


def metrics_of_files(spark: SparkSession, path: str, by: dict[str, str]) -> DataFrame:
    """``stage_metrics`` straight from files of JSON lines, blank lines passed over; ``by`` names the grouping fields and their types."""
    keys = ", ".join(f"{k} {kind}" for k, kind in by.items())
    return stage_metrics(jsonl.lenient(spark, path, f"{keys}, {RESULT}" if keys else RESULT), list(by))


def stage_metrics(rows: DataFrame, by: list[str]) -> DataFrame:
    """Sums of tokens and seconds, mean and token-weighted drop rates, throughput, peak memory, whether all rows are without warm-up, and FLOPs where any were profiled."""
    drop = lambda s: 1 - F.col(s) / F.col("original")
    rate = lambda n, s: F.when(F.sum(s) == 0, 0.0).otherwise(n / F.sum(s))
    profiled = F.bool_or("profiler_enabled")
    return rows.groupBy(*by).agg(
        F.count("*").alias("samples"), *[F.sum(c).alias(c) for c in ("original", *STAGES, *TIMES)],
        *[F.avg(drop(s)).alias(f"mean_drop_{s[5:]}") for s in STAGES], *[(1 - F.sum(s) / F.sum("original")).alias(f"weighted_drop_{s[5:]}") for s in STAGES],
        rate(F.count("*"), "encoder_seconds").alias("encoder_rate"), rate(F.count("*"), "decoder_seconds").alias("decoder_rate"), rate(F.sum("original"), "total_seconds").alias("token_rate"),
        F.max("peak_bytes").alias("peak_bytes"), F.bool_and("warmup_excluded").alias("warmup_excluded"), profiled.alias("profiler_enabled"), F.when(profiled, F.sum("flops")).alias("flops"),
    )


def trace_violations(rows: DataFrame, key: str, positive_times: bool = False) -> DataFrame:
    """(key, violation): counts that aren't positive or grow, times that aren't finite or are negative (or 0), FLOPs without or beyond profiling."""
    counts = ["original", *STAGES]
    time_ok = lambda c: F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(F.col(c)) < float("inf")) & ((F.col(c) > 0) if positive_times else (F.col(c) >= 0))
    rules = {
        "counts must be positive": reduce(Column.__and__, [F.col(c) > 0 for c in counts]),
        "counts must not grow": reduce(Column.__and__, [F.col(a) >= F.col(b) for a, b in zip(counts, counts[1:], strict=False)]),
        "times must be finite": reduce(Column.__and__, [time_ok(c) for c in TIMES]),
        "peak must not be negative": F.col("peak_bytes") >= 0,
        "FLOPs must go with profiling": F.when(F.col("profiler_enabled"), F.col("flops") >= 0).otherwise(F.col("flops").isNull()),
    }
    return violations(rows, key, rules)


def violations(rows: DataFrame, key: str, rules: dict[str, Column]) -> DataFrame:
    """(key, violation) of every rule that a row breaks; an unknown truth breaks it."""
    broken = F.array_compact(F.array(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in rules.items()]))
    return rows.select(key, F.explode(broken).alias("violation"))


def cost_ledger(calls: DataFrame, stage: str, columns: list[str], required: list[str]) -> DataFrame:
    """(stage, calls, sums, missing): sums and counts by stage; required stages without a call stand with none."""
    sums = calls.groupBy(F.col(stage).alias("stage")).agg(F.count("*").alias("calls"), *[F.sum(c).alias(c) for c in columns])
    wanted = calls.sparkSession.createDataFrame([(s,) for s in required], "stage string")
    return sums.join(F.broadcast(wanted.withColumn("_r", F.lit(True))), "stage", "full").select("stage", F.coalesce("calls", F.lit(0)).alias("calls"), *columns, F.col("calls").isNull().alias("missing"))


def melted(summary: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, metric, value) of all numbers of a summary, nested ones by dotted names."""

    def walk(schema, prefix: str = ""):
        for f in schema.fields:
            name = f"{prefix}{f.name}"
            if f.dataType.typeName() == "struct":
                yield from walk(f.dataType, f"{name}.")
            elif f.dataType.typeName() in ("integer", "long", "short", "byte", "double", "float") or f.dataType.typeName().startswith("decimal"):
                yield name

    names = [n for n in walk(summary.schema) if n not in keys]
    return summary.select(*keys, F.explode(F.array(*[F.struct(F.lit(n).alias("metric"), F.col(n).cast("double").alias("value")) for n in names])).alias("m")).select(*keys, "m.*")


def deltas(first: DataFrame, second: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, metric, first, second, delta) of the numbers that both summaries have."""
    a, b = melted(first, keys).withColumnRenamed("value", "first"), melted(second, keys).withColumnRenamed("value", "second")
    return a.join(b, [*keys, "metric"]).withColumn("delta", F.col("second") - F.col("first"))


def throughput(runs: DataFrame) -> DataFrame:
    """Adds ``tflops`` (FLOPs by total seconds by 1e12); null where none was profiled, an error if only some runs were."""
    some = runs.agg(F.count("flops").alias("_some"), F.count("*").alias("_all"))
    mixed = (F.col("_some") > 0) & (F.col("_some") < F.col("_all"))
    value = F.when(mixed, F.raise_error(F.lit("some runs were profiled, others not")).cast("double")).otherwise(F.try_divide(F.col("flops"), F.col("total_seconds")) / 1e12)
    return runs.join(F.broadcast(some)).withColumn("tflops", value).drop("_some", "_all")


def matrix_violations(cells: DataFrame, modes: list[str], counts: list[int]) -> DataFrame:
    """(mode, pages, violation): cells of the modes x page counts that are missing, repeated, or unexpected."""
    wanted = cells.sparkSession.createDataFrame([(m, c) for m in modes for c in counts], "mode string, pages int").withColumn("_w", F.lit(True))
    n = cells.groupBy("mode", "pages").agg(F.count("*").alias("_n"))
    kind = F.when(F.col("_n").isNull(), "missing").when(F.col("_w").isNull(), "unexpected").when(F.col("_n") > 1, "repeated")
    return n.join(F.broadcast(wanted), ["mode", "pages"], "full").select("mode", "pages", kind.alias("violation")).where("violation is not null")


def matrix_deltas(cells: DataFrame, baseline: str, other: str, values: list[str]) -> DataFrame:
    """(pages, value deltas): what the other mode has over the baseline at each page count."""
    a = cells.where(F.col("mode") == baseline).select("pages", *[F.col(v).alias(f"_{v}") for v in values])
    return cells.where(F.col("mode") == other).join(a, "pages").select("pages", *[(F.col(v) - F.col(f"_{v}")).alias(v) for v in values])
