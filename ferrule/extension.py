"""What users plug in: factories by name, sources and metrics by protocol, results kept by identity."""

from __future__ import annotations

import inspect
from collections.abc import Callable
from importlib import import_module
from typing import Any, Protocol, runtime_checkable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ferrule.sources.stores import exists


@runtime_checkable
class Retriever(Protocol):
    """Gives (question, document, page, score) for questions."""

    def retrieve(self, questions: DataFrame, k: int) -> DataFrame: ...


@runtime_checkable
class PageLoader(Protocol):
    """Gives (document, page, content) for pages."""

    def load(self, pages: DataFrame) -> DataFrame: ...


@runtime_checkable
class Answerer(Protocol):
    """Gives (question, answer) for questions with their pages."""

    def answer(self, questions: DataFrame, pages: DataFrame) -> DataFrame: ...


def load(name: str) -> Callable:
    """The object that "module:name" stands for; it must be callable."""
    module, _, attribute = name.partition(":")
    if not module or not attribute:
        raise ValueError(f"{name!r} is not of the form module:name")
    found: Any = import_module(module)
    for part in attribute.split("."):
        found = getattr(found, part)
    if not callable(found):
        raise TypeError(f"{name} can't be called")
    return found


def call(factory: Callable, **options):
    """Calls a factory with those of the options that it takes; one that takes any gets all."""
    parameters = inspect.signature(factory).parameters.values()
    if any(p.kind is p.VAR_KEYWORD for p in parameters):
        return factory(**options)
    known = {p.name for p in parameters if p.kind in (p.POSITIONAL_OR_KEYWORD, p.KEYWORD_ONLY)}
    return factory(**{k: v for k, v in options.items() if k in known})


def answered(questions: DataFrame, retriever: Retriever, loader: PageLoader, answerer: Answerer, k: int, correct: Callable[[Column, Column], Column] | None = None) -> DataFrame:
    """(question, answer, and with a metric ``correct``) through the three parts; the metric compares the answer with the questions' ``gold``."""
    hits = retriever.retrieve(questions, k)
    out = answerer.answer(questions, loader.load(hits))
    if correct is None:
        return out
    return out.join(questions.select("question", "gold"), "question").withColumn("correct", correct(F.col("answer"), F.col("gold"))).drop("gold")


#: Workloads of each operation, by name: functions of (spark, options) that give a table.
WORKLOADS: dict[str, Callable[..., DataFrame]] = {}


def workload(name: str) -> Callable[[Callable[..., DataFrame]], Callable[..., DataFrame]]:
    """Registers a workload; a name that is taken is an error."""

    def add(f: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
        if name in WORKLOADS:
            raise ValueError(f"{name} is registered already")
        WORKLOADS[name] = f
        return f

    return add


def run(spark: SparkSession, name: str, **options) -> DataFrame:
    """Runs a registered workload, or one named "module:name"."""
    return call(WORKLOADS[name] if name in WORKLOADS else load(name), spark=spark, **options)


def judged(rows: DataFrame, ask: Callable[[DataFrame], DataFrame], path: str, columns: list[str]) -> DataFrame:
    """Adds the verdicts that ``ask`` gives for rows (digest, columns) as (digest, verdict); answers are kept under ``path`` by the row's digest, so that nothing is asked twice.

    ``ask`` is where a service is called, from executors; an uncertain answer is
    kept as well.
    """
    spark = rows.sparkSession
    marked = rows.withColumn("_digest", F.sha2(F.to_json(F.struct(*columns)), 256))
    todo = marked.select(F.col("_digest").alias("digest"), *columns).dropDuplicates(["digest"])
    if exists(spark, path):
        todo = todo.join(spark.read.parquet(path).select("digest"), "digest", "left_anti")
    ask(todo).select("digest", "verdict").write.mode("append").parquet(path)
    return marked.join(spark.read.parquet(path).withColumnRenamed("digest", "_digest"), "_digest", "left").drop("_digest")


def remembered(spark: SparkSession, path: str, identity: str, make: Callable[[], DataFrame]) -> DataFrame:
    """The table kept under ``path`` for this identity, made and written there the first time."""
    place = f"{path}/{identity}"
    if not exists(spark, f"{place}/_SUCCESS"):
        make().write.mode("overwrite").parquet(place)
    return spark.read.parquet(place)
