"""Token policies at a boundary, as a closed table of names, and eligibility of questions."""

from __future__ import annotations

from collections.abc import Callable
from enum import Enum

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ferrule.operators.metrics import violations


class Policy(Enum):
    """What a boundary may do with the tokens that it sees; other names are errors."""

    WHOLE = "no-ctp"
    LITERAL_THRESHOLD = "literal-threshold"
    AGGREGATE_THRESHOLD = "aggregate-threshold"
    LITERAL_TOP = "literal-score-top-m"
    AGGREGATE_TOP = "aggregate-score-top-m"
    RANDOM = "global-uniform-random"
    PAGE_RANDOM = "page-stratified-random"


def _top(score: Column | str, group: list[str], m: Column) -> Column:
    return F.row_number().over(Window.partitionBy(*group).orderBy(F.desc(score) if isinstance(score, str) else score, "token")) <= m


_KEEP: dict[Policy, Callable[[list[str], float, str], Column]] = {
    Policy.WHOLE: lambda g, t, s: F.lit(True),
    Policy.LITERAL_THRESHOLD: lambda g, t, s: F.col("literal") >= t,
    Policy.AGGREGATE_THRESHOLD: lambda g, t, s: F.col("aggregate") >= t,
    Policy.LITERAL_TOP: lambda g, t, s: _top("literal", g, F.col("budget")),
    Policy.AGGREGATE_TOP: lambda g, t, s: _top("aggregate", g, F.col("budget")),
    Policy.RANDOM: lambda g, t, s: _top(_drawn(g, s), g, F.col("budget")),
    Policy.PAGE_RANDOM: lambda g, t, s: _top(_drawn(g, s), [*g, "page"], F.col("page_budget")),
}


def _drawn(group: list[str], seed: str) -> Column:
    return F.sha2(F.concat_ws("|", F.lit(seed), *[F.col(c).cast("string") for c in group], F.col("token").cast("string")), 256)


def selected(tokens: DataFrame, group: list[str], names: list[str], threshold: float, seed: str) -> DataFrame:
    """(group, policy, token, kept, native, tied) of (group..., page, token, literal, aggregate) under each named policy.

    ``native`` is what the aggregate threshold keeps, whose number is the budget
    of top-m and random policies (by page, of the best of the page); ``tied``
    tokens score exactly the threshold.
    """
    native = F.col("aggregate") >= threshold
    base = tokens.withColumn("native", native).withColumn("tied", F.col("aggregate") == threshold).withColumn("budget", F.count_if("native").over(Window.partitionBy(*group)))
    base = base.withColumn("_best", _top("aggregate", group, F.col("budget"))).withColumn("page_budget", F.count_if("_best").over(Window.partitionBy(*group, "page")))
    rows = base.select("*", *[_KEEP[Policy(n)](group, threshold, f"{seed}|{n}").alias(f"_k{i}") for i, n in enumerate(names)])
    each = F.explode(F.array(*[F.struct(F.lit(n).alias("policy"), F.col(f"_k{i}").alias("kept")) for i, n in enumerate(names)])).alias("p")
    return rows.select(*group, each, "token", "native", "tied").select(*group, "p.policy", "token", "p.kept", "native", "tied")


def selection_records(chosen: DataFrame, group: list[str]) -> DataFrame:
    """(group, policy, population, kept, tied, difference): counts, and the tokens in which a selection differs from the native one, sorted."""
    return chosen.groupBy(*group, "policy").agg(
        F.count("*").alias("population"), F.count_if("kept").alias("kept"), F.count_if("tied").alias("tied"),
        F.array_sort(F.collect_list(F.when(F.col("kept") != F.col("native"), F.col("token")))).alias("difference"),
    )


def eligible(questions: DataFrame, development: DataFrame) -> DataFrame:
    """(qid, failures, eligible) of (qid, type, supports, pages, features): four different pages in line with four features, distinct supports, one hop, not seen in development.

    Pages and features are arrays of structs (document, page).
    """
    pairs = lambda c: F.transform(c, lambda p: F.struct(p["document"].alias("document"), p["page"].alias("page")))
    seen = development.select(F.col("qid"), F.lit(True).alias("_seen")).distinct()
    repeated = F.count("*").over(Window.partitionBy("qid"))
    rows = questions.join(seen, "qid", "left").withColumn("_n", repeated)
    rules = {
        "four pages": F.size("pages") == 4, "different pages": F.size(F.array_distinct(pairs("pages"))) == F.size("pages"), "features in line": pairs("pages") == pairs("features"),
        "distinct supports": (F.size("supports") > 0) & (F.size(F.array_distinct("supports")) == F.size("supports")), "one hop": F.col("type") == "single_hop", "not in development": F.col("_seen").isNull(), "once": F.col("_n") == 1,
    }
    failed = violations(rows, "qid", rules).groupBy("qid").agg(F.array_sort(F.collect_set("violation")).alias("failures"))
    out = questions.select("qid").distinct().join(failed, "qid", "left")
    return out.select("qid", F.coalesce("failures", F.array().cast("array<string>")).alias("failures"), F.col("failures").isNull().alias("eligible"))
