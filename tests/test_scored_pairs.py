"""Scores of distinct pairs of texts are those of every row, and made once a pair."""

from pyspark.sql import functions as F

from ferrule.functions import answers
from ferrule.operators import scoring

TEXTS = ["The ring", "ring", "a", "", None, "two 2", "2.0", "1e3 bolts", "one-two!", "x  y z", "inf", "3 4"]


def test_rows_have_the_scores_of_their_pair(spark):
    rows = [(k, p, g) for k, (p, g) in enumerate((p, g) for _ in range(2) for p in TEXTS for g in TEXTS)]
    df = spark.createDataFrame(rows, "id long, p string, g string")
    want = {r.id: (r.em, r.f1) for r in df.select("id", answers.text_em(F.col("p"), F.col("g")).alias("em"), answers.text_f1(F.col("p"), F.col("g")).alias("f1")).collect()}
    got = scoring.scored(df, "p", "g")
    assert got.columns == ["id", "p", "g", "em", "f1"]
    assert {r.id: (r.em, r.f1) for r in got.collect()} == want and got.count() == len(rows)


def test_equal_pairs_are_scored_once(spark):
    df = spark.range(5000).selectExpr("'the ring ' || id % 3 p", "'ring 1' g")
    lines = scoring.scored(df, "p", "g")._jdf.queryExecution().analyzed().toString().splitlines()
    at = next(k for k, line in enumerate(lines) if "translate" in line)
    assert any("Distinct" in line or "Deduplicate" in line or "Aggregate" in line for line in lines[at + 1 :])
