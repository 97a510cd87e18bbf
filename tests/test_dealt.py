"""Tasks that sort hold no more rows as tables grow."""

from ferrule.operators import ranking, settle


def test_rank_correlation_is_dealt_by_rows(spark, monkeypatch):
    monkeypatch.setattr(settle, "TASK_ROWS", 10)
    df = spark.range(95).selectExpr("id % 7 g", "id * 31 % 17 x", "id * 13 % 11 y", "id other")
    out = ranking.spearman(df, ["g"], "x", "y")
    assert out.rdd.getNumPartitions() == 10
    monkeypatch.setattr(settle, "TASK_ROWS", 1000)
    assert sorted(ranking.spearman(df, ["g"], "x", "y").collect()) == sorted(out.collect())
