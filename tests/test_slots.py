"""Permuted scores stay within the task that made them."""

from ferrule.operators import resampling


def test_draws_are_not_shuffled(spark, monkeypatch):
    df = spark.range(300).selectExpr("id % 3 c", "id i", "cast(id % 2 as string) k", "id * 7919 % 97 x", "id * 37 % 101 / 10.0D s", "id * 31 % 11 / 10.0D m")
    found = []
    for slots in (1, 3, 8):
        monkeypatch.setattr(resampling, "SLOTS", slots)
        out = resampling.matched_null(df, "c", "i", "k", "x", "s", "m", 5, "t")
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert not any("hashpartitioning" in line and "draw#" in line for line in plan.splitlines())
        found.append(sorted(tuple(round(x, 9) for x in r) for r in out.collect()))
    assert found[0] == found[1] == found[2] and len(found[0]) == 3
