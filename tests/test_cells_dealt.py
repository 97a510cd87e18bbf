"""Cells of pictures are many and are not sent to the driver (F1)."""

from ferrule.operators import evidence

SCHEMA = "picture long, height int, width int, rgb binary"


def test_cells_are_not_broadcast(spark):
    df = spark.createDataFrame([(k, 8, 8, bytes((k * 7 + x) % 256 for x in range(192))) for k in range(40)], SCHEMA)
    out = evidence.picture_pairs(df.where("picture % 20 = 0"), df)
    assert {(r.source, r.candidate) for r in out.collect() if r.status == "exact"} >= {(0, 0), (20, 20)}
    # Both as planned and as run, where sizes of earlier stages are known.
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert any("SortMergeJoin [cell" in line for line in plan.splitlines()) and not any("BroadcastHashJoin [cell" in line for line in plan.splitlines())
