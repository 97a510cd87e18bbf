"""Dense rasters: matrix products against sums cell by cell, with holes and missing rows."""

import math
import random

import numpy as np
import pytest
from ferrule.operators import raster
from pyspark.sql import functions as F


def rows_of(seed, pages, h, w):
    draw = random.Random(seed)
    return [(p, y, x, None if draw.random() < 0.2 else draw.choice([draw.random(), -math.inf if p == 2 else 1.0])) for p in range(pages) for y in range(h) for x in range(w) if p != 3 or draw.random() < 0.6]


def total(pairs):
    found = [(w, v) for w, v in pairs if v is not None and w > 0]
    return sum(w * v for w, v in found) if found else None


def near(a, b):
    return (a is None and b is None) or a == b or (a is not None and b is not None and abs(a - b) < 1e-9)


def test_resized_cell_by_cell(spark):
    rows = rows_of(1, 5, 4, 6)
    there = {r[:3]: r[3] for r in rows}
    got = {(r.page, r.y, r.x): r.v for r in raster.resized(spark.createDataFrame(rows, "page long, y int, x int, v double").repartition(3), (4, 6), (7, 5)).collect()}

    def axis(k, n, m):
        at = max((k + 0.5) * (n / m) - 0.5, 0.0)
        low = min(int(at), n - 1)
        return [(low, 1 - (at - low)), (min(low + 1, n - 1), at - low)]

    want = {}
    for p in range(5):
        for y in range(7):
            for x in range(5):
                taps = [(a, b, u * w) for a, u in axis(y, 4, 7) for b, w in axis(x, 6, 5) if u * w > 0 and (p, a, b) in there]
                if taps:
                    want[p, y, x] = total([(w, there[p, a, b]) for a, b, w in taps])
    assert got.keys() == want.keys() and all(near(got[k], want[k]) for k in want)


def test_smoothed_cell_by_cell(spark):
    rows = rows_of(2, 5, 5, 4)
    there = {r[:3]: r[3] for r in rows}
    got = {(r.page, r.y, r.x): r.v for r in raster.smoothed(spark.createDataFrame(rows, "page long, y int, x int, v double").repartition(3), 5, 4, 0.7).collect()}
    radius = math.ceil(2.1)
    raw = {d: math.exp(-d * d / (2 * 0.49)) for d in range(-radius, radius + 1)}
    taps = {d: w / sum(raw.values()) for d, w in raw.items()}
    clip = lambda k, n: min(max(k, 0), n - 1)
    first = {(p, y, x): total([(w, there.get((p, clip(y + d, 5), x))) for d, w in taps.items()]) for p, y, x in there}
    want = {(p, y, x): total([(w, first.get((p, y, clip(x + d, 4)))) for d, w in taps.items()]) for p, y, x in there}
    assert got.keys() == want.keys() and all(near(got[k], want[k]) for k in want)


@pytest.mark.parametrize("retention", ["any", "all", "mean"])
def test_the_chain_in_one_pass_is_that_of_its_steps(spark, retention):
    draw = random.Random(3)
    tokens = spark.createDataFrame([(p, k, draw.random() if draw.random() < 0.95 else None) for p in range(6) for k in range(30) if draw.random() < 0.9], "page long, place int, v double")
    one = {tuple(r) for r in raster.relevant_groups(tokens, (6, 5), (7, 11), 0.5, 1.0, retention).collect()}
    dense = raster.scattered(tokens, 6, 5)
    smooth = raster.smoothed(raster.resized(dense.fillna({"v": 0.0}), (6, 5), (7, 11)), 7, 11, 1.0)
    kept = raster.group_keep(smooth, F.col("v") >= 0.5, retention, F.col("v") >= 0.5)
    valid = raster.group_keep(raster.nearest(dense.withColumn("v", F.col("v").isNotNull()), (6, 5), (7, 11)), F.col("v"), "all").withColumnRenamed("keep", "valid")
    want = {(r.page, r.gy, r.gx, r.keep and r.valid) for r in kept.join(valid, ["page", "gy", "gx"]).collect()}
    assert one == want and {r[3] for r in one} == {True, False}
    with pytest.raises(ValueError):
        raster.relevant_groups(tokens, (6, 5), (7, 11), 0.5, 1.0, "none")


def test_weights_add_up():
    for n, m in [(1, 5), (5, 1), (4, 9), (9, 4), (6, 6)]:
        assert np.allclose(raster.resize_weights(n, m).sum(1), 1)
    assert np.allclose(raster.smooth_weights(3, 2.0).sum(1), 1) and np.allclose(raster.resize_weights(6, 6), np.eye(6))
