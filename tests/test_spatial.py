"""The overlap join against all pairs, for boxes of all sizes."""

import random

from ferrule.operators import spatial
from pyspark.sql import functions as F


def boxes(seed, n):
    draw, out = random.Random(seed), []
    for k in range(n):
        size = 2.0 ** draw.uniform(-3, 12)
        x, y = draw.choice([0.0, 16.0, draw.uniform(-300, 5000)]), draw.uniform(-300, 5000)
        out.append((draw.randrange(3), k, x, y, x + draw.choice([size, 16.0, 32.0, 0.0]), y + size * draw.random()))
    return out


def test_pairs_are_those_of_all_pairs(spark):
    t, r = boxes(1, 250), boxes(2, 120) + [(0, 900, -1e4, -1e4, 1e4, 1e4), (1, 901, None, 0.0, 1.0, 1.0)]
    td = spark.createDataFrame(t, "page int, token int, tx0 double, ty0 double, tx1 double, ty1 double").repartition(3)
    rd = spark.createDataFrame(r, "page int, region int, rx0 double, ry0 double, rx1 double, ry1 double")
    got = sorted((x.token, x.region, round(x.area, 6)) for x in spatial.overlap_join(td, rd).collect())
    want = []
    for a in t:
        for b in r:
            if a[0] == b[0] and None not in b:
                w, h = min(a[4], b[4]) - max(a[2], b[2]), min(a[5], b[5]) - max(a[3], b[3])
                if w > 0 and h > 0:
                    want.append((a[1], b[1], round(w * h, 6)))
    assert got == sorted(want)
    assert spatial.overlap_join(td.limit(0), rd).count() == 0 and spatial.overlap_join(td, rd.limit(0)).count() == 0


def test_a_box_lies_in_four_cells_at_most(spark):
    td = spark.createDataFrame(boxes(3, 2000), "page int, token int, tx0 double, ty0 double, tx1 double, ty1 double").withColumn("l", spatial.level("t", 16))
    most = spatial.in_cells(td, "t", 16, "l").groupBy("token").count().agg(F.max("count")).first()[0]
    assert most <= 4


def test_copies_of_boxes_are_not_expanded_to_find_owners(spark):
    """40,000 tokens and 20,000 regions of one box: 800 million pairs, which owners never make."""
    td = spark.range(40_000).selectExpr("0 page", "id token", "0.0D tx0", "0.0D ty0", "4.0D tx1", "4.0D ty1")
    rd = spark.range(20_000).selectExpr("0 page", "id + 7 region", "1.0D rx0", "1.0D ry0", "9.0D rx1", "9.0D ry1", "-id rank")
    assert spatial.met_boxes(td, rd).count() == 1
    rows = spatial.owners(td, rd).groupBy("region", "area").count().collect()
    assert [tuple(r) for r in rows] == [(7, 9.0, 40_000)]
    assert spatial.owners(td, rd, order=["rank", "region"]).groupBy("region").count().collect()[0][0] == 20_006
    assert [tuple(r) for r in spatial.first_owners(td, rd, "region", 8).groupBy("owner").count().collect()] == [(7, 40_000)]


def test_owners_and_shares_are_those_of_all_pairs(spark):
    """Boxes that repeat, tokens and regions of several boxes, and null corners."""
    draw = random.Random(4)
    box = lambda: draw.choice([(0.0, 0.0, 4.0, 4.0), (2.0, 1.0, 9.0, 6.0), (3.0, 3.0, 5.0, 5.0), (draw.random(), 0.0, 7.0, draw.random() * 8), (None, 0.0, 1.0, 1.0)])
    t, r = ([(draw.randrange(2), draw.randrange(n), *box()) for _ in range(n)] for n in (60, 25))
    td = spark.createDataFrame(t, "page int, token int, tx0 double, ty0 double, tx1 double, ty1 double").repartition(3)
    rd = spark.createDataFrame(r, "page int, region int, rx0 double, ry0 double, rx1 double, ry1 double")
    pairs = spatial.overlap_join(td, rd).collect()
    best, shares = {}, {}
    for x in pairs:
        key = (x.page, x.token)
        best[key] = min(best.get(key, (1.0, 0)), (-x.area, x.region))
        shares[(*key, x.region)] = shares.get((*key, x.region), 0) + x.area / ((x.tx1 - x.tx0) * (x.ty1 - x.ty0))
    got = sorted((x.page, x.token, -(x.area or -1.0), x.region or 0) for x in spatial.owners(td, rd).collect())
    assert got == sorted((p, k, *best.get((p, k), (1.0, 0))) for p, k, *_ in t)
    assert {(x.page, x.token, x.region): round(x.fraction, 9) for x in spatial.owned_fractions(td, rd).collect()} == {k: round(v, 9) for k, v in shares.items()}
    like = spatial.similar_boxes(td, rd, 0.5).select("page", "token", "region", "tx0", "tx1", "rx0", "ry1", "iou").collect()
    area = lambda x, p: (x[f"{p}x1"] - x[f"{p}x0"]) * (x[f"{p}y1"] - x[f"{p}y0"])
    want = [(x.page, x.token, x.region, x.tx0, x.tx1, x.rx0, x.ry1, i) for x in pairs if (i := x.area / (area(x, "t") + area(x, "r") - x.area)) > 0.5]
    assert sorted(map(tuple, like)) == sorted(want)
