"""Picture pairs found by signatures, against all pairs."""

import random

import numpy as np
import pytest
from ferrule.operators import evidence
from pyspark.sql import functions as F

SCHEMA = "picture long, height int, width int, rgb binary"


def drawn(seed, n):
    rng, draw, rows = np.random.default_rng(seed), random.Random(seed), []
    bases = [rng.integers(0, 256, (draw.choice([24, 31, 40]), draw.choice([24, 40, 41]), 3)) for _ in range(6)]
    flat = [np.full((30, 30, 3), v) for v in (0, 10, 12, 14, 128, 255)]
    for k in range(n):
        base = draw.choice(bases + flat)
        step = draw.choice([0, 1, 2, 3, 5, 40])
        noisy = np.clip(base + rng.integers(-step, step + 1, base.shape), 0, 255) if draw.random() < 0.7 else base
        if draw.random() < 0.2:
            noisy = np.kron(noisy, np.ones((2, 2, 1)))
        view = np.ascontiguousarray(np.rot90(noisy, draw.randrange(4))).astype(np.uint8)
        rows.append((k, *view.shape[:2], view.tobytes()))
    return rows


def test_pairs_are_those_of_all_pairs(spark):
    rows = drawn(2, 42) + [(900, 3, 3, None), (901, 0, 0, b""), (902, 5, 5, b"short")]
    s = spark.createDataFrame([r for r in rows if r[0] % 3 == 0], SCHEMA)
    c = spark.createDataFrame(rows, SCHEMA).repartition(3)
    got = {(r.source, r.candidate): (r.rotation, r.status) for r in evidence.picture_pairs(s, c).collect()}
    first = {r.picture: r.first for r in evidence.same_pictures(c).collect()}
    first_s = {r.picture: r.first for r in evidence.same_pictures(s).collect()}
    left = s.where("length(rgb) > 5").select(F.col("picture").alias("source"), *[F.col(x).alias(f"s_{x}") for x in ("height", "width", "rgb")])
    right = c.where("length(rgb) > 5").select(F.col("picture").alias("candidate"), *[F.col(x).alias(f"c_{x}") for x in ("height", "width", "rgb")])
    every = evidence.matched_pictures(left.crossJoin(right)).where("status <> 'none'").collect()
    want = {(first_s[r.source], first[r.candidate]): (r.rotation, r.status) for r in every}
    assert {k: v[1] for k, v in got.items()} == {k: v[1] for k, v in want.items()}
    assert {v[1] for v in got.values()} == {"exact", "near"} and len({v[0] for v in got.values()}) == 4
    assert evidence.picture_pairs(s.limit(0), c).count() == 0


def test_wide_tolerances_are_refused():
    with pytest.raises(ValueError):
        evidence._signatures(True, 0.03, 0.05)


def test_cells_of_unlike_pictures_are_seldom_shared(spark):
    rng = np.random.default_rng(5)
    rows = [(k, 8, 8, np.repeat(np.clip(127 + 50 * rng.standard_normal((8, 8, 1)), 0, 255), 3, 2).astype(np.uint8).tobytes()) for k in range(400)]
    df = spark.createDataFrame(rows, SCHEMA)
    s, c = (df.mapInPandas(evidence._signatures(probes, 0.03, 0.01), "picture long, means array<double>, cells array<long>").select("picture", F.explode("cells").alias("cell")) for probes in (True, False))
    pairs = s.alias("s").join(c.alias("c"), "cell").select("s.picture", "c.picture").distinct().toDF("s", "c")
    assert pairs.where("s = c").count() == 400 and pairs.where("s <> c").count() < 0.01 * 400 * 400
