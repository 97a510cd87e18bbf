"""Draws of n out of n: their law, and that every layout of the rows gives the same; nulls against all permutations."""

import itertools
import math
import random
from collections import defaultdict

import numpy as np
from ferrule.operators import inference, resampling
from pyspark.sql import functions as F


def test_quantiles_are_binomial():
    u = np.append((np.arange(400) + 0.3717) / 400, [1e-9, 1 - 1e-9])
    for c in (0, 1, 7, 48, 49, 200, 1500):
        for share in (0.5, 1 / 3, 0.4997):
            mass = [math.exp(math.lgamma(c + 1) - math.lgamma(k + 1) - math.lgamma(c - k + 1) + k * math.log(share) + (c - k) * math.log1p(-share)) for k in range(c + 1)]
            want = np.minimum(np.searchsorted(np.cumsum(mass), u, side="right"), c)
            assert np.array_equal(resampling.quantiles(np.full(len(u), c), share, u), want), (c, share)
    many = resampling.quantiles(np.full(999, 10**9), 0.5, np.arange(1, 1000) / 1000)
    assert abs(many[499] - 5 * 10**8) <= 1 and abs((many[840] - many[158]) / 2 - math.sqrt(10**9) / 2 * 0.9987) < 60


def test_every_draw_takes_n_and_any_part_agrees():
    w = resampling.counts(np.arange(203), 203, 600, "s")
    assert (w.sum(axis=0) == 203).all() and w.min() == 0
    some = np.array([0, 3, 50, 51, 101, 102, 202])
    assert np.array_equal(resampling.counts(some, 203, 600, "s"), w[some])
    assert not np.array_equal(resampling.counts(some, 203, 600, "t"), w[some])
    assert abs(w.mean() - 1) < 1e-9 and abs(w.var() - (1 - 1 / 203)) < 0.03
    assert abs((w == 0).mean() - (1 - 1 / 203) ** 203) < 0.01 and abs(np.cov(w[10], w[11])[0, 1]) < 0.15


def test_sums_do_not_depend_on_the_layout(spark):
    draw = random.Random(1)
    rows = [(k, draw.choice("ab") if k else "c", draw.random(), [float(k), 1.0, draw.random()]) for k in range(500)]
    df = spark.createDataFrame(rows, "u long, s string, v double, a array<double>")
    w = resampling.counts(np.arange(500), 500, 3, "x")
    want = {d: (sum(w[k, d] * r[2] for k, r in enumerate(rows)), sum(w[k, d] * r[3][d] for k, r in enumerate(rows))) for d in range(3)}
    for parts in (1, 5):
        got = {r.draw: (r.v, r.a) for r in resampling.resampled(df.repartition(parts), ["u"], ["v", "a"], 3, "x").collect()}
        assert got.keys() == want.keys() and all(np.allclose(got[d], want[d]) for d in want)
    strata = defaultdict(list)
    for r in rows:
        strata[r[1]].append(r[2])
    for r in resampling.resampled(df.repartition(4), ["u"], ["v"], 3, "x", stratum="s").collect():
        own = strata[r.s]
        assert np.isclose(r.v, resampling.counts(np.arange(len(own)), len(own), 3, f"x|{r.s}")[:, r.draw] @ own)
    assert resampling.resampled(df.limit(0), ["u"], ["v"], 3, "x").count() == 0


def test_repetitions_are_drawn_within_units(spark):
    df = spark.createDataFrame([(1, 0, 2.0, [1.0, 5.0, 6.0]), (2, 1, 3.0, [4.0]), (3, 1, 3.0, []), (4, 1, 3.0, None), (5, 1, 7.0, [0.0, 1.0])], "u long, c long, v double, r array<double>")
    got = {r.draw: r.estimate for r in inference.nested_bootstrap(df, "u", "c", "v", "r", 5, "n").collect()}
    outer = resampling.counts(np.arange(2), 2, 5, "n|outer")
    for d in range(5):
        gap = lambda u, v, r: v - resampling.counts(np.arange(len(r)), len(r), 5, f"n|inner|{u}")[:, d] @ np.array(r) / len(r)  # noqa: B023, E731
        a, b, c = gap(1, 2.0, [1.0, 5.0, 6.0]), gap(2, 3.0, [4.0]), gap(5, 7.0, [0.0, 1.0])
        w = outer[:, d]
        assert np.isclose(got[d], (w[0] * a + w[1] * (b + c)) / (w[0] + 2 * w[1]))


def test_interactions_of_cells(spark):
    rows = [(k, "g", k % 2 == 0, k % 3 == 0, float((k % 2 == 0) * 2 + (k % 3 == 0) * 3 + (k % 6 == 0) * 5 + k % 5 / 10)) for k in range(300)] + [(1000 + k, "h", True, k % 2 == 0, 1.0) for k in range(4)] + [(2000, "g", None, True, 1.0)]
    df = spark.createDataFrame(rows, "u long, b string, p boolean, q boolean, v double").repartition(3)
    out = {r.b: r for r in resampling.interactions(df, "b", "p", "q", "v", "u", 200, "i").collect()}
    mean = lambda p, q: np.mean([r[4] for r in rows if r[1] == "g" and r[2] is p and r[3] is q])
    g = out["g"]
    assert np.isclose(g.interaction, mean(True, True) - mean(True, False) - mean(False, True) + mean(False, False)) and abs(g.interaction - 5) < 0.1
    assert g.low < g.interaction < g.high and g.high - g.low < 0.2 and (g.n00, g.n01, g.n10, g.n11) == (100, 50, 100, 50)
    assert (out["h"].interaction, out["h"].low, out["h"].n01) == (None, None, 0)


def test_the_null_is_that_of_all_permutations(spark):
    rows = [(1, 10 * k, "a" if k < 4 else "b", 1.0, s, m) for k, (s, m) in enumerate([(5.0, 8.0), (4.0, 1.0), (3.0, 0.5), (2.0, 0.25), (4.5, 2.0), (1.0, 4.0)])]
    rows += [(2, 1, "a", 1.0, 1.0, 0.0), (2, 2, "a", 5.0, 2.0, 0.0)]
    df = spark.createDataFrame(rows, "c long, i long, k string, x double, s double, m double")
    out = {r.c: r for r in resampling.matched_null(df, "c", "i", "k", "x", "s", "m", 1500, "p").collect()}
    total, values = 15.75, []
    for a in itertools.permutations(rows[:4]):
        for b in itertools.permutations(rows[4:6]):
            scored = sorted([(-x[4], y[1], y[5]) for x, y in zip([*a, *b], rows[:6], strict=True)])
            values.append(sum(m for *_, m in scored[:2]) / total)
    one = out[1]
    assert np.isclose(one.actual, (8 + 2) / total) and abs(one.null_mean - np.mean(values)) < 0.02
    assert np.isclose(one.null_low, np.quantile(values, 0.025)) and np.isclose(one.null_high, np.quantile(values, 0.975))
    assert (out[2].actual, out[2].null_mean) == (None, None)
