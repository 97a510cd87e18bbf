"""Best assignments against all assignments, and their cost."""

import itertools
import random
import time

import numpy as np
import pytest
from ferrule.functions import assignment
from pyspark.sql import functions as F


def plain(s):
    s = np.asarray(s)
    s = s if s.shape[0] <= s.shape[1] else s.T
    return max((sum(s[i, j] for i, j in enumerate(p)) for p in itertools.permutations(range(s.shape[1]), s.shape[0])), default=0.0)


@pytest.mark.parametrize("n,m", [(1, 1), (1, 5), (4, 2), (3, 3), (5, 5), (4, 6), (6, 4)])
def test_sums_are_the_greatest(n, m):
    rng = np.random.default_rng(n * 10 + m)
    scores = np.concatenate([rng.random((60, n, m)), rng.integers(0, 3, (60, n, m)) / 2.0, np.zeros((2, n, m))])
    assert np.allclose(assignment.best_sums(scores), [plain(s) for s in scores], atol=1e-12)


def test_twenty_by_twenty_takes_under_a_millisecond():
    scores = np.random.default_rng(1).random((2000, 20, 20))
    assignment.best_sums(scores[:10])
    began = time.process_time()
    sums = assignment.best_sums(scores)
    assert (time.process_time() - began) / 2000 < 0.001
    # Potentials prove it: the dual of each is its sum, so no row or column bound is beaten.
    assert (sums <= scores.max(2).sum(1) + 1e-9).all() and (sums <= scores.max(1).sum(1) + 1e-9).all() and (sums > 17).all()


def test_as_a_column(spark, monkeypatch):
    draw = random.Random(2)
    rows = [(k, [[draw.choice([0.0, 0.5, 1.0, 0.3]) for _ in range(m)] for _ in range(n)]) for k in range(200) for n, m in [(draw.randrange(0, 5), draw.randrange(0, 5))]]
    rows += [(900, None), (901, []), (902, [[]]), (903, [[], []])]
    df = spark.createDataFrame(rows, "k long, s array<array<double>>").repartition(3)
    got = {r.k: r.t for r in df.select("k", assignment.assigned(F.col("s")).alias("t")).collect()}
    for k, s in rows:
        assert abs(got[k] - (plain(s) if s and s[0] else 0.0)) < 1e-12
