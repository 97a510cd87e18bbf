"""Scores of queries and rows in stretches that a task can hold."""

import numpy as np

from ferrule.operators import vectors


def test_stretches_are_bounded_and_whole():
    for tokens, rows in ((4_096, 10_000), (1, 5), (3_000_000, 3), (1_200, 3_000), (7, 0)):
        parts = list(vectors._stretches(tokens, rows))
        assert [i for p in parts for i in range(p.start, p.stop)] == list(range(rows))
        assert all((p.stop - p.start) * tokens <= vectors.MOST_SCORES or p.stop - p.start == 1 for p in parts)


def test_results_over_many_stretches(spark):
    rng = np.random.default_rng(3)
    v, m = rng.integers(-3, 4, (3_001, 4)).astype(float), rng.integers(-3, 4, (1_200, 4)).astype(float)
    rows = spark.createDataFrame([(i, i // 5, x) for i, x in enumerate(v.tolist())], "id long, page long, v array<double>").coalesce(1)
    queries = spark.createDataFrame([(i % 7, i, x) for i, x in enumerate(m.tolist())], "q long, t long, qv array<double>")
    scores = m @ v.T
    order = np.lexsort((np.broadcast_to(np.arange(3_001), scores.shape), -scores))[:, :4]
    got = vectors.knn(queries, rows, 4).collect()
    assert {(r.t, r["rank"]): (r.id, r.score) for r in got} == {(t, k + 1): (int(i), scores[t, i]) for t in range(1_200) for k, i in enumerate(order[t])}
    best = np.maximum.reduceat(scores, np.arange(0, 3_001, 5), axis=1)
    want = {(q, p): float(best[q::7, p].sum()) for q in range(7) for p in range(601)}
    assert {(r.q, r.page): r.score for r in vectors.full_maxsim(queries, rows).collect()} == want
