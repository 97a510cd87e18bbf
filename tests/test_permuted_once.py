"""Rows whose scores are permuted are shuffled once."""

import hashlib
import math
from collections import defaultdict

import numpy as np

from ferrule.operators import resampling, settle


def enumerated(rows, draws, seed):
    cases, out = defaultdict(list), set()
    for r in rows:
        cases[r[0]].append(r)
    for c, own in cases.items():
        q, groups, total = np.quantile([r[3] for r in own], [0.2, 0.4, 0.6, 0.8]), defaultdict(list), sum(r[5] for r in own)
        held = lambda scored: sum(m for _, _, m in sorted((-s, i, m) for s, i, m in scored)[: math.ceil(len(own) / 5)]) / total  # noqa: B023, E731
        for r in sorted(own, key=lambda r: r[1]):
            if r[2] is not None:
                groups[r[2], int((q < r[3]).sum())].append(r)
        v = [held([(r[4], i, m) for g in groups.values() for r, (_, i, m) in zip(g, sorted((hashlib.sha256(f"{seed}|{d}|{x[1]}".encode()).hexdigest(), x[1], x[5]) for x in g), strict=True)]) for d in range(draws)]
        if c is not None and groups:
            out.add((c, *(round(float(x), 9) for x in (held([(r[4], r[1], r[5]) for r in own]), np.mean(v), np.quantile(v, 0.025), np.quantile(v, 0.975)))))
    return out


def test_rows_are_shuffled_once_and_large_cases_by_slots(spark, monkeypatch):
    rows = [(None if k < 4 else 1 if k < 80 else 2 if k < 90 else 3, k, None if k % 7 == 0 or k >= 96 else "ab"[k % 2], k * 7919 % 97, k * 37 % 101 / 10, k % 5 + 0.5) for k in range(100)]
    df = spark.createDataFrame([*rows[:96], *((4, k, None, 1, 1.0, 1.0) for k in range(96, 100))], "c long, i long, k string, x long, s double, m double").repartition(3)
    want = enumerated([*rows[:96], *((4, k, None, 1, 1.0, 1.0) for k in range(96, 100))], 6, "t")
    assert {c for c, *_ in want} == {1, 2, 3}
    for most, shuffles in ((500_000, 1), (140, None)):  # then cases of over 20 items are large
        monkeypatch.setattr(settle, "TASK_ROWS", most)
        out = resampling.matched_null(df, "c", "i", "k", "x", "s", "m", 6, "t")
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert "Join" not in plan and (not shuffles or plan.count("Exchange hashpartitioning") == shuffles)
        assert {(r.c, *(round(x, 9) for x in r[1:])) for r in out.collect()} == want
