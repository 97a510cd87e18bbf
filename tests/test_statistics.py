"""Selection, inference, surrogates and cohorts against enumeration, numpy and their laws."""

import itertools
import random
from collections import Counter, defaultdict

import numpy as np
from pyspark.sql import functions as F

from ferrule.operators import cohorts, inference, integrity, raster, selection, surrogates, vectors


def test_extreme_subsets_equal_enumeration():
    rng = random.Random(4)
    for _ in range(80):
        n, budget = rng.randrange(1, 8), rng.randrange(1, 25)
        ids, costs, scores = rng.sample(range(40), n), [rng.randrange(1, 9) for _ in range(n)], [float(rng.randrange(-3, 4)) for _ in range(n)]
        sets = [p for k in range(n + 1) for p in itertools.combinations(range(n), k) if sum(costs[i] for i in p) <= budget]
        goal = max(sum(costs[i] for i in p) for p in sets)
        assert selection.achievable(costs, budget) == goal
        full = [(sum(scores[i] for i in p), sorted(ids[i] for i in p)) for p in sets if sum(costs[i] for i in p) == goal]
        best, worst = min(full, key=lambda x: (-x[0], x[1]))[1], min(full)[1]
        assert selection.extreme_subsets(ids, costs, scores, budget) == (best, worst)


def test_samples_have_the_cost_and_the_law():
    costs, budget = [2, 2, 3, 1, 4], 6
    sets = [tuple(i in p for i in range(5)) for k in range(6) for p in itertools.combinations(range(5), k) if sum(costs[i] for i in p) == 6]
    for tilts in (None, [0.5, -0.5, 1.0, 0.0, 0.3]):
        n = 6000
        found = Counter(tuple(selection.sampled_subset(costs, budget, f"s{k}", tilts)) for k in range(n))
        weights = {s: np.exp(sum(t for t, x in zip(tilts or [0] * 5, s, strict=True) if x)) for s in sets}
        assert set(found) == set(sets)
        assert all(abs(found[s] / n - weights[s] / sum(weights.values())) < 0.03 for s in sets)
    assert selection.sampled_subset(costs, budget, "a") == selection.sampled_subset(costs, budget, "a")


def test_arms_pages_and_units(spark):
    rows = [(q, i, (i * 7 + q) % 5 + 1, float((i * 13 + q) % 11)) for q in range(3) for i in range(9)]
    arms = selection.arms(spark.createDataFrame(rows, "q int, i int, c int, s double"), "q", "i", "c", "s", (0.75, 0.5), "x").collect()
    cost = {(q, i): c for q, i, c, _ in rows}
    for q in range(3):
        total = sum(c for (p, _), c in cost.items() if p == q)
        for arm, share in (("whole", 1), ("best 0.75", 0.75), ("random 0.5", 0.5)):
            mine = [r for r in arms if r.g == q and r.arm == arm]
            assert len(mine) == 9 and sum(cost[q, r.i] for r in mine if r.kept) <= share * total
        left = int(total * 0.5)
        for _, i, c, _ in sorted((r for r in rows if r[0] == q), key=lambda r: (-r[3], r[1])):
            kept = next(r.kept for r in arms if (r.g, r.arm, r.i) == (q, "best 0.5", i))
            assert kept == (c <= left)
            left -= c if kept else 0
    regions = [(0, k % 2, "text", k, 1 + k % 3, float(k)) for k in range(30)]
    units = {r.region: r.unit for r in selection.exchange_groups(spark.createDataFrame(regions, "page int, tile int, kind string, region int, cost int, priority double"), 0.1).collect()}
    assert len(units) == 30 and all(units[k] == f"r{k}" for k in range(25, 30))
    sizes = defaultdict(int)
    for k, u in units.items():
        sizes[u] += 1 + k % 3
    assert all(v <= 0.1 * sum(1 + k % 3 for k in range(30)) for u, v in sizes.items() if u.startswith("p"))


def test_bootstraps_have_the_right_spread(spark):
    rng = np.random.default_rng(3)
    x = rng.standard_normal(400)
    df = spark.createDataFrame([(int(k), int(k) // 4, float(v), [float(v)]) for k, v in enumerate(x)], "u int, c int, v double, r array<double>")
    b = inference.paired_bootstrap(df, "u", "v", 300, "s").first()
    error = x.std() / 20
    assert abs(b.high - b.low - 3.92 * error) < 0.6 * error and b.low < x.mean() < b.high and b.low <= b.lower
    nested = inference.interval(inference.nested_bootstrap(df.withColumn("v", F.col("v") * 2), "u", "c", "v", "r", 200, "n"), 0.05, 0.95).first()
    assert nested.low < x.mean() < nested.high
    bounds = inference.simultaneous_bounds(df.withColumn("w", F.col("v") + 1), "c", ["v", "w"], 200, "b").collect()
    assert [r.boundary for r in sorted(bounds, key=lambda r: r.place)] == ["v", "w"] and all(r.lower < r.estimate for r in bounds)
    assert np.isclose(bounds[0].estimate - bounds[0].lower, bounds[1].estimate - bounds[1].lower)


def test_power_search():
    n = inference.equivalence_size(10.0, 2.0)
    assert n == next(k for k in range(1, 2000) if _power(10.0, 2.0, k) >= 0.8) and inference.equivalence_size(10.0, 1e-9) is None


def _power(spread, margin, n):
    from statistics import NormalDist

    z, e = NormalDist().inv_cdf(0.95), spread / n**0.5
    return 2 * NormalDist().cdf(margin / e - z) - 1


def test_surrogates(spark):
    rng = np.random.default_rng(5)
    x = (rng.random((200, 6)) < 0.5).astype(float)
    y = 2 * x[:, 1] - 3 * x[:, 4] + 0.01 * rng.standard_normal(200) + 7
    w, b = surrogates.lasso(x, y, 0.01)
    z = (x - x.mean(0)) / x.std(0)
    gradient = z.T @ (y - x @ w - b) / len(y)
    scaled = w * x.std(0)
    assert np.all(np.abs(gradient[scaled == 0]) <= 0.01 + 1e-6) and np.allclose(gradient[scaled != 0], 0.01 * np.sign(scaled[scaled != 0]), atol=1e-6)
    assert surrogates.pursuit(x, y)[0][:2] == [4, 1]
    r, c = surrogates.ridge(x, y)
    a = np.column_stack([x, np.ones(len(y))])
    plain = np.linalg.solve(a.T @ a + np.diag([1.0] * 6 + [0]), a.T @ y)
    assert np.allclose(np.append(r, c), plain)
    folds = surrogates.ridge_folds(x, y)
    keep = np.arange(len(y)) % 5 != 2
    assert np.allclose(folds[~keep], x[~keep] @ surrogates.ridge(x[keep], y[keep])[0] + surrogates.ridge(x[keep], y[keep])[1])
    df = spark.createDataFrame([(g, k, (x[k] > 0).tolist(), float(y[k])) for g in (1, 2) for k in range(200)], "group long, row long, mask array<boolean>, y double")
    fits = surrogates.fitted(df).collect()
    assert len(fits) == 12 and np.allclose([f.coefficient for f in sorted(fits, key=lambda f: (f.group, f.feature))][:6], w)
    assert {(p.group, p.step, p.feature) for p in surrogates.pursued(df).collect()} >= {(1, 0, 4), (1, 1, 1), (2, 0, 4)}
    assert all(r.spearman > 0.5 and r.jaccard >= 0.2 for r in surrogates.stability(df, 3).collect())
    p = {r.group: r for r in surrogates.permuted(df.selectExpr("`group`", "y", "y + 0.5 * (row % 3 - 1) z", "y + 1 up"), "group", "y", "up").collect()}
    assert p[1].p < 0.01 and abs(p[1].observed - 1) < 1e-9


def test_pools_and_splits(spark):
    rng = random.Random(6)
    rows = [(k, rng.choice("abc"), k % 20, rng.random() < 0.5, k % 4, f"t {k % 70}") for k in range(150)]
    df = spark.createDataFrame(rows, "k int, kind string, family int, verdict boolean, contexts int, text string")
    pool = cohorts.quota_pool(df, "k", "kind", "family", 45, "p").collect()
    counts, n = Counter(r[1] for r in rows), Counter(r.kind for r in pool)
    assert len(pool) == 45 and all(abs(n[c] - 45 * counts[c] / 150) < 1 for c in counts)
    fresh = [r.family for r in pool if r["pass"] == 1]
    assert len(fresh) == len(set(fresh))
    split = cohorts.balanced_split(df, "k", ["kind", "verdict"], "contexts", "text", 5, "q").collect()
    texts = [r[5] for s in split for r in rows if r[0] == s.k]
    assert max(Counter((s.kind, s.verdict) for s in split).values()) == 5 and len(texts) == len(set(texts))


def test_rasters_equal_numpy(spark):
    rng = np.random.default_rng(7)
    places = sorted(rng.choice(30, 22, replace=False).tolist())
    tokens = [(0, p, float(rng.random())) for p in places]
    out = {(r.gy, r.gx): r.keep for r in raster.relevant_groups(spark.createDataFrame(tokens, "page int, place int, v double"), (6, 5), (8, 10), 0.4, 1.0).collect()}
    dense, valid = np.zeros((6, 5)), np.zeros((6, 5), bool)
    for _, p, v in tokens:
        dense[p // 5, p % 5], valid[p // 5, p % 5] = v, True

    def axis(n, m):
        at = np.maximum((np.arange(m) + 0.5) * n / m - 0.5, 0)
        low = np.minimum(np.floor(at).astype(int), n - 1)
        w = np.zeros((m, n))
        for i in range(m):
            w[i, low[i]] += 1 - (at[i] - low[i])
            w[i, min(low[i] + 1, n - 1)] += at[i] - low[i]
        return w

    big = axis(6, 8) @ dense @ axis(5, 10).T
    k = np.exp(-np.arange(-3, 4) ** 2 / 2)
    k /= k.sum()
    wide = np.pad(big, 3, mode="edge")
    smooth = sum(k[a] * k[b] * wide[a : a + 8, b : b + 10] for a in range(7) for b in range(7))
    near = valid[np.arange(8) * 6 // 8][:, np.arange(10) * 5 // 10]
    good = {(y, x): bool((smooth[2 * y : 2 * y + 2, 2 * x : 2 * x + 2] >= 0.4).any() and near[2 * y : 2 * y + 2, 2 * x : 2 * x + 2].all()) for y in range(4) for x in range(5)}
    assert out == good and set(good.values()) == {True, False}
    assert {r.kind for r in raster.scatter_violations(spark.createDataFrame([(0, 99, 1.0), (0, 3, 1.0), (0, 3, 2.0)], "page int, place int, v double"), 6, 5).collect()} == {"outside", "repeated"}


def test_banks_that_break_rules(spark):
    costs = spark.createDataFrame([(q, r, r + 1) for q in (1, 2) for r in range(3)], "question int, region int, cost int")
    masks = {(1, 0): (1, 1, 0), (1, 1): (0, 0, 1), (2, 0): (1, 1, 0), (2, 1): (1, 1, 0), (2, 2): (1, 0, 0)}
    bank = spark.createDataFrame([(q, m, r, bool(k)) for (q, m), bits in masks.items() for r, k in enumerate(bits)], "question int, mask int, region int, kept boolean")
    budgets = spark.createDataFrame([(1, 3), (2, 3)], "question int, budget int")
    assert {tuple(r) for r in integrity.bank_violations(bank, costs, budgets).collect()} == {(2, "repeated masks"), (2, "not the budget")}


def test_too_few_pages_are_an_error(spark):
    import pytest

    scores = spark.createDataFrame([(1, 5, 0.5), (1, 6, 0.7), (2, 5, 0.1)], "q int, page int, score double")
    assert [(r.page, r.page_rank) for r in vectors.top_pages(scores.where("q = 1"), 2).collect()] == [(6, 0), (5, 1)]
    with pytest.raises(Exception, match="too few pages"):
        vectors.top_pages(scores, 2).collect()
