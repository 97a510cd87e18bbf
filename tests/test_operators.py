import itertools
import random

from pyspark.sql import functions as F

from ferrule.operators import containment, graph, ranking, scoring, selection, spatial
from ferrule.plans import registry


def test_scores(spark):
    rows = [("new york", "New York"), ("2", "2"), ("the red", "red"), ("", "x"), (None, "")]
    out = scoring.scored(spark.createDataFrame(rows, "p string, g string"), "p", "g").collect()
    assert [(r.em, r.f1) for r in out] == [(1, 1), (1, 1), (1, 1), (0, 0), (1, 1)]


def test_recall_cuts_before_it_drops_repeats(spark):
    df = spark.createDataFrame([(["a", "a", "b"], ["a", "b"]), ([], [])], "r array<string>, g array<string>")
    out = df.select(*[scoring.recall_at(F.col("r"), F.col("g"), k).alias(f"r{k}") for k in (1, 2, 3)]).collect()
    assert [tuple(r) for r in out] == [(0.5, 0.5, 1.0), (0, 0, 0)]


def test_top_m_breaks_ties_by_id(spark):
    df = spark.createDataFrame([(1, 0, 0.2), (1, 1, 0.9), (1, 2, 0.9), (1, 3, -0.1)], "g int, id int, s double")
    assert {r.id for r in ranking.top_m(df, ["g"], "s", ["id"], 2).collect()} == {1, 2}


def test_greedy_prefix_skips(spark):
    df = spark.createDataFrame([([(1, 5), (2, 9), (3, 4)],)], "items array<struct<id: bigint, cost: bigint>>")
    assert df.select(ranking.greedy_prefix(F.col("items"), 10)).first()[0] == [1, 3]


def test_holm_is_monotone(spark):
    df = spark.createDataFrame([(1, "a", 0.01), (1, "b", 0.04), (1, "c", 0.03)], "g int, l string, p double")
    out = {r.l: round(r.adjusted, 9) for r in ranking.holm(df, ["g"], "p", "l").collect()}
    assert out == {"a": 0.03, "c": 0.06, "b": 0.06}


def test_components_and_owners(spark):
    e = spark.createDataFrame([(1, 2), (2, 3), (7, 8)], "a long, b long")
    assert {(r.id, r.component) for r in graph.components(e).collect()} == {(1, 1), (2, 1), (3, 1), (7, 7), (8, 7)}
    t = spark.createDataFrame([(0, 1, 0, 0, 4, 4), (0, 2, 50, 50, 54, 54)], "page int, token int, tx0 int, ty0 int, tx1 int, ty1 int")
    r = spark.createDataFrame([(0, 9, 0, 0, 3, 3), (0, 8, 0, 0, 20, 20)], "page int, region int, rx0 int, ry0 int, rx1 int, ry1 int")
    assert {(x.token, x.region, x.area) for x in spatial.owners(t, r).collect()} == {(1, 8, 16), (2, None, None)}


def test_best_subset_equals_enumeration():
    rng = random.Random(2)
    for _ in range(60):
        n, budget = rng.randrange(7), rng.randrange(25)
        costs, scores = [rng.randrange(1, 12) for _ in range(n)], [float(rng.randrange(-5, 9)) for _ in range(n)]
        subsets = [p for k in range(n + 1) for p in itertools.combinations(range(n), k) if sum(costs[i] for i in p) <= budget]
        most = max(sum(costs[i] for i in p) for p in subsets)
        spent, places = selection.best_subset(costs, scores, budget)
        assert spent == most == sum(costs[i] for i in places)
        assert sum(scores[i] for i in places) == max(sum(scores[i] for i in p) for p in subsets if sum(costs[i] for i in p) == most)


def test_additive_score(spark):
    df = spark.createDataFrame([([True, False, True], [1.0, 2.0, 4.0]), ([], [])], "m array<boolean>, s array<double>")
    assert [r[0] for r in df.select(selection.additive_score(F.col("m"), F.col("s"))).collect()] == [5.0, 0.0]


def test_windows_are_minimal(spark):
    pages = spark.createDataFrame([(1, k, t) for k, t in enumerate(["aaaa the long passage that", "goes over two pages here", "zzz", "the long passage that goes over all"])], "doc int, page int, text string")
    needles = spark.createDataFrame([(1, 0, "the long passage that goes over"), (1, 1, "zzz"), (1, 2, "no such passage is anywhere in it")], "doc int, passage int, needle string")
    assert {(r.passage, r.first, r.last) for r in containment.minimal_windows(pages, needles).collect()} == {(0, 0, 1), (0, 3, 3)}


def test_queries_over_whole_tables(spark, tmp_path):
    rng = random.Random(3)
    lines = [(k, n, rng.randrange(40), rng.randrange(30)) for k in range(100, 130) for n in range(1, 1 + rng.randrange(1, 4))]
    orders = [(k, rng.choice("FO")) for k in range(100, 135)]
    vecs = [(k, [rng.gauss(0, 1) for _ in range(4)], k % 3) for k in range(100)]
    spark.createDataFrame(lines, "l_orderkey long, l_linenumber int, l_partkey long, l_suppkey long").write.parquet(f"{tmp_path}/lineitem.parquet")
    spark.createDataFrame(orders, "o_orderkey long, o_orderstatus string").write.parquet(f"{tmp_path}/orders.parquet")
    spark.createDataFrame(vecs, "vec_id long, embedding array<double>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    run = lambda name: registry.QUERIES[name](spark, str(tmp_path)).collect()

    label = {x: x for k, _, p, _ in lines for x in (2 * k, 2 * p + 1)}
    for k, _, p, _ in lines:
        low, high = sorted((label[2 * k], label[2 * p + 1]))
        label = {x: low if v == high else v for x, v in label.items()}
    assert {(r.id, r.component) for r in run("shared_components")} == set(label.items())

    places = [(k + (1_000_000 if k % 50 == 7 else 0), k + (2 if k % 30 == 3 else 1)) for k, *_ in lines]
    good = {("missing", k) for k, _ in orders if k not in dict(places)} | {("unexpected", k) for k, _ in places if k >= 1_000_000}
    good |= {("repeated", k) for k, _ in places if [x for x, _ in places].count(k) > 1} | {("moved", k) for k, p in places if k < 1_000_000 and p != k + 1}
    assert sorted(tuple(r) for r in run("key_reconciliation")) == sorted(good)

    dot = lambda a, b: sum(x * y for x, y in zip(a, b, strict=True))
    top = {(t, i) for t, q, _ in vecs if t % 20 == 0 for i, *_ in sorted(vecs, key=lambda v: -dot(q, v[1]))[:4]}
    assert {(r.t, r.id) for r in run("token_knn")} == top and len(top) == 20
    best = {}
    for t, q, label_ in vecs:
        for i, v, _ in vecs if t % 20 == 0 else ():
            best[label_, t, i // 5, (t, i) in top] = max(best.get((label_, t, i // 5, (t, i) in top), -9e9), dot(q, v))
    for name, hits in (("indexed_maxsim", (True,)), ("full_maxsim", (True, False))):
        most, sums = {}, {}
        for (q, t, page, hit), s in best.items():
            if hit in hits:
                most[q, t, page] = max(most.get((q, t, page), -9e9), s)
        for (q, _, page), s in most.items():
            sums[q, page] = sums.get((q, page), 0) + s
        out = {(r.q, r.page): r.score for r in run(name)}
        assert set(out) == set(sums) and all(abs(out[k] - sums[k]) < 1e-5 for k in sums)
    cosines = {i: sum(dot(q, v) / (dot(q, q) * dot(v, v)) ** 0.5 for t, q, _ in vecs if t % 20 == 0) for i, v, _ in vecs}
    out = {r.vec_id: r.relevance for r in run("cosine_relevance")}
    assert set(out) == set(cosines) and all(abs(out[i] - cosines[i]) < 1e-5 for i in cosines)
