"""Evidence, pictures, banks, controllers and what users plug in."""

import json
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from ferrule import extension
from ferrule.functions import answers
from ferrule.operators import banks, evidence, graph, inference, integrity, metrics, policies, scoring


def test_evidence_prefers_retrieved_pages(spark):
    text = "The quick brown fox jumps over the lazy dog at noon"
    pages = spark.createDataFrame([("d", 0, "A Title here"), ("d", 1, f"x {text[:30]}"), ("d", 2, f"{text[30:]} y"), ("d", 3, f"{text} again"), ("e", 0, "No title"), ("e", 1, text)], "document string, page int, text string")
    passages = spark.createDataFrame([("q1", "d", "a title", text), ("q2", "d", "a title", "something that is nowhere in the pages"), ("q3", "e", "a title", text)], "question string, document string, title string, text string")
    seen = spark.createDataFrame([("q1", "d", 0), ("q1", "d", 3)], "question string, document string, page int")
    out = {r.question: (r.status, r.found, r.missing) for r in evidence.located(passages, pages, seen).collect()}
    assert out == {"q1": ("present", [0, 3], []), "q2": ("unresolved", None, None), "q3": ("unresolved", None, None)}
    none = {r.question: (r.status, r.missing) for r in evidence.located(passages, pages, seen.limit(0)).collect()}
    assert none["q1"] == ("missing", [0, 3])


def test_pictures(spark):
    rng = np.random.default_rng(1)
    s = rng.integers(0, 256, (70, 100, 3)).astype(np.uint8)
    near = np.clip(s.astype(int) + 1, 0, 255).astype(np.uint8)
    others = {1: s, 2: np.rot90(s), 3: near, 4: rng.integers(0, 256, (70, 100, 3)).astype(np.uint8), 5: s[:, :60]}
    rows = [(0, k, 70, 100, s.tobytes(), c.shape[0], c.shape[1], np.ascontiguousarray(c).tobytes()) for k, c in others.items()]
    df = spark.createDataFrame([tuple(bytearray(x) if isinstance(x, bytes) else x for x in r) for r in rows], "source long, candidate long, s_height int, s_width int, s_rgb binary, c_height int, c_width int, c_rgb binary")
    out = {r.candidate: (r.rotation, r.status) for r in evidence.matched_pictures(df).collect()}
    assert out[1] == (0, "exact") and out[2] == (270, "exact") and out[3] == (0, "near") and out[4][1] == "none" and out[5] == (None, "none")


def test_banks_cost_the_same():
    rng = random.Random(2)
    costs, priority = [rng.randrange(1, 9) for _ in range(24)], [rng.random() for _ in range(24)]
    made = banks.bank(costs, priority, "case")
    assert made == banks.bank(costs, priority, "case") and len({m for *_, m in made}) == len(made) == 32
    assert len({sum(c for c, x in zip(costs, m, strict=True) if x) for *_, m in made}) == 1
    mean = {f: np.mean([np.dot(m, priority) for g, _, m in made if g == f]) for f in ("positive", "negative")}
    assert mean["positive"] > mean["negative"]
    shared = [m for f, _, m in made if f == "shared"]
    assert all(0 < sum(a != b for a, b in zip(shared[base], m, strict=True)) for f, base, m in made if f == "local")


def test_the_controller_learns():
    costs, history, kinds = [1] * 16, [], []
    while step := banks.next_masks(costs, history, "c"):
        assert step == banks.next_masks(costs, history, "c")
        kinds += [k for k, _ in step]
        history += [(m, float(sum(m[:4]))) for _, m in step]
    assert kinds == ["seed"] * 8 + (["broad"] * 4 + ["focus"] * 4) * 3 and len({m for m, _ in history}) == 32
    score = {k: np.mean([s for (x, (_, s)) in zip(kinds, history, strict=True) if x == k]) for k in set(kinds)}
    assert score["focus"] > score["broad"]


def test_policy_names_are_closed(spark):
    df = spark.createDataFrame([(1, 0, 0, 0.5, 0.5)], "q int, page int, token int, literal double, aggregate double")
    with pytest.raises(ValueError):
        policies.selected(df, ["q"], ["other"], 0.5, "s")


class Parts:
    def retrieve(self, questions, k):
        return questions.select("question", F.lit("d").alias("document"), F.lit(0).alias("page"), F.lit(1.0).alias("score"))

    def load(self, pages):
        return pages.withColumn("content", F.concat(F.lit("The answer to "), "question"))

    def answer(self, questions, pages):
        return pages.select("question", F.regexp_extract("content", r"(\w+)$", 1).alias("answer"))


def test_parts_are_plugged_in(spark, tmp_path):
    parts = Parts()
    assert all(isinstance(parts, p) for p in (extension.Retriever, extension.PageLoader, extension.Answerer)) and not isinstance(3, extension.Retriever)
    q = spark.createDataFrame([("one", "One"), ("two", "three")], "question string, gold string")
    out = {r.question: r.correct for r in extension.answered(q, parts, parts, parts, 1, answers.text_em).collect()}
    assert out == {"one": 1.0, "two": 0.0}
    assert extension.load("math:sqrt")(9) == 3 and extension.call(lambda a, b=2: a + b, a=1, c=9) == 3 and extension.call(lambda **k: k, a=1) == {"a": 1}
    with pytest.raises(ValueError):
        extension.load("math")

    @extension.workload("count")
    def count(spark, n):
        return spark.range(n)

    assert extension.run(spark, "count", n=3, other=1).count() == 3
    with pytest.raises(ValueError):
        extension.workload("count")(count)
    asked = []

    def ask(rows):
        asked.append(rows.count())
        return rows.select("digest", F.lit("correct").alias("verdict"))

    for _ in range(2):
        assert {r.verdict for r in extension.judged(q, ask, str(tmp_path / "v"), ["question", "gold"]).collect()} == {"correct"}
    assert asked == [2, 0]
    made = []
    for _ in range(2):
        assert extension.remembered(spark, str(tmp_path / "r"), "id", lambda: made.append(1) or spark.range(2)).count() == 2
    assert made == [1]


def test_metrics_straight_from_files(spark, tmp_path):
    row = {"policy": "a", "original": 10, "post_btp": 8, "post_qtp": 6, "post_ctp": 5, **{t: 1.0 for t in metrics.TIMES}, "peak_bytes": 7, "warmup_excluded": True, "profiler_enabled": False, "flops": None}
    (tmp_path / "r.jsonl").write_text("\n".join(["", json.dumps(row), "  ", json.dumps(row | {"policy": "b", "original": 20}), json.dumps(row), ""]))
    out = {r.policy: r for r in metrics.metrics_of_files(spark, str(tmp_path / "r.jsonl"), {"policy": "string"}).collect()}
    assert (out["a"].samples, out["a"].original, out["b"].original) == (2, 20.0, 20.0) and abs(out["a"].mean_drop_btp - 0.2) < 1e-12
    assert metrics.metrics_of_files(spark, str(tmp_path / "r.jsonl"), {}).first().samples == 3


def test_depth_of_retrieval(spark):
    df = spark.createDataFrame([(1, [1, 2, 2]), (2, None), (3, [])], "k int, r array<int>")
    assert scoring.retrieval_depth(df, "r").first().depth == 3 and scoring.retrieval_depth(df.limit(0), "r").first().depth == 0


def test_arms_that_do_not_pair(spark):
    a = spark.createDataFrame([(1, "f"), (2, "f"), (2, "f"), (3, None), (4, "g"), (None, "f")], "k int, family string")
    b = spark.createDataFrame([(1, "f"), (2, "f"), (3, None), (4, "h"), (5, "f"), (5, "x")], "k int, family string")
    got = {tuple(r) for r in integrity.arm_violations(a, b, "k", "family").collect()}
    assert got == {(2, "repeated in first", 2), (4, "families differ", 2), (5, "only in second", 2), (5, "repeated in second", 2), (None, "only in first", 1)}
    assert integrity.arm_violations(a.where("k = 1"), b.where("k = 1"), "k").count() == 0


def test_sizes_of_each_spread(spark):
    df = spark.createDataFrame([(10.0,), (None,), (0.0,), (1e9,)], "s double")
    assert [r.n for r in df.coalesce(1).select(inference.equivalence_sizes(F.col("s"), 2.0).alias("n")).collect()] == [inference.equivalence_size(10.0, 2.0), None, None, None]


def test_components_of_paths_stars_and_chance(spark):
    draw = random.Random(5)
    edges = [(k, k + 1) for k in range(1000, 1300)] + [(5000, k) for k in range(5001, 5200)] + [(draw.randrange(400), draw.randrange(400)) for _ in range(260)] + [(7, 7), (9999, 9999)]
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    df = spark.createDataFrame([*edges, (None, 3), (4, None)], "a long, b long").repartition(3)
    assert {r.id: r.component for r in graph.components(df).collect()} == {k: find(k) for k in parent}
    assert graph.components(df.limit(0)).count() == 0
