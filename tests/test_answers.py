"""Scores, contracts and text forms against the known values of the blueprint's fixtures and against plain Python."""

import itertools
import json
import random

import pytest
from pyspark.sql import functions as F

from ferrule.functions import answers, labels, numbers, text
from ferrule.operators import contracts, scoring


def one(spark, column, **values):
    df = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} {v}" for k, v in zip(values, _kinds(values.values()), strict=True)))
    return df.select(column.alias("x")).first().x


def _kinds(values):
    return ["array<string>" if isinstance(v, list) else "boolean" if isinstance(v, bool) else "long" if isinstance(v, int) else "double" if isinstance(v, float) else "string" for v in values]


def test_report_of_the_fixture(spark):
    rows = [("new york", ["New York"], "text", "single-hop", ["doc-a"], ["doc-a", "doc-x"]), ("2", ["2"], "table", "multi-hop", ["doc-b", "doc-c"], ["doc-b", "doc-x"]),
            ("red", ["red", "blue"], "image", "single-hop", ["doc-d"], ["doc-d"]), ("wrong", ["answer"], "text", "multi-hop", ["doc-e"], ["doc-x"])]
    df = spark.createDataFrame(rows, "p string, g array<string>, modality string, hop string, support array<string>, pages array<string>")
    s = df.withColumn("em", answers.list_em(F.array("p"), F.col("g"))).withColumn("f1", answers.list_f1(F.array("p"), F.col("g")))
    out = {(r.modality, r.hop): (r.em, r.f1) for r in scoring.sliced_report(s, ["modality", "hop"]).collect()}
    assert out[None, None] == (50.0, 62.5) and out["image", None] == (0.0, 50.0) and out[None, "single-hop"][0] == out[None, "multi-hop"][0] == 50.0


@pytest.mark.parametrize(("p", "g", "em", "f1"), [
    ("red blue", "blue red", 0, 1.0), ("red red", "red", 0, 1.0), ("2 apples", "3 apples", 0, 0.0), ("2", "2.0", 1, 1.0), ("the twenty-five", "20 5", 1, 1.0),
    ("Ünder-the sea!", "ünder sea", 1, 1.0), ("", "x", 0, 0.0), ("a", "", 1, 1.0), ("1e3", "thousand", 1, 1.0), ("1,000", "1000", 1, 1.0), ("12d", "12", 0, 0.0), ("one two", "1 3", 0, 0.5),
])
def test_single_answers(spark, p, g, em, f1):
    assert one(spark, F.struct(answers.text_em(F.col("p"), F.col("g")), answers.text_f1(F.col("p"), F.col("g"))), p=p, g=g)[:] == (em, f1)
    assert one(spark, F.struct(answers.list_em(F.array("p"), F.array("g")), answers.list_f1(F.array("p"), F.array("g"))), p=p, g=g)[:] == (em, f1)


def test_float_texts(spark):
    values = ["0", "-0", "7", "1e7", "12345678.5", "0.0001", "0.00001", "1e16", "123456789012345678", "-2.50", "1_000", ".5", "1e-7", "9999999", "-inf", "nan", "+3"]
    df = spark.createDataFrame([(v,) for v in values], "v string").coalesce(1)
    assert [r.x for r in df.select(answers.float_text(F.col("v")).alias("x")).collect()] == [str(float(v)) for v in values]


def test_lists_take_the_best_assignment(spark):
    rng = random.Random(1)
    rows = [([" ".join(rng.choices("abcdefgh", k=rng.randrange(1, 4))) for _ in range(rng.randrange(5))] for _ in "pg") for _ in range(60)]
    rows = [tuple(r) for r in rows]

    def f1(p, g):
        bags = [[set(x.replace("a", "").split()) for x in side] for side in (p, g)]
        score = lambda a, b: 2 * x * y / (x + y) if (x := len(a & b) / len(a) if a else 1.0) + (y := len(a & b) / len(b) if b else 1.0) else 0.0
        small, large = sorted(bags, key=len)
        if not large:
            return 0.0
        flip = len(bags[0]) > len(bags[1])
        best = max((sum((score(large[j], small[i]) if flip else score(small[i], large[j])) for i, j in enumerate(c)) for c in itertools.permutations(range(len(large)), len(small))), default=0)
        return best / len(large)

    df = spark.createDataFrame(rows, "p array<string>, g array<string>").coalesce(1)
    out = [r.x for r in df.select(answers.list_f1(F.col("p"), F.col("g")).alias("x")).collect()]
    assert all(abs(a - f1(*r)) <= 0.005 + 1e-9 for a, r in zip(out, rows, strict=True))
    with pytest.raises(Exception, match="too many"):
        one(spark, answers.list_f1(F.col("p"), F.array(F.lit("x"))), p=["x"] * 21)


def test_prediction_shapes(spark):
    shapes = {'["a", "b"]': ["a", "b"], "plain": ["plain"], '[{"a": 1}]': ['[{"a": 1}]'], "[broken": ["[broken"], "[1, 2]": ["1", "2"]}
    for said, spans in shapes.items():
        assert one(spark, answers.prediction_spans(F.col("p")), p=said) == spans


@pytest.mark.parametrize(("answer", "contract", "status"), [
    ("The  Moon.", {"kind": "scalar", "items": [{"canonical": "the moon", "aliases": ["Luna"]}]}, "correct"),
    ("LUNA", {"kind": "scalar", "items": [{"canonical": "the moon", "aliases": ["Luna"]}]}, "correct"),
    ("sun", {"kind": "scalar", "items": [{"canonical": "moon"}], "closed_domain": ["Sun"]}, "incorrect"),
    ("star", {"kind": "scalar", "items": [{"canonical": "moon"}], "closed_domain": ["Sun"]}, "review"),
    ("12.4 km", {"kind": "number", "items": [{"canonical": "12 km"}], "unit": "km", "numeric_value": "12", "absolute_tolerance": "0.5"}, "correct"),
    ("13 km", {"kind": "number", "items": [{"canonical": "12 km"}], "unit": "km", "numeric_value": "12", "absolute_tolerance": "0.5"}, "incorrect"),
    ("12", {"kind": "number", "items": [{"canonical": "12 km"}], "unit": "km", "numeric_value": "12"}, "review"),
    ("1,200 km", {"kind": "number", "items": [{"canonical": "12 km"}], "unit": "km", "numeric_value": "12"}, "review"),
    ('["b", "A"]', {"kind": "set", "items": [{"canonical": "a"}, {"canonical": "b"}]}, "correct"),
    ('["b", "A"]', {"kind": "ordered", "items": [{"canonical": "a"}, {"canonical": "b"}]}, "incorrect"),
    ("a; b", {"kind": "ordered", "items": [{"canonical": "a"}, {"canonical": " b"}], "separator": ";"}, "correct"),
    ("a, c", {"kind": "set", "items": [{"canonical": "a"}, {"canonical": "b"}], "separator": ","}, "review"),
    ("both", {"kind": "set", "items": [{"canonical": "a"}, {"canonical": "b"}], "accepted_complete": ["Both"]}, "correct"),
    ("none", {"kind": "set", "items": [{"canonical": "a"}], "rejected_complete": ["None"]}, "incorrect"),
])
def test_contracts(spark, answer, contract, status):
    assert one(spark, contracts.score(F.col("a"), F.col("c")), a=answer, c=json.dumps(contract)).status == status


def test_inconsistent_contracts():
    for bad in ({"kind": "x"}, {"kind": "set", "items": []}, {"kind": "scalar", "items": [{"canonical": "a"}, {"canonical": "b"}]}, {"kind": "set", "items": [{"canonical": "a", "aliases": ["b"]}, {"canonical": "b"}]}, {"kind": "set", "items": [{"canonical": "a"}], "rejected_complete": ["A"]}):
        with pytest.raises(ValueError):
            contracts.Contract(bad)


def test_texts_labels_and_numbers(spark):
    assert one(spark, text.surface(F.col("a")), a="  “É’s   Straße.”. ") == '"é\'s strasse."'
    assert one(spark, text.letters_only(F.col("a")), a="Ａb[12] c-ﬁ") == "abcfi"
    assert one(spark, text.words_only(F.col("a")), a="Él vio_2 a—b") == "él vio_2 a b"
    assert one(spark, text.url_title(F.col("a")), a="https://EN.x.org/wiki/Caf%C3%A9_a+b?q") == "/wiki/café a+b"
    assert one(spark, text.page_of(F.col("a")), a="a_page1_page12")[:] == ("a_page1", 12) and one(spark, text.page_of(F.col("a")), a="a_page") is None
    assert one(spark, text.redacted(F.col("a"), "hidden"), a="key sk-abcdef123456 and hidden") == "key [redacted] and [redacted]"
    with pytest.raises(Exception, match="several modalities"):
        one(spark, labels.modality(F.col("m")), m=["text", "table"])
    assert one(spark, labels.modality(F.col("m")), m=["text", "text"]) == "text" and one(spark, labels.modality(F.array().cast("array<string>")), a="x") == "unknown"
    assert [one(spark, labels.scalar_text(F.col("a")), a=a) for a in ("true", "null", "x")] == ["True", "None", "x"]
    assert one(spark, labels.interval_label(F.lit(-0.5), F.lit(0.5), F.lit(-0.9), F.lit(0.9)), a="") == "equivalent"
    assert one(spark, numbers.softplus(F.col("a")), a=800.0) == 800.0 and abs(one(spark, numbers.sequence_logit(F.col("a")), a=-1e-12) - 27.631021) < 1e-3
    assert one(spark, numbers.packed_bits(F.array(F.lit(True), F.lit(False), F.lit(True))), a="") == 5
