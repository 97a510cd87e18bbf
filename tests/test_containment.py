"""Passages in windows of pages: against every window, and at the length of a long document."""

import random

import pytest
from ferrule.operators import containment
from pyspark.sql import functions as F


def plain(pages, passages, between):
    docs, out = {}, set()
    for doc, page, text in sorted(pages, key=lambda r: (r[0], r[1])):
        docs.setdefault(doc, []).append((page, text or ""))
    for doc, passage, needle in passages:
        if needle is None or len(needle) < 24:
            continue
        own, hits = docs.get(doc, []), []
        for size in range(1, 4):
            for a in range(len(own) - size + 1):
                if needle in between.join(t for _, t in own[a : a + size]) and not any(a <= x and y <= a + size - 1 for x, y in hits):
                    hits.append((a, a + size - 1))
        out |= {(doc, passage, own[a][0], own[b][0]) for a, b in hits}
    return out


@pytest.mark.parametrize("between", ["", " "])
def test_minimal_windows_are_those_of_every_window(spark, between):
    draw = random.Random(1)
    pages, passages = [], []
    for doc in range(40):
        texts = []
        for _ in range(draw.randrange(1, 9)):
            kind = draw.randrange(6)
            texts.append(None if kind == 0 else "" if kind == 1 else "".join(draw.choices("ab" if kind < 4 else "abcdé日", k=draw.randrange(1, 60))))
        if doc % 5 == 0:
            texts += texts  # the same pages again
        numbers = sorted(draw.sample(range(50), len(texts)))
        pages += [(doc, n, t) for n, t in zip(numbers, texts, strict=True)]
        for k in range(30):
            whole = between.join(t or "" for t in texts)
            at = draw.randrange(len(whole) + 1)
            passages.append((doc, k, whole[at : at + draw.choice([10, 23, 24, 25, 40, 90])]))
        passages += [(doc, 100, "never to be found on any page at all"), (doc, 101, None), (doc, 102, "")]
    p = spark.createDataFrame(pages, "doc long, page int, text string").repartition(4)
    n = spark.createDataFrame(passages + passages[:50], "doc long, passage long, needle string")
    got = {tuple(r) for r in containment.minimal_windows(p, n, between=between).collect()}
    assert got == plain(pages, passages, between)
    assert containment.minimal_windows(p.limit(0), n, between=between).count() == 0
    assert containment.minimal_windows(p, n.limit(0), between=between).count() == 0


def test_short_passages_are_refused(spark):
    with pytest.raises(ValueError):
        containment.minimal_windows(spark.createDataFrame([], "doc long, page int, text string"), spark.createDataFrame([], "doc long, passage long, needle string"), least=10)


def test_places_of_a_long_document_grow_with_its_text(spark):
    """20,000 pages under one running title, and 20,000 passages that begin with it."""
    words = F.concat_ws(" ", *[F.substring(F.sha2(F.concat_ws("-", "id", F.lit(k)), 256), 1, 9) for k in range(20)])
    pages = spark.range(20_000, numPartitions=4).select(F.lit(1).cast("long").alias("doc"), F.col("id").cast("int").alias("page"), F.concat(F.lit("a title that stands on every page of it "), words).alias("text"))
    passages = pages.select("doc", F.col("page").cast("long").alias("passage"), F.substring("text", 1, 120).alias("needle"))
    assert containment.candidates(pages, passages).count() < 5 * 20_000
    out = containment.minimal_windows(pages, passages)
    assert out.agg(F.count("*"), F.count_if((F.col("first") == F.col("passage")) & (F.col("last") == F.col("passage")))).first() == (20_000, 20_000)
