"""Operators held against plain versions of themselves, edge cases of every operator, and the pipeline stage by stage."""

import itertools
import random
import re
from collections import Counter

import numpy as np
import pytest

import corpus_pipeline
from ferrule.llm import _common, bpe, decontaminate, embedding_dedup, html_text, licenses, ngram_join, quality, substring_dedup, toxicity, warc

DOC = "doc_id long, text string, lang string, source string, n_chars long"
CLASH = DOC + ", id string, key string, h string, rep string, block string, label int, part int, score double, spans string, words string, item string"


def words(rng, n, pool=400):
    return [f"w{rng.randrange(pool)}" for _ in range(n)]


def docs_of(spark, texts, schema=DOC):
    extra = tuple(["x"] * 5 + [1, 2, 0.5] + ["y"] * 3) if schema == CLASH else ()
    return spark.createDataFrame([(i, t, "en", "s", len(t or ""), *extra) for i, t in texts], schema)


def test_automaton_equals_naive_search():
    rng = random.Random(1)
    letters = "abcde"
    for _ in range(200):
        lexicon = {"".join(rng.choices(letters, k=rng.randrange(1, 4))) + rng.choice(["", "*"]): float(rng.randrange(1, 9)) for _ in range(4)}
        exceptions = tuple(" ".join("".join(rng.choices(letters, k=rng.randrange(1, 3))) for _ in range(2)) for _ in range(2))
        text = " ".join("".join(rng.choices(letters, k=rng.randrange(1, 4))) for _ in range(rng.randrange(12)))
        w = text.split()
        safe = {i + d for e in exceptions for i in range(len(w) - 1) if w[i : i + 2] == e.split() for d in (0, 1)}
        total = sum(max((v for e, v in lexicon.items() if (x.startswith(e[:-1]) if e.endswith("*") else x == e)), default=0) for i, x in enumerate(w) if i not in safe)
        assert toxicity.Lexicon(lexicon, exceptions).measure(text) == (total, len(w))


def test_exceptions_are_learned_from_clean_rows(spark):
    rng = random.Random(2)
    rows = [(" ".join([*words(rng, 9), "grobnik", "harvest", *words(rng, 9)]), 0) for _ in range(30)] + [(" ".join([*words(rng, 9), "grobnik", *words(rng, 9)]), 1) for _ in range(30)]
    found = toxicity.learn_exceptions(spark.createDataFrame(rows, "text string, y int"), {"grobnik": 3.0})
    assert found == ("grobnik harvest",)


def test_scores_equal_a_plain_discriminant():
    rng = np.random.default_rng(3)
    x = np.concatenate([rng.standard_normal((80, 4)), rng.standard_normal((50, 4)) @ rng.standard_normal((4, 4)) + 1])
    y = np.repeat([0, 1], [80, 50])
    model = quality.Discriminant.fit(x, y)
    z = (x - x.mean(0)) / x.std(0)
    pooled = sum((y == c).sum() * np.cov(z[y == c], rowvar=False, bias=True) for c in (0, 1)) / len(y)
    logs = []
    for c in (0, 1):
        s = 0.8 * np.cov(z[y == c], rowvar=False, bias=True) + 0.2 * pooled
        s = 0.9 * s + 0.1 * np.diag(np.diag(s)) + 1e-3 * np.eye(4)
        d = z - z[y == c].mean(0)
        logs.append(np.log((y == c).mean()) - 0.5 * np.linalg.slogdet(s)[1] - 0.5 * np.einsum("ij,jk,ik->i", d, np.linalg.inv(s), d))
    assert np.allclose(model.score(x, softness=1.0), 1 / (1 + np.exp(-np.clip(logs[1] - logs[0], -50, 50))))


def shingles_of(text):
    w = [x for x in re.split(r"[^\w]+|_", (text or "").lower()) if x]
    return [tuple(w[i : i + 5]) for i in range(len(w) - 4)] if len(w) >= 5 else [tuple(w)] if w else []


def weighted(a, b):
    x, y = Counter(a), Counter(b)
    both = sum((x & y).values())
    return both / (len(a) + len(b) - both)


def test_leaks_equal_all_windows(spark):
    rng = random.Random(4)
    items = {k: words(rng, rng.randrange(8, 40), 3000) for k in range(12)}
    items[20], items[21] = ["again"] * 12, items[3]
    texts = []
    for k in range(60):
        body = words(rng, rng.randrange(0, 60), 3000)
        for _ in range(rng.randrange(3)):
            noisy = list(items[rng.choice(list(items))])
            for _ in range(rng.randrange(3)):
                at = rng.randrange(len(noisy))
                noisy[at : at + 1] = rng.choice([[], ["new"], ["two", "new"]])
            at = rng.randrange(len(body) + 1)
            body = body[:at] + noisy + body[at:]
        texts.append((k, " ".join(body)))
    bench = spark.createDataFrame([(k, " ".join(w)) for k, w in items.items()], "item_id long, text string")
    out = {(r.doc_id, r.item_id): r.similarity for r in decontaminate.contaminated(docs_of(spark, texts), bench).collect()}
    good = {}
    for (i, t), (k, w) in itertools.product(texts, items.items()):
        s, g = shingles_of(t), shingles_of(" ".join(w))
        if s:
            good[i, k] = max(weighted(s[a : a + len(g)], g) for a in range(max(1, len(s) - len(g) + 1)))
    assert len(out) > 20 and all(abs(v - good[k]) < 1e-9 or v <= good[k] for k, v in out.items())
    assert {k for k, v in good.items() if v >= 0.8} == set(out)


def test_hubs_are_joined_apart(spark, monkeypatch):
    monkeypatch.setattr(_common, "HOT_LINKS", 5)
    edges = [(0, k) for k in range(1, 30)] + [(40, 41), (41, 42), (29, 50), (None, 3), (7, 7)]
    out = {r.id: r.component for r in _common.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert out == {**{k: 0 for k in [*range(30), 50]}, 40: 40, 41: 40, 42: 40}


@pytest.mark.parametrize("percent", [60, 80, 90])
def test_long_sets_in_blocks_equal_brute_force(spark, monkeypatch, percent):
    monkeypatch.setattr(ngram_join, "_most_block", lambda p: 20)
    monkeypatch.setattr(ngram_join, "BULK", 4)
    monkeypatch.setattr(ngram_join, "COLUMN_TILE", 7)
    rng = random.Random(percent)
    texts = []
    for g in range(6):
        base = words(rng, rng.randrange(5, 160), 5000)
        for _ in range(rng.randrange(1, 25)):
            w = list(base)
            for _ in range(rng.randrange(1 + len(w) // 8)):
                w[rng.randrange(len(w))] = f"e{rng.randrange(99999)}"
            texts.append(" ".join(w))
    rng.shuffle(texts)
    sets = [{tuple(t.split()[i : i + 3]) for i in range(len(t.split()) - 2)} for t in texts]
    label, links = list(range(len(texts))), [0] * len(texts)
    for a, b in itertools.combinations(range(len(texts)), 2):
        both = len(sets[a] & sets[b])
        if 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
            links[a], links[b] = links[a] + 1, links[b] + 1
            low, high = sorted((label[a], label[b]))
            label = [low if x == high else x for x in label]
    out = {r.doc_id: r for r in ngram_join.jaccard_groups(docs_of(spark, list(enumerate(texts))), 3, percent).collect()}
    assert [(out[i].n_links, out[i].component_id) for i in range(len(texts))] == list(zip(links, label, strict=True))


def naive_passages(texts, min_words=50):
    """Maximal equal runs of earlier documents' words, quadratically."""
    found = set()
    for (i, a), (j, b) in itertools.product(texts, texts):
        if j < i:
            x, y = a.split(), b.split()
            for p, q in itertools.product(range(len(x)), range(len(y))):
                if x[p] == y[q] and (p == 0 or q == 0 or x[p - 1] != y[q - 1]):
                    n = 0
                    while p + n < len(x) and q + n < len(y) and x[p + n] == y[q + n]:
                        n += 1
                    if n >= min_words:
                        found.add((i, j, p, p + n))
    return found


def test_every_equal_run_is_within_a_passage(spark, monkeypatch):
    monkeypatch.setattr(substring_dedup, "BLOCK_BYTES", 1500)
    rng = random.Random(6)
    shared = [words(rng, rng.randrange(50, 90), 9000) for _ in range(5)]
    texts = []
    for k in range(24):
        body = words(rng, rng.randrange(5, 30), 9000)
        for s in rng.sample(shared, rng.randrange(3)):
            body += s + words(rng, rng.randrange(1, 30), 9000)
        texts.append((k, " ".join(body)))
    covered = {}
    for r in substring_dedup.passages(docs_of(spark, texts)).collect():
        assert r.source_id < r.doc_id
        covered.setdefault(r.doc_id, set()).update(range(r.start_word, r.end_word))
    runs = naive_passages(texts)
    assert len(runs) > 20 and all(set(range(p, q)) <= covered.get(i, set()) for i, _, p, q in runs)
    clean = {i for i, _ in texts} - {i for i, *_ in runs}
    assert all(len(covered.get(i, ())) == 0 for i in clean)


def test_clashing_columns_empty_tables_and_repeats(spark):
    rng = random.Random(7)
    long = " ".join(words(rng, 30_000, 50_000))
    base = " ".join(words(rng, 120, 9000))
    texts = [(1, base), (2, base), (2, base), (2, "another text of this id"), (3, None), (4, ""), (5, " \n"), (6, long), (None, base), (-7, base.upper())]
    bench = spark.createDataFrame([(1, " ".join(base.split()[:30])), (1, " ".join(base.split()[:30])), (None, "x"), (2, None)], "item_id long, text string")
    labels = spark.createDataFrame([(1, 1, 0), (2, 0, 1), (2, 1, 1), (None, 1, 1), (9, None, 3)], "doc_id long, quality int, toxic int")
    runs = {
        "groups": lambda d: ngram_join.jaccard_groups(d), "leaks": lambda d: decontaminate.contaminated(d, bench), "clean": lambda d: decontaminate.clean(d, bench), "passages": lambda d: substring_dedup.passages(d),
        "cut": lambda d: substring_dedup.cut_repeats(d), "quality": lambda d: quality.score(d, labels), "toxicity": lambda d: toxicity.score(d, labels), "licenses": lambda d: licenses.scan(d),
        "tokens": lambda d: bpe.token_digests(d, __import__("public_tokenizers").path("byte_bpe_50k.tiktoken"), __import__("public_tokenizers").PATTERN),
    }
    for name, run in runs.items():
        assert run(docs_of(spark, [], CLASH)).count() == 0, name
        plain, clash = run(docs_of(spark, texts)), run(docs_of(spark, texts, CLASH))
        keep = [c for c in plain.columns]
        assert sorted(map(repr, plain.collect())) == sorted(map(repr, clash.select(*keep).collect())), name
    cut = {(r.doc_id, r.text) for r in substring_dedup.cut_repeats(docs_of(spark, texts, CLASH)).collect()}
    assert cut == {(2, "another text of this id"), (3, None), (4, ""), (5, " \n"), (6, long), (None, base), (-7, base.upper())}
    groups = ngram_join.jaccard_groups(docs_of(spark, texts)).collect()
    assert len(groups) == len(texts) and {r.component_id for r in groups if r.doc_id in (1, -7)} == {-7}
    assert {r.doc_id for r in decontaminate.clean(docs_of(spark, texts), bench).collect()} == {3, 4, 5, 6, None}
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    assert html_text.main_text(pages).count() == 0 and warc.capture_history(pages).count() == 0
    assert embedding_dedup.near_duplicates(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0
    page = "<article>" + "<p>same words here</p>" * 3000 + "</article>"
    pages = spark.createDataFrame([(1, "u", page, "k", "h"), (1, "u", page, "k", "h"), (2, None, None, "k", "h"), (None, "u", "<p>x", "k", "h")], "page_id long, url string, html string, key string, host string")
    out = html_text.main_text(pages).collect()
    assert len(out) == 4 and {r.n_chars for r in out if r.page_id == 1} == {3000 * 16 - 1}


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    rng, where = random.Random(8), tmp_path_factory.mktemp("corpus")
    prose = [f"word{k}" for k in range(4000)]
    sentence = lambda n: " ".join(rng.choice(prose) for _ in range(n)).capitalize() + "."
    texts = {k: " ".join(sentence(12) for _ in range(8)) for k in range(60)}
    texts |= {100 + k: "BUY!!! $$$ " * rng.randrange(30, 80) for k in range(40)}
    texts[200], texts[201] = texts[3], texts[4] + " One more here."
    shared = " ".join(rng.choice(prose) for _ in range(70))
    texts[210], texts[211] = f"{sentence(40)} {shared} {sentence(30)}", f"{sentence(20)} {shared} {sentence(50)}"
    item = " ".join(rng.choice(prose) for _ in range(30))
    texts[220] = f"{sentence(40)} {item} {sentence(40)}"
    rows = [(k, t, "en", "s", len(t), "extra") for k, t in texts.items()] + [(None, "A text without an id.", "en", "s", 21, None), (300, None, None, None, None, None)]
    spark.createDataFrame(rows, DOC + ", spans string").write.parquet(f"{where}/documents.parquet")
    spark.createDataFrame([(k, int(not 100 <= k < 140), 0) for k in texts], "doc_id long, quality int, toxic int").write.parquet(f"{where}/labels.parquet")
    spark.createDataFrame([(1, item), (2, None)], "item_id long, text string").write.parquet(f"{where}/benchmark.parquet")
    return str(where), texts, shared


def test_pipeline_stages(spark, corpus):
    where, texts, shared = corpus
    docs = spark.read.parquet(f"{where}/documents.parquet")
    ids = lambda df: {r.doc_id for r in df.select("doc_id").collect()}
    good = corpus_pipeline.keep_good(spark, docs, where)
    assert good.columns == docs.columns and {k for k in texts if k < 100} <= ids(good) and not {k for k in texts if 100 <= k < 140} & ids(good) and None in ids(good)
    one = corpus_pipeline.keep_one_of_each_group(spark, docs, where)
    assert {200, 201} & ids(one) == set() and {3, 4, None, 300} <= ids(one) and one.columns == docs.columns
    cut = {r.doc_id: r for r in corpus_pipeline.cut_repeated_passages(spark, docs, where).collect()}
    assert shared in cut[210].text and shared not in cut[211].text and len(cut[211].text.split()) == 70 and cut[211].n_chars == len(cut[211].text) and cut[211].spans == "extra"
    left = corpus_pipeline.drop_leaks(spark, docs, where)
    assert ids(docs) - ids(left) == {220} and left.columns == docs.columns
    assert {r.doc_id for r in corpus_pipeline.tokens(spark, docs, where).collect()} == ids(docs)
    empty = docs.limit(0)
    assert all(stage(spark, empty, where).count() == 0 for _, stage in corpus_pipeline.STAGES)


def test_pipeline_run(spark, corpus):
    where, texts, _ = corpus
    out = {r.doc_id: r for r in corpus_pipeline.run(spark, where).collect()}
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "near_duplicates", "repeated_passages", "benchmark_leaks", "tokens"]
    assert {k for k in range(60)} | {210, 211} <= set(out) and not {200, 201, 220, *range(100, 140)} & set(out)
    import hashlib

    assert all(out[k].decoded_sha256 == hashlib.sha256(texts[k].encode()).hexdigest() for k in range(60))
