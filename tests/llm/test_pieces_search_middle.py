"""Piece encoding, ranked search and fill-in-the-middle, each against a plain version over awkward rows."""

import hashlib
import math
import random
import re
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from ferrule.llm import fill_middle, lexical_search, sentencepiece_bpe

MODEL = public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=MODEL)


def awkward(n: int) -> list[str]:
    draw = random.Random(5)
    alphabets = ["abc ", "ab", "a b\n\t", "the ring ", "01ab_-/", "\n \t", "ions esting THE ABCabc", "日本語テ é́👩‍", "▁ a<s>"]
    texts = ["", " ", "  a", "a▁b", "x\x00y", " " * 3000 + "x" + " " * 3000, "ab" * 3000, "日本語" * 300, "<s>x</s>", "﻿x", "\U0010ffff퟿"]
    return texts + ["".join(draw.choice(draw.choice(alphabets)) for _ in range(draw.randrange(1, 300))) for _ in range(n)]


def test_pieces_as_the_library_has_them(spark, library):
    pieces = sentencepiece_bpe.vocabulary(MODEL).texts[259:]
    draw = random.Random(6)
    texts = awkward(600) + ["".join(draw.choice(pieces) for _ in range(draw.randrange(1, 40))) for _ in range(600)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    encoded = sentencepiece_bpe.encode(docs, MODEL)
    ids = {r["doc_id"]: r["ids"] for r in encoded.collect()}
    assert all(ids[k] == library.encode(t, add_bos=True, add_eos=True) for k, t in enumerate(texts))
    decoded = {r["doc_id"]: r["decoded"] for r in sentencepiece_bpe.decode(encoded, MODEL).collect()}
    assert all(decoded[k] == library.decode(ids[k]) for k in ids)
    for r in sentencepiece_bpe.token_digests(docs, MODEL).collect():
        own = ids[r["doc_id"]]
        assert (r["n_tokens"], r["ids_sha256"]) == (len(own), hashlib.sha256(np.array(own, "<u4").tobytes()).hexdigest())
        assert r["decoded_sha256"] == hashlib.sha256(library.decode(own).encode()).hexdigest()


def test_pieces_decode_any_ids(library):
    v, draw = sentencepiece_bpe.vocabulary(MODEL), random.Random(7)
    for _ in range(2000):
        ids = [draw.choice([draw.randrange(32000), draw.randrange(3, 259), 0, 1, 2, 259]) for _ in range(draw.randrange(12))]
        assert sentencepiece_bpe.decode_ids(v, ids) == library.decode(ids)
    with pytest.raises(ValueError):
        sentencepiece_bpe.decode_ids(v, [32000])


def test_pieces_by_heap_and_by_rounds_are_the_same(monkeypatch):
    texts, v = awkward(300), sentencepiece_bpe.vocabulary(MODEL)
    one = [np.concatenate([i for i, _ in sentencepiece_bpe.encode_segments(v, sentencepiece_bpe.escaped(t))] or [[]]).tolist() for t in texts]
    monkeypatch.setattr(sentencepiece_bpe, "MOST_ROUNDS", 0)
    monkeypatch.setattr(sentencepiece_bpe, "MOST_TOGETHER", 50)
    assert one == [np.concatenate([i for i, _ in sentencepiece_bpe.encode_segments(v, sentencepiece_bpe.escaped(t))] or [[]]).tolist() for t in texts]


def test_pieces_of_odd_rows(spark, library, monkeypatch):
    monkeypatch.setattr(sentencepiece_bpe, "MOST_KNOWN", 3)
    docs = spark.createDataFrame([(1, None, 9, 1), (1, "", 9, 1), (None, "a b", 9, 1), (2, "a b", 9, 1), (2, "a b", 9, 1)], "doc_id long, text string, ids int, n_tokens int")
    said = library.encode("a b", add_bos=True, add_eos=True)
    rows = Counter((r[0], r[1], tuple(r[2])) for r in sentencepiece_bpe.encode(docs, MODEL).collect())
    assert rows == {(1, 2, (1, 2)): 2, (None, len(said), tuple(said)): 1, (2, len(said), tuple(said)): 2}
    assert sentencepiece_bpe.encode(docs.limit(0), MODEL).count() == 0
    assert sentencepiece_bpe.token_digests(docs.limit(0), MODEL).count() == 0
    gone = spark.createDataFrame([(1, None), (1, []), (1, [])], "doc_id long, ids array<int>")
    assert [r["decoded"] for r in sentencepiece_bpe.decode(gone, MODEL).collect()] == [None, "", ""]


def plain_search(docs, items, k):
    def terms(text):
        return re.findall("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))

    counted = [(i, Counter(terms(t)), len(terms(t))) for i, t in docs if terms(t)]
    n_docs, n_words = len(counted), sum(n for *_, n in counted)
    df = Counter(t for _, c, _ in counted for t in c)
    out = []
    for item, text in {*items}:
        scored = []
        for i, c, n in counted:
            m = 25 + 75 * n * n_docs // n_words
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 8 * m)) for t in terms(text) if t in c)
            if s > 0:
                scored.append((-s, i is None, i or 0, i))
        out += [(item, r + 1, i, -s) for r, (s, _, _, i) in enumerate(sorted(scored)[:k])]
    return Counter(out)


def test_search_equals_plain_scores(spark, monkeypatch):
    draw = random.Random(8)
    words = ["a", "B", "cé", "ñ", "x1", "Éa", "zz", "日本"] + [f"w{k}" for k in range(60)]
    docs = [(draw.choice([k, k, k // 2, None]), " ,\n".join(draw.choices(words, k=draw.randrange(1, 60)))) for k in range(300)]
    docs += [(500, None), (501, ""), (502, "--"), *[(600 + k, "w1 w2 same") for k in range(40)], (700, "w3 " * 30000)]
    items = [(k, " ".join(draw.choices(words, k=draw.randrange(1, 12)))) for k in range(30)] + [(90, "same same"), (91, None), (92, "..."), (93, "nothing here"), (90, "same same"), (None, "w3")]
    monkeypatch.setattr(lexical_search, "SHARD_DOCUMENTS", 23)
    monkeypatch.setattr(lexical_search, "MOST_ITEM_BYTES", 200)
    monkeypatch.setattr(lexical_search, "TEXT_BYTES", 7)
    d = spark.createDataFrame([(i, t, 0, 0) for i, t in docs], "doc_id long, text string, item int, score int").repartition(4)
    q = spark.createDataFrame([(i, t, 0) for i, t in items], "item_id long, text string, rank int")
    got = Counter(map(tuple, lexical_search.search(d, q).collect()))
    assert got == plain_search(docs, items, 10)
    assert lexical_search.search(d.limit(0), q).count() == 0
    assert lexical_search.search(d, q.limit(0)).count() == 0


def test_best_breaks_ties_by_id():
    draw = random.Random(9)
    for _ in range(300):
        n = draw.randrange(1, 40)
        scores, ids = np.array([draw.randrange(-2, 4) for _ in range(n)]), np.array(draw.sample(range(100), n))
        want = sorted((-s, i, k) for k, (s, i) in enumerate(zip(scores.tolist(), ids.tolist(), strict=True)) if s > 0)[:5]
        assert lexical_search.best(scores, ids, 5).tolist() == [k for *_, k in want]


def plain_middle(key, text):
    text = text or ""
    units = re.findall("[A-Za-z]+|[^A-Za-z]", text)
    n = len(units)
    digest = hashlib.sha256(f"1:{key}".encode()).hexdigest()
    h = [int(digest[8 * k : 8 * k + 8], 16) for k in range(4)]
    if key is None or not text or re.search("<[PSM]>", text) or h[2] % 100 >= 90:
        return key, n, "plain", None, None, text
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    form = "spm" if h[3] % 100 < 20 else "psm"
    return key, n, form, len(p), len(m), f"<S>{s}<P>{p}<M>{m}" if form == "spm" else f"<P>{p}<S>{s}<M>{m}"


@pytest.mark.parametrize("chunk", [1, 2, 3, 7, 50, 32_768])
def test_middle_whatever_the_chunks(spark, chunk):
    draw = random.Random(10)
    alphabets = ["ab ", "a<P>", "<PSM> x", "é1 Z\n", "a"]
    rows = [(k, "".join(draw.choices(draw.choice(alphabets), k=draw.randrange(0, 40)))) for k in range(250)]
    rows += [(None, "abc def"), (7, None), (8, "\n"), (9, "a<"), (10, "x" * 500), (10, "x" * 500), (11, "é" * 90 + "<M>"), (12, "日本 " * 60)]
    docs = spark.createDataFrame([(i, t, "z", 0) for i, t in rows], "doc_id long, text string, output string, n int").repartition(3)
    out = fill_middle.transform(docs, chunk=chunk)
    got = out.collect()
    assert Counter(map(tuple, got)) == Counter(plain_middle(*r) for r in rows)
    back = out.select("doc_id", fill_middle.restored(out["output"], out["form"]).alias("t")).collect()
    assert Counter(map(tuple, back)) == Counter((i, t or "") for i, t in rows)
    assert fill_middle.transform(docs.limit(0), chunk=chunk).count() == 0


def test_chunk_functions_compose_to_the_automaton():
    text = "ab<P>c <S<M>>x<"
    points = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    for cuts in ([15], [1, 15], [3, 4, 15], [2, 5, 9, 12, 15], list(range(1, 16)), [4, 4, 15]):
        after, units, found = fill_middle.functions(points, np.array(cuts))
        state = n = marks = 0
        for k in range(len(cuts)):
            n, marks, state = n + units[k, state], marks + found[k, state], after[k, state]
        assert (n, marks, state) == (len(re.findall("[A-Za-z]+|[^A-Za-z]", text)), 2, 2)
