"""Operators against brute force on small tables with nulls, empty and long texts, repeats and clashing columns."""

import hashlib
import itertools
import random
import re

import numpy as np
import public_tokenizers as P
import pyarrow as pa
import pyarrow.compute as pc
import pytest

from ferrule.llm import bpe, decontaminate, embedding_dedup, html_text, licenses, ngram_join, quality, substring_dedup, toxicity, warc

DOC = "doc_id long, text string, lang string, source string, n_chars long, id string, n int"


def docs_of(spark, texts):
    rows = [(i, t, "en", "s", len(t or ""), "x", 1) for i, t in texts]
    return spark.createDataFrame(rows, DOC)


def words(rng, n, pool=400):
    return [f"w{rng.randrange(pool)}" for _ in range(n)]


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(3)
    base = words(rng, 300)
    texts = [" ".join(base)] * 3
    for _ in range(12):
        w = list(base)
        for _ in range(rng.randrange(1, 12)):
            w[rng.randrange(len(w))] = f"e{rng.randrange(99)}"
        texts.append(" ".join(w))
    texts += [" ".join(words(rng, rng.randrange(1, 80))) for _ in range(30)] + [None, "", " \n ", "one", "one two", "ONE two", "a " * 500]
    return list(enumerate(texts)) + [(0, texts[0]), (None, "null id")]


def shingles(text, n):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} if w else set()


@pytest.mark.parametrize(("n", "percent"), [(3, 90), (5, 80)])
def test_jaccard_groups(spark, corpus, n, percent):
    sets = {i: shingles(t, n) for i, t in corpus if i is not None}
    label = {i: i for i in sets}
    links = {i: 0 for i in sets}
    for a, b in itertools.combinations(sets, 2):
        both = len(sets[a] & sets[b])
        if sets[a] and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
            links[a] += 1
            links[b] += 1
            low, high = sorted((label[a], label[b]))
            label = {k: low if v == high else v for k, v in label.items()}
    out = ngram_join.jaccard_groups(docs_of(spark, corpus), n, percent).collect()
    assert len(out) == len(corpus)
    assert {(r.doc_id, r.n_shingles, r.n_links, r.component_id) for r in out if r.doc_id is not None} == {(i, len(s), links[i], label[i]) for i, s in sets.items()}
    assert [(r.n_links, r.component_id) for r in out if r.doc_id is None] == [(None, None)]
    assert ngram_join.jaccard_groups(docs_of(spark, []), n, percent).count() == 0


def test_overlaps_equal_brute_force():
    rng = np.random.default_rng(1)
    sets = [np.unique(rng.integers(0, 50, 30).astype(np.uint64)) for _ in range(9)]
    out = ngram_join._overlaps(sets)
    assert all(out[i, j] == len(np.intersect1d(sets[i], sets[j])) for i in range(9) for j in range(9) if i != j)


def test_near_vectors(spark):
    rng = np.random.default_rng(2)
    x = rng.standard_normal((60, 16))
    x[40:] = x[:20] + 0.05 * rng.standard_normal((20, 16))
    x[10] = x[11]
    rows = [(i, v.astype(float).tolist()) for i, v in enumerate(x)] + [(90, None), (91, [0.0] * 16), (92, [float("nan")] * 16), (93, []), (94, [1.0, 2.0]), (None, [1.0])]
    out = {r.vec_id: r for r in embedding_dedup.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()}
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    link = u @ u.T >= 0.9
    assert len(out) == len(rows)
    found, there = sum(out[i].n_links for i in range(60)), int(link.sum()) - 60
    assert 0.9 * there <= found <= there
    assert all(out[i].n_links == 0 and out[i].kept for i in (90, 91, 92, 93, 94))


def test_vectors_of_any_id_repeats_and_clashing_columns(spark):
    v = [1.0, 2.0, 3.0]
    rows = [(-1, v, 9, "x"), (5, v, 9, "x"), (7, [1.0, 2.0, 3.01], 9, "x"), (2**62, [2.0, 4.0, 6.0], 9, "x"), (5, v, 9, "y"), (8, [-1.0, 0.0, 0.0], 9, "z"), (8, [0.0, -1.0, 0.0], 9, "z"), (None, v, 9, "x")]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, rep long, id string")
    out = sorted((tuple(r) for r in embedding_dedup.near_duplicates(df).collect() if r.vec_id is not None))
    assert out == [(-1, 3, -1, True), (5, 3, -1, False), (5, 3, -1, False), (7, 3, -1, False), (8, 0, 8, True), (8, 0, 8, True), (2**62, 3, -1, False)]
    assert embedding_dedup.near_duplicates(df.limit(0)).count() == 0


def test_buckets_in_tiles_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(embedding_dedup, "BUCKET_TILE", 8)
    rng = np.random.default_rng(3)
    x = np.concatenate([rng.standard_normal((1, 32)) + 0.1 * rng.standard_normal((60, 32)), rng.standard_normal((60, 32))])
    out = {r.vec_id: r for r in embedding_dedup.near_duplicates(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")).collect()}
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    link = u @ u.T >= 0.9
    np.fill_diagonal(link, False)
    assert [out[i].n_links for i in range(120)] == link.sum(1).tolist()


@pytest.mark.parametrize("n", [1_000, 262_145, 1_000_000, 4_300_000, 8_000_000, 1_000_000_000])
def test_tables_hold_the_miss(n):
    width, tables, codes = embedding_dedup.plan(n, 64, 0.9)
    assert (1 - (1 - np.arccos(0.9) / np.pi) ** width) ** tables <= embedding_dedup.MISS
    rng = np.random.default_rng(4)
    a, b = rng.standard_normal((2, 1500, 64))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    b -= (a * b).sum(1, keepdims=True) * a
    b = 0.9 * a + np.sqrt(1 - 0.81) * b / np.linalg.norm(b, axis=1, keepdims=True)
    mean, projections = np.zeros(64), np.stack([np.linalg.qr(rng.standard_normal((64, 64)))[0] for _ in range(codes)])
    ka, kb = (embedding_dedup.keys(x, mean, projections, width, tables) for x in (a, b))
    recall = (ka == kb).any(1).mean()
    print(n, width, tables, codes, recall, (ka[:, :64] == kb[:, :64]).any(1).mean())
    assert recall >= 0.95


def test_bpe_is_tiktoken(spark, corpus):
    import base64

    import tiktoken

    path = P.path("byte_bpe_50k.tiktoken")
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    e = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    rows = [*corpus[:20], (50, None), (51, ""), (52, "a b   c\n\n d's ''s 12́ \U0001f600  x\x1cy"), (53, "é" * 5000)]
    df = docs_of(spark, rows)
    texts = dict(rows)
    for r in bpe.token_digests(df, path, P.PATTERN).collect():
        ids = e.encode_ordinary(texts[r.doc_id] or "")
        assert r.n_tokens == len(ids) and r.ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256((texts[r.doc_id] or "").encode()).hexdigest()
    back = bpe.decode(bpe.encode(df, path, P.PATTERN), path).collect()
    assert {r.doc_id: bytes(r.decoded).decode() for r in back} == {i: t or "" for i, t in rows}


def test_warc_round_trip(spark):
    pages = [(1, "http://www.A.org/x?q#f", "same\r\n\r\nWARC/1.1\r\n"), (2, None, None), (3, "http://b.org:80/", "same\r\n\r\nWARC/1.1\r\n"), (4, "https://a.org/a", ""), (5, "http://a.org/a", "é")]
    out = warc.capture_history(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()
    assert {(r.page_id, r.payload_bytes, r.record_type, r.refers_to) for r in out} == {(1, 18, "response", None), (2, 0, "response", None), (3, 18, "revisit", 1), (4, 0, "revisit", 2), (5, 2, "response", None)}
    keys = [(r.url_key, r.captured) for r in out]
    assert keys == sorted(keys) and ("org,a)/x?q" in dict(keys))
    assert warc.capture_history(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_warc_ids_members_and_clashing_columns(spark, tmp_path, monkeypatch):
    import gzip

    monkeypatch.setattr(warc, "CLASSES", ((10, 2), (40, 1), (1 << 62, 1)))
    ids = [10**13, 2**62, 253402300800, -5, 7, 7, 8]
    pages = [(i, f"http://h.org/{k}", "same" if k < 5 else "x" * 30 * (k - 4), "key", "value") for k, i in enumerate(ids)] + [(None, None, "same", "a", "b")]
    df = spark.createDataFrame(pages, "page_id long, url string, html string, key string, value string")
    out = warc.capture_history(df).collect()
    assert sorted((r.page_id, r.record_type) for r in out if r.page_id is not None) == sorted([(-5, "response"), (7, "revisit"), (7, "response"), (8, "response"), *((i, "revisit") for i in ids[:3])])
    assert all(r.refers_to == -5 for r in out if r.record_type == "revisit")
    monkeypatch.setattr(warc, "MEMBER", 50)
    warc.write(df, str(tmp_path / "w"))
    found = []
    for f in (tmp_path / "w").glob("part-*"):
        data = f.read_bytes()
        whole = gzip.decompress(data)
        for head, start, payload in warc.records(memoryview(data)):
            assert gzip.decompress(data[start:]).startswith(b"WARC/1.1\r\n") and payload + b"\r\n\r\n" in whole
            found.append((head["WARC-Target-URI"], len(payload)))
    assert sorted(n for _, n in found) == [0, 0, 0, 0, 0, 4, 30, 60]
    with pytest.raises(ValueError):
        list(warc.records(memoryview(data[:-3])))


def test_loser_tree():
    rng = random.Random(5)
    runs = [sorted((rng.randrange(50),) for _ in range(rng.randrange(8))) for _ in range(7)]
    assert list(warc.LoserTree(runs)) == sorted(x for r in runs for x in r)


def test_contaminated(spark):
    rng = random.Random(8)
    item = words(rng, 30, 10_000)
    other = words(rng, 60, 10_000)
    texts = [(1, " ".join(other[:20] + item + other[20:])), (2, " ".join(other)), (3, " ".join(item[:29] + ["zz"])), (4, None), (5, ""), (6, " ".join(item[:15] + ["q"] + item[16:])), (None, " ".join(item))]
    bench = spark.createDataFrame([(7, " ".join(item).upper()), (8, None), (9, "")], "item_id long, text string")
    out = {r.doc_id: r for r in decontaminate.contaminated(docs_of(spark, texts), bench).collect()}
    assert set(out) == {1, 3} and out[1].start_word == 20 and out[1].similarity == 1.0
    assert {r.doc_id for r in decontaminate.clean(docs_of(spark, texts), bench).collect()} == {2, 4, 5, 6, None}


def test_passages(spark):
    rng = random.Random(9)
    shared = words(rng, 70, 10_000)
    fuzzy = list(shared)
    fuzzy[35] = "changed"
    texts = [(1, " ".join(words(rng, 40, 9999) + shared + words(rng, 5, 9999))), (2, " ".join(words(rng, 10, 9999) + fuzzy)), (3, " ".join(words(rng, 90, 9999))), (4, None), (5, " ".join(shared)), (6, "x " * 300), (7, "x " * 300)]
    out = {(r.doc_id, r.source_id): r for r in substring_dedup.passages(docs_of(spark, texts)).collect()}
    assert (2, 1) in out and (out[2, 1].start_word, out[2, 1].end_word) == (10, 80) and (5, 1) in out
    assert not any(3 in k for k in out)
    left = {r.doc_id: r for r in substring_dedup.cut_repeats(docs_of(spark, texts)).collect()}
    assert 5 not in left and left[1].text == texts[0][1] and len(left[2].text.split()) == 10 and left[2].n_chars == len(left[2].text) and 4 in left


def test_every_passage_of_a_chain(spark):
    rng = random.Random(10)
    one, two = words(rng, 60, 10_000), words(rng, 60, 10_000)
    texts = [(1, " ".join(one + words(rng, 20, 9999) + two)), (2, " ".join(one + words(rng, 20, 9999) + two))]
    out = sorted((r.start_word, r.end_word) for r in substring_dedup.passages(docs_of(spark, texts)).collect())
    assert out == [(0, 60), (80, 140)]
    far = np.array([*range(0, 300, 5), 310]), np.array([*range(0, 300, 5), 900])
    near = np.append(far[0], 320), np.append(far[1], 910)
    assert sorted(substring_dedup.chains(*near)) == [(0, 295, 0, 295), (310, 320, 900, 910)]


def test_passage_whose_parts_are_elsewhere(spark):
    rng = random.Random(11)
    w = [f"u{k}" for k in range(120)]
    texts = [*((k + 1, " ".join(w[40 * k : 40 * k + 40])) for k in range(3)), (4, " ".join(words(rng, 9, 9999) + w)), (5, " ".join(w))]
    out = [(r.doc_id, r.source_id, r.start_word, r.end_word) for r in substring_dedup.passages(docs_of(spark, texts)).collect()]
    assert out == [(5, 4, 0, 120)]


def test_passages_at_the_promised_identity(spark):
    rng = random.Random(14)
    texts = []
    for n in (5, 6, 7, 8, 10) * 8:
        shared = words(rng, 60, 100_000)
        texts += [words(rng, 30, 99_999) + shared, [f"e{rng.randrange(9999)}" if k % n == n - 1 else w for k, w in enumerate(shared)] + words(rng, 30, 99_999)]
    out = {(r.source_id, r.doc_id) for r in substring_dedup.passages(docs_of(spark, list(enumerate(" ".join(t) for t in texts)))).collect()}
    assert out == {(k, k + 1) for k in range(0, len(texts), 2)}


def test_short_runs_count_for_identity():
    a = np.arange(60, dtype=np.uint32)
    b = a.copy()
    b[[11, 14, 17, 30, 32, 35, 37, 45]] += 1000
    assert substring_dedup.align(a, b) == [(0, 60, 0, 60, 52 / 60)]
    c = np.delete(b, 31)
    assert substring_dedup.align(a, c) == [(0, 60, 0, 59, 51 / 60)]


def test_passage_held_twice(spark):
    rng = random.Random(13)
    shared = words(rng, 60, 10_000)
    texts = [(1, " ".join(words(rng, 30, 9999) + shared)), (2, " ".join(shared + words(rng, 90, 9999) + shared + words(rng, 7, 9999)))]
    out = sorted((r.start_word, r.end_word) for r in substring_dedup.passages(docs_of(spark, texts)).collect())
    assert out == [(0, 60), (150, 210)]
    assert len({r.doc_id: r.text for r in substring_dedup.cut_repeats(docs_of(spark, texts)).collect()}[2].split()) == 97


@pytest.mark.parametrize("per_block", [1, 3, 100])
def test_links_of_seeds(per_block):
    """Every place of a seed meets the seed's first holder and an earlier one nearest to it, however documents are dealt to blocks by id."""
    rng = random.Random(12)
    texts = [" ".join(words(rng, 40, 6)) for _ in range(9)]
    parts, found, blocks = 4, set(), []
    for a in range(0, len(texts), per_block):
        own = [t.encode() for t in texts[a : a + per_block]]
        row = {"block": 50 + a, "ids": list(range(a, a + len(own))), "keys": [0] * len(own), "sizes": list(map(len, own)), "text": substring_dedup.zstandard.ZstdCompressor().compress(b"".join(own))}
        blocks.append(pa.Table.from_pylist([row]))
    batches = [b for t in blocks for b in substring_dedup._all_seeds(parts)(t.to_batches())]
    lists = pa.Table.from_batches(batches)
    by = lambda t, c: {v: t.filter(pc.equal(t.column(c), v)) for v in set(t.column(c).to_pylist())}
    bits = pa.concat_tables([substring_dedup._in_two(t) for t in by(lists, "part").values()])
    firsts = pa.concat_tables([substring_dedup._first_holders(parts)(t, by(bits, "block")[50 + per_block * k]) for k, t in enumerate(blocks)])
    answers = pa.concat_tables([substring_dedup._earlier(t) for t in by(firsts, "part").values()]) if len(firsts) else firsts
    for k, t in enumerate(blocks):
        mine = by(answers, "block").get(50 + per_block * k)
        block = substring_dedup.Block(t.to_pylist()[0])
        (doc, pos, s_block, s_doc, s_id, s_pos), _ = substring_dedup._matches(block, mine.column("list").to_pylist() if mine else [])
        assert (s_block + s_doc == s_id + 50).all()
        found |= set(zip(block.ids[doc].tolist(), pos.tolist(), s_id.tolist(), s_pos.tolist(), strict=True))
    places = {}
    for i, t in enumerate(texts):
        w = t.split()
        for p in range(len(w) - substring_dedup.K + 1):
            places.setdefault(tuple(w[p : p + substring_dedup.K]), {}).setdefault(i, []).append(p)
    for at in places.values():
        for i in sorted(at)[1:]:
            less = [j for j in at if j < i]
            for p in at[i]:
                assert (i, p, min(less), at[min(less)][0]) in found
                assert any((i, p, max(less), q) in found for q in at[max(less)])
    assert all(j < i for i, _, j, _ in found)


def test_quality_and_toxicity(spark):
    rng = random.Random(4)
    good = [(i, " ".join(words(rng, 120)) + ".") for i in range(60)]
    junk = [(100 + i, "spam " * rng.randrange(50, 200)) for i in range(60)]
    bad = [(200 + i, " ".join([*words(rng, 30), rng.choice(["grobnik", "grobnak", "Gr0bnik!"]), *words(rng, 30)])) for i in range(60)]
    df = docs_of(spark, good + junk + bad + [(900, None), (901, "")])
    labels = spark.createDataFrame([(i, int(i < 100 or i >= 200), int(i >= 200)) for i, _ in good + junk + bad] + [(5, None, None)], "doc_id long, quality int, toxic int")
    q = {r.doc_id: r for r in quality.score(df, labels).collect()}
    assert all(q[i].predicted == 1 for i, _ in good) and all(q[i].predicted == 0 for i, _ in junk) and all(0 <= r.score <= 1 for r in q.values())
    t = {r.doc_id: r for r in toxicity.score(df, labels).collect()}
    assert sum(t[i].predicted for i, _ in bad) >= 57 and sum(t[i].predicted for i, _ in good + junk) <= 3 and 900 in t
    empty = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert {r.score for r in quality.score(df, empty).collect()} == {0.5} and toxicity.score(docs_of(spark, []), empty).count() == 0


def test_exceptions_and_folding():
    lexicon = toxicity.Lexicon({"trash": 4.0, "idio*": 5.0})
    assert lexicon.measure("a trash can") == (0.0, 3) and lexicon.measure("тr4$h and 1d1oтs!") == (9.0, 3) and lexicon.measure(None) == (0.0, 0)


def test_html(spark):
    line = "".join(f"<p>shared line number {k} here</p>" for k in range(2))
    pages = [
        (1, "http://h.org/a/1", f"<body><nav>menu</nav>{line}<p>first&amp;  own<br>text</p><div class='cookie-notice'>no</div><footer>f</footer>" + "<p>x</p>" * 3),
        (2, "http://h.org/a/2", f"<body>{line}<p>second own text that is long enough to differ</p><!-- c --><script>var a='<p>';</script>"),
        (3, "http://z.org/", "<article><h1>T</h1><p>In<b>li</b>ne <br> x</article><div>out</div>"),
        (4, None, None),
    ]
    out = {r.page_id: r.text for r in html_text.main_text(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()}
    assert out == {1: "first& own text x x x", 2: "second own text that is long enough to differ", 3: "T Inline x", 4: ""}


@pytest.mark.parametrize(("page", "text"), [
    ('<article><p>a</p><p class="advert">no<p>b<span class="ad">no</span>c</article>', "a bc"),
    ('<article>a<iframe>no</iframe> b<article class="comment">no</article><details class="comments"><p>no</p></details> c</article>', "a b c"),
    ('<article><section class="related-work"><p>kept</p></section><div class="post-header">kept too</div><div class="site-header">no</div></article>', "kept kept too"),
    ('<main><ul><li>a<li class="ad">no<li>b</ul><span id="share">no<span>no</span></span>c<b class="menu">no</b></main>', "a b c"),
    ('<div class="comment-list"><article>no</article></div><article class="post">yes</article>', "yes"),
    ('<body class="menu"><p>a&lt;b&nbsp;&#x41;</p><table><tr><td class="sponsor">no<td>c</table>', "a<b A c"),
    ("<article><p>x<div role='complementary'>no</div>y", "x y"), ("<article></article><p>plain", "plain"), ("no markup", "no markup"), ("<", "<"),
])
def test_html_names(page, text):
    texts, zones = html_text.lines(page)
    zone = html_text.INSIDE if html_text.INSIDE in zones else html_text.PLAIN
    assert " ".join(t for t, z in zip(texts, zones, strict=True) if z == zone) == text


def test_html_equals_a_plain_differ(spark):
    """Every page against the nearest of its two neighbours by URL, by the standard library's parser-free lines and a quadratic LCS."""
    rng = random.Random(21)
    menus = [f"menu {k} of the host" for k in range(6)]
    pages = {}
    for k in range(40):
        own = [f"own line {k} {j} " + " ".join(words(rng, 6)) for j in range(rng.randrange(1, 5))]
        body = sorted(rng.sample(menus, rng.randrange(6))) + own + (["the end"] if k % 2 else [])
        pages[k] = (f"http://h{k % 3}.org/{rng.choice('ab')}/{rng.choice('xyz')}/{k}", body)
    rows = [(k, u, "".join(f"<p>{x}</p>" for x in b)) for k, (u, b) in pages.items()]
    out = {r.page_id: r.text for r in html_text.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    order = sorted(pages, key=lambda k: (pages[k][0].split("/")[2], "/" + "/".join(pages[k][0].split("/")[3:]), k))
    changed = 0
    for at, k in enumerate(order):
        url, mine = pages[k]
        near = []
        for step in (-1, 1):
            j = at + step
            while 0 <= j < len(order) and pages[order[j]][0].split("/")[2] == url.split("/")[2] and set(mine) <= set(pages[order[j]][1]):
                j += step
            if 0 <= j < len(order) and pages[order[j]][0].split("/")[2] == url.split("/")[2]:
                other, theirs = pages[order[j]]
                near.append((sum(1 for _ in itertools.takewhile(lambda x: x[0] == x[1], zip(url.split("/", 3)[3], other.split("/", 3)[3], strict=False))), theirs))
        best = max((n for n, _ in near), default=0)
        options = set()
        for n, theirs in near:
            if n == best:
                table = [[0] * (len(theirs) + 1) for _ in range(len(mine) + 1)]
                for i, j in itertools.product(range(len(mine)), range(len(theirs))):
                    table[i + 1][j + 1] = table[i][j] + 1 if mine[i] == theirs[j] else max(table[i][j + 1], table[i + 1][j])
                i, j, gone = len(mine), len(theirs), set()
                while i and j:
                    if mine[i - 1] == theirs[j - 1]:
                        gone.add(i - 1)
                        i, j = i - 1, j - 1
                    elif table[i - 1][j] >= table[i][j - 1]:
                        i -= 1
                    else:
                        j -= 1
                options.add(" ".join(x for q, x in enumerate(mine) if q not in gone))
        assert out[k] in (options or {" ".join(mine)})
        changed += out[k] != " ".join(mine)
    assert changed > 20


@pytest.mark.parametrize("ranges", [1, 3, 12])
def test_html_walks_past_copies(spark, ranges):
    menu = "".join(f"<p>menu entry number {k} with many words in it</p>" for k in range(9))
    page = lambda own: f"<body>{menu}<p>{own}</p></body>"
    pages = [(k, f"http://h.org/b/{k}", page("the same text")) for k in range(10, 18)] + [(1, "http://h.org/a", page("short one")), (2, "http://h.org/c", page("short two")), (3, "http://i.org/", page("alone"))]
    spark.conf.set("spark.sql.shuffle.partitions", ranges)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        out = {r.page_id: r.text for r in html_text.main_text(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "3")
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert out.pop(3).endswith("alone") and out.pop(1) == "short one" and out.pop(2) == "short two" and set(out.values()) == {"the same text"}


def test_common_lines_is_longest():
    rng = random.Random(6)
    for _ in range(50):
        a, b = ([rng.randrange(4) for _ in range(rng.randrange(9))] for _ in "ab")
        table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, j in itertools.product(range(len(a)), range(len(b))):
            table[i + 1][j + 1] = table[i][j] + 1 if a[i] == b[j] else max(table[i][j + 1], table[i + 1][j])
        mine, theirs = html_text.common_lines(a, b)
        assert len(mine) == table[-1][-1] and [a[i] for i in mine] == [b[j] for j in theirs] and mine == sorted(set(mine))


def test_licenses(spark):
    from ferrule.llm.license_texts import NOTICES, TEXTS

    mit = TEXTS["MIT"].replace("\n", "\n * ")
    texts = [(1, "x y Licensed under the Apache License, Version 2.0. z"), (2, "nothing"), (3, None), (4, "released under  the\nMIT license"), (5, "license the under"), (6, ""),
             (7, "under the Mozilla Public License 2.0 and SPDX-License-Identifier: LGPL-2.1-only"), (8, f"Copyright 2020 A\n{mit}\n" + "word " * 3000), (8, f"Copyright 2020 A\n{mit}"), (9, NOTICES["GPL-2.0-or-later"].replace("program", "library")), (None, "MIT License is released under")]
    out = {(r.doc_id, r.license, r.kind, r.start_word, r.end_word) for r in licenses.scan(docs_of(spark, texts)).collect()}
    n = len(licenses.words_of(TEXTS["MIT"]))
    assert {x for x in out if x[0] in (1, 2, 3, 4, 5, 6, None)} == {(1, "Apache-2.0", "name", 2, 10), (4, "MIT", "name", 0, 5)}
    assert {x[1:3] for x in out if x[0] == 7} == {("MPL-2.0", "name"), ("LGPL-2.1-only", "identifier")}
    assert (8, "MIT", "text", 3, 3 + n) in out and (9, "GPL-2.0-or-later", "notice") in {x[:3] for x in out}
    assert licenses.scan(docs_of(spark, [])).count() == 0


def test_patience_is_common_and_scans_equal_all_windows():
    rng = random.Random(31)
    for _ in range(150):
        template = [rng.choice("abcdefghijkl") for _ in range(rng.randrange(1, 12))]
        text = [rng.choice("abcdefghijkl") for _ in range(rng.randrange(30))]
        at = rng.randrange(len(text) + 1)
        noisy = [w if rng.random() < 0.9 else "z" for w in template]
        text = text[:at] + noisy + text[at:]
        pairs = licenses.patience(text, template)
        assert all(text[i] == template[j] for i, j in pairs) and all(a < c and b < d for (a, b), (c, d) in itertools.pairwise(pairs))
        found = licenses.matches(text, template, 0.8)
        most = max(len(licenses.patience(text[a : a + len(template)], template)) for a in range(len(text)))
        if most >= 0.8 * len(template):
            assert found is not None and found[0] >= 0.8
        if found:
            assert len(licenses.patience(text[found[1] : found[2]], template)) >= 1
