"""License scans by patience alignment of templates with whole texts.

Words that are unique both to a template and to the text are anchors; their
longest rising subsequence is taken, and the gaps between anchors are aligned
in the same way, down to equal runs. Coverage is the share of a template's
words that are aligned within one stretch of the text. A template is passed over
only where the words that the text has of it can't reach the coverage.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ferrule.llm.license_texts import templates as known

_WORD = re.compile(r"[^\W_]+")


def words_of(text: str) -> list[str]:
    return _WORD.findall(text.lower())


def _rising(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    tails, ends, before = [], [], []
    for k, (_, j) in enumerate(pairs):
        at = bisect_left(tails, j)
        before.append(ends[at - 1] if at else -1)
        tails[at : at + 1], ends[at : at + 1] = [j], [k]
    out, k = [], ends[-1] if ends else -1
    while k >= 0:
        out.append(pairs[k])
        k = before[k]
    return out[::-1]


def patience(a: list[str], b: list[str]) -> list[tuple[int, int]]:
    """Aligned places of two word lists: equal ends, then unique common words in rising order, then the gaps alike."""
    out: list[tuple[int, int]] = []
    todo = [(0, len(a), 0, len(b))]
    while todo:
        p, q, u, v = todo.pop()
        while p < q and u < v and a[p] == b[u]:
            out.append((p, u))
            p, u = p + 1, u + 1
        while p < q and u < v and a[q - 1] == b[v - 1]:
            q, v = q - 1, v - 1
            out.append((q, v))
        if p >= q or u >= v:
            continue
        ca, cb = Counter(a[p:q]), Counter(b[u:v])
        place = {w: j for j, w in enumerate(b[u:v], u) if cb[w] == 1 and ca.get(w) == 1}
        anchors = _rising([(i, place[a[i]]) for i in range(p, q) if a[i] in place])
        if not anchors:
            continue
        out += anchors
        for (i, j), (k, m) in zip([(p - 1, u - 1), *anchors], [*anchors, (q, v)], strict=True):
            todo.append((i + 1, k, j + 1, m))
    return sorted(out)


def matches(text: list[str], template: list[str], coverage: float) -> tuple[float, int, int] | None:
    """(coverage, start, end) of the best stretch, the first of equals.

    Of the template's words so many may be missing; of one more than those,
    taken by how rarely they stand in the text, one is there at its place. Each
    of their places is tried in line, and with half the template's length to spare
    on either side, unless an earlier try with room held that one whole.
    """
    n = len(template)
    places: dict[str, list[int]] = {w: [] for w in template}
    for i, w in enumerate(text):
        if w in places:
            places[w].append(i)
    most = math.floor(n - coverage * n + 1e-9)
    if sum(1 for w in template if not places[w]) > most:
        return None
    order = sorted(range(n), key=lambda k: (len(places[template[k]]), k))
    spare = max(1, n // 2)
    best, tried = None, -1
    for start in sorted({i - k for k in order[: most + 1] for i in places[template[k]]}):
        spans = [(max(0, start), min(len(text), start + n))]
        if start > tried:
            tried = start + spare // 2
            spans.append((max(0, start - spare), min(len(text), tried + n + spare)))
        for low, high in spans:
            found = patience(text[low:high], template)
            share = len(found) / n
            if found and share >= coverage and (best is None or share > best[0]):
                best = (share, low + found[0][0], low + found[-1][0] + 1)
        if best is not None and best[0] == 1:
            break
    return best


def scan(docs: DataFrame, templates: list[tuple[str, str, str, float | None]] | None = None, coverage: float = 0.8, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(id, license, kind, coverage, start_word, end_word): for each license and kind the best stretch of a template that a text covers far enough.

    Kinds are whole texts, notices, names and stated identifiers; the last two
    need every word. Null and empty texts have none; rows that repeat an id, and
    null ids, are scanned each; of equally good stretches the first counts. A
    long text is scanned whole; an empty table gives an empty one; other columns
    don't matter. Words are runs of letters and digits in lower case.
    """
    prepared = []
    for name, kind, text, least in templates if templates is not None else known():
        words = words_of(text)
        if words:
            counts = Counter(words)
            least = coverage if least is None else least
            prepared.append((name, kind, words, least, set(counts), counts, math.floor(len(words) - least * len(words) + 1e-9)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                words = words_of((text or "").lower())
                there, found = set(words), {}
                for name, kind, template, least, distinct, counts, most in prepared:
                    if len(words) >= len(template) - most and sum(counts[w] for w in distinct - there) <= most:
                        best = matches(words, template, least)
                        if best and (best[0], -best[1]) > (found.get((name, kind), (0, 0))[0], -found.get((name, kind), (0, 0))[1]):
                            found[name, kind] = best
                out += [(key, *k, *v) for k, v in found.items()]
            if out:
                kinds = (pa.int64(), pa.string(), pa.string(), pa.float64(), pa.int64(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names=names)

    names = [id_column, "license", "kind", "coverage", "start_word", "end_word"]
    rows = docs.select(F.col(id_column).cast("long").alias(id_column), F.col(text_column).cast("string").alias("text"))
    return rows.mapInArrow(run, f"{id_column} long, license string, kind string, coverage double, start_word long, end_word long")
