"""Toxicity by a weighted lexicon, matched with an Aho-Corasick automaton.

Texts are folded first: case, accents, homoglyphs and digits or signs that
stand for letters. Entries are whole words and word beginnings with a weight
each; matches inside an exception phrase don't count. Summed weights, as they
are and by length, go through a logistic curve. Entries, weights and curve are
learned from a bounded sample of labelled rows: one half gives the entries and,
from where these stand in rows of label 0, further exceptions; the other the
curve.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ferrule.llm import labelled
from ferrule.llm._common import stage

#: Signs and letters of other scripts that are read as Latin letters. "l" is read as "i", as "1" is.
READ_AS = {
    "0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "@": "a", "$": "s", "l": "i",
    "а": "a", "в": "b", "с": "c", "е": "e", "н": "h", "і": "i", "ј": "j", "к": "k", "м": "m", "о": "o", "р": "p", "ѕ": "s", "т": "t", "у": "y", "х": "x",
    "α": "a", "β": "b", "ε": "e", "η": "n", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x",
    "ı": "i", "ß": "ss", "ø": "o", "ł": "i", "đ": "d", "æ": "ae", "œ": "oe",
}
#: Phrases in which an entry is harmless.
EXCEPTIONS = ("trash can", "trash bin", "trash collection", "class clown", "clown fish", "pond scum")
#: At most this many entries, and as many exceptions, are learned; an exception stands in so many rows of label 0 at least, and in none of label 1 for each so many.
MOST_ENTRIES, LEAST_CLEAN, MORE_CLEAN = 2_000, 3, 20


class _Fold(dict):
    def __missing__(self, code: int) -> str:
        c = chr(code)
        if c in READ_AS:
            out = READ_AS[c]
        elif "a" <= c <= "z":
            out = c
        elif code < 128:
            out = " "
        else:
            plain = "".join(x for x in unicodedata.normalize("NFKD", c).lower() if not unicodedata.combining(x))
            out = "".join(READ_AS.get(x, x if x.isalnum() else " ") for x in plain) if unicodedata.category(c)[0] != "M" else ""
        self[code] = out
        return out


_FOLD = _Fold()
for _i in range(128):
    _FOLD[_i]
_TRAILING = re.compile(r"[$@]+(?![0-9A-Za-z])")
_INNER = re.compile(r"(?<=[a-z])[!|](?=[a-z])")


def folded(text: str) -> str:
    """Words of ``text`` in folded letters, single spaces between them and one at either end."""
    text = text.lower()
    if "$" in text or "@" in text:
        text = _TRAILING.sub(" ", text)
    if "!" in text or "|" in text:
        text = _INNER.sub("i", text)
    return f" {' '.join(text.translate(_FOLD).split())} "


class Lexicon:
    """Entries ("word" whole, "beginning*" at a word's start) with weights, and exception phrases."""

    def __init__(self, weights: dict[str, float], exceptions: tuple[str, ...] = EXCEPTIONS):
        import ahocorasick

        self.automaton = ahocorasick.Automaton()
        for entry, weight in weights.items():
            word = folded(entry.rstrip("*")).strip()
            if word:
                pattern = f" {word}" if entry.endswith("*") else f" {word} "
                self.automaton.add_word(pattern, (len(pattern), weight))
        for phrase in exceptions:
            pattern = folded(phrase)
            if pattern.strip():
                self.automaton.add_word(pattern, (len(pattern), None))
        if len(self.automaton):
            self.automaton.make_automaton()

    def measure(self, text: str | None) -> tuple[float, int]:
        """(summed weights, words) of a text; the heaviest entry at each place counts, unless it starts inside an exception."""
        plain = folded(text or "")
        words = plain.count(" ") - 1 if len(plain) > 2 else 0
        if not len(self.automaton) or not words:
            return 0.0, words
        best: dict[int, float] = {}
        safe: list[tuple[int, int]] = []
        for end, (size, weight) in self.automaton.iter(plain):
            start = end - size + 1
            if weight is None:
                safe.append((start, end))
            elif weight > best.get(start, 0.0):
                best[start] = weight
        if safe:
            ends = np.zeros(len(plain) + 1, np.int32)  # how many exceptions a place is inside of
            for a, b in safe:
                ends[a] += 1
                ends[b] -= 1
            inside = np.cumsum(ends)
            return sum(w for at, w in best.items() if not inside[at]), words
        return sum(best.values()), words

    def phrases(self, text: str | None) -> set[str]:
        """The entries' words in a text, each with the word before it and with the one after it."""
        plain, out = folded(text or ""), set()
        for end, (size, weight) in self.automaton.iter(plain) if len(self.automaton) else ():
            if weight is not None:
                start = end - size + 2
                stop = plain.index(" ", start)
                before, after = plain.rfind(" ", 0, start - 1) + 1, plain.find(" ", stop + 1)
                out |= {plain[before:stop]} if before < start - 1 else set()
                out |= {plain[start:after]} if after > stop + 1 else set()
        return out


def learn(texts: DataFrame, least_weight: float = 3.0, least_share: float = 0.01) -> dict[str, float]:
    """Entries from rows (text, y): words and word beginnings of four to eight letters.

    The weight is the smoothed log ratio of the shares of label-1 and label-0
    texts with the entry. An entry needs a hundredth of the label-1 texts, three
    at least. A beginning stands for the words it covers.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = (Counter(), Counter())
        for batch in batches:
            for text, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                words = set(folded(text or "").split())
                entries = {w for w in words if 3 <= len(w) <= 40}
                entries |= {f"{w[:k]}*" for w in words for k in range(4, 9) if len(w) > k}
                counts[y].update(entries)
        found = sorted(counts[0].keys() | counts[1].keys())
        for a in range(0, len(found), 20_000):
            piece = found[a : a + 20_000]
            yield pa.RecordBatch.from_arrays([pa.array(piece), *(pa.array([c[e] for e in piece], pa.int64()) for c in counts)], names=["entry", "clean", "toxic"])

    sizes = {r["y"]: r["count"] for r in texts.groupBy("y").count().collect()}
    clean, toxic = sizes.get(0, 0), sizes.get(1, 0)
    totals = texts.select("text", "y").mapInArrow(count, "entry string, clean long, toxic long").groupBy("entry").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
    weight = F.log((F.col("toxic") + 0.5) / (toxic + 1)) - F.log((F.col("clean") + 0.5) / (clean + 1))
    rows = (
        totals.where(F.col("toxic") >= max(3, math.ceil(least_share * toxic))).withColumn("weight", weight)
        .where(F.col("weight") >= least_weight).orderBy(F.desc("weight"), "entry").limit(MOST_ENTRIES).collect()
    )
    beginnings = {r["entry"][:-1]: r["weight"] for r in rows if r["entry"].endswith("*")}
    kept: dict[str, float] = {}
    for r in rows:
        word = r["entry"].rstrip("*")
        shorter = [beginnings[word[:k]] for k in range(4, len(word) + (not r["entry"].endswith("*"))) if word[:k] in beginnings]
        if not shorter or max(shorter) < r["weight"] - 0.5:
            kept[r["entry"]] = float(r["weight"])
    return kept


def learn_exceptions(texts: DataFrame, lexicon: dict[str, float]) -> tuple[str, ...]:
    """Phrases of two words around entries that stand in at least LEAST_CLEAN rows of label 0, and in those MORE_CLEAN times as often as in rows of label 1."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, counts = Lexicon(lexicon, ()).phrases, (Counter(), Counter())
        for batch in batches:
            for text, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                counts[y].update(found(text))
        listed = sorted(counts[0].keys() | counts[1].keys())
        for a in range(0, len(listed), 20_000):
            piece = listed[a : a + 20_000]
            yield pa.RecordBatch.from_arrays([pa.array(piece), *(pa.array([c[e] for e in piece], pa.int64()) for c in counts)], names=["phrase", "clean", "toxic"])

    totals = texts.select("text", "y").mapInArrow(count, "phrase string, clean long, toxic long").groupBy("phrase").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
    rows = totals.where((F.col("clean") >= LEAST_CLEAN) & (F.col("clean") >= MORE_CLEAN * F.col("toxic"))).orderBy(F.desc("clean"), "phrase").limit(MOST_ENTRIES).collect()
    return tuple(r["phrase"] for r in rows)


def curve(measures: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Logistic weights (bias, log sum, log sum by length) by ridge-regularised Newton steps."""
    x = _inputs(measures)
    w = np.zeros(3)
    if len(y) == 0 or y.min() == y.max():
        return np.array([-2.0, 1.0, 0.0])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = (x * (p * (1 - p))[:, None]).T @ x + 0.5 * np.eye(3)
        w = w - np.linalg.solve(h, x.T @ (p - y) + 0.5 * w)
    return w


def _inputs(measures: np.ndarray) -> np.ndarray:
    total, words = measures[:, 0], np.maximum(1, measures[:, 1])
    return np.column_stack([np.ones(len(total)), np.log1p(total), np.log1p(1000 * total / words)])


def score(docs: DataFrame, labels: DataFrame, folds: int = 4, held_out: int = 2, threshold: float = 0.3, most: int = labelled.MOST_LABELLED,
          seeds: dict[str, float] | None = None, exceptions: tuple[str, ...] = EXCEPTIONS, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(id, held_out, score, predicted, weight, n_words) of every row of ``docs``.

    ``seeds`` are entries besides the learned ones. Null and empty texts have no
    matches and get the curve's value there. Rows that repeat an id, and null
    ids, are scored each; an empty table gives an empty one. Of entries of one
    weight the first by spelling are kept. A long text is matched whole; other
    columns don't matter.
    """
    rows = docs.select(F.col(id_column).cast("long").alias("id"), F.col(text_column).cast("string").alias("text"))
    chosen = stage(labelled.sample(labels, "toxic", folds, held_out, most).withColumn("half", F.pmod(F.xxhash64("id", F.lit(5)), F.lit(2))), "toxicity-sample")
    texts = rows.join(F.broadcast(chosen.where("half = 0")), "id")
    texts = stage(texts.select("text", "y"), "toxicity-texts")
    lexicon = (seeds or {}) | learn(texts)
    exceptions = (*exceptions, *learn_exceptions(texts, lexicon))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        measure = Lexicon(lexicon, exceptions).measure
        for batch in batches:
            found = [measure(t) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([m for m, _ in found], pa.float64()), pa.array([n for _, n in found], pa.int64())], names=["id", "weight", "n_words"])

    measured = stage(rows.mapInArrow(run, "id long, weight double, n_words long"), "toxicity-measures")
    fitted = measured.join(F.broadcast(chosen.where("half = 1")), "id").select("weight", "n_words", "y").limit(2 * most).toArrow()
    w = curve(np.column_stack([fitted.column("weight").to_numpy(), fitted.column("n_words").to_numpy()]), fitted.column("y").to_numpy())
    per = F.log1p(1000 * F.col("weight") / F.greatest(F.lit(1), F.col("n_words")))
    z = F.lit(float(w[0])) + F.lit(float(w[1])) * F.log1p("weight") + F.lit(float(w[2])) * per
    value = F.lit(1.0) / (F.lit(1.0) + F.exp(-z))
    return measured.select(
        F.col("id").alias(id_column), (labelled.fold("id", folds) == held_out).alias("held_out"), value.alias("score"),
        (value >= threshold).cast("int").alias("predicted"), "weight", "n_words",
    )
