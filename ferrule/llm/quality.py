"""Quality by a regularised quadratic discriminant over document statistics.

Statistics of every whole text are computed once, block by block on its bytes,
and written. Class means and shrunk class covariances are fitted on a bounded
sample of labelled rows; their Cholesky factors are kept, and a document's
score is the logistic of the difference of the classes' log densities.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ferrule.llm import labelled
from ferrule.llm._common import WordBlock, stage, word_blocks

STATISTICS = (
    "log_words", "word_length", "word_length_sd", "upper", "digits", "pipes", "odd_symbols", "shouts",
    "repeats", "distinct_words", "distinct_pairs", "top_word", "stops", "lines", "non_ascii",
)

_KIND = np.zeros((7, 256), bool)
_KIND[0, 65:91] = True
_KIND[1, 48:58] = True
_KIND[2, ord("|")] = True
_KIND[3, [ord(c) for c in "#$%&*+/<=>@[]\\^_`{}~"]] = True
_KIND[4, [ord("!"), ord("?")]] = True
_KIND[5, [ord("."), ord(","), ord(";"), ord(":")]] = True
_KIND[6, ord("\n")] = True


def _sums(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    total = np.zeros(len(values) + 1, np.float64)
    np.cumsum(values, out=total[1:])
    return total[offsets[1:]] - total[offsets[:-1]]


def statistics_of(block: WordBlock) -> np.ndarray:
    """Transformed statistics, a row a text; shares go through a square root. A text without words has zeros."""
    n = np.diff(block.offset).astype(np.float64)
    size = np.maximum(1.0, np.diff(block.row_start))
    length = (block.end - block.start).astype(np.float64)
    mean = _sums(length, block.offset) / np.maximum(1, n)
    square = _sums(length * length, block.offset) / np.maximum(1, n)
    share = [np.sqrt(_sums(k[block.data], block.row_start) / size) for k in _KIND]
    high = np.sqrt(_sums(block.data >= 128, block.row_start) / size)
    same = np.zeros(len(block.hash))
    same[1:] = block.hash[1:] == block.hash[:-1]
    first = block.offset[:-1][n > 0]
    same[first] = 0
    repeats = np.sqrt(_sums(same, block.offset) / np.maximum(1, n))
    distinct, pairs, top = np.zeros(len(n)), np.zeros(len(n)), np.zeros(len(n))
    for r in np.flatnonzero(n > 0):
        h = block.hash[block.offset[r] : block.offset[r + 1]]
        _, counts = np.unique(h, return_counts=True)
        distinct[r], top[r] = len(counts) / len(h), np.sqrt(counts.max() / len(h))
        pairs[r] = len(np.unique(h[1:] ^ (h[:-1] * np.uint64(3)))) / (len(h) - 1) if len(h) > 1 else 1.0
    sd = np.sqrt(np.maximum(0, square - mean * mean))
    return np.column_stack([
        np.log1p(n), np.log1p(mean), np.log1p(sd), share[0], share[1], share[2], share[3], share[4],
        repeats, distinct, pairs, top, share[5], share[6], high,
    ])


def statistics(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(id, x): the statistics of every row's whole text; null is as empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in word_blocks(batch.column(1)):
                x = statistics_of(block)
                ids = batch.column(0).slice(block.first, block.rows)
                values = pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), x.shape[1]).cast(pa.list_(pa.float64()))
                yield pa.RecordBatch.from_arrays([ids, values], names=["id", "x"])

    rows = docs.select(F.col(id_column).cast("long").alias("id"), F.col(text_column).cast("string").alias("text"))
    return rows.mapInArrow(run, "id long, x array<double>")


@dataclass
class Discriminant:
    """Class means, inverses of the Cholesky factors of the shrunk covariances, and log priors, over scaled statistics.

    The factors are inverted once, so that a batch's Mahalanobis distances are
    one product with a triangular matrix.
    """

    centre: np.ndarray
    scale: np.ndarray
    means: list[np.ndarray]
    factors: list[np.ndarray]
    offsets: list[float]
    constant: float | None = None

    @classmethod
    def fit(cls, x: np.ndarray, y: np.ndarray, to_pooled: float = 0.2, to_diagonal: float = 0.1) -> Discriminant:
        """Class covariances shrink to the pooled one and then to their diagonal.

        With fewer than two rows of a class the score is the share of label 1
        (0.5 without rows).
        """
        counts = [int((y == c).sum()) for c in (0, 1)]
        if min(counts) < 2:
            return cls(np.zeros(0), np.zeros(0), [], [], [], float(counts[1] / sum(counts)) if sum(counts) else 0.5)
        centre, scale = x.mean(0), x.std(0)
        scale[scale < 1e-9] = 1.0
        z = (x - centre) / scale
        means = [z[y == c].mean(0) for c in (0, 1)]
        own = [np.cov(z[y == c], rowvar=False, bias=True) for c in (0, 1)]
        pooled = sum(n * s for n, s in zip(counts, own, strict=True)) / sum(counts)
        factors, offsets = [], []
        for n, s in zip(counts, own, strict=True):
            s = (1 - to_pooled) * s + to_pooled * pooled
            s = (1 - to_diagonal) * s + to_diagonal * np.diag(np.diag(s)) + 1e-3 * np.eye(len(s))
            factor = np.linalg.cholesky(s)
            factors.append(np.linalg.inv(factor))
            offsets.append(float(np.log(n / sum(counts)) - np.log(np.diag(factor)).sum()))
        return cls(centre, scale, means, factors, offsets)

    def score(self, x: np.ndarray, softness: float = 4.0) -> np.ndarray:
        """Logistic of the log-density difference, which ``softness`` divides.

        The statistics of one text aren't independent draws, so that the plain
        difference is far too sure; 4 is a fixed choice, not fitted, and moves
        scores towards a half without changing their order.
        """
        if self.constant is not None:
            return np.full(len(x), self.constant)
        z = (x - self.centre) / self.scale
        logs = []
        for mean, factor, offset in zip(self.means, self.factors, self.offsets, strict=True):
            w = (z - mean) @ factor.T
            logs.append(offset - 0.5 * (w * w).sum(1))
        return 1 / (1 + np.exp(-np.clip((logs[1] - logs[0]) / softness, -50, 50)))


def fit(stats: DataFrame, labels: DataFrame, label: str = "quality", folds: int = 5, held_out: int = 0, most: int = labelled.MOST_LABELLED) -> Discriminant:
    """Fit on at most about ``most`` labelled rows outside the held-out fold."""
    chosen = labelled.sample(labels, label, folds, held_out, most)
    rows = stats.join(F.broadcast(chosen), "id").select("x", "y").limit(2 * most).toArrow()
    if rows.num_rows == 0:
        return Discriminant.fit(np.zeros((0, len(STATISTICS))), np.zeros(0))
    x = rows.column("x").combine_chunks().flatten().to_numpy().reshape(rows.num_rows, -1)
    return Discriminant.fit(x, rows.column("y").to_numpy())


def score(docs: DataFrame, labels: DataFrame, folds: int = 5, held_out: int = 0, threshold: float = 0.3, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(id, held_out, score, predicted) of every row of ``docs``.

    Label 1 is good. Rows that repeat an id are scored each; a null id is
    scored too, as of the fold of the empty text. Null and empty texts have
    statistics of 0, an empty table gives an empty one; a long text is read
    whole, and other columns don't matter. An id with several labels takes the
    largest.
    """
    stats = stage(statistics(docs, id_column, text_column), "quality-statistics")
    model = fit(stats, labels, folds=folds, held_out=held_out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x = batch.column(1).flatten().to_numpy().reshape(batch.num_rows, -1)
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(model.score(x))], names=["id", "score"])

    scored = stats.mapInArrow(run, "id long, score double")
    return scored.select(
        F.col("id").alias(id_column), (labelled.fold("id", folds) == held_out).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted")
    )

