"""Best assignments of many small score matrices at once: shortest augmenting paths, a step of all matrices of one shape a numpy call."""

from __future__ import annotations

import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F


def best_sums(scores: np.ndarray) -> np.ndarray:
    """Of each (rows, columns) matrix the greatest sum with every row and column used once at most; scores are at least 0.

    Rows are matched one after another. A row looks for the shortest path to a
    free column, by costs reduced with potentials of rows and columns, and the
    matches along it change over: a cubic number of steps, each on all
    matrices that still look.
    """
    if scores.shape[1] > scores.shape[2]:
        scores = scores.transpose(0, 2, 1)
    many, n, m = scores.shape
    if not n:
        return np.zeros(many)
    cost = -scores
    # Column 0 is where a new row starts from; row 0 stands for none.
    of_row, of_column = np.zeros((many, n + 1)), np.zeros((many, m + 1))
    match = np.zeros((many, m + 1), np.int64)
    for row in range(1, n + 1):
        match[:, 0] = row
        at, reach, seen = np.zeros(many, np.int64), np.full((many, m + 1), np.inf), np.zeros((many, m + 1), bool)
        came = np.zeros((many, m + 1), np.int64)
        looking = np.arange(many)
        while len(looking):
            here = at[looking]
            seen[looking, here] = True
            owner = match[looking, here]
            reduced = cost[looking, owner - 1] - of_row[looking, owner][:, None] - of_column[looking, 1:]
            far, known = reach[looking, 1:], seen[looking, 1:]
            nearer = ~known & (reduced < far)
            far = np.where(nearer, reduced, far)
            came[looking, 1:] = np.where(nearer, here[:, None], came[looking, 1:])
            to = np.argmin(np.where(known, np.inf, far), axis=1)
            step = far[np.arange(len(looking)), to]
            reach[looking, 1:] = np.where(known, far, far - step[:, None])
            on = np.where(seen[looking], step[:, None], 0.0)
            of_row[looking[:, None], match[looking]] += on
            of_column[looking] -= on
            at[looking] = to + 1
            looking = looking[match[looking, to + 1] > 0]
        turning = np.arange(many)
        while len(turning):
            here, before = at[turning], came[turning, at[turning]]
            match[turning, here] = match[turning, before]
            at[turning] = before
            turning = turning[before > 0]
    which = match[:, 1:] - 1
    picked = np.take_along_axis(scores, np.maximum(which, 0)[:, None, :], 1)[:, 0, :]
    # In the order of rows, as one adds them up by hand.
    order = np.argsort(np.where(which < 0, n, which), axis=1, kind="stable")[:, :n]
    return np.take_along_axis(picked, order, 1).sum(axis=1)


#: Score numbers of matrices that are solved together.
TOGETHER = 1 << 20


def _sums(matrices: pa.Array) -> pa.Array:
    inner = matrices.flatten()
    values = inner.flatten().to_numpy(zero_copy_only=False)
    rows = matrices.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    wide = inner.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    first_row = np.cumsum(rows) - rows
    columns = np.where(rows > 0, np.append(wide, 0)[np.minimum(first_row, len(wide))], 0)
    first = np.append(0, np.cumsum(wide))[first_row]
    out = np.zeros(len(rows))
    shapes, which = np.unique(np.stack([rows, columns], 1), axis=0, return_inverse=True)
    for k, (n, m) in enumerate(shapes.tolist()):
        if n and m:
            own = np.flatnonzero(which.ravel() == k)
            for part in np.array_split(own, 1 + len(own) * n * m // TOGETHER):
                out[part] = best_sums(values[first[part][:, None] + np.arange(n * m)].reshape(-1, n, m))
    return pa.array(out, pa.float64())


def assigned(matrix: Column) -> Column:
    """The greatest sum of a score matrix (array of rows of equal length) with each row and column used once at most; 0 without rows or columns, and for null."""

    def sums(matrices: pa.Array) -> pa.Array:
        return _sums(matrices)

    return F.arrow_udf(sums, "double")(matrix)


def _f1(predicted: frozenset[str], gold: frozenset[str], numbers: frozenset[str]) -> float:
    """F1 of two bags; an empty prediction has precision 1, an empty gold recall 1; 0 if none of the gold's numbers is predicted."""
    if numbers and not predicted & numbers:
        return 0.0
    both = len(predicted & gold)
    precision, recall = both / len(predicted) if predicted else 1.0, both / len(gold) if gold else 1.0
    return 2 * precision * recall / (precision + recall) if precision + recall else 0.0


def span_scores(predicted: Column, gold: Column, number: str) -> Column:
    """(em, total): of two lists of spans in normal form, whether they have one set and one length, and the greatest sum of F1 over assignments of their bags of tokens.

    ``number`` is the pattern of tokens that are numbers.
    """
    schema = pa.struct([("em", pa.float64()), ("total", pa.float64())])

    def scores(p: pa.Array, g: pa.Array) -> pa.Array:
        is_number = lru_cache(1 << 16)(re.compile(number, re.ASCII).match)
        bags = lru_cache(1 << 16)(lambda span: frozenset(t for t in span.split(" ") if t))
        rows, same = [], []
        for x, y in zip(p.to_pylist(), g.to_pylist(), strict=True):
            x, y = x or [], y or []
            same.append(float(len(x) == len(y) and set(x) == set(y)))
            golds = [(b := bags(t), frozenset(filter(is_number, b))) for t in y]
            rows.append([[_f1(bags(t), b, n) for b, n in golds] for t in x] if y else [])
        total = _sums(pa.array(rows, pa.list_(pa.list_(pa.float64()))))
        return pa.StructArray.from_arrays([pa.array(same, pa.float64()), total], fields=list(schema))

    return F.arrow_udf(scores, "em double, total double")(predicted, gold)
