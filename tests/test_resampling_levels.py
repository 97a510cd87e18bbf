"""Ranges of one size are split together, and large ones once a task."""

import numpy as np

from ferrule.operators import resampling


def one_by_one(places: np.ndarray, n: int, draws: int, seed: str) -> np.ndarray:
    out = np.zeros((len(places), draws), np.int64)
    todo = [(0, n, np.full(draws, n, np.int64))]
    while todo:
        lo, hi, c = todo.pop()
        a, b = np.searchsorted(places, [lo, hi])
        if a == b or not c.any():
            continue
        if hi - lo == 1:
            out[a:b] = c
            continue
        middle = (lo + hi) // 2
        left = resampling.quantiles(c, (middle - lo) / (hi - lo), resampling.uniforms(seed, lo, hi, draws))
        todo += [(lo, middle, left), (middle, hi, c - left)]
    return out


def test_levels_give_what_ranges_give(monkeypatch):
    monkeypatch.setattr(resampling, "BLOCK", 100)
    monkeypatch.setattr(resampling, "CELLS", 1000)
    known: dict = {}
    for n, places in [(0, []), (1, [0]), (2, [1]), (7, range(7)), (1000, range(1000)), (1000, range(300, 420)), (5001, [0, 2500, 5000])]:
        places = np.array(places, np.int64)
        for draws in (1, 4, 6):
            seed = f"s{n}|{draws}"
            got = resampling.counts(places, n, draws, seed, known)
            assert (got == one_by_one(places, n, draws, seed)).all()
            if len(places) == n:
                assert (got.sum(axis=0) == n).all()


def test_few_calls_for_many_places(monkeypatch):
    calls, plain = [], resampling.quantiles
    monkeypatch.setattr(resampling, "quantiles", lambda c, share, u: calls.append(c.size) or plain(c, share, u))
    known: dict = {}
    resampling.counts(np.arange(2048), 100_000, 4, "x", known)
    assert len(calls) < 60
    calls.clear()
    resampling.counts(np.arange(2048, 4096), 100_000, 4, "x", known)
    assert len(calls) < 40 and max(calls) <= 4 * 1024
