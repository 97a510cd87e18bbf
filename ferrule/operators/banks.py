"""Banks of masks for a question, and the next masks that a controller asks for.

Both are pure functions of a question's regions and history, so they are made
by group; draws are seeded by the question and the purpose.
"""

from __future__ import annotations

from hashlib import sha256

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from ferrule.operators.selection import Sampler, achievable

#: Masks of each kind, local pairs with their pools' shares of the cost, the tilt, the kept share, and tries for a new mask.
SHARED, GLOBAL, POOLS, TILT, KEPT, TRIES = 8, 8, (0.4, 0.3, 0.2, 0.1), 2.0, 0.5, 60


def _rng(*parts) -> np.random.Generator:
    return np.random.Generator(np.random.PCG64(int.from_bytes(sha256("|".join(map(str, parts)).encode()).digest()[:8], "big")))


def tilts(priority: np.ndarray, strength: float = TILT) -> np.ndarray:
    """Priorities as evenly spaced tilts from -strength to strength, ties sharing their mean rank."""
    _, at, n = np.unique(priority, return_inverse=True, return_counts=True)
    rank = (np.cumsum(n) - n + (n - 1) / 2)[at]
    return strength * (2 * (rank + 0.5) / len(priority) - 1)


def _new(sampler: Sampler, seed: str, seen: set) -> tuple | None:
    for k in range(TRIES):
        mask = tuple(sampler.draw(f"{seed}|{k}"))
        if mask not in seen:
            seen.add(mask)
            return mask
    return None


def bank(costs: list[int], priority: list[float], case: str, kept: float = KEPT) -> list[tuple[str, int, tuple]]:
    """(family, base, mask) of a question: shared uniform masks, masks tilted towards and against priority, and local pairs.

    A local pair differs from its shared base (its index; -1 for others) within
    a pool of regions that is nominated by priority and noise and packed up to a
    share of the cost. All masks cost the same; families that have no further
    new mask end early.
    """
    c, theta = [int(x) for x in costs], tilts(np.asarray(priority, float))
    budget = achievable(c, int(kept * sum(c)))
    seen: set[tuple] = set()
    out: list[tuple[str, int, tuple]] = []

    def add(family: str, n: int, tilt: np.ndarray | None) -> None:
        sampler = Sampler(c, budget, None if tilt is None else tilt.tolist())
        for k in range(n):
            mask = _new(sampler, f"{case}|{family}|{k}", seen)
            if mask is None:
                return
            out.append((family, -1, mask))

    add("shared", SHARED, None)
    shared = [m for f, _, m in out if f == "shared"]
    add("positive", GLOBAL, theta)
    add("negative", GLOBAL, -theta)
    for r, share in enumerate(POOLS):
        if r >= len(shared):
            break
        base, rng = np.array(shared[r]), _rng(case, "local", r)
        for _ in range(TRIES):
            soft = np.exp(theta - theta.max())
            order = np.argsort(-(np.log(0.5 / len(c) + 0.5 * soft / soft.sum()) + rng.gumbel(size=len(c))), kind="stable")
            pool, used = [], 0
            for i in order.tolist():
                if used + c[i] <= share * sum(c):
                    pool.append(i)
                    used += c[i]
            pool.sort()
            if len(pool) < 2 or base[pool].all() or not base[pool].any():
                continue
            pair: list[tuple] = []
            sampler = Sampler([c[i] for i in pool], sum(c[i] for i in pool if base[i]))
            for k in range(TRIES):
                inner = sampler.draw(f"{case}|local|{r}|{used}|{k}")
                mask = base.copy()
                mask[pool] = inner
                if tuple(mask.tolist()) not in seen and tuple(mask.tolist()) not in pair:
                    pair.append(tuple(mask.tolist()))
                if len(pair) == 2:
                    break
            if len(pair) == 2:
                seen.update(pair)
                out += [("local", r, m) for m in pair]
                break
    return out


def banks(regions: DataFrame) -> DataFrame:
    """(question, slot, family, base, mask) from (question, region, cost, priority)."""

    def make(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("region")
        found = bank(rows["cost"].tolist(), rows["priority"].tolist(), str(key[0]))
        return pd.DataFrame([(key[0], k, f, b, list(m)) for k, (f, b, m) in enumerate(found)], columns=["question", "slot", "family", "base", "mask"])

    return regions.groupBy("question").applyInPandas(make, "question long, slot int, family string, base int, mask array<boolean>")


def next_masks(costs: list[int], history: list[tuple[tuple, float]], case: str, seeds: int = 8, rounds: int = 3) -> list[tuple[str, tuple]]:
    """(kind, mask) of the masks that a controller observes next, from its history of (mask, score): first seeds, then in each round a broad and a focussed quartet, at last nothing.

    Broad masks are uniform; focussed ones tilt towards regions whose masks
    scored above the mean. The same history always gives the same masks.
    """
    c = [int(x) for x in costs]
    budget, seen, n = achievable(c, int(KEPT * sum(c))), {m for m, _ in history}, len(history)
    if n < seeds:
        plain = Sampler(c, budget)
        drawn = [("seed", _new(plain, f"{case}|seed|{k}", seen)) for k in range(seeds - n)]
        return [x for x in drawn if x[1] is not None]
    stage = (n - seeds) // 8
    if stage >= rounds:
        return []
    x, y = np.array([m for m, _ in history], float), np.array([s for _, s in history])
    lean = (x - x.mean(0)).T @ (y - y.mean())
    lean = TILT * lean / max(1e-12, np.abs(lean).max())
    plain, leaning = Sampler(c, budget), Sampler(c, budget, lean.tolist())
    drawn = [("broad", _new(plain, f"{case}|broad|{stage}|{k}", seen)) for k in range(4)]
    drawn += [("focus", _new(leaning, f"{case}|focus|{stage}|{k}", seen)) for k in range(4)]
    return [d for d in drawn if d[1] is not None]
