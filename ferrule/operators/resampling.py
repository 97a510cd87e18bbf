"""Draws of n out of n with replacement, without a join of draws and rows.

Units are numbered in order. Draw d takes n units in all; of the units of a range of places
[lo, hi) it takes some number c, and of these the lower half gets
Binomial(c, its share of the places) and the upper half the rest: down to single units
these are the counts of a multinomial draw. A split's number is the quantile of a uniform
number that the seed, the range and the draw hash to, so any task finds the same
counts for the units it holds by walking down from the top to them, and every draw adds up
to n. Tasks add up counts times values, and ``draws`` rows a task go on.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ferrule.operators import settle
from ferrule.operators.settle import dealt, numbered

#: Units that a walk finds counts for at once; counts up to which binomial quantiles are looked up in a table;
#: probabilities that are added up at once; splits that a task remembers.
BLOCK, TABLE, CELLS, MOST_KNOWN = 2_048, 48, 1 << 19, 4_096
#: Tasks that share the draws of a large case whose scores are permuted.
SLOTS = 8


def uniforms(seed: str, lo: int, hi: int, draws: int) -> np.ndarray:
    """For each draw 52 bits of a digest as a number in [0, 1), four draws a digest."""
    return _uniforms(seed, [lo], [hi], draws)[0]


def _uniforms(seed: str, lo: list[int], hi: list[int], draws: int) -> np.ndarray:
    """``uniforms`` of many ranges, as (range, draw)."""
    raw = b"".join([hashlib.sha256(f"{seed}|{a}|{b}|{q}".encode()).digest() for a, b in zip(lo, hi, strict=True) for q in range((draws + 3) // 4)])
    return (np.frombuffer(raw, ">u8").reshape(len(lo), -1)[:, :draws] >> np.uint64(12)).astype(np.float64) / float(1 << 52)


def _log_factorial(k: np.ndarray) -> np.ndarray:
    """By Stirling's series from 16 on, by sums of logarithms below."""
    small = np.append(0.0, np.cumsum(np.log(np.arange(1.0, 16))))
    x = np.maximum(k, 16).astype(np.float64)
    series = (x + 0.5) * np.log(x) - x + 0.5 * np.log(2 * np.pi) + 1 / (12 * x) - 1 / (360 * x**3) + 1 / (1260 * x**5) - 1 / (1680 * x**7)
    return np.where(k < 16, small[np.minimum(k, 15)], series)


def _masses(c: np.ndarray, k: np.ndarray, share: float) -> np.ndarray:
    inside = (k >= 0) & (k <= c)
    j = np.clip(k, 0, c)
    logs = _log_factorial(c) - _log_factorial(j) - _log_factorial(c - j) + j * np.log(share) + (c - j) * np.log1p(-share)
    return np.where(inside, np.exp(logs), 0.0)


@lru_cache(maxsize=512)
def _cumulative(share: float) -> np.ndarray:
    grid = np.arange(TABLE + 1)
    return np.cumsum(_masses(grid[:, None], grid[None, :], share), axis=1)


def quantiles(c: np.ndarray, share: float, u: np.ndarray) -> np.ndarray:
    """The least k of Binomial(c, share) whose cumulative probability is above u, elementwise."""
    out = np.zeros(c.shape, np.int64)
    few = c <= TABLE
    if few.any():
        out[few] = (_cumulative(share)[c[few]] <= u[few][:, None]).sum(axis=1)
    if not few.all():
        many, v = c[~few], u[~few]
        spread = int(12 * np.sqrt(many.max() * share * (1 - share))) + 12
        low = np.maximum((many * share).astype(np.int64) - spread, 0)
        found, step = np.zeros(len(many), np.int64), max(1, CELLS // (2 * spread + 1))
        for a in range(0, len(many), step):
            x = slice(a, a + step)
            k = low[x, None] + np.arange(2 * spread + 1)
            found[x] = (np.cumsum(_masses(many[x, None], k, share), axis=1) <= v[x, None]).sum(axis=1)
        out[~few] = low + found
    return np.minimum(out, c)


def counts(places: np.ndarray, n: int, draws: int, seed: str, known: dict | None = None) -> np.ndarray:
    """How often each of the rising ``places`` among 0 to n - 1 is taken, as (place, draw).

    Ranges of one size are split together, level by level. ``known`` keeps the splits of
    ranges larger than a block, for the next blocks of the same task.
    """
    out = np.zeros((len(places), draws), np.int64)
    known = {} if known is None else known
    lo, hi, c = np.zeros(1, np.int64), np.full(1, n, np.int64), np.full((1, draws), n, np.int64)
    while len(lo):
        a, b = np.searchsorted(places, lo), np.searchsorted(places, hi)
        there, single = (a < b) & c.any(axis=1), hi - lo == 1
        held = np.flatnonzero(there & single)
        wide = (b - a)[held]
        out[np.repeat(a[held] - np.cumsum(wide) + wide, wide) + np.arange(wide.sum())] = np.repeat(c[held], wide, axis=0)
        on = there & ~single
        lo, hi, c = lo[on], hi[on], c[on]
        size, left = hi - lo, np.zeros(c.shape, np.int64)
        for k in np.flatnonzero(size > BLOCK).tolist():
            key = seed, int(lo[k]), int(hi[k])
            if key not in known:
                if len(known) >= MOST_KNOWN:
                    known.clear()
                known[key] = quantiles(c[k], int(size[k] // 2) / int(size[k]), uniforms(*key, draws))
            left[k] = known[key]
        for s in np.unique(size[size <= BLOCK]).tolist():
            own = np.flatnonzero(size == s)
            left[own] = quantiles(c[own], (s // 2) / s, _uniforms(seed, lo[own].tolist(), hi[own].tolist(), draws))
        middle = lo + size // 2
        lo, hi = np.stack([lo, middle], 1).ravel(), np.stack([middle, hi], 1).ravel()
        c = np.stack([left, c - left], 1).reshape(-1, draws)
    return out


def resampled(units: DataFrame, order: list[str], columns: list[str], draws: int, seed: str, stratum: str | None = None) -> DataFrame:
    """(draw[, stratum], columns...): sums of the columns over the units that each draw takes, n of n, in each stratum if there is one.

    A column is a number, or an array with a number for each draw. Units are
    numbered by ``order``, within strata; equal ones may change places. The strata
    are few: their sizes go to every task. Without units there are no rows.
    """
    keys = [stratum] if stratum else []
    rows = numbered(units.select(*keys, *order, *[c for c in columns if c not in order]), *keys, *order, name="_place")
    names = [r for r in rows.groupBy(*keys).agg(F.count("*").alias("_n"), F.min("_place").alias("_first")).collect() if r["_n"]]
    sizes = {r[0] if stratum else None: (r["_n"], r["_first"]) for r in names}
    kind = f"`{stratum}` {units.schema[stratum].dataType.simpleString()}, " if stratum else ""
    sums = [f"_s{k}" for k in range(len(columns))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict = {}
        known: dict = {}
        for batch in batches:
            strata = np.array(batch.column(0).to_pylist(), object) if stratum else np.full(batch.num_rows, None, object)
            place = batch.column(int(bool(stratum))).to_numpy()
            values = []
            for c in batch.columns[1 + bool(stratum) :]:
                flat = c.flatten() if pa.types.is_list(c.type) else c
                values.append(flat.to_numpy(zero_copy_only=False).astype(np.float64).reshape(batch.num_rows, -1))
            for name in dict.fromkeys(strata.tolist()):
                n, first = sizes[name]
                own = np.flatnonzero(np.array([s == name for s in strata])) if stratum else np.arange(batch.num_rows)
                own = own[np.argsort(place[own])]
                text = seed if stratum is None else f"{seed}|{name}"
                for at in np.array_split(own, -(-len(own) // BLOCK)):
                    w = counts(place[at] - first, n, draws, text, known)
                    part = np.stack([(w * v[at]).sum(axis=0) for v in values])
                    totals[name] = totals.get(name, 0) + part
        for name, part in totals.items():
            head = [pa.array([name] * draws, batch.column(0).type)] if stratum else []
            yield pa.RecordBatch.from_arrays([*head, pa.array(np.arange(draws), pa.int32()), *(pa.array(x, pa.float64()) for x in part)], names=[*keys, "draw", *sums])

    made = rows.select(*keys, "_place", *columns).mapInArrow(run, f"{kind}draw int, {', '.join(f'{s} double' for s in sums)}")
    return made.groupBy("draw", *keys).agg(*[F.sum(s).alias(c) for s, c in zip(sums, columns, strict=True)])


def own_means(units: DataFrame, unit: str, repeated: str, draws: int, seed: str, name: str = "means") -> DataFrame:
    """Adds for each unit the means of draws of its repetitions, n of n (an array by draw); null without repetitions."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            at = batch.schema.get_field_index(unit), batch.schema.get_field_index(repeated)
            for u, r in zip(batch.column(at[0]).to_pylist(), batch.column(at[1]).to_pylist(), strict=True):
                r = np.array(r or [], np.float64)
                out.append((counts(np.arange(len(r)), len(r), draws, f"{seed}|{u}") * r[:, None]).sum(axis=0) / len(r) if len(r) else None)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.list_(pa.float64()))], names=[*batch.schema.names, name])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in units.schema)
    return units.mapInArrow(run, f"{kinds}, {name} array<double>")


def interactions(df: DataFrame, by: str, first: str, second: str, value: str, unit: str, draws: int, seed: str) -> DataFrame:
    """(by, n00, n01, n10, n11, effect_present, effect_absent, interaction, low, high): what ``second`` adds where ``first`` is there and where not.

    Means of the four cells of two boolean columns; the interaction is the
    difference of the two effects, its 95 % interval from draws within each
    cell, n of n. A group without rows in some cell has null effects. Groups are few.
    """
    cell = F.concat_ws("|", F.col(by).cast("string"), F.col(first).cast("int"), F.col(second).cast("int"))
    rows = df.where(F.col(first).isNotNull() & F.col(second).isNotNull() & F.col(value).isNotNull()).select(F.col(by).alias("_b"), F.col(first).alias("_p"), F.col(second).alias("_q"), cell.alias("_s"), F.col(unit).alias("_u"), F.col(value).cast("double").alias("_v"), F.lit(1).cast("long").alias("_n"))
    at = lambda c, p, q: F.max(F.when((F.col("_p") == bool(p)) & (F.col("_q") == bool(q)), F.col(c)))
    names = rows.select("_b", "_p", "_q", "_s").distinct()

    def effects(cells: DataFrame, *keys: str) -> DataFrame:
        m = cells.groupBy("_b", *keys).agg(*[at("_m", p, q).alias(f"_m{p}{q}") for p in (0, 1) for q in (0, 1)], *[F.coalesce(at("_n", p, q), F.lit(0)).cast("long").alias(f"n{p}{q}") for p in (0, 1) for q in (0, 1)])
        return m.withColumn("effect_present", F.col("_m11") - F.col("_m10")).withColumn("effect_absent", F.col("_m01") - F.col("_m00")).withColumn("interaction", F.col("_m11") - F.col("_m10") - F.col("_m01") + F.col("_m00"))

    plain = effects(rows.groupBy("_b", "_p", "_q").agg(F.avg("_v").alias("_m"), F.count("*").alias("_n")))
    drawn = resampled(rows, ["_u", "_v"], ["_v", "_n"], draws, seed, stratum="_s").withColumn("_m", F.col("_v") / F.col("_n"))
    drawn = effects(drawn.join(F.broadcast(names), "_s"), "draw").groupBy("_b").agg(*[F.percentile("interaction", F.lit(p)).alias(n) for p, n in ((0.025, "low"), (0.975, "high"))])
    out = plain.join(drawn, plain["_b"].eqNullSafe(drawn["_b"])).select(plain["_b"].alias(by), "n00", "n01", "n10", "n11", "effect_present", "effect_absent", "interaction", "low", "high")
    return out


def matched_null(df: DataFrame, case: str, item: str, kind: str, cost: str, score: str, mass: str, draws: int, seed: str, share: int = 5) -> DataFrame:
    """(case, actual, null_mean, null_low, null_high): the share of mass that a case's best items hold, and what it would be by chance.

    The best are the ceil(n / ``share``) items of a case by (-score, item). By chance: scores are
    permuted among items of one kind and one fifth of the costs (an item's
    fifth is the number of its case's quintiles below its cost), then the best are
    taken again. In each draw a group's items in order of a digest of
    (seed, draw, item) get the scores of its items in order. Cases without mass have null shares.
    """
    rows = df.where(F.col(case).isNotNull()).select(F.col(case).alias("_c"), F.col(item).alias("_i"), F.col(kind).alias("_k"), F.col(cost).cast("double").alias("_x"), F.col(score).alias("_s"), F.col(mass).cast("double").alias("_m"))
    slots, most = min(SLOTS, draws), settle.TASK_ROWS // (draws + 1)
    n = rows.groupBy("_c").agg(F.count("*").alias("_n")).agg(F.sum("_n").alias("all"), F.sum(F.when(F.col("_n") > most, F.col("_n"))).alias("large")).first()
    # Rows are shuffled once, to tasks that have room for all draws of their cases; what follows stays within a task.
    rows = dealt(rows, "_c", rows=(n["all"] or 0) * (draws + 1))
    own, same = Window.partitionBy("_c"), ["_c", "_k", "_bin"]
    per = rows.withColumns({"_q": F.percentile("_x", F.array(*[F.lit(p) for p in (0.2, 0.4, 0.6, 0.8)])).over(own), "_n": F.count("*").over(own), "_total": F.sum("_m").over(own)})
    binned = per.withColumn("_top", F.ceil(F.col("_n") / F.lit(share))).withColumn("_bin", F.size(F.filter("_q", lambda q: q < F.col("_x")))).drop("_q", "_x")
    digest = F.sha2(F.concat_ws("|", F.lit(seed), F.col("draw"), F.col("_i")), 256)

    def shares(each: DataFrame, *slot: str) -> DataFrame:
        """(case, draw, share) of rows with a draw each, of which -1 stands for the scores as they are: the others take theirs from it, place by place."""
        place = F.row_number().over(Window.partitionBy(*same, *slot, "draw").orderBy(F.when(F.col("draw") >= 0, digest), "_i"))
        # No join: Spark deals both of its sides anew, by all of its keys, or broadcasts what it takes for small.
        taken = F.first("_s").over(Window.partitionBy(*same, *slot, "_r").orderBy("draw"))
        scored = each.withColumn("_r", place).withColumn("_s", taken).where("draw < 0 or (_k is not null and _bin is not null)").select("_c", *slot, "draw", "_i", "_s", "_m", "_top", "_total")
        best = F.row_number().over(Window.partitionBy("_c", *slot, "draw").orderBy(F.desc("_s"), "_i"))
        v = F.when(F.max("_total") > 1e-12, F.coalesce(F.sum(F.when(F.col("_p") <= F.col("_top"), F.col("_m"))), F.lit(0.0)) / F.max("_total"))
        return scored.withColumn("_p", best).groupBy("_c", *slot, "draw").agg(v.alias("_v"))

    def summed(v: DataFrame) -> DataFrame:
        null = F.when(F.col("draw") >= 0, F.col("_v"))
        ends = [F.percentile(null, F.lit(p)).alias(name) for p, name in ((0.025, "null_low"), (0.975, "null_high"))]
        return v.groupBy("_c").agg(F.max(F.when(F.col("draw") < 0, F.col("_v"))).alias("actual"), F.avg(null).alias("null_mean"), *ends, F.max("draw").alias("_last")).where("_last >= 0").select(F.col("_c").alias(case), "actual", "null_mean", "null_low", "null_high")

    out = summed(shares(binned.where(F.col("_n") <= most).withColumn("draw", F.explode(F.sequence(F.lit(-1), F.lit(draws - 1))))))
    if n["large"]:
        # Draws of a large case are dealt to slots before they are made.
        slotted = binned.where(F.col("_n") > most).withColumn("_slot", F.explode(F.sequence(F.lit(0), F.lit(slots - 1)))).drop("_n")
        each = dealt(slotted, "_c", "_slot", rows=n["large"] * (draws + slots)).withColumn("draw", F.explode(F.concat(F.array(F.lit(-1)), F.sequence("_slot", F.lit(draws - 1), F.lit(slots)))))
        out = out.union(summed(shares(each, "_slot").where("draw >= 0 or _slot = 0")))
    return out
