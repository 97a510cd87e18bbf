"""Numbers, geometry, bit masks and losses as Columns."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def softplus(x: Column) -> Column:
    """log(1 + e^x) without overflow."""
    return F.greatest(x, F.lit(0.0)) + F.log1p(F.exp(-F.abs(x)))


def pair_loss(plus: Column, minus: Column, temperature: float = 1.0) -> Column:
    return softplus(-(plus - minus) / temperature)


def sequence_logit(log_p: Column) -> Column:
    """log(p / (1 - p)) from log p, by the stabler of two forms at log 2."""
    log_q = F.when(log_p > -math.log(2.0), F.log(-F.expm1(log_p))).otherwise(F.log1p(-F.exp(log_p)))
    return log_p - log_q


def tie_credit(a: Column, b: Column) -> Column:
    """1 if a is greater, 0 if less, a half for a tie."""
    return F.when(a > b, 1.0).when(a < b, 0.0).otherwise(0.5)


def grid_cell(place: Column, size: Column, cells: int = 4) -> Column:
    """Cell of a row or column by its middle."""
    return F.least(F.lit(cells - 1), F.floor(cells * (place + 0.5) / size)).cast("int")


def intersection(a: tuple[Column, ...], b: tuple[Column, ...]) -> Column:
    """Area that two boxes (x0, y0, x1, y1) share, 0 if they don't meet."""
    wide = F.least(a[2], b[2]) - F.greatest(a[0], b[0])
    high = F.least(a[3], b[3]) - F.greatest(a[1], b[1])
    return F.when((wide > 0) & (high > 0), wide * high).otherwise(F.lit(0))


def iou(a: tuple[Column, ...], b: tuple[Column, ...]) -> Column:
    both = intersection(a, b)
    area = lambda x: (x[2] - x[0]) * (x[3] - x[1])
    return F.try_divide(both, area(a) + area(b) - both)


def token_box(row: Column, column: Column, height: Column, width: Column) -> tuple[Column, ...]:
    """The box of a grid cell in the unit square."""
    return column / width, row / height, (column + 1) / width, (row + 1) / height


def group_of(row: Column, column: Column, width: Column, merge: int = 2) -> Column:
    """Index of the merge group (a square of fine cells) that a fine cell is in."""
    return F.floor(row / merge).cast("long") * F.ceil(width / merge).cast("long") + F.floor(column / merge).cast("long")


def packed_bits(mask: Column) -> Column:
    """A mask of up to 63 flags as a whole number, the first flag lowest."""
    return F.aggregate(mask, F.struct(F.lit(0).cast("long").alias("bits"), F.lit(0).alias("at")),
                       lambda s, x: F.struct((s["bits"] + F.when(x, F.expr("1L").cast("long") * F.pow(F.lit(2), s["at"]).cast("long")).otherwise(F.lit(0).cast("long"))).alias("bits"), (s["at"] + 1).alias("at")),
                       lambda s: s["bits"])


def hamming(a: Column, b: Column) -> Column:
    """Bits in which two packed masks differ."""
    return F.bit_count(a.bitwiseXOR(b))


def gray(red: Column, green: Column, blue: Column) -> Column:
    """BT.601 luma, rounded half to even."""
    return F.bround(0.299 * red + 0.587 * green + 0.114 * blue, 0).cast("int")


def effect(gold: Column) -> tuple[Column, Column]:
    """(G, S) of likelihoods whose last one is the sequence's: the greatest of the others, and the last."""
    return F.array_max(F.slice(gold, 1, F.size(gold) - 1)), F.element_at(gold, -1)


def utility(g: Column, s: Column, ok: Column) -> Column:
    """Rank of an outcome: admissible ones by (G - S, G, -S), others after them by (G, G - S, -S)."""
    return F.when(ok, F.struct(F.lit(1).alias("a"), (g - s).alias("b"), g.alias("c"), (-s).alias("d"))).otherwise(F.struct(F.lit(0).alias("a"), g.alias("b"), (g - s).alias("c"), (-s).alias("d")))
