"""Interval and box joins: which regions overlap, without testing all pairs.

Boxes are binned to cells of a grid whose size doubles and redoubles by levels: a box has the level at which it spans a few cells. A
pair is looked for at the coarser of its two levels, so a long box is not cut into many small cells for the sake of short ones, and it
is tested exactly once, in the first cell that both boxes have along every axis.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A level's cells are so many times the one before's; a box spans at most this many cells and one of its own level.
FACTOR = 8


@dataclass(frozen=True)
class Axis:
    """Names of the columns that hold a box's ends, [start, stop)."""

    left: tuple[str, str]
    right: tuple[str, str]


def _level(extents: list[Column], sizes: list[float], top: int) -> Column:
    """The least level at which no axis spans more than FACTOR cells."""
    out = F.lit(top)
    for level in reversed(range(top)):
        fits = F.lit(True)
        for e, s in zip(extents, sizes, strict=True):
            fits = fits & (e <= s * FACTOR ** (level + 1))
        out = F.when(fits, level).otherwise(out)
    return out


def _celled(df: DataFrame, ends: list[tuple[str, str]], sizes: list[float], top: int, name: str) -> DataFrame:
    """A row for each level from the box's own on, and each cell that it meets there."""
    extents = [F.col(b) - F.col(a) for a, b in ends]
    filled = df
    for a, b in ends:
        filled = filled.where(F.col(a) < F.col(b))
    out = filled.withColumn(f"__{name}_own", _level(extents, sizes, top)).withColumn("__level", F.explode(F.sequence(f"__{name}_own", F.lit(top))))
    for k, ((a, b), s) in enumerate(zip(ends, sizes, strict=True)):
        width = F.lit(float(s)) * F.pow(F.lit(float(FACTOR)), F.col("__level"))
        first = F.floor(F.col(a) / width)
        out = out.withColumns({f"__{name}_first{k}": first, f"__cell{k}": F.explode(F.sequence(first, F.floor(F.col(b) / width)))})
    return out


def overlapping(left: DataFrame, right: DataFrame, keys: list[str], axes: Sequence[Axis], sizes: Sequence[float] | None = None) -> DataFrame:
    """All pairs of rows with equal keys whose boxes overlap along every axis: the columns of both sides, each pair once.

    ``sizes`` are the finest cells' extents, by default the mean extent of the left side's boxes. Columns other than the keys must have
    different names on the two sides. Boxes that are empty or have a null end overlap nothing; null keys meet nothing. Repeated rows
    give a pair each. A cell that many boxes share is split by the join, not gathered.
    """
    ends = [(f.left, f.right) for f in axes]
    lengths = [e for a, b in ends for e in (F.col(a[1]) - F.col(a[0]),)]
    facts = left.agg(*[F.avg(F.when(e > 0, e)).alias(f"m{k}") for k, e in enumerate(lengths)], *[F.max(e).alias(f"l{k}") for k, e in enumerate(lengths)]).first()
    other = right.agg(*[F.max(F.col(b[1]) - F.col(b[0])).alias(f"l{k}") for k, (_, b) in enumerate(ends)]).first()
    own = list(sizes) if sizes else [float(facts[f"m{k}"] or 1) for k in range(len(axes))]
    longest = [max(float(facts[f"l{k}"] or 0), float(other[f"l{k}"] or 0)) for k in range(len(axes))]
    top = max([0, *(math.ceil(math.log(n / s, FACTOR)) for n, s in zip(longest, own, strict=True) if n > s)])
    a = _celled(left, [x for x, _ in ends], own, top, "a")
    b = _celled(right, [y for _, y in ends], own, top, "b")
    cells = [f"__cell{k}" for k in range(len(axes))]
    met = a.join(b, [*keys, "__level", *cells]).where(F.col("__level") == F.greatest("__a_own", "__b_own"))
    for k, (x, y) in enumerate(ends):
        met = met.where((F.col(f"__cell{k}") == F.greatest(f"__a_first{k}", f"__b_first{k}")) & (F.col(x[0]) < F.col(y[1])) & (F.col(y[0]) < F.col(x[1])))
    return met.drop("__level", "__a_own", "__b_own", *cells, *[f"__{s}_first{k}" for s in "ab" for k in range(len(axes))])
