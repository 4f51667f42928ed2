"""Array expressions that the operators share. All are columns: they run inside the row, without a shuffle."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Elements that one fold appends to; each append copies the array so far, so longer arrays go by blocks.
BLOCK = 256


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is computed once per row; a column that is repeated inside a lambda would be computed for each element."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def total(values: Column) -> Column:
    """Sum of an array of doubles; 0 for an empty one, null for null or where an element is null."""
    return F.aggregate(values, F.lit(0.0), lambda a, v: a + v)


def average(values: Column) -> Column:
    """Mean of an array; null for an empty one."""
    return F.when(F.size(values) > 0, total(values) / F.size(values))


def sample_variance(values: Column) -> Column:
    """Variance by n - 1; 0 for one element."""

    def of(v: Column) -> Column:
        return let(average(v), lambda m: F.when(F.size(v) > 1, total(F.transform(v, lambda x: (x - m) * (x - m))) / (F.size(v) - 1)).when(F.size(v) == 1, 0.0))

    return let(values, of)


def dot(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: x * y))


def clean(values: Column) -> Column:
    """Without NaN and null elements."""
    return F.filter(values, lambda v: v.isNotNull() & ~F.isnan(v))


def quantile(values: Column, q: float) -> Column:
    """By linear interpolation between the nearest ranks of a row's own array; NaN and null are skipped."""

    def of(v: Column) -> Column:
        place = (F.size(v) - 1) * F.lit(q)
        low = F.floor(place).cast("int")
        first, second = F.get(v, low), F.get(v, F.least(low + 1, F.size(v) - 1))
        return first + (second - first) * (place - low)

    return let(F.array_sort(clean(values)), of)


def _fold(xs: Column, first: Column, merge) -> Column:
    return F.aggregate(xs, F.array(first), lambda done, x: F.concat(done, F.array(merge(F.element_at(done, -1), x))))


def running(xs: Column, zero: Column, merge: Callable[[Column, Column], Column]) -> Column:
    """For each element ``zero`` merged with all elements before it. ``merge`` must be associative, ``zero`` of the elements' type."""

    def over(xs: Column) -> Column:
        blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(xs) - 1) / BLOCK).cast("int")), lambda k: F.slice(xs, k * BLOCK + 1, F.lit(BLOCK)))
        return let(blocks, lambda blocks: let(_fold(F.transform(blocks, lambda b: F.aggregate(b, zero, merge)), zero, merge), lambda before: F.flatten(F.transform(blocks, lambda b, k: F.slice(_fold(b, F.get(before, k), merge), 1, F.size(b))))))

    return let(xs, lambda xs: F.when(F.size(xs) == 0, F.slice(xs, 1, 0)).otherwise(over(xs)))


def matrix(rows: list[list[float]]) -> Column:
    return F.array(*[F.array(*[F.lit(float(x)) for x in row]) for row in rows])


def apply_matrix(rows: Column, vector: Column) -> Column:
    """Each row's product with a vector; a row that is longer by one holds a shift."""
    return F.transform(rows, lambda r: dot(F.slice(r, F.lit(1), F.size(vector)), vector) + F.coalesce(F.get(r, F.size(vector)), F.lit(0.0)))


def multiply(a: Column, b: Column) -> Column:
    """The product of two matrices, arrays of rows."""
    return F.transform(a, lambda row: F.transform(F.sequence(F.lit(0), F.size(F.get(b, F.lit(0))) - 1), lambda j: F.aggregate(F.zip_with(row, b, lambda x, other: x * F.get(other, j)), F.lit(0.0), lambda s, x: s + x)))
