"""Seeded augmentations of arrays: each case's copies draw their parameters from a hash of case, copy and salt.

A draw needs no state, so a lost task draws the same again, and all patches of a copy agree. Nothing here shuffles.
"""

from __future__ import annotations

import math
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridspan.functions.arrays import let, multiply
from gridspan.operators.schedules import signal_levels
from gridspan.operators.volume import Grid, displace, folded, gather, permute, voxels_of, warp

SPAN = 1 << 31


def uniform(case: Column, copy: Column, salt: int) -> Column:
    """A number in [0, 1) that case, copy and salt decide: two steps of a linear congruence."""
    seed = F.pmod(case, F.lit(SPAN)) + copy * 7919 + salt * 104729
    for _ in range(2):
        seed = F.pmod(seed * 1103515245 + 12345, F.lit(SPAN))
    return seed / F.lit(float(SPAN))


def normal(case: Column, copy: Column, salt: int) -> Column:
    """A standard normal number from two uniform ones."""
    return F.sqrt(-2 * F.log(1 - uniform(case, copy, salt))) * F.cos(2 * math.pi * uniform(case, copy, salt + 1))


def copies(arrays: DataFrame, n: int) -> DataFrame:
    return arrays.withColumn("copy", F.explode(F.array(*[F.lit(i).cast("long") for i in range(n)])))


def flip(values: Column, chosen: Column) -> Column:
    """Mirrored where chosen; its own inverse."""
    return F.when(chosen, F.reverse(values)).otherwise(values)


def translate(values: Column, shift: Column) -> Column:
    """Moved by a whole number of voxels, fewer than there are; what enters is reflected at the edge voxel."""
    last = F.size(values) - 1

    def source(i: Column) -> Column:
        at = F.abs(i - shift)
        return F.when(at > last, 2 * last - at).otherwise(at)

    return F.transform(values, lambda _, i: F.get(values, source(i).cast("int")))


def brightness_contrast(values: Column, added: Column, exponent: Column) -> Column:
    """(v + added) * 2 ** exponent."""
    return F.transform(values, lambda v: (v + added) * F.pow(F.lit(2.0), exponent))


def cut_out(values: Column, centre: Column, share: float, fill: float) -> Column:
    """Voxels within half of ``share`` of a relative centre get ``fill``."""
    return F.transform(values, lambda v, i: F.when(F.abs((i + 0.5) / F.size(values) - centre) < share / 2, F.lit(fill)).otherwise(v))


def chosen(case: Column, copy: Column, salt: int, probability: float) -> Column:
    """Whether a copy is augmented at all."""
    return uniform(case, copy, salt) < probability


def between(case: Column, copy: Column, salt: int, low: float, high: float) -> Column:
    return low + (high - low) * uniform(case, copy, salt)


def integer(case: Column, copy: Column, salt: int, n: int) -> Column:
    """A number from 0 to n - 1."""
    return F.floor(uniform(case, copy, salt) * n).cast("int")


# Affine maps in coordinates from -1 to 1, x first: arrays of rows with a shift, one a copy.


def identity(rank: int) -> list[list[float]]:
    return [[float(i == j) for j in range(rank + 1)] for i in range(rank)]


def translation(shifts: list[Column], grid: Grid) -> Column:
    """By voxels along x, y, z."""
    extents = list(reversed(grid.shape))
    rank = len(extents)
    return F.array(*[F.array(*[F.lit(float(i == j)) for j in range(rank)], shifts[i] * 2.0 / max(extents[i] - 1, 1)) for i in range(rank)])


def rotation(angles: list[Column]) -> Column:
    """About x, then y, then z by angles; of one angle, in the plane."""
    zero, one = F.lit(0.0), F.lit(1.0)
    if len(angles) == 1:
        c, s = F.cos(angles[0]), F.sin(angles[0])
        return F.array(F.array(c, -s, zero), F.array(s, c, zero))
    (cx, sx), (cy, sy), (cz, sz) = [(F.cos(a), F.sin(a)) for a in angles]
    z = F.array(F.array(cz, -sz, zero), F.array(sz, cz, zero), F.array(zero, zero, one))
    y = F.array(F.array(cy, zero, sy), F.array(zero, one, zero), F.array(-sy, zero, cy))
    x = F.array(F.array(one, zero, zero), F.array(zero, cx, -sx), F.array(zero, sx, cx))
    return F.transform(multiply(multiply(z, y), x), lambda row: F.concat(row, F.array(zero)))


def scaling(factor: Column, rank: int) -> Column:
    return F.array(*[F.array(*[factor if i == j else F.lit(0.0) for j in range(rank + 1)]) for i in range(rank)])


def inverse_of(rows: Column) -> Column:
    """The inverse of an affine map of two or three axes, by cofactors."""

    def of(m: Column) -> Column:
        at = lambda i, j: F.get(F.get(m, F.lit(i)), F.lit(j))

        def by(rank: int) -> Column:
            if rank == 2:
                det = at(0, 0) * at(1, 1) - at(0, 1) * at(1, 0)
                inv = [[at(1, 1) / det, -at(0, 1) / det], [-at(1, 0) / det, at(0, 0) / det]]
            else:
                minor = lambda i, j: at((i + 1) % 3, (j + 1) % 3) * at((i + 2) % 3, (j + 2) % 3) - at((i + 1) % 3, (j + 2) % 3) * at((i + 2) % 3, (j + 1) % 3)
                det = at(0, 0) * minor(0, 0) + at(0, 1) * minor(0, 1) + at(0, 2) * minor(0, 2)
                inv = [[minor(j, i) / det for j in range(3)] for i in range(3)]
            return F.array(*[F.array(*row, -sum((row[j] * at(j, rank) for j in range(rank)), F.lit(0.0))) for row in inv])

        return F.when(F.size(m) == 2, by(2)).otherwise(by(3))

    return let(rows, of)


def euler(values: Column, grid: Grid, affine: Column, labels: bool = False) -> Column:
    """Sampled through an affine map, mirrored at the border; label maps take the nearest voxel."""
    return warp(values, grid, affine, "reflection", labels)


def quarter_turn(values: Column, grid: Grid, axes: tuple[int, int], turns: int) -> tuple[Column, Grid]:
    """An exact turn by quarters in the plane of two axes, and the grid that it leads to: no voxel is interpolated."""
    a, b = axes
    turns %= 4
    if turns == 0:
        return values, grid
    dims = list(range(len(grid.shape)))
    if turns % 2:
        dims[a], dims[b] = dims[b], dims[a]
    out = Grid(tuple(grid.shape[d] for d in dims))

    def where(at: list[Column]) -> list[Column]:
        there = [at[dims.index(d)] for d in range(len(dims))]
        if turns in (1, 2):
            there[b] = grid.shape[b] - 1 - there[b]
        if turns in (2, 3):
            there[a] = grid.shape[a] - 1 - there[a]
        return there

    return gather(values, grid, out, where), out


def vector_flip(components: list[Column], axis: int, chosen_: Column) -> list[Column]:
    """A mirrored vector field's components change sign along the mirrored axis; the arrays themselves are mirrored by ``volume.flip``."""
    return [F.when(chosen_, F.transform(c, lambda v: -v)).otherwise(c) if k == axis else c for k, c in enumerate(components)]


def shifted(values: Column, grid: Grid, by: list[Column]) -> Column:
    """Moved by whole voxels along each axis, mirrored at the edges."""
    return gather(values, grid, grid, lambda at: [folded(c - d, n, "reflect") for c, d, n in zip(at, by, grid.shape, strict=True)])


def cut_box(values: Column, grid: Grid, centre: list[Column], share: float, fill: float) -> Column:
    """``fill`` in the box of a relative size about a relative centre."""

    def at(c: list[Column]) -> Column:
        inside = F.lit(True)
        for x, n, m in zip(c, grid.shape, centre, strict=True):
            inside = inside & (F.abs((x + 0.5) / n - m) < share / 2)
        return F.when(inside, F.lit(fill)).otherwise(F.get(values, grid.place(c)))

    return voxels_of(grid, at)


# Colour: 4 x 4 maps of red, green and blue; grey volumes take their mean.


def colour(values: Column, channels: int, rows: Column) -> Column:
    """A colour map (4 x 4, or its first three rows) on a channel-first array of 3 channels, or of 1 by the mean over its rows."""
    n = F.floor(F.size(values) / channels).cast("int")

    def of(m: Column) -> Column:
        at = lambda i, j: F.get(F.get(m, F.lit(i)), F.lit(j))
        if channels == 1:
            factor = sum((at(i, j) for i in range(3) for j in range(3)), F.lit(0.0)) / 3
            added = sum((at(i, 3) for i in range(3)), F.lit(0.0)) / 3
            return F.transform(values, lambda v: v * factor + added)
        row = lambda i: F.transform(F.slice(values, F.lit(1), n), lambda r, k: at(i, 0) * r + at(i, 1) * F.get(values, k + n) + at(i, 2) * F.get(values, k + 2 * n) + at(i, 3))
        return F.concat(*map(row, range(3)))

    if channels not in (1, 3):
        raise ValueError("colour maps take 1 or 3 channels")
    return let(rows, of)


def brightness(added: Column) -> Column:
    return F.array(*[F.array(*[F.lit(float(i == j)) for j in range(3)], added) for i in range(3)])


def contrast(factor: Column) -> Column:
    return scaling(factor, 3)


def luma_flip(flipped: Column) -> Column:
    """Mirrored along the grey axis where ``flipped`` is 1."""
    return F.array(*[F.array(*[F.lit(float(i == j)) - flipped * (2 / 3) for j in range(3)], F.lit(0.0)) for i in range(3)])


def hue(angle: Column) -> Column:
    """A turn about the grey axis: grey stays grey."""
    c, s, k = F.cos(angle), F.sin(angle), 1 / math.sqrt(3)
    cross = [[0.0, -k, k], [k, 0.0, -k], [-k, k, 0.0]]
    return F.array(*[F.array(*[c * float(i == j) + (1 - c) / 3 + s * cross[i][j] for j in range(3)], F.lit(0.0)) for i in range(3)])


def saturation(factor: Column) -> Column:
    """What is not grey scaled."""
    return F.array(*[F.array(*[F.lit(1 / 3) + factor * (float(i == j) - 1 / 3) for j in range(3)], F.lit(0.0)) for i in range(3)])


def noise(values: Column, case: Column, copy: Column, step: Column, deviation: float, steps: int = 1000, salt: int = 0) -> Column:
    """The signal's share after ``step`` steps of diffusion, and normal noise for the rest; step 0 leaves values as they are."""
    levels = F.array(*map(F.lit, signal_levels(steps)))
    level = F.get(levels, step)
    return F.transform(values, lambda v, i: F.sqrt(level) * v + F.sqrt(1 - level) * normal(case * 31 + i, copy, salt) * deviation)


# Elastic warps: displacements from a lattice of drawn control points.


def bspline_weights(extent: int, cells: int) -> list[tuple[int, list[float]]]:
    """For each voxel the first of the four control points about it, and their cubic weights; the lattice spans the extent."""
    out = []
    for i in range(extent):
        at = i * cells / max(extent - 1, 1)
        first = min(int(at), cells - 1)
        t = at - first
        out.append((first, [(1 - t) ** 3 / 6, (3 * t**3 - 6 * t**2 + 4) / 6, (-3 * t**3 + 3 * t**2 + 3 * t + 1) / 6, t**3 / 6]))
    return out


def spline_basis(grid: Grid, cells: tuple[int, ...]) -> np.ndarray:
    """Weights of all control points for all voxels: voxels by control points, mostly 0."""
    axes = []
    for n, c in zip(grid.shape, cells, strict=True):
        m = np.zeros((n, c + 3))
        for i, (first, w) in enumerate(bspline_weights(n, c)):
            m[i, first : first + 4] = w
        axes.append(m)
    out = axes[0]
    for m in axes[1:]:
        out = np.einsum("ab,cd->acbd", out, m).reshape(out.shape[0] * m.shape[0], -1)
    return out


def elastic_field(case: Column, copy: Column, grid: Grid, spacing: int = 16, most: float = 16.0, salt: int = 0) -> list[Column]:
    """Displacements in voxels, an array for each axis: control points drawn within ``most``, a cubic spline between them."""
    cells = tuple(max(1, int(n / spacing + 0.5)) for n in grid.shape)
    basis = spline_basis(grid, cells)
    points = basis.shape[1]

    @F.arrow_udf("array<double>")
    def spread(drawn: pa.Array) -> pa.Array:
        rows = np.array(drawn.to_pylist(), float).reshape(-1, points)
        return pa.array((rows @ basis.T).tolist(), pa.list_(pa.float64()))

    draw = lambda axis: F.transform(F.sequence(F.lit(0), F.lit(points - 1)), lambda k: between(case * 31 + k, copy, salt + axis, -most, most))
    return [spread(draw(axis)) for axis in range(len(grid.shape))]


def elastic(df: DataFrame, values: str, grid: Grid, case: str, copy: str, spacing: int = 16, most: float = 16.0, labels: bool = False, salt: int = 0) -> DataFrame:
    """``values`` warped by a drawn spline, the edge voxel beyond the edge. It has no inverse."""
    names = [f"__f{k}" for k in range(len(grid.shape))]
    fields = df.withColumns(dict(zip(names, elastic_field(F.col(case), F.col(copy), grid, spacing, most, salt), strict=True)))
    return fields.withColumn(values, displace(F.col(values), grid, [F.col(n) for n in names], "border", labels)).drop(*names)


#: The two exchanges of axes that a copy may get, in this order.
EXCHANGES = ((1, 0, 2), (2, 0, 1))


def permute_array(grid: Grid, dims: tuple[int, ...], values: Column) -> Column:
    return permute(values, grid, dims)


def permuted_copy(values: Column, grid: Grid, first: bool, second: bool) -> tuple[Column, Grid]:
    """Axes exchanged by the chosen ones; three axes only."""
    if len(grid.shape) != 3:
        raise ValueError("axes are exchanged in three dimensions")
    for use, dims in zip((first, second), EXCHANGES, strict=True):
        if use:
            values, grid = let(values, partial(permute_array, grid, dims)), Grid(tuple(grid.shape[d] for d in dims))
    return values, grid


def placed_mask(values: Column, grid: Grid, mask: Column, mask_grid: Grid, position: list[Column], outside: float) -> Column:
    """The region of the mask's extent at a drawn position, ``outside`` where the mask is not 1 or the volume ends."""
    region = gather(values, grid, mask_grid, lambda at: [c + p for c, p in zip(at, position, strict=True)], outside)
    return F.zip_with(region, mask, lambda v, m: F.when(m == 1, v).otherwise(F.lit(outside)))


def foreign(function, values: Column, case: Column, copy: Column, seed: int = 0) -> Column:
    """Any function (array, random generator) -> array of another library, its generator seeded by case and copy: a lost task draws the same again."""
    @F.arrow_udf("array<double>")
    def run(v: pa.Array, i: pa.Array, c: pa.Array) -> pa.Array:
        rows = zip(v.to_pylist(), i.to_pylist(), c.to_pylist(), strict=True)
        out = [None if row is None else np.asarray(function(np.array(row, float), np.random.default_rng([seed, (k or 0) & (1 << 62) - 1, n or 0])), float).tolist() for row, k, n in rows]
        return pa.array(out, pa.list_(pa.float64()))

    return run(values, case, copy)

