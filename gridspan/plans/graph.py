"""Named branches: a flow of steps that read and write columns by branch name, and the small operations between them.

A branch is an array column of a table with a row per sample. Steps run in order; a step reads the branches that it
names and writes one. Reading a branch that nothing wrote is an error before anything runs; a number that no branch
has falls back to the input.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridspan.functions.arrays import dot, let, total
from gridspan.operators import kernels
from gridspan.operators.volume import Grid, permute, voxels_of


@dataclass(frozen=True)
class Node:
    """A step of a flow: ``apply`` takes the input columns in order to a column."""

    name: str
    apply: Callable[..., Column]
    inputs: tuple[str, ...] = ("0",)
    output: str = "0"


@dataclass(frozen=True)
class Flow:
    nodes: tuple[Node, ...]

    def checked(self, branches: set[str]) -> Flow:
        names = [n.name for n in self.nodes]
        if len(set(names)) < len(names):
            raise ValueError("two steps have one name")
        known = set(branches)
        for n in self.nodes:
            unknown = [b for b in n.inputs if b not in known and not b.isdigit()]
            if unknown:
                raise ValueError(f"{n.name} reads {', '.join(unknown)}, which nothing wrote")
            known.add(n.output)
        return self

    def run(self, df: DataFrame, branches: dict[str, str]) -> DataFrame:
        """``df`` plus a column branch_<name> for each branch; ``branches`` maps the first ones' names to columns, the first of them is the input."""
        self.checked(set(branches))
        first = next(iter(branches.values()))
        out = df.withColumns({f"branch_{b}": F.col(c) for b, c in branches.items()} | ({} if "0" in branches else {"branch_0": F.col(first)}))
        known = set(branches) | {"0"}
        for n in self.nodes:
            columns = [F.col(f"branch_{b}" if b in known else "branch_0") for b in n.inputs]
            out = out.withColumn(f"branch_{n.output}", n.apply(*columns))
            known.add(n.output)
        return out


def concat(*parts: Column) -> Column:
    """Channels of all branches, one after the other."""
    return F.concat(*parts)


def add(*parts: Column) -> Column:
    out = parts[0]
    for p in parts[1:]:
        out = F.zip_with(out, p, lambda a, b: a + b)
    return out


def multiply(*parts: Column) -> Column:
    out = parts[0]
    for p in parts[1:]:
        out = F.zip_with(out, p, lambda a, b: a * b)
    return out


def negative(values: Column) -> Column:
    return F.transform(values, lambda v: -v)


def argmax(values: Column, grid: Grid, axis: int) -> Column:
    """Place of the greatest value along an axis, the first of ties; the axis goes."""
    out = Grid(tuple(n for k, n in enumerate(grid.shape) if k != axis))

    def bound(held: Column) -> Column:
        def best(at: list[Column]) -> Column:
            line = F.array(*[F.get(held, grid.place([*at[:axis], F.lit(k), *at[axis:]])) for k in range(grid.shape[axis])])
            return let(line, lambda x: F.array_position(x, F.array_max(x)) - 1)

        return voxels_of(out, best)

    return let(values, bound)


def select(values: Column, grid: Grid, slices: list[tuple[int, int, int]]) -> tuple[Column, Grid]:
    """(start, stop, step) along each axis."""
    out = Grid(tuple(len(range(*s)) for s in slices))
    return voxels_of(out, lambda at: F.get(values, grid.place([c * step + start for c, (start, _, step) in zip(at, slices, strict=True)]))), out


def view(grid: Grid, shape: list[int]) -> Grid:
    """Another reading of the same array; one extent may be -1."""
    known = 1
    for n in shape:
        known *= n if n != -1 else 1
    out = Grid(tuple(grid.size // known if n == -1 else n for n in shape))
    if out.size != grid.size:
        raise ValueError(f"{grid.shape} does not read as {shape}")
    return out


def flatten(grid: Grid) -> Grid:
    return Grid((grid.size,))


def squeeze(grid: Grid, axis: int) -> Grid:
    if grid.shape[axis] != 1:
        raise ValueError(f"axis {axis} has {grid.shape[axis]} voxels")
    return Grid(grid.shape[:axis] + grid.shape[axis + 1 :])


def unsqueeze(grid: Grid, axis: int) -> Grid:
    return Grid((*grid.shape[:axis], 1, *grid.shape[axis:]))


def to_channels(values: Column, grid: Grid) -> tuple[Column, Grid]:
    """The last axis first."""
    dims = (len(grid.shape) - 1, *range(len(grid.shape) - 1))
    return permute(values, grid, dims), Grid(tuple(grid.shape[d] for d in dims))


def to_features(values: Column, grid: Grid) -> tuple[Column, Grid]:
    """The first axis last."""
    dims = (*range(1, len(grid.shape)), 0)
    return permute(values, grid, dims), Grid(tuple(grid.shape[d] for d in dims))


def shape_of(grid: Grid) -> Column:
    return F.array(*map(F.lit, grid.shape))


def shape_of_voxels(voxels: DataFrame, keys: list[str], axes: list[str]) -> DataFrame:
    """Extents by the greatest coordinate, from the long form."""
    return voxels.groupBy(*keys).agg(F.array(*[(F.max(a) + 1).cast("int") for a in axes]).alias("shape"))


def identity(values: Column) -> Column:
    return values


def stop_here(reason: str = "stopped"):
    def apply(*_: Column) -> Column:
        raise RuntimeError(reason)

    return apply


def positional(values: Column, width: int, table: list[list[float]]) -> Column:
    """A token's own vector added to it: tokens of ``width`` values, one after the other."""
    flat = F.array(*[F.lit(x) for row in table for x in row])
    return F.transform(values, lambda v, i: v + F.get(flat, F.pmod(i, F.lit(width * len(table)))))


def attention(queries: Column, keys: Column, values: Column, tokens: int, width: int, heads: int = 1) -> Column:
    """softmax(Q K' / sqrt(d)) V by heads: tokens of ``width`` values, one after the other, heads side by side in each."""
    d = width // heads
    part = lambda x, t, h: F.slice(x, t * width + h * d + 1, F.lit(d))

    def of(t: Column) -> Column:
        def head(h: int) -> Column:
            scores = F.transform(F.sequence(F.lit(0), F.lit(tokens - 1)), lambda s: dot(part(queries, t, F.lit(h)), part(keys, s, F.lit(h))) / (d**0.5))

            def weighted(x: Column) -> Column:
                share = let(F.array_max(x), lambda m: F.transform(x, lambda v: F.exp(v - m)))
                return let(share, lambda w: let(total(w), lambda z: F.transform(F.sequence(F.lit(0), F.lit(d - 1)), lambda j: F.aggregate(F.transform(w, lambda v, s: v / z * F.get(values, s * width + h * d + j)), F.lit(0.0), lambda a, v: a + v))))

            return let(scores, weighted)

        return F.concat(*[head(h) for h in range(heads)])

    return F.flatten(F.transform(F.sequence(F.lit(0), F.lit(tokens - 1)), of))


def pool(values: Column, grid: Grid, size: tuple[int, ...], kind: str = "max") -> tuple[Column, Grid]:
    """Blocks of a size as their greatest value or their mean; what is left at the far side goes."""
    import itertools

    out = Grid(tuple(n // s for n, s in zip(grid.shape, size, strict=True)))

    def at(c: list[Column]) -> Column:
        held = F.array(*[F.get(values, grid.place([x * s + o for x, s, o in zip(c, size, off, strict=True)])) for off in itertools.product(*map(range, size))])
        return F.array_max(held) if kind == "max" else let(held, lambda h: total(h) / F.size(h))

    return voxels_of(out, at), out


def convolve(values: Column, grid: Grid, kernel: list[list[float]] | list, bias: float = 0.0) -> Column:
    """Weighted sums over the box about each voxel, 0 beyond the edge: ``kernel`` is nested lists of odd extents."""
    import numpy as np

    k = np.asarray(kernel, float)
    half = [n // 2 for n in k.shape]

    def at(c: list[Column]) -> Column:
        out = F.lit(bias)
        for off in np.ndindex(*k.shape):
            if k[off]:
                there = [x + o - h for x, o, h in zip(c, off, half, strict=True)]
                out = out + F.when(grid.inside(there), F.get(values, grid.place(there)) * float(k[off])).otherwise(0.0)
        return out

    return voxels_of(grid, at)


def residual(values: Column, block: Callable[[Column], Column]) -> Column:
    """max(0, x + block(x))."""
    return let(values, lambda v: F.zip_with(v, block(v), lambda a, b: F.greatest(a + b, F.lit(0.0))))


def reparametrised(mean: Column, log_deviation: Column, noise: Column) -> Column:
    """mean + exp(log deviation) * noise."""
    spread = F.zip_with(log_deviation, noise, lambda s, n: F.exp(s) * n)
    return F.zip_with(mean, spread, lambda m, s: m + s)


def attention_gate(x: Column, gate: Column, grid: Grid, w_x: list[list[float]], w_g: list[list[float]], psi: list[float], biases: tuple[list[float], list[float], float] | None = None) -> Column:
    """``x`` times its attention: what both inputs' channels say at half resolution, through a rectifier and a logistic function, repeated to full size.

    ``x`` is channel first on ``grid`` of even extents, ``gate`` channel first on half of it; ``w_x`` and ``w_g`` have a row for each inner
    channel, ``psi`` a factor. Biases are those of the three, 0 without. Null inputs give null.
    """
    if any(n % 2 for n in grid.shape):
        raise ValueError("a gate halves even extents")
    half = Grid(tuple(n // 2 for n in grid.shape))
    a, b, c = np.array(w_x, float), np.array(w_g, float), np.array(psi, float)
    bx, bg, bp = biases or ([0.0] * len(w_x), [0.0] * len(w_g), 0.0)
    every = (slice(None), *[slice(None, None, 2)] * len(grid.shape))

    @F.arrow_udf("array<double>")
    def run(rows: pa.Array, gates: pa.Array) -> pa.Array:
        out = []
        for r, g in zip(kernels.rows_of(rows), kernels.rows_of(gates), strict=True):
            if r is None or g is None:
                out.append(None)
                continue
            full, low = r.reshape(a.shape[1], *grid.shape), g.reshape(b.shape[1], half.size)
            inner = a @ full[every].reshape(a.shape[1], -1) + b @ low + np.add(bx, bg)[:, None]
            share = (1 / (1 + np.exp(-(c @ np.maximum(inner, 0) + bp)))).reshape(half.shape)
            for axis in range(share.ndim):
                share = np.repeat(share, 2, axis)
            out.append((full * share).ravel())
        return kernels.list_column(out)

    return run(x.cast("array<double>"), gate.cast("array<double>"))
