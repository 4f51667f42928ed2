"""Chains of transforms: what each reads of its surroundings, whether a patch suffices, and how to undo it.

A step is an expression of an array column on a grid, and names its locality. The locality decides what a
patch of the output needs of the input: the same voxel, some voxels around, another place, the statistics of
the volume, or all of it. So a chain can be checked before it runs, and the region that a patch needs is known.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from enum import Enum

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridspan.functions import parse
from gridspan.functions.arrays import let
from gridspan.operators import kernels, tiles
from gridspan.operators.tiles import Tiling
from gridspan.operators.volume import Grid, shifted_origin
from gridspan.plans.registry import REGISTRY


class Kind(Enum):
    POINTWISE = "pointwise"
    HALO = "halo"
    ORIENTATION = "orientation"
    CROP = "crop"
    GLOBAL_STAT = "global statistics"
    RESCALE = "rescale"
    SLAB = "slab"
    WHOLE_VOLUME = "whole volume"


@dataclass(frozen=True)
class Locality:
    kind: Kind
    halo: tuple[int, ...] = ()
    keys: tuple[str, ...] = ()

    def shuffles(self) -> bool:
        """Whether the long form needs an exchange."""
        return self.kind not in (Kind.POINTWISE, Kind.ORIENTATION, Kind.CROP)


POINTWISE = Locality(Kind.POINTWISE)


@dataclass(frozen=True)
class Step:
    """``apply`` and ``undo`` take (values, grid) to values; ``shape`` takes a grid to the one after.

    A step that can only be undone with what it saw names it: ``see`` takes values to columns by key, ``undo_seen`` takes (values, grid,
    what was seen). ``offset`` is the place, in voxels, of the new first voxel. On tiles, ``kernel`` takes an array, and the statistics that the
    locality names by key, to an array; ``tiled`` takes (tiles, keys, column, tiling) to tiles and their tiling.
    """

    name: str
    apply: Callable[[Column, Grid], Column]
    undo: Callable[[Column, Grid], Column] | None = None
    shape: Callable[[Grid], Grid] = lambda grid: grid
    locality: Locality = POINTWISE
    see: Callable[[Column], dict[str, Column]] | None = None
    undo_seen: Callable[[Column, Grid, dict[str, Column]], Column] | None = None
    offset: Callable[[Grid], tuple[int, ...]] | None = None
    kernel: Callable[..., np.ndarray] | None = None
    tiled: Callable[[DataFrame, list[str], str, Tiling], tuple[DataFrame, Tiling]] | None = None
    invert: bool = True


#: The attributes that say where a volume lies.
ORIGIN, SPACING, DIRECTION = "Origin", "Spacing", "Direction"


def _text(values: Column) -> Column:
    return F.concat(F.lit("["), F.array_join(F.transform(values, lambda v: v.cast("string")), " "), F.lit("]"))


def _on(operation: Callable[[Column, Grid], Column], grid: Grid) -> Callable[[Column], Column]:
    return lambda values: operation(values, grid)


def _bound(df: DataFrame, column: str, step: Step, operation: Callable[[Column, Grid], Column], grid: Grid) -> DataFrame:
    """The column through one step. An expression gets its argument bound first; a Python function runs on columns alone.

    Spark would write the steps before into a Python function's argument, and doesn't find the function again where that holds nested
    lambdas: a generated row of one keeps them apart.
    """
    if step.locality.kind in (Kind.WHOLE_VOLUME, Kind.RESCALE):
        return df.withColumn(column, F.explode(F.array(column))).withColumn(column, operation(F.col(column), grid))
    return df.withColumn(column, let(F.col(column), _on(operation, grid)))


def _seen(step: Step, grid: Grid, keys: list[str]) -> Callable[[Column], Column]:
    return lambda held: step.undo_seen(held["values"], grid, {k: held[k] for k in keys})


def _composed(parts: list[Callable[[np.ndarray], np.ndarray]]) -> Callable[[np.ndarray], list[np.ndarray]]:
    def run(x: np.ndarray) -> list[np.ndarray]:
        for f in parts:
            x = f(x)
        return [x]

    return run


@dataclass(frozen=True)
class Chain:
    steps: tuple[Step, ...]

    def grids(self, grid: Grid) -> list[Grid]:
        """The grid before each step, and the last one: a fold over extents, no voxel is read."""
        out = [grid]
        for s in self.steps:
            out.append(s.shape(out[-1]))
        return out

    def apply(self, df: DataFrame, column: str, grid: Grid) -> DataFrame:
        """The column taken through all steps. Each step's result is bound before the next reads it."""
        for s, g in zip(self.steps, self.grids(grid), strict=False):
            df = _bound(df, column, s, s.apply, g)
        return df

    def undo(self, df: DataFrame, column: str, grid: Grid) -> DataFrame:
        """The steps' inverses in reverse order, for a column of the last grid; steps without one are an error."""
        lacking = [s.name for s in self.steps if s.undo is None]
        if lacking:
            raise ValueError(f"no inverse: {', '.join(lacking)}")
        for s, g in reversed(list(zip(self.steps, self.grids(grid), strict=False))):
            df = _bound(df, column, s, s.undo, g)
        return df

    def apply_recorded(self, df: DataFrame, column: str, grid: Grid, attributes: str = "attributes") -> DataFrame:
        """``apply``, with each step pushing what it saw on the stacks of the map column ``attributes`` (made if missing).

        A step that moves the first voxel pushes the new origin where the row's attributes have a geometry.
        """
        if attributes not in df.columns:
            df = df.withColumn(attributes, F.create_map().cast("map<string,array<string>>"))
        for s, g in zip(self.steps, self.grids(grid), strict=False):
            held = F.col(attributes)
            if s.see:
                for key, value in s.see(F.col(column)).items():
                    held = parse.push(held, key, value)
            if s.offset:
                start = F.array(*[F.lit(float(a)) for a in reversed(s.offset(g))])
                moved = shifted_origin(*[parse.numbers(parse.peek(F.col(attributes), k)) for k in (ORIGIN, SPACING, DIRECTION)], start)
                held = F.when(moved.isNull(), held).otherwise(parse.push(held, ORIGIN, _text(moved)))
            df = Chain((s,)).apply(df.withColumn(attributes, held), column, g)
        return df

    def undo_recorded(self, df: DataFrame, column: str, grid: Grid, attributes: str = "attributes", strict: bool = False) -> DataFrame:
        """The steps' inverses in reverse order, each popping what its step pushed; steps without an inverse, as Clip, stay as they are, or are an error if ``strict``."""
        lacking = [s.name for s in self.steps if s.undo is None and s.undo_seen is None]
        if strict and lacking:
            raise ValueError(f"no inverse: {', '.join(lacking)}")
        for s, g in reversed(list(zip(self.steps, self.grids(grid), strict=False))):
            held = F.col(attributes)
            if s.invert and s.undo_seen:
                keys = list(s.see(F.col(column)))
                # Read from the map once a row, not once a voxel.
                seen = F.struct(F.col(column).alias("values"), *[parse.peek(held, k).try_cast("double").alias(k) for k in keys])
                df = df.withColumn(column, let(seen, _seen(s, g, keys)))
                for k in keys:
                    held = parse.pop(held, k)
            elif s.invert and s.undo:
                df = _bound(df, column, s, s.undo, g)
                # The least of a stack is the volume's own.
                held = F.when(F.size(F.try_element_at(held, F.lit(ORIGIN))) > 1, parse.pop(held, ORIGIN)).otherwise(held) if s.offset else held
            df = df.withColumn(attributes, held)
        return df

    def apply_tiles(self, table: DataFrame, keys: list[str], column: str, tiling: Tiling) -> tuple[DataFrame, Tiling]:
        """The chain on volumes of any size, tile by tile, and the tiling that comes out: steps that follow one another within their halos share one exchange."""
        at = 0
        while at < len(self.steps):
            s = self.steps[at]
            if s.locality.kind in (Kind.POINTWISE, Kind.HALO) and s.kernel:
                run = [s]
                while at + len(run) < len(self.steps) and (t := self.steps[at + len(run)]).kernel and t.locality.kind in (Kind.POINTWISE, Kind.HALO):
                    run.append(t)
                radius = sum(max(t.locality.halo, default=0) for t in run)
                one = _composed([t.kernel for t in run])
                table = tiles.with_halo(table, keys, [column], tiling, radius, one) if radius else tiles.map_tiles(table, keys, [column], tiling, one)
                at += len(run)
                continue
            if s.locality.kind is Kind.GLOBAL_STAT and s.kernel:
                seen = tiles.statistics(table, keys, column, tiling).select(*keys, *s.locality.keys)
                table = tiles.map_tiles(table.join(seen, keys), keys, [column], tiling, lambda x, *stats, f=s.kernel: [f(x, *stats)], beside=s.locality.keys)
            elif s.tiled:
                table, tiling = s.tiled(table, keys, column, tiling)
            else:
                raise ValueError(f"{s.name} needs {s.locality.kind.value}: it has no way on tiles")
            at += 1
        return table, tiling

    def locality(self, rank: int) -> Locality:
        """Of the chain as one step: halos add up, the strongest need of any step is the chain's."""
        halo, keys, kinds = [0] * rank, [], {s.locality.kind for s in self.steps}
        for s in self.steps:
            own = s.locality.halo or (0,)
            halo = [h + own[k if len(own) > 1 else 0] for k, h in enumerate(halo)]
            keys += s.locality.keys
        for kind in (Kind.WHOLE_VOLUME, Kind.RESCALE, Kind.ORIENTATION, Kind.CROP, Kind.SLAB):
            if kind in kinds:
                return Locality(kind, tuple(halo), tuple(keys))
        if any(halo):
            return Locality(Kind.HALO, tuple(halo), tuple(keys))
        return Locality(Kind.GLOBAL_STAT, keys=tuple(keys)) if keys or Kind.GLOBAL_STAT in kinds else POINTWISE

    def window(self, start: tuple[int, ...], stop: tuple[int, ...], grid: Grid) -> list[tuple[int, int]]:
        """The input region that a region of the output needs: widened by the halo; the whole for steps that need it."""
        own = self.locality(len(grid.shape))
        if own.kind in (Kind.POINTWISE, Kind.GLOBAL_STAT, Kind.HALO):
            halo = own.halo or (0,) * len(grid.shape)
            return [(max(0, a - h), min(n, b + h)) for a, b, h, n in zip(start, stop, halo, grid.shape, strict=True)]
        return [(0, n) for n in grid.shape]


def check_patch_steps(steps: list[Step], grid: Grid, at_prediction: bool = False) -> None:
    """Steps that run on patches may read their own voxel and the volume's statistics, keep the grid, and at prediction undo what they do."""
    for s in steps:
        if s.locality.kind not in (Kind.POINTWISE, Kind.GLOBAL_STAT):
            raise ValueError(f"{s.name} reads {s.locality.kind.value}: it runs on volumes, not on patches")
        if s.shape(grid).shape != grid.shape:
            raise ValueError(f"{s.name} changes the grid of a patch")
        if at_prediction and s.locality.kind is Kind.GLOBAL_STAT and s.undo is None:
            raise ValueError(f"{s.name} can't be undone on a patch at prediction")


@dataclass(frozen=True)
class GroupChain:
    """A source group's steps on volumes and on patches, and whether it is an input; metrics have no patch steps."""

    volume: Chain
    patch: Chain = Chain(())
    is_input: bool = True

    def checked(self, grid: Grid, at_prediction: bool = False) -> GroupChain:
        check_patch_steps(list(self.patch.steps), self.volume.grids(grid)[-1], at_prediction)
        return self


def fan_out(volumes: DataFrame, group: str, column: str, chains: dict[str, dict[str, Chain]], grid: Grid, dest: str = "dest") -> DataFrame:
    """Each source group to its destinations, each by a chain of its own: one scan, a union of projections."""
    out = None
    for source, targets in chains.items():
        for name, chain in targets.items():
            part = chain.apply(volumes.where(F.col(group) == source), column, grid).withColumn(dest, F.lit(name))
            out = part if out is None else out.unionByName(part)
    return out


def from_config(config: list[dict]) -> Chain:
    """A chain from a list of {name: settings}: factories are found by name, unknown settings are errors."""
    steps = []
    for entry in config:
        if len(entry) != 1:
            raise ValueError(f"one name a step, not {sorted(entry)}")
        (name, settings), *_ = entry.items()
        factory = REGISTRY.find("transform", name)
        try:
            steps.append(factory(**(settings or {})))
        except TypeError as e:
            raise ValueError(f"{name}: {e}") from None
    return Chain(tuple(steps))


def auto_patch(budget: float, worst: list[int], channels: int, item: int, free: list[int]) -> list[int]:
    """The largest disjoint patch of the worst case that fits a budget; 0 marks a free axis."""
    from gridspan.operators.volume import budgeted_patch

    return budgeted_patch(free, worst, channels, item, budget)


# Steps by name.


def _step(name: str):
    return REGISTRY.register("transform", name)


@_step("Clip")
def clip_step(min_value: float | str = -1024.0, max_value: float | str = 1024.0) -> Step:
    from gridspan.operators import pointwise

    bounds = tuple(str(b) for b in (min_value, max_value) if isinstance(b, str))
    return Step("Clip", lambda v, _: pointwise.clip(v, min_value, max_value), locality=Locality(Kind.GLOBAL_STAT, keys=bounds) if bounds else POINTWISE, kernel=None if bounds else lambda x: np.clip(x, min_value, max_value))


@_step("Normalize")
def normalize_step(min_value: float = -1.0, max_value: float = 1.0, inverse: bool = True) -> Step:
    from gridspan.functions.arrays import clean
    from gridspan.operators import pointwise

    if max_value <= min_value:
        raise ValueError(f"the range [{min_value}, {max_value}] is empty")

    def kernel(x: np.ndarray, least: float, most: float) -> np.ndarray:
        return (max_value - min_value) * (x - least) / (most - least) + min_value if most != least else np.full_like(x, min_value)

    return Step(
        "Normalize", lambda v, _: pointwise.normalize(v, min_value, max_value), locality=Locality(Kind.GLOBAL_STAT, keys=("min", "max")), kernel=kernel, invert=inverse,
        see=lambda v: {"Min": F.array_min(clean(v)), "Max": F.array_max(clean(v))}, undo_seen=lambda v, _, seen: pointwise.denormalize(v, min_value, max_value, seen["Min"], seen["Max"]),
    )


@_step("UnNormalize")
def unnormalize_step(min_value: float = -1024.0, max_value: float = 3071.0) -> Step:
    from gridspan.operators import pointwise

    return Step("UnNormalize", lambda v, _: pointwise.unnormalize(v, min_value, max_value), lambda v, _: pointwise.normalize(v, -1.0, 1.0, F.lit(min_value), F.lit(max_value)), kernel=lambda x: (x + 1) / 2 * (max_value - min_value) + min_value)


@_step("Standardize")
def standardize_step(inverse: bool = True) -> Step:
    from gridspan.functions.arrays import average, clean, sample_variance
    from gridspan.operators import pointwise

    return Step(
        "Standardize", lambda v, _: pointwise.standardize(v), locality=Locality(Kind.GLOBAL_STAT, keys=("mean", "std")), kernel=lambda x, mean, std: (x - mean) / std if std else x * 0.0, invert=inverse,
        see=lambda v: {"Mean": average(clean(v)), "Std": F.sqrt(sample_variance(clean(v)))}, undo_seen=lambda v, _, seen: pointwise.destandardize(v, seen["Mean"], seen["Std"]),
    )


@_step("Flip")
def flip_step(dims: list[int]) -> Step:
    from gridspan.operators import volume

    turn = lambda v, g: volume.flip(v, g, tuple(dims))
    return Step("Flip", turn, turn, locality=Locality(Kind.ORIENTATION), tiled=lambda t, keys, c, g: (tiles.flip(t, keys, [c], g, tuple(dims)), g))


@_step("Permute")
def permute_step(dims: list[int]) -> Step:
    from gridspan.operators import volume

    way = tuple(dims)
    turned = lambda g: Tiling(tuple(g.shape[d] for d in way), tuple(g.tile[d] for d in way))
    return Step(
        "Permute", lambda v, g: volume.permute(v, g, way), lambda v, g: volume.permute(v, volume.permuted(g, way), volume.inverse_dims(way)), lambda g: volume.permuted(g, way), Locality(Kind.ORIENTATION),
        tiled=lambda t, keys, c, g: (tiles.permute(t, keys, [c], g, turned(g), way), turned(g)),
    )


@_step("Padding")
def padding_step(before: list[int], after: list[int], mode: str = "constant", value: float = 0.0) -> Step:
    from gridspan.operators import volume

    a, b = tuple(before), tuple(after)
    inside = lambda v, g: volume.crop(v, volume.padded(g, a, b), a, tuple(n + x for n, x in zip(g.shape, a, strict=True)))
    wider = lambda g: Tiling(tuple(n + x + y for n, x, y in zip(g.shape, a, b, strict=True)), g.tile)
    return Step(
        "Padding", lambda v, g: volume.pad(v, g, a, b, mode, value), inside, lambda g: volume.padded(g, a, b), Locality(Kind.CROP),
        offset=lambda _: tuple(-x for x in a), tiled=lambda t, keys, c, g: (tiles.pad(t, keys, [c], g, wider(g), a, mode, value), wider(g)),
    )


@_step("Dilate")
def dilate_step(dilate: int = 1) -> Step:
    from gridspan.operators import volume

    return Step("Dilate", lambda v, g: volume.dilate(v, g, dilate), locality=Locality(Kind.HALO, (dilate,)) if dilate else POINTWISE, kernel=lambda x: kernels.dilate(x, dilate))


@_step("Gradient")
def gradient_step() -> Step:
    from gridspan.operators import volume

    return Step("Gradient", volume.gradient, locality=Locality(Kind.HALO, (1,)), kernel=kernels.gradient)


def _resized(out: Callable[[Grid], Grid], labels: bool):
    def run(t: DataFrame, keys: list[str], column: str, tiling: Tiling) -> tuple[DataFrame, Tiling]:
        target = Tiling(out(Grid(tiling.shape)).shape, tiling.tile)
        return tiles.resample(t, keys, column, tiling, target, labels), target

    return run


@_step("ResampleToShape")
def resample_step(shape: list[int], labels: bool = False) -> Step:
    from gridspan.operators import volume

    out = lambda g: volume.grid_of_shape(g, tuple(shape))
    return Step("ResampleToShape", lambda v, g: volume.resample(v, g, out(g), labels), lambda v, g: volume.resample(v, out(g), g, labels), out, Locality(Kind.RESCALE), tiled=_resized(out, labels))


@_step("ResampleToResolution")
def resolution_step(spacing: list[float], source: list[float], labels: bool = False) -> Step:
    from gridspan.operators import volume

    out = lambda g: volume.grid_of_spacing(g, source, spacing)
    return Step("ResampleToResolution", lambda v, g: volume.resample(v, g, out(g), labels), lambda v, g: volume.resample(v, out(g), g, labels), out, Locality(Kind.RESCALE), tiled=_resized(out, labels))


@_step("Foreign")
def foreign_step(function: Callable, name: str = "Foreign") -> Step:
    """Any function of an array of the grid's shape, of the same shape after: whole volumes, no inverse."""
    def apply(values: Column, grid: Grid) -> Column:
        @F.arrow_udf("array<double>")
        def run(rows: pa.Array) -> pa.Array:
            return pa.array([None if r is None else np.asarray(function(np.array(r, float).reshape(grid.shape)), float).ravel().tolist() for r in rows.to_pylist()], pa.list_(pa.float64()))

        return run(values)

    return Step(name, apply, locality=Locality(Kind.WHOLE_VOLUME))


def same_as_group(outputs: DataFrame, sources: DataFrame, keys: list[str], group: str, source: str, column: str, chain: Chain, grid: Grid, attributes: str = "attributes") -> DataFrame:
    """``outputs`` (keys, column) in the place of a source group: the group's chain is undone on them with what it recorded there, and its geometry is theirs.

    ``sources`` has a row per case and group, its attributes as ``Chain.apply_recorded`` left them. Outputs of a case without that group go.
    """
    recorded = sources.where(F.col(group) == source).select(*keys, attributes)
    undone = chain.undo_recorded(outputs.drop(attributes).join(recorded, keys), column, grid, attributes)
    return undone.withColumns({name.lower(): parse.numbers(parse.peek(F.col(attributes), name)) for name in (ORIGIN, SPACING, DIRECTION)})


def inference(volumes: DataFrame, column: str, grid: Grid, model: Callable, out: str, batch: int = 8) -> DataFrame:
    """``out``: a model's answer for each row's volume, a function of an array of volumes, loaded once a worker. Rows go in batches of bounded size."""
    @F.arrow_udf("array<double>")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for rows in batches:
            held = rows.to_pylist()
            parts = [np.asarray(model(np.array(held[k : k + batch], float).reshape(-1, *grid.shape)), float) for k in range(0, len(held), batch)]
            yield pa.array([r.ravel().tolist() for p in parts for r in p], pa.list_(pa.float64()))

    return volumes.withColumn(out, run(F.col(column)))

