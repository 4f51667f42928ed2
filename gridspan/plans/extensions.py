"""Configured parts by name: criteria, reductions, schedules, blendings, selectors, augmentations, sources and sinks.

A part is named in a configuration as {name: settings}. The name is one registered in ``REGISTRY`` for its kind, or ``module:attribute`` of
any library; settings are its keyword arguments, and unknown ones are errors. The functions here are what use each kind.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridspan.operators import augment, metrics, reductions, schedules, tiles, volume
from gridspan.operators.tiles import Tiling
from gridspan.operators.volume import Grid
from gridspan.plans.registry import REGISTRY
from gridspan.sources import ranges, volumes

Config = dict | str


def build(kind: str, config: Config) -> tuple[str, Callable]:
    """The name, and the part with its settings bound: calling it adds what the kind's user gives."""
    (name, settings), *more = ({config: {}} if isinstance(config, str) else config).items()
    if more:
        raise ValueError(f"one name for a {kind}, not {sorted(config)}")
    part = REGISTRY.find(kind, name)

    def call(*args, **kwargs):
        try:
            return part(*args, **(settings or {}), **kwargs)
        except TypeError as e:
            raise ValueError(f"{kind} {name}: {e}") from None

    return name, call


# Criteria take (df, keys, output, target) to keys and value: aggregates with partial sums before the shuffle.


def _regression(column: str):
    def of(df: DataFrame, keys: list[str], output: str, target: str, mask: str | None = None, data_range: float = 4095.0) -> DataFrame:
        report = metrics.regression_report(df, keys, F.col(output), F.col(target), None if mask is None else F.col(mask) == 1, data_range)
        return report.select(*keys, F.col(column).alias("value"))

    return of


for _name, _column in (("MAE", "mae"), ("MSE", "mse"), ("ME", "me"), ("PSNR", "psnr")):
    REGISTRY.add("criterion", _name, _regression(_column))


@REGISTRY.register("criterion", "Dice")
def _dice(df: DataFrame, keys: list[str], output: str, target: str, mask: str | None = None, labels: list[int] | None = None) -> DataFrame:
    """Mean over the labels."""
    return metrics.dice(df, keys, output, target, mask, labels).groupBy(*keys).agg(F.avg("dice").alias("value"))


@REGISTRY.register("criterion", "Accuracy")
def _accuracy(df: DataFrame, keys: list[str], output: str, target: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.avg((F.col(output) == F.col(target)).cast("double")).alias("value"))


def evaluate(df: DataFrame, keys: list[str], output: str, target: str, criteria: list[Config]) -> DataFrame:
    """keys, metric, value: each criterion's value of each group."""
    out = None
    for config in criteria:
        name, part = build("criterion", config)
        one = part(df, keys, output, target).select(*keys, F.lit(name).alias("metric"), F.col("value").cast("double").alias("value"))
        out = one if out is None else out.unionByName(one)
    if out is None:
        raise ValueError("no criterion")
    return out


# Reductions take (members, keys, value) to a row for each keys.

for _name, _part in (("Mean", reductions.mean), ("Median", reductions.lower_median), ("Variance", reductions.variance), ("StandardDeviation", reductions.deviation)):
    REGISTRY.add("reduction", _name, _part)


def reduced(members: DataFrame, keys: list[str], value: str, config: Config) -> DataFrame:
    return build("reduction", config)[1](members, keys, value)


# Schedules take a column of steps to a column of factors.

for _name, _part in (("Constant", schedules.constant), ("CosineAnnealing", schedules.cosine_annealing), ("Warmup", schedules.warmup), ("Polynomial", schedules.polynomial)):
    REGISTRY.add("schedule", _name, _part)


def scheduled(steps: DataFrame, step: str, name: str, parts: list[Config]) -> DataFrame:
    """``steps`` plus the product of the schedules' factors."""
    factor = F.lit(1.0)
    for config in parts:
        factor = factor * build("schedule", config)[1](F.col(step))
    return steps.withColumn(name, factor)


# Blendings take (patch, overlap) along an axis to weights.

for _name, _kind in (("Mean", "mean"), ("Cosinus", "cosinus"), ("Gaussian", "gaussian")):
    REGISTRY.add("blending", _name, lambda patch, overlap, _kind=_kind: volume.axis_weights(_kind, patch, overlap))


def blended(pieces: DataFrame, keys: list[str], column: str, tiling: Tiling, patch: tuple[int, ...], overlap: tuple[int, ...], config: Config) -> DataFrame:
    return tiles.blend(pieces, keys, column, tiling, patch, overlap, build("blending", config)[1])


# Selectors take (catalog, case) to the rows that stay.


@REGISTRY.register("selector", "Matching")
def _matching(catalog: DataFrame, case: str, pattern: str) -> DataFrame:
    return catalog.where(F.col(case).cast("string").rlike(pattern))


@REGISTRY.register("selector", "Without")
def _without(catalog: DataFrame, case: str, cases: list) -> DataFrame:
    return catalog.where(~F.col(case).isin(cases) | F.col(case).isNull())


def selected(catalog: DataFrame, case: str, parts: list[Config]) -> DataFrame:
    for config in parts:
        catalog = build("selector", config)[1](catalog, case)
    return catalog


# Augmentations take (values, grid, case, copy) to values of the same grid.


@REGISTRY.register("augmentation", "Flip")
def _flip(values: Column, grid: Grid, case: Column, copy: Column, axes: list[int], salt: int = 0) -> Column:
    return volume.flip(values, grid, tuple(axes))


@REGISTRY.register("augmentation", "Scale")
def _scale(values: Column, grid: Grid, case: Column, copy: Column, deviation: float = 0.2, salt: int = 0, labels: bool = False) -> Column:
    return augment.euler(values, grid, augment.scaling(F.pow(F.lit(2.0), augment.normal(case, copy, salt) * deviation), len(grid.shape)), labels)


@REGISTRY.register("augmentation", "Translate")
def _translate(values: Column, grid: Grid, case: Column, copy: Column, most: float, salt: int = 0, labels: bool = False) -> Column:
    shifts = [augment.between(case, copy, salt + k, -most, most) for k in range(len(grid.shape))]
    return augment.euler(values, grid, augment.translation(shifts, grid), labels)


REGISTRY.add("augmentation", "Foreign", lambda values, grid, case, copy, function, seed=0: augment.foreign(function, values, case, copy, seed))


def augmented(df: DataFrame, column: str, grid: Grid, case: str, copy: str, parts: list[Config], probability: float = 1.0) -> DataFrame:
    """Each copy through the parts in order, each part with ``probability``, drawn by case, copy and the part's place; copy 0 stays as it is."""
    for k, config in enumerate(parts):
        moved = build("augmentation", config)[1](F.col(column), grid, F.col(case), F.col(copy))
        use = (F.col(copy) != 0) & augment.chosen(F.col(case), F.col(copy), 7001 + k, probability)
        df = df.withColumn("__moved", moved).withColumn(column, F.when(use, F.col("__moved")).otherwise(F.col(column))).drop("__moved")
    return df


# Sources take (spark, path) to rows, sinks (rows, path).

REGISTRY.add("source", "Planes", ranges.planes)
REGISTRY.add("source", "Heads", ranges.heads)
REGISTRY.add("source", "Volumes", lambda spark, path: volumes.read(volumes.files(spark, path)))
for _kind in ("mha", "npy", "zarr"):
    REGISTRY.add("sink", _kind, lambda rows, path, _kind=_kind: volumes.write(rows, path, _kind))


def read(spark: SparkSession, path: str, config: Config) -> DataFrame:
    return build("source", config)[1](spark, path)


def write(rows: DataFrame, path: str, config: Config) -> None:
    build("sink", config)[1](rows, path)
