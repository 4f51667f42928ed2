"""Histogram matching by levels: two distributed histograms, cumulative shares, and a monotone map.

A volume's histogram has ``levels`` equal bins from its mean to its greatest value. Where the cumulative share reaches a match
point, a knot lies, linear inside the bin; the least value, the mean and the greatest value are knots too. Values go piecewise linearly from
the knots of their own volume to those of the reference. Counts are added up before the shuffle: a row for each bin.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from gridspan.functions.arrays import let
from gridspan.operators import tiles
from gridspan.operators.tiles import Tiling

#: Bins and match points of the usual filter.
LEVELS, POINTS = 256, 1


def _joined(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    other = right.select(*[F.col(k).alias(f"__k_{k}") for k in keys], *[c for c in right.columns if c not in keys])
    meet = F.lit(True)
    for k in keys:
        meet = meet & F.col(k).eqNullSafe(F.col(f"__k_{k}"))
    return left.join(other, meet).drop(*[f"__k_{k}" for k in keys])


def knots(voxels: DataFrame, keys: list[str], value: str, levels: int = LEVELS, points: int = POINTS) -> DataFrame:
    """keys and knots (least, mean, match points, greatest) of each volume, from a row per voxel; null and NaN voxels don't count."""
    v = F.col(value).cast("double")
    held = voxels.select(*keys, v.alias("__v")).where(F.col("__v").isNotNull() & ~F.isnan("__v"))
    ends = held.groupBy(*keys).agg(F.min("__v").alias("__least"), F.avg("__v").alias("__mean"), F.max("__v").alias("__most"))
    width = (F.col("__most") - F.col("__mean")) / levels
    above = _joined(held, ends, keys).where((F.col("__v") >= F.col("__mean")) & (width > 0))
    counts = above.groupBy(*keys, F.least(F.floor((F.col("__v") - F.col("__mean")) / width), F.lit(levels - 1)).cast("int").alias("__bin")).agg(F.count("*").alias("__c"))
    own = Window.partitionBy(*keys)
    shares = counts.withColumns({"__upto": F.sum("__c").over(own.orderBy("__bin").rowsBetween(Window.unboundedPreceding, 0)), "__all": F.sum("__c").over(own)})
    placed = _joined(shares, ends, keys)

    def at(share: float) -> Column:
        need = F.col("__all") * share
        before = F.col("__upto") - F.col("__c")
        inside = (F.col("__upto") >= need) & (before < need)
        return F.max(F.when(inside, F.col("__mean") + (F.col("__bin") + (need - before) / F.col("__c")) * width))

    found = placed.groupBy(*keys).agg(F.array(*[at((j + 1) / (points + 1)) for j in range(points)]).alias("__inner"))
    whole = _left(ends, found, keys)
    # A constant volume has no bins: its mean stands for the match points.
    inner = F.coalesce("__inner", F.array_repeat("__mean", points))
    return whole.select(*keys, F.concat(F.array("__least", "__mean"), inner, F.array("__most")).alias("knots"))


def _left(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    other = right.select(*[F.col(k).alias(f"__k_{k}") for k in keys], *[c for c in right.columns if c not in keys])
    meet = F.lit(True)
    for k in keys:
        meet = meet & F.col(k).eqNullSafe(F.col(f"__k_{k}"))
    return left.join(other, meet, "left").drop(*[f"__k_{k}" for k in keys])


def mapped(value: Column, source: Column, target: Column, count: int) -> Column:
    """A value from one list of ``count`` knots to another, piecewise linear; a segment of no length goes to its upper end."""

    def of(k: Column) -> Column:
        out = F.get(k["t"], F.lit(0))
        for j in range(count - 1):
            a0, a1, b0, b1 = (F.get(k[c], F.lit(j + d)) for c, d in (("s", 0), ("s", 1), ("t", 0), ("t", 1)))
            out = F.when(k["v"] >= a0, F.when(a1 > a0, b0 + (k["v"] - a0) / (a1 - a0) * (b1 - b0)).otherwise(b1)).otherwise(out)
        return F.when(k["v"].isNull() | F.isnan(k["v"]), k["v"]).otherwise(out)

    return let(F.struct(value.cast("double").alias("v"), source.alias("s"), target.alias("t")), of)


def match(voxels: DataFrame, reference: DataFrame, keys: list[str], value: str, levels: int = LEVELS, points: int = POINTS) -> DataFrame:
    """``voxels`` with values matched to the reference volume of the same keys; volumes without one go."""
    source = knots(voxels, keys, value, levels, points).withColumnRenamed("knots", "__source")
    target = knots(reference, keys, value, levels, points).withColumnRenamed("knots", "__target")
    both = _joined(source, target, keys)
    return _joined(voxels, both, keys).withColumn(value, mapped(F.col(value), F.col("__source"), F.col("__target"), points + 3)).drop("__source", "__target")


def match_tiles(table: DataFrame, reference: DataFrame, keys: list[str], column: str, tiling: Tiling, reference_tiling: Tiling, levels: int = LEVELS, points: int = POINTS) -> DataFrame:
    """``match`` of tiled volumes: tiles give their ends and their bins' counts, and only these are shuffled."""

    def found(own: DataFrame, grid: Tiling, name: str) -> DataFrame:
        ends = tiles.statistics(own, keys, column, grid).select(*keys, "min", "mean", "max")

        def bins(x: np.ndarray, mean: float, most: float) -> list[np.ndarray]:
            if mean is None:
                return [np.zeros(levels)]
            x = x[x >= mean]
            width = (most - mean) / levels
            return [np.bincount(np.minimum(((x - mean) / width).astype(np.int64), levels - 1), minlength=levels).astype(float) if width > 0 else np.zeros(levels)]

        parts = tiles.map_tiles(own.join(ends, keys), keys, [column], grid, bins, ["bins"], ("mean", "max"))
        counts = parts.select(*keys, F.posexplode("bins").alias("bin", "c")).where("c > 0").groupBy(*keys, "bin").agg(F.sum("c").alias("c"))
        lists = counts.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("bin", "c"))).alias("held"))

        @F.udf("array<double>")
        def placed(least: float, mean: float, most: float, held: list) -> list:
            if not held:
                return [least, mean, *[mean] * points, most]
            upto = np.cumsum([h["c"] for h in held])
            need = upto[-1] * (np.arange(points) + 1) / (points + 1)
            at = np.searchsorted(upto, need, side="left")
            inner = [mean + (held[i]["bin"] + (n - (upto[i] - held[i]["c"])) / held[i]["c"]) * (most - mean) / levels for i, n in zip(at.tolist(), need.tolist(), strict=True)]
            return [least, mean, *map(float, inner), most]

        # One row a volume, of levels entries at most.
        return _left(ends, lists, keys).select(*keys, placed("min", "mean", "max", "held").alias(name))

    both = _joined(found(table, tiling, "source"), found(reference, reference_tiling, "target"), keys)

    def run(x: np.ndarray, source: list[float], target: list[float]) -> list[np.ndarray]:
        a, b = np.array(source, float), np.array(target, float)
        segment = np.clip(np.searchsorted(a, x, side="right") - 1, 0, len(a) - 2)
        length = a[segment + 1] - a[segment]
        out = np.where(length > 0, b[segment] + (x - a[segment]) / np.where(length > 0, length, 1) * (b[segment + 1] - b[segment]), b[segment + 1])
        return [np.where(np.isnan(x), x, out)]

    return tiles.map_tiles(_joined(table, both, keys), keys, [column], tiling, run, beside=("source", "target"))
