"""Criteria in the space of features: any function of a batch of images takes the network's part, the analytic rest is here.

A feature function takes an array (rows, voxels) and gives an array (rows, features), or a list of these, one a layer.
It runs where the rows lie, on Arrow batches, and is loaded once a worker.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridspan.operators import metrics, pointwise
from gridspan.operators.volume import Grid, patches


def layers_of(function: Callable, image: Column, rows: int = 32) -> Column:
    """An array of feature arrays, one a layer, of each row's image; null for null. Images of a batch are of one length, ``rows`` at a time."""

    @F.arrow_udf("array<array<double>>")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            held, out = batch.to_pylist(), [None] * len(batch)
            known = [k for k, r in enumerate(held) if r is not None]
            for at in range(0, len(known), rows):
                part = known[at : at + rows]
                answer = function(np.array([held[k] for k in part], float))
                answer = answer if isinstance(answer, (list, tuple)) else [answer]
                for i, k in enumerate(part):
                    out[k] = [np.asarray(layer[i], float).ravel().tolist() for layer in answer]
            yield pa.array(out, pa.list_(pa.list_(pa.float64())))

    return run(image)


def perceptual(df: DataFrame, function: Callable, output: str, target: str, weights: list[float], name: str = "loss", squared: bool = False) -> DataFrame:
    """``df`` plus the weighted sum, over layers, of the mean difference between both images' features."""
    both = df.withColumns({"__a": layers_of(function, F.col(output)), "__b": layers_of(function, F.col(target))})
    layer = lambda k, w: w * metrics.feature_distance(F.get("__a", F.lit(k)), F.get("__b", F.lit(k)), squared)
    return both.withColumn(name, sum((layer(k, w) for k, w in enumerate(weights) if w), F.lit(0.0))).drop("__a", "__b")


def style(df: DataFrame, function: Callable, output: str, target: str, weights: list[float], channels: list[int], name: str = "loss") -> DataFrame:
    """``df`` plus the weighted sum, over layers, of the differences of both images' channel products."""
    both = df.withColumns({"__a": layers_of(function, F.col(output)), "__b": layers_of(function, F.col(target))})
    layer = lambda k, w: w * pointwise.gram_distance(F.get("__a", F.lit(k)), F.get("__b", F.lit(k)), channels[k])
    return both.withColumn(name, sum((layer(k, w) for k, w in enumerate(weights) if w), F.lit(0.0))).drop("__a", "__b")


def tiled(df: DataFrame, keys: list[str], function: Callable, output: str, target: str, grid: Grid, tile: tuple[int, ...], weights: list[float]) -> DataFrame:
    """keys and the mean, over disjoint tiles of both images, of their perceptual difference."""
    none = (0,) * len(tile)
    a = patches(df.select(*keys, F.col(output).alias("a")), keys, "a", grid, tile, none)
    b = patches(df.select(*keys, F.col(target).alias("b")), keys, "b", grid, tile, none)
    pairs = a.join(b, [*keys, "patch_idx"])
    return perceptual(pairs, function, "a", "b", weights, "__loss").groupBy(*keys).agg(F.avg("__loss").alias("loss"))


def projected(df: DataFrame, function: Callable, output: str, target: str, k: int, name: str = "loss") -> DataFrame:
    """``df`` plus the mean absolute difference of the first layer's features on the target features' k principal axes."""
    first = lambda c: F.get(layers_of(function, F.col(c)), F.lit(0))
    both = df.withColumns({"__a": first(output), "__b": first(target)})
    mean, axes = metrics.principal_axes(both, "__b", k)
    return both.withColumn(name, metrics.feature_distance(metrics.project(F.col("__a"), mean, axes), metrics.project(F.col("__b"), mean, axes))).drop("__a", "__b")


def frechet(a: DataFrame, b: DataFrame, function: Callable, image: str) -> float:
    """Fréchet distance between the features of two sets of images."""
    of = lambda df: df.select(F.get(layers_of(function, F.col(image)), F.lit(0)).alias("v"))
    return metrics.frechet_distance(of(a), of(b), "v")
