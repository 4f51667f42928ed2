"""Patch grids, extraction with padding, and weighted reassembly."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def grid_axis(extent: int, patch: int, overlap: int) -> list[tuple[int, int]]:
    """(start, stop) of the patches along an axis; the last one ends at the extent and may be shorter."""
    out, start = [], 0
    while True:
        out.append((start, min(start + patch, extent)))
        if start + patch >= extent:
            return out
        start += patch - overlap


def grid(cases: DataFrame, case: str, extent: Column, patch: int, overlap: int) -> DataFrame:
    """case, patch_idx, start, stop for any extents: a generated sequence, no join."""
    step = patch - overlap
    count = F.when(extent <= patch, 1).otherwise(F.ceil((extent - patch) / step) + 1).cast("int")
    starts = F.transform(F.sequence(F.lit(0), count - 1), lambda i: i * step)
    rows = cases.select(case, extent.alias("__extent"), F.posexplode(starts).alias("patch_idx", "start"))
    return rows.select(case, "patch_idx", "start", F.least(F.col("start") + patch, "__extent").alias("stop"))


def extract(voxels: DataFrame, case: str, axis: str, value: str, extent: int, patch: int, overlap: int, fill: float) -> DataFrame:
    """case, patch_idx, offset, value: each voxel goes to the patches that hold it; short patches are padded at the far end."""
    cells = grid_axis(extent, patch, overlap)
    holders = F.array(*[F.struct(F.lit(k).alias("k"), F.lit(a).alias("a"), F.lit(b).alias("b")) for k, (a, b) in enumerate(cells)])
    inside = voxels.select(case, axis, value, F.explode(F.filter(holders, lambda h: (h["a"] <= F.col(axis)) & (F.col(axis) < h["b"]))).alias("h"))
    held = inside.select(case, F.col("h.k").alias("patch_idx"), (F.col(axis) - F.col("h.a")).alias("offset"), value)
    short = [(k, o) for k, (a, b) in enumerate(cells) for o in range(b - a, patch)]
    if not short:
        return held
    pads = F.array(*[F.struct(F.lit(k).alias("patch_idx"), F.lit(o).alias("offset")) for k, o in short])
    added = voxels.select(case).distinct().select(case, F.inline(pads)).withColumn(value, F.lit(fill))
    return held.unionByName(added)


def window(kind: str, patch: int, overlap: int) -> list[float]:
    """Blending weights along an axis."""
    if overlap <= 0 or kind == "mean":
        return [1.0] * patch
    if kind == "cosinus":
        ramp = [math.sin((i + 0.5) / overlap * math.pi / 2) ** 2 for i in range(overlap)]
        return [min(ramp[i] if i < overlap else 1.0, ramp[patch - 1 - i] if patch - 1 - i < overlap else 1.0) for i in range(patch)]
    sigma = 0.125 * patch
    return [math.exp(-((i - (patch - 1) / 2) ** 2) / (2 * sigma * sigma)) for i in range(patch)]


def blend(pieces: DataFrame, case: str, value: str, extent: int, patch: int, overlap: int, kind: str) -> DataFrame:
    """case, x, value: weighted mean of all patches over a voxel; padding is dropped."""
    cells = grid_axis(extent, patch, overlap)
    starts, weights = F.array(*[F.lit(a) for a, _ in cells]), F.array(*map(F.lit, window(kind, patch, overlap)))
    placed = pieces.select(case, (F.get(starts, F.col("patch_idx")) + F.col("offset")).alias("x"), value, F.get(weights, F.col("offset")).alias("w")).where(F.col("x") < extent)
    return placed.groupBy(case, "x").agg((F.sum(F.col("w") * F.col(value)) / F.greatest(F.sum("w"), F.lit(1e-300))).alias(value))


def overwrite(pieces: DataFrame, case: str, value: str, extent: int, patch: int, overlap: int) -> DataFrame:
    """case, x, value: the last patch over a voxel wins."""
    starts = F.array(*[F.lit(a) for a, _ in grid_axis(extent, patch, overlap)])
    placed = pieces.withColumn("x", F.get(starts, F.col("patch_idx")) + F.col("offset")).where(F.col("x") < extent)
    return placed.groupBy(case, "x").agg(F.max_by(value, "patch_idx").alias(value))
