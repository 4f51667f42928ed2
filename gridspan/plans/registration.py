"""Registrations scored by whatever a case has: images by mean absolute error, label maps by Dice, landmarks by distance.

A case's displacement field, in voxels of the fixed grid, leads from a fixed place to the moving one. What is moving is sampled through it
(labels at the nearest voxel) before it is compared; a case without a field is taken as registered already. A modality whose pair is
not there has no row.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridspan.operators import kernels, volume
from gridspan.operators.volume import Grid


def _zero(field: Column, grid: Grid) -> Column:
    return F.coalesce(field, F.array_repeat(F.lit(0.0), grid.size))


def absolute_error(fixed: Column, moved: Column, mask: Column | None) -> Column:
    """Mean over the voxels where the mask is 1, or over all; null without one."""

    @F.arrow_udf("double")
    def of(a: pa.Array, b: pa.Array, m: pa.Array) -> pa.Array:
        out = []
        for x, y, w in zip(*map(kernels.rows_of, (a, b, m)), strict=True):
            d = None if x is None or y is None else np.abs(x - y)[slice(None) if w is None else w == 1]
            out.append(float(d.mean()) if d is not None and d.size else None)
        return pa.array(out, pa.float64())

    return of(fixed, moved, F.lit(None).cast("array<double>") if mask is None else mask.cast("array<double>"))


def overlap(fixed: Column, moved: Column) -> Column:
    """Mean Dice over the labels of the fixed map, 0 left out; null where it has none."""

    @F.arrow_udf("double")
    def of(a: pa.Array, b: pa.Array) -> pa.Array:
        out = []
        for x, y in zip(kernels.rows_of(a), kernels.rows_of(b), strict=True):
            labels = [] if x is None or y is None else [v for v in np.unique(x) if v and not np.isnan(v)]
            out.append(float(np.mean([2 * ((x == v) & (y == v)).sum() / ((x == v).sum() + (y == v).sum()) for v in labels])) if labels else None)
        return pa.array(out, pa.float64())

    return of(fixed, moved)


def landmark_error(fixed: Column, moving: Column, fields: list[Column], grid: Grid) -> Column:
    """Mean distance in voxels between the moving landmarks and the fixed ones as the field moves them; arrays of places in array order, by index."""

    @F.arrow_udf("double")
    def of(a: pa.Array, b: pa.Array, *moves: pa.Array) -> pa.Array:
        read = [kernels.matrix_of(m, grid.size)[0] for m in moves]
        out = []
        for r, (p, q) in enumerate(zip(a.to_pylist(), b.to_pylist(), strict=True)):
            n = min(len(p or []), len(q or []))
            if not n:
                out.append(None)
                continue
            at, there = np.array(p[:n], float).T, np.array(q[:n], float).T
            moved = at + np.stack([kernels.sampled_rows(f[r : r + 1], grid.shape, lambda _: [c[None] for c in at], n, "border", False)[0] for f in read])  # noqa: B023
            out.append(float(np.sqrt(((moved - there) ** 2).sum(0)).mean()))
        return pa.array(out, pa.float64())

    return of(fixed, moving, *fields)


def evaluate(
    cases: DataFrame, keys: list[str], grid: Grid, fields: list[str], image: tuple[str, str] | None = None, labels: tuple[str, str] | None = None, landmarks: tuple[str, str] | None = None, mask: str | None = None
) -> DataFrame:
    """keys, metric (MAE, Dice, TRE), value. Pairs name the fixed and the moving column; ``fields`` are the displacements, an array column for each axis."""
    zeroed = cases.withColumns({f: _zero(F.col(f).cast("array<double>"), grid) for f in fields})
    moves, scores = [F.col(f) for f in fields], []
    if image:
        zeroed = zeroed.withColumn("__image", volume.displace(F.col(image[1]), grid, moves, "zeros"))
        scores.append(("MAE", absolute_error(F.col(image[0]).cast("array<double>"), F.col("__image"), None if mask is None else F.col(mask))))
    if labels:
        zeroed = zeroed.withColumn("__labels", volume.displace(F.col(labels[1]), grid, moves, "zeros", labels=True))
        scores.append(("Dice", overlap(F.col(labels[0]).cast("array<double>"), F.col("__labels"))))
    if landmarks:
        scores.append(("TRE", landmark_error(F.col(landmarks[0]).cast("array<array<double>>"), F.col(landmarks[1]).cast("array<array<double>>"), moves, grid)))
    if not scores:
        raise ValueError("nothing to compare")
    scored = zeroed.select(*keys, *[s.alias(name) for name, s in scores])
    rows = F.array(*[F.struct(F.lit(name).alias("metric"), F.col(name).alias("value")) for name, _ in scores])
    return scored.select(*keys, F.inline(rows)).where("value is not null")
