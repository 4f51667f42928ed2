"""Spatial transforms as matrices in columns, geometry without voxels, boxes of labels.

A transform is an array of rows, each with a shift at its end; points, origins and spacings are in x, y, z order.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridspan.functions.arrays import apply_matrix, let, multiply, total


def identity_rows(rank: int) -> Column:
    return F.array(*[F.array(*[F.lit(float(i == j)) for j in range(rank + 1)]) for i in range(rank)])


def composed(transforms: Column, rank: int = 3) -> Column:
    """One transform from an array of them, applied in order; the identity for none."""
    square = lambda rows: F.concat(rows, F.array(F.array(*[F.lit(float(j == rank)) for j in range(rank + 1)])))
    whole = F.aggregate(transforms, square(identity_rows(rank)), lambda done, t: multiply(square(t), done))
    return F.slice(whole, 1, rank)


def moved_point(rows: Column, point: Column) -> Column:
    return apply_matrix(rows, point)


def moved_points(points: DataFrame, axes: list[str], rows: Column) -> DataFrame:
    """Points (a column for each axis) through a transform column."""
    point = F.array(*[F.col(a) for a in axes])
    out = points.withColumn("__p", apply_matrix(rows, point))
    return out.withColumns({a: F.get("__p", F.lit(k)) for k, a in enumerate(axes)}).drop("__p")


def rigid_parameters(rows: Column) -> Column:
    """Angles about x, y, z and the shift of a rigid transform that turns about x first, then y, then z."""

    def of(m: Column) -> Column:
        at = lambda i, j: F.get(F.get(m, F.lit(i)), F.lit(j))
        return F.array(F.atan2(at(2, 1), at(2, 2)), F.asin(F.greatest(F.least(-at(2, 0), F.lit(1.0)), F.lit(-1.0))), F.atan2(at(1, 0), at(0, 0)), at(0, 3), at(1, 3), at(2, 3))

    return let(rows, of)


def moved_geometry(origin: Column, direction: Column, rows: Column) -> Column:
    """struct(origin, direction) of a volume moved by the inverse of a rigid transform: its voxels stay, its place changes."""

    def of(m: Column) -> Column:
        n = F.size(origin)
        at = lambda i, j: F.get(F.get(m, i), j)
        axes = F.sequence(F.lit(0), n - 1)
        back = F.zip_with(origin, m, lambda o, r: o - F.get(r, n))
        new_origin = F.transform(axes, lambda j: F.aggregate(F.transform(back, lambda b, i: b * at(i, j)), F.lit(0.0), lambda a, v: a + v))
        new_direction = F.flatten(F.transform(axes, lambda j: F.transform(axes, lambda k: F.aggregate(F.transform(axes, lambda i: at(i, j) * F.get(direction, i * n + k)), F.lit(0.0), lambda a, v: a + v))))
        return F.struct(new_origin.alias("origin"), new_direction.alias("direction"))

    return let(rows, of)


def parameter_map(text: Column) -> Column:
    """A map of names to values from lines ``(Name value value ...)``; quotes are taken off."""
    entries = F.regexp_extract_all(text, F.lit(r"(?m)^\s*\(([A-Za-z0-9_]+)\s+([^)]*)\)"), F.lit(0))
    name = lambda e: F.regexp_extract(e, r"\(([A-Za-z0-9_]+)", 1)
    value = lambda e: F.transform(F.filter(F.split(F.regexp_replace(F.regexp_extract(e, r"\([A-Za-z0-9_]+\s+([^)]*)\)", 1), '"', ""), r"\s+"), lambda x: x != ""), lambda x: x)
    return F.map_from_entries(F.transform(entries, lambda e: F.struct(name(e).alias("key"), value(e).alias("value"))))


def transform_of_parameters(parameters: Column) -> Column:
    """Rows of an Euler or translation transform about its centre of rotation, from a parameter map of three dimensions; null for other kinds."""
    numbers = lambda key: F.transform(F.try_element_at(parameters, F.lit(key)), lambda x: x.try_cast("double"))
    kind = F.get(F.try_element_at(parameters, F.lit("Transform")), F.lit(0))
    p, c = numbers("TransformParameters"), F.coalesce(numbers("CenterOfRotationPoint"), F.array(*[F.lit(0.0)] * 3))

    def euler(both: Column) -> Column:
        v = lambda k: F.get(both["p"], F.lit(k))
        (cx, sx), (cy, sy), (cz, sz) = [(F.cos(v(k)), F.sin(v(k))) for k in range(3)]
        zero, one = F.lit(0.0), F.lit(1.0)
        x = F.array(F.array(one, zero, zero), F.array(zero, cx, -sx), F.array(zero, sx, cx))
        y = F.array(F.array(cy, zero, sy), F.array(zero, one, zero), F.array(-sy, zero, cy))
        z = F.array(F.array(cz, -sz, zero), F.array(sz, cz, zero), F.array(zero, zero, one))
        turn = multiply(multiply(z, x), y)
        # A turn about a centre shifts by what the turn moves the centre.
        return let(turn, lambda r: F.transform(r, lambda row, i: F.concat(row, F.array(F.get(both["p"], i + 3) + F.get(both["c"], i) - total(F.zip_with(row, both["c"], lambda a, b: a * b))))))

    shifted = F.transform(F.sequence(F.lit(0), F.lit(2)), lambda i: F.concat(F.transform(F.sequence(F.lit(0), F.lit(2)), lambda j: (i == j).cast("double")), F.array(F.get(p, i))))
    turned = let(F.struct(p.alias("p"), c.alias("c")), euler)
    return F.when(kind == "EulerTransform", turned).when(kind == "TranslationTransform", shifted)


def label_boxes(voxels: DataFrame, keys: list[str], label: str, labels: list[int], axes: list[str], grow: dict[str, int], extent: dict[str, int]) -> DataFrame:
    """keys and for each axis <axis>_from, <axis>_to (exclusive): the box of the chosen labels, grown on both sides within the extent. Groups without them have no row."""
    inside = voxels.where(F.col(label).isin(*labels))
    ends = [F.greatest(F.min(a) - grow.get(a, 0), F.lit(0)).alias(f"{a}_from") for a in axes] + [F.least(F.max(a) + 1 + grow.get(a, 0), F.lit(extent[a])).alias(f"{a}_to") for a in axes]
    return inside.groupBy(*keys).agg(*ends)


def cropped(voxels: DataFrame, keys: list[str], boxes: DataFrame, axes: list[str]) -> DataFrame:
    """Voxels inside their group's box, coordinates from the box on."""
    names = [c for c in boxes.columns if c not in keys]
    joined = voxels.join(boxes.select(*[F.col(k).alias(f"__k_{k}") for k in keys], *names), [F.col(k).eqNullSafe(F.col(f"__k_{k}")) for k in keys])
    inside = F.lit(True)
    for a in axes:
        inside = inside & (F.col(a) >= F.col(f"{a}_from")) & (F.col(a) < F.col(f"{a}_to"))
    moved = joined.where(inside).withColumns({a: F.col(a) - F.col(f"{a}_from") for a in axes})
    return moved.select(*voxels.columns)


def resized_spacing(spacing: list[float], extents: list[int], target: float | None = None) -> tuple[list[float], list[int]]:
    """Isotropic spacing (the least one, or a target) and the extents that keep the size."""
    one = target or min(spacing)
    return [one] * len(spacing), [int(math.floor(n * s / one + 0.5)) for n, s in zip(extents, spacing, strict=True)]


def clip_and_cast(values: Column, low: float, high: float, dtype: str) -> Column:
    return F.transform(values, lambda v: F.least(F.greatest(v, F.lit(low)), F.lit(high)).cast(dtype))
